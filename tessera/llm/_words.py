"""Words of whole texts as 64-bit hashes, for many texts at a time.

Everything works on the UTF-8 bytes of an Arrow string column. A word is a run of bytes
outside ``[\\x20\\x09-\\x0D]``; bytes of non-ASCII characters never fall in that class, so byte
positions and character positions split alike. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of text that are handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scramble of unsigned 64-bit values (multiply and shift rounds)."""
    x = x.astype(U64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U64(shift)
        x *= U64(factor)
    return x ^ (x >> U64(31))


#: Bytes of a word that are hashed in blocks of eight for many words at once; longer words are hashed one by one.
BLOCK_BYTES = 128
#: Masks that keep the first 0 to 8 bytes of a little-endian block.
HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


@lru_cache(maxsize=8)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    return _powers(int(base), max(12, int(n).bit_length()))[:n]


def _head_hash(head: np.ndarray, length: np.ndarray) -> np.ndarray:
    return mix(mix(length.astype(U64)) ^ (head & HEAD[np.minimum(length, 8)]))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, first eight bytes) of each span of bytes: its length and then block after block of eight bytes, each
    scrambled into what came before, so that no structure of the bytes cancels out."""
    length = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    block = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    head = block[start]
    value = _head_hash(head, length)
    more, k = np.flatnonzero(length > 8), 8
    while len(more) and k < BLOCK_BYTES:
        value[more] = mix(value[more] ^ (block[start[more] + k] & HEAD[np.minimum(length[more] - k, 8)]))
        k += 8
        more = more[length[more] > k]
    for i in more.tolist():
        value[i] = U64(int.from_bytes(blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little"))
    return value, head


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most `limit` bytes of text, or one row: (slice, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


@dataclass
class Words:
    """Words of a chunk in text order."""

    start: np.ndarray  # first byte
    end: np.ndarray  # byte after the last
    row: np.ndarray  # row of the chunk
    first: np.ndarray  # n_rows + 1: index of each row's first word
    hash: np.ndarray
    head: np.ndarray  # first eight bytes


def find_words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE, lower: bool = False) -> Words:
    inside = ~space[data]
    n = len(data)
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        begins[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(start, offsets)
    value, head = span_hashes(LOWER[data] if lower else data, start, end)
    return Words(start, end, row, first, value, head)


def prefix_hash(words: Words, length: int) -> np.ndarray:
    """Hash of each word's first `length` bytes, at most eight; words not longer than that hash as whole words do."""
    return _head_hash(words.head, np.minimum(words.end - words.start, length))


def windows(words: Words, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each run of k words within one row; another salt gives a hash that does not depend on the first."""
    n = len(words.hash)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    odd = U64(0x9FB21C651E98DF25)
    hashes = mix(words.hash ^ U64(salt)) if salt else words.hash
    if k <= 8:
        value = np.zeros(n - k + 1, U64)
        for j, p in enumerate(powers(odd, k)):
            value += hashes[j : n - k + 1 + j] * p
    else:
        inverse = U64(pow(int(odd), -1, 1 << 64))
        sums = np.zeros(n + 1, U64)
        np.cumsum(hashes * powers(odd, n), out=sums[1:])
        value = (sums[k:] - sums[:-k]) * powers(inverse, n - k + 1)
    at = np.flatnonzero(words.row[k - 1 :] == words.row[: n - k + 1])
    return at, mix(value[at] + U64(k))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ragged(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An Arrow list column with counts[i] of the values in row i."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def distinct_by_row(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs, sorted by row, then value."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]


#: Bytes between words of letters: ASCII bytes that are no letter. Bytes of non-ASCII characters count as letters.
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals of UTF-8 bytes in lower case; every byte stays in its place."""
    out = LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    b = out[at]
    out[at] = np.where((b >= 0x80) & (b <= 0x9E) & (b != 0x97), b + 0x20, b)
    return out


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys in a sorted array, -1 where missing."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)
