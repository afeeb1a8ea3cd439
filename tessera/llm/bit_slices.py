"""Exact top-k inner products over a bit-sliced index.

Components are quantised to integers. A block of rows keeps, for each component and each binary digit, one bitmap with a bit
for each row. A query's scores are sums of these bitmaps, shifted by the digits of its own components: all bitmaps of one
place are added three at a time (sum and carry), until one is left. The best rows are read from the highest
place down, and rows that tie at the boundary are resolved by their ids.

Null vectors, vectors with a null or non-finite component and rows without an id take no part. Vectors of different lengths
meet as if followed by zeros; equal rows are all candidates, and a query that occurs twice is answered twice; what has the query's own
id is no candidate. Components that are too large for scores of 62 bits raise. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import map_arrow, written

U64 = np.uint64
#: Rows of an index block and queries of a query block.
BLOCK_ROWS, QUERY_ROWS = 16_384, 8_192
#: Bytes of all queries up to which they are broadcast, and bytes of candidates that a task holds at once.
BROADCAST_BYTES = 64 << 20
#: Index blocks that meet one query block in one cell of a shuffled join.
CELL_BLOCKS = 32


def quantised(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, rows of floor(scale * component)) of the vectors that take part, shorter ones followed by zeros."""
    ids, vectors = batch.column("vec_id"), batch.column("embedding")
    n = np.asarray(vectors.value_lengths().fill_null(0)).astype(np.int64)
    flat = np.asarray(vectors.flatten().cast(pa.float64()).fill_null(np.nan))
    row = np.repeat(np.arange(len(n)), n)
    good = ~np.asarray(vectors.is_null()) & ~np.asarray(ids.is_null())
    good[row[~np.isfinite(flat)]] = False
    out = np.zeros((len(n), int(n[good].max(initial=0))), np.int64)
    keep = good[row]
    value = np.floor(scale * flat[keep])
    if len(value) and not np.abs(value).max() < 2.0**52:
        raise ValueError("quantised components must be below 2**52")
    out[row[keep], (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n))[keep]] = value.astype(np.int64)
    return np.asarray(ids.fill_null(0)).astype(np.int64)[good], out[good]


def _stacked(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    wide = max(v.shape[1] for _, v in parts)
    return np.concatenate([i for i, _ in parts]), np.concatenate([np.pad(v, ((0, 0), (0, wide - v.shape[1]))) for _, v in parts])


def _blocks(batches: Iterator[pa.RecordBatch], scale: float, rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(key, ids, quantised rows) of at most `rows` rows."""
    context = TaskContext.get()
    key, held, n = (context.partitionId() if context else 0) << 32, [], 0
    for batch in batches:
        ids, values = quantised(batch, scale)
        at = 0
        while at < len(ids):
            take = min(rows - n, len(ids) - at)
            held.append((ids[at : at + take], values[at : at + take]))
            at, n = at + take, n + take
            if n == rows:
                yield key, *_stacked(held)
                key, held, n = key + 1, [], 0
    if n:
        yield key, *_stacked(held)


def slices_of(values: np.ndarray) -> np.ndarray:
    """(components, digits, words) bitmaps of values + 2**(digits - 1), which is not negative: bit r of a bitmap is row r's."""
    rows, dims = values.shape
    top = int(max(values.max(initial=0), -(values.min(initial=0) + 1)))
    digits = top.bit_length() + 1
    shifted = (values + (1 << (digits - 1))).T
    padded = np.zeros((dims, -(-rows // 64) * 64), np.int64)
    padded[:, :rows] = shifted
    maps = np.stack([np.packbits(((padded >> b) & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(digits)], axis=1)
    return np.ascontiguousarray(maps).view(U64)


def added(base: np.ndarray, digits: int, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bitmaps of the sums of each query, lowest place first; what is to be taken off each query's sums) of inner products with a block.

    `base`: the block's bitmaps, (component, digit) after (component, digit), then the complement of each, which negative components take,
    and an empty bitmap, which fills up queries with fewer bitmaps at a place than others.
    """
    half, size = 1 << (digits - 1), np.abs(queries)
    width = int(size.max(initial=0)).bit_length()
    query, component, shift = np.nonzero((size[:, :, None] >> np.arange(max(width, 1))) & 1)
    first = component * digits + np.where(queries[query, component] < 0, len(base) // 2, 0)
    out, carried, place = [], [], 0
    while place < width + digits - 1 or carried:
        mine = np.flatnonzero((place - shift >= 0) & (place - shift < digits))
        of = query[mine]
        n = np.bincount(of, minlength=len(queries))
        which = np.full((len(queries), int(n.max(initial=0))), len(base) - 1)
        which[of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)] = (first + place - shift)[mine]
        x = np.concatenate([base[which], *carried], axis=1)
        carried = []
        while x.shape[1] > 2:
            m = x.shape[1] // 3
            a, b, c = x[:, :m], x[:, m : 2 * m], x[:, 2 * m : 3 * m]
            odd = a ^ b
            carried.append((a & b) | (odd & c))
            x = np.concatenate([odd ^ c, x[:, 3 * m :]], axis=1)
        if x.shape[1] == 2:
            carried.append(x[:, :1] & x[:, 1:])
            x = x[:, :1] ^ x[:, 1:]
        out.append(x[:, 0] if x.shape[1] else np.zeros((len(queries), base.shape[1]), U64))
        place += 1
    if len(out) > 62:
        raise ValueError("scores of more than 62 bits")
    sums = np.stack(out, axis=1) if out else np.zeros((len(queries), 0, base.shape[1]), U64)
    return sums, size.sum(1) * half - np.where(queries < 0, size, 0).sum(1)


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def highest(sums: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, sums) of the k highest sums among the allowed rows, ties to smaller ids: from the highest place down."""
    sure, maybe, n = np.zeros_like(allowed), allowed, 0
    for place in sums[::-1]:
        up = maybe & place
        more = int(np.bitwise_count(up).sum())
        if n + more > k:
            maybe = up
        else:
            sure, maybe, n = sure | up, maybe & ~place, n + more
            if n == k:
                break
    rows = _rows(sure)
    if n < k:  # what is left has equal sums
        ties = _rows(maybe)
        rows = np.concatenate([rows, ties[np.argsort(ids[ties], kind="stable")[: k - n]]])
    value = np.zeros(len(rows), np.int64)
    for i, place in enumerate(sums):
        value |= ((place[rows >> 6] >> (rows & 63).astype(U64)) & U64(1)).astype(np.int64) << i
    return rows, value


def bit_sliced_index(vectors: DataFrame, scale: float = 256.0, rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, dims, digits, ids, slices): every vector that takes part stands in one block."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, values in _blocks(batches, scale, rows):
            maps = slices_of(values)
            cells = [[key], [values.shape[1]], [maps.shape[1]], [ids.tobytes()], [maps.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "dims", "digits", "ids", "slices"])

    return map_arrow(vectors.select("vec_id", "embedding"), build, "block long, dims int, digits int, ids binary, slices binary")


def query_blocks(queries: DataFrame, scale: float = 256.0, rows: int = QUERY_ROWS) -> DataFrame:
    """(q_block, q_ids, q_values): the quantised queries, many in a row."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, values in _blocks(batches, scale, rows):
            cells = [[key], [ids.tobytes()], [values.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["q_block", "q_ids", "q_values"])

    return map_arrow(queries.select("vec_id", "embedding"), build, "q_block long, q_ids binary, q_values binary")


class _Best:
    """The k best candidates so far of each query of one block."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

    def add(self, at: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = (np.concatenate(x) for x in zip(self.found[at], (ids, scores), strict=True))
        order = np.lexsort((ids, -scores))[: self.k]
        self.found[at] = ids[order], scores[order]

    def rows(self, key: int) -> pa.RecordBatch:
        n = [len(i) for i, _ in self.found]
        each = np.repeat(np.arange(len(n)), n)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(each), key)), pa.array(each), pa.array(self.ids[each]), pa.array(np.concatenate([i for i, _ in self.found])), pa.array(np.concatenate([s for _, s in self.found]))], names=["q_block", "q_row", "query_id", "vec_id", "score"])


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        last = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] != last:
                    last, ids = r["block"], np.frombuffer(r["ids"], np.int64)
                    there = np.packbits(np.arange(-(-len(ids) // 64) * 64) < len(ids), bitorder="little").view(U64)
                    maps = np.frombuffer(r["slices"], U64).reshape(-1, len(there))
                    base = np.concatenate([maps, ~maps, np.zeros((1, len(there)), U64)])
                    place = np.argsort(ids, kind="stable")
                q_ids = np.frombuffer(r["q_ids"], np.int64)
                values = np.frombuffer(r["q_values"], np.int64).reshape(len(q_ids), -1)
                queries = np.zeros((len(q_ids), r["dims"]), np.int64)
                shared = min(r["dims"], values.shape[1])
                queries[:, :shared] = values[:, :shared]
                low, high = (np.searchsorted(ids[place], q_ids, side) for side in ("left", "right"))
                mine, step = best.setdefault(r["q_block"], _Best(q_ids, k)), max(1, 512 // len(there))
                for at in range(0, len(q_ids), step):
                    sums, off = added(base, r["digits"], queries[at : at + step])
                    for i in range(len(sums)):
                        allowed, own = there, place[low[at + i] : high[at + i]]
                        if len(own):
                            allowed = there.copy()
                            np.bitwise_and.at(allowed, own >> 6, ~(U64(1) << (own & 63).astype(U64)))
                        rows, value = highest(sums[i], allowed, ids, k)
                        mine.add(at + i, ids[rows], value - off[i])
                if sum(len(b.ids) for b in best.values()) * (k + 1) * 16 > BROADCAST_BYTES:
                    yield from (b.rows(key) for key, b in best.items())
                    best = {}
        yield from (b.rows(key) for key, b in best.items())

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row of `queries` the k rows of `vectors` with the highest integer inner product, ties to smaller ids.

    Both have vec_id and embedding. Every index block meets every query block in one row of an equi-join, whose sides are
    numbered for that: few queries are broadcast, many are dealt to cells of bounded size. Tasks send the best rows only.
    """
    index, asked = written(bit_sliced_index(vectors, scale, block_rows), "index"), written(query_blocks(queries, scale, query_rows), "queries")
    size = asked.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum(F.length("q_values") + F.length("q_ids")), F.lit(0)).alias("bytes")).first()
    groups = max(size["blocks"], 1)
    asked = asked.withColumn("g", F.pmod(F.xxhash64("q_block"), F.lit(groups)))
    index = index.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    if size["bytes"] <= BROADCAST_BYTES:
        pairs = index.join(F.broadcast(asked), "g")
    else:
        cells = -(-index.select("block").distinct().count() // CELL_BLOCKS)
        asked = asked.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
        pairs = index.withColumn("s", F.pmod(F.xxhash64("block"), F.lit(cells))).join(asked, ["g", "s"])
    found = map_arrow(pairs.select("block", "dims", "digits", "ids", "slices", "q_block", "q_ids", "q_values"), _search(k), "q_block long, q_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
