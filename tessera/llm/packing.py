"""Packing documents into fixed-size token sequences with a controlled mixture of sources.

Each source is a queue of tokens in table order. Deficit round-robin serves the queues: in
round n source s may have been served floor(n * w_s / d) tokens in all, where d gives a round a
sixteenth of a window, so what a round could not serve of its quantum w_s / d is carried to the next round, window and partition. A source
that runs dry drops out and the others go on; rounds are then shorter, and as a window holds many of them, it still has each source at its share of what is left. The rounds form one stream, cut at every
`window` tokens. Since the served amounts are a closed form of the round number, the place of
any token follows from its position in its queue alone: no task waits for another. Only the
token counts of (partition, source) meet in a shuffle.

Every source is a queue of its own, however many there are. Sources with the same quantum and token count are one
kind; sums over queues are prefix sums over the kinds of each quantum, of which there are few (about 1,500), so that
no task holds a list of the sources.

The last, short window is cut into sequences whose lengths are powers of two, so that nothing
is padded.

Cases: a null or empty text is a document with the end id alone; a null source is a queue of
its own; repeated rows are packed once each; an empty table gives no rows. Tokens of a document
of any length are cut at window ends only. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import map_arrow, small_side, written
from ._words import LOWER, chunks, find_words, span_hashes

QUANTA = 1 << 20  # resolution of target shares
FINE = 16  # rounds in a window while no source is dry
CACHE_WORDS = 600_000  # words whose ids a task keeps
TAIL = "!\"#$%&()*+,-./:;=?@]^_`{|}~>"  # ASCII marks that may follow a word
MARK = "\x01"  # stands between words that are encoded in one call
TAIL_BYTE, ALNUM_BYTE = np.zeros(256, bool), np.zeros(256, bool)
TAIL_BYTE[[ord(c) for c in TAIL]] = True
ALNUM_BYTE[[i for i in range(128) if chr(i).isalnum()]] = True
#: What the pre-tokenizer never joins across: the space and the line feed.
BREAK = np.zeros(256, bool)
BREAK[[0x20, 0x0A]] = True


class _Pieces:
    """Runs of ids in one flat array: slot i has count[i] ids from first[i] on. Keys are 64-bit hashes."""

    def __init__(self, kind: np.dtype, ids: list[int]) -> None:
        self.slots: dict[int, int] = {}
        self.flat, self.first, self.count = np.array(ids, kind), np.zeros(1, np.int64), np.array([len(ids)])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys, -1 where unknown."""
        get = self.slots.get
        return np.fromiter((get(k, -1) for k in keys.tolist()), np.int64, len(keys))

    def add(self, keys: np.ndarray, ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        new = np.arange(len(self.count), len(self.count) + len(keys))
        self.slots.update(zip(keys.tolist(), new.tolist(), strict=True))
        self.first, self.count = np.concatenate([self.first, len(self.flat) + first]), np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, ids])
        return new

    def joined(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of these slots one after the other, where each one's end)."""
        count = self.count[slots]
        ends = np.cumsum(count)
        return self.flat[np.repeat(self.first[slots] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)], ends


class _TokenIds:
    """Ids of texts, with the ids of words kept.

    The pre-tokenizer never joins what a space or line feed parts, so ids of a text are the ids of its words in turn. Nor does it
    join a core that ends in a letter or digit with the marks after it, and letters count as small. So a word's ids are those of its core
    and of its marks, and only new cores are encoded. Words and cores are told apart by 64-bit hashes.
    """

    def __init__(self, path: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u4" if self.tokenizer.get_vocab_size() > 1 << 16 else "<u2")
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.end_id = end_id
        self._forget()

    def _forget(self) -> None:
        self.words, self.parts = _Pieces(self.kind, [self.end_id]), _Pieces(self.kind, [])

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, count) of texts: many in one call, parted by a mark of one id that none of them holds; the others one by one."""
        found, first, count, at = [], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), 0
        joint = np.array([len(self.mark) == 1 and MARK not in t for t in texts], bool)
        groups = [np.flatnonzero(joint)[k : k + 2048] for k in range(0, int(joint.sum()), 2048)] + [np.array([k]) for k in np.flatnonzero(~joint)]
        for group in groups:
            ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join([texts[k] for k in group])], add_special_tokens=False)[0].ids, self.kind)
            cut = np.flatnonzero(ids == self.mark[0]) if joint[group[0]] else np.zeros(0, np.int64)
            first[group] = at + np.append(0, cut + 1)
            count[group] = np.append(cut, len(ids)) - np.append(0, cut + 1)
            found.append(ids)
            at += len(ids)
        return np.concatenate(found), first, count

    def _learn(self, data: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Slots for new words."""
        cut, some = end.copy(), np.arange(len(end))
        while len(some):
            some = some[(cut[some] > start[some]) & TAIL_BYTE[data[cut[some] - 1]]]
            cut[some] -= 1
        last, before = data[cut - 1], data[np.maximum(cut - 2, 0)]
        latin = (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (cut - 2 >= start)  # letters of Latin-1
        sums = lambda hit: np.append(0, np.cumsum(hit))
        angle, high = sums(data == ord("<")), sums(data >= 0x80)
        parted = (cut > start) & (ALNUM_BYTE[last] | latin) & (angle[end] == angle[start])  # special tokens hold "<|"
        cut = np.where(parted, cut, end)
        small = parted & (high[cut] == high[start])
        low = LOWER[data]
        core = np.where(small, span_hashes(low, start, cut)[0], span_hashes(data, start, cut)[0])
        tailed = np.flatnonzero(cut < end)
        tail = span_hashes(data, cut[tailed], end[tailed])[0]
        known, index, inverse = np.unique(np.concatenate([core, tail]), return_index=True, return_inverse=True)
        slot = self.parts.find(known)
        new = np.flatnonzero(slot < 0)
        if len(new):
            raw, lowered_ = data.tobytes(), low.tobytes()
            i = index[new]
            from_, to = np.concatenate([start, cut[tailed]])[i], np.concatenate([cut, end[tailed]])[i]
            is_small = np.append(small, np.zeros(len(tailed), bool))[i]
            texts = [(lowered_ if x else raw)[b:e].decode() for x, b, e in zip(is_small.tolist(), from_.tolist(), to.tolist(), strict=True)]
            slot[new] = self.parts.add(known[new], *self._encode(texts))
        both = np.zeros((len(core), 2), np.int64)  # slot 0 has no ids
        both[:, 0], both[tailed, 1] = slot[inverse[: len(core)]], slot[inverse[len(core) :]]
        ids, ends = self.parts.joined(both.ravel())
        count = np.diff(ends[1::2], prepend=0)
        return self.words.add(keys, ids, np.cumsum(count) - count, count)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, number of each row) of a chunk of texts; each row ends with the end id."""
        words = find_words(data, offsets, BREAK)
        if len(self.words.count) > CACHE_WORDS:
            self._forget()
        known, index, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        slot = self.words.find(known)
        new = np.flatnonzero(slot < 0)
        if len(new):
            slot[new] = self._learn(data, known[new], words.start[index[new]], words.end[index[new]])
        ids, ends = self.words.joined(np.insert(slot[inverse], words.first[1:], 0))  # slot 0 has the end id
        return ids, np.diff(ends[words.first[1:] + np.arange(len(offsets) - 1)], prepend=0)


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int, text: str, source: str, doc_id: str) -> DataFrame:
    """(doc_id, source, ids, width, n, part, before): before counts the source's earlier tokens of the same task."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = _TokenIds(tokenizer_path, end_id)
        part, served, width = TaskContext.get().partitionId(), {}, to_ids.kind.itemsize
        for batch, data, offsets in chunks(batches, "text"):
            ids, n = to_ids.of(data, offsets)
            before = []
            for name, k in zip(batch.column(1).to_pylist(), n.tolist(), strict=True):
                before.append(served.get(name, 0))
                served[name] = before[-1] + k
            places = np.append(0, np.cumsum(n) * width)
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(places), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), raw, pa.array([width] * len(n), pa.int32()), pa.array(n), pa.array([part] * len(n), pa.int64()), pa.array(before, pa.int64())], ["doc_id", "queue", "ids", "width", "n", "part", "before"])

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("queue"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return map_arrow(plain, encode, "doc_id long, queue string, ids binary, width int, n long, part long, before long")


@dataclass(frozen=True)
class Mixture:
    """Deficit round-robin in closed form over `count[k]` queues of each kind, with `tokens[k]` tokens and integer quantum `quanta[k]`.

    Kinds are sorted by quantum and tokens; a round serves the queues in the order of kind and rank. A group is the kinds of one quantum.
    """

    tokens: np.ndarray
    quanta: np.ndarray
    count: np.ndarray
    window: int

    @property
    def total(self) -> int:
        return int((self.tokens * self.count).sum())

    @cached_property
    def rounds(self) -> int:
        """Rounds in which a quantum is a whole number of tokens; `FINE` rounds of all quanta make a window."""
        return max(1, FINE * QUANTA // self.window)

    @cached_property
    def groups(self) -> tuple[np.ndarray, ...]:
        """quantum, first kind and end of each group; the group of each kind; sums of queues and of tokens before each kind; sorted keys of the kinds."""
        quantum, first, group = np.unique(self.quanta, return_index=True, return_inverse=True)
        queues, sums = (np.append(0, np.cumsum(x)) for x in (self.count, self.count * self.tokens))
        return quantum, first, np.append(first[1:], len(self.tokens)), group, queues, sums, self._key(group, self.tokens)

    def _key(self, group: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        top = int(self.tokens.max()) + 1
        return group * (top + 1) + np.minimum(tokens, top)

    def kind(self, quanta: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.groups[6], self._key(np.searchsorted(self.groups[0], quanta), tokens))

    def starts(self, sequence: np.ndarray) -> np.ndarray:
        """Stream position at which each sequence starts; the tail is cut at powers of two."""
        full = self.total // self.window
        tail = self.total - full * self.window
        cuts, at = [full * self.window], full * self.window
        for bit in range(tail.bit_length() - 1, -1, -1):
            if tail >> bit & 1:
                at += 1 << bit
                cuts.append(at)
        return np.where(sequence < full, sequence * self.window, np.array(cuts)[np.clip(sequence - full, 0, len(cuts) - 1)])

    def sequence(self, place: np.ndarray) -> np.ndarray:
        full = self.total // self.window
        cuts = self.starts(np.arange(full, full + self.window.bit_length() + 1))
        return np.where(place < full * self.window, place // self.window, full + np.searchsorted(np.unique(cuts), place, "right") - 1)

    def reach(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that a queue of each group (columns) may have been served before each round (rows)."""
        quantum, _, end = self.groups[:3]
        last = self.tokens[end - 1] * self.rounds // quantum + 1
        return np.minimum(rounds[:, None], last) * quantum // self.rounds

    def served(self, reach: np.ndarray) -> np.ndarray:
        """Tokens served to all queues of each group."""
        _, first, end, _, queues, sums, keys = self.groups
        dry = np.searchsorted(keys, self._key(np.arange(len(first)), reach), "right")
        return sums[dry] - sums[first] + (queues[end] - queues[dry]) * reach

    def _inside(self, reach: np.ndarray, kind: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Tokens served to the queues before (kind, rank) in its group."""
        _, first, _, group, queues, sums, keys = self.groups
        start = first[group[kind]]
        dry = np.clip(np.searchsorted(keys, self._key(group[kind], reach), "right"), start, kind)
        return sums[dry] - sums[start] + (queues[kind] - queues[dry]) * reach + rank * np.minimum(reach, self.tokens[kind])

    def place(self, kind: np.ndarray, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Stream position of the token at position `at` of its queue."""
        rounds = -(-(at + 1) * self.rounds // self.quanta[kind]) - 1
        low, high = self.reach(rounds), self.reach(rounds + 1)
        before, after = self.served(low), self.served(high)
        rows, group = np.arange(len(at)), self.groups[3][kind]
        earlier = (np.cumsum(after - before, axis=1) - (after - before))[rows, group] + self._inside(high[rows, group], kind, rank) - self._inside(low[rows, group], kind, rank)
        return before.sum(axis=1) + earlier + at - np.minimum(low[rows, group], self.tokens[kind])

    def taken(self, place: np.ndarray, row: np.ndarray, kind: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Among the first `place[row]` tokens of the stream: those of the queue (kind, rank), and those of the queues before it."""
        low = np.zeros(len(place), np.int64)
        high = np.full(len(place), int((self.tokens * self.rounds // self.quanta).max()) + 2)
        while (high - low > 1).any():
            mid = (low + high) // 2
            under = self.served(self.reach(mid)).sum(axis=1) <= place
            low, high = np.where(under, mid, low), np.where(under, high, mid)
        now, then = self.reach(low), self.reach(low + 1)
        before, more = self.served(now), self.served(then) - self.served(now)
        left, group = (place - before.sum(axis=1))[row], self.groups[3][kind]
        a, b = now[row, group], then[row, group]
        inside = self._inside(a, kind, rank)
        earlier = (np.cumsum(more, axis=1) - more)[row, group] + self._inside(b, kind, rank) - inside
        own, own_more = np.minimum(a, self.tokens[kind]), np.minimum(b, self.tokens[kind]) - np.minimum(a, self.tokens[kind])
        return own + np.clip(left - earlier, 0, own_more), (np.cumsum(before, axis=1) - before)[row, group] + inside + np.minimum(left, earlier)


def pack(docs: DataFrame, tokenizer_path: str, *, window: int = 4096, end_id: int = 2, targets: Mapping[str, float] | None = None, text: str = "text", source: str = "source", doc_id: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row for each piece of each document: where it starts and how it is placed in its sequence.

    targets: share of tokens for each source; none means each source's share of all tokens. A source without
    a target is served last. Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue
    and, if asked for, ids (the piece's ids, little-endian) and width (2 or 4 bytes each).
    """
    table = written(tokenized(docs, tokenizer_path, end_id, text, source, doc_id), "tokens")
    parts = written(table.groupBy("part", "queue").agg(F.sum("n").alias("n")), "token-counts")
    totals = written(parts.groupBy("queue").agg(F.sum("n").alias("total")), "source-counts")
    from pyspark.sql import Window

    if targets is None:
        share = totals.withColumn("share", F.col("total") / max(1, totals.agg(F.sum("total")).first()[0] or 0))
    else:
        whole = max(sum(targets.values()), 1e-12)
        wanted = docs.sparkSession.createDataFrame([(k, float(v) / whole) for k, v in targets.items()], "target string, share double")
        share = totals.join(wanted, F.col("queue").eqNullSafe(F.col("target")), "left")
    # The rank of a source among those of its kind; only the kinds go to the driver.
    ranked = share.select("queue", "total", F.greatest(F.lit(1), F.rint(F.coalesce("share", F.lit(0.0)) * QUANTA).cast("long")).alias("quantum"))
    ranked = written(ranked.withColumn("rank", F.row_number().over(Window.partitionBy("quantum", "total").orderBy("queue")).cast("long") - 1), "sources")
    kinds = sorted(tuple(r) for r in ranked.groupBy("quantum", "total").agg(F.count(F.lit(1)).alias("count")).collect())
    quanta, tokens, count = np.array(kinds, np.int64).reshape(-1, 3).T.copy()
    mixture = Mixture(tokens, quanta, count, window)

    # A partition's first position in each queue: running sums over the partitions, a few rows a partition.
    over = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(F.col("part").alias("in_part"), F.col("queue").alias("of"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    bases = bases.join(small_side(ranked), F.col("of").eqNullSafe(F.col("queue"))).drop("queue")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = max(1, 1_000_000 // max(1, len(np.unique(quanta))))
        for whole in batches:
            for lo in range(0, whole.num_rows, min(block, 1024)):
                batch = whole.slice(lo, min(block, 1024))
                width = batch.column("width")[0].as_py()
                n, at, quantum, total, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "at", "quantum", "total", "rank"))
                kind = mixture.kind(quantum, total)
                first = mixture.sequence(mixture.place(kind, rank, at))
                count = mixture.sequence(mixture.place(kind, rank, at + n - 1)) - first + 1
                row = np.repeat(np.arange(len(n)), count)
                seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                for piece in range(0, len(row), block):
                    r, s = row[piece : piece + block], seq[piece : piece + block]
                    known, where = np.unique(s, return_inverse=True)
                    begin, before = mixture.taken(mixture.starts(known), where, kind[r], rank[r])
                    end, before_end = mixture.taken(mixture.starts(known + 1), where, kind[r], rank[r])
                    low = np.maximum(begin, at[r])
                    high = np.minimum(end, at[r] + n[r])
                    keep = high > low
                    r, s, low, high, offset = r[keep], s[keep], low[keep], high[keep], (before_end - before + low - begin)[keep]
                    start = low - at[r]
                    raw = batch.column("ids")
                    cut = [raw[int(i)].as_buffer()[int(a) * width : int(b) * width] for i, a, b in zip(r, start, start + high - low, strict=True)]
                    crc = [zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4")) for x in cut]
                    out = [batch.column("doc_id").take(pa.array(r)), pa.array(start), pa.array(high - low), pa.array(crc, pa.int64()), pa.array(n[r]), pa.array(s), pa.array(offset), batch.column("queue").take(pa.array(r))]
                    if with_ids:
                        out += [pa.array([x.to_pybytes() for x in cut], pa.binary()), pa.array([width] * len(r), pa.int32())]
                    yield pa.RecordBatch.from_arrays(out, names_out)

    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"
    columns += ", ids binary, width int" if with_ids else ""
    names_out = [c.split()[0] for c in columns.split(", ")]
    placed = table.join(small_side(bases, parts.count()), (F.col("part") == F.col("in_part")) & F.col("queue").eqNullSafe(F.col("of"))).select("doc_id", "queue", "ids", "width", "n", "quantum", "total", "rank", (F.col("base") + F.col("before")).alias("at"))
    return map_arrow(placed, place, columns)
