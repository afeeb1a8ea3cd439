"""Collocations by dynamic itemset counting over contiguous phrases.

The corpus is encoded once into shards of word hashes, which are scanned in a cycle. Words are counted from the first scan
on; a longer phrase becomes active with the scan after both its subphrases (all words but the last, all but the first)
have reached the threshold, and is counted for one full cycle, so that each shard is seen once. Lengths overlap: long
phrases of frequent words are counted while rare words still are.

Which phrases are active is never listed. An array of fixed size has, for each length and cell of hashes, the turn from which on a phrase in it
has reached the threshold; the later turn of a phrase's two subphrases is its start, and its cycle ends `shards` turns later.
Phrases that share a cell start too early, or are counted in vain, but always for one whole cycle, so every count is exact at any size of the
corpus. Lengths have cells of their own: a scan looks at phrases of k words only from the turn at which one of k - 1 words reached the threshold. Counts travel and stay as arrays, a row for each bucket of hashes.

Everything is for each language; a null one is `und`. Null and empty texts have no words, pieces never cross rows, rows that are repeated count
again, very long texts are handled whole, and an empty table gives an empty result. Other columns are not read. Words are told apart by 64 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import forget, map_arrow, written
from ._words import LOWER, chunks, find, find_words, mix, ragged, signed

U64 = np.uint64
#: Bytes that end a piece, and those that end a word (the same, and space and tab).
PIECE = np.zeros(256, bool)
PIECE[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
WORD_END = PIECE.copy()
WORD_END[[0x20, 0x09]] = True
#: Cells of hashes of all lengths together, as bits: an array of 16 MB, at any size of the corpus.
BITS = 24
#: Bytes of counts that meet in one bucket, about.
BUCKET_BYTES = 32 << 20
ODD = U64(0x9FB21C651E98DF25)
#: Words of a shard that are handled at once.
CHUNK_WORDS = 1 << 20


class _Sent:
    """Hashes that a task has sent already; it forgets them when there are too many, which repeats some."""

    def __init__(self, most: int = 1 << 20) -> None:
        self.seen, self.most = np.zeros(0, U64), most

    def new(self, hashes: np.ndarray) -> np.ndarray:
        """Which of these distinct hashes have not been sent; now they have."""
        new = find(self.seen, hashes) < 0
        if new.any():
            self.seen = np.union1d(self.seen if len(self.seen) < self.most else self.seen[:0], hashes[new])
        return new


def encoded(docs: DataFrame, shards: int) -> DataFrame:
    """Written table of (shard, lang, n, words, spelled): rows of a shard have their number of words and the words' codes, 0 between pieces; rows of shard -1 spell the codes that a task meets first.

    A code is a hash of word and language.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, spelling, sent = ["shard", "lang", "n", "words", "spelled"], pa.list_(pa.string()), _Sent()
        for part, data, offsets in chunks(batches, "text"):
            data = LOWER[data]
            words = find_words(data, offsets, WORD_END)
            langs = part.column("lang").dictionary_encode()
            seed = np.array([int.from_bytes(blake2b(s.encode(), digest_size=8).digest(), "little") for s in langs.dictionary.to_pylist()], U64)
            lang = np.asarray(langs.indices).astype(np.int64)
            n, code = len(words.hash), mix(words.hash ^ seed[lang][words.row])
            code = np.where(code == 0, U64(1), code)
            piece = np.concatenate([[0], np.cumsum(PIECE[data])])[words.start]
            cut = np.zeros(n, bool)
            cut[1:] = (piece[1:] != piece[:-1]) & (words.row[1:] == words.row[:-1])
            line = np.zeros(n + int(cut.sum()), U64)
            line[np.arange(n) + np.cumsum(cut)] = code
            size = np.diff(words.first).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("shard"), part.column("lang"), pa.array(size), ragged(signed(line), size + np.bincount(words.row[cut], minlength=part.num_rows)), pa.nulls(part.num_rows, spelling)], names=names)
            hashes, one = np.unique(code, return_index=True)
            one = one[sent.new(hashes)]
            if not len(one):
                continue
            of = lang[words.row[one]]
            order = one[np.argsort(of, kind="stable")]
            spelled = [bytes(data[a:b]).decode() for a, b in zip(words.start[order].tolist(), words.end[order].tolist(), strict=True)]
            there, counts = np.unique(of, return_counts=True)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(spelled))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), -1, np.int32)), langs.dictionary.take(pa.array(there)), pa.array(np.zeros(len(there), np.int64)), ragged(signed(code[order]), counts), lists], names=names)

    key = F.xxhash64(*[c for c in ("doc_id", "text") if c in docs.columns])
    some = docs.select(F.pmod(key, F.lit(shards)).cast("int").alias("shard"), F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return written(map_arrow(some, encode, "shard int, lang string, n long, words array<long>, spelled array<string>"), "encoded", by=("shard",))


def _cells(hashes: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return cells[(hashes >> U64(65 - len(cells).bit_length())).astype(np.int64)]


def _grams(words: np.ndarray, sizes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(k, places of the phrases of k words, all hashes of that length, all of length k - 1) of rows of codes, `sizes` each."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    inside, phrase, before = words != 0, words, words
    for k in range(1, longest + 1):
        n = len(words) - k + 1
        if n <= 0:
            return
        if k > 1:
            inside = inside[:-1] & (words[k - 1 :] != 0) & (row[k - 1 :] == row[:n])
            before, phrase = phrase, mix(phrase[:-1] * ODD ^ words[k - 1 :])
        yield k, np.flatnonzero(inside), phrase, before


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(codes, codes in each row, languages of the rows), a bounded number of codes at a time."""
    for batch in batches:
        lists, langs = batch.column("words"), batch.column("lang")
        sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_WORDS, "right")))
            yield np.asarray(lists.slice(at, stop - at).flatten()).astype(np.int64).view(U64), sizes[at:stop], langs.slice(at, stop - at)
            at = stop


def _buckets(table: DataFrame) -> int:
    """Buckets of hashes: as many as partitions, and more where the words of the corpus are many."""
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), total * 40 // BUCKET_BYTES)


def _dealt(hashes: np.ndarray, buckets: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket of the sorted hashes, with the bytes of its part of the columns."""
    bucket = ((hashes >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    used, begin = np.unique(bucket, return_index=True)
    ends = np.append(begin[1:], len(bucket))
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array([x[i:j].tobytes() for i, j in zip(begin, ends, strict=True)], pa.binary()) for x in columns.values()]], names=["bucket", *columns])


#: A row of counts: phrases of one bucket, their lengths, starts, counts and the turns at which they reached the threshold; and what reached it in this turn.
COUNTS = "bucket int, phrase binary, k binary, start binary, n binary, reached binary, fresh array<long>"


def _scan(shard: DataFrame, longest: int, turn: int, shards: int, since: np.ndarray, buckets: int) -> DataFrame:
    """Counts of one scan: of words in the first cycle, and of the phrases whose cycle it is."""
    sent, shape = zlib.compress(since.tobytes(), 1), since.shape

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.frombuffer(zlib.decompress(sent), np.uint8).reshape(shape)
        for words, sizes, _ in _lists(batches):
            for k, at, phrase, before in _grams(words, sizes, longest):
                if k == 1:
                    if turn >= shards:
                        continue
                    start = np.zeros(len(at), np.uint8)
                else:
                    left = _cells(before[at], cells[k - 2])
                    at, left = at[left > 0], left[left > 0]
                    right = _cells(before[at + 1], cells[k - 2])
                    start = np.maximum(left, right)
                    go = (right > 0) & (start.astype(np.int64) + shards > turn)
                    at, start = at[go], start[go]
                if not len(at):
                    continue
                found, first, counts = np.unique(phrase[at], return_index=True, return_counts=True)
                start = start[first]
                part = _dealt(found, buckets, {"phrase": found, "k": np.full(len(found), k, np.uint8), "start": start, "n": counts.astype(np.int64), "reached": np.zeros(len(found), np.uint8)})
                yield part.append_column("fresh", pa.nulls(part.num_rows, pa.list_(pa.int64())))

    return map_arrow(shard.select("lang", "words"), scan, COUNTS)


def _merged(counts: DataFrame, least: int, turn: int, shards: int, longest: int, bits: int) -> DataFrame:
    """Counts of one bucket as one row. What has had its cycle and is rare goes."""
    kinds = {"phrase": U64, "k": np.uint8, "start": np.uint8, "n": np.int64, "reached": np.uint8}

    def meet(table: pa.Table) -> pa.Table:
        got = {c: np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in kinds.items()}
        order = np.argsort(got["phrase"], kind="stable")
        got = {c: x[order] for c, x in got.items()}
        first = np.flatnonzero(np.concatenate([[True], got["phrase"][1:] != got["phrase"][:-1]])) if len(order) else np.zeros(0, np.int64)
        out = {c: got[c][first] for c in ("phrase", "k", "start")}
        out["n"] = np.add.reduceat(got["n"], first) if len(first) else got["n"]
        out["reached"] = np.maximum.reduceat(got["reached"], first) if len(first) else got["reached"]
        new = (out["n"] >= least) & (out["reached"] == 0)
        fresh = new & (out["k"] < longest)
        places = (out["phrase"][fresh] >> U64(64 - bits)).astype(np.int64) + (out["k"][fresh].astype(np.int64) << bits)
        out["reached"] = np.where(new, np.uint8(turn + 1), out["reached"])
        keep = (out["reached"] > 0) | (out["start"].astype(np.int64) + shards > turn + 1)
        return pa.table([pa.array([table.column("bucket")[0].as_py()], pa.int32()), *[pa.array([out[c][keep].astype(kind).tobytes()], pa.binary()) for c, kind in kinds.items()], pa.array([places], pa.list_(pa.int64()))], names=["bucket", *kinds, "fresh"])

    return counts.groupBy("bucket").applyInArrow(meet, COUNTS)


def frequent_phrases(table: DataFrame, longest: int = 5, least: int = 100, shards: int = 4) -> DataFrame:
    """(k, phrase, left, right, n) of every phrase of 1 to `longest` words that occurs `least` times or more in its language, from a table of encoded().

    Each turn scans one shard, adds its counts to those of the phrases that are being counted or frequent, and writes them.
    """
    if longest * shards + shards > 255:
        raise ValueError("turns are counted in one byte")
    buckets = _buckets(table)
    lengths_below = max(1, longest - 1)
    bits = max(6, BITS - (lengths_below - 1).bit_length())  # cells travel in words of 64
    since, last, turn, counts = np.zeros((lengths_below, 1 << bits), np.uint8), {}, 0, None
    while True:
        # A length is counted while one less has reached the threshold within a cycle.
        lengths = [k for k in range(2, longest + 1) if k - 1 in last and turn < last[k - 1] + shards]
        if turn >= shards and not lengths:
            break
        got = _scan(table.where(F.col("shard") == turn % shards), max([1, *lengths]), turn, shards, since, buckets)
        before = counts
        counts = written(_merged(got if before is None else before.drop("fresh").withColumn("fresh", F.lit(None).cast("array<long>")).unionByName(got), least, turn, shards, longest, bits), "counts")
        if before is not None:
            forget(before)
        turn += 1
        place = F.expr(f"place & {(1 << bits) - 1}")
        words = counts.select(F.explode("fresh").alias("place")).groupBy(F.shiftright("place", bits).alias("k"), F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(place & 63))")).alias("bits")).toArrow()
        rows, digit = np.nonzero(np.unpackbits(np.asarray(words.column("bits")).astype(np.int64).view(np.uint8), bitorder="little").reshape(-1, 64))
        k, cell = np.asarray(words.column("k")).astype(np.int64)[rows], np.asarray(words.column("w")).astype(np.int64)[rows] * 64 + digit
        new = since[k - 1, cell] == 0
        since[k[new] - 1, cell[new]] = turn
        last |= dict.fromkeys(map(int, np.unique(k)), turn)
    return _with_sides(table, counts, longest)


def _with_sides(table: DataFrame, counts: DataFrame, longest: int) -> DataFrame:
    """(k, phrase, left, right, n) of every frequent phrase: one more scan of all shards finds the subphrases, and meets the counts bucket by bucket."""
    bits, kinds = BITS, {"phrase": U64, "k": np.uint8, "left": U64, "right": U64}
    n_buckets = _buckets(table)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for phrase, reached in zip(batch.column("phrase").to_pylist(), batch.column("reached").to_pylist(), strict=True):
                cell = (np.frombuffer(phrase, U64)[np.frombuffer(reached, np.uint8) > 0] >> U64(64 - bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell)], names=["cell"])

    words = map_arrow(counts.select("phrase", "reached"), places, "cell long").groupBy(F.shiftright("cell", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(cell & 63))")).alias("bits")).toArrow()
    there = np.zeros(1 << (bits - 6), np.int64)
    there[np.asarray(words.column("w")).astype(np.int64)] = np.asarray(words.column("bits"))
    held = zlib.compress(there.tobytes(), 1)

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, sent = np.unpackbits(np.frombuffer(zlib.decompress(held), np.uint8), bitorder="little"), _Sent()
        for codes, sizes, _ in _lists(batches):
            for k, at, phrase, before in _grams(codes, sizes, longest):
                at = at[_cells(phrase[at], cells) > 0]
                found, first = np.unique(phrase[at], return_index=True)
                new = sent.new(found)
                found, first = found[new], at[first[new]]
                if len(found):
                    left, right = (before[first + j] if k > 1 else found for j in (0, 1))
                    yield _dealt(found, n_buckets, {"phrase": found, "k": np.full(len(found), k, np.uint8), "left": left, "right": right})

    def meet(known: pa.Table, seen: pa.Table) -> pa.Table:
        got = {c: np.frombuffer(b"".join(seen.column(c).to_pylist()), kind) for c, kind in kinds.items()}
        _, one = np.unique(got["phrase"], return_index=True)
        phrase, n, reached = (np.frombuffer(b"".join(known.column(c).to_pylist()), kind) for c, kind in (("phrase", U64), ("n", np.int64), ("reached", np.uint8)))
        frequent = reached > 0
        at = find(got["phrase"][one], phrase[frequent])
        one = one[at[at >= 0]]
        columns = [got["k"][one].astype(np.int32), *[signed(got[c][one]) for c in ("phrase", "left", "right")], n[frequent][at >= 0]]
        return pa.table([pa.array(c) for c in columns], names=["k", "phrase", "left", "right", "n"])

    seen = map_arrow(table.where("shard >= 0").select("lang", "words"), sides, "bucket int, phrase binary, k binary, left binary, right binary")
    both = counts.select("bucket", "phrase", "n", "reached").groupBy("bucket").cogroup(seen.groupBy("bucket"))
    return written(both.applyInArrow(meet, "k int, phrase long, left long, right long, n long"), "phrases")


def with_parts(phrases: DataFrame, table: DataFrame, longest: int = 5) -> DataFrame:
    """(lang, k, phrase, left, right, n, text, heads, tails): the spelled phrase and the counts of its first and of its last 1 to k words."""
    spelled = table.where("shard = -1").select("lang", F.explode(F.arrays_zip("words", "spelled")).alias("w")).groupBy(F.col("w.words").alias("phrase")).agg(F.min("lang").alias("lang"), F.min("w.spelled").alias("text"))
    words = phrases.where("k = 1").join(spelled, "phrase")
    levels = [written(words.withColumns({"heads": F.array("n"), "tails": F.array("n")}), "phrases-1")]
    for k in range(2, longest + 1):
        a = levels[-1].select("lang", F.col("phrase").alias("left"), F.col("text").alias("__a"), "heads")
        b = levels[-1].select(F.col("phrase").alias("right"), F.substring_index("text", " ", -1).alias("__b"), "tails")
        rows = phrases.where(F.col("k") == k).join(a, "left").join(b, "right")
        grown = {"text": F.concat_ws(" ", "__a", "__b"), "heads": F.concat("heads", F.array("n")), "tails": F.concat("tails", F.array("n"))}
        levels.append(written(rows.withColumns(grown).select(*levels[0].columns), f"phrases-{k}"))
    return reduce(DataFrame.unionByName, levels)


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, covered: int = 100, most: int = 2_000, shards: int = 4) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `most` phrases of each language with the highest score of their worst cut.

    A phrase goes that is inside a longer one with `covered` percent of its occurrences; it suffices to look at phrases one word longer, since every
    phrase between two has a count between theirs. Scores are whole numbers from decimals of 38 digits.
    """
    table = encoded(docs, shards)
    phrases = with_parts(frequent_phrases(table, longest, least, shards), table, longest)
    pairs = phrases.where("k > 1")
    around = pairs.select("lang", F.col("left").alias("phrase"), F.col("n").alias("m")).unionByName(pairs.select("lang", F.col("right").alias("phrase"), F.col("n").alias("m"))).groupBy("lang", "phrase").agg(F.max("m").alias("m"))
    kept = pairs.withColumnRenamed("n", "a").join(around, ["lang", "phrase"], "left").where(F.coalesce(F.col("m") * 100 < F.col("a") * covered, F.lit(True)))
    rows = kept.join(table.groupBy("lang").agg(F.sum("n").alias("n")), "lang")
    cut = F.expr("array_min(transform(sequence(1, k - 1), j -> struct((cast(1000 * a AS decimal(19, 0)) * cast(n AS decimal(19, 0))) div (cast(heads[j - 1] AS decimal(19, 0)) * cast(tails[k - j - 1] AS decimal(19, 0))) AS score, j, heads[j - 1] AS l, tails[k - j - 1] AS r)))")
    scored = rows.withColumn("__c", cut).select("lang", F.col("text").alias("phrase"), "a", "__c.l", "__c.r", "n", "__c.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
