"""Importance resampling towards a target text: hashed word features, bucket gains, Gumbel keys, exact ranks.

Features are runs of words; their buckets are crc32 values modulo `buckets`. The crc32 of all distinct features of a
chunk are taken at once: features of equal length form a matrix of bytes, all of whose rows take one column after another.

Null and empty texts have no features, weight 0 and still a score; rows with a null id rank after others of their score;
rows that share an id are ranked each by itself; very long texts are handled whole, alone in their chunk; empty tables give
an empty result (an empty target gives gains against a flat one). Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import map_arrow, small_side, written
from ._words import LOWER, Words, chunks, find_words

#: Bytes between words: ASCII bytes that are neither digit nor letter, once capitals are lower case.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Ids that one group of equal scores holds, so that the place of a row within its score is found in bounded pieces.
IDS = 1 << 20


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    """crc32 of each byte, by its polynomial."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1)
    return value


def crc_of_spans(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of each span of bytes: spans of equal length as rows of one matrix, updated column by column."""
    table, out = _crc_table(), np.zeros(len(start), np.uint32)
    order = np.argsort(length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    for size, rows in zip(sizes.tolist(), np.split(order, first[1:]), strict=True):
        # At most about 4 MB of bytes in one matrix.
        step = max(1, (1 << 22) // max(size, 1))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            matrix = np.lib.stride_tricks.sliding_window_view(data, size)[start[part]] if size else np.zeros((len(part), 0), np.uint8)
            crc = np.full(len(part), 0xFFFFFFFF, np.uint32)
            for column in range(size):
                crc = table[(crc ^ matrix[:, column]) & np.uint32(255)] ^ (crc >> np.uint32(8))
            out[part] = ~crc
    return out


def _joined(data: np.ndarray, start: np.ndarray, length: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, length) of runs of words joined by one space: parts[i] are the words of run i."""
    if not len(parts):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = length[parts].sum(1) + parts.shape[1] - 1
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.full(begin[-1], 0x20, np.uint8)
    to = begin[:-1].copy()
    for j in range(parts.shape[1]):
        n = length[parts[:, j]]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to, n) + inside] = data[np.repeat(start[parts[:, j]], n) + inside]
        to += n + 1
    return out, begin[:-1], size


def feature_buckets(data: np.ndarray, words: Words, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of the chunk, bucket) of every feature: runs of 1 to `runs` consecutive words of one row."""
    _, one, ids = np.unique(words.hash, return_index=True, return_inverse=True)
    start, length = words.start[one], (words.end - words.start)[one]
    rows, found = [], []
    for k in range(1, runs + 1):
        n = len(words.hash) - k + 1
        if n <= 0:
            break
        at = np.flatnonzero(words.row[k - 1 :] == words.row[:n])
        parts, which = np.arange(len(one))[:, None], ids[at]
        if k > 1:
            # The places of the distinct features: pair after pair of (feature so far, next word).
            which, parts = ids[at], np.arange(len(one))[:, None]
            for j in range(1, k):
                pairs, which = np.unique(which * np.int64(len(one)) + ids[at + j], return_inverse=True)
                parts = np.column_stack([parts[pairs // len(one)], pairs % len(one)])
        crc = crc_of_spans(*_joined(data, start, length, parts))
        rows.append(words.row[at])
        found.append((crc % np.uint32(buckets)).astype(np.int64)[which])
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def bucket_counts(texts: DataFrame, runs: int = 2, buckets: int = 10_000) -> DataFrame:
    """(bucket, n) of all features of the column `text`; each task sends one sum for each bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, data, offsets in chunks(batches, "text"):
            data = LOWER[data]
            total += np.bincount(feature_buckets(data, find_words(data, offsets, BETWEEN), runs, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return map_arrow(texts.select("text"), count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) of all buckets, from two tables of bucket_counts: floor(1000 * ln of the smoothed target share over the raw one)."""
    spark = raw.sparkSession
    all_ = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = all_.join(raw.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").fillna(0, ["s", "t"])
    totals = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    # The totals are one row.
    share = (F.col("t") + 1.0) * (F.col("all_s") + float(buckets)) / ((F.col("s") + 1.0) * (F.col("all_t") + float(buckets)))
    return both.join(F.broadcast(totals)).select("bucket", F.floor(F.log(share) * 1000.0).cast("long").alias("gain"))


def weigh(docs: DataFrame, gains: DataFrame, runs: int = 2, buckets: int = 10_000) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of each row's features. `gains` are as many rows as buckets, which a parameter bounds."""
    gain = np.zeros(buckets, np.int64)
    for r in gains.collect():
        gain[r["bucket"]] = r["gain"]

    def weigh_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches, "text"):
            data, rows = LOWER[data], part.num_rows
            words = find_words(data, offsets, BETWEEN)
            row, bucket = feature_buckets(data, words, runs, buckets)
            n, total = np.bincount(row, minlength=rows), np.zeros(rows, np.int64)
            order = np.argsort(row, kind="stable")
            sums = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
            ends = np.cumsum(n)
            total = sums[ends] - sums[ends - n]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(words.first).astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), weigh_rows, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel_key(salt: str) -> F.Column:
    """floor(-1000 * ln(-ln(u))), u drawn by the sha256 of salt and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0).cast("long")


def ranked(scored: DataFrame, percent: int, eligible: F.Column) -> DataFrame:
    """`scored` with `rank`: the first floor(percent * N / 100) of the N eligible rows by score, then id; null for the others.

    No sort of all rows: rows before a score are a sum over the scores (whole thousandths within a bounded span), those
    before a block of ids within a score are a sum over its blocks, and only rows of one block are put in order.
    """
    rows = scored.withColumn("__e", F.coalesce(eligible, F.lit(False))).withColumn("__b", F.coalesce(F.floor(F.col("doc_id") / IDS), F.lit((1 << 62))))
    blocks = rows.where("__e").groupBy("score", "__b").agg(F.count(F.lit(1)).alias("n"))
    blocks = written(blocks.withColumn("__in", F.sum("n").over(Window.partitionBy("score").orderBy("__b")) - F.col("n")), "blocks")
    scores = blocks.groupBy("score").agg(F.sum("n").alias("n"))
    every = Window.orderBy(F.desc("score"))  # a row for each score
    scores = scores.withColumns({"__up": F.sum("n").over(every) - F.col("n"), "__most": F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100)})
    before = written(blocks.join(scores.select("score", "__up", "__most"), "score").where("__up + __in < __most").select("score", "__b", (F.col("__up") + F.col("__in")).alias("__before"), "__most"), "before")
    placed = rows.join(small_side(before), ["score", "__b"], "left")
    # Rows that cannot be drawn are dealt by id, not to one block.
    drawn = F.col("__e") & F.col("__before").isNotNull()
    block = [drawn.alias("__drawn"), F.when(drawn, F.col("score")).otherwise(F.col("doc_id").cast("long")).alias("__k1"), F.when(drawn, F.col("__b")).otherwise(F.lit(None).cast("long")).alias("__k2")]
    place = F.row_number().over(Window.partitionBy("__drawn", "__k1", "__k2").orderBy(F.asc_nulls_last("doc_id"), *[c for c in ("n_features", "weight") if c in scored.columns]))
    placed = placed.select("*", *block).withColumn("__rank", F.col("__before") + place)
    return placed.select(*scored.columns, F.when(F.col("__drawn") & (F.col("__rank") <= F.col("__most")), F.col("__rank")).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, *, runs: int = 2, buckets: int = 10_000, percent: int = 25, least_words: int = 20, salt: str = "7:") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): a draw of `percent` of the documents that leans towards the texts of `target`.

    `docs` and `target` have a column `text`. A document's score is its weight plus a Gumbel key of its id, so that the highest
    scores are a draw without replacement with chances by weight. Documents under `least_words` words are not drawn.
    """
    gains = written(bucket_gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets), buckets), "gains")
    scored = weigh(docs, gains, runs, buckets).withColumn("score", F.col("weight") + gumbel_key(salt))
    return ranked(written(scored, "scored"), percent, F.col("n_words") >= least_words)
