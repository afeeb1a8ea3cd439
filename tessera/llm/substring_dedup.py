"""Removal of passages that occur in an earlier document: seed and extend.

1. Seeds: of every run of `window` words, the least hash among its k-grams (k = window / 2) is its
   anchor (winnowing), so equal windows have equal anchors and neighbours mostly share theirs. Anchors of
   documents meet in a join; those of one document only are dropped.
2. Extension: around an anchor that another document has, a match reaches as far to both sides as
   the windows with that anchor agree. Windows go to the bucket of their anchor; the least id
   that has a window decides. Within a task's chunk only the least id's window is sent, the others are
   settled at once; and windows around an anchor of more than `hot` documents are dealt to buckets one by one, not by their
   anchor. So a passage that very many documents share does not pile up in a bucket. Windows are equal if two
   64-bit hashes agree that are built in two ways from the 64-bit hashes of their words.
3. Maximal repeats: agreeing windows next to each other merge into intervals of at least `window`
   words; these are removed from all documents but the one with the least id.

Cases: a null text has no words; texts shorter than a window lose nothing; rows that share an id are not
compared with each other; repeated rows are answered alike; a null id is never removed from
and never a source; very long texts are handled alone, whole; an empty table gives an empty result; further
columns are carried along unless a new column has their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import join_skewed, map_arrow, small_lists, written
from ._words import U64, Words, chunks, distinct_by_row, find_words, signed, windows

#: Bytes of windows that meet in one bucket, about.
BUCKET_BYTES = 32 << 20
SALT = 0x5851F42D4C957F2D


def _anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, anchor) of every window of words."""
    k = window // 2
    span = window - k + 1  # k-grams in a window
    n = len(words.hash)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    gram = np.full(n, np.iinfo(np.uint64).max, U64)
    at, value = windows(words, k)
    gram[at] = value
    least, reach = gram, 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    start = np.flatnonzero(words.row[window - 1 :] == words.row[: n - window + 1])
    return start, least[start]


def _seeds(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, rid, anchor), distinct within a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, "__tessera_text"):
            words = find_words(data, offsets)
            start, anchor = _anchors(words, window)
            row, anchor = distinct_by_row(words.row[start], anchor)
            if len(row):
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("__tessera_id").take(take), batch.column("__tessera_rid").take(take), pa.array(signed(anchor))], ["doc_id", "rid", "anchor"])

    return map_arrow(docs, run, "doc_id long, rid long, anchor long")


def _runs(rid: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Intervals (rid, doc, first, last) of consecutive places."""
    order = np.lexsort((pos, doc, rid))
    rid, doc, pos = rid[order], doc[order], pos[order]
    new = np.ones(len(rid), bool)
    new[1:] = (rid[1:] != rid[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rid))[: len(first)] - 1
    return rid[first], doc[first], pos[first], pos[last]


def _intervals(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """(rid, doc_id, first, last): starts of windows that occur in a document with a smaller id."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, "__tessera_text"):
            words = find_words(data, offsets)
            start, anchor = _anchors(words, window)
            shared = batch.column("__anchors")
            listed = np.asarray(shared.flatten().to_numpy(zero_copy_only=False)).view(U64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(shared.offsets.to_numpy()))
            # Windows whose anchor is among the shared ones of their own row: a join of (row, anchor) pairs.
            row = words.row[start]
            both = np.concatenate([row, owner])
            _, key = np.unique(np.concatenate([anchor, listed]), return_inverse=True)
            pair = both * (len(key) + 1) + key
            keep = np.isin(pair[: len(row)], pair[len(row) :])
            start, anchor, row = start[keep], anchor[keep], row[keep]
            if not len(start):
                continue
            at, value = windows(words, window)
            at = np.searchsorted(at, start)
            value, check = value[at], windows(words, window, SALT)[1][at]
            ids, rids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__tessera_id", "__tessera_rid"))
            doc, rid, pos = ids[row], rids[row], start - words.first[row]
            order = np.lexsort((pos, rid, doc, check, value))
            value, check, doc, rid, pos, anchor = (x[order] for x in (value, check, doc, rid, pos, anchor))
            new = np.ones(len(value), bool)
            new[1:] = (value[1:] != value[:-1]) | (check[1:] != check[:-1])
            least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            settled = doc > least
            again = np.zeros(len(value), bool)  # repeated rows
            again[1:] = ~new[1:] & (rid[1:] == rid[:-1]) & (pos[1:] == pos[:-1]) & (doc[1:] == doc[:-1])
            out: list[tuple] = []
            if settled.any():
                done = _runs(rid[settled], doc[settled], pos[settled])
                out.append((int(value[0] % U64(buckets)), b"", b"", *[x.astype(np.int64).tobytes() for x in done]))
            go = ~settled & ~again
            often = np.unique(np.asarray(batch.column("__hot").flatten().to_numpy(zero_copy_only=False)).view(U64))
            bucket = (np.where(np.isin(anchor[go], often), value[go], anchor[go]) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            columns = [x[go][order] for x in (value, check, rid, doc, pos)]
            used, first = np.unique(bucket[order], return_index=True)
            for b, i, j in zip(used, first, np.append(first[1:], len(order)), strict=True):
                out.append((int(b), *[x[i:j].tobytes() for x in columns], b""))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), *[pa.array([o[i] for o in out], pa.binary()) for i in range(1, 7)]], ["bucket", "value", "check", "rid", "doc", "first", "last"])

    def meet(table: pa.Table) -> pa.Table:
        value, check = (table.column(c).to_pylist() for c in ("value", "check"))
        rid, doc, first, last = (table.column(c).to_pylist() for c in ("rid", "doc", "first", "last"))
        join = lambda parts, kind: np.frombuffer(b"".join(parts), kind)
        sent = [i for i, v in enumerate(value) if v]
        v, w = (join((x[i] for i in sent), U64) for x in (value, check))
        r, d, p = (join((x[i] for i in sent), np.int64) for x in (rid, doc, first))
        order = np.lexsort((d, w, v))
        v, w, r, d, p = (x[order] for x in (v, w, r, d, p))
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
        least = d[np.flatnonzero(new)][np.cumsum(new) - 1] if len(v) else d
        hit = d > least
        found = [_runs(r[hit], d[hit], p[hit])]
        found += [tuple(np.frombuffer(y[i], np.int64) for y in (rid, doc, first, last)) for i, x in enumerate(value) if not x]
        return pa.table({n: pa.array(np.concatenate([f[k] for f in found])) for k, n in enumerate(("rid", "doc_id", "first", "last"))})

    sent = map_arrow(docs, send, "bucket int, value binary, check binary, rid binary, doc binary, first binary, last binary")
    return sent.groupBy("bucket").applyInArrow(meet, "rid long, doc_id long, first long, last long")


def dedup_substrings(docs: DataFrame, *, window: int = 50, hot: int = 256, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs` with n_words, n_removed, repeats (word intervals [start, end) that were removed) and kept_text (words joined by a space)."""
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("long").alias("__tessera_id"), F.coalesce(F.col(text), F.lit("")).alias("__tessera_text")).where(F.col("__tessera_id").isNotNull())
    plain = plain.withColumn("__tessera_rid", F.xxhash64("__tessera_id", "__tessera_text"))
    seeds = written(_seeds(plain, window), "seeds")
    met = seeds.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    met = written(met.select("anchor", "n", (F.col("n") > hot).alias("hot")), "met")
    shared = written(join_skewed(seeds, met, "anchor").groupBy(F.col("doc_id").alias("__tessera_id"), F.col("rid").alias("__tessera_rid")).agg(F.collect_set("anchor").alias("__anchors"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("__hot")), "shared-anchors")
    with_anchors = plain.join(small_lists(shared, "__anchors"), ["__tessera_id", "__tessera_rid"]).select("__tessera_id", "__tessera_rid", "__tessera_text", "__anchors", "__hot")
    # An anchor stands for at most window - k + 1 windows of 40 bytes.
    sent = (shared.agg(F.sum(F.size("__anchors"))).first()[0] or 0) * (window - window // 2 + 1) * 40
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), sent // BUCKET_BYTES)
    spans = _intervals(with_anchors, window, buckets).groupBy(F.col("doc_id").alias("__tessera_id"), F.col("rid").alias("__tessera_rid"))
    spans = written(spans.agg(F.flatten(F.collect_list(F.array("first", "last"))).alias("__s")), "repeats")

    new = ("n_words", "n_removed", "repeats", "kept_text")
    keep = [f for f in docs.schema.fields if f.name != text and f.name not in new]
    names = [f.name for f in keep]
    cased = docs.select(*names, F.coalesce(F.col(text), F.lit("")).alias("__tessera_text"), F.col(doc_id).cast("long").alias("__tessera_id")).withColumn("__tessera_rid", F.xxhash64("__tessera_id", "__tessera_text"))
    joined = cased.join(small_lists(spans, "__s"), ["__tessera_id", "__tessera_rid"], "left").select(*names, "__tessera_text", "__s")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n, removed, repeats, kept = [], [], [], []
                for t, s in zip(batch.column("__tessera_text").to_pylist(), batch.column("__s").to_pylist(), strict=True):
                    words = t.encode().split()  # bytes split at the same six characters
                    merged: list[list[int]] = []
                    for a, b in sorted(zip(s[::2], s[1::2], strict=True)) if s else ():
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b + window)
                        else:
                            merged.append([a, b + window])
                    n.append(len(words))
                    for a, b in reversed(merged):
                        del words[a:b]
                    removed.append(n[-1] - len(words))
                    repeats.append([{"start": a, "end": b} for a, b in merged])
                    kept.append(b" ".join(words).decode())
                out = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(repeats, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], *out], [*names, *new])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "n_words long, n_removed long, repeats array<struct<start:bigint,end:bigint>>, kept_text string"])
    return map_arrow(joined, cut, schema)
