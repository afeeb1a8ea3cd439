"""Jaccard join of documents on word shingles, with token-combination prefixes.

Tokens are 64-bit hashes of shingles. The steps, each a Spark job over what the one before left:

1. Sets: the size and a 128-bit hash of every document's token set. Documents with equal sets
   are one class, represented by their smallest id; the rest works on representatives.
2. Extended prefixes: of two similar sets, all but d = floor((1 - t) n) tokens of either are shared. So of the
   least ceil(0.4 n) tokens in hash order at least ceil(0.15 t n) must occur in another document. Tasks
   send these prefixes to buckets of the hash range; a token that repeats within a task's chunk is counted there and sent once, so
   that no frequent token piles up. Only documents with enough shared tokens go on.
3. Index: tokens that only one set has bound the sizes of its partners, and sets that can have none leave. Tokens are ordered by
   class: the rare (up to `frequent` sets) first, then each doubling of the count, within a class by hash. If the
   least shared token is rare, both sets hold it in their first d + 1 tokens: single tokens index these.
   If it is frequent, all shared tokens are. Then combinations of two index the sets: of the frequent tokens of a set, each with the
   next one in the order. A token that only one of two sets has breaks at most one such combination, so sets of a and b frequent tokens,
   s of them shared, have 3 s - 1 - a - b combinations in common, and the prefix of combinations that must hold one of these is extended
   to about n / 2. So a set of any size has fewer entries than tokens.
   Each entry keeps how many tokens come before and after it. Shared tokens before the first common combination have one that is
   not shared after them, in one of the two sets, so with i and j tokens before it at most (i + j) / 3 are shared, and after it no more than the fewer. So
   entries bound the size of the partners met there, and two entries that meet what both sets can share. Edits of a much
   copied text are rarer than the text, come first, and so count against it.
4. Verification without all pairs: each document is compared with the first of a bucket, what links is
   contracted, and further comparisons are made only between different components that share a bucket,
   until every bucket's pairs of components have been compared in full. No cap applies, so no link between different texts is lost.

Cases: a null or blank text has the empty set, size 0, and links with nothing; with fewer words than a
shingle the whole sequence is one token; rows with equal texts, or equal sets, are one class; rows that share an id stand for one node;
a null id gets a null component unless equal to another text; an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._tables import BROADCAST_ROWS, join_skewed, map_arrow, small_side, written
from ._words import U64, Words, chunks, distinct_by_row, find, find_words, mix, ragged, signed, windows

REACH = 0.4  # share of a set in its extended prefix
BUCKET_BYTES = 32 << 20  # of prefixes that meet in one group, at most about
#: Entries of one signature and band that meet in one key of the last comparison.
CELL = 1_000


def _tokens(words: Words, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, token), distinct, sorted by row and token."""
    at, token = windows(words, k)
    row = words.row[at]
    size = np.diff(words.first)
    for few in range(1, k):
        rows = np.flatnonzero(size == few)
        if len(rows):
            start, whole = windows(words, few)
            keep = np.isin(start, words.first[rows])
            row, token = np.concatenate([row, words.row[start[keep]]]), np.concatenate([token, whole[keep]])
    return distinct_by_row(row, token)


def shingle_sets(docs: DataFrame, k: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, n, key1, key2): size and hash of each document's token set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, "__tessera_text"):
            row, token = _tokens(find_words(data, offsets, lower=True), batch.num_rows, k)
            n = np.bincount(row, minlength=batch.num_rows)
            keys = []
            for salt in (1, 2):
                sums = np.concatenate([[U64(0)], np.cumsum(mix(token ^ U64(salt)))])
                end = np.cumsum(n)
                keys.append(pa.array(signed(mix(sums[end] - sums[end - n] + n.astype(U64)))))
            yield pa.RecordBatch.from_arrays([batch.column("__tessera_id"), pa.array(n), *keys], ["doc_id", "n", "key1", "key2"])

    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("__tessera_id"), F.coalesce(F.col(text), F.lit("")).alias("__tessera_text")), run, "doc_id long, n long, key1 long, key2 long")


def _shared_prefixes(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """(doc_id, shared): how many tokens of its extended prefix occur in another document (copies included)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, "__tessera_text"):
            row, token = _tokens(find_words(data, offsets, lower=True), batch.num_rows, k)
            n = np.bincount(row, minlength=batch.num_rows)
            rank = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            keep = rank < np.ceil(REACH * n)[row]
            row, token = row[keep], token[keep]
            value, first, inverse, count = np.unique(token, return_index=True, return_inverse=True, return_counts=True)
            ids = batch.column("__tessera_id").to_numpy(zero_copy_only=False)
            here = np.bincount(row, (count > 1)[inverse], batch.num_rows).astype(np.int64)
            # Tokens that repeat here are known to be shared; one sign of them goes out, without a document. Any id can occur, so none stands for this.
            doc, known = ids[row[first]], count > 1
            bucket = (value % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            used, start = np.unique(bucket[order], return_index=True)
            end = np.append(start[1:], len(order))[: len(used)]
            short = (value >> U64(32)).astype(np.uint32)[order]
            doc, known = doc[order], known[order]
            out = [(int(b), short[i:j][~known[i:j]].tobytes(), short[i:j][known[i:j]].tobytes(), doc[i:j][~known[i:j]].tobytes(), b"") for b, i, j in zip(used, start, end, strict=True)]
            some = np.flatnonzero(here)
            if len(some):
                out.append((int(ids[some[0]] % buckets), b"", b"", ids[some].tobytes(), here[some].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "tokens", "known", "docs", "counts"])

    def meet(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in ("tokens", "known", "docs", "counts")]
        tokens = np.frombuffer(b"".join(columns[0] + columns[1]), np.uint32)
        whole = [(np.frombuffer(d, np.int64), np.frombuffer(c, np.int64)) for d, c in zip(*columns[2:], strict=True) if c]
        docs_ = np.frombuffer(b"".join(d for d, c in zip(*columns[2:], strict=True) if not c), np.int64)
        order = np.argsort(tokens, kind="stable")
        t = tokens[order]
        same = np.zeros(len(t), bool)
        same[1:] = t[1:] == t[:-1]
        same[:-1] |= same[1:]
        with_doc = order[same]
        ids, count = np.unique(docs_[with_doc[with_doc < len(docs_)]], return_counts=True)
        ids, count = np.concatenate([ids, *[w[0] for w in whole]]), np.concatenate([count, *[w[1] for w in whole]])
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "shared": pa.array(count, pa.int64())})

    sent = map_arrow(docs, send, "bucket int, tokens binary, known binary, docs binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(meet, "doc_id long, shared long").groupBy("doc_id").agg(F.sum("shared").alias("shared"))


def _token_lists(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, tokens, bits): the token set, and a bitmap of it with 4 to 8 bits a token (a power of two, so that it folds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, "__tessera_text"):
            row, token = _tokens(find_words(data, offsets, lower=True), batch.num_rows, k)
            n = np.bincount(row, minlength=batch.num_rows)
            maps, end = [], np.cumsum(n)
            for i, j in zip(end - n, end, strict=True):
                bits = np.zeros(max(64, 1 << int(4 * (j - i) - 1).bit_length()) if j > i else 64, bool)
                bits[(token[i:j] & U64(len(bits) - 1)).astype(np.int64)] = True
                maps.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("__tessera_id"), ragged(signed(token), n), pa.array(maps, pa.binary())], ["doc_id", "tokens", "bits"])

    return map_arrow(docs, run, "doc_id long, tokens array<long>, bits binary")


def _differing_bits(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ, the larger folded to the smaller: no more than the sets' differing tokens."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) != len(b):
        if len(a) > len(b):
            a = a[: len(a) // 2] | a[len(a) // 2 :]
        else:
            b = b[: len(b) // 2] | b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _signatures(sets: DataFrame, often: np.ndarray, classes: np.ndarray, percent: int) -> DataFrame:
    """(signature, doc_id, room, before, after): what the index holds of each set.

    Sets that meet there for the first time are similar only if neither has more than the other's `room` tokens, and share at most
    a third of the sum of `before` and the lesser `after`.
    """
    loose = 1 - percent / 100
    paired = percent > 50
    # Below this sum of sizes, two similar sets need not have a combination in common, and frequent tokens are indexed singly too.
    small = 2 * (100 + percent) / (2 * percent - 100) if paired else math.inf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("tokens")
            flat = column.flatten().to_numpy(zero_copy_only=False).view(U64)
            n = np.diff(column.offsets.to_numpy()).astype(np.int64)
            if not len(flat):
                continue
            at = find(often, flat)
            level = np.where(at >= 0, classes[at], 0) if len(often) else np.zeros(len(flat), np.int64)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((flat, level, row))
            flat, rare = flat[order], level[order] == 0
            size, place = n[row], np.arange(len(flat)) - (np.cumsum(n) - n)[row]
            m = n - np.bincount(row, rare, len(n)).astype(np.int64)  # frequent tokens
            one = np.flatnonzero((place <= np.floor(loose * size + 1e-9)) & (rare | (size * (100 + percent) < 100 * small)))
            signature, who = [flat[one]], [row[one]]
            before, after = [np.zeros(len(one), np.int64)], [size[one] - place[one]]
            room = [(size[one] - place[one]) * (100 + percent) // percent - size[one]]
            if paired:
                two = np.flatnonzero(~rare & (place + 1 < size))
                nth = place[two] - (size - m[row])[two]
                left = ((100 + percent) * (2 * m[row[two]] - nth) - 3 * percent * size[two]) // (2 * percent - 100)
                left = np.minimum(left, m[row[two]] * (100 + percent) // percent - size[two])
                fits = left * 100 >= size[two] * percent
                two, left, nth = two[fits], left[fits], nth[fits]
                signature.append(mix(flat[two] * U64(3) + flat[two + 1]))
                who.append(row[two])
                room.append(left)
                before.append(nth)
                after.append(m[row[two]] - nth)
            doc = batch.column("doc_id").take(pa.array(np.concatenate(who)))
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(signature))), doc, *[pa.array(np.concatenate(x)) for x in (room, before, after)]], ["signature", "doc_id", "room", "before", "after"])

    return map_arrow(sets, run, "signature long, doc_id long, room long, before long, after long")


def _linked(pairs: DataFrame, sets: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least percent / 100.

    Sizes and bitmaps rule out most pairs without reading their tokens, and none that is similar.
    """
    side = lambda key, size, bits: sketches.select(F.col("doc_id").alias(key), F.col("n").alias(size), F.col("bits").alias(bits))
    drawn = pairs.join(side("a", "na", "xa"), "a").where("na IS NOT NULL").join(side("b", "nb", "xb"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (batch.column("na").to_numpy(zero_copy_only=False) + batch.column("nb").to_numpy(zero_copy_only=False)) * (100 - percent) // (100 + percent)
            keep = [_differing_bits(x, y) <= m for x, y, m in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), most.tolist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left_over = written(map_arrow(drawn, near, "a long, b long"), "near-pairs")
    some = small_side(left_over)
    x = sets.join(some, sets["doc_id"] == some["a"]).select("a", "b", F.col("tokens").alias("x"))
    y = sets.join(some, sets["doc_id"] == some["b"]).select("a", "b", F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return x.join(y, ["a", "b"]).where(both * 100 >= (F.size("x") + F.size("y") - both) * percent).select("a", "b")


def similarity_classes(docs: DataFrame, *, k: int = 5, percent: int = 75, frequent: int = 64, text: str = "text", doc_id: str = "doc_id", star_rounds: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) for each row: component_id is the least id reachable by links, class_id the least id with the same set."""
    spark = docs.sparkSession
    loose = 1 - percent / 100
    plain = docs.select(F.col(doc_id).cast("long").alias("__tessera_id"), F.coalesce(F.col(text), F.lit("")).alias("__tessera_text"))
    all_sets = written(shingle_sets(docs, k, text, doc_id), "sets")
    classes = all_sets.where("n > 0").groupBy("key1", "key2").agg(F.min("doc_id").alias("class_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    totals = all_sets.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows")).first()
    buckets = max(4 * parts, int((totals["tokens"] or 0) * REACH * 12) // BUCKET_BYTES)
    shared = _shared_prefixes(plain.where(F.col("__tessera_id").isNotNull()), k, buckets)
    least = F.greatest(F.lit(1), F.ceil(F.col("n") * ((REACH - loose) * percent / 100) - 1e-9))
    alive = written(classes.join(shared, F.col("class_id") == F.col("doc_id")).where(F.col("shared") >= least).select(F.col("class_id").alias("__tessera_id")).distinct(), "candidates")
    sets = written(_token_lists(plain.join(small_side(alive), "__tessera_id", "left_semi"), k), "tokens")
    sketches = written(sets.select("doc_id", F.size("tokens").cast("long").alias("n"), "bits"), "sketches")

    # One count of all tokens gives both the tokens of frequent classes and how many tokens each set has to itself.
    # Tokens of its own bound a set's overlaps, so n and `own` bound the size of its partners: `most`.
    counted = sets.select("doc_id", F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("d")).where((F.col("c") == 1) | (F.col("c") > frequent))
    counted = written(counted.groupBy((F.col("c") == 1).alias("own"), F.when(F.col("c") == 1, F.col("d")).otherwise(F.col("t")).alias("key")).agg(F.sum("c").alias("n")), "token-counts")
    # The bound on the list only moves the order of tokens, so it can rise without losing a link.
    # An order by doublings keeps edits of a much copied text before the text itself, however many copies there are.
    often, limit = counted.where("NOT own"), frequent
    while often.where(F.col("n") > limit).count() > BROADCAST_ROWS:
        limit *= 2
    named = [(r["key"], r["level"]) for r in often.where(F.col("n") > limit).select("key", (F.floor(F.log2(F.col("n") / limit)) + 1).alias("level")).toLocalIterator()]
    often = np.array([key for key, _ in named], np.int64).view(U64)
    classes_of = np.array([level for _, level in named], np.int64)[np.argsort(often)]
    often = np.sort(often)
    own = counted.where("own").select(F.col("key").alias("doc_id"), F.col("n").alias("alone"))
    sizes = sketches.select("doc_id", "n").join(own, "doc_id", "left").select("doc_id", "n", F.floor((F.col("n") - F.coalesce("alone", F.lit(0))) * (100 + percent) / percent + 1e-9).alias("sum")).select("doc_id", "n", (F.col("sum") - F.col("n")).alias("most"))
    sizes = written(sizes.where(F.col("most") * 100 >= F.col("n") * percent), "sizes")

    postings = _signatures(sets.select("doc_id", "tokens"), often, classes_of, percent)
    index = postings.join(small_side(sizes), "doc_id").select("signature", "doc_id", "n", F.least("most", "room").alias("most"), "before", "after")
    index = written(index.where(F.col("most") * 100 >= F.col("n") * percent), "postings")
    met = index.groupBy("signature").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    index = written(index.join(met, "signature", "left_semi"), "index")
    band = lambda c: F.floor(F.ln(c) / math.log(1.1)).cast("int")  # noqa: E731  sizes within a tenth

    # Whether two entries that meet leave enough to share; names of the one and the other side.
    enough = lambda x, y: F.expr(f"{x('n')} <= {y('most')} AND {y('n')} <= {x('most')} AND {100 + percent} * (3 * least({x('after')}, {y('after')}) + {x('before')} + {y('before')}) >= {3 * percent} * ({x('n')} + {y('n')})")
    fields = ("doc_id", "n", "most", "before", "after", "component")

    links: list[DataFrame] = []
    labels = None
    for step in range(star_rounds + 1):
        if labels is None:
            held = index.withColumn("component", F.col("doc_id"))
        else:
            held = index.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        # Buckets that still hold more than one component.
        held = written(held, "labelled")
        who = F.struct(*fields)
        # First the set with most room, which has the fewest tokens that the others lack; then others by a hash.
        pivot = F.max_by(who, F.struct(F.col("most") / F.col("n"), "doc_id")) if step == 0 else F.min_by(who, F.xxhash64("doc_id", F.lit(step)))
        split = held.groupBy("signature").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("__rows"), pivot.alias("p")).where("lo <> hi")
        split = written(split.select("signature", "__rows", "p"), "split")
        if step < star_rounds:
            # Two comparisons for each document whose component the pivot lacks: with the first and the last it meets.
            named = join_skewed(held, split, "signature", "__rows").where("p.component <> component").where(enough(lambda c: c, lambda c: f"p.{c}")).select("doc_id", F.col("p.doc_id").alias("p"))
            pairs = named.groupBy("doc_id").agg(F.array(F.min("p"), F.max("p")).alias("ps")).select("doc_id", F.explode("ps").alias("p"))
            pairs = pairs.select(F.least("p", "doc_id").alias("a"), F.greatest("p", "doc_id").alias("b")).distinct()
        else:
            # The rest in full: pairs of documents of different components that share a bucket, each looking only into bands of sizes it can link with.
            some = written(join_skewed(held, split.drop("p"), "signature", "__rows"), "open")
            left = some.select("signature", F.explode(F.sequence(band(F.ceil(F.col("n") * percent / 100)), band(F.greatest("most", F.ceil(F.col("n") * percent / 100))))).alias("band"), *[F.col(c).alias(f"{c}_a") for c in fields])
            right = some.select("signature", band(F.col("n")).alias("band"), *[F.col(c).alias(f"{c}_b") for c in fields])
            # Large cells fall into squares of about CELL by CELL entries, each of which is a key of its own.
            large = right.groupBy("signature", "band").agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") > CELL)
            squares = small_side(written(large.select("signature", "band", F.ceil(F.col("__c") / CELL).alias("__k")), "squares"))

            def dealt(df: DataFrame, side: str, own: str, other: str) -> DataFrame:
                k = F.coalesce("__k", F.lit(1))
                return df.join(squares, ["signature", "band"], "left").withColumns({own: F.pmod(F.xxhash64(f"doc_id_{side}"), k), other: F.explode(F.sequence(F.lit(0).cast("long"), k - 1))}).drop("__k")

            met_ = dealt(left, "a", "__i", "__j").join(dealt(right, "b", "__j", "__i"), ["signature", "band", "__i", "__j"]).where("doc_id_a < doc_id_b AND component_a <> component_b").where(enough(lambda c: f"{c}_a", lambda c: f"{c}_b"))
            pairs = met_.select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct()
        links.append(written(_linked(pairs, sets, sketches, percent), "links"))
        edges = links[0]
        for more in links[1:]:
            edges = edges.union(more)
        labels = components(edges)

    comps = classes.join(labels.select(F.col("node").alias("class_id"), "component"), "class_id", "left").select("key1", "key2", "copies", "class_id", F.coalesce("component", "class_id").alias("component"))
    comps = written(comps, "classes")
    # Classes with many copies, of which there are at most 8 a partition, are broadcast; so no task gets all copies of a text.
    many = totals["rows"] // (8 * parts)
    heavy = F.broadcast(comps.where(F.col("copies") > many).drop("copies"))
    worded, keys = all_sets.where("n > 0"), ["key1", "key2"]
    alone = all_sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component"))
    merged = [worded.join(heavy, keys), worded.join(heavy, keys, "left_anti").join(comps.where(F.col("copies") <= many), keys)]
    for part in merged:
        alone = alone.union(part.select("doc_id", "n", "class_id", "component"))
    return alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "class_id")


def keep_one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """`docs` with one row of each component: that of the least id (of rows with that id the one of the least text).

    Rows without words all stay, and so do rows with a null id, which are no node of the graph.
    """
    found = similarity_classes(docs, text=text, doc_id=doc_id, **options).where(F.col("n_shingles") > 0)
    found = written(found.select(F.col("doc_id").alias("__tessera_id"), "component_id").where(F.col("__tessera_id").isNotNull()), "members")
    drop = written(found.where("__tessera_id <> component_id").select("__tessera_id").distinct(), "dropped")
    known = F.col(doc_id).cast("long")
    left = docs.join(small_side(drop), known == F.col("__tessera_id"), "left_anti")
    twice = written(found.where("__tessera_id = component_id").groupBy("__tessera_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__tessera_id"), "repeated-ids")
    if twice.isEmpty():
        return left
    worded = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", "")) > 0
    one = left.where(worded).join(small_side(twice), known == F.col("__tessera_id"), "left_semi").select(F.struct(*docs.columns).alias("__row"))
    one = one.groupBy(F.col("__row")[doc_id].alias("__tessera_id")).agg(F.min_by("__row", F.struct(F.col("__row")[text], F.xxhash64("__row"))).alias("__row")).select("__row.*")
    rest = left.where(worded).join(small_side(twice), known == F.col("__tessera_id"), "left_anti")
    return rest.union(left.where(~worded)).union(one)
