"""Homomorphic fingerprints of documents.

A document is the multiset of its paragraphs (its text cut at line feeds). Each paragraph is hashed to
a wide vector and the document's fingerprint is the sum of the vectors, lane by lane: 8 lanes modulo
2**64 for equality and 128 lanes modulo 2**16 for likeness. So the fingerprint does not depend on
the order of paragraphs, and inserting or deleting one adds or subtracts its vector; no other
paragraph is read again.

The equality lanes of a paragraph are the 512 bits of its BLAKE2b digest, so they are independent of each other. Its
likeness lanes are a count sketch of its runs of three words (shorter paragraphs: the whole as one
run): every run adds +1 or -1 to one lane. The dot product of two sketches estimates the dot
product of the run counts, hence the likeness 2 a.b / (a.a + b.b), cut to 0..1.

Cases: a null text is empty; an empty text has the fingerprint of one empty paragraph, and any two
texts without a word have likeness 1; equal texts have equal fingerprints, wherever and however
often they occur; long texts are read whole; an empty table gives no rows. Input columns that have the name of
an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import BROADCAST_ROWS, map_arrow
from ._words import CHUNK_BYTES, SPACE, U64, find_words, mix, text_bytes, windows

EQUAL_LANES, LIKE_LANES, RUN = 8, 128, 3
#: Bytes of text in one range of ids, about.
RANGE_BYTES = 32 << 20


def vectors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x 8 sums modulo 2**64, rows x 128 sums modulo 2**16) of the texts of a chunk."""
    n = len(offsets) - 1
    blob, at = data.tobytes(), offsets.tolist()
    lines = [blob[i:j].split(b"\n") for i, j in zip(at, at[1:])]
    digests = np.frombuffer(b"".join([blake2b(x).digest() for row in lines for x in row]), "<u8").reshape(-1, EQUAL_LANES)
    equal = np.add.reduceat(digests, np.cumsum([0, *map(len, lines)])[:-1], axis=0)
    # Runs of words within paragraphs: cutting rows at line feeds keeps runs from crossing them.
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(data == 0x0A)]))
    words = find_words(data, cuts, SPACE)
    owner = np.searchsorted(offsets, cuts[:-1], "right") - 1 if len(cuts) > 1 else np.zeros(0, np.int64)
    at, run = windows(words, RUN)
    size = np.diff(words.first)
    short = np.flatnonzero((size > 0) & (size < RUN))
    extra = mix(words.hash[words.first[short]] + words.hash[words.first[short + 1] - 1] * U64(3)) if len(short) else np.zeros(0, U64)
    row = owner[np.concatenate([words.row[at], short])] if len(owner) else np.zeros(0, np.int64)
    run = np.concatenate([run, extra])
    sign = 1.0 - 2.0 * ((run >> U64(40)) & U64(1)).astype(float)
    cell = row * LIKE_LANES + (run % U64(LIKE_LANES)).astype(np.int64)
    like = np.bincount(cell, sign, n * LIKE_LANES).reshape(n, LIKE_LANES).astype(np.int64).astype(np.uint16)
    return equal, like


def add(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints after inserting the paragraphs of b."""
    return a[0] + b[0], a[1] + b[1]


def subtract(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints after deleting the paragraphs of b."""
    return a[0] - b[0], a[1] - b[1]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = a.view(np.int16).astype(float), b.view(np.int16).astype(float)
    squares = (x * x).sum(1) + (y * y).sum(1)
    return np.where(squares > 0, np.clip(2 * (x * y).sum(1) / np.maximum(squares, 1), 0, 1), 1.0)


def as_text(v: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """Lower-case hex of the lanes, equality lanes first."""
    raw = np.concatenate([np.ascontiguousarray(v[0]).view(np.uint8), np.ascontiguousarray(v[1]).view(np.uint8)], axis=1)
    return [r.tobytes().hex() for r in raw]


def _of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [(np.zeros((0, EQUAL_LANES), U64), np.zeros((0, LIKE_LANES), np.uint16))]
    data, offsets = text_bytes(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        parts.append(vectors(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]))
        at = end
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """`docs` without its text, with the fingerprint of each row."""
    keep = [f for f in docs.schema.fields if f.name not in (text, into)]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(as_text(_of(batch.column("__tessera_text"))))], [*names, into])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{into}` string"])
    return map_arrow(docs.select(*names, F.coalesce(F.col(text), F.lit("")).alias("__tessera_text")), run, schema)


def with_next(docs: DataFrame, order: str = "doc_id", text: str = "text", blocks: int | None = None) -> DataFrame:
    """`docs` with `next_text`: the text of the row after in descending order of the id (for the last: of the first).

    Rows are dealt to ranges of the id (by approximate quantiles in two levels; their number follows from the bytes of text) and sorted
    there, which is the only shuffle of texts. The first row of each range is handed to the range before it, by a join on the
    ranges. Rows of one id follow in the order of their texts; null ids come last, null texts are empty.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    if blocks is None:
        blocks = max(2 * parts, (docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // RANGE_BYTES)
    key, block = F.col(order).cast("double"), F.col("__tessera_block")
    # Two levels of cuts, each of about the square root of the number of ranges: the upper ones are one short array, the lower ones a row for each upper range.
    wide = max(1, round(blocks**0.5))
    cuts_at = lambda n: F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], max(10_000, 10 * n))
    place = lambda cuts: F.size(F.filter(F.array_distinct(cuts), lambda c: c <= key))
    none = F.expr("cast(array() AS array<double>)")
    upper = docs.agg(cuts_at(wide).alias("p")).first()["p"] or []
    dealt = docs.withColumn("__tessera_upper", place(F.array(*[F.lit(float(x)) for x in sorted(set(upper))]) if upper else none))
    lower = dealt.groupBy("__tessera_upper").agg(F.coalesce(cuts_at(-(-blocks // wide)), none).alias("__tessera_cuts"))
    dealt = dealt.join(F.broadcast(lower), "__tessera_upper")  # `wide` rows of `wide` numbers
    numbered = F.col("__tessera_upper").cast("long") * (1 << 20) + place(F.col("__tessera_cuts"))
    dealt = dealt.withColumn("__tessera_block", F.when(key.isNull(), -1).otherwise(numbered)).drop("__tessera_upper", "__tessera_cuts")
    # The first row of each range: its largest id, then the least of the texts with that id. A few bytes for each of about `blocks` ranges.
    top = dealt.groupBy(block.alias("__c")).agg(F.max(order).alias("__top"))
    known = F.broadcast(top) if blocks <= BROADCAST_ROWS else top
    heads = dealt.select("__tessera_block", F.col(order).alias("__own"), F.col(text).alias("__head")).join(known, F.expr("__tessera_block = __c AND __own <=> __top"), "left_semi")
    heads = heads.groupBy("__tessera_block").agg(F.min("__head").alias("__head"))
    # Which range comes after which: numbers only. The texts follow by a join.
    line = Window.orderBy("__tessera_block")  # a row for each range
    chain = top.select(F.col("__c").alias("__tessera_block")).withColumn("__to", F.coalesce(F.lag("__tessera_block").over(line), F.last("__tessera_block").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    after = chain.join(heads.select(F.col("__tessera_block").alias("__to"), F.col("__head").alias("__tessera_after")), "__to").select("__tessera_block", "__tessera_after")
    if blocks > 2 * parts:
        dealt = dealt.repartition(blocks // 2, block)
    inside = dealt.withColumn("next_text", F.lead(text).over(Window.partitionBy("__tessera_block").orderBy(F.col(order).desc_nulls_last(), F.col(text))))
    # Both sides are dealt by the range, so the join moves the heads only.
    return inside.join(after, "__tessera_block", "left").withColumn("next_text", F.coalesce("next_text", "__tessera_after")).drop("__tessera_block", "__tessera_after")


def _other(texts: pa.Array, own: tuple[np.ndarray, np.ndarray], column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of another column; where it holds the text of the row after, they are known already."""
    column, texts = pc.fill_null(column, ""), pc.fill_null(texts, "")
    known = np.zeros(len(texts), bool)
    known[:-1] = pc.equal(column.slice(0, len(texts) - 1), texts.slice(1)).to_numpy(zero_copy_only=False)
    rest = np.flatnonzero(~known)
    new = _of(column.take(pa.array(rest)))
    out = tuple(np.roll(x, -1, axis=0) for x in own)
    for x, y in zip(out, new, strict=True):
        x[rest] = y
    return out


def compare(docs: DataFrame, text: str, others: dict[str, str], hashed: tuple[str, ...] = ()) -> DataFrame:
    """`docs` without these texts, with the text's fingerprint and its likeness to each of the others.

    others: column of another text -> name of the likeness. Those in `hashed` also give `<column>_fingerprint`.
    """
    new = ["fingerprint", *[f"{c}_fingerprint" for c in hashed], *others.values()]
    keep = [f for f in docs.schema.fields if f.name not in (text, *others, *new)]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                own = _of(batch.column(text))
                found = {c: _other(batch.column(text), own, batch.column(c)) for c in others}
                out = [pa.array(as_text(own)), *[pa.array(as_text(found[c])) for c in hashed], *[pa.array(likeness(own[1], found[c][1])) for c in others]]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *out], [*names, *new])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), *[f"`{n}` {'double' if n in others.values() else 'string'}" for n in new]])
    return map_arrow(docs.select(*names, text, *others), run, schema)
