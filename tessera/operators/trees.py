"""Gradient-boosted regression trees for many groups at once, by histograms.

Rows are binned at quantiles of their group and packed into blocks of bytes. A level of a tree is one job for all groups: every
block sends its sums by (node, feature, bin), a group's sums meet, and the best cut of each node comes back, a few numbers a
node. So a job is done `trees * depth` times, however many groups there are, and no task holds a group's rows.

Residuals are summed as whole multiples of 2**-32: results do not depend on the order or number of blocks. The
sample of a tree follows from a hash of the row's id. Null features count as below all others; rows without a label do not train.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.package import ship_package
from ..sources.panel import stored

BLOCK_ROWS = 65_536
UNIT = 1 << 32


@dataclass
class Forest:
    """Trees of one group: for each inner node its feature (-1: none) and the last bin that goes left, for each leaf its value."""

    start: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    gain: np.ndarray
    value: np.ndarray  # trees x leaves

    def packed(self) -> bytes:
        return b"".join([np.float64(self.start).tobytes(), self.feature.astype(np.int32).tobytes(), self.cut.astype(np.int32).tobytes(), self.value.astype(np.float64).tobytes()])

    @staticmethod
    def unpacked(raw: bytes, trees: int, depth: int) -> Forest:
        inner, at = (1 << depth) - 1, 8 + 4 * trees * ((1 << depth) - 1)
        feature, cut = (np.frombuffer(raw, np.int32, trees * inner, a).reshape(trees, inner) for a in (8, at))
        return Forest(np.frombuffer(raw, np.float64, 1)[0], feature, cut, np.zeros(0), np.frombuffer(raw, np.float64, trees << depth, at + 4 * trees * inner).reshape(trees, -1))

    def node(self, bins: np.ndarray, tree: int, levels: int) -> np.ndarray:
        """The node of each row after some levels of a tree."""
        node, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            feature = self.feature[tree, node]
            node = 2 * node + 1 + ((feature >= 0) & (bins[row, feature] > self.cut[tree, node]))
        return node

    def predict(self, bins: np.ndarray, trees: int, depth: int) -> np.ndarray:
        out = np.full(len(bins), self.start)
        for t in range(trees):
            out += self.value[t, self.node(bins, t, depth) - ((1 << depth) - 1)]
        return out


def in_sample(ident: np.ndarray, tree: int, share: float) -> np.ndarray:
    """Whether each id is in a tree's sample."""
    x = ident.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (tree + 1) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(32)) < np.uint64(int(share * (1 << 32)))


def best_cuts(sums: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, float, float, float]]:
    """(feature, bin, gain, mean left, mean right) of each node from (node, feature, bin) sums; without a gain -1 and the node's mean, ties to the first feature and bin."""
    out = []
    for s, n in zip(sums, counts, strict=True):
        left, right = np.cumsum(s, axis=1) / UNIT, s.sum(axis=1, keepdims=True) / UNIT
        nl, all_n = np.cumsum(n, axis=1), n.sum(axis=1, keepdims=True)
        total, size = float(right[0, 0]), int(all_n[0, 0])
        right, nr = right - left, all_n - nl
        good = (nl > 0) & (nr > 0)
        gain = np.where(good, left**2 / np.maximum(nl, 1) + right**2 / np.maximum(nr, 1), -1.0)
        f, b = divmod(int(np.argmax(gain)), s.shape[1])
        mean = total / size if size else 0.0
        if good[f, b] and gain[f, b] - total * mean > 1e-9:
            out.append((f, b, float(gain[f, b] - total * mean), float(left[f, b] / nl[f, b]), float(right[f, b] / nr[f, b])))
        else:
            out.append((-1, 0, 0.0, mean, mean))
    return out


def _lowest(x: str) -> F.Column:
    return F.coalesce(F.col(x).cast("double"), F.lit(float("-inf")))


def quantile_cuts(rows: DataFrame, names: Sequence[str], key: str, bins: int) -> DataFrame:
    """(key, cuts): for each feature the distinct values at the quantiles i / bins of its group, from sorted rows; a value's bin is the number of cuts below it."""
    long = rows.select(key, F.posexplode(F.array(*[_lowest(c) for c in names])).alias("f", "x"))
    group = Window.partitionBy(key, "f")
    place, n = F.row_number().over(group.orderBy("x")), F.count(F.lit(1)).over(group)
    # The row at which a whole step of n / bins is reached.
    at = long.withColumn("p", place).withColumn("n", n).where((F.floor(F.col("p") * bins / F.col("n")) > F.floor((F.col("p") - 1) * bins / F.col("n"))) & (F.col("p") < F.col("n")))
    lists = at.groupBy(key, "f").agg(F.sort_array(F.collect_set("x")).alias("cuts"))
    return lists.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("f", "cuts"))).alias("cuts"))


def _binned(x: np.ndarray, cuts: list[dict]) -> np.ndarray:
    out = np.zeros(x.shape, np.uint8)
    for c in cuts:
        out[:, c["f"]] = np.searchsorted(np.asarray(c["cuts"]), x[:, c["f"]], "left")
    return out


def _groups(batch: pa.RecordBatch, key: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one key."""
    code = np.asarray(batch.column(key).dictionary_encode().indices)
    ends = [*(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
    at = 0
    for end in ends:
        if end > at:
            yield batch.slice(at, end - at)
        at = end


def _blocks(rows: DataFrame, cuts: DataFrame, names: Sequence[str], label: str, key: str, ident: Sequence[str], salts: int) -> DataFrame:
    """(key, ident, y, bins): the rows of a group in blocks of bytes."""
    kind = rows.schema[key].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _groups(batch, key):
                x = np.stack([np.asarray(part.column(f"__x{i}")) for i in range(len(names))], axis=1)
                bins = _binned(x, part.column("cuts")[0].as_py())
                cells = [np.ascontiguousarray(np.asarray(part.column(c))).tobytes() for c in ("__id", "__y")] + [bins.tobytes()]
                yield pa.RecordBatch.from_arrays([part.column(key).slice(0, 1), *[pa.array([c], pa.binary()) for c in cells]], names=[key, "ident", "y", "bins"])

    plain = rows.select(key, F.xxhash64(*ident).alias("__id"), F.col(label).cast("double").alias("__y"), *[_lowest(c).alias(f"__x{i}") for i, c in enumerate(names)])
    dealt = plain.withColumn("__s", F.pmod("__id", F.lit(salts))).repartition(key, "__s").drop("__s").join(cuts, key).sortWithinPartitions(key)
    return dealt.mapInArrow(pack, f"`{key}` {kind}, ident binary, y binary, bins binary")


def fit_forests(rows: DataFrame, names: Sequence[str], *, key: str, label: str = "label", ident: Sequence[str] = ("symbol", "date"), trees: int = 20, depth: int = 5, rate: float = 0.05, share: float = 0.8, bins: int = 32, least: int = 100, least_dates: int = 3) -> tuple[dict, DataFrame]:
    """({key: Forest}, cuts) of every group with `least` labelled rows on `least_dates` dates; a group is a rebalance date, so the driver holds a few thousand numbers for each."""
    spark = rows.sparkSession
    ship_package(spark)
    rows = stored(rows.where(F.col(label).isNotNull()), "tree-rows")
    stats = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("d"), (F.sum(F.round(F.col(label) * UNIT).cast("long")) / F.count(F.lit(1)) / UNIT).alias("m")).where((F.col("n") >= least) & (F.col("d") >= least_dates)).collect()
    inner = (1 << depth) - 1
    empty = lambda kind, n: np.zeros((trees, n), kind)
    forests = {r[key]: Forest(r["m"], empty(np.int32, inner) - 1, empty(np.int32, inner), empty(float, inner), empty(float, inner + 1)) for r in stats}
    cuts = stored(quantile_cuts(rows, names, key, bins), "tree-cuts")
    if not forests:
        return forests, cuts
    kind, k = rows.schema[key].dataType.simpleString(), len(names)
    salts = max(1, -(-max(r["n"] for r in stats) // BLOCK_ROWS))
    blocks = stored(_blocks(rows, cuts, names, label, key, ident, salts), "tree-blocks")

    def level(tree: int, at: int) -> list:
        nodes = 1 << at

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    forest = Forest.unpacked(r["forest"], trees, depth)
                    matrix = np.frombuffer(r["bins"], np.uint8).reshape(-1, k)
                    kept = np.flatnonzero(in_sample(np.frombuffer(r["ident"], np.int64), tree, share))
                    matrix = matrix[kept]
                    rest = np.rint((np.frombuffer(r["y"])[kept] - forest.predict(matrix, tree, depth)) * UNIT)
                    cell = (((forest.node(matrix, tree, at) - (nodes - 1))[:, None] * k + np.arange(k)) * bins + matrix).ravel()
                    # Whole numbers below 2**53 are exact in doubles: 65,536 rows of residuals up to 32.
                    sums = np.bincount(cell, np.repeat(rest, k), nodes * k * bins).astype(np.int64)
                    counts = np.bincount(cell, minlength=nodes * k * bins).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([r[key]], batch.schema.field(key).type), pa.array([sums.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=[key, "sums", "counts"])

        def choose(table: pa.Table) -> pa.Table:
            sums, counts = (sum(np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()).reshape(nodes, k, bins) for c in ("sums", "counts"))
            found = list(zip(*best_cuts(sums, counts), strict=True))
            return pa.table([table.column(key).slice(0, 1), *[pa.array([list(x)]) for x in found]], names=[key, "feature", "cut", "gain", "left", "right"])

        known = spark.createDataFrame([(g, f.packed()) for g, f in forests.items()], f"`{key}` {kind}, forest binary")
        joined = blocks.join(F.broadcast(known), key)  # a row for each rebalance date
        return joined.mapInArrow(send, f"`{key}` {kind}, sums binary, counts binary").groupBy(key).applyInArrow(choose, f"`{key}` {kind}, feature array<long>, cut array<long>, gain array<double>, left array<double>, right array<double>").collect()

    for tree in range(trees):
        for at in range(depth):
            first = (1 << at) - 1
            for r in level(tree, at):
                forest, span = forests[r[key]], slice(first, 2 * first + 1)
                forest.feature[tree, span], forest.cut[tree, span], forest.gain[tree, span] = r["feature"], r["cut"], r["gain"]
                if at == depth - 1:
                    forest.value[tree] = rate * np.stack([r["left"], r["right"]], axis=1).ravel()
    return forests, cuts


def predict_forests(rows: DataFrame, forests: dict, cuts: DataFrame, names: Sequence[str], *, key: str, trees: int = 20, depth: int = 5, into: str = "margin") -> DataFrame:
    """`rows` of groups that have trees, with their prediction."""
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    ship_package(spark)
    known = spark.createDataFrame([(g, f.packed()) for g, f in forests.items()], f"`{key}` {kind}, __forest binary")
    columns = rows.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _groups(batch, key):
                x = np.stack([np.asarray(part.column(f"__x{i}")) for i in range(len(names))], axis=1)
                forest = Forest.unpacked(part.column("__forest")[0].as_py(), trees, depth)
                yield part.select(columns).append_column(into, pa.array(forest.predict(_binned(x, part.column("cuts")[0].as_py()), trees, depth)))

    whole = rows.select("*", *[_lowest(c).alias(f"__x{i}") for i, c in enumerate(names)]).join(cuts, key).join(F.broadcast(known), key)
    return whole.sortWithinPartitions(key).mapInArrow(score, rows.schema.add(into, "double"))
