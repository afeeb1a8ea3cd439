"""Where the operators put tables that they read again.

Lineage is cut only by written tables in the shared folder that the session names in
``spark.checkpoint.dir``; any executor can read them, so a lost executor costs no more than
its own tasks.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._words import chunks

#: Rows of a (long key, small payload) table up to which a broadcast is allowed.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        # Off a cluster, as in tests.
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The same rows, read from Parquet files that were written now, in folders by the columns `by`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a written table that nothing reads any more."""
    context = df.sparkSession.sparkContext
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if it is proven small, else as it is, for a shuffled join.

    `df` is a written table, so that counting it reads file footers only.
    """
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def join_skewed(rows: DataFrame, groups: DataFrame, key: str, count: str = "n") -> DataFrame:
    """`rows` joined with a written table of one row for each key, with the number of rows that the key has.

    Keys with more than an eighth of a partition's share of all rows, of which there can be no more than 8 a partition, are broadcast, so no task gets all rows of one.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = (groups.agg(F.sum(count)).first()[0] or 0) // (8 * parts)
    large, rest = F.broadcast(groups.where(F.col(count) > many)), groups.where(F.col(count) <= many)
    return rows.join(large, key).unionByName(rows.join(large.select(key), key, "left_anti").join(rest, key))


def small_lists(df: DataFrame, lists: str, most: int = 64 << 20) -> DataFrame:
    """As small_side, for a written table with a column of lists of longs: the bytes of all lists count."""
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size(lists)).alias("items")).first()
    return F.broadcast(df) if 64 * size["rows"] + 8 * (size["items"] or 0) <= most else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % F.lit(n)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once for each context, as --py-files would."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="spark-")) / "tessera_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(target))
    context._tessera_shipped = True


def in_one_task(df: DataFrame, *order: str) -> DataFrame:
    """A bounded sample for one task, in a fixed order; unlike coalesce(1) it leaves the scan that finds it to all tasks."""
    return df.repartition(1).sortWithinPartitions(*order)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """The texts of the labelled documents with the `most` smallest hashes of their ids, in one task, in the order of the hash.

    docs: (id, text), labels: (id, label), one row an id. The rows follow from ids alone, not from partitions or the order of tasks.
    """
    some = labels.withColumn("__h", F.xxhash64("id")).orderBy("__h", "id").limit(most)
    return in_one_task(docs.join(F.broadcast(some), "id").select("__h", "id", "label", "text"), "__h", "id", "text")


def first_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """chunks() of the first rows whose texts have no more than `most` bytes together; the first row always."""
    left = most
    for batch, data, offsets in chunks(batches, column):
        n = int(np.searchsorted(offsets, left, "right")) - 1
        n = max(n, 1) if left == most else n
        if n:
            yield batch.slice(0, n), data[: offsets[n]].copy(), offsets[: n + 1].copy()
        left -= int(offsets[min(n + 1, len(offsets) - 1)])
        if n < batch.num_rows or left <= 0:
            return


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with this package at hand in the tasks."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)
