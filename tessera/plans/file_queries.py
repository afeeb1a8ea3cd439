"""Queries that go through files: what is derived from the tables is written in a source's format and read by that source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import panel as src
from . import factor_queries
from .common import SQL_UNIVERSE, Query, bars, quarter_universe, rounded, sql_bars


def _place(spark: SparkSession, name: str) -> str:
    return f"{src.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _universe_csv(spark: SparkSession, sf_dir: str) -> str:
    """A universe file as people write them: symbols in any case with blanks, many words for true and false."""
    path = _place(spark, "universe")
    n = F.pmod(F.xxhash64("symbol", "snapshot_date"), F.lit(len(src.TRUE_WORDS))).cast("int")
    word = F.when(F.col("is_member"), F.get(F.array(*map(F.lit, src.TRUE_WORDS)), n)).otherwise(F.get(F.array(*map(F.lit, src.FALSE_WORDS)), n))
    rows = quarter_universe(bars(spark, sf_dir)).select(F.col("snapshot_date").cast("string").alias("date"), F.concat(F.lit(" "), F.lower("symbol")).alias("symbol"), F.upper(word).alias("is_member"))
    rows.write.csv(path, header=True)
    return path


def universe_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.read_universe_csv(spark, _universe_csv(spark, sf_dir))


def delisting_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last session of every symbol as its delisting, read together with a universe."""
    path = _place(spark, "delistings")
    last = bars(spark, sf_dir).where("close IS NOT NULL").groupBy("symbol").agg(F.max("date").alias("date"))
    last.select("date", "symbol", F.lit(-0.5).alias("delisting_return")).write.csv(path, header=True)
    return src.read_bundle(spark, _universe_csv(spark, sf_dir), path)[1]


def event_log_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, every tenth of them followed by a line that broke off."""
    path = _place(spark, "event-log")
    line = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("account"), "value"))
    broken = F.when(F.col("event_id") % 10 == 0, F.substring(line, 1, 12))
    src.read(spark, sf_dir, "events").select(F.explode(F.array_compact(F.array(line, broken))).alias("value")).write.text(path)
    return src.read_event_log(spark, path, "id long, account long, value double")


def run_state_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state for each customer: its orders as runs, their items as deals, of which returned ones count as filled."""
    path = _place(spark, "run-states")
    items = src.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_suppkey").cast("string").alias("symbol"), F.when(F.col("l_returnflag") == "R", "filled").otherwise("new").alias("status"), F.col("l_quantity").alias("quantity"))).alias("deals"))
    runs = src.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").cast("string").alias("date")).join(items, "o_orderkey")
    runs.groupBy(F.col("o_custkey").alias("account")).agg(F.collect_list(F.struct("date", "deals")).alias("history")).write.json(path)
    state = spark.read.schema("account long, history array<struct<date: string, deals: array<struct<symbol: string, status: string, quantity: double>>>>").json(path)
    return src.filled_deals(state, "history", "deals").select("run_date", "symbol", "quantity")


def result_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking as it was written, as Parquet in folders by date's year and as JSON lines."""
    top = factor_queries.composite_top(spark, sf_dir).withColumn("year", F.year("date"))
    kept = src.write_result(top, _place(spark, "ranking"), by=("year",))
    return src.write_result(kept.drop("year"), _place(spark, "ranking-lines"), "json").select("date", "symbol", "score", "rank")


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("symbol"), "ts", F.col("value").alias("price"))


def ohlcv_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.ohlcv(_ticks(spark, sf_dir))


def ohlcv_of_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of one symbol between two dates."""
    return src.ohlcv(_ticks(spark, sf_dir), symbol="7", start="2024-01-05", end="2024-01-20")


def fundamentals_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve fields for each symbol, written and read by their fixed schema."""
    path = _place(spark, "fundamentals")
    side = lambda table, p: src.read(spark, sf_dir, table).groupBy(F.col(f"{p}_nationkey").alias("k")).agg(*[f(f"{p}_acctbal").alias(f"{p}{i}") for i, f in enumerate((F.avg, F.min, F.max, F.sum, F.count))])
    places = src.read(spark, sf_dir, "nation").join(src.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"))
    rows = places.join(side("customer", "c"), "k", "left").join(side("supplier", "s"), "k", "left")
    values = ["c0", "s0", "c1", "s1", "c2", "s2", "c3", "s3", "c4", "s4", None]
    columns = [(F.col(v) if v else F.col("c3") + F.col("s3")).cast("double").alias(name) for v, name in zip(values, src.FUNDAMENTALS, strict=True)]
    rows.select("symbol", *columns, "sector").write.parquet(path)
    return rounded(src.read_fundamentals(spark, path), *src.FUNDAMENTALS, digits=3)


QUERIES: dict[str, Query] = {f.__name__: f for f in (universe_file, delisting_file, event_log_file, run_state_file, result_tables, ohlcv_bars, ohlcv_of_symbol, fundamentals_snapshot)}

_OHLCV = "SELECT user_id::VARCHAR AS symbol, ts::DATE AS date, arg_min(value, (ts, value)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, value)) AS close, count(*) AS volume FROM events"
_SIDE = lambda table, p: f"(SELECT {p}_nationkey AS k, avg({p}_acctbal) AS {p}0, min({p}_acctbal) AS {p}1, max({p}_acctbal) AS {p}2, sum({p}_acctbal) AS {p}3, count({p}_acctbal) AS {p}4 FROM {table} GROUP BY 1)"
ORACLE_SQL = {
    "universe_file": f"WITH {sql_bars()}, {SQL_UNIVERSE} SELECT snapshot_date AS date, symbol, is_member FROM universe",
    "delisting_file": f"WITH {sql_bars()} SELECT max(date) AS date, symbol, -0.5::DOUBLE AS delisting_return FROM bars WHERE close IS NOT NULL GROUP BY symbol",
    "event_log_file": "SELECT event_id::BIGINT AS id, user_id::BIGINT AS account, value FROM events",
    "run_state_file": "SELECT o_orderdate::DATE::VARCHAR AS run_date, l_suppkey::VARCHAR AS symbol, l_quantity::DOUBLE AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'",
    "result_tables": factor_queries.ORACLE_SQL["composite_top"],
    "ohlcv_bars": f"{_OHLCV} GROUP BY 1, 2",
    "ohlcv_of_symbol": f"{_OHLCV} WHERE user_id = 7 AND ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1, 2",
    "fundamentals_snapshot": "SELECT n_name AS symbol, " + ", ".join(f"round({v}, 3) AS {name}" for v, name in zip(["c0", "s0", "c1", "s1", "c2", "s2", "c3", "s3", "c4::DOUBLE", "s4::DOUBLE", "c3 + s3"], src.FUNDAMENTALS, strict=True)) + f", r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN {_SIDE('customer', 'c')} c ON c.k = n_nationkey LEFT JOIN {_SIDE('supplier', 's')} s ON s.k = n_nationkey",
}
