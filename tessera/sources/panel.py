"""Sources and sinks: price panels, snapshots, event files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import positive


def shared_folder(spark: SparkSession) -> str:
    """The folder for written tables that all executors see: spark.checkpoint.dir, or in local mode without it a new one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def deal_bars(spark: SparkSession, sf_dir: str, freq: str = "week") -> DataFrame:
    """(symbol, sector, date, close, volume): a bar for each nation and period with deals."""
    items = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    places = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"))
    joined = items.join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("symbol", "sector", F.date_trunc(freq, "l_shipdate").cast("date").alias("date")).agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity") + 1e-9, 6).alias("close"), F.sum("l_quantity").alias("volume"))


def benchmark_bars(spark: SparkSession, sf_dir: str, freq: str = "week", symbol: str = "MARKET") -> DataFrame:
    """(symbol, date, close) of the whole market."""
    items = read(spark, sf_dir, "lineitem")
    return items.groupBy(F.date_trunc(freq, "l_shipdate").cast("date").alias("date")).agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity") + 1e-9, 6).alias("close")).select(F.lit(symbol).alias("symbol"), "date", "close")


def densify(bars: DataFrame, keys: tuple[str, ...] = ("symbol", "sector")) -> DataFrame:
    """A row for each symbol and session, with nulls where a symbol had no price; prices are positive or null.

    The session list (one row for each date, bounded by the calendar) is broadcast as one array.
    """
    sessions = bars.where(F.col("close").isNotNull()).agg(F.sort_array(F.collect_set("date")).alias("dates"))
    grid = bars.select(*keys).distinct().join(F.broadcast(sessions)).select(*keys, F.explode("dates").alias("date"))
    return grid.join(bars, [*keys, "date"], "left").withColumn("close", positive("close"))


def static_universe(bars: DataFrame, listed: DataFrame) -> DataFrame:
    """Bars of the symbols on a list."""
    return bars.join(listed.select("symbol").distinct(), "symbol", "left_semi")


def completed_sessions(bars: DataFrame, now: Column, close_time: str = "16:15", zone: str = "America/New_York") -> DataFrame:
    """Bars of sessions that are over: today's counts only from `close_time` on, exchange time."""
    local = F.from_utc_timestamp(now, zone)
    done = F.when(F.date_format(local, "HH:mm") >= close_time, F.to_date(local)).otherwise(F.date_sub(F.to_date(local), 1))
    return bars.where(F.col("date") <= done)


def average_volume(bars: DataFrame, window: int = 30) -> DataFrame:
    """(symbol, adv): mean volume of each symbol's last sessions with a volume, where positive."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("date"))
    recent = bars.where(F.col("volume").isNotNull()).withColumn("k", F.row_number().over(newest)).where(F.col("k") <= window)
    return recent.groupBy("symbol").agg(F.avg("volume").alias("adv")).where("adv > 0")


#: Fields of a fundamentals snapshot beside symbol and sector. Fixed names.
FUNDAMENTALS = ("trailingPE", "forwardPE", "priceToBook", "pegRatio", "dividendYield", "profitMargins", "returnOnEquity", "debtToEquity", "earningsGrowth", "revenueGrowth", "marketCap")


def read_fundamentals(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, the eleven numbers, sector) of a snapshot, by a fixed schema; fields that a file lacks are null."""
    return spark.read.schema(", ".join(["symbol string", *(f"{f} double" for f in FUNDAMENTALS), "sector string"])).parquet(path)


TRUE_WORDS = ("1", "1.0", "true", "t", "yes", "y")
FALSE_WORDS = ("0", "0.0", "false", "f", "no", "n")


def universe_rows(raw: DataFrame) -> DataFrame:
    """(date, symbol, is_member) from text columns; raises on bad values, duplicates or a snapshot list without members."""
    word = F.lower(F.trim(F.col("is_member").cast("string")))
    rows = raw.select(F.to_date("date").alias("date"), F.upper(F.trim("symbol")).alias("symbol"), F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False).alias("is_member"))
    bad = rows.agg(F.count_if(F.col("is_member").isNull() | F.col("date").isNull() | F.coalesce(F.col("symbol") == "", F.lit(True))).alias("bad"), F.count_if("is_member").alias("members"), (F.count(F.lit(1)) - F.count_distinct("date", "symbol")).alias("twice")).first()
    if bad["bad"] or bad["twice"] or not bad["members"]:
        raise ValueError(f"universe file: {bad['bad']} bad rows, {bad['twice']} duplicates, {bad['members']} members")
    return rows


def read_universe_csv(spark: SparkSession, path: str) -> DataFrame:
    return universe_rows(spark.read.csv(path, header=True, schema="date string, symbol string, is_member string"))


def read_delistings_csv(spark: SparkSession, path: str) -> DataFrame:
    """(date, symbol, delisting_return) with returns from -1 to 10; raises on bad or repeated rows."""
    rows = spark.read.csv(path, header=True, schema="date date, symbol string, delisting_return double").withColumn("symbol", F.upper(F.trim("symbol")))
    bad = rows.agg(F.count_if(~F.coalesce(F.col("delisting_return").between(-1, 10), F.lit(False)) | F.col("date").isNull()).alias("bad"), (F.count(F.lit(1)) - F.count_distinct("date", "symbol")).alias("twice")).first()
    if bad["bad"] or bad["twice"]:
        raise ValueError(f"delisting file: {bad['bad']} bad rows, {bad['twice']} duplicates")
    return rows


def read_event_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without those that do not parse."""
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = spark.read.text(path).select(parsed.alias("event")).where("event IS NOT NULL AND event._corrupt_record IS NULL")
    return rows.select("event.*").drop("_corrupt_record")


def filled_deals(state: DataFrame, history: str, deals: str) -> DataFrame:
    """Filled deals of nested run states: an array of runs (`history`), each with an array of deals."""
    runs = state.select(F.explode(history).alias("run"))
    return runs.select(F.col("run.date").alias("run_date"), F.explode(F.col("run")[deals]).alias("t")).select("run_date", "t.*").where("status = 'filled'")


def read_bundle(spark: SparkSession, universe_path: str | None, delistings_path: str | None) -> tuple[DataFrame, DataFrame] | None:
    """Universe and delistings of one source; raises if only one of them is given, and is None without both."""
    if bool(universe_path) != bool(delistings_path):
        raise ValueError("a universe and its delistings come together")
    return (read_universe_csv(spark, universe_path), read_delistings_csv(spark, delistings_path)) if universe_path and delistings_path else None


def ohlcv(ticks: DataFrame, freq: str = "day", symbol: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """(symbol, date, open, high, low, close, volume) of ticks (symbol, ts, price), of all symbols or one, from `start` to `end` inclusive; the filters reach the scan."""
    some = ticks if symbol is None else ticks.where(F.col("symbol") == symbol)
    some = some if start is None else some.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    some = some if end is None else some.where(F.col("ts") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    at = F.struct("ts", "price")
    return some.groupBy("symbol", F.date_trunc(freq, "ts").cast("date").alias("date")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("volume"))


def write_result(df: DataFrame, path: str, kind: str = "parquet", by: tuple[str, ...] = (), mode: str = "error") -> DataFrame:
    """Writes a result table (parquet or json lines, in folders by some columns) and gives it as it was written."""
    df.write.partitionBy(*by).mode(mode).format(kind).save(path)
    return df.sparkSession.read.schema(df.schema).format(kind).load(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table that is read several times, written once to the shared folder."""
    return write_result(df, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}")
