"""Queries on data quality, calendar and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import factors as fa
from ..operators import quality as qu
from ..sources import panel as src
from .common import Query, bars, rounded, sql_bars

#: A fixed list of events on sessions of the test panel.
DELISTINGS = [("NATION_5", "1997-03-03", -1.0), ("NATION_9", "1997-06-02", 0.25)]


def delistings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DELISTINGS, "symbol string, d string, delisting_return double").select("symbol", F.col("d").cast("date").alias("date"), "delisting_return")


def quality_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qu.missing_rates(bars(spark, sf_dir, "day"), 0.43), "missing")


def quality_late_starters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qu.late_starters(bars(spark, sf_dir, "day"), 1)


def quality_live_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = qu.live_gate(bars(spark, sf_dir, "month"), least=12, missing=0.2, breadth=0.1)
    return kept.groupBy("symbol").agg(F.count("close").alias("n"))


def quality_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = bars(spark, sf_dir, "day")
    return qu.dropped_symbols(panel, qu.missing_rates(panel, 0.43).where("verdict <> 'fail'"))


def quality_extreme_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qu.extreme_moves(bars(spark, sf_dir)), "move")


def quality_date_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qu.date_gaps(bars(spark, sf_dir, "month"), 30)


def quality_stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = src.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("symbol"), F.col("ts").alias("date"), F.floor(F.col("value") / 20).alias("close"))
    return qu.stale_runs(events, 1).groupBy("symbol").agg(F.count(F.lit(1)).alias("runs"), F.max("length").alias("longest"), F.min("start").alias("start"))


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qu.quality_report(bars(spark, sf_dir, "week"))


def rebalance_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = src.deal_bars(spark, sf_dir, "week").select("date").distinct()
    return qu.next_sessions(qu.business_schedule(sessions), sessions, "1996-01-01")


def delisting_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = fa.with_returns(bars(spark, sf_dir)).select("symbol", "date", "ret")
    return rounded(qu.with_delistings(returns, delistings(spark)), "ret")


def benchmark_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = src.read(spark, sf_dir, "orders")
    account = orders.groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("equity"))
    return rounded(qu.scaled_benchmark(account, src.benchmark_bars(spark, sf_dir, "week")), "bench", digits=3)


def valuation_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir, "day").select("symbol", "date", qu.forward_filled("close").alias("price"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (quality_missing, quality_late_starters, quality_live_gate, quality_dropped, quality_extreme_moves, quality_date_gaps, quality_stale_runs, quality_report, rebalance_dates, delisting_returns, benchmark_alignment, valuation_prices)}

_D, _W, _M = sql_bars("day"), sql_bars("week"), sql_bars("month")
_EXTREME = "SELECT symbol, date, before, close AS after, close / before - 1 AS move FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS before FROM bars) WHERE abs(close / before - 1) > 0.5"
_STALE = """SELECT symbol, min(date) AS start, max(date) AS "end", count(*) - 1 AS length FROM (SELECT symbol, date, close, sum(m) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT symbol, date, close, CASE WHEN close = lag(close) OVER (PARTITION BY symbol ORDER BY date) THEN 0 ELSE 1 END AS m FROM src WHERE close IS NOT NULL)) GROUP BY symbol, run HAVING count(*) - 1 >= """
_MISSING = "SELECT symbol, round(avg((close IS NULL)::INT), 6) AS missing FROM bars GROUP BY 1"
ORACLE_SQL = {
    "quality_missing": f"WITH {_D} SELECT symbol, missing, CASE WHEN missing > 0.43 THEN 'fail' WHEN missing > 0.215 THEN 'warn' ELSE 'ok' END AS verdict FROM ({_MISSING})",
    "quality_late_starters": f"WITH {_D} SELECT symbol, min(date) AS first, max(date) AS last, min(date) - min(min(date)) OVER () > 1 AS late FROM bars WHERE close IS NOT NULL GROUP BY symbol",
    "quality_live_gate": f"WITH {_M} SELECT symbol, count(close) AS n FROM bars GROUP BY symbol HAVING count(close) >= 12 AND avg((close IS NULL)::INT) <= 0.2 AND count(close) FILTER (WHERE date IN (SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 2)) > 0",
    "quality_dropped": f"WITH {_D} SELECT symbol FROM ({_MISSING}) WHERE missing > 0.43",
    "quality_extreme_moves": f"WITH {_W} SELECT symbol, date, before, after, round(move, 6) AS move FROM ({_EXTREME})",
    "quality_date_gaps": f"WITH {_M} SELECT * FROM (SELECT date, lag(date) OVER (ORDER BY date) AS previous, (date - lag(date) OVER (ORDER BY date))::INT AS days FROM (SELECT DISTINCT date FROM bars)) WHERE days > 30",
    "quality_stale_runs": f"WITH src AS (SELECT user_id::VARCHAR AS symbol, ts AS date, floor(value / 20)::BIGINT AS close FROM events), r AS ({_STALE} 1) SELECT symbol, count(*) AS runs, max(length) AS longest, min(start) AS start FROM r GROUP BY symbol",
    "quality_report": f"""WITH {_W}, src AS (SELECT * FROM bars), miss AS ({_MISSING}), late AS (SELECT symbol, min(date) AS first, min(date) - min(min(date)) OVER () > 30 AS late FROM bars WHERE close IS NOT NULL GROUP BY symbol)
SELECT 'missing' AS "check", CASE WHEN missing > 0.05 THEN 'fail' ELSE 'warn' END AS severity, symbol AS key, missing::DOUBLE AS value FROM miss WHERE missing > 0.025
UNION ALL SELECT 'late_start', 'warn', symbol, (first - DATE '1970-01-01')::DOUBLE FROM late WHERE late
UNION ALL SELECT 'extreme_move', 'warn', symbol || '@' || date, round(move, 6) FROM ({_EXTREME})
UNION ALL SELECT 'date_gap', 'warn', date::VARCHAR, days FROM (SELECT date, date - lag(date) OVER (ORDER BY date) AS days FROM (SELECT DISTINCT date FROM bars)) WHERE days > 5
UNION ALL SELECT 'stale', 'warn', symbol || '@' || start, length FROM ({_STALE} 5)""",
    "rebalance_dates": f"""WITH {_W}, ses AS (SELECT DISTINCT date FROM raw), wd AS (SELECT d::DATE AS d, row_number() OVER (ORDER BY d) - 1 AS n FROM (SELECT unnest(generate_series(DATE '1980-01-01', DATE '2020-12-31', INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6),
an AS (SELECT n AS n0 FROM wd WHERE d = DATE '2000-01-03'), sch AS (SELECT d FROM wd, an WHERE (n - n0) % 21 = 0 AND d BETWEEN (SELECT min(date) FROM ses) AND (SELECT max(date) FROM ses))
SELECT DISTINCT date FROM (SELECT (SELECT min(date) FROM ses WHERE date >= d) AS date FROM sch) WHERE date >= DATE '1996-01-01'""",
    "delisting_returns": f"WITH {_W} SELECT symbol, date, round(ret, 6) AS ret, r AS delisting_return FROM rets LEFT JOIN (VALUES {', '.join(f'({s!r}, DATE {d!r}, {r}::DOUBLE)' for s, d, r in DELISTINGS)}) v(symbol, date, r) USING (symbol, date)",
    "benchmark_alignment": """WITH a AS (SELECT date_trunc('month', o_orderdate)::DATE AS date, round(sum(o_totalprice), 2) AS equity FROM orders GROUP BY 1), b AS (SELECT date_trunc('week', l_shipdate)::DATE AS date, round(sum(l_extendedprice) / sum(l_quantity) + 1e-9, 6) AS b FROM lineitem GROUP BY 1),
j AS (SELECT a.date, equity, (SELECT max_by(b, b.date) FROM b WHERE b.date <= a.date) AS b FROM a) SELECT date, equity, round(b / first_value(b) OVER w * first_value(equity) OVER w, 3) AS bench FROM (SELECT *, b IS NULL AS nob FROM j) WINDOW w AS (ORDER BY nob, date)""",
    "valuation_prices": f"WITH {_D} SELECT symbol, date, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date) AS price FROM bars",
}
