"""Queries on panels, factors, masks and composite scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import rank_share, zscore
from ..operators import factors as fa
from ..sources import panel as src
from .common import MONTHLY, SQL_UNIVERSE, WEEKLY, Query, bars, quarter_universe, rounded, sql_bars, sql_composite, sql_factors, sql_z


def flagship_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fa.composite(fa.price_factors(bars(spark, sf_dir, "month"), MONTHLY), {"momentum": 0.7, "high_proximity": 0.3})
    return rounded(fa.latest(fa.top_by_score(scored, 12)).select("date", "symbol", "sector", "score", "rank"), "score")


def panel_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir, "week").select("symbol", "sector", "date", "close", "volume")


def panel_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = src.deal_bars(spark, sf_dir).select("symbol", "date", "close")
    return symbols.unionByName(src.benchmark_bars(spark, sf_dir))


def cross_section_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_benchmark(spark, sf_dir).where("symbol <> 'MARKET'").where(F.col("date").between("1995-01-01", "1996-12-31"))


def panel_completed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.completed_sessions(src.deal_bars(spark, sf_dir, "day"), F.lit("1997-06-18 19:00:00").cast("timestamp")).select("symbol", "date", "close")


def panel_static_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = src.read(spark, sf_dir, "nation").where("n_regionkey IN (1, 2)").select(F.col("n_name").alias("symbol"))
    return src.static_universe(src.deal_bars(spark, sf_dir), listed).select("symbol", "date", "close")


def panel_average_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(src.average_volume(bars(spark, sf_dir)), "adv")


def panel_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fa.with_returns(bars(spark, sf_dir)).select("symbol", "date", "ret", "log_ret"), "ret", "log_ret")


def factor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fa.price_factors(bars(spark, sf_dir), WEEKLY)
    return rounded(scored.select("symbol", "date", *fa.FACTORS, "trend_filter", "blowoff_filter"), *fa.FACTORS, digits=5)


def factor_sector_neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fa.price_factors(bars(spark, sf_dir), WEEKLY).select("symbol", "sector", "date", "momentum", "volatility")
    neutral = fa.sector_neutral(scored.withColumn("sector", F.when(F.col("symbol") != "NATION_3", F.col("sector"))), ["momentum", "volatility"])
    return rounded(neutral.select("symbol", "date", "momentum", "volatility"), "momentum", "volatility", digits=5)


def factor_standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fa.price_factors(bars(spark, sf_dir), WEEKLY).select("symbol", "date", "volume", "momentum")
    df = df.withColumn("cut", fa.winsorized("momentum", 1.0)).withColumns({"z": zscore("cut"), "share": rank_share("volume")})
    return rounded(df.select("symbol", "date", "z", "share"), "z", "share", digits=5)


def universe_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = bars(spark, sf_dir)
    return fa.membership(panel.select("date").distinct(), quarter_universe(panel)).select("date", "symbol", "eligible")


def composite_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = bars(spark, sf_dir)
    member = fa.membership(panel.select("date").distinct(), quarter_universe(panel))
    factors = fa.price_factors(panel, WEEKLY).join(member, ["date", "symbol"], "left").withColumn("eligible", F.coalesce("eligible", F.lit(False)))
    return rounded(fa.composite(factors, eligible="eligible").select("symbol", "date", "score"), "score", digits=5)


def composite_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rounded(fa.composite(fa.price_factors(bars(spark, sf_dir), WEEKLY)), "score", digits=5)
    return fa.top_by_score(scored, 12).select("date", "symbol", "score", "rank")


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = src.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("symbol"))
    c = src.read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.avg("c_acctbal"), 4).alias("ratio1"), F.count(F.lit(1)).cast("double").alias("ratio3"))
    s = src.read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.round(F.avg("s_acctbal"), 4).alias("ratio2"))
    return places.join(c, "k", "left").join(s, "k", "left").select(F.lit("1998-01-01").cast("date").alias("as_of"), "symbol", "ratio1", "ratio2", "ratio3")


def fundamental_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = ["ratio1", "ratio2", "ratio3"]
    df = fundamentals(spark, sf_dir).withColumns({"value": fa.fundamental_scores(ratios, True), "quality": fa.fundamental_scores(ratios, False)})
    return rounded(df.select("symbol", "value", "quality"), "value", "quality", digits=5)


def fundamentals_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot on every session for which it was fetched in time (fetch date less 90 days), and the static score repeated on it."""
    sessions = src.deal_bars(spark, sf_dir, "month").select("date").distinct()
    scored = fundamental_scores(spark, sf_dir).withColumn("fetched", F.lit("1998-01-01").cast("date"))
    return sessions.join(scored, F.date_sub("fetched", 90) <= F.col("date")).select("date", "symbol", "value")


QUERIES: dict[str, Query] = {f.__name__: f for f in (flagship_composite, panel_bars, panel_benchmark, cross_section_members, panel_completed_sessions, panel_static_universe, panel_average_volume, panel_returns, factor_table, factor_sector_neutral, factor_standardized, universe_mask, composite_signal, composite_top, fundamental_scores, fundamentals_available)}

_FUND = """fund AS (SELECT n_name AS symbol, r1, r2, r3 FROM nation
  LEFT JOIN (SELECT c_nationkey AS k, round(avg(c_acctbal), 4) AS r1, count(*)::DOUBLE AS r3 FROM customer GROUP BY 1) c ON c.k = n_nationkey
  LEFT JOIN (SELECT s_nationkey AS k, round(avg(s_acctbal), 4) AS r2 FROM supplier GROUP BY 1) s ON s.k = n_nationkey),
inv AS (SELECT *, 1 / nullif(r1, 0) AS i1, 1 / nullif(r2, 0) AS i2, 1 / nullif(r3, 0) AS i3 FROM fund),"""
_PLAIN_Z = lambda x: f"({x} - avg({x}) OVER ()) / nullif(stddev_samp({x}) OVER (), 0)"
_MEAN = lambda xs: "(" + " + ".join(f"coalesce({x}, 0)" for x in xs) + ") / nullif(" + " + ".join(f"({x} IS NOT NULL)::INT" for x in xs) + ", 0)"
_FUND_SCORES = _FUND + f"""zs AS (SELECT symbol, {", ".join(f"CASE WHEN count({b}{i}) OVER () > 2 THEN {_PLAIN_Z(f'{a}{i}')} END AS {a}z{i}" for a, b in (("i", "r"), ("r", "r")) for i in (1, 2, 3))} FROM inv),
scores AS (SELECT symbol, round({_MEAN(['iz1', 'iz2', 'iz3'])}, 5) AS value, round({_MEAN(['rz1', 'rz2', 'rz3'])}, 5) AS quality FROM zs)"""
_F5 = ", ".join(f"round({c}, 5) AS {c}" for c in fa.FACTORS)
_MASKED = ", ".join(f"CASE WHEN e THEN {c} END AS {c}" for c in fa.WEIGHTS)
_REZ = ", ".join(f"{sql_z(c)} AS {c}" for c in fa.WEIGHTS)

ORACLE_SQL = {
    "flagship_composite": f"WITH {sql_bars('month')}, {sql_factors(MONTHLY)}, {sql_composite('fac', {'momentum': 0.7, 'high_proximity': 0.3})}, top AS (SELECT date, symbol, sector, score, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol)::INT AS rank FROM comp WHERE score IS NOT NULL) SELECT date, symbol, sector, round(score, 6) AS score, rank FROM top WHERE rank <= 12 AND date = (SELECT max(date) FROM top)",
    "panel_bars": f"WITH {sql_bars()} SELECT symbol, sector, date, close, volume FROM bars",
    "panel_benchmark": f"WITH {sql_bars()} SELECT symbol, date, close FROM raw UNION ALL SELECT 'MARKET', date_trunc('week', l_shipdate)::DATE, round(sum(l_extendedprice) / sum(l_quantity) + 1e-9, 6) FROM lineitem GROUP BY 2",
    "cross_section_members": f"WITH {sql_bars()} SELECT symbol, date, close FROM raw WHERE date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'",
    "panel_completed_sessions": f"WITH {sql_bars('day')} SELECT symbol, date, close FROM raw WHERE date <= DATE '1997-06-17'",
    "panel_static_universe": f"WITH {sql_bars()} SELECT symbol, date, close FROM raw WHERE symbol IN (SELECT n_name FROM nation WHERE n_regionkey IN (1, 2))",
    "panel_average_volume": f"WITH {sql_bars()} SELECT symbol, round(avg(volume), 6) AS adv FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars WHERE volume IS NOT NULL) WHERE k <= 30 GROUP BY symbol HAVING avg(volume) > 0",
    "panel_returns": f"WITH {sql_bars()} SELECT symbol, date, round(ret, 6) AS ret, round(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)), 6) AS log_ret FROM rets",
    "factor_table": f"WITH {sql_bars()}, {sql_factors(WEEKLY)} SELECT symbol, date, {_F5}, trend_filter, blowoff_filter FROM fac",
    "factor_sector_neutral": f"WITH {sql_bars()}, {sql_factors(WEEKLY)}, s AS (SELECT symbol, date, momentum, volatility, CASE WHEN symbol <> 'NATION_3' THEN sector END AS sec FROM fac), n AS (SELECT sec, count(DISTINCT symbol) AS k FROM s WHERE sec IS NOT NULL GROUP BY 1), g AS (SELECT s.*, CASE WHEN k >= 5 THEN s.sec ELSE '__F' END AS grp FROM s LEFT JOIN n ON s.sec = n.sec) SELECT symbol, date, round({sql_z('momentum', 'PARTITION BY date, grp')}, 5) AS momentum, round({sql_z('volatility', 'PARTITION BY date, grp')}, 5) AS volatility FROM g",
    "factor_standardized": f"WITH {sql_bars()}, {sql_factors(WEEKLY)}, c AS (SELECT symbol, date, volume, CASE WHEN momentum IS NOT NULL THEN greatest(-1.0, least(1.0, momentum)) END AS cut FROM fac) SELECT symbol, date, round({sql_z('cut')}, 5) AS z, round(CASE WHEN volume IS NOT NULL THEN (rank() OVER (PARTITION BY date, volume IS NULL ORDER BY volume) + (count(volume) OVER (PARTITION BY date, volume) - 1) / 2.0) / count(volume) OVER (PARTITION BY date) END, 5) AS share FROM c",
    "universe_mask": f"WITH {sql_bars()}, {SQL_UNIVERSE} SELECT date, symbol, true AS eligible FROM members",
    "composite_signal": f"WITH {sql_bars()}, {SQL_UNIVERSE}, {sql_factors(WEEKLY)}, m1 AS (SELECT fac.*, m.symbol IS NOT NULL AS e FROM fac LEFT JOIN members m ON m.date = fac.date AND m.symbol = fac.symbol), m2 AS (SELECT symbol, sector, date, close, trend_filter, blowoff_filter, {_MASKED} FROM m1), m3 AS (SELECT symbol, sector, date, close, trend_filter, blowoff_filter, {_REZ} FROM m2), {sql_composite('m3', fa.WEIGHTS)} SELECT symbol, date, round(score, 5) AS score FROM comp",
    "composite_top": f"WITH {sql_bars()}, {sql_factors(WEEKLY)}, {sql_composite('fac', fa.WEIGHTS)}, r AS (SELECT date, symbol, round(score, 5) AS score FROM comp WHERE score IS NOT NULL) SELECT * FROM (SELECT date, symbol, score, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol)::INT AS rank FROM r) WHERE rank <= 12",
    "fundamental_scores": f"WITH {_FUND_SCORES} SELECT * FROM scores",
    "fundamentals_available": f"WITH {_FUND_SCORES} SELECT date, symbol, value FROM scores, (SELECT DISTINCT date_trunc('month', l_shipdate)::DATE AS date FROM lineitem) WHERE date >= DATE '1998-01-01' - 90",
}
