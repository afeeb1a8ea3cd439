"""Panels and SQL fragments that several queries use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import factors as fa
from ..sources import panel as src

def of_the_date_before(df: DataFrame) -> DataFrame:
    """The rows of each date under the next date that there is."""
    dates = df.select("date").distinct().withColumn("next", F.lead("date").over(Window.orderBy("date"))).where("next IS NOT NULL")  # a row for each date
    return df.join(dates, "date").withColumn("date", F.col("next")).drop("next")


Query = Callable[[SparkSession, str], DataFrame]

#: Window lengths for weekly bars of the test tables; the operators' defaults are for daily bars.
WEEKLY = fa.Lengths(momentum=(4, 13, 26), skip=4, reversion=10, trend=(10, 40), trend_filter=40, blowoff=10, blowoff_limit=2.0, reversal=2, persistence=13, high=52, contraction=(4, 13), volatility=13)
MONTHLY = fa.Lengths(momentum=(3, 6, 11), skip=1, reversion=6, trend=(3, 10), trend_filter=10, blowoff=6, blowoff_limit=2.0, reversal=1, persistence=6, high=12, contraction=(3, 6), volatility=6)


def bars(spark: SparkSession, sf_dir: str, freq: str = "week") -> DataFrame:
    return src.densify(src.deal_bars(spark, sf_dir, freq))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def quarter_universe(panel: DataFrame, size: int = 20) -> DataFrame:
    """(snapshot_date, symbol, is_member): members are the symbols with the largest volume of the quarter before."""
    by_quarter = panel.groupBy("symbol", F.add_months(F.date_trunc("quarter", "date").cast("date"), 3).alias("snapshot_date")).agg(F.sum(F.coalesce("volume", F.lit(0.0))).alias("v"))
    rank = F.row_number().over(Window.partitionBy("snapshot_date").orderBy(F.desc("v"), "symbol"))
    return by_quarter.select("snapshot_date", "symbol", (rank <= size).alias("is_member"))


def sql_bars(freq: str = "week") -> str:
    return f"""raw AS (SELECT n_name AS symbol, r_name AS sector, date_trunc('{freq}', l_shipdate)::DATE AS date,
    round(sum(l_extendedprice) / sum(l_quantity) + 1e-9, 6) AS close, sum(l_quantity) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2, 3),
bars AS (SELECT g.symbol, g.sector, g.date, CASE WHEN close > 0 THEN close END AS close, volume
  FROM (SELECT * FROM (SELECT DISTINCT symbol, sector FROM raw), (SELECT DISTINCT date FROM raw)) g LEFT JOIN raw USING (symbol, sector, date)),
rets AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM bars)"""


def sql_z(x: str, over: str = "PARTITION BY date") -> str:
    return f"(({x}) - avg({x}) OVER ({over})) / (CASE WHEN stddev_samp({x}) OVER ({over}) = 0 THEN 1 ELSE stddev_samp({x}) OVER ({over}) END)"


def sql_full(x: str, n: int, how: str = "avg") -> str:
    frame = f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} = {n} THEN {how}({x}) {frame} END"


def sql_factors(n: fa.Lengths) -> str:
    """CTEs up to `fac`: the price factors, from `rets`."""
    lag = lambda x, k: f"lag({x}, {k}) OVER (PARTITION BY symbol ORDER BY date)"
    moms = ", ".join(f"{lag('close', n.skip)} / {lag('close', n.skip + w)} - 1 AS m{i}" for i, w in enumerate(n.momentum))
    k = range(len(n.momentum))
    pair = f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n.persistence - 2} PRECEDING AND CURRENT ROW)"
    band = f"(close - ({sql_full('close', n.blowoff)})) / (CASE WHEN ({sql_full('close', n.blowoff, 'stddev_samp')}) = 0 THEN 1 ELSE ({sql_full('close', n.blowoff, 'stddev_samp')}) END)"
    rev = f"-(close - ({sql_full('close', n.reversion)})) / (CASE WHEN ({sql_full('close', n.reversion, 'stddev_samp')}) = 0 THEN 1 ELSE ({sql_full('close', n.reversion, 'stddev_samp')}) END)"
    s, l = n.contraction
    return f"""f0 AS (SELECT *, {lag('ret', 1)} AS before, {moms}, {rev} AS mean_reversion,
    ({sql_full('close', n.trend[0])}) / ({sql_full('close', n.trend[1])}) AS tr,
    CASE WHEN coalesce(close >= ({sql_full('close', n.trend_filter)}), false) THEN 1.0 ELSE {n.penalty} END AS trend_filter,
    CASE WHEN coalesce({band} > {n.blowoff_limit}, false) THEN {n.penalty} ELSE 1.0 END AS blowoff_filter,
    {sql_full('ret', n.reversal, 'sum')} AS rv, close / ({sql_full('close', n.high, 'max')}) AS hi,
    ({sql_full('ret', s, 'stddev_samp')}) / nullif(({sql_full('ret', l, 'stddev_samp')}), 0) AS co,
    ({sql_full('ret', n.volatility, 'stddev_samp')}) * sqrt(252) AS vo,
    count(ret) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n.persistence - 1} PRECEDING AND CURRENT ROW) AS nret FROM rets),
f1 AS (SELECT *, CASE WHEN nret = {n.persistence} THEN corr(before, ret) {pair} END AS pe FROM f0),
f2 AS (SELECT *, {", ".join(f"{sql_z(f'm{i}')} AS z{i}" for i in k)} FROM f1),
fac AS (SELECT symbol, sector, date, close, volume, ret, ({" + ".join(f"coalesce(z{i}, 0)" for i in k)}) / nullif({" + ".join(f"(z{i} IS NOT NULL)::INT" for i in k)}, 0) AS momentum,
    mean_reversion, {sql_z('tr')} AS trend, -({sql_z('rv')}) AS short_term_reversal, {sql_z('pe')} AS trend_persistence, {sql_z('hi')} AS high_proximity,
    -({sql_z('co')}) AS volatility_contraction, -({sql_z('vo')}) AS volatility, trend_filter, blowoff_filter FROM f2)"""


def sql_composite(source: str, weights: dict[str, float], limit: float = 3.0) -> str:
    """CTEs up to `comp` with `score`, from a table of factors."""
    wins = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN greatest(-{limit}, least({limit}, {c})) END AS {c}" for c in weights)
    zs = ", ".join(f"{sql_z(c)} AS {c}" for c in weights)
    total = " + ".join(f"{w} * coalesce({c}, 0)" for c, w in weights.items())
    share = " + ".join(f"{w} * ({c} IS NOT NULL)::INT" for c, w in weights.items())
    return f"""c1 AS (SELECT symbol, sector, date, close, trend_filter, blowoff_filter, {wins} FROM {source}),
c2 AS (SELECT symbol, sector, date, close, trend_filter, blowoff_filter, {zs} FROM c1),
c3 AS (SELECT *, ({total}) / nullif({share}, 0) AS s0 FROM c2),
c4 AS (SELECT *, CASE WHEN s0 >= 0 THEN s0 * trend_filter ELSE s0 * (2 - trend_filter) END AS s1 FROM c3),
comp AS (SELECT *, CASE WHEN s1 >= 0 THEN s1 * blowoff_filter ELSE s1 * (2 - blowoff_filter) END AS score FROM c4)"""


SQL_UNIVERSE = """q AS (SELECT symbol, (date_trunc('quarter', date) + INTERVAL 3 MONTH)::DATE AS snapshot_date, sum(coalesce(volume, 0)) AS v FROM bars GROUP BY 1, 2),
universe AS (SELECT snapshot_date, symbol, row_number() OVER (PARTITION BY snapshot_date ORDER BY v DESC, symbol) <= 20 AS is_member FROM q),
stamp AS (SELECT d.date, (SELECT max(snapshot_date) FROM universe u WHERE u.snapshot_date <= d.date) AS snapshot_date FROM (SELECT DISTINCT date FROM bars) d),
members AS (SELECT date, symbol FROM stamp JOIN universe USING (snapshot_date) WHERE is_member)"""
