"""Price factors, filters and the composite score, as columns over a dense panel (symbol, sector, date, close)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import by_symbol, change, clean, full, last_rows, mean_of, moment_corr, ratio, unit, zscore


@dataclass(frozen=True)
class Lengths:
    """Window lengths in sessions."""

    momentum: Sequence[int] = (42, 126, 252)
    skip: int = 21
    reversion: int = 20
    trend: tuple[int, int] = (50, 200)
    trend_filter: int = 200
    blowoff: int = 20
    blowoff_limit: float = 4.0
    penalty: float = 0.5
    reversal: int = 5
    persistence: int = 21
    high: int = 252
    contraction: tuple[int, int] = (10, 63)
    volatility: int = 63


#: Default weights of the composite.
WEIGHTS = {"momentum": 0.5, "high_proximity": 0.2, "short_term_reversal": 0.1, "volatility_contraction": 0.1, "trend_persistence": 0.1}


def with_returns(panel: DataFrame) -> DataFrame:
    """Simple and log returns; a gap gives no return."""
    before = F.lag("close").over(by_symbol())
    return panel.withColumns({"ret": ratio("close", before) - 1, "log_ret": F.ln(ratio("close", before))})


def raw_factors(panel: DataFrame, n: Lengths = Lengths()) -> DataFrame:
    """The factors before any cross-section. All windows partition by symbol in date order and share one sort."""
    panel = with_returns(panel).withColumn("__before", F.lag("ret").over(by_symbol()))
    short, long = n.contraction
    pairs = last_rows(n.persistence - 1)
    corr = moment_corr(F.col("__before"), F.col("ret"), lambda v: F.sum(v).over(pairs))
    columns: dict[str, Column] = {f"__momentum{i}": change("close", w, n.skip) for i, w in enumerate(n.momentum)}
    columns |= {
        "mean_reversion": -(F.col("close") - full("close", n.reversion)) / unit(full("close", n.reversion, "stddev_samp")),
        "__trend": ratio(full("close", n.trend[0]), full("close", n.trend[1])),
        "trend_filter": F.when(F.coalesce(F.col("close") >= full("close", n.trend_filter), F.lit(False)), 1.0).otherwise(n.penalty),
        "blowoff_filter": F.when(F.coalesce((F.col("close") - full("close", n.blowoff)) / unit(full("close", n.blowoff, "stddev_samp")) > n.blowoff_limit, F.lit(False)), n.penalty).otherwise(1.0),
        "__reversal": full("ret", n.reversal, "sum"),
        "__persistence": F.when(F.count("ret").over(last_rows(n.persistence)) == n.persistence, corr),
        "__high": ratio("close", full("close", n.high, "max")),
        "__contraction": ratio(full("ret", short, "stddev_samp"), F.nullif(full("ret", long, "stddev_samp"), F.lit(0.0))),
        "__volatility": full("ret", n.volatility, "stddev_samp") * (252**0.5),
    }
    return panel.withColumns(columns).drop("__before")


FACTORS = ("momentum", "mean_reversion", "trend", "short_term_reversal", "trend_persistence", "high_proximity", "volatility_contraction", "volatility")


def price_factors(panel: DataFrame, n: Lengths = Lengths()) -> DataFrame:
    """All price factors, scored across each date; filters as multipliers."""
    df = raw_factors(panel, n)
    z = {f"__momentum{i}": zscore(f"__momentum{i}") for i in range(len(n.momentum))}
    z |= {"trend": zscore("__trend"), "short_term_reversal": -zscore("__reversal"), "trend_persistence": zscore("__persistence"), "high_proximity": zscore("__high"), "volatility_contraction": -zscore("__contraction"), "volatility": -zscore("__volatility")}
    df = df.withColumns(z).withColumn("momentum", mean_of([F.col(f"__momentum{i}") for i in range(len(n.momentum))]))
    return df.select(*panel.columns, "ret", "log_ret", *FACTORS, "trend_filter", "blowoff_filter")


def winsorized(x: str, limit: float = 3.0) -> Column:
    """Cut to +-limit. Score the result again with zscore."""
    return F.when(F.col(x).isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col(x))))


def neutral_key(panel: DataFrame, least: int = 5) -> DataFrame:
    """`panel` with __group: the sector if it has `least` symbols, else one fallback group of all other symbols."""
    members = panel.select("symbol", "sector").distinct()
    sizes = members.where("sector IS NOT NULL").groupBy("sector").agg(F.count(F.lit(1)).alias("__size"))
    return panel.join(sizes, "sector", "left").withColumn("__group", F.when(F.col("__size") >= least, F.col("sector")).otherwise("__FALLBACK__")).drop("__size")


def sector_neutral(panel: DataFrame, names: Sequence[str], least: int = 5) -> DataFrame:
    """Scores within sectors; small and missing sectors are pooled, and left as they are if the pool has one symbol."""
    grouped = neutral_key(panel, least)
    inside = Window.partitionBy("date", "__group")
    # Two different symbols, if the least is not the greatest.
    alone = F.coalesce(F.min("symbol").over(inside) == F.max("symbol").over(inside), F.lit(True))
    return grouped.withColumns({c: F.when((F.col("__group") == "__FALLBACK__") & alone, F.col(c)).otherwise(zscore(c, inside)) for c in names}).drop("__group")


def apply_multiplier(score: Column, multiplier: Column) -> Column:
    """A penalty: shrinks positive scores, deepens negative ones."""
    return F.when(score >= 0, score * multiplier).otherwise(score * (2.0 - multiplier))


def weighted_mean(weights: Mapping[str, float]) -> Column:
    """Weighted mean of the factors that a row has."""
    used = {k: w for k, w in weights.items() if w > 0}
    if not used:
        raise ValueError("no factor has a positive weight")
    total = reduce(lambda a, b: a + b, [w * F.coalesce(F.col(k), F.lit(0.0)) for k, w in used.items()])
    share = reduce(lambda a, b: a + b, [F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in used.items()])
    return ratio(total, F.nullif(share, F.lit(0.0)))


def composite(factors: DataFrame, weights: Mapping[str, float] = WEIGHTS, *, eligible: str | None = None, neutral: bool = False, limit: float = 3.0) -> DataFrame:
    """The composite score of a factor table: mask, sector neutrality, winsorising, weighted mean, filters."""
    names = [k for k, w in weights.items() if w > 0]
    df = factors
    if eligible:
        df = df.withColumns({c: F.when(F.col(eligible), F.col(c)) for c in names})
        df = df.withColumns({c: zscore(c) for c in names})
    if neutral:
        df = sector_neutral(df, names)
    df = df.withColumns({c: winsorized(c, limit) for c in names})
    df = df.withColumns({c: zscore(c) for c in names}).withColumn("score", weighted_mean(weights))
    df = df.withColumn("score", apply_multiplier(F.col("score"), F.col("trend_filter")))
    return df.withColumn("score", apply_multiplier(F.col("score"), F.col("blowoff_filter")))


def top_by_score(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best finite scores of each date, ties by symbol, with their rank."""
    finite = scores.withColumn(score, clean(score)).where(F.col(score).isNotNull())
    order = Window.partitionBy("date").orderBy(F.desc(score), "symbol")
    return finite.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def latest(scores: DataFrame) -> DataFrame:
    """The last cross-section."""
    newest = scores.agg(F.max("date").alias("date"))
    return scores.join(F.broadcast(newest), "date", "left_semi")


def membership(dates: DataFrame, universe: DataFrame, start: date | None = None) -> DataFrame:
    """(date, symbol, eligible): membership by the latest snapshot on or before each date; the whole snapshot counts.

    With `start`, the first day of a run, a universe whose first snapshot is later raises, instead of leaving the run without members until then.
    """
    if start is not None:
        first = universe.agg(F.min("snapshot_date")).first()[0]
        if first is None or first > start:
            raise ValueError(f"the universe starts on {first}, after the run's first day {start}")
    stamps = universe.select(F.col("snapshot_date")).distinct()
    line = dates.select("date", F.lit(None).cast("date").alias("snap")).union(stamps.select(F.col("snapshot_date").alias("date"), F.col("snapshot_date").alias("snap")))
    asof = line.withColumn("snapshot_date", F.max("snap").over(Window.orderBy("date").rangeBetween(Window.unboundedPreceding, 0)))  # one row for each date
    asof = dates.join(asof.select("date", "snapshot_date").distinct(), "date")
    return asof.join(universe.where("is_member"), "snapshot_date").select("date", "symbol", F.lit(True).alias("eligible"))


def fundamental_scores(fields: Sequence[str], inverse: bool, keys: Sequence[str] = ("as_of",)) -> Column:
    """Mean score, within a snapshot, of the ratios (or of their inverses) that have more than two values; 0 where none has."""
    every = Window.partitionBy(*keys)
    scores = []
    for c in fields:
        value = F.try_divide(F.lit(1.0), F.nullif(F.col(c), F.lit(0.0))) if inverse else F.col(c)
        scores.append(F.when(F.count(F.col(c)).over(every) > 2, F.try_divide(value - F.avg(value).over(every), F.stddev_samp(value).over(every))))
    none = reduce(lambda a, b: a & b, [F.count(F.col(c)).over(every) <= 2 for c in fields])
    return F.when(none, 0.0).otherwise(mean_of(scores))
