"""Factor evaluation: information coefficients, quantiles, decay, turnover, collinearity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import by_symbol, last_rows, moment_corr, rank_share


def forward_sum(ret: str, h: int) -> Column:
    """Sum of the next h returns, null unless all are there."""
    frame = by_symbol().rowsBetween(1, h)
    return F.when(F.count(ret).over(frame) == h, F.sum(ret).over(frame))


def information_coefficients(df: DataFrame, factor: str, forward: str, *, keys: Sequence[str] = (), least: int = 10, rank: bool = True) -> DataFrame:
    """(keys, date, ic): correlation of factor and forward return across each date, by ranks or plain; null under `least` names."""
    both = df.where(F.col(factor).isNotNull() & F.col(forward).isNotNull()).select(*keys, "date", F.col(factor).alias("f"), F.col(forward).alias("r"))
    if rank:
        group = (*keys, "date")
        both = both.withColumns({"f": rank_share("f", group), "r": rank_share("r", group)})
    return both.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("n"), moment_corr(F.col("f"), F.col("r"), F.sum).alias("ic")).select(*keys, "date", F.when(F.col("n") >= least, F.col("ic")).alias("ic"))


def ic_summary(ics: DataFrame, keys: Sequence[str] = (), least: int = 20) -> DataFrame:
    """Mean, deviation, ratio, hit rate, t and count of the coefficients; null under `least` dates. A coefficient that is 0 but for noise of the last digits is no hit."""
    s = ics.where("ic IS NOT NULL").groupBy(*keys).agg(F.count("ic").alias("n"), F.avg("ic").alias("m"), F.stddev_samp("ic").alias("s"), F.avg((F.round("ic", 12) > 0).cast("double")).alias("h"))
    enough = F.col("n") >= least
    icir = F.when(F.col("s") > 0, F.try_divide("m", "s")).otherwise(0.0)
    return s.select(*keys, *[F.when(enough, F.round(v, d)).alias(name) for name, v, d in (("mean_ic", F.col("m"), 4), ("std_ic", F.col("s"), 4), ("icir", icir, 4), ("hit_rate", F.col("h"), 4), ("t_stat", icir * F.sqrt("n"), 2))], "n")


def quantile_returns(df: DataFrame, factor: str, forward: str, q: int = 5) -> DataFrame:
    """(date, q1..qn, spread): mean forward return of right-closed bins between interpolated quantiles.

    Dates with fewer than 2 q names, or with equal edges, are left out.
    """
    both = df.where(F.col(factor).isNotNull() & F.col(forward).isNotNull()).select("date", F.col(factor).alias("f"), F.col(forward).alias("r"))
    edges = both.groupBy("date").agg(F.percentile("f", F.array(*[F.lit(i / q) for i in range(q + 1)])).alias("e"), F.count(F.lit(1)).alias("n"))
    edges = edges.where((F.col("n") >= 2 * q) & (F.size(F.array_distinct("e")) == q + 1))
    binned = both.join(edges, "date").withColumn("bin", F.greatest(F.lit(1), F.size(F.filter("e", lambda x: x < F.col("f")))))
    wide = binned.groupBy("date").agg(*[F.avg(F.when(F.col("bin") == i, F.col("r"))).alias(f"q{i}") for i in range(1, q + 1)])
    return wide.withColumn("spread", F.col(f"q{q}") - F.col("q1"))


def factor_decay(df: DataFrame, factor: str, horizons: Sequence[int] = (1, 5, 10, 21, 42, 63)) -> DataFrame:
    """The coefficient summary for forward sums of several lengths, one row each."""
    wide = df.select("symbol", "date", factor, *[forward_sum("ret", h).alias(f"h{h}") for h in horizons])
    long = wide.select("date", factor, F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"h{h}").alias("forward")) for h in horizons])))
    return ic_summary(information_coefficients(long, factor, "forward", keys=("horizon",)), ("horizon",))


def factor_turnover(df: DataFrame, factor: str) -> DataFrame:
    """Mean absolute change of the percentile rank from date to date."""
    ranked = df.select("symbol", "date", rank_share(factor).alias("p"))
    return ranked.withColumn("d", F.abs(F.col("p") - F.lag("p").over(by_symbol()))).groupBy("date").agg(F.avg("d").alias("turnover"))


def factor_correlations(df: DataFrame, factors: Sequence[str], every: int = 21, least: int = 10) -> DataFrame:
    """(a, b, corr): mean over every n-th date of the rank correlation of each pair; constant sides count 0."""
    dates = df.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date")) - 1).where(F.col("k") % every == 0).select("date")
    long = df.join(F.broadcast(dates), "date", "left_semi").where(F.col(factors[0]).isNotNull())
    long = long.select("symbol", "date", F.inline(F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).alias("v")) for f in factors])))
    ranked = long.select("symbol", "date", "name", rank_share("v", ("date", "name")).alias("p"))
    left, right = ranked.select("symbol", "date", F.col("name").alias("a"), F.col("p").alias("x")), ranked.select("symbol", "date", F.col("name").alias("b"), F.col("p").alias("y"))
    by_day = left.join(right, ["symbol", "date"]).groupBy("a", "b", "date").agg(F.count(F.lit(1)).alias("n"), moment_corr(F.col("x"), F.col("y"), F.sum).alias("c")).where(F.col("n") >= least)
    return by_day.groupBy("a", "b").agg(F.round(F.avg(F.coalesce("c", F.lit(0.0))), 3).alias("corr"))


def variance_inflation(df: DataFrame, factors: Sequence[str], digits: int = 2) -> DataFrame:
    """(date, factor, vif): 1 / (1 - R^2) of each factor on the others; rows complete in all factors, at least k + 2; infinite where the others give it whole, null where it is constant.

    Elimination on each date's correlation matrix, all dates and factors at once: what is left of a factor's own cell is 1 - R^2. A pivot of 0 is one that others give whole and is left out.
    """
    k = len(factors)
    complete = df.select("date", *factors).dropna(subset=list(factors))
    sums = [F.avg(F.col(a)).alias(f"s{i}") for i, a in enumerate(factors)] + [F.avg(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(factors) for j, b in enumerate(factors) if j >= i]
    rows = complete.groupBy("date").agg(F.count(F.lit(1)).alias("n"), *sums).where(F.col("n") >= k + 2)
    rows = rows.select("date", *[(F.col(f"p{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}")).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)])
    scale = lambda i, j: F.try_divide(F.col(f"c{i}_{j}"), F.sqrt(F.greatest(F.col(f"c{i}_{i}"), F.lit(0.0)) * F.greatest(F.col(f"c{j}_{j}"), F.lit(0.0))))
    rows = rows.select("date", *[F.coalesce(scale(i, j), F.lit(0.0)).alias(f"r{i}_{j}") for i in range(k) for j in range(i, k)])
    # One copy of the matrix for each target, which is eliminated last.
    order = {t: [i for i in range(k) if i != t] + [t] for t in range(k)}
    cell = lambda t, i, j: f"m{t}_{i}_{j}"
    names = {t: [(i, j) for i in range(k) for j in range(i, k)] for t in range(k)}
    rows = rows.select("date", *[F.col(f"r{min(order[t][i], order[t][j])}_{max(order[t][i], order[t][j])}").alias(cell(t, i, j)) for t in range(k) for i, j in names[t]])
    for p in range(k - 1):
        left = [(i, j) for i in range(p + 1, k) for j in range(i, k)]
        lower = lambda t, i, j, p=p: F.when(F.col(cell(t, p, p)) > 1e-10, F.col(cell(t, i, j)) - F.col(cell(t, p, i)) * F.col(cell(t, p, j)) / F.col(cell(t, p, p))).otherwise(F.col(cell(t, i, j)))
        rows = rows.select("date", *[lower(t, i, j).alias(cell(t, i, j)) for t in range(k) for i, j in left], *([] if p else [F.col(cell(t, k - 1, k - 1)).alias(f"own{t}") for t in range(k)]), *([f"own{t}" for t in range(k)] if p else []))
    rest = lambda t: F.col(cell(t, k - 1, k - 1))
    own = (lambda t: F.col(f"own{t}")) if k > 1 else rest
    vif = lambda t: F.when(own(t) > 0, F.when(rest(t) > 1e-10, F.round(1 / rest(t), digits)).otherwise(float("inf")))
    return rows.select("date", F.inline(F.array(*[F.struct(F.lit(f).alias("factor"), vif(t).alias("vif")) for t, f in enumerate(factors)])))


def rolling_sharpe(returns: DataFrame, window: int = 63) -> DataFrame:
    frame = last_rows(window)
    full = F.count("ret").over(frame) == window
    return returns.withColumn("sharpe", F.when(full, F.try_divide(F.avg("ret").over(frame), F.stddev_samp("ret").over(frame)) * (252**0.5)))
