"""Model features, targets, walk-forward splits, ranking jobs and their reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import by_symbol, change, full, rank_share, ratio
from .trees import fit_forests, predict_forests


def base_features(panel: DataFrame, returns: Sequence[int] = (5, 10, 21, 63), band: int = 20, atr: int = 14, bias: int = 21, long: int = 63) -> DataFrame:
    """Rolling features of a panel with close and ret; each needs its whole window."""
    step = F.col("close") - F.lag("close").over(by_symbol())
    columns: dict[str, Column] = {f"ret_{n}": change("close", n) for n in returns}
    columns |= {f"vol_{n}": full("ret", n, "stddev_samp") * (252**0.5) for n in returns}
    columns["band_width"] = ratio(4 * full("close", band, "stddev_samp"), full("close", band))
    df = panel.withColumns({"__step": step, "__size": F.abs(step), "__abs": F.abs("ret"), "__sign": F.signum("ret")}).withColumns(columns)
    df = df.withColumns({"atr": ratio(full("__size", atr), F.col("close")), "bias": full("__sign", bias, "sum"), **{f"activity_{n}": ratio(full("__abs", n), full("__abs", long)) for n in returns if n < long}})
    return df.drop("__size", "__abs", "__sign", "__step")


def recursive_means(panel: DataFrame, means: Mapping[str, tuple[str, float]], block: int = 64) -> DataFrame:
    """`panel` with recursive means y += a * (x - y) over each symbol's dates, by name: (column, a).

    The first value starts a mean; missing values keep it and lower its weight against the next value, by 1 - a for each row.
    A row's step is y -> c y + d. Within a block of rows, steps combine by running products and sums; blocks are chained by one
    array for each symbol with two numbers a block. Null before the first value.
    """
    order = by_symbol()
    df = panel.withColumn("__i", F.row_number().over(order) - 1)
    df = df.withColumn("__block", F.floor(F.col("__i") / block))
    seen = {name: F.last(F.when(F.col(x).isNotNull(), F.col("__i")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)) for name, (x, _) in means.items()}
    df = df.withColumns({f"__at_{name}": c for name, c in seen.items()})
    steps = {}
    for name, (x, a) in means.items():
        there, first = F.col(x).isNotNull(), F.col(f"__at_{name}").isNull()
        old = F.pow(F.lit(1 - a), F.col("__i") - F.col(f"__at_{name}"))
        steps[f"__c_{name}"] = F.when(there & ~first, old / (old + a)).otherwise(1.0)
        steps[f"__d_{name}"] = F.when(there, F.when(first, F.col(x)).otherwise(a * F.col(x) / (old + a))).otherwise(0.0)
    inside = Window.partitionBy("symbol", "__block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns(steps).withColumns({f"__p_{name}": F.product(F.col(f"__c_{name}")).over(inside) for name in means})
    df = df.withColumns({f"__s_{name}": F.col(f"__p_{name}") * F.sum(F.col(f"__d_{name}") / F.col(f"__p_{name}")).over(inside) for name in means})
    ends = df.groupBy("symbol", "__block").agg(*[F.max_by(f"__{k}_{name}", "date").alias(f"__{k}_{name}") for name in means for k in "ps"])
    chain = ends.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("__block", *[f"__{k}_{name}" for name in means for k in "ps"]))).alias("__chain"))
    fields = ", ".join(["__block: bigint", *[f"__y_{name}: double" for name in means]])

    def follow(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        return F.concat(done, F.array(F.struct((x["__block"] + 1).alias("__block"), *[(x[f"__p_{name}"] * last[f"__y_{name}"] + x[f"__s_{name}"]).alias(f"__y_{name}") for name in means])))

    start = F.array(F.struct(F.lit(0).cast("long").alias("__block"), *[F.lit(0.0).alias(f"__y_{name}") for name in means])).cast(f"array<struct<{fields}>>")
    carried = chain.select("symbol", F.inline(F.aggregate("__chain", start, follow)))
    whole = df.join(carried, ["symbol", "__block"])
    known = {name: F.col(f"__at_{name}").isNotNull() | F.col(x).isNotNull() for name, (x, _) in means.items()}
    return whole.select(*[c for c in panel.columns if c not in means], *[F.when(known[name], F.col(f"__s_{name}") + F.col(f"__p_{name}") * F.col(f"__y_{name}")).alias(name) for name in means])


def wilder_rsi(panel: DataFrame, n: int = 14) -> DataFrame:
    """`panel` with `rsi`: exponentially weighted gains and losses with 1 / n, from the n-th change on; 100 without losses."""
    step = F.col("close") - F.lag("close").over(by_symbol())
    df = panel.drop("rsi").withColumn("__step", step).withColumns({"__gain": F.greatest(F.col("__step"), F.lit(0.0)), "__loss": F.greatest(-F.col("__step"), F.lit(0.0))})
    df = df.withColumns({c: F.when(F.col("__step").isNotNull(), F.col(c)) for c in ("__gain", "__loss")}).withColumn("__n", F.count("__step").over(by_symbol()))
    df = recursive_means(df, {"__g": ("__gain", 1 / n), "__l": ("__loss", 1 / n)})
    rsi = F.when(F.col("__l") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("__g", "__l")))
    return df.withColumn("rsi", F.when(F.col("__step").isNotNull() & (F.col("__n") >= n), rsi)).drop("__step", "__gain", "__loss", "__n", "__g", "__l")


def macd(panel: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """`panel` with macd, macd_signal and macd_histogram from exponentially weighted means of the close."""
    names = ("macd", "macd_signal", "macd_histogram")
    df = recursive_means(panel.drop(*names), {"__fast": ("close", 2 / (fast + 1)), "__slow": ("close", 2 / (slow + 1))})
    df = recursive_means(df.withColumn("macd", F.col("__fast") - F.col("__slow")).drop("__fast", "__slow"), {"macd_signal": ("macd", 2 / (signal + 1))})
    return df.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))


def feature_table(df: DataFrame, names: Sequence[str], eligible: str | None = None) -> DataFrame:
    """For each base feature its value, percentile rank and missing flag; nulls (and non-members) become 0 after ranking."""
    if eligible:
        df = df.withColumns({c: F.when(F.col(eligible), F.col(c)) for c in names})
    df = df.withColumns({f"{c}_rank": rank_share(c) for c in names})
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in (*names, *[f"{c}_rank" for c in names])}).fillna(0.0, [*names, *[f"{c}_rank" for c in names]])


def compounded_forward(h: int, ret: str = "ret", event: str | None = None) -> Column:
    """Return of the next h sessions; after a delisting event (a column with its return) the event's return counts once, then 0."""
    past = by_symbol().rowsBetween(Window.unboundedPreceding, -1)
    r = F.col(ret)
    if event:
        gone = F.count(event).over(past) > 0
        r = F.when(gone, 0.0).otherwise(F.coalesce(F.col(event), F.col(ret)))
    return r


def forward_return(df: DataFrame, h: int, event: str | None = None) -> DataFrame:
    frame = by_symbol().rowsBetween(1, h)
    df = df.withColumn("__r", compounded_forward(h, event=event))
    return df.withColumn("fwd_ret", F.when(F.count("__r").over(frame) == h, F.product(1 + F.col("__r")).over(frame) - 1)).drop("__r")


def target(df: DataFrame, eligible: str | None = None) -> DataFrame:
    """`label`: percentile rank of fwd_ret among eligible names; `grade`: 0 to 9."""
    kept = F.when(F.col(eligible), F.col("fwd_ret")) if eligible else F.col("fwd_ret")
    df = df.withColumn("__f", kept).withColumn("label", rank_share("__f")).drop("__f")
    return df.withColumn("grade", F.least(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("label"))) * 10), F.lit(9)))


def purged_splits(sessions: DataFrame, rebalances: DataFrame, train: int = 504, validate: int = 63, embargo: int = 21) -> DataFrame:
    """(rebalance_date, date, split, position): training rows end an embargo before validation, which ends one before the date."""
    order = sessions.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)  # a row for each session
    at = rebalances.select(F.col("date").alias("rebalance_date")).join(order, F.col("rebalance_date") == F.col("date")).select("rebalance_date", F.col("i").alias("at"))
    at = at.withColumns({"v0": F.col("at") - validate, "v1": F.col("at") - embargo}).withColumns({"t1": F.col("v0") - embargo}).withColumn("t0", F.greatest(F.lit(0), F.col("v0") - train))
    at = at.where(F.col("t1") - F.col("t0") >= validate)
    spans = at.withColumn("i", F.explode(F.sequence("t0", F.col("v1") - 1)))  # at most train + validate rows for each rebalance
    rows = order.join(spans, "i")
    rows = rows.withColumn("split", F.when(F.col("i") < F.col("t1"), "train").when(F.col("i") >= F.col("v0"), "validate")).where("split IS NOT NULL")
    return rows.select("rebalance_date", "date", "split", F.when(F.col("split") == "train", F.col("i") - F.col("t0")).otherwise(F.col("i") - F.col("v0")).alias("position"))


def training_rows(features: DataFrame, splits: DataFrame, stride: int = 21) -> DataFrame:
    """Labelled rows of every stride-th training session (all validation ones), of dates with two names or more."""
    some = splits.where((F.col("split") == "validate") | (F.col("position") % stride == 0))
    rows = features.where(F.col("label").isNotNull()).join(some, "date")
    return rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("rebalance_date", "date"))).where("__n >= 2").drop("__n")


def walk_forward(features: DataFrame, splits: DataFrame, names: Sequence[str], *, stride: int = 21, least: int = 100, trees: int = 20, depth: int = 5, rate: float = 0.05, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(scores, importances) of one boosted model for each rebalance date, all of them fitted at once; dates with fewer than `least` rows or three training dates are left out.

    The cross-section of each date is scored by its own model.
    """
    spark = features.sparkSession
    rows = training_rows(features, splits, stride).where("split = 'train'").select("rebalance_date", "date", "symbol", "label", *names)
    forests, cuts = fit_forests(rows, names, key="rebalance_date", trees=trees, depth=depth, rate=rate, share=share, least=least)
    today = features.withColumn("rebalance_date", F.col("date")).join(F.broadcast(splits.select("rebalance_date").distinct()), "rebalance_date", "left_semi")  # a row for each rebalance date
    scored = predict_forests(today.select("rebalance_date", "symbol", "date", "label", "fwd_ret", *names), forests, cuts, names, key="rebalance_date", trees=trees, depth=depth)
    gains = [(d, n, float(f.gain[f.feature == i].sum())) for d, f in forests.items() for i, n in enumerate(names)]
    importances = spark.createDataFrame(gains, "date date, feature string, importance double")
    return scored.select("symbol", "date", "margin", "label", "fwd_ret", rank_share("margin").alias("score")), importances


def top_importances(importances: DataFrame, n: int = 20) -> DataFrame:
    share = F.try_divide(F.col("importance"), F.sum("importance").over(Window.partitionBy("date")))
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("importance"), "feature"))
    return importances.withColumns({"percent": 100 * share, "rank": rank}).where(F.col("rank") <= n)


def decile_spread(scores: DataFrame, score: str, outcome: str) -> DataFrame:
    """Mean outcome of the top less that of the bottom tenth (one name at least) of each date."""
    both = scores.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    n = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(Window.partitionBy("date")) / 10))
    up, down = (F.row_number().over(Window.partitionBy("date").orderBy(o, "symbol")) for o in (F.desc(score), F.asc(score)))
    ranked = both.withColumns({"n": n, "up": up, "down": down})
    mean = lambda side: F.avg(F.when(F.col(side) <= F.col("n"), F.col(outcome)))
    return ranked.groupBy("date").agg((mean("up") - mean("down")).alias("spread"))


def validation_report(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Error of the score against the label, of the constant 0.5, and the skill."""
    both = scores.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    report = both.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.pow(F.col(score) - F.col(label), 2))).alias("rmse"), F.sqrt(F.avg(F.pow(F.col(label) - 0.5, 2))).alias("rmse_constant"))
    return report.withColumn("skill", 1 - F.try_divide("rmse", "rmse_constant"))


def ensemble(first: DataFrame, second: DataFrame, weight: float = 0.5, top: int = 10, boost: float = 1.3) -> DataFrame:
    """Two score tables (symbol, date, score) as one: weighted percentile ranks, 0.5 for missing or constant sides, more for names in both tops."""
    def side(df: DataFrame, name: str) -> DataFrame:
        day = Window.partitionBy("date")
        best = F.row_number().over(Window.partitionBy("date").orderBy(F.desc_nulls_last("score"), "symbol"))
        return df.select("symbol", "date", F.when(F.max("score").over(day) > F.min("score").over(day), rank_share("score")).otherwise(0.5).alias(name), (F.col("score").isNotNull() & (best <= top)).alias(f"{name}_top"), (F.max("score").over(day) > F.min("score").over(day)).alias(f"{name}_on"))

    both = side(first, "a").join(side(second, "b"), ["symbol", "date"], "full_outer")
    on = lambda c: F.coalesce(F.max(f"{c}_on").over(Window.partitionBy("date")), F.lit(False))
    mixed = weight * F.coalesce("a", F.lit(0.5)) + (1 - weight) * F.coalesce("b", F.lit(0.5))
    agreed = F.coalesce("a_top", F.lit(False)) & F.coalesce("b_top", F.lit(False)) & on("a") & on("b")
    return both.select("symbol", "date", F.when(agreed, mixed * boost).otherwise(mixed).alias("score"), agreed.alias("consensus"))


def turnover_penalty(scores: DataFrame, previous: DataFrame, penalty: float = 0.1, keys: tuple[str, ...] = ()) -> DataFrame:
    """Scores less a share of their change since the previous table; new symbols keep theirs."""
    before = previous.select(*keys, "symbol", F.col("score").alias("before"))
    joined = scores.join(before, [*keys, "symbol"], "left")
    return joined.withColumn("score", F.col("score") - penalty * F.coalesce(F.abs(F.col("score") - F.col("before")), F.lit(0.0))).drop("before")


def turnover_penalty_chained(scores: DataFrame, penalty: float = 0.1, keys: tuple[str, ...] = ()) -> DataFrame:
    """`scores` (keys, symbol, date, score) less a share of their change since the score that came out at the date before; symbols without one there keep theirs, null scores stay null.

    A symbol's path depends on itself only: its scores of all dates are folded as one array.
    """
    dates = scores.select(*keys, "date").distinct().withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy("date")))  # a row for each date
    good = F.col("score").isNotNull() & ~F.isnan("score")
    paths = scores.where(good).join(dates, [*keys, "date"]).groupBy(*keys, "symbol").agg(F.sort_array(F.collect_list(F.struct("__k", "date", F.col("score").cast("double").alias("score")))).alias("__path"))

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        moved = F.when(last["__k"] == x["__k"] - 1, F.abs(x["score"] - last["score"])).otherwise(0.0)
        return F.concat(done, F.array(F.struct(x["__k"].alias("__k"), x["date"].alias("date"), (x["score"] - penalty * moved).alias("score"))))

    kind = f"array<struct<__k: int, date: {scores.schema['date'].dataType.simpleString()}, score: double>>"
    folded = paths.withColumn("__path", F.aggregate("__path", F.expr(f"cast(array() AS {kind})"), step))
    out = folded.select(*keys, "symbol", F.explode("__path").alias("__p")).select(*keys, "symbol", "__p.date", "__p.score")
    return out.unionByName(scores.where(~F.coalesce(good, F.lit(False))).select(*keys, "symbol", "date", F.lit(None).cast("double").alias("score")))
