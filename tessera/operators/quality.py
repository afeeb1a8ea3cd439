"""Data quality of a dense panel, trading calendar, and event checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import by_symbol, clean, positive


def missing_rates(panel: DataFrame, fail: float = 0.05) -> DataFrame:
    """(symbol, missing, verdict): share of sessions without a close; fail above the limit, warn above half of it."""
    rates = panel.groupBy("symbol").agg(F.avg(F.col("close").isNull().cast("double")).alias("missing"))
    return rates.withColumn("verdict", F.when(F.col("missing") > fail, "fail").when(F.col("missing") > fail / 2, "warn").otherwise("ok"))


def late_starters(panel: DataFrame, days: int = 30) -> DataFrame:
    """First and last session with a close, and whether a symbol starts more than `days` after the earliest."""
    spans = panel.where(F.col("close").isNotNull()).groupBy("symbol").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    earliest = spans.agg(F.min("first").alias("earliest"))
    return spans.join(F.broadcast(earliest)).select("symbol", "first", "last", (F.datediff("first", "earliest") > days).alias("late"))


def live_gate(panel: DataFrame, benchmark: str | None = None, *, least: int = 200, missing: float = 0.05, breadth: float = 0.8) -> DataFrame:
    """The panel's symbols that are fit to be bought now; raises if too few are, or the benchmark is not.

    A symbol needs `least` finite positive closes, at most `missing` gaps, and a close in the last two sessions.
    """
    clean_close = positive(clean("close"))
    recent = Window.orderBy(F.desc("date"))
    last_two = panel.select("date").distinct().withColumn("k", F.row_number().over(recent)).where("k <= 2").agg(F.min("date").alias("since"))
    checked = panel.join(F.broadcast(last_two)).groupBy("symbol").agg(F.count(clean_close).alias("n"), F.avg(clean_close.isNull().cast("double")).alias("missing"), F.max(F.when(F.col("date") >= F.col("since"), clean_close)).isNotNull().alias("alive"))
    passed = checked.where((F.col("n") >= least) & (F.col("missing") <= missing) & F.col("alive")).select("symbol")
    counts = checked.join(passed.withColumn("ok", F.lit(True)), "symbol", "left").agg(F.count_if((F.col("symbol") != F.lit(benchmark or ""))).alias("n"), F.count_if(F.col("ok") & (F.col("symbol") != F.lit(benchmark or ""))).alias("good"), F.coalesce(F.max(F.when(F.col("symbol") == F.lit(benchmark or ""), F.coalesce("ok", F.lit(False)))), F.lit(benchmark is None)).alias("bench")).first()
    if counts["good"] < max(-(-counts["n"] * breadth // 1), 2) or not counts["bench"]:
        raise ValueError(f"live data: {counts['good']} of {counts['n']} symbols pass, benchmark {'passes' if counts['bench'] else 'fails'}")
    return panel.join(passed, "symbol", "left_semi")


def dropped_symbols(panel: DataFrame, kept: DataFrame) -> DataFrame:
    return panel.select("symbol").distinct().join(kept.select("symbol").distinct(), "symbol", "left_anti")


def extreme_moves(panel: DataFrame, limit: float = 0.5) -> DataFrame:
    """Changes beyond the limit, with the price before and after."""
    before = F.lag("close").over(by_symbol())
    moved = panel.withColumns({"before": before, "move": F.try_divide(F.col("close"), before) - 1})
    return moved.where(F.abs("move") > limit).select("symbol", "date", "before", F.col("close").alias("after"), "move")


def date_gaps(panel: DataFrame, days: int = 5) -> DataFrame:
    """Sessions more than `days` calendar days apart."""
    dates = panel.select("date").distinct()
    return dates.withColumn("previous", F.lag("date").over(Window.orderBy("date"))).withColumn("days", F.datediff("date", "previous")).where(F.col("days") > days)


def stale_runs(panel: DataFrame, least: int = 5) -> DataFrame:
    """Runs of at least `least` zero changes over the closes that are there: start, end, length, price."""
    there = panel.where(F.col("close").isNotNull()).select("symbol", "date", "close")
    moved = (F.col("close") != F.lag("close").over(by_symbol())).cast("int")
    runs = there.withColumn("moved", F.coalesce(moved, F.lit(1))).withColumn("run", F.sum("moved").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("symbol", "run").agg(F.min("date").alias("start"), F.max("date").alias("end"), (F.count(F.lit(1)) - 1).alias("length"), F.first("close").alias("price")).where(F.col("length") >= least).drop("run")


def quality_report(panel: DataFrame) -> DataFrame:
    """(check, severity, key, value): findings of all checks in one table."""
    row = lambda df, check, severity, key, value: df.select(F.lit(check).alias("check"), severity.alias("severity"), key.cast("string").alias("key"), value.cast("double").alias("value"))
    missing = missing_rates(panel).where("verdict <> 'ok'")
    parts = [
        row(missing, "missing", F.col("verdict"), F.col("symbol"), F.round("missing", 6)),
        row(late_starters(panel).where("late"), "late_start", F.lit("warn"), F.col("symbol"), F.datediff("first", F.lit("1970-01-01"))),
        row(extreme_moves(panel), "extreme_move", F.lit("warn"), F.concat_ws("@", "symbol", F.col("date").cast("string")), F.round("move", 6)),
        row(date_gaps(panel), "date_gap", F.lit("warn"), F.col("date"), F.col("days")),
        row(stale_runs(panel), "stale", F.lit("warn"), F.concat_ws("@", "symbol", F.col("start").cast("string")), F.col("length")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def business_schedule(spark_dates: DataFrame, every: int = 21, anchor: str = "2000-01-03") -> DataFrame:
    """(scheduled): every n-th weekday from the anchor, over the span of the sessions (and n weekdays before it)."""
    span = spark_dates.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = span.select(F.explode(F.expr(f"sequence(least(lo, DATE'{anchor}'), greatest(hi, DATE'{anchor}'))")).alias("d"), "lo", "hi").where(F.weekday("d") < 5)
    # Weekdays since the anchor, counted without a window: whole weeks and the rest.
    anchor_day = F.to_date(F.lit(anchor))
    monday = lambda d: F.date_sub(d, F.weekday(d))
    n = (F.datediff(monday(F.col("d")), monday(anchor_day)) / 7 * 5).cast("int") + F.weekday("d") - F.weekday(anchor_day)
    return days.where((F.pmod(n, F.lit(every)) == 0) & F.col("d").between(F.col("lo"), F.col("hi"))).select(F.col("d").alias("scheduled"))


def next_sessions(scheduled: DataFrame, sessions: DataFrame, least: str | None = None) -> DataFrame:
    """(date): the first session on or after each scheduled date, once each, none before `least`."""
    line = scheduled.select(F.col("scheduled").alias("date"), F.lit(True).alias("wanted"), F.lit(None).cast("date").alias("s")).union(sessions.select("date", F.lit(False), F.col("date")))
    upcoming = line.withColumn("session", F.min("s").over(Window.orderBy("date").rangeBetween(0, Window.unboundedFollowing)))  # one row for each date
    found = upcoming.where("wanted AND session IS NOT NULL").select(F.col("session").alias("date")).distinct()
    return found.where(F.col("date") >= F.lit(least).cast("date")) if least else found


def with_delistings(returns: DataFrame, delistings: DataFrame) -> DataFrame:
    """`returns` with delisting_return; raises if an event has no session."""
    lost = delistings.join(returns, ["symbol", "date"], "left_anti").count()
    if lost:
        raise ValueError(f"{lost} delistings fall on no session")
    return returns.join(delistings, ["symbol", "date"], "left")


def forward_filled(column: str) -> Column:
    """The last value that was there."""
    return F.last(column, ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))


def scaled_benchmark(account: DataFrame, bench: DataFrame) -> DataFrame:
    """(date, equity, bench): the benchmark's last close on each account date, scaled to the first equity."""
    b = bench.select("date", F.col("close").alias("b"))
    line = account.select("date", "equity").join(b, "date", "full_outer")
    over = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one account: a row for each date
    filled = line.withColumn("b", F.last("b", ignorenulls=True).over(over)).where("equity IS NOT NULL")
    first = filled.where("b IS NOT NULL").agg(F.min_by("equity", "date").alias("e0"), F.min_by("b", "date").alias("b0"))
    return filled.join(F.broadcast(first)).select("date", "equity", (F.col("b") / F.col("b0") * F.col("e0")).alias("bench"))
