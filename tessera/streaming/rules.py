"""Daily rules over streams of fills and prices; the batch forms are in operators.execution.

The aggregates are meant for update mode (a day's row is written again when it changes) or append mode (once, when
the watermark has passed the day). Both drop rows that come later than `late`, and the state of past days with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.execution import UNCERTAIN

#: Trading days start at midnight in New York; a stream keyed by that date survives changes of the clock.
NEW_YORK = "America/New_York"


def _timed(rows: DataFrame, late: str) -> DataFrame:
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def _day(fills: DataFrame, late: str) -> DataFrame:
    """Rows with `local`, the New York time, which carries the watermark: its days are the windows, so a day is one row.

    Changes of the clock fall within a day, so they close none.
    """
    return fills.withColumn("local", F.from_utc_timestamp(F.col("ts").cast("timestamp"), NEW_YORK)).withWatermark("local", late)


def daily_totals(fills: DataFrame, late: str = "1 hour") -> DataFrame:
    """(day, n, value) for each New York day; later rows than the watermark are dropped."""
    return _day(fills, late).groupBy(F.window("local", "1 day").alias("w"), F.to_date("local").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select("day", "n", "value")


def highest_notional(fills: DataFrame, late: str = "1 hour") -> DataFrame:
    """(day, order_id, value): the largest cumulative notional of each order and day."""
    return _day(fills, late).groupBy(F.window("local", "1 day").alias("w"), F.to_date("local").alias("day"), "order_id").agg(F.max("value").alias("value")).select("day", "order_id", "value")


def loss_flags(profits: DataFrame, limit: float, late: str = "1 hour") -> DataFrame:
    """(day, value, stopped): days whose total is below -limit."""
    return daily_totals(profits, late).withColumn("stopped", F.col("value") < -limit)


def bars(ticks: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(symbol, start, open, high, low, close, volume) of tumbling windows."""
    w = _timed(ticks, late).groupBy(F.window("ts", width).alias("w"), "symbol")
    return w.agg(F.min_by("price", F.struct("ts", "price")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", F.struct("ts", "price")).alias("close"), F.count(F.lit(1)).alias("volume")).select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def first_attempts(attempts: DataFrame, seconds: int = 300, late: str = "1 hour") -> DataFrame:
    """(symbol, ts, id): attempts (symbol, ts, status, id) at stop orders that are allowed, as in operators.execution.cooled_down.

    The state of a symbol is its last allowed attempt and whether its order may still be open. Attempts older than that, which came late, are not allowed. Append mode only.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, is_open = state.get if state.exists else (None, False)
        passed = []
        for at, i, uncertain in sorted(x for b in batches for x in zip(b["us"].tolist(), b["id"].tolist(), b["open"].tolist(), strict=True)):
            if last is None or (at >= last and (not is_open or at - last >= seconds * 1_000_000)):
                passed.append((at, i))
                last, is_open = at, uncertain
        if passed:
            state.update((last, is_open))
        yield pd.DataFrame({"symbol": pd.Series([key[0]] * len(passed), dtype=object), "us": pd.Series([x for x, _ in passed], dtype="int64"), "id": pd.Series([i for _, i in passed], dtype="int64")})

    rows = _timed(attempts, late).where("symbol IS NOT NULL AND ts IS NOT NULL")
    uncertain = F.coalesce(F.col("status").isin(*UNCERTAIN), F.lit(False))
    kept = rows.select(F.col("symbol").cast("string").alias("symbol"), F.unix_micros("ts").alias("us"), F.col("id").cast("long").alias("id"), uncertain.alias("open"))
    out = kept.groupBy("symbol").applyInPandasWithState(run, "symbol string, us long, id long", "last long, open boolean", "append", GroupStateTimeout.NoTimeout)
    return out.select(F.col("symbol").cast(attempts.schema["symbol"].dataType).alias("symbol"), F.timestamp_micros("us").alias("ts"), "id")


def order_increases(fills: DataFrame, late: str = "1 hour", buckets: int = 256) -> DataFrame:
    """(day, order_id, increase): by how much each fill (ts, order_id, notional), whose notional is cumulative, raises its order's highest of the New York day.

    Repeated and smaller notionals raise nothing and come out only as the order's first row of a day, with 0. Orders fall into `buckets` by a hash, since calls of Python
    for each order cost more than its rows; the state of a bucket and day is the highest of each of its orders. It goes
    when the watermark has passed the day, after which rows of that day are dropped. Append mode only; the sum of a day is that of operators.execution.daily_totals.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tops = dict(zip(*state.get, strict=True)) if state.exists else {}
        before, end = {}, 0
        for b in batches:
            for order, notional in zip(b["order_id"].tolist(), b["notional"].tolist(), strict=True):
                before.setdefault(order, tops.get(order))
                if notional > tops.setdefault(order, 0.0):
                    tops[order] = notional
            end = max(end, int(b["day_end"].max()))
        state.update((list(tops), list(tops.values())))
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        out = [(order, tops[order] - (top or 0.0)) for order, top in before.items() if top is None or tops[order] > top]
        if out:
            yield pd.DataFrame({"day": [key[0]] * len(out), "order_id": pd.Series([o for o, _ in out], dtype=object), "increase": [x for _, x in out]})

    rows = _day(fills, late).where("order_id IS NOT NULL AND ts IS NOT NULL AND notional IS NOT NULL")
    kept = rows.select(F.to_date("local").alias("day"), F.pmod(F.xxhash64("order_id"), F.lit(buckets)).alias("bucket"), F.col("order_id").cast("string").alias("order_id"), F.col("notional").cast("double").alias("notional"), F.unix_millis(F.date_trunc("day", "local") + F.expr("INTERVAL 1 DAY")).alias("day_end"), "local")
    out = kept.groupBy("day", "bucket").applyInPandasWithState(run, "day date, order_id string, increase double", "orders array<string>, tops array<double>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("day", F.col("order_id").cast(fills.schema["order_id"].dataType).alias("order_id"), "increase")
