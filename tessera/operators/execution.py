"""Order, fill and position analytics, and corporate actions."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"


def new_york_date(ts: Column | str) -> Column:
    return F.to_date(F.from_utc_timestamp(F.col(ts) if isinstance(ts, str) else ts, NEW_YORK))


def intent_id(*parts: str) -> Column:
    """A deterministic id of 24 hex digits."""
    return F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 24)


def rebalance_orders(positions: DataFrame, targets: DataFrame, prices: DataFrame, value: Column, offset: float = 0.001, keys: tuple[str, ...] = ("account",)) -> DataFrame:
    """(keys, symbol, side, quantity, limit_price, place): whole shares from held to target, sells first within each account; names without a price are left out."""
    both = positions.select(*keys, "symbol", "held").join(targets.select(*keys, "symbol", "weight"), [*keys, "symbol"], "full_outer").fillna(0, ["held", "weight"])
    rows = both.join(prices.select("symbol", "price"), "symbol").where("price > 0")
    n = (F.floor(F.col("weight") * value / F.col("price")) - F.col("held")).cast("long")
    rows = rows.withColumn("n", n).where("n <> 0").withColumn("side", F.when(F.col("n") > 0, "buy").otherwise("sell"))
    limit = F.col("price") * F.when(F.col("n") > 0, 1 + offset).otherwise(1 - offset)
    order = Window.partitionBy(*keys).orderBy(F.desc("side"), "symbol")
    return rows.select(*keys, "symbol", "side", F.abs("n").alias("quantity"), limit.alias("limit_price")).withColumn("place", F.row_number().over(order))


def order_checks(orders: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """`orders` with the first rule each fails, or null.

    Columns: symbol, ts, side, quantity, price, held, portfolio, adv, and filled (value filled that day before it). Rules on concentration never block what reduces a position.
    """
    value = F.col("quantity") * F.col("price")
    reducing = (F.col("side") == "sell") & (F.col("held") > 0)
    after = (F.col("held") + F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))) * F.col("price")
    rules = [
        ("bad_number", F.col("quantity").isNull() | F.col("price").isNull() | (F.col("quantity") <= 0)),
        ("price", F.col("price") <= 0),
        ("portfolio", ~reducing & F.coalesce(F.col("portfolio") <= 0, F.lit(True))),
        ("min_price", F.col("price") < limits["min_price"]),
        ("order_value", value > limits["order_value"]),
        ("order_shares", F.col("quantity") > limits["order_shares"]),
        ("daily_value", F.coalesce("filled", F.lit(0.0)) + value > limits["daily_value"]),
        ("concentration", ~reducing & (F.try_divide(after, F.col("portfolio")) > limits["concentration"])),
        ("adv_invalid", F.col("adv").isNotNull() & (F.col("adv") <= 0)),
        ("adv_share", F.try_divide(F.col("quantity"), F.col("adv")) > limits["adv_share"]),
    ]
    return orders.withColumn("reason", F.coalesce(*[F.when(test, name) for name, test in rules]))


def filled_before(fills: DataFrame) -> DataFrame:
    """Value filled earlier on the same day."""
    day = Window.partitionBy("day").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    return fills.withColumn("filled", F.coalesce(F.sum(F.col("quantity") * F.col("price")).over(day), F.lit(0.0)))


def drift(targets: DataFrame, positions: DataFrame, value: Column, alert: float = 0.05, warn: float = 0.02, keys: tuple[str, ...] = ("account",)) -> DataFrame:
    """(keys, symbol, target, actual, drift, level), the largest drift of each account first by `place`."""
    both = targets.select(*keys, "symbol", F.col("weight").alias("target")).join(positions.select(*keys, "symbol", (F.col("held") * F.col("price") / value).alias("actual")), [*keys, "symbol"], "full_outer").fillna(0.0, ["target", "actual"])
    gap = both.withColumn("drift", F.col("actual") - F.col("target"))
    level = F.when(F.abs("drift") >= alert, "alert").when(F.abs("drift") >= warn, "warn").otherwise("ok")
    return gap.withColumn("level", level).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.abs("drift")), "symbol")))


def drift_summary(gaps: DataFrame) -> DataFrame:
    return gaps.agg(F.sum(F.abs("drift")).alias("total"), F.max_by("symbol", F.struct(F.abs("drift"), F.col("symbol"))).alias("worst"), F.max(F.abs("drift")).alias("largest"))


def twap(orders: DataFrame, slices: int = 5, seconds: int = 1800, share: float = 0.01) -> DataFrame:
    """Child rows (id, slice, quantity, offset) of orders above a share of ADV; others keep one row. The remainder goes to the first slices."""
    n = F.when(F.try_divide("quantity", "adv") > share, F.least(F.lit(slices), F.col("quantity"))).otherwise(1).cast("int")
    rows = orders.withColumn("n", n).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    each = F.floor(F.col("quantity") / F.col("n")) + F.when(F.col("slice") < F.col("quantity") % F.col("n"), 1).otherwise(0)
    offset = F.when(F.col("n") > 1, F.col("slice") * seconds / F.nullif(F.col("n") - 1, F.lit(0))).otherwise(0.0)
    return rows.select("id", "slice", each.cast("long").alias("slice_quantity"), offset.alias("offset"))


def slippage(fills: DataFrame) -> DataFrame:
    """Cost in hundredths of a percent against the signal price; positive is worse."""
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    return fills.withColumn("slippage", F.try_divide(F.col("fill_price") - F.col("signal_price"), F.col("signal_price")) * 10_000 * sign)


def completion(orders: DataFrame) -> DataFrame:
    """(rebalance, complete, blocked): all filled, and buys that stand behind a sell that was not filled in full."""
    so_far = Window.partitionBy("rebalance").orderBy("place", "side", "quantity").rowsBetween(Window.unboundedPreceding, -1)
    short = F.when((F.col("side") == "sell") & (F.col("filled") < F.col("quantity")), 1).otherwise(0)
    flagged = orders.withColumn("__b", (F.col("side") == "buy") & (F.max(short).over(so_far) == 1))
    return flagged.groupBy("rebalance").agg(F.bool_and(F.col("filled") >= F.col("quantity")).alias("complete"), F.count_if(F.coalesce("__b", F.lit(False))).alias("blocked"))


def position_profit(positions: DataFrame) -> DataFrame:
    worth, cost = F.col("held") * F.col("price"), F.col("held") * F.col("entry")
    return positions.select("symbol", worth.alias("value"), (worth - cost).alias("profit"), (F.try_divide(worth - cost, cost) * 100).alias("percent"))


def fills_by_day(orders: DataFrame) -> DataFrame:
    """(day, n, filled): orders with any fill, whatever their status, by New York day."""
    some = orders.where("filled > 0").withColumn("day", new_york_date("filled_at"))
    return some.groupBy("day").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum("filled").alias("filled"))


def assign_rebalances(events: DataFrame) -> DataFrame:
    """Each fill with the id of the last rebalance start before it, in event order."""
    start = F.when(F.col("event") == "rebalance_start", F.col("id"))
    return events.withColumn("rebalance", F.last(start, ignorenulls=True).over(Window.partitionBy("account").orderBy("ts", "id"))).where("event = 'fill'")


def daily_totals(fills: DataFrame) -> DataFrame:
    """(day, orders, value): cumulative notionals per order count only by their increase."""
    path = Window.partitionBy("day", "order_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    seen = fills.withColumn("day", new_york_date("ts")).withColumn("top", F.max("notional").over(path))
    step = F.col("top") - F.coalesce(F.lag("top").over(Window.partitionBy("day", "order_id").orderBy("ts")), F.lit(0.0))
    return seen.withColumn("step", step).groupBy("day").agg(F.count_distinct("order_id").alias("orders"), F.sum("step").alias("value"))


#: States of an order that may still be open. Fixed values.
UNCERTAIN = ("unknown", "submitted", "partial_fill_open")


def cooled_down(attempts: DataFrame, seconds: int = 300) -> DataFrame:
    """Attempts (symbol, ts, status, id) with `allowed`: not less than `seconds` after the symbol's last allowed attempt, if the order of that one may still be open.

    An attempt that comes `seconds` or more after the one before it is always allowed, so a symbol falls into chains that do not
    depend on each other; a chain is read in order from sorted partitions, of which nothing but the last allowed attempt is held.
    Ties go by id. Rows without symbol or time are left out.
    """
    order = Window.partitionBy("symbol").orderBy("ts", "id")
    rows = attempts.where("symbol IS NOT NULL AND ts IS NOT NULL").withColumn("__us", F.unix_micros(F.col("ts").cast("timestamp")))
    before = F.lag("__us").over(order)
    rows = rows.withColumn("__starts", before.isNull() | (F.col("__us") - before >= seconds * 1_000_000))
    rows = rows.withColumns({"__chain": F.count_if("__starts").over(order), "__open": F.coalesce(F.col("status").isin(*UNCERTAIN), F.lit(False))})
    limit = seconds * 1_000_000

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, is_open = 0, False
        for batch in batches:
            allowed = []
            for us, starts, uncertain in zip(*(batch.column(c).to_pylist() for c in ("__us", "__starts", "__open")), strict=True):
                passes = starts or not is_open or us - last >= limit
                if passes:
                    last, is_open = us, uncertain
                allowed.append(passes)
            yield batch.select(names).append_column("allowed", pa.array(allowed, pa.bool_()))

    names = attempts.columns
    dealt = rows.repartition("symbol", "__chain").sortWithinPartitions("symbol", "__chain", "__us", "id")
    return dealt.select(*names, "__us", "__starts", "__open").mapInArrow(read, attempts.schema.add("allowed", "boolean"))


def looks_presplit(entry: Column, current: Column, ratio: Column) -> Column:
    return F.coalesce(F.try_divide(entry, current) > ratio / 3, F.lit(False))


def unresolved_splits(positions: DataFrame, splits: DataFrame) -> DataFrame:
    """Positions entered before a split that still carry the old count; unusable numbers count as unresolved."""
    both = positions.join(splits, "symbol").where(F.col("entry_date") < F.col("effective"))
    bad = ~F.coalesce((F.col("entry") > 0) & (F.col("price") > 0), F.lit(False))
    return both.where(bad | looks_presplit(F.col("entry"), F.col("price"), F.col("ratio")))


def split_corrected(positions: DataFrame, splits: DataFrame) -> DataFrame:
    """Held counts and entries after splits: count times ratio, entry over ratio."""
    both = positions.join(splits, "symbol", "left")
    hit = F.coalesce(looks_presplit(F.col("entry"), F.col("price"), F.col("ratio")) & (F.col("entry_date") < F.col("effective")), F.lit(False))
    return both.select(*[c for c in positions.columns if c not in ("held", "entry")], F.when(hit, F.col("held") * F.col("ratio")).otherwise(F.col("held")).alias("held"), F.when(hit, F.col("entry") / F.col("ratio")).otherwise(F.col("entry")).alias("entry"), hit.alias("corrected"))


def sold_credit(orders: DataFrame, ratio: Column) -> DataFrame:
    """`orders` with `credit`: what sales of more than was bought after the split should have brought, (ratio - 1) * uncovered * price.

    Sales first use up later purchases: uncovered to date is the depth of the running balance below 0.
    """
    path = Window.partitionBy("symbol").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy("symbol").orderBy("ts", "id")
    move = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    df = orders.withColumn("balance", F.sum(move).over(path)).withColumn("deep", -F.least(F.lit(0.0), F.min("balance").over(path)))
    new = F.col("deep") - F.coalesce(F.lag("deep").over(order), F.lit(0.0))
    return df.withColumn("uncovered", new).withColumn("credit", (ratio - 1) * F.col("uncovered") * F.col("price")).drop("deep")


def equity_correction(history: DataFrame, held: DataFrame, credits: DataFrame, ratio: Column, paid: DataFrame | None = None) -> DataFrame:
    """(date, correction): (ratio - 1) * remaining * price on each date, and credits to date less what was paid (date, amount) to date."""
    line = history.select("date", F.lit(0.0).alias("c")).union(credits.select("date", "c"))
    line = line if paid is None else line.union(paid.select("date", -F.col("amount")))
    paid = line.groupBy("date").agg(F.sum("c").alias("c")).withColumn("total", F.sum("c").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))  # a row for each date
    return history.select("date").join(held, "date", "left").join(paid.select("date", "total"), "date").select("date", (F.coalesce((ratio - 1) * F.col("remaining") * F.col("price"), F.lit(0.0)) + F.greatest(F.lit(0.0), F.col("total"))).alias("correction"))


def current_weights(positions: DataFrame, prices: DataFrame, equity: Column) -> DataFrame:
    """(symbol, weight): what each held name is worth of the account's equity; raises if a count or a price is unusable, instead of taking it as 0."""
    good = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = positions.select("symbol", F.col("held").cast("double").alias("held")).join(prices.select("symbol", F.col("price").cast("double").alias("price")), "symbol", "left").withColumn("equity", equity.cast("double"))
    bad = rows.agg(F.count_if(~F.coalesce(good(F.col("held")) & (F.col("held") >= 0), F.lit(False))).alias("held"), F.count_if(~F.coalesce(good(F.col("price")) & (F.col("price") > 0), F.lit(False))).alias("price"), F.count_if(~F.coalesce(good(F.col("equity")) & (F.col("equity") > 0), F.lit(False))).alias("equity")).first()
    if any(bad):
        raise ValueError(f"current weights: {bad['held']} bad counts, {bad['price']} bad prices, {bad['equity']} rows without equity")
    return rows.select("symbol", (F.col("held") * F.col("price") / F.col("equity")).alias("weight"))


def account_equity(cash: Column, positions: DataFrame, splits: DataFrame, orders: DataFrame, ratio: Column, compensation: Column | None = None) -> DataFrame:
    """(equity, value, credit): cash, the value of the positions with their counts put right after splits, and what sales before the correction should have brought, less what was paid for it."""
    fixed = split_corrected(positions, splits).agg(F.coalesce(F.sum(F.col("held") * F.col("price")), F.lit(0.0)).alias("value"))
    owed = sold_credit(orders, ratio).agg(F.coalesce(F.sum("credit"), F.lit(0.0)).alias("credit"))
    left = F.greatest(F.lit(0.0), F.col("credit") - (compensation if compensation is not None else F.lit(0.0)))
    return fixed.join(owed).select((cash + left + F.col("value")).alias("equity"), "value", left.alias("credit"))


def with_equity(rebalances: DataFrame, history: DataFrame, current: Column) -> DataFrame:
    """`rebalances` with `equity`: that of their date in the account's history, else the current one."""
    known = history.where("equity IS NOT NULL").select("date", "equity")
    return rebalances.join(known, "date", "left").withColumn("equity", F.coalesce("equity", current))
