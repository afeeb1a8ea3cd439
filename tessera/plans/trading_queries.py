"""Queries on orders, fills, positions, corporate actions and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import execution as ex
from ..sources import panel as src
from ..streaming import rules
from .common import Query, rounded

LIMITS = {"min_price": 950.0, "order_value": 90_000.0, "order_shares": 45, "daily_value": 300_000.0, "concentration": 0.1, "adv_share": 0.02}


def _fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = src.read(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return items.select("id", F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").alias("ts"), F.to_date("l_shipdate").alias("day"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.col("l_quantity").alias("quantity"), F.round(F.col("l_extendedprice") / F.col("l_quantity") + 1e-9, 4).alias("price"), "l_discount", "l_tax")


def _account():
    """Ten accounts, by the last digit of a name."""
    return F.col("symbol").cast("long") % 10


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fills(spark, sf_dir).where("side = 'buy'").groupBy("symbol").agg(F.sum("quantity").alias("held"), F.round(F.sum(F.col("quantity") * F.col("price")) / F.sum("quantity"), 2).alias("entry"), F.max_by("price", F.struct("ts", "id")).alias("price"), F.min("day").alias("entry_date")).withColumn("account", _account())


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = _fills(spark, sf_dir).where("side = 'sell'").groupBy("symbol").agg(F.sum("quantity").alias("q"))
    total = pos.agg(F.sum("q").alias("t"))
    return pos.join(F.broadcast(total)).select("symbol", F.round(F.col("q") / F.col("t"), 8).alias("weight"), _account().alias("account"))


def orders_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = _positions(spark, sf_dir)
    return rounded(ex.rebalance_orders(pos, _targets(spark, sf_dir), pos, F.lit(50_000_000.0)), "limit_price", digits=3)


def orders_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = ex.filled_before(_fills(spark, sf_dir))
    held = _positions(spark, sf_dir).select("symbol", "held")
    adv = _fills(spark, sf_dir).groupBy("symbol").agg(F.sum("quantity").alias("adv"))
    rows = fills.join(held, "symbol", "left").join(adv, "symbol").fillna(0.0, ["held"]).withColumn("portfolio", F.lit(20_000_000.0))
    return ex.order_checks(rows, LIMITS).select("id", "reason")


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ex.drift(_targets(spark, sf_dir), _positions(spark, sf_dir), F.lit(2_000_000_000.0), 0.002, 0.001), "actual", "drift", digits=6)


def positions_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir).select("account", "symbol", "target", "actual", "drift", "level", "place")


def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ex.drift_summary(_drift(spark, sf_dir)), "total", "largest", digits=6)


def orders_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.twap(_fills(spark, sf_dir).select("id", F.col("quantity").cast("long").alias("quantity"), F.lit(2000.0).alias("adv")))


def fill_slippage(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = _fills(spark, sf_dir).withColumns({"signal_price": F.col("price"), "fill_price": F.col("price") * (1 + F.col("l_tax") - F.col("l_discount"))})
    return rounded(ex.slippage(fills).select("id", "slippage"), "slippage", digits=4)


def rebalance_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = _fills(spark, sf_dir).select(F.floor(F.col("id") / 10).alias("rebalance"), F.col("id").alias("place"), "side", "quantity", F.when(F.col("quantity") > 40, F.col("quantity") - 1).otherwise(F.col("quantity")).alias("filled"))
    return ex.completion(fills)


def position_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After counts and entries are put right for splits."""
    fixed = ex.split_corrected(_positions(spark, sf_dir), _splits(spark, sf_dir))
    return rounded(ex.position_profit(fixed), "value", "profit", "percent", digits=3)


def fills_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fills(spark, sf_dir).select("id", "symbol", "side", F.when(F.col("quantity") > 5, F.col("quantity")).otherwise(0.0).alias("filled"), F.col("ts").alias("filled_at"))
    return ex.fills_by_day(rows)


def fills_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = src.read(spark, sf_dir, "events").select(F.col("user_id").alias("account"), "ts", F.col("event_id").alias("id"), F.when(F.col("event_id") % 7 == 0, "rebalance_start").otherwise("fill").alias("event"))
    return ex.assign_rebalances(events).select("id", "rebalance")


def _notionals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.read(spark, sf_dir, "events").select("ts", F.col("user_id").alias("order_id"), F.round("value", 2).alias("notional"))


def trading_day_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ex.daily_totals(_notionals(spark, sf_dir)), "value", digits=2)


#: Events as attempts at stop orders: the state that an order was left in.
STATUS = {"error": "unknown", "purchase": "submitted", "click": "partial_fill_open", "view": "filled", "signup": "rejected"}


def _attempts(events: DataFrame) -> DataFrame:
    status = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in STATUS.items()])
    return events.select(F.col("event_id").alias("id"), F.col("user_id").alias("symbol"), "ts", status.alias("status"))


def retry_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.cooled_down(_attempts(src.read(spark, sf_dir, "events")), 3600).select("id", "allowed")


def account_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equity, and profit against the day before (none on the first), by New York day of an epoch."""
    epochs = src.read(spark, sf_dir, "events").select(F.unix_timestamp("ts").alias("epoch"), "value")
    days = epochs.groupBy(ex.new_york_date(F.timestamp_seconds("epoch")).alias("day")).agg(F.sum("value").alias("equity"))
    days = days.withColumn("profit", F.col("equity") - F.lag("equity").over(Window.orderBy("day")))  # a row for each day
    return rounded(days, "equity", "profit", digits=2)


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.read(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").cast("string").alias("symbol"), F.lit(2.9).alias("ratio"), F.lit("1997-01-01").cast("date").alias("effective"))


def splits_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.unresolved_splits(_positions(spark, sf_dir), _splits(spark, sf_dir)).select("symbol", "entry", "price")


def splits_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ex.split_corrected(_positions(spark, sf_dir), _splits(spark, sf_dir)).select("symbol", "held", "entry", "corrected"), "held", "entry", digits=3)


def split_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ex.sold_credit(_fills(spark, sf_dir).where("ts >= TIMESTAMP'1997-01-01'"), F.lit(3.0))
    return rounded(rows.groupBy("symbol").agg(F.sum("uncovered").alias("uncovered"), F.sum("credit").alias("credit"), F.count(F.lit(1)).alias("n")), "credit", digits=2)


def split_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections by day with the credits of every symbol, less what was paid on some days."""
    fills = _fills(spark, sf_dir)
    days = fills.groupBy(F.col("day").alias("date")).agg(F.sum("quantity").alias("remaining"), F.max("price").alias("price"))
    credits = fills.select(F.col("day").alias("date"), (F.col("price") - 1400).alias("c"))
    paid = fills.where("quantity = 50").select(F.col("day").alias("date"), (F.col("price") / 10).alias("amount"))
    return rounded(ex.equity_correction(days, days, credits, F.lit(2.0), paid), "correction", digits=2)


def order_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fills(spark, sf_dir).select("id", ex.intent_id("id", "symbol", "side").alias("intent"))


def _stream(spark: SparkSession, sf_dir: str, build, keys: tuple[str, ...] = (), mode: str = "update") -> DataFrame:
    """Runs a streaming form over the events files to the end (all that is there now) and returns what it wrote: of each key its last update, or all rows."""
    run = f"{src.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = src.read(spark, sf_dir, "events").schema
    out = build(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"))
    spark.createDataFrame([], out.schema).write.parquet(f"{run}/out/batch=-1")  # so that there is a table without any batch
    save = lambda df, k: df.write.mode("overwrite").parquet(f"{run}/out/batch={k}")
    out.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(out.schema.add("batch", "long")).parquet(f"{run}/out")
    if not keys:
        return rows.drop("batch")
    rest = [c for c in out.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")


def stream_day_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_stream(spark, sf_dir, lambda s: rules.daily_totals(s.select("ts", "value")), ("day",)), "value", digits=2)


def stream_loss_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily loss rule over events as profits and losses around 50."""
    df = _stream(spark, sf_dir, lambda s: rules.loss_flags(s.select("ts", (F.round(F.col("value"), 2) - 50).alias("value")), 100.0), ("day",))
    return rounded(df.select("day", "n", "value", "stopped"), "value", digits=2)


def stream_order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _stream(spark, sf_dir, lambda s: rules.highest_notional(s.select("ts", F.col("user_id").alias("order_id"), "value")), ("day", "order_id"))
    return rounded(df, "value")


def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, lambda s: rules.bars(s.select("ts", F.col("user_id").alias("symbol"), F.col("value").alias("price"))), ("symbol", "start"))


def stream_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts that pass a cooldown of an hour for their symbol, from keyed state."""
    return _stream(spark, sf_dir, lambda s: rules.first_attempts(_attempts(s), 3600, late="60 days"), mode="append")


def stream_order_increases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day totals from what each event adds to its order, from keyed state."""
    notionals = lambda s: s.select("ts", F.col("user_id").alias("order_id"), F.round("value", 2).alias("notional"))
    added = _stream(spark, sf_dir, lambda s: rules.order_increases(notionals(s), late="60 days"), mode="append")
    return rounded(added.groupBy("day").agg(F.count_distinct("order_id").alias("orders"), F.sum("increase").alias("value")), "value", digits=2)


def weights_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = _positions(spark, sf_dir)
    return rounded(ex.current_weights(pos, pos, F.lit(2_000_000_000.0)), "weight")


def account_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = _fills(spark, sf_dir).where("ts >= TIMESTAMP'1997-01-01'")
    return rounded(ex.account_equity(F.lit(1_000_000.0), _positions(spark, sf_dir), _splits(spark, sf_dir), late, F.lit(3.0), F.lit(5_000.0)), "equity", "value", "credit", digits=0)


def rebalance_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The account's equity at each month of orders: of days with shipments from the history, of the others the current one."""
    dates = src.read(spark, sf_dir, "orders").select(F.date_trunc("month", "o_orderdate").cast("date").alias("date")).distinct()
    history = _fills(spark, sf_dir).where("quantity > 45").groupBy(F.col("day").alias("date")).agg(F.sum(F.col("quantity") * F.col("price")).alias("equity"))
    return rounded(ex.with_equity(dates, history, F.lit(123.0)), "equity", digits=2)


QUERIES: dict[str, Query] = {f.__name__: f for f in (orders_rebalance, orders_checked, positions_drift, drift_summary, orders_sliced, fill_slippage, rebalance_completion, position_profit, fills_by_day, fills_assigned, trading_day_totals, retry_cooldown, account_history, splits_unresolved, splits_corrected, split_credits, split_equity, order_intents, stream_day_totals, stream_loss_flags, stream_order_totals, stream_bars, stream_cooldown, stream_order_increases, weights_current, account_equity, rebalance_equity)}

_FILLS = "WITH fills AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey::VARCHAR AS symbol, l_shipdate AS ts, l_shipdate::DATE AS day, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_quantity AS quantity, round(l_extendedprice / l_quantity + 1e-9, 4) AS price, l_discount, l_tax FROM lineitem)"
_POS = f"{_FILLS}, pos AS (SELECT symbol, sum(quantity) AS held, round(sum(quantity * price) / sum(quantity), 2) AS entry, max_by(price, (ts, id)) AS price, min(day) AS entry_date FROM fills WHERE side = 'buy' GROUP BY 1), tg AS (SELECT symbol, round(sum(quantity) / sum(sum(quantity)) OVER (), 8) AS weight FROM fills WHERE side = 'sell' GROUP BY 1)"
_DRIFT = f"{_POS}, dr AS (SELECT symbol, coalesce(weight, 0) AS target, coalesce(held * price / 2e9, 0) AS actual, coalesce(held * price / 2e9, 0) - coalesce(weight, 0) AS drift FROM tg FULL JOIN pos USING (symbol)), d6 AS (SELECT symbol::BIGINT % 10 AS account, row_number() OVER (PARTITION BY symbol::BIGINT % 10 ORDER BY abs(drift) DESC, symbol)::INT AS place, symbol, target, round(actual, 6) AS actual, round(drift, 6) AS drift, CASE WHEN abs(drift) >= 0.002 THEN 'alert' WHEN abs(drift) >= 0.001 THEN 'warn' ELSE 'ok' END AS level FROM dr)"
_NY = "timezone('America/New_York', timezone('UTC', {}))::DATE"
_DAY_TOTALS = f"SELECT day, count(*) AS orders, round(sum(greatest(v, 0)), 2) AS value FROM (SELECT {_NY.format('ts')} AS day, user_id, max(round(value, 2)) AS v FROM events GROUP BY 1, 2) GROUP BY 1"
_STATES = " ".join(f"WHEN event_type = '{k}' THEN {v in ex.UNCERTAIN}" for k, v in STATUS.items())
_COOL = f"WITH RECURSIVE ca AS (SELECT event_id AS id, user_id, ts, epoch_us(ts) AS us, CASE {_STATES} ELSE false END AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), cf AS (SELECT id, user_id, ts, k, us AS last, u AS held, true AS allowed FROM ca WHERE k = 1 UNION ALL SELECT id, user_id, ts, k, CASE WHEN ok THEN us ELSE last END, CASE WHEN ok THEN u ELSE held END, ok FROM (SELECT ca.*, last, held, NOT held OR us - last >= 3600000000 AS ok FROM cf JOIN ca ON ca.user_id = cf.user_id AND ca.k = cf.k + 1))"
ORACLE_SQL = {
    "orders_rebalance": f"{_POS}, o AS (SELECT symbol, (floor(coalesce(weight, 0) * 5e7 / price) - held)::BIGINT AS n, price FROM pos LEFT JOIN tg USING (symbol) WHERE price > 0) SELECT symbol::BIGINT % 10 AS account, symbol, CASE WHEN n > 0 THEN 'buy' ELSE 'sell' END AS side, abs(n) AS quantity, round(price * CASE WHEN n > 0 THEN 1.001 ELSE 0.999 END, 3) AS limit_price, row_number() OVER (PARTITION BY symbol::BIGINT % 10 ORDER BY n > 0, symbol)::INT AS place FROM o WHERE n <> 0",
    "orders_checked": f"{_POS}, adv AS (SELECT symbol, sum(quantity) AS adv FROM fills GROUP BY 1), f AS (SELECT fills.*, coalesce(held, 0) AS held, adv, coalesce(sum(quantity * fills.price) OVER (PARTITION BY day ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled FROM fills LEFT JOIN pos USING (symbol) JOIN adv USING (symbol)) SELECT id, CASE WHEN quantity <= 0 THEN 'bad_number' WHEN price <= 0 THEN 'price' WHEN price < 950 THEN 'min_price' WHEN quantity * price > 90000 THEN 'order_value' WHEN quantity > 45 THEN 'order_shares' WHEN filled + quantity * price > 300000 THEN 'daily_value' WHEN NOT (side = 'sell' AND held > 0) AND (held + CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) * price / 2e7 > 0.1 THEN 'concentration' WHEN adv <= 0 THEN 'adv_invalid' WHEN quantity / adv > 0.02 THEN 'adv_share' END AS reason FROM f",
    "positions_drift": f"{_DRIFT} SELECT * FROM d6",
    "drift_summary": f"{_DRIFT} SELECT round(sum(abs(drift)), 6) AS total, max_by(symbol, (abs(drift), symbol)) AS worst, round(max(abs(drift)), 6) AS largest FROM d6",
    "orders_sliced": f"{_FILLS}, n AS (SELECT id, quantity::BIGINT AS q, CASE WHEN quantity / 2000 > 0.01 THEN least(5, quantity)::INT ELSE 1 END AS n FROM fills) SELECT id, slice::INT AS slice, q // n + (slice < q % n)::INT AS slice_quantity, CASE WHEN n > 1 THEN slice * 1800.0::DOUBLE / (n - 1) ELSE 0 END::DOUBLE AS \"offset\" FROM (SELECT *, unnest(range(0, n)) AS slice FROM n)",
    "fill_slippage": f"{_FILLS} SELECT id, round((price * (1 + l_tax - l_discount) - price) / price * 10000 * CASE WHEN side = 'buy' THEN 1 ELSE -1 END, 4) AS slippage FROM fills",
    "rebalance_completion": f"{_FILLS}, o AS (SELECT id // 10 AS rebalance, id AS place, side, quantity, CASE WHEN quantity > 40 THEN quantity - 1 ELSE quantity END AS filled FROM fills), b AS (SELECT *, side = 'buy' AND coalesce(max((side = 'sell' AND filled < quantity)::INT) OVER (PARTITION BY rebalance ORDER BY place, side, quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS b FROM o) SELECT rebalance, bool_and(filled >= quantity) AS complete, count(*) FILTER (WHERE b) AS blocked FROM b GROUP BY 1",
    "position_profit": f"{_POS}, c AS (SELECT *, CASE WHEN coalesce(symbol::BIGINT % 5 = 0 AND entry_date < DATE '1997-01-01' AND entry / price > 2.9 / 3, false) THEN 2.9 ELSE 1 END AS r FROM pos), k AS (SELECT symbol, price, held * r AS held, entry / r AS entry FROM c) SELECT symbol, round(held * price, 3) AS value, round(held * price - held * entry, 3) AS profit, round((held * price - held * entry) / (held * entry) * 100, 3) AS percent FROM k",
    "fills_by_day": f"{_FILLS} SELECT {_NY.format('ts')} AS day, count(*)::INT AS n, sum(quantity) AS filled FROM fills WHERE quantity > 5 GROUP BY 1",
    "fills_assigned": "SELECT id, rebalance FROM (SELECT event_id AS id, event_id % 7 = 0 AS s, last_value(CASE WHEN event_id % 7 = 0 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rebalance FROM events) WHERE NOT s",
    "trading_day_totals": _DAY_TOTALS,
    "retry_cooldown": f"{_COOL} SELECT id, allowed FROM cf",
    "stream_cooldown": f"{_COOL} SELECT user_id AS symbol, ts::TIMESTAMP AS ts, id FROM cf WHERE allowed",
    "stream_order_increases": _DAY_TOTALS,
    "account_history": f"SELECT day, round(e, 2) AS equity, round(e - lag(e) OVER (ORDER BY day), 2) AS profit FROM (SELECT {_NY.format('ts')} AS day, sum(value) AS e FROM events GROUP BY 1)",
    "splits_unresolved": f"{_POS} SELECT symbol, entry, price FROM pos WHERE symbol::BIGINT % 5 = 0 AND entry_date < DATE '1997-01-01' AND (NOT coalesce(entry > 0 AND price > 0, false) OR entry / price > 2.9 / 3)",
    "splits_corrected": f"{_POS}, c AS (SELECT *, coalesce(symbol::BIGINT % 5 = 0 AND entry_date < DATE '1997-01-01' AND entry / price > 2.9 / 3, false) AS corrected FROM pos) SELECT symbol, round(CASE WHEN corrected THEN held * 2.9 ELSE held END, 3) AS held, round(CASE WHEN corrected THEN entry / 2.9 ELSE entry END, 3) AS entry, corrected FROM c",
    "split_credits": f"{_FILLS}, b AS (SELECT *, sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) OVER (PARTITION BY symbol ORDER BY ts, id) AS bal FROM fills WHERE ts >= TIMESTAMP '1997-01-01'), d AS (SELECT *, -least(0, min(bal) OVER (PARTITION BY symbol ORDER BY ts, id)) AS deep FROM b), u AS (SELECT *, deep - coalesce(lag(deep) OVER (PARTITION BY symbol ORDER BY ts, id), 0) AS un FROM d) SELECT symbol, sum(un) AS uncovered, round(sum(2 * un * price), 2) AS credit, count(*) AS n FROM u GROUP BY 1",
    "split_equity": f"{_FILLS}, h AS (SELECT day AS date, sum(quantity) AS remaining, max(price) AS price FROM fills GROUP BY 1), c AS (SELECT day AS date, sum(price - 1400 - CASE WHEN quantity = 50 THEN price / 10 ELSE 0 END) AS c FROM fills GROUP BY 1) SELECT date, round(remaining * price + greatest(0, sum(coalesce(c, 0)) OVER (ORDER BY date)), 2) AS correction FROM h LEFT JOIN c USING (date)",
    "order_intents": f"""{_FILLS} SELECT id, substr(sha256('{{"id":' || id || ',"symbol":"' || symbol || '","side":"' || side || '"}}'), 1, 24) AS intent FROM fills""",
    "stream_day_totals": f"SELECT {_NY.format('ts')} AS day, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1",
    "stream_loss_flags": f"SELECT day, count(*) AS n, round(sum(v), 2) AS value, sum(v) < -100 AS stopped FROM (SELECT {_NY.format('ts')} AS day, round(value, 2) - 50 AS v FROM events) GROUP BY 1",
    "stream_order_totals": f"SELECT {_NY.format('ts')} AS day, user_id AS order_id, round(max(value), 6) AS value FROM events GROUP BY 1, 2",
    "stream_bars": "SELECT user_id AS symbol, date_trunc('day', ts) AS start, arg_min(value, (ts, value)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, value)) AS close, count(*) AS volume FROM events GROUP BY 1, 2",
    "weights_current": f"{_POS} SELECT symbol, round(held * price / 2e9, 6) AS weight FROM pos",
    "account_equity": f"{_POS}, v AS (SELECT sum(CASE WHEN coalesce(symbol::BIGINT % 5 = 0 AND entry_date < DATE '1997-01-01' AND entry / price > 2.9 / 3, false) THEN held * 2.9 ELSE held END * price) AS value FROM pos), b AS (SELECT *, sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) OVER (PARTITION BY symbol ORDER BY ts, id) AS bal FROM fills WHERE ts >= TIMESTAMP '1997-01-01'), d AS (SELECT *, -least(0, min(bal) OVER (PARTITION BY symbol ORDER BY ts, id)) AS deep FROM b), u AS (SELECT *, deep - coalesce(lag(deep) OVER (PARTITION BY symbol ORDER BY ts, id), 0) AS un FROM d), k AS (SELECT greatest(0, sum(2 * un * price) - 5000) AS credit FROM u) SELECT round(1e6 + credit + value, 0) AS equity, round(value, 0) AS value, round(credit, 0) AS credit FROM v, k",
    "rebalance_equity": f"{_FILLS}, m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS date FROM orders), h AS (SELECT day AS date, sum(quantity * price) AS equity FROM fills WHERE quantity > 45 GROUP BY 1) SELECT date, round(coalesce(equity, 123.0), 2) AS equity FROM m LEFT JOIN h USING (date)",
}
