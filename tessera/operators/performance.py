"""Weight-space performance. Not a share-level simulator: no integer shares, pending orders or same-day blocking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import by_symbol


def execution_price() -> Column:
    """Open, else same-day close; never a stale one."""
    return F.coalesce("open", "close")


def periods(books: DataFrame, bars: DataFrame) -> DataFrame:
    """(date, period, n, until): every session with the date of the book that is held on it (null before the first), its number in that period, and the session on which the next book takes over.

    A book takes over at the session after its date; a book that is replaced before that is never held. One window over the calendar.
    """
    line = bars.select("date").distinct().withColumn("__s", F.lit(True)).join(books.select("date").distinct().withColumn("__book", F.col("date")), "date", "full_outer")
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)  # a row for each session
    held = line.withColumn("period", F.last("__book", ignorenulls=True).over(before)).where("__s").select("date", "period")
    of_period = held.groupBy("period").agg(F.min("date").alias("first"))
    until = of_period.withColumn("until", F.lead("first").over(Window.orderBy("first"))).select("period", "until")  # a row for each book
    numbered = held.withColumn("n", F.row_number().over(Window.partitionBy("period").orderBy("date")))
    return numbered.join(until, numbered["period"].eqNullSafe(until["period"])).select("date", numbered["period"], "n", "until")


def _priced(bars: DataFrame) -> DataFrame:
    """(symbol, date, __price, __exec, __open): the filled close, the execution price, and what a position is worth at the open."""
    filled = F.last("close", ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumns({"__price": filled, "__exec": execution_price()}).select("symbol", "date", "__price", "__exec", F.coalesce("__exec", "__price").alias("__open"))


def stopped_books(books: DataFrame, bars: DataFrame, loss: float = 0.15) -> DataFrame:
    """(date, symbol, weight, exit): the books as stops leave them.

    A position whose filled close is more than `loss` below the price at which its spell began is sold at the next execution price, the `exit`. A name whose stop
    is open when a book takes over, or was executed at the session before, is not bought back by that book: its weight is 0. An entry price lasts through all books that hold the name.
    Names do not depend on each other; a group is one name's sessions.
    """
    sessions = periods(books, bars)
    book = books.select(F.col("date").alias("period"), "symbol", "weight")
    rows = _priced(bars).join(sessions.where("period IS NOT NULL"), "date").join(books.select("symbol").distinct(), "symbol", "left_semi").join(book, ["period", "symbol"], "left")

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        out, held, entry, open_stop, sold_before = [], False, None, False, False
        for r in pdf.sort_values("date").itertuples():
            price, sold = (None if pd.isna(r.exec_) else r.exec_), False
            if r.n == 1:
                weight = 0.0 if pd.isna(r.weight) or open_stop or sold_before else r.weight
                held, entry = weight > 0, entry if held and weight > 0 else None
                open_stop = False
                if not pd.isna(r.weight):
                    out.append([r.period, r.symbol, weight, None])
            elif open_stop and price is not None:
                out[-1][3] = r.date
                held, entry, open_stop, sold = False, None, False, True
            if held and entry is None:
                entry = price
            if held and entry is not None and not pd.isna(r.close_) and r.close_ / entry - 1 < -loss:
                open_stop = True
            sold_before = sold
        return pd.DataFrame(out, columns=["date", "symbol", "weight", "exit"])

    plain = rows.select("symbol", "date", "period", "n", F.col("weight").cast("double").alias("weight"), F.col("__exec").alias("exec_"), F.col("__price").alias("close_"))
    kind = books.schema["symbol"].dataType.simpleString()
    return plain.groupBy("symbol").applyInPandas(follow, f"date date, symbol {kind}, weight double, exit date")


def _held(books: DataFrame, bars: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(period, symbol, weight, date, live, sold, ratio, at_open) at every session, and (period, symbol, weight, date, live, ratio) when the next book takes over: positions per unit of their entry.

    A position enters at the first execution price of its period and is cash until then; closes are filled; from the session of an `exit` on it is not live.
    """
    priced = _priced(bars)
    book = books.select(F.col("date").alias("period"), "symbol", "weight", "exit")
    rows = priced.join(sessions, "date").join(book, ["period", "symbol"])
    so_far = Window.partitionBy("period", "symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__entry", F.first("__exec", ignorenulls=True).over(so_far)).withColumns({"live": F.coalesce(F.col("date") < F.col("exit"), F.lit(True)), "sold": F.coalesce(F.col("date") == F.col("exit"), F.lit(False))})
    ratio = lambda p: F.coalesce(F.try_divide(p, F.col("__entry")), F.lit(1.0))
    # What the position is worth when the next book takes over.
    after = priced.select("symbol", F.col("date").alias("until"), F.col("__open").alias("__next"))
    ends = rows.groupBy("period", "symbol", "weight", "until").agg(F.max_by("__entry", "date").alias("__entry"), F.max_by("__price", "date").alias("__last"), F.bool_and("live").alias("live")).where("until IS NOT NULL").join(after, ["until", "symbol"], "left")
    return rows.select("period", "symbol", "weight", "date", "live", "sold", ratio(F.col("__price")).alias("ratio"), ratio(F.col("__open")).alias("at_open")), ends.select("period", "symbol", "weight", F.col("until").alias("date"), "live", ratio(F.coalesce("__next", "__last")).alias("ratio"))


def _valued(books: DataFrame, bars: DataFrame, rate: float, sessions: DataFrame, costs: tuple[float, float, float] = (0, 0, 0)) -> tuple[DataFrame, DataFrame]:
    """(positions when the next book takes over, growth of every book by (period, date, over)).

    Cash is what the weights leave and what stops bring in, less their cost; where it is below 0 each session's close adds a day's interest. A period's
    cash is followed through an array of its sessions.
    """
    positions, ends = _held(books, bars, sessions)
    worth = lambda test, c: F.coalesce(F.sum(F.when(test, F.col("weight") * F.col(c))), F.lit(0.0))
    sums = positions.groupBy("period", "date").agg(worth(F.col("live"), "ratio").alias("held"), worth(F.col("live") | F.col("sold"), "at_open").alias("opened"), worth(F.col("sold"), "at_open").alias("sold"))
    whole = sessions.where("period IS NOT NULL").join(sums, ["period", "date"], "left").fillna(0.0, ["held", "opened", "sold"])
    paths = whole.groupBy("period").agg(F.sort_array(F.collect_list(F.struct("n", "date", "held", "opened", "sold"))).alias("path"))
    cash = books.groupBy(F.col("date").alias("period")).agg((1 - F.sum("weight")).alias("cash"))

    def follow(done: Column, x: Column) -> Column:
        before = F.element_at(done, -1)["cash"]
        value = before + x["opened"]
        now = before + x["sold"] - F.coalesce(cost_rate(F.try_divide(x["sold"], value), *costs), F.lit(0.0)) * value
        return F.concat(done, F.array(F.struct(x["date"].alias("date"), x["held"].alias("held"), F.when(now < 0, now * (1 + rate / 252)).otherwise(now).alias("cash"))))

    start = F.array(F.struct(F.lit(None).cast("date").alias("date"), F.lit(0.0).alias("held"), F.col("cash")))
    paths = paths.join(cash, "period").withColumn("path", F.aggregate("path", start, follow))
    closes = paths.select("period", F.inline("path")).where("date IS NOT NULL").select("period", "date", F.lit(False).alias("over"), (F.col("held") + F.col("cash")).alias("growth"))
    rest = ends.groupBy("period", "date").agg(worth(F.col("live"), "ratio").alias("__v"))
    untils = sessions.where("until IS NOT NULL").select("period", F.col("until").alias("date")).distinct()
    over = untils.join(rest, ["period", "date"], "left").join(paths.select("period", F.element_at("path", -1)["cash"].alias("cash")), "period")
    return ends, closes.unionByName(over.select("period", "date", F.lit(True).alias("over"), (F.coalesce("__v", F.lit(0.0)) + F.col("cash")).alias("growth")))


def _with_exits(books: DataFrame) -> DataFrame:
    return books if "exit" in books.columns else books.withColumn("exit", F.lit(None).cast("date"))


def holding_growth(books: DataFrame, bars: DataFrame, rate: float = 0.0) -> DataFrame:
    """(period, date, over, growth): value of each book per unit of its start, at every close while it is held and, with `over`, at the execution prices of the session on which the next book takes over.

    A position enters at the first execution price (open, else close) after its book's date; uninvested weight is cash, and `rate` is the yearly interest on cash below 0.
    """
    return _valued(_with_exits(books), bars, rate, periods(books, bars))[1]


def net_equity(books: DataFrame, bars: DataFrame, start: float = 1_000_000.0, commission: float = 10, slippage: float = 5, impact: float = 2.5, rate: float = 0.06) -> DataFrame:
    """(date, equity, turnover, cost): the curve of all books one after the other, net of costs and interest; turnover and cost stand at the sessions on which a book takes over.

    The old book is valued at the new one's execution prices; the change from the weights that it has come to by then, both sides counted, is the
    turnover, whose cost comes off before the new period starts. Books of stopped_books() sell at their exits, at a cost, and hold the cash until the next book.
    Before the first book the equity is its start. Weight space: no whole shares, pending orders or blocked buys.
    """
    books = _with_exits(books)
    sessions = periods(books, bars)
    ends, growth = _valued(books, bars, rate, sessions, (commission, slippage, impact))
    takes = sessions.where("n = 1 AND period IS NOT NULL").select("period", F.col("date").alias("at"))
    handed = growth.where("over").select(F.col("date").alias("at"), F.col("growth").alias("__g"))
    old = ends.where("live").select(F.col("date").alias("at"), "symbol", (F.col("weight") * F.col("ratio")).alias("__old")).join(handed, "at").select("at", "symbol", F.try_divide("__old", "__g").alias("__old"))
    new = books.select(F.col("date").alias("period"), "symbol", "weight").join(takes, "period").select("at", "symbol", "weight")
    moved = old.join(new, ["at", "symbol"], "full_outer").groupBy("at").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("__old", F.lit(0.0)))).alias("turnover"))
    steps = takes.join(moved, "at", "left").join(handed, "at", "left").withColumn("cost", cost_rate(F.coalesce("turnover", F.lit(0.0)), commission, slippage, impact))
    kept = F.coalesce("__g", F.lit(1.0)) * (1 - F.col("cost"))
    base = steps.withColumn("__base", F.product(kept).over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))  # a row for each book
    closes = sessions.join(growth.where("NOT over").select("period", "date", "growth"), ["period", "date"], "left").join(base.select("period", "at", "turnover", "cost", "__base"), "period", "left")
    at = lambda c: F.when(F.col("date") == F.col("at"), F.col(c)).otherwise(0.0)
    return closes.select("date", (F.coalesce(F.col("growth") * F.col("__base"), F.lit(1.0)) * start).alias("equity"), at("turnover").alias("turnover"), at("cost").alias("cost"))


def chained_equity(books: DataFrame, bars: DataFrame, start: float = 1_000_000.0) -> DataFrame:
    """(date, equity): net_equity without costs and interest."""
    return net_equity(books, bars, start, 0, 0, 0, 0).select("date", "equity")


def cost_rate(turnover: Column, commission: float = 10, slippage: float = 5, impact: float = 2.5) -> Column:
    """Cost as a share of equity, rates in hundredths of a percent."""
    return turnover * ((commission + slippage) / 1e4) + F.pow(turnover, 1.5) * (impact / 1e4)


def margin_interest(cash: Column, rate: float = 0.06) -> Column:
    return F.when(cash < 0, -cash * (rate / 252)).otherwise(0.0)


def stop_signals(held: DataFrame, loss: float = 0.15) -> DataFrame:
    """(symbol, spell, entry_date, stop_date): the first session of each holding spell below entry by more than `loss`.

    `held`: (symbol, date, close, holding), a row for each session.
    """
    flags = held.withColumn("spell", F.sum(F.when(~F.coalesce(F.lag("holding").over(by_symbol()), F.lit(False)) & F.col("holding"), 1).otherwise(0)).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))).where("holding")
    spell = Window.partitionBy("symbol", "spell").orderBy("date")
    entered = flags.withColumns({"entry": F.first("close", ignorenulls=True).over(spell), "entry_date": F.first("date").over(spell)})
    return entered.where(F.try_divide("close", "entry") - 1 < -loss).groupBy("symbol", "spell", "entry_date").agg(F.min("date").alias("stop_date"))


def delisted_prices(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Closes with a delisting's payoff (last price times 1 + return) on its date, and constant after."""
    joined = bars.join(events.select("symbol", "date", "delisting_return"), ["symbol", "date"], "left")
    past = by_symbol().rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("close", ignorenulls=True).over(past)
    paid = joined.withColumn("__pay", F.when(F.col("delisting_return").isNotNull(), before * (1 + F.col("delisting_return"))))
    so_far = F.last("__pay", ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    return paid.withColumn("close", F.coalesce(so_far, "close")).drop("__pay", "delisting_return")


def drawdowns(equity: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    path = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return equity.withColumn("drawdown", F.col("equity") / F.max("equity").over(path) - 1)


def performance(equity: DataFrame, keys: tuple[str, ...] = ("run",), rate: float = 0.04, periods: int = 252) -> DataFrame:
    """One row for each run of (keys, date, equity, bench): returns, ratios and drawdown; zero denominators give 0. The first row has no return."""
    order = Window.partitionBy(*keys).orderBy("date")
    df = drawdowns(equity, keys).withColumns({"r": F.try_divide("equity", F.lag("equity").over(order)) - 1, "b": F.try_divide("bench", F.lag("bench").over(order)) - 1})
    daily = (1 + rate) ** (1 / periods) - 1
    s = df.groupBy(*keys).agg(
        F.min_by("equity", "date").alias("v0"), F.max_by("equity", "date").alias("v1"), F.min_by("bench", "date").alias("b0"), F.max_by("bench", "date").alias("b1"), F.count("r").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"),
        F.sqrt(F.avg(F.when(F.col("r").isNotNull(), F.pow(F.least(F.col("r") - daily, F.lit(0.0)), 2)))).alias("down"), F.min("drawdown").alias("max_drawdown"), F.avg((F.col("r") > 0).cast("double")).alias("w"), F.avg(F.when(F.col("r").isNotNull(), (F.col("r") > 0).cast("double"))).alias("win_rate"), F.avg(F.col("r") - F.col("b")).alias("am"), F.stddev_samp(F.col("r") - F.col("b")).alias("as"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    root = periods**0.5
    cagr = F.pow(F.col("v1") / F.col("v0"), F.try_divide(F.lit(float(periods)), F.col("n"))) - 1
    return s.select(
        *keys, (F.col("v1") / F.col("v0") - 1).alias("total_return"), zero(cagr).alias("cagr"), zero(F.col("s") * root).alias("volatility"), zero(F.try_divide(F.col("m") - daily, "s") * root).alias("sharpe"), zero(F.try_divide((F.col("m") - daily) * periods, F.col("down") * root)).alias("sortino"),
        zero(F.try_divide(cagr, F.abs("max_drawdown"))).alias("calmar"), "max_drawdown", "win_rate", zero(F.try_divide("am", "as") * root).alias("information_ratio"), (F.col("b1") / F.col("b0") - 1).alias("bench_return"),
    )


def windowed(equity: DataFrame, windows: DataFrame) -> DataFrame:
    """Each run cut to several windows (name, start), a few: its rows under every window's name, for performance() by (run, name)."""
    named = windows.agg(F.collect_list(F.struct("name", "start")).alias("__windows"))
    cut = equity.join(named).withColumn("__w", F.explode("__windows")).where(F.col("date") >= F.col("__w.start"))
    return cut.select(*[c for c in equity.columns if c != "name"], F.col("__w.name").alias("name"))


def monthly_table(equity: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, year, m1..m12, annual): returns from month end to month end; the first month has none."""
    ends = equity.groupBy(*keys, F.trunc("date", "month").alias("month")).agg(F.max_by("equity", "date").alias("v"))
    rets = ends.withColumn("r", F.try_divide("v", F.lag("v").over(Window.partitionBy(*keys).orderBy("month"))) - 1).where("r IS NOT NULL")  # a row for each month
    return rets.groupBy(*keys, F.year("month").alias("year")).agg(*[F.max(F.when(F.month("month") == i, F.col("r"))).alias(f"m{i}") for i in range(1, 13)], (F.product(1 + F.col("r")) - 1).alias("annual"))


def risk_report(returns: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """Mean, deviation, bias-corrected skewness and excess kurtosis, extremes, 5 % tail, share positive, win to loss ratio."""
    s = returns.where("ret IS NOT NULL").groupBy(*keys).agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"), F.skewness("ret").alias("g1"), F.kurtosis("ret").alias("g2"), F.max("ret").alias("best"), F.min("ret").alias("worst"), F.percentile("ret", F.lit(0.05)).alias("var"), F.avg((F.col("ret") > 0).cast("double")).alias("positive"), F.avg(F.when(F.col("ret") > 0, F.col("ret"))).alias("win"), F.avg(F.when(F.col("ret") < 0, F.col("ret"))).alias("loss"))
    tail = returns.join(s.select(*keys, "var"), list(keys)).where("ret <= var").groupBy(*keys).agg(F.avg("ret").alias("cvar"))
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    kurt = F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.col("g2") + 6))
    return s.where("n >= 2").join(tail, list(keys), "left").select(*keys, "mean", "std", skew.alias("skew"), kurt.alias("kurtosis"), "best", "worst", "var", "cvar", "positive", F.try_divide(F.col("win"), F.abs("loss")).alias("win_loss"))


def account_panel(equity: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("date")
    df = drawdowns(equity, keys).withColumn("r", F.try_divide("equity", F.lag("equity").over(order)) - 1)
    return df.groupBy(*keys).agg((F.max_by("equity", "date") / F.min_by("equity", "date") - 1).alias("total_return"), F.coalesce(F.try_divide(F.avg("r"), F.stddev_pop("r")) * (252**0.5), F.lit(0.0)).alias("sharpe"), F.min("drawdown").alias("max_drawdown"))


def weekly(equity: DataFrame) -> DataFrame:
    """The last row of each week, with the drawdown of the full curve."""
    return drawdowns(equity).groupBy(F.date_trunc("week", "date").cast("date").alias("week")).agg(*[F.max_by(c, "date").alias(c) for c in ("equity", "bench", "drawdown")])


def drawdown_breaches(equity: DataFrame, limit: float, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """(keys, drawdown, breached): the drawdown at the last value that is there, against a limit."""
    some = equity.where(F.col("equity").isNotNull() & ~F.isnan("equity") & (F.abs("equity") < float("inf")))
    last = drawdowns(some, keys).groupBy(*keys).agg(F.max_by("drawdown", "date").alias("drawdown"))
    return last.withColumn("breached", F.col("drawdown") < -limit)


def rebalance_activity(books: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, rebalances, avg_turnover, changes): mean half change of weights from book to book, and positions opened, closed or changed; the first book has no change."""
    order = Window.partitionBy(*keys).orderBy("date")
    dates = books.select(*keys, "date").distinct().withColumn("next", F.lead("date").over(order))  # a row for each book
    old = books.select(*keys, "date", "symbol", F.col("weight").alias("old")).join(dates.where("next IS NOT NULL"), [*keys, "date"]).select(*keys, F.col("next").alias("date"), "symbol", "old")
    new = books.select(*keys, "date", "symbol", "weight").join(dates.select(*keys, F.col("next").alias("date")).where("date IS NOT NULL"), [*keys, "date"], "left_semi")
    moved = old.join(new, [*keys, "date", "symbol"], "full_outer").withColumn("d", F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))
    by_book = moved.groupBy(*keys, "date").agg((F.sum("d") / 2).alias("turnover"), F.count_if(F.col("d") > 1e-9).alias("n"))
    return by_book.groupBy(*keys).agg(F.count(F.lit(1)).alias("rebalances"), F.avg("turnover").alias("avg_turnover"), F.sum("n").alias("changes"))


def drifted_weights(books: DataFrame, prices: DataFrame) -> DataFrame:
    """(date, symbol, weight) on each book's date: the weights that the book before has come to by then, at prices (date, symbol, price) that are filled."""
    dates = books.select("date").distinct().withColumn("next", F.lead("date").over(Window.orderBy("date"))).where("next IS NOT NULL")  # a row for each book
    p0, p1 = (prices.select(F.col("date").alias(d), "symbol", F.col("price").alias(p)) for d, p in (("date", "p0"), ("next", "p1")))
    held = books.select("date", "symbol", "weight").join(dates, "date").join(p0, ["date", "symbol"], "left").join(p1, ["next", "symbol"], "left")
    grown = held.withColumn("__v", F.col("weight") * F.coalesce(F.try_divide("p1", "p0"), F.lit(1.0)))
    total = 1 - F.sum("weight").over(Window.partitionBy("next")) + F.sum("__v").over(Window.partitionBy("next"))
    return grown.select(F.col("next").alias("date"), "symbol", F.try_divide(F.col("__v"), total).alias("weight"))


def drifted_turnover(books: DataFrame, prices: DataFrame) -> DataFrame:
    """(date, turnover): half the change from the drifted weights to the new book."""
    old = drifted_weights(books, prices).withColumnRenamed("weight", "old")
    new = books.select("date", "symbol", "weight").join(old.select("date").distinct(), "date", "left_semi")
    both = old.join(new, ["date", "symbol"], "full_outer")
    return both.groupBy("date").agg((F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))) / 2).alias("turnover"))
