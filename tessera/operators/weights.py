"""Weight books: (date, symbol, sector, score or weight), and their risk. Leftover weight is cash."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import by_symbol

UNKNOWN = "__UNKNOWN__"


def _day(*more: str):
    return Window.partitionBy("date", *more)


def with_sector(book: DataFrame, sectors: DataFrame) -> DataFrame:
    return book.join(sectors, "symbol", "left").withColumn("sector", F.coalesce("sector", F.lit(UNKNOWN)))


def feasible_gross(book: DataFrame, cap: float, sector_cap: float) -> DataFrame:
    """(date, gross): what position and sector caps allow, at most 1."""
    sectors = book.groupBy("date", "sector").agg(F.least(F.lit(sector_cap), F.count(F.lit(1)) * cap).alias("room"))
    return sectors.groupBy("date").agg(F.least(F.lit(1.0), F.sum("room")).alias("gross"))


def score_weights(book: DataFrame, gross: Column) -> DataFrame:
    """Weights in proportion to scores above the least."""
    shifted = F.col("score") - F.min("score").over(_day()) + 1e-6
    return book.withColumn("__s", shifted).withColumn("weight", F.col("__s") / F.sum("__s").over(_day()) * gross).drop("__s")


def within_bounds(book: DataFrame, low: float, high: float) -> DataFrame:
    """Cuts weights to [low, high], keeping each date's gross: the cut amount goes to, or comes from, the free room in proportion."""
    gross = F.sum("weight").over(_day())
    n = F.count(F.lit(1)).over(_day())
    floor = F.when(n * low > gross, 0.0).otherwise(F.lit(low))
    df = book.withColumns({"__g": F.least(gross, n * high), "__lo": floor})
    df = df.withColumn("__c", F.greatest(F.col("__lo"), F.least(F.lit(high), F.col("weight"))))
    df = df.withColumn("__gap", F.col("__g") - F.sum("__c").over(_day()))
    room = F.when(F.col("__gap") > 0, F.lit(high) - F.col("__c")).otherwise(F.col("__c") - F.col("__lo"))
    df = df.withColumn("__r", room).withColumn("weight", F.col("__c") + F.coalesce(F.try_divide(F.col("__gap") * F.col("__r"), F.sum("__r").over(_day())), F.lit(0.0)))
    return df.drop("__g", "__lo", "__c", "__gap", "__r")


def sector_capped(book: DataFrame, sector_cap: float, cap: float) -> DataFrame:
    """Scales sectors above the cap down; what is cut goes to names with room in sectors with room, the rest is cash."""
    total = F.sum("weight").over(_day("sector"))
    df = book.withColumn("__cut", F.when(total > sector_cap, F.col("weight") * sector_cap / total).otherwise(F.col("weight")))
    df = df.withColumn("__free", F.sum(F.col("weight") - F.col("__cut")).over(_day()))
    df = df.withColumns({"__room": F.greatest(F.lit(0.0), F.lit(cap) - F.col("__cut")), "__sroom": F.greatest(F.lit(0.0), F.lit(sector_cap) - F.sum("__cut").over(_day("sector")))})
    share = F.try_divide(F.least(F.col("__sroom"), F.sum("__room").over(_day("sector"))) * F.col("__room"), F.sum("__room").over(_day("sector")))
    df = df.withColumn("__may", F.coalesce(share, F.lit(0.0)))
    give = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("__free"), F.sum("__may").over(_day())), F.lit(0.0)))
    return df.withColumn("weight", F.col("__cut") + F.col("__may") * give).drop("__cut", "__free", "__room", "__sroom", "__may")


def hard_limits(book: DataFrame, cap: float, gross_cap: float | Column, sector_cap: float) -> DataFrame:
    """Long only, position cap, gross cap, sector caps."""
    top = gross_cap if isinstance(gross_cap, Column) else F.lit(gross_cap)
    df = book.withColumn("weight", F.greatest(F.lit(0.0), F.least(F.lit(cap), F.col("weight"))))
    df = df.withColumn("weight", F.col("weight") * F.least(F.lit(1.0), F.coalesce(F.try_divide(top, F.sum("weight").over(_day())), F.lit(1.0))))
    return sector_capped(df, sector_cap, cap)


def volatility_scaled(book: DataFrame, covariance: DataFrame, target: float, leverage: Column, cap: float, sector_cap: float, periods: int = 252) -> DataFrame:
    """Weights times target over portfolio volatility, at most `leverage` times; as they are where the volatility is unknown or 0. Hard limits follow, with the leverage as gross cap."""
    a, b = book.select("date", F.col("symbol").alias("a"), F.col("weight").alias("wa")), book.select("date", F.col("symbol").alias("b"), F.col("weight").alias("wb"))
    risk = a.join(covariance, ["date", "a"]).join(b, ["date", "b"]).groupBy("date").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("wa") * F.col("wb") * F.col("cov")) * periods)).alias("__vol"))
    df = book.join(risk, "date", "left").withColumn("__top", leverage)
    scale = F.when(F.col("__vol") > 0, F.least(F.lit(target) / F.col("__vol"), F.col("__top"))).otherwise(1.0)
    return hard_limits(df.withColumn("weight", F.col("weight") * scale), cap, F.col("__top"), sector_cap).drop("__vol", "__top")


#: Leverage by regime.
REGIME_LEVERAGE = {"low": 1.5, "normal": 1.0, "high": 0.7}


def regime_leverage(caps: Mapping[str, float] = REGIME_LEVERAGE, most: float = 1.5, regime: str = "regime") -> Column:
    """The gross cap of a regime, at most `most`; 1 for unknown ones."""
    known = F.coalesce(*[F.when(F.col(regime) == name, cap) for name, cap in caps.items()], F.lit(1.0))
    return F.least(known, F.lit(most))


def target_books(top: DataFrame, covariance: DataFrame, regimes: DataFrame, *, low: float, cap: float, sector_cap: float, target: float, leverage: Mapping[str, float] = REGIME_LEVERAGE, most: float = 1.5, periods: int = 252) -> DataFrame:
    """(date, symbol, sector, score, weight, gross_cap): the whole way from selected names (date, symbol, sector, score) to a book.

    Feasible gross, weights by score, bounds, sector caps, the regime's leverage, volatility scaling, hard limits. What is left is cash and is never spread again.
    """
    book = score_weights(top.join(feasible_gross(top, cap, sector_cap), "date"), F.col("gross"))
    book = sector_capped(within_bounds(book, low, cap), sector_cap, cap).drop("gross")
    known = book.join(regimes.select("date", "regime"), "date", "left").withColumn("gross_cap", regime_leverage(leverage, most)).drop("regime")
    return volatility_scaled(known, covariance, target, F.col("gross_cap"), cap, sector_cap, periods).select("date", "symbol", "sector", "score", "weight", "gross_cap")


def turnover_capped(previous: DataFrame, target: DataFrame, cap: float, gross_cap: float, stub: float = 0.0025, keys: tuple[str, ...] = (), sector_cap: float | None = None) -> DataFrame:
    """(keys, symbol, weight), for each value of the keys: the target, or a blend on the way to it if the full change exceeds the cap.

    Books that bring the gross, or (with `sector_cap` and a column `sector` in both tables) a sector, from above its cap to within it pass as they are.
    """
    both = previous.select(*keys, "symbol", F.col("weight").alias("old")).join(target.select(*keys, "symbol", F.col("weight").alias("new")), [*keys, "symbol"], "full_outer").fillna(0.0, ["old", "new"])
    sums = both.groupBy(*keys).agg(F.sum(F.abs(F.col("new") - F.col("old"))).alias("l1"), F.sum("old").alias("g0"), F.sum("new").alias("g1"))
    if sector_cap is not None:
        side = lambda df, name: df.groupBy(*keys, F.coalesce("sector", F.lit(UNKNOWN)).alias("sector")).agg(F.sum("weight").alias(name))
        sectors = side(previous, "s0").join(side(target, "s1"), [*keys, "sector"], "left").groupBy(*keys).agg(F.max((F.col("s0") > sector_cap + 1e-9) & (F.coalesce("s1", F.lit(0.0)) <= sector_cap + 1e-9)).alias("relief"))
        sums = sums.join(sectors, list(keys), "left") if keys else sums.join(sectors)
    relief = F.coalesce("relief", F.lit(False)) if sector_cap is not None else F.lit(False)
    free = relief | (F.col("g0") <= 0) | ((F.col("g0") > gross_cap + 1e-9) & (F.col("g1") <= gross_cap + 1e-9)) | (F.lit(cap) >= 1) | (F.col("l1") <= cap)
    blended = F.when(free, F.col("new")).otherwise(F.col("old") + F.try_divide(F.lit(cap), F.col("l1")) * (F.col("new") - F.col("old")))
    out = both.join(sums, list(keys) or None).withColumn("weight", blended)
    return out.where((F.col("weight") >= stub) | (free & (F.col("weight") > 0))).select(*keys, "symbol", "weight")


def turnover_chained(targets: DataFrame, cap: float | str, sector_cap: float | None = None, stub: float = 0.0025, keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """(keys, date, symbol, weight): books of one date after another, each a blend from the book that came out before to its target, as in turnover_capped.

    `targets`: (keys, date, symbol, sector, weight, gross_cap), within their hard limits; a blend of two such books is within them too, unless the
    gross cap came down, and then the target passes. `cap` is a number or a column. A chain is sequential, so a strategy (a row for each name and
    date of its books) is one group; strategies run beside each other.
    """
    import pandas as pd

    names = [*keys, "date", "symbol", "weight"]
    kinds = {f.name: f.dataType.simpleString() for f in targets.schema.fields}

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, float] = {}
        sector: dict[str, str] = {}
        out = []
        for date, rows in pdf.sort_values(["date", "symbol"]).groupby("date", sort=True):
            new = dict(zip(rows["symbol"], rows["weight"], strict=True))
            sector.update(zip(rows["symbol"], rows["sector"].fillna(UNKNOWN), strict=True))
            top, most = float(rows["gross_cap"].iloc[0]), float(rows["__cap"].iloc[0])
            both = sorted({*held, *new})
            change = sum(abs(new.get(x, 0.0) - held.get(x, 0.0)) for x in both)
            gross = [sum(b.values()) for b in (held, new)]
            free = not held or most >= 1 or change <= most or (gross[0] > top + 1e-9 and gross[1] <= top + 1e-9)
            if not free and sector_cap is not None:
                sums: dict[str, list[float]] = {}
                for i, book in enumerate((held, new)):
                    for x, w in book.items():
                        sums.setdefault(sector[x], [0.0, 0.0])[i] += w
                free = any(a > sector_cap + 1e-9 and b <= sector_cap + 1e-9 for a, b in sums.values())
            if free:
                held = {x: w for x, w in new.items() if w > 1e-12}
            else:
                blend = {x: held.get(x, 0.0) + most / change * (new.get(x, 0.0) - held.get(x, 0.0)) for x in both}
                held = {x: w for x, w in blend.items() if w >= stub}
            out += [(date, x, w) for x, w in held.items()]
        frame = pd.DataFrame(out, columns=["date", "symbol", "weight"])
        return frame.assign(**{k: pdf[k].iloc[0] for k in keys})[names]

    rows = targets.select(*keys, "date", "symbol", "sector", "weight", "gross_cap", (F.col(cap) if isinstance(cap, str) else F.lit(cap)).cast("double").alias("__cap"))
    return rows.groupBy(*keys).applyInPandas(chain, ", ".join(f"`{n}` {kinds[n]}" for n in names))


def without_stopped(book: DataFrame, stopped: Column) -> DataFrame:
    """Stopped names go to 0 and the rest is scaled up to the same gross."""
    gross = F.sum("weight").over(_day())
    df = book.withColumns({"__g": gross, "weight": F.when(stopped, 0.0).otherwise(F.col("weight"))})
    return df.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col("__g"), F.sum("weight").over(_day())), F.lit(0.0))).drop("__g")


def book_turnover(book: DataFrame) -> DataFrame:
    """(date, turnover): half the absolute change of weights against the book before; the first has none."""
    dates = book.select("date").distinct().withColumn("next", F.lead("date").over(Window.orderBy("date"))).where("next IS NOT NULL")  # a row for each book
    old = book.join(dates, "date").select(F.col("next").alias("date"), "symbol", F.col("weight").alias("__old"))
    new = book.select("date", "symbol", "weight").join(dates.select(F.col("next").alias("date")), "date", "left_semi")
    change = F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("__old", F.lit(0.0)))
    return old.join(new, ["date", "symbol"], "full_outer").groupBy("date").agg((F.sum(change) / 2).alias("turnover"))


def concentration(book: DataFrame) -> DataFrame:
    """(date, hhi, effective_n, gross)."""
    return book.groupBy("date").agg(F.sum(F.col("weight") * F.col("weight")).alias("hhi"), F.sum("weight").alias("gross")).withColumn("effective_n", F.try_divide(F.lit(1.0), "hhi"))


def sector_weights(book: DataFrame, cap: float) -> DataFrame:
    return book.groupBy("date", "sector").agg(F.sum("weight").alias("weight")).withColumn("breach", F.col("weight") > cap)


def moments(returns: DataFrame, books: DataFrame, window: int) -> DataFrame:
    """(book_date, date, symbol, ret, age): the last `window` sessions' returns of each book's names; age 0 is the newest.

    Sessions are numbered once; a book's window is a row for each number, which meets the sessions by equality.
    """
    sessions = returns.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")))  # a row for each session
    at = books.select(F.col("date").alias("book_date"), "symbol")
    marks = sessions.join(books.select("date").distinct(), "date").select(F.col("date").alias("book_date"), F.col("i").alias("at"))
    numbers = marks.select("book_date", "at", F.explode(F.sequence(F.greatest(F.lit(1), F.col("at") - window + 1), F.col("at"))).alias("i"))
    span = numbers.join(sessions, "i").select("book_date", "date", (F.col("at") - F.col("i")).alias("age"))
    return at.join(span, "book_date").join(returns.select("symbol", "date", "ret"), ["symbol", "date"], "left")


def _complete(samples: DataFrame) -> DataFrame:
    """Sessions on which every name of a book has a return; in books with fewer than two of these, all with any return, where missing ones take the name's mean."""
    session, book = Window.partitionBy("book_date", "date"), Window.partitionBy("book_date")
    df = samples.withColumns({"__all": F.count("ret").over(session) == F.count(F.lit(1)).over(session), "__any": F.count("ret").over(session) > 0})
    df = df.withColumn("__few", F.coalesce(F.max(F.when(F.col("__all"), F.col("date"))).over(book) <= F.min(F.when(F.col("__all"), F.col("date"))).over(book), F.lit(True)))
    mean = F.coalesce(F.avg("ret").over(Window.partitionBy("book_date", "symbol")), F.lit(0.0))
    return df.withColumn("ret", F.when(F.col("__few"), F.coalesce("ret", mean)).otherwise(F.col("ret"))).where("__all OR (__few AND __any)").drop("__all", "__any", "__few")


def covariance(samples: DataFrame, method: str = "sample", decay: float = 0.06) -> DataFrame:
    """(date, a, b, cov) of each book from the rows of moments().

    sample: pairwise; shrunk: complete sessions, shrunk to the mean variance by the Ledoit-Wolf intensity (with fewer than two sessions the variances alone); ewm: decaying weights, bias corrected.
    """
    df = samples
    if method != "sample":
        df = _complete(df)
    x = df.where("ret IS NOT NULL").select("book_date", "date", "age", F.col("symbol").alias("a"), F.col("ret").alias("x"))
    y = x.select("book_date", "date", F.col("a").alias("b"), F.col("x").alias("y"))
    pairs = x.join(y, ["book_date", "date"])
    if method == "sample":
        return pairs.groupBy(F.col("book_date").alias("date"), "a", "b").agg(F.covar_samp("x", "y").alias("cov"))
    if method == "ewm":
        w = F.pow(F.lit(1 - decay), F.col("age"))
        s = pairs.groupBy(F.col("book_date").alias("date"), "a", "b").agg(F.sum(w).alias("w"), F.sum(w * w).alias("ww"), *[F.sum(w * F.col(c)).alias(f"s{c}") for c in "xy"], F.sum(w * F.col("x") * F.col("y")).alias("sxy"))
        biased = F.col("sxy") / F.col("w") - F.col("sx") * F.col("sy") / (F.col("w") * F.col("w"))
        return s.select("date", "a", "b", (biased * F.try_divide(F.col("w") * F.col("w"), F.col("w") * F.col("w") - F.col("ww"))).alias("cov"))
    centered = pairs.withColumns({c: F.col(c) - F.avg(c).over(Window.partitionBy("book_date", "a", "b")) for c in "xy"})
    s = centered.groupBy(F.col("book_date").alias("date"), "a", "b").agg(F.count(F.lit(1)).alias("t"), F.avg(F.col("x") * F.col("y")).alias("s"), F.avg(F.pow(F.col("x") * F.col("y"), 2)).alias("q"))
    day = Window.partitionBy("date")
    s = s.withColumns({"n": F.sqrt(F.count(F.lit(1)).over(day)), "trace": F.sum(F.when(F.col("a") == F.col("b"), F.col("s"))).over(day)}).withColumn("mu", F.col("trace") / F.col("n"))
    goal = F.when(F.col("a") == F.col("b"), F.col("mu")).otherwise(0.0)
    delta = F.sum(F.pow(F.col("s") - goal, 2)).over(day) / F.col("n")
    phi = F.sum(F.col("q") - F.col("s") * F.col("s")).over(day) / F.col("n")
    k = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(phi, delta * F.col("t")), F.lit(1.0))))
    shrunk = s.withColumn("k", k).where("t >= 2").select("date", "a", "b", (F.col("k") * goal + (1 - F.col("k")) * F.col("s")).alias("cov"))
    # Books with fewer than two such sessions: each name's own variance, 0 where it has none.
    enough = df.groupBy("book_date").agg(F.count_distinct("date").alias("__t")).where("__t >= 2").select("book_date")
    own = samples.join(enough, "book_date", "left_anti").groupBy("book_date", "symbol").agg(F.coalesce(F.var_pop("ret"), F.lit(0.0)).alias("v"))
    both = own.select("book_date", F.col("symbol").alias("a"), "v").join(own.select("book_date", F.col("symbol").alias("b")), "book_date")
    return shrunk.unionByName(both.select(F.col("book_date").alias("date"), "a", "b", F.when(F.col("a") == F.col("b"), F.col("v")).otherwise(0.0).alias("cov")))


def book_returns(samples: DataFrame, books: DataFrame) -> DataFrame:
    """(book_date, date, ret): returns of each book on sessions on which every name has one."""
    held = samples.join(books.select(F.col("date").alias("book_date"), "symbol", "weight"), ["book_date", "symbol"])
    return held.groupBy("book_date", "date").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"), F.count("ret").alias("n"), F.count(F.lit(1)).alias("all")).where("n = all").select("book_date", "date", "ret")


def tail_risk(returns: DataFrame, keys: tuple[str, ...] = ("book_date",), confidence: float = 0.95, least: int = 20) -> DataFrame:
    """Value at risk and mean loss beyond it; null under `least` sessions."""
    v = returns.groupBy(*keys).agg(F.percentile("ret", F.lit(1 - confidence)).alias("q"), F.count("ret").alias("n"))
    t = returns.join(v, list(keys)).groupBy(*keys).agg(F.first("q").alias("q"), F.first("n").alias("n"), F.avg(F.when(F.col("ret") <= F.col("q"), F.col("ret"))).alias("c"))
    return t.select(*keys, *[F.when(F.col("n") >= least, F.col(a)).alias(b) for a, b in (("q", "var"), ("c", "cvar"))])


def book_risk(samples: DataFrame, books: DataFrame) -> DataFrame:
    """One row for each book: concentration, largest sector, volatility, tail risk, worst drawdown of its returns."""
    rets = book_returns(samples, books)
    path = rets.withColumn("v", F.product(1 + F.col("ret")).over(Window.partitionBy("book_date").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    path = path.withColumn("dd", F.col("v") / F.greatest(F.lit(1.0), F.max("v").over(Window.partitionBy("book_date").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))) - 1)
    stats = path.groupBy("book_date").agg((F.stddev_samp("ret") * (252**0.5)).alias("vol"), F.min("dd").alias("drawdown"))
    sector = sector_weights(books, 1.0).groupBy(F.col("date").alias("book_date")).agg(F.max("weight").alias("top_sector"))
    return concentration(books).withColumnRenamed("date", "book_date").join(sector, "book_date").join(stats, "book_date", "left").join(tail_risk(rets), "book_date", "left")


def factor_exposures(returns: DataFrame, factors: list[str], key: str = "book", window: int = 126, least: int = 30) -> DataFrame:
    """(key, factor, beta, alpha, r2, residual_vol): least squares of `ret` on factor columns over each group's last `window` complete dates; only sums of products reach Python.

    Groups with fewer than `least` complete dates have no row; alpha and the residual volatility are for a year.
    """
    import numpy as np
    import pandas as pd

    k = len(factors)
    names = ["__one", *factors, "ret"]
    whole = returns.dropna(subset=["ret", *factors]).withColumns({"__one": F.lit(1.0), "__k": F.row_number().over(Window.partitionBy(key).orderBy(F.desc("date"))), "__n": F.count(F.lit(1)).over(Window.partitionBy(key))})
    whole = whole.where((F.col("__k") <= window) & (F.col("__n") >= least))
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    moments_ = whole.groupBy(key).agg(*sums)

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                m = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(k + 2)] for i in range(k + 2)], float)
                if m[0, 0] < k + 1:
                    continue
                beta = np.linalg.pinv(m[:-1, :-1]) @ m[:-1, -1]
                residual = m[-1, -1] - beta @ m[:-1, -1]
                total = m[-1, -1] - m[0, -1] ** 2 / m[0, 0]
                spread = float(np.sqrt(max(residual, 0.0) / (m[0, 0] - k - 1) * 252)) if m[0, 0] > k + 1 else None
                out += [(str(r[key]), f, float(b), float(beta[0] * 252), float(1 - residual / total) if total > 0 else 0.0, spread) for f, b in zip(factors, beta[1:], strict=True)]
            yield pd.DataFrame(out, columns=[key, "factor", "beta", "alpha", "r2", "residual_vol"])

    return moments_.mapInPandas(solve, f"{key} string, factor string, beta double, alpha double, r2 double, residual_vol double")


def regime(benchmark: DataFrame, window: int = 21, low: float = 0.12, high: float = 0.25, periods: int = 252) -> DataFrame:
    """(date, vol, regime): volatility of the last returns against two limits; a short history is normal."""
    frame = by_symbol().rowsBetween(-window + 1, 0)
    vol = F.when(F.count("ret").over(frame) == window, F.stddev_samp("ret").over(frame) * periods**0.5)
    return benchmark.withColumn("vol", vol).select("date", "vol", F.when(F.col("vol") < low, "low").when(F.col("vol") > high, "high").otherwise("normal").alias("regime"))


def portfolio_table(book: DataFrame, prices: DataFrame, capital: float, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """(keys, symbol, score, weight, weight_pct, dollars, shares, price): what a book buys of each name, in whole shares (0 without a price)."""
    rows = book.join(prices.select(*keys, "symbol", "price"), [*keys, "symbol"], "left").withColumn("dollars", F.col("weight") * capital)
    shares = F.coalesce(F.floor(F.try_divide("dollars", "price")), F.lit(0)).cast("long")
    return rows.select(*keys, "symbol", "score", "weight", F.round(F.col("weight") * 100, 2).alias("weight_pct"), F.round("dollars", 2).alias("dollars"), shares.alias("shares"), F.round("price", 2).alias("price"))


def portfolio_header(book: DataFrame, regimes: DataFrame) -> DataFrame:
    """(date, regime, invested_pct, cash_pct) of each book."""
    sums = book.groupBy("date").agg(F.sum("weight").alias("w")).join(regimes.select("date", "regime"), "date", "left")
    return sums.select("date", F.coalesce("regime", F.lit("normal")).alias("regime"), F.round(F.col("w") * 100, 1).alias("invested_pct"), F.round(F.greatest(F.lit(0.0), 1 - F.col("w")) * 100, 1).alias("cash_pct"))


def factor_breakdown(factors: DataFrame, held: DataFrame, weights: dict[str, float], digits: int = 3) -> DataFrame:
    """(date, symbol, factor, value): the factors with a positive weight of each book's names on its date."""
    active = [name for name, w in weights.items() if w > 0 and name in factors.columns]
    rows = held.select("date", "symbol").join(factors.select("date", "symbol", *active), ["date", "symbol"], "left")
    return rows.unpivot(["date", "symbol"], active, "factor", "value").withColumn("value", F.round("value", digits))
