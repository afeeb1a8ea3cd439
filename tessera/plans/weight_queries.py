"""Queries on weight books, covariance, risk and performance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import analysis as an
from ..operators import factors as fa
from ..operators import performance as pe
from ..operators import quality as qu
from ..operators import weights as we
from ..sources import panel as src
from .common import WEEKLY, Query, bars, of_the_date_before, rounded, sql_bars, sql_composite, sql_factors, sql_full
from .quality_queries import DELISTINGS, delistings

CAP, LOW, SECTOR_CAP = 0.12, 0.03, 0.5
CAPITAL = 1_000_000.0
DRAWDOWN_LIMIT = 0.15


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top twelve of every fourth week."""
    scored = rounded(fa.composite(fa.price_factors(bars(spark, sf_dir), WEEKLY)), "score", digits=5)
    some = scored.where(F.pmod(F.floor(F.datediff("date", F.lit("1995-01-02")) / 7), F.lit(4)) == 0)
    return src.stored(fa.top_by_score(some, 12).select("date", "symbol", "sector", "score"), "top")


def _plain_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _top(spark, sf_dir)
    gross = we.feasible_gross(top, CAP, SECTOR_CAP)
    df = we.score_weights(top.join(gross, "date"), F.col("gross"))
    return we.sector_capped(we.within_bounds(df, LOW, CAP), SECTOR_CAP, CAP).select("date", "symbol", "sector", "score", "weight")


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.stored(rounded(_plain_book(spark, sf_dir), "weight"), "book")


def weights_gross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(we.feasible_gross(_top(spark, sf_dir), 0.2, 0.3), "gross")


def weights_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(we.score_weights(_top(spark, sf_dir), F.lit(1.0)).select("date", "symbol", "weight"), "weight", digits=5)


def weights_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = we.within_bounds(we.score_weights(_top(spark, sf_dir), F.lit(1.0)), LOW, CAP)
    return rounded(df.select("date", "symbol", "weight"), "weight", digits=5)


def weights_sector_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(we.sector_capped(we.score_weights(_top(spark, sf_dir), F.lit(1.0)), 0.4, 0.2).select("date", "symbol", "weight"), "weight", digits=5)


def weights_hard_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(we.hard_limits(_book(spark, sf_dir), 0.1, 0.8, 0.3).select("date", "symbol", "weight"), "weight", digits=7)


def weights_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(we.without_stopped(_book(spark, sf_dir), F.col("symbol") == "NATION_7").select("date", "symbol", (F.col("weight") + 1e-9).alias("weight")), "weight", digits=5)


def weights_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(we.book_turnover(_book(spark, sf_dir)).withColumn("turnover", F.col("turnover") + 1e-9), "turnover", digits=5)


def weights_turnover_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every book against the one before; books that bring a sector back under its cap pass."""
    book = src.stored(rounded(we.score_weights(_top(spark, sf_dir), F.lit(1.0)).select("date", "symbol", "sector", "weight"), "weight", digits=5), "book")
    old = of_the_date_before(book)
    new = book.join(old.select("date").distinct(), "date", "left_semi")
    return rounded(we.turnover_capped(old, new, 0.4, 1.0, keys=("date",), sector_cap=0.6), "weight", digits=5)


def weights_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(we.concentration(_book(spark, sf_dir)), "hhi", "gross", "effective_n", digits=5)


def weights_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(we.sector_weights(_book(spark, sf_dir), 0.4).withColumn("weight", F.col("weight") + 1e-9), "weight", digits=5)


def _samples(spark: SparkSession, sf_dir: str, book: DataFrame | None = None) -> DataFrame:
    book = (_book(spark, sf_dir) if book is None else book).select("date", "symbol", "weight")
    returns = rounded(fa.with_returns(bars(spark, sf_dir)).select("symbol", "date", "ret"), "ret")
    return src.stored(we.moments(returns, book, 26), "samples")


def covariance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(we.covariance(_samples(spark, sf_dir)), "cov", digits=5)


def covariance_shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(we.covariance(_samples(spark, sf_dir), "shrunk"), "cov", digits=5)


def covariance_decayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(we.covariance(_samples(spark, sf_dir), "ewm"), "cov", digits=5)


def weights_volatility_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = _book(spark, sf_dir)
    cov = we.covariance(_samples(spark, sf_dir, book))
    return rounded(we.volatility_scaled(book, cov, 0.5, F.lit(1.5), 0.2, 0.6, 52).select("date", "symbol", "weight"), "weight", digits=5)


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books by the whole way of weights, from the top names of every fourth week."""
    top = _top(spark, sf_dir)
    cov = we.covariance(_samples(spark, sf_dir, top.withColumn("weight", F.lit(1.0))), "shrunk")
    regimes = we.regime(fa.with_returns(src.benchmark_bars(spark, sf_dir)), 8, 0.3, 0.6, 52)
    return src.stored(rounded(we.target_books(top, cov, regimes, low=LOW, cap=CAP, sector_cap=SECTOR_CAP, target=0.4, periods=52), "weight", digits=7), "targets")


def weights_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_targets(spark, sf_dir).select("date", "symbol", "weight", "gross_cap"), "weight", digits=5)


def weights_turnover_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final books under two turnover caps, each book against what came out before."""
    some = _targets(spark, sf_dir).withColumn("cap", F.explode(F.array(F.lit(0.3), F.lit(0.6)))).withColumn("strategy", F.concat(F.lit("cap"), F.col("cap").cast("string")))
    return rounded(we.turnover_chained(some, "cap", SECTOR_CAP), "weight", digits=5)


def book_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = _book(spark, sf_dir)
    # Weights have six digits, so these sums have at most twelve; without that, an exact half would go by the order of a sum.
    risk = rounded(we.book_risk(_samples(spark, sf_dir, book), book), "hhi", "gross", "top_sector", digits=12)
    return rounded(risk, "hhi", "gross", "effective_n", "top_sector", "vol", "drawdown", "var", "cvar", digits=4)


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = fa.with_returns(bars(spark, sf_dir)).select("symbol", "date", "ret")
    market = fa.with_returns(src.benchmark_bars(spark, sf_dir)).select("date", F.col("ret").alias("market"))
    return rounded(we.factor_exposures(returns.join(market, "date"), ["market"], "symbol"), "beta", "alpha", "r2", "residual_vol")


def market_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = fa.with_returns(src.benchmark_bars(spark, sf_dir))
    return rounded(we.regime(bench, 8, 0.3, 0.6, 52), "vol", digits=5)


def _curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, date, equity, bench): each symbol's filled close as an equity curve against the market."""
    panel = bars(spark, sf_dir).select(F.col("symbol").alias("run"), "date", qu.forward_filled("close").alias("equity")).where("equity IS NOT NULL")
    return panel.join(src.benchmark_bars(spark, sf_dir).select("date", F.col("close").alias("bench")), "date")


def performance_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pe.performance(_curves(spark, sf_dir), periods=52)
    return rounded(df, *[c for c in df.columns if c != "run"], digits=4)


def performance_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = spark.createDataFrame([("5y", "1995-01-01"), ("3y", "1996-06-01"), ("1y", "1998-01-01")], "name string, s string").select("name", F.col("s").cast("date").alias("start"))
    df = pe.performance(pe.windowed(_curves(spark, sf_dir), windows), ("run", "name"), periods=52)
    return rounded(df, *[c for c in df.columns if c not in ("run", "name")], digits=4)


def monthly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pe.monthly_table(_curves(spark, sf_dir), ("run",))
    return rounded(df, *[c for c in df.columns if c not in ("run", "year")], digits=5)


def drawdown_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pe.drawdown_breaches(_curves(spark, sf_dir), DRAWDOWN_LIMIT), "drawdown")


def rebalance_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pe.rebalance_activity(_book(spark, sf_dir)), "avg_turnover")


def portfolio_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each book buys with the capital, from weights to four digits."""
    prices = bars(spark, sf_dir).select("date", "symbol", F.col("close").alias("price"))
    return we.portfolio_table(rounded(_plain_book(spark, sf_dir), "weight", digits=4), prices, CAPITAL)


def portfolio_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return we.portfolio_header(_book(spark, sf_dir), we.regime(fa.with_returns(src.benchmark_bars(spark, sf_dir)), 8, 0.3, 0.6, 52))


def factor_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return we.factor_breakdown(fa.price_factors(bars(spark, sf_dir), WEEKLY), _book(spark, sf_dir), fa.WEIGHTS)


def return_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pe.risk_report(fa.with_returns(bars(spark, sf_dir)).select(F.col("symbol").alias("run"), F.round("ret", 6).alias("ret")))
    return rounded(df, *[c for c in df.columns if c != "run"], digits=4)


def account_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pe.account_panel(_curves(spark, sf_dir)), "total_return", "sharpe", "max_drawdown", digits=4)


def weekly_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = src.benchmark_bars(spark, sf_dir, "day").select("date", F.col("close").alias("equity"), F.col("close").alias("bench"))
    return rounded(pe.weekly(daily), "drawdown")


def sharpe_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(an.rolling_sharpe(fa.with_returns(src.benchmark_bars(spark, sf_dir)), 13).select("date", "sharpe"), "sharpe", digits=4)


def stop_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = bars(spark, sf_dir, "month").withColumn("holding", F.coalesce(F.month("date") > 3, F.lit(False))).select("symbol", "date", "close", "holding")
    return pe.stop_signals(held).select("symbol", "entry_date", "stop_date")


def delisting_payoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pe.delisted_prices(bars(spark, sf_dir).select("symbol", "date", "close"), delistings(spark)), "close", digits=4)


def _opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that open at the close before."""
    return src.stored(bars(spark, sf_dir).withColumn("open", F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))), "panel")


def portfolio_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pe.chained_equity(_book(spark, sf_dir), _opened(spark, sf_dir)), "equity", digits=2)


def holding_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pe.holding_growth(_book(spark, sf_dir), _opened(spark, sf_dir)), "growth", digits=5)


def net_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books at five quarters of their weights, so that some borrow."""
    book = _book(spark, sf_dir).withColumn("weight", F.col("weight") * 1.25)
    return rounded(pe.net_equity(book, _opened(spark, sf_dir)), "equity", "turnover", "cost", digits=6).withColumn("equity", F.round("equity", 2))


def net_equity_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The books' curve with stops at a loss of a tenth."""
    book, panel = _book(spark, sf_dir), _opened(spark, sf_dir)
    stopped = src.stored(pe.stopped_books(book, panel, 0.1), "stopped")
    return rounded(pe.net_equity(stopped, panel), "equity", "turnover", "cost", digits=6).withColumn("equity", F.round("equity", 2))


def drifted_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = bars(spark, sf_dir).select("date", "symbol", qu.forward_filled("close").alias("price"))
    return rounded(pe.drifted_turnover(_book(spark, sf_dir), prices), "turnover")


def rebalance_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of the turnover from drifted weights, and a day's interest on what a book at five quarters of its weights borrows."""
    prices = bars(spark, sf_dir).select("date", "symbol", qu.forward_filled("close").alias("price"))
    book = _book(spark, sf_dir)
    df = pe.drifted_turnover(book, prices).join(we.concentration(book), "date")
    return rounded(df.select("date", pe.cost_rate(F.col("turnover")).alias("cost"), pe.margin_interest(1 - 1.25 * F.col("gross")).alias("interest")), "cost", "interest", digits=8)


QUERIES: dict[str, Query] = {f.__name__: f for f in (weights_gross, weights_by_score, weights_bounded, weights_sector_capped, weights_hard_limits, weights_stopped, weights_turnover, weights_turnover_capped, weights_concentration, weights_sectors, covariance_sample, covariance_shrunk, covariance_decayed, weights_volatility_scaled, weights_final, weights_turnover_chained, book_risk, exposures, market_regime, performance_by_run, performance_windows, monthly_returns, return_risk, account_summary, weekly_curve, sharpe_rolling, stop_losses, delisting_payoff, holding_growth, portfolio_equity, net_equity, net_equity_stopped, rebalance_costs, drifted_turnover, drawdown_breaches, rebalance_activity, portfolio_table, portfolio_header, factor_breakdown)}

_TOP = f"WITH {sql_bars()}, {sql_factors(WEEKLY)}, {sql_composite('fac', fa.WEIGHTS)}, t0 AS (SELECT date, symbol, sector, round(score, 5) AS score FROM comp WHERE score IS NOT NULL AND ((date - DATE '1995-01-02') // 7) % 4 = 0), top AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS k FROM t0) WHERE k <= 12)"


def _gross(cap: float, sector_cap: float) -> str:
    return f"gross AS (SELECT date, least(1.0, sum(room)) AS gross FROM (SELECT date, sector, least({sector_cap}, count(*) * {cap}) AS room FROM top GROUP BY 1, 2) GROUP BY date)"


_BYSCORE = lambda gross: f"sw AS (SELECT date, symbol, sector, score, s / sum(s) OVER (PARTITION BY date) * g AS weight FROM (SELECT top.*, score - min(score) OVER (PARTITION BY date) + 1e-6 AS s, {gross} AS g FROM top JOIN gross USING (date)))"
_BOUND = f"b1 AS (SELECT *, least(sum(weight) OVER (PARTITION BY date), count(*) OVER (PARTITION BY date) * {CAP}) AS g, CASE WHEN count(*) OVER (PARTITION BY date) * {LOW} > sum(weight) OVER (PARTITION BY date) THEN 0 ELSE {LOW} END AS lo FROM sw), b2 AS (SELECT *, greatest(lo, least({CAP}, weight)) AS c FROM b1), b3 AS (SELECT *, g - sum(c) OVER (PARTITION BY date) AS gap FROM b2), b4 AS (SELECT *, CASE WHEN gap > 0 THEN {CAP} - c ELSE c - lo END AS r FROM b3), bw AS (SELECT date, symbol, sector, score, c + coalesce(gap * r / nullif(sum(r) OVER (PARTITION BY date), 0), 0) AS weight FROM b4)"


def _sector(source: str, out: str, sector_cap: float, cap: float) -> str:
    p = out
    return f"""{p}1 AS (SELECT *, CASE WHEN sum(weight) OVER (PARTITION BY date, sector) > {sector_cap} THEN weight * {sector_cap} / sum(weight) OVER (PARTITION BY date, sector) ELSE weight END AS cut FROM {source}),
{p}2 AS (SELECT *, sum(weight - cut) OVER (PARTITION BY date) AS free, greatest(0, {cap} - cut) AS room, greatest(0, {sector_cap} - sum(cut) OVER (PARTITION BY date, sector)) AS sroom FROM {p}1),
{p}3 AS (SELECT *, coalesce(least(sroom, sum(room) OVER (PARTITION BY date, sector)) * room / nullif(sum(room) OVER (PARTITION BY date, sector), 0), 0) AS may FROM {p}2),
{out} AS (SELECT date, symbol, sector, score, cut + may * least(1, coalesce(free / nullif(sum(may) OVER (PARTITION BY date), 0), 0)) AS weight FROM {p}3)"""


_BOOK = f"{_TOP}, {_gross(CAP, SECTOR_CAP)}, {_BYSCORE('gross')}, {_BOUND}, {_sector('bw', 'sc', SECTOR_CAP, CAP)}, book AS (SELECT date, symbol, sector, score, round(weight, 6) AS weight FROM sc)"
_PLAIN = f"{_TOP}, gross AS (SELECT DISTINCT date, 1.0 AS gross FROM top), {_BYSCORE('1.0')}"
_SAMPLES = "r6 AS (SELECT symbol, date, round(ret, 6) AS ret FROM rets), ses AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM r6)), span AS (SELECT m.date AS book_date, s.date, m.i - s.i AS age FROM (SELECT * FROM ses WHERE date IN (SELECT date FROM bk)) m JOIN ses s ON s.i <= m.i AND s.i > m.i - 26), samp AS (SELECT book_date, span.date, bk.symbol, r6.ret, age FROM span JOIN bk ON bk.date = book_date LEFT JOIN r6 ON r6.symbol = bk.symbol AND r6.date = span.date)"
_SAMP = f"{_BOOK}, bk AS (SELECT * FROM book), {_SAMPLES}"
_WHOLE = "sess AS (SELECT book_date, date, count(ret) = count(*) AS full_, count(ret) > 0 AS some_ FROM samp GROUP BY 1, 2), nb AS (SELECT book_date, count(*) FILTER (WHERE full_) AS k FROM sess GROUP BY 1), mn AS (SELECT book_date, symbol, coalesce(avg(ret), 0) AS mu FROM samp GROUP BY 1, 2), whole AS (SELECT s.book_date, s.date, s.symbol, CASE WHEN k < 2 THEN coalesce(ret, mu) ELSE ret END AS ret, age FROM samp s JOIN sess USING (book_date, date) JOIN nb USING (book_date) JOIN mn USING (book_date, symbol) WHERE full_ OR (k < 2 AND some_)), pr AS (SELECT x.book_date AS date, x.symbol AS a, y.symbol AS b, x.ret AS x, y.ret AS y, x.age FROM whole x JOIN whole y ON x.book_date = y.book_date AND x.date = y.date)"
_SHRUNK = "c AS (SELECT date, a, b, x - avg(x) OVER v AS x, y - avg(y) OVER v AS y FROM pr WINDOW v AS (PARTITION BY date, a, b)), s AS (SELECT date, a, b, count(*) AS t, avg(x * y) AS s, avg((x * y) ** 2) AS q FROM c GROUP BY 1, 2, 3), m AS (SELECT *, sqrt(count(*) OVER (PARTITION BY date)) AS n, sum(CASE WHEN a = b THEN s END) OVER (PARTITION BY date) / sqrt(count(*) OVER (PARTITION BY date)) AS mu FROM s), g AS (SELECT *, CASE WHEN a = b THEN mu ELSE 0 END AS goal FROM m), d AS (SELECT *, sum((s - goal) ** 2) OVER (PARTITION BY date) / n AS delta, sum(q - s * s) OVER (PARTITION BY date) / n AS phi FROM g), k AS (SELECT *, greatest(0, least(1, coalesce(phi / nullif(delta * t, 0), 1))) AS k FROM d), shr AS (SELECT date, a, b, k * goal + (1 - k) * s AS cov FROM k WHERE t >= 2 UNION ALL SELECT x.book_date, x.symbol, y.symbol, CASE WHEN x.symbol = y.symbol THEN x.v ELSE 0 END FROM (SELECT book_date, symbol, coalesce(var_pop(ret), 0) AS v FROM samp GROUP BY 1, 2) x JOIN (SELECT DISTINCT book_date, symbol FROM samp) y ON x.book_date = y.book_date WHERE x.book_date NOT IN (SELECT book_date FROM whole GROUP BY 1 HAVING count(DISTINCT date) >= 2))"
_COV = "cov AS (SELECT x.book_date AS date, x.symbol AS a, y.symbol AS b, covar_samp(x.ret, y.ret) AS cov FROM samp x JOIN samp y ON x.book_date = y.book_date AND x.date = y.date WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY 1, 2, 3)"
_CURVE = "bench AS (SELECT date_trunc('week', l_shipdate)::DATE AS date, round(sum(l_extendedprice) / sum(l_quantity) + 1e-9, 6) AS bench FROM lineitem GROUP BY 1), curve AS (SELECT symbol AS run, f.date, equity, bench FROM (SELECT symbol, date, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date) AS equity FROM bars) f JOIN bench USING (date) WHERE equity IS NOT NULL)"


def _perf(source: str, keys: str = "run") -> str:
    d = f"({1.04!r} ** (1 / 52.0) - 1)"
    return f"""p1 AS (SELECT *, equity / max(equity) OVER (PARTITION BY {keys} ORDER BY date) - 1 AS dd, equity / lag(equity) OVER (PARTITION BY {keys} ORDER BY date) - 1 AS r, bench / lag(bench) OVER (PARTITION BY {keys} ORDER BY date) - 1 AS b FROM {source}),
p2 AS (SELECT {keys}, min_by(equity, date) AS v0, max_by(equity, date) AS v1, min_by(bench, date) AS b0, max_by(bench, date) AS b1, count(r) AS n, avg(r) AS m, stddev_samp(r) AS s, sqrt(avg(least(r - {d}, 0) ** 2) FILTER (WHERE r IS NOT NULL)) AS down, min(dd) AS mdd, avg((r > 0)::INT) AS win, avg(r - b) AS am, stddev_samp(r - b) AS s2 FROM p1 GROUP BY {keys}),
p3 AS (SELECT *, (v1 / v0) ** (52.0 / n) - 1 AS cagr FROM p2)
SELECT {keys}, round(v1 / v0 - 1, 4) AS total_return, round(cagr, 4) AS cagr, round(s * sqrt(52), 4) AS volatility, round((m - {d}) / s * sqrt(52), 4) AS sharpe, round((m - {d}) * 52 / (down * sqrt(52)), 4) AS sortino, round(cagr / abs(mdd), 4) AS calmar, round(mdd, 4) AS max_drawdown, round(win, 4) AS win_rate, round(am / s2 * sqrt(52), 4) AS information_ratio, round(b1 / b0 - 1, 4) AS bench_return FROM p3"""


def _scaled(cov: str, book: str, target: str, leverage: str, periods: int, cap: float, sector_cap: float) -> str:
    """CTEs up to `vl`: volatility scaling and hard limits of a book."""
    return f"""vo AS (SELECT {cov}.date, sqrt(greatest(0, sum(x.weight * y.weight * cov) * {periods})) AS vol FROM {cov} JOIN {book} x ON x.date = {cov}.date AND x.symbol = a JOIN {book} y ON y.date = {cov}.date AND y.symbol = b GROUP BY 1),
va AS (SELECT {book}.*, {leverage}::DOUBLE AS top, weight * CASE WHEN vol > 0 THEN least({target} / vol, {leverage}::DOUBLE) ELSE 1 END AS w0 FROM {book} LEFT JOIN vo USING (date)),
vb AS (SELECT date, symbol, sector, score, top, greatest(0, least({cap}, w0)) AS w1 FROM va),
vc AS (SELECT date, symbol, sector, score, w1 * least(1, coalesce(top / nullif(sum(w1) OVER (PARTITION BY date), 0), 1)) AS weight FROM vb),
{_sector('vc', 'vl', sector_cap, cap)}"""


def _final() -> str:
    """CTEs up to `fin`: the whole way of weights."""
    samples = f"{_TOP}, {_gross(CAP, SECTOR_CAP)}, {_BYSCORE('gross')}, {_BOUND}, {_sector('bw', 'sc', SECTOR_CAP, CAP)}, bk AS (SELECT * FROM sc), {_SAMPLES}, {_WHOLE}, {_SHRUNK}"
    regime = f"{_CURVE}, {_MK}, m2 AS (SELECT 'M' AS symbol, date, ret FROM mk), rv AS (SELECT date, ({sql_full('ret', 8, 'stddev_samp')}) * sqrt(52) AS v FROM m2), rg AS (SELECT date, least(1.5, CASE WHEN v < 0.3 THEN 1.5 WHEN v > 0.6 THEN 0.7 ELSE 1 END)::DOUBLE AS gross_cap FROM rv), bl AS (SELECT bk.*, coalesce(gross_cap, 1)::DOUBLE AS gross_cap FROM bk LEFT JOIN rg USING (date))"
    return f"{samples}, {regime}, {_scaled('shr', 'bl', '0.4', 'gross_cap', 52, CAP, SECTOR_CAP)}, fin AS (SELECT vl.date, vl.symbol, vl.sector, round(vl.weight, 7) AS weight, gross_cap FROM vl JOIN bl USING (date, symbol))"


_CHAIN = f"""tg AS (SELECT strategy, cap, dense_rank() OVER (ORDER BY date) AS k, date, symbol, sector, weight, gross_cap FROM fin, (VALUES ('cap0.3', 0.3), ('cap0.6', 0.6)) v(strategy, cap)),
chn AS (SELECT strategy, k, symbol, sector, weight FROM tg WHERE k = 1 AND weight > 1e-12
  UNION ALL SELECT strategy, k, symbol, sector, weight FROM (SELECT strategy, k, symbol, sector, free, CASE WHEN free THEN new ELSE old + cap / l1 * (new - old) END AS weight FROM (
    SELECT *, bool_or(l1 <= cap OR (g0 > gross_cap + 1e-9 AND g1 <= gross_cap + 1e-9) OR (s0 > {SECTOR_CAP} + 1e-9 AND s1 <= {SECTOR_CAP} + 1e-9)) OVER (PARTITION BY strategy) AS free FROM (
      SELECT *, sum(abs(new - old)) OVER d AS l1, sum(old) OVER d AS g0, sum(new) OVER d AS g1, sum(old) OVER e AS s0, sum(new) OVER e AS s1, max(top) OVER d AS gross_cap, max(c0) OVER d AS cap FROM (
        SELECT strategy, k, symbol, any_value(sector) AS sector, sum(old) AS old, sum(new) AS new, max(top) AS top, max(c0) AS c0 FROM (
          SELECT strategy, k + 1 AS k, symbol, sector, weight AS old, 0 AS new, NULL AS top, NULL AS c0 FROM chn
          UNION ALL SELECT tg.strategy, tg.k, symbol, sector, 0, weight, gross_cap, cap FROM tg JOIN (SELECT strategy, max(k) + 1 AS k FROM chn GROUP BY strategy) z ON z.strategy = tg.strategy AND z.k = tg.k) GROUP BY strategy, k, symbol)
      WINDOW d AS (PARTITION BY strategy), e AS (PARTITION BY strategy, sector)))
    ) WHERE k <= (SELECT max(k) FROM tg) AND (weight >= 0.0025 OR (free AND weight > 1e-12))),
ch AS (SELECT strategy, date, symbol, weight FROM chn JOIN (SELECT DISTINCT k, date FROM tg) USING (k))"""
_W5 = "SELECT date, symbol, round(weight, 5) AS weight FROM "
_DENSE = "gr AS (SELECT g.date, g.symbol, coalesce(weight, 0) AS weight FROM (SELECT * FROM (SELECT DISTINCT date FROM book), (SELECT DISTINCT symbol FROM book)) g LEFT JOIN book USING (date, symbol)), tc AS (SELECT date, abs(weight - lag(weight) OVER (PARTITION BY symbol ORDER BY date)) AS d FROM gr), tv AS (SELECT date, round(sum(d) / 2 + 1e-9, 5) AS turnover FROM tc GROUP BY date HAVING sum(d) IS NOT NULL)"
_DRIFTED = "fl AS (SELECT symbol, date, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date) AS price FROM bars), nx AS (SELECT date, lead(date) OVER (ORDER BY date) AS next FROM (SELECT DISTINCT date FROM book)), hd0 AS (SELECT nx.next AS date, b.symbol, b.weight, b.weight * coalesce(y.price / x.price, 1) AS v FROM book b JOIN nx USING (date) LEFT JOIN fl x ON x.date = b.date AND x.symbol = b.symbol LEFT JOIN fl y ON y.date = nx.next AND y.symbol = b.symbol WHERE nx.next IS NOT NULL), dw AS (SELECT date, symbol, v / (1 - sum(weight) OVER (PARTITION BY date) + sum(v) OVER (PARTITION BY date)) AS old FROM hd0), nb0 AS (SELECT date, symbol, weight FROM book WHERE date IN (SELECT date FROM dw)), dtv AS (SELECT date, sum(abs(coalesce(weight, 0) - coalesce(old, 0))) / 2 AS turnover FROM dw FULL JOIN nb0 USING (date, symbol) GROUP BY date)"
def _grow(factor: float, rate: float) -> str:
    """CTEs up to `gw` (growth of each period at closes, and at the next book's first session) and `dr` (drifted weights there)."""
    return f"""wb AS (SELECT date AS period, symbol, weight * {factor}::DOUBLE AS weight FROM book),
px AS (SELECT symbol, date, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date) AS price, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY date), close) AS ex FROM bars),
ss AS (SELECT s.date, (SELECT max(period) FROM wb WHERE period < s.date) AS period FROM (SELECT DISTINCT date FROM bars) s),
sn AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY date) AS n FROM ss),
pr AS (SELECT period, min(date) AS first, count(*) AS len, lead(min(date)) OVER (ORDER BY min(date)) AS until FROM sn WHERE period IS NOT NULL GROUP BY period),
hd AS (SELECT wb.period, wb.symbol, weight, sn.date, n, price, first_value(ex IGNORE NULLS) OVER (PARTITION BY wb.period, wb.symbol ORDER BY sn.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS entry FROM wb JOIN sn USING (period) JOIN px ON px.symbol = wb.symbol AND px.date = sn.date),
le AS (SELECT period, symbol, weight, max_by(price, date) AS lp, max_by(entry, date) AS entry FROM hd GROUP BY ALL),
dr0 AS (SELECT le.period, le.symbol, until, len, weight * coalesce(coalesce(px.ex, px.price, lp) / entry, 1) AS v FROM le JOIN pr USING (period) LEFT JOIN px ON px.symbol = le.symbol AND px.date = until WHERE until IS NOT NULL),
ca AS (SELECT period, 1 - sum(weight) AS cash FROM wb GROUP BY 1),
gw AS (SELECT period, date, false AS over, any_value(cash) * CASE WHEN any_value(cash) < 0 THEN (1 + {rate} / 252) ** any_value(n) ELSE 1 END + sum(weight * coalesce(price / entry, 1)) AS growth FROM hd JOIN ca USING (period) GROUP BY 1, 2
  UNION ALL SELECT period, until, true, any_value(cash) * CASE WHEN any_value(cash) < 0 THEN (1 + {rate} / 252) ** any_value(len) ELSE 1 END + sum(v) FROM dr0 JOIN ca USING (period) GROUP BY 1, 2),
dr AS (SELECT dr0.until AS tk, symbol, v / growth AS old FROM dr0 JOIN gw ON gw.period = dr0.period AND over),
nw AS (SELECT first AS tk, symbol, weight FROM wb JOIN pr USING (period)),
tn AS (SELECT tk, sum(abs(coalesce(weight, 0) - coalesce(old, 0))) AS t FROM dr FULL JOIN nw USING (tk, symbol) GROUP BY 1)"""


def _net(costs: tuple[float, float]) -> str:
    a, b = costs
    return f"""st AS (SELECT pr.period, first AS tk, t, t * ({a} / 1e4) + t ** 1.5 * ({b} / 1e4) AS cost, coalesce(growth, 1) AS g FROM pr JOIN tn ON tk = first LEFT JOIN gw ON over AND gw.date = first),
ba AS (SELECT *, exp(sum(ln(g * (1 - cost))) OVER (ORDER BY tk)) AS base FROM st),
ne AS (SELECT sn.date, 1e6 * coalesce(growth * base, 1) AS equity, CASE WHEN sn.date = tk THEN t ELSE 0 END AS turnover, CASE WHEN sn.date = tk THEN cost ELSE 0 END AS cost FROM sn LEFT JOIN ba USING (period) LEFT JOIN gw ON NOT over AND gw.date = sn.date)"""


_MK = "mk AS (SELECT date, bench / lag(bench) OVER (ORDER BY date) - 1 AS ret, bench FROM bench)"
_FINAL = _final()
ORACLE_SQL = {
    "weights_gross": f"{_TOP}, {_gross(0.2, 0.3)} SELECT date, round(gross, 6) AS gross FROM gross",
    "weights_by_score": f"{_PLAIN} {_W5} sw",
    "weights_bounded": f"{_PLAIN}, {_BOUND} {_W5} bw",
    "weights_sector_capped": f"{_PLAIN}, {_sector('sw', 'k', 0.4, 0.2)} {_W5} k",
    "weights_hard_limits": f"{_BOOK}, h1 AS (SELECT date, symbol, sector, score, greatest(0, least(0.1, weight)) AS weight FROM book), h2 AS (SELECT date, symbol, sector, score, weight * least(1, coalesce(0.8 / nullif(sum(weight) OVER (PARTITION BY date), 0), 1)) AS weight FROM h1), {_sector('h2', 'k', 0.3, 0.1)} SELECT date, symbol, round(weight, 7) AS weight FROM k",
    "weights_stopped": f"{_BOOK}, z AS (SELECT *, sum(weight) OVER (PARTITION BY date) AS g, CASE WHEN symbol = 'NATION_7' THEN 0 ELSE weight END AS w FROM book) SELECT date, symbol, round(w * g / sum(w) OVER (PARTITION BY date) + 1e-9, 5) AS weight FROM z",
    "weights_turnover": f"{_BOOK}, {_DENSE} SELECT * FROM tv",
    "weights_turnover_capped": f"{_PLAIN}, bk AS (SELECT date, symbol, sector, round(weight, 5) AS weight FROM sw), k AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM bk)), o AS (SELECT k.date, symbol, sector, weight FROM bk JOIN k ON bk.date = prev), n AS (SELECT bk.* FROM bk JOIN k USING (date) WHERE prev IS NOT NULL), so AS (SELECT date, sector, sum(weight) AS s0 FROM o GROUP BY 1, 2), sn AS (SELECT date, sector, sum(weight) AS s1 FROM n GROUP BY 1, 2), rl AS (SELECT date, bool_or(s0 > 0.6 + 1e-9 AND coalesce(s1, 0) <= 0.6 + 1e-9) AS relief FROM so LEFT JOIN sn USING (date, sector) GROUP BY 1), j AS (SELECT date, symbol, coalesce(o.weight, 0) AS old, coalesce(n.weight, 0) AS new FROM o FULL JOIN n USING (date, symbol)), s AS (SELECT *, sum(abs(new - old)) OVER d AS l1, sum(old) OVER d AS g0, sum(new) OVER d AS g1 FROM j WINDOW d AS (PARTITION BY date)), f AS (SELECT s.*, coalesce(relief, false) OR g0 <= 0 OR (g0 > 1 + 1e-9 AND g1 <= 1 + 1e-9) OR l1 <= 0.4 AS free FROM s LEFT JOIN rl USING (date)), w AS (SELECT date, symbol, free, CASE WHEN free THEN new ELSE old + 0.4 / l1 * (new - old) END AS weight FROM f) SELECT date, symbol, round(weight, 5) AS weight FROM w WHERE weight >= 0.0025 OR (free AND weight > 0)",
    "weights_concentration": f"{_BOOK} SELECT date, round(sum(weight * weight), 5) AS hhi, round(sum(weight), 5) AS gross, round(1 / sum(weight * weight), 5) AS effective_n FROM book GROUP BY date",
    "weights_sectors": f"{_BOOK} SELECT date, sector, round(sum(weight) + 1e-9, 5) AS weight, sum(weight) > 0.4 AS breach FROM book GROUP BY 1, 2",
    "covariance_sample": f"{_SAMP}, {_COV} SELECT date, a, b, round(cov, 5) AS cov FROM cov",
    "covariance_decayed": f"{_SAMP}, {_WHOLE}, s AS (SELECT date, a, b, sum(w) AS w, sum(w * w) AS ww, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * y) AS sxy FROM (SELECT *, 0.94 ** age AS w FROM pr) GROUP BY 1, 2, 3) SELECT date, a, b, round((sxy / w - sx * sy / (w * w)) * (w * w) / nullif(w * w - ww, 0), 5) AS cov FROM s",
    "covariance_shrunk": f"{_SAMP}, {_WHOLE}, {_SHRUNK} SELECT date, a, b, round(cov, 5) AS cov FROM shr",
    "weights_volatility_scaled": f"{_SAMP}, {_COV}, {_scaled('cov', 'bk', '0.5', '1.5', 52, 0.2, 0.6)} SELECT date, symbol, round(weight, 5) AS weight FROM vl",
    "weights_final": f"{_FINAL} SELECT date, symbol, round(weight, 5) AS weight, gross_cap FROM fin",
    "weights_turnover_chained": f"{_FINAL.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_CHAIN} SELECT strategy, date, symbol, round(weight, 5) AS weight FROM ch",
    "book_risk": f"{_SAMP}, br AS (SELECT book_date, samp.date, sum(weight * ret) AS ret FROM samp JOIN bk ON bk.date = book_date AND bk.symbol = samp.symbol GROUP BY 1, 2 HAVING count(ret) = count(*)), pa AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY book_date ORDER BY date)) AS v FROM br), dd AS (SELECT *, v / greatest(1, max(v) OVER (PARTITION BY book_date ORDER BY date)) - 1 AS dd FROM pa), st AS (SELECT book_date, stddev_samp(ret) * sqrt(252) AS vol, min(dd) AS drawdown, quantile_cont(ret, 0.05) AS q, count(*) AS n FROM dd GROUP BY 1), tl AS (SELECT book_date, avg(ret) AS c FROM br JOIN st USING (book_date) WHERE ret <= q GROUP BY 1), co AS (SELECT date AS book_date, sum(weight * weight) AS hhi, sum(weight) AS gross FROM bk GROUP BY 1), se AS (SELECT date AS book_date, max(w) AS top_sector FROM (SELECT date, sector, sum(weight) AS w FROM bk GROUP BY 1, 2) GROUP BY 1) SELECT book_date, round(hhi, 4) AS hhi, round(gross, 4) AS gross, round(1 / hhi, 4) AS effective_n, round(top_sector, 4) AS top_sector, round(vol, 4) AS vol, round(drawdown, 4) AS drawdown, round(CASE WHEN n >= 20 THEN q END, 4) AS var, round(CASE WHEN n >= 20 THEN c END, 4) AS cvar FROM co JOIN se USING (book_date) LEFT JOIN st USING (book_date) LEFT JOIN tl USING (book_date)",
    "market_regime": f"WITH {sql_bars()}, {_CURVE}, {_MK}, m2 AS (SELECT 'M' AS symbol, date, ret FROM mk), v AS (SELECT date, ({sql_full('ret', 8, 'stddev_samp')}) * sqrt(52) AS vol FROM m2) SELECT date, round(vol, 5) AS vol, CASE WHEN vol < 0.3 THEN 'low' WHEN vol > 0.6 THEN 'high' ELSE 'normal' END AS regime FROM v",
    "performance_by_run": f"WITH {sql_bars()}, {_CURVE}, {_perf('curve')}",
    "performance_windows": f"WITH {sql_bars()}, {_CURVE}, w AS (SELECT run, name, date, equity, bench FROM curve, (VALUES ('5y', DATE '1995-01-01'), ('3y', DATE '1996-06-01'), ('1y', DATE '1998-01-01')) v(name, start) WHERE date >= start), {_perf('w', 'run, name')}",
    "monthly_returns": f"WITH {sql_bars()}, {_CURVE}, e AS (SELECT run, date_trunc('month', date)::DATE AS month, max_by(equity, date) AS v FROM curve GROUP BY 1, 2), r AS (SELECT run, month, v / lag(v) OVER (PARTITION BY run ORDER BY month) - 1 AS r FROM e) SELECT run, year(month)::INT AS year, {', '.join(f'round(max(r) FILTER (WHERE month(month) = {i}), 5) AS m{i}' for i in range(1, 13))}, round(product(1 + r) - 1, 5) AS annual FROM r WHERE r IS NOT NULL GROUP BY 1, 2",
    "drawdown_breaches": f"WITH {sql_bars()}, {_CURVE}, d AS (SELECT run, date, equity / max(equity) OVER (PARTITION BY run ORDER BY date) - 1 AS dd FROM curve) SELECT run, round(max_by(dd, date), 6) AS drawdown, max_by(dd, date) < -{DRAWDOWN_LIMIT} AS breached FROM d GROUP BY run",
    "rebalance_activity": f"{_BOOK}, {_DENSE}, b AS (SELECT date, sum(d) / 2 AS t, count(*) FILTER (WHERE d > 1e-9) AS n FROM tc GROUP BY date HAVING sum(d) IS NOT NULL) SELECT count(*) AS rebalances, round(avg(t), 6) AS avg_turnover, sum(n)::BIGINT AS changes FROM b",
    "portfolio_table": f"{_BOOK}, w4 AS (SELECT date, symbol, score, round(weight, 4) AS weight FROM sc) SELECT date, symbol, score, weight, round(weight * 100, 2) AS weight_pct, round(weight * {CAPITAL}::DOUBLE, 2) AS dollars, coalesce(floor(weight * {CAPITAL}::DOUBLE / close), 0)::BIGINT AS shares, round(close::DECIMAL(18, 6), 2)::DOUBLE AS price FROM w4 LEFT JOIN (SELECT date, symbol, close FROM bars) USING (date, symbol)",
    "portfolio_header": f"{_BOOK}, {_CURVE}, {_MK}, m2 AS (SELECT 'M' AS symbol, date, ret FROM mk), v AS (SELECT date, ({sql_full('ret', 8, 'stddev_samp')}) * sqrt(52) AS vol FROM m2), g AS (SELECT date, sum(weight) AS w FROM book GROUP BY 1) SELECT date, CASE WHEN vol < 0.3 THEN 'low' WHEN vol > 0.6 THEN 'high' ELSE 'normal' END AS regime, round(w * 100, 1) AS invested_pct, round(greatest(0, 1 - w) * 100, 1) AS cash_pct FROM g LEFT JOIN v USING (date)",
    "factor_breakdown": f"{_BOOK}, {', '.join(f'fb{i} AS (SELECT date, symbol, {c!r} AS factor, round({c}, 3) AS value FROM (SELECT date, symbol FROM book) LEFT JOIN (SELECT date, symbol, {c} FROM fac) USING (date, symbol))' for i, (c, w) in enumerate(fa.WEIGHTS.items()) if w > 0)} {' UNION ALL '.join(f'SELECT * FROM fb{i}' for i, (c, w) in enumerate(fa.WEIGHTS.items()) if w > 0)}",
    "exposures": f"WITH {sql_bars()}, {_CURVE}, {_MK}, x AS (SELECT r.symbol, r.date, r.ret AS y, mk.ret AS x FROM rets r JOIN mk USING (date) WHERE r.ret IS NOT NULL AND mk.ret IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM x), s AS (SELECT symbol, count(*) AS n, regr_slope(y, x) AS beta, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, regr_syy(y, x) AS syy FROM k WHERE k <= 126 AND n >= 30 GROUP BY symbol) SELECT symbol, 'market' AS factor, round(beta, 6) AS beta, round(a * 252, 6) AS alpha, round(r2, 6) AS r2, round(sqrt(syy * (1 - r2) / (n - 2) * 252), 6) AS residual_vol FROM s",
    "return_risk": f"WITH {sql_bars()}, r AS (SELECT symbol AS run, round(ret, 6) AS ret FROM rets WHERE ret IS NOT NULL), m AS (SELECT run, count(*)::DOUBLE AS n, avg(ret) AS mean, stddev_samp(ret) AS std, max(ret) AS best, min(ret) AS worst, quantile_cont(ret, 0.05) AS var, avg((ret > 0)::INT) AS positive, avg(ret) FILTER (WHERE ret > 0) AS w, avg(ret) FILTER (WHERE ret < 0) AS l, skewness(ret) AS skew, kurtosis(ret) AS kurtosis FROM r GROUP BY run), t AS (SELECT run, avg(ret) AS cvar FROM r JOIN m USING (run) WHERE ret <= var GROUP BY run) SELECT run, round(mean, 4) AS mean, round(std, 4) AS std, round(skew, 4) AS skew, round(kurtosis, 4) AS kurtosis, round(best, 4) AS best, round(worst, 4) AS worst, round(var, 4) AS var, round(cvar, 4) AS cvar, round(positive, 4) AS positive, round(w / abs(l), 4) AS win_loss FROM m JOIN t USING (run)",
    "account_summary": f"WITH {sql_bars()}, {_CURVE}, a AS (SELECT *, equity / max(equity) OVER (PARTITION BY run ORDER BY date) - 1 AS dd, equity / lag(equity) OVER (PARTITION BY run ORDER BY date) - 1 AS r FROM curve) SELECT run, round(max_by(equity, date) / min_by(equity, date) - 1, 4) AS total_return, round(avg(r) / stddev_pop(r) * sqrt(252), 4) AS sharpe, round(min(dd), 4) AS max_drawdown FROM a GROUP BY run",
    "weekly_curve": "WITH d AS (SELECT date_trunc('day', l_shipdate)::DATE AS date, round(sum(l_extendedprice) / sum(l_quantity) + 1e-9, 6) AS v FROM lineitem GROUP BY 1), e AS (SELECT *, v / max(v) OVER (ORDER BY date) - 1 AS dd FROM d) SELECT date_trunc('week', date)::DATE AS week, max_by(v, date) AS equity, max_by(v, date) AS bench, round(max_by(dd, date), 6) AS drawdown FROM e GROUP BY 1",
    "sharpe_rolling": f"WITH {sql_bars()}, {_CURVE}, {_MK}, m2 AS (SELECT 'M' AS symbol, date, ret FROM mk) SELECT date, round(({sql_full('ret', 13)}) / ({sql_full('ret', 13, 'stddev_samp')}) * sqrt(252), 4) AS sharpe FROM m2",
    "stop_losses": f"WITH {sql_bars('month')}, h AS (SELECT symbol, date, close, year(date) AS spell FROM bars WHERE month(date) > 3), e AS (SELECT *, first_value(close IGNORE NULLS) OVER w AS entry, first_value(date) OVER w AS entry_date FROM h WINDOW w AS (PARTITION BY symbol, spell ORDER BY date)) SELECT symbol, entry_date, min(date) AS stop_date FROM e WHERE close / entry - 1 < -0.15 GROUP BY symbol, spell, entry_date",
    "delisting_payoff": f"WITH {sql_bars()}, v(symbol, date, r) AS (VALUES {', '.join(f'({s!r}, DATE {d!r}, {r}::DOUBLE)' for s, d, r in DELISTINGS)}), p AS (SELECT v.symbol, v.date, (1 + r) * (SELECT max_by(close, b.date) FROM bars b WHERE b.symbol = v.symbol AND b.date < v.date AND close IS NOT NULL) AS pay FROM v) SELECT b.symbol, b.date, round(CASE WHEN p.date <= b.date THEN pay ELSE close END, 4) AS close FROM bars b LEFT JOIN p ON p.symbol = b.symbol",
    "holding_growth": f"{_BOOK}, {_grow(1, 0)} SELECT period, date, over, round(growth, 5) AS growth FROM gw",
    "portfolio_equity": f"{_BOOK}, {_grow(1, 0)}, {_net((0, 0))} SELECT date, round(equity, 2) AS equity FROM ne",
    "net_equity": f"{_BOOK}, {_grow(1.25, 0.06)}, {_net((15, 2.5))} SELECT date, round(equity, 2) AS equity, round(turnover, 6) AS turnover, round(cost, 6) AS cost FROM ne",
    "drifted_turnover": f"{_BOOK}, {_DRIFTED} SELECT date, round(turnover, 6) AS turnover FROM dtv",
    "rebalance_costs": f"{_BOOK}, {_DRIFTED}, gs AS (SELECT date, sum(weight) AS gross FROM book GROUP BY 1) SELECT date, round(turnover * (15 / 1e4) + turnover ** 1.5 * (2.5 / 1e4), 8) AS cost, round(CASE WHEN 1 - 1.25 * gross < 0 THEN -(1 - 1.25 * gross) * (0.06 / 252) ELSE 0 END, 8) AS interest FROM dtv JOIN gs USING (date)",
}
