"""Queries on factor evaluation, features, targets and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import rank_share
from ..operators import analysis as an
from ..operators import factors as fa
from ..operators import features as fe
from ..sources import panel as src
from .common import WEEKLY, Query, bars, of_the_date_before, rounded, sql_bars, sql_factors, sql_full
from .quality_queries import DELISTINGS, delistings

WINDOWS = (2, 4, 8, 13)
NAMES = ("momentum", "short_term_reversal", "high_proximity", "volatility")


def factors_forward(spark: SparkSession, sf_dir: str, h: int = 4) -> DataFrame:
    scored = rounded(fa.price_factors(bars(spark, sf_dir), WEEKLY), *NAMES, digits=6)
    return scored.withColumn("fwd", an.forward_sum("ret", h))


def ic_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = factors_forward(spark, sf_dir)
    rank, plain = (an.information_coefficients(df, "momentum", "fwd", rank=r).withColumnRenamed("ic", c) for r, c in ((True, "rank_ic"), (False, "plain_ic")))
    return rounded(rank.join(plain, "date"), "rank_ic", "plain_ic", digits=5)


def ic_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.ic_summary(an.information_coefficients(factors_forward(spark, sf_dir), "momentum", "fwd"))


def quantile_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(an.quantile_returns(factors_forward(spark, sf_dir), "momentum", "fwd"), *[f"q{i}" for i in range(1, 6)], "spread", digits=5)


def decay_by_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.factor_decay(factors_forward(spark, sf_dir), "momentum", (1, 2, 4, 8))


def rank_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(an.factor_turnover(factors_forward(spark, sf_dir), "momentum"), "turnover")


def correlation_of_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.factor_correlations(factors_forward(spark, sf_dir), NAMES, every=8)


def collinearity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.variance_inflation(factors_forward(spark, sf_dir), NAMES)


def feature_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fe.base_features(fa.with_returns(bars(spark, sf_dir)), WINDOWS, 10, 7, 10, WINDOWS[-1])
    names = [c for c in df.columns if c.startswith(("ret_", "vol_", "activity_")) or c in ("band_width", "atr", "bias")]
    return rounded(df.select("symbol", "date", *names), *names, digits=5)


def feature_oscillators(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fe.macd(fe.wilder_rsi(bars(spark, sf_dir, "month"), 6), 3, 6, 4)
    return rounded(df.select("symbol", "date", "rsi", "macd", "macd_signal", "macd_histogram"), "rsi", "macd", "macd_signal", "macd_histogram", digits=5)


#: Base features of the matrix: rolling ones, price factors, and (in the full matrix) oscillators.
ROLLING = [*[f"ret_{n}" for n in WINDOWS], *[f"vol_{n}" for n in WINDOWS], *[f"activity_{n}" for n in WINDOWS[:-1]], "band_width", "atr", "bias"]
FACTOR_FEATURES = ["momentum", "short_term_reversal", "high_proximity", "volatility_contraction", "trend_persistence"]
OSCILLATORS = ["rsi", "macd", "macd_signal", "macd_histogram"]


def _base_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors = rounded(fa.price_factors(bars(spark, sf_dir), WEEKLY).select("symbol", "date", *FACTOR_FEATURES), *FACTOR_FEATURES, digits=5)
    return feature_base(spark, sf_dir).join(factors, ["symbol", "date"])


def _matrix(df: DataFrame, names: list[str]) -> DataFrame:
    return rounded(fe.feature_table(df, names), *[f"{c}_rank" for c in names])


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values, ranks and missing flags of the features that SQL can express."""
    return _matrix(_base_features(spark, sf_dir), [*ROLLING, *FACTOR_FEATURES])


def feature_matrix_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 23 base features with ranks and missing flags."""
    slow = fe.macd(fe.wilder_rsi(bars(spark, sf_dir).select("symbol", "date", "close"), 6), 3, 6, 4).drop("close")
    slow = rounded(slow, *OSCILLATORS, digits=5)
    return _matrix(_base_features(spark, sf_dir).join(slow, ["symbol", "date"]), [*ROLLING, *FACTOR_FEATURES, *OSCILLATORS])


def cross_sectional_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = fa.with_returns(bars(spark, sf_dir, "month")).select("symbol", "date", "ret")
    events = delistings(spark).withColumn("date", F.trunc("date", "month"))
    df = returns.join(events, ["symbol", "date"], "left")
    df = rounded(fe.forward_return(df, 3, event="delisting_return"), "fwd_ret")
    return rounded(fe.target(df).select("symbol", "date", "fwd_ret", "label", "grade"), "label")


def purged_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A row for each session; stored, since all that is built on it would read the deals again.
    sessions = src.stored(src.deal_bars(spark, sf_dir).select("date").distinct(), "sessions")
    some = sessions.withColumn("k", F.row_number().over(Window.orderBy("date")) - 1).where("k % 40 = 39").select("date")
    return fe.purged_splits(sessions, some, 104, 13, 4)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = factors_forward(spark, sf_dir).fillna(0.0, list(NAMES)).withColumn("fwd_ret", F.round("fwd", 6))
    return fe.target(df).select("symbol", "date", *NAMES, "fwd_ret", "label")


def training_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fe.training_rows(_features(spark, sf_dir), purged_folds(spark, sf_dir), 4)
    return rows.groupBy("rebalance_date", "split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("dates"), F.round(F.avg("label"), 6).alias("label"))


def _models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fe.walk_forward(src.stored(_features(spark, sf_dir), "features"), purged_folds(spark, sf_dir), NAMES, stride=4)


def walk_forward_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark, sf_dir)[0]


def model_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fe.top_importances(_models(spark, sf_dir)[1])


def validation_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _features(spark, sf_dir).where("fwd_ret IS NOT NULL").select("symbol", "date", F.col("momentum").alias("margin"), "fwd_ret", "label")
    return rounded(fe.decile_spread(df, "margin", "fwd_ret").withColumn("spread", F.col("spread") + 1e-9), "spread")


def validation_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _features(spark, sf_dir).withColumn("score", rank_share("momentum"))
    return rounded(fe.validation_report(df), "rmse", "rmse_constant", "skill")


def _two_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = factors_forward(spark, sf_dir)
    return df.select("symbol", "date", F.col("momentum").alias("score")), df.where("symbol <> 'NATION_2'").select("symbol", "date", F.col("volatility").alias("score"))


def ensemble_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fe.ensemble(*_two_scores(spark, sf_dir)), "score")


def penalized_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date against the one before."""
    df = _two_scores(spark, sf_dir)[0]
    return rounded(fe.turnover_penalty(df, of_the_date_before(df), keys=("date",)), "score", digits=7)


def penalized_scores_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date against what came out at the one before."""
    return rounded(fe.turnover_penalty_chained(_two_scores(spark, sf_dir)[0], 0.3), "score", digits=6)


QUERIES: dict[str, Query] = {f.__name__: f for f in (ic_by_date, ic_statistics, quantile_spreads, decay_by_horizon, rank_turnover, correlation_of_factors, collinearity, feature_base, feature_oscillators, feature_matrix, cross_sectional_target, purged_folds, training_panel, walk_forward_scores, model_importances, validation_spreads, validation_skill, ensemble_scores, penalized_scores, penalized_scores_chained, feature_matrix_full)}

_FWD = lambda h: f"CASE WHEN count(ret) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) = {h} THEN sum(ret) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) END"
_PCT = lambda x, keys="date": f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {keys}, {x} IS NULL ORDER BY {x}) + (count({x}) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {keys}) END"
_BASE = f"WITH {sql_bars()}, {sql_factors(WEEKLY)}, df AS (SELECT symbol, sector, date, close, ret, {', '.join(f'round({c}, 6) AS {c}' for c in NAMES)}, {_FWD(4)} AS fwd FROM fac)"
_RK = f"both_ AS (SELECT date, momentum AS f, fwd AS r FROM df WHERE momentum IS NOT NULL AND fwd IS NOT NULL), rk AS (SELECT date, f, r, {_PCT('f')} AS pf, {_PCT('r')} AS pr FROM both_), ics AS (SELECT date, CASE WHEN count(*) >= 10 THEN corr(pf, pr) END AS ic, CASE WHEN count(*) >= 10 THEN corr(f, r) END AS pic FROM rk GROUP BY date)"
_SUM = "CASE WHEN count(ic) >= 20 THEN round(avg(ic), 4) END AS mean_ic, CASE WHEN count(ic) >= 20 THEN round(stddev_samp(ic), 4) END AS std_ic, CASE WHEN count(ic) >= 20 THEN round(avg(ic) / stddev_samp(ic), 4) END AS icir, CASE WHEN count(ic) >= 20 THEN round(avg((round(ic, 12) > 0)::INT), 4) END AS hit_rate, CASE WHEN count(ic) >= 20 THEN round(avg(ic) / stddev_samp(ic) * sqrt(count(ic)), 2) END AS t_stat, count(ic) AS n"
_EDGES = "e AS (SELECT date, quantile_cont(f, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM both_ GROUP BY date HAVING count(*) >= 10 AND len(list_distinct(quantile_cont(f, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) = 6)"
_LONGF = " UNION ALL ".join(f"SELECT symbol, date, '{c}' AS name, {c} AS v FROM s" for c in NAMES)


def _determinant(cells: list[list[str]]) -> str:
    """The determinant of a matrix of SQL expressions, by cofactors."""
    if len(cells) == 1:
        return cells[0][0]
    terms = [f"{'-' if j % 2 else '+'} {x} * ({_determinant([[*row[:j], *row[j + 1 :]] for row in cells[1:]])})" for j, x in enumerate(cells[0])]
    return " ".join(terms)


def _collinearity() -> str:
    k = range(len(NAMES))
    pairs = ", ".join(f"corr({NAMES[i]}, {NAMES[j]}) AS r{i}{j}" for i in k for j in k if i < j)
    cells = [[("1" if i == j else f"r{min(i, j)}{max(i, j)}") for j in k] for i in k]
    minors = [_determinant([[cells[i][j] for j in k if j != t] for i in k if i != t]) for t in k]
    rows = " UNION ALL ".join(f"SELECT date, '{f}' AS factor, round(({m}) / ({_determinant(cells)}), 2) AS vif FROM m" for f, m in zip(NAMES, minors, strict=True))
    return f"m AS (SELECT date, {pairs} FROM df WHERE {' AND '.join(f'{f} IS NOT NULL' for f in NAMES)} GROUP BY date HAVING count(*) >= {len(NAMES) + 2}) {rows}"


def _mean(y: str, gap: str, x: str, a: float) -> str:
    """The next value of a recursive mean y, `gap` rows after its last value."""
    return f"CASE WHEN {x} IS NULL THEN {y} WHEN {y} IS NULL THEN {x} ELSE (({1 - a!r}::DOUBLE ** ({gap} + 1)) * {y} + {a!r}::DOUBLE * {x}) / (({1 - a!r}::DOUBLE ** ({gap} + 1)) + {a!r}::DOUBLE) END"


def _oscillators(n: int = 6, fast: int = 3, slow: int = 6, signal: int = 4) -> str:
    """CTEs up to `osc`: RSI and MACD by recursion over each symbol's rows."""
    aw, af, al, as_ = 1 / n, 2 / (fast + 1), 2 / (slow + 1), 2 / (signal + 1)
    fa_, sl = _mean("f", "gc", "x.close", af), _mean("s", "gc", "x.close", al)
    return f"""x AS (SELECT symbol, date, close, close - lag(close) OVER w AS d, count(close) OVER w AS nc, row_number() OVER w AS k FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
xd AS (SELECT *, count(d) OVER (PARTITION BY symbol ORDER BY k) AS nd, CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0 END AS up, CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0 END AS dn FROM x),
rec AS (SELECT symbol, date, k, d, nd, up AS g, dn AS l, 0 AS gd, close AS f, close AS s, 0 AS gc, (close - close)::DOUBLE AS m FROM xd WHERE k = 1
  UNION ALL SELECT symbol, date, k, d, nd, g, l, gd, f, s, gc, {_mean("m", "0", "(f - s)", as_)} FROM (
    SELECT x.symbol, x.date, x.k, x.d, x.nd, {_mean("g", "gd", "x.up", aw)} AS g, {_mean("l", "gd", "x.dn", aw)} AS l, CASE WHEN x.d IS NULL THEN gd + 1 ELSE 0 END AS gd, {fa_} AS f, {sl} AS s, CASE WHEN x.close IS NULL THEN gc + 1 ELSE 0 END AS gc, m FROM rec JOIN xd x ON x.symbol = rec.symbol AND x.k = rec.k + 1)),
osc AS (SELECT symbol, date, CASE WHEN d IS NOT NULL AND nd >= {n} THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END AS rsi, f - s AS macd, m AS macd_signal, f - s - m AS macd_histogram FROM rec)"""


_FEAT = f"""x AS (SELECT symbol, date, close, ret, close - lag(close) OVER w AS d, {', '.join(f'close / lag(close, {n}) OVER w - 1 AS ret_{n}' for n in WINDOWS)} FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY date)),
y AS (SELECT *, abs(d) AS ad, abs(ret) AS ar, sign(ret) AS sg FROM x),
feat AS (SELECT symbol, date, {', '.join(f'round(ret_{n}, 5) AS ret_{n}, round(({sql_full("ret", n, "stddev_samp")}) * sqrt(252), 5) AS vol_{n}' for n in WINDOWS)},
  round(4 * ({sql_full('close', 10, 'stddev_samp')}) / ({sql_full('close', 10)}), 5) AS band_width, round(({sql_full('ad', 7)}) / close, 5) AS atr, round({sql_full('sg', 10, 'sum')}, 5) AS bias,
  {', '.join(f'round(({sql_full("ar", n)}) / ({sql_full("ar", 13)}), 5) AS activity_{n}' for n in WINDOWS[:-1])} FROM y)"""
_EV = ", ".join(f"({s!r}, date_trunc('month', DATE {d!r})::DATE, {r}::DOUBLE)" for s, d, r in DELISTINGS)
_SES = "ses AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM raw)), pts AS (SELECT date AS rebalance_date, i AS a FROM ses WHERE i % 40 = 39), sp AS (SELECT rebalance_date, a - 13 AS v0, a - 4 AS v1, a - 17 AS t1, greatest(0, a - 117) AS t0 FROM pts WHERE a - 17 - greatest(0, a - 117) >= 13), folds AS (SELECT rebalance_date, date, CASE WHEN i < t1 THEN 'train' ELSE 'validate' END AS split, (CASE WHEN i < t1 THEN i - t0 ELSE i - v0 END)::INT AS position FROM ses, sp WHERE i >= t0 AND i < v1 AND (i < t1 OR i >= v0))"
_LAB = f"lab0 AS (SELECT symbol, date, {', '.join(f'coalesce({c}, 0) AS {c}' for c in NAMES)}, round(fwd, 6) AS fwd_ret FROM df), lab AS (SELECT *, {_PCT('fwd_ret')} AS label FROM lab0)"
_SIDE = lambda col, name, where: f"{name}0 AS (SELECT symbol, date, {col} AS score FROM df {where}), {name} AS (SELECT symbol, date, CASE WHEN max(score) OVER (PARTITION BY date) > min(score) OVER (PARTITION BY date) THEN {_PCT('score')} ELSE 0.5 END AS p, score IS NOT NULL AND row_number() OVER (PARTITION BY date ORDER BY score DESC NULLS LAST, symbol) <= 10 AS t, max(score) OVER (PARTITION BY date) > min(score) OVER (PARTITION BY date) AS o FROM {name}0)"
_NOT_2 = "WHERE symbol <> 'NATION_2'"
ORACLE_SQL = {
    "ic_by_date": f"{_BASE}, {_RK} SELECT date, round(ic, 5) AS rank_ic, round(pic, 5) AS plain_ic FROM ics",
    "ic_statistics": f"{_BASE}, {_RK} SELECT {_SUM} FROM ics",
    "quantile_spreads": f"{_BASE}, {_RK}, {_EDGES}, b AS (SELECT date, r, greatest(1, len(list_filter(e, lambda v: v < f))) AS bin FROM both_ JOIN e USING (date)), a AS (SELECT date, {', '.join(f'avg(r) FILTER (WHERE bin = {i}) AS q{i}' for i in range(1, 6))} FROM b GROUP BY date) SELECT date, {', '.join(f'round(q{i}, 5) AS q{i}' for i in range(1, 6))}, round(q5 - q1, 5) AS spread FROM a",
    "decay_by_horizon": f"{_BASE}, hs AS ({' UNION ALL '.join(f'SELECT {h} AS horizon, date, momentum AS f, {_FWD(h)} AS r FROM df' for h in (1, 2, 4, 8))}), hb AS (SELECT * FROM hs WHERE f IS NOT NULL AND r IS NOT NULL), hr AS (SELECT horizon, date, {_PCT('f', 'horizon, date')} AS pf, {_PCT('r', 'horizon, date')} AS pr FROM hb), ics AS (SELECT horizon, date, CASE WHEN count(*) >= 10 THEN corr(pf, pr) END AS ic FROM hr GROUP BY 1, 2) SELECT horizon, {_SUM} FROM ics GROUP BY horizon",
    "rank_turnover": f"{_BASE}, p AS (SELECT symbol, date, {_PCT('momentum')} AS p FROM df), d AS (SELECT date, abs(p - lag(p) OVER (PARTITION BY symbol ORDER BY date)) AS d FROM p) SELECT date, round(avg(d), 6) AS turnover FROM d GROUP BY date",
    "correlation_of_factors": f"{_BASE}, ds AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM df)) WHERE k % 8 = 0), s AS (SELECT * FROM df WHERE date IN (SELECT date FROM ds) AND momentum IS NOT NULL), l AS ({_LONGF}), p AS (SELECT symbol, date, name, {_PCT('v', 'date, name')} AS p FROM l), c AS (SELECT x.name AS a, y.name AS b, x.date, CASE WHEN stddev_pop(x.p) > 0 AND stddev_pop(y.p) > 0 THEN corr(x.p, y.p) END AS c FROM p x JOIN p y USING (symbol, date) GROUP BY 1, 2, 3 HAVING count(*) >= 10) SELECT a, b, round(avg(coalesce(c, 0)), 3) AS corr FROM c GROUP BY 1, 2",
    "feature_base": f"WITH {sql_bars()}, {_FEAT} SELECT * FROM feat",
    "collinearity": f"{_BASE}, {_collinearity()}",
    "feature_oscillators": f"WITH RECURSIVE {sql_bars('month')}, {_oscillators()} SELECT symbol, date, {', '.join(f'round({c}, 5) AS {c}' for c in OSCILLATORS)} FROM osc",
    "feature_matrix_full": f"WITH RECURSIVE {sql_bars()}, {sql_factors(WEEKLY)}, {_oscillators()}, feat0 AS (WITH {_FEAT} SELECT * FROM feat), fx AS (SELECT feat0.*, {', '.join(f'round(fac.{c}, 5) AS {c}' for c in FACTOR_FEATURES)}, {', '.join(f'round(osc.{c}, 5) AS {c}' for c in OSCILLATORS)} FROM feat0 JOIN fac USING (symbol, date) JOIN osc USING (symbol, date)) SELECT symbol, date, {', '.join(f'coalesce({c}, 0) AS {c}, round(coalesce({_PCT(c)}, 0), 6) AS {c}_rank, ({c} IS NULL)::INT AS {c}_missing, ({c} IS NULL)::INT AS {c}_rank_missing' for c in [*ROLLING, *FACTOR_FEATURES, *OSCILLATORS])} FROM fx",
    "feature_matrix": f"WITH {sql_bars()}, {sql_factors(WEEKLY)}, {_FEAT}, fx AS (SELECT feat.*, {', '.join(f'round(fac.{c}, 5) AS {c}' for c in FACTOR_FEATURES)} FROM feat JOIN fac USING (symbol, date)) SELECT symbol, date, {', '.join(f'coalesce({c}, 0) AS {c}, round(coalesce({_PCT(c)}, 0), 6) AS {c}_rank, ({c} IS NULL)::INT AS {c}_missing, ({c} IS NULL)::INT AS {c}_rank_missing' for c in [*ROLLING, *FACTOR_FEATURES])} FROM fx",
    "cross_sectional_target": f"WITH {sql_bars('month')}, v AS (SELECT * FROM (VALUES {_EV}) v(symbol, date, e)), r1 AS (SELECT symbol, date, ret, e, count(e) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS gone FROM rets LEFT JOIN v USING (symbol, date)), r2 AS (SELECT symbol, date, CASE WHEN gone THEN 0 ELSE coalesce(e, ret) END AS r FROM r1), r3 AS (SELECT symbol, date, round((1 + lead(r, 1) OVER w) * (1 + lead(r, 2) OVER w) * (1 + lead(r, 3) OVER w) - 1, 6) AS fwd_ret FROM r2 WINDOW w AS (PARTITION BY symbol ORDER BY date)), r4 AS (SELECT *, {_PCT('fwd_ret')} AS label FROM r3) SELECT symbol, date, fwd_ret, round(label, 6) AS label, least(floor(label * 10), 9)::BIGINT AS grade FROM r4",
    "purged_folds": f"WITH {sql_bars()}, {_SES} SELECT * FROM folds",
    "training_panel": f"{_BASE}, {_SES}, {_LAB}, r AS (SELECT rebalance_date, split, date, label, count(*) OVER (PARTITION BY rebalance_date, date) AS n FROM lab JOIN folds USING (date) WHERE label IS NOT NULL AND (split = 'validate' OR position % 4 = 0)) SELECT rebalance_date, split, count(*) AS n, count(DISTINCT date) AS dates, round(avg(label), 6) AS label FROM r WHERE n >= 2 GROUP BY 1, 2",
    "validation_spreads": f"{_BASE}, {_LAB}, k AS (SELECT date, fwd_ret, greatest(1, floor(count(*) OVER (PARTITION BY date) / 10)) AS n, row_number() OVER (PARTITION BY date ORDER BY momentum DESC, symbol) AS up, row_number() OVER (PARTITION BY date ORDER BY momentum, symbol) AS down FROM lab WHERE fwd_ret IS NOT NULL) SELECT date, round(avg(fwd_ret) FILTER (WHERE up <= n) - avg(fwd_ret) FILTER (WHERE down <= n) + 1e-9, 6) AS spread FROM k GROUP BY date",
    "validation_skill": f"{_BASE}, {_LAB}, k AS (SELECT label, {_PCT('momentum')} AS s FROM lab) SELECT count(*) AS n, round(sqrt(avg((s - label) ** 2)), 6) AS rmse, round(sqrt(avg((label - 0.5) ** 2)), 6) AS rmse_constant, round(1 - sqrt(avg((s - label) ** 2)) / sqrt(avg((label - 0.5) ** 2)), 6) AS skill FROM k WHERE label IS NOT NULL",
    "ensemble_scores": f"{_BASE}, {_SIDE('momentum', 'a', '')}, {_SIDE('volatility', 'b', _NOT_2)}, j AS (SELECT symbol, date, a.p AS pa, b.p AS pb, coalesce(a.t, false) AND coalesce(b.t, false) AS tops, coalesce(max(a.o) OVER (PARTITION BY date), false) AND coalesce(max(b.o) OVER (PARTITION BY date), false) AS act FROM a FULL JOIN b USING (symbol, date)) SELECT symbol, date, round((0.5 * coalesce(pa, 0.5) + 0.5 * coalesce(pb, 0.5)) * CASE WHEN tops AND act THEN 1.3 ELSE 1 END, 6) AS score, tops AND act AS consensus FROM j",
    "penalized_scores": f"{_BASE}, ds AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM df)) SELECT n.symbol, n.date, round(n.momentum - 0.1 * coalesce(abs(n.momentum - p.momentum), 0), 7) AS score FROM df n JOIN ds ON ds.date = n.date LEFT JOIN df p ON p.symbol = n.symbol AND p.date = ds.prev",
    "penalized_scores_chained": f"{_BASE.replace('WITH ', 'WITH RECURSIVE ', 1)}, sk AS (SELECT symbol, date, dense_rank() OVER (ORDER BY date) AS k, momentum AS s FROM df), pc AS (SELECT symbol, date, k, s FROM sk WHERE k = 1 UNION ALL SELECT sk.symbol, sk.date, sk.k, CASE WHEN pc.s IS NULL THEN sk.s ELSE sk.s - 0.3 * abs(sk.s - pc.s) END FROM pc JOIN sk ON sk.symbol = pc.symbol AND sk.k = pc.k + 1) SELECT symbol, date, round(s, 6) AS score FROM pc",
}
