"""Small goldens and invariances of the panel operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions.expressions import rank_share
from tessera.operators import execution as ex
from tessera.operators import factors as fa
from tessera.operators import features as fe
from tessera.operators import performance as pe
from tessera.operators import quality as qu
from tessera.operators import weights as we
from tessera.sources import panel as src

D = dt.date


def panel(spark, closes):
    rows = [(s, "S", D(2024, 1, 1) + dt.timedelta(i), c) for s, cs in closes.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "symbol string, sector string, date date, close double")


def column(df, name, order="date"):
    return [r[name] for r in df.orderBy("symbol", order).collect()]


def test_returns_do_not_bridge_gaps(spark):
    assert column(fa.with_returns(panel(spark, {"A": [100.0, None, 110.0]})), "ret") == [None, None, None]


def test_rank_share_averages_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", None)], "symbol string, x double").withColumn("date", F.lit("2024-01-01"))
    got = {r["symbol"]: r["p"] for r in df.withColumn("p", rank_share("x")).collect()}
    assert got["a"] == pytest.approx(1 / 3) and got["b"] == got["c"] == pytest.approx(2.5 / 3) and got["d"] is None


def test_trend_filter_penalises_during_warm_up(spark):
    n = fa.Lengths(momentum=(1,), skip=0, reversion=2, trend=(1, 2), trend_filter=3, blowoff=2, reversal=1, persistence=3, high=2, contraction=(2, 3), volatility=2)
    got = column(fa.price_factors(panel(spark, {"A": [1.0, 2.0, 3.0, 4.0]}), n), "trend_filter")
    assert got == [0.5, 0.5, 1.0, 1.0]


def test_negative_scores_are_pushed_down(spark):
    df = spark.range(1).select(fa.apply_multiplier(F.lit(2.0), F.lit(0.5)).alias("a"), fa.apply_multiplier(F.lit(-2.0), F.lit(0.5)).alias("b"))
    assert tuple(df.first()) == (1.0, -3.0)


def test_membership_replaces_whole_snapshots(spark):
    u = spark.createDataFrame([(D(2025, 1, 1), "A", True), (D(2025, 1, 1), "B", False), (D(2025, 2, 1), "B", True), (D(2025, 2, 1), "A", False)], "snapshot_date date, symbol string, is_member boolean")
    days = spark.createDataFrame([(D(2024, 12, 31),), (D(2025, 1, 15),), (D(2025, 2, 15),)], "date date")
    assert {(r["date"], r["symbol"]) for r in fa.membership(days, u).collect()} == {(D(2025, 1, 15), "A"), (D(2025, 2, 15), "B")}


def test_universe_rejects_unknown_words(spark):
    with pytest.raises(ValueError):
        src.universe_rows(spark.createDataFrame([("2025-01-01", "A", "tru")], "date string, symbol string, is_member string"))


def test_non_members_do_not_move_scores(spark):
    n = fa.Lengths(momentum=(1, 2), skip=0, reversion=2, trend=(1, 2), trend_filter=2, blowoff=2, reversal=1, persistence=3, high=2, contraction=(2, 3), volatility=2)
    closes = {"A": [1, 2, 3, 5, 4, 6], "B": [3, 2, 4, 4, 5, 7], "C": [2, 2, 3, 3, 4, 4]}
    out = []
    for last in (closes["C"], [9, 1, 8, 2, 7, 3]):
        df = fa.price_factors(panel(spark, {k: [float(x) for x in v] for k, v in (closes | {"C": last}).items()}), n).withColumn("eligible", F.col("symbol") != "C")
        out.append([r["score"] for r in fa.composite(df, {"momentum": 0.6, "high_proximity": 0.4}, eligible="eligible").where("symbol <> 'C'").orderBy("symbol", "date").collect()])
    assert out[0] == pytest.approx(out[1], abs=1e-10)


def test_delisted_forward_return(spark):
    rows = [("A", D(2024, 1, i), 0.01, -1.0 if i == 2 else None) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "symbol string, date date, ret double, e double")
    assert column(fe.forward_return(df, 3, event="e"), "fwd_ret")[0] == pytest.approx(-1.0)


def test_purged_split(spark):
    days = spark.createDataFrame([(D(2000, 1, 1) + dt.timedelta(i),) for i in range(700)], "date date")
    got = fe.purged_splits(days, days.where(F.col("date") == D(2000, 1, 1) + dt.timedelta(650)))
    v = got.where("split = 'validate'").agg(F.min("date"), F.max("date"), F.count("*")).first()
    assert tuple(v) == (D(2000, 1, 1) + dt.timedelta(587), D(2000, 1, 1) + dt.timedelta(628), 42)


def test_twap(spark):
    got = ex.twap(spark.createDataFrame([(1, 5000, 100_000.0)], "id long, quantity long, adv double")).orderBy("slice").collect()
    assert [r["offset"] for r in got] == [0, 450, 900, 1350, 1800] and sum(r["slice_quantity"] for r in got) == 5000


def test_partial_fills_count_by_their_increase(spark):
    rows = [(dt.datetime(2024, 1, 2, 15, i), 7, v) for i, v in enumerate((4000.0, 10000.0, 10000.0))]
    got = ex.daily_totals(spark.createDataFrame(rows, "ts timestamp, order_id long, notional double")).first()
    assert (got["orders"], got["value"]) == (1, 10000.0)


def test_new_york_day(spark):
    got = spark.createDataFrame([(dt.datetime(2026, 7, 15, 1),)], "ts timestamp").select(ex.new_york_date("ts")).first()[0]
    assert got == D(2026, 7, 14)


def test_sold_credit(spark):
    rows = [(1, "A", dt.datetime(2026, 1, 1), "sell", 3.0, 175.40)]
    schema = "id long, symbol string, ts timestamp, side string, quantity double, price double"
    assert ex.sold_credit(spark.createDataFrame(rows, schema), F.lit(25.0)).first()["credit"] == pytest.approx(12628.80)
    covered = [(0, "A", dt.datetime(2025, 12, 1), "buy", 3.0, 100.0), *rows]
    assert sum(r["credit"] for r in ex.sold_credit(spark.createDataFrame(covered, schema), F.lit(25.0)).collect()) == 0


def test_entry_at_next_open(spark):
    rows = [("A", D(2024, 1, i + 1), o, 100.0) for i, o in enumerate((90.0, 50.0, 60.0, 70.0))]
    bars = spark.createDataFrame(rows, "symbol string, date date, open double, close double")
    book = spark.createDataFrame([(D(2024, 1, 1), "A", 1.0)], "date date, symbol string, weight double")
    assert [r["growth"] for r in pe.holding_growth(book, bars).where("NOT over").orderBy("date").collect()] == [2.0, 2.0, 2.0]


def test_delisting_payoff(spark):
    bars = panel(spark, {"A": [10.0, 10.0, 10.0, None]}).select("symbol", "date", "close")
    event = spark.createDataFrame([("A", D(2024, 1, 3), -1.0)], "symbol string, date date, delisting_return double")
    assert column(pe.delisted_prices(bars, event), "close") == [10.0, 10.0, 0.0, 0.0]


def test_bounds_keep_gross(spark):
    rows = [(D(2024, 1, 1), s, "S", w) for s, w in zip("ABCDEFGHIJ", (0.4, 0.2, 0.1, 0.1, 0.05, 0.05, 0.04, 0.03, 0.02, 0.01), strict=True)]
    got = [r["weight"] for r in we.within_bounds(spark.createDataFrame(rows, "date date, symbol string, sector string, weight double"), 0.03, 0.15).collect()]
    assert sum(got) == pytest.approx(1.0) and min(got) >= 0.03 - 1e-12 and max(got) <= 0.15 + 1e-12


def test_calendar_phase_does_not_depend_on_the_span(spark):
    days = spark.createDataFrame([(D(2020, 1, 1) + dt.timedelta(i),) for i in range(2000)], "date date").where(F.weekday("date") < 5)
    long = {r["date"] for r in qu.next_sessions(qu.business_schedule(days), days).collect()}
    late = days.where("date >= DATE'2023-01-01'")
    short = {r["date"] for r in qu.next_sessions(qu.business_schedule(late), late).collect()}
    assert short == {d for d in long if d >= D(2023, 1, 1)} and short


def test_rsi_and_macd_match_pandas(spark):
    import numpy as np
    import pandas as pd

    closes = [float(x) for x in 100 + np.cumsum(np.random.default_rng(0).normal(size=80))]
    s = pd.Series(closes)
    got = fe.macd(fe.wilder_rsi(panel(spark, {"A": closes}))).orderBy("date").toPandas()
    d = s.diff()
    gain, loss = (x.ewm(alpha=1 / 14, min_periods=14, adjust=False).mean() for x in (d.clip(lower=0), -d.clip(upper=0)))
    line = s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
    assert np.allclose(got["rsi"].astype(float), 100 - 100 / (1 + gain / loss), equal_nan=True) and np.allclose(got["macd"], line)


def test_first_row_without_a_return_is_no_downside(spark):
    import numpy as np

    values = [100.0, 101.0, 99.0, 102.0, 98.0]
    rows = [("r", D(2024, 1, i + 1), v, v) for i, v in enumerate(values)]
    got = pe.performance(spark.createDataFrame(rows, "run string, date date, equity double, bench double")).first()
    r = np.diff(values) / values[:-1]
    daily = 1.04 ** (1 / 252) - 1
    down = np.sqrt(np.mean(np.minimum(r - daily, 0) ** 2)) * 252**0.5
    assert got["sortino"] == pytest.approx((r.mean() - daily) * 252 / down)


def test_current_weights_need_every_price(spark):
    held = spark.createDataFrame([("A", 10.0), ("B", 5.0)], "symbol string, held double")
    prices = lambda b: spark.createDataFrame([("A", 2.0), ("B", b)], "symbol string, price double")
    got = {r["symbol"]: r["weight"] for r in ex.current_weights(held, prices(4.0), F.lit(80.0)).collect()}
    assert got == {"A": 0.25, "B": 0.25}
    for bad in (None, 0.0, float("nan")):
        with pytest.raises(ValueError):
            ex.current_weights(held, prices(bad), F.lit(80.0))
    with pytest.raises(ValueError):
        ex.current_weights(held, prices(4.0), F.lit(0.0))


def books(spark, rows):
    return spark.createDataFrame([(D(2024, 1, 1), *r) for r in rows], "date date, symbol string, sector string, weight double")


def test_turnover_cap_blends_and_lets_a_sector_come_down(spark):
    old = books(spark, [("A", "S", 0.5), ("B", "T", 0.5)])
    new = books(spark, [("A", "S", 0.1), ("C", "S", 0.3), ("D", "U", 0.6)])
    plain = {r["symbol"]: r["weight"] for r in we.turnover_capped(old, new, 0.4, 1.0, keys=("date",)).collect()}
    assert plain == pytest.approx({"A": 0.5 - 0.4 / 1.8 * 0.4, "B": 0.5 - 0.5 * 0.4 / 1.8, "C": 0.3 * 0.4 / 1.8, "D": 0.6 * 0.4 / 1.8})
    freed = {r["symbol"]: r["weight"] for r in we.turnover_capped(old, new, 0.4, 1.0, keys=("date",), sector_cap=0.45).collect()}
    assert freed == {"A": 0.1, "C": 0.3, "D": 0.6}


def test_exposures_of_two_factors_match_numpy(spark):
    import numpy as np

    r = np.random.default_rng(3)
    x = r.normal(0, 0.01, (200, 2))
    y = 0.001 + x @ [0.8, -0.3] + r.normal(0, 0.002, 200)
    rows = [("b", D(2020, 1, 1) + dt.timedelta(i), float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(200)]
    got = we.factor_exposures(spark.createDataFrame(rows, "book string, date date, ret double, m double, s double"), ["m", "s"]).collect()
    a = np.column_stack([np.ones(126), x[-126:]])
    beta, rest, _, _ = np.linalg.lstsq(a, y[-126:], rcond=None)
    assert {g["factor"]: g["beta"] for g in got} == pytest.approx({"m": beta[1], "s": beta[2]})
    assert got[0]["residual_vol"] == pytest.approx(np.sqrt(rest[0] / 123 * 252)) and got[0]["alpha"] == pytest.approx(beta[0] * 252)


def test_collinearity_matches_regressions(spark):
    import numpy as np
    from tessera.operators import analysis as an

    r = np.random.default_rng(4)
    x = r.normal(size=(60, 3))
    x[:, 2] += x[:, 0]
    rows = [(f"s{i}", D(2024, 1, 1), *map(float, x[i])) for i in range(60)]
    df = an.variance_inflation(spark.createDataFrame(rows, "symbol string, date date, a double, b double, c double"), ("a", "b", "c"))
    got = {g[1]: g[2] for g in df.select("date", *[c for c in df.columns if c != "date"]).collect()}
    for j, name in enumerate("abc"):
        others = np.column_stack([np.ones(60), np.delete(x, j, 1)])
        rest = x[:, j] - others @ np.linalg.lstsq(others, x[:, j], rcond=None)[0]
        assert got[name] == pytest.approx(((x[:, j] - x[:, j].mean()) ** 2).sum() / (rest**2).sum(), abs=0.006)


def test_shrinkage_fills_gaps_only_without_complete_sessions(spark):
    rows = [(D(2024, 1, 9), D(2024, 1, d), s, v, 9 - d) for d, s, v in ((7, "A", 0.1), (7, "B", None), (8, "A", 0.3), (8, "B", 0.2), (9, "A", None), (9, "B", 0.4))]
    got = {(r["a"], r["b"]): r["cov"] for r in we.covariance(spark.createDataFrame(rows, "book_date date, date date, symbol string, ret double, age int"), "shrunk").collect()}
    assert len(got) == 4 and all(v is not None for v in got.values()) and got["A", "B"] == got["B", "A"]


def test_universe_and_delistings_come_together(spark, tmp_path):
    with pytest.raises(ValueError):
        src.read_bundle(spark, str(tmp_path), None)
    assert src.read_bundle(spark, None, None) is None


def test_text_that_is_no_number_is_null(spark):
    from tessera.functions.expressions import clean

    assert [r[0] for r in spark.createDataFrame([("1.5",), ("n/a",), ("NaN",)], "x string").select(clean("x")).collect()] == [1.5, None, None]


def test_live_gate_prunes_or_raises(spark):
    good = [100.0 + i % 7 for i in range(30)]
    closes = {"A": good, "B": good, "C": [*good[:20], *[None] * 10], "D": good[:28] + [None, None], "MARKET": good}
    gate = lambda c, **k: sorted(r["symbol"] for r in qu.live_gate(panel(spark, c), "MARKET", least=20, missing=0.2, **k).select("symbol").distinct().collect())
    assert gate(closes, breadth=0.5) == ["A", "B", "MARKET"]
    with pytest.raises(ValueError, match="2 of 4"):
        gate(closes, breadth=0.8)
    with pytest.raises(ValueError, match="benchmark fails"):
        gate(closes | {"MARKET": [*good[:28], None, None]}, breadth=0.5)


def test_names_without_a_sector_share_a_bucket(spark):
    book = spark.createDataFrame([("A", 0.5), ("B", 0.3), (None, 0.2)], "symbol string, weight double")
    got = {r["symbol"]: r["sector"] for r in we.with_sector(book, spark.createDataFrame([("A", "S")], "symbol string, sector string")).collect()}
    assert got == {"A": "S", "B": we.UNKNOWN, None: we.UNKNOWN}


def test_drifted_turnover_follows_prices(spark):
    rows = [(D(2024, 1, 1), "A", 0.5), (D(2024, 1, 1), "B", 0.3), (D(2024, 1, 2), "A", 0.5)]
    prices = [(D(2024, 1, d), s, p) for d, s, p in ((1, "A", 10.0), (2, "A", 20.0), (1, "B", 10.0), (2, "B", 10.0))]
    got = pe.drifted_turnover(spark.createDataFrame(rows, "date date, symbol string, weight double"), spark.createDataFrame(prices, "date date, symbol string, price double")).collect()
    # The first book grows from 1 to 1.5: A is 1.0 of it, B 0.3, cash 0.2.
    assert len(got) == 1 and got[0]["turnover"] == pytest.approx((abs(0.5 - 1 / 1.5) + 0.3 / 1.5) / 2)


def bars_of(spark, rows):
    """(symbol, day of January 2024, open, close)."""
    return spark.createDataFrame([(s, D(2024, 1, d), o, c) for s, d, o, c in rows], "symbol string, date date, open double, close double")


def books_of(spark, rows):
    return spark.createDataFrame([(D(2024, 1, d), s, w) for d, s, w in rows], "date date, symbol string, weight double")


def test_a_position_is_carried_to_the_next_execution(spark):
    closes = {1: 10.0, 2: 10.0, 3: 10.0, 4: 20.0, 5: 20.0}
    bars = bars_of(spark, [("A", d, c, c) for d, c in closes.items()])
    got = pe.chained_equity(books_of(spark, [(1, "A", 1.0), (3, "A", 1.0)]), bars, 100.0).orderBy("date")
    assert [r["equity"] for r in got.collect()] == [100.0, 100.0, 100.0, 200.0, 200.0]


def loop_equity(books, bars, start, rates, rate, loss=None):
    """Session after session: the book of an earlier date takes over at this session's execution prices; stops sell at the next one."""
    days = sorted({d for _, d, _, _ in bars})
    names = sorted({s for s, *_ in bars})
    open_, close = {(s, d): (o if o is not None else c) for s, d, o, c in bars}, {}
    for s in names:
        last = None
        for d in days:
            last = next((c for x, y, _, c in bars if (x, y) == (s, d) and c is not None), last)
            close[s, d] = last
    cost_of = lambda t: t * (rates[0] + rates[1]) / 1e4 + t**1.5 * rates[2] / 1e4
    cash, held, waiting, out = start, {}, {}, []
    entry, stops, sold_before = {}, set(), set()
    for i, d in enumerate(days):
        due = [b for b in books if (days[i - 1] if i else -1) <= b < d]
        turnover = cost = 0.0
        mark = lambda s: open_.get((s, d)) or close[s, d]  # noqa: E731, B023
        sold = set()
        if due:
            book = {s: 0.0 if s in stops | sold_before else w for s, w in books[max(due)].items()}
            worth = {s: q * mark(s) for s, q in held.items()} | waiting
            value = cash + sum(worth.values())
            turnover = sum(abs(book.get(s, 0.0) - worth.get(s, 0.0) / value) for s in {*book, *worth})
            cost = cost_of(turnover)
            value *= 1 - cost
            entry = {s: p for s, p in entry.items() if book.get(s, 0.0) > 0 and s not in stops}
            cash, held, stops = value * (1 - sum(book.values())), {}, set()
            waiting = {s: value * w for s, w in book.items() if w > 0}
        else:
            sold = {s for s in stops if open_.get((s, d)) is not None}
            value, gone = cash + sum(q * mark(s) for s, q in held.items()) + sum(waiting.values()), sum(held[s] * mark(s) for s in sold)
            cash += gone - (cost_of(gone / value) * value if sold else 0.0)
            for s in sold:
                del held[s], entry[s]
            stops -= sold
        for s in [s for s in waiting if open_.get((s, d)) is not None]:
            held[s] = waiting.pop(s) / open_[s, d]
            entry.setdefault(s, open_[s, d])
        if loss is not None:
            stops |= {s for s in held if close[s, d] / entry[s] - 1 < -loss}
        if cash < 0:
            cash *= 1 + rate / 252
        sold_before = sold
        out.append((D(2024, 1, d), cash + sum(q * close[s, d] for s, q in held.items()) + sum(waiting.values()), turnover, cost))
    return out


@pytest.mark.parametrize(("loss", "factor"), [(0.03, 1.0), (0.05, 1.5), (5.0, 1.0)])
def test_stops_act_on_the_books(spark, loss, factor):
    import random

    r = random.Random(11)
    rows = []
    for s in "ABCD":
        price = 10.0
        for d in range(1, 31):
            o, price = price * r.uniform(0.93, 1.07), price * r.uniform(0.92, 1.08)
            rows.append((s, d, None if r.random() < 0.2 else o, price))
    books = {2: {"A": 0.3, "B": 0.3, "C": 0.4}, 8: {"A": 0.5, "B": 0.2, "D": 0.3}, 9: {"A": 0.4, "C": 0.6}, 14: {"A": 0.25, "B": 0.25, "C": 0.25, "D": 0.25}, 21: {"B": 0.5, "D": 0.5}}
    books = {d: {s: w * factor for s, w in b.items()} for d, b in books.items()}
    bars = bars_of(spark, rows)
    stopped = pe.stopped_books(books_of(spark, [(d, s, w) for d, b in books.items() for s, w in b.items()]), bars, loss).cache()
    got = pe.net_equity(stopped, bars, 1000.0).orderBy("date").collect()
    for g, w in zip(got, loop_equity(books, rows, 1000.0, (10, 5, 2.5), 0.06, loss), strict=True):
        assert tuple(g)[1:] == pytest.approx(w[1:], rel=1e-9)
    assert (stopped.where("exit IS NOT NULL").count() > 0) == (loss < 1)


def test_a_stopped_name_is_not_bought_back_in_the_same_cycle(spark):
    """Stopped at the close on which the next book is made, or sold at that session's open: the book after that takes it again."""
    closes = {1: 10.0, 2: 10.0, 3: 10.0, 4: 8.0, 5: 8.0, 6: 8.0, 7: 6.0, 8: 6.0, 9: 6.0, 10: 6.0, 11: 6.0}
    bars = bars_of(spark, [("A", d, c, c) for d, c in closes.items()])
    books = {1: 1.0, 4: 1.0, 5: 1.0, 8: 1.0, 9: 1.0}
    got = pe.stopped_books(books_of(spark, [(d, "A", w) for d, w in books.items()]), bars, 0.15)
    # 8 is made on the session on which the stop of 7 is executed.
    assert {r["date"].day: (r["weight"], r["exit"] and r["exit"].day) for r in got.collect()} == {1: (1.0, None), 4: (0.0, None), 5: (1.0, 8), 8: (0.0, None), 9: (1.0, None)}


@pytest.mark.parametrize(("rates", "rate", "factor"), [((0, 0, 0), 0.0, 1.0), ((10, 5, 2.5), 0.06, 1.0), ((100, 50, 2.5), 0.3, 1.6)])
def test_net_equity_equals_a_loop(spark, rates, rate, factor):
    import random

    r = random.Random(4)
    rows = []
    for s in "ABC":
        price = 10.0
        for d in range(1, 25):
            o, price = price * r.uniform(0.9, 1.1), price * r.uniform(0.9, 1.15)
            rows.append((s, d, None if r.random() < 0.2 else o, None if r.random() < 0.1 and d > 1 else price))
    books = {2: {"A": 0.5, "B": 0.4}, 7: {"A": 0.3, "C": 0.7}, 8: {"B": 0.2}, 15: {"A": 0.9, "B": 0.1}, 24: {"C": 1.0}}
    books = {d: {s: w * factor for s, w in b.items()} for d, b in books.items()}
    got = pe.net_equity(books_of(spark, [(d, s, w) for d, b in books.items() for s, w in b.items()]), bars_of(spark, rows), 1000.0, *rates, rate).orderBy("date").collect()
    want = loop_equity(books, rows, 1000.0, rates, rate)
    assert [r["date"] for r in got] == [w[0] for w in want]
    for r_, w in zip(got, want, strict=True):
        assert tuple(r_)[1:] == pytest.approx(w[1:], rel=1e-9)
    if rates[0]:
        assert got[-1]["equity"] < pe.chained_equity(books_of(spark, [(d, s, w) for d, b in books.items() for s, w in b.items()]), bars_of(spark, rows), 1000.0).orderBy("date").collect()[-1]["equity"]


def scaled(spark, weights, variance, leverage, cap=1.0, sector_cap=1.0, sectors=None, periods=252):
    book = books(spark, [(s, (sectors or {}).get(s, s), w) for s, w in weights.items()])
    cov = spark.createDataFrame([(D(2024, 1, 1), a, b, variance if a == b else 0.0) for a in weights for b in weights], "date date, a string, b string, cov double")
    return {r["symbol"]: r["weight"] for r in we.volatility_scaled(book, cov, 0.15, F.lit(leverage), cap, sector_cap, periods).collect()}


def test_leverage_bounds_the_scale_and_limits_follow(spark):
    assert scaled(spark, {"A": 0.4, "B": 0.2}, 1e-8, 1.0) == pytest.approx({"A": 0.4, "B": 0.2})
    assert sum(scaled(spark, {"A": 0.5, "B": 0.5}, 0.10, 0.7).values()) <= 1.0
    low = scaled(spark, dict.fromkeys("ABCDE", 0.2), 0.0001 / 252, 1.5, cap=0.4)
    assert sum(low.values()) == pytest.approx(1.5)
    levered = scaled(spark, {"A": 0.2} | dict.fromkeys("BCDEFGHI", 0.1), 0.0001 / 252, 1.5, cap=0.2)
    assert max(levered.values()) == pytest.approx(0.2) and levered["B"] == pytest.approx(0.15)
    capped = scaled(spark, dict.fromkeys("ABCDE", 0.2), 0.0001 / 252, 1.5, cap=0.4, sector_cap=0.35, sectors={"A": "T", "B": "T"})
    assert capped["A"] + capped["B"] <= 0.35 + 1e-9
    assert sum(scaled(spark, {"A": 0.5, "B": 0.5}, 0.0001 / 252, 0.7).values()) == pytest.approx(0.7)
    # Without a volatility the limits alone hold.
    assert sum(scaled(spark, {"A": 0.5, "B": 0.5}, 0.0, 0.7).values()) == pytest.approx(0.7)


def test_regime_leverage(spark):
    rows = spark.createDataFrame([("low",), ("normal",), ("high",), (None,)], "regime string")
    assert [r[0] for r in rows.select(we.regime_leverage(most=1.2)).collect()] == [1.2, 1.0, 0.7, 1.0]


def test_chained_turnover_equals_a_loop(spark):
    import random

    r = random.Random(9)
    names, sector = "ABCDEFGH", dict(zip("ABCDEFGH", "SSTTUUVV", strict=True))
    targets, rows = [], []
    for d in range(89):
        some = r.sample(names, 4)
        w = [r.random() for _ in some]
        gross = 0.7 if d % 11 == 5 else 1.0
        book = {s: x / sum(w) * gross for s, x in zip(some, w, strict=True)}
        targets.append((book, gross))
        rows += [(k, D(2024, 1, 1) + dt.timedelta(d), s, sector[s], x, gross) for k in ("a", "b") for s, x in book.items()]
    got = we.turnover_chained(spark.createDataFrame(rows, "strategy string, date date, symbol string, sector string, weight double, gross_cap double"), 0.4, 0.6).collect()
    held, want = {}, {}
    for d, (new, top) in enumerate(targets):
        l1 = sum(abs(new.get(s, 0) - held.get(s, 0)) for s in names)
        side = lambda book, x: sum(w for s, w in book.items() if sector[s] == x)
        relief = any(side(held, x) > 0.6 + 1e-9 and side(new, x) <= 0.6 + 1e-9 for x in "STUV")  # noqa: B023
        if not held or l1 <= 0.4 or relief or (sum(held.values()) > top + 1e-9 >= sum(new.values())):
            held = dict(new)
        else:
            held = {s: w for s in names if (w := held.get(s, 0) + 0.4 / l1 * (new.get(s, 0) - held.get(s, 0))) >= 0.0025}
        want |= {("a", D(2024, 1, 1) + dt.timedelta(d), s): w for s, w in held.items()}
    assert {(g["strategy"], g["date"], g["symbol"]): g["weight"] for g in got if g["strategy"] == "a"} == pytest.approx(want)
    assert sum(g["strategy"] == "b" for g in got) == len(want)


def test_chained_penalty_equals_a_loop(spark):
    import random

    r = random.Random(2)
    rows = [(s, D(2024, 1, d), None if r.random() < 0.1 else r.random()) for s in "ABC" for d in range(1, 29) if r.random() < 0.8]
    got = {(g["symbol"], g["date"]): g["score"] for g in fe.turnover_penalty_chained(spark.createDataFrame(rows, "symbol string, date date, score double"), 0.3).collect()}
    before, want = {}, {}
    for d in sorted({d for _, d, _ in rows}):
        now = {s: v for s, e, v in rows if e == d and v is not None}
        before = {s: v - 0.3 * abs(v - before[s]) if s in before else v for s, v in now.items()}
        want |= {(s, d): before.get(s) for s, e, _ in rows if e == d}
    assert got == pytest.approx(want)


def test_cooldown_counts_from_the_last_allowed_attempt(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(i, "A", at(s), "submitted") for i, s in enumerate((0, 200, 400, 600))] + [(10, "B", at(0), "rejected"), (11, "B", at(1), "unknown"), (12, "B", at(2), "filled"), (13, None, at(0), None), (14, "C", at(5), None), (15, "C", at(5), "unknown"), (16, "C", at(6), None)]
    df = spark.createDataFrame(rows, "id long, symbol string, ts timestamp, status string")
    got = {r["id"]: r["allowed"] for r in ex.cooled_down(df, 300).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 10: True, 11: True, 12: False, 14: True, 15: True, 16: False}
    assert ex.cooled_down(df.limit(0), 300).count() == 0


def test_recursive_means_match_pandas(spark):
    import numpy as np
    import pandas as pd

    r = np.random.default_rng(0)
    x = r.normal(size=300)
    x[r.random(300) < 0.2] = np.nan
    x[:3] = np.nan
    rows = [("A", D(2024, 1, 1) + dt.timedelta(i), None if np.isnan(v) else float(v)) for i, v in enumerate(x)] + [("B", D(2024, 1, 1), 2.0), ("C", D(2024, 1, 1), None)]
    df = fe.recursive_means(spark.createDataFrame(rows, "symbol string, date date, x double"), {"slow": ("x", 0.03), "fast": ("x", 0.7)}, block=16)
    got = df.where("symbol = 'A'").orderBy("date").toPandas()
    for name, a in (("slow", 0.03), ("fast", 0.7)):
        assert np.allclose(got[name].astype(float), pd.Series(x).ewm(alpha=a, adjust=False).mean(), equal_nan=True)
    assert {r["symbol"]: r["fast"] for r in df.where("symbol <> 'A'").collect()} == {"B": 2.0, "C": None}


def test_collinearity_of_whole_and_constant_factors(spark):
    from tessera.operators import analysis as an

    rows = [(D(2024, 1, 1), float(i), 2.0 * i + 1, float(i * i % 7), 3.0) for i in range(12)]
    got = {r["factor"]: r["vif"] for r in an.variance_inflation(spark.createDataFrame(rows, "date date, a double, b double, c double, d double"), "abcd").collect()}
    assert got["a"] == got["b"] == float("inf") and got["c"] > 1 and got["d"] is None


def test_shrinkage_below_two_sessions_gives_variances(spark):
    rows = [(D(2024, 1, 9), D(2024, 1, 8), "A", 0.1, 1), (D(2024, 1, 9), D(2024, 1, 8), "B", None, 1), (D(2024, 1, 9), D(2024, 1, 9), "A", None, 0), (D(2024, 1, 9), D(2024, 1, 9), "B", None, 0)]
    got = {(r["a"], r["b"]): r["cov"] for r in we.covariance(spark.createDataFrame(rows, "book_date date, date date, symbol string, ret double, age int"), "shrunk").collect()}
    assert got == {("A", "A"): 0.0, ("A", "B"): 0.0, ("B", "A"): 0.0, ("B", "B"): 0.0}


def test_a_universe_that_starts_late_raises(spark):
    u = spark.createDataFrame([(D(2025, 1, 1), "A", True)], "snapshot_date date, symbol string, is_member boolean")
    days = spark.createDataFrame([(D(2025, 1, 15),)], "date date")
    assert fa.membership(days, u, start=D(2025, 1, 1)).count() == 1
    with pytest.raises(ValueError, match="starts on 2025-01-01"):
        fa.membership(days, u, start=D(2024, 12, 31))


def plain_trees(rows, ident, trees, depth, rate, share, bins):
    """Boosted trees of one group, node by node over lists of rows: (x, y) -> (cuts, predict, importances)."""
    import numpy as np
    from tessera.operators import trees as tr

    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    n, k = x.shape
    cuts = []
    for f in range(k):
        ordered = sorted(x[:, f])
        cuts.append(sorted({ordered[p - 1] for p in range(1, n) if p * bins // n > (p - 1) * bins // n}))
    binned = lambda v: np.array([[sum(c < a for c in cuts[f]) for f, a in enumerate(r)] for r in v])
    b, whole = binned(x), lambda v: float(np.rint(v * 2**32))
    start = sum(map(whole, y)) / n / 2**32
    forest, gains, value = [], [0.0] * k, np.full(n, start)
    for t in range(trees):
        kept = np.flatnonzero(tr.in_sample(np.array(ident, np.int64), t, share))
        rest = {i: whole(y[i] - value[i]) / 2**32 for i in kept}

        def grow(node, level, mean):
            best = None
            for f in range(k):
                for c in range(bins):
                    left, right = [i for i in node if b[i, f] <= c], [i for i in node if b[i, f] > c]
                    if left and right:
                        sl, sr = sum(rest[i] for i in left), sum(rest[i] for i in right)
                        gain = sl**2 / len(left) + sr**2 / len(right)
                        if best is None or gain > best[0] + 1e-12:
                            best = (gain, f, c, left, right, sl / len(left), sr / len(right))
            total = sum(rest[i] for i in node)
            if level == depth:
                return rate * mean
            if best is None or best[0] - (total**2 / len(node) if node else 0) <= 1e-9:
                mean = total / len(node) if node else 0.0
                return grow(node, level + 1, mean) if level + 1 < depth else rate * mean
            gains[best[1]] += best[0] - total**2 / len(node)
            return (best[1], best[2], grow(best[3], level + 1, best[5]), grow(best[4], level + 1, best[6]))

        forest.append(grow(list(kept), 0, 0.0))

        def walk(tree, row):
            while isinstance(tree, tuple):
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            return tree

        value = value + np.array([walk(forest[-1], r) for r in b])
    return lambda v: [start + sum(walk(t, r) for t in forest) for r in binned(v)], gains


def test_forests_equal_plain_trees(spark):
    import numpy as np
    from tessera.operators import trees as tr

    r = np.random.default_rng(5)
    rows = []
    for key in (1, 2):
        for i in range(150):
            x = [float(np.round(r.normal(), 1)), float(r.normal()), float(r.integers(0, 3))]
            rows.append((key, i, D(2024, 1, 1 + i % 5), *x, float(np.tanh(x[0]) + (x[2] > 1) * x[1] + r.normal(0, 0.1))))
    rows += [(3, i, D(2024, 1, 1 + i % 5), 0.0, 0.0, 0.0, 1.0) for i in range(20)] + [(1, 999, D(2024, 1, 1), None, None, None, None)]
    names, options = ["a", "b", "c"], {"trees": 4, "depth": 3}
    df = spark.createDataFrame(rows, "key int, i int, date date, a double, b double, c double, label double")
    forests, cuts = tr.fit_forests(df.repartition(3), names, key="key", ident=("key", "i"), rate=0.3, share=0.7, bins=8, **options)
    assert set(forests) == {1, 2}
    got = {(g["key"], g["i"]): g["margin"] for g in tr.predict_forests(df, forests, cuts, names, key="key", **options).collect()}
    ident = {(g["key"], g["i"]): g["h"] for g in df.select("key", "i", F.xxhash64("key", "i").alias("h")).collect()}
    for key in (1, 2):
        mine = [x for x in rows if x[0] == key and x[6] is not None]
        predict, gains = plain_trees([(x[3:6], x[6]) for x in mine], [ident[key, x[1]] for x in mine], 4, 3, 0.3, 0.7, 8)
        assert [got[key, x[1]] for x in mine] == pytest.approx(predict([x[3:6] for x in mine]), abs=1e-7)
        assert [forests[key].gain[forests[key].feature == f].sum() for f in range(3)] == pytest.approx(gains, rel=1e-6)
        error = np.mean([(got[key, x[1]] - x[6]) ** 2 for x in mine]) / np.var([x[6] for x in mine])
        assert error < 0.4
    # Blocks of other sizes and partitions give the same trees to the last bit.
    again, _ = tr.fit_forests(df.repartition(1), names, key="key", ident=("key", "i"), rate=0.3, share=0.7, bins=8, **options)
    assert all(again[k].packed() == forests[k].packed() for k in forests)
