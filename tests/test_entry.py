"""The driver's contract, and a few registered queries against their SQL."""

import datetime
import tempfile

import duckdb
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    plain = lambda v: f"{v:.5f}" if isinstance(v, float) else str(v)
    got = sorted(tuple(plain(r[c]) for c in names) for r in rows.collect())
    assert got == sorted(tuple(plain(v) for v in r) for r in want.fetchall())


@pytest.mark.parametrize("name", ["walk_forward_scores", "model_importances"])
def test_walk_forward_fits_every_rebalance_date(spark, name):
    from tessera.plans import analysis_queries as aq

    rows = entry.queries()[name](spark, SF)
    want = {r[0] for r in aq.purged_folds(spark, SF).select("rebalance_date").distinct().collect()}
    assert len(want) > 2 and {r[0] for r in rows.select("date").distinct().collect()} == want
    if name == "walk_forward_scores":
        assert rows.where("margin IS NULL OR score IS NULL").count() == 0 and rows.select(F.count_distinct("margin")).first()[0] > 20


@pytest.mark.parametrize("weights", [[0.079965, 0.119978, 0.05839, 0.112017], [0.112017, 0.05839, 0.119978, 0.079965]])
def test_halves_in_book_risk_do_not_go_by_the_order_of_rows(spark, monkeypatch, weights):
    from tessera.plans import weight_queries as wq

    day = datetime.date(2024, 1, 1)
    # Rows of one partition are summed in their order; exactly they have 0.37035 together.
    book = spark.createDataFrame([(day, f"s{i}", "x", w) for i, w in enumerate(weights)], "date date, symbol string, sector string, weight double").coalesce(1)
    samples = book.select(F.col("date").alias("book_date"), "date", "symbol", F.lit(0.01).alias("ret"), F.lit(0).alias("age"))
    monkeypatch.setattr(wq, "_book", lambda *_: book)
    monkeypatch.setattr(wq, "_samples", lambda *_: samples)
    assert [r["top_sector"] for r in wq.book_risk(spark, SF).collect()] == [0.3704]


def test_folds_read_the_deals_once(spark):
    from tessera.plans import analysis_queries as aq

    # What is left after the sessions were stored reads no deals at all.
    assert not any("lineitem" in f for f in aq.purged_folds(spark, SF).inputFiles())


def run_stream(spark, rows, schema, build, mode):
    """What build() makes of rows that come in one file after another."""
    base = tempfile.mkdtemp(prefix="spark-")
    for some in rows:
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    got = []
    keep = lambda df, _: (got.clear() if mode == "complete" else None, got.extend(df.collect()))
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"))
    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return got


def test_loss_of_a_new_york_day_counts_across_midnight_utc(spark):
    from tessera.streaming import rules

    at = lambda day, hour: datetime.datetime(2024, 1, day, hour, tzinfo=datetime.UTC)
    got = run_stream(spark, [[(at(3, 23), -60.0)], [(at(4, 1), -60.0), (at(4, 6), -60.0)]], "ts timestamp, value double", lambda s: rules.loss_flags(s, 100.0), "complete")
    assert sorted((str(r["day"]), r["n"], r["value"], r["stopped"]) for r in got) == [("2024-01-03", 2, -120.0, True), ("2024-01-04", 1, -60.0, False)]


def test_cooldown_holds_across_windows_and_batches(spark):
    from tessera.streaming import rules

    at = lambda s: datetime.datetime.fromtimestamp(1_704_300_000 + s, datetime.UTC)
    rows = [[("a", at(298), "submitted", 1), ("a", at(302), "submitted", 2), ("b", at(302), "unknown", 3), ("c", at(302), "filled", 4)], [("a", at(597), "unknown", 5), ("a", at(598), "unknown", 6), ("b", at(601), "unknown", 7), ("c", at(303), None, 8)]]
    got = run_stream(spark, rows, "symbol string, ts timestamp, status string, id long", lambda s: rules.first_attempts(s).select("symbol", F.unix_seconds("ts").alias("s")), "append")
    assert sorted((r["symbol"], r["s"] - 1_704_300_000) for r in got) == [("a", 298), ("a", 598), ("b", 302), ("c", 302), ("c", 303)]


def test_late_rows_of_a_past_day_are_dropped(spark):
    from tessera.streaming import rules

    at = lambda day, hour: datetime.datetime(2024, 1, day, hour, tzinfo=datetime.UTC)
    # Two batches after the watermark has passed a day its late rows are dropped.
    rows = [[(at(3, 20), 5.0)], [(at(5, 18), 1.0)], [(at(5, 20), 1.0)], [(at(3, 21), 100.0), (at(5, 21), 2.0)]]
    got = run_stream(spark, rows, "ts timestamp, value double", lambda s: rules.daily_totals(s), "update")
    last = {str(r["day"]): (r["n"], r["value"]) for r in got}
    assert last == {"2024-01-03": (1, 5.0), "2024-01-05": (3, 4.0)}


def test_order_increases_of_late_and_repeated_fills(spark):
    from tessera.operators import execution as ex
    from tessera.streaming import rules

    at = lambda day, hour: datetime.datetime(2024, 1, day, hour, tzinfo=datetime.UTC)
    rows = [[(at(3, 20), 7, 4000.0), (at(3, 21), 7, 10000.0), (at(3, 21), 8, 0.0)], [(at(3, 21), 7, 10000.0), (at(3, 19), 7, 9000.0), (at(3, 22), 9, 5.0)], [(at(4, 20), 7, 3.0)], [(at(3, 20), 9, 8.0)]]
    schema = "ts timestamp, order_id long, notional double"
    got = run_stream(spark, rows, schema, lambda s: rules.order_increases(s, late="3 days"), "append")
    want = {r["day"]: (r["orders"], r["value"]) for r in ex.daily_totals(spark.createDataFrame([x for some in rows for x in some], schema)).collect()}
    for day, (orders, value) in want.items():
        mine = [r for r in got if r["day"] == day]
        assert len({r["order_id"] for r in mine}) == orders and sum(r["increase"] for r in mine) == value
    assert sorted(r["increase"] for r in got) == [0.0, 3.0, 3.0, 5.0, 10000.0]
    # A day that the watermark has passed takes no more rows.
    gone = run_stream(spark, [[(at(3, 20), 7, 4.0)], [(at(9, 20), 7, 1.0)], [(at(9, 21), 7, 2.0)], [(at(3, 21), 7, 100.0)]], schema, lambda s: rules.order_increases(s), "append")
    assert sorted((str(r["day"]), r["increase"]) for r in gone) == [("2024-01-03", 4.0), ("2024-01-09", 1.0), ("2024-01-09", 1.0)]


def test_states_of_order_increases_do_not_grow_with_orders(spark):
    from tessera.operators import execution as ex
    from tessera.streaming import rules

    base, schema = tempfile.mkdtemp(prefix="spark-"), "ts timestamp, order_id long, notional double"
    at = lambda hour: datetime.datetime(2024, 1, 3, hour, tzinfo=datetime.UTC)
    rows = [[(at(20), i, float(i % 7)) for i in range(2000)], [(at(21), i, float(i % 11)) for i in range(1000, 3000)]]
    for some in rows:
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    out, got = rules.order_increases(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"), late="3 days"), []
    stream = out.writeStream.outputMode("append").foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in stream.recentProgress) <= 256
    (want,) = ex.daily_totals(spark.createDataFrame(rows[0] + rows[1], schema)).collect()
    assert (len({r["order_id"] for r in got}), sum(r["increase"] for r in got)) == (want["orders"], want["value"])
