from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import gates
from tidemark.streaming import incremental


def _stream(spark, df, path):
    df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _states(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_ingest_keeps_corrections_and_is_idempotent(spark, tmp_path):
    _states(spark)
    schema = "symbol string, timeframe string, event_time timestamp, close double, volume double"
    t = datetime(2024, 1, 1)
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    now = F.lit(datetime(2024, 2, 1))
    for close in (1.0, 1.0, 2.0):
        s = _stream(spark, spark.createDataFrame([("A", "1d", t, close, 1.0)], schema), src)
        incremental.ingest(s, out, f"{tmp_path}/cp", now).awaitTermination()
    got = sorted((r["revision"], r["close"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, 1.0), (2, 2.0)]


_FETCHED = "symbol string, timeframe string, event_time timestamp, close double, volume double"


def test_ingest_compares_with_its_state_and_not_with_the_table(spark, tmp_path):
    _states(spark)
    t, now = datetime(2024, 1, 1), F.lit(datetime(2024, 2, 1))
    stored = spark.createDataFrame([("A", "1d", t, 9.0, 1.0, 4), ("A", "1d", t, 8.0, 1.0, 3)], _FETCHED + ", revision int")
    batches = [
        [("A", "1d", t, 9.0, 1.0), ("B", "1d", t, 1.0, 1.0), ("B", "1d", datetime(2024, 1, 31, 12), 7.0, 1.0)],  # as stored; new; not closed yet
        [("B", "1d", t, 1.0, 1.0), ("B", "1d", t + timedelta(days=3), 2.0, 1.0)],  # the same again; a later bar
        [("A", "1d", t, 9.5, 1.0), ("B", "1d", t + timedelta(days=3), 2.000000001, 1.0), ("B", "1d", t, 1.0, 2.0)],  # late corrections, of which one is below 8 decimals
    ]
    for k, rows in enumerate(batches):
        s = _stream(spark, spark.createDataFrame(rows, _FETCHED), f"{tmp_path}/in")
        # each batch writes where no earlier one can be read
        incremental.ingest(s, f"{tmp_path}/out{k}", f"{tmp_path}/cp", now, stored).awaitTermination()
    got = [sorted((r["symbol"], r["event_time"].day, r["revision"], r["close"], r["available_at"]) for r in spark.read.parquet(f"{tmp_path}/out{k}").collect()) for k in range(3)]
    closes = lambda day: datetime(2024, 1, day + 1, 0, 5)
    assert got == [[("B", 1, 1, 1.0, closes(1))], [("B", 4, 1, 2.0, closes(4))], [("A", 1, 5, 9.5, datetime(2024, 2, 1)), ("B", 1, 2, 1.0, datetime(2024, 2, 1))]]


def test_a_batch_that_failed_is_written_once(spark, tmp_path):
    _states(spark)
    t, now = datetime(2024, 1, 1), F.lit(datetime(2024, 2, 1))
    fetched = lambda: _stream(spark, spark.createDataFrame([("A", "1d", t + timedelta(days=k), 1.0 + k, 1.0) for k in range(5)], _FETCHED), f"{tmp_path}/in")
    out = f"{tmp_path}/out"

    def fails(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        raise RuntimeError("lost after its rows were written")

    query = incremental.revisions(fetched(), now).writeStream.foreachBatch(fails).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
        raise AssertionError("the batch did not fail")
    except Exception as e:  # noqa: BLE001
        assert "lost after its rows" in str(e)
    incremental.ingest(spark.readStream.schema(_FETCHED).parquet(f"{tmp_path}/in"), out, f"{tmp_path}/cp", now).awaitTermination()
    assert sorted((r["close"], r["revision"], r["batch"]) for r in spark.read.parquet(out).collect()) == [(1.0 + k, 1, 0) for k in range(5)]


def test_days_and_limits_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    import random

    from tidemark.operators import paper

    _states(spark)
    rng, t = random.Random(9), datetime(2024, 1, 1)
    schema = "strategy_id long, id long, side string, price double, qty double, filled_at timestamp"
    fills = [(rng.randrange(4), i, rng.choice(["buy", "sell"]), 5.0 + 60 * rng.random(), 1.0 + rng.randrange(4), t + timedelta(minutes=7 * i)) for i in range(1500)]
    end = [(99, 10_000, "buy", 1.0, 1.0, t + timedelta(days=30)), (98, 10_001, "buy", 1.0, 1.0, t + timedelta(days=31))]  # moves the watermark past all days
    got = []
    for a in range(0, 1500, 500):
        part = fills[a : a + 500] if a else fills[40:500] + fills[:40]
        mixed = rng.sample(part, len(part))
        got += _run(incremental.limits(_stream(spark, spark.createDataFrame(mixed, schema), f"{tmp_path}/fills"), 0.3, 0.05), tmp_path, "days", "append")
    for last in end:
        got += _run(incremental.limits(_stream(spark, spark.createDataFrame([last], schema), f"{tmp_path}/fills"), 0.3, 0.05), tmp_path, "days", "append")
    table = spark.createDataFrame(fills, schema)
    curve = paper.equity_curve(table)
    starts = {(r["strategy_id"], r["day"]): r["day_start"] for r in paper.day_start(curve).collect()}
    known = [r for r in got if r["strategy_id"] < 90]
    assert len(known) == len(fills) and {(r["strategy_id"], r["day"]) for r in known} == set(starts)
    assert all(abs(r["day_start"] - starts[r["strategy_id"], r["day"]]) < 1e-6 for r in known)
    equity = {(r["strategy_id"], r["filled_at"]): r["equity"] for r in curve.collect()}
    assert all(abs(equity[r["strategy_id"], r["filled_at"]] - r["equity"]) < 1e-6 for r in known)
    rows = spark.createDataFrame([(r["id"], r["equity"], r["peak"], r["day_start"]) for r in known], "id long, equity double, peak double, day_start double")
    assert {r["id"]: r["breach"] for r in paper.breaches(rows, 0.3, 0.05).collect()} == {r["id"]: r["breach"] for r in known}
    assert {r["breach"] for r in known} == {None, "DRAWDOWN", "DAILY_LOSS"}


def test_snapshots_are_deduplicated(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("X", t.date(), t.date(), t + timedelta(hours=h)) for h in (0, 1)], "underlying string, quote_date date, expiry date, seen_at timestamp")
    q = incremental.snapshots(_stream(spark, rows, f"{tmp_path}/in")).writeStream.format("memory").queryName("snaps").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("snaps").count() == 1


def test_gate_fold_continues_from_its_state():
    import pandas as pd

    p = pd.DataFrame({"p_value": [0.5, 0.0, 0.9, 0.001, 0.2]})
    whole, *_ = gates.fold(p, [], 0.0, 0)
    a, found, spent, t = gates.fold(p[:2], [], 0.0, 0)
    b, *_ = gates.fold(p[2:], found, spent, t)
    assert whole["alpha_threshold"].tolist() == a["alpha_threshold"].tolist() + b["alpha_threshold"].tolist()


def _run(query, path, name, mode):
    """Runs what is there of a stream; the rows of this run."""
    got = []
    query.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"{path}/cp-{name}").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return got


def test_positions_and_gate_keep_state_between_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t, schema = datetime(2024, 1, 1), "strategy_id long, id long, side string, price double, qty double, filled_at timestamp"
    fills = [(1, 1, "buy", 10.0, 2.0, t), (1, 2, "sell", 20.0, 1.0, t + timedelta(hours=1)), (2, 3, "buy", 5.0, 1.0, t)]
    got = _run(incremental.positions(_stream(spark, spark.createDataFrame(fills, schema), f"{tmp_path}/fills")), tmp_path, "held", "update")
    assert {tuple(r) for r in got} == {(1, 1000.0, 1.0, 1020.0, 1020.0), (2, 995.0, 1.0, 1000.0, 1000.0)}
    more = _stream(spark, spark.createDataFrame([(1, 4, "sell", 5.0, 1.0, t + timedelta(days=1))], schema), f"{tmp_path}/fills")
    assert [tuple(r) for r in _run(incremental.positions(more), tmp_path, "held", "update")] == [(1, 1005.0, 0.0, 1005.0, 1020.0)]
    schema = "stream string, test_index int, config_hash string, p_value double"
    tests = [("s", 1, "a", 0.5), ("s", 2, "b", 0.0), ("s", 3, "a", 0.0), ("s", 4, "c", 0.9)]
    want = {(r["t"], r["config_hash"], round(r["alpha_threshold"], 12), r["discovery"]) for r in gates.gate(spark.createDataFrame(tests, schema)).collect()}
    got = []
    for part in (tests[:2], tests[2:]):
        got += _run(incremental.gate(_stream(spark, spark.createDataFrame(part, schema), f"{tmp_path}/tests")), tmp_path, "ledger", "append")
    assert {(r["t"], r["config_hash"], round(r["alpha_threshold"], 12), r["discovery"]) for r in got} == want
