import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions import ordered as o
from strandline.operators import feature_sets, research, validation
from strandline.sources import readers
from strandline.streaming import events


@pytest.fixture
def tiny_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def series(spark, n=50, names=("a", "b", "c", None), gaps=False):
    rng = np.random.default_rng(4)
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(i), None if gaps and rng.random() < 0.3 else float(rng.normal())) for s in names for i in range(n)]
    return spark.createDataFrame(rows, "series_id string, ts date, value double")


@pytest.mark.parametrize("gaps", [False, True])
def test_ewma_carries_over_batches(spark, tiny_batches, gaps):
    d = series(spark, gaps=gaps)
    got = o.ewma(d, [("value", "e3", 3), ("value", "e9", 9)]).toPandas().sort_values(["series_id", "ts"])
    assert len(got) == 200
    for _, g in got.groupby("series_id", dropna=False):
        for name, span in (("e3", 3), ("e9", 9)):
            want = pd.Series(g["value"].to_numpy(dtype=float)).ewm(span=span, adjust=False).mean()
            assert np.allclose(g[name], want, equal_nan=True)


def test_fold_carries_its_state_over_batches(spark, tiny_batches):
    got = o.fold(series(spark), lambda s, v: ((s[0] + 1, s[1] + v[0]), (s[0] + 1, s[1] + v[0])), (0, 0.0), ["value"], "n long, total double").toPandas()
    for _, g in got.groupby("series_id", dropna=False):
        g = g.sort_values("ts")
        assert list(g["n"]) == list(range(1, 51)) and np.allclose(g["total"], g["value"].cumsum())


def test_a_long_series_goes_through_in_batches(spark):
    d = spark.range(1_000_000).selectExpr("'a' series_id", "id ts", "cast(id % 10 as double) value")
    x = o.ewma(d, [("value", "e", 5)]).agg(F.count("e"), F.max("e")).first()
    assert x[0] == 1_000_000 and x[1] < 9


def test_pareto_keeps_equal_runs_and_drops_beaten_ones(spark):
    rows = [("s", 1, 0.5, -0.2), ("s", 2, 0.5, -0.2), ("s", 3, 0.5, -0.3), ("s", 4, 0.7, -0.3), ("s", 5, 0.6, -0.3), ("s", 6, 0.1, -0.1), ("s", 7, 0.7, -0.4), ("t", 8, 0.0, 0.0)]
    got = {r.run_id for r in research.pareto(spark.createDataFrame(rows, "series_id string, run_id long, total_return double, max_drawdown double")).collect()}
    beaten = {a[1] for a in rows for b in rows if a[0] == b[0] and b[2] >= a[2] and b[3] >= a[3] and (b[2] > a[2] or b[3] > a[3])}
    assert got == {r[1] for r in rows} - beaten == {1, 2, 4, 6, 8}


def calendar(ticker, field, start, end, override):
    """Each ticker has days of its own; overrides shift them."""
    asked.append((ticker, field, override))
    for i in range(3):
        yield dt.date(2024, 1, 1 + i + ord(ticker[0]) - ord("A") + (5 if override else 0)), float(i)


asked: list = []


def test_history_keeps_all_dates_and_aligns_overrides(spark):
    got = {}
    for r in readers.history(spark, {"A|PX": "a", "B|PX": "b", "B|EPS|1BF": "e1", "C|EPS|1BF": "e2", "B|EPS|2BF": "e3"}, "tests.test_streams_folds:calendar").collect():
        got.setdefault(r.series_id, set()).add(r.ts.day)
    assert got == {"a": {1, 2, 3}, "b": {2, 3, 4}, "e1": {7, 8, 9}, "e2": {8, 9}, "e3": {7, 8, 9}}


def test_only_mapped_pairs_are_asked_for():
    r = readers._HistoryReader({"pairs": '[["A", "PX"], ["B", "EPS"]]', "provider": "x:y"})
    assert [(p.ticker, p.field) for p in r.partitions()] == [("A", "PX"), ("B", "EPS")]


def test_overfitting_reaches_the_verdict(spark):
    m = spark.createDataFrame([(0.9, 0.99, 0.0), (0.5, 0.99, 0.0), (None, 0.99, 0.0), (0.1, 0.99, 0.0)], "pbo double, dsr double, cv_ratio double")
    assert [r.status for r in validation.status(m).collect()] == ["FAIL", "WARNING", "PASS", "PASS"]
    rng = np.random.default_rng(42)  # five configurations of 100 days
    rows = [("s", f"config{k}", dt.date(2020, 1, 1) + dt.timedelta(i), float(rng.normal(0, 0.01))) for k in range(5) for i in range(100)]
    runs = spark.createDataFrame(rows, "series_id string, config_id string, ts date, ret double")
    got = validation.overfitting(runs).first().pbo
    halves = pd.DataFrame(rows, columns=["s", "c", "t", "r"]).groupby("c")["r"].apply(lambda x: x[50:].mean() / x[50:].std())
    assert got == (halves < halves.median()).mean()
    bt = spark.createDataFrame([("s", dt.date(2018, 1, 1) + dt.timedelta(i), float(rng.normal(0.001, 0.01)), 100.0 + i) for i in range(500)], "series_id string, ts date, ret double, value double")
    v = validation.validate(bt, runs=runs).first()
    assert v.pbo == got and v.status in ("WARNING", "FAIL") and v.n_returns == 500 and v.long_enough in (True, False)
    assert validation.validate(bt).first().pbo is None


def test_held_signals_sort_a_trigger(spark, tmp_path, tiny_batches):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, i, t0 + dt.timedelta(minutes=i), 10.0 if i % 9 == 0 else 0.0) for i in range(60)]
    d = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, value double")
    d.orderBy(F.desc("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = events.held_signals(events.read_events(spark, f"{tmp_path}/in", d.schema), 5.0, 4)
    got = {r.event_id: r.held for r in events.run_once(stream, "held_sorted", f"{tmp_path}/ck").collect()}
    left, want = 0, {}
    for _, i, _, v in rows:
        want[i] = left > 0 or v > 5
        left = left - 1 if left > 0 else (3 if v > 5 else 0)
    assert got == want


def test_members_and_callables(spark):
    d = series(spark, 60, ("a", "b")).withColumnRenamed("value", "ret")
    c = validation.combinatorial_members(d, 5, 2)
    assert validation.n_splits(5, 2) == 10 == c.select("split").distinct().count() and validation.n_splits(4) == 4
    assert {r.n for r in c.where("role = 'test'").groupBy("series_id", "split").agg(F.count(F.lit(1)).alias("n")).collect()} == {24}
    w = validation.walk_forward_members(d, 20, 10, 5, "rolling").toPandas()
    sizes = w[w.series_id == "a"].groupby(["fold", "role"]).size().unstack()
    assert list(sizes["test"]) == [10] * 7 and list(sizes["train"]) == [20, 25, 30, 35, 40, 40, 40]
    seen = validation.per_fold(validation.walk_forward_members(d, 20, 10, 5, "fixed"), d, lambda tr, te: {"n": len(tr), "after": bool(te["ts"].min() > tr["ts"].max())}, "n long, after boolean").collect()
    assert len(seen) == 14 and all(r.n == 20 and r.after for r in seen)


def test_feature_engineers_can_be_added(spark):
    p = feature_sets.panel(series(spark, 30, ("a", "b")), {"price": "a", "vix": "b"})
    feature_sets.register("mine", lambda p, scale: p.withColumn("x", F.col("price") * scale))
    assert feature_sets.create("mine", p, scale=2.0).where("x = 2 * price").count() == 30
    g = feature_sets.create("genetic", p, asset="price")
    assert g.where("cad_oas_mom4 = 0 and vix_mom4 is not null").count() == 30 and not g.where(" or ".join(f"{c} is null" for c in g.columns)).count()
    with pytest.raises(ValueError):
        feature_sets.create("none", p)
    assert math.isfinite(feature_sets.create("boosting", p, asset="price").agg(F.sum("rsi_14d")).first()[0])


def plain_holds(rows, threshold, hold):
    out, left = {}, {}
    for ts, user, event, value in sorted(rows, key=lambda r: (r[1], r[0], r[2])):
        n = left.get(user, 0)
        starts = n == 0 and value is not None and value > threshold
        out[event] = n > 0 or starts
        left[user] = n - 1 if n > 0 else hold - 1 if starts else 0
    return out


def test_ordered_holds_take_late_events_in_their_place(spark, tmp_path):
    """Two triggers, the second with events older than the first's: the same holds as one batch. Events behind the watermark go."""
    t0, rng = dt.datetime(2024, 1, 1), np.random.default_rng(8)
    rows = [(t0 + dt.timedelta(seconds=int(x)), int(rng.integers(0, 4)), i, None if i % 11 == 0 else float(rng.integers(0, 10))) for i, x in enumerate(rng.permutation(400))]
    rows += [(rows[5][0], rows[5][1], 1000, 9.0)]  # a tie in time
    first, second = [r for r in rows if r[2] % 3], [r for r in rows if not r[2] % 3]
    close = [(t0 + dt.timedelta(hours=5), 99, 2000, 1.0)]  # moves the watermark past all others, a trigger later
    after = [(t0 + dt.timedelta(hours=5, seconds=1), 99, 2001, 1.0)]
    too_late = [(t0 + dt.timedelta(seconds=7), 0, 3000, 9.0)]
    schema, path = "ts timestamp, user_id long, event_id long, value double", str(tmp_path / "in")
    for part in (first, second, close, after, too_late):  # a file, and so a trigger, each
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = events.run_once(events.ordered_holds(stream, 6.0, 3, "1 hour"), "ordered_late", str(tmp_path / "ck"), state_store=events.ROCKSDB)
    got = [(r.event_id, r.held) for r in out.collect()]
    assert len(got) == len(rows)
    assert dict(got) == plain_holds(rows, 6.0, 3)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != events.ROCKSDB


def test_ordered_holds_of_nothing(spark, tmp_path):
    schema = "ts timestamp, user_id long, event_id long, value double"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))
    out = events.run_once(events.ordered_holds(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 1.0, 2), "ordered_none", str(tmp_path / "ck"), state_store=events.ROCKSDB)
    assert out.count() == 0


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_a_streams_rows_stay_with_the_tasks(spark, tmp_path, mode):
    """Nothing of a result is in the driver's memory, over several triggers and when run again with and without more events."""
    t0, schema, path = dt.datetime(2024, 1, 1), "ts timestamp, user_id long, event_id long, event_type string, value double", str(tmp_path / "in")
    rows = [(t0 + dt.timedelta(hours=i), i % 3, i, "a", float(i % 7)) for i in range(90)]
    name, ck = f"stay_{mode}", str(tmp_path / "ck")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        result = events.held_signals(stream, 5.0, 2) if mode == "append" else events.windowed_bars(stream, "1 day").drop("total", "high", "low", "open", "close")
        return events.run_once(result, name, ck, mode)

    def want(seen):
        n = len(seen)
        return n if mode == "append" else {d: sum(r[0].date() == d for r in seen) for d in {r[0].date() for r in seen}}

    def got(out):
        return len({r.event_id for r in out.collect()}) if mode == "append" else {r.start.date(): r.n for r in out.withColumn("start", F.col("start").cast("date").cast("timestamp")).collect()}

    for part in (rows[:30], rows[30:60]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    out = run()
    assert "MemoryPlan" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.inputFiles() and all(f"{ck}-rows" in f for f in out.inputFiles())
    assert got(out) == want(rows[:60]) and spark.table(name).count() == out.count()
    assert got(run()) == want(rows[:60])
    spark.createDataFrame(rows[60:], schema).coalesce(1).write.mode("append").parquet(path)
    out = run()
    assert got(out) == want(rows) and (mode == "complete" or out.count() == 90)


def test_run_once_refuses_other_modes(spark, tmp_path):
    with pytest.raises(ValueError):
        events.run_once(spark.range(1), "none", str(tmp_path / "ck"), "update")


def test_ordered_holds_rows_stay_with_the_tasks(spark, tmp_path):
    """Users with several Arrow batches of events; the result is files, none of it in the driver's memory."""
    t0, schema, path = dt.datetime(2024, 1, 1), "ts timestamp, user_id long, event_id long, value double", str(tmp_path / "in")
    rows = [(t0 + dt.timedelta(seconds=(i * 37) % 100), i % 2, i, None if i % 13 == 0 else float(i % 10)) for i in range(100)]
    close = [(t0 + dt.timedelta(hours=5), 9, 500, 1.0)]
    spark.createDataFrame(rows + close, schema).coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        stream = events.ordered_holds(spark.readStream.schema(schema).parquet(path), 6.0, 3, "1 hour")
        out = events.run_once(stream, "ordered_stay", str(tmp_path / "ck"), state_store=events.ROCKSDB)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "MemoryPlan" not in out._jdf.queryExecution().optimizedPlan().toString() and out.inputFiles()
    got = [(r.event_id, r.held) for r in out.collect()]
    assert len(got) == 100 and dict(got) == plain_holds(rows, 6.0, 3)
