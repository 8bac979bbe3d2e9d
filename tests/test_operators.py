import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import ordered as o
from strandline.operators import align, bars, features, genetic, indices, learn, metrics, portfolio, quality, select, signals, validation

D0 = dt.date(2020, 1, 1)


def long(spark, values, name="a", start=D0):
    return spark.createDataFrame([(name, start + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)], "series_id string, ts date, value double")


def values(df, column="value"):
    return [r[column] for r in df.orderBy("series_id", "ts").collect()]


def test_fill_vector(spark):
    d = long(spark, [1, None, None, 3, None])
    assert values(quality.fill(d, "ffill")) == [1, 1, 1, 3, 3]
    assert values(quality.fill(d, "bfill")) == [1, 3, 3, 3, None]
    assert values(quality.fill(d, "constant", 999.0)) == [1, 999, 999, 3, 999]
    assert values(quality.fill(d, "linear")) == pytest.approx([1, 5 / 3, 7 / 3, 3, 3])
    assert quality.fill(d, "drop").count() == 2


def test_leading_nulls_stay(spark):
    d = long(spark, [None, 1, None, 3, None])
    assert values(quality.fill(d, "linear")) == [None, 1, 2, 3, 3]
    assert values(quality.fill(d, "bfill_after_first")) == [None, 1, 3, 3, None]
    assert values(quality.fill(d, "zero_after_ffill")) == [0, 1, 1, 3, 3]


def test_outliers(spark):
    d = long(spark, [1, 2, 3, 100, 5, 6, 7])
    assert [bool(x) for x in values(quality.outliers(d), "is_outlier")] == [False] * 3 + [True] + [False] * 3
    assert quality.outliers(d, "remove").count() == 6
    assert max(values(quality.outliers(d, "clip"))) < 100
    z = long(spark, [1, 2, 3, 4, 5, 100])
    assert values(quality.outliers(z, "flag", "z", 2.0), "is_outlier")[-1]


def test_outlier_in_two_series_removes_the_date_once(spark):
    d = align.merge(long(spark, [1, 2, 3, 100, 5, 6, 7]), long(spark, [1, 2, 3, -100, 5, 6, 7], "b"))
    assert quality.outliers(d, "remove").count() == 12


def test_gaps(spark):
    d = long(spark, [1, 2, 3, 4, 5]).where(F.col("ts") != D0 + dt.timedelta(days=2))
    assert [(r.ts, r.days) for r in quality.gaps(d, 1).collect()] == [(D0 + dt.timedelta(days=3), 2)]


def test_clip_keeps_nulls(spark):
    d = long(spark, [None, 1, 9]).withColumn("value", quality.clip(F.col("value"), 2.0, 5.0))
    assert values(d) == [None, 2, 5]


def test_price_validity(spark):
    d = align.merge(long(spark, [1, 2], "ok"), long(spark, [None, None], "none"), long(spark, [-1, -2], "neg"), long(spark, [1, float("inf")], "inf"))
    assert {r.series_id: r.is_valid for r in quality.price_validity(d).collect()} == {"ok": True, "none": False, "neg": False, "inf": False}


def test_empty_include_is_ignored(spark):
    d, meta = long(spark, [1]), spark.createDataFrame([("a", "x", 0)], "series_id string, asset_class string, ordinal int")
    assert select.by_class(d, meta, include=["nope"]).count() == 1
    assert select.by_class(d, meta, exclude=["x"]).count() == 1


def test_rules_are_parsed_not_evaluated(spark):
    d = spark.createDataFrame([(1.0, None), (3.0, 2.0)], "x double, y double")
    assert [r.v for r in d.select(select.rule("(x > 2) & (y <= 2.0)").alias("v")).collect()] == [False, True]
    for bad in ("__import__('os')", "(x > 1) & (y > 2) | (x > 3)", "x > y"):
        with pytest.raises(ValueError):
            select.parse_rule(bad)


def test_asof_ties_and_misses(spark):
    left = long(spark, [0, 0, 0, 0])
    right = spark.createDataFrame([("a", D0 + dt.timedelta(days=1), 7.0)], "series_id string, ts date, value double")
    assert values(align.asof(left, right), "matched") == [None, 7, 7, 7]
    assert values(align.asof(left, right, direction="forward"), "matched") == [7, 7, None, None]


def test_resample_weeks_end_on_friday_and_fill(spark):
    d = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0), ("a", dt.date(2024, 1, 16), 2.0)], "series_id string, ts date, value double")
    got = align.resample(d, "W").orderBy("ts").collect()
    assert [(r.ts, r.value) for r in got] == [(dt.date(2024, 1, 5), 1), (dt.date(2024, 1, 12), 1), (dt.date(2024, 1, 19), 2)]


def test_running_sum_in_buckets(spark):
    d = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    got = align.cumulative_over_all(d, "k", "v", 5).orderBy("k").toPandas()
    assert (got["running"].to_numpy() == np.cumsum(np.arange(1000) % 7)).all()


def test_overlap_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    a, b = ([("s", int(x), int(x + rng.integers(0, 6))) for x in rng.integers(0, 200, n)] for n in (60, 15))
    fa, fb = (spark.createDataFrame(x, "series_id string, t0 int, t1 int") for x in (a, b))
    want = sorted(x for x in a if any(x[1] <= y[2] and y[1] <= x[2] for y in b))
    assert sorted(map(tuple, align.overlapping(fa, fb).collect())) == want
    assert align.overlapping(fa, fb, anti=True).count() == len(a) - len(want)


def test_rsi_bounds(spark):
    up, flat = long(spark, range(1, 40)), long(spark, [5] * 40)
    assert values(features.rsi(up), "rsi")[-1] == 100
    assert values(features.rsi(flat), "rsi")[-1] is None


def test_indices_start_at_base(spark):
    assert values(indices.levered(long(spark, [100, 101, 102])), "index")[0] == 100
    d = spark.createDataFrame([("a", dt.date(2020, 6, 1), 5.0), ("a", dt.date(2020, 12, 31), 10.0), ("a", dt.date(2021, 6, 1), 10.0)], "series_id string, ts date, value double")
    assert values(indices.from_ytd(d), "index") == pytest.approx([105, 110, 121])


def test_greedy_hold_skips_signals_inside(spark):
    d = spark.createDataFrame([("a", i, x) for i, x in enumerate([0, 1, 0, 1, 0, 1, 0, 0, 1])], "series_id string, ts int, sig int")
    assert values(signals.hold_greedy(d, "sig", 3), "held") == [0, 1, 1, 1, 0, 1, 1, 1, 1]


def test_no_signal_is_flat(spark):
    d = long(spark, range(1, 30)).withColumns({"entry": F.lit(False), "exit": F.lit(False)})
    b = portfolio.backtest(d, fee=0.01)
    assert set(values(b, "equity")) == {100.0}
    assert portfolio.summary(b).first().sharpe == 0


def test_backtest_matches_a_loop(spark):
    rng = np.random.default_rng(1)
    p, cap, fee = 100 * np.cumprod(1 + rng.normal(0, 0.01, 60)), 100.0, 0.002
    entry, exit_ = np.zeros(60, bool), np.zeros(60, bool)
    entry[[5, 6, 30]], exit_[[10, 20, 45]] = True, True
    cash, shares, want = cap, 0.0, []
    for i in range(60):
        if entry[i] and not shares:
            shares, cash = cash / p[i] * (1 - fee), 0.0
        elif exit_[i] and shares:
            cash, shares = shares * p[i] * (1 - fee), 0.0
        want.append(cash + shares * p[i])
    rows = [("a", D0 + dt.timedelta(days=i), float(p[i]), bool(entry[i]), bool(exit_[i])) for i in range(60)]
    b = portfolio.backtest(spark.createDataFrame(rows, "series_id string, ts date, value double, entry boolean, exit boolean"), fee=fee)
    assert values(b, "equity") == pytest.approx(want)
    assert max(values(b, "sides")) == 4
    assert portfolio.trades(b).count() == 2


def test_fold_counts():
    assert len(portfolio.folds(5834, 252, 63, 21, include_last=True)) == 263


@pytest.fixture(scope="module")
def days(spark):
    return spark.range(5834).select(F.lit("a").alias("series_id"), F.expr("date_add(date'2003-01-01', cast(id as int))").alias("ts"), F.lit(1.0).alias("value"))


def test_published_label_figures(spark, days):
    iv = validation.intervals(days, 7)
    assert validation.overlap_count(iv).first().pairs == 40_810
    u = validation.weights(validation.uniqueness(iv))
    r = u.agg(F.avg("uniqueness"), F.min("uniqueness"), F.max("weight"), F.avg("weight")).first()
    assert tuple(round(x, 4) for x in r[:2]) == (0.1251, 0.1250)
    assert round(r[2], 4) == 2.7162 and r[3] == pytest.approx(1)


def test_combinatorial_splits(spark):
    d = long(spark, range(100))
    got = validation.combinatorial_folds(d, mode="reference").collect()
    assert len(got) == 10 and sum(r.n_train == 0 for r in got) == 4
    assert all(r.n_train > 0 for r in validation.combinatorial_folds(d).collect())


def test_purged_folds_are_disjoint(spark):
    d = long(spark, range(100))
    f = validation.purge(validation.intervals(d, 7), validation.purged_folds(d))
    n = f.groupBy("fold", "role").count().toPandas().pivot(index="fold", columns="role", values="count")
    assert (n["test"] == 20).all() and n["purged"].sum() > 0


def test_pbo_of_five(spark):
    rng = np.random.default_rng(42)
    rows = [(f"c{j}", D0 + dt.timedelta(days=i), float(x)) for j in range(5) for i, x in enumerate(rng.normal(0, 0.01, 100))]
    assert validation.pbo(spark.createDataFrame(rows, "config_id string, ts date, ret double")).first().pbo == pytest.approx(0.4)


def test_ratio_formulas():
    assert metrics.probabilistic_sharpe(0.0, 100, 0.0, 3.0) == pytest.approx(0.5)
    assert metrics.min_backtest_length(2.0, 5834) == 5834
    assert 0 <= metrics.deflated_sharpe(0.5, 100, 0, 3, 10) <= 1


def test_weekly_artefact_metrics(spark):
    rets = [0.01, -0.02, 0.03, 0.0, 0.01]
    r = metrics.performance(spark.createDataFrame([("a", D0 + dt.timedelta(days=7 * i), x) for i, x in enumerate(rets)], "series_id string, ts date, ret double"), af=52).first()
    assert r.total_return == pytest.approx(np.prod([1 + x for x in rets]) - 1)
    assert r.sharpe == pytest.approx(np.mean(rets) / np.std(rets, ddof=1) * 52**0.5)


def test_simulation_repeats(spark):
    r = spark.createDataFrame([("a", D0 + dt.timedelta(days=i), 0.01 * (-1) ** i) for i in range(30)], "series_id string, ts date, ret double")
    a, b = (validation.synthetic_paths(x, 3, 10, m).orderBy("sim", "step").toPandas() for m in ("normal",) for x in (r, r.repartition(3)))
    assert np.allclose(a[["ret", "value"]], b[["ret", "value"]], rtol=1e-12) and a["sim"].equals(b["sim"])
    with pytest.raises(ValueError):
        validation.synthetic_paths(r, 1, 1, "garch")


def test_cusum_and_weights(spark):
    assert bars.frac_weights(1.0, 3) == [1.0, -1.0, -0.0] or bars.frac_weights(1.0, 3)[:2] == [1.0, -1.0]
    assert values(bars.cusum(long(spark, [100, 110, 121, 110, 90]), 0.15), "event") == [0, 0, 1, 0, -1]


def test_threshold_sweep_prefers_first_on_ties(spark):
    rows = [("a", D0 + dt.timedelta(days=i), 0.9, 0.01) for i in range(10)]
    t = learn.threshold_sweep(spark.createDataFrame(rows, "series_id string, ts date, p double, ret double"))
    assert t.where("best").first().step == 0


def test_search_repeats_and_stays_within_features(spark):
    a, b = (genetic.Search({"x": [0.1, 0.2]}, seed=5) for _ in range(2))
    r = [a.rule() for _ in range(20)]
    assert r == [b.rule() for _ in range(20)]
    assert all(select.parse_rule(genetic.text_of(x)) for x in r)


def test_fold_needs_order_only_within_series(spark):
    d = spark.createDataFrame([("a", 2, 1), ("b", 1, 5), ("a", 1, 2)], "series_id string, ts int, v int")
    out = o.fold(d, lambda st, x: ((st[0] + x[0],), (st[0] + x[0],)), (0,), ["v"], "t int")
    assert values(out, "t") == [2, 3, 5]


def test_leaking_names():
    assert learn.leaking_names(["mom_5", "fwd_ret", "x.shift(-1)"]) == ["fwd_ret", "x.shift(-1)"]
