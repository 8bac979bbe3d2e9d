"""Validation reports, the normal integral, sizes, shortfalls, optional columns and sentiment, against plain Python."""

import datetime as dt
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import features, metrics, portfolio, research, validation


def day(i):
    return dt.date(2020, 1, 1) + dt.timedelta(i)


def backtested(spark, n, names=("a", "b")):
    rng = np.random.default_rng(3)
    rows = [(s, day(i), 100.0 + float(rng.normal()), i % 7 == 0, i % 7 == 3) for s in names for i in range(n)]
    return portfolio.backtest(spark.createDataFrame(rows, "series_id string, ts date, value double, entry boolean, exit boolean"))


def test_normal_cdf(spark):
    zs = [-40.0, -8.0, -7.9, -3.0, -1e-12, 0.0, 0.5, 2.0, 5.0, 7.99, 8.5, None]
    got = [r.p for r in spark.createDataFrame([(i, z) for i, z in enumerate(zs)], "i int, z double").orderBy("i").select(metrics.normal_cdf(F.col("z")).alias("p")).collect()]
    assert got[-1] is None
    assert got[:-1] == pytest.approx([NormalDist().cdf(z) for z in zs[:-1]], abs=1e-14)


def test_loss_probability_without_spread(spark):
    rows = [("flat", 0.0), ("flat", 0.0), ("one", 0.1), ("two", 0.1), ("two", -0.2), ("two", None)]
    got = {r.series_id: r for r in metrics.loss_probability(spark.createDataFrame(rows, "series_id string, ret double"), -0.1, 5).collect()}
    assert got["flat"].probability is None and got["one"].probability is None and got["two"].n == 2
    s = float(np.std([0.1, -0.2], ddof=1))
    assert got["two"].probability == pytest.approx(NormalDist().cdf((-0.1 + 0.25) / (s * 5**0.5)))


def test_report_tells_every_section(spark):
    bt = backtested(spark, 400)
    data = bt.select("series_id", "ts", "value", F.lit(1.0).alias("flat"), F.when(F.col("ts") > F.lit(day(300)), F.col("value")).alias("late"), (F.dayofmonth("ts") == 1).cast("int").alias("label"))
    runs = bt.withColumn("config_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("ret", F.col("ret") * (F.col("config_id") - 1))
    scores = spark.createDataFrame([("a", 3, 1.0, 0.1), ("b", 3, 0.0, 0.1)], "series_id string, n_scores long, cv_mean double, cv_std double")
    rows = validation.report(bt, data, ["value", "flat", "late"], runs=runs, scores=scores).collect()
    got = {(r.series_id, r.metric): r for r in rows}
    assert len(rows) == len(got) == 2 * sum(map(len, validation.SECTIONS.values()))
    assert got["a", "n_constant"].value == 1 and got["a", "n_constant"].verdict == "WARNING"
    assert got["a", "missing_share"].value == pytest.approx(301 / 1200) and got["a", "missing_share"].verdict == "FAIL"
    assert got["a", "minority_share"].verdict == "WARNING"
    assert got["a", "cv_ratio"].value == pytest.approx(0.1) and got["a", "cv_ratio"].verdict == "PASS"
    plain = {r.series_id: r for r in validation.validate(bt, runs=runs, scores=scores).collect()}
    for s in "ab":
        for m in ("psr", "dsr", "pbo", "n_folds", "mean_sharpe", "mean_uniqueness", "n_returns", "cv_ratio"):
            assert got[s, m].value == pytest.approx(plain[s][m])
        assert got[s, "low_weight"].value <= 1 <= got[s, "high_weight"].value
        assert got[s, "n_overlaps"].value == sum(min(7, 399 - i) for i in range(400))


def test_report_of_what_was_not_asked_for(spark):
    got = {r.metric: r for r in validation.report(backtested(spark, 30, ("a",))).collect()}
    for m in ("n_rows", "n_scores", "pbo", "n_folds", "mean_sharpe"):
        assert got[m].value is None and got[m].verdict is None
    assert got["cv_ratio"].value == 0
    assert validation.report(backtested(spark, 1, ("a",)).limit(0)).count() == 0


def test_kelly_sizes_look_back_only(spark):
    rng = np.random.default_rng(5)
    r = [None if i == 50 else float(x) for i, x in enumerate(rng.normal(0.3, 1, 80))]
    rows = [("a", day(i), x) for i, x in enumerate(r)] + [("win", day(i), 1.0) for i in range(20)] + [("loss", day(i), -1.0) for i in range(20)] + [("even", day(i), 0.0) for i in range(20)]
    got = {(x.series_id, x.ts): x.kelly for x in portfolio.kelly_sizes(spark.createDataFrame(rows, "series_id string, ts date, ret double"), 10, 1.0, 0.8).collect()}
    for i in range(80):
        w = r[max(0, i - 10) : i]
        if len(w) < 10 or None in w:
            assert got["a", day(i)] is None
            continue
        up, down = [x for x in w if x > 0], [x for x in w if x <= 0]
        want = 0.0 if not up else 0.8 if not down else len(up) / 10 - (len(down) / 10) / (np.mean(up) / abs(np.mean(down)))
        assert got["a", day(i)] == pytest.approx(min(0.8, max(0.0, want)))
    assert got["win", day(15)] == 0.8 and got["loss", day(15)] == got["even", day(15)] == 0.0


def test_decisions_and_shortfall(spark):
    bt = spark.createDataFrame([("a", day(i), p, v) for i, (p, v) in enumerate([(1, 10.0), (1, 11.0), (0, 12.0), (0, 9.0), (1, 0.0), (1, 5.0), (0, 4.0)])], "series_id string, ts date, position int, value double")
    d = portfolio.decisions(bt)
    assert [tuple(r)[2:] for r in d.orderBy("ts").collect()] == [(1, 10.0, 11.0), (-1, 12.0, 9.0), (1, 0.0, 5.0)]
    got = metrics.shortfall_summary(metrics.shortfall(d)).first()
    assert (got.n, got.share_adverse) == (2, 1.0) and got.mean == pytest.approx((0.1 + 0.25) / 2) and got.worst == 0.25


def test_optional_columns(spark):
    d = spark.createDataFrame([("a", day(0), 2.0), ("a", day(1), 3.0), ("a", day(2), None)], "series_id string, ts date, oas double")
    f = features.optional(features.optional_momentum(features.optional_momentum(d, "oas", [1], -1.0), "vix", [1], 0.5), "oas", "kept", 7.0)
    assert [(r.oas_mom_1, r.vix_mom_1, r.kept) for r in f.orderBy("ts").collect()] == [(-1.0, 0.5, 2.0), (0.5, 0.5, 3.0), (-1.0, 0.5, 7.0)]


def test_sentiment(spark):
    lexicon = spark.createDataFrame([("good", 0.6, 0.5), ("bad", -0.7, 0.9), ("fine", 0.0, 0.1)], "word string, polarity double, subjectivity double")
    texts = {1: "Good, GOOD and bad", 2: "not bad", 3: None, 4: "", 5: "nothing here", 6: "fine " * 5000 + "good", 7: "not not good"}
    t = spark.createDataFrame([(k, dt.datetime(2024, 1, 1 + k // 4), v) for k, v in texts.items()], "id int, ts timestamp, text string")
    scored = research.sentiment(t, lexicon, ["id", "ts"])
    got = {r.id: r for r in scored.collect()}
    assert len(got) == 7 and {k: r.n_scored for k, r in got.items()} == {1: 3, 2: 1, 3: 0, 4: 0, 5: 0, 6: 5001, 7: 1}
    assert {k: round(r.polarity, 6) for k, r in got.items()} == {1: round(0.5 / 3, 6), 2: 0.35, 3: 0.0, 4: 0.0, 5: 0.0, 6: round(0.6 / 5001, 6), 7: -0.3}
    days = {r.day.day: r for r in research.daily_sentiment(scored).collect()}
    assert days[1].n == 3 and days[1].high == pytest.approx(0.35) and days[1].low == 0.0 and days[2].n == 4
