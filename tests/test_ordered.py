import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions import ordered as o


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    rows = []
    for name in "ab":
        v = 100 + rng.normal(0, 1, 80).cumsum()
        v[rng.random(80) < 0.15] = np.nan
        v[0] = np.nan
        rows += [(name, dt.date(2020, 1, 1) + dt.timedelta(days=int(i * 1.5)), x) for i, x in enumerate(v)]
    return pd.DataFrame(rows, columns=["series_id", "ts", "value"])


@pytest.fixture(scope="module")
def df(spark, frame):
    rows = [(a, b, None if np.isnan(c) else float(c)) for a, b, c in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, "series_id string, ts date, value double")


def check(df, column, frame, expected):
    got = df.withColumn("x", column).orderBy("series_id", "ts").toPandas()["x"].astype(float).to_numpy()
    want = pd.concat([expected(g["value"]) for _, g in frame.groupby("series_id")]).astype(float).to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)


def test_fills(df, frame):
    w = o.series()
    check(df, o.ffill("value", w), frame, lambda v: v.ffill())
    check(df, o.bfill("value", w), frame, lambda v: v.bfill())


def test_linear_interpolation_by_row(df, frame):
    d = df.withColumn("at", F.row_number().over(o.series()))
    check(d, o.interpolate("value", "at", o.series()), frame, lambda v: v.interpolate(method="linear"))


@pytest.mark.parametrize("name", ["mean", "std", "min", "max", "median", "skew", "kurt"])
def test_rolling_needs_a_full_window(df, frame, name):
    w, n = o.series(), 7
    column = {
        "mean": lambda: o.full(F.avg, "value", n, w), "std": lambda: o.full(F.stddev_samp, "value", n, w), "min": lambda: o.full(F.min, "value", n, w), "max": lambda: o.full(F.max, "value", n, w),
        "median": lambda: o.rolling_quantile("value", 0.5, n, w), "skew": lambda: o.rolling_skew("value", n, w), "kurt": lambda: o.rolling_kurtosis("value", n, w),
    }[name]()
    check(df, column, frame, lambda v: getattr(v.rolling(n), name)())


def test_rolling_rank_uses_mean_rank_of_ties(spark):
    d = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate([3, 1, 3, 3])], "series_id string, ts int, value double")
    assert [r.x for r in d.withColumn("x", o.rolling_rank("value", 4, o.series())).orderBy("ts").collect()][-1] == 0.75


def test_ewma(df, frame):
    got = o.ewma(df, [("value", "x", 5)]).orderBy("series_id", "ts").toPandas()["x"].to_numpy()
    want = pd.concat([g["value"].ewm(span=5, adjust=False).mean() for _, g in frame.groupby("series_id")]).to_numpy()
    np.testing.assert_allclose(got, want)


def test_change_of_a_zero_is_null(spark):
    d = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 5.0)], "series_id string, ts int, value double")
    assert d.withColumn("x", o.pct_change("value", 1, o.series())).where("ts = 2").first().x is None


def test_window_needs_a_key():
    with pytest.raises(ValueError, match="partition key"):
        o.series(())


def test_bias_corrected_moments(df, frame):
    got = {r.series_id: (r.s, r.k) for r in df.groupBy("series_id").agg(o.skew("value").alias("s"), o.kurtosis("value").alias("k")).collect()}
    for name, g in frame.groupby("series_id"):
        np.testing.assert_allclose(got[name], (g["value"].skew(), g["value"].kurt()))
