"""Missing data, outliers, gaps, bad points and data-quality reports over long tables (series_id, ts, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ordered as o

W = o.series
KEY = ("series_id",)


def fill(df: DataFrame, how: str, value: float | None = None) -> DataFrame:
    """value filled: ffill, bfill, bfill_after_first, linear (by row), time (by day), constant, zero_after_ffill, or drop."""
    if how == "drop":
        return df.na.drop("any")
    if how == "constant":
        return df.na.fill({"value": value})
    if how == "linear":
        df = df.withColumn("_at", F.row_number().over(W()))
        return df.withColumn("value", o.interpolate("value", "_at", W())).drop("_at")
    if how == "time":
        return df.withColumn("value", o.interpolate("value", F.datediff("ts", F.lit("1970-01-01").cast("date")), W()))
    if how == "zero_after_ffill":
        return df.withColumn("value", F.coalesce(o.ffill("value", W()), F.lit(0.0)))
    return df.withColumn("value", {"ffill": o.ffill, "bfill": o.bfill, "bfill_after_first": o.bfill_after_first}[how]("value", W()))


def bounds(df: DataFrame, method: str = "iqr", threshold: float = 3.0) -> DataFrame:
    """(series_id, low, high) beyond which a value is an outlier: 1.5 interquartile ranges around the quartiles (series
    without range: none), or ``threshold`` sample deviations around the mean."""
    if method == "iqr":
        q = df.groupBy(*KEY).agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
        q = q.select(*KEY, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")).where("q3 > q1")
        return q.select(*KEY, (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("high"))
    z = df.groupBy(*KEY).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return z.select(*KEY, (F.col("m") - threshold * F.col("s")).alias("low"), (F.col("m") + threshold * F.col("s")).alias("high"))


def outliers(df: DataFrame, action: str = "flag", method: str = "iqr", threshold: float = 3.0) -> DataFrame:
    """flag: adds is_outlier; clip: to the bounds; remove: drops every date on which any series has one."""
    j = df.join(bounds(df, method, threshold), list(KEY), "left")
    out = F.coalesce((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")), F.lit(False))
    if action == "flag":
        return j.withColumn("is_outlier", out).drop("low", "high")
    if action == "clip":
        return j.withColumn("value", clip(F.col("value"), F.col("low"), F.col("high"))).drop("low", "high")
    return df.join(j.where(out).select("ts").distinct(), "ts", "left_anti").select(*df.columns)


def clip(x, low=None, high=None):
    """x within the bounds; null stays null, a null bound doesn't bind."""
    low = None if low is None else F.lit(low) if not hasattr(low, "alias") else low
    high = None if high is None else F.lit(high) if not hasattr(high, "alias") else high
    if low is not None:
        x = F.when(x.isNotNull(), F.greatest(x, low))
    if high is not None:
        x = F.when(x.isNotNull(), F.least(x, high))
    return x


def gaps(df: DataFrame, max_days: int) -> DataFrame:
    """Observations more than max_days after the series' one before: series_id, ts, days."""
    have = df.where("value is not null")
    return have.withColumn("days", F.datediff("ts", F.lag("ts").over(W()))).where(F.col("days") > max_days).select(*KEY, "ts", "days")


def repair(df: DataFrame, points: DataFrame) -> DataFrame:
    """Bad points (series_id, ts, action) repaired. use_previous: the value of the row before; interpolate: by time
    between the neighbours; forward_fill: nulls of the whole series filled forward, the point's value dropped."""
    p = points.select(*KEY, "ts", "action")
    j = df.join(p, [*KEY, "ts"], "left")
    j = j.withColumn("_clean", F.when(F.col("action").isNull(), F.col("value")))
    carry = F.max(F.when(F.col("action") == "forward_fill", 1)).over(o.Window.partitionBy(*KEY))
    day = F.datediff("ts", F.lit("1970-01-01").cast("date"))
    value = (
        F.when(F.col("action") == "use_previous", F.lag("value").over(W()))
        .when(F.col("action") == "interpolate", o.interpolate("_clean", day, W()))
        .when(carry == 1, o.ffill("_clean", W()))
        .otherwise(F.col("value"))
    )
    return j.withColumn("value", value).select(*df.columns)


def price_validity(df: DataFrame) -> DataFrame:
    """Per series: whether it has values, any above zero, and none infinite."""
    ok = (F.count("value") > 0) & F.bool_or(F.col("value") > 0) & F.bool_and(F.abs("value") < float("inf"))
    return df.groupBy(*KEY).agg(F.coalesce(ok, F.lit(False)).alias("is_valid"))


def completeness(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_missing"), (F.count("value") / F.count(F.lit(1))).alias("completeness"))


def missing_by_class(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Missing values per asset class; series without a class are 'other'."""
    j = df.join(meta, "series_id", "left").withColumn("asset_class", F.coalesce("asset_class", F.lit("other")))
    return j.groupBy("asset_class").agg(F.countDistinct("series_id").alias("n_series"), F.count_if(F.col("value").isNull()).alias("n_missing"), (100 * F.count_if(F.col("value").isNull()) / F.count(F.lit(1))).alias("missing_pct"))


def frequency(df: DataFrame, daily_rows: int = 4000) -> DataFrame:
    """Per series: gaps between observations and the frequency they suggest."""
    have = df.where("value is not null").withColumn("gap", F.datediff("ts", F.lag("ts").over(W())))
    g = have.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("gap").alias("avg_gap"), F.median("gap").alias("median_gap"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"))
    kind = F.when(F.col("n_rows") >= daily_rows, "DAILY").when(F.col("avg_gap") >= 25, "MONTHLY").when(F.col("avg_gap") >= 4, "WEEKLY").when(F.col("avg_gap") < 4, "DAILY").otherwise("SPARSE")
    return g.withColumn("frequency", kind).withColumn("needs_fill", F.col("frequency") != "DAILY")


def high_low(df: DataFrame) -> DataFrame:
    """Extremes with their first dates, and the range as a share of the low."""
    high_at = F.min_by("ts", F.struct(-F.col("value"), F.col("ts")))
    low_at = F.min_by("ts", F.struct(F.col("value"), F.col("ts")))
    g = df.where("value is not null").groupBy(*KEY).agg(F.max("value").alias("high"), high_at.alias("high_date"), F.min("value").alias("low"), low_at.alias("low_date"))
    return g.withColumn("range", F.col("high") - F.col("low")).withColumn("range_pct", 100 * F.try_divide("range", "low"))


def coverage(df: DataFrame, least: float = 0.5) -> DataFrame:
    share = F.count("value") / F.count(F.lit(1))
    return df.groupBy(*KEY).agg(share.alias("share"), F.when(F.count("value") == 0, "failed").when(share < least, "partial").otherwise("success").alias("status"))


def extent(df: DataFrame, rows: int = 3) -> DataFrame:
    """Per series: first and last date, rows, and the values of its first and last ``rows`` rows, in order."""
    d = df.withColumns({"_up": F.row_number().over(W()), "_n": F.count(F.lit(1)).over(o.Window.partitionBy(*KEY))})
    some = lambda on: F.transform(F.array_sort(F.collect_list(F.when(on, F.struct("_up", "value")))), lambda z: z["value"])
    return d.groupBy(*KEY).agg(F.min("ts").alias("first_date"), F.max("ts").alias("last_date"), F.count(F.lit(1)).alias("n_rows"), some(F.col("_up") <= rows).alias("head"), some(F.col("_up") > F.col("_n") - rows).alias("tail"))


def profile(df: DataFrame, columns: Sequence[str] = ("value",)) -> DataFrame:
    """Per series: count, mean, deviation, quartiles, extremes, skewness and kurtosis of each column."""
    made = []
    for c in columns:
        q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        made += [F.count(c).alias(f"{c}_count"), F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), q[0].alias(f"{c}_q25"), q[1].alias(f"{c}_q50"), q[2].alias(f"{c}_q75"), F.max(c).alias(f"{c}_max"), o.skew(c).alias(f"{c}_skew"), o.kurtosis(c).alias(f"{c}_kurt")]
    return df.groupBy(*KEY).agg(*made)
