"""Joins and alignment in time: outer merges, as-of joins, resampling, calendars, interval overlaps, grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered as o


def merge(*tables: DataFrame) -> DataFrame:
    """N-way outer merge of long tables: a union, with no join at all."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def complete(df: DataFrame) -> DataFrame:
    """Every series on every date of any series; missing values are null. Dates and series are distinct lists."""
    days, names = df.select("ts").distinct(), df.select("series_id").distinct()
    return days.join(names).join(df, ["series_id", "ts"], "left")


def asof(left: DataFrame, right: DataFrame, by: str = "series_id", at: str = "ts", value: str = "value", direction: str = "backward") -> DataFrame:
    """left with the value (and its time) of right's last row at or before (first at or after) its own time.

    One union and one ordered window, so no range join: rows of right sort before those of left at equal times
    (after, if forward), and each row of left takes the nearest one.
    """
    back = direction == "backward"
    r = right.select(by, at, F.struct(F.col(at).alias("at"), F.col(value).alias("v")).alias("_r"), F.lit(0 if back else 1).alias("_side"))
    extra = [c for c in left.columns if c not in (by, at)]
    lt = left.select(by, at, F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.lit(1 if back else 0).alias("_side"), F.struct(*extra, F.lit(1).alias("_is")).alias("_l"))
    u = lt.unionByName(r.withColumn("_l", F.lit(None).cast(lt.schema["_l"].dataType)))
    w = o.series(by, (at, "_side"))
    near = o.ffill("_r", w) if back else o.bfill("_r", w)
    return u.withColumn("_near", near).where("_l is not null").select(by, at, *[F.col(f"_l.{c}").alias(c) for c in extra], F.col("_near.at").alias("matched_at"), F.col("_near.v").alias("matched"))


def period_end(ts: Column, freq: str) -> Column:
    """The last day of the period: W (weeks to Friday), M, Q or Y."""
    if freq == "W":
        return F.next_day(F.date_sub(ts, 1), "FRI")
    if freq == "M":
        return F.last_day(ts)
    if freq == "Q":
        return F.last_day(F.add_months(F.trunc(ts, "quarter"), 2))
    return F.make_date(F.year(ts), F.lit(12), F.lit(31))


def resample(df: DataFrame, freq: str, how: str = "last", fill: bool = True) -> DataFrame:
    """One row per series and period; periods without observations appear and, with fill, carry the value before."""
    p = df.withColumn("_p", period_end(F.col("ts"), freq))
    v = F.col("value")
    agg = {
        "last": F.max_by(v, F.when(v.isNotNull(), F.col("ts"))), "first": F.min_by(v, F.when(v.isNotNull(), F.col("ts"))),
        "mean": F.avg(v), "sum": F.coalesce(F.sum(v), F.lit(0.0)), "max": F.max(v), "min": F.min(v),
    }[how]
    g = p.groupBy("series_id", "_p").agg(agg.alias("value"))
    if freq == "W":
        steps = F.sequence("lo", "hi", F.expr("interval 7 days"))
    else:
        months = {"M": 1, "Q": 3, "Y": 12}[freq]
        steps = F.transform(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr(f"interval {months} months")), lambda d: F.last_day(d))
    span = g.groupBy("series_id").agg(F.min("_p").alias("lo"), F.max("_p").alias("hi")).select("series_id", F.explode(steps).alias("_p"))
    out = span.join(g, ["series_id", "_p"], "left").withColumnRenamed("_p", "ts")
    return out.withColumn("value", o.ffill("value", o.series())) if fill and how != "sum" else out


def daily(df: DataFrame) -> DataFrame:
    """Every calendar day from a series' first to its last, values carried forward."""
    span = df.groupBy("series_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).select("series_id", F.explode(F.sequence("lo", "hi")).alias("ts"))
    return span.join(df, ["series_id", "ts"], "left").withColumn("value", o.ffill("value", o.series()))


def overlapping(a: DataFrame, b: DataFrame, by: str = "series_id", anti: bool = False) -> DataFrame:
    """Rows of a (t0, t1) whose closed interval meets one of b's of the same key; anti: those that meet none.

    Sorted instead of joined by range. A row of a meets one of b iff some b begins by its t1 and ends at its t0 or
    later; the latest end among the b's that begin by t1 decides, which is a running maximum.
    """
    begins = b.select(by, F.col("t0").alias("_at"), F.col("t1").alias("_end"), F.lit(0).alias("_side"))
    cols = F.struct(*a.columns)
    asks = a.select(by, F.col("t1").alias("_at"), F.lit(None).cast(b.schema["t1"].dataType).alias("_end"), F.lit(1).alias("_side"), cols.alias("_a"))
    u = asks.unionByName(begins.withColumn("_a", F.lit(None).cast(asks.schema["_a"].dataType)))
    latest = F.max("_end").over(o.so_far(o.series(by, ("_at", "_side"))))
    meets = F.coalesce(F.col("_latest") >= F.col("_a.t0"), F.lit(False))
    return u.withColumn("_latest", latest).where("_a is not null").where(~meets if anti else meets).select("_a.*")


def grid(spark, values: Mapping[str, Sequence]) -> DataFrame:
    """The product of parameter lists, with a running param_id in order of the lists."""
    import itertools

    rows = [(i, *map(float, x)) for i, x in enumerate(itertools.product(*values.values()))]
    return spark.createDataFrame(rows, "param_id long, " + ", ".join(f"{k} double" for k in values))


def pairs(df: DataFrame) -> DataFrame:
    """Values of two series on the same date, each pair of series once: a, b, ts, va, vb."""
    x = df.select(F.col("series_id").alias("a"), "ts", F.col("value").alias("va"))
    y = df.select(F.col("series_id").alias("b"), "ts", F.col("value").alias("vb"))
    return x.join(y, "ts").where("a < b").select("a", "b", "ts", "va", "vb")


def cumulative_over_all(df: DataFrame, order: str, value: str, buckets: int = 64) -> DataFrame:
    """A running sum over one long series without one long task: range buckets, their totals, then the rest within."""
    d = df.repartitionByRange(buckets, order).withColumn("_b", F.spark_partition_id())
    totals = d.groupBy("_b").agg(F.sum(value).alias("_t"), F.min(order).alias("_lo"))
    before = totals.select("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_lo").rowsBetween(o.START, -1)), F.lit(0)).alias("_before"))
    run = F.sum(value).over(Window.partitionBy("_b").orderBy(order).rowsBetween(o.START, 0))
    return d.withColumn("_run", run).join(F.broadcast(before), "_b").withColumn("running", F.col("_run") + F.col("_before")).drop("_b", "_run", "_before")
