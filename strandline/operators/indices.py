"""Index construction by compounding. All recurrences are products, so each is one ordered window per series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ordered as o
from .align import daily

W = o.series


def from_ytd(df: DataFrame, base: float = 100.0) -> DataFrame:
    """Index from year-to-date returns in percent: within a year, base * (1 + ytd / 100), the base being the index at
    the last year's end (unchanged if that year's last row is null). Gaps are carried forward, then backward."""
    year = F.year("ts")
    ends = df.groupBy("series_id", year.alias("y")).agg(F.coalesce(1 + F.max_by("value", "ts") / 100, F.lit(1.0)).alias("f"))
    before = ends.select("series_id", "y", (F.lit(base) * F.coalesce(F.product("f").over(o.series(order="y").rowsBetween(o.START, -1)), F.lit(1.0))).alias("_base"))
    d = df.withColumn("y", year).join(before, ["series_id", "y"]).withColumn("_i", F.col("_base") * (1 + F.col("value") / 100))
    d = d.withColumn("_f", o.ffill("_i", W()))
    return d.select("series_id", "ts", F.coalesce("_f", o.bfill("_i", W())).alias("index"))


def money_market(rates: DataFrame, base: float = 100.0) -> DataFrame:
    """Total-return index of a rate in percent a year: each calendar day earns the day's rate, carried forward, for one day."""
    d = daily(rates)
    first = F.row_number().over(W()) == 1
    f = F.when(first, F.lit(1.0)).otherwise(1 + F.col("value") / 100 / 365)
    return d.withColumn("_f", f).select("series_id", "ts", (F.lit(base) * F.product("_f").over(o.so_far(W()))).alias("index"))


def _compounded(d: DataFrame, base: float) -> DataFrame:
    """Index from a return column _r in percent; the first row is the base."""
    f = F.when(F.col("_r").isNull(), F.lit(1.0)).otherwise(1 + F.col("_r") / 100)
    return d.withColumn("_f", f).select("series_id", "ts", "_r", (F.lit(base) * F.product("_f").over(o.so_far(W()))).alias("index"))


def levered(df: DataFrame, leverage: float = 3.0, borrow_bps: float = 40.0, base: float = 100.0) -> DataFrame:
    """Leverage times the return, less the borrowing cost for the days since the row before."""
    days = F.datediff("ts", F.lag("ts").over(W()))
    d = df.withColumn("_r", leverage * 100 * o.pct_change("value", 1, W()) - borrow_bps / 10_000 * 100 * days / 365)
    return _compounded(d, base).select("series_id", "ts", F.col("_r").alias("ret_pct"), "index")


def gross(levered_index: DataFrame, cash_index: DataFrame, base: float = 100.0) -> DataFrame:
    """The levered return plus the cash return on dates that both have."""
    a = levered_index.select("series_id", "ts", F.col("index").alias("_a"))
    b = cash_index.select("series_id", "ts", F.col("index").alias("_b"))
    d = a.join(b, ["series_id", "ts"]).withColumn("_r", 100 * o.pct_change("_a", 1, W()) + 100 * o.pct_change("_b", 1, W()))
    return _compounded(d, base).select("series_id", "ts", F.col("_r").alias("ret_pct"), "index")


def net(gross_index: DataFrame, fee_pct: float = 0.90 + 0.20, performance: float = 0.15, base: float = 100.0) -> DataFrame:
    """Gross return less the yearly fee per row, and less the performance fee on what is then above zero."""
    d = gross_index.withColumn("_d", F.col("ret_pct") - fee_pct / 365)
    d = d.withColumn("_r", F.when(F.col("_d") > 0, (1 - performance) * F.col("_d")).otherwise(F.col("_d")))
    return _compounded(d, base).select("series_id", "ts", F.col("_r").alias("ret_pct"), "index")
