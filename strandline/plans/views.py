"""The series that the queries run over, from the given tables, as DataFrames and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ordered as o

Query = Callable[[SparkSession, str], DataFrame]


def unsigned_zero(sql: str) -> str:
    """sql with 0.0 added to every round(...), so that minus zero is zero, as rounded() does."""
    out, at = [], 0
    while (i := sql.find("round(", at)) >= 0:
        depth, j = 0, i + 5
        while True:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
            if not depth:
                break
        out.append(f"{sql[at:i]}({sql[i:j]} + 0.0::DOUBLE)")
        at = j
    return "".join([*out, sql[at:]])


class Book:
    """Queries and their SQL, by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = unsigned_zero(sql)
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def px(spark: SparkSession, d: str) -> DataFrame:
    """Daily mean order price per priority."""
    t = table(spark, d, "orders").select(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("ts"), "o_totalprice")
    return t.groupBy("series_id", "ts").agg(F.avg("o_totalprice").alias("value"))


def px_null(spark: SparkSession, d: str) -> DataFrame:
    """px with every seventh value and the first two missing."""
    rn = F.row_number().over(o.series())
    return px(spark, d).withColumn("value", F.when((rn % 7 == 3) | (rn <= 2), None).otherwise(F.col("value")))


def returns(spark: SparkSession, d: str) -> DataFrame:
    """px scaled to small daily moves: ret = change / 1000, first row 0; value its compounded level."""
    p = px(spark, d).withColumn("ret", F.coalesce(o.pct_change("value", 1, o.series()) / 1000, F.lit(0.0)))
    return p.select("series_id", "ts", "ret", (100 * F.product(1 + F.col("ret")).over(o.so_far(o.series()))).alias("value"))


def meta(spark: SparkSession, d: str) -> DataFrame:
    """Two asset classes of the price series; one series has none."""
    p = px(spark, d).select("series_id").distinct().where("series_id <> '5-LOW'")
    return p.select("series_id", F.when(F.substring("series_id", 1, 1).cast("int") <= 2, "rates").otherwise("credit").alias("asset_class"), F.substring("series_id", 1, 1).cast("int").alias("ordinal"))


def flow(spark: SparkSession, d: str) -> DataFrame:
    """Daily price and volume of line items per return flag."""
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").cast("date").alias("ts"), "l_quantity", "l_extendedprice")
    return t.groupBy("series_id", "ts").agg(F.sum("l_quantity").alias("volume"), F.avg("l_extendedprice").alias("value"), F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"))


def ticks(spark: SparkSession, d: str) -> DataFrame:
    """Events as ticks: price is the value, volume one plus the user's number in tens."""
    return table(spark, d, "events").select(F.col("event_type").alias("series_id"), "ts", "event_id", F.col("value").alias("price"), (1 + F.col("user_id") % 10).cast("double").alias("volume"))


PX = "px AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ts, avg(o_totalprice) AS value FROM orders GROUP BY ALL)"
PXN = PX + ", pn AS (SELECT series_id, ts, CASE WHEN rn % 7 = 3 OR rn <= 2 THEN NULL ELSE value END AS value, rn FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn FROM px) q)"
RET = PX + ", r0 AS (SELECT series_id, ts, coalesce((value / lag(value) OVER (PARTITION BY series_id ORDER BY ts) - 1) / 1000, 0) AS ret FROM px), rt AS (SELECT series_id, ts, ret, 100 * product(1 + ret) OVER (PARTITION BY series_id ORDER BY ts) AS value, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn FROM r0)"
META = PX + ", meta AS (SELECT DISTINCT series_id, CASE WHEN CAST(substr(series_id, 1, 1) AS INTEGER) <= 2 THEN 'rates' ELSE 'credit' END AS asset_class, CAST(substr(series_id, 1, 1) AS INTEGER) AS ordinal FROM px WHERE series_id <> '5-LOW')"
FLOW = "fl AS (SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS ts, sum(l_quantity) AS volume, avg(l_extendedprice) AS value, max(l_extendedprice) AS high, min(l_extendedprice) AS low FROM lineitem GROUP BY ALL)"
TICKS = "tk AS (SELECT event_type AS series_id, ts, event_id, value AS price, CAST(1 + user_id % 10 AS DOUBLE) AS volume FROM events)"
#: Windows: one series in order; and frames over it.
W = "PARTITION BY series_id ORDER BY ts"


def rolled(agg: str, x: str, n: int, w: str = W) -> str:
    """SQL of an aggregate over the last n rows, if they hold n values."""
    f = f"OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {f} >= {n} THEN {agg.format(x)} {f} END"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as both sides of a comparison do; minus zero is zero."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])
