"""Queries of sources and sinks: what is written comes back; and of labels, repairs and extents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality, signals
from ..session import shared_dir
from ..sources import readers, sinks
from .views import PX, PXN, Book, W, px, px_null, rounded

BOOK = Book()
query = BOOK.add
LONG = f"WITH {PX} SELECT series_id, ts, round(value, 4) AS value FROM px"


def _path(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


@query(LONG)
def csv_round_trip(s, d):
    """A one-header CSV, written and read, of the long prices as numbers and dates."""
    path = _path(s, "csv")
    p = px(s, d)
    sinks.write_csv(p.select(F.col("ts").alias("Date"), F.substring("series_id", 1, 1).alias("no"), "value"), path)
    names = p.select("series_id", F.substring("series_id", 1, 1).cast("double").alias("no")).distinct()
    return rounded(readers.read_csv(s, path).join(F.broadcast(names), "no").select("series_id", "ts", "value"), 4)  # a row per series


@query(f"WITH {PX}, q AS (SELECT series_id, ts, round(value, 4) AS value FROM px WHERE substr(series_id, 1, 1) <= '3') SELECT series_id, ts, value FROM q WHERE ts BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'")
def two_level_csv(s, d):
    """A CSV with rows of asset classes and of columns over its dates, read for a range of dates."""
    p = px(s, d).where(F.substring("series_id", 1, 1) <= "3")
    names = [r["series_id"] for r in p.select("series_id").distinct().orderBy("series_id").collect()]  # a row per series
    wide = p.groupBy("ts").pivot("series_id", names).agg(F.first("value"))
    path = _path(s, "two")
    line = F.concat_ws(",", F.col("ts").cast("string"), *[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names])
    head = s.createDataFrame([(0, ",".join(["asset_class", "rates", *[""] * (len(names) - 1)])), (1, ",".join(["column", *names])), (2, "Date" + "," * len(names))], "n int, value string")
    head.unionByName(wide.select(F.lit(3).alias("n"), line.alias("value"))).coalesce(1).sortWithinPartitions("n").select("value").write.text(path)
    prices, _ = readers.read_two_level_csv(s, path, "1996-01-01", "1997-06-30")
    return rounded(prices.where("value is not null"), 4)


@query(LONG)
def prices_round_trip(s, d):
    """Prices by series and year as Parquet."""
    path = _path(s, "prices")
    sinks.write_prices(px(s, d), path)
    return rounded(s.read.parquet(path).select("series_id", "ts", "value"), 4)


@query(f"WITH {PX} SELECT series_id, count(*) AS n, round(avg(value), 4) AS mean FROM px GROUP BY series_id")
def json_round_trip(s, d):
    """Metrics as JSON."""
    path = _path(s, "json")
    sinks.write_json(px(s, d).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean")), path)
    return s.read.schema("series_id string, n long, mean double").json(path)


@query("SELECT k.series_id, CAST(DATE '2024-01-01' + CAST(7 * (i // 5) + i % 5 AS INTEGER) AS DATE) AS ts, CAST(k.base + i AS DOUBLE) AS value FROM (VALUES ('a', 22), ('b', 32), ('c', 33)) k(series_id, base) CROSS JOIN (SELECT unnest(range(10)) AS i) q")
def vendor_history(s, d):
    """The vendor source over its fixture provider, one key with an override."""
    return readers.history(s, {"AA|PX": "a", "BBB|PX": "b", "BBB|EPS|1BF": "c"}, "strandline.sources.readers:fixture_provider", start="2024-01-01")


@query(f"""WITH {PX}, f AS (SELECT series_id, ts, lead(value, 5) OVER ({W}) / value - 1 AS r FROM px) SELECT series_id, ts, CASE WHEN r > 0.2 THEN 1 WHEN r < -0.2 THEN -1 WHEN r IS NOT NULL THEN 0 END AS label FROM f""")
def fixed_horizon_labels(s, d):
    return signals.fixed_horizon(px(s, d), 5, 0.2).select("series_id", "ts", "label")


@query(f"""WITH {PXN}, b AS (SELECT series_id, ts, CASE WHEN rn % 50 = 5 THEN NULL ELSE value END AS value FROM pn) SELECT series_id, ts, round(last_value(value IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS value FROM b""")
def repair_forward_fill(s, d):
    """Bad points repaired by filling their whole series forward."""
    from ..functions import ordered as o

    p = px_null(s, d)
    bad = p.withColumn("rn", F.row_number().over(o.series())).where("rn % 50 = 5").select("series_id", "ts", F.lit("forward_fill").alias("action"))
    return rounded(quality.repair(p, bad).select("series_id", "ts", "value"), 4)


@query(f"""WITH {PX}, n AS (SELECT *, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM px)
SELECT series_id, min(ts) AS first_date, max(ts) AS last_date, count(*) AS n_rows, array_to_string(list(CAST(CAST(round(value) AS BIGINT) AS VARCHAR) ORDER BY ts) FILTER (rn <= 3), ',') AS head, array_to_string(list(CAST(CAST(round(value) AS BIGINT) AS VARCHAR) ORDER BY ts) FILTER (rn > n - 3), ',') AS tail FROM n GROUP BY series_id""")
def extent(s, d):
    text = lambda c: F.array_join(F.transform(c, lambda v: F.round(v).cast("long").cast("string")), ",").alias(c)
    return quality.extent(px(s, d)).select("series_id", "first_date", "last_date", "n_rows", text("head"), text("tail"))
