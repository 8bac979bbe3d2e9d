"""CSV with one or two header rows, YAML settings, and a vendor history source over the Python Data Source API."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_csv(spark: SparkSession, path: str, date: str = "Date", start: str | None = None, end: str | None = None) -> DataFrame:
    """A one-header CSV as a wide table: ts (bad dates dropped to null and left out), numbers as DOUBLE or null."""
    raw = spark.read.option("header", True).csv(path)
    if date not in raw.columns:
        raise ValueError(f"no date column {date!r} in {path}")
    d = raw.select(F.col(date).try_cast("date").alias("ts"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in raw.columns if c != date]).where("ts is not null")
    return _between(d, start, end)


def _between(d: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start:
        d = d.where(F.col("ts") >= F.lit(start).cast("date"))
    if end:
        d = d.where(F.col("ts") <= F.lit(end).cast("date"))
    return d


def header_rows(spark: SparkSession, path: str) -> int:
    """1 or 2: whether the second line begins with a date."""
    lines = spark.read.text(path).limit(2).collect()
    first = lines[1][0].split(",")[0].strip() if len(lines) > 1 else ""
    return 1 if spark.sql("select try_to_date(:x) is not null as y", {"x": first}).first()["y"] or _is_date(first) else 2


def _is_date(x: str) -> bool:
    for f in ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y", "%d/%m/%Y"):
        try:
            dt.datetime.strptime(x, f)
            return True
        except ValueError:
            continue
    return False


def read_two_level_csv(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(prices, meta) from a CSV whose first two rows are asset classes and columns, with an empty "Date" row after them.

    prices: series_id, ts, value; meta: series_id, asset_class, ordinal. The header is read by the driver, the body by
    the executors.
    """
    head = [r[0].split(",") for r in spark.read.text(path).limit(2).collect()]
    if len(head) < 2:
        raise ValueError(f"no two header rows in {path}")
    names, classes, last = head[1][1:], [], ""
    for c in head[0][1:]:
        last = c.strip() or last
        classes.append(last or "other")
    schema = "_date string, " + ", ".join(f"`c{i}` string" for i in range(len(names)))
    body = spark.read.schema(schema).csv(path).withColumn("ts", F.col("_date").try_cast("date")).where("ts is not null")
    wide = body.select("ts", *[F.col(f"c{i}").try_cast("double").alias(n.strip()) for i, n in enumerate(names)])
    long = wide.unpivot("ts", [n.strip() for n in names], "series_id", "value").select("series_id", "ts", "value")
    meta = spark.createDataFrame([(n.strip(), c, i) for i, (n, c) in enumerate(zip(names, classes, strict=True))], "series_id string, asset_class string, ordinal int")
    return _between(long, start, end), meta


def load(spark: SparkSession, path: str, **how) -> DataFrame:
    """Long prices of either kind of CSV."""
    if header_rows(spark, path) == 1:
        d = read_csv(spark, path, **how)
        return d.unpivot("ts", [c for c in d.columns if c != "ts"], "series_id", "value").select("series_id", "ts", "value")
    return read_two_level_csv(spark, path, **how)[0]


@dataclass
class Settings:
    """Typed settings with defaults; from_yaml() reads nested keys by name and ignores others."""

    frequency: str = "D"
    fill: str = "ffill"
    fees: float = 0.0
    slippage: float = 0.0
    capital: float = 100.0
    start: str | None = None
    end: str | None = None
    strategies: list[str] = field(default_factory=list)

    @classmethod
    def from_yaml(cls, path: str) -> Settings:
        import yaml

        raw = yaml.safe_load(Path(path).read_text()) or {}
        flat = {k: v for part in (raw, *(x for x in raw.values() if isinstance(x, dict))) for k, v in part.items()}
        return cls(**{k: flat[k] for k in cls.__dataclass_fields__ if k in flat})

    def to_yaml(self, path: str) -> None:
        import yaml

        Path(path).write_text(yaml.safe_dump(vars(self), sort_keys=True))


def mapping(keys: Mapping[str, str]) -> list[tuple[str, str, str, str]]:
    """(ticker, field, override, column) from "ticker|field[|override]" keys."""
    out = []
    for k, column in keys.items():
        parts = [p.strip() for p in k.split("|")]
        if len(parts) not in (2, 3):
            raise ValueError(f"not ticker|field[|override]: {k!r}")
        out.append((parts[0], parts[1], parts[2] if len(parts) == 3 else "", column))
    return out


class HistorySource(DataSource):
    """Vendor history as a Spark data source: spark.read.format("series_history").

    Options: pairs (a JSON list of [ticker, field]) or tickers and fields (comma-separated: all pairs of them), start,
    end, override, and provider, "package.module:function", which gives (date, value) pairs for (ticker, field, start,
    end, override). One partition per ticker and field, so that requests run side by side; a vendor's own library is
    only touched by its provider.
    """

    @classmethod
    def name(cls) -> str:
        return "series_history"

    def schema(self) -> str:
        return "ticker string, field string, override string, ts date, value double"

    def reader(self, schema) -> DataSourceReader:
        return _HistoryReader(self.options)


@dataclass
class _Request(InputPartition):
    ticker: str
    field: str


class _HistoryReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.o = dict(options)

    def partitions(self) -> list[InputPartition]:
        if "pairs" in self.o:
            return [_Request(t, f) for t, f in json.loads(self.o["pairs"])]
        return [_Request(t.strip(), f.strip()) for t in self.o["tickers"].split(",") for f in self.o["fields"].split(",")]

    def read(self, p: _Request) -> Iterator[tuple]:
        import importlib

        module, _, name = self.o["provider"].partition(":")
        get = getattr(importlib.import_module(module), name)
        for ts, value in get(p.ticker, p.field, self.o.get("start"), self.o.get("end"), self.o.get("override", "")):
            yield p.ticker, p.field, self.o.get("override", ""), ts, float(value)


def fixture_provider(ticker: str, field_: str, start: str | None, end: str | None, override: str) -> Iterator[tuple[dt.date, float]]:
    """Ten weekdays of made-up values, for tests."""
    d, n = dt.date.fromisoformat(start or "2024-01-01"), 0
    while n < 10 and (end is None or d <= dt.date.fromisoformat(end)):
        if d.weekday() < 5:
            yield d, float(len(ticker) * 10 + len(field_) + n)
            n += 1
        d += dt.timedelta(days=1)


def history(spark: SparkSession, keys: Mapping[str, str], provider: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Prices of the mapped (ticker, field, override) keys under their column names. Only mapped pairs are asked for.

    Series without an override keep all their dates. Overrides are requests of their own; their series are aligned to the
    dates of the first of them, in the order of the keys, that has any.
    """
    spark.dataSource.register(HistorySource)
    maps = mapping(keys)
    m = spark.createDataFrame([(*x, i) for i, x in enumerate(maps)], "ticker string, field string, override string, series_id string, _no int")
    out = None
    for override in sorted({x[2] for x in maps}):
        pairs = sorted({(t, f) for t, f, o, _ in maps if o == override})
        r = spark.read.format("series_history").option("provider", provider).option("pairs", json.dumps(pairs)).option("override", override)
        r = r.option("start", start) if start else r
        d = (r.option("end", end) if end else r).load().join(F.broadcast(m), ["ticker", "field", "override"])  # the mapping
        out = d if out is None else out.unionByName(d)
    over = out.where("override <> ''")
    if not any(x[2] for x in maps):
        return out.select("series_id", "ts", "value")
    first = over.select("ts", "_no").join(F.broadcast(over.agg(F.min("_no").alias("_first"))), F.col("_no") == F.col("_first")).select("ts").distinct()  # one row
    return out.where("override = ''").unionByName(over.join(first, "ts", "left_semi")).select("series_id", "ts", "value")
