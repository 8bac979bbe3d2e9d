"""Intraday vendor requests as a Spark data source, by time slices: batch with the range pushed down, and as a stream."""

from __future__ import annotations

import datetime as dt
import importlib
import json
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

ROW = tuple[dt.datetime, int, float]


@dataclass
class _Slice(InputPartition):
    ticker: str
    start: dt.datetime
    end: dt.datetime


def sliced(start: dt.datetime, end: dt.datetime, seconds: int) -> list[tuple[dt.datetime, dt.datetime]]:
    """[start, end) in parts that begin at multiples of so many seconds, whatever the start, but for the first."""
    out, at, base = [], start, dt.datetime(1970, 1, 1)
    while at < end:
        n = int((at - base).total_seconds() // seconds) + 1
        to = min(end, base + dt.timedelta(seconds=n * seconds))
        out.append((at, to))
        at = to
    return out


def _provided(options: Mapping[str, str], p: _Slice) -> Iterator[tuple]:
    module, _, name = options["provider"].partition(":")
    for ts, number, value in getattr(importlib.import_module(module), name)(p.ticker, p.start, p.end, dict(options)):
        yield p.ticker, ts, int(number), float(value)


class IntradaySource(DataSource):
    """spark.read (or readStream).format("series_intraday").

    Options: tickers (a JSON list), start and end (ISO times, the end not included), seconds (of a slice, 86400 if not
    given), slices (of a trigger, for streams, 1 if not given), and provider, "package.module:function", which gives
    (time, number, value) rows for (ticker, start, end, options). A ticker and slice is a partition, so requests run
    side by side, and one that is lost is asked for again alone.
    """

    @classmethod
    def name(cls) -> str:
        return "series_intraday"

    def schema(self) -> str:
        return "ticker string, ts timestamp_ntz, number long, value double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(dict(self.options))


class _Span:
    def __init__(self, options: Mapping[str, str]) -> None:
        self.o = options
        self.start, self.end = (dt.datetime.fromisoformat(options[x]) for x in ("start", "end"))
        self.seconds, self.tickers = int(options.get("seconds", "86400")), json.loads(options["tickers"])


class _Reader(_Span, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Narrows the range by bounds on ts. All filters are left to Spark too, so the provider needs no exact bounds."""
        for f in filters:
            if getattr(f, "attribute", None) == ("ts",) and isinstance(v := getattr(f, "value", None), dt.datetime):
                v = v.replace(tzinfo=None)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.start = max(self.start, v)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.end = min(self.end, v + dt.timedelta(microseconds=isinstance(f, LessThanOrEqual)))
            yield f

    def partitions(self) -> list[InputPartition]:
        return [_Slice(t, a, b) for t in self.tickers for a, b in sliced(self.start, self.end, self.seconds)] or [_Slice("", self.start, self.start)]

    def read(self, p: _Slice) -> Iterator[tuple]:
        return _provided(self.o, p) if p.start < p.end else iter(())


class _StreamReader(_Span, DataSourceStreamReader):
    """Offsets are times: a trigger takes the next slices, up to the end."""

    def __init__(self, options: Mapping[str, str]) -> None:
        super().__init__(options)
        self.at = self.start

    def initialOffset(self) -> dict:  # noqa: N802
        return {"ts": self.start.isoformat()}

    def latestOffset(self) -> dict:  # noqa: N802
        rest = sliced(self.at, self.end, self.seconds)[: int(self.o.get("slices", "1"))]
        if rest:
            self.at = rest[-1][1]
        return {"ts": self.at.isoformat()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = (dt.datetime.fromisoformat(x["ts"]) for x in (start, end))
        self.at = max(self.at, b)
        return [_Slice(t, x, y) for t in self.tickers for x, y in sliced(a, b, self.seconds)]

    def read(self, p: _Slice) -> Iterator[tuple]:
        return _provided(self.o, p)

    def commit(self, end: dict) -> None:
        self.at = max(self.at, dt.datetime.fromisoformat(end["ts"]))


def table_provider(ticker: str, start: dt.datetime, end: dt.datetime, options: Mapping[str, str]) -> Iterator[ROW]:
    """Rows of a Parquet table of events (event_type, ts, event_id, value), at options["path"]: a vendor's stand-in."""
    import pyarrow.dataset as ds

    f = ds.field
    t = ds.dataset(options["path"]).to_table(columns=["ts", "event_id", "value"], filter=(f("event_type") == ticker) & (f("ts") >= start) & (f("ts") < end))
    yield from zip(t["ts"].to_pylist(), t["event_id"].to_pylist(), t["value"].to_pylist(), strict=True)


def intraday(spark: SparkSession, tickers: list[str], start: dt.datetime, end: dt.datetime, provider: str, seconds: int = 86400, **options: str) -> DataFrame:
    """(ticker, ts, number, value) of the tickers from start to before end; bounds on ts that a query adds reach the requests."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IntradaySource)
    r = spark.read.format("series_intraday").options(tickers=json.dumps(sorted(tickers)), start=start.isoformat(), end=end.isoformat(), seconds=str(seconds), provider=provider, **options)
    return r.load()


def intraday_stream(spark: SparkSession, tickers: list[str], start: dt.datetime, end: dt.datetime, provider: str, seconds: int = 86400, slices: int = 1, **options: str) -> DataFrame:
    """The same as a stream: a trigger takes so many slices of all tickers."""
    spark.dataSource.register(IntradaySource)
    r = spark.readStream.format("series_intraday").options(tickers=json.dumps(sorted(tickers)), start=start.isoformat(), end=end.isoformat(), seconds=str(seconds), slices=str(slices), provider=provider, **options)
    return r.load()
