"""Selection by metadata, schema operators, derived columns and rules."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_class(df: DataFrame, meta: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Series of the included asset classes less the excluded ones. If nothing would be left, df as it is."""
    m = meta
    if include:
        m = m.where(F.col("asset_class").isin(*include))
    if exclude:
        m = m.where(~F.col("asset_class").isin(*exclude))
    if m.isEmpty():
        return df
    return df.join(m.select("series_id"), "series_id", "left_semi")


def by_series(df: DataFrame, meta: DataFrame, include: Mapping[str, Sequence[str]] | None = None, exclude: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Per asset class the series to keep or drop; classes that aren't named pass whole. If nothing is left, df."""
    keep: Column = F.lit(True)
    for cls, names in (include or {}).items():
        keep = keep & ((F.col("asset_class") != cls) | F.col("series_id").isin(*names))
    for cls, names in (exclude or {}).items():
        keep = keep & ~((F.col("asset_class") == cls) & F.col("series_id").isin(*names))
    m = meta.where(keep)
    if m.isEmpty():
        return df
    return df.join(m.select("series_id"), "series_id", "left_semi")


def between(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Dates from start to end, both included."""
    if start:
        df = df.where(F.col("ts") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("ts") <= F.lit(end).cast("date"))
    return df


def wide(df: DataFrame, names: Sequence[str], value: str = "value") -> DataFrame:
    """One column per named series; one pass, since the names are given."""
    return df.groupBy("ts").pivot("series_id", list(names)).agg(F.first(value))


def ordered_columns(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Series with class and place in the registry, unknown ones last as 'other'."""
    m = df.select("series_id").distinct().join(meta, "series_id", "left")
    return m.select("series_id", F.coalesce("asset_class", F.lit("other")).alias("asset_class"), F.coalesce("ordinal", F.lit(1_000_000)).alias("ordinal"))


def numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as DOUBLE; what isn't a number becomes null."""
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in columns})


def require(df: DataFrame, columns: Sequence[str], rows: int = 0) -> DataFrame:
    """df, or ValueError if columns are missing or it has fewer rows."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    if rows and df.limit(rows).count() < rows:
        raise ValueError(f"fewer than {rows} rows")
    return df


def align_start(df: DataFrame) -> DataFrame:
    """From the first date on which every series has a value; unchanged if there is none."""
    n = df.select("series_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    per = df.where("value is not null").groupBy("ts").agg(F.countDistinct("series_id").alias("k"))
    first = per.join(F.broadcast(n)).where("k = n").agg(F.min("ts").alias("first"))  # one row
    return df.join(F.broadcast(first)).where("first is null or ts >= first").select(*df.columns)


def common_start(df: DataFrame) -> DataFrame:
    """From the latest of the series' first valid dates."""
    first = df.where("value is not null").groupBy("series_id").agg(F.min("ts").alias("f")).agg(F.max("f").alias("first"))
    return df.join(F.broadcast(first)).where("ts >= first").select(*df.columns)  # one row


def category(name: Column) -> Column:
    """Feature family by what the name contains."""
    c = F.when(name.contains("mom"), "momentum").when(name.contains("vol"), "volatility").when(name.contains("spread"), "spread")
    return c.when(name.contains("z"), "zscore").when(name.contains("URGENT"), "urgent").otherwise("other")


_CLAUSE = re.compile(r"\s*\(?\s*([A-Za-z_]\w*)\s*(>=|<=|==|!=|>|<)\s*(-?\d+(?:\.\d+)?(?:[eE]-?\d+)?)\s*\)?\s*")


def parse_rule(rule: str) -> list[tuple[str, str, float] | str]:
    """A rule such as "(x > 0.1) & (y <= 2)" as clauses and connectives (& or |, one kind per rule). Nothing is evaluated."""
    parts = re.split(r"([&|])", rule)
    out: list[tuple[str, str, float] | str] = []
    for i, p in enumerate(parts):
        if i % 2:
            out.append(p)
            continue
        m = _CLAUSE.fullmatch(p)
        if m is None:
            raise ValueError(f"not a clause: {p!r}")
        out.append((m.group(1), m.group(2), float(m.group(3))))
    if len({x for x in out if isinstance(x, str)}) > 1:
        raise ValueError("one connective per rule")
    return out


def rule(text: str) -> Column:
    """A parsed rule as a boolean column; unknown is false."""
    ops = {">": Column.__gt__, "<": Column.__lt__, ">=": Column.__ge__, "<=": Column.__le__, "==": Column.__eq__, "!=": Column.__ne__}
    parsed = parse_rule(text)
    out = None
    for i, x in enumerate(parsed):
        if isinstance(x, str):
            continue
        c = F.coalesce(ops[x[1]](F.col(x[0]), F.lit(x[2])), F.lit(False))
        out = c if out is None else out & c if parsed[i - 1] == "&" else out | c
    return out
