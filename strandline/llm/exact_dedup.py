"""Exact dedup by a content sort, with DataFrame functions only.

Texts are normalised by deleting white space. Splitters from a sample cut the order of (first characters, hash of the
whole, hash of the id) into ranges, so rows are dealt out by content, and a text that very many rows share is cut into
several ranges. Within a range an external sort puts equal texts side by side, and neighbours are compared in full. The
few texts that hold a splitter, whose rows may lie in several ranges, are put together at the end from one row per
range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Ranges per shuffle partition, sampled rows per range, and leading code points of the sort key. The driver holds
#: some 130 bytes for each sampled row, whatever the table's size.
RANGES, SAMPLES, LEADING = 4, 16, 16
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    """text without white space (space, tab to carriage return); null: ''."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]", "")


def _wide(x: Column) -> Column:
    return F.lpad(F.hex(x), 16, "0")


def _key(norm: Column) -> Column:
    """Where a text stands in the order of content, as a string; equal texts have equal keys."""
    return F.concat_ws(".", F.hex(F.encode(F.left(norm, F.lit(LEADING)), "utf-8")), _wide(F.xxhash64(norm)))


def _splitters(docs: DataFrame, id_col: str, text_col: str, ranges: int, samples: int) -> list[str]:
    """At most ranges - 1 sorted keys that cut a sample of the rows evenly."""
    want, n = ranges * samples, docs.count()
    part = docs.sample(fraction=min(1.0, 1.2 * want / n), seed=17) if n > want else docs
    key = F.concat_ws(".", _key(normalised(F.col(text_col))), _wide(F.xxhash64(id_col)))
    keys = sorted(r[0] for r in part.select(key).collect())  # bounded: some 1.2 * ranges * samples short strings
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def _range_of(key: Column, splitters: list[str]) -> Column:
    """Number of splitters up to key: first among the heads of blocks of splitters, then within the block."""
    if not splitters:
        return F.lit(0)
    b = math.ceil(math.sqrt(len(splitters)))
    blocks = [splitters[i : i + b] for i in range(0, len(splitters), b)]
    heads = F.split(F.lit(",".join(x[0] for x in blocks)), ",")
    rest = F.transform(F.split(F.lit(";".join(",".join(x) for x in blocks)), ";"), lambda x: F.split(x, ","))
    upto = lambda a: F.size(F.filter(a, lambda s: s <= key))
    # one-element arrays bind the block number, so it is found once
    return F.transform(F.array(upto(heads)), lambda c: F.when(c == 0, 0).otherwise((c - 1) * b + upto(F.get(rest, c - 1))))[0]


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, samples: int = SAMPLES, keep: Sequence[str] | None = None) -> DataFrame:
    """docs plus ``keep_id`` (id of the row that stays), ``group_size`` (long), ``kept`` (boolean) and ``text_sha256``
    (lowercase hex of the normalised text in UTF-8), a row for every row.

    - Texts are equal when identical after deleting white space. Of equal ones, the row of the longest original text (in
      code points), then of the smallest id stays; null ids come last.
    - Null text counts as empty, and empty and blank texts are equal; each is its own length long.
    - Repeated rows (same id, equal text) are a group as any other: one of them, any, stays.
    - Long texts travel once, whole, in a shuffle and a sort that spill. An empty table gives an empty result.
    - Other columns pass through; columns of the four names above are replaced. ``keep`` names the columns to pass
      through, if not all are wanted: the text then travels once, normalised, and is never written.

    ``ranges`` (RANGES for each shuffle partition if None) and ``samples`` only say how rows are dealt out.
    """
    spark = docs.sparkSession
    ranges = ranges or RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    doc_id, text = "_doc", "_text"
    src = docs.select(F.col(f"`{id_col}`").alias(doc_id), F.col(f"`{text_col}`").alias(text), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)])
    splitters = _splitters(src.select(doc_id, text), doc_id, text, ranges, samples)

    d = src.withColumns({"_norm": normalised(F.col(text)), "_n": F.coalesce(F.char_length(text), F.lit(0)).cast("long")})
    d = d.withColumns({"_key": _key(F.col("_norm")), "_sha": F.sha2(F.encode("_norm", "utf-8"), 256)})
    d = d.withColumn("_range", _range_of(F.concat_ws(".", "_key", _wide(F.xxhash64(doc_id))), splitters))
    # a window's keys are compared in full, neighbour by neighbour, after the sort
    w = Window.partitionBy("_range", "_norm").orderBy(F.desc("_n"), F.asc_nulls_last(doc_id))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = F.struct((-F.col("_n")).alias("n"), F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"))
    d = d.withColumns({"_at": F.row_number().over(w), "_size": F.count(F.lit(1)).over(whole), "_first": F.first(order).over(whole)})
    out = [F.col(f"_c{i}").alias(c) for i, c in enumerate(names)]
    if not splitters:
        return d.select(*out, F.col("_first.id").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_at") == 1).alias("kept"), F.col("_sha").alias("text_sha256"))
    d = written(d.drop("_norm", "_n", doc_id, text), "copies-marked")
    cut = spark.createDataFrame([(k,) for k in sorted({s.rpartition(".")[0] for s in splitters})], "_key string")  # fewer than ranges
    leaders = d.where("_at = 1").join(F.broadcast(cut), "_key", "left_semi")
    joint = leaders.groupBy("_key", "_sha").agg(F.min(F.struct("_first", "_range")).alias("_best"), F.sum("_size").alias("_all"))
    joint = written(joint, "copies-joint")  # as many rows as splitters, at most
    d = d.join(F.broadcast(joint), ["_key", "_sha"], "left")
    first = F.col("_best").isNull() | (F.col("_range") == F.col("_best._range"))
    keep = F.when(F.col("_best").isNull(), F.col("_first.id")).otherwise(F.col("_best._first.id"))
    return d.select(*out, keep.alias("keep_id"), F.coalesce("_all", "_size").alias("group_size"), ((F.col("_at") == 1) & first).alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """The rows of docs that stay, with their own columns."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    boxed = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest")] if rest else []))
    kept = mark_copies(boxed, id_col, text_col, ranges).where("kept")
    return kept.select(*[F.col("_rest").getField(c).alias(c) if c in rest else F.col(f"`{c}`") for c in docs.columns])
