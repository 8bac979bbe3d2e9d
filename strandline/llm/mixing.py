"""Mixing sources to target weights along a curriculum, with DataFrame functions only.

Each source has a share of the mix and a schedule: a piecewise linear weight over training time 0..1. The integral of
the schedule, scaled to the source's target, is its cumulative demand for tokens; inverting that function gives the
time at which a token is needed. Documents lie in a fixed pseudo-random order within their source; a document's
cumulative token offset, put through the inverse, is its training position, and the mix is range-sorted by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, if_small, written

#: Weights of the sources in order of code point, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Knots (time, relative weight) of the schedules, repeating in the same order: fading out, even, fading in.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.4), (0.3, 0.8), (1.0, 1.4)))


def size_of(text: str | Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def first_words(text: str | Column, n: Column) -> Column:
    """A text up to the end of its n-th word, what parts the words untouched; the whole text if it has no more words."""
    t = F.col(text) if isinstance(text, str) else text
    n = n.cast("int") + t.rlike(f"^{SPACE}").cast("int")  # white space in front makes an empty piece
    pieces = F.split(t, SPACE, n + 1)
    cut = F.left(t, F.char_length(t) - F.char_length(F.element_at(pieces, -1)))
    return F.when(F.size(pieces) > n, F.regexp_replace(cut, f"(?<!{SPACE[:-1]}){SPACE}$", "")).otherwise(t)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, size) rows per source to (source, rank, source_size, target).

    Targets share ``share`` times all sizes by weight; what goes beyond ``cap`` times a source's size is shared again
    by weight until none is above. That is the water level L at which the sum of min(cap * size, weight * L) is the
    total: sources sorted by cap * size / weight, one running sum. One row per source takes part.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("ratio", "rank").rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("ratio", F.col("most") / F.col("w"))
    s = s.withColumns({"full": F.coalesce(F.sum("most").over(before), F.lit(0.0)), "left_w": F.sum("w").over(onward), "total": F.sum("source_size").over(all_) * F.lit(float(share))})
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("left_w"))
    # the first source in this order that its own level does not fill sets the level of all after it
    s = s.withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(all_)["level"])
    target = F.when(F.col("water").isNull() | (F.col("ratio") <= F.col("water")), F.col("most")).otherwise(F.col("w") * F.col("water"))
    return s.select("source", "rank", "source_size", target.alias("target"))


def _position(share: Column, rank: Column, schedules: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """Time at which a schedule's integral reaches the given share (0..1) of its whole."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        area = [0.0]
        for (a, u), (b, v) in zip(knots, knots[1:], strict=False):
            area.append(area[-1] + (b - a) * (u + v) / 2)
        y, here = share * area[-1], F.lit(float(knots[-1][0]))
        for i in range(len(knots) - 2, -1, -1):
            (a, u), (b, v) = knots[i], knots[i + 1]
            slope, rest = (v - u) / (b - a), y - area[i]
            root = 2 * rest / (u + F.sqrt(F.greatest(F.lit(u * u) + 2 * slope * rest, F.lit(0.0))))
            here = F.when(y <= area[i + 1], F.lit(a) + root).otherwise(here)
        out = F.when((rank - 1) % len(schedules) == k, here).otherwise(out)
    return out


def assign_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, share: float = 1.5, per_bucket: int = 4_000, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken, first_position, second_position, and ``keep``.

    A source gives its documents in a fixed order (by md5 of id and text), as often as its target asks; the document
    at the end gives its first words only, so that a source's taken words are its target, rounded. taken counts
    repeats; with targets at most twice a source's size, no document gives more than twice its size.
    first_position and second_position (0..1) say when its first and second copy are trained on; null: not taken.

    Null text: size 0, taken 0. Long texts are counted whole. Null source: a source of its own, last in order. Rows alike in id and text are
    interchangeable. Columns of clashing names in docs play no part. An empty table gives an empty result.

    Offsets are two-level sums: documents fall into buckets of their source by md5 prefix, long enough for about
    ``per_bucket`` documents, so a hot source is spread over many tasks.
    """
    order = F.md5(F.concat_ws("\x1f", F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    d = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), size_of(text_col).alias("size"), order.alias("_o"), *[F.col(f"`{c}`").alias(f"_keep{i}") for i, c in enumerate(keep)])
    slim = written(d.select("_id", "source", "size", "_o"), "mix-sizes") if not keep else None
    base = slim if slim is not None else d
    n = (slim if slim is not None else docs).count()
    digits = 1
    while 16**digits * per_bucket < n and digits < 8:
        digits += 1
    base = base.withColumn("_b", F.substring("_o", 1, digits))
    parts = written(base.groupBy("source", "_b").agg(F.sum("size").alias("_s")), "mix-buckets")
    targets = source_targets(parts.groupBy("source").agg(F.sum("_s").alias("source_size")), weights, share)
    run = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_s").over(run), F.lit(0)))
    t = targets.select(F.col("source").alias("_ts"), "rank", "source_size", "target")
    parts = written(parts.join(t, F.col("source").eqNullSafe(F.col("_ts"))).select(F.col("source").alias("_ps"), F.col("_b").alias("_pb"), "_before", "rank", "source_size", "target"), "mix-offsets")
    within = Window.partitionBy("source", "_b").orderBy("_o", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("_c", F.coalesce(F.sum("size").over(within), F.lit(0)))
    base = base.join(if_small(parts), F.col("source").eqNullSafe(F.col("_ps")) & (F.col("_b") == F.col("_pb")))
    quota, start, n_ = F.round("target").cast("long"), F.col("_before") + F.col("_c"), F.col("size")
    once = F.greatest(F.lit(0), F.least(n_, quota - start))
    twice = F.greatest(F.lit(0), F.least(n_, quota - F.col("source_size") - start))
    at = lambda first, got: F.when(got > 0, _position((first + got / 2) / F.greatest(F.lit(1.0), F.col("target")), F.col("rank"), schedules))
    return base.select(
        F.col("_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (once + twice).alias("taken"),
        once.alias("taken_once"), twice.alias("taken_twice"),
        at(start, once).alias("first_position"), at(start + F.col("source_size"), twice).alias("second_position"),
        *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)],
    )


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: a row for each copy that is taken, with its text, ``copy`` (1 or 2), ``words`` taken of it and
    ``position``, range-sorted by position (ties by id). A copy that is taken in part ends after its last word taken.
    Columns of docs by the names of the result's give way to them."""
    own = (id_col, source_col, "size", "source_size", "target", "taken", "taken_once", "taken_twice", "first_position", "second_position", "copy", "words", "position")
    keep = [c for c in docs.columns if c not in own]
    a = assign_positions(docs, id_col, text_col, source_col, keep=keep, **how)
    copies = F.filter(F.array(F.struct(F.lit(1).alias("copy"), F.col("taken_once").alias("words"), F.col("first_position").alias("position")), F.struct(F.lit(2).alias("copy"), F.col("taken_twice").alias("words"), F.col("second_position").alias("position"))), lambda c: c["words"] > 0)
    out = a.select(id_col, source_col, *keep, "size", "target", F.explode(copies).alias("_c")).select(id_col, source_col, *keep, "size", "target", "_c.copy", "_c.words", "_c.position")
    out = out.withColumn(text_col, F.when(F.col("words") < F.col("size"), first_words(text_col, F.col("words"))).otherwise(F.col(text_col)))
    return out.repartitionByRange("position", id_col, "copy").sortWithinPartitions("position", id_col, "copy")
