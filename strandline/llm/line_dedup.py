"""Line dedup by overlapping three-line windows, with DataFrame functions only.

Every line of a text is hashed, every run of three consecutive lines gets a hash of its three line hashes, and windows
that occur more than once in the corpus are found by one aggregation. The first occurrence, by (doc_id, position),
stays; the lines that later occurrences cover are merged and removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, if_small, unboxed, written


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """docs with ``text`` less its repeated line windows, plus ``n_lines`` and ``n_removed`` (int).

    - Lines are split at \\n and compared exactly. A text of fewer than ``width`` lines is left as it is.
    - Order of occurrences: doc_id ascending (nulls last), then a hash of the row, then position. Rows alike in id and
      text are one document: they keep or lose the same lines.
    - A later occurrence that overlaps the first one in the same text loses only the lines beyond the first.
    - Null text: null, 0 lines. Empty text: one empty line. A text that loses every line becomes ''.
    - Long texts are cut in time and memory that grow with their length. An empty table gives an empty result.
    - Other columns pass through; n_lines and n_removed of the input, if any, are replaced.

    Three steps. Window hashes are counted by numbers alone, combined before the shuffle; only windows that occur again
    go on with their place, in joins that adaptive execution splits when a window is hot; and whole rows meet the
    lines they lose in a hash join, which streams them without sorting.
    """
    d = boxed(docs.drop("n_lines", "n_removed"), id_col, text_col)
    text, own_id = F.col("_row").getField(text_col), F.col("_row").getField(id_col)
    lines = F.split(text, "\n", -1)
    runs = d.where(text.contains("\n" if width > 1 else "")).select("_k1", "_k2", own_id.alias("_id"), F.transform(lines, lambda x: F.xxhash64(x)).alias("_h")).where(F.size("_h") >= width)
    whole = dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint")
    order = [F.col("_id").isNull().alias("x"), F.col("_id").cast("bigint" if whole else "string").alias("i"), F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), F.col("_p").alias("p")]
    at = [F.col("_h")[F.col("_p") + i] for i in range(width)]
    windows = runs.select("*", F.explode(F.sequence(F.lit(0), F.size("_h") - width)).alias("_p")).select(F.xxhash64(*at).alias("_w"), F.hash(*reversed(at)).alias("_v"), F.xxhash64("_k1", "_k2", "_p").alias("_x"), F.struct(*order).alias("_o"))
    # rows alike in id and text have the same _x, so they are one occurrence
    repeated = windows.groupBy("_w", "_v").agg(F.min("_x").alias("_x1"), F.max("_x").alias("_x2")).where("_x1 <> _x2").select("_w", "_v")
    hits = written(windows.drop("_x").join(if_small(written(repeated, "line-repeated")), ["_w", "_v"], "left_semi"), "line-hits")
    first = written(hits.groupBy("_w", "_v").agg(F.min("_o").alias("_f")), "line-first")
    same = (F.col("_o.k1") == F.col("_f.k1")) & (F.col("_o.k2") == F.col("_f.k2"))
    low = F.when(same, F.greatest(F.col("_o.p"), F.col("_f.p") + width)).otherwise(F.col("_o.p"))
    gone = (
        hits.join(if_small(first), ["_w", "_v"])
        .where(F.col("_o") != F.col("_f"))
        .select(F.col("_o.k1").alias("_k1"), F.col("_o.k2").alias("_k2"), low.alias("_a"), (F.col("_o.p") + (width - 1)).alias("_b"))
        .where("_a <= _b")
        .groupBy("_k1", "_k2")
        .agg(F.collect_set(F.struct("_a", "_b")).alias("_gone"))
    )
    out = d.join(written(gone, "line-gone").hint("shuffle_hash"), ["_k1", "_k2"], "left")
    covered = F.flatten(F.transform("_gone", lambda s: F.sequence(s["_a"], s["_b"])))

    def cut(own: Column) -> Column:
        """n lines, those that stay, and their text; own is a variable, so the text is split once."""
        stay = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), covered)
        return F.transform(F.array(stay), lambda s: F.struct(F.size(s).alias("n"), F.array_join(F.transform(s, lambda i: F.get(own, i)), "\n").alias("t")))[0]

    out = out.withColumn("_cut", F.when(F.col("_gone").isNotNull(), F.transform(F.array(lines), cut)[0]))
    n = F.when(text.isNull(), 0).otherwise(F.size(lines))
    rest = F.when(F.col("_cut").isNull(), text).otherwise(F.col("_cut.t"))
    removed = F.when(F.col("_cut").isNull(), 0).otherwise(n - F.col("_cut.n"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*[rest.alias(c) if c == text_col else x for c, x in zip(names, unboxed(names), strict=True)], n.alias("n_lines"), removed.alias("n_removed"))
