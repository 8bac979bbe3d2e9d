"""Tails of losses per series, from the largest ones only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def worst(returns: DataFrame, k: int) -> DataFrame:
    """(series_id, i, loss): the k + 1 largest losses (-ret) per series, i from 1. A bounded top-k per task and series, which
    is merged; no series is sorted whole."""
    w = Window.partitionBy("series_id").orderBy(F.desc("loss"), "ts")
    d = returns.where("ret is not null").select("series_id", "ts", (-F.col("ret")).alias("loss"))
    return d.withColumn("i", F.row_number().over(w)).where(F.col("i") <= k + 1).select("series_id", "i", "loss")


def tail(returns: DataFrame, k: int = 40, levels: Sequence[float] = (0.99,)) -> DataFrame:
    """Per series with more than k rows, from its k + 1 largest losses: n, threshold (the last of them), hill and pickands
    (tail indices), shape and scale of a generalised Pareto distribution of what the first k exceed it by (by moments),
    and var_<level>, es_<level> in percent levels from these.

    hill needs a positive threshold; pickands needs order statistics k / 4, k / 2 and k that differ; es a shape below 1.
    What can't be told is null.
    """
    top = worst(returns, k)
    n = returns.where("ret is not null").groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k)
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("loss")))
    u = top.where(F.col("i") == k + 1).select("series_id", F.col("loss").alias("threshold"))
    over = F.when(F.col("i") <= k, F.col("loss") - F.col("threshold"))
    logs = F.when((F.col("i") <= k) & (F.col("threshold") > 0), F.ln(F.col("loss")) - F.ln("threshold"))
    g = top.join(u, "series_id").groupBy("series_id", "threshold").agg(F.avg(logs).alias("hill"), F.avg(over).alias("_m"), F.var_samp(over).alias("_v"), at(k // 4).alias("_a"), at(k // 2).alias("_b"), at(k).alias("_c"))
    g = g.join(n, "series_id")
    ratio = F.try_divide(F.col("_a") - F.col("_b"), F.col("_b") - F.col("_c"))
    q = F.try_divide(F.col("_m") * F.col("_m"), F.col("_v"))
    g = g.withColumns({"pickands": F.when(ratio > 0, F.ln(ratio) / math.log(2)), "shape": 0.5 * (1 - q), "scale": 0.5 * F.col("_m") * (q + 1)})
    out: dict[str, Column] = {}
    for level in levels:
        name = f"{level * 100:g}".replace(".", "_")
        p = (1 - level) * F.col("n") / k
        var = F.col("threshold") + F.when(F.abs("shape") < 1e-9, -F.col("scale") * F.ln(p)).otherwise(F.try_divide("scale", "shape") * (F.pow(p, -F.col("shape")) - 1))
        out[f"var_{name}"] = var
        out[f"es_{name}"] = F.when(F.col("shape") < 1, (var + F.col("scale") - F.col("shape") * F.col("threshold")) / (1 - F.col("shape")))
    return g.select("series_id", "n", "threshold", "hill", "pickands", "shape", "scale", *[c.alias(x) for x, c in out.items()])
