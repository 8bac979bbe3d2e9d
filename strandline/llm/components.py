"""Connected components of a graph given as edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(v, c) for every vertex of the edges (a, b), c being the least vertex of its component.

    Each round hangs every vertex's larger neighbours, then its smaller ones, on the least of them, until all edges
    are stars. Edges never outnumber those given; rounds grow with the logarithm of the longest path. Neighbours are
    combined before the shuffle, and written, so that both sides of the join that follows are dealt out for it alone
    and adaptive execution can split a vertex of very many neighbours.
    """
    e = written(edges.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct(), "star")
    before = None
    while True:
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("m", "a").alias("m")), "least")
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        large = written(large, "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"), "least")
        down = large.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = written(down.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "star")
        now = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if before == (now["n"], now["x"]):
            break
        before = (now["n"], now["x"])
    return e.select(F.col("a").alias("v"), F.col("b").alias("c")).union(e.select(F.col("b").alias("v"), F.col("b").alias("c")).distinct())
