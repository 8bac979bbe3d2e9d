"""Portfolio construction, importance, unit-root and tail measures: aggregations in Spark, small matrices on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered as o

W = o.series


def covariance(returns: DataFrame, names: Sequence[str]) -> np.ndarray:
    """Covariance matrix of the named series over the dates that all have, from one aggregation."""
    wide = returns.groupBy("ts").pivot("series_id", list(names)).agg(F.first("ret")).na.drop("any")
    cells = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = wide.agg(*[F.covar_samp(f"`{names[i]}`", f"`{names[j]}`").alias(f"c{i}_{j}") for i, j in cells]).first()
    c = np.zeros((len(names), len(names)))
    for i, j in cells:
        c[i, j] = c[j, i] = row[f"c{i}_{j}"] or 0.0
    return c


def mean_variance(mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Fully invested weights of the best ratio of mean to deviation, shorts allowed."""
    x = np.linalg.solve(cov + np.eye(len(mean)) * 1e-12, mean)
    return x / x.sum()


def risk_parity(cov: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity: series joined by single linkage of correlation distance, then weights split top down in
    inverse proportion to the variance of each half."""
    n = len(cov)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-18))
    dist = np.sqrt(np.maximum(0.0, (1 - cov / np.outer(sd, sd)) / 2))
    clusters: list[list[int]] = [[i] for i in range(n)]
    while len(clusters) > 1:
        a, b = min(((a, b) for a in range(len(clusters)) for b in range(a + 1, len(clusters))), key=lambda p: (min(dist[i, j] for i in clusters[p[0]] for j in clusters[p[1]]), p))
        clusters[a] = clusters[a] + clusters.pop(b)
    order, w, todo = clusters[0], np.ones(n), [clusters[0]]

    def variance(part: list[int]) -> float:
        c = cov[np.ix_(part, part)]
        iv = 1 / np.diag(c)
        iv /= iv.sum()
        return float(iv @ c @ iv)

    while todo:
        part = todo.pop()
        if len(part) < 2:
            continue
        left, right = part[: len(part) // 2], part[len(part) // 2 :]
        share = 1 - variance(left) / (variance(left) + variance(right))
        w[left] *= share
        w[right] *= 1 - share
        todo += [left, right]
    assert sorted(order) == list(range(n))
    return w / w.sum()


def pca_weights(cov: np.ndarray, risk: float = 1.0) -> np.ndarray:
    """Weights that put all risk on the component of least variance."""
    values, vectors = np.linalg.eigh(cov)
    return risk * vectors[:, 0] / math.sqrt(max(values[0], 1e-18))


def information_coefficient(df: DataFrame, signal: str, horizon: int) -> DataFrame:
    """Per date, the rank correlation across series of a signal with the return over the next rows."""
    f = df.withColumn("_f", F.try_divide(F.lead("value", horizon).over(W()), F.col("value")) - 1).where(F.col(signal).isNotNull() & F.col("_f").isNotNull())
    by = Window.partitionBy("ts")
    mean_rank = lambda c: F.rank().over(by.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("ts", c)) - 1) / 2
    r = f.withColumns({"_a": mean_rank(signal), "_b": mean_rank("_f")})
    return r.groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.corr("_a", "_b").alias("ic"))


def unit_root(df: DataFrame) -> DataFrame:
    """Dickey-Fuller t statistic of the log level per series: the slope of the change on the level before."""
    d = df.withColumn("_l", F.ln("value")).withColumns({"_x": F.lag("_l").over(W()), "_y": o.diff("_l", 1, W())}).where("_x is not null")
    g = d.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("_y", "_x").alias("slope"), F.regr_sxx("_y", "_x").alias("_sxx"), F.regr_syy("_y", "_x").alias("_syy"))
    s2 = (F.col("_syy") - F.col("slope") * F.col("slope") * F.col("_sxx")) / (F.col("n") - 2)
    return g.select("series_id", "n", "slope", F.try_divide(F.col("slope"), F.sqrt(s2 / F.col("_sxx"))).alias("t_stat"))


def explosiveness(df: DataFrame, least: int = 30) -> DataFrame:
    """Supremum over start rows of the Dickey-Fuller statistic up to the last row, from prefix sums: one pass per series."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts")
        v = np.log(g["value"].to_numpy(dtype=float))
        x, y = v[:-1], np.diff(v)
        s = [np.concatenate([[0], np.cumsum(z)]) for z in (np.ones_like(x), x, y, x * x, x * y, y * y)]
        best = float("nan")
        for i in range(max(0, len(x) - least + 1)):
            n, sx, sy, sxx, sxy, syy = (z[-1] - z[i] for z in s)
            dx = sxx - sx * sx / n
            if dx <= 0 or n < 3:
                continue
            b = (sxy - sx * sy / n) / dx
            s2 = (syy - sy * sy / n - b * b * dx) / (n - 2)
            if s2 > 0 and not b / math.sqrt(s2 / dx) <= best:
                best = b / math.sqrt(s2 / dx)
        return pd.DataFrame({"series_id": [g["series_id"].iloc[0]], "sadf": [best]})

    return df.select("series_id", "ts", "value").groupBy("series_id").applyInPandas(run, "series_id string, sadf double")


def tail_dependence(pair: DataFrame, q: float = 0.1) -> DataFrame:
    """Share of dates with both of a pair's returns at or below their q quantiles, over q. Pairs are (a, b, ts, va, vb) of returns."""
    cut = pair.groupBy("a", "b").agg(F.percentile("va", q).alias("qa"), F.percentile("vb", q).alias("qb"))
    return pair.join(cut, ["a", "b"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), (F.avg(((F.col("va") <= F.col("qa")) & (F.col("vb") <= F.col("qb"))).cast("double")) / q).alias("lower_tail"))


def stress(returns: DataFrame, shocks: Sequence[float] = (-0.05, -0.1, -0.2)) -> DataFrame:
    """What a shock of the equal-weight market comes to in each series, by its beta."""
    m = returns.groupBy("ts").agg(F.avg("ret").alias("_m"))
    b = returns.join(m, "ts").groupBy("series_id").agg(F.regr_slope("ret", "_m").alias("beta"))
    return b.withColumn("shock", F.explode(F.array(*map(F.lit, shocks)))).withColumn("loss", F.col("beta") * F.col("shock"))


def drawdown_spells(df: DataFrame) -> DataFrame:
    """Each spell below the running peak: start, end, rows under water and depth; open at the last row or recovered."""
    d = df.withColumn("_peak", F.max("value").over(o.so_far(W()))).withColumn("_under", F.col("value") < F.col("_peak"))
    d = d.withColumn("_spell", o.islands(~F.col("_under"), W())).withColumn("_last", F.max("ts").over(Window.partitionBy("series_id")))
    g = d.where("_under").groupBy("series_id", "_spell").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("rows_under"), F.min(F.col("value") / F.col("_peak") - 1).alias("depth"), F.max("_last").alias("_last"))
    return g.select("series_id", "start", "end", "rows_under", "depth", F.when(F.col("end") == F.col("_last"), "open").otherwise("recovered").alias("status"))


def smart_ratios(returns: DataFrame, af: int = 252) -> DataFrame:
    """Sharpe and Sortino ratios less a penalty for autocorrelation of returns, and Sortino over the square root of two."""
    d = returns.withColumn("_l", F.lag("ret").over(W()))
    g = d.groupBy("series_id").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))).alias("dn"), F.abs(F.corr("ret", "_l")).alias("rho"), F.count("ret").alias("n"))
    penalty = F.sqrt(1 + 2 * (F.col("rho") / (1 - F.col("rho")) - F.col("rho") * (1 - F.pow("rho", F.col("n"))) / (F.col("n") * F.pow(1 - F.col("rho"), F.lit(2)))))
    a = math.sqrt(af)
    return g.select("series_id", (F.col("m") / F.col("s") * a / penalty).alias("smart_sharpe"), (F.col("m") / F.col("dn") * a / penalty).alias("smart_sortino"), (F.col("m") / F.col("dn") * a / math.sqrt(2)).alias("sortino_sqrt2"))


def daily_mentions(docs: DataFrame, words: Sequence[str], ts: str = "ts", text: str = "text") -> DataFrame:
    """Texts per day, and how many name each of some words."""
    hit = [F.count_if(F.lower(text).contains(w.lower())).alias(f"n_{w.lower()}") for w in words]
    return docs.groupBy(F.col(ts).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"), *hit)


#: Words that turn the next one around.
NEGATORS = ("not", "no", "never", "without")


def sentiment(texts: DataFrame, lexicon: DataFrame, keys: Sequence[str], text: str = "text", negators: Sequence[str] = NEGATORS) -> DataFrame:
    """(keys, n_scored, polarity, subjectivity): means over a text's words that the lexicon (word, polarity, subjectivity; one row
    a word, lower case) has.

    Words are runs of a-z of the lower-case text; after a negator a polarity counts as minus a half of it. A text without such words has
    0 in all three, as have null and empty texts; rows alike in keys are one text. The lexicon is joined by word, broadcast
    only if Spark finds it small.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    t = texts.select(*keys, words.alias("_w"))
    t = t.select(*keys, F.explode_outer(F.arrays_zip(F.col("_w").alias("word"), F.concat(F.array(F.lit("")), F.col("_w")).alias("before"))).alias("_p")).select(*keys, "_p.word", "_p.before")
    d = t.join(lexicon.select("word", "polarity", "subjectivity"), "word", "left")
    turned = F.when(F.col("before").isin(*negators), -0.5).otherwise(1.0) * F.col("polarity")
    return d.groupBy(*keys).agg(F.count("polarity").alias("n_scored"), F.coalesce(F.avg(turned), F.lit(0.0)).alias("polarity"), F.coalesce(F.avg("subjectivity"), F.lit(0.0)).alias("subjectivity"))


def daily_sentiment(scored: DataFrame, ts: str = "ts") -> DataFrame:
    """sentiment()'s texts by day: how many, mean, deviation, extremes of the polarity, mean subjectivity."""
    p = F.col("polarity")
    return scored.groupBy(F.col(ts).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean"), F.stddev_samp(p).alias("std"), F.min(p).alias("low"), F.max(p).alias("high"), F.avg("subjectivity").alias("subjectivity"))


def permuted_importance(fitted, df: DataFrame, features: Sequence[str], label: str = "label", seed: int = 42) -> DataFrame:
    """Accuracy lost when a feature's values are dealt anew among the rows of its series (by hash order): feature, drop."""
    from .validation import uniform

    def accuracy(d: DataFrame) -> float:
        return fitted.transform(d).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]

    base, rows = accuracy(df), []
    w = Window.partitionBy("series_id")
    for f in features:
        d = df.withColumns({"_k": F.row_number().over(w.orderBy("ts")), "_s": F.row_number().over(w.orderBy(uniform("series_id", "ts", F.lit(f), seed=seed), "ts"))})
        dealt = d.select("series_id", F.col("_s").alias("_k"), F.col(f).alias("_v"))
        rows.append((f, float(base - accuracy(d.join(dealt, ["series_id", "_k"]).withColumn(f, F.col("_v"))))))
    return df.sparkSession.createDataFrame(rows, "feature string, drop double")


def parameter_paths(n: int, population: Sequence[float], fitness: Sequence[float], kind: str = "tournament", seed: int = 42) -> list[float]:
    """n parents by tournament or by rank."""
    import random

    r = random.Random(seed)
    ranked = sorted(range(len(population)), key=lambda i: (fitness[i], i))
    if kind == "tournament":
        return [population[max(r.sample(range(len(population)), k=min(3, len(population))), key=lambda i: (fitness[i], -i))] for _ in range(n)]
    if kind == "rank":
        return [population[i] for i in r.choices(ranked, weights=range(1, len(ranked) + 1), k=n)]
    raise ValueError(f"unknown selection {kind!r}")


def pareto(runs: DataFrame) -> DataFrame:
    """Runs (run_id, total_return, max_drawdown) that no other beats: none is as good in both and better in one. Sorted by
    drawdown, a run stays if its return is the best of its own drawdown and beats all of better drawdowns; equal runs stay
    together."""
    w = Window.partitionBy("series_id").orderBy(F.col("max_drawdown").desc()).rangeBetween(o.START, 0)
    above = Window.partitionBy("series_id").orderBy(F.col("max_drawdown").desc(), F.col("total_return").desc())
    d = runs.withColumns({"_best": F.max("total_return").over(w), "_first": F.dense_rank().over(above)})
    at = Window.partitionBy("series_id", "total_return")
    # equal in return to the best, and the first of that return by drawdown
    return d.withColumn("_least", F.min("_first").over(at)).where((F.col("total_return") == F.col("_best")) & (F.col("_first") == F.col("_least"))).drop("_best", "_first", "_least")
