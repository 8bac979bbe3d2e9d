"""Splits, scaling, models, threshold sweeps and diagnostics, on pyspark.ml and plain aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered as o

W = o.series


def split(df: DataFrame, share: float = 0.7) -> DataFrame:
    """part 'train' for the first int(n * share) rows of each series in time, else 'test'."""
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    return df.withColumn("part", F.when(F.row_number().over(W()) <= F.floor(n * share), "train").otherwise("test"))


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less the training part's mean over its population deviation, per series."""
    train = [F.when(F.col("part") == "train", F.col(c)) for c in columns]
    s = df.groupBy("series_id").agg(*[F.avg(x).alias(f"_m_{c}") for c, x in zip(columns, train, strict=True)], *[F.stddev_pop(x).alias(f"_s_{c}") for c, x in zip(columns, train, strict=True)])
    d = df.join(s, "series_id")
    return d.withColumns({c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns}).select(*df.columns)


def model(kind: str, features: Sequence[str], label: str = "label", seed: int = 42, n_train: int = 1000, **how) -> Pipeline:
    """logit (L2 with strength C), forest or boosting."""
    a = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip")
    if kind == "logit":
        c = LogisticRegression(featuresCol="_x", labelCol=label, regParam=1 / (how.pop("C", 1.0) * n_train), elasticNetParam=0.0, standardization=False, **how)
    elif kind == "forest":
        c = RandomForestClassifier(featuresCol="_x", labelCol=label, seed=seed, **how)
    elif kind == "boosting":
        c = GBTClassifier(featuresCol="_x", labelCol=label, seed=seed, **how)
    else:
        raise ValueError(f"unknown model {kind!r}")
    return Pipeline(stages=[a, c])


def score(fitted: PipelineModel, df: DataFrame, name: str = "p") -> DataFrame:
    out = fitted.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.drop("_x", "rawPrediction", "probability", "prediction")


def ensemble(df: DataFrame, weights: dict[str, float], name: str = "p") -> DataFrame:
    total = sum(weights.values())
    return df.withColumn(name, sum((F.col(c) * (w / total) for c, w in weights.items()), F.lit(0.0)))


def importance(fitted: PipelineModel, features: Sequence[str], k: int = 10) -> list[tuple[str, float]]:
    """The k features of most importance (or largest coefficients)."""
    m = fitted.stages[-1]
    v = m.featureImportances.toArray() if hasattr(m, "featureImportances") else m.coefficients.toArray()
    return sorted(zip(features, map(float, v), strict=True), key=lambda x: (-abs(x[1]), x[0]))[:k]


def threshold_sweep(scored: DataFrame, low: float = 0.45, high: float = 0.65, n: int = 20, most_drawdown: float = -0.30, af: int = 252) -> DataFrame:
    """Of (series_id, ts, p, ret), with ret the row's own return: per series and threshold, the strategy's return,
    drawdown and Sharpe when in the market after a p above it; best marks the highest return (halved if the drawdown
    is worse than allowed), first on ties. Thresholds multiply rows by a constant; windows run per threshold."""
    t = [low + (high - low) * i / (n - 1) for i in range(n)]
    d = scored.withColumn("_t", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("threshold")) for i, x in enumerate(t)])))
    d = d.select("series_id", "ts", "ret", F.col("_t.i").alias("step"), F.col("_t.threshold").alias("threshold"), (F.col("p") > F.col("_t.threshold")).cast("int").alias("_on"))
    w = o.series(("series_id", "step"))
    d = d.withColumn("_r", F.coalesce(F.lag("_on").over(w) * F.col("ret"), F.lit(0.0)))
    d = d.withColumn("_eq", F.product(1 + F.col("_r")).over(o.so_far(w))).withColumn("_dd", F.col("_eq") / F.max("_eq").over(o.so_far(w)) - 1)
    g = d.groupBy("series_id", "step", "threshold").agg((F.product(1 + F.col("_r")) - 1).alias("total_return"), F.min("_dd").alias("max_drawdown"), F.coalesce(F.try_divide(F.avg("_r"), F.stddev_samp("_r")) * float(af) ** 0.5, F.lit(0.0)).alias("sharpe"), F.sum("_on").alias("rows_in"))
    g = g.withColumn("score", F.when(F.col("max_drawdown") < most_drawdown, F.col("total_return") / 2).otherwise(F.col("total_return")))
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(F.col("score").desc(), "step"))
    return g.withColumn("best", rank == 1)


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts and rates of (series_id, label, p) at a threshold."""
    hit, yes = F.col("p") > threshold, F.col("label") == 1
    g = scored.groupBy("series_id").agg(F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn"))
    g = g.withColumns({"accuracy": F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), "precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})
    return g.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def auc(scored: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Area under the ROC curve by mean ranks of the positives, per series or other keys."""
    w = Window.partitionBy(*keys).orderBy("p")
    d = scored.withColumn("_r", F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, "p")) - 1) / 2)
    g = d.groupBy(*keys).agg(F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg"), F.sum(F.when(F.col("label") == 1, F.col("_r"))).alias("_s"))
    return g.select(*keys, "n_pos", "n_neg", F.try_divide(F.col("_s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2, F.col("n_pos") * F.col("n_neg")).alias("auc"))


def balance(labelled: DataFrame) -> DataFrame:
    g = labelled.groupBy("series_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("series_id")))


def bootstrap_cagr(returns: DataFrame, draws: int = 200, af: int = 252, seed: int = 42) -> DataFrame:
    """Confidence bounds of the CAGR: each draw weighs every row by a Poisson(1) count from a hash, so rows never move."""
    from .validation import uniform

    d = returns.where("ret is not null").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u, p, cdf, k = uniform("series_id", "ts", "draw", seed=seed), 0.36787944117144233, 0.0, F.lit(0)
    for i in range(8):  # inverse of the Poisson distribution function
        cdf += p
        k = k + (u > cdf).cast("int")
        p /= i + 1
    d = d.withColumn("_k", k)
    g = d.groupBy("series_id", "draw").agg(F.sum(F.col("_k") * F.ln(1 + F.col("ret"))).alias("_l"), F.sum("_k").alias("_n"))
    g = g.withColumn("cagr", F.exp(F.try_divide("_l", "_n") * af) - 1)
    q = F.percentile("cagr", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return g.groupBy("series_id").agg(q[0].alias("low"), q[1].alias("median"), q[2].alias("high"))


def leaking_names(features: Sequence[str]) -> list[str]:
    """Feature names that look ahead."""
    return [x for x in features if "shift(-" in x or "fwd" in x.lower() or "future" in x.lower()]


def horizon_ensemble(df: DataFrame, features: Sequence[str], horizons: Sequence[int], kind: str = "boosting", share: float = 0.7, **how) -> DataFrame:
    """Mean probability of models for several label horizons, each fitted on the first part of every series: df plus p."""
    from .signals import labels

    d = split(df, share)
    for h in horizons:
        x = labels(d, h)
        fitted = model(kind, features, **how).fit(x.where("part = 'train'"))
        d = score(fitted, d, f"_p{h}")
    names = [f"_p{h}" for h in horizons]
    return ensemble(d, dict.fromkeys(names, 1.0)).drop(*names)


def forest_ensemble(df: DataFrame, features: Sequence[str], horizon: int, forests: Sequence[tuple[float, dict]], share: float = 0.7) -> DataFrame:
    """Weighted probability of several forests of different shapes: (weight, settings) each. df plus p."""
    from .signals import labels

    d = split(labels(df, horizon), share)
    train = d.where("part = 'train'").persist()
    try:
        for i, (_, settings) in enumerate(forests):
            d = score(model("forest", features, seed=42 + i, **settings).fit(train), d, f"_p{i}")
    finally:
        train.unpersist()
    return ensemble(d, {f"_p{i}": w for i, (w, _) in enumerate(forests)}).drop(*[f"_p{i}" for i in range(len(forests))])


def expanding_retrain(df: DataFrame, features: Sequence[str], periods: int = 3, first: float = 0.5, kind: str = "logit", **how) -> DataFrame:
    """Models refitted on all rows before each of several consecutive periods and applied to the period: rows with period and p."""
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    at = (F.row_number().over(W()) - 1) / n
    d = df.withColumn("period", F.when(at >= first, F.least(F.floor((at - first) / ((1 - first) / periods)), F.lit(periods - 1)).cast("int")).otherwise(-1))
    out = None
    for k in range(periods):
        fitted = model(kind, features, **how).fit(d.where(F.col("period") < k))
        scored = score(fitted, d.where(F.col("period") == k))
        out = scored if out is None else out.unionByName(scored)
    return out


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) of all pairs of columns, per series, from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    g = df.groupBy("series_id").agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")) for a, b in pairs]).alias("m"))
    return g.select("series_id", F.explode("m").alias("x")).select("series_id", "x.a", "x.b", "x.corr")
