"""Boosting that stops by itself: rounds judged on rows that the trees have not seen, several label horizons, and a
threshold chosen on what the strategy would have earned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered as o
from . import learn, signals

W = o.series

#: The strategy's settings of its trees, as far as gradient-boosted trees have them here.
SETTINGS = {"stepSize": 0.05, "maxDepth": 5, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 20}


def judged(df: DataFrame, horizon: int, share: float = 0.7) -> DataFrame:
    """df with label, part, and _valid: the rows after each series' training part, which say when to stop. Rows whose label
    lies ahead of the data are 0, as the strategy has them."""
    return learn.split(signals.labels(df, horizon), share).withColumn("_valid", F.col("part") == "test")


def fit_until(df: DataFrame, features: Sequence[str], rounds: int = 200, tol: float = 0.01, seed: int = 42, **how) -> PipelineModel:
    """Boosted trees of at most so many rounds on judged() rows. Fitting ends when a round betters the loss of the validation
    rows by less than ``tol`` of it; the rounds up to the best one are kept."""
    return learn.model("boosting", features, seed=seed, maxIter=rounds, validationIndicatorCol="_valid", validationTol=tol, **(SETTINGS | how)).fit(df)


def rounds_kept(fitted: PipelineModel) -> int:
    return fitted.stages[-1].getNumTrees


def margins(fitted: PipelineModel, df: DataFrame) -> DataFrame:
    """df with an array of the sum of trees after each round, from the model's own trees; rows are read once."""
    assembler, model = fitted.stages
    d = assembler.transform(df)
    names = []
    for i, tree in enumerate(model.trees):
        names.append(f"_t{i}")
        d = tree.copy().setFeaturesCol("_x").setPredictionCol(names[-1]).transform(d)
    sums, steps = F.lit(0.0), []
    for name, weight in zip(names, model.treeWeights, strict=True):
        sums = sums + F.col(name) * float(weight)
        steps.append(sums)
    return d.withColumn("margins", F.array(*steps)).drop("_x", *names)


def round_auc(fitted: PipelineModel, df: DataFrame) -> DataFrame:
    """(series_id, part, round, n_pos, n_neg, auc): the area under the ROC curve after each round that was kept, of the
    rows trained on and of those that judged. A part of one class has none."""
    d = margins(fitted, df).select("series_id", "part", "label", F.posexplode("margins").alias("round", "p"))
    return learn.auc(d.withColumn("round", F.col("round") + 1), ("series_id", "part", "round"))


def loss_by_round(fitted: PipelineModel, df: DataFrame) -> list[float]:
    """Loss on the validation rows after each round that was kept."""
    assembler, model = fitted.stages
    return model.evaluateEachIteration(assembler.transform(df.where("_valid")))


def horizons(df: DataFrame, features: Sequence[str], ahead: Sequence[int] = (1, 5, 10), rounds: int = 200, tol: float = 0.01, share: float = 0.7, **how) -> tuple[dict[int, PipelineModel], DataFrame]:
    """A model per label horizon, each stopped by itself, and df with the probability of each, p_<horizon>."""
    fitted, d = {}, df
    for h in ahead:
        fitted[h] = fit_until(judged(df, h, share), features, rounds, tol, **how)
        scored = fitted[h].transform(d).withColumn(f"p_{h}", vector_to_array("probability")[1])
        d = scored.drop("_x", "rawPrediction", "probability", "prediction")
    return fitted, d


def sweeps(scored: DataFrame, ahead: Sequence[int], **how) -> DataFrame:
    """(horizon, series_id, step, threshold, total_return, max_drawdown, sharpe, rows_in, score, best): the threshold sweep
    inside each horizon."""
    r = scored.withColumn("ret", o.pct_change("value", 1, W()))
    out = None
    for h in ahead:
        s = learn.threshold_sweep(r.select("series_id", "ts", F.col(f"p_{h}").alias("p"), "ret"), **how).withColumn("horizon", F.lit(h))
        out = s if out is None else out.unionByName(s)
    return out


def strategy(scored: DataFrame, swept: DataFrame, ahead: Sequence[int]) -> DataFrame:
    """(series_id, ts, p, position, entry, exit): in the market while the horizons' mean probability is above the best
    threshold of the first horizon."""
    p = learn.ensemble(scored, {f"p_{h}": 1.0 for h in ahead}).select("series_id", "ts", "p")
    best = swept.where(F.col("best") & (F.col("horizon") == ahead[0])).select("series_id", "threshold")
    d = p.join(best, "series_id").withColumn("_pos", F.col("p") > F.col("threshold"))
    return signals.edges(d).select("series_id", "ts", "p", "position", "entry", "exit")


def gains(fitted: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    """Features by what their splits gained, highest first."""
    return learn.importance(fitted, features, len(features))


def best_rounds(aucs: DataFrame, part: str = "test") -> DataFrame:
    """(series_id, round, auc): the round of most area on a part, the first on ties."""
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("auc"), "round"))
    return aucs.where(F.col("part") == part).withColumn("_r", rank).where("_r = 1").select("series_id", "round", "auc")
