"""Meta-labels: a first model says which way, a second one, on the rows where the first acts, whether to follow it and
how far."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import learn, signals, validation


def sides(p: Column, band: float) -> Column:
    """1 or -1 where a probability of rising is band or more from a half, else 0."""
    return F.when(p >= 0.5 + band, 1).when(p <= 0.5 - band, -1).otherwise(0)


def meta_label(side: Column, label: Column) -> Column:
    """1 if the value went the side's way."""
    return F.when(side == 1, label).when(side == -1, 1 - label)


def out_of_fold(df: DataFrame, roles: DataFrame, features: Sequence[str], label: str, name: str, k: int, kind: str = "logit", **how) -> DataFrame:
    """df's tested rows with the probability ``name`` of a model that saw their fold's training rows only; roles as
    validation.purge() gives them."""
    out = None
    d = written(df.join(roles, ["series_id", "ts"]), "folds")
    for f in range(k):
        own = d.where(F.col("fold") == f)
        fitted = learn.model(kind, features, label, **how).fit(own.where("role = 'train'"))
        s = learn.score(fitted, own.where("role = 'test'"), name).drop("role", "fold")
        out = s if out is None else out.unionByName(s)
    return out


def bet_sizes(df: DataFrame, p: str = "p_meta", side: str = "side", name: str = "bet") -> DataFrame:
    """df with a position from -1 to 1: the side times 2 N(z) - 1 of z = (p - 1/2) / sqrt(p (1 - p)); none below a half."""
    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    cdf = np.vectorize(NormalDist().cdf, otypes=[float])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            q = b[p].to_numpy(float).clip(1e-9, 1 - 1e-9)
            b[name] = b[side].to_numpy(float) * np.maximum(0.0, 2 * cdf((q - 0.5) / np.sqrt(q * (1 - q))) - 1)
            yield b

    return df.mapInPandas(run, f"{fields}, `{name}` double")


def bets(df: DataFrame, features: Sequence[str], horizon: int, k: int = 3, inner: int = 2, embargo: float = 0.01, band: float = 0.0, kind: str = "logit", **how) -> DataFrame:
    """(series_id, ts, fold, p, side, label, meta_label, p_meta, bet) of the rows on which the first model acts, each judged
    by models that know nothing of its fold.

    Per fold, whose rows and the labels that reach into it are kept from both models: the first model's probabilities
    for the training rows come from inner folds, out of fold too; on those it acts on, the second one learns whether
    the first was right, from the features, that probability and the side; both are then applied to the fold. Rows
    without a label, and those past the last whole fold, have no row here. A fold whose acting rows are all right, or
    all wrong, has their share as its probability.
    """
    d = signals.labels(df, horizon, null_tail=True).where("label is not null").select("series_id", "ts", "value", "label", *features)
    spans = validation.intervals(df, horizon)
    outer = written(validation.purge(spans, validation.purged_folds(d, k, embargo)), "bets-folds")
    fed = [*features, "p", "side"]
    out = None
    for f in range(k):
        own = outer.where(F.col("fold") == f)
        train, test = (written(d.join(own.where(F.col("role") == r).select("series_id", "ts"), ["series_id", "ts"]), f"bets-{r}") for r in ("train", "test"))
        folds = validation.purge(spans, validation.purged_folds(train, inner, embargo))
        first = out_of_fold(train, folds, features, "label", "p", inner, kind, **how).withColumn("side", sides(F.col("p"), band)).where("side <> 0")
        first = written(first.withColumn("meta_label", meta_label(F.col("side"), F.col("label"))), "bets-first")
        seen = learn.score(learn.model(kind, features, **how).fit(train), test, "p").withColumn("side", sides(F.col("p"), band)).where("side <> 0")
        seen = seen.withColumns({"meta_label": meta_label(F.col("side"), F.col("label")), "fold": F.lit(f)})
        share = first.agg(F.avg("meta_label")).first()[0]
        if share is None or share in (0.0, 1.0):
            s = seen.withColumn("p_meta", F.lit(0.5 if share is None else share))
        else:
            s = learn.score(learn.model(kind, fed, "meta_label", **how).fit(first), seen, "p_meta")
        s = s.select("series_id", "ts", "fold", "p", "side", "label", "meta_label", "p_meta")
        out = s if out is None else out.unionByName(s)
    return bet_sizes(out)
