"""Leakage-aware validation: folds, purging, label uniqueness, overfitting statistics, simulation."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered as o

W = o.series


def numbered(df: DataFrame) -> DataFrame:
    return df.withColumns({"rn": F.row_number().over(W()) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("series_id"))})


def purged_folds(df: DataFrame, k: int = 5, embargo: float = 0.01) -> DataFrame:
    """(series_id, ts, fold, role): contiguous test blocks of floor(n / k) rows; the rows after a block, int(n * embargo)
    of them, and the remainder of the division are neither tested nor, if embargoed, trained on."""
    d = numbered(df).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("_size", F.floor(F.col("n") / k))
    s, e = F.col("fold") * F.col("_size"), (F.col("fold") + 1) * F.col("_size")
    emb = F.floor(F.col("n") * embargo)
    role = F.when((F.col("rn") >= s) & (F.col("rn") < e), "test").when((F.col("rn") < s) | (F.col("rn") >= e + emb), "train").otherwise("embargo")
    return d.select("series_id", "ts", "fold", role.alias("role"))


def purge(intervals: DataFrame, folds: DataFrame) -> DataFrame:
    """folds with training rows whose label interval (series_id, ts, t0, t1) meets the fold's test labels as 'purged'.

    Test blocks are contiguous, so a fold is its least t0 and greatest t1: no interval join."""
    d = folds.join(intervals, ["series_id", "ts"])
    f = Window.partitionBy("series_id", "fold")
    lo, hi = F.min(F.when(F.col("role") == "test", F.col("t0"))).over(f), F.max(F.when(F.col("role") == "test", F.col("t1"))).over(f)
    d = d.withColumns({"_lo": lo, "_hi": hi})
    meets = (F.col("t0") <= F.col("_hi")) & (F.col("_lo") <= F.col("t1"))
    return d.withColumn("role", F.when((F.col("role") == "train") & meets, "purged").otherwise(F.col("role"))).select("series_id", "ts", "fold", "role")


def n_splits(k: int, m: int | None = None) -> int:
    """Number of folds: k, or of choices of m test groups out of k."""
    return k if m is None else math.comb(k, m)


def combinatorial_members(df: DataFrame, k: int = 5, m: int = 2, embargo: float = 0.01, mode: str = "correct") -> DataFrame:
    """(series_id, ts, split, role) of all C(k, m) choices of test groups; the last group takes the remainder. role: test,
    train, or embargo.

    mode 'correct' trains on all other rows outside each test group's embargo; 'reference' only on rows after the
    embargo of the last test group, which leaves some splits without any."""
    splits = list(itertools.combinations(range(k), m))
    d = numbered(df).withColumn("_size", F.floor(F.col("n") / k)).withColumn("_g", F.least(F.floor(F.col("rn") / F.col("_size")), F.lit(k - 1)))
    d = d.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(i).alias("split"), F.array(*map(F.lit, c)).alias("groups")) for i, c in enumerate(splits)])))
    groups, emb = F.col("_s.groups"), F.floor(F.col("n") * embargo)
    test = F.array_contains(groups, F.col("_g").cast("int"))
    end = lambda g: F.when(g == k - 1, F.col("n")).otherwise((g + 1) * F.col("_size"))
    if mode == "reference":
        train = F.col("rn") >= end(F.element_at(groups, -1)) + emb
    else:
        train = ~F.exists(groups, lambda g: (F.col("rn") >= end(g)) & (F.col("rn") < end(g) + emb))
    return d.select("series_id", "ts", F.col("_s.split").alias("split"), F.when(test, "test").when(train, "train").otherwise("embargo").alias("role"))


def combinatorial_folds(df: DataFrame, k: int = 5, m: int = 2, embargo: float = 0.01, mode: str = "correct") -> DataFrame:
    """(series_id, split, n_train, n_test): how many rows each of combinatorial_members() trains and tests on."""
    d = combinatorial_members(df, k, m, embargo, mode)
    return d.groupBy("series_id", "split").agg(F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test"))


def per_fold(members: DataFrame, df: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], dict], outputs: str, fold: str = "fold") -> DataFrame:
    """(series_id, fold, outputs) of a Python callable that gets a fold's training and test rows of a series, in order, and
    gives a dict of the outputs ("score double, ..."). Folds run side by side; a fold's rows, which a model needs together,
    are one task's."""
    names = [x.split()[0] for x in outputs.split(", ")]
    d = members.where(F.col("role").isin("train", "test")).select("series_id", "ts", F.col(fold).alias("_fold"), F.col("role").alias("_role")).join(df, ["series_id", "ts"])

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts")
        rows = [g[g["_role"] == r].drop(columns=["_role", "_fold"]) for r in ("train", "test")]
        got = run(*rows)
        return pd.DataFrame({"series_id": [g["series_id"].iloc[0]], "fold": [int(g["_fold"].iloc[0])], **{n: [got[n]] for n in names}})

    return d.groupBy("series_id", "_fold").applyInPandas(one, f"series_id string, fold int, {outputs}")


def cross_validate(df: DataFrame, scorer: Callable[[pd.DataFrame, pd.DataFrame], float], folds: DataFrame, fold: str = "fold") -> DataFrame:
    """(series_id, n_scores, cv_mean, cv_std): a scorer's results over the folds (purged_folds(), purge() or
    combinatorial_members()); sample weights are a column of df, if wanted."""
    s = per_fold(folds, df, lambda train, test: {"score": float(scorer(train, test))}, "score double", fold)
    return s.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_scores"), F.avg("score").alias("cv_mean"), F.stddev_pop("score").alias("cv_std"))


def walk_forward_members(df: DataFrame, train: int = 252, test: int = 63, step: int = 21, mode: str = "expanding") -> DataFrame:
    """(series_id, ts, fold, role): fold f tests the rows from f * step + train on. mode 'expanding' trains on all rows before;
    'rolling' on those from f * step - train on, up to twice ``train``, as the analyser defines it; 'fixed' on ``train`` rows."""
    d = numbered(df).withColumn("_last", F.floor((F.col("n") - train - test) / step)).where("_last >= 0")
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("_last").cast("int"))))
    at = F.col("fold") * step
    start = {"expanding": F.lit(0), "rolling": F.greatest(F.lit(0), at - train), "fixed": at}[mode]
    role = F.when((F.col("rn") >= start) & (F.col("rn") < at + train), "train").when((F.col("rn") >= at + train) & (F.col("rn") < at + train + test), "test")
    return d.withColumn("role", role).where("role is not null").select("series_id", "ts", "fold", "role")


def intervals(df: DataFrame, horizon: int) -> DataFrame:
    """Label intervals: from a row's date to that of the row horizon later, or the last one."""
    last = F.max("ts").over(Window.partitionBy("series_id"))
    return df.select("series_id", "ts", F.col("ts").alias("t0"), F.coalesce(F.lead("ts", horizon).over(W()), last).alias("t1"))


def uniqueness(iv: DataFrame) -> DataFrame:
    """Mean over the rows of a label's interval of 1 / (labels alive there).

    A sweep: labels alive at a row are starts so far less ends before it; the sums of 1 / alive up to t1 and up to
    before t0 give the mean. Two windows and one equi-join on t1 instead of a range join."""
    ends = iv.groupBy("series_id", F.col("t1").alias("ts")).agg(F.count(F.lit(1)).alias("_e"))
    d = iv.join(ends, ["series_id", "ts"], "left").withColumn("_e", F.coalesce("_e", F.lit(0)))
    alive = F.count(F.lit(1)).over(o.so_far(W())) - F.coalesce(F.sum("_e").over(W().rowsBetween(o.START, -1)), F.lit(0))
    d = d.withColumn("alive", alive).withColumn("_s", F.sum(1 / F.col("alive")).over(o.so_far(W()))).withColumn("_n", F.row_number().over(W()))
    at = d.select("series_id", F.col("ts").alias("t1"), F.col("_s").alias("_s1"), F.col("_n").alias("_n1"))
    d = d.join(at, ["series_id", "t1"])
    u = (F.col("_s1") - F.col("_s") + 1 / F.col("alive")) / (F.col("_n1") - F.col("_n") + 1)
    return d.select("series_id", "ts", "t0", "t1", "alive", u.alias("uniqueness"))


def weights(u: DataFrame, decay: float = 0.0) -> DataFrame:
    """Sample weights from uniqueness, times exp(-decay * days to the last interval end), that sum to the number of labels."""
    p = Window.partitionBy("series_id")
    d = u.withColumn("_w", F.col("uniqueness") * F.exp(-decay * F.datediff(F.max("t1").over(p), F.col("t0"))))
    w = F.when(F.sum("_w").over(p) > 0, F.col("_w") / F.sum("_w").over(p) * F.count(F.lit(1)).over(p)).otherwise(1.0)
    return d.withColumn("weight", w).drop("_w")


def overlap_count(iv: DataFrame) -> DataFrame:
    """Pairs of labels that meet: all pairs less those in which one ends before the other begins, from one ordered window."""
    ends = iv.select("series_id", F.col("t1").alias("at"), F.lit(1).alias("side"), F.lit(1).alias("e"))
    starts = iv.select("series_id", F.col("t0").alias("at"), F.lit(0).alias("side"), F.lit(0).alias("e"))
    w = o.series(order=("at", "side"))
    d = ends.unionByName(starts).withColumn("before", F.sum("e").over(o.so_far(w)))
    g = d.where("side = 0").groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.sum("before").alias("apart"))
    return g.select("series_id", "n", (F.col("n") * (F.col("n") - 1) / 2 - F.col("apart")).cast("long").alias("pairs"))


def pbo(returns: DataFrame, is_share: float = 0.5, af: int = 252) -> DataFrame:
    """Probability of overfitting of configurations (config_id, ts, ret): the share whose out-of-sample Sharpe is below
    the median, the configuration best in sample, and whether it is among those (rank-based variant)."""
    w = Window.partitionBy("config_id").orderBy("ts")
    d = returns.withColumns({"_k": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy("config_id"))})
    d = d.withColumn("_is", F.col("_k") <= F.floor(F.col("_n") * is_share))
    sh = lambda on: F.coalesce(F.try_divide(F.avg(F.when(on, F.col("ret"))), F.stddev_samp(F.when(on, F.col("ret")))) * math.sqrt(af), F.lit(0.0))
    g = d.groupBy("config_id").agg(sh(F.col("_is")).alias("sharpe_is"), sh(~F.col("_is")).alias("sharpe_oos"))
    m = g.agg(F.percentile("sharpe_oos", 0.5).alias("m"))
    g = g.join(F.broadcast(m))  # one row
    best = F.min_by(F.struct("config_id", "sharpe_oos", "m"), F.struct(-F.col("sharpe_is"), F.col("config_id")))
    return g.agg(F.avg((F.col("sharpe_oos") < F.col("m")).cast("double")).alias("pbo"), best.alias("b"), F.count(F.lit(1)).alias("n_configs")).select("pbo", "n_configs", F.col("b.config_id").alias("best_is"), (F.col("b.sharpe_oos") < F.col("b.m")).alias("best_is_below_median"))


def overfitting(runs: DataFrame, is_share: float = 0.5) -> DataFrame:
    """(series_id, pbo): per series, the share of its configurations (series_id, config_id, ts, ret) whose out-of-sample Sharpe
    ratio is below their median."""
    w, p = Window.partitionBy("series_id", "config_id"), Window.partitionBy("series_id")
    d = runs.withColumns({"_k": F.row_number().over(w.orderBy("ts")), "_n": F.count(F.lit(1)).over(w)}).where(F.col("_k") > F.floor(F.col("_n") * is_share))
    g = d.groupBy("series_id", "config_id").agg(F.coalesce(F.try_divide(F.avg("ret"), F.stddev_samp("ret")), F.lit(0.0)).alias("s"))
    return g.withColumn("m", F.percentile("s", 0.5).over(p)).groupBy("series_id").agg(F.avg((F.col("s") < F.col("m")).cast("double")).alias("pbo"))


def uniform(*keys, seed: int = 0):
    """A number in (0, 1) from a hash of keys: the same wherever the row is computed."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(2**52)) + 0.5) / float(2**52)


def normal(*keys, seed: int = 0):
    u, v = uniform(*keys, F.lit(1), seed=seed), uniform(*keys, F.lit(2), seed=seed)
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)


def synthetic_paths(returns: DataFrame, n_paths: int, n_rows: int, method: str = "normal", start: float = 100.0, seed: int = 42) -> DataFrame:
    """(series_id, sim, step, ret, value): simulated returns of each series' mean and deviation, or drawn from its own."""
    if method not in ("normal", "bootstrap"):
        raise ValueError(f"unknown method {method!r}")
    stats = returns.where("ret is not null").groupBy("series_id").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.count(F.lit(1)).alias("n"))
    d = stats.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n_paths - 1)))).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    if method == "normal":
        d = d.withColumn("ret", F.col("m") + F.col("s") * normal("series_id", "sim", "step", seed=seed))
    else:
        d = d.withColumn("_k", F.floor(uniform("series_id", "sim", "step", seed=seed) * F.col("n")).cast("int"))
        own = returns.where("ret is not null").select("series_id", (F.row_number().over(W()) - 1).alias("_k"), "ret")
        d = d.join(own, ["series_id", "_k"])
    w = o.series(("series_id", "sim"), "step")
    return d.select("series_id", "sim", "step", "ret", (F.lit(start) * F.product(1 + F.col("ret")).over(o.so_far(w))).alias("value"))


def path_summary(paths: DataFrame) -> DataFrame:
    """(series_id, sim, n, total_return, last, low): a row per simulated path."""
    end = F.max_by("value", "step")
    return paths.groupBy("series_id", "sim").agg(F.count(F.lit(1)).alias("n"), (F.product(1 + F.col("ret")) - 1).alias("total_return"), end.alias("last"), F.min("value").alias("low"))


def robustness(paths: DataFrame, strategy: Callable[[pd.DataFrame], dict] | None = None) -> DataFrame:
    """Mean, deviation, extremes and success share over simulated paths of a statistic, by default the total return; a
    Python strategy gets one path at a time and gives {'total_return': x}."""
    if strategy is None:
        per = paths.groupBy("series_id", "sim").agg((F.product(1 + F.col("ret")) - 1).alias("total_return"))
    else:

        def run(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("step")
            return pd.DataFrame({"series_id": [g["series_id"].iloc[0]], "sim": [int(g["sim"].iloc[0])], "total_return": [float(strategy(g)["total_return"])]})

        per = paths.groupBy("series_id", "sim").applyInPandas(run, "series_id string, sim int, total_return double")
    x = F.col("total_return")
    return per.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_paths"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg((x > 0).cast("double")).alias("success_share"))


def sequential_bootstrap(iv: DataFrame, draws: int, replicates: int = 1, seed: int = 42) -> DataFrame:
    """(series_id, replicate, draw, ts): labels drawn one after another with the probability of their remaining
    uniqueness, which shrinks by the overlap with those drawn. Sequential by nature: one replicate is one group."""
    d = iv.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts")
        name, rep = g["series_id"].iloc[0], int(g["replicate"].iloc[0])
        t0, t1 = (pd.to_datetime(g[c]).to_numpy().astype("datetime64[D]").astype(np.int64) for c in ("t0", "t1"))
        left, rng = np.ones(len(g)), np.random.default_rng([seed, rep, sum(name.encode())])
        picked = []
        for _ in range(min(draws, len(g))):
            if left.sum() <= 0:
                break
            i = int(rng.choice(len(g), p=left / left.sum()))
            picked.append(i)
            both = np.maximum(0, np.minimum(t1, t1[i]) - np.maximum(t0, t0[i]) + 1)
            left = left * (1 - both / (t1 - t0 + 1))
            left[i] = 0
        return pd.DataFrame({"series_id": name, "replicate": rep, "draw": range(len(picked)), "ts": g["ts"].to_numpy()[picked]})

    return d.groupBy("series_id", "replicate").applyInPandas(run, "series_id string, replicate int, draw int, ts date")


def status(metrics: DataFrame) -> DataFrame:
    """PASS, WARNING or FAIL from (pbo, dsr, cv_ratio)."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    fail = yes(F.col("pbo") > 0.7) | yes(F.col("dsr") < 0.80)
    warn = yes(F.col("pbo") > 0.3) | yes(F.col("dsr") < 0.95) | yes(F.col("cv_ratio") > 0.2)
    return metrics.withColumn("status", F.when(fail, "FAIL").when(warn, "WARNING").otherwise("PASS"))


def quality(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(series_id, n_rows, missing_share, n_constant, minority_share): what a data-quality check of a training table looks at."""
    gaps = sum((F.col(c).isNull().cast("double") for c in features), F.lit(0.0)) / max(1, len(features))
    flat = sum(((F.min(c) == F.max(c)) | F.min(c).isNull()).cast("long") for c in features)
    share = F.avg(F.col(label).cast("double"))
    return df.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(gaps).alias("missing_share"), flat.alias("n_constant"), F.least(share, 1 - share).alias("minority_share"))


def _judged(bt: DataFrame, horizon: int, trials: int, runs: DataFrame | None, scores: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """A row per series of all that validate() and report() tell of a backtest, and the labels' uniqueness."""
    from . import metrics, portfolio

    wf = portfolio.walk_forward_summary(portfolio.walk_forward(bt, 252, 63, 21, include_last=True))
    labels = uniqueness(intervals(bt, horizon))
    u = labels.groupBy("series_id").agg(F.avg("uniqueness").alias("mean_uniqueness"))
    p = metrics.sharpe_probabilities(bt, trials)
    d = p.join(u, "series_id").join(wf, "series_id", "left")
    ratio = F.try_divide("std_sharpe", F.abs("mean_sharpe"))
    if scores is not None:
        d, ratio = d.join(scores, "series_id", "left"), F.coalesce(F.try_divide("cv_std", F.abs("cv_mean")), ratio)
    d = d.withColumn("cv_ratio", F.coalesce(ratio, F.lit(0.0)))
    d = d.withColumn("pbo", F.lit(None).cast("double")) if runs is None else d.join(overfitting(runs), "series_id", "left")
    length = bt.groupBy("series_id").agg(F.count("ret").alias("n_returns"))
    return status(d.join(length, "series_id").withColumn("long_enough", F.col("n_returns") >= F.col("min_backtest"))), labels


def validate(bt: DataFrame, horizon: int = 7, trials: int = 10, runs: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """One row per series: fold summary, uniqueness, probabilistic ratios, minimum length and status of a backtest's returns.

    runs: returns of the configurations tried (series_id, config_id, ts, ret), from which the probability of overfitting is
    estimated; without them it is null and takes no part in the status. scores: cross_validate()'s result, whose spread
    then stands for that of the walk-forward folds.
    """
    return _judged(bt, horizon, trials, runs, scores)[0].drop("min_sharpe", "max_sharpe", "mean_return", "std_return", "mean_drawdown", "worst_drawdown", "success_share")


#: What report() tells, by section.
SECTIONS = {
    "quality": ("n_rows", "missing_share", "n_constant", "minority_share"),
    "labels": ("n_overlaps", "mean_uniqueness", "low_weight", "high_weight"),
    "cross_validation": ("n_scores", "cv_mean", "cv_std", "cv_ratio"),
    "walk_forward": ("n_folds", "mean_sharpe", "std_sharpe", "min_sharpe", "max_sharpe", "mean_return", "worst_drawdown", "success_share"),
    "significance": ("psr", "dsr", "pbo"),
    "length": ("n_returns", "min_backtest"),
}


def report(bt: DataFrame, data: DataFrame | None = None, features: list[str] | None = None, label: str = "label", horizon: int = 7, trials: int = 10, decay: float = 0.0, runs: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """(series_id, section, metric, value, verdict): the whole validation of a backtest, a row per figure of SECTIONS.

    data, features, label: the training table whose quality is told. decay: of the sample weights. verdict is PASS, WARNING or
    FAIL where a figure has limits (those of status(), a missing share of 5 and 20 percent, any constant feature, a minority
    class of 10 and 2 percent, a history shorter than the minimum), else null. What wasn't asked for (quality without data,
    scores, runs) has null values and no verdict, as have the folds of a series too short for one (its cv_ratio is 0). An empty backtest gives no rows.
    """
    d, labels = _judged(bt, horizon, trials, runs, scores)
    w = weights(labels, decay).groupBy("series_id").agg(F.min("weight").alias("low_weight"), F.max("weight").alias("high_weight"))
    pairs = overlap_count(labels).select("series_id", F.col("pairs").alias("n_overlaps"))
    d = d.join(w, "series_id").join(pairs, "series_id", "left")
    if data is not None:
        d = d.join(quality(data, features or [], label), "series_id", "left")
    there = set(d.columns)
    rows = [F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), (F.col(m) if m in there else F.lit(None)).cast("double").alias("value")) for s, ms in SECTIONS.items() for m in ms]
    r = d.select("series_id", F.col("min_backtest").alias("_least"), F.explode(F.array(*rows)).alias("_r")).select("series_id", "_least", "_r.*")
    x, of = F.col("value"), lambda m: F.col("metric") == m
    grade = lambda fail, warn: F.when(fail, "FAIL").when(warn, "WARNING").otherwise("PASS")
    none = F.lit(False)
    limits = {
        "pbo": (x > 0.7, x > 0.3), "dsr": (x < 0.80, x < 0.95), "cv_ratio": (none, x > 0.2), "missing_share": (x > 0.2, x > 0.05),
        "n_constant": (none, x > 0), "minority_share": (x < 0.02, x < 0.1), "n_returns": (none, x < F.col("_least")),
    }
    verdict = F.when(x.isNull(), None)
    for m, (fail, warn) in limits.items():
        verdict = verdict.when(of(m), grade(fail, warn))
    return r.withColumn("verdict", verdict.cast("string")).drop("_least")
