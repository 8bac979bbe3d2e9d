"""Performance metrics of a returns table (series_id, ts, ret), one aggregation per question."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered as o

W = o.series
ANNUAL = {"D": 252, "W": 52, "M": 12, "Q": 4, "Y": 1}
R = F.col


def _sharpe(m: Column, s: Column, af: float) -> Column:
    return F.coalesce(F.when(s > 0, m / s * math.sqrt(af)), F.lit(0.0))


def performance(df: DataFrame, af: int = 252, rf: float = 0.0) -> DataFrame:
    """Total return, CAGR, volatility, Sharpe, Sortino, drawdown, Calmar, skewness and kurtosis."""
    d = df.withColumn("_eq", F.product(1 + R("ret")).over(o.so_far(W())))
    d = d.withColumn("_dd", R("_eq") / F.max("_eq").over(o.so_far(W())) - 1)
    g = d.groupBy("series_id").agg(
        F.count("ret").alias("n"), (F.product(1 + R("ret")) - 1).alias("total_return"), F.avg(R("ret") - rf / af).alias("_m"), F.stddev_samp("ret").alias("_s"),
        F.stddev_samp(F.when(R("ret") < 0, R("ret"))).alias("_d"), F.min("_dd").alias("max_drawdown"), o.skew("ret").alias("skew"), o.kurtosis("ret").alias("kurt"),
    )
    g = g.withColumns({"cagr": F.pow(1 + R("total_return"), F.lit(float(af)) / R("n")) - 1, "volatility": R("_s") * math.sqrt(af), "sharpe": _sharpe(R("_m"), R("_s"), af), "sortino": _sharpe(R("_m"), R("_d"), af)})
    return g.withColumn("calmar", F.try_divide(R("cagr"), F.abs("max_drawdown"))).drop("_m", "_s", "_d")


def tails(df: DataFrame) -> DataFrame:
    """Omega (= profit factor), payoff, win rate, Kelly, tail ratio, common-sense ratio and CPC; null without losses."""
    q = F.percentile("ret", F.array(F.lit(0.05), F.lit(0.95)))
    g = df.groupBy("series_id").agg(
        F.sum(F.when(R("ret") > 0, R("ret"))).alias("_up"), F.abs(F.sum(F.when(R("ret") <= 0, R("ret")))).alias("_down"),
        F.avg(F.when(R("ret") > 0, R("ret"))).alias("_win"), F.abs(F.avg(F.when(R("ret") <= 0, R("ret")))).alias("_loss"),
        F.avg((R("ret") > 0).cast("double")).alias("win_rate"), F.abs(F.try_divide(q[1], q[0])).alias("tail_ratio"),
    )
    g = g.withColumns({"profit_factor": F.try_divide("_up", "_down"), "payoff": F.try_divide("_win", "_loss")})
    g = g.withColumn("kelly", F.greatest(F.lit(0.0), R("win_rate") - F.try_divide(1 - R("win_rate"), R("payoff"))))
    return g.withColumns({"common_sense": F.sqrt(R("tail_ratio") * R("profit_factor")), "cpc": R("profit_factor") * R("win_rate")}).drop("_up", "_down", "_win", "_loss")


def against(df: DataFrame, benchmark: DataFrame, af: int = 252) -> DataFrame:
    """Information ratio, R squared, outperformance and excess Sharpe on dates that both have."""
    j = df.join(benchmark.select("ts", R("ret").alias("_b")), "ts")
    j = j.withColumn("_e", R("ret") - R("_b"))
    g = j.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_e").alias("_m"), F.stddev_samp("_e").alias("_s"), F.pow(F.corr("ret", "_b"), 2).alias("r_squared"),
        (F.product(1 + R("ret")) - F.product(1 + R("_b"))).alias("outperformance"), F.avg("ret").alias("_ma"), F.stddev_samp("ret").alias("_sa"), F.avg("_b").alias("_mb"), F.stddev_samp("_b").alias("_sb"),
    )
    return g.withColumns({"information_ratio": _sharpe(R("_m"), R("_s"), af), "excess_sharpe": _sharpe(R("_ma"), R("_sa"), af) - _sharpe(R("_mb"), R("_sb"), af)}).drop("_m", "_s", "_ma", "_sa", "_mb", "_sb")


def at_risk(df: DataFrame, days: float = 5.0, q: float = 0.05) -> DataFrame:
    """VaR and CVaR of a day's share of the returns, and expected returns over day, week, month and year."""
    v = df.groupBy("series_id").agg(F.percentile(R("ret") / days, q).alias("var"))
    g = df.join(v, "series_id").groupBy("series_id").agg(F.first("var").alias("var"), (F.avg(F.when(R("ret") <= days * R("var"), R("ret"))) / days).alias("cvar"), F.avg("ret").alias("_m"))
    return g.select("series_id", "var", "cvar", (R("_m") / 5).alias("expected_day"), R("_m").alias("expected_week"), (R("_m") * 4.33).alias("expected_month"), (R("_m") * 252).alias("expected_year"))


def runs(df: DataFrame) -> DataFrame:
    """Longest runs of wins and of losses."""
    out = None
    for name, on in (("max_wins", R("ret") > 0), ("max_losses", R("ret") < 0)):
        d = df.withColumn("_on", F.coalesce(on, F.lit(False)))
        d = d.withColumn("_run", o.islands(~R("_on"), W())).groupBy("series_id", "_run").agg(F.sum(R("_on").cast("long")).alias("k"))
        d = d.groupBy("series_id").agg(F.max("k").alias(name))
        out = d if out is None else out.join(d, "series_id")
    return out


def longest_drawdown(df: DataFrame) -> DataFrame:
    """Most rows in a row below the running peak of the compounded returns, an open run included."""
    d = df.withColumn("_eq", F.product(1 + R("ret")).over(o.so_far(W())))
    d = d.withColumn("_under", R("_eq") < F.max("_eq").over(o.so_far(W())))
    d = d.withColumn("_run", o.islands(~R("_under"), W())).groupBy("series_id", "_run").agg(F.sum(R("_under").cast("long")).alias("k"))
    return d.groupBy("series_id").agg(F.max("k").alias("longest_drawdown"))


def by_period(df: DataFrame, split: str, af: int = 252) -> DataFrame:
    """In-sample, out-of-sample and full statistics side by side."""
    cut = F.lit(split).cast("date")
    d = df.withColumn("period", F.explode(F.array(F.lit("full"), F.when(R("ts") < cut, "is").otherwise("oos"))))
    return d.groupBy("series_id", "period").agg(
        F.count(F.lit(1)).alias("n"), (F.product(1 + R("ret")) - 1).alias("total_return"), F.max("ret").alias("best"), F.min("ret").alias("worst"),
        _sharpe(F.avg("ret"), F.stddev_samp("ret"), af).alias("sharpe"), F.try_divide(F.avg(F.when(R("ret") > 0, R("ret"))), F.abs(F.avg(F.when(R("ret") < 0, R("ret"))))).alias("win_loss"),
    )


def sharpe_inputs(df: DataFrame, af: int = 252) -> DataFrame:
    """What the probabilistic ratios are made of: n, annual Sharpe, skewness and (not excess) kurtosis."""
    g = df.groupBy("series_id").agg(F.count("ret").alias("n"), _sharpe(F.avg("ret"), F.stddev_samp("ret"), af).alias("sharpe"), o.skew("ret").alias("skew"), (o.kurtosis("ret") + 3).alias("kurtosis"))
    return g.withColumn("psr_z", F.try_divide(R("sharpe") * F.sqrt(R("n") - 1), F.sqrt(F.greatest(F.lit(1e-12), 1 - R("skew") * R("sharpe") + (R("kurtosis") - 1) / 4 * R("sharpe") * R("sharpe")))))


def expected_max_sharpe(trials: int, variance: float = 1.0) -> float:
    """Expected best Sharpe ratio of so many trials without skill."""
    if trials < 2:
        return 0.0
    n, gamma = NormalDist(), 0.5772156649015329
    return math.sqrt(variance) * ((1 - gamma) * n.inv_cdf(1 - 1 / trials) + gamma * n.inv_cdf(1 - 1 / (trials * math.e)))


def probabilistic_sharpe(sharpe: float, n: int, skew: float, kurtosis: float, benchmark: float = 0.0) -> float:
    return NormalDist().cdf((sharpe - benchmark) * math.sqrt(max(0, n - 1)) / math.sqrt(max(1e-12, 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe)))


def deflated_sharpe(sharpe: float, n: int, skew: float, kurtosis: float, trials: int, variance: float | None = None) -> float:
    """The probabilistic ratio against the best of so many trials; variance of the trials' ratios, by default that of an estimate."""
    v = (1 + (1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe)) / max(1, n - 1) if variance is None else variance
    return probabilistic_sharpe(sharpe, n, skew, kurtosis, expected_max_sharpe(trials, v))


def min_backtest_length(sharpe: float, n: int, target: float = 1.0) -> float:
    return math.inf if sharpe == 0 else math.ceil(max(n, ((target / sharpe) ** 2 - 1) * n))


def sharpe_probabilities(df: DataFrame, trials: int = 10, af: int = 252) -> DataFrame:
    """psr, dsr and min_backtest per series; the inputs are one row per series, the normal integral a small Arrow batch."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = list(zip(b["sharpe"], b["n"], b["skew"], b["kurtosis"], strict=True))
            yield pd.DataFrame({"series_id": b["series_id"], "psr": [probabilistic_sharpe(*r) for r in rows], "dsr": [deflated_sharpe(*r, trials) for r in rows], "min_backtest": [float(min_backtest_length(s, n)) for s, n, _, _ in rows]})

    return sharpe_inputs(df, af).mapInPandas(run, "series_id string, psr double, dsr double, min_backtest double")


def yearly(df: DataFrame) -> DataFrame:
    """Return per calendar year and growth since the start."""
    g = df.groupBy("series_id", F.year("ts").alias("year")).agg((F.product(1 + R("ret")) - 1).alias("year_return"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("growth", F.product(1 + R("year_return")).over(o.so_far(o.series(order="year"))))


def regimes(df: DataFrame, state: str) -> DataFrame:
    """Statistics of returns above and below the median of a state column."""
    m = Window.partitionBy("series_id")
    d = df.where(R(state).isNotNull()).withColumn("regime", F.when(R(state) > F.percentile(state, 0.5).over(m), "high").otherwise("low"))
    return d.groupBy("series_id", "regime").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean_ret"), F.stddev_samp("ret").alias("std_ret"), F.avg((R("ret") > 0).cast("double")).alias("win_rate"))


def t_test(df: DataFrame) -> DataFrame:
    """t statistic of the mean return and z of the Sharpe ratio."""
    return df.groupBy("series_id").agg(F.count("ret").alias("n"), (F.avg("ret") / (F.stddev_samp("ret") / F.sqrt(F.count("ret")))).alias("t_stat"), (F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.count("ret")) / F.sqrt(1 + F.pow(F.avg("ret") / F.stddev_samp("ret"), 2) / 2)).alias("sharpe_z"))


def adjusted(p: DataFrame, by: str = "family") -> DataFrame:
    """Bonferroni, Holm and false-discovery adjustments of p values (family, test, p)."""
    up = Window.partitionBy(by).orderBy("p", "test")
    d = p.withColumns({"_k": F.row_number().over(up), "_m": F.count(F.lit(1)).over(Window.partitionBy(by))})
    holm = F.max(R("p") * (R("_m") - R("_k") + 1)).over(up.rowsBetween(o.START, 0))
    fdr = F.min(R("p") * R("_m") / R("_k")).over(up.rowsBetween(0, o.END))
    return d.withColumns({"bonferroni": F.least(F.lit(1.0), R("p") * R("_m")), "holm": F.least(F.lit(1.0), holm), "fdr": F.least(F.lit(1.0), fdr)}).drop("_k", "_m")


def normal_cdf(z: Column) -> Column:
    """The standard normal integral, by its series of odd powers (all terms of one sign) within 8 deviations, 0 or 1 beyond."""
    x = F.least(F.lit(8.0), F.greatest(F.lit(-8.0), z))
    grow = lambda a, k: F.struct((a["term"] * x * x / (2 * k + 1)).alias("term"), (a["total"] + a["term"] * x * x / (2 * k + 1)).alias("total"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(150)), F.struct(x.alias("term"), x.alias("total")), grow, lambda a: a["total"])
    return F.when(z >= 8, 1.0).when(z <= -8, 0.0).when(z.isNotNull(), 0.5 + F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * total)


def loss_probability(df: DataFrame, threshold: float = -0.10, horizon: int = 252) -> DataFrame:
    """(series_id, n, z, probability): the chance that the returns of so many rows add up to less than the threshold, if they are
    normal. Without spread (or with fewer than two returns) z and probability are null."""
    g = df.groupBy("series_id").agg(F.count("ret").alias("n"), F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_s"))
    g = g.withColumn("z", F.when(R("_s") > 0, (threshold - R("_m") * horizon) / (R("_s") * math.sqrt(horizon))))
    return g.select("series_id", "n", "z", normal_cdf(R("z")).alias("probability"))


def shortfall(fills: DataFrame) -> DataFrame:
    """fills (decision and execution prices, side 1 to buy or -1 to sell) with ``shortfall``: the cost of being late, as a share
    of the decision's price. Null prices and decisions at 0 give null."""
    return fills.withColumn("shortfall", R("side") * F.try_divide(R("execution") - R("decision"), R("decision")))


def shortfall_summary(fills: DataFrame) -> DataFrame:
    """(series_id, n, mean, worst, total, share_adverse) of shortfall()'s rows; nulls take no part."""
    x = R("shortfall")
    return fills.groupBy("series_id").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.max(x).alias("worst"), F.sum(x).alias("total"), F.avg((x > 0).cast("double")).alias("share_adverse"))


def degradation(df: DataFrame, split: str, n_features: int, af: int = 252) -> DataFrame:
    """(series_id, sharpe_is, sharpe_oos, degradation, samples_per_feature): what of the in-sample ratio is lost from the date
    ``split`` on (null if there was none to lose), and in-sample rows per feature."""
    early = R("ts") < F.lit(split).cast("date")
    a, b = F.when(early, R("ret")), F.when(~early, R("ret"))
    g = df.groupBy("series_id").agg(_sharpe(F.avg(a), F.stddev_samp(a), af).alias("sharpe_is"), _sharpe(F.avg(b), F.stddev_samp(b), af).alias("sharpe_oos"), (F.count(a) / n_features).alias("samples_per_feature"))
    return g.withColumn("degradation", 1 - F.try_divide("sharpe_oos", "sharpe_is"))
