"""Where a return comes from: factors, risk, and classes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(returns: DataFrame, factors: DataFrame, names: Sequence[str]) -> DataFrame:
    """(series_id, n, _xx, _xy, _yy, _sx): the sums that a regression of ret on the factors and a constant needs, combined
    before the shuffle; factors is a row per ts. Rows with a gap are left out."""
    x = [F.lit(1.0), *[F.col(f"`{f}`") for f in names]]
    d = returns.select("series_id", "ts", "ret").join(factors.select("ts", *names), "ts").dropna(subset=["ret", *names])
    xx = F.array(*[F.sum(a * b) for i, a in enumerate(x) for b in x[i:]])
    return d.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), xx.alias("_xx"), F.array(*[F.sum(a * F.col("ret")) for a in x]).alias("_xy"), F.sum(F.col("ret") * F.col("ret")).alias("_yy"))


def factor_attribution(returns: DataFrame, factors: DataFrame, names: Sequence[str], af: int = 252) -> DataFrame:
    """(series_id, n, alpha, r2, beta_<f>, part_<f>, specific): least squares on all factors together. part_<f> is the
    exposure times the factor's mean return over a year, alpha the constant over a year, so alpha and parts add up to
    the mean return; specific is the deviation of the residuals over a year. Series with too few rows, or factors that
    can't be told apart, have null.

    One aggregation gives each series' sums; each is then solved by itself, a small row of an Arrow batch.
    """
    m = len(names) + 1
    up = np.triu_indices(m)
    fields = ["series_id string", "n long", "alpha double", "r2 double", *(f"`beta_{f}` double" for f in names), *(f"`part_{f}` double" for f in names), "specific double"]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                xx, xy = np.zeros((m, m)), np.asarray(r.xy, float)
                xx[up] = np.asarray(r.xx, float)
                xx += np.triu(xx, 1).T
                scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
                if r.n <= m or np.linalg.matrix_rank(xx / np.outer(scale, scale), tol=1e-10) < m:
                    rows.append((r.series_id, r.n, *[None] * (2 * m + 1)))
                    continue
                w = np.linalg.solve(xx, xy)
                rest = max(0.0, r.yy - float(w @ xy))
                spread = r.yy - xy[0] ** 2 / r.n
                rows.append((r.series_id, r.n, w[0] * af, 1 - rest / spread if spread > 0 else None, *w[1:], *(w[1:] * xx[0, 1:] / r.n * af), (rest / (r.n - m) * af) ** 0.5))
            yield pd.DataFrame(rows, columns=[f.split()[0].strip("`") for f in fields])

    s = moments(returns, factors, names)
    return s.select("series_id", "n", F.col("_xx").alias("xx"), F.col("_xy").alias("xy"), F.col("_yy").alias("yy")).mapInPandas(solve, ", ".join(fields))


def risk_attribution(returns: DataFrame, market: DataFrame, af: int = 252) -> DataFrame:
    """(series_id, beta, systematic, idiosyncratic, total): the market's part of a series' deviation over a year, that of what
    is left, and the whole; market is (ts, market)."""
    d = returns.join(market, "ts").where("ret is not null and market is not null")
    g = d.groupBy("series_id").agg(F.regr_slope("ret", "market").alias("beta"), F.stddev_samp("market").alias("_m"), F.stddev_samp("ret").alias("_r"), F.covar_samp("ret", "market").alias("_c"))
    left = F.col("_r") * F.col("_r") - 2 * F.col("beta") * F.col("_c") + F.col("beta") * F.col("beta") * F.col("_m") * F.col("_m")
    a = float(af) ** 0.5
    return g.select("series_id", "beta", (F.col("beta") * F.col("_m") * a).alias("systematic"), (F.sqrt(F.greatest(F.lit(0.0), left)) * a).alias("idiosyncratic"), (F.col("_r") * a).alias("total"))


def brinson(holdings: DataFrame) -> DataFrame:
    """(asset_class, allocation, selection, interaction, total) of (ts, asset_class, ret, weight, bench_weight) rows, weights
    adding up to 1 per date on each side: per date and class, over- or underweight times what the class's benchmark
    earned beyond the whole, its weight times what its own choice earned beyond the benchmark's, and both at once;
    summed over dates. Over all classes they add up to the sum of daily returns beyond the benchmark.

    A class that one side does not hold has, there, the other side's return, so it counts as allocation alone.
    """
    w, b = F.col("weight"), F.col("bench_weight")
    g = holdings.groupBy("ts", "asset_class").agg(F.sum(w).alias("w"), F.sum(b).alias("b"), F.sum(w * F.col("ret")).alias("_wr"), F.sum(b * F.col("ret")).alias("_br"))
    g = g.withColumns({"_rw": F.try_divide("_wr", "w"), "_rb": F.try_divide("_br", "b")})
    g = g.withColumns({"_rw": F.coalesce("_rw", "_rb", F.lit(0.0)), "_rb": F.coalesce("_rb", "_rw", F.lit(0.0))})
    whole = g.groupBy("ts").agg(F.sum(F.col("b") * F.col("_rb")).alias("_all"))
    d = g.join(whole, "ts")
    more, better = F.col("w") - F.col("b"), F.col("_rw") - F.col("_rb")
    out = d.groupBy("asset_class").agg(F.sum(more * (F.col("_rb") - F.col("_all"))).alias("allocation"), F.sum(F.col("b") * better).alias("selection"), F.sum(more * better).alias("interaction"))
    return out.withColumn("total", F.col("allocation") + F.col("selection") + F.col("interaction"))
