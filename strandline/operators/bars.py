"""Bars, event filters and microstructure measures over ticks (series_id, ts, price, volume)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered as o

W = o.series


def _ohlc(d: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    at = F.struct(*order)
    return d.groupBy(*keys).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("ticks"))


def tick_bars(ticks: DataFrame, n: int, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """A bar for every n ticks of a series; the last, incomplete one is left out."""
    d = ticks.withColumn("bar", F.floor((F.row_number().over(o.series(order=order)) - 1) / n).cast("long"))
    return _ohlc(d, ["series_id", "bar"], list(order)).where(F.col("ticks") == n)


def time_bars(ticks: DataFrame, width: str, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    d = ticks.withColumn("_w", F.window("ts", width))
    return _ohlc(d, ["series_id", "_w"], list(order)).withColumn("bar_start", F.col("_w.start")).drop("_w")


def volume_bars(ticks: DataFrame, threshold: float, dollars: bool = False, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """A bar whenever the volume (or value) since the last bar reaches the threshold; the count then starts at zero."""
    amount = F.col("price") * F.col("volume") if dollars else F.col("volume")

    def step(state, x):
        total, bar = state[0] + x[0], state[1]
        return ((0.0, bar + 1) if total >= threshold else (total, bar)), (bar, total >= threshold)

    d = o.fold(ticks.withColumn("_a", amount.cast("double")), step, (0.0, 0), ["_a"], "bar long, _full boolean", order=order)
    full = F.max("_full").over(Window.partitionBy("series_id", "bar"))
    return _ohlc(d.withColumn("_full", full).where("_full"), ["series_id", "bar"], list(order))


def tick_rule(ticks: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """side: sign of the price change, the last one where the price stands still; imbalance: its running sum."""
    w = o.series(order=order)
    s = F.signum(o.diff("price", 1, w))
    d = ticks.withColumn("_s", F.when(s != 0, s))
    d = d.withColumn("side", F.coalesce(o.ffill("_s", w), F.lit(1.0)).cast("int")).drop("_s")
    return d.withColumn("imbalance", F.sum("side").over(o.so_far(w)))


def imbalance_bars(ticks: DataFrame, ticks_expected: float = 50.0, imbalance_expected: float = 0.2, ticks_alpha: float = 0.1, imbalance_alpha: float = 0.1, volume: bool = False, most_ticks: float = 1000.0, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """A bar when the signed ticks (or signed volume) since the last one reach, on either side, what was expected of a bar:
    expected ticks times expected imbalance per tick.

    Both expectations are exponential means over the bars so far, so the threshold is an estimate that the state carries
    along: alpha 0 keeps the first ones (a fixed threshold of ticks_expected * imbalance_expected). Expected ticks stay
    within 1 and ``most_ticks``, or a bar of much one-sided flow would put off the next one for ever. Rows get theta, the
    bar's imbalance, and threshold, what it was held against; the last, open bar is left out.
    """
    d = tick_rule(ticks, order).withColumn("_b", F.col("side") * (F.col("volume").cast("double") if volume else F.lit(1.0)))

    def step(state, x):
        theta, n, t, b, bar = state
        theta, n = theta + x[0], n + 1
        edge = t * abs(b)
        if abs(theta) < edge:
            return (theta, n, t, b, bar), (bar, theta, edge, False)
        t = min(most_ticks, max(1.0, t + ticks_alpha * (n - t)))
        b = b + imbalance_alpha * (theta / n - b)
        return (0.0, 0, t, b, bar + 1), (bar, theta, edge, True)

    d = o.fold(d, step, (0.0, 0, float(ticks_expected), float(imbalance_expected), 0), ["_b"], "bar long, _theta double, _edge double, _full boolean", order=order)
    w = Window.partitionBy("series_id", "bar")
    closed = lambda c: F.max(F.when(F.col("_full"), F.col(c))).over(w)
    d = d.withColumns({"theta": closed("_theta"), "threshold": closed("_edge")}).where("theta is not null")
    return _ohlc(d, ["series_id", "bar", "theta", "threshold"], list(order))


def cusum(df: DataFrame, threshold: float) -> DataFrame:
    """event 1 or -1 where the sum of returns above (below) zero reaches the threshold; the sums then start anew."""

    def step(state, x):
        r = 0.0 if x[0] is None or x[0] != x[0] else x[0]
        up, down = max(0.0, state[0] + r), min(0.0, state[1] + r)
        if down < -threshold:
            return (up, 0.0), (-1,)
        if up > threshold:
            return (0.0, down), (1,)
        return (up, down), (0,)

    return o.fold(df.withColumn("_r", o.pct_change("value", 1, W())), step, (0.0, 0.0), ["_r"], "event int").drop("_r")


def frac_weights(d: float, n: int) -> list[float]:
    out = [1.0]
    for k in range(1, n):
        out.append(-out[-1] * (d - k + 1) / k)
    return out


def frac_diff(df: DataFrame, d: float, n: int) -> DataFrame:
    """Fractional difference with a fixed window of n weights."""
    w = frac_weights(d, n)
    x = sum((F.lag("value", k).over(W()) * c if k else F.col("value") * c for k, c in enumerate(w)), F.lit(0.0))
    return df.withColumn("frac", x)


def liquidity(bars: DataFrame, n: int = 20) -> DataFrame:
    """Roll's spread, Amihud's illiquidity and Kyle's lambda over the last n bars (series_id, ts, value, volume)."""
    d = bars.withColumns({"_d": o.diff("value", 1, W()), "_r": o.pct_change("value", 1, W())})
    d = d.withColumns({"_l": F.lag("_d").over(W()), "_q": F.signum("_d") * F.col("volume")})
    cov = F.when(F.count("_l").over(o.last_rows(W(), n)) >= n, F.covar_samp("_d", "_l").over(o.last_rows(W(), n)))
    kyle = F.when(F.count("_q").over(o.last_rows(W(), n)) >= n, F.try_divide(F.covar_samp("_d", "_q").over(o.last_rows(W(), n)), F.var_samp("_q").over(o.last_rows(W(), n))))
    d = d.withColumns({"roll_spread": 2 * F.sqrt(F.greatest(F.lit(0.0), -cov)), "kyle_lambda": kyle, "_a": F.try_divide(F.abs("_r"), F.col("value") * F.col("volume"))})
    d = d.withColumn("roll_spread", F.when(cov.isNotNull(), F.col("roll_spread")))
    return d.withColumn("amihud", o.full(F.avg, "_a", n, W())).drop("_d", "_r", "_l", "_q", "_a")


def vpin(bars: DataFrame, n: int = 10) -> DataFrame:
    """Share of one-sided volume over the last n bars, sides by the sign of the change."""
    d = bars.withColumn("_q", F.signum(o.diff("value", 1, W())) * F.col("volume"))
    return d.withColumn("vpin", F.try_divide(o.full(F.sum, F.abs(F.col("_q")), n, W()), o.full(F.sum, "volume", n, W()))).drop("_q")


def entropy(df: DataFrame) -> DataFrame:
    """Shannon entropy, in bits, of the signs of changes per series."""
    d = df.withColumn("_s", F.signum(o.diff("value", 1, W()))).where("_s is not null").groupBy("series_id", "_s").agg(F.count(F.lit(1)).alias("n"))
    d = d.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("series_id")))
    return d.groupBy("series_id").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def hurst(df: DataFrame, lags: tuple[int, ...] = (2, 4, 8, 16, 32)) -> DataFrame:
    """Slope of the log deviation of k-row changes against log k."""
    d = df.withColumns({f"_d{k}": o.diff("value", k, W()) for k in lags})
    g = d.groupBy("series_id").agg(*[F.stddev_samp(f"_d{k}").alias(f"_s{k}") for k in lags])
    g = g.select("series_id", F.explode(F.array(*[F.struct(F.lit(math.log(k)).alias("x"), F.ln(f"_s{k}").alias("y")) for k in lags])).alias("p"))
    return g.groupBy("series_id").agg(F.regr_slope("p.y", "p.x").alias("hurst"))


def daily_volatility(df: DataFrame, span: int = 20) -> DataFrame:
    """Exponentially weighted deviation of daily returns, from weighted first and second moments."""
    d = df.withColumn("_r", o.pct_change("value", 1, W())).where("_r is not null").withColumn("_q", F.col("_r") * F.col("_r"))
    d = o.ewma(d, [("_r", "_m", span), ("_q", "_v", span)])
    return d.withColumn("ewm_vol", F.sqrt(F.greatest(F.lit(0.0), F.col("_v") - F.col("_m") * F.col("_m")))).drop("_r", "_q", "_m", "_v")


def min_variance(returns: DataFrame, names: list[str]) -> dict[str, float]:
    """Weights of least variance, fully invested. Covariances are one aggregation over the dates that all have; the
    driver solves a system of the size of the portfolio."""
    import numpy as np

    wide = returns.groupBy("ts").pivot("series_id", names).agg(F.first("ret")).na.drop("any")
    row = wide.agg(*[F.covar_samp(f"`{a}`", f"`{b}`").alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
    c = np.array([[row[f"{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))])
    x = np.linalg.solve(c + np.eye(len(names)) * 1e-12, np.ones(len(names)))
    return dict(zip(names, map(float, x / x.sum()), strict=True))
