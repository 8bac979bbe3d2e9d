"""The feature sets of the learning strategies, over panels: one row per date with a column per role.

A panel is made of a long table by panel(); its rows carry ``panel_id``, the key of all windows, so many panels are
worked on side by side. Roles that a panel lacks are left out of a set, as their features can't be told.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import ordered as o

def W() -> WindowSpec:  # noqa: N802
    return o.series("panel_id")


#: Windows of the sets.
MOMENTUM, VOLATILITY, AVERAGES = (1, 3, 5, 10, 20, 40, 60, 120, 252), (5, 10, 20, 60), (5, 10, 20, 50, 200)
CREDIT_MOMENTUM = (2, 3, 5, 7, 10, 12, 15, 20, 25, 30, 40, 50, 60, 90, 120)
CREDIT_Z = (5, 10, 20, 40, 60, 120, 252)
CREDIT_CHANGE = (3, 5, 10, 20, 40, 60, 90)
CREDIT_LEVELS = ("cad_oas", "us_hy_oas", "us_ig_oas", "vix", "us_3m_10y", "us_lei_yoy", "us_equity_revisions", "us_hard_data_surprises", "us_growth_surprises", "tsx", "spx_1bf_eps", "tsx_1bf_eps")
GENETIC_MOMENTUM, GENETIC_WINDOWS, GENETIC_FACTORS = (1, 2, 3, 4, 6, 8, 12, 13, 26, 52), (4, 8, 13, 26), ("cad_oas", "us_ig_oas", "us_hy_oas", "vix")
WEEKLY_MACRO = ("us_growth_surprises", "us_inflation_surprises", "us_hard_data_surprises", "us_equity_revisions", "us_lei_yoy")


def panel(df: DataFrame, roles: Mapping[str, str], name: str = "all") -> DataFrame:
    """(panel_id, ts, a column per role) from long rows, on the dates that all roles have; roles: role to series_id."""
    g = df.where(F.col("series_id").isin(*set(roles.values()))).groupBy("ts")
    p = g.agg(*[F.max(F.when(F.col("series_id") == s, F.col("value"))).alias(r) for r, s in roles.items()])
    return p.dropna(subset=list(roles)).withColumn("panel_id", F.lit(name))


def _yes(c: Column) -> Column:
    return F.coalesce(c.cast("int"), F.lit(0)).cast("double")


def _mean(x: str | Column, n: int) -> Column:
    return o.full(F.avg, x, n, W())


def _filled(df: DataFrame, names: Sequence[str], carry: bool = True) -> DataFrame:
    """panel_id, ts and the features, gaps filled with the value before (if carry), then with 0."""
    fill = {c: F.coalesce(o.ffill(c, W()) if carry else F.col(c), F.lit(0.0)) for c in names}
    return df.select("panel_id", "ts", *[F.col(c).cast("double").alias(c) for c in names]).withColumns(fill)


def boosting_set(p: DataFrame, asset: str) -> DataFrame:
    """About a hundred features of an asset's price and of what else the panel has: momentum with ranks, volatility with its
    regime, averages and their crossings, oscillators, cross-asset levels and moves, moments, percentiles, trend, streaks."""
    price, have, x = F.col(asset), set(p.columns), {}
    d = o.ewma(p.withColumn("_price", price), [("_price", "_fast", 12), ("_price", "_slow", 26)], "panel_id")
    d = o.ewma(d.withColumn("_macd", F.col("_fast") - F.col("_slow")), [("_macd", "_signal", 9)], "panel_id")
    d = d.withColumn("_r", o.pct_change(price, 1, W()))
    d = d.withColumns({f"_mom{k}": o.pct_change(price, k, W()) for k in MOMENTUM} | {f"_vol{n}": o.full(F.stddev_samp, "_r", n, W()) for n in VOLATILITY})
    up, down = F.coalesce(F.col("_r") > 0, F.lit(False)), F.coalesce(F.col("_r") < 0, F.lit(False))
    d = d.withColumns({"_gain": F.greatest(F.coalesce("_r", F.lit(0.0)), F.lit(0.0)), "_loss": F.greatest(F.coalesce(-F.col("_r"), F.lit(0.0)), F.lit(0.0)), "_up": o.islands(~up, W()), "_down": o.islands(~down, W())})
    d = d.withColumn("_span", o.full(F.max, price, 2, W()) - o.full(F.min, price, 2, W()))
    for k in MOMENTUM:
        x |= {f"momentum_{k}d": F.col(f"_mom{k}"), f"momentum_{k}d_rank": o.rolling_rank(f"_mom{k}", 252, W())}
    for n in VOLATILITY:
        x |= {f"volatility_{n}d": F.col(f"_vol{n}"), f"volatility_{n}d_zscore": o.zscore(f"_vol{n}", 252, W()), f"volatility_regime_{n}d": _yes(F.col(f"_vol{n}") > o.rolling_quantile(f"_vol{n}", 0.5, 252, W()))}
    for n in AVERAGES:
        x |= {f"ma_{n}d_deviation": F.try_divide(price - _mean(price, n), _mean(price, n)), f"price_above_ma_{n}d": _yes(price > _mean(price, n))}
    x |= {f"ma_cross_{a}_{b}": _yes(_mean(price, a) > _mean(price, b)) for a, b in ((5, 20), (10, 50), (50, 200))}
    x |= {f"rsi_{n}d": 100 - F.lit(100.0) / (1 + _mean("_gain", n) / (_mean("_loss", n) + 1e-10)) for n in (14, 30)}
    x |= {"macd_diff": F.col("_macd") - F.col("_signal"), "macd_signal": _yes(F.col("_macd") > F.col("_signal"))}
    for n in (20, 40):
        s = o.full(F.stddev_samp, price, n, W())
        x |= {f"bollinger_position_{n}d": F.try_divide(price - _mean(price, n), 2 * s), f"bollinger_width_{n}d": F.try_divide(4 * s, _mean(price, n))}
    for n in (14, 30):
        low, high = o.full(F.min, price, n, W()), o.full(F.max, price, n, W())
        x[f"stochastic_{n}d"] = 100 * (price - low) / (high - low + 1e-10)
    if "vix" in have:
        x |= {"vix_level": F.col("vix"), "vix_change": o.pct_change("vix", 1, W()), "vix_zscore": o.zscore("vix", 252, W()), "vix_regime": _yes(F.col("vix") > o.rolling_quantile("vix", 0.5, 252, W()))}
        x |= {f"vix_momentum_{k}d": o.pct_change("vix", k, W()) for k in (5, 20)}
    for c in ("cad_oas", "us_ig_oas", "us_hy_oas"):
        if c in have:
            x |= {f"{c}_level": F.col(c), f"{c}_change": o.pct_change(c, 1, W()), f"{c}_zscore": o.zscore(c, 252, W())} | {f"{c}_momentum_{k}d": o.pct_change(c, k, W()) for k in (5, 20)}
    for c in ("us_3m_10y", "us_lei_yoy", "us_economic_regime"):
        if c in have:
            x |= {f"{c}_level": F.col(c), f"{c}_change": o.pct_change(c, 1, W())}
    for n in (20, 60, 252):
        x |= {f"return_mean_{n}d": _mean("_r", n), f"return_std_{n}d": o.full(F.stddev_samp, "_r", n, W()), f"return_skew_{n}d": o.rolling_skew("_r", n, W()), f"return_kurt_{n}d": o.rolling_kurtosis("_r", n, W()), f"price_percentile_{n}d": o.rolling_rank(price, n, W())}
    x |= {f"trend_strength_{n}d": F.abs(o.pct_change(price, n, W())) / (_mean("_span", n) + 1e-10) for n in (14, 30)}
    x |= {f"consecutive_{name}": F.sum(on.cast("double")).over(o.so_far(o.series(("panel_id", f"_{name}")))) for name, on in (("up", up), ("down", down))}
    x |= {f"momentum_acceleration_{k}d": o.diff(f"_mom{k}", k, W()) for k in (5, 10, 20)}
    x |= {f"vol_of_vol_{n}d": o.full(F.stddev_samp, f"_vol{n}", n, W()) for n in (20, 60)}
    x |= {f"distance_from_{end}_{n}d": F.try_divide(price - o.full(f, price, n, W()), o.full(f, price, n, W())) for n in (60, 252) for end, f in (("high", F.max), ("low", F.min))}
    return _filled(d.withColumns(x), list(x))


def credit_set(p: DataFrame) -> DataFrame:
    """Momentum and z-scores of spreads and volatility, changes of macro series, and levels."""
    have, x = set(p.columns), {}
    x |= {f"{c}_ret{k}": o.pct_change(c, k, W()) for c in ("cad_oas", "us_hy_oas", "vix") if c in have for k in CREDIT_MOMENTUM}
    x |= {f"{c}_zscore{n}": o.zscore(c, n, W()) for c in ("cad_oas", "us_hy_oas", "vix") if c in have for n in CREDIT_Z}
    x |= {f"{c}_change{k}": o.diff(c, k, W()) for c in ("us_equity_revisions", "us_hard_data_surprises") if c in have for k in CREDIT_CHANGE}
    levels = [c for c in CREDIT_LEVELS if c in have]
    return _filled(p.withColumns(x), [*x, *levels])


def genetic_set(p: DataFrame, asset: str) -> DataFrame:
    """Momentum, volatility, distance from averages, MACD, %K and factor momentum; factors that the panel lacks are 0."""
    price, have = F.col(asset), set(p.columns)
    d = o.ewma(p.withColumn("_price", price), [("_price", "_fast", 12), ("_price", "_slow", 26)], "panel_id")
    d = o.ewma(d.withColumn("_macd", F.col("_fast") - F.col("_slow")), [("_macd", "_signal", 9)], "panel_id")
    d = d.withColumn("_r", o.pct_change(price, 1, W()))
    x = {f"mom_{k}": o.pct_change(price, k, W()) for k in GENETIC_MOMENTUM} | {f"vol_{n}": o.full(F.stddev_samp, "_r", n, W()) for n in GENETIC_WINDOWS}
    x |= {f"sma_{n}_dev": F.try_divide(price, _mean(price, n)) - 1 for n in GENETIC_WINDOWS}
    low, high = o.full(F.min, price, 14, W()), o.full(F.max, price, 14, W())
    x |= {"macd_diff": F.col("_macd") - F.col("_signal"), "stoch_k": 100 * (price - low) / (high - low + 1e-8)}
    x |= {f"{c}_mom4": o.pct_change(c, 4, W()) if c in have else F.lit(0.0) for c in GENETIC_FACTORS}
    return _filled(d.withColumns(x), list(x), carry=False)


def weekly_set(p: DataFrame, asset: str) -> DataFrame:
    """Features of a weekly panel: momentum, volatility, spreads between spreads, macro changes, averages, z-scores, a
    correlation and high volatility; rows with any gap are left out."""
    have, target = set(p.columns), F.col(asset)
    d = p
    if {"us_hy_oas", "us_ig_oas"} <= have:
        d = d.withColumn("hy_ig_spread", F.col("us_hy_oas") - F.col("us_ig_oas"))
    if {"cad_oas", "us_ig_oas"} <= have:
        d = d.withColumn("cad_us_ig_spread", F.col("cad_oas") - F.col("us_ig_oas"))
    spreads = [c for c in ("hy_ig_spread", "cad_us_ig_spread") if c in d.columns]
    risky = [c for c in ("cad_oas", "us_hy_oas", "us_ig_oas", "vix") if c in have]
    d = d.withColumns({f"_r_{c}": o.pct_change(c, 1, W()) for c in [*risky, asset]})
    x = {f"{c}_mom_{k}w": o.pct_change(c, k, W()) for c in ("cad_oas", "us_hy_oas", "us_ig_oas", "tsx", "vix", "us_3m_10y") if c in have for k in (1, 2, 4, 8, 12)}
    x |= {f"{c}_vol_{n}w": o.full(F.stddev_samp, f"_r_{c}", n, W()) for c in [*risky, asset] for n in (4, 8, 12)}
    x |= {f"{c}_chg_{k}w": o.diff(c, k, W()) for c in spreads for k in (1, 4, 8)}
    x |= {f"{c}_chg_{k}w": o.diff(c, k, W()) for c in WEEKLY_MACRO if c in have for k in (1, 4)}
    if "us_economic_regime" in have:
        x["regime_change"] = o.diff("us_economic_regime", 1, W())
    for n in (4, 8, 12, 26):
        x |= {f"target_sma_{n}": _mean(target, n), f"target_dist_sma_{n}": F.try_divide(target, _mean(target, n)) - 1}
    x |= {f"target_zscore_{n}w": o.zscore(target, n, W()) for n in (8, 12)}
    if "tsx" in have:
        x["target_tsx_corr_12w"] = o.rolling_corr(target, "tsx", 12, W())
    if "vix" in have:
        x["vix_high"] = _yes(F.col("vix") > o.rolling_quantile("vix", 0.75, 12, W()))
    raw = [c for c in p.columns if c not in ("panel_id", "ts", asset)]
    return d.withColumns(x).select("panel_id", "ts", *raw, *spreads, *x).dropna()


#: Feature engineers by name, a panel and its settings in, features out; register() adds one of a user's own.
ENGINEERS: dict[str, Callable[..., DataFrame]] = {"boosting": boosting_set, "credit": credit_set, "genetic": genetic_set, "weekly": weekly_set}


def register(name: str, engineer: Callable[..., DataFrame]) -> None:
    ENGINEERS[name] = engineer


def create(name: str, p: DataFrame, **settings) -> DataFrame:
    """Features of a panel by a registered engineer."""
    if name not in ENGINEERS:
        raise ValueError(f"unknown feature engineer {name!r}; there are {', '.join(sorted(ENGINEERS))}")
    return ENGINEERS[name](p, **settings)
