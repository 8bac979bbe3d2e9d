"""Strategies as plans: prices in, (series_id, ts, value, entry, exit) out; many strategies are one plan each."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered as o
from . import features, select

W = o.series


def monday(ts: str = "ts") -> Column:
    return F.weekday(ts) == 0


def hold_mondays(signal: Column, w=None) -> Column:
    """A signal as it was on the last Monday; false before the first."""
    return F.coalesce(o.ffill(F.when(monday(), F.coalesce(signal, F.lit(False))), w or W()), F.lit(False))


def edges(df: DataFrame, w=None) -> DataFrame:
    """entry and exit where the boolean column _pos turns true and false."""
    p = F.col("_pos").cast("int")
    d = df.withColumn("position", p)
    before = F.lag("position", 1, 0).over(w or W())
    return d.withColumns({"entry": (F.col("position") == 1) & (before == 0), "exit": (F.col("position") == 0) & (before == 1)}).drop("_pos")


def cross_momentum(df: DataFrame, ks: Sequence[int] = (2, 5, 10), least: int = 2) -> DataFrame:
    """Long from a Monday with at least so many positive momenta to the next Monday."""
    d = features.confirmations(df, ks)
    return edges(d.withColumn("_pos", hold_mondays(F.col("n_confirmed") >= least)).select("series_id", "ts", "value", "_pos"))


def mean_momentum(df: DataFrame, ks: Sequence[int] = (2, 4, 8), threshold: float = -0.005, hold: int = 10) -> DataFrame:
    """A Monday's mean momentum (null counts as 0) above the threshold holds for so many rows; another starts anew.

    Any trigger within the last rows is what the restarting counter comes to, so the state is one windowed maximum.
    """
    d = features.momentum(df, ks)
    mean = sum((F.coalesce(F.col(f"mom_{k}"), F.lit(0.0)) for k in ks), F.lit(0.0)) / len(ks)
    d = d.withColumn("_t", (monday() & (mean > threshold)).cast("int"))
    return edges(d.withColumn("_pos", F.max("_t").over(W().rowsBetween(-(hold - 1), 0)) == 1).select("series_id", "ts", "value", "_pos"))


def vol_adaptive(df: DataFrame, n: int = 20, k: int = 10, calm: float = 1.0, tense: float = 0.5, scale: float = 0.02, most: int = 10, causal: bool = False) -> DataFrame:
    """A low z-score of volatility, with a positive momentum unless volatility is high, holds for a number of rows that
    grows with the momentum; what happens meanwhile is ignored, which no window expresses: an ordered fold.

    The regime compares volatility with its median over the whole series, which looks ahead; causal: over the past.
    """
    d = features.volatility(df, [n]).withColumns({"_z": o.zscore("value", n, W()), "_m": o.pct_change("value", k, W())})
    med = F.percentile(f"vol_{n}", 0.5).over(o.so_far(W()) if causal else Window.partitionBy("series_id"))
    d = d.withColumn("_high", F.coalesce(F.col(f"vol_{n}") > med, F.lit(False)))
    go = F.coalesce((F.col("_z") <= F.when(F.col("_high"), tense).otherwise(calm)) & (F.col("_high") | (F.col("_m") > 0)), F.lit(False))
    rows = F.least(1 + F.floor(F.greatest(F.lit(0.0), F.coalesce("_m", F.lit(0.0))) / scale), F.lit(most)).cast("int")
    d = d.select("series_id", "ts", "value", F.when(go, rows).otherwise(0).alias("_go"))

    def step(state, x):
        left = state[0] - 1 if state[0] > 0 else 0
        if left == 0:
            left = int(x[0])
        return (left,), (left > 0,)

    return edges(o.fold(d, step, (0,), ["_go"], "_pos boolean").drop("_go"))


def hold_greedy(df: DataFrame, signal: str, hold: int, out: str = "held") -> DataFrame:
    """A signal holds for so many rows; signals within a hold are passed over, and the next is looked for after it."""
    return o.fold(df, _greedy(hold), (0,), [signal], f"{out} int")


def _greedy(hold: int) -> Callable[[tuple, tuple], tuple]:
    def step(state, x):
        left = state[0] - 1 if state[0] > 0 else (hold - 1 if x[0] else -1)
        return (max(left, 0),), (1 if state[0] > 0 or x[0] else 0,)

    return step


def hold_sliced(df: DataFrame, signal: str, hold: int, out: str = "held", slices: int | None = None) -> DataFrame:
    """hold_greedy() for long series, by slices of time: what is left of a hold is one of ``hold`` states."""
    return o.fold_sliced(df, _greedy(hold), (0,), [(i,) for i in range(hold)], [signal], f"{out} int", slices=slices)


def by_rule(df: DataFrame, text: str) -> DataFrame:
    """Long from a Monday on which the rule over df's feature columns holds, to the next."""
    return edges(df.withColumn("_pos", hold_mondays(select.rule(text))).select("series_id", "ts", "value", "_pos"))


def labels(df: DataFrame, horizon: int, null_tail: bool = False) -> DataFrame:
    """1 if the value rises over the next rows; without a future: 0, or null if asked."""
    up = F.try_divide(F.lead("value", horizon).over(W()), F.col("value")) - 1 > 0
    return df.withColumn("label", up.cast("int") if null_tail else F.coalesce(up, F.lit(False)).cast("int"))


def fixed_horizon(df: DataFrame, horizon: int, threshold: float) -> DataFrame:
    """-1, 0 or 1 by the forward return; null without a future."""
    r = F.try_divide(F.lead("value", horizon).over(W()), F.col("value")) - 1
    return df.withColumn("label", F.when(r.isNotNull(), F.when(r > threshold, 1).when(r < -threshold, -1).otherwise(0)))


def triple_barrier(df: DataFrame, horizon: int, up: float, down: float) -> DataFrame:
    """Which barrier is touched first within the next rows: 1 (up), -1 (down) or 0 (time), and after how many rows."""
    ahead = F.collect_list("value").over(W().rowsBetween(1, horizon))
    rel = F.transform("_ahead", lambda v: v / F.col("value") - 1)
    hit = F.filter(F.transform("_rel", lambda r, i: F.struct(F.when(r >= up, 1).when(r <= -down, -1).alias("side"), (i + 1).alias("rows"))), lambda s: s["side"].isNotNull())
    d = df.withColumn("_ahead", ahead).withColumn("_rel", rel).withColumn("_hit", F.get(hit, F.lit(0)))
    return d.withColumns({"barrier": F.coalesce("_hit.side", F.lit(0)), "touch_rows": F.coalesce("_hit.rows", F.size("_ahead"))}).drop("_ahead", "_rel", "_hit")


class Strategies:
    """Strategies by lower-cased name."""

    def __init__(self) -> None:
        self._known: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, plan: Callable[..., DataFrame]) -> None:
        self._known[name.lower()] = plan

    def create(self, name: str, **how) -> Callable[[DataFrame], DataFrame]:
        if name.lower() not in self._known:
            raise ValueError(f"unknown strategy {name!r}; known: {', '.join(self.names())}")
        return lambda df: self._known[name.lower()](df, **how)

    def names(self) -> list[str]:
        return sorted(self._known)


STRATEGIES = Strategies()
for _name, _plan in {"cross_asset_momentum": cross_momentum, "multi_asset_momentum": mean_momentum, "two_of_three": cross_momentum, "vol_adaptive": vol_adaptive, "rule": by_rule}.items():
    STRATEGIES.register(_name, _plan)


def statistics(df: DataFrame, entry: str = "entry", confirmations: str = "n_confirmed") -> DataFrame:
    """(series_id, n_signals, signal_share, monday_confirmations): how often a strategy enters, and what its confirmations average on Mondays."""
    on = F.coalesce(F.col(entry).cast("int"), F.lit(0))
    return df.groupBy("series_id").agg(F.sum(on).cast("long").alias("n_signals"), F.avg(on).alias("signal_share"), F.avg(F.when(F.weekday("ts") == 0, F.col(confirmations))).alias("monday_confirmations"))
