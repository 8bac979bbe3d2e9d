"""Ordered, per-series column functions.

Every function takes the window it works over; ``series()`` makes one and insists on a partition key, since a window
without one moves all rows to a single task. Missing values are NULL throughout (NaN never enters a table), and all
divisions that may meet a zero are try_divide.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..session import written

START, END = Window.unboundedPreceding, Window.unboundedFollowing


def series(keys: str | Sequence[str] = "series_id", order: str | Sequence[str] = "ts") -> WindowSpec:
    keys = [keys] if isinstance(keys, str) else list(keys)
    if not keys:
        raise ValueError("a window needs a partition key")
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(START, 0)


def full(agg: Callable[[Column], Column], x: str | Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    """agg over the last n rows, if they hold n values (or ``least``)."""
    return F.when(F.count(col(x)).over(last_rows(w, n)) >= (least or n), agg(col(x)).over(last_rows(w, n)))


# filling


def ffill(x: str | Column, w: WindowSpec) -> Column:
    return F.last(col(x), ignorenulls=True).over(so_far(w))


def bfill(x: str | Column, w: WindowSpec) -> Column:
    return F.first(col(x), ignorenulls=True).over(w.rowsBetween(0, END))


def bfill_after_first(x: str | Column, w: WindowSpec) -> Column:
    """Backward fill that leaves the nulls before the first value."""
    return F.when(F.count(col(x)).over(so_far(w)) > 0, bfill(x, w))


def interpolate(x: str | Column, at: str | Column, w: WindowSpec) -> Column:
    """Linear between neighbours by position ``at`` (a number); after the last value, that value; before the first, null."""
    x, at = col(x), col(at)
    here = F.when(x.isNotNull(), at)
    x0, x1, a0, a1 = ffill(x, w), bfill(x, w), ffill(here, w), bfill(here, w)
    return F.when(x.isNotNull(), x).otherwise(F.coalesce(x0 + (x1 - x0) * F.try_divide(at - a0, a1 - a0), x0))


# differences


def pct_change(x: str | Column, k: int, w: WindowSpec) -> Column:
    """x over its value k rows before, less 1 (fill x first, if it has gaps)."""
    return F.try_divide(col(x), F.lag(col(x), k).over(w)) - 1


def diff(x: str | Column, k: int, w: WindowSpec) -> Column:
    return col(x) - F.lag(col(x), k).over(w)


# moments


def unbiased_skew(g1: Column, n: Column) -> Column:
    return F.when(n >= 3, g1 * F.try_divide(F.sqrt(n * (n - 1)), n - 2))


def unbiased_kurtosis(g2: Column, n: Column) -> Column:
    return F.when(n >= 4, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def skew(x: str | Column) -> Column:
    """Bias-corrected skewness, as an aggregate."""
    return unbiased_skew(F.skewness(col(x)), F.count(col(x)))


def kurtosis(x: str | Column) -> Column:
    """Bias-corrected excess kurtosis, as an aggregate."""
    return unbiased_kurtosis(F.kurtosis(col(x)), F.count(col(x)))


def rolling_skew(x: str | Column, n: int, w: WindowSpec) -> Column:
    return full(lambda c: F.skewness(c), x, n, w) * (math.sqrt(n * (n - 1)) / (n - 2))


def rolling_kurtosis(x: str | Column, n: int, w: WindowSpec) -> Column:
    return ((n + 1) * full(lambda c: F.kurtosis(c), x, n, w) + 6) * ((n - 1) / ((n - 2) * (n - 3)))


# ranks, scores


def rolling_quantile(x: str | Column, q: float, n: int, w: WindowSpec) -> Column:
    return full(lambda c: F.percentile(c, q), x, n, w)


def rolling_rank(x: str | Column, n: int, w: WindowSpec) -> Column:
    """Share of the last n values that rank at or below the current one; ties count by their mean rank."""
    x = col(x)
    held = F.collect_list(x).over(last_rows(w, n))
    below, equal = F.size(F.filter(held, lambda v: v < x)), F.size(F.filter(held, lambda v: v == x))
    return F.when((F.size(held) >= n) & x.isNotNull(), (below + (equal + 1) / 2) / n)


def zscore(x: str | Column, n: int, w: WindowSpec) -> Column:
    return F.try_divide(col(x) - full(F.avg, x, n, w), full(F.stddev_samp, x, n, w))


def rolling_corr(a: str | Column, b: str | Column, n: int, w: WindowSpec) -> Column:
    """Null where either side doesn't vary (corr() raises there)."""
    both, f = col(a).isNotNull() & col(b).isNotNull(), last_rows(w, n)
    x, y = F.when(both, col(a)), F.when(both, col(b))
    return F.when(F.count(x).over(f) >= n, F.try_divide(F.covar_samp(x, y).over(f), F.stddev_samp(x).over(f) * F.stddev_samp(y).over(f)))


# runs


def islands(change: Column, w: WindowSpec) -> Column:
    """Number of the run a row is in, given where runs begin."""
    return F.sum(F.when(change, 1).otherwise(0)).over(so_far(w))


def _streamed(df: DataFrame, keys: list[str], order: list[str], piece: Callable[[pd.DataFrame, object], object], fields: str) -> DataFrame:
    """df in order of each series, in pieces of one series each: piece(rows, state) adds columns to the rows and returns the
    state for the next piece of that series; it is None at a series' beginning.

    Rows are dealt out by series and sorted by Spark, which spills, and read in Arrow batches: a worker holds a batch at a
    time, however long a series is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for b in batches:
            if not len(b):
                continue
            k = b[keys].astype(object).where(b[keys].notna(), None)
            new = (k != k.shift()).any(axis=1) & ~(k.isna() & k.shift().isna()).all(axis=1)
            cuts = [0, *(i for i in np.flatnonzero(new.to_numpy()).tolist() if i), len(b)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                now = tuple(k.iloc[i])
                if now != last:
                    last, state = now, None
                g = b.iloc[i:j].copy()
                state = piece(g, state)
                yield g

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, fields)


def ewma(df: DataFrame, columns: Sequence[tuple[str, str, int]], keys: str | Sequence[str] = "series_id", order: str = "ts") -> DataFrame:
    """df with exponentially weighted means: (column, new name, span), y0 = first value, alpha = 2 / (span + 1).

    A recursion over a whole series, which no built-in function has. It only needs its last mean, and how many nulls came
    after it, so series go through in batches. Nulls decay the old weight, so fill them first if that isn't wanted.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def piece(g: pd.DataFrame, state: dict | None) -> dict:
        after = {}
        for c, name, span in columns:
            before = (state or {}).get(name, [])
            x = np.concatenate([before, g[c].astype("float64").to_numpy()])
            g[name] = pd.Series(x).ewm(span=span, adjust=False).mean().to_numpy()[len(before) :]
            known = np.flatnonzero(~np.isnan(x))
            y = pd.Series(x).ewm(span=span, adjust=False).mean().iloc[known[-1]] if len(known) else None
            after[name] = [] if y is None else [float(y), *[np.nan] * (len(x) - 1 - int(known[-1]))]
        return after

    return _streamed(df, keys, [order], piece, fields + "".join(f", `{name}` double" for _, name, _ in columns))


def fold(df: DataFrame, step: Callable[[tuple, tuple], tuple], start: tuple, inputs: Sequence[str], outputs: str, keys: str | Sequence[str] = "series_id", order: str | Sequence[str] = "ts") -> DataFrame:
    """df with the outputs of a state machine that walks each series in order.

    step(state, values of ``inputs``) gives (new state, outputs). For state that no window expresses, such as holds
    that ignore what happens while they last. Series go through in batches; only the state is carried.
    """
    keys, order = ([x] if isinstance(x, str) else list(x) for x in (keys, order))
    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    names = [x.split()[0] for x in outputs.split(", ")]

    def piece(g: pd.DataFrame, state: tuple | None) -> tuple:
        state, made = start if state is None else state, []
        for values in zip(*(g[c].tolist() for c in inputs), strict=True):
            state, out = step(state, values)
            made.append(out)
        for i, name in enumerate(names):
            g[name] = [m[i] for m in made]
        return state

    return _streamed(df, keys, order, piece, f"{fields}, {outputs}")


# one long series over many tasks


def _sliced(df: DataFrame, keys: list[str], order: list[str], slices: int | None) -> DataFrame:
    """df written in ranges of (keys, order) of about equal size, with the number of each: _slice. Ranges are cut by sampled
    splitters, so a long series lies in many of them, and rows of one time in one."""
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *keys, *order).withColumn("_slice", F.spark_partition_id()), "slices")


def _mean_from(x: np.ndarray, y: float | None, gap: int, alpha: float) -> tuple[np.ndarray, float | None, int]:
    """Exponential means of x after a mean y with so many nulls after it; the last mean, and the nulls after its value."""
    out = np.full(len(x), np.nan if y is None else y)
    known = np.flatnonzero(~np.isnan(x))
    if not len(known):
        return out, y, gap + len(x)
    i = int(known[0])
    old = (1 - alpha) ** (gap + i + 1)
    first = x[i] if y is None else (old * y + alpha * x[i]) / (old + alpha)
    out[i:] = pd.Series(np.concatenate([[first], x[i + 1 :]])).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    return out, float(out[-1]), len(x) - 1 - int(known[-1])


def ewma_sliced(df: DataFrame, columns: Sequence[tuple[str, str, int]], keys: str | Sequence[str] = "series_id", order: str = "ts", slices: int | None = None) -> DataFrame:
    """As ewma(), for series longer than a task should walk: a slice turns the mean before it into the one after it by an
    affine map, which is found without knowing either. Maps of all slices are made side by side, applied one after the
    other (a row per series and slice), and the slices then walked side by side, each from its own start."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    d = _sliced(df, keys, [order], slices)
    types = dict(d.dtypes)
    alphas = [2 / (span + 1) for _, _, span in columns]
    fields = [*(f"`{k}` {types[k]}" for k in keys), "_slice int", *(f"_{p}{i} double" for i in range(len(columns)) for p in "nlxcdt")]

    def maps(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable")
        row = [*(g[k].iloc[0] for k in keys), int(g["_slice"].iloc[0])]
        for (c, _, _), a in zip(columns, alphas, strict=True):
            x = g[c].astype("float64").to_numpy()
            known = np.flatnonzero(~np.isnan(x))
            if not len(known):
                row += [float(len(x)), 0.0, np.nan, 0.0, 0.0, 0.0]
                continue
            i = int(known[0])
            zero, one = (_mean_from(np.concatenate([[v], x[i + 1 :]]), None, 0, a)[1] for v in (0.0, 1.0))
            row += [float(len(x)), float(i), x[i], one - zero, zero, float(len(x) - 1 - known[-1])]
        return pd.DataFrame([row], columns=[f.rsplit(" ", 1)[0].strip("`") for f in fields])

    made = d.select(*keys, "_slice", order, *dict.fromkeys(c for c, _, _ in columns)).groupBy(*keys, "_slice").applyInPandas(maps, ", ".join(fields))

    def through(state: tuple, x: tuple) -> tuple[tuple, tuple]:
        after = []
        for i, a in enumerate(alphas):
            (y, gap), (n, lead, first, c, e, trail) = state[i], x[6 * i : 6 * i + 6]
            if first != first or first is None:
                after.append((y, gap + int(n)))
                continue
            old = (1 - a) ** (gap + lead + 1)
            start = first if y is None else (old * y + a * first) / (old + a)
            after.append((c * start + e, int(trail)))
        return tuple(after), tuple(v for s in state for v in s)

    names = [f"_{p}{i}" for i in range(len(columns)) for p in "nlxcdt"]
    starts = fold(made, through, tuple((None, 0) for _ in columns), names, ", ".join(f"_y{i} double, _g{i} long" for i in range(len(columns))), keys, "_slice")
    starts = written(starts.select(*keys, "_slice", *(f"_{p}{i}" for i in range(len(columns)) for p in "yg")), "slice-starts")
    on = [d[k].eqNullSafe(starts[k]) for k in keys] + [d["_slice"] == starts["_slice"]]
    rows = d.join(starts, on).select(*[d[c] for c in d.columns], *[starts[f"_{p}{i}"] for i in range(len(columns)) for p in "yg"])

    def piece(g: pd.DataFrame, state: dict | None) -> dict:
        after = {}
        for i, ((c, name, _), a) in enumerate(zip(columns, alphas, strict=True)):
            y, gap = state[i] if state else (None if pd.isna(y := g[f"_y{i}"].iloc[0]) else float(y), int(g[f"_g{i}"].iloc[0]))
            g[name], y, gap = _mean_from(g[c].astype("float64").to_numpy(), y, gap, a)
            after[i] = (y, gap)
        return after

    all_fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + "".join(f", `{name}` double" for _, name, _ in columns)
    return _streamed(rows, [*keys, "_slice"], [order], piece, all_fields).drop("_slice", *(f"_{p}{i}" for i in range(len(columns)) for p in "yg"))


def fold_sliced(df: DataFrame, step: Callable[[tuple, tuple], tuple], start: tuple, states: Sequence[tuple], inputs: Sequence[str], outputs: str, keys: str | Sequence[str] = "series_id", order: str | Sequence[str] = "ts", slices: int | None = None) -> DataFrame:
    """As fold(), for long series and a machine of few states, all of which ``states`` lists: slices first say, side by side,
    which state each state leads to; these tables are followed from slice to slice; then slices are walked side by side.
    States that meet are walked once, so a table costs little more than one walk."""
    keys, order = ([x] if isinstance(x, str) else list(x) for x in (keys, order))
    d = _sliced(df, keys, order, slices)
    types, number = dict(d.dtypes), {s: i for i, s in enumerate(states)}

    def table(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable")
        now = list(states)
        for values in zip(*(g[c].tolist() for c in inputs), strict=True):
            met = {s: step(s, values)[0] for s in set(now)}
            now = [met[s] for s in now]
        return pd.DataFrame([[*(g[k].iloc[0] for k in keys), int(g["_slice"].iloc[0]), [number[s] for s in now]]], columns=[*keys, "_slice", "_to"])

    made = d.select(*keys, "_slice", *dict.fromkeys([*order, *inputs])).groupBy(*keys, "_slice").applyInPandas(table, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "_slice int, _to array<int>"]))
    starts = fold(made, lambda s, x: ((int(x[0][s[0]]),), (s[0],)), (number[start],), ["_to"], "_from int", keys, "_slice")
    starts = written(starts.select(*keys, "_slice", "_from"), "slice-starts")
    rows = d.join(starts, [d[k].eqNullSafe(starts[k]) for k in keys] + [d["_slice"] == starts["_slice"]]).select(*[d[c] for c in d.columns], starts["_from"])
    names = [x.split()[0] for x in outputs.split(", ")]

    def piece(g: pd.DataFrame, state: tuple | None) -> tuple:
        state, out = states[int(g["_from"].iloc[0])] if state is None else state, []
        for values in zip(*(g[c].tolist() for c in inputs), strict=True):
            state, o_ = step(state, values)
            out.append(o_)
        for i, name in enumerate(names):
            g[name] = [m[i] for m in out]
        return state

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return _streamed(rows, [*keys, "_slice"], order, piece, f"{fields}, {outputs}").drop("_slice", "_from")
