"""From signals to positions, equity and trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered as o


def positions(df: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """position 1 from an entry, 0 from an exit (exit wins on the same row), carried forward, 0 before."""
    w = o.series(keys)
    return df.withColumn("position", F.coalesce(o.ffill(F.when(F.col("exit"), 0).when(F.col("entry"), 1), w), F.lit(0)))


def backtest(df: DataFrame, capital: float = 100.0, fee: float = 0.0, slippage: float = 0.0, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """All in, all out at the row's price: adds position, ret, equity and sides (trades so far).

    equity = capital * product(1 + position before * price return) * (1 - fee)^sides, with price * (1 +- slippage) at
    each side. A null price carries the last one.
    """
    w = o.series(keys)
    d = positions(df, keys).withColumn("value", o.ffill("value", w))
    d = d.withColumns({"_before": F.lag("position", 1, 0).over(w), "_r": F.coalesce(o.pct_change("value", 1, w), F.lit(0.0))})
    d = d.withColumn("_side", (F.col("position") != F.col("_before")).cast("long"))
    cost = (1 - fee) * (1 - slippage)
    d = d.withColumn("_f", (1 + F.col("_before") * F.col("_r")) * F.when(F.col("_side") == 1, F.lit(cost)).otherwise(1.0))
    d = d.withColumns({"equity": F.lit(capital) * F.product("_f").over(o.so_far(w)), "sides": F.sum("_side").over(o.so_far(w))})
    # the change of equity, from its factor: exactly 0 while out of the market
    return d.withColumn("ret", F.when(F.row_number().over(w) == 1, F.lit(0.0)).otherwise(F.col("_f") - 1)).drop("_before", "_r", "_side", "_f")


def buy_and_hold(df: DataFrame, capital: float = 100.0, fee: float = 0.0, slippage: float = 0.0, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """backtest() of a position that is taken on the first row and kept."""
    return backtest(df.withColumns({"entry": F.lit(True), "exit": F.lit(False)}), capital, fee, slippage, keys)


def decisions(bt: DataFrame, delay: int = 1, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """(keys, ts, side, decision, execution): every change of position, at the row's price and at that ``delay`` rows later, if
    there is one."""
    w = o.series(keys)
    d = bt.withColumns({"side": F.col("position") - F.lag("position", 1, 0).over(w), "execution": F.lead("value", delay).over(w)})
    return d.where("side <> 0 AND execution IS NOT NULL").select(*keys, "ts", "side", F.col("value").alias("decision"), "execution")


def kelly_sizes(df: DataFrame, n: int = 60, fraction: float = 0.5, most: float = 1.0, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Adds ``kelly``: a fraction of the Kelly bet on the n returns before the row (never the row's own), from 0 to ``most``.

    The bet is (win share x payoff - loss share) / payoff, payoff being the mean win over the mean loss; 0 where there was no win, and
    ``most`` where there was no loss. Null until n returns are there.
    """
    w = o.series(keys).rowsBetween(-n, -1)
    r = F.col("ret")
    share, win, loss = F.avg((r > 0).cast("double")).over(w), F.avg(F.when(r > 0, r)).over(w), F.abs(F.avg(F.when(r <= 0, r)).over(w))
    payoff = F.try_divide(win, loss)
    bet = F.when(win.isNull(), 0.0).when(payoff.isNull(), float(most)).otherwise(fraction * (share * payoff - (1 - share)) / payoff)
    return df.withColumn("kelly", F.when(F.count(r).over(w) >= n, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), bet))))


def summary(bt: DataFrame, af: int = 252, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """One row per run: total return, CAGR, volatility, Sharpe, Sortino, drawdown, final and initial value, trades, time in market."""
    w = o.series(keys)
    d = bt.withColumn("_peak", F.max("equity").over(o.so_far(w))).withColumn("_first", F.first("equity").over(o.so_far(w)))
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("equity", "ts").alias("final_value"), F.min_by("equity", "ts").alias("initial_value"),
        F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_s"), F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))).alias("_d"),
        F.min(F.col("equity") / F.col("_peak") - 1).alias("max_drawdown"), F.max("sides").alias("trades"), F.avg("position").alias("time_in_market"),
    )
    g = g.withColumn("total_return", F.col("final_value") / F.col("initial_value") - 1)
    g = g.withColumns({"cagr": F.pow(1 + F.col("total_return"), F.lit(float(af)) / F.col("n")) - 1, "volatility": F.col("_s") * F.sqrt(F.lit(float(af)))})
    g = g.withColumns({"sharpe": F.coalesce(F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * F.sqrt(F.lit(float(af)))), F.lit(0.0)), "sortino": F.coalesce(F.when(F.col("_d") > 0, F.col("_m") / F.col("_d") * F.sqrt(F.lit(float(af)))), F.lit(0.0))})
    return g.drop("_m", "_s", "_d")


def log_backtest(df: DataFrame, position: str = "position", af: int = 52) -> DataFrame:
    """Position times log return per row, compounded by exp of sums, with its own statistics."""
    w = o.series()
    d = df.withColumn("_r", F.col(position) * F.coalesce(F.ln(F.try_divide(F.lead("value").over(w), F.col("value"))), F.lit(0.0)))
    d = d.withColumns({"_eq": F.exp(F.sum("_r").over(o.so_far(w))), "_dp": F.abs(F.col(position) - F.coalesce(F.lag(position).over(w), F.lit(0)))})
    d = d.withColumn("_dd", F.col("_eq") / F.max("_eq").over(o.so_far(w)) - 1)
    g = d.groupBy("series_id").agg(
        (F.exp(F.sum("_r")) - 1).alias("total_return"), (F.avg("_r") * af).alias("ann_return"), (F.stddev_samp("_r") * F.sqrt(F.lit(float(af)))).alias("ann_vol"), F.min("_dd").alias("max_drawdown"),
        (F.sum("_dp") / 2).alias("trades"), F.try_divide(F.count_if(F.col("_r") > 0), F.count_if(F.col("_r") != 0)).alias("win_rate"), (F.stddev_samp(F.when(F.col("_r") < 0, F.col("_r"))) * F.sqrt(F.lit(float(af)))).alias("_down"),
    )
    down = F.when(F.col("_down") > 0, F.col("_down")).otherwise(F.col("ann_vol"))
    return g.withColumns({"sharpe": F.coalesce(F.try_divide("ann_return", "ann_vol"), F.lit(0.0)), "sortino": F.coalesce(F.try_divide(F.col("ann_return"), down), F.lit(0.0))}).drop("_down")


def trades(bt: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """One row per holding period: entry and exit dates and prices, days, return, and whether it is still open."""
    w = o.series(keys)
    d = bt.withColumn("_run", o.islands((F.col("position") == 1) & (F.lag("position", 1, 0).over(w) == 0), w))
    d = d.withColumns({"_next_ts": F.lead("ts").over(w), "_next": F.lead("value").over(w), "_last": F.max("ts").over(Window.partitionBy(*keys))})
    g = d.where("position = 1").groupBy(*keys, "_run").agg(
        F.min("ts").alias("entry_date"), F.min_by("value", "ts").alias("entry_price"), F.max_by("_next_ts", "ts").alias("_x"), F.max_by(F.coalesce("_next", "value"), "ts").alias("exit_price"), F.max("_last").alias("_last"),
    )
    g = g.withColumns({"exit_date": F.coalesce("_x", "_last"), "status": F.when(F.col("_x").isNull(), "open").otherwise("closed")})
    return g.select(*keys, F.col("_run").alias("trade"), "entry_date", "exit_date", "entry_price", "exit_price", F.greatest(F.lit(0), F.datediff("exit_date", "entry_date")).alias("days"), (F.col("exit_price") / F.col("entry_price") - 1).alias("ret"), "status")


def folds(n: int, train: int, test: int, step: int, include_last: bool = False) -> list[tuple[int, int, int]]:
    """(fold, first training row, first test row), from 0; include_last: also the window that just fits."""
    stop = n - train - test + (1 if include_last else 0)
    return [(k, i, i + train) for k, i in enumerate(range(0, max(0, stop), step))]


def walk_forward(bt: DataFrame, train: int, test: int, step: int, af: int = 252, include_last: bool = False) -> DataFrame:
    """Per series and fold, return, volatility, Sharpe and drawdown of the test rows.

    A row belongs to at most ceil(test / step) folds, found by arithmetic from its number: no range join.
    """
    w = o.series()
    d = bt.withColumns({"_n": F.row_number().over(w) - 1, "_of": F.count(F.lit(1)).over(Window.partitionBy("series_id"))})
    lo = F.greatest(F.lit(0), F.ceil((F.col("_n") - train - test + 1) / step))
    hi = F.least(F.floor((F.col("_n") - train) / step), F.floor((F.col("_of") - train - test + (0 if include_last else -1)) / step))
    d = d.where(lo <= hi).withColumn("fold", F.explode(F.sequence(lo, hi)))
    wf = o.series(("series_id", "fold"))
    d = d.withColumn("_eq", F.product(1 + F.col("ret")).over(o.so_far(wf))).withColumn("_dd", F.col("_eq") / F.greatest(F.lit(1.0), F.max("_eq").over(o.so_far(wf))) - 1)
    g = d.groupBy("series_id", "fold").agg((F.product(1 + F.col("ret")) - 1).alias("total_return"), F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_s"), F.min("_dd").alias("max_drawdown"))
    sharpe = F.coalesce(F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * F.sqrt(F.lit(float(af)))), F.lit(0.0))
    return g.select("series_id", "fold", "total_return", (F.col("_s") * F.sqrt(F.lit(float(af)))).alias("volatility"), sharpe.alias("sharpe"), "max_drawdown")


def walk_forward_summary(folds_: DataFrame) -> DataFrame:
    return folds_.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_folds"), F.avg("sharpe").alias("mean_sharpe"), F.stddev_pop("sharpe").alias("std_sharpe"), F.min("sharpe").alias("min_sharpe"), F.max("sharpe").alias("max_sharpe"), F.avg("total_return").alias("mean_return"), F.stddev_pop("total_return").alias("std_return"), F.avg("max_drawdown").alias("mean_drawdown"), F.min("max_drawdown").alias("worst_drawdown"), F.avg((F.col("total_return") > 0).cast("double")).alias("success_share"))
