"""Technical indicators over long tables (series_id, ts, value): columns added to the input, null until warm."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered as o

W = o.series
EPS = 1e-8


def momentum(df: DataFrame, ks: Sequence[int]) -> DataFrame:
    return df.withColumns({f"mom_{k}": o.pct_change("value", k, W()) for k in ks})


def optional_momentum(df: DataFrame, column: str, ks: Sequence[int], constant: float = 0.0) -> DataFrame:
    """<column>_mom_<k>: k-row changes of a column that a table may lack; then, and before k rows, the constant."""
    there = column in df.columns
    return df.withColumns({f"{column}_mom_{k}": F.coalesce(o.pct_change(column, k, W()), F.lit(float(constant))) if there else F.lit(float(constant)) for k in ks})


def optional(df: DataFrame, column: str, name: str, constant: float = 0.0) -> DataFrame:
    """A column taken over under a name, the constant where the table lacks it or it is null."""
    return df.withColumn(name, F.coalesce(F.col(column).cast("double"), F.lit(float(constant))) if column in df.columns else F.lit(float(constant)))


def volatility(df: DataFrame, ns: Sequence[int], k: int = 1) -> DataFrame:
    """Rolling deviation of k-row returns."""
    d = df.withColumn("_r", o.pct_change("value", k, W()))
    return d.withColumns({f"vol_{n}": o.full(F.stddev_samp, "_r", n, W()) for n in ns}).drop("_r")


def sma_deviation(df: DataFrame, ns: Sequence[int]) -> DataFrame:
    return df.withColumns({f"sma_{n}_dev": F.try_divide(F.col("value"), o.full(F.avg, "value", n, W())) - 1 for n in ns})


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """macd, macd_signal and macd_hist."""
    d = o.ewma(df, [("value", "_fast", fast), ("value", "_slow", slow)])
    d = o.ewma(d.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow"), [("macd", "macd_signal", signal)])
    return d.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def stochastic(df: DataFrame, n: int = 14) -> DataFrame:
    low, high = o.full(F.min, "value", n, W()), o.full(F.max, "value", n, W())
    return df.withColumn("stoch_k", 100 * (F.col("value") - low) / (high - low + EPS))


def rsi(df: DataFrame, n: int = 14, on: str = "difference") -> DataFrame:
    """Simple-mean RSI. On differences: 100 where nothing was lost, null where nothing moved; on returns: the loss is
    kept from zero by 1e-10."""
    move = o.diff("value", 1, W()) if on == "difference" else o.pct_change("value", 1, W())
    d = df.withColumn("_m", move)
    d = d.withColumns({"_up": F.when(F.col("_m").isNotNull(), F.greatest("_m", F.lit(0.0))), "_down": F.when(F.col("_m").isNotNull(), F.greatest(-F.col("_m"), F.lit(0.0)))})
    d = d.withColumns({"_gain": o.full(F.avg, "_up", n, W()), "_loss": o.full(F.avg, "_down", n, W())})
    if on == "difference":
        x = F.when((F.col("_loss") == 0) & (F.col("_gain") > 0), F.lit(100.0)).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide("_gain", "_loss")))
    else:
        x = 100 - F.lit(100.0) / (1 + F.col("_gain") / (F.col("_loss") + 1e-10))
    return d.withColumn("rsi", x).drop("_m", "_up", "_down", "_gain", "_loss")


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    m, s = o.full(F.avg, "value", n, W()), o.full(F.stddev_samp, "value", n, W())
    d = df.withColumns({"bb_mid": m, "_s": s})
    d = d.withColumns({"bb_upper": F.col("bb_mid") + k * F.col("_s"), "bb_lower": F.col("bb_mid") - k * F.col("_s")})
    return d.withColumns({"bb_position": F.try_divide(F.col("value") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")), "bb_width": F.try_divide(2 * k * F.col("_s"), F.col("bb_mid"))}).drop("_s")


def zscores(df: DataFrame, ns: Sequence[int]) -> DataFrame:
    return df.withColumns({f"z_{n}": o.zscore("value", n, W()) for n in ns})


def changes(df: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Differences over k rows and the level itself."""
    return df.withColumns({f"chg_{k}": o.diff("value", k, W()) for k in ks} | {"level": F.col("value")})


def ranks(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn(f"rank_{n}", o.rolling_rank("value", n, W()))


def trend_strength(df: DataFrame, n: int = 20) -> DataFrame:
    """Absolute n-row change over the mean two-row range."""
    d = df.withColumn("_range", o.full(F.max, "value", 2, W()) - o.full(F.min, "value", 2, W()))
    d = d.withColumn("_mean", o.full(F.avg, "_range", n, W()))
    return d.withColumn("trend_strength", F.abs(o.pct_change("value", n, W())) / (F.col("_mean") + 1e-10)).drop("_range", "_mean")


def acceleration(df: DataFrame, k: int = 5) -> DataFrame:
    d = df.withColumn("_m", o.pct_change("value", k, W()))
    return d.withColumn("acceleration", o.diff("_m", k, W())).drop("_m")


def from_extremes(df: DataFrame, n: int = 20) -> DataFrame:
    """Distance from the rolling high and low, as shares of them."""
    return df.withColumns({"from_high": F.try_divide(F.col("value"), o.full(F.max, "value", n, W())) - 1, "from_low": F.try_divide(F.col("value"), o.full(F.min, "value", n, W())) - 1})


def ma_cross(df: DataFrame, fast: int = 10, slow: int = 30) -> DataFrame:
    f, s = o.full(F.avg, "value", fast, W()), o.full(F.avg, "value", slow, W())
    return df.withColumns({"above_ma": F.coalesce((F.col("value") > s).cast("int"), F.lit(0)), "ma_cross": F.coalesce((f > s).cast("int"), F.lit(0))})


def vol_regime(df: DataFrame, n: int = 20, long: int = 60) -> DataFrame:
    """Volatility, its volatility, its z-score and whether it is above its rolling median: windows over windows."""
    d = df.withColumn("_r", o.pct_change("value", 1, W())).withColumn("vol", o.full(F.stddev_samp, "_r", n, W()))
    return d.withColumns({"vol_of_vol": o.full(F.stddev_samp, "vol", n, W()), "vol_z": o.zscore("vol", long, W()), "high_vol": F.coalesce((F.col("vol") > o.rolling_quantile("vol", 0.5, long, W())).cast("int"), F.lit(0))}).drop("_r")


def return_moments(df: DataFrame, n: int = 20) -> DataFrame:
    d = df.withColumn("_r", o.pct_change("value", 1, W()))
    return d.withColumns({"ret_skew": o.rolling_skew("_r", n, W()), "ret_kurt": o.rolling_kurtosis("_r", n, W())}).drop("_r")


def streaks(df: DataFrame) -> DataFrame:
    """Rows in a row that rose (fell), counted up to the current one."""
    d = df.withColumn("_m", o.diff("value", 1, W()))
    out = d
    for name, up in (("up_streak", F.col("_m") > 0), ("down_streak", F.col("_m") < 0)):
        out = out.withColumn("_on", F.coalesce(up, F.lit(False)))
        out = out.withColumn("_run", o.islands(~F.col("_on"), W()))
        out = out.withColumn(name, F.sum(F.col("_on").cast("long")).over(o.so_far(o.series(("series_id", "_run")))))
    return out.drop("_m", "_on", "_run")


def relative_strength(df: DataFrame, benchmark: str, k: int = 20) -> DataFrame:
    """Ratio to the benchmark series on the same date and the ratio's k-row change."""
    b = df.where(F.col("series_id") == benchmark).select("ts", F.col("value").alias("_b"))
    d = df.join(b, "ts").withColumn("ratio", F.try_divide("value", "_b")).drop("_b")
    return d.withColumn("ratio_mom", o.pct_change("ratio", k, W()))


def confirmations(df: DataFrame, ks: Sequence[int], threshold: float = 0.0) -> DataFrame:
    """Per row, how many momenta exceed the threshold, and their share; null momenta don't."""
    d = momentum(df, ks)
    n = sum((F.coalesce((F.col(f"mom_{k}") > threshold).cast("int"), F.lit(0)) for k in ks), F.lit(0))
    return d.withColumns({"n_confirmed": n, "pct_confirmed": n / len(ks)}).drop(*[f"mom_{k}" for k in ks])


def combined_momentum(df: DataFrame, k: int = 4, threshold: float = 0.0) -> DataFrame:
    """Per date, the equal-weight mean momentum of all series that have the date; null if any is null."""
    d = momentum(df, [k]).groupBy("ts").agg(F.when(F.count(f"mom_{k}") == F.count(F.lit(1)), F.avg(f"mom_{k}")).alias("combined"))
    return d.withColumn("signal", F.coalesce((F.col("combined") > threshold).cast("int"), F.lit(0)))


def correlations(df: DataFrame, pair: DataFrame, n: int = 20) -> DataFrame:
    """Rolling correlation of returns for pairs (a, b, ts, va, vb)."""
    w = o.series(("a", "b"))
    d = pair.withColumns({"ra": o.pct_change("va", 1, w), "rb": o.pct_change("vb", 1, w)})
    return d.withColumn("corr", o.rolling_corr("ra", "rb", n, w)).select("a", "b", "ts", "corr")


def select_features(long: DataFrame, target: DataFrame, least_corr: float = 0.05, least_var: float = 0.0, most_mutual: float = 0.9) -> DataFrame:
    """Of features (key, feature, value): variance, correlation with the target (key, y), and whether to keep: enough of
    both, and not correlated beyond most_mutual with a feature earlier by name. Features are few; keys are many."""
    stats = long.join(target, "key").groupBy("feature").agg(F.var_samp("value").alias("variance"), F.corr("value", "y").alias("corr"))
    a, b = long.select("key", F.col("feature").alias("f"), F.col("value").alias("u")), long.select("key", F.col("feature").alias("g"), F.col("value").alias("v"))
    mutual = a.join(b, "key").where("f < g").groupBy("f", "g").agg(F.corr("u", "v").alias("c")).where(F.abs("c") > most_mutual).select(F.col("g").alias("feature")).distinct().withColumn("redundant", F.lit(True))
    out = stats.join(mutual, "feature", "left").withColumn("redundant", F.coalesce("redundant", F.lit(False)))
    return out.withColumn("keep", F.coalesce((F.abs("corr") > least_corr) & (F.col("variance") > least_var), F.lit(False)) & ~F.col("redundant"))


def feature_set(df: DataFrame) -> DataFrame:
    """A wide set of price features in one pass of windows over one shuffle."""
    d = df.withColumn("r", o.pct_change("value", 1, W()))
    d = d.withColumns({f"mom_{k}": o.pct_change("value", k, W()) for k in (1, 2, 3, 5, 10, 20, 60)})
    d = d.withColumns({f"vol_{n}": o.full(F.stddev_samp, "r", n, W()) for n in (5, 10, 20, 60)} | {f"sma_{n}_dev": F.try_divide(F.col("value"), o.full(F.avg, "value", n, W())) - 1 for n in (5, 10, 20, 50)} | {f"z_{n}": o.zscore("value", n, W()) for n in (20, 60)} | {f"high_{n}": F.try_divide(F.col("value"), o.full(F.max, "value", n, W())) - 1 for n in (20, 60)})
    names = [c for c in d.columns if c not in df.columns]
    return d.withColumns({c: F.coalesce(o.ffill(c, W()), F.lit(0.0)) for c in names})


#: Feature builders by name, for configuration.
REGISTRY: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (momentum, volatility, sma_deviation, macd, stochastic, rsi, bollinger, zscores, changes, ranks, trend_strength, acceleration, from_extremes, ma_cross, vol_regime, return_moments, streaks, relative_strength, confirmations, combined_momentum, feature_set)}


def average_true_range(df: DataFrame, n: int = 14) -> DataFrame:
    """ATR, true-range breakout band and rate of change from bars (series_id, ts, open, high, low, close, volume)."""
    prev = F.lag("close").over(W())
    d = df.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))
    return d.withColumns({"atr": o.full(F.avg, "_tr", n, W()), "roc": 100 * o.pct_change("close", n, W()), "breakout": F.coalesce((F.col("close") > F.max("high").over(W().rowsBetween(-n, -1))).cast("int"), F.lit(0))}).drop("_tr")


def volume_flow(df: DataFrame) -> DataFrame:
    """On-balance volume and volume-price trend."""
    d = df.withColumns({"_s": F.coalesce(F.signum(o.diff("close", 1, W())), F.lit(0.0)) * F.col("volume"), "_p": F.coalesce(o.pct_change("close", 1, W()), F.lit(0.0)) * F.col("volume")})
    return d.withColumns({"obv": F.sum("_s").over(o.so_far(W())), "vpt": F.sum("_p").over(o.so_far(W()))}).drop("_s", "_p")


def candles(df: DataFrame) -> DataFrame:
    """Doji and hammer shapes, gaps, and squeeze of the bar."""
    body, span = F.abs(F.col("close") - F.col("open")), F.col("high") - F.col("low")
    lower = F.least("open", "close") - F.col("low")
    upper = F.col("high") - F.greatest("open", "close")
    gap = F.try_divide(F.col("open"), F.lag("close").over(W())) - 1
    return df.withColumns({"doji": (body <= 0.1 * span).cast("int"), "hammer": ((lower >= 2 * body) & (upper <= body)).cast("int"), "gap": gap})


def directional(df: DataFrame, n: int = 14) -> DataFrame:
    """+DI, -DI and ADX of bars (series_id, ts, high, low, close): directional moves and true range smoothed by alpha 1 / n
    from their first values, in percent of the smoothed range; ADX is the smoothed share of what the two differ in."""
    up, down, prev = o.diff("high", 1, W()), -o.diff("low", 1, W()), F.lag("close").over(W())
    d = df.withColumns({"_up": up, "_down": down, "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))})
    d = d.withColumns({"_tr": F.when(prev.isNotNull(), F.col("_tr")), "_plus": F.when(F.col("_up").isNull(), None).when((F.col("_up") > F.col("_down")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0), "_minus": F.when(F.col("_down").isNull(), None).when((F.col("_down") > F.col("_up")) & (F.col("_down") > 0), F.col("_down")).otherwise(0.0)})
    span = 2 * n - 1  # alpha = 2 / (span + 1) = 1 / n
    d = o.ewma(d, [("_tr", "_atr", span), ("_plus", "_p", span), ("_minus", "_m", span)])
    d = d.withColumns({"plus_di": 100 * F.try_divide("_p", "_atr"), "minus_di": 100 * F.try_divide("_m", "_atr")})
    d = d.withColumn("_dx", 100 * F.coalesce(F.try_divide(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")), F.when(F.col("_atr").isNotNull(), F.lit(0.0))))
    return o.ewma(d, [("_dx", "adx", span)]).drop("_up", "_down", "_tr", "_plus", "_minus", "_atr", "_p", "_m", "_dx")


def squeeze(df: DataFrame, n: int = 20, width: float = 2.0, look: int = 10, q: float = 0.2) -> DataFrame:
    """band_width (of Bollinger bands, over their mean) and squeeze: 1 where it is below its own q quantile of the last rows."""
    d = df.withColumn("band_width", F.try_divide(2 * width * o.full(F.stddev_samp, "close", n, W()), o.full(F.avg, "close", n, W())))
    return d.withColumn("squeeze", F.coalesce((F.col("band_width") < o.rolling_quantile("band_width", q, look, W())).cast("int"), F.lit(0)))


def pivots(df: DataFrame, k: int = 5) -> DataFrame:
    """(series_id, ts, kind, level, known): highs above (lows below) all others of the k rows before and after, known k rows
    later, so that nothing is used before it can be seen."""
    top = lambda c: F.greatest(F.max(c).over(W().rowsBetween(-k, -1)), F.max(c).over(W().rowsBetween(1, k)))
    low = lambda c: F.least(F.min(c).over(W().rowsBetween(-k, -1)), F.min(c).over(W().rowsBetween(1, k)))
    whole = (F.count(F.lit(1)).over(W().rowsBetween(-k, -1)) == k) & (F.count(F.lit(1)).over(W().rowsBetween(1, k)) == k)
    d = df.withColumns({"_r": whole & (F.col("high") > top("high")), "_s": whole & (F.col("low") < low("low")), "known": F.lead("ts", k).over(W())})
    kinds = F.filter(F.array(F.struct(F.col("_r").alias("on"), F.lit("resistance").alias("kind"), F.col("high").alias("level")), F.struct(F.col("_s").alias("on"), F.lit("support").alias("kind"), F.col("low").alias("level"))), lambda x: x["on"])
    return d.select("series_id", "ts", "known", F.explode(kinds).alias("_p")).select("series_id", "ts", "_p.kind", "_p.level", "known")


def levels(pivots_: DataFrame, gap: float = 0.02) -> DataFrame:
    """(series_id, kind, level, touches, first_known, last_known): pivots clustered by gaps. Sorted by level, one that lies more
    than ``gap`` of its value above the one below begins a new cluster."""
    w = Window.partitionBy("series_id", "kind").orderBy("level", "ts")
    new = F.coalesce(F.col("level") > F.lag("level").over(w) * (1 + gap), F.lit(True))
    d = pivots_.withColumn("_c", F.sum(new.cast("int")).over(w.rowsBetween(o.START, 0)))
    g = d.groupBy("series_id", "kind", "_c").agg(F.avg("level").alias("level"), F.count(F.lit(1)).alias("touches"), F.min("known").alias("first_known"), F.max("known").alias("last_known"))
    return g.drop("_c")
