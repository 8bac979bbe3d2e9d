"""Queries of indicators, indices, strategies and portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ordered as o
from ..operators import align, features, genetic, indices, portfolio, signals
from .views import FLOW, PX, RET, Book, W, flow, px, returns, rolled, rounded

BOOK = Book()
query = BOOK.add
UNB = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_R = f"rr AS (SELECT *, value / lag(value) OVER ({W}) - 1 AS r, row_number() OVER ({W}) AS rn FROM px)"

# indicators


@query(f"WITH {PX} SELECT series_id, ts, round(value / lag(value, 5) OVER w - 1, 6) AS mom_5, round(value / lag(value, 20) OVER w - 1, 6) AS mom_20 FROM px WINDOW w AS ({W})")
def momentum(s, d):
    return rounded(features.momentum(px(s, d), [5, 20]).drop("value"))


@query(f"WITH {PX}, {_R} SELECT series_id, ts, round({rolled('stddev_samp({})', 'r', 10)}, 6) AS vol_10, round({rolled('stddev_samp({})', 'r', 20)}, 6) AS vol_20 FROM rr")
def volatility(s, d):
    return rounded(features.volatility(px(s, d), [10, 20]).drop("value"))


@query(f"WITH {PX} SELECT series_id, ts, round(value / ({rolled('avg({})', 'value', 10)}) - 1, 6) AS sma_10_dev, round(value / ({rolled('avg({})', 'value', 50)}) - 1, 6) AS sma_50_dev FROM px")
def sma_dev(s, d):
    return rounded(features.sma_deviation(px(s, d), [10, 50]).drop("value"))


@query(f"""WITH RECURSIVE {PX}, n AS (SELECT *, row_number() OVER ({W}) AS rn FROM px),
e AS (SELECT series_id, ts, rn, value AS f, value AS s, 0.0::DOUBLE AS g FROM n WHERE rn = 1
  UNION ALL SELECT n.series_id, n.ts, n.rn, e.f + (2.0 / 13) * (n.value - e.f), e.s + (2.0 / 27) * (n.value - e.s),
    e.g + 0.2 * ((e.f + (2.0 / 13) * (n.value - e.f)) - (e.s + (2.0 / 27) * (n.value - e.s)) - e.g) FROM e JOIN n ON n.series_id = e.series_id AND n.rn = e.rn + 1)
SELECT series_id, ts, round(f - s, 3) AS macd, round(g, 3) AS macd_signal, round(f - s - g, 3) AS macd_hist FROM e""")
def macd(s, d):
    return rounded(features.macd(px(s, d)).drop("value"), 3)


@query(f"WITH {PX}, x AS (SELECT *, {rolled('min({})', 'value', 14)} AS lo, {rolled('max({})', 'value', 14)} AS hi FROM px) SELECT series_id, ts, round(100 * (value - lo) / (hi - lo + 1e-8), 6) AS stoch_k FROM x")
def stochastic(s, d):
    return rounded(features.stochastic(px(s, d)).drop("value"))


@query(f"""WITH {PX}, m AS (SELECT *, value - lag(value) OVER ({W}) AS m FROM px), u AS (SELECT *, CASE WHEN m IS NOT NULL THEN greatest(m, 0) END AS up, CASE WHEN m IS NOT NULL THEN greatest(-m, 0) END AS down FROM m),
g AS (SELECT series_id, ts, {rolled('avg({})', 'up', 14)} AS gain, {rolled('avg({})', 'down', 14)} AS loss FROM u)
SELECT series_id, ts, round(CASE WHEN loss = 0 AND gain > 0 THEN 100 WHEN loss > 0 THEN 100 - 100 / (1 + gain / loss) END, 6) AS rsi FROM g""")
def rsi(s, d):
    return rounded(features.rsi(px(s, d)).drop("value"))


@query(f"""WITH {PX}, m AS (SELECT *, value / lag(value) OVER ({W}) - 1 AS m FROM px), u AS (SELECT *, CASE WHEN m IS NOT NULL THEN greatest(m, 0) END AS up, CASE WHEN m IS NOT NULL THEN greatest(-m, 0) END AS down FROM m),
g AS (SELECT series_id, ts, {rolled('avg({})', 'up', 14)} AS gain, {rolled('avg({})', 'down', 14)} AS loss FROM u)
SELECT series_id, ts, round(100 - 100 / (1 + gain / (loss + 1e-10)), 6) AS rsi FROM g""")
def rsi_returns(s, d):
    return rounded(features.rsi(px(s, d), 14, "return").drop("value"))


@query(f"""WITH {PX}, x AS (SELECT *, {rolled('avg({})', 'value', 20)} AS m, {rolled('stddev_samp({})', 'value', 20)} AS sd FROM px)
SELECT series_id, ts, round(m + 2 * sd, 5) AS bb_upper, round(m - 2 * sd, 5) AS bb_lower, round((value - (m - 2 * sd)) / (4 * sd), 4) AS bb_position, round(4 * sd / m, 4) AS bb_width FROM x""")
def bollinger(s, d):
    b = features.bollinger(px(s, d))
    return b.select("series_id", "ts", *[F.round(c, 5).alias(c) for c in ("bb_upper", "bb_lower")], *[(F.round(c, 4) + 0.0).alias(c) for c in ("bb_position", "bb_width")])


@query(f"WITH {PX}, x AS (SELECT *, {rolled('avg({})', 'value', 20)} AS m, {rolled('stddev_samp({})', 'value', 20)} AS sd FROM px) SELECT series_id, ts, round((value - m) / sd, 6) AS z_20 FROM x")
def zscore(s, d):
    return rounded(features.zscores(px(s, d), [20]).drop("value"))


@query(f"WITH {PX} SELECT series_id, ts, round(value - lag(value) OVER w, 6) AS chg_1, round(value - lag(value, 5) OVER w, 6) AS chg_5, round(value, 6) AS level FROM px WINDOW w AS ({W})")
def level_changes(s, d):
    return rounded(features.changes(px(s, d), [1, 5]).drop("value"))


@query(f"""WITH {PX}, x AS (SELECT *, {rolled('max({})', 'value', 2)} - ({rolled('min({})', 'value', 2)}) AS rg FROM px), y AS (SELECT *, {rolled('avg({})', 'rg', 20)} AS mr FROM x)
SELECT series_id, ts, round(1e6 * abs(value / lag(value, 20) OVER ({W}) - 1) / (mr + 1e-10), 6) AS trend_strength FROM y""")
def trend_strength(s, d):
    t = features.trend_strength(px(s, d))
    return rounded(t.select("series_id", "ts", (1e6 * F.col("trend_strength")).alias("trend_strength")))


@query(f"WITH {PX}, m AS (SELECT *, value / lag(value, 5) OVER ({W}) - 1 AS m FROM px) SELECT series_id, ts, round(m - lag(m, 5) OVER ({W}), 6) AS acceleration FROM m")
def acceleration(s, d):
    return rounded(features.acceleration(px(s, d)).drop("value"))


@query(f"WITH {PX} SELECT series_id, ts, round(value / ({rolled('max({})', 'value', 20)}) - 1, 6) AS from_high, round(value / ({rolled('min({})', 'value', 20)}) - 1, 6) AS from_low FROM px")
def from_extremes(s, d):
    return rounded(features.from_extremes(px(s, d)).drop("value"))


@query(f"WITH {PX}, x AS (SELECT *, {rolled('avg({})', 'value', 10)} AS f, {rolled('avg({})', 'value', 30)} AS s FROM px) SELECT series_id, ts, coalesce(CAST(value > s AS INTEGER), 0) AS above_ma, coalesce(CAST(f > s AS INTEGER), 0) AS ma_cross FROM x")
def ma_cross(s, d):
    return features.ma_cross(px(s, d)).drop("value")


@query(f"""WITH {PX}, {_R}, v AS (SELECT series_id, ts, {rolled('stddev_samp({})', 'r', 20)} AS vol FROM rr),
x AS (SELECT *, {rolled('stddev_samp({})', 'vol', 20)} AS vv, {rolled('avg({})', 'vol', 60)} AS m, {rolled('stddev_samp({})', 'vol', 60)} AS sd, {rolled('quantile_cont({}, 0.5)', 'vol', 60)} AS md FROM v)
SELECT series_id, ts, round(vol, 5) AS vol, round(vv, 5) AS vol_of_vol, round((vol - m) / sd, 5) AS vol_z, coalesce(CAST(vol > md AS INTEGER), 0) AS high_vol FROM x""")
def vol_regime(s, d):
    return rounded(features.vol_regime(px(s, d)).drop("value"), 5)


@query(f"WITH {PX}, {_R} SELECT series_id, ts, round({rolled('skewness({})', 'r', 20)}, 4) AS ret_skew, round({rolled('kurtosis({})', 'r', 20)}, 4) AS ret_kurt FROM rr")
def return_moments(s, d):
    return rounded(features.return_moments(px(s, d)).drop("value"), 4)


@query(f"""WITH {PX}, m AS (SELECT *, coalesce(value > lag(value) OVER ({W}), false) AS up, coalesce(value < lag(value) OVER ({W}), false) AS dn FROM px),
g AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER {UNB} AS gu, sum(CASE WHEN dn THEN 0 ELSE 1 END) OVER {UNB} AS gd FROM m)
SELECT series_id, ts, CAST(sum(CASE WHEN up THEN 1 ELSE 0 END) OVER (PARTITION BY series_id, gu ORDER BY ts) AS BIGINT) AS up_streak, CAST(sum(CASE WHEN dn THEN 1 ELSE 0 END) OVER (PARTITION BY series_id, gd ORDER BY ts) AS BIGINT) AS down_streak FROM g""")
def streaks(s, d):
    return features.streaks(px(s, d)).select("series_id", "ts", "up_streak", "down_streak")


@query(f"WITH {PX}, x AS (SELECT a.series_id, a.ts, a.value / b.value AS ratio FROM px a JOIN px b ON a.ts = b.ts WHERE b.series_id = '1-URGENT') SELECT series_id, ts, round(ratio, 6) AS ratio, round(ratio / lag(ratio, 20) OVER ({W}) - 1, 6) AS ratio_mom FROM x")
def relative_strength(s, d):
    return rounded(features.relative_strength(px(s, d), "1-URGENT").drop("value"))


_M3 = f"m AS (SELECT *, value / lag(value, 2) OVER w - 1 AS m2, value / lag(value, 5) OVER w - 1 AS m5, value / lag(value, 10) OVER w - 1 AS m10 FROM px WINDOW w AS ({W})), c AS (SELECT *, coalesce(CAST(m2 > 0 AS INTEGER), 0) + coalesce(CAST(m5 > 0 AS INTEGER), 0) + coalesce(CAST(m10 > 0 AS INTEGER), 0) AS k FROM m)"


@query(f"WITH {PX}, {_M3} SELECT series_id, ts, k AS n_confirmed, round(k / 3, 6) AS pct_confirmed FROM c")
def confirmations(s, d):
    return rounded(features.confirmations(px(s, d), [2, 5, 10]).drop("value"))


@query(f"WITH {PX}, m AS (SELECT *, value / lag(value, 4) OVER ({W}) - 1 AS m FROM px), g AS (SELECT ts, CASE WHEN count(m) = count(*) THEN avg(m) END AS c FROM m GROUP BY ts) SELECT ts, round(c, 6) AS combined, coalesce(CAST(c > 0 AS INTEGER), 0) AS signal FROM g")
def combined_momentum(s, d):
    return rounded(features.combined_momentum(px(s, d)))


@query(f"""WITH {PX}, p AS (SELECT a.series_id AS a, b.series_id AS b, a.ts, a.value AS va, b.value AS vb FROM px a JOIN px b ON a.ts = b.ts WHERE a.series_id < b.series_id),
r AS (SELECT a, b, ts, va / lag(va) OVER w - 1 AS ra, vb / lag(vb) OVER w - 1 AS rb FROM p WINDOW w AS (PARTITION BY a, b ORDER BY ts))
SELECT a, b, ts, round(CASE WHEN count(CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN 1 END) OVER f >= 20 THEN corr(ra, rb) OVER f END, 5) AS corr FROM r WINDOW f AS (PARTITION BY a, b ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def pairwise_corr(s, d):
    return rounded(features.correlations(px(s, d), align.pairs(px(s, d))), 5)


@query(f"""WITH {FLOW}, k AS (SELECT series_id || '|' || ts AS key, value, volume, high - low AS spread, value * 2 AS copy, lead(value) OVER ({W}) / value - 1 AS y FROM fl),
l AS (SELECT key, 'value' AS feature, value AS v, y FROM k UNION ALL SELECT key, 'volume', volume, y FROM k UNION ALL SELECT key, 'spread', spread, y FROM k UNION ALL SELECT key, 'zcopy', copy, y FROM k),
st AS (SELECT feature, var_samp(v) AS variance, corr(v, y) AS corr FROM l WHERE y IS NOT NULL GROUP BY feature),
mu AS (SELECT DISTINCT b.feature FROM l a JOIN l b ON a.key = b.key WHERE a.feature < b.feature GROUP BY a.feature, b.feature HAVING abs(corr(a.v, b.v)) > 0.9)
SELECT st.feature, round(variance, 2) AS variance, round(corr, 6) AS corr, (mu.feature IS NOT NULL) AS redundant, (coalesce(abs(corr) > 0.05 AND variance > 0, false) AND mu.feature IS NULL) AS keep FROM st LEFT JOIN mu ON st.feature = mu.feature""")
def feature_select(s, d):
    f = flow(s, d).withColumns({"key": F.concat_ws("|", "series_id", F.col("ts").cast("string")), "spread": F.col("high") - F.col("low"), "zcopy": F.col("value") * 2, "y": F.try_divide(F.lead("value").over(o.series()), F.col("value")) - 1})
    long = f.unpivot("key", ["value", "volume", "spread", "zcopy"], "feature", "value")
    out = features.select_features(long, f.select("key", "y").where("y is not null"))
    return out.select("feature", F.round("variance", 2).alias("variance"), F.round("corr", 6).alias("corr"), "redundant", "keep")


@query(f"""WITH {FLOW}, b AS (SELECT series_id, ts, low + (high - low) * 0.5 AS open, high, low, value AS close, volume FROM fl),
p AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, lag(close) OVER w AS pc, max(high) OVER ({W} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS top FROM b WINDOW w AS ({W}))
SELECT series_id, ts, round({rolled('avg({})', 'tr', 14)}, 5) AS atr, round(100 * (close / lag(close, 14) OVER ({W}) - 1), 5) AS roc, coalesce(CAST(close > top AS INTEGER), 0) AS breakout,
round(sum(coalesce(sign(close - pc), 0) * volume) OVER {UNB}, 5) AS obv, round(sum(coalesce(close / pc - 1, 0) * volume) OVER {UNB}, 5) AS vpt,
CAST(abs(close - open) <= 0.1 * (high - low) AS INTEGER) AS doji, CAST((least(open, close) - low >= 2 * abs(close - open)) AND (high - greatest(open, close) <= abs(close - open)) AS INTEGER) AS hammer, round(open / pc - 1, 5) AS gap FROM p""")
def bar_filters(s, d):
    b = flow(s, d).select("series_id", "ts", (F.col("low") + (F.col("high") - F.col("low")) * 0.5).alias("open"), "high", "low", F.col("value").alias("close"), "volume")
    out = features.candles(features.volume_flow(features.average_true_range(b)))
    return rounded(out.select("series_id", "ts", "atr", "roc", "breakout", "obv", "vpt", "doji", "hammer", "gap"), 5)


@query(f"""WITH {PX}, {_R}, f AS (SELECT series_id, ts, value / lag(value, 5) OVER w - 1 AS mom_5, value / lag(value, 60) OVER w - 1 AS mom_60, {rolled('stddev_samp({})', 'r', 20)} AS vol_20, value / ({rolled('avg({})', 'value', 50)}) - 1 AS sma_50_dev, value / ({rolled('max({})', 'value', 60)}) - 1 AS high_60 FROM rr WINDOW w AS ({W}))
SELECT series_id, ts, {", ".join(f"round(coalesce(last_value({c} IGNORE NULLS) OVER {UNB}, 0), 6) AS {c}" for c in ("mom_5", "mom_60", "vol_20", "sma_50_dev", "high_60"))} FROM f""")
def feature_set(s, d):
    return rounded(features.feature_set(px(s, d)).select("series_id", "ts", "mom_5", "mom_60", "vol_20", "sma_50_dev", "high_60"))


# indices


@query(f"""WITH {RET}, y AS (SELECT *, (value / first_value(value) OVER (PARTITION BY series_id, year(ts) ORDER BY ts) - 1) * 100 AS ytd, year(ts) AS yr FROM rt),
f AS (SELECT series_id, yr, coalesce(1 + arg_max(ytd, ts) / 100, 1) AS f FROM y GROUP BY series_id, yr),
b AS (SELECT series_id, yr, 100 * coalesce(product(f) OVER (PARTITION BY series_id ORDER BY yr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS base FROM f)
SELECT y.series_id, y.ts, round(base * (1 + ytd / 100), 6) AS index FROM y JOIN b ON y.series_id = b.series_id AND y.yr = b.yr""")
def ytd_index(s, d):
    r = returns(s, d).withColumn("_f", F.first("value").over(o.Window.partitionBy("series_id", F.year("ts")).orderBy("ts")))
    return rounded(indices.from_ytd(r.select("series_id", "ts", ((F.col("value") / F.col("_f") - 1) * 100).alias("value"))))


_CASH = """m AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM px GROUP BY series_id), g AS (SELECT series_id, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ts FROM m),
c AS (SELECT g.series_id, g.ts, last_value(px.value / 100000 IGNORE NULLS) OVER (PARTITION BY g.series_id ORDER BY g.ts) AS rate, row_number() OVER (PARTITION BY g.series_id ORDER BY g.ts) AS rn FROM g LEFT JOIN px ON g.series_id = px.series_id AND g.ts = px.ts),
cash AS (SELECT series_id, ts, 100 * product(CASE WHEN rn = 1 THEN 1 ELSE 1 + rate / 100 / 365 END) OVER (PARTITION BY series_id ORDER BY ts) AS index FROM c)"""
_LEV = f"lv AS (SELECT series_id, ts, 3 * 100 * (value / lag(value) OVER ({W}) - 1) - 0.4 * date_diff('day', lag(ts) OVER ({W}), ts) / 365 AS r FROM rt), lev AS (SELECT series_id, ts, r, 100 * product(coalesce(1 + r / 100, 1)) OVER ({W}) AS index FROM lv)"
_GROSS = f"gj AS (SELECT lev.series_id, lev.ts, lev.index AS a, cash.index AS b FROM lev JOIN cash ON lev.series_id = cash.series_id AND lev.ts = cash.ts), gr AS (SELECT series_id, ts, 100 * (a / lag(a) OVER ({W}) - 1) + 100 * (b / lag(b) OVER ({W}) - 1) AS r FROM gj)"


def _cash(s, d):
    return indices.money_market(px(s, d).withColumn("value", F.col("value") / 100_000))


@query(f"WITH {PX}, {_CASH} SELECT series_id, ts, round(index, 6) AS index FROM cash")
def tbill_index(s, d):
    return rounded(_cash(s, d))


@query(f"WITH {RET}, {_LEV} SELECT series_id, ts, round(r, 3) AS ret_pct, round(index, 3) AS index FROM lev")
def levered_index(s, d):
    return rounded(indices.levered(returns(s, d)), 3)


@query(f"WITH {RET}, {_CASH}, {_LEV}, {_GROSS} SELECT series_id, ts, round(r, 3) AS ret_pct, round(100 * product(coalesce(1 + r / 100, 1)) OVER ({W}), 3) AS index FROM gr")
def gross_index(s, d):
    return rounded(indices.gross(indices.levered(returns(s, d)), _cash(s, d)), 3)


@query(f"WITH {RET}, {_CASH}, {_LEV}, {_GROSS}, nt AS (SELECT series_id, ts, CASE WHEN r - (0.90 + 0.20) / 365 > 0 THEN 0.85 * (r - (0.90 + 0.20) / 365) ELSE r - (0.90 + 0.20) / 365 END AS r FROM gr) SELECT series_id, ts, round(r, 3) AS ret_pct, round(100 * product(coalesce(1 + r / 100, 1)) OVER ({W}), 3) AS index FROM nt")
def net_index(s, d):
    return rounded(indices.net(indices.gross(indices.levered(returns(s, d)), _cash(s, d))), 3)


# strategies

_EDGE = "SELECT series_id, ts, position, (position = 1 AND coalesce(lag(position) OVER (PARTITION BY series_id ORDER BY ts), 0) = 0) AS entry, (position = 0 AND coalesce(lag(position) OVER (PARTITION BY series_id ORDER BY ts), 0) = 1) AS exit FROM ps"
_CROSS = f"{_M3}, ps AS (SELECT series_id, ts, value, CAST(coalesce(last_value(CASE WHEN isodow(ts) = 1 THEN k >= 2 END IGNORE NULLS) OVER {UNB}, false) AS INTEGER) AS position FROM c)"


def _signal(df):
    return df.select("series_id", "ts", "position", "entry", "exit")


@query(f"WITH {PX}, {_CROSS} {_EDGE}")
def st_cross_asset(s, d):
    return _signal(signals.cross_momentum(px(s, d)))


@query(f"""WITH {PX}, m AS (SELECT *, (coalesce(value / lag(value, 2) OVER w - 1, 0) + coalesce(value / lag(value, 4) OVER w - 1, 0) + coalesce(value / lag(value, 8) OVER w - 1, 0)) / 3 AS mm FROM px WINDOW w AS ({W})),
ps AS (SELECT series_id, ts, max(CASE WHEN isodow(ts) = 1 AND mm > -0.005 THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS position FROM m) {_EDGE}""")
def st_multi_asset(s, d):
    return _signal(signals.mean_momentum(px(s, d)))


@query(f"WITH {PX}, m AS (SELECT *, value / lag(value, 1) OVER w - 1 AS a, value / lag(value, 3) OVER w - 1 AS b, value / lag(value, 6) OVER w - 1 AS c FROM px WINDOW w AS ({W})), ps AS (SELECT series_id, ts, CAST(coalesce(last_value(CASE WHEN isodow(ts) = 1 THEN coalesce(CAST(a > 0 AS INTEGER), 0) + coalesce(CAST(b > 0 AS INTEGER), 0) + coalesce(CAST(c > 0 AS INTEGER), 0) >= 2 END IGNORE NULLS) OVER {UNB}, false) AS INTEGER) AS position FROM m) {_EDGE}")
def st_two_of_three(s, d):
    return _signal(signals.cross_momentum(px(s, d), (1, 3, 6), 2))


@query(f"""WITH RECURSIVE {PX}, {_R}, v AS (SELECT series_id, ts, rn, value / lag(value, 10) OVER ({W}) - 1 AS m, {rolled('stddev_samp({})', 'r', 20)} AS vol, (value - {rolled('avg({})', 'value', 20)}) / ({rolled('stddev_samp({})', 'value', 20)}) AS z FROM rr),
h AS (SELECT *, coalesce(vol > quantile_cont(vol, 0.5) OVER (PARTITION BY series_id), false) AS high FROM v),
g AS (SELECT *, CASE WHEN coalesce(z <= CASE WHEN high THEN 0.5 ELSE 1.0 END AND (high OR m > 0), false) THEN CAST(least(1 + floor(greatest(0, coalesce(m, 0)) / 0.02), 10) AS INTEGER) ELSE 0 END AS go FROM h),
f AS (SELECT series_id, ts, rn, go AS rest FROM g WHERE rn = 1
  UNION ALL SELECT g.series_id, g.ts, g.rn, CASE WHEN f.rest > 1 THEN f.rest - 1 ELSE g.go END FROM f JOIN g ON g.series_id = f.series_id AND g.rn = f.rn + 1),
ps AS (SELECT series_id, ts, CASE WHEN rest > 0 THEN 1 ELSE 0 END AS position FROM f) {_EDGE}""")
def st_vol_adaptive(s, d):
    return _signal(signals.vol_adaptive(px(s, d)))


@query(f"""WITH RECURSIVE {PX}, {_R}, g AS (SELECT series_id, ts, rn, coalesce(CAST(r > 0.1 AS INTEGER), 0) AS sig FROM rr),
f AS (SELECT series_id, ts, rn, sig, sig AS held, CASE WHEN sig = 1 THEN 6 ELSE 0 END AS rest FROM g WHERE rn = 1
  UNION ALL SELECT g.series_id, g.ts, g.rn, g.sig, CASE WHEN f.rest > 0 OR g.sig = 1 THEN 1 ELSE 0 END, CASE WHEN f.rest > 0 THEN f.rest - 1 WHEN g.sig = 1 THEN 6 ELSE 0 END FROM f JOIN g ON g.series_id = f.series_id AND g.rn = f.rn + 1)
SELECT series_id, ts, sig, held FROM f""")
def hold_greedy(s, d):
    p = px(s, d).withColumn("sig", F.coalesce((o.pct_change("value", 1, o.series()) > 0.1).cast("int"), F.lit(0)))
    return signals.hold_greedy(p, "sig", 7).select("series_id", "ts", "sig", "held")


@query(f"WITH {PX} SELECT series_id, ts, coalesce(CAST(lead(value, 5) OVER w / value - 1 > 0 AS INTEGER), 0) AS label, CASE WHEN lead(value, 5) OVER w IS NOT NULL THEN CASE WHEN lead(value, 5) OVER w / value - 1 > 0.1 THEN 1 WHEN lead(value, 5) OVER w / value - 1 < -0.1 THEN -1 ELSE 0 END END AS fixed FROM px WINDOW w AS ({W})")
def labels(s, d):
    a = signals.labels(px(s, d), 5)
    return signals.fixed_horizon(a.withColumnRenamed("label", "up"), 5, 0.1).select("series_id", "ts", F.col("up").alias("label"), F.col("label").alias("fixed"))


@query(f"""WITH {RET}, a AS (SELECT x.series_id, x.ts, y.rn - x.rn AS k, y.value / x.value - 1 AS g FROM rt x LEFT JOIN rt y ON x.series_id = y.series_id AND y.rn BETWEEN x.rn + 1 AND x.rn + 10),
h AS (SELECT series_id, ts, min(CASE WHEN g >= 0.003 OR g <= -0.003 THEN k END) AS k, count(k) AS n FROM a GROUP BY series_id, ts)
SELECT h.series_id, h.ts, CASE WHEN h.k IS NULL THEN 0 WHEN a.g >= 0.003 THEN 1 ELSE -1 END AS barrier, CAST(coalesce(h.k, h.n) AS INTEGER) AS touch_rows FROM h LEFT JOIN a ON h.series_id = a.series_id AND h.ts = a.ts AND h.k = a.k""")
def triple_barrier(s, d):
    return signals.triple_barrier(returns(s, d), 10, 0.003, 0.003).select("series_id", "ts", "barrier", "touch_rows")


_RULE = f"f AS (SELECT *, value / lag(value, 5) OVER w - 1 AS mom_5, (value - ({rolled('avg({})', 'value', 20)})) / ({rolled('stddev_samp({})', 'value', 20)}) AS z_20, value / lag(value) OVER w - 1 AS r FROM px WINDOW w AS ({W}))"


@query(f"""WITH {PX}, {_RULE}, o AS (SELECT series_id, ts, r, 0 AS rule_id, coalesce(mom_5 > 0.05, false) AND coalesce(z_20 < 1.0, false) AS onn FROM f UNION ALL SELECT series_id, ts, r, 1, coalesce(mom_5 < -0.1, false) OR coalesce(z_20 > 1.5, false) FROM f),
p AS (SELECT *, CAST(coalesce(last_value(CASE WHEN isodow(ts) = 1 THEN onn END IGNORE NULLS) OVER (PARTITION BY series_id, rule_id ORDER BY ts), false) AS INTEGER) AS pos FROM o),
g AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY series_id, rule_id ORDER BY ts) * r, 0) AS g FROM p),
e AS (SELECT *, product(1 + g) OVER (PARTITION BY series_id, rule_id ORDER BY ts) AS eq FROM g), k AS (SELECT *, eq / max(eq) OVER (PARTITION BY series_id, rule_id ORDER BY ts) - 1 AS dd FROM e),
z AS (SELECT series_id, rule_id, sum(ln(abs(1 + g))) AS lr, min(dd) AS dd FROM k GROUP BY series_id, rule_id)
SELECT series_id, rule_id, round(lr, 3) AS log_growth, round(dd, 3) AS max_drawdown FROM z""")
def rule_fitness(s, d):
    p = features.zscores(features.momentum(px(s, d), [5]), [20])
    out = genetic.fitness(p, ["(mom_5 > 0.05) & (z_20 < 1.0)", "(mom_5 < -0.1) | (z_20 > 1.5)"])
    return rounded(out.select("series_id", "rule_id", F.ln(F.abs(1 + F.col("total_return"))).alias("log_growth"), "max_drawdown"), 3)


@query()
def ga_search(s, d):
    f = features.zscores(features.momentum(returns(s, d).select("series_id", "ts", "value"), [5, 10]), [20])
    found = genetic.Search(genetic.thresholds(f, ["mom_5", "mom_10", "z_20"])).run(f, population=120, generations=3, elite=25)
    return s.createDataFrame([(i, genetic.text_of(x["rule"]), float(x["total_return"]), float(x["fitness"])) for i, x in enumerate(found)], "rank int, rule string, total_return double, fitness double")


# portfolio

BT = f"""{_CROSS}, sg AS ({_EDGE.replace('SELECT series_id, ts, position,', 'SELECT series_id, ts, value, position,')}),
b0 AS (SELECT series_id, ts, position, coalesce(lag(position) OVER ({W}), 0) AS before, ret AS pr FROM (SELECT sg.*, rt.ret FROM sg JOIN rt ON sg.series_id = rt.series_id AND sg.ts = rt.ts) q),
b1 AS (SELECT *, CAST(position <> before AS INTEGER) AS side, (1 + before * pr) * CASE WHEN position <> before THEN 1 - 0.001 ELSE 1 END AS f FROM b0),
b2 AS (SELECT *, 100 * product(f) OVER ({W}) AS equity, CAST(sum(side) OVER ({W}) AS BIGINT) AS sides FROM b1),
bt AS (SELECT *, CASE WHEN row_number() OVER ({W}) = 1 THEN 0 ELSE f - 1 END AS ret, row_number() OVER ({W}) AS rn FROM b2)"""


def _bt(s, d, fee: float = 0.001):
    """Monday momentum on px, run on the scaled levels."""
    sig = signals.cross_momentum(px(s, d)).select("series_id", "ts", "entry", "exit")
    return portfolio.backtest(returns(s, d).select("series_id", "ts", "value").join(sig, ["series_id", "ts"]), fee=fee)


@query(f"WITH {RET}, {BT} SELECT series_id, ts, position, round(equity, 6) AS equity, sides, round(ret, 6) AS ret FROM bt")
def manual_backtest(s, d):
    return rounded(_bt(s, d).select("series_id", "ts", "position", "equity", "sides", "ret"))


_SUM = """k AS (SELECT *, equity / max(equity) OVER (PARTITION BY series_id ORDER BY ts) - 1 AS dd FROM bt),
g AS (SELECT series_id, count(*) AS n, arg_max(equity, ts) AS fv, arg_min(equity, ts) AS iv, avg(ret) AS m, stddev_samp(ret) AS sd, stddev_samp(CASE WHEN ret < 0 THEN ret END) AS dn, min(dd) AS mdd, max(sides) AS trades, avg(position) AS tim FROM k GROUP BY series_id)
SELECT series_id, n, round(fv, 6) AS final_value, round(iv, 6) AS initial_value, round(fv / iv - 1, 6) AS total_return, round(pow(fv / iv, 252.0 / n) - 1, 6) AS cagr, round(sd * sqrt(252.0), 6) AS volatility,
round(CASE WHEN sd > 0 THEN m / sd * sqrt(252.0) ELSE 0 END, 6) AS sharpe, round(CASE WHEN dn > 0 THEN m / dn * sqrt(252.0) ELSE 0 END, 6) AS sortino, round(mdd, 6) AS max_drawdown, trades, round(tim, 6) AS time_in_market FROM g"""


@query(f"WITH {RET}, {BT}, {_SUM}")
def momentum_backtest(s, d):
    return rounded(portfolio.summary(_bt(s, d)))


@query(f"WITH {PX}, {_CROSS} SELECT series_id, ts, position FROM ps")
def positions(s, d):
    return portfolio.positions(signals.cross_momentum(px(s, d)).drop("position")).select("series_id", "ts", "position")


@query(f"""WITH {RET}, {_CROSS}, x AS (SELECT ps.series_id, ps.ts, ps.position, rt.value FROM ps JOIN rt ON ps.series_id = rt.series_id AND ps.ts = rt.ts),
r AS (SELECT *, position * coalesce(ln(lead(value) OVER ({W}) / value), 0) AS r, abs(position - coalesce(lag(position) OVER ({W}), 0)) AS dp FROM x),
k AS (SELECT *, exp(sum(r) OVER ({W})) AS eq FROM r), q AS (SELECT *, eq / max(eq) OVER ({W}) - 1 AS dd FROM k),
g AS (SELECT series_id, exp(sum(r)) - 1 AS tr, avg(r) * 52 AS ar, stddev_samp(r) * sqrt(52.0) AS av, min(dd) AS dd, sum(dp) / 2 AS trades, count(*) FILTER (r > 0) / nullif(count(*) FILTER (r <> 0), 0) AS wr, stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(52.0) AS dn FROM q GROUP BY series_id)
SELECT series_id, round(tr, 6) AS total_return, round(ar, 6) AS ann_return, round(av, 6) AS ann_vol, round(dd, 6) AS max_drawdown, CAST(trades AS DOUBLE) AS trades, round(wr, 6) AS win_rate, round(coalesce(ar / nullif(av, 0), 0), 6) AS sharpe, round(coalesce(ar / nullif(CASE WHEN dn > 0 THEN dn ELSE av END, 0), 0), 6) AS sortino FROM g""")
def log_backtest(s, d):
    sig = signals.cross_momentum(px(s, d)).select("series_id", "ts", "position")
    return rounded(portfolio.log_backtest(returns(s, d).select("series_id", "ts", "value").join(sig, ["series_id", "ts"])))


@query(f"""WITH {PX}, {_CROSS}, x AS (SELECT *, sum(CASE WHEN position = 1 AND coalesce(pl, 0) = 0 THEN 1 ELSE 0 END) OVER ({W}) AS run, lead(ts) OVER ({W}) AS nts, lead(value) OVER ({W}) AS nv, max(ts) OVER (PARTITION BY series_id) AS last FROM (SELECT *, lag(position) OVER ({W}) AS pl FROM ps) q),
g AS (SELECT series_id, run, min(ts) AS entry_date, arg_min(value, ts) AS ep, (SELECT NULL) AS z, max(last) AS last, max(ts) AS lt FROM x WHERE position = 1 GROUP BY series_id, run)
SELECT g.series_id, CAST(g.run AS BIGINT) AS trade, entry_date, coalesce(x.nts, g.last) AS exit_date, round(ep, 4) AS entry_price, round(coalesce(x.nv, x.value), 4) AS exit_price, CAST(greatest(0, date_diff('day', entry_date, coalesce(x.nts, g.last))) AS INTEGER) AS days, round(coalesce(x.nv, x.value) / ep - 1, 6) AS ret, CASE WHEN x.nts IS NULL THEN 'open' ELSE 'closed' END AS status
FROM g JOIN x ON g.series_id = x.series_id AND g.lt = x.ts""")
def trades(s, d):
    t = portfolio.trades(signals.cross_momentum(px(s, d)))
    return t.select("series_id", F.col("trade").cast("long").alias("trade"), "entry_date", "exit_date", F.round("entry_price", 4).alias("entry_price"), F.round("exit_price", 4).alias("exit_price"), "days", F.round("ret", 6).alias("ret"), "status")


_GRID = "(VALUES (0, 5), (1, 10), (2, 20)) p(param_id, k)"


@query(f"""WITH {RET}, a AS (SELECT rt.*, p.param_id, p.k FROM rt CROSS JOIN {_GRID}),
m AS (SELECT *, CASE param_id WHEN 0 THEN lag(value, 5) OVER w WHEN 1 THEN lag(value, 10) OVER w ELSE lag(value, 20) OVER w END AS past FROM a WINDOW w AS (PARTITION BY series_id, param_id ORDER BY ts)),
g AS (SELECT *, coalesce(lag(CAST(coalesce(value / past - 1 > 0, false) AS INTEGER)) OVER (PARTITION BY series_id, param_id ORDER BY ts) * ret, 0) AS g FROM m),
z AS (SELECT series_id, param_id, product(1 + g) - 1 AS tr FROM g GROUP BY series_id, param_id),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(tr, 9) DESC, param_id) AS r FROM z)
SELECT series_id, CAST(param_id AS BIGINT) AS param_id, round(tr, 6) AS total_return, r = 1 AS best FROM k""")
def grid_search(s, d):
    ks = (5, 10, 20)
    w = o.series(("series_id", "param_id"))
    a = returns(s, d).join(F.broadcast(align.grid(s, {"k": ks})))  # a parameter grid has a handful of rows
    past = F.coalesce(*[F.when(F.col("k") == k, F.lag("value", k).over(w)) for k in ks])
    a = a.withColumn("_on", F.coalesce(F.try_divide(F.col("value"), past) - 1 > 0, F.lit(False)).cast("int"))
    g = a.withColumn("_g", F.coalesce(F.lag("_on").over(w) * F.col("ret"), F.lit(0.0))).groupBy("series_id", "param_id").agg((F.product(1 + F.col("_g")) - 1).alias("total_return"))
    best = F.row_number().over(o.Window.partitionBy("series_id").orderBy(F.round("total_return", 9).desc(), "param_id")) == 1
    return g.select("series_id", "param_id", F.round("total_return", 6).alias("total_return"), best.alias("best"))


@query(f"""WITH {RET}, {BT.replace('0.001', '0.0')}, cc AS (SELECT series_id, 'momentum' AS strategy, ret, rn FROM bt UNION ALL SELECT series_id, 'hold', ret, rn FROM rt),
g AS (SELECT series_id, strategy, product(1 + ret) - 1 AS tr, avg(ret) AS m, stddev_samp(ret) AS sd FROM cc GROUP BY series_id, strategy)
SELECT a.series_id, a.strategy, round(a.tr, 6) AS total_return, round(a.m / a.sd * sqrt(252.0), 6) AS sharpe, round(a.tr - b.tr, 6) AS excess FROM g a JOIN g b ON a.series_id = b.series_id AND b.strategy = 'hold'""")
def strategy_compare(s, d):
    c = _bt(s, d, 0.0).select("series_id", F.lit("momentum").alias("strategy"), "ret").unionByName(returns(s, d).select("series_id", F.lit("hold").alias("strategy"), "ret"))
    g = c.groupBy("series_id", "strategy").agg((F.product(1 + F.col("ret")) - 1).alias("total_return"), (F.avg("ret") / F.stddev_samp("ret") * 252**0.5).alias("sharpe"))
    b = F.max(F.when(F.col("strategy") == "hold", F.col("total_return"))).over(o.Window.partitionBy("series_id"))
    return rounded(g.withColumn("excess", F.col("total_return") - b))


def wf_parts(last: str, train: int = 120, test: int = 30, step: int = 15) -> str:
    """The common tables of a walk through bt, the last of which, wf, has a row per fold."""
    return f"""wn AS (SELECT series_id, count(*) AS n FROM bt GROUP BY series_id), wi AS (SELECT series_id, unnest(range(0, greatest(0, n - {train} - {test}{last}), {step})) AS i FROM wn),
wx AS (SELECT wi.series_id, CAST(wi.i / {step} AS BIGINT) AS fold, bt.ts, bt.ret FROM wi JOIN bt ON wi.series_id = bt.series_id AND bt.rn - 1 BETWEEN wi.i + {train} AND wi.i + {train + test - 1}),
we AS (SELECT *, product(1 + ret) OVER (PARTITION BY series_id, fold ORDER BY ts) AS eq FROM wx), wk AS (SELECT *, eq / greatest(1, max(eq) OVER (PARTITION BY series_id, fold ORDER BY ts)) - 1 AS dd FROM we),
wg AS (SELECT series_id, fold, product(1 + ret) - 1 AS tr, avg(ret) AS m, stddev_samp(ret) AS sd, min(dd) AS dd FROM wk GROUP BY series_id, fold),
wf AS (SELECT series_id, fold, tr AS total_return, sd * sqrt(252.0) AS volatility, CASE WHEN sd > 0 THEN m / sd * sqrt(252.0) ELSE 0 END AS sharpe, dd AS max_drawdown FROM wg)"""


def _wf_sql(last: str) -> str:
    return f"WITH {RET}, {BT}, {wf_parts(last)} SELECT series_id, fold, round(total_return, 6) AS total_return, round(volatility, 6) AS volatility, round(sharpe, 6) AS sharpe, round(max_drawdown, 6) AS max_drawdown FROM wf"


@query(_wf_sql(""))
def walk_forward_backtest(s, d):
    return rounded(portfolio.walk_forward(_bt(s, d), 120, 30, 15))


@query(_wf_sql(" + 1"))
def walk_forward(s, d):
    return rounded(portfolio.walk_forward(_bt(s, d), 120, 30, 15, include_last=True))


@query(f"""SELECT series_id, count(*) AS n_folds, round(avg(sharpe), 5) AS mean_sharpe, round(stddev_pop(sharpe), 5) AS std_sharpe, round(min(sharpe), 5) AS min_sharpe, round(max(sharpe), 5) AS max_sharpe, round(avg(total_return), 5) AS mean_return, round(stddev_pop(total_return), 5) AS std_return, round(avg(max_drawdown), 5) AS mean_drawdown, round(min(max_drawdown), 5) AS worst_drawdown, round(avg(CAST(total_return > 0 AS INTEGER)), 5) AS success_share
FROM ({_wf_sql(" + 1")}) q GROUP BY series_id""")
def walk_forward_summary(s, d):
    return rounded(portfolio.walk_forward_summary(rounded(portfolio.walk_forward(_bt(s, d), 120, 30, 15, include_last=True))), 5)
