"""Queries of boosting by rounds, clustered importance, meta-labels, imbalance bars, tails, attribution, baskets, trend
strength and levels, and their SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ordered as o
from ..session import written
from ..operators import attribution, bars, baskets, boosting, extremes, feature_sets, features, importance, learn, meta_labels, metrics, portfolio, research, signals, validation
from ..sources import intraday, sinks
from . import core, judging, panels, trading
from .views import FLOW, META, PX, RET, TICKS, Book, W, flow, meta, px, returns, rounded, table, ticks

BOOK = Book()
query = BOOK.add

# boosting


def _boosting_set(s: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """The boosting features of the daily panel, with its price as value."""
    return _with_price(panels.daily(s, d, panels.DAILY), lambda p: feature_sets.boosting_set(p, "price"))


def _with_price(p: DataFrame, features_of: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[str]]:
    """(series_id, ts, value, features) of a panel, written, as many fits read it; and the features' names."""
    f = features_of(p)
    names = [c for c in f.columns if c not in ("panel_id", "ts")]
    f = f.join(p.select("panel_id", "ts", F.col("price").alias("value")), ["panel_id", "ts"]).withColumnRenamed("panel_id", "series_id")
    return written(f.select("series_id", "ts", "value", *names), "panel-features"), names


AHEAD = (1, 5, 10)
ROUNDS = {"rounds": 200, "tol": 0.0001}


@query()
def boosting_rounds(s, d):
    f, names = _boosting_set(s, d)
    if f.isEmpty():  # too few dates that all series have
        return s.createDataFrame([], "series_id string, part string, round int, n_pos long, n_neg long, auc double, horizon int")
    out = None
    for h in AHEAD:
        rows = boosting.judged(f, h)
        a = boosting.round_auc(boosting.fit_until(rows, names, **ROUNDS), rows).withColumn("horizon", F.lit(h))
        out = a if out is None else out.unionByName(a)
    return rounded(out)


@query()
def boosting_horizons(s, d):
    f, names = _boosting_set(s, d)
    if f.isEmpty():
        return s.createDataFrame([], "series_id string, ts date, p double, position int, entry boolean, exit boolean")
    _, scored = boosting.horizons(f, names, AHEAD, **ROUNDS)
    return boosting.strategy(scored, boosting.sweeps(scored, AHEAD), AHEAD)


# importance


@query()
def clustered_importance(s, d):
    f, names = _with_price(panels.daily(s, d, panels.DAILY), feature_sets.credit_set)
    if f.isEmpty():  # too few dates that all series have
        return s.createDataFrame([], importance.CLUSTERED)
    x = written(learn.split(signals.labels(f, 5)), "labelled")
    groups = importance.clusters(importance.correlation(x, names), names, 20)
    fitted = learn.model("logit", names, n_train=1000).fit(x.where("part = 'train'"))
    return rounded(importance.clustered(fitted, x.where("part = 'test'").select("series_id", "ts", "label", *names), groups))


def _four(s: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    names = ["mom_5", "mom_20", "vol_20", "z_20"]
    return written(features.feature_set(returns(s, d).select("series_id", "ts", "value")).select("series_id", "ts", "value", *names).dropna(), "four-features"), names


@query()
def single_importance(s, d):
    f, names = _four(s, d)
    x = learn.split(signals.labels(f, 5))
    return rounded(importance.single(x.where("part = 'train'"), x.where("part = 'test'"), names, n_train=5000))


# meta-labels


@query()
def meta_bets(s, d):
    f, names = _four(s, d)
    return rounded(meta_labels.bets(f, names, 5, n_train=3000))


# imbalance bars


def _imbalance_sql(amount: str, t0: float, b0: float) -> str:
    return f"""WITH RECURSIVE {TICKS}, sg AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts, event_id) AS rn, sign(price - lag(price) OVER (PARTITION BY series_id ORDER BY ts, event_id)) AS s FROM tk),
n AS (SELECT *, coalesce(last_value(CASE WHEN s <> 0 THEN s END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) * {amount} AS a FROM sg),
f AS (
  SELECT series_id, rn, CAST(a AS DOUBLE) AS th, 1 AS k, {t0}::DOUBLE AS te, {b0}::DOUBLE AS be, 0::BIGINT AS bar, abs(a) >= {t0}::DOUBLE * abs({b0}::DOUBLE) AS shut FROM n WHERE rn = 1
  UNION ALL
  SELECT series_id, rn, th, k, te, be, bar, abs(th) >= te * abs(be) FROM (
    SELECT n.series_id, n.rn, CASE WHEN f.shut THEN n.a ELSE f.th + n.a END AS th, CASE WHEN f.shut THEN 1 ELSE f.k + 1 END AS k,
      CASE WHEN f.shut THEN least(1000.0::DOUBLE, greatest(1.0::DOUBLE, f.te + 0.1::DOUBLE * (f.k - f.te))) ELSE f.te END AS te, CASE WHEN f.shut THEN f.be + 0.1::DOUBLE * (f.th / f.k - f.be) ELSE f.be END AS be, f.bar + CAST(f.shut AS BIGINT) AS bar
    FROM f JOIN n ON n.series_id = f.series_id AND n.rn = f.rn + 1) q
),
j AS (SELECT n.*, f.bar, f.shut, f.th, f.te * abs(f.be) AS edge FROM n JOIN f ON n.series_id = f.series_id AND n.rn = f.rn)
SELECT series_id, bar, round(max(th) FILTER (shut), 6) AS theta, round(max(edge) FILTER (shut), 6) AS threshold, min(ts) AS start, max(ts) AS "end", round(arg_min(price, rn), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(arg_max(price, rn), 6) AS close, round(sum(volume), 6) AS volume, count(*) AS ticks
FROM j GROUP BY series_id, bar HAVING bool_or(shut)"""


@query(_imbalance_sql("1.0::DOUBLE", 30, 0.2))
def tick_imbalance_bars(s, d):
    return rounded(bars.imbalance_bars(ticks(s, d), 30, 0.2, order=("ts", "event_id")))


@query(_imbalance_sql("volume", 30, 1.0))
def volume_imbalance_bars(s, d):
    return rounded(bars.imbalance_bars(ticks(s, d), 30, 1.0, volume=True, order=("ts", "event_id")))


# tails


@query(f"""WITH {RET}, r AS (SELECT series_id, -ret AS loss, row_number() OVER (PARTITION BY series_id ORDER BY -ret DESC, ts) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM rt),
u AS (SELECT series_id, n, loss AS threshold FROM r WHERE i = 41),
g AS (SELECT u.series_id, u.n, u.threshold, avg(CASE WHEN i <= 40 AND u.threshold > 0 THEN ln(loss) - ln(u.threshold) END) AS hill, avg(CASE WHEN i <= 40 THEN loss - u.threshold END) AS m, var_samp(CASE WHEN i <= 40 THEN loss - u.threshold END) AS v,
  max(loss) FILTER (i = 10) AS a, max(loss) FILTER (i = 20) AS b, max(loss) FILTER (i = 40) AS c FROM r JOIN u ON r.series_id = u.series_id WHERE i <= 41 GROUP BY ALL),
h AS (SELECT *, CASE WHEN (a - b) / nullif(b - c, 0) > 0 THEN ln((a - b) / (b - c)) / ln(2) END AS pickands, 0.5 * (1 - m * m / v) AS shape, 0.5 * m * (m * m / v + 1) AS scale FROM g),
w AS (SELECT *, threshold + scale / shape * (pow(0.01 * n / 40, -shape) - 1) AS var_99, threshold + scale / shape * (pow(0.005 * n / 40, -shape) - 1) AS var_99_5 FROM h)
SELECT series_id, n, round(threshold, 6) AS threshold, round(hill, 6) AS hill, round(pickands, 6) AS pickands, round(shape, 6) AS shape, round(scale, 6) AS scale, round(var_99, 6) AS var_99, round((var_99 + scale - shape * threshold) / (1 - shape), 6) AS es_99, round(var_99_5, 6) AS var_99_5, round((var_99_5 + scale - shape * threshold) / (1 - shape), 6) AS es_99_5 FROM w""")
def tail_estimates(s, d):
    return rounded(extremes.tail(returns(s, d), 40, (0.99, 0.995)))


# attribution


def _factors(r: DataFrame, m: DataFrame) -> DataFrame:
    """(ts, market, tilt): the equal-weight mean of all series, and of one class less the other."""
    k = r.join(m, "series_id", "left")
    mean = lambda c: F.avg(F.when(F.col("asset_class") == c, F.col("ret")))
    return k.groupBy("ts").agg(F.avg("ret").alias("market"), (mean("rates") - mean("credit")).alias("tilt"))


_FACTORS = "k AS (SELECT rt.*, meta.asset_class FROM rt LEFT JOIN meta ON rt.series_id = meta.series_id), f AS (SELECT ts, avg(ret) AS market, avg(ret) FILTER (asset_class = 'rates') - avg(ret) FILTER (asset_class = 'credit') AS tilt FROM k GROUP BY ts)"
_RETM = f"{RET}{META.removeprefix(PX)}"


@query(f"""WITH {_RETM}, {_FACTORS}, x AS (SELECT rt.series_id, rt.ret AS y, f.market AS a, f.tilt AS b FROM rt JOIN f ON rt.ts = f.ts WHERE f.tilt IS NOT NULL),
c AS (SELECT series_id, count(*) AS n, avg(y) AS y, avg(a) AS a, avg(b) AS b, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, covar_pop(y, y) AS yy FROM x GROUP BY series_id),
w AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM c)
SELECT series_id, n, round((y - wa * a - wb * b) * 252, 6) AS alpha, round((wa * ay + wb * by_) / yy, 6) AS r2, round(wa, 6) AS beta_market, round(wb, 6) AS beta_tilt, round(wa * a * 252, 6) AS part_market, round(wb * b * 252, 6) AS part_tilt, round(sqrt((yy - wa * ay - wb * by_) * n / (n - 3) * 252), 6) AS specific FROM w""")
def factor_attribution(s, d):
    r = returns(s, d)
    return rounded(attribution.factor_attribution(r, _factors(r, meta(s, d)), ["market", "tilt"]))


@query(f"""WITH {_RETM}, {_FACTORS}, x AS (SELECT rt.series_id, rt.ret AS y, f.market AS m FROM rt JOIN f ON rt.ts = f.ts), b AS (SELECT series_id, covar_samp(y, m) / var_samp(m) AS beta FROM x GROUP BY series_id)
SELECT x.series_id, round(b.beta, 6) AS beta, round(b.beta * stddev_samp(m) * sqrt(252), 6) AS systematic, round(stddev_samp(y - b.beta * m) * sqrt(252), 6) AS idiosyncratic, round(stddev_samp(y) * sqrt(252), 6) AS total FROM x JOIN b ON x.series_id = b.series_id GROUP BY x.series_id, b.beta""")
def risk_attribution(s, d):
    r = returns(s, d)
    return rounded(attribution.risk_attribution(r, _factors(r, meta(s, d)).select("ts", "market")))


@query(f"""WITH {_RETM}, h AS (SELECT rt.ts, coalesce(meta.asset_class, 'other') AS asset_class, rt.ret, 1.0 / count(*) OVER (PARTITION BY rt.ts) AS b, (1 + rt.rn % 3) / CAST(sum(1 + rt.rn % 3) OVER (PARTITION BY rt.ts) AS DOUBLE) AS w FROM rt LEFT JOIN meta ON rt.series_id = meta.series_id),
g AS (SELECT ts, asset_class, sum(w) AS w, sum(b) AS b, sum(w * ret) / sum(w) AS rw, sum(b * ret) / sum(b) AS rb FROM h GROUP BY ts, asset_class), q AS (SELECT *, sum(b * rb) OVER (PARTITION BY ts) AS whole FROM g)
SELECT asset_class, round(sum((w - b) * (rb - whole)), 6) AS allocation, round(sum(b * (rw - rb)), 6) AS selection, round(sum((w - b) * (rw - rb)), 6) AS interaction, round(sum((w - b) * (rb - whole)) + sum(b * (rw - rb)) + sum((w - b) * (rw - rb)), 6) AS total FROM q GROUP BY asset_class""")
def brinson_attribution(s, d):
    day = Window.partitionBy("ts")
    r = returns(s, d).withColumn("_t", 1 + F.row_number().over(o.series()) % 3).join(meta(s, d).select("series_id", "asset_class"), "series_id", "left")
    h = r.select("ts", F.coalesce("asset_class", F.lit("other")).alias("asset_class"), "ret", (F.col("_t") / F.sum("_t").over(day)).alias("weight"), (1 / F.count(F.lit(1)).over(day)).alias("bench_weight"))
    return rounded(attribution.brinson(h))


# baskets

_BASKET = ("a", "b", "c")
_BPANEL = panels.panel_sql(_BASKET)


def _members(s: SparkSession, d: str) -> DataFrame:
    """Three price series; weights by month on the first date of each, carry every fifth date."""
    p = panels.daily(s, d, _BASKET).withColumn("rn", F.row_number().over(o.series("panel_id")))
    first = F.coalesce(F.month("ts") != F.lag(F.month("ts")).over(o.series("panel_id")), F.lit(True))
    p = p.withColumn("_first", first)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("series_id"), F.col(c).alias("price"), F.when(F.col("_first"), 1.0 + (F.month("ts") + i) % 3).alias("weight"), F.when(F.col("rn") % 5 == 0, F.col(c) * 0.0002 * (i + 1)).otherwise(0.0).alias("carry")) for i, c in enumerate(_BASKET)]))
    return p.select(F.col("panel_id").alias("basket_id"), "ts", rows.alias("_r")).select("basket_id", "ts", "_r.*")


def _basket_sql() -> str:
    c = _BASKET
    weight = [f"(1.0::DOUBLE + (month(ts) + {i}) % 3)" for i in range(3)]
    total = " + ".join(weight)
    n = f"n AS (SELECT *, row_number() OVER (ORDER BY ts) AS rn, coalesce(month(ts) <> lag(month(ts)) OVER (ORDER BY ts), true) AS go FROM pn), m AS (SELECT *, {', '.join(f'{w} / ({total}) AS w{x}' for w, x in zip(weight, c, strict=True))}, {', '.join(f'CASE WHEN rn % 5 = 0 THEN {x} * 0.0002 * {i + 1} ELSE 0 END AS y{x}' for i, x in enumerate(c))} FROM n)"
    grown = " + ".join(f"f.h{x} * (m.{x} - f.{x} + m.y{x})" for x in c)
    new = ", ".join(f"CASE WHEN go THEN w{x} * v / {x} ELSE o{x} END AS h{x}" for x in c)
    spent = " + ".join(f"abs(w{x} * v / {x} - o{x}) * {x}" for x in c)
    outer = f"SELECT ts, rn, {', '.join(c)}, v - 0.001::DOUBLE * t AS value, t AS traded, {', '.join(f'h{x}' for x in c)} FROM (SELECT *, {new}, CASE WHEN go THEN {spent} ELSE 0 END AS t FROM ({{}}) q) q"
    base = outer.format(f"SELECT m.*, 1.0::DOUBLE AS v, {', '.join(f'0.0::DOUBLE AS o{x}' for x in c)} FROM m WHERE rn = 1")
    more = outer.format(f"SELECT m.*, f.value + {grown} AS v, {', '.join(f'f.h{x} AS o{x}' for x in c)} FROM f JOIN m ON m.rn = f.rn + 1")
    return f"WITH RECURSIVE {PX}, {_BPANEL}, {n}, f AS ({base} UNION ALL {more}) SELECT 'all' AS basket_id, ts, round(value, 6) AS value, round(traded, 6) AS traded, round(0.001 * traded, 6) AS cost FROM f"


@query(_basket_sql())
def basket_value(s, d):
    return rounded(baskets.basket_value(_members(s, d), 0.001))


def _contracts(s: SparkSession, d: str) -> DataFrame:
    """Two price series that take turns as front and back contract, by month."""
    p = panels.daily(s, d, ("a", "b"))
    odd = F.month("ts") % 2 == 1
    return p.select(F.col("panel_id").alias("series_id"), "ts", F.trunc("ts", "month").alias("period"), F.when(odd, F.col("a")).otherwise(F.col("b")).alias("front"), F.when(odd, F.col("b")).otherwise(F.col("a")).alias("back"))


@query(f"""WITH {PX}, {panels.panel_sql(("a", "b"))}, c AS (SELECT ts, CAST(date_trunc('month', ts) AS DATE) AS period, CASE WHEN month(ts) % 2 = 1 THEN a ELSE b END AS front, CASE WHEN month(ts) % 2 = 1 THEN b ELSE a END AS back FROM pn),
l AS (SELECT *, greatest(0, (5 - (row_number() OVER (PARTITION BY period ORDER BY ts DESC) - 1)) / 5) AS w FROM c), p AS (SELECT *, (1 - w) * front + w * back AS price, lag(w) OVER (ORDER BY ts) AS lw, lag(front) OVER (ORDER BY ts) AS lf, lag(back) OVER (ORDER BY ts) AS lb, lag(period) OVER (ORDER BY ts) AS lp FROM l),
r AS (SELECT *, coalesce(CASE WHEN lp = period THEN (1 - lw) * (front / lf - 1) + lw * (back / lb - 1) ELSE front / lb - 1 END, 0) AS r FROM p)
SELECT 'all' AS series_id, ts, period, front, back, round(w, 6) AS back_weight, round(price, 4) AS price, round(first_value(price) OVER (ORDER BY ts) * product(1 + r) OVER (ORDER BY ts), 4) AS continuous FROM r""".replace("front, back, round(w", "round(front, 4) AS front, round(back, 4) AS back, round(w"))
def proportional_roll(s, d):
    out = baskets.proportional_roll(_contracts(s, d))
    return rounded(out.select("series_id", "ts", "period", "front", "back", F.round("back_weight", 6).alias("back_weight"), "price", "continuous"), 4)


@query(f"""WITH {RET}, m AS (SELECT ts, avg(value) AS reference FROM rt GROUP BY ts), j AS (SELECT rt.series_id, rt.ts, rt.value, m.reference, coalesce(m.reference / lag(m.reference) OVER (PARTITION BY rt.series_id ORDER BY rt.ts) - 1, 0) AS r FROM rt JOIN m ON rt.ts = m.ts)
SELECT series_id, ts, round(value, 4) AS value, round(reference, 4) AS reference, round(first_value(value) OVER ({W}) * product(1 + r) OVER ({W}), 4) AS continuous FROM j""")
def reference_returns(s, d):
    r = returns(s, d).select("series_id", "ts", "value")
    return rounded(baskets.reference_returns(r, r.groupBy("ts").agg(F.avg("value").alias("reference"))), 4)


# trend strength, squeeze, levels


def _daily_bars(s: SparkSession, d: str) -> DataFrame:
    return flow(s, d).withColumnRenamed("value", "close")


@query(f"""WITH RECURSIVE {FLOW}, n AS (SELECT series_id, ts, row_number() OVER ({W}) AS rn, high - lag(high) OVER ({W}) AS up, lag(low) OVER ({W}) - low AS dn, greatest(high - low, abs(high - lag(value) OVER ({W})), abs(low - lag(value) OVER ({W}))) AS tr FROM fl),
m AS (SELECT series_id, ts, rn, tr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS q FROM n),
f AS (
  SELECT series_id, ts, rn, CAST(tr AS DOUBLE) AS a, CAST(p AS DOUBLE) AS b, CAST(q AS DOUBLE) AS c, coalesce(100 * abs(p - q) / nullif(p + q, 0), 0)::DOUBLE AS adx FROM m WHERE rn = 2
  UNION ALL
  SELECT series_id, ts, rn, a, b, c, adx + (coalesce(100 * abs(b / nullif(a, 0) - c / nullif(a, 0)) / nullif(b / nullif(a, 0) + c / nullif(a, 0), 0), 0) - adx) / 14 FROM (
    SELECT m.series_id, m.ts, m.rn, f.a + (m.tr - f.a) / 14 AS a, f.b + (m.p - f.b) / 14 AS b, f.c + (m.q - f.c) / 14 AS c, f.adx FROM f JOIN m ON m.series_id = f.series_id AND m.rn = f.rn + 1) q
)
SELECT n.series_id, n.ts, round(100 * f.b / nullif(f.a, 0), 4) AS plus_di, round(100 * f.c / nullif(f.a, 0), 4) AS minus_di, round(f.adx, 4) AS adx FROM n LEFT JOIN f ON n.series_id = f.series_id AND n.rn = f.rn""")
def adx(s, d):
    return rounded(features.directional(_daily_bars(s, d)).select("series_id", "ts", "plus_di", "minus_di", "adx"), 4)


@query(f"""WITH {FLOW}, b AS (SELECT series_id, ts, CASE WHEN count(value) OVER f >= 20 THEN 4 * stddev_samp(value) OVER f / avg(value) OVER f END AS bw FROM fl WINDOW f AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
q AS (SELECT *, CASE WHEN count(bw) OVER g >= 10 THEN quantile_cont(bw, 0.2) OVER g END AS q FROM b WINDOW g AS ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT series_id, ts, round(bw, 6) AS band_width, coalesce(CAST(bw < q - 1e-12 AS INTEGER), 0) AS squeeze FROM q""")
def squeeze(s, d):
    return rounded(features.squeeze(_daily_bars(s, d)).select("series_id", "ts", "band_width", "squeeze"))


_PIVOTS = f"""{FLOW}, w AS (SELECT series_id, ts, high, low, lead(ts, 5) OVER ({W}) AS known, max(high) OVER b AS hb, max(high) OVER a AS ha, min(low) OVER b AS lb, min(low) OVER a AS la, count(*) OVER b AS nb, count(*) OVER a AS na FROM fl WINDOW b AS ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), a AS ({W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
p AS (SELECT series_id, ts, known, 'resistance' AS kind, high AS level FROM w WHERE nb = 5 AND na = 5 AND high > greatest(hb, ha) UNION ALL SELECT series_id, ts, known, 'support', low FROM w WHERE nb = 5 AND na = 5 AND low < least(lb, la))"""


@query(f"""WITH {_PIVOTS}, c AS (SELECT *, coalesce(level > lag(level) OVER g * 1.002, true) AS new FROM p WINDOW g AS (PARTITION BY series_id, kind ORDER BY level, ts)), k AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY series_id, kind ORDER BY level, ts) AS c FROM c)
SELECT series_id, kind, round(avg(level), 4) AS level, count(*) AS touches, min(known) AS first_known, max(known) AS last_known FROM k GROUP BY series_id, kind, c""")
def support_resistance(s, d):
    return rounded(features.levels(features.pivots(_daily_bars(s, d)), 0.002), 4)


# intraday requests


@query("""WITH b AS (SELECT min(ts) + INTERVAL 5 DAY AS lo, max(ts) - INTERVAL 5 DAY AS hi FROM events),
e AS (SELECT event_type AS ticker, date_trunc('hour', ts) AS hour, ts, event_id, value FROM events, b WHERE ts >= lo AND ts < hi)
SELECT ticker, hour, round(arg_min(value, (ts, event_id)), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(arg_max(value, (ts, event_id)), 6) AS close, count(*) AS n FROM e GROUP BY ticker, hour""")
def intraday_bars(s, d):
    """Hourly bars of all tickers, less five days at either end, from requests that the bounds on ts narrow."""
    e = table(s, d, "events")
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    if lo is None:
        return s.createDataFrame([], "ticker string, hour timestamp_ntz, open double, high double, low double, close double, n long")
    tickers = [r[0] for r in e.select("event_type").distinct().collect()]  # a handful
    path = f"{d.rstrip('/')}/events.parquet"
    t = intraday.intraday(s, tickers, lo, hi + dt.timedelta(microseconds=1), "strandline.sources.intraday:table_provider", path=path)
    days = dt.timedelta(days=5)
    t = t.where((F.col("ts") >= F.lit(lo + days).cast("timestamp_ntz")) & (F.col("ts") < F.lit(hi - days).cast("timestamp_ntz")))
    at = F.struct("ts", "number")
    g = t.groupBy("ticker", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
    return rounded(g.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("n")))


# long series, by slices


@query(core.BOOK.sql["ewma"])
def ewma_sliced(s, d):
    return rounded(o.ewma_sliced(px(s, d), [("value", "ewma_12", 12)], slices=16).select("series_id", "ts", "ewma_12"), 4)


@query(trading.BOOK.sql["hold_greedy"])
def hold_sliced(s, d):
    p = px(s, d).withColumn("sig", F.coalesce((o.pct_change("value", 1, o.series()) > 0.1).cast("int"), F.lit(0)))
    return signals.hold_sliced(p, "sig", 7, slices=16).select("series_id", "ts", "sig", "held")


# reports


_TOLD = ", ".join(f"{{'section': '{section}', 'metric': '{m}', 'value': CAST({m} AS DOUBLE)}}" for section, ms in validation.SECTIONS.items() for m in ms)
_REPORT = f"""WITH {judging.JUDGED}, dq AS ({panels.BOOK.sql['data_quality']}), cv AS ({panels.SCORES}), ov AS ({panels.BOOK.sql['overfitting_by_series']}), oc AS ({judging.BOOK.sql['overlap_count']}),
j AS (SELECT pr.*, mean_uniqueness, low_weight, high_weight, pairs AS n_overlaps, w.* EXCLUDE (series_id), coalesce(CASE WHEN cv_mean <> 0 THEN cv_std / abs(cv_mean) END, CASE WHEN mean_sharpe <> 0 THEN std_sharpe / abs(mean_sharpe) END, 0) AS cv_ratio, n_scores, cv_mean, cv_std, n_returns, pbo, n_rows, missing_share, n_constant, minority_share
  FROM pr JOIN un ON pr.series_id = un.series_id JOIN ln ON pr.series_id = ln.series_id LEFT JOIN w ON pr.series_id = w.series_id LEFT JOIN dq ON pr.series_id = dq.series_id LEFT JOIN cv ON pr.series_id = cv.series_id LEFT JOIN ov ON pr.series_id = ov.series_id LEFT JOIN oc ON pr.series_id = oc.series_id),
r AS (SELECT series_id, min_backtest AS least_rows, unnest([{_TOLD}], recursive := true) FROM j)
SELECT series_id, section, metric, round(value, 6) AS value, CASE WHEN value IS NULL THEN NULL WHEN metric = 'pbo' THEN CASE WHEN value > 0.7 THEN 'FAIL' WHEN value > 0.3 THEN 'WARNING' ELSE 'PASS' END WHEN metric = 'dsr' THEN CASE WHEN value < 0.8 THEN 'FAIL' WHEN value < 0.95 THEN 'WARNING' ELSE 'PASS' END
WHEN metric = 'cv_ratio' THEN CASE WHEN value > 0.2 THEN 'WARNING' ELSE 'PASS' END WHEN metric = 'missing_share' THEN CASE WHEN value > 0.2 THEN 'FAIL' WHEN value > 0.05 THEN 'WARNING' ELSE 'PASS' END WHEN metric = 'n_constant' THEN CASE WHEN value > 0 THEN 'WARNING' ELSE 'PASS' END
WHEN metric = 'minority_share' THEN CASE WHEN value < 0.02 THEN 'FAIL' WHEN value < 0.1 THEN 'WARNING' ELSE 'PASS' END WHEN metric = 'n_returns' THEN CASE WHEN value < least_rows THEN 'WARNING' ELSE 'PASS' END END AS verdict FROM r"""


@query(_REPORT)
def validation_report(s, d):
    """All sections of a backtest's validation, with the data, the folds' scores and the configurations tried."""
    return rounded(validation.report(trading._bt(s, d), panels.training_table(s, d), panels.TRAINING, runs=panels.tried(s, d), scores=panels.scores(s, d)))


def _text_sql(title: str, sections: dict[str, tuple[str, tuple[str, ...]]]) -> str:
    """SQL of sinks.full_report: sections are (query, columns), ordered by the first column."""
    lines, parts = [f"SELECT 0 AS section, i AS n, x AS text FROM (VALUES (0, '{title}'), (1, '{'#' * len(title)}'), (2, '')) h(i, x)"], []
    for k, (name, (sql, columns)) in enumerate(sections.items(), 1):
        head = name.replace("_", " ").capitalize()
        cell = lambda c: f"coalesce(CASE WHEN typeof({c}) = 'DOUBLE' THEN printf('%.4f', TRY_CAST({c} AS DOUBLE)) WHEN typeof({c}) = 'BOOLEAN' THEN CASE CAST({c} AS VARCHAR) WHEN 'true' THEN 'True' WHEN 'false' THEN 'False' END ELSE CAST({c} AS VARCHAR) END, '')"
        row = lambda of, k=k, columns=columns: "rtrim(" + " || '  ' || ".join(f"rpad({of(c)}, CAST(w_{c} AS INTEGER), ' ')" for c in columns) + ")"
        parts += [f"t{k} AS (SELECT {', '.join(f'{cell(c)} AS {c}' for c in columns)}, row_number() OVER (ORDER BY {columns[0]}) AS _k FROM ({sql}) q)", f"w{k} AS (SELECT {', '.join(f'greatest({len(c)}, coalesce(max(length({c})), 0)) AS w_{c}' for c in columns)} FROM t{k})"]
        lines.append(f"SELECT {k}, i, x FROM (VALUES (-3, '{head}'), (-2, '{'=' * len(head)}')) h(i, x) UNION ALL SELECT {k}, -1, {row(lambda c: repr(c))} FROM w{k} UNION ALL SELECT {k}, _k, {row(lambda c: c)} FROM t{k}, w{k}")
        if k < len(sections):
            lines.append(f"SELECT {k}, 9223372036854775807, ''")
    return f"WITH {', '.join(parts)}, l AS ({' UNION ALL '.join(lines)}) SELECT CAST(row_number() OVER (ORDER BY section, n) - 1 AS INTEGER) AS line, text FROM l"


_SECTIONS = {
    "performance": (judging.BOOK.sql["perf_metrics"], ("series_id", "n", "total_return", "sharpe", "max_drawdown", "calmar")),
    "worst_and_best_years": (f"WITH {RET}, y AS (SELECT series_id, year(ts) AS year, product(1 + ret) - 1 AS r FROM rt GROUP BY ALL) SELECT series_id, min(r) AS worst, max(r) AS best, avg(r) AS mean FROM y GROUP BY series_id", ("series_id", "worst", "best", "mean")),
    "validation": (judging.BOOK.sql["validate_backtest"], ("series_id", "dsr", "n_folds", "mean_sharpe", "long_enough", "status")),
}


@query(_text_sql("Run of the Monday momentum", _SECTIONS))
def full_report(s, d):
    """The text report of a run, a row per line, from tables of a row per series."""
    year = metrics.yearly(returns(s, d)).groupBy("series_id").agg(*[f("year_return").alias(n) for f, n in ((F.min, "worst"), (F.max, "best"), (F.avg, "mean"))])
    tables = {"performance": judging.perf_metrics(s, d), "worst_and_best_years": year, "validation": judging.validate_backtest(s, d)}
    text = sinks.full_report("Run of the Monday momentum", **{k: df.select(*_SECTIONS[k][1]).orderBy("series_id") for k, df in tables.items()})
    return s.createDataFrame(list(enumerate(text.splitlines())), "line int, text string")


# risk, sizes, sentiment


@query(f"""WITH {RET}, pv AS (SELECT series_id, count(ret) AS n, (-0.002 - avg(ret) * 20) / (stddev_samp(ret) * sqrt(20.0)) AS z FROM rt GROUP BY series_id),
t AS (SELECT series_id, sum(exp((2 * i + 1) * ln(greatest(abs(z), 1e-9)) - (i + 1) * ln(2.0) - lgamma(i + 1.5) + ln(pi()) / 2)) AS t FROM pv CROSS JOIN (SELECT unnest(range(150)) AS i) r WHERE abs(z) <= 8 GROUP BY series_id)
SELECT pv.series_id, n, round(z, 6) AS z, round(CASE WHEN z > 8 THEN 1 WHEN z < -8 THEN 0 ELSE 0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * t END, 6) AS probability FROM pv LEFT JOIN t ON pv.series_id = t.series_id""")
def loss_probability(s, d):
    """Chance of losing 0.2 % in 20 rows."""
    return rounded(metrics.loss_probability(returns(s, d), -0.002, 20))


@query(f"""WITH {RET}, {trading.BT}, x AS (SELECT bt.series_id, bt.ts, position - lag(position, 1, 0) OVER (PARTITION BY bt.series_id ORDER BY bt.ts) AS side, rt.value AS decision, lead(rt.value) OVER (PARTITION BY bt.series_id ORDER BY bt.ts) AS execution FROM bt JOIN rt ON bt.series_id = rt.series_id AND bt.ts = rt.ts),
f AS (SELECT series_id, side * (execution - decision) / decision AS c FROM x WHERE side <> 0 AND execution IS NOT NULL)
SELECT series_id, count(c) AS n, round(avg(c), 6) AS mean, round(max(c), 6) AS worst, round(sum(c), 6) AS total, round(avg(CAST(c > 0 AS DOUBLE)), 6) AS share_adverse FROM f GROUP BY series_id""")
def implementation_shortfall(s, d):
    """What acting a row late costs the Monday momentum."""
    return rounded(metrics.shortfall_summary(metrics.shortfall(portfolio.decisions(trading._bt(s, d)))))


@query(f"""WITH {RET}, k AS (SELECT series_id, ts, count(ret) OVER w AS n, avg(CAST(ret > 0 AS DOUBLE)) OVER w AS p, avg(CASE WHEN ret > 0 THEN ret END) OVER w AS a, abs(avg(CASE WHEN ret <= 0 THEN ret END) OVER w) AS b FROM rt WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT series_id, ts, round(CASE WHEN n >= 60 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN a IS NULL THEN 0 WHEN b IS NULL OR b = 0 THEN 1 ELSE 0.5 * (p * a / b - (1 - p)) / (a / b) END)) END, 6) AS kelly FROM k""")
def kelly_sizes(s, d):
    return rounded(portfolio.kelly_sizes(returns(s, d)).select("series_id", "ts", "kelly"))


@query(f"""WITH {RET}, {trading.BT.replace("THEN 1 - 0.001 ELSE", "THEN (1 - 0.001) * (1 - 0.002) ELSE")} SELECT series_id, ts, round(equity, 6) AS equity, round(ret, 6) AS ret FROM bt""")
def slippage_backtest(s, d):
    """The Monday momentum with a fee and slippage on each side."""
    sig = signals.cross_momentum(px(s, d)).select("series_id", "ts", "entry", "exit")
    bt = portfolio.backtest(returns(s, d).select("series_id", "ts", "value").join(sig, ["series_id", "ts"]), fee=0.001, slippage=0.002)
    return rounded(bt.select("series_id", "ts", "equity", "ret"))


@query(f"WITH {RET} SELECT series_id, ts, 1 AS position, round(100 * 0.999 * value / first_value(value) OVER ({W}), 6) AS equity FROM rt")
def buy_and_hold(s, d):
    return rounded(portfolio.buy_and_hold(returns(s, d).select("series_id", "ts", "value"), fee=0.001).select("series_id", "ts", "position", "equity"))


@query(f"""WITH {RET}, g AS (SELECT series_id, avg(ret) FILTER (ts < DATE '1998-01-01') / stddev_samp(ret) FILTER (ts < DATE '1998-01-01') * sqrt(252.0) AS a, avg(ret) FILTER (ts >= DATE '1998-01-01') / stddev_samp(ret) FILTER (ts >= DATE '1998-01-01') * sqrt(252.0) AS b, count(ret) FILTER (ts < DATE '1998-01-01') AS n FROM rt GROUP BY series_id)
SELECT series_id, round(a, 5) AS sharpe_is, round(b, 5) AS sharpe_oos, round(n / 12.0::DOUBLE, 5) AS samples_per_feature, round(1 - b / a, 5) AS degradation FROM g""")
def degradation(s, d):
    return rounded(metrics.degradation(returns(s, d), "1998-01-01", 12), 5)


@query(f"WITH {PX} SELECT series_id, ts, round(coalesce(value / lag(value, 5) OVER ({W}) - 1, 0), 6) AS value_mom_5, round(coalesce(value / lag(value, 20) OVER ({W}) - 1, 0), 6) AS value_mom_20, 0.0::DOUBLE AS vix_mom_5, round(value, 4) AS surprise, 0.5::DOUBLE AS absent FROM px")
def optional_features(s, d):
    """Momenta and surprises of columns that are there and of columns that aren't."""
    f = features.optional_momentum(features.optional_momentum(px(s, d), "value", [5, 20]), "vix", [5])
    f = features.optional(features.optional(f, "value", "surprise"), "growth", "absent", 0.5)
    return rounded(f.withColumn("surprise", F.round("surprise", 4)).drop("value"))


_LEXICON = (("worthless", -0.8, 0.9), ("stupid", -0.8, 1.0), ("idiot", -0.8, 0.8), ("hate", -0.8, 0.9), ("by", 0.1, 0.2), ("the", 0.2, 0.3), ("this", 0.5, 0.5), ("that", -0.4, 0.1))


@query(f"""WITH l AS (SELECT * FROM (VALUES {', '.join(f"('{w}', {p}::DOUBLE, {q}::DOUBLE)" for w, p, q in _LEXICON)}) v(word, polarity, subjectivity)),
x AS (SELECT doc_id, ts, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS ws FROM documents JOIN events ON doc_id = event_id), t AS (SELECT doc_id, ts, i, ws[i] AS word, CASE WHEN i > 1 THEN ws[i - 1] ELSE '' END AS before FROM (SELECT *, unnest(range(1, greatest(len(ws), 1) + 1)) AS i FROM x) q),
p AS (SELECT t.doc_id, t.ts, coalesce(avg(CASE WHEN before IN ('not', 'no', 'and', 'without') THEN -0.5::DOUBLE ELSE 1 END * polarity), 0) AS polarity, coalesce(avg(subjectivity), 0) AS subjectivity FROM t LEFT JOIN l ON t.word = l.word GROUP BY t.doc_id, t.ts)
SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(avg(polarity), 6) AS mean, round(stddev_samp(polarity), 6) AS std, round(min(polarity), 6) AS low, round(max(polarity), 6) AS high, round(avg(subjectivity), 6) AS subjectivity FROM p GROUP BY 1""")
def daily_sentiment(s, d):
    """Documents as the news of the event of their number."""
    news = table(s, d, "documents").join(table(s, d, "events").select(F.col("event_id").alias("doc_id"), "ts"), "doc_id")
    lexicon = s.createDataFrame(_LEXICON, "word string, polarity double, subjectivity double")
    return rounded(research.daily_sentiment(research.sentiment(news, lexicon, ["doc_id", "ts"], negators=("not", "no", "and", "without"))))
