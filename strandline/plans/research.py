"""Queries of portfolio construction, importance, unit roots and tails."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import ordered as o
from ..operators import align, features, learn, research, signals
from .views import PX, RET, Book, W, px, returns, rounded, table

BOOK = Book()
query = BOOK.add
NAMES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]


def _weights(s, names, w):
    return s.createDataFrame([(n, round(float(x), 8)) for n, x in zip(names, w, strict=True)], "series_id string, weight double")


@query()
def hrp_weights(s, d):
    return _weights(s, NAMES, research.risk_parity(research.covariance(returns(s, d), NAMES)))


@query()
def mean_variance_weights(s, d):
    r = returns(s, d)
    mean = {x.series_id: x.m for x in r.groupBy("series_id").agg(F.avg("ret").alias("m")).collect()}
    return _weights(s, NAMES, research.mean_variance(np.array([mean[n] for n in NAMES]), research.covariance(r, NAMES)))


@query()
def pca_weights(s, d):
    return _weights(s, NAMES, research.pca_weights(research.covariance(returns(s, d), NAMES)))


@query(f"""WITH {PX}, f AS (SELECT series_id, ts, value / lag(value, 5) OVER ({W}) - 1 AS m, lead(value, 5) OVER ({W}) / value - 1 AS f FROM px), k AS (SELECT * FROM f WHERE m IS NOT NULL AND f IS NOT NULL),
r AS (SELECT ts, rank() OVER (PARTITION BY ts ORDER BY m) + (count(*) OVER (PARTITION BY ts, m) - 1) / 2 AS a, rank() OVER (PARTITION BY ts ORDER BY f) + (count(*) OVER (PARTITION BY ts, f) - 1) / 2 AS b FROM k)
SELECT ts, count(*) AS n, round(CASE WHEN count(*) > 1 THEN corr(a, b) END, 6) AS ic FROM r GROUP BY ts""")
def information_coefficient(s, d):
    return rounded(research.information_coefficient(features.momentum(px(s, d), [5]), "mom_5", 5))


@query(f"""WITH {RET}, l AS (SELECT series_id, ln(lag(value) OVER ({W})) AS x, ln(value) - ln(lag(value) OVER ({W})) AS y FROM rt), g AS (SELECT series_id, count(*) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy FROM l WHERE x IS NOT NULL GROUP BY series_id)
SELECT series_id, n, round(b, 6) AS slope, round(b / sqrt((syy - b * b * sxx) / (n - 2) / sxx), 5) AS t_stat FROM g""")
def unit_root(s, d):
    u = research.unit_root(returns(s, d))
    return u.select("series_id", "n", (F.round("slope", 6) + 0.0).alias("slope"), (F.round("t_stat", 5) + 0.0).alias("t_stat"))


@query()
def explosiveness(s, d):
    return research.explosiveness(returns(s, d))


@query(f"""WITH {RET}, p AS (SELECT x.series_id AS a, y.series_id AS b, x.ret AS va, y.ret AS vb FROM rt x JOIN rt y ON x.ts = y.ts WHERE x.series_id < y.series_id), q AS (SELECT a, b, quantile_cont(va, 0.1) AS qa, quantile_cont(vb, 0.1) AS qb FROM p GROUP BY a, b)
SELECT p.a, p.b, count(*) AS n, round(avg(CAST(va <= qa AND vb <= qb AS INTEGER)) / 0.1, 6) AS lower_tail FROM p JOIN q ON p.a = q.a AND p.b = q.b GROUP BY p.a, p.b""")
def tail_dependence(s, d):
    return rounded(research.tail_dependence(align.pairs(returns(s, d).drop("value").withColumnRenamed("ret", "value"))))


@query(f"""WITH {RET}, m AS (SELECT ts, avg(ret) AS m FROM rt GROUP BY ts), b AS (SELECT series_id, regr_slope(ret, m) AS beta FROM rt JOIN m ON rt.ts = m.ts GROUP BY series_id)
SELECT series_id, round(beta, 6) AS beta, CAST(k.shock AS DOUBLE) AS shock, round(beta * k.shock, 6) AS loss FROM b CROSS JOIN (VALUES (-0.05::DOUBLE), (-0.1::DOUBLE), (-0.2::DOUBLE)) k(shock)""")
def stress(s, d):
    return rounded(research.stress(returns(s, d)))


@query(f"""WITH {RET}, k AS (SELECT *, max(value) OVER ({W}) AS peak FROM rt), u AS (SELECT *, value < peak AS under, max(ts) OVER (PARTITION BY series_id) AS last FROM k), g AS (SELECT *, sum(CASE WHEN under THEN 0 ELSE 1 END) OVER ({W}) AS spell FROM u)
SELECT series_id, min(ts) AS start, max(ts) AS "end", count(*) AS rows_under, round(min(value / peak - 1), 6) AS depth, CASE WHEN max(ts) = max(last) THEN 'open' ELSE 'recovered' END AS status FROM g WHERE under GROUP BY series_id, spell""")
def drawdown_spells(s, d):
    return rounded(research.drawdown_spells(returns(s, d)))


@query(f"""WITH {RET}, l AS (SELECT *, lag(ret) OVER ({W}) AS l FROM rt), g AS (SELECT series_id, avg(ret) AS m, stddev_samp(ret) AS sd, stddev_samp(CASE WHEN ret < 0 THEN ret END) AS dn, abs(corr(ret, l)) AS rho, count(ret) AS n FROM l GROUP BY series_id),
p AS (SELECT *, sqrt(1 + 2 * (rho / (1 - rho) - rho * (1 - pow(rho, n)) / (n * pow(1 - rho, 2)))) AS pen FROM g)
SELECT series_id, round(m / sd * sqrt(252.0) / pen, 5) AS smart_sharpe, round(m / dn * sqrt(252.0) / pen, 5) AS smart_sortino, round(m / dn * sqrt(252.0) / sqrt(2.0), 5) AS sortino_sqrt2 FROM p""")
def smart_ratios(s, d):
    return rounded(research.smart_ratios(returns(s, d)), 5)


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (contains(lower(event_type), 'click')) AS n_click, count(*) FILTER (contains(lower(event_type), 'view')) AS n_view FROM events GROUP BY 1")
def daily_mentions(s, d):
    return research.daily_mentions(table(s, d, "events"), ["click", "view"], text="event_type")


@query()
def permuted_importance(s, d):
    names = ["mom_5", "vol_20", "z_20"]
    x = signals.labels(features.feature_set(returns(s, d).select("series_id", "ts", "value")), 5).select("series_id", "ts", "label", *names)
    x = learn.split(x)
    fitted = learn.model("logit", names, n_train=5000).fit(x.where("part = 'train'"))
    return research.permuted_importance(fitted, x.where("part = 'test'"), names)


@query(f"""WITH {RET}, r AS (SELECT series_id, CAST(year(ts) AS BIGINT) AS run_id, round(product(1 + ret) - 1, 9) AS total_return, round(min(ret), 9) AS max_drawdown FROM rt GROUP BY series_id, year(ts))
SELECT series_id, run_id, round(total_return, 6) AS total_return, round(max_drawdown, 6) AS max_drawdown FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE a.series_id = b.series_id AND b.total_return >= a.total_return AND b.max_drawdown >= a.max_drawdown AND (b.total_return > a.total_return OR b.max_drawdown > a.max_drawdown))""")
def pareto_front(s, d):
    r = returns(s, d).groupBy("series_id", F.year("ts").cast("long").alias("run_id")).agg(F.round(F.product(1 + F.col("ret")) - 1, 9).alias("total_return"), F.round(F.min("ret"), 9).alias("max_drawdown"))
    return rounded(research.pareto(r))


def _featured(s, d):
    names = ["mom_5", "mom_20", "vol_20", "z_20"]
    return features.feature_set(returns(s, d).select("series_id", "ts", "value")).select("series_id", "ts", "value", *names), names


@query()
def boosting_ensemble(s, d):
    f, names = _featured(s, d)
    p = learn.horizon_ensemble(f, names, (1, 5), "boosting", maxIter=3, maxDepth=3)
    return signals.edges(p.withColumn("_pos", F.col("p") > 0.5)).select("series_id", "ts", "p", "position", "entry", "exit")


@query()
def forest_ensemble(s, d):
    f, names = _featured(s, d)
    shapes = [(0.30, {"numTrees": 8, "maxDepth": 4}), (0.30, {"numTrees": 8, "maxDepth": 5}), (0.25, {"numTrees": 6, "maxDepth": 3}), (0.15, {"numTrees": 6, "maxDepth": 6})]
    p = learn.forest_ensemble(f, names, 7, shapes)
    held = signals.hold_greedy(p.select("series_id", "ts", "value", "p", (F.col("p") >= 0.55).cast("int").alias("raw")), "raw", 7)
    return signals.edges(held.withColumn("_pos", F.col("held") == 1)).select("series_id", "ts", "p", "position", "entry", "exit")


@query()
def expanding_retrain(s, d):
    f, names = _featured(s, d)
    return learn.expanding_retrain(signals.labels(f, 5), names, 3, n_train=3000).select("series_id", "ts", "period", "p")


@query(f"""WITH {RET}, m AS (SELECT series_id, value / lag(value, 5) OVER ({W}) - 1 AS m5, value / lag(value, 20) OVER ({W}) - 1 AS m20, ret FROM rt)
SELECT series_id, a, b, round(c, 6) AS corr FROM (SELECT series_id, 'mom_20' AS a, 'mom_20' AS b, corr(m20, m20) AS c FROM m GROUP BY series_id UNION ALL SELECT series_id, 'mom_20', 'ret', corr(m20, ret) FROM m GROUP BY series_id UNION ALL SELECT series_id, 'ret', 'ret', corr(ret, ret) FROM m GROUP BY series_id
UNION ALL SELECT series_id, 'mom_5', 'mom_5', corr(m5, m5) FROM m GROUP BY series_id UNION ALL SELECT series_id, 'mom_5', 'mom_20', corr(m5, m20) FROM m GROUP BY series_id UNION ALL SELECT series_id, 'mom_5', 'ret', corr(m5, ret) FROM m GROUP BY series_id) q""")
def correlation_matrix(s, d):
    return rounded(learn.correlation_matrix(features.momentum(returns(s, d), [5, 20]), ["mom_5", "mom_20", "ret"]))


@query(f"""WITH {PX}, b AS (SELECT series_id, CAST(ts + CAST(((5 - isodow(ts) + 7) % 7) AS INTEGER) AS DATE) AS p, arg_max(value, ts) AS v FROM px GROUP BY ALL), m AS (SELECT series_id, min(p) AS lo, max(p) AS hi FROM b GROUP BY series_id),
g AS (SELECT series_id, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS ts FROM m),
w AS (SELECT g.series_id, g.ts, last_value(b.v IGNORE NULLS) OVER (PARTITION BY g.series_id ORDER BY g.ts) AS value FROM g LEFT JOIN b ON g.series_id = b.series_id AND g.ts = b.p)
SELECT series_id, ts, round(value / lag(value, 4) OVER ({W}) - 1, 6) AS mom_4, round(CASE WHEN count(value) OVER f >= 12 THEN (value - avg(value) OVER f) / stddev_samp(value) OVER f END, 6) AS z_12,
coalesce(CAST(value > CASE WHEN count(value) OVER f >= 12 THEN quantile_cont(value, 0.75) OVER f END AS INTEGER), 0) AS above_q75 FROM w WINDOW f AS ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def weekly_features(s, d):
    w = align.resample(px(s, d), "W", "last")
    x = features.zscores(features.momentum(w, [4]), [12]).withColumn("above_q75", F.coalesce((F.col("value") > o.rolling_quantile("value", 0.75, 12, o.series())).cast("int"), F.lit(0)))
    return rounded(x.select("series_id", "ts", "mom_4", "z_12", "above_q75"))


@query()
def text_report(s, d):
    from ..operators import metrics
    from ..sources import sinks

    m = metrics.performance(returns(s, d)).select("series_id", "total_return", "sharpe", "max_drawdown").orderBy("series_id")
    return s.createDataFrame([(i, x) for i, x in enumerate(sinks.report("Performance", m).splitlines())], "line int, text string")
