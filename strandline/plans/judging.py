"""Queries of metrics, validation, learning, bars, sources and streams."""

from __future__ import annotations

import math
import uuid
from statistics import NormalDist

from pyspark.sql import functions as F

from ..functions import ordered as o
from ..operators import bars, features, learn, metrics, signals, validation
from ..streaming import events as stream
from .trading import BT, _bt, wf_parts
from ..session import shared_dir
from .views import FLOW, PX, RET, TICKS, Book, W, flow, px, returns, rolled, rounded, table, ticks

BOOK = Book()
query = BOOK.add
UNB = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

# metrics


@query(f"""WITH {RET}, e AS (SELECT *, product(1 + ret) OVER ({W}) AS eq FROM rt), k AS (SELECT *, eq / max(eq) OVER ({W}) - 1 AS dd FROM e),
g AS (SELECT series_id, count(ret) AS n, product(1 + ret) - 1 AS tr, avg(ret) AS m, stddev_samp(ret) AS sd, stddev_samp(CASE WHEN ret < 0 THEN ret END) AS dn, min(dd) AS dd, skewness(ret) AS sk, kurtosis(ret) AS ku FROM k GROUP BY series_id)
SELECT series_id, n, round(tr, 5) AS total_return, round(dd, 5) AS max_drawdown, round(sk, 5) AS skew, round(ku, 5) AS kurt, round(pow(1 + tr, 252.0 / n) - 1, 5) AS cagr, round(sd * sqrt(252.0), 5) AS volatility, round(m / sd * sqrt(252.0), 5) AS sharpe, round(m / dn * sqrt(252.0), 5) AS sortino, round((pow(1 + tr, 252.0 / n) - 1) / abs(dd), 5) AS calmar FROM g""")
def perf_metrics(s, d):
    return rounded(metrics.performance(returns(s, d)), 5)


@query(f"""WITH {RET}, g AS (SELECT series_id, sum(CASE WHEN ret > 0 THEN ret END) AS up, abs(sum(CASE WHEN ret <= 0 THEN ret END)) AS dn, avg(CASE WHEN ret > 0 THEN ret END) AS aw, abs(avg(CASE WHEN ret <= 0 THEN ret END)) AS al, avg(CAST(ret > 0 AS INTEGER)) AS wr, abs(quantile_cont(ret, 0.95) / quantile_cont(ret, 0.05)) AS tl FROM rt GROUP BY series_id)
SELECT series_id, round(wr, 6) AS win_rate, round(tl, 6) AS tail_ratio, round(up / dn, 6) AS profit_factor, round(aw / al, 6) AS payoff, round(greatest(0, wr - (1 - wr) / (aw / al)), 6) AS kelly, round(sqrt(tl * up / dn), 6) AS common_sense, round(up / dn * wr, 6) AS cpc FROM g""")
def tail_metrics(s, d):
    return rounded(metrics.tails(returns(s, d)))


@query(f"""WITH {RET}, j AS (SELECT a.series_id, a.ret, b.ret AS b, a.ret - b.ret AS e FROM rt a JOIN rt b ON a.ts = b.ts WHERE b.series_id = '1-URGENT' AND a.series_id <> '1-URGENT')
SELECT series_id, count(*) AS n, round(pow(corr(ret, b), 2), 6) AS r_squared, round(product(1 + ret) - product(1 + b), 5) AS outperformance, round(avg(e) / stddev_samp(e) * sqrt(252.0), 5) AS information_ratio, round(avg(ret) / stddev_samp(ret) * sqrt(252.0) - avg(b) / stddev_samp(b) * sqrt(252.0), 5) AS excess_sharpe FROM j GROUP BY series_id""")
def benchmark_compare(s, d):
    r = returns(s, d)
    out = metrics.against(r.where("series_id <> '1-URGENT'"), r.where("series_id = '1-URGENT'"))
    return out.select("series_id", "n", F.round("r_squared", 6).alias("r_squared"), *[F.round(c, 5).alias(c) for c in ("outperformance", "information_ratio", "excess_sharpe")])


@query(f"""WITH {RET}, v AS (SELECT series_id, quantile_cont(ret / 5, 0.05) AS v FROM rt GROUP BY series_id)
SELECT rt.series_id, round(max(v), 8) AS var, round(avg(CASE WHEN ret <= 5 * v THEN ret END) / 5, 8) AS cvar, round(avg(ret) / 5, 8) AS expected_day, round(avg(ret), 8) AS expected_week, round(avg(ret) * 4.33, 8) AS expected_month, round(avg(ret) * 252, 6) AS expected_year FROM rt JOIN v ON rt.series_id = v.series_id GROUP BY rt.series_id""")
def var_cvar(s, d):
    r = metrics.at_risk(returns(s, d))
    return rounded(r.drop("expected_year"), 8).join(rounded(r.select("series_id", "expected_year")), "series_id")


@query(f"""WITH {RET}, w AS (SELECT *, sum(CASE WHEN ret > 0 THEN 0 ELSE 1 END) OVER ({W}) AS gw, sum(CASE WHEN ret < 0 THEN 0 ELSE 1 END) OVER ({W}) AS gl FROM rt),
a AS (SELECT series_id, max(k) AS mw FROM (SELECT series_id, gw, count(*) FILTER (ret > 0) AS k FROM w GROUP BY series_id, gw) q GROUP BY series_id),
b AS (SELECT series_id, max(k) AS ml FROM (SELECT series_id, gl, count(*) FILTER (ret < 0) AS k FROM w GROUP BY series_id, gl) q GROUP BY series_id)
SELECT a.series_id, mw AS max_wins, ml AS max_losses FROM a JOIN b ON a.series_id = b.series_id""")
def win_loss_runs(s, d):
    return metrics.runs(returns(s, d))


@query(f"""WITH {RET}, e AS (SELECT *, product(1 + ret) OVER ({W}) AS eq FROM rt), k AS (SELECT *, eq < max(eq) OVER ({W}) AS u FROM e), g AS (SELECT *, sum(CASE WHEN u THEN 0 ELSE 1 END) OVER ({W}) AS r FROM k)
SELECT series_id, max(n) AS longest_drawdown FROM (SELECT series_id, r, count(*) FILTER (u) AS n FROM g GROUP BY series_id, r) q GROUP BY series_id""")
def longest_drawdown(s, d):
    return metrics.longest_drawdown(returns(s, d))


@query(f"""WITH {RET}, p AS (SELECT *, 'full' AS period FROM rt UNION ALL SELECT *, CASE WHEN ts < DATE '1998-01-01' THEN 'is' ELSE 'oos' END FROM rt)
SELECT series_id, period, count(*) AS n, round(product(1 + ret) - 1, 6) AS total_return, round(max(ret), 6) AS best, round(min(ret), 6) AS worst, round(avg(ret) / stddev_samp(ret) * sqrt(252.0), 6) AS sharpe, round(avg(CASE WHEN ret > 0 THEN ret END) / abs(avg(CASE WHEN ret < 0 THEN ret END)), 6) AS win_loss FROM p GROUP BY series_id, period""")
def oos_periods(s, d):
    return rounded(metrics.by_period(returns(s, d), "1998-01-01"))


@query(f"""WITH {RET}, g AS (SELECT series_id, count(ret) AS n, avg(ret) / stddev_samp(ret) * sqrt(252.0) AS sr, skewness(ret) AS sk, kurtosis(ret) + 3 AS ku FROM rt GROUP BY series_id)
SELECT series_id, n, round(sr, 5) AS sharpe, round(sk, 5) AS skew, round(ku, 5) AS kurtosis, round(sr * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - sk * sr + (ku - 1) / 4 * sr * sr)), 4) AS psr_z FROM g""")
def psr_inputs(s, d):
    p = metrics.sharpe_inputs(returns(s, d))
    return p.select("series_id", "n", *[F.round(c, 5).alias(c) for c in ("sharpe", "skew", "kurtosis")], F.round("psr_z", 4).alias("psr_z"))


#: Expected best ratio of ten trials, in deviations.
_BEST = (1 - 0.5772156649015329) * NormalDist().inv_cdf(1 - 1 / 10) + 0.5772156649015329 * NormalDist().inv_cdf(1 - 1 / (10 * math.e))


def probability_parts(source: str) -> str:
    """The common tables of the probabilistic ratios of a table of returns, the last of which, pr, has a row per series. The
    normal integral is its series of odd powers over double factorials, of which all terms have one sign."""
    return f"""pg AS (SELECT series_id, count(ret) AS n, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252.0) ELSE 0 END AS sr, skewness(ret) AS sk, kurtosis(ret) + 3 AS ku FROM {source} GROUP BY series_id),
pv AS (SELECT *, 1 - sk * sr + (ku - 1) / 4 * sr * sr AS v FROM pg),
pz AS (SELECT series_id, 'psr' AS k, sr * sqrt(n - 1) / sqrt(greatest(1e-12, v)) AS z FROM pv UNION ALL SELECT series_id, 'dsr', (sr - {_BEST!r} * sqrt((1 + v) / (n - 1))) * sqrt(n - 1) / sqrt(greatest(1e-12, v)) FROM pv),
pt AS (SELECT series_id, k, z, sum(exp((2 * i + 1) * ln(greatest(abs(z), 1e-9)) - (i + 1) * ln(2.0) - lgamma(i + 1.5) + ln(pi()) / 2)) AS t FROM pz CROSS JOIN (SELECT unnest(range(150)) AS i) r WHERE abs(z) <= 8 GROUP BY ALL),
pp AS (SELECT pz.series_id, pz.k, CASE WHEN pz.z > 8 THEN 1 WHEN pz.z < -8 THEN 0 ELSE 0.5 + sign(pz.z) * exp(-pz.z * pz.z / 2) / sqrt(2 * pi()) * t END AS p FROM pz LEFT JOIN pt ON pz.series_id = pt.series_id AND pz.k = pt.k),
pr AS (SELECT pv.series_id, max(p) FILTER (k = 'psr') AS psr, max(p) FILTER (k = 'dsr') AS dsr, CASE WHEN any_value(sr) = 0 THEN 'infinity'::DOUBLE ELSE ceil(greatest(any_value(n), (pow(1 / any_value(sr), 2) - 1) * any_value(n))) END AS min_backtest FROM pv JOIN pp ON pv.series_id = pp.series_id GROUP BY pv.series_id)"""


@query(f"WITH {RET}, {probability_parts('rt')} SELECT series_id, round(psr, 5) AS psr, round(dsr, 5) AS dsr, min_backtest FROM pr")
def sharpe_probabilities(s, d):
    p = metrics.sharpe_probabilities(returns(s, d))
    return p.select("series_id", F.round("psr", 5).alias("psr"), F.round("dsr", 5).alias("dsr"), "min_backtest")


@query(f"""WITH {RET}, y AS (SELECT series_id, CAST(year(ts) AS INTEGER) AS year, product(1 + ret) - 1 AS yr, count(*) AS n FROM rt GROUP BY ALL) SELECT series_id, year, round(yr, 6) AS year_return, n, round(product(1 + yr) OVER (PARTITION BY series_id ORDER BY year), 6) AS growth FROM y""")
def yearly_returns(s, d):
    return rounded(metrics.yearly(returns(s, d)))


@query(f"""WITH {RET}, v AS (SELECT *, {rolled('stddev_samp({})', 'ret', 20)} AS vol FROM rt), m AS (SELECT *, quantile_cont(vol, 0.5) OVER (PARTITION BY series_id) AS md FROM v WHERE vol IS NOT NULL)
SELECT series_id, CASE WHEN vol > md THEN 'high' ELSE 'low' END AS regime, count(*) AS n, round(avg(ret), 6) AS mean_ret, round(stddev_samp(ret), 6) AS std_ret, round(avg(CAST(ret > 0 AS INTEGER)), 6) AS win_rate FROM m GROUP BY 1, 2""")
def regimes(s, d):
    r = returns(s, d).withColumn("vol", o.full(F.stddev_samp, "ret", 20, o.series()))
    return rounded(metrics.regimes(r, "vol"))


@query(f"WITH {RET} SELECT series_id, count(ret) AS n, round(avg(ret) / (stddev_samp(ret) / sqrt(count(ret))), 6) AS t_stat, round(avg(ret) / stddev_samp(ret) * sqrt(count(ret)) / sqrt(1 + pow(avg(ret) / stddev_samp(ret), 2) / 2), 6) AS sharpe_z FROM rt GROUP BY series_id")
def significance(s, d):
    return rounded(metrics.t_test(returns(s, d)))


@query(f"""WITH {RET}, p AS (SELECT 'all' AS family, series_id AS test, round(least(1, abs(avg(ret)) * 100), 8) AS p FROM rt GROUP BY series_id), k AS (SELECT *, row_number() OVER (ORDER BY p, test) AS k, count(*) OVER () AS m FROM p)
SELECT family, test, round(p, 6) AS p, round(least(1, p * m), 6) AS bonferroni, round(least(1, max(p * (m - k + 1)) OVER (ORDER BY p, test)), 6) AS holm, round(least(1, min(p * m / k) OVER (ORDER BY p, test ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS fdr FROM k""")
def adjusted_p(s, d):
    p = returns(s, d).groupBy(F.col("series_id").alias("test")).agg(F.round(F.least(F.lit(1.0), F.abs(F.avg("ret")) * 100), 8).alias("p")).select(F.lit("all").alias("family"), "test", "p")
    return rounded(metrics.adjusted(p))


# validation

_N = f"nn AS (SELECT series_id, ts, row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM px)"


@query(f"""WITH {PX}, {_N}, f AS (SELECT nn.*, k.fold, n // 5 AS sz, CAST(floor(n * 0.01) AS BIGINT) AS emb FROM nn CROSS JOIN (SELECT CAST(unnest(range(5)) AS INTEGER) AS fold) k)
SELECT series_id, ts, fold, CASE WHEN rn >= fold * sz AND rn < (fold + 1) * sz THEN 'test' WHEN rn < fold * sz OR rn >= (fold + 1) * sz + emb THEN 'train' ELSE 'embargo' END AS role FROM f""")
def purged_folds(s, d):
    return validation.purged_folds(px(s, d))


_IVS = f"iv AS (SELECT series_id, ts, ts AS t0, coalesce(lead(ts, 7) OVER ({W}), max(ts) OVER (PARTITION BY series_id)) AS t1 FROM px)"


@query(f"""WITH {PX}, {_N}, {_IVS}, f AS (SELECT nn.*, k.fold, n // 5 AS sz, CAST(floor(n * 0.01) AS BIGINT) AS emb FROM nn CROSS JOIN (SELECT CAST(unnest(range(5)) AS INTEGER) AS fold) k),
r AS (SELECT f.series_id, f.ts, fold, t0, t1, CASE WHEN rn >= fold * sz AND rn < (fold + 1) * sz THEN 'test' WHEN rn < fold * sz OR rn >= (fold + 1) * sz + emb THEN 'train' ELSE 'embargo' END AS role FROM f JOIN iv ON f.series_id = iv.series_id AND f.ts = iv.ts),
b AS (SELECT series_id, fold, min(t0) AS lo, max(t1) AS hi FROM r WHERE role = 'test' GROUP BY series_id, fold)
SELECT r.series_id, r.fold, CASE WHEN role = 'train' AND t0 <= hi AND lo <= t1 THEN 'purged' ELSE role END AS role, count(*) AS n FROM r JOIN b ON r.series_id = b.series_id AND r.fold = b.fold GROUP BY 1, 2, 3""")
def purge(s, d):
    p = px(s, d)
    return validation.purge(validation.intervals(p, 7), validation.purged_folds(p)).groupBy("series_id", "fold", "role").agg(F.count(F.lit(1)).alias("n"))


_COMBOS = "c AS (SELECT row_number() OVER (ORDER BY a.g, b.g) - 1 AS split, a.g AS g1, b.g AS g2 FROM (SELECT unnest(range(5)) AS g) a CROSS JOIN (SELECT unnest(range(5)) AS g) b WHERE a.g < b.g)"


def _cpcv(train: str) -> str:
    return f"""WITH {PX}, {_N}, {_COMBOS}, x AS (SELECT nn.series_id, c.split, rn, n, least(rn // (n // 5), 4) AS g, g1, g2, CASE WHEN g1 = 4 THEN n ELSE (g1 + 1) * (n // 5) END AS e1, CASE WHEN g2 = 4 THEN n ELSE (g2 + 1) * (n // 5) END AS e2, CAST(floor(n * 0.01) AS BIGINT) AS emb FROM nn CROSS JOIN c)
SELECT series_id, CAST(split AS INTEGER) AS split, count(*) FILTER (g NOT IN (g1, g2) AND {train}) AS n_train, count(*) FILTER (g IN (g1, g2)) AS n_test FROM x GROUP BY series_id, split"""


@query(_cpcv("NOT (rn >= e1 AND rn < e1 + emb) AND NOT (rn >= e2 AND rn < e2 + emb)"))
def cpcv_folds(s, d):
    return validation.combinatorial_folds(px(s, d))


@query(_cpcv("rn >= e2 + emb"))
def cpcv_folds_forward(s, d):
    return validation.combinatorial_folds(px(s, d), mode="reference")


_UNIQ = f"""{_IVS}, al AS (SELECT p.series_id, p.ts, count(*) AS c FROM px p JOIN iv ON p.series_id = iv.series_id AND p.ts BETWEEN iv.t0 AND iv.t1 GROUP BY p.series_id, p.ts),
u AS (SELECT iv.series_id, iv.ts, iv.t0, iv.t1, avg(1.0::DOUBLE / c) AS u FROM iv JOIN al ON al.series_id = iv.series_id AND al.ts BETWEEN iv.t0 AND iv.t1 GROUP BY ALL)"""


@query(f"WITH {PX}, {_UNIQ} SELECT u.series_id, u.ts, al.c AS alive, round(u, 6) AS uniqueness FROM u JOIN al ON u.series_id = al.series_id AND u.ts = al.ts")
def label_uniqueness(s, d):
    u = validation.uniqueness(validation.intervals(px(s, d), 7))
    return rounded(u.select("series_id", "ts", "alive", "uniqueness"))


@query(f"WITH {PX}, {_UNIQ} SELECT series_id, ts, round(u / sum(u) OVER (PARTITION BY series_id) * count(*) OVER (PARTITION BY series_id), 6) AS weight FROM u")
def sample_weights(s, d):
    return rounded(validation.weights(validation.uniqueness(validation.intervals(px(s, d), 7))).select("series_id", "ts", "weight"))


@query(f"WITH {PX}, {_UNIQ}, dw AS (SELECT *, u * exp(-0.001 * date_diff('day', t0, max(t1) OVER (PARTITION BY series_id))) AS w FROM u) SELECT series_id, ts, round(w / sum(w) OVER (PARTITION BY series_id) * count(*) OVER (PARTITION BY series_id), 6) AS weight FROM dw")
def time_decay_weights(s, d):
    return rounded(validation.weights(validation.uniqueness(validation.intervals(px(s, d), 7)), 0.001).select("series_id", "ts", "weight"))


@query(f"WITH {PX}, {_IVS} SELECT a.series_id, (SELECT count(*) FROM iv q WHERE q.series_id = a.series_id) AS n, count(*) AS pairs FROM iv a JOIN iv b ON a.series_id = b.series_id AND a.ts < b.ts AND b.t0 <= a.t1 GROUP BY a.series_id")
def overlap_count(s, d):
    return validation.overlap_count(validation.intervals(px(s, d), 7))


@query(f"""WITH {RET}, k AS (SELECT series_id AS config_id, ret, row_number() OVER ({W}) <= count(*) OVER (PARTITION BY series_id) // 2 AS a FROM rt),
g AS (SELECT config_id, avg(CASE WHEN a THEN ret END) / stddev_samp(CASE WHEN a THEN ret END) * sqrt(252.0) AS si, avg(CASE WHEN NOT a THEN ret END) / stddev_samp(CASE WHEN NOT a THEN ret END) * sqrt(252.0) AS so FROM k GROUP BY config_id), m AS (SELECT median(so) AS m FROM g)
SELECT round(avg(CAST(so < m AS INTEGER)), 6) AS pbo, count(*) AS n_configs, arg_max(config_id, si) AS best_is, arg_max(so < m, si) AS best_is_below_median FROM g CROSS JOIN m""")
def pbo(s, d):
    return rounded(validation.pbo(returns(s, d).select(F.col("series_id").alias("config_id"), "ts", "ret")))


def _simulated(s, d, method: str):
    """1,000 paths of each series, as long as the longest."""
    r = returns(s, d).select("series_id", "ts", "ret")
    rows = r.groupBy("series_id").count().agg(F.max("count")).first()[0]
    return validation.synthetic_paths(r, 1000, rows, method)


@query()
def synthetic_paths(s, d):
    return validation.path_summary(_simulated(s, d, "normal"))


@query()
def bootstrap_paths(s, d):
    return validation.path_summary(_simulated(s, d, "bootstrap"))


@query()
def robustness(s, d):
    return validation.robustness(_simulated(s, d, "normal"))


@query()
def sequential_bootstrap(s, d):
    return validation.sequential_bootstrap(validation.intervals(px(s, d), 7), 1_000_000)  # as many draws as labels


@query("SELECT name, pbo, dsr, cv_ratio, CASE WHEN pbo > 0.7 OR dsr < 0.80 THEN 'FAIL' WHEN pbo > 0.3 OR dsr < 0.95 OR cv_ratio > 0.2 THEN 'WARNING' ELSE 'PASS' END AS status FROM (SELECT r_name AS name, r_regionkey / 5.0::DOUBLE AS pbo, 1 - r_regionkey / 50.0::DOUBLE AS dsr, r_regionkey / 10.0::DOUBLE AS cv_ratio FROM region) q")
def overall_status(s, d):
    k = F.col("r_regionkey")
    return validation.status(table(s, d, "region").select(F.col("r_name").alias("name"), (k / 5.0).alias("pbo"), (1 - k / 50.0).alias("dsr"), (k / 10.0).alias("cv_ratio")))


#: Common tables of a whole validation of bt: w has its folds' summary, pr its ratios, un its labels' uniqueness, ln its length.
JUDGED = f"""{RET}, {BT}, {wf_parts(' + 1', 252, 63, 21)}, {probability_parts('bt')}, {_UNIQ}, un AS (SELECT series_id, avg(u) AS mean_uniqueness, min(w) AS low_weight, max(w) AS high_weight FROM (SELECT *, u / sum(u) OVER (PARTITION BY series_id) * count(*) OVER (PARTITION BY series_id) AS w FROM u) q GROUP BY series_id),
w AS (SELECT series_id, count(*) AS n_folds, avg(sharpe) AS mean_sharpe, stddev_pop(sharpe) AS std_sharpe, min(sharpe) AS min_sharpe, max(sharpe) AS max_sharpe, avg(total_return) AS mean_return, min(max_drawdown) AS worst_drawdown, avg(CAST(total_return > 0 AS INTEGER)) AS success_share FROM wf GROUP BY series_id),
ln AS (SELECT series_id, count(ret) AS n_returns FROM bt GROUP BY series_id)"""


@query(f"""WITH {JUDGED}, j AS (SELECT pr.*, mean_uniqueness, n_folds, mean_sharpe, std_sharpe, coalesce(CASE WHEN mean_sharpe <> 0 THEN std_sharpe / abs(mean_sharpe) END, 0) AS cv_ratio, n_returns FROM pr JOIN un ON pr.series_id = un.series_id JOIN ln ON pr.series_id = ln.series_id LEFT JOIN w ON pr.series_id = w.series_id)
SELECT series_id, round(psr, 5) AS psr, round(dsr, 5) AS dsr, min_backtest, round(mean_uniqueness, 5) AS mean_uniqueness, n_folds, round(mean_sharpe, 5) AS mean_sharpe, round(std_sharpe, 5) AS std_sharpe, round(cv_ratio, 4) AS cv_ratio, CAST(NULL AS DOUBLE) AS pbo, n_returns, n_returns >= min_backtest AS long_enough,
CASE WHEN dsr < 0.80 THEN 'FAIL' WHEN dsr < 0.95 OR cv_ratio > 0.2 THEN 'WARNING' ELSE 'PASS' END AS status FROM j""")
def validate_backtest(s, d):
    v = validation.validate(_bt(s, d))
    return rounded(v.withColumn("cv_ratio", F.round("cv_ratio", 4)), 5)


# learning


@query(f"""WITH {PX}, m AS (SELECT *, value / lag(value, 5) OVER ({W}) - 1 AS x, row_number() OVER ({W}) AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM px),
p AS (SELECT *, CASE WHEN rn <= floor(n * 0.7) THEN 'train' ELSE 'test' END AS part FROM m), st AS (SELECT series_id, avg(x) AS mu, stddev_pop(x) AS sd FROM p WHERE part = 'train' GROUP BY series_id)
SELECT p.series_id, p.ts, p.part, round((x - mu) / sd, 6) AS x FROM p JOIN st ON p.series_id = st.series_id""")
def split_scale(s, d):
    p = px(s, d).withColumn("x", o.pct_change("value", 5, o.series())).drop("value")
    return rounded(learn.standardise(learn.split(p), ["x"]).select("series_id", "ts", "part", "x"))


_SC = f"sc AS (SELECT series_id, ts, ret, CASE WHEN lag(value, 3) OVER ({W}) IS NULL THEN 0.5 ELSE 1 / (1 + exp(-200 * (value / lag(value, 3) OVER ({W}) - 1))) END AS p, coalesce(CAST(lead(ret) OVER ({W}) > 0 AS INTEGER), 0) AS label FROM rt)"


def _scored(s, d):
    w = o.series()
    z = o.pct_change("value", 3, w)
    return returns(s, d).select("series_id", "ts", "ret", F.coalesce(1 / (1 + F.exp(-200 * z)), F.lit(0.5)).alias("p"), F.coalesce((F.lead("ret").over(w) > 0).cast("int"), F.lit(0)).alias("label"))


@query(f"""WITH {RET}, {_SC}, t AS (SELECT CAST(i AS INTEGER) AS step, 0.45 + 0.2 * i / 19 AS th FROM (SELECT unnest(range(20)) AS i) q), a AS (SELECT sc.*, t.step, t.th, CAST(p > th AS INTEGER) AS onn FROM sc CROSS JOIN t),
r AS (SELECT *, coalesce(lag(onn) OVER w * ret, 0) AS r FROM a WINDOW w AS (PARTITION BY series_id, step ORDER BY ts)), e AS (SELECT *, product(1 + r) OVER (PARTITION BY series_id, step ORDER BY ts) AS eq FROM r),
k AS (SELECT *, eq / max(eq) OVER (PARTITION BY series_id, step ORDER BY ts) - 1 AS dd FROM e), g AS (SELECT series_id, step, product(1 + r) - 1 AS tr, min(dd) AS dd, CAST(sum(onn) AS BIGINT) AS rows_in FROM k GROUP BY series_id, step),
z AS (SELECT *, CASE WHEN dd < -0.30 THEN tr / 2 ELSE tr END AS score FROM g)
SELECT series_id, step, round(tr, 6) AS total_return, round(dd, 6) AS max_drawdown, rows_in, row_number() OVER (PARTITION BY series_id ORDER BY score DESC, step) = 1 AS best FROM z""")
def threshold_sweep(s, d):
    return rounded(learn.threshold_sweep(_scored(s, d)).select("series_id", "step", "total_return", "max_drawdown", "rows_in", "best"))


@query(f"""WITH {RET}, {_SC}, g AS (SELECT series_id, count(*) FILTER (p > 0.5 AND label = 1) AS tp, count(*) FILTER (p > 0.5 AND label = 0) AS fp, count(*) FILTER (p <= 0.5 AND label = 1) AS fn, count(*) FILTER (p <= 0.5 AND label = 0) AS tn FROM sc GROUP BY series_id)
SELECT series_id, tp, fp, fn, tn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM g""")
def confusion(s, d):
    return rounded(learn.confusion(_scored(s, d)))


@query(f"""WITH {RET}, {_SC}, a AS (SELECT series_id, round(p, 3) AS p, label FROM sc)
SELECT x.series_id, x.np AS n_pos, y.nn AS n_neg, round(w / (x.np * y.nn), 6) AS auc FROM (SELECT a.series_id, sum(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS w FROM a JOIN a b ON a.series_id = b.series_id WHERE a.label = 1 AND b.label = 0 GROUP BY a.series_id) z
JOIN (SELECT series_id, count(*) AS np FROM a WHERE label = 1 GROUP BY series_id) x ON x.series_id = z.series_id JOIN (SELECT series_id, count(*) AS nn FROM a WHERE label = 0 GROUP BY series_id) y ON y.series_id = z.series_id""")
def auc_rank(s, d):
    return rounded(learn.auc(_scored(s, d).withColumn("p", F.round("p", 3))))


@query(f"WITH {RET}, {_SC} SELECT series_id, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY series_id), 6) AS share FROM sc GROUP BY series_id, label")
def class_balance(s, d):
    return rounded(learn.balance(_scored(s, d)))


@query(f"WITH {RET}, {_SC}, q AS (SELECT series_id, ts, p, CASE WHEN ret > 0 THEN 0.6 ELSE 0.4 END AS q FROM sc) SELECT series_id, ts, round((0.3 * p + 0.7 * q) / 1.0, 6) AS mix FROM q")
def probability_ensemble(s, d):
    x = _scored(s, d).withColumn("q", F.when(F.col("ret") > 0, 0.6).otherwise(0.4))
    return rounded(learn.ensemble(x, {"p": 0.3, "q": 0.7}, "mix").select("series_id", "ts", "mix"))


def _learned(s, d, kind: str, **how):
    f = features.feature_set(returns(s, d).select("series_id", "ts", "value"))
    names = ["mom_5", "mom_20", "vol_20", "z_20"]
    x = learn.split(signals.labels(f, 5)).select("series_id", "ts", "value", "part", "label", *names)
    fitted = learn.model(kind, names, **how).fit(x.where("part = 'train'"))
    scored = learn.score(fitted, x)
    return signals.edges(scored.withColumn("_pos", F.col("p") > 0.52)).select("series_id", "ts", "p", "position", "entry", "exit")


@query()
def logit_signals(s, d):
    return _learned(s, d, "logit", n_train=5000)


@query()
def forest_signals(s, d):
    return _learned(s, d, "forest", numTrees=10, maxDepth=4)


@query()
def boosting_signals(s, d):
    return _learned(s, d, "boosting", maxIter=5, maxDepth=3)


@query()
def bootstrap_ci(s, d):
    return learn.bootstrap_cagr(returns(s, d), 1000)


# bars and microstructure


@query(f"""WITH {TICKS}, n AS (SELECT *, (row_number() OVER (PARTITION BY series_id ORDER BY ts, event_id) - 1) // 50 AS bar FROM tk)
SELECT series_id, bar, min(ts) AS start, max(ts) AS "end", round(arg_min(price, (ts, event_id)), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(arg_max(price, (ts, event_id)), 6) AS close, round(sum(volume), 6) AS volume, count(*) AS ticks FROM n GROUP BY series_id, bar HAVING count(*) = 50""")
def tick_bars(s, d):
    return rounded(bars.tick_bars(ticks(s, d), 50, ("ts", "event_id")))


def _volume_bars_sql(amount: str, threshold: float) -> str:
    return f"""WITH RECURSIVE {TICKS}, n AS (SELECT *, {amount} AS a, row_number() OVER (PARTITION BY series_id ORDER BY ts, event_id) AS rn FROM tk),
f AS (SELECT series_id, rn, CASE WHEN a >= {threshold} THEN 0 ELSE a END AS total, 0::BIGINT AS bar, a >= {threshold} AS shut FROM n WHERE rn = 1
  UNION ALL SELECT n.series_id, n.rn, CASE WHEN f.total + n.a >= {threshold} THEN 0 ELSE f.total + n.a END, f.bar + CAST(f.shut AS BIGINT), f.total + n.a >= {threshold} FROM f JOIN n ON n.series_id = f.series_id AND n.rn = f.rn + 1),
j AS (SELECT n.*, f.bar, f.shut FROM n JOIN f ON n.series_id = f.series_id AND n.rn = f.rn)
SELECT series_id, bar, min(ts) AS start, max(ts) AS "end", round(arg_min(price, rn), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(arg_max(price, rn), 6) AS close, round(sum(volume), 6) AS volume, count(*) AS ticks FROM j GROUP BY series_id, bar HAVING bool_or(shut)"""


@query(_volume_bars_sql("volume", 200))
def volume_bars(s, d):
    return rounded(bars.volume_bars(ticks(s, d), 200, order=("ts", "event_id")))


@query(_volume_bars_sql("price * volume", 20000))
def dollar_bars(s, d):
    return rounded(bars.volume_bars(ticks(s, d), 20_000, dollars=True, order=("ts", "event_id")))


@query(f"""WITH {TICKS}, sg AS (SELECT *, sign(price - lag(price) OVER (PARTITION BY series_id ORDER BY ts, event_id)) AS s FROM tk),
f AS (SELECT series_id, ts, event_id, CAST(coalesce(last_value(CASE WHEN s <> 0 THEN s END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS INTEGER) AS side FROM sg)
SELECT series_id, event_id, side, CAST(sum(side) OVER (PARTITION BY series_id ORDER BY ts, event_id) AS BIGINT) AS imbalance FROM f""")
def tick_rule(s, d):
    return bars.tick_rule(ticks(s, d), ("ts", "event_id")).select("series_id", "event_id", "side", "imbalance")


@query(f"""WITH RECURSIVE {PX}, n AS (SELECT series_id, ts, coalesce(value / lag(value) OVER ({W}) - 1, 0) AS r, row_number() OVER ({W}) AS rn FROM px),
f AS (SELECT series_id, ts, rn, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, 0 AS event FROM n WHERE rn = 1
  UNION ALL SELECT n.series_id, n.ts, n.rn, CASE WHEN least(0, f.dn + n.r) < -0.5 THEN greatest(0, f.up + n.r) WHEN greatest(0, f.up + n.r) > 0.5 THEN 0 ELSE greatest(0, f.up + n.r) END,
    CASE WHEN least(0, f.dn + n.r) < -0.5 THEN 0 ELSE least(0, f.dn + n.r) END, CASE WHEN least(0, f.dn + n.r) < -0.5 THEN -1 WHEN greatest(0, f.up + n.r) > 0.5 THEN 1 ELSE 0 END FROM f JOIN n ON n.series_id = f.series_id AND n.rn = f.rn + 1)
SELECT series_id, ts, event FROM f""")
def cusum(s, d):
    return bars.cusum(px(s, d), 0.5).select("series_id", "ts", "event")


_FW = bars.frac_weights(0.4, 8)


@query(f"WITH {PX} SELECT series_id, ts, round({' + '.join(f'lag(value, {k}) OVER w * ({x!r})' if k else f'value * {x!r}' for k, x in enumerate(_FW))}, 4) AS frac FROM px WINDOW w AS ({W})")
def frac_diff(s, d):
    return rounded(bars.frac_diff(px(s, d), 0.4, 8).drop("value"), 4)


@query(f"""WITH {FLOW}, a AS (SELECT *, value - lag(value) OVER w AS dd, value / lag(value) OVER w - 1 AS r FROM fl WINDOW w AS ({W})), b AS (SELECT *, lag(dd) OVER ({W}) AS l, sign(dd) * volume AS q, abs(r) / (value * volume) AS am FROM a),
c AS (SELECT *, CASE WHEN count(l) OVER f >= 20 THEN covar_samp(dd, l) OVER f END AS cv, CASE WHEN count(q) OVER f >= 20 THEN covar_samp(dd, q) OVER f / nullif(var_samp(q) OVER f, 0) END AS ky, CASE WHEN count(am) OVER f >= 20 THEN avg(am) OVER f END AS ami FROM b WINDOW f AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT series_id, ts, round(CASE WHEN cv IS NOT NULL THEN 2 * sqrt(greatest(0, -cv)) END, 2) AS roll_spread, round(ky, 3) AS kyle_lambda, round(ami * 1e6, 4) AS amihud FROM c""")
def liquidity(s, d):
    x = bars.liquidity(flow(s, d).select("series_id", "ts", "value", "volume"))
    return x.select("series_id", "ts", (F.round("roll_spread", 2) + 0.0).alias("roll_spread"), (F.round("kyle_lambda", 3) + 0.0).alias("kyle_lambda"), (F.round(F.col("amihud") * 1e6, 4) + 0.0).alias("amihud"))


@query(f"""WITH {FLOW}, a AS (SELECT *, abs(sign(value - lag(value) OVER ({W})) * volume) AS q FROM fl) SELECT series_id, ts, round(({rolled('sum({})', 'q', 10)}) / ({rolled('sum({})', 'volume', 10)}), 6) AS vpin FROM a""")
def vpin(s, d):
    return rounded(bars.vpin(flow(s, d).select("series_id", "ts", "value", "volume")).select("series_id", "ts", "vpin"))


@query(f"""WITH {PX}, a AS (SELECT series_id, sign(value - lag(value) OVER ({W})) AS s FROM px), c AS (SELECT series_id, s, count(*) AS n FROM a WHERE s IS NOT NULL GROUP BY series_id, s), p AS (SELECT *, n / sum(n) OVER (PARTITION BY series_id) AS p FROM c) SELECT series_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY series_id""")
def sign_entropy(s, d):
    return rounded(bars.entropy(px(s, d)))


@query(f"""WITH {RET}, a AS (SELECT series_id, {', '.join(f'value - lag(value, {k}) OVER w AS d{k}' for k in (2, 4, 8, 16, 32))} FROM rt WINDOW w AS ({W})),
g AS ({' UNION ALL '.join(f"SELECT series_id, ln({k}::DOUBLE) AS x, ln(stddev_samp(d{k})) AS y FROM a GROUP BY series_id" for k in (2, 4, 8, 16, 32))}) SELECT series_id, round(regr_slope(y, x), 6) AS hurst FROM g GROUP BY series_id""")
def hurst(s, d):
    return rounded(bars.hurst(returns(s, d)))


@query(f"""WITH RECURSIVE {PX}, r AS (SELECT * FROM (SELECT series_id, ts, value / lag(value) OVER ({W}) - 1 AS r FROM px) q WHERE r IS NOT NULL), n AS (SELECT *, row_number() OVER ({W}) AS rn FROM r),
e AS (SELECT series_id, ts, rn, r AS m, r * r AS v FROM n WHERE rn = 1
  UNION ALL SELECT n.series_id, n.ts, n.rn, e.m + (2.0 / 21) * (n.r - e.m), e.v + (2.0 / 21) * (n.r * n.r - e.v) FROM e JOIN n ON n.series_id = e.series_id AND n.rn = e.rn + 1)
SELECT series_id, ts, round(sqrt(greatest(0, v - m * m)), 5) AS ewm_vol FROM e""")
def ewm_volatility(s, d):
    return rounded(bars.daily_volatility(px(s, d)).select("series_id", "ts", "ewm_vol"), 5)


@query()
def min_variance(s, d):
    w = bars.min_variance(returns(s, d), ["1-URGENT", "2-HIGH", "3-MEDIUM"])
    return s.createDataFrame(sorted(w.items()), "series_id string, weight double")


# streams


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 6) AS high, round(min(value), 6) AS low, round(arg_min(value, (ts, event_id)), 6) AS open, round(arg_max(value, (ts, event_id)), 6) AS close FROM events GROUP BY 1, 2")
def event_bars(s, d):
    b = stream.windowed_bars(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return b.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"), *[F.round(c, 6).alias(c) for c in ("high", "low", "open", "close")])


@query("""WITH o AS (SELECT user_id, ts, value, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM o) SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS start, CAST(max(ts) + INTERVAL 30 MINUTE AS TIMESTAMP) AS "end", count(*) AS n, round(sum(value), 4) AS total FROM r GROUP BY user_id, k""")
def session_bars(s, d):
    x = stream.sessions(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return x.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.round("total", 4).alias("total"))


def _stream(s, d):
    schema = table(s, d, "events").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def _shared(s) -> str:
    return f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(s, d):
    out = stream.run_once(stream.windowed_bars(_stream(s, d)), f"bars_{uuid.uuid4().hex[:8]}", _shared(s), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH RECURSIVE n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
h AS (SELECT user_id, event_id, rn, value > 400 AS held, CASE WHEN value > 400 THEN 2 ELSE 0 END AS rest FROM n WHERE rn = 1
  UNION ALL SELECT n.user_id, n.event_id, n.rn, h.rest > 0 OR n.value > 400, CASE WHEN h.rest > 0 THEN h.rest - 1 WHEN n.value > 400 THEN 2 ELSE 0 END FROM h JOIN n ON n.user_id = h.user_id AND n.rn = h.rn + 1)
SELECT user_id, event_id, held FROM h""")
def stream_holds(s, d):
    return stream.run_once(stream.held_signals(_stream(s, d), 400.0, 3), f"holds_{uuid.uuid4().hex[:8]}", _shared(s))


@query("""WITH RECURSIVE w AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY AS mark FROM events), n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events, w WHERE ts <= mark),
h AS (SELECT user_id, event_id, rn, value > 400 AS held, CASE WHEN value > 400 THEN 2 ELSE 0 END AS rest FROM n WHERE rn = 1
  UNION ALL SELECT n.user_id, n.event_id, n.rn, h.rest > 0 OR n.value > 400, CASE WHEN h.rest > 0 THEN h.rest - 1 WHEN n.value > 400 THEN 2 ELSE 0 END FROM h JOIN n ON n.user_id = h.user_id AND n.rn = h.rn + 1)
SELECT user_id, event_id, held FROM h""")
def stream_ordered_holds(s, d):
    """Holds by event time: what the watermark, a day behind the newest event, has reached."""
    held = stream.ordered_holds(_stream(s, d), 400.0, 3)
    return stream.run_once(held, f"ordered_{uuid.uuid4().hex[:8]}", _shared(s), state_store=stream.ROCKSDB)
