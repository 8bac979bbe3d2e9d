"""Queries of the feature sets over panels, callables per fold, folds' members, and their SQL.

A panel's roles are dealt to the price series in order of name, over and over, so that the names come from the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ordered as o
from ..operators import align, feature_sets, features, signals, validation
from .views import PX, RET, Book, W, px, returns, rolled, rounded

BOOK = Book()
query = BOOK.add
O = "ORDER BY ts"  # noqa: E741
UP_TO = f"OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
DAILY = ("price", "vix", "cad_oas", "us_ig_oas", "us_hy_oas", "us_3m_10y", "us_lei_yoy", "us_economic_regime")
WEEKLY = ("price", "cad_oas", "us_hy_oas", "us_ig_oas", "tsx", "vix", "us_3m_10y", *feature_sets.WEEKLY_MACRO, "us_economic_regime")


def roles(df: DataFrame, names: tuple[str, ...]) -> dict[str, str]:
    own = [r["series_id"] for r in df.select("series_id").distinct().orderBy("series_id").collect()]  # a handful
    return {r: own[i % len(own)] for i, r in enumerate(names)}


def daily(s: SparkSession, d: str, names: tuple[str, ...]) -> DataFrame:
    p = px(s, d)
    return feature_sets.panel(p, roles(p, names))


def panel_sql(names: tuple[str, ...], src: str = "px") -> str:
    cols = ", ".join(f"max(CASE WHEN nm.k = {i} % nn.n THEN {src}.value END) AS {r}" for i, r in enumerate(names))
    return f"""nm AS (SELECT series_id, row_number() OVER (ORDER BY series_id) - 1 AS k FROM (SELECT DISTINCT series_id FROM {src}) q), nn AS (SELECT count(*) AS n FROM nm),
pn AS (SELECT * FROM (SELECT {src}.ts, {cols} FROM {src} JOIN nm ON {src}.series_id = nm.series_id CROSS JOIN nn GROUP BY {src}.ts) q WHERE {" AND ".join(f"{r} IS NOT NULL" for r in names)})"""


def roll(agg: str, x: str, n: int) -> str:
    return f"({rolled(agg, x, n, O)})"


def move(x: str, k: int) -> str:
    return f"({x} / lag({x}, {k}) OVER ({O}) - 1)"


def z(x: str, n: int) -> str:
    return f"(({x} - {roll('avg({})', x, n)}) / nullif({roll('stddev_samp({})', x, n)}, 0))"


def yes(c: str) -> str:
    return f"coalesce(CAST(({c}) AS DOUBLE), 0)"


def rank(x: str, n: int) -> str:
    """From the list of the last n values, kept as l_<x>_<n>."""
    held = f"list_filter(l_{x}_{n}, lambda v: v IS NOT NULL)"
    return f"CASE WHEN len({held}) >= {n} AND {x} IS NOT NULL THEN (len(list_filter({held}, lambda v: v < {x})) + (len(list_filter({held}, lambda v: v = {x})) + 1) / 2) / {n} END"


def held(x: str, n: int) -> str:
    return f"list({x}) OVER ({O} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS l_{x}_{n}"


MACD = """n AS (SELECT *, row_number() OVER (ORDER BY ts) AS rn FROM pn),
e AS (SELECT ts, rn, price AS f, price AS s, 0.0::DOUBLE AS g FROM n WHERE rn = 1
  UNION ALL SELECT n.ts, n.rn, e.f + (2.0 / 13) * (n.price - e.f), e.s + (2.0 / 27) * (n.price - e.s), e.g + 0.2 * ((e.f + (2.0 / 13) * (n.price - e.f)) - (e.s + (2.0 / 27) * (n.price - e.s)) - e.g) FROM e JOIN n ON n.rn = e.rn + 1)"""


def finished(ctes: str, x: dict[str, str], digits: int = 4, carry: bool = True, src: str = "t") -> str:
    fill = (lambda c: f"last_value({c} IGNORE NULLS) {UP_TO}") if carry else (lambda c: c)
    cols = ", ".join(f"{v} AS {c}" for c, v in x.items())
    return f"WITH RECURSIVE {ctes}, x AS (SELECT ts, {cols} FROM {src})\nSELECT 'all' AS panel_id, ts, {', '.join(f'round(coalesce({fill(c)}, 0), {digits}) AS {c}' for c in x)} FROM x"


def _boosting_sql() -> str:
    fs, x = feature_sets, {}
    one = f"t1 AS (SELECT pn.*, e.f - e.s AS mc, e.g AS sg, {move('price', 1)} AS r, {', '.join(f'{move("price", k)} AS mom{k}' for k in fs.MOMENTUM)}, {roll('max({})', 'price', 2)} - {roll('min({})', 'price', 2)} AS span FROM pn JOIN e USING (ts))"
    two = f"t2 AS (SELECT *, {', '.join(f'{roll("stddev_samp({})", "r", n)} AS vol{n}' for n in fs.VOLATILITY)}, greatest(coalesce(r, 0), 0) AS gain, greatest(coalesce(-r, 0), 0) AS loss, sum(CASE WHEN r > 0 THEN 0 ELSE 1 END) {UP_TO} AS gu, sum(CASE WHEN r < 0 THEN 0 ELSE 1 END) {UP_TO} AS gd FROM t1)"
    lists = ", ".join([*(held(f"mom{k}", 252) for k in fs.MOMENTUM), *(held("price", n) for n in (20, 60, 252))])
    three = f"t AS (SELECT *, {lists}, sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY gu ORDER BY ts) AS su, sum(CASE WHEN r < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY gd ORDER BY ts) AS sd FROM t2)"
    avg = lambda c, n: roll("avg({})", c, n)
    for k in fs.MOMENTUM:
        x |= {f"momentum_{k}d": f"mom{k}", f"momentum_{k}d_rank": rank(f"mom{k}", 252)}
    for n in fs.VOLATILITY:
        x |= {f"volatility_{n}d": f"vol{n}", f"volatility_{n}d_zscore": z(f"vol{n}", 252), f"volatility_regime_{n}d": yes(f"vol{n} > {roll('quantile_cont({}, 0.5)', f'vol{n}', 252)}")}
    for n in fs.AVERAGES:
        x |= {f"ma_{n}d_deviation": f"(price - {avg('price', n)}) / {avg('price', n)}", f"price_above_ma_{n}d": yes(f"price > {avg('price', n)}")}
    x |= {f"ma_cross_{a}_{b}": yes(f"{avg('price', a)} > {avg('price', b)}") for a, b in ((5, 20), (10, 50), (50, 200))}
    x |= {f"rsi_{n}d": f"100 - 100.0 / (1 + {avg('gain', n)} / ({avg('loss', n)} + 1e-10))" for n in (14, 30)}
    x |= {"macd_diff": "mc - sg", "macd_signal": yes("mc > sg")}
    for n in (20, 40):
        dev = roll("stddev_samp({})", "price", n)
        x |= {f"bollinger_position_{n}d": f"(price - {avg('price', n)}) / (2 * {dev})", f"bollinger_width_{n}d": f"4 * {dev} / {avg('price', n)}"}
    low, high = (lambda n: roll("min({})", "price", n)), (lambda n: roll("max({})", "price", n))
    x |= {f"stochastic_{n}d": f"100 * (price - {low(n)}) / ({high(n)} - {low(n)} + 1e-10)" for n in (14, 30)}
    x |= {"vix_level": "vix", "vix_change": move("vix", 1), "vix_zscore": z("vix", 252), "vix_regime": yes(f"vix > {roll('quantile_cont({}, 0.5)', 'vix', 252)}")} | {f"vix_momentum_{k}d": move("vix", k) for k in (5, 20)}
    for c in ("cad_oas", "us_ig_oas", "us_hy_oas"):
        x |= {f"{c}_level": c, f"{c}_change": move(c, 1), f"{c}_zscore": z(c, 252)} | {f"{c}_momentum_{k}d": move(c, k) for k in (5, 20)}
    for c in ("us_3m_10y", "us_lei_yoy", "us_economic_regime"):
        x |= {f"{c}_level": c, f"{c}_change": move(c, 1)}
    for n in (20, 60, 252):
        x |= {f"return_mean_{n}d": avg("r", n), f"return_std_{n}d": roll("stddev_samp({})", "r", n), f"return_skew_{n}d": roll("skewness({})", "r", n), f"return_kurt_{n}d": roll("kurtosis({})", "r", n), f"price_percentile_{n}d": rank("price", n)}
    x |= {f"trend_strength_{n}d": f"abs({move('price', n)}) / ({avg('span', n)} + 1e-10)" for n in (14, 30)}
    x |= {"consecutive_up": "CAST(su AS DOUBLE)", "consecutive_down": "CAST(sd AS DOUBLE)"}
    x |= {f"momentum_acceleration_{k}d": f"mom{k} - lag(mom{k}, {k}) OVER ({O})" for k in (5, 10, 20)}
    x |= {f"vol_of_vol_{n}d": roll("stddev_samp({})", f"vol{n}", n) for n in (20, 60)}
    x |= {f"distance_from_{end}_{n}d": f"(price - {f(n)}) / {f(n)}" for n in (60, 252) for end, f in (("high", high), ("low", low))}
    return finished(f"{PX}, {panel_sql(DAILY)}, {MACD}, {one}, {two}, {three}", x, 3)


@query(_boosting_sql())
def boosting_features(s, d):
    return rounded(feature_sets.create("boosting", daily(s, d, DAILY), asset="price"), 3)


def _credit_sql() -> str:
    fs = feature_sets
    x = {f"{c}_ret{k}": move(c, k) for c in ("cad_oas", "us_hy_oas", "vix") for k in fs.CREDIT_MOMENTUM} | {f"{c}_zscore{n}": z(c, n) for c in ("cad_oas", "us_hy_oas", "vix") for n in fs.CREDIT_Z}
    x |= {f"{c}_change{k}": f"{c} - lag({c}, {k}) OVER ({O})" for c in ("us_equity_revisions", "us_hard_data_surprises") for k in fs.CREDIT_CHANGE} | {c: c for c in fs.CREDIT_LEVELS}
    return finished(f"{PX}, {panel_sql(fs.CREDIT_LEVELS)}", x, 5, src="pn")


@query(_credit_sql())
def credit_features(s, d):
    return rounded(feature_sets.create("credit", daily(s, d, feature_sets.CREDIT_LEVELS)), 5)


GENETIC = ("price", "cad_oas", "us_ig_oas", "vix")  # without us_hy_oas, which is 0 then


def _genetic_sql() -> str:
    fs = feature_sets
    x = {f"mom_{k}": move("price", k) for k in fs.GENETIC_MOMENTUM} | {f"vol_{n}": roll("stddev_samp({})", "r", n) for n in fs.GENETIC_WINDOWS} | {f"sma_{n}_dev": f"price / {roll('avg({})', 'price', n)} - 1" for n in fs.GENETIC_WINDOWS}
    low, high = roll("min({})", "price", 14), roll("max({})", "price", 14)
    x |= {"macd_diff": "mc - sg", "stoch_k": f"100 * (price - {low}) / ({high} - {low} + 1e-8)"} | {f"{c}_mom4": move(c, 4) if c in GENETIC else "0.0::DOUBLE" for c in fs.GENETIC_FACTORS}
    return finished(f"{PX}, {panel_sql(GENETIC)}, {MACD}, t AS (SELECT pn.*, e.f - e.s AS mc, e.g AS sg, {move('price', 1)} AS r FROM pn JOIN e USING (ts))", x, 3, carry=False)


@query(_genetic_sql())
def genetic_features(s, d):
    return rounded(feature_sets.create("genetic", daily(s, d, GENETIC), asset="price"), 3)


WEEKS = f"""{PX}, wb AS (SELECT series_id, CAST(ts + CAST(((5 - isodow(ts) + 7) % 7) AS INTEGER) AS DATE) AS p, arg_max(value, ts) AS v FROM px GROUP BY ALL), wm AS (SELECT series_id, min(p) AS lo, max(p) AS hi FROM wb GROUP BY series_id),
wg AS (SELECT series_id, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS ts FROM wm),
wk AS (SELECT wg.series_id, wg.ts, last_value(wb.v IGNORE NULLS) OVER (PARTITION BY wg.series_id ORDER BY wg.ts) AS value FROM wg LEFT JOIN wb ON wg.series_id = wb.series_id AND wg.ts = wb.p)"""


def _weekly_sql() -> str:
    risky, spreads = ("cad_oas", "us_hy_oas", "us_ig_oas", "vix", "price"), ("hy_ig_spread", "cad_us_ig_spread")
    t = f"t AS (SELECT *, us_hy_oas - us_ig_oas AS hy_ig_spread, cad_oas - us_ig_oas AS cad_us_ig_spread, {', '.join(f'{move(c, 1)} AS r_{c}' for c in risky)} FROM pn)"
    x = {c: c for c in (*WEEKLY[1:], *spreads)} | {f"{c}_mom_{k}w": move(c, k) for c in ("cad_oas", "us_hy_oas", "us_ig_oas", "tsx", "vix", "us_3m_10y") for k in (1, 2, 4, 8, 12)}
    x |= {f"{c}_vol_{n}w": roll("stddev_samp({})", f"r_{c}", n) for c in risky for n in (4, 8, 12)}
    x |= {f"{c}_chg_{k}w": f"{c} - lag({c}, {k}) OVER ({O})" for c in spreads for k in (1, 4, 8)} | {f"{c}_chg_{k}w": f"{c} - lag({c}, {k}) OVER ({O})" for c in feature_sets.WEEKLY_MACRO for k in (1, 4)}
    x["regime_change"] = f"us_economic_regime - lag(us_economic_regime) OVER ({O})"
    for n in (4, 8, 12, 26):
        x |= {f"target_sma_{n}": roll("avg({})", "price", n), f"target_dist_sma_{n}": f"price / {roll('avg({})', 'price', n)} - 1"}
    x |= {f"target_zscore_{n}w": z("price", n) for n in (8, 12)}
    x["target_tsx_corr_12w"] = f"({roll('covar_samp({}, tsx)', 'price', 12)} / nullif({roll('stddev_samp({})', 'price', 12)} * {roll('stddev_samp({})', 'tsx', 12)}, 0))"
    x["vix_high"] = yes(f"vix > {roll('quantile_cont({}, 0.75)', 'vix', 12)}")
    cols = ", ".join(f"{v} AS {c}" for c, v in x.items())
    return f"WITH {WEEKS}, {panel_sql(WEEKLY, 'wk')}, {t}, x AS (SELECT ts, {cols} FROM t)\nSELECT 'all' AS panel_id, ts, {', '.join(f'round({c}, 4) AS {c}' for c in x)} FROM x WHERE {' AND '.join(f'{c} IS NOT NULL' for c in x)}"


@query(_weekly_sql())
def weekly_feature_set(s, d):
    w = align.resample(px(s, d), "W", "last")
    return rounded(feature_sets.create("weekly", feature_sets.panel(w, roles(w, WEEKLY)), asset="price"), 4)


# folds whose members and callables are asked for


@query(f"""WITH {PX}, n AS (SELECT series_id, ts, row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM px), g AS (SELECT *, least(rn // (n // 5), 4) AS g FROM n),
c AS (SELECT a.g AS a, b.g AS b, row_number() OVER (ORDER BY a.g, b.g) - 1 AS split FROM (SELECT unnest(range(5)) AS g) a JOIN (SELECT unnest(range(5)) AS g) b ON a.g < b.g),
e AS (SELECT g.*, c.split, c.a, c.b, CASE WHEN c.a = 4 THEN n ELSE (c.a + 1) * (n // 5) END AS ea, CASE WHEN c.b = 4 THEN n ELSE (c.b + 1) * (n // 5) END AS eb, n // 100 AS emb FROM g CROSS JOIN c)
SELECT series_id, ts, CAST(split AS INTEGER) AS split, CASE WHEN g IN (a, b) THEN 'test' WHEN (rn >= ea AND rn < ea + emb) OR (rn >= eb AND rn < eb + emb) THEN 'embargo' ELSE 'train' END AS role FROM e""")
def cpcv_members(s, d):
    return validation.combinatorial_members(px(s, d))


def _forward_sql(start: str) -> str:
    return f"""WITH {RET}, n AS (SELECT series_id, ts, ret, row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM rt),
f AS (SELECT *, CAST(unnest(range(CASE WHEN n >= 150 THEN (n - 150) // 20 + 1 ELSE 0 END)) AS INTEGER) AS fold FROM n),
m AS (SELECT series_id, ts, fold, ret, CASE WHEN rn >= {start} AND rn < fold * 20 + 100 THEN 'train' WHEN rn >= fold * 20 + 100 AND rn < fold * 20 + 150 THEN 'test' END AS role FROM f)"""


@query(_forward_sql("0") + " SELECT series_id, ts, fold, role FROM m WHERE role IS NOT NULL")
def forward_members_expanding(s, d):
    return validation.walk_forward_members(returns(s, d), 100, 50, 20)


@query(_forward_sql("greatest(0, fold * 20 - 100)") + " SELECT series_id, ts, fold, role FROM m WHERE role IS NOT NULL")
def forward_members_rolling(s, d):
    return validation.walk_forward_members(returns(s, d), 100, 50, 20, "rolling")


@query(_forward_sql("fold * 20") + " SELECT series_id, fold, round(1000 * (avg(ret) FILTER (role = 'test') - avg(ret) FILTER (role = 'train')), 6) AS edge, count(*) FILTER (role = 'train') AS n_train FROM m WHERE role IS NOT NULL GROUP BY series_id, fold")
def forward_model(s, d):
    """A model callable per fold."""
    r = returns(s, d)
    run = lambda train, test: {"edge": float(1000 * (test["ret"].mean() - train["ret"].mean())), "n_train": len(train)}
    return rounded(validation.per_fold(validation.walk_forward_members(r, 100, 50, 20, "fixed"), r, run, "edge double, n_train long"))


SCORES = f"""WITH {RET}, n AS (SELECT series_id, ts, ret, row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM rt), f AS (SELECT *, unnest(range(5)) AS fold FROM n),
m AS (SELECT series_id, fold, 1000 * avg(ret) FILTER (rn >= fold * (n // 5) AND rn < (fold + 1) * (n // 5)) - 1000 * avg(ret) FILTER (rn < fold * (n // 5) OR rn >= (fold + 1) * (n // 5) + n // 100) AS score FROM f GROUP BY series_id, fold)
SELECT series_id, count(*) AS n_scores, avg(score) AS cv_mean, stddev_pop(score) AS cv_std FROM m GROUP BY series_id"""


def scores(s, d):
    r = returns(s, d)
    return validation.cross_validate(r, lambda train, test: 1000 * (test["ret"].mean() - train["ret"].mean()), validation.purged_folds(r))


@query(f"SELECT series_id, n_scores, round(cv_mean, 6) AS cv_mean, round(cv_std, 6) AS cv_std FROM ({SCORES}) q")
def cross_validation(s, d):
    """A scorer callable over purged folds."""
    return rounded(scores(s, d))


TRAINING = ["mom_5", "mom_20", "mom_60", "flat"]


def training_table(s, d):
    """Three momenta, a constant, and a label."""
    return features.momentum(px(s, d), [5, 20, 60]).withColumns({"flat": F.lit(0.0), "label": F.coalesce((F.col("mom_5") > 0).cast("int"), F.lit(0))})


@query(f"""WITH {PX}, m AS (SELECT series_id, ts, {", ".join(f"value / lag(value, {k}) OVER ({W}) - 1 AS m{k}" for k in (5, 20, 60))} FROM px), x AS (SELECT *, 0.0::DOUBLE AS flat, CAST(coalesce(m5 > 0, false) AS INTEGER) AS label FROM m)
SELECT series_id, count(*) AS n_rows, round(avg((CAST(m5 IS NULL AS DOUBLE) + CAST(m20 IS NULL AS DOUBLE) + CAST(m60 IS NULL AS DOUBLE) + 0) / 4), 6) AS missing_share, 1 + CAST(count(m60) = 0 AS BIGINT) + CAST(count(m20) = 0 AS BIGINT) + CAST(count(m5) = 0 AS BIGINT) AS n_constant, round(least(avg(label), 1 - avg(label)), 6) AS minority_share FROM x GROUP BY series_id""")
def data_quality(s, d):
    return rounded(validation.quality(training_table(s, d), TRAINING, "label"))


@query(f"""WITH {PX}, m AS (SELECT series_id, ts, {" + ".join(f"CAST(coalesce(value / lag(value, {k}) OVER ({W}) - 1 > 0, false) AS INTEGER)" for k in (5, 20, 60))} AS c FROM px), e AS (SELECT *, c >= 2 AS on_, coalesce(lag(c >= 2) OVER ({W}), false) AS was FROM m)
SELECT series_id, CAST(sum(CAST(on_ AND NOT was AS INTEGER)) AS BIGINT) AS n_signals, round(avg(CAST(on_ AND NOT was AS INTEGER)), 6) AS signal_share, round(avg(c) FILTER (isodow(ts) = 1), 6) AS monday_confirmations FROM e GROUP BY series_id""")
def signal_statistics(s, d):
    c = features.confirmations(px(s, d), [5, 20, 60]).withColumn("_pos", F.col("n_confirmed") >= 2)
    return rounded(signals.statistics(signals.edges(c)))


def tried(s, d):
    """Returns of five configurations per series, each out of the market on rows of its own."""
    r = returns(s, d).withColumn("rn", F.row_number().over(o.series())).withColumn("config_id", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return r.withColumn("ret", F.when(F.col("rn") % (F.col("config_id") + 2) == 0, F.lit(0.0)).otherwise(F.col("ret")))


@query(f"""WITH {RET}, c AS (SELECT series_id, k AS config_id, ts, CASE WHEN rn % (k + 2) = 0 THEN 0 ELSE ret END AS ret, row_number() OVER (PARTITION BY series_id, k ORDER BY ts) AS rk, count(*) OVER (PARTITION BY series_id, k) AS n FROM rt CROSS JOIN (SELECT unnest(range(5)) AS k) q),
g AS (SELECT series_id, config_id, coalesce(avg(ret) / stddev_samp(ret), 0) AS s FROM c WHERE rk > floor(n * 0.5) GROUP BY series_id, config_id), m AS (SELECT *, quantile_cont(s, 0.5) OVER (PARTITION BY series_id) AS md FROM g)
SELECT series_id, round(avg(CAST(s < md AS DOUBLE)), 6) AS pbo FROM m GROUP BY series_id""")
def overfitting_by_series(s, d):
    return rounded(validation.overfitting(tried(s, d)))
