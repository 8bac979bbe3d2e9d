"""Queries of the ordered core, calendars and joins, selection and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ordered as o
from ..operators import align, quality, select
from .views import FLOW, META, PX, PXN, RET, Book, W, flow, meta, px, px_null, returns, rolled, rounded

BOOK = Book()
query = BOOK.add
S = o.series
UNB = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
FWD = f"({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


# filling


@query(f"WITH {PXN} SELECT series_id, ts, round(last_value(value IGNORE NULLS) OVER {UNB}, 6) AS value FROM pn")
def ffill(s, d):
    return rounded(quality.fill(px_null(s, d), "ffill"))


@query(f"WITH {PXN} SELECT series_id, ts, round(first_value(value IGNORE NULLS) OVER {FWD}, 6) AS value FROM pn")
def bfill(s, d):
    return rounded(quality.fill(px_null(s, d), "bfill"))


@query(f"WITH {PXN} SELECT series_id, ts, CASE WHEN count(value) OVER {UNB} > 0 THEN round(first_value(value IGNORE NULLS) OVER {FWD}, 6) END AS value FROM pn")
def bfill_after_first(s, d):
    return rounded(quality.fill(px_null(s, d), "bfill_after_first"))


_INTERP = """WITH {pxn}, n AS (SELECT *, {at} AS a FROM pn),
x AS (SELECT series_id, ts, value, a, last_value(value IGNORE NULLS) OVER {unb} AS v0, first_value(value IGNORE NULLS) OVER {fwd} AS v1,
  last_value(CASE WHEN value IS NOT NULL THEN a END IGNORE NULLS) OVER {unb} AS a0, first_value(CASE WHEN value IS NOT NULL THEN a END IGNORE NULLS) OVER {fwd} AS a1 FROM n)
SELECT series_id, ts, round(CASE WHEN value IS NOT NULL THEN value WHEN v1 IS NULL THEN v0 WHEN v0 IS NULL THEN NULL ELSE v0 + (v1 - v0) * (a - a0) / (a1 - a0) END, 6) AS value FROM x"""


@query(_INTERP.format(pxn=PXN, at="rn", unb=UNB, fwd=FWD))
def interp_linear(s, d):
    return rounded(quality.fill(px_null(s, d), "linear"))


@query(_INTERP.format(pxn=PXN, at="date_diff('day', DATE '1970-01-01', ts)", unb=UNB, fwd=FWD))
def interp_time(s, d):
    return rounded(quality.fill(px_null(s, d), "time"))


@query(f"WITH {PXN} SELECT series_id, ts, round(value, 6) AS value FROM pn WHERE value IS NOT NULL")
def drop_missing(s, d):
    return rounded(quality.fill(px_null(s, d), "drop"))


@query(f"WITH {PXN} SELECT series_id, ts, round(coalesce(value, 999), 6) AS value FROM pn")
def fill_constant(s, d):
    return rounded(quality.fill(px_null(s, d), "constant", 999.0))


@query(f"WITH {PXN} SELECT series_id, ts, round(coalesce(last_value(value IGNORE NULLS) OVER {UNB}, 0), 6) AS value FROM pn")
def fill_feature(s, d):
    return rounded(quality.fill(px_null(s, d), "zero_after_ffill"))


# windows


@query(f"WITH {PXN}, f AS (SELECT series_id, ts, last_value(value IGNORE NULLS) OVER {UNB} AS v FROM pn) SELECT series_id, ts, round(v / lag(v, 1) OVER w - 1, 6) AS ret_1, round(v / lag(v, 5) OVER w - 1, 6) AS ret_5 FROM f WINDOW w AS ({W})")
def returns_padded(s, d):
    f = quality.fill(px_null(s, d), "ffill")
    return rounded(f.select("series_id", "ts", o.pct_change("value", 1, S()).alias("ret_1"), o.pct_change("value", 5, S()).alias("ret_5")))


@query(f"WITH {PX} SELECT series_id, ts, round(lag(value, 2) OVER w, 6) AS lag_2, round(lead(value, 3) OVER w, 6) AS lead_3, round(value - lag(value, 5) OVER w, 6) AS diff_5 FROM px WINDOW w AS ({W})")
def lag_lead_diff(s, d):
    return rounded(px(s, d).select("series_id", "ts", F.lag("value", 2).over(S()).alias("lag_2"), F.lead("value", 3).over(S()).alias("lead_3"), o.diff("value", 5, S()).alias("diff_5")))


@query(f"WITH {PXN} SELECT series_id, ts, round({rolled('avg({})', 'value', 5)}, 6) AS mean_5, round({rolled('stddev_samp({})', 'value', 5)}, 6) AS std_5, round({rolled('min({})', 'value', 5)}, 6) AS min_5, round({rolled('max({})', 'value', 5)}, 6) AS max_5 FROM pn")
def rolling_stats(s, d):
    p = px_null(s, d)
    return rounded(p.select("series_id", "ts", *[o.full(f, "value", 5, S()).alias(n) for f, n in ((F.avg, "mean_5"), (F.stddev_samp, "std_5"), (F.min, "min_5"), (F.max, "max_5"))]))


@query(f"WITH {PX} SELECT series_id, ts, round({rolled('quantile_cont({}, 0.5)', 'value', 20)}, 6) AS median_20, round({rolled('quantile_cont({}, 0.75)', 'value', 20)}, 6) AS q75_20 FROM px")
def rolling_quantile(s, d):
    return rounded(px(s, d).select("series_id", "ts", o.rolling_quantile("value", 0.5, 20, S()).alias("median_20"), o.rolling_quantile("value", 0.75, 20, S()).alias("q75_20")))


@query(f"WITH {PX} SELECT series_id, ts, round({rolled('skewness({})', 'value', 20)}, 5) AS skew_20, round({rolled('kurtosis({})', 'value', 20)}, 5) AS kurt_20 FROM px")
def rolling_moments(s, d):
    return rounded(px(s, d).select("series_id", "ts", o.rolling_skew("value", 20, S()).alias("skew_20"), o.rolling_kurtosis("value", 20, S()).alias("kurt_20")), 5)


@query(f"""WITH {PX}, q AS (SELECT series_id, ts, value, list(value) OVER ({W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS l FROM px)
SELECT series_id, ts, CASE WHEN len(l) >= 30 THEN round((len(list_filter(l, lambda x: x < value)) + (len(list_filter(l, lambda x: x = value)) + 1) / 2) / 30, 6) END AS rank_30 FROM q""")
def rolling_rank(s, d):
    return rounded(px(s, d).select("series_id", "ts", o.rolling_rank("value", 30, S()).alias("rank_30")))


@query(f"""WITH {FLOW} SELECT series_id, ts, round(CASE WHEN count(value) OVER f >= 20 THEN corr(value, volume) OVER f END, 6) AS corr_20 FROM fl WINDOW f AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def rolling_corr(s, d):
    return rounded(flow(s, d).select("series_id", "ts", o.rolling_corr("value", "volume", 20, S()).alias("corr_20")))


@query(f"""WITH RECURSIVE {PX}, n AS (SELECT *, row_number() OVER ({W}) AS rn FROM px),
e AS (SELECT series_id, ts, rn, value, value AS y FROM n WHERE rn = 1
  UNION ALL SELECT n.series_id, n.ts, n.rn, n.value, e.y + (2.0 / 13) * (n.value - e.y) FROM e JOIN n ON n.series_id = e.series_id AND n.rn = e.rn + 1)
SELECT series_id, ts, round(y, 4) AS ewma_12 FROM e""")
def ewma(s, d):
    return rounded(o.ewma(px(s, d), [("value", "ewma_12", 12)]).select("series_id", "ts", "ewma_12"), 4)


@query(f"WITH {RET}, k AS (SELECT *, max(value) OVER {UNB} AS peak FROM rt) SELECT series_id, ts, round(value, 6) AS equity, round(peak, 6) AS peak, round((value - peak) / peak, 6) AS drawdown FROM k")
def drawdown(s, d):
    r = returns(s, d).withColumn("peak", F.max("value").over(o.so_far(S())))
    return rounded(r.select("series_id", "ts", F.col("value").alias("equity"), "peak", ((F.col("value") - F.col("peak")) / F.col("peak")).alias("drawdown")))


@query(f"WITH {RET} SELECT series_id, ts, round(sum(ret) OVER {UNB}, 6) AS cum_sum, round(exp(sum(ln(1 + ret)) OVER {UNB}), 6) AS cum_exp, round(max(ret) OVER {UNB}, 6) AS cum_max FROM rt")
def cumulative(s, d):
    r = returns(s, d)
    return rounded(r.select("series_id", "ts", F.sum("ret").over(o.so_far(S())).alias("cum_sum"), F.exp(F.sum(F.ln(1 + F.col("ret"))).over(o.so_far(S()))).alias("cum_exp"), F.max("ret").over(o.so_far(S())).alias("cum_max")))


@query(f"WITH {PX}, g AS (SELECT *, CASE WHEN isodow(ts) = 1 THEN value > lag(value, 5) OVER ({W}) END AS sig FROM px), h AS (SELECT series_id, ts, coalesce(last_value(CASE WHEN isodow(ts) = 1 THEN coalesce(sig, false) END IGNORE NULLS) OVER {UNB}, false) AS held FROM g) SELECT series_id, ts, held, (held AND NOT coalesce(lag(held) OVER ({W}), false)) AS entry, (NOT held AND coalesce(lag(held) OVER ({W}), false)) AS exit FROM h")
def monday_hold(s, d):
    from ..operators import signals

    p = px(s, d).withColumn("_up", F.col("value") > F.lag("value", 5).over(S()))
    p = p.withColumn("_pos", signals.hold_mondays(F.col("_up")))
    return signals.edges(p).select("series_id", "ts", (F.col("position") == 1).alias("held"), "entry", "exit")


@query(f"WITH {PX}, n AS (SELECT *, row_number() OVER ({W}) AS rn, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS back FROM px) SELECT series_id, ts, round(value, 6) AS value, CASE WHEN back <= 3 THEN 'tail' ELSE 'slice' END AS part FROM n WHERE back <= 3 OR rn BETWEEN 11 AND 20")
def positional_slice(s, d):
    n = px(s, d).withColumns({"rn": F.row_number().over(S()), "back": F.row_number().over(o.Window.partitionBy("series_id").orderBy(F.col("ts").desc()))})
    return rounded(n.where("back <= 3 or rn between 11 and 20").select("series_id", "ts", "value", F.when(F.col("back") <= 3, "tail").otherwise("slice").alias("part")))


# calendars and joins

_FRI = "CAST(ts + CAST(((5 - isodow(ts) + 7) % 7) AS INTEGER) AS DATE)"


def _resample_sql(period: str, grid: str, agg: str, fill: bool = True) -> str:
    value = "last_value(b.value IGNORE NULLS) OVER (PARTITION BY g.series_id ORDER BY g.p)" if fill else "b.value"
    return f"""WITH {PXN}, b AS (SELECT series_id, {period} AS p, {agg} AS value FROM pn GROUP BY ALL),
m AS (SELECT series_id, min(p) AS lo, max(p) AS hi FROM b GROUP BY series_id),
g AS (SELECT series_id, CAST({grid} AS DATE) AS p FROM m)
SELECT g.series_id, g.p AS ts, round({value}, 6) AS value FROM g LEFT JOIN b ON g.series_id = b.series_id AND g.p = b.p"""


_WEEKS = "unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY))"
_MONTHS = "last_day(CAST(unnest(generate_series(date_trunc('month', CAST(lo AS TIMESTAMP)), date_trunc('month', CAST(hi AS TIMESTAMP)), INTERVAL {} MONTH)) AS DATE))"


@query(_resample_sql(_FRI, _WEEKS, "arg_max(value, ts) FILTER (value IS NOT NULL)"))
def resample_weekly(s, d):
    return rounded(align.resample(px_null(s, d), "W", "last"))


@query(_resample_sql("last_day(ts)", _MONTHS.format(1), "avg(value)"))
def resample_month_mean(s, d):
    return rounded(align.resample(px_null(s, d), "M", "mean"))


@query(_resample_sql("last_day(CAST(date_trunc('quarter', ts) + INTERVAL 2 MONTH AS DATE))", _MONTHS.format(3), "coalesce(sum(value), 0)", False))
def resample_quarter_sum(s, d):
    return rounded(align.resample(px_null(s, d), "Q", "sum"))


@query(_resample_sql("last_day(ts)", _MONTHS.format(1), "arg_min(value, ts) FILTER (value IS NOT NULL)"))
def resample_month_first(s, d):
    return rounded(align.resample(px_null(s, d), "M", "first"))


@query(f"""WITH {PX}, m AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM px GROUP BY series_id),
g AS (SELECT series_id, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ts FROM m)
SELECT g.series_id, g.ts, round(last_value(px.value IGNORE NULLS) OVER (PARTITION BY g.series_id ORDER BY g.ts), 6) AS value FROM g LEFT JOIN px ON g.series_id = px.series_id AND g.ts = px.ts""")
def densify_daily(s, d):
    return rounded(align.daily(px(s, d)))


_SPARSE = "sp AS (SELECT * FROM px WHERE day(ts) = 15)"


@query(f"WITH {PX}, {_SPARSE} SELECT px.series_id, px.ts, round(px.value, 6) AS value, sp.ts AS matched_at, round(sp.value, 6) AS matched FROM px ASOF LEFT JOIN sp ON px.series_id = sp.series_id AND px.ts >= sp.ts")
def asof_join(s, d):
    p = px(s, d)
    return rounded(align.asof(p, p.where(F.dayofmonth("ts") == 15)))


@query(f"WITH {PX}, {_SPARSE} SELECT px.series_id, px.ts, round(px.value, 6) AS value, sp.ts AS matched_at, round(sp.value, 6) AS matched FROM px ASOF LEFT JOIN sp ON px.series_id = sp.series_id AND px.ts <= sp.ts")
def asof_forward(s, d):
    p = px(s, d)
    return rounded(align.asof(p, p.where(F.dayofmonth("ts") == 15), direction="forward"))


@query(f"""WITH {PX}, t AS (SELECT DISTINCT ts FROM px), n AS (SELECT DISTINCT series_id FROM px), c AS (SELECT n.series_id, t.ts, px.value FROM t CROSS JOIN n LEFT JOIN px ON px.series_id = n.series_id AND px.ts = t.ts)
SELECT series_id, ts, round(last_value(value IGNORE NULLS) OVER {UNB}, 6) AS value FROM c""")
def outer_merge(s, d):
    p = px(s, d)
    parts = [p.where(F.col("series_id") < "3"), p.where(F.col("series_id") >= "3")]
    return rounded(quality.fill(align.complete(align.merge(*parts)), "ffill"))


@query(f"WITH {PX} SELECT a.ts, round(a.value, 6) AS a, round(b.value, 6) AS b FROM px a JOIN px b ON a.ts = b.ts WHERE a.series_id = '1-URGENT' AND b.series_id = '2-HIGH'")
def inner_align(s, d):
    p = px(s, d)
    a, b = (p.where(F.col("series_id") == x).select("ts", F.col("value").alias(n)) for x, n in (("1-URGENT", "a"), ("2-HIGH", "b")))
    return rounded(a.join(b, "ts"))


@query(f"WITH {PX} SELECT a.series_id, a.ts, coalesce(b.value > 150000, false) AS sig FROM px a LEFT JOIN (SELECT * FROM px WHERE day(ts) <= 10) b ON a.series_id = b.series_id AND a.ts = b.ts")
def left_default(s, d):
    p = px(s, d)
    b = p.where(F.dayofmonth("ts") <= 10).select("series_id", "ts", (F.col("value") > 150_000).alias("sig"))
    return p.select("series_id", "ts").join(b, ["series_id", "ts"], "left").withColumn("sig", F.coalesce("sig", F.lit(False)))


@query(f"WITH {PX}, k AS (SELECT ts, count(*) AS n FROM px GROUP BY ts) SELECT ts FROM k WHERE n = (SELECT count(DISTINCT series_id) FROM px)")
def common_dates(s, d):
    p, out = px(s, d), None
    for name in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"):
        t = p.where(F.col("series_id") == name).select("ts")
        out = t if out is None else out.intersect(t)
    return out


@query(f"WITH {PX} (SELECT ts FROM px WHERE series_id = '1-URGENT' EXCEPT SELECT ts FROM px WHERE series_id = '5-LOW')")
def dates_except(s, d):
    p = px(s, d)
    return p.where("series_id = '1-URGENT'").select("ts").exceptAll(p.where("series_id = '5-LOW'").select("ts")).distinct()


@query(f"WITH {PXN}, k AS (SELECT ts FROM pn WHERE value IS NOT NULL GROUP BY ts HAVING count(DISTINCT series_id) = (SELECT count(DISTINCT series_id) FROM pn)) SELECT series_id, ts, round(value, 6) AS value FROM pn WHERE ts >= (SELECT min(ts) FROM k) OR NOT EXISTS (SELECT 1 FROM k)")
def align_start(s, d):
    return rounded(select.align_start(px_null(s, d)))


@query(f"WITH {PXN} SELECT series_id, ts, round(value, 6) AS value FROM pn WHERE ts >= (SELECT max(f) FROM (SELECT min(ts) AS f FROM pn WHERE value IS NOT NULL GROUP BY series_id) q)")
def common_start(s, d):
    return rounded(select.common_start(px_null(s, d)))


_IV = "iv AS (SELECT series_id, ts AS t0, coalesce(lead(ts, 7) OVER (PARTITION BY series_id ORDER BY ts), max(ts) OVER (PARTITION BY series_id)) AS t1 FROM px), tb AS (SELECT * FROM iv WHERE month(t0) = 6 AND day(t0) <= 10)"


@query(f"WITH {PX}, {_IV} SELECT a.series_id, a.t0, a.t1 FROM iv a WHERE NOT EXISTS (SELECT 1 FROM tb b WHERE a.series_id = b.series_id AND a.t0 <= b.t1 AND b.t0 <= a.t1)")
def overlap_anti_join(s, d):
    from ..operators import validation

    iv = validation.intervals(px(s, d), 7).select("series_id", "t0", "t1")
    return align.overlapping(iv, iv.where((F.month("t0") == 6) & (F.dayofmonth("t0") <= 10)), anti=True)


@query(f"WITH {PX}, {_IV} SELECT a.series_id, a.t0, a.t1 FROM iv a WHERE EXISTS (SELECT 1 FROM tb b WHERE a.series_id = b.series_id AND a.t0 <= b.t1 AND b.t0 <= a.t1)")
def overlap_semi_join(s, d):
    from ..operators import validation

    iv = validation.intervals(px(s, d), 7).select("series_id", "t0", "t1")
    return align.overlapping(iv, iv.where((F.month("t0") == 6) & (F.dayofmonth("t0") <= 10)))


@query("SELECT row_number() OVER (ORDER BY a.i, b.i) - 1 AS param_id, a.fast, b.slow FROM (VALUES (0, 5.0::DOUBLE), (1, 10.0::DOUBLE)) a(i, fast) CROSS JOIN (VALUES (0, 20.0::DOUBLE), (1, 30.0::DOUBLE), (2, 60.0::DOUBLE)) b(i, slow)")
def parameter_grid(s, d):
    return align.grid(s, {"fast": [5, 10], "slow": [20, 30, 60]})


@query(f"WITH {PX}, t AS (SELECT ts, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS v FROM px GROUP BY ts) SELECT ts, CAST(sum(v) OVER (ORDER BY ts) AS BIGINT) AS running FROM t")
def running_total(s, d):
    t = px(s, d).groupBy("ts").agg(F.sum(F.round("value").cast("long")).alias("v"))
    return align.cumulative_over_all(t, "ts", "v", 16).select("ts", "running")


# selection


@query(f"WITH {META} SELECT series_id, ts, round(value, 6) AS value FROM px WHERE series_id IN (SELECT series_id FROM meta WHERE asset_class = 'rates')")
def class_filter(s, d):
    return rounded(select.by_class(px(s, d), meta(s, d), include=["rates"]))


@query(f"WITH {META} SELECT series_id, ts, round(value, 6) AS value FROM px")
def class_filter_no_match(s, d):
    return rounded(select.by_class(px(s, d), meta(s, d), include=["no such class"]))


@query(f"WITH {META} SELECT series_id, ts, round(value, 6) AS value FROM px WHERE series_id IN (SELECT series_id FROM meta WHERE asset_class <> 'credit' OR series_id = '3-MEDIUM')")
def column_filter(s, d):
    return rounded(select.by_series(px(s, d), meta(s, d), include={"credit": ["3-MEDIUM"]}))


@query(f"WITH {PX} SELECT series_id, ts, round(value, 6) AS value FROM px WHERE ts BETWEEN DATE '1996-01-10' AND DATE '1996-03-20'")
def date_filter(s, d):
    return rounded(select.between(px(s, d), "1996-01-10", "1996-03-20"))


@query(f"""WITH {PX} SELECT ts, round(max(CASE WHEN series_id = '1-URGENT' THEN value END), 6) AS urgent, round(max(CASE WHEN series_id = '2-HIGH' THEN value END), 6) AS high, round(max(CASE WHEN series_id = '5-LOW' THEN value END), 6) AS low FROM px GROUP BY ts""")
def pivot_rename(s, d):
    w = select.wide(px(s, d), ["1-URGENT", "2-HIGH", "5-LOW"])
    return rounded(w.withColumnsRenamed({"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"}))


@query(f"WITH {META}, s AS (SELECT DISTINCT series_id FROM px) SELECT s.series_id, coalesce(m.asset_class, 'other') AS asset_class, coalesce(m.ordinal, 1000000) AS ordinal FROM s LEFT JOIN meta m ON s.series_id = m.series_id")
def ordered_columns(s, d):
    return select.ordered_columns(px(s, d), meta(s, d))


@query("SELECT p_partkey, TRY_CAST(CASE WHEN p_partkey % 10 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS DOUBLE) AS size FROM part")
def numeric_coercion(s, d):
    from .views import table

    t = table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("size"))
    return select.numeric(t, ["size"])


@query(f"WITH {PXN} SELECT series_id, ts, CASE WHEN value IS NOT NULL THEN round(least(greatest(value, 100000), 180000), 6) END AS value FROM pn")
def clip(s, d):
    return rounded(px_null(s, d).withColumn("value", quality.clip(F.col("value"), 100_000.0, 180_000.0)))


@query(f"WITH {FLOW} SELECT series_id, ts, round(high - low, 6) AS spread, round(CASE WHEN low <> 0 THEN high / low END, 6) AS ratio, round(value, 6) AS level FROM fl")
def derived_columns(s, d):
    return rounded(flow(s, d).select("series_id", "ts", (F.col("high") - F.col("low")).alias("spread"), F.try_divide("high", "low").alias("ratio"), F.col("value").alias("level")))


@query("SELECT DISTINCT o_orderpriority AS name, CASE WHEN contains(o_orderpriority, 'mom') THEN 'momentum' WHEN contains(o_orderpriority, 'vol') THEN 'volatility' WHEN contains(o_orderpriority, 'spread') THEN 'spread' WHEN contains(o_orderpriority, 'z') THEN 'zscore' WHEN contains(o_orderpriority, 'URGENT') THEN 'urgent' ELSE 'other' END AS category FROM orders")
def categorise(s, d):
    from .views import table

    return table(s, d, "orders").select(F.col("o_orderpriority").alias("name")).distinct().withColumn("category", select.category(F.col("name")))


@query(f"WITH {FLOW} SELECT series_id, ts, (volume > 100 AND value <= 40000) AS hit FROM fl")
def rule_predicate(s, d):
    return flow(s, d).select("series_id", "ts", select.rule("(volume > 100) & (value <= 40000)").alias("hit"))


# outliers, gaps, bad points, quality

_IQR = "q AS (SELECT series_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM pn GROUP BY series_id), b AS (SELECT series_id, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q WHERE q3 > q1)"
_Z = "b AS (SELECT series_id, avg(value) - 2 * stddev_samp(value) AS low, avg(value) + 2 * stddev_samp(value) AS high FROM pn GROUP BY series_id)"


@query(f"WITH {PXN}, {_IQR} SELECT pn.series_id, ts, round(value, 6) AS value, coalesce(value < low OR value > high, false) AS is_outlier FROM pn LEFT JOIN b ON pn.series_id = b.series_id")
def outlier_iqr(s, d):
    return rounded(quality.outliers(px_null(s, d), "flag", "iqr"))


@query(f"WITH {PXN}, {_Z} SELECT pn.series_id, ts, round(value, 6) AS value, coalesce(value < low OR value > high, false) AS is_outlier FROM pn LEFT JOIN b ON pn.series_id = b.series_id")
def outlier_z(s, d):
    return rounded(quality.outliers(px_null(s, d), "flag", "z", 2.0))


@query(f"WITH {PXN}, {_Z}, x AS (SELECT DISTINCT ts FROM pn JOIN b ON pn.series_id = b.series_id WHERE value < low OR value > high) SELECT series_id, ts, round(value, 6) AS value FROM pn WHERE ts NOT IN (SELECT ts FROM x)")
def outlier_remove(s, d):
    return rounded(quality.outliers(px_null(s, d), "remove", "z", 2.0))


@query(f"WITH {PXN}, {_IQR} SELECT pn.series_id, ts, CASE WHEN value IS NOT NULL THEN round(least(greatest(value, low), high), 6) END AS value FROM pn LEFT JOIN b ON pn.series_id = b.series_id")
def outlier_clip(s, d):
    return rounded(quality.outliers(px_null(s, d), "clip", "iqr"))


@query(f"WITH {PXN}, g AS (SELECT series_id, ts, CAST(date_diff('day', lag(ts) OVER ({W}), ts) AS INTEGER) AS days FROM pn WHERE value IS NOT NULL) SELECT * FROM g WHERE days > 3")
def gaps(s, d):
    return quality.gaps(px_null(s, d), 3)


@query(f"""WITH {PX}, n AS (SELECT *, row_number() OVER ({W}) AS rn FROM px),
a AS (SELECT *, CASE WHEN rn % 50 = 10 THEN 'use_previous' WHEN rn % 50 = 30 THEN 'interpolate' END AS action FROM n),
c AS (SELECT *, CASE WHEN action IS NULL THEN value END AS clean, date_diff('day', DATE '1970-01-01', ts) AS day FROM a),
x AS (SELECT *, last_value(clean IGNORE NULLS) OVER {UNB} AS v0, first_value(clean IGNORE NULLS) OVER {FWD} AS v1, last_value(CASE WHEN clean IS NOT NULL THEN day END IGNORE NULLS) OVER {UNB} AS d0, first_value(CASE WHEN clean IS NOT NULL THEN day END IGNORE NULLS) OVER {FWD} AS d1, lag(value) OVER ({W}) AS prev FROM c)
SELECT series_id, ts, round(CASE action WHEN 'use_previous' THEN prev WHEN 'interpolate' THEN coalesce(v0 + (v1 - v0) * (day - d0) / (d1 - d0), v0) ELSE value END, 6) AS value FROM x""")
def bad_points(s, d):
    p = px(s, d)
    rn = F.row_number().over(S())
    points = p.select("series_id", "ts", F.when(rn % 50 == 10, "use_previous").when(rn % 50 == 30, "interpolate").alias("action")).where("action is not null")
    return rounded(quality.repair(p, points))


@query(f"WITH {PXN} SELECT series_id, (count(value) > 0 AND bool_or(value > 0)) AS is_valid FROM pn GROUP BY series_id")
def price_validity(s, d):
    return quality.price_validity(px_null(s, d))


@query(f"WITH {PXN} SELECT series_id, count(*) AS n_rows, count(*) - count(value) AS n_missing, round(count(value) / count(*), 6) AS completeness FROM pn GROUP BY series_id")
def completeness(s, d):
    return rounded(quality.completeness(px_null(s, d)))


@query(f"WITH {META}, {PXN[len(PX) + 2 :]} SELECT coalesce(asset_class, 'other') AS asset_class, count(DISTINCT pn.series_id) AS n_series, count(*) - count(value) AS n_missing, round(100 * (count(*) - count(value)) / count(*), 6) AS missing_pct FROM pn LEFT JOIN meta ON pn.series_id = meta.series_id GROUP BY 1")
def missing_by_class(s, d):
    return rounded(quality.missing_by_class(px_null(s, d), meta(s, d)))


@query(f"""WITH {PXN}, g AS (SELECT series_id, CAST(date_diff('day', lag(ts) OVER ({W}), ts) AS INTEGER) AS gap FROM pn WHERE value IS NOT NULL),
a AS (SELECT series_id, count(*) AS n_rows, avg(gap) AS avg_gap, median(gap) AS median_gap, min(gap) AS min_gap, max(gap) AS max_gap FROM g GROUP BY series_id)
SELECT series_id, n_rows, round(avg_gap, 6) AS avg_gap, round(median_gap, 6) AS median_gap, min_gap, max_gap, CASE WHEN n_rows >= 4000 THEN 'DAILY' WHEN avg_gap >= 25 THEN 'MONTHLY' WHEN avg_gap >= 4 THEN 'WEEKLY' WHEN avg_gap < 4 THEN 'DAILY' ELSE 'SPARSE' END AS frequency,
CASE WHEN n_rows >= 4000 THEN false WHEN avg_gap >= 4 THEN true WHEN avg_gap < 4 THEN false ELSE true END AS needs_fill FROM a""")
def frequency_class(s, d):
    return rounded(quality.frequency(px_null(s, d)))


@query(f"""WITH {PX} SELECT series_id, round(max(value), 6) AS high, (SELECT min(ts) FROM px q WHERE q.series_id = p.series_id AND q.value = max(p.value)) AS high_date, round(min(value), 6) AS low,
(SELECT min(ts) FROM px q WHERE q.series_id = p.series_id AND q.value = min(p.value)) AS low_date, round(max(value) - min(value), 6) AS range, round(100 * (max(value) - min(value)) / min(value), 6) AS range_pct FROM px p GROUP BY series_id""")
def high_low(s, d):
    return rounded(quality.high_low(px(s, d)))


@query(f"WITH {PXN} SELECT series_id, round(count(value) / count(*), 6) AS share, CASE WHEN count(value) = 0 THEN 'failed' WHEN count(value) / count(*) < 0.5 THEN 'partial' ELSE 'success' END AS status FROM pn GROUP BY series_id")
def coverage_gate(s, d):
    return rounded(quality.coverage(px_null(s, d)))


@query(f"""WITH {PX} SELECT series_id, count(value) AS value_count, round(avg(value), 4) AS value_mean, round(stddev_samp(value), 4) AS value_std, round(min(value), 4) AS value_min, round(quantile_cont(value, 0.25), 4) AS value_q25, round(quantile_cont(value, 0.5), 4) AS value_q50, round(quantile_cont(value, 0.75), 4) AS value_q75, round(max(value), 4) AS value_max, round(skewness(value), 4) AS value_skew, round(kurtosis(value), 4) AS value_kurt FROM px GROUP BY series_id""")
def profile(s, d):
    return rounded(quality.profile(px(s, d)), 4)


@query("SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY o_orderstatus")
def value_counts(s, d):
    from .views import table

    return table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("n_customers"))


@query("SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25) q")
def top_k(s, d):
    from .views import table

    return table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@query("SELECT o_orderkey, lower(split_part(o_orderpriority, '-', 2)) AS tail, upper(o_orderstatus) AS status, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS wd, strftime(o_orderdate, '%Y-%m') AS ym, sqrt(o_totalprice) > 300 AS big, CAST(sign(o_totalprice - 150000) AS DOUBLE) AS s, CAST(trunc(o_totalprice / 1000) AS INTEGER) AS k, CAST(ceil(o_totalprice / 1000) AS BIGINT) AS kc FROM orders")
def scalars(s, d):
    from .views import table

    p = F.col("o_totalprice")
    return table(s, d, "orders").select("o_orderkey", F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))).alias("tail"), F.upper("o_orderstatus").alias("status"), F.year("o_orderdate").alias("y"), F.weekday("o_orderdate").alias("wd"), F.date_format("o_orderdate", "yyyy-MM").alias("ym"), (F.sqrt(p) > 300).alias("big"), F.signum(p - 150_000).alias("s"), (p / 1000).cast("int").alias("k"), F.ceil(p / 1000).alias("kc"))
