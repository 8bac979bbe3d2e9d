"""Boosting that stops, clusters of features, meta-labels, imbalance bars, tails, attribution and baskets against plain
Python."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import attribution, bars, baskets, boosting, extremes, features, importance, learn, meta_labels, signals, validation

D0 = dt.date(2020, 1, 1)


def frame(spark, cols, name="a", start=D0):
    """series_id, ts and columns of equal length."""
    n = len(next(iter(cols.values())))
    rows = [(name, start + dt.timedelta(days=i), *[None if v[i] is None else float(v[i]) for v in cols.values()]) for i in range(n)]
    return spark.createDataFrame(rows, "series_id string, ts date, " + ", ".join(f"{c} double" for c in cols))


@pytest.fixture(scope="module")
def learnable(spark):
    """A series whose next move is mostly told by x, and not at all by z."""
    rng = np.random.default_rng(0)
    x, z = rng.normal(size=300), rng.normal(size=300)
    steps = np.concatenate([[0], 0.01 * np.sign(x[:-1] + 0.3 * rng.normal(size=299))])
    return frame(spark, {"value": 100 * np.exp(np.cumsum(steps)), "x": x, "z": z})


# boosting


def test_boosting_stops_and_keeps_the_best_rounds(spark, learnable):
    rows = boosting.judged(learnable, 1)
    fitted = boosting.fit_until(rows, ["x", "z"], 60, 0.02, stepSize=0.3, maxDepth=2)
    n = boosting.rounds_kept(fitted)
    assert 1 <= n < 60
    longer = learn.model("boosting", ["x", "z"], maxIter=60, **(boosting.SETTINGS | {"stepSize": 0.3, "maxDepth": 2})).fit(rows.where("part = 'train'"))
    assert longer.stages[-1].getNumTrees == 60
    # the kept rounds are the first ones, and each betters the loss of the rows that judge by enough
    losses = boosting.loss_by_round(fitted, rows)
    assert len(losses) == n and all(b <= a for a, b in zip(losses, losses[1:], strict=False))
    d = boosting.margins(fitted, rows)
    got = d.select(F.size("margins").alias("n"), F.element_at("margins", -1).alias("m")).collect()
    want = fitted.transform(rows).select("rawPrediction").collect()
    assert all(g.n == n and g.m == pytest.approx(w.rawPrediction[1]) for g, w in zip(got, want, strict=True))


def test_boosting_on_noise_keeps_few_rounds(spark):
    rng = np.random.default_rng(2)
    d = frame(spark, {"value": 100 + rng.normal(size=200), "x": rng.normal(size=200)})
    assert boosting.rounds_kept(boosting.fit_until(boosting.judged(d, 1), ["x"], 40, 0.01, stepSize=0.3)) < 10


def test_round_auc_is_the_share_of_ordered_pairs(spark, learnable):
    rows = boosting.judged(learnable, 1)
    fitted = boosting.fit_until(rows, ["x", "z"], 5, 0.001, stepSize=0.3, maxDepth=2)
    got = {(r.part, r["round"]): r.auc for r in boosting.round_auc(fitted, rows).collect()}
    for part in ("train", "test"):
        s = boosting.margins(fitted, rows).where(F.col("part") == part).select("label", "margins").collect()
        for k in range(boosting.rounds_kept(fitted)):
            pos, neg = ([r.margins[k] for r in s if r.label == y] for y in (1, 0))
            assert got[part, k + 1] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]))
    best = boosting.best_rounds(boosting.round_auc(fitted, rows)).first()
    assert best.auc == max(v for (p, _), v in got.items() if p == "test")


def test_horizons_each_have_a_model_and_a_threshold(spark, learnable):
    fitted, scored = boosting.horizons(learnable, ["x", "z"], (1, 2), 5, stepSize=0.3, maxDepth=2)
    swept = boosting.sweeps(scored, (1, 2))
    assert set(fitted) == {1, 2} and {r.horizon for r in swept.where("best").collect()} == {1, 2}
    out = boosting.strategy(scored, swept, (1, 2)).orderBy("ts").collect()
    t = swept.where("best and horizon = 1").first().threshold
    assert [r.position for r in out] == [int(r.p > t) for r in out]
    assert boosting.gains(fitted[1], ["x", "z"])[0][0] == "x"


# importance


def plain_merges(dist):
    groups, out = [[i] for i in range(len(dist))], []
    while True:
        own = np.zeros(len(dist), int)
        for g in groups:
            own[g] = min(g)
        out.append(own)
        if len(groups) == 1:
            return out
        pairs = [(np.mean([dist[i, j] for i in a for j in b]), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y]
        _, x, y = min(pairs)
        groups[x] += groups.pop(y)


def plain_silhouette(dist, own, i):
    same = [dist[i, j] for j in range(len(own)) if j != i and own[j] == own[i]]
    if not same:
        return 0.0
    a, b = np.mean(same), min(np.mean(dist[i, own == k]) for k in set(own.tolist()) - {own[i]})
    return (b - a) / max(a, b)


def test_clusters_match_brute_force():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 4))
    x = np.stack([base[:, i % 4] * 1.0 + 0.4 * rng.normal(size=400) for i in range(13)], axis=1)
    names = [f"f{i}" for i in range(13)]
    c = np.corrcoef(x.T)
    d = importance.distance(c)
    for a, b in zip(importance.merges(d), plain_merges(d), strict=True):
        assert a.tolist() == b.tolist()
        if 1 < len(set(b.tolist())) < 13:
            np.testing.assert_allclose(importance.silhouettes(d, a), [plain_silhouette(d, b, i) for i in range(13)], atol=1e-9)
    assert importance.clusters(c, names) == [[f"f{i}" for i in range(k, 13, 4)] for k in range(4)]
    assert importance.clusters(np.eye(2), ["p", "q"]) == [["p"], ["q"]]


def test_correlation_is_one_pass_over_whole_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2))
    d = frame(spark, {"a": [None, *x[:, 0]], "b": [3.0, *x[:, 1]], "c": [1.0] * 61})
    c = importance.correlation(d, ["a", "b", "c"])
    assert c[0, 1] == pytest.approx(np.corrcoef(x.T)[0, 1]) and c[0, 2] == 0 and c[2, 2] == 1


def test_a_cluster_is_permuted_by_one_order(spark, learnable):
    d = learnable.withColumn("twin", F.col("x") * 2)
    out = importance.dealt_anew(d, ["x", "twin"]).orderBy("ts").collect()
    old = d.orderBy("ts").collect()
    assert all(r.twin == 2 * r.x for r in out) and sorted(r.x for r in out) == sorted(r.x for r in old)
    assert sum(a.x != b.x for a, b in zip(out, old, strict=True)) > 250 and [r.z for r in out] == [r.z for r in old]


def test_twins_matter_together_only(spark, learnable):
    """A feature and its twin stand in for one another; together they are what the model knows."""
    d = learn.split(signals.labels(learnable, 1)).withColumn("twin", F.col("x") + 0.01 * F.col("z"))
    names = ["x", "twin", "z"]
    fitted = learn.model("logit", names, n_train=200).fit(d.where("part = 'train'"))
    groups = importance.clusters(importance.correlation(d, names), names)
    assert groups == [["x", "twin"], ["z"]]
    got = importance.clustered(fitted, d.where("part = 'test'"), groups).orderBy("cluster").collect()
    assert got[0].accuracy_drop > 0.2 > abs(got[1].accuracy_drop) and got[0].loss_rise > got[1].loss_rise
    one = {r.feature: r for r in importance.single(d.where("part = 'train'"), d.where("part = 'test'"), names, n_train=200).collect()}
    assert one["x"].auc > 0.8 and one["twin"].auc > 0.8 and one["z"].auc < 0.65


# meta-labels


def test_meta_labels_and_bets(spark):
    d = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.1, 0), (0.1, 1), (0.5, 1)], "p double, label int")
    d = d.withColumn("side", meta_labels.sides(F.col("p"), 0.1)).withColumn("meta", meta_labels.meta_label(F.col("side"), F.col("label")))
    assert [(r.side, r.meta) for r in d.collect()] == [(1, 1), (1, 0), (-1, 1), (-1, 0), (0, None)]
    b = meta_labels.bet_sizes(spark.createDataFrame([(0.5, 1), (0.3, -1), (0.8, -1), (1.0, 1)], "p_meta double, side int")).collect()
    z = 0.3 / math.sqrt(0.16)
    assert [r.bet for r in b] == pytest.approx([0, 0, -math.erf(z / math.sqrt(2)), 1])


def test_bets_know_nothing_of_their_fold(spark, learnable):
    """Values from a fold's first row on, and so its labels, turned round: what the models say of it stays."""
    base = {(r.ts, r.fold): (r.p, r.p_meta) for r in meta_labels.bets(learnable, ["x", "z"], 1, k=2, n_train=200).collect()}
    assert len(base) > 250
    last = validation.purged_folds(learnable, 2).where("fold = 1 and role = 'test'").agg(F.min("ts")).first()[0]
    other = learnable.withColumn("value", F.when(F.col("ts") > last, 20000 / F.col("value")).otherwise(F.col("value")))
    got = {(r.ts, r.fold): (r.p, r.p_meta) for r in meta_labels.bets(other, ["x", "z"], 1, k=2, n_train=200).collect()}
    own = [k for k in base if k[1] == 1]
    assert len(own) > 100 and all(got[k] == pytest.approx(base[k]) for k in own)
    assert any(got.get(k) != pytest.approx(base[k]) for k in base if k[1] == 0)


# bars


def test_imbalance_bars_by_hand(spark):
    side = [1, 1, 1, -1, 1, 1, 1, 1, -1, -1, -1, -1, -1, 1, 1]
    price = 10 + np.cumsum(side)
    d = frame(spark, {"price": price, "volume": [2.0] * 15})
    fixed = bars.imbalance_bars(d, 6, 0.5, 0.0, 0.0).orderBy("bar").collect()
    assert [(r.theta, r.threshold, r.ticks) for r in fixed] == [(3, 3, 3), (3, 3, 5), (-3, 3, 3)]
    own, t, b, theta, n = [], 6.0, 0.5, 0.0, 0
    for s in side:
        theta, n = theta + 2 * s, n + 1
        if abs(theta) >= t * abs(b):
            own.append((theta, t * abs(b), n))
            t, b, theta, n = t + 0.5 * (n - t), b + 0.25 * (theta / n - b), 0.0, 0
    got = bars.imbalance_bars(d, 6, 0.5, 0.5, 0.25, volume=True).orderBy("bar").collect()
    assert [(r.theta, r.threshold, r.ticks) for r in got] == [pytest.approx(x) for x in own] and len(own) > 3
    assert bars.imbalance_bars(d.limit(0), 6, 0.5).count() == 0


# tails


def test_tail_of_a_pareto(spark):
    rng = np.random.default_rng(7)
    loss = 0.01 * rng.pareto(3.0, 4000) + 0.01
    r = extremes.tail(frame(spark, {"ret": -loss}), 400, (0.99,)).first()
    s = np.sort(loss)[::-1]
    u, over = s[400], s[:400] - s[400]
    assert r.n == 4000 and r.threshold == pytest.approx(u) and r.hill == pytest.approx(np.mean(np.log(s[:400] / u)))
    assert r.pickands == pytest.approx(math.log2((s[99] - s[199]) / (s[199] - s[399])))
    q = over.mean() ** 2 / over.var(ddof=1)
    assert r.shape == pytest.approx((1 - q) / 2) and r.scale == pytest.approx(over.mean() * (q + 1) / 2)
    assert r.hill == pytest.approx(1 / 3, abs=0.06) and r.var_99 == pytest.approx(np.quantile(loss, 0.99), rel=0.1)
    assert r.es_99 == pytest.approx(loss[loss > r.var_99].mean(), rel=0.2)


def test_tail_edges(spark):
    assert extremes.tail(frame(spark, {"ret": [0.1] * 5}), 40).count() == 0
    r = extremes.tail(frame(spark, {"ret": [0.01, None] * 50}), 8).first()
    assert r.hill is None and r.pickands is None and r.shape is None and r.threshold == -0.01


# attribution


def test_factors_match_least_squares(spark):
    rng = np.random.default_rng(8)
    f = rng.normal(size=(90, 3))
    y = 0.001 + f @ [0.5, -0.2, 0.1] + 0.01 * rng.normal(size=90)
    fac = frame(spark, {"m": f[:, 0], "v": f[:, 1], "w": f[:, 2]}).drop("series_id")
    ret = frame(spark, {"ret": y}).union(frame(spark, {"ret": y[:3]}, "few"))
    got = {r.series_id: r for r in attribution.factor_attribution(ret, fac, ["m", "v", "w"]).collect()}
    x = np.column_stack([np.ones(90), f])
    w, rest, *_ = np.linalg.lstsq(x, y, rcond=None)
    a = got["a"]
    assert [a.alpha / 252, a.beta_m, a.beta_v, a.beta_w] == pytest.approx(w)
    assert a.r2 == pytest.approx(1 - rest[0] / ((y - y.mean()) ** 2).sum()) and a.specific == pytest.approx(math.sqrt(rest[0] / 86 * 252))
    assert a.alpha + a.part_m + a.part_v + a.part_w == pytest.approx(y.mean() * 252)
    assert got["few"].alpha is None and got["few"].n == 3
    twin = attribution.factor_attribution(ret, fac.withColumn("v", F.col("m") * 2), ["m", "v"]).where("series_id = 'a'").first()
    assert twin.beta_m is None


def test_brinson_adds_up(spark):
    rng = np.random.default_rng(9)
    rows, active = [], 0.0
    for i in range(30):
        w, b, r = rng.dirichlet(np.ones(5)), rng.dirichlet(np.ones(5)), rng.normal(size=5)
        if i % 3 == 0:
            w[4], b[0] = 0, 0
            w, b = w / w.sum(), b / b.sum()
        active += w @ r - b @ r
        rows += [(D0 + dt.timedelta(days=i), "uvvxy"[j], float(r[j]), float(w[j]), float(b[j])) for j in range(5)]
    got = attribution.brinson(spark.createDataFrame(rows, "ts date, asset_class string, ret double, weight double, bench_weight double")).collect()
    assert sum(r.total for r in got) == pytest.approx(active) and len(got) == 4
    assert {r.asset_class: r.interaction for r in got}["u"] != 0


# baskets


def test_basket_by_hand(spark):
    day = lambda i: D0 + dt.timedelta(days=i)
    rows = [("k", day(0), "a", 10.0, 1.0, 0.0), ("k", day(0), "b", 5.0, 1.0, None), ("k", day(1), "a", 11.0, None, 0.2), ("k", day(1), "b", None, None, 0.0), ("k", day(2), "a", 12.0, 0.0, 0.0), ("k", day(2), "b", 4.0, 1.0, 0.0), ("k", day(3), "b", 6.0, None, 0.0)]
    got = baskets.basket_value(spark.createDataFrame(rows, "basket_id string, ts date, series_id string, price double, weight double, carry double"), 0.01, 100.0).orderBy("ts").collect()
    # 5 a and 10 b; a up 1 and pays 0.2; a up 1, b down 1: 101 after cost 99 + 6 + ...
    v0, v1 = 100 - 1.0, 100 - 1.0 + 5 * 1.2
    v2 = v1 + 5 * 1 - 10 * 1
    traded = 5 * 12 + abs(v2 / 4 - 10) * 4
    assert [r.value for r in got] == pytest.approx([v0, v1, v2 - 0.01 * traded, v2 - 0.01 * traded + v2 / 4 * 2])
    assert [r.traded for r in got] == pytest.approx([100, 0, traded, 0])


def test_rolls_make_no_jump(spark):
    days = [D0 + dt.timedelta(days=i) for i in range(20)]
    rows = [("f", t, dt.date(2020, 1, 1 if i < 10 else 11), 100.0 if i < 10 else 50.0, 50.0 if i < 10 else 25.0) for i, t in enumerate(days)]
    got = baskets.proportional_roll(spark.createDataFrame(rows, "series_id string, ts date, period date, front double, back double"), 4).orderBy("ts").collect()
    assert [r.back_weight for r in got[:10]] == pytest.approx([0] * 6 + [0.25, 0.5, 0.75, 1])
    assert [r.price for r in got[:10]] == pytest.approx([100] * 6 + [87.5, 75, 62.5, 50]) and all(r.continuous == pytest.approx(100) for r in got)


# trend strength, levels


def test_adx_and_pivots(spark):
    n = 80
    up = frame(spark, {"high": np.arange(n) + 1.0, "low": np.arange(n) * 1.0, "close": np.arange(n) + 0.5})
    r = features.directional(up).orderBy("ts").collect()
    assert r[0].adx is None and r[-1].adx == pytest.approx(100) and r[-1].minus_di == 0
    wave = np.sin(np.arange(n) / 4)
    d = frame(spark, {"high": 10 + wave + 0.1, "low": 10 + wave, "close": 10 + wave})
    got = {(p.ts, p.kind): p for p in features.pivots(d, 3).collect()}
    want = {(D0 + dt.timedelta(days=i), k) for i in range(3, n - 3) for k, s in (("resistance", 1), ("support", -1)) if all(s * wave[i] > s * wave[i + j] for j in (-3, -2, -1, 1, 2, 3))}
    assert set(got) == want and all(p.known == p.ts + dt.timedelta(days=3) for p in got.values())
    # what is known by a date does not change with what comes after
    part = {(p.ts, p.kind) for p in features.pivots(d.where(F.col("ts") <= D0 + dt.timedelta(days=50)), 3).collect()}
    assert part == {k for k, p in got.items() if p.known <= D0 + dt.timedelta(days=50)}
    lv = features.levels(spark.createDataFrame([("a", D0, "support", v, D0) for v in (10.0, 10.1, 10.25, 12.0)], "series_id string, ts date, kind string, level double, known date"), 0.02)
    assert sorted((round(x.level, 4), x.touches) for x in lv.collect()) == [(10.1167, 3), (12.0, 1)]


# long series by slices


@pytest.mark.parametrize("slices", [1, 7, 40])
def test_sliced_means_equal_one_walk(spark, slices):
    """One long series with gaps, one of nulls alone, a short one: as pandas and as the walk in one task have it."""
    import pandas as pd

    from strandline.functions import ordered as o

    rng = np.random.default_rng(slices)
    x = [None if rng.random() < 0.3 or 60 < i < 140 else float(rng.normal()) for i in range(400)]
    d = frame(spark, {"v": x}).union(frame(spark, {"v": [None] * 30}, "b")).union(frame(spark, {"v": [None, 2.0, 4.0]}, "c"))
    cols = [("v", "fast", 3), ("v", "slow", 25)]
    got = o.ewma_sliced(d, cols, slices=slices).orderBy("series_id", "ts").toPandas()
    one = o.ewma(d, cols).orderBy("series_id", "ts").toPandas()
    pd.testing.assert_frame_equal(got, one)
    want = pd.Series(x, dtype=float).ewm(span=25, adjust=False).mean()
    np.testing.assert_allclose(got[got.series_id == "a"]["slow"].to_numpy(float), want.to_numpy())


def test_sliced_folds_equal_one_walk(spark):
    rng = np.random.default_rng(6)
    d = frame(spark, {"sig": (rng.random(500) < 0.15).astype(float)}).union(frame(spark, {"sig": [1.0] * 20}, "b"))
    want = signals.hold_greedy(d, "sig", 7).orderBy("series_id", "ts").collect()
    for slices in (1, 9, 60):
        assert signals.hold_sliced(d, "sig", 7, slices=slices).orderBy("series_id", "ts").collect() == want
    assert signals.hold_sliced(d.limit(0), "sig", 7).count() == 0
