import datetime as dt

import numpy as np
import pytest

from strandline.operators import bars, research

D0 = dt.date(2021, 1, 1)


@pytest.fixture(scope="module")
def returns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.01, (120, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]])
    rows = [(n, D0 + dt.timedelta(days=i), float(x[i, j])) for j, n in enumerate("abc") for i in range(120)]
    return spark.createDataFrame(rows, "series_id string, ts date, ret double"), x


def test_covariance_and_weights(returns):
    d, x = returns
    c = research.covariance(d, ["a", "b", "c"])
    np.testing.assert_allclose(c, np.cov(x.T), rtol=1e-9)
    for w in (research.risk_parity(c), research.mean_variance(x.mean(axis=0), c)):
        assert w.sum() == pytest.approx(1)
    assert (research.risk_parity(c) > 0).all()
    w = research.pca_weights(c)
    assert w @ c @ w == pytest.approx(1)
    best = bars.min_variance(d, ["a", "b", "c"])
    v = np.array([best[n] for n in "abc"])
    assert v @ c @ v <= min(u @ c @ u for u in np.random.default_rng(1).dirichlet(np.ones(3), 50)) + 1e-12


def test_unit_root_tells_walks_from_reversion(spark):
    rng = np.random.default_rng(3)
    walk, back = np.exp(np.cumsum(rng.normal(0, 0.01, 300))), np.exp(rng.normal(0, 0.01, 300))
    rows = [(n, D0 + dt.timedelta(days=i), float(v[i])) for n, v in (("walk", walk), ("back", back)) for i in range(300)]
    d = spark.createDataFrame(rows, "series_id string, ts date, value double")
    t = {r.series_id: r.t_stat for r in research.unit_root(d).collect()}
    assert t["back"] < -10 < t["walk"]
    s = {r.series_id: r.sadf for r in research.explosiveness(d).collect()}
    assert s["walk"] >= t["walk"] - 1e-9


def test_selection_prefers_the_fit():
    picked = research.parameter_paths(200, [1.0, 2.0, 3.0, 4.0], [0, 1, 2, 3], "tournament")
    assert picked.count(4.0) > picked.count(1.0)
    with pytest.raises(ValueError):
        research.parameter_paths(1, [1.0], [1], "nope")
