"""Fixed effects on cells, their rank, group-time effects with errors, and the imputation estimator, against dense versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterloom.operators import estimate


def _dummies(*labels):
    return np.column_stack([(np.array(v)[:, None] == np.unique(v)[None, :]).astype(float) for v in labels])


def _disconnected(seed=6):
    """Two blocks of levels that never meet, and chains of rows that are alone one after another."""
    r = np.random.default_rng(seed)
    rows = [(b * 100 + int(r.integers(0, 8)), b * 100 + int(r.integers(0, 6)), float(r.normal())) for b in (0, 1) for _ in range(120)]
    rows += [(900, 901, 1.0), (900, 902, 2.0), (903, 902, 3.0)]
    return [(u, t, x, float(2 * x + u % 7 - t % 5 + r.normal())) for u, t, x in rows]


def test_rank_singletons_and_cells_equal_dummies(spark):
    rows = _disconnected()
    df = spark.createDataFrame(rows, "u int, t int, x double, y double")
    u, t, x, y = map(np.array, zip(*rows, strict=True))
    m = _dummies(u, t)
    assert estimate.absorbed_rank(df, ["u", "t"]) == np.linalg.matrix_rank(m) and estimate.absorbed_rank(df, ["u"]) == len(set(u)) and estimate.absorbed_rank(df, []) == 0
    kept = sorted(map(tuple, estimate.drop_singletons(df, ["u", "t"]).collect()))
    assert kept == sorted(r for r in rows if r[0] < 900)
    for singletons, own in ((True, rows), (False, [r for r in rows if r[0] < 900])):
        u, t, x, y = map(np.array, zip(*own, strict=True))
        m = np.column_stack([x, _dummies(u, t)])
        res = estimate.fe_regression(df, "y", ["x"], ["u", "t"], count_absorbed=True, singletons=singletons).first()
        beta = np.linalg.lstsq(m, y, rcond=None)[0]
        left = x - m[:, 1:] @ np.linalg.lstsq(m[:, 1:], x, rcond=None)[0]
        e, k = y - m @ beta, np.linalg.matrix_rank(m)
        assert res.n == len(own) and res.estimate == pytest.approx(beta[0], abs=1e-7)
        assert res.se == pytest.approx(np.sqrt((left**2 * e**2).sum() * len(own) / (len(own) - k)) / (left**2).sum(), rel=1e-5)
    assert estimate.fe_regression(df.limit(0), "y", ["x"], ["u", "t"], cluster=["u"]).count() == 0


def _panel(seed=8, holes=0.25):
    r = np.random.default_rng(seed)
    out = []
    for u in range(80):
        g = (None, 3, 4, 3)[u % 4]
        for t in range(7):
            if r.random() > holes:
                out.append((u, t, float(u % 9 + 0.5 * t + (2.0 if g is not None and t >= g else 0) + r.normal()), g, int(g is not None and t >= g)))
    return out


@pytest.mark.parametrize("holes", [0.0, 0.25])
def test_group_time_inference_equals_a_plain_version(spark, holes):
    rows = _panel(holes=holes)
    df = spark.createDataFrame(rows, "u int, t int, y double, g int, d int")
    got = {(r.g, r.t): r for r in estimate.att_inference(df, "u", "t", "y", "g", draws=600).collect()}
    y = {(u, t): (v, g) for u, t, v, g, _ in rows}
    for (g, t), r in got.items():
        cells = [(g, t, 1), (g, g - 1, -1), (None, t, -1), (None, g - 1, 1)]
        att, psi = 0.0, np.zeros(80)
        for own, at, sign in cells:
            held = [(u, v) for (u, p), (v, h) in y.items() if p == at and h == own]
            mean = np.mean([v for _, v in held])
            att += sign * mean
            for u, v in held:
                psi[u] += sign * (v - mean) / len(held)
        assert r.att == pytest.approx(att) and r.se == pytest.approx(np.sqrt((psi**2).sum()))
        assert 2.2 * r.se < r.high - r.att < 3.6 * r.se and r.high - r.att == pytest.approx(r.att - r.low)
    assert len(got) == 12
    if not holes:
        plain = {(r.g, r.t): r.att for r in estimate.att_gt(df, "u", "t", "y", "g").collect()}
        assert plain == pytest.approx({k: r.att for k, r in got.items()})
    simple = estimate.att_bootstrap(df, "u", "t", "y", "g", 800).first()
    assert simple.att == pytest.approx(2, abs=0.6) and 0.1 < simple.se < 0.5 and simple.draws == 800
    assert estimate.att_inference(df.filter("g is null"), "u", "t", "y", "g").count() == 0


@pytest.mark.parametrize("horizon", [[], ["g"]])
def test_imputation_effect_and_error_equal_dense_ones(spark, horizon):
    rows = [*_panel(), (500, 2, 1.0, 1, 1)]  # the last unit has no untreated row
    rows += rows[:40]  # repeated rows
    df = spark.createDataFrame(rows, "u int, t int, y double, g int, d int").withColumn("g", F.coalesce("g", F.lit(-1)))
    got = estimate.imputation_effect(df, "u", "t", "y", "d", horizon=horizon).first()
    u, t, y, g, d = map(np.array, zip(*[(a, b, c, -1 if e is None else e, f) for a, b, c, e, f in rows], strict=True))
    ok = (d == 0) | (np.isin(u, u[d == 0]) & np.isin(t, t[d == 0]))
    u, t, y, g, d = u[ok], t[ok], y[ok], g[ok], d[ok]
    z = _dummies(u, t)
    z0, z1, w1 = z[d == 0], z[d == 1], np.full((d == 1).sum(), 1 / (d == 1).sum())
    fit = np.linalg.lstsq(z0, y[d == 0], rcond=None)[0]
    tau = y[d == 1] - z1 @ fit
    v = np.zeros(len(y))
    v[d == 1] = w1
    v[d == 0] = -z0 @ np.linalg.pinv(z0.T @ z0) @ z1.T @ w1
    e = np.zeros(len(y))
    e[d == 0] = y[d == 0] - z0 @ fit
    centre = np.array([tau[g[d == 1] == k].mean() for k in g[d == 1]]) if horizon else tau.mean()
    e[d == 1] = tau - centre
    se = np.sqrt(sum((v[u == k] @ e[u == k]) ** 2 for k in np.unique(u)))
    assert got.n == len(tau) and got.effect == pytest.approx(tau.mean(), abs=1e-8) and got.effect == pytest.approx(v @ y) and got.se == pytest.approx(se, rel=1e-6)
    none = estimate.imputation_effect(df.filter("d = 0"), "u", "t", "y", "d").first()
    assert tuple(none) == (None, 0, None)
