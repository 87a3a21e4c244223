"""Models by sums, posterior draws, donors, imputation kinds and the prior."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterloom.operators import estimate, indices, models, panel


def _frame(spark, n=3000, seed=4):
    r = np.random.default_rng(seed)
    x, z = r.normal(size=n), r.integers(0, 2, n)
    p = 1 / (1 + np.exp(-(-0.5 + 1.2 * x - 0.8 * z)))
    yes = (r.random(n) < p).astype(float)
    latent = 0.9 * x + 0.4 * z + r.logistic(size=n)
    grade = np.digitize(latent, [-1.0, 0.5, 2.0]).astype(float)
    y = 2 + 3 * x - z + r.normal(size=n)
    rows = [(k, float(a), float(b), float(c), float(d), float(e)) for k, (a, b, c, d, e) in enumerate(zip(x, z, yes, grade, y, strict=True))]
    return spark.createDataFrame(rows, "k int, x double, z double, yes double, grade double, y double"), np.column_stack([np.ones(n), x, z]), yes, grade, y


def _logistic(m, y, penalty=None):
    b = np.zeros(m.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-m @ b))
        d = np.zeros(len(b)) if penalty is None else penalty(b)
        b = b + np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + np.diag(d), m.T @ (y - p) - d * b)
    return b, np.linalg.inv((m * (p * (1 - p))[:, None]).T @ m + np.diag(d))


def test_fits_equal_dense_ones(spark):
    df, m, yes, grade, y = _frame(spark)
    lin = models.fit_linear(df, "y", ["x", "z"])[None]
    want, rss = np.linalg.lstsq(m, y, rcond=None)[:2]
    assert lin.beta == pytest.approx(want, abs=1e-8) and lin.sigma == pytest.approx(np.sqrt(rss[0] / (len(y) - 3))) and lin.covariance == pytest.approx(np.linalg.inv(m.T @ m) * lin.sigma**2, rel=1e-6)
    log = models.fit_logistic(df, "yes", ["x", "z"])[None]
    b, cov = _logistic(m, yes)
    assert log.beta == pytest.approx(b, abs=1e-6) and log.covariance == pytest.approx(cov, rel=1e-4)
    fit = models.fit_ordered(df, "grade", ["x", "z"], 4)[None]
    assert fit.beta == pytest.approx([-1.0, 0.5, 2.0, 0.9, 0.4], abs=4 * np.sqrt(np.diag(fit.covariance)).max())

    def loss(b):
        eta = m[:, 1:] @ b[3:]
        big = np.column_stack([np.zeros(len(y)), *[1 / (1 + np.exp(eta - t)) for t in b[:3]], np.ones(len(y))])
        return np.log(np.diff(big, axis=1)[np.arange(len(y)), grade.astype(int)]).sum()

    step = 1e-4 * np.eye(5)
    gradient = [(loss(fit.beta + s) - loss(fit.beta - s)) / 2e-4 for s in step]
    assert gradient == pytest.approx([0] * 5, abs=0.05)
    curve = np.array([[(loss(fit.beta + s + t) - loss(fit.beta + s) - loss(fit.beta + t) + loss(fit.beta)) / 1e-8 for s in step] for t in step])
    assert np.sqrt(np.diag(fit.covariance)) == pytest.approx(np.sqrt(np.diag(np.linalg.inv(-curve))), rel=0.05)


def test_groups_are_fitted_apart(spark):
    df, *_ = _frame(spark, 800)
    both = df.withColumn("g", F.lit(1)).unionByName(df.withColumn("g", F.lit(2)).withColumn("yes", 1 - F.col("yes")))
    fits = models.fit_logistic(both, "yes", ["x", "z"], "g")
    assert fits[1].beta == pytest.approx(-fits[2].beta, abs=1e-6) and fits[1].n == fits[2].n == 800


def test_draws_have_the_posterior_spread():
    fit = models.Fit(np.array([1.0, -2.0]), np.array([[0.04, 0.01], [0.01, 0.09]]), 100, 2.0)
    draws = [fit.draw(np.random.default_rng(k), 2) for k in range(4000)]
    b = np.array([x for x, _ in draws])
    assert b.mean(0) == pytest.approx([1, -2], abs=0.03) and np.cov(b.T) == pytest.approx(fit.covariance * 98 / 96, abs=0.008)
    assert np.mean([s for _, s in draws]) == pytest.approx(2.0, abs=0.05)


def test_prior_mode_equals_a_dense_one_and_is_finite(spark):
    r = np.random.default_rng(2)
    x, z = r.normal(size=200), r.integers(0, 2, 200)
    df = spark.createDataFrame([(float(a), float(b), float(a > 0), float(b)) for a, b in zip(x, z, strict=True)], "x double, z double, apart double, same double")
    scales = models.prior_scales(df, ["x", "z"], 2.5, 10.0)
    assert scales == pytest.approx([10, 2.5 / (2 * np.std(x, ddof=1)), 2.5])
    fit = models.fit_logistic(df, "apart", ["x", "z"], None, scales)[None]
    want, _ = _logistic(np.column_stack([np.ones(200), x, z]), (x > 0).astype(float), lambda b: 2 / (scales**2 + b**2))
    assert fit.beta == pytest.approx(want, rel=1e-3) and np.abs(fit.beta).max() < 100
    rows = df.withColumns({"u": (F.monotonically_increasing_id() % 10).cast("int"), "sw": (F.rand(3) < 0.5).cast("int")})
    out = estimate.prior_logit_weights(rows, "apart", "sw", ["x", "z"], "u")
    assert out.count() > 150 and out.filter("weight <= 0 or isnan(weight) or weight = double('infinity')").count() == 0


@pytest.mark.parametrize("k", [1, 5])
def test_donors_equal_brute_force(spark, k):
    r = np.random.default_rng(k)
    donors = [(int(g), float(v), d) for d, (g, v) in enumerate(zip(r.integers(0, 2, 90), r.integers(0, 12, 90) / 2, strict=True))]
    asked = [(i, int(i % 3), None if i == 5 else float(r.integers(-2, 16)) / 2) for i in range(40)]
    rec = spark.createDataFrame(asked, "i int, g int, v double")
    got = {x.i: x.donors for x in models.nearest_donors(rec, spark.createDataFrame(donors, "g int, v double, d int"), "v", "d", k, ["g"]).collect()}
    assert len(got) == 40
    for i, g, v in asked:
        own = sorted((x[1], x[2]) for x in donors if x[0] == g)
        if v is None or not own:
            assert got[i] is None
            continue
        b = sum(x[0] < v for x in own)
        best = sorted((abs(x[0] - v), abs(n + 1 - b - 0.5), n, x[1]) for n, x in enumerate(own))[:k]
        assert [(x.v, x.d) for x in got[i]] == [(own[n][0], d) for *_, n, d in best]


def test_imputation_by_models_of_their_own(spark):
    df, m, yes, grade, y = _frame(spark, 800)
    holes = df.withColumns({"yes": F.when(F.col("k") % 5 != 0, F.col("yes")), "grade": F.when(F.col("k") % 5 != 1, F.col("grade")), "y": F.when(F.col("k") % 4 != 2, F.col("y")), "none": F.lit(None).cast("double"), "one": F.when(F.col("k") % 2 == 0, 7.0)})
    names = ["x", "z", "yes", "grade", "y", "none", "one"]
    kinds = {"yes": "binary", "grade": "ordered", "y": "donor"}
    run = lambda: indices.chained_imputation(holes, "k", names, 2, 1, 5, kinds)
    out = sorted(run().collect())
    assert len(out) == 1600 and {o.none for o in out} == {None} and {o.one for o in out} == {7.0} and {o.yes for o in out} == {0.0, 1.0} and {o.grade for o in out} == {0.0, 1.0, 2.0, 3.0}
    assert {o.y for o in out} <= set(y.tolist()) and all(o.yes == yes[o.k] for o in out if o.k % 5) and all(o.y == y[o.k] for o in out if o.k % 4 != 2)
    drawn = [o for o in out if o.k % 5 == 0]
    high, low = (np.mean([o.yes for o in drawn if (o.x > 0.7) == side and abs(o.x) > 0.7]) for side in (True, False))
    assert high > low + 0.4
    graded = [o for o in out if o.k % 5 == 1]
    assert np.corrcoef([o.grade for o in graded], [o.x for o in graded])[0, 1] == pytest.approx(np.corrcoef(grade, m[:, 1])[0, 1], abs=0.2)
    given = [o for o in out if o.k % 4 == 2]
    assert np.corrcoef([o.y for o in given], [y[o.k] for o in given])[0, 1] > 0.85
    assert sorted(run().collect()) == out
    assert indices.chained_imputation(holes.limit(0), "k", names, 2, 1, 1, kinds).count() == 0
    with pytest.raises(ValueError, match="kind"):
        indices.chained_imputation(holes, "k", names, kinds={"y": "other"})


def test_weights_of_empty_tables_and_answers_of_any_kind(spark):
    empty = spark.createDataFrame([], "u int, d int, s int, a double")
    for f in (estimate.propensity_weights, estimate.prior_logit_weights):
        assert f(empty, "d", "s", ["a"], "u").count() == 0
    rows = spark.createDataFrame([(1, "brick", 2), (2, None, 2), (3, None, None)], "k int, wall string, n int")
    assert sorted(r.k for r in indices.completeness_filter(rows, ["wall", "n"], 0.5).collect()) == [1, 2]
    assert panel is not None
