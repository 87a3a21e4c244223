"""Treatment comparisons: balance, weights, fixed effects, group-time effects.

Executors make sums; only k-by-k matrices (k regressors) reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import models
from .aggs import density
from .graph import components, materialised


def balance_table(df: DataFrame, treat: str, covariates: Sequence[str], subset: str | None = None) -> DataFrame:
    """Per variable (and subset): size, mean and sd by arm, Welch's t, its two-sided normal p, standardised difference."""
    keys = [subset] if subset else []
    rows = df.select(*keys, treat, *[F.col(c).cast("double").alias(c) for c in covariates]).unpivot([*keys, treat], list(covariates), "variable", "value").dropna(subset=["value", treat])
    arm = lambda f, k: f(F.when(F.col(treat) == k, F.col("value")))
    out = rows.groupBy(*keys, "variable").agg(*[a.alias(f"{n}_{k}") for k in (0, 1) for n, a in (("n", arm(F.count, k)), ("mean", arm(F.avg, k)), ("sd", arm(F.stddev_samp, k)))])
    v0, v1 = F.col("sd_0") * F.col("sd_0"), F.col("sd_1") * F.col("sd_1")
    t = F.try_divide(F.col("mean_1") - F.col("mean_0"), F.sqrt(v0 / F.col("n_0") + v1 / F.col("n_1")))
    out = out.withColumn("t", t)
    return out.withColumns({"p": normal_p(F.col("t")), "std_diff": F.try_divide(F.col("mean_1") - F.col("mean_0"), F.sqrt((v0 + v1) / 2))})


def balance_categories(df: DataFrame, treat: str, covariates: Sequence[str], subset: str | None = None) -> DataFrame:
    """Per variable and level: count and share by arm, with the variable's chi-square, its degrees of freedom and p.

    p is the normal approximation of Wilson and Hilferty.
    """
    keys = [subset] if subset else []
    rows = df.select(*keys, treat, *[F.col(c).cast("string").alias(c) for c in covariates]).unpivot([*keys, treat], list(covariates), "variable", "level").dropna(subset=["level", treat])
    cells = rows.groupBy(*keys, "variable", "level").agg(*[F.count_if(F.col(treat) == k).alias(f"n_{k}") for k in (0, 1)])
    per = Window.partitionBy(*keys, "variable")  # a row per level
    cells = cells.withColumns({"_0": F.sum("n_0").over(per), "_1": F.sum("n_1").over(per), "_k": F.count(F.lit(1)).over(per)})
    both = F.col("n_0") + F.col("n_1")
    off = lambda k: F.pow(F.col(f"n_{k}") - both * F.col(f"_{k}") / (F.col("_0") + F.col("_1")), 2) / F.nullif(both * F.col(f"_{k}") / (F.col("_0") + F.col("_1")), F.lit(0.0))
    chi2 = F.sum(off(0) + off(1)).over(per)
    out = cells.select(*keys, "variable", "level", "n_0", F.try_divide("n_0", "_0").alias("share_0"), "n_1", F.try_divide("n_1", "_1").alias("share_1"), chi2.alias("chi2"), (F.col("_k") - 1).alias("df"))
    c = 2 / (9 * F.nullif(F.col("df"), F.lit(0)))
    z = (F.pow(F.col("chi2") / F.nullif(F.col("df"), F.lit(0)), 1 / 3) - (1 - c)) / F.sqrt(c)
    return out.withColumn("p", F.when(z >= 0, normal_p(z) / 2).otherwise(1 - normal_p(z) / 2))


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal value: a rational approximation of the error function, exact to 1e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def _logit(df: DataFrame, label: str, covariates: Sequence[str], out: str, ridge: float) -> DataFrame:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = VectorAssembler(inputCols=list(covariates), outputCol="_x").transform(df)
    model = LogisticRegression(featuresCol="_x", labelCol=label, probabilityCol="_pr", rawPredictionCol="_raw", predictionCol="_pd", regParam=ridge, tol=1e-12, maxIter=500).fit(x)
    return model.transform(x).withColumn(out, F.get(vector_to_array("_pr"), F.lit(1))).drop("_x", "_pr", "_raw", "_pd")


def propensity_weights(df: DataFrame, treat: str, switcher: str, covariates: Sequence[str], unit: str, ridge: float = 0.0) -> DataFrame:
    """weight = P(treat) / P(switch) / variance of treat within the unit × share switching / share treated.

    Rows without a covariate or with an infinite weight (units without
    variance) go.  ``ridge`` > 0 shrinks the coefficients.  A table without a
    whole row gives no rows.
    """
    rows = df.dropna(subset=[treat, switcher, *covariates]).withColumns({c: F.col(c).cast("double") for c in [treat, switcher, *covariates]})
    if rows.isEmpty():
        return rows.withColumns({"p_treat": F.lit(0.0), "p_switch": F.lit(0.0), "weight": F.lit(0.0)}).filter(F.lit(False))
    return _ratio_weights(_logit(_logit(rows, treat, covariates, "p_treat", ridge), switcher, covariates, "p_switch", ridge), treat, switcher, unit)


def _ratio_weights(rows: DataFrame, treat: str, switcher: str, unit: str) -> DataFrame:
    share = rows.agg(F.avg(switcher), F.avg(treat)).first()
    per = rows.groupBy(unit).agg(F.var_pop(treat).alias("_var")).withColumnRenamed(unit, "_unit")
    weight = F.try_divide(F.col("p_treat") / F.col("p_switch"), F.col("_var")) * (share[0] / share[1] if share[1] else None)
    joined = rows.join(per, F.col(unit).eqNullSafe(F.col("_unit")))
    return joined.withColumn("weight", weight.cast("double")).filter(F.col("weight").isNotNull()).drop("_unit", "_var")


def prior_logit_weights(df: DataFrame, treat: str, switcher: str, covariates: Sequence[str], unit: str, scale: float = 2.5, intercept: float = 10.0, degrees: float = 1.0) -> DataFrame:
    """``propensity_weights`` with a weakly informative Student prior on the coefficients.

    The scale of a coefficient's prior is ``scale`` by the variable's range if it
    has two values, else by twice its standard deviation; ``intercept`` is the
    scale for the constant.  Chances are those at the mode of the posterior,
    which is finite where the classes are separated.
    """
    rows = df.dropna(subset=[treat, switcher, *covariates]).withColumns({c: F.col(c).cast("double") for c in [treat, switcher, *covariates]})
    if rows.isEmpty():
        return rows.withColumns({"p_treat": F.lit(0.0), "p_switch": F.lit(0.0), "weight": F.lit(0.0)}).filter(F.lit(False))
    scales = models.prior_scales(rows, covariates, scale, intercept)
    for label, out in ((treat, "p_treat"), (switcher, "p_switch")):
        b = models.by_group({None: models.fit_logistic(rows, label, covariates, None, scales, degrees)[None].beta}, None)
        rows = rows.withColumn(out, 1 / (1 + F.exp(-(F.get(b, F.lit(0)) + models.line(covariates, b, 1)))))
    return _ratio_weights(rows, treat, switcher, unit)


def demean(df: DataFrame, names: Sequence[str], effects: Sequence[str], weight: str | None = None, tolerance: float = 1e-9, rounds: int = 100) -> DataFrame:
    """The columns less their (weighted) means by each effect, in turn until they stay.

    One effect takes one pass.  With more, a round goes through all of them
    twice, is written to a table, and the step is lengthened by what the two
    passes tell of its limit (Irons and Tuck's rule: what is added are means of
    the effects, so the limit stays the same).  Rounds go on until the means by
    every effect are under ``tolerance`` of the columns' own spread; a
    ``RuntimeError`` is raised if ``rounds`` don't suffice.
    """
    w = F.col(weight) if weight else F.lit(1.0)

    def less_means(df: DataFrame, e: str) -> DataFrame:
        means = df.groupBy(e).agg(*[(F.sum(F.col(n) * w) / F.sum(w)).alias(f"_m_{n}") for n in names])
        return df.join(means, e).withColumns({n: F.col(n) - F.col(f"_m_{n}") for n in names}).drop(*[f"_m_{n}" for n in names])

    if len(effects) == 1:
        return less_means(df, effects[0])
    columns = df.columns
    spread = [max(x or 0.0, 1e-300) for x in df.agg(*[F.stddev_pop(n) for n in names]).first()]
    for k in range(rounds):
        for kept in ("_0_", "_1_"):
            df = df.withColumns({kept + n: F.col(n) for n in names})
            for e in effects:
                df = less_means(df, e)
        df = materialised(df, f"demean-{k}")
        # the last effect's means are zero by now; the others' tell how far it is
        open_ = [df.groupBy(e).agg(*[F.abs(F.sum(F.col(n) * w) / F.sum(w)).alias(n) for n in names]).agg(*[F.max(n) for n in names]).first() for e in effects[:-1]]
        if all((x or 0.0) <= tolerance * s for row in open_ for x, s in zip(row, spread, strict=True)):
            return df.select(columns)
        last = {n: F.col(n) - F.col("_1_" + n) for n in names}
        bend = {n: last[n] - (F.col("_1_" + n) - F.col("_0_" + n)) for n in names}
        got = df.agg(*[F.sum(w * last[n] * bend[n]) for n in names], *[F.sum(w * bend[n] * bend[n]) for n in names]).first()
        step = {n: (got[i] or 0.0) / got[i + len(names)] if got[i + len(names)] else 0.0 for i, n in enumerate(names)}
        df = df.select([(F.col(c) - step[c] * last[c]).alias(c) if c in names else F.col(c) for c in columns])
    raise RuntimeError(f"demean: not stable after {rounds} rounds")


def demean_cells(df: DataFrame, names: Sequence[str], effects: Sequence[str], weight: str | None = None, tolerance: float = 1e-9, rounds: int = 100) -> DataFrame:
    """``demean`` of a table whose effects depend on rows only through their combinations.

    The rows are summed once to cells of the effects; the rounds go over the
    cells, and the rows get what they differ from their cell's mean plus the
    cell's remainder: two scans of the rows however many rounds there are.
    """
    if len(effects) < 2:
        return demean(df, names, effects, weight)
    w = F.col(weight) if weight else F.lit(1.0)
    cells = materialised(df.groupBy(*effects).agg(*[(F.sum(F.col(n) * w) / F.sum(w)).alias(n) for n in names], F.sum(w).alias("_w")), "cells")
    left = demean(cells, names, effects, "_w", tolerance, rounds).drop("_w")
    both = cells.drop("_w").join(left.withColumnsRenamed({n: f"_left_{n}" for n in names}), list(effects))
    shifts = both.select(*effects, *[(F.col(f"_left_{n}") - F.col(n)).alias(f"_shift_{n}") for n in names])
    return materialised(df.join(shifts, list(effects)).withColumns({n: F.col(n) + F.col(f"_shift_{n}") for n in names}).select(df.columns), "demeaned")


def drop_singletons(df: DataFrame, effects: Sequence[str], rounds: int = 100) -> DataFrame:
    """The rows whose level of every effect has another row, again and again until none is alone (at most ``rounds`` times, else ``RuntimeError``).

    Rounds go over the cells of the effects with their counts, not over the rows.
    """
    cells = materialised(df.groupBy(*effects).agg(F.count(F.lit(1)).alias("_n")), "cells")
    for k in range(rounds):
        kept = cells
        for e in effects:
            kept = kept.join(kept.groupBy(e).agg(F.sum("_n").alias("_all")).filter("_all > 1").select(e), e, "left_semi")
        kept = materialised(kept, f"kept-{k}")
        if kept.count() == cells.count():
            return df.join(kept.drop("_n"), list(effects), "left_semi")
        cells = kept
    raise RuntimeError(f"drop_singletons: not stable after {rounds} rounds")


def absorbed_rank(df: DataFrame, effects: Sequence[str]) -> int:
    """The degrees of freedom that the effects take.

    One effect: its levels.  Two: their levels less the connected components of
    the graph of levels that meet in a row, exactly.  Each further effect: its
    levels less one (at least as many as it takes).
    """
    if not effects:
        return 0
    levels = list(df.agg(*[F.count_distinct(e).alias(f"n{i}") for i, e in enumerate(effects)]).first())
    if len(effects) == 1:
        return int(levels[0])
    name = lambda i: F.concat(F.lit(f"{i}:"), F.col(effects[i]).cast("string"))
    edges = df.select(name(0).alias("u"), name(1).alias("v")).distinct()
    parts = components(edges).select("component").distinct().count() if levels[0] else 0
    return int(levels[0] + levels[1] - parts + sum(max(0, n - 1) for n in levels[2:]))


def _sums(df: DataFrame, y: str, xs: Sequence[str], w: Column) -> tuple[np.ndarray, np.ndarray, int]:
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    cells = [F.sum(w * F.col(xs[i]) * F.col(xs[j])) for i, j in pairs] + [F.sum(w * F.col(x) * F.col(y)) for x in xs] + [F.count(F.lit(1))]
    got = list(df.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).first())
    xx = np.zeros((len(xs), len(xs)))
    for (i, j), v in zip(pairs, got, strict=False):
        xx[i, j] = xx[j, i] = v
    return xx, np.array(got[len(pairs) : -1], float), int(got[-1])


def fe_regression(df: DataFrame, y: str, xs: Sequence[str], effects: Sequence[str] = (), weight: str | None = None, cluster: Sequence[str] = (), interact: str | None = None, count_absorbed: bool = False, singletons: bool = True) -> DataFrame:
    """(term, estimate, se, t, p, low, high, n): least squares with absorbed effects and clustered errors.

    ``interact``: the treatment, also multiplied by each other regressor.
    Several clusters are combined by inclusion and exclusion.  The small-sample
    factor is G/(G-1) · (N-1)/(N-K); ``count_absorbed`` lets K count the rank of
    the effects (``absorbed_rank``), and ``singletons=False`` takes out rows alone in
    a level first.  Without a whole row the result is empty.
    """
    need = [y, *xs, *effects, *cluster, *([weight] if weight else [])]
    rows = df.select(*dict.fromkeys(need)).dropna().withColumns({c: F.col(c).cast("double") for c in [y, *xs]})
    terms = list(xs)
    if interact:
        for x in [x for x in xs if x != interact]:
            rows, terms = rows.withColumn(f"{interact}_{x}", F.col(interact) * F.col(x)), [*terms, f"{interact}_{x}"]
    absorbed = 0
    if effects and not singletons:
        rows = drop_singletons(rows, effects)
    if rows.isEmpty():
        return result_table(df, [], 0)
    if effects:
        # an effect can also be a cluster: keep the names
        rows = demean_cells(rows, [y, *terms], effects, weight)
        absorbed = absorbed_rank(rows, effects) if count_absorbed else 0
    else:
        rows, terms = rows.withColumn("_one", F.lit(1.0)), ["_one", *terms]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    xx, xy, n = _sums(rows, y, terms, w)
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    fitted = sum((F.col(t) * float(b) for t, b in zip(terms, beta, strict=True)), F.lit(0.0))
    rows = rows.withColumn("_u", (F.col(y) - fitted) * w)
    k = len(terms) + absorbed

    def meat(keys: Sequence[str]) -> tuple[np.ndarray, int]:
        s = rows.groupBy(*keys).agg(*[F.sum(F.col(t) * F.col("_u")).alias(f"s{i}") for i, t in enumerate(terms)]) if keys else rows.select(*[(F.col(t) * F.col("_u")).alias(f"s{i}") for i, t in enumerate(terms)])
        pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
        got = list(s.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"c{i}_{j}") for i, j in pairs], F.count(F.lit(1)).alias("g")).first())
        m = np.zeros((len(terms), len(terms)))
        for (i, j), v in zip(pairs, got, strict=False):
            m[i, j] = m[j, i] = v
        return m, int(got[-1])

    if cluster:
        total, least = np.zeros_like(xx), None
        for r in range(1, len(cluster) + 1):
            for keys in combinations(cluster, r):
                m, g = meat(keys)
                total += (-1) ** (r + 1) * m * g / max(1, g - 1)
                least = g if least is None or r == 1 and g < least else least
        total *= (n - 1) / max(1, n - k)
    else:
        total = meat(())[0] * n / max(1, n - k)
    variance = inverse @ total @ inverse
    out = [(t if t != "_one" else "(intercept)", float(b), float(math.sqrt(max(v, 0.0)))) for t, b, v in zip(terms, beta, np.diag(variance), strict=True)]
    return result_table(df, out, n)


def result_table(df: DataFrame, rows: Sequence[tuple[str, float, float]], n: int) -> DataFrame:
    table = df.sparkSession.createDataFrame([(*r, n) for r in rows], "term string, estimate double, se double, n long")
    t = F.try_divide(F.col("estimate"), F.col("se"))
    return table.select("term", "estimate", "se", t.alias("t"), normal_p(t).alias("p"), (F.col("estimate") - 1.96 * F.col("se")).alias("low"), (F.col("estimate") + 1.96 * F.col("se")).alias("high"), "n")


def _from_base(u: DataFrame, unit: Sequence[str], period: str, y: str, g: str) -> DataFrame:
    """The rows of treated units, and those of never treated ones for each cohort, with ``cohort`` and the value ``y0`` before its treatment."""
    cohorts = u.select(F.col(g).alias("cohort")).dropna().distinct()
    base = u.select(*unit, F.col(period).alias("_t"), F.col(y).alias("y0"), F.col(g).alias("_g")).join(cohorts, F.col("_t") == F.col("cohort") - 1)
    base = base.filter(F.col("_g").isNull() | (F.col("_g") == F.col("cohort"))).drop("_t", "_g")
    return u.join(base, list(unit))


def att_gt(df: DataFrame, unit: str, period: str, y: str, first_treated: str) -> DataFrame:
    """(g, t, att, treated, controls): group-time effects against the never treated, from the period before g."""
    u = df.select(unit, F.col(period).alias("t"), F.col(y).cast("double").alias("y"), F.col(first_treated).alias("g")).dropna(subset=["y"])
    both = _from_base(u, [unit], "t", "y", "g").filter(F.col("t") != F.col("cohort") - 1).withColumn("d", F.col("y") - F.col("y0"))
    out = both.groupBy(F.col("cohort").alias("g"), "t").agg(
        F.avg(F.when(F.col("g").isNotNull(), F.col("d"))).alias("_a"), F.avg(F.when(F.col("g").isNull(), F.col("d"))).alias("_b"),
        F.count_if(F.col("g").isNotNull()).alias("treated"), F.count_if(F.col("g").isNull()).alias("controls"),
    )
    return out.filter("treated > 0 and controls > 0").select("g", "t", (F.col("_a") - F.col("_b")).alias("att"), "treated", "controls")


def att_simple(effects: DataFrame) -> DataFrame:
    """The mean of effects from treatment on, weighted by cohort size."""
    return effects.filter("t >= g").agg((F.sum(F.col("att") * F.col("treated")) / F.sum("treated")).alias("att"), F.sum("treated").alias("treated"))


def _cells(df: DataFrame, period: str, y: str, first_treated: str) -> tuple[DataFrame, list]:
    """The rows as (t, y, g), and the list of (g, t, mean, n): one for each cohort and period."""
    rows = df.withColumns({"_t": F.col(period).cast("long"), "_y": F.col(y).cast("double"), "_g": F.col(first_treated).cast("long")}).dropna(subset=["_t", "_y"])
    got = rows.groupBy("_g", "_t").agg(F.avg("_y").alias("m"), F.count(F.lit(1)).alias("n")).collect()  # cohorts by periods
    return rows, sorted(((r["_g"], r["_t"], r["m"], r["n"]) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _effects(cells: list) -> list[tuple]:
    """(g, t, att, treated, controls, {cell number: sign}) of each effect that has its four cells."""
    at = {(g, t): k for k, (g, t, *_) in enumerate(cells)}
    out = []
    for g, t, _, n in cells:
        four = (at.get((g, t)), at.get((g, g - 1 if g is not None else None)), at.get((None, t)), at.get((None, g - 1 if g is not None else None)))
        if g is not None and t != g - 1 and None not in four:
            signs = dict(zip(four, (1, -1, -1, 1), strict=True))
            out.append((g, t, sum(s * cells[k][2] for k, s in signs.items()), n, cells[four[2]][3], signs))
    return out


def _cell_draws(rows: DataFrame, unit: str, cells: list, draws: int, seed: int) -> np.ndarray:
    """For each cell and draw the sum over its rows of the unit's random sign × (value − mean) / rows of the cell.

    The signs are bits of hashes of the unit, so all rows of a unit share them
    and no row is copied: each task adds up cells × draws numbers.
    """
    words = -(-draws // 64)
    number = {(g, t): k for k, (g, t, *_) in enumerate(cells)}
    mean, size = np.array([c[2] for c in cells]), np.array([c[3] for c in cells], float)
    hashes = F.array(*[F.xxhash64(F.col(unit).cast("string"), F.lit(seed), F.lit(w)) for w in range(words)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(cells), draws))
        for batch in (whole.slice(at, 2048) for whole in batches for at in range(0, whole.num_rows, 2048)):
            cell = np.array([number[g, t] for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
            bits = np.unpackbits(batch.column(3).flatten().to_numpy().view(np.uint8), bitorder="little").reshape(len(cell), -1)[:, :draws]
            value = (batch.column(2).to_numpy() - mean[cell]) / size[cell]
            signed = (2.0 * bits - 1.0) * value[:, None]
            for k in np.unique(cell):
                total[k] += signed[cell == k].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["cell", "sums"])

    sums = rows.select("_g", "_t", "_y", hashes.alias("_h")).mapInArrow(run, "cell int, sums array<double>")
    got = sums.select("cell", F.posexplode("sums").alias("draw", "s")).groupBy("cell", "draw").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros((len(cells), draws))
    out[got.column("cell").to_numpy(), got.column("draw").to_numpy()] = got.column("s").to_numpy()
    return out


def att_inference(df: DataFrame, unit: str, period: str, y: str, first_treated: str, draws: int = 999, seed: int = 1, level: float = 0.95) -> DataFrame:
    """(g, t, att, se, low, high, treated, controls): group-time effects with errors and uniform bands, for panels with gaps.

    Each effect is a difference of differences of four means, over all rows that
    fall in their cells: units seen in some periods only count where they are
    seen; on whole panels this is ``att_gt``.  ``se`` comes from the influence of
    each unit: the sum over its rows of the signed (value − mean) / rows of the
    cell.  The bands hold for all effects together: their width is the quantile
    at ``level`` of the largest standardised deviation over ``draws`` of random
    signs per unit (a multiplier bootstrap in one pass).
    """
    rows, cells = _cells(df, period, y, first_treated)
    effects = _effects(cells)
    schema = "g long, t long, att double, se double, low double, high double, treated long, controls long"
    if not effects:
        return df.sparkSession.createDataFrame([], schema)
    # each row stands in the effects of its own cell: as the cell (g, t) itself, or as a base of many
    touched: dict = {}
    for e, (*_, signs) in enumerate(effects):
        for k, s in signs.items():
            touched.setdefault(k, []).append((e, s))
    links = [(*cells[k][:2], e, float(s), cells[k][2], float(cells[k][3])) for k, own in touched.items() for e, s in own]
    of = df.sparkSession.createDataFrame(links, "lg long, lt long, effect int, sign double, m double, size double")  # a few for each cohort and period
    met = rows.join(F.broadcast(of), F.col("_g").eqNullSafe(F.col("lg")) & (F.col("_t") == F.col("lt")))
    own = met.groupBy(unit, "effect").agg(F.sum(F.col("sign") * (F.col("_y") - F.col("m")) / F.col("size")).alias("psi"))
    got = {r["effect"]: r["v"] for r in own.groupBy("effect").agg(F.sum(F.col("psi") * F.col("psi")).alias("v")).collect()}  # one per effect
    se = np.sqrt([got.get(e, 0.0) for e in range(len(effects))])
    moves = _cell_draws(rows, unit, cells, draws, seed)
    away = np.array([sum(s * moves[k] for k, s in signs.items()) for *_, signs in effects])
    held = se > 0
    width = float(np.quantile(np.abs(away[held] / se[held, None]).max(axis=0), level)) if held.any() else 0.0
    table = [(g, t, float(att), float(s), float(att - width * s), float(att + width * s), n, c) for (g, t, att, n, c, _), s in zip(effects, se, strict=True)]
    return df.sparkSession.createDataFrame(table, schema)


def att_bootstrap(df: DataFrame, unit: str, period: str, y: str, first_treated: str, draws: int = 999, seed: int = 1) -> DataFrame:
    """(att, se, draws): the mean of effects from treatment on, weighted by treated rows, and its error by random signs of units; weights are taken as known."""
    rows, cells = _cells(df, period, y, first_treated)
    effects = [e for e in _effects(cells) if e[1] >= e[0]]
    if not effects:
        return df.sparkSession.createDataFrame([], "att double, se double, draws long")
    weight = np.array([e[3] for e in effects], float)
    weight /= weight.sum()
    moves = _cell_draws(rows, unit, cells, draws, seed)
    away = sum(w * sum(s * moves[k] for k, s in e[5].items()) for w, e in zip(weight, effects, strict=True))
    att = float(sum(w * e[2] for w, e in zip(weight, effects, strict=True)))
    return df.sparkSession.createDataFrame([(att, float(np.std(away, ddof=1)), draws)], "att double, se double, draws long")


def _two_effects(cells: DataFrame, unit: str, period: str, names: Sequence[str], rounds: int, tolerance: float = 1e-12) -> tuple[DataFrame, DataFrame]:
    """Solve the normal equations of unit and period effects for several right-hand sides at once.

    ``cells``: unit, period, ``n`` (rows) and, for each name, its right-hand side at
    the cell (0 rows allowed).  The units are eliminated, and what is left for
    the periods is solved by conjugate gradients, scaled by their rows; vectors
    are tables with a row per period.  Gives (unit, names), (period, names).
    """
    per_unit = cells.groupBy(unit).agg(F.sum("n").alias("_nu"), *[F.sum(c).alias(f"_q_{c}") for c in names])
    cells = materialised(cells.join(per_unit, unit), "cells")

    def applied(v: DataFrame, cols: Sequence[str]) -> DataFrame:
        """The reduced matrix on the vectors ``cols`` of ``v`` (a row per period)."""
        at_unit = cells.join(v, period).groupBy(unit).agg(*[(F.sum(F.col("n") * F.col(c)) / F.first("_nu")).alias(f"_u_{c}") for c in cols])
        back = cells.join(at_unit, unit).groupBy(period).agg(*[F.sum(F.col("n") * F.col(f"_u_{c}")).alias(f"_b_{c}") for c in cols])
        return v.join(back, period).withColumns({f"_A_{c}": F.col("_nt") * F.col(c) - F.col(f"_b_{c}") for c in cols})

    start = cells.groupBy(period).agg(F.sum("n").alias("_nt"), *[F.sum(F.col(c) - F.col("n") * F.col(f"_q_{c}") / F.col("_nu")).alias(f"r_{c}") for c in names])
    state = start.filter("_nt > 0").withColumns({f"x_{c}": F.lit(0.0) for c in names} | {f"p_{c}": F.col(f"r_{c}") / F.col("_nt") for c in names})
    state = materialised(state, "cg")
    size = lambda d: [x or 0.0 for x in d.agg(*[F.sum(F.col(f"r_{c}") * F.col(f"r_{c}") / F.col("_nt")).alias(c) for c in names]).first()]
    rho = size(state)
    scale = list(cells.agg(*[F.sum(F.col(c) * F.col(c) / F.greatest("n", F.lit(1))).alias(c) for c in names]).first())
    goal = [tolerance * tolerance * max(r, s or 0.0, 1e-300) for r, s in zip(rho, scale, strict=True)]
    for k in range(rounds):
        if all(r <= g for r, g in zip(rho, goal, strict=True)):
            break
        moved = materialised(applied(state, [f"p_{c}" for c in names]), f"cg-{k}")
        curve = list(moved.agg(*[F.sum(F.col(f"p_{c}") * F.col(f"_A_p_{c}")).alias(c) for c in names]).first())
        step = {c: rho[i] / curve[i] if curve[i] and rho[i] > goal[i] else 0.0 for i, c in enumerate(names)}
        moved = moved.withColumns({f"x_{c}": F.col(f"x_{c}") + step[c] * F.col(f"p_{c}") for c in names} | {f"r_{c}": F.col(f"r_{c}") - step[c] * F.col(f"_A_p_{c}") for c in names})
        new = size(moved)
        turn = {c: new[i] / rho[i] if rho[i] else 0.0 for i, c in enumerate(names)}
        state, rho = moved.withColumns({f"p_{c}": F.col(f"r_{c}") / F.col("_nt") + turn[c] * F.col(f"p_{c}") for c in names}).select(state.columns), new
    else:
        raise RuntimeError(f"two effects: not stable after {rounds} rounds")
    times = state.select(period, *[F.col(f"x_{c}").alias(c) for c in names])
    at = cells.drop(*names).join(times, period)
    units = at.groupBy(unit).agg(*[((F.first(f"_q_{c}") - F.sum(F.col("n") * F.col(c))) / F.first("_nu")).alias(c) for c in names])
    return materialised(units, "units"), times


def imputation_effect(df: DataFrame, unit: str, period: str, y: str, treated: str, rounds: int = 500, horizon: Sequence[str] = ()) -> DataFrame:
    """(effect, n, se): unit and period effects from untreated rows; the effect is the mean residual of the treated rows whose unit and period have some.

    The effect is a weighted sum of all values: 1/n for treated rows, and for
    untreated ones what the effects' normal equations give.  Both solutions come
    from one run of conjugate gradients over tables; a ``RuntimeError`` is raised
    if ``rounds`` don't suffice.  ``se`` is clustered by unit: the sum over a
    unit's rows of weight × residual, squared; residuals of treated rows are taken
    from their mean by ``horizon`` (default: from the effect).  Without such rows the
    effect and its error are null.
    """
    kept = df.select(unit, period, F.col(y).cast("double").alias("_y"), F.col(treated).cast("int").alias("_d"), *[c for c in horizon if c not in (unit, period)]).dropna(subset=[unit, period, "_y", "_d"])
    clean = kept.filter("_d = 0").groupBy(unit, period).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("_y").alias("_s"))
    clean = materialised(clean, "untreated")
    on = kept.filter("_d = 1").join(clean.select(unit).distinct(), unit, "left_semi").join(clean.select(period).distinct(), period, "left_semi")
    total = on.count()
    if not total:
        return df.sparkSession.createDataFrame([(None, 0, None)], "effect double, n long, se double")
    asked = on.groupBy(unit, period).agg((F.count(F.lit(1)) / F.lit(float(total))).alias("_w"))
    cells = clean.join(asked, [unit, period], "full").na.fill(0.0, ["n", "_s", "_w"])
    units, times = _two_effects(cells.withColumnsRenamed({"_s": "value", "_w": "weight"}), unit, period, ["value", "weight"], rounds)
    units = units.withColumnsRenamed({"value": "_a", "weight": "_la"})
    times = times.withColumnsRenamed({"value": "_b", "weight": "_lb"})
    left = on.join(units, unit).join(times, period).withColumn("_tau", F.col("_y") - F.col("_a") - F.col("_b"))
    effect = left.agg(F.avg("_tau")).first()[0]
    if horizon:
        left = left.join(left.groupBy(*horizon).agg(F.avg("_tau").alias("_mean")), list(horizon))
    else:
        left = left.withColumn("_mean", F.lit(effect))
    untreated = clean.join(units, unit).join(times, period).select(unit, (-(F.col("_la") + F.col("_lb")) * (F.col("_s") - F.col("n") * (F.col("_a") + F.col("_b")))).alias("_e"))
    both = untreated.unionByName(left.select(unit, ((F.col("_tau") - F.col("_mean")) / float(total)).alias("_e")))
    sums = both.groupBy(unit).agg(F.sum("_e").alias("_e"))
    return sums.agg(F.lit(effect).alias("effect"), F.lit(total).cast("long").alias("n"), F.sqrt(F.sum(F.col("_e") * F.col("_e"))).alias("se"))


def overlap_density(df: DataFrame, score: str, group: str, points: int = 50, bandwidth: float = 0.05) -> DataFrame:
    """Propensity densities by group."""
    return density(df, [group], score, 0.0, 1.0, points, bandwidth)
