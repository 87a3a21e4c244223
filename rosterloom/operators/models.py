"""Likelihood models by Newton steps on k-by-k sums, posterior draws, and nearest donors.

Executors make the sums of one step for all groups (imputed copies) in one pass;
the driver solves k-by-k systems.  Rows that enter must not have nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import materialised


@dataclass(frozen=True)
class Fit:
    """Coefficients (the intercept or the thresholds first), their covariance, and the rows used."""

    beta: np.ndarray
    covariance: np.ndarray
    n: int
    sigma: float = 1.0

    def draw(self, rng: np.random.Generator, k: int) -> tuple[np.ndarray, float]:
        """Coefficients and spread from the posterior under a flat prior; ``k``: coefficients of a linear model, 0 for others."""
        sigma = self.sigma * (np.sqrt(max(1, self.n - k) / rng.chisquare(max(1, self.n - k))) if k else 1.0)
        values, vectors = np.linalg.eigh(self.covariance)
        scale = sigma / self.sigma if k and self.sigma else 1.0
        return self.beta + scale * vectors @ (np.sqrt(np.maximum(values, 0.0)) * rng.standard_normal(len(values))), sigma


def by_group(values: dict, by: str | None) -> Column:
    """A literal array per group."""
    arrays = {g: F.array(*[F.lit(float(x)) for x in v]) for g, v in values.items()}
    if by is None:
        return arrays[None]
    return F.element_at(F.create_map(*[c for g, a in arrays.items() for c in (F.lit(g), a)]), F.col(by))


def with_values(rows: DataFrame, values: dict, by: str | None, out: str = "_b") -> DataFrame:
    """The rows with their group's array as a column: a join keeps the compiled code of a step the same for all steps."""
    spark = rows.sparkSession
    if by is None:
        return rows.crossJoin(F.broadcast(spark.createDataFrame([([float(x) for x in values[None]],)], f"{out} array<double>")))  # one row
    kind = rows.schema[by].dataType.simpleString()
    table = spark.createDataFrame([(g, [float(x) for x in v]) for g, v in values.items()], f"_by {kind}, {out} array<double>")  # a row per group
    return rows.join(F.broadcast(table), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def line(xs: Sequence[str], coefficients: Column, first: int = 0) -> Column:
    return sum((F.col(x) * F.get(coefficients, F.lit(first + i)) for i, x in enumerate(xs)), F.lit(0.0))


def _summed(rows: DataFrame, cells: Sequence[Column], by: str | None) -> dict:
    got = rows.groupBy(*([by] if by else [])).agg(*[F.sum(c).alias(f"c{i}") for i, c in enumerate(cells)]).collect()
    return {(r[0] if by else None): [float(x or 0.0) for x in (list(r)[1:] if by else r)] for r in got}


def _symmetric(k: int, cells: Sequence[float]) -> np.ndarray:
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = cells
    return m + np.triu(m, 1).T


def _newton(evaluate: Callable[[dict], dict], start: dict, rounds: int, name: str, tolerance: float = 1e-14) -> dict:
    """Newton steps, halved where the likelihood falls, until no group's step promises more than ``tolerance`` of it.

    ``evaluate`` gives (log likelihood, gradient, information) for each group.
    """
    at = dict(start)
    held = evaluate(at)
    step = {g: np.linalg.pinv(i) @ d for g, (_, d, i) in held.items()}
    for _ in range(rounds):
        open_ = [g for g, (ll, d, _) in held.items() if abs(step[g] @ d) > tolerance * (1 + abs(ll))]
        if not open_:
            return {g: (at[g], held[g]) for g in held}
        tried = evaluate(at | {g: at[g] + step[g] for g in open_})
        for g in open_:
            if np.isfinite(tried[g][0]) and tried[g][0] >= held[g][0] - 1e-12 * (1 + abs(held[g][0])):
                at[g], held[g] = at[g] + step[g], tried[g]
                step[g] = np.linalg.pinv(held[g][2]) @ held[g][1]
            else:
                step[g] = step[g] / 2
    raise RuntimeError(f"{name}: not stable after {rounds} rounds")


def fit_linear(rows: DataFrame, y: str, xs: Sequence[str], by: str | None = None) -> dict:
    """Least squares with an intercept, from one pass of sums."""
    cols = [F.lit(1.0), *map(F.col, xs), F.col(y)]
    k = len(cols)
    got = _summed(rows, [*[cols[i] * cols[j] for i in range(k) for j in range(i, k)]], by)
    out = {}
    for g, cells in got.items():
        m = _symmetric(k, cells)
        xx, xy, n = m[:-1, :-1], m[:-1, -1], int(m[0, 0])
        inverse = np.linalg.pinv(xx + 1e-8 * np.eye(k - 1))
        beta = inverse @ xy
        sigma = float(np.sqrt(max(0.0, m[-1, -1] - beta @ xy) / max(1, n - k + 1)))
        out[g] = Fit(beta, inverse * sigma**2, n, sigma)
    return out


def prior_scales(rows: DataFrame, xs: Sequence[str], scale: float, intercept: float) -> np.ndarray:
    """Scales of the prior: of the intercept, and for each variable ``scale`` by its range if it has two values, else by two standard deviations."""
    got = rows.agg(*[e for i, x in enumerate(xs) for e in (F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"), F.stddev_samp(x).alias(f"s{i}"))]).first() if xs else ()
    ends = [(got[3 * i], got[3 * i + 1], got[3 * i + 2]) for i in range(len(xs))]
    inside = rows.agg(*[F.max(((F.col(x) > a) & (F.col(x) < b)).cast("int")).alias(f"i{i}") for i, (x, (a, b, _)) in enumerate(zip(xs, ends, strict=True))]).first() if xs and all(a is not None for a, *_ in ends) else [0] * len(xs)
    widths = [(2 * (s or 0.0) if many else (b or 0.0) - (a or 0.0)) or 1.0 for (a, b, s), many in zip(ends, inside, strict=True)]
    return np.array([intercept, *[scale / w for w in widths]])


def fit_logistic(rows: DataFrame, y: str, xs: Sequence[str], by: str | None = None, scales: np.ndarray | None = None, df: float = 1.0, rounds: int = 100, start: dict | None = None) -> dict:
    """Logistic regression of ``y`` (0 or 1) with an intercept.

    With ``scales`` each coefficient has a Student prior of ``df`` degrees of
    freedom around 0: the weight of the prior follows the coefficient, as in an
    EM step, and the mode is finite even where the classes are separated.
    """
    names = ["_one", *xs]
    rows = rows.withColumn("_one", F.lit(1.0))
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def evaluate(at: dict) -> dict:
        eta = line(names, F.col("_b"))
        p = 1 / (1 + F.exp(-eta))
        # log(1 + exp(eta)) without overflow
        ll = F.col(y) * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta)))
        made = with_values(rows, at, by).withColumns({"_r": F.col(y) - p, "_w": p * (1 - p), "_ll": ll})
        got = _summed(made, [F.col("_ll"), *[F.col(n) * F.col("_r") for n in names], *[F.col(names[i]) * F.col(names[j]) * F.col("_w") for i, j in pairs]], by)
        out = {}
        for g, cells in got.items():
            loss, gradient, information = cells[0], np.array(cells[1 : k + 1]), _symmetric(k, cells[k + 1 :])
            if scales is not None:
                b = at[g]
                pull = (df + 1) / (df * scales**2 + b**2)
                loss -= (df + 1) / 2 * float(np.log1p(b**2 / (df * scales**2)).sum())
                # the prior's own curvature, where it is not flat or bent the other way: steps of Newton, not of EM
                bend = (df + 1) * (df * scales**2 - b**2) / (df * scales**2 + b**2) ** 2
                gradient, information = gradient - pull * b, information + np.diag(np.where(bend > 0, bend, pull))
            out[g] = (loss, gradient, information)
        return out

    counts = _summed(rows, [F.lit(1.0)], by)
    found = _newton(evaluate, {g: (start or {}).get(g, np.zeros(k)) for g in counts}, rounds, "fit_logistic")
    return {g: Fit(b, np.linalg.pinv(i), int(counts[g][0])) for g, (b, (_, _, i)) in found.items()}


def fit_ordered(rows: DataFrame, y: str, xs: Sequence[str], levels: int, by: str | None = None, rounds: int = 100, start: dict | None = None) -> dict:
    """Proportional odds: P(y <= j) = 1 / (1 + exp(-(threshold_j - x b))) for ``y`` in 0 .. levels - 1; thresholds come first.  Fisher's scoring."""
    k, m = len(xs), levels - 1
    counts = _summed(rows, [F.when(F.col(y) == j, 1.0) for j in range(levels)], by)
    # half a row more in each level, so that the first thresholds differ
    begin = {g: np.cumsum(np.array(c) + 0.5)[:-1] / (sum(c) + levels / 2) for g, c in counts.items()}
    begin = {g: np.concatenate([np.log(s / (1 - s)), np.zeros(k)]) for g, s in begin.items()} | (start or {})
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def evaluate(at: dict) -> dict:
        b = F.col("_b")
        made = with_values(rows, at, by).withColumn("_eta", line(xs, b, m))
        made = made.withColumns({f"_F{j}": 1 / (1 + F.exp(F.col("_eta") - F.get(b, F.lit(j)))) for j in range(m)})
        big = [F.lit(0.0), *[F.col(f"_F{j}") for j in range(m)], F.lit(1.0)]
        small = [x * (1 - x) for x in big]  # density at each threshold, 0 at both ends
        made = made.withColumns({f"_p{j}": F.greatest(big[j + 1] - big[j], F.lit(1e-300)) for j in range(levels)} | {f"_f{j}": small[j + 1] for j in range(m)})
        p = [F.col(f"_p{j}") for j in range(levels)]
        f = [F.lit(0.0), *[F.col(f"_f{j}") for j in range(m)], F.lit(0.0)]
        own = lambda values: F.get(F.array(*values), F.col(y).cast("int"))
        made = made.withColumns({"_own": own(p), "_d": own([(f[j + 1] - f[j]) for j in range(levels)])})
        made = made.withColumn("_ww", sum(((f[j + 1] - f[j]) * (f[j + 1] - f[j]) / p[j] for j in range(levels)), F.lit(0.0)))
        cross = [-f[j + 1] * ((f[j + 1] - f[j]) / p[j] - (f[j + 2] - f[j + 1]) / p[j + 1]) for j in range(m)]
        cells = [F.log(F.col("_own"))]
        cells += [(F.when(F.col(y) == j, 1.0).when(F.col(y) == j + 1, -1.0).otherwise(0.0)) * f[j + 1] / F.col("_own") for j in range(m)]
        cells += [-F.col(x) * F.col("_d") / F.col("_own") for x in xs]
        cells += [f[j + 1] * f[j + 1] * (1 / p[j] + 1 / p[j + 1]) for j in range(m)]
        cells += [-f[j + 1] * f[j + 2] / p[j + 1] for j in range(m - 1)]
        cells += [F.col(x) * cross[j] for j in range(m) for x in xs]
        cells += [F.col(xs[i]) * F.col(xs[j]) * F.col("_ww") for i, j in pairs]
        out = {}
        for g, got in _summed(made, cells, by).items():
            sorted_ = bool(np.all(np.diff(at[g][:m]) > 0))
            loss, gradient, rest = got[0] if sorted_ else -np.inf, np.array(got[1 : 1 + m + k]), got[1 + m + k :]
            info = np.zeros((m + k, m + k))
            info[range(m), range(m)] = rest[:m]
            for j, v in enumerate(rest[m : 2 * m - 1]):
                info[j, j + 1] = info[j + 1, j] = v
            block = np.array(rest[2 * m - 1 : 2 * m - 1 + m * k]).reshape(m, k)
            info[:m, m:], info[m:, :m] = block, block.T
            info[m:, m:] = _symmetric(k, rest[2 * m - 1 + m * k :])
            out[g] = (loss, gradient, info)
        return out

    found = _newton(evaluate, begin, rounds, "fit_ordered", 1e-11)
    return {g: Fit(b, np.linalg.pinv(i), int(sum(counts[g]))) for g, (b, (_, _, i)) in found.items()}


def nearest_donors(recipients: DataFrame, donors: DataFrame, value: str, key: str, k: int = 5, by: Sequence[str] = (), out: str = "donors") -> DataFrame:
    """The recipients with ``out``: the ``k`` donors nearest in ``value``, nearest first, as structs of all donor columns but ``by``.

    Donors are numbered in order of (by, value, key) by range partitions with
    offsets, recipients placed between them, so the nearest are among ``k`` numbers
    on either side: an equal join, no sort of all in one task, and one search for
    each distinct value.  Ties in distance go to the donor nearer in that order,
    then to the lower number.  Null values have no donors (null) and are none.
    """
    parts = max(1, int(recipients.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    v = F.col(value).cast("double").alias("_v")
    asked = recipients.select(*by, v).filter("_v is not null").distinct()
    given = donors.select(*by, v, F.struct(*[c for c in donors.columns if c not in by]).alias("_donor"), F.col(key).alias("_key")).filter("_v is not null")
    both = asked.withColumn("_kind", F.lit(0)).unionByName(given.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    order = [*[F.col(c).asc_nulls_first() for c in by], F.col("_v"), F.col("_kind"), F.col("_key")]
    ranged = materialised(both.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), "donors")
    sizes = ranged.groupBy("_p").agg(F.sum("_kind").alias("_n"))  # a row per partition
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum("_kind").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = ranged.join(F.broadcast(offsets), "_p").withColumn("_at", (F.col("_before") + inside).cast("long"))  # offsets: as many rows as partitions
    near = placed.filter("_kind = 0").select(*by, "_v", F.col("_at").alias("_b"), F.explode(F.sequence(F.col("_at") - (k - 1), F.col("_at") + k)).alias("_at"))
    other = placed.filter("_kind = 1").select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_v").alias("_dv"), "_at", "_donor")
    met = near.join(other, "_at")
    for i, c in enumerate(by):
        met = met.filter(F.col(c).eqNullSafe(F.col(f"_by{i}")))
    rank = F.struct(F.abs(F.col("_v") - F.col("_dv")).alias("distance"), F.abs(F.col("_at") - F.col("_b") - 0.5).alias("places"), F.col("_at").alias("at"), F.col("_donor").alias("donor"))
    first = F.slice(F.array_sort(F.collect_list(rank)), 1, k)  # 2k rows of a value at most
    best = met.groupBy(*by, "_v").agg(F.transform(first, lambda x: x["donor"]).alias(out))
    for i, c in enumerate(by):
        best = best.withColumnRenamed(c, f"_by{i}")
    cond = F.col(value).cast("double").eqNullSafe(F.col("_v"))
    for i, c in enumerate(by):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return recipients.join(best, cond, "left").select(*recipients.columns, out)
