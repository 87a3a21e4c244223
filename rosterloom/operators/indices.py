"""Socio-economic indices: completeness, components, chained imputation."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import models
from .graph import materialised


def completeness_filter(df: DataFrame, names: Sequence[str], share: float = 0.65) -> DataFrame:
    """Rows with at least ``share`` of the answers of the most complete row."""
    held = sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
    rows = df.withColumn("_held", held)
    most = rows.agg(F.max("_held")).first()[0] or 0
    return rows.filter(F.col("_held") >= share * most).drop("_held")


def household_reduce(df: DataFrame, household: str, assets: Sequence[str], order: Sequence[Column], heads: Column | None = None) -> DataFrame:
    """One row per household: the most of each asset over its members, and its best-educated head or partner."""
    w = Window.partitionBy(household)
    rows = df.withColumns({c: F.max(c).over(w) for c in assets})
    rows = rows.filter(heads) if heads is not None else rows
    return rows.withColumn("_rn", F.row_number().over(w.orderBy(*order))).filter("_rn = 1").drop("_rn")


#: Levels of an ordinal item at most, for its contingency tables.
MAX_LEVELS = 50


def _normal(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(np.clip(x, -9, 9) / math.sqrt(2)))


def _both_below(h: np.ndarray, k: np.ndarray, r: float) -> np.ndarray:
    """P(X <= h, Y <= k) of two normal values of correlation ``r``: its derivative by r, integrated."""
    at, weight = np.polynomial.legendre.leggauss(24)
    rho = r * (at + 1) / 2
    h, k = np.clip(h, -9, 9), np.clip(k, -9, 9)
    slope = np.exp(-(h[..., None] ** 2 - 2 * rho * h[..., None] * k[..., None] + k[..., None] ** 2) / (2 * (1 - rho**2))) / (2 * math.pi * np.sqrt(1 - rho**2))
    return _normal(h) * _normal(k) + (slope * weight).sum(axis=-1) * r / 2


def latent_correlation(table: np.ndarray) -> float:
    """The correlation of two normal values that thresholds turn into a contingency table, by most likely value (two steps)."""
    table = table[table.sum(axis=1) > 0][:, table.sum(axis=0) > 0]
    if min(table.shape) < 2:
        return 0.0
    grid = np.linspace(-9, 9, 20_001)
    cut = lambda s: np.concatenate([[-9.0], np.interp(np.cumsum(s)[:-1] / s.sum(), _normal(grid), grid), [9.0]])
    h, k = np.meshgrid(cut(table.sum(axis=1)), cut(table.sum(axis=0)), indexing="ij")

    def loss(r: float) -> float:
        below = _both_below(h, k, r)
        cells = below[1:, 1:] - below[:-1, 1:] - below[1:, :-1] + below[:-1, :-1]
        return -float((table * np.log(np.maximum(cells, 1e-12))).sum())

    low, high, golden = -0.995, 0.995, (math.sqrt(5) - 1) / 2
    while high - low > 1e-6:
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return (low + high) / 2


def latent_correlations(df: DataFrame, names: Sequence[str]) -> np.ndarray:
    """Latent-trait correlations of ordinal items, from the contingency tables of all pairs: one pass, bounded by levels."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    each = F.array(*[F.struct(F.lit(k).alias("pair"), F.col(names[i]).cast("double").alias("a"), F.col(names[j]).cast("double").alias("b")) for k, (i, j) in enumerate(pairs)])
    counts = df.dropna(subset=list(names)).select(F.inline(each)).groupBy("pair", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    got = counts.limit(len(pairs) * MAX_LEVELS**2 + 1).collect()
    corr = np.eye(len(names))
    for k, (i, j) in enumerate(pairs):
        own = [r for r in got if r["pair"] == k]
        a, b = sorted({r["a"] for r in own}), sorted({r["b"] for r in own})
        if max(len(a), len(b)) > MAX_LEVELS or len(got) > len(pairs) * MAX_LEVELS**2:
            raise ValueError(f"{names[i]}, {names[j]}: over {MAX_LEVELS} levels")
        table = np.zeros((len(a), len(b)))
        for r in own:
            table[a.index(r["a"]), b.index(r["b"])] = r["n"]
        corr[i, j] = corr[j, i] = latent_correlation(table) if own else 0.0
    return corr


def first_component(corr: np.ndarray) -> np.ndarray:
    """The first eigenvector of a correlation matrix, its sum positive; where that is 0, the first weight that isn't.

    Two items weigh 1 / sqrt 2 each, the second with the sign of the correlation
    (plus if it is 0): given directly, as rounding would choose the sign.
    """
    if len(corr) == 2:
        return np.array([1.0, -1.0 if corr[0, 1] < 0 else 1.0]) / math.sqrt(2)
    vector = np.linalg.eigh(corr)[1][:, -1]
    total = vector.sum()
    if abs(total) < 1e-9:
        total = vector[np.flatnonzero(np.abs(vector) > 1e-9)[0]]
    return vector if total >= 0 else -vector


def component_index(df: DataFrame, names: Sequence[str], out: str = "index", latent: bool = False) -> DataFrame:
    """The first principal component of ordinal items: sum of weights × standardised items.

    Correlations are Pearson's on the codes, or with ``latent`` those of the
    normal traits behind them; one pass gives all sums, the k-by-k matrix is
    solved on the driver.  Rows with a null item get null.
    """
    cols = [F.col(c).cast("double") for c in names]
    full = df.dropna(subset=list(names))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    got = list(full.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)], *[F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]).first())
    k = len(names)
    mean, sd = np.array(got[:k], float), np.array(got[k : 2 * k], float)
    corr = np.eye(k)
    for (i, j), v in zip(pairs, got[2 * k :], strict=True):
        corr[i, j] = corr[j, i] = v / (sd[i] * sd[j]) if sd[i] * sd[j] > 0 else float(i == j)
    if latent:
        corr = latent_correlations(df, names)
    vector = first_component(corr)
    score = F.lit(0.0)
    for c, w, m, s in zip(cols, vector, mean, sd, strict=True):
        score = score + (c - float(m)) / float(s or 1.0) * float(w)
    return df.withColumn(out, score)


def composite_index(df: DataFrame, groups: dict[str, Sequence[str]], also: Sequence[str] = (), out: str = "index") -> DataFrame:
    """An index of each group of items, and one over these and other columns."""
    for name, items in groups.items():
        df = component_index(df, items, name)
    return component_index(df, [*groups, *also], out)


def chained_imputation(
    df: DataFrame, key: str, names: Sequence[str], copies: int = 5, rounds: int = 5, seed: int = 1, kinds: Mapping[str, str] | None = None,
    order: Sequence[str] | None = None, posterior: bool = True, donors: int = 5,
) -> DataFrame:
    """``copies`` completed copies (column ``imputation``): each variable in turn from the others, drawn from a model of its kind.

    ``kinds``: ``linear`` (default; normal noise), ``binary`` (0 or 1, logistic
    regression), ``ordered`` (proportional odds over the observed levels) or
    ``donor`` (the observed value of one of the ``donors`` nearest in predicted
    mean, of the same copy).  ``order``: the variables in the order of their turns
    (default: as named).  With ``posterior`` the coefficients of each copy are
    drawn from their posterior first; without, they stay at their estimates.

    Models come from passes of sums over all copies at once.  Draws come from
    hashes of key, copy, round and variable and from seeded generators, so a lost
    task redraws the same values.  Observed cells never change.  A variable
    without any observed value stays null and predicts nothing; a variable of
    one observed value is filled with it.  An empty table gives no rows.
    """
    kinds = dict(kinds or {})
    if set(kinds.values()) - {"linear", "binary", "ordered", "donor"}:
        raise ValueError(f"unknown kind among {sorted(set(kinds.values()))}")
    number = lambda c: F.col(c).cast("double")
    facts = df.agg(*[f(number(c)).alias(f"{n}_{i}") for i, c in enumerate(names) for n, f in (("n", F.count), ("avg", F.avg), ("low", F.min), ("high", F.max))], F.count(F.lit(1)).alias("rows")).first()
    about = {c: dict(zip(("n", "mean", "low", "high"), facts[4 * i : 4 * i + 4], strict=True)) for i, c in enumerate(names)}
    # as many numbers as a variable of this kind has levels
    levels = {c: sorted(r[0] for r in df.select(number(c)).dropna().distinct().collect()) for c, kind in kinds.items() if kind in ("ordered", "binary")}
    for c, kind in kinds.items():
        if kind == "binary" and not set(levels[c]) <= {0.0, 1.0}:
            raise ValueError(f"{c} is not 0 or 1")
    used = [c for c in names if about[c]["n"]]
    missing = [c for c in (order or names) if about[c]["n"] and about[c]["n"] < facts["rows"]]
    rows = df.withColumn("imputation", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    rows = rows.withColumns({f"_na_{c}": F.col(c).isNull() for c in names} | {c: F.coalesce(number(c), F.lit(about[c]["mean"])) for c in names})
    rows = materialised(rows, "impute")
    last: dict = {}  # the estimates of the round before, to begin with
    for r in range(rounds):
        for v, c in enumerate(missing):
            kind = kinds.get(c, "linear")
            if about[c]["low"] == about[c]["high"]:
                continue  # the mean is the one value
            others = [o for o in used if o != c]
            seen = rows.filter(~F.col(f"_na_{c}"))
            u = [_draw(F.col(key), F.col("imputation"), f"{seed}-{r}-{v}-{k}") for k in (0, 1)]
            if kind == "binary":
                fits = models.fit_logistic(seen, c, others, "imputation", models.prior_scales(seen, others, 10.0, 10.0), start=last.get(c))
            elif kind == "ordered":
                place = F.array_position(F.array(*[F.lit(x) for x in levels[c]]), F.col(c)) - 1
                fits = models.fit_ordered(seen.withColumn("_level", place), "_level", others, len(levels[c]), "imputation", start=last.get(c))
            else:
                fits = models.fit_linear(seen, c, others, "imputation")
            last[c] = {m: fit.beta for m, fit in fits.items()}
            k = len(others) + 1 if kind in ("linear", "donor") else 0
            drawn = {m: fit.draw(np.random.default_rng([seed, r, v, m]), k) if posterior else (fit.beta, fit.sigma) for m, fit in fits.items()}
            b = models.by_group({m: x for m, (x, _) in drawn.items()}, "imputation")
            if kind == "ordered":
                cuts = len(levels[c]) - 1
                b = models.by_group({m: np.concatenate([np.sort(x[:cuts]), x[cuts:]]) for m, (x, _) in drawn.items()}, "imputation")
                eta = models.line(others, b, cuts)
                above = sum(((u[0] > 1 / (1 + F.exp(eta - F.get(b, F.lit(j))))).cast("int") for j in range(cuts)), F.lit(0))
                value = F.get(F.array(*[F.lit(x) for x in levels[c]]), above)
            elif kind == "binary":
                value = (u[0] < 1 / (1 + F.exp(-(F.get(b, F.lit(0)) + models.line(others, b, 1))))).cast("double")
            elif kind == "linear":
                spread = F.get(models.by_group({m: [s] for m, (_, s) in drawn.items()}, "imputation"), F.lit(0))
                value = F.get(b, F.lit(0)) + models.line(others, b, 1) + spread * F.sqrt(-2 * F.log(u[0])) * F.cos(2 * np.pi * u[1])
            else:
                hat = models.by_group({m: fit.beta for m, fit in fits.items()}, "imputation")
                mean = lambda a: F.get(a, F.lit(0)) + models.line(others, a, 1)
                given = seen.select("imputation", mean(hat).alias("_mean"), F.col(key).alias("_k"), F.col(c).alias("_given"))
                lacking = rows.filter(F.col(f"_na_{c}")).select(F.col(key).alias("_key2"), F.col("imputation").alias("_copy"), mean(b).alias("_mean"), "imputation")
                found = models.nearest_donors(lacking, given, "_mean", "_k", donors, ["imputation"])
                pick = F.get(F.col("donors"), F.floor(F.size("donors") * _draw(F.col("_key2"), F.col("_copy"), f"{seed}-{r}-{v}-0")).cast("int"))["_given"]
                # a key that stands in more than one row has equal draws: one value of each is enough
                picked = found.groupBy("_key2", "_copy").agg(F.min(pick).alias("_picked"))
                rows = rows.join(picked, (F.col(key) == F.col("_key2")) & (F.col("imputation") == F.col("_copy")), "left").drop("_key2", "_copy")
                value = F.coalesce(F.col("_picked"), F.col(c))
            rows = rows.withColumn(c, F.when(F.col(f"_na_{c}"), value).otherwise(F.col(c))).drop("_picked")
            if kind == "donor":
                rows = materialised(rows, f"impute-{r}-{v}")
        rows = materialised(rows, f"impute-{r}")
    return rows.drop(*[f"_na_{c}" for c in names])


def _draw(key: Column, copy: Column, name: str) -> Column:
    """A number between 0 and 1 from 40 bits of an md5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), copy.cast("string"), F.lit(name))), 1, 10), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 40)


def pool_scores(df: DataFrame, key: str, score: str) -> DataFrame:
    """Mean over imputations."""
    return df.groupBy(key).agg(F.avg(score).alias(score))
