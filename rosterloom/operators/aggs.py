"""Aggregates with stated null and tie policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import materialised


def strict(agg: Column, c: Column) -> Column:
    """An aggregate that is null if any value of the group is null."""
    return F.when(F.count_if(c.isNull()) == 0, agg)


def summary(df: DataFrame, by: Sequence[str], value: str, skip_null: bool = True) -> DataFrame:
    c = F.col(value)
    keep = (lambda a: a) if skip_null else (lambda a: strict(a, c))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), keep(F.sum(c)).alias("sum"), keep(F.avg(c)).alias("mean"),
        keep(F.stddev_samp(c)).alias("sd"), keep(F.min(c)).alias("min"), keep(F.max(c)).alias("max"),
    )


def count_of_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """How many groups have each size."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def having(df: DataFrame, by: Sequence[str], least: int) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def mode(df: DataFrame, by: Sequence[str], value: str, tie: str = "min", order: str | None = None) -> DataFrame:
    """The most frequent value; ``tie``: min, max, first or last seen (by ``order``), or all tied values.

    Nulls don't count.  The window sees one row per distinct value, not per row.
    """
    seen = F.min(order) if order else F.min(value)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"), seen.alias("_seen"))
    ties = {"min": [F.col(value)], "max": [F.col(value).desc()], "first": [F.col("_seen"), F.col(value)], "last": [F.col("_seen").desc(), F.col(value).desc()], "all": []}[tie]
    w = Window.partitionBy(*by).orderBy(F.desc("_n"), *ties)
    return counts.withColumn("_r", F.rank().over(w)).filter("_r = 1").select(*by, value)


def reduce_vintages(df: DataFrame, key: Sequence[str], value: str, year: str, how: str) -> DataFrame:
    """One value per key from its yearly values: latest known, mean, or a mode with tie min, max or last."""
    known = df.filter(F.col(value).isNotNull())
    if how == "latest":
        return known.groupBy(*key).agg(F.max_by(value, F.struct(year, value)).alias(value))
    if how == "mean":
        return known.groupBy(*key).agg(F.avg(value).alias(value))
    return mode(known, key, value, {"mode_min": "min", "mode_max": "max", "mode_last": "last"}[how], year)


def single_or_null(c: Column, count_null: bool = False) -> Column:
    """The value on which a group agrees, else null; ``count_null``: a null disagrees."""
    one = F.when(F.count_distinct(c) == 1, F.max(c))
    return F.when(F.count_if(c.isNull()) == 0, one) if count_null else one


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(by, q): exact interpolated quantiles of each group as an array, however large the group.

    Distinct values are counted and range-sorted; offsets of the ranges and sums
    inside them give the ranks, so no task holds a group's values at once.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = {b: f"_k{k}" for k, b in enumerate(by)}
    counts = df.filter(F.col(value).isNotNull()).groupBy(*[F.col(b).alias(k) for b, k in keys.items()], F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    names = list(keys.values())
    rows = materialised(counts.repartitionByRange(n, *names, "_v").withColumn("_p", F.spark_partition_id()), "quantiles")
    sums = rows.groupBy(*names, "_p").agg(F.sum("_n").alias("_s"))  # a row per group and range
    upto = Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_s").over(upto), F.lit(0)), "_all": F.sum("_s").over(Window.partitionBy(*names))}).drop("_s")
    joined = rows.alias("r").join(sums.alias("s"), [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*names, "_p")])
    inside = Window.partitionBy(*[f"r.{k}" for k in names], "r._p").orderBy("r._v").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("s._before") + F.sum("r._n").over(inside)  # places from 1 up to which the value stands
    ranked = joined.select(*[F.col(f"r.{k}").alias(k) for k in names], "r._v", "s._all", (last - F.col("r._n")).alias("_from"), last.alias("_to"))
    at = lambda x: F.max(F.when((F.col("_from") <= x) & (x < F.col("_to")), F.col("_v")))
    cells = []
    for share in shares:
        place = (F.col("_all") - 1) * F.lit(float(share))
        low, high = at(F.floor(place)), at(F.ceil(place))
        cells.append(low + (high - low) * F.max(place - F.floor(place)))
    out = ranked.groupBy(*names).agg(F.array(*cells).alias("q")) if names else ranked.agg(F.array(*cells).alias("q"))
    return out.withColumnsRenamed({k: b for b, k in keys.items()})


def six_number(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Minimum, quartiles (interpolated), mean and maximum."""
    rest = df.groupBy(*by).agg(F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    q = quantiles(df, by, value, (0.25, 0.5, 0.75)).withColumnsRenamed({b: f"_q_{b}" for b in by})
    out = rest.join(q, [F.col(b).eqNullSafe(F.col(f"_q_{b}")) for b in by], "left")
    return out.select(*by, "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), "mean", F.col("q")[2].alias("q3"), "max")


def boxplot(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers within 1.5 times their distance, notch of the median and outliers.

    Quartiles are interpolated; for very small groups hinges can differ slightly.
    """
    s = six_number(df.filter(F.col(value).isNotNull()), by, value).select(*[F.col(b).alias(f"_by_{b}") for b in by], "q1", "median", "q3")
    s = s.withColumns({"_lo": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), "_hi": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    inside = F.col(value).between(F.col("_lo"), F.col("_hi"))
    same = [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by] or F.lit(True)  # a null group is a group
    out = df.filter(F.col(value).isNotNull()).join(s, same).groupBy(*by).agg(
        *[F.first(c).alias(c) for c in ("q1", "median", "q3")],
        F.min(F.when(inside, F.col(value))).alias("whisker_low"), F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"), F.count(F.lit(1)).alias("n"),
    )
    half = 1.58 * (F.col("q3") - F.col("q1")) / F.sqrt("n")
    return out.withColumns({"notch_low": F.col("median") - half, "notch_high": F.col("median") + half})


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Share of the values in each of ``bins`` equal bins; the upper end belongs to the last."""
    b = F.least(F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins).cast("long"))
    counts = df.filter(F.col(value).between(low, high)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bin", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def ecdf(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The share of values up to each distinct value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(*by, value, (F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy(*by))).alias("share"))


def density(df: DataFrame, by: Sequence[str], value: str, low: float, high: float, points: int, bandwidth: float, bins: int = 512) -> DataFrame:
    """Gaussian kernel density at equally spaced points, from binned counts (bounded by bins × points per group)."""
    width = (high - low) / bins
    b = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1))
    counts = df.filter(F.col(value).between(low, high)).groupBy(*by, b.alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    grid = counts.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.lit(low) + F.col("_k") * ((high - low) / (points - 1)))
    z = (F.col("x") - (F.lit(low) + (F.col("_b") + 0.5) * width)) / bandwidth
    out = grid.groupBy(*by, "x").agg(F.sum(F.col("n") * F.exp(-z * z / 2)).alias("_s"), F.sum("n").alias("_n"))
    return out.select(*by, "x", (F.col("_s") / (F.col("_n") * bandwidth * 2.5066282746310002)).alias("density"))


def percentile_groups(df: DataFrame, value: str, n: int = 100, out: str = "group") -> DataFrame:
    """Groups 1 to n by percentile cut points: equal values share a group (``ntile`` would part them)."""
    cuts = quantiles(df, [], value, [i / n for i in range(1, n)]).withColumnRenamed("q", "_cuts")
    joined = df.crossJoin(F.broadcast(cuts))  # one row of n - 1 numbers
    return joined.withColumn(out, F.when(F.col(value).isNotNull(), 1 + F.size(F.filter("_cuts", lambda c: c < F.col(value))))).drop("_cuts")


def nested_mean(df: DataFrame, inner: Sequence[str], outer: Sequence[str], value: str) -> DataFrame:
    """Mean over outer groups of the means of inner groups."""
    return df.groupBy(*dict.fromkeys([*outer, *inner])).agg(F.avg(value).alias("_m")).groupBy(*outer).agg(F.avg("_m").alias("mean"), F.count(F.lit(1)).alias("groups"))


def first_by(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.min_by(value, F.struct(*order)).alias(value))


def share_of(cond: Column) -> Column:
    return F.avg(cond.cast("double"))
