"""Window operators; every order must end in a unique column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import dense_ids


def with_count(df: DataFrame, keys: Sequence[str], out: str = "n", others: bool = False) -> DataFrame:
    """Rows of each key on every row (with ``others``: the other holders of the key)."""
    counts = df.groupBy(*keys).agg((F.count(F.lit(1)) - (1 if others else 0)).alias("__n"))
    counts = counts.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], "__n")
    # counted first, then joined: a frequent key is split over tasks
    same = [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)]
    return df.drop(out).join(counts, same).withColumn(out, F.col("__n")).select(*[c for c in df.columns if c != out], out)


def by_group_size(df: DataFrame, keys: Sequence[str], size: int = 1, keep: bool = True) -> DataFrame:
    hit = F.col("__count") == size
    return with_count(df, keys, "__count").filter(hit if keep else ~hit).drop("__count")


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column], accept: Column | None = None) -> DataFrame:
    """The first row per key; ``accept`` is asked of that row only, so a key can end up without one."""
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter((F.col("__rn") == 1) & (accept if accept is not None else F.lit(True))).drop("__rn")


def later_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The duplicates after the first."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn > 1").drop("__rn")


def fill(df: DataFrame, names: Sequence[str], keys: Sequence[str], order: Sequence[Column], direction: str = "down") -> DataFrame:
    """Nulls from the last known value (down), the next one (up), or down and then up."""
    w = Window.partitionBy(*keys).orderBy(*order)
    down, up = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    kinds = {
        "down": lambda c: F.last(c, ignorenulls=True).over(down),
        "up": lambda c: F.first(c, ignorenulls=True).over(up),
        "downup": lambda c: F.coalesce(F.last(c, ignorenulls=True).over(down), F.first(c, ignorenulls=True).over(up)),
    }
    return df.withColumns({n: kinds[direction](n) for n in names})


def lags(df: DataFrame, names: Sequence[str], keys: Sequence[str], order: Sequence[Column], steps: Sequence[int] = (1, 2, 3)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"{n}_lag{k}": F.lag(n, k).over(w) for n in names for k in steps})


def spread(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Aggregates of the group on each of its rows."""
    w = Window.partitionBy(*keys)
    return df.withColumns({n: a.over(w) for n, a in aggs.items()})


def extreme_rows(df: DataFrame, keys: Sequence[str], value: str, largest: bool = False, also: Column | None = None) -> DataFrame:
    """Rows equal to the group's extreme; ``also`` filters after the extreme is taken."""
    w = Window.partitionBy(*keys)
    at = (F.max if largest else F.min)(value).over(w)
    return df.withColumn("__extreme", at).filter((F.col(value) == F.col("__extreme")) & (also if also is not None else F.lit(True))).drop("__extreme")


def random_row(df: DataFrame, keys: Sequence[str], unique: Sequence[str], seed: int = 1) -> DataFrame:
    """One row per group by a seeded hash (md5, which other engines have too) of the unique columns: the same on any layout."""
    return first_row(df, keys, [F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(u).cast("string") for u in unique])), *[F.col(u) for u in unique]])


def with_group_id(df: DataFrame, keys: Sequence[str], out: str = "group_id") -> DataFrame:
    """Dense ids of the distinct keys, in their order, without a single-task sort."""
    ids = dense_ids(df.select(*keys).distinct(), [F.col(k).asc_nulls_first() for k in keys], out)
    joined = df
    for k in keys:
        ids = ids.withColumnRenamed(k, f"_k_{k}")
    cond = [joined[k].eqNullSafe(ids[f"_k_{k}"]) for k in keys]
    return joined.join(ids, cond).select(*df.columns, out)


def surrogate_key(df: DataFrame, order: Sequence[str], out: str = "row_id") -> DataFrame:
    """Row numbers from 1 over the whole table in a total order: range partitions with offsets."""
    return dense_ids(df, [F.col(c).asc_nulls_first() for c in order], out)


def changes(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[Column], out: str = "changes") -> DataFrame:
    """How often a value differs from the row before, nulls left out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = df.withColumn("__step", (F.col(value) != F.lag(value).over(w)).cast("int"))
    return step.withColumn(out, F.coalesce(F.sum("__step").over(Window.partitionBy(*keys)), F.lit(0))).drop("__step")


def first_known(value: str, keys: Sequence[str], order: Sequence[Column]) -> Column:
    return F.first(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def once_per_group(df: DataFrame, value: str, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """The value on the first row of its group and 0 on the others, so that sums don't count it twice."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.when(F.row_number().over(w) == 1, F.col(value)).otherwise(0))


def first_or(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cond: Column) -> DataFrame:
    """The first row per key, and all rows that meet a condition."""
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter((F.col("__rn") == 1) | cond).drop("__rn")


def number_by_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with their counts, numbered within equal counts."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    # most keys may share one count: numbered over ranges of all, then from the first of each count
    ids = dense_ids(counts, [F.col("n"), *[F.col(k).asc_nulls_first() for k in keys]], "_id")
    first = ids.groupBy("n").agg(F.min("_id").alias("_first"))
    return ids.join(first, "n").select(*keys, "n", (F.col("_id") - F.col("_first") + 1).cast("int").alias("place"))
