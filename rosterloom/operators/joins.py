"""Joins with a stated null policy.

``null_safe=False``: a null key matches nothing; ``True``: null matches null.
Physical strategy is left to the optimizer and adaptive execution; nothing is
broadcast by hand here.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed_join(x: DataFrame, y: DataFrame, by: Sequence[str] | None = None, how: str = "inner", null_safe: bool = False, suffix: str = "_y") -> DataFrame:
    """Join on ``by`` (default: all shared columns); clashing other columns of ``y`` get a suffix."""
    by = list(by or [c for c in x.columns if c in y.columns])
    clash = [c for c in y.columns if c in x.columns and c not in by]
    y = y.withColumnsRenamed({c: c + suffix for c in clash})
    if how in ("left_semi", "left_anti"):
        y = y.select(*by)
    if not null_safe:
        return x.join(y, by, how)
    right = y.withColumnsRenamed({k: f"_by_{k}" for k in by})
    cond = reduce(lambda a, b: a & b, [x[k].eqNullSafe(right[f"_by_{k}"]) for k in by])
    out = x.join(right, cond, how)
    if how in ("left_semi", "left_anti"):
        return out
    pick = {k: F.coalesce(F.col(k), F.col(f"_by_{k}")) if how in ("full", "outer", "right") else F.col(k) for k in by}
    return out.select(*[pick[c].alias(c) if c in pick else F.col(c) for c in x.columns], *[c for c in y.columns if c not in by])


def full_join_all(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """N-way full join of tables that are unique on one key and share no other column: one union and one shuffle."""
    names = [c for t in tables for c in t.columns if c != key]
    if len(set(names)) < len(names):
        raise ValueError("columns clash")
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return stacked.groupBy(key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])


def coalesce_join(x: DataFrame, y: DataFrame, by: Sequence[str], reverse: bool = False, how: str = "full", null_safe: bool = False) -> DataFrame:
    """Join, then merge every shared other column: the left value first, with ``reverse`` the right one."""
    shared = [c for c in y.columns if c in x.columns and c not in by]
    out = keyed_join(x, y, by, how, null_safe, suffix="__r")
    merged = {c: (F.coalesce(f"{c}__r", c) if reverse else F.coalesce(c, f"{c}__r")) for c in shared}
    return out.select(*[merged[c].alias(c) if c in merged else F.col(c) for c in x.columns], *[c for c in y.columns if c not in x.columns])


def unique_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in an order that must end in a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def fallback_join(df: DataFrame, ref: DataFrame, fine: Sequence[str], coarse: Sequence[str], value: str) -> DataFrame:
    """``value`` of the reference by the fine key, else by the coarse key.

    The least value is taken where the reference repeats a key, so rows never multiply.
    """
    a = ref.groupBy(*fine).agg(F.min(value).alias("_fine"))
    b = ref.groupBy(*coarse).agg(F.min(value).alias("_coarse"))
    return df.join(a, list(fine), "left").join(b, list(coarse), "left").select(*df.columns, F.coalesce("_fine", "_coarse").alias(value))


def cast_join(x: DataFrame, y: DataFrame, left: str, right: str, kind: str, how: str = "inner") -> DataFrame:
    """Join on keys of different types, cast to one (a value that can't be cast matches nothing)."""
    return x.withColumn("_k", F.col(left).try_cast(kind)).join(y.withColumn("_k", F.col(right).try_cast(kind)), "_k", how).drop("_k")


def membership(df: DataFrame, keys: DataFrame, by: Sequence[str], inside: bool = True) -> DataFrame:
    """Rows whose key is (or isn't) in a sub-query."""
    return df.join(keys.select(*by).distinct(), list(by), "left_semi" if inside else "left_anti")


def interval_join(df: DataFrame, ref: DataFrame, opens: str, closes: str, year: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per year from ``opens`` to ``closes``, joined with a table by year."""
    rows = df.filter(F.col(opens) <= F.col(closes)).withColumn(year, F.explode(F.sequence(opens, closes)))
    return rows.join(ref, [*by, year])


def two_aggregates(df: DataFrame, fine: Sequence[str], coarse: Sequence[str]) -> DataFrame:
    """Distinct fine keys and rows per coarse key, side by side: one aggregate of an aggregate, no join."""
    return df.groupBy(*dict.fromkeys([*coarse, *fine])).agg(F.count(F.lit(1)).alias("n")).groupBy(*coarse).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys"))
