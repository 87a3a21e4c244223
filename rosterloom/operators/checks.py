"""Quality checks over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, unique: Sequence[str], nullable: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys, and the rows of each null combination of two columns and each alone."""
    nulls = {f"null_{c}": F.count_if(F.col(c).isNull()) for c in nullable}
    pairs = {f"null_{a}_{b}": F.count_if(F.col(a).isNull() & F.col(b).isNull()) for i, a in enumerate(nullable) for b in nullable[i + 1 :]}
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.struct(*unique)).alias("keys"), *[v.alias(k) for k, v in (nulls | pairs).items()])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by several rows, or null."""
    null = [F.col(k).isNull() for k in keys]
    bad = null[0]
    for n in null[1:]:
        bad |= n
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | bad)


def orphans(df: DataFrame, ref: DataFrame, keys: Sequence[str], ref_keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in the reference (a null key refers to nothing and is fine)."""
    known = ref.select(*[F.col(r).alias(k) for k, r in zip(keys, ref_keys, strict=True)]).distinct()
    return df.dropna(subset=list(keys)).join(known, list(keys), "left_anti")


def linkability(left: DataFrame, right: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """Of each value of ``by``: rows, and rows with a partner on the keys."""
    found = right.select(*keys).distinct().withColumn("_hit", F.lit(1))
    return left.join(found, list(keys), "left").groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.count("_hit").alias("linked"))


def identity_uniqueness(df: DataFrame, keys: Sequence[str], identity: str) -> DataFrame:
    """Keys that hold several identities."""
    return df.groupBy(*keys).agg(F.count_distinct(identity).alias("identities")).filter("identities > 1")


def coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Codes of each source and of both, in one pass over their union."""
    marks = a.select(F.col(key).alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(F.col(key).alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    each = marks.filter("k is not null").groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return each.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both"), F.count_if(F.col("b") == 0).alias("only_a"), F.count_if(F.col("a") == 0).alias("only_b"))
