"""Sort, set operations and reshaping."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Arrays in which the values of the second column of ``complete`` travel.
BLOCKS = 16


def top_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def stack(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def shared_columns(*tables: DataFrame) -> list[str]:
    return [c for c in tables[0].columns if all(c in t.columns for t in tables[1:])]


def extra_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c not in b.columns]


def longer(df: DataFrame, ids: Sequence[str], regex: str, names_to: Sequence[str] = ("name",), value: str = "value", pattern: str | None = None, drop_null: bool = False) -> DataFrame:
    """Wide to long over matching columns; ``pattern`` parts the names in several columns by its groups."""
    cols = [c for c in df.columns if re.search(regex, c) and c not in ids]
    out = df.select(*ids, *cols).unpivot(list(ids), cols, "_name", value)
    if drop_null:
        out = out.filter(F.col(value).isNotNull())
    parts = {n: F.regexp_extract("_name", pattern, k + 1) if pattern else F.col("_name") for k, n in enumerate(names_to)}
    return out.select(*ids, *[p.alias(n) for n, p in parts.items()], value)


def wider(df: DataFrame, ids: Sequence[str], name: str, value: str, names: Sequence, how: str = "sum", fill=None, prefix: str = "") -> DataFrame:
    """Long to wide for the listed names (no job to find them)."""
    agg = {"sum": F.sum, "mean": F.avg, "list": F.collect_list, "count": F.count, "max": F.max, "first": F.first}[how](value)
    out = df.groupBy(*ids).pivot(name, list(names)).agg(agg)
    out = out.na.fill(fill, [str(n) for n in names]) if fill is not None else out
    return out.withColumnsRenamed({str(n): f"{prefix}{n}" for n in names}) if prefix else out


def explode_lists(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Lists of equal length to rows, side by side."""
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.inline(F.arrays_zip(*names)))


def complete(df: DataFrame, a: str, b: str, values: Mapping[str, object]) -> DataFrame:
    """All pairs of the observed values of two columns, missing rows filled.

    Give the column with fewer values (years, levels) second: its values travel
    in ``BLOCKS`` arrays to each value of the first, of any number.
    """
    every = df.groupBy(F.pmod(F.xxhash64(b), F.lit(BLOCKS)).alias("_block")).agg(F.collect_set(b).alias("_bs")).select("_bs")
    grid = df.select(a).distinct().crossJoin(every).select(a, F.explode("_bs").alias(b))
    return grid.join(df, [a, b], "left").na.fill(dict(values))


def split_column(df: DataFrame, column: str, into: Sequence[str], sep: str) -> DataFrame:
    """Parts of a delimited text; what exceeds the last column stays in it."""
    parts = F.split(F.col(column), sep, len(into))
    return df.withColumns({n: F.get(parts, k) for k, n in enumerate(into)})


def stack_named(tables: Mapping[tuple, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Stack tables whose type or year is only in their name."""
    return stack([t.withColumns({c: F.lit(v) for c, v in zip(columns, key, strict=True)}) for key, t in tables.items()])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold nulls only (one pass over the table)."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first().asDict()
    return df.select(*[c for c in df.columns if counts[c]])
