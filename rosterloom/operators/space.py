"""Clusters in space: footprints, scales, place resolution, cluster tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import area_code, speed_distance
from .aggs import mode
from .fuzzy import near_pairs
from .graph import materialised
from .windows import extreme_rows, random_row, with_count


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise (monotone chain)."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def chain(rows: np.ndarray) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def buffered_area(h: np.ndarray, r: float) -> float:
    """Area of a convex hull grown by ``r``: A + P r + pi r²."""
    if len(h) < 2:
        return math.pi * r * r
    n = np.roll(h, -1, axis=0)
    around = float(np.hypot(*(n - h).T).sum())
    area = abs(float((h[:, 0] * n[:, 1] - n[:, 0] * h[:, 1]).sum())) / 2 if len(h) > 2 else 0.0
    return area + around * r + math.pi * r * r


def footprint(df: DataFrame, group: str, x: str, y: str, buffer: float = 0.0, min_size: int = 2) -> DataFrame:
    """(group, n, area): buffered convex hull of each group of ``min_size`` rows or more.

    Each input batch gives the hull of its part of a group, so what meets in a
    group's task is hull corners, not points.
    """
    kind = dict(df.dtypes)[group]

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, rows in b.groupby("g", dropna=False):
                g = None if pd.isna(g) else g
                h = hull(rows[["x", "y"]].to_numpy(float))
                yield pd.DataFrame({"g": [g] * len(h), "x": h[:, 0], "y": h[:, 1], "n": [len(rows)] + [0] * (len(h) - 1)})

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [None if pd.isna(rows["g"].iloc[0]) else rows["g"].iloc[0]], "n": [int(rows["n"].sum())], "area": [buffered_area(hull(rows[["x", "y"]].to_numpy(float)), buffer)]})

    rows = df.select(F.col(group).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(subset=["x", "y"])
    corners = rows.mapInPandas(part, f"g {kind}, x double, y double, n long")
    out = corners.groupBy("g").applyInPandas(whole, f"g {kind}, n long, area double")
    return out.filter(F.col("n") >= min_size).select(F.col("g").alias(group), "n", "area")


def select_scale(df: DataFrame, scales: Sequence[tuple[str, str, str]], most: float) -> DataFrame:
    """The id of the largest scale whose footprint is at most ``most``; else 0; and the scale's label.

    ``scales``: (label, id column, area column), smallest first.  A missing
    area counts as 0 and passes, so noise (id 0) at a larger scale gives 0.
    """
    ident, label = F.lit(0).cast("long"), F.lit(None).cast("string")
    for name, i, a in scales:
        fits = F.coalesce(F.col(a), F.lit(0.0)) <= most
        ident, label = F.when(fits, F.coalesce(F.col(i), F.lit(0))).otherwise(ident), F.when(fits, name).otherwise(label)
    return df.withColumns({"scale_id": ident, "scale": label})


def same_name_groups(df: DataFrame, area: str, name: str, errors: DataFrame | None = None) -> DataFrame:
    """Rows whose area and name occur together more than once, without known errors (by area and name)."""
    out = with_count(df.dropna(subset=[area, name]), [area, name], "members").filter("members > 1")
    return out if errors is None else out.join(errors.select(area, name).distinct(), [area, name], "left_anti")


def resolve_places(x: DataFrame, ref: DataFrame, row: str, place: str, name: str, id_: str, px: str, py: str, steps: Sequence[tuple[int, int]] = ((2, 6), (2, 5), (2, 4), (4, 6)), most_area: float = 100e6, seed: int = 1) -> DataFrame:
    """(row, id, step): places found by fuzzy name within an area prefix, step by step.

    A step (edits, prefix digits) takes rows not found before.  Of the nearest
    names a single candidate is accepted; of several, one seeded pick if they
    lie within ``most_area``.
    """
    found, rest = None, x.select(row, place, name)
    refs = ref.select(F.col(id_).alias("_id"), place, F.col(name).alias("_name"), F.col(px).alias("_x"), F.col(py).alias("_y"))
    for k, (edits, digits) in enumerate(steps, 1):
        a, b = rest.withColumn("_area", area_code(F.col(place), digits)), refs.withColumn("_area", area_code(F.col(place), digits)).drop(place)
        pairs = near_pairs(a, b, name, "_name", edits, block=["_area"])
        # rows of one area and name share their candidates, so those are found once for all of them
        names = extreme_rows(pairs.withColumnsRenamed({"left_text": name, "right_text": "_name"}), ["_area", name], "distance")
        near = with_count(names.join(b, ["_area", "_name"]), ["_area", name], "_n").withColumn("_key", F.concat_ws("|", "_area", name))
        one = a.join(near.filter("_n = 1"), ["_area", name]).select(row, F.col("_id").alias(id_))
        several = near.filter("_n > 1")
        areas = footprint(several, "_key", "_x", "_y").filter(F.col("area") < most_area).select("_key")
        # the pick's order doesn't look at the row, so it is made once for all rows of an area and name, then among those of a row
        best = random_row(several.join(areas, "_key", "left_semi"), ["_area", name], ["_id"], seed).select("_area", name, "_id")
        pick = random_row(a.join(best, ["_area", name]), [row], ["_id"], seed).select(row, F.col("_id").alias(id_))
        hit = materialised(one.unionByName(pick).withColumn("step", F.lit(k)), f"places-{k}")  # the next steps read it, not what made it
        found = hit if found is None else found.unionByName(hit)
        rest = rest.join(hit.select(row), row, "left_anti")
    return found


def cluster_summary(df: DataFrame, cluster: str, sums: Sequence[str], modes: Sequence[str], means: Sequence[str], flags: Sequence[str], once: str | None = None) -> DataFrame:
    """Per cluster: sums (of the first row per ``once`` only), means, any flag, size and most frequent values."""
    base = df
    if once:
        from pyspark.sql import Window

        first = F.row_number().over(Window.partitionBy(cluster, once).orderBy(*[F.col(c) for c in df.columns])) == 1
        base = df.withColumns({c: F.when(first, F.col(c)).otherwise(0) for c in sums})
    out = base.groupBy(cluster).agg(*[F.sum(c).alias(c) for c in sums], *[F.avg(c).alias(c) for c in means], *[F.bool_or(F.col(c).cast("boolean")).alias(c) for c in flags], F.count(F.lit(1)).alias("members"))
    for c in modes:
        out = out.join(mode(df, [cluster], c, "min"), cluster, "left")
    return out


def conversion_table(df: DataFrame, cluster: str, area: str, id_: str, names: Sequence[str], corrections: DataFrame | None = None) -> DataFrame:
    """(cluster, area, id, name) for every variant of a name, and corrections."""
    out = df.unpivot([cluster, area, id_], list(names), "_v", "name").drop("_v").dropna(subset=["name"])
    return (out if corrections is None else out.unionByName(corrections)).distinct()


def reconcile_codes(df: DataFrame, area: str, place: str, refs: Sequence[DataFrame], key: str, digits: int = 6) -> DataFrame:
    """Area codes that disagree with the place id's prefix are taken from the reference lists in turn."""
    out = df
    for k, ref in enumerate(refs):
        out = out.join(ref.groupBy(key).agg(F.min(area).alias(f"_r{k}")), key, "left")
    prefix = area_code(F.col(place), digits)
    right = F.coalesce(F.when(F.col(area) == prefix, F.col(area)), *[F.col(f"_r{k}") for k in range(len(refs))], F.col(area))
    return out.withColumn(area, right).drop(*[f"_r{k}" for k in range(len(refs))])


def travel_distance(minutes: Column, rural: Column, speeds: Column) -> Column:
    """Kilometres from minutes and the speed of the transport; rural travel without a transport is on foot."""
    return speed_distance(minutes, F.coalesce(speeds, F.when(rural, 5.0)))
