"""Mixing sources to target weights with a time-varying curriculum.

Native: DataFrame expressions only.

* ``source_targets`` shares a word budget over the sources by weight; a target
  stops at ``max_epochs`` times its source, the excess is shared again.  The
  fixed point of that resharing is a water level, found from sorted caps.
* ``take`` takes whole documents in a fixed pseudo-random order of each source
  until the target is met; the last one is taken in part, so that each source
  meets its (whole-word) target exactly.
* ``when_trained`` integrates each source's piecewise-linear weight schedule and
  inverts the cumulative token demand: the q-th part of a source's tokens is
  trained at the time t at which the integral of its schedule reaches q.
* ``in_order`` range-sorts by that time: partitions, and the files they are
  written to, follow each other in order of training.

A source may hold any share of all rows: running sums go over blocks of a
source (keyed by the leading digits of a hash), then inside each block.

Nulls: a null or empty text has size 0 and is taken 0 times; a null source is a
source of its own, last in order.  Repeated rows are separate documents; they
tie, and which of two equal rows comes first doesn't change the result.  Texts
of any length are counted whole and never split over tasks.  An empty table
gives an empty result.  Extra columns are kept; one with the
name of a computed column gives way to it in ``take``, and stays in ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, SPACE_RX, WORD_RX, partitions, protected

WEIGHTS = (5.0, 2.0, 1.0)
NEEDED = ("doc_id", "text", "source", "n_chars")

#: (time, relative weight) knots of the schedules, by the place of the source in order, repeating.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
    ((0.0, 1.0), (1.0, 1.0)),
)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RX)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """``sizes``: one row per source (source, its non-null key _source, source_size) → with place and target.

    The rows are one per source, however many documents there are.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = sizes.withColumn("place", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = place.select("source", "_source", "source_size", "place", w.alias("w"), (F.col("source_size") * max_epochs).alias("cap"))
    every = Window.partitionBy()
    by_level = Window.orderBy(F.col("cap") / F.col("w"), "place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        (F.sum("source_size").over(every) * share).alias("demand"),
        F.sum("w").over(every).alias("w_all"),
        F.coalesce(F.sum("cap").over(by_level), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("w").over(by_level), F.lit(0.0)).alias("w_before"),
    )
    # The level if this source and all with a higher cap per weight are free: the highest level under its own cap holds.
    level = (F.col("demand") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before"))
    rows = rows.withColumn("level", F.when(level <= F.col("cap") / F.col("w"), level))
    water = F.max("level").over(every)
    return rows.select("source", "_source", "source_size", "place", F.when(water.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), water * F.col("w"))).alias("target"))


def take(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, schedules=SCHEDULES, digits: int = 3) -> DataFrame:
    """Add size, source_size, target, taken, position, position_2 to documents.

    ``position`` is the time in [0, 1] at which the document is first trained,
    ``position_2`` the time of its second copy (null: none).  ``digits``: each
    source is summed in 16 ** digits blocks.
    """
    return protected(docs, NEEDED, lambda d: _take(d, weights, share, max_epochs, schedules, digits))


def _take(docs: DataFrame, weights, share: float, max_epochs: float, schedules, digits: int) -> DataFrame:
    keys = {
        "size": n_words(F.col("text")),
        "_source": F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("source"))),
        "_key": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))),
        "_tie": F.xxhash64("text"),
    }
    sized = docs.withColumns(keys).withColumn("_block", F.substring("_key", 1, digits))
    blocks = sized.groupBy("source", "_source", "_block").agg(F.sum("size").alias("block_size"))
    targets = source_targets(blocks.groupBy("source", "_source").agg(F.sum("block_size").alias("source_size")), weights, share, max_epochs)
    before = Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocks.withColumn("block_before", F.coalesce(F.sum("block_size").over(before), F.lit(0)))
        .join(targets.drop("source"), "_source")
        .select("_source", "_block", "block_before", "source_size", "place", "target")
    )
    inside = Window.partitionBy("_source", "_block").orderBy("_key", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    d = sized.join(offsets, ["_source", "_block"]).withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    start = F.col("block_before") + F.col("_inside")
    goal = F.floor(F.col("target") + 0.5).cast("long")

    def epoch(n: int) -> Column:
        left = goal - F.col("source_size") * n - start
        return F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))

    d = d.withColumn("taken", (epoch(0) + epoch(1)).cast("long"))
    d = d.withColumns({
        "position": F.when(epoch(0) > 0, when_trained(start / F.greatest(goal, F.lit(1)), F.col("place"), schedules)),
        "position_2": F.when(epoch(1) > 0, when_trained((start + F.col("source_size")) / F.greatest(goal, F.lit(1)), F.col("place"), schedules)),
    })
    return d.select(*docs.columns, "size", "source_size", "target", "taken", "position", "position_2")


def when_trained(q: Column, place: Column, schedules=SCHEDULES) -> Column:
    """The time at which the integral of a schedule reaches the part ``q`` of its whole.

    A schedule is piecewise linear, its weights are not negative and not all 0.
    """
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        areas = [(t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False)]
        total, done, cases = sum(areas), 0.0, None
        for ((t0, a), (t1, b)), area in zip(zip(knots, knots[1:], strict=False), areas, strict=False):
            need = q * total - done
            slope = (b - a) / (t1 - t0)
            if slope == 0:
                at = F.lit(t0) + (need / a if a else F.lit(0.0))
            else:
                at = F.lit(t0) + (F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + 2 * slope * need)) - a) / slope
            done += area
            here = q * total <= done
            cases = F.when(here, at) if cases is None else cases.when(here, at)
        out = F.when(place % len(schedules) == k, cases.otherwise(F.lit(1.0))).otherwise(out)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row per copy taken, in order of training.

    A document taken in part keeps its first words, up to the number taken.
    """
    return protected(docs, NEEDED, lambda d: _mixed(d, **options))


def _mixed(docs: DataFrame, **options) -> DataFrame:
    t = take(docs, **options)
    first = F.least(F.col("size"), F.col("taken"))
    copies = F.array_compact(F.array(
        F.when(F.col("position").isNotNull(), F.struct(F.col("position").alias("at"), first.alias("n"))),
        F.when(F.col("position_2").isNotNull(), F.struct(F.col("position_2").alias("at"), (F.col("taken") - first).alias("n"))),
    ))
    rows = t.withColumn("_copy", F.explode(copies))
    part = F.when(F.col("_copy.n") >= F.col("size"), F.col("text")).otherwise(
        F.array_join(F.slice(F.split(F.btrim(F.col("text"), F.lit(SPACE)), SPACE_RX), 1, F.col("_copy.n").cast("int")), " ")
    )
    rows = rows.withColumn("text", part)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return in_order(rows.withColumn("_at", F.col("_copy.at")), "_at").select(*docs.columns)


def in_order(df: DataFrame, at: str) -> DataFrame:
    """Range-sort by a position in [0, 1]: no row of a partition is trained before one of the partition before it.

    The k-th of n partitions holds the positions from k / n to (k + 1) / n,
    sorted.  Demand is spread evenly over positions but for the schedules, so
    the ranges are known beforehand and need no sampling pass over the rows.
    Rows without a position follow those of a partition, dealt out by hash.
    """
    n = partitions(df.sparkSession)
    place = F.coalesce(F.least(F.lit(n - 1), F.floor(F.col(at) * n)), F.pmod(F.xxhash64("doc_id", "size"), F.lit(n)))
    return df.repartitionById(n, place.cast("int")).sortWithinPartitions(F.col(at).asc_nulls_last(), "doc_id")
