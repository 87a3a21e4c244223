"""Connected components of edge tables and groupings merged through them.

Rounds of random contraction; each round is written to a table so that the plan
stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` (a temporary folder only where none is set, on one machine)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialised(df: DataFrame, name: str = "step") -> DataFrame:
    """Write to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int | None = None) -> DataFrame:
    """(node, component): the least node of each node's component, for all nodes with an edge.

    Each round puts the nodes in a new random order (by a hash), contracts every
    node to the first of itself and its neighbours, and keeps the edges between
    what is left, so edges and settled components go quickly and a node with many
    neighbours is only summed up.  Rounds go on until no edge is left; with
    ``max_rounds``, a ``RuntimeError`` is raised where they don't suffice.
    """
    ends = F.col(u), F.col(v)
    e = materialised(edges.select(F.least(*ends).alias("u"), F.greatest(*ends).alias("v")).filter(ends[0] != ends[1]).distinct(), "edges")
    nodes = edges.select(F.explode(F.array(*ends)).alias("node")).distinct()
    levels: list[DataFrame] = []
    while not e.isEmpty():
        if max_rounds is not None and len(levels) >= max_rounds:
            raise RuntimeError(f"components: edges are left after {max_rounds} rounds")
        place = lambda c, turn=len(levels): F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("n"))
        first = _both(e).groupBy("u").agg(F.min(place("v")).alias("m"))
        levels.append(materialised(first.select("u", F.least("m", place("u"))["n"].alias("r")), "first"))
        left = e.join(levels[-1], "u").select(F.col("r").alias("a"), "v")
        both = left.join(levels[-1].withColumnsRenamed({"u": "v", "r": "b"}), "v").filter("a <> b")
        e = materialised(both.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    if not levels:
        return nodes.withColumn("component", F.col("node"))
    found = levels.pop()
    while levels:  # what a node was contracted to, and that in turn
        found = levels.pop().join(found.select(F.col("u").alias("r"), F.col("r").alias("root")), "r", "left").select("u", F.coalesce("root", "r").alias("r"))
    found = materialised(found, "roots")
    # written, so that the join can split a component of many nodes over tasks
    least = materialised(found.groupBy("r").agg(F.min("u").alias("component")), "least")
    named = found.join(least, "r").select(F.col("u").alias("node"), "component")
    return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def merge_groupings(df: DataFrame, first: str, second: str, out: str = "group_id") -> DataFrame:
    """Rows that share an id of either grouping end in one group; a null id makes no link.

    Group ids are dense, in order of the least first id of the group.  Rows
    with both ids null get null.
    """
    names = F.concat(F.lit("a"), F.col(first).cast("string")), F.concat(F.lit("b"), F.col(second).cast("string"))
    keyed = df.withColumns({"_a": names[0], "_b": names[1]})
    edges = keyed.filter("_a is not null and _b is not null").select("_a", "_b").distinct()
    found = components(edges, "_a", "_b")
    node = F.coalesce("_a", "_b")
    joined = keyed.withColumn("_n", node).join(found.withColumnRenamed("node", "_n"), "_n", "left").withColumn("_c", F.coalesce("component", "_n"))
    least = joined.filter("_c is not null").groupBy("_c").agg(F.min(first).alias("_f"), F.min(second).alias("_s"))
    ids = dense_ids(least, [F.col("_f").asc_nulls_last(), F.col("_s").asc_nulls_last(), F.col("_c")], out)
    return joined.join(ids.select("_c", out), "_c", "left").select(*df.columns, out)


def dense_ids(keys: DataFrame, order: list, out: str, parts: int | None = None) -> DataFrame:
    """Number distinct keys from 1 in a total order: range partitions, their offsets, then places inside."""
    n = parts or int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialised(keys.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_size"))  # a row per partition
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = ranged.join(F.broadcast(offsets.select("_p", "_before")), "_p")
    return placed.withColumn(out, (F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy(*order))).cast("long")).drop("_p", "_before")


def merge_with_names(df: DataFrame, row: str, cluster: str, name_group: str, noise: str, out: str = "group_id") -> DataFrame:
    """Clusters merged with same-name groups; noise points get an id of their own unless a name links them.

    ``source`` tells what made a group: cluster, names, both or noise.
    """
    base = df.withColumn("__c", F.when(F.coalesce(F.col(noise), F.lit(False)), F.concat(F.lit("p"), F.col(row).cast("string"))).otherwise(F.concat(F.lit("c"), F.col(cluster).cast("string"))))
    merged = merge_groupings(base, "__c", name_group, out)
    facts = merged.groupBy(out).agg(
        F.count_distinct("__c").alias("__cs"), F.bool_or(F.col(name_group).isNotNull()).alias("__named"), F.bool_or(~F.coalesce(F.col(noise), F.lit(False))).alias("__clustered")
    )
    source = F.when(F.col("__named") & F.col("__clustered") & (F.col("__cs") > 1), "both").when(F.col("__named") & (F.col("__cs") > 1), "names").when(F.col("__clustered"), "cluster").otherwise("noise")
    return merged.join(facts, out).select(*df.columns, out, source.alias("source"))
