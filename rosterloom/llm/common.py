"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and the ASCII controls from tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RX = r"[\x20\x09-\x0D]+"
WORD_RX = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none and runs on one machine (tests) a temporary
    folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_held = threading.local()


def _folders() -> list[str]:
    if not hasattr(_held, "folders"):
        _held.folders = []
    return _held.folders


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside, by this thread, are deleted at the end, but for those that are kept; what is kept must be written by then."""
    _folders().append(new_path(spark, "scratch"))
    try:
        yield
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(_folders().pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again."""
    path = f"{_folders()[-1]}/{name}-{uuid.uuid4().hex}" if _folders() and not keep else new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Array of the maximal runs of non-space characters; empty for null."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, SPACE_RX, -1))


def written_order(docs: DataFrame) -> Column | None:
    """A number that ascends in the order in which the rows of a read of Spark's files were written; None for other tables.

    Tasks write a file each (``part-<task>``, with ``-c<n>`` if they are cut),
    in the order of partitions; files keep the order of rows.
    """
    if not docs.inputFiles():
        return None
    name = F.col("_metadata.file_name")
    task, cut = (F.coalesce(F.regexp_extract(name, rx, 1).try_cast("long"), F.lit(0)) for rx in (r"^part-(\d+)", r"-c(\d+)"))
    return F.shiftleft(task, 40) + F.shiftleft(cut, 32) + F.col("_metadata.row_index")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def range_of(value: Column, cuts: list) -> Column:
    """The number of sorted ``cuts`` at or under ``value``: a nested CASE of depth log2 of their number."""

    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo).cast("long")
        mid = (lo + hi) // 2
        return F.when(value < cuts[mid], between(lo, mid)).otherwise(between(mid + 1, hi))

    return between(0, len(cuts))


def quantile_cuts(df: DataFrame, column: str, n: int) -> list:
    """At most ``n - 1`` sorted distinct values that cut a number column in like parts (a bounded sketch)."""
    if n < 2:
        return []
    found = df.agg(F.percentile_approx(column, [i / n for i in range(1, n)], 10_000)).first()[0]
    return sorted(set(found or []))


def protected(docs: DataFrame, needed: tuple[str, ...], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``step`` with all columns but the needed ones under names that can't clash.

    Afterwards they have their own names again; one whose name the step
    computes gives way to the computed column.
    """
    names = docs.columns
    inner = [c if c in needed else f"__in{k}__" for k, c in enumerate(names)]
    out = step(docs.toDF(*inner))
    made = [c for c in out.columns if c not in inner]
    taken = {c.lower() for c in made}
    kept = [F.col(i).alias(c) for i, c in zip(inner, names, strict=True) if i in out.columns and c.lower() not in taken]
    return out.select(*kept, *made)
