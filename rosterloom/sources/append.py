"""Appends that can be run again, with serial ids and a table of rejected values."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.recode import rename_by_dictionary
from ..operators.graph import dense_ids
from ..operators.reshape import stack


class AppendTable:
    """A table that grows by named batches, each once.

    A batch is written to a folder of its own and counts only from its commit
    record on, a small file that is created if it isn't there.  A batch that was
    committed is not read or written again, and the folder of a run that died
    before its commit is never read, so any run can be repeated.  Records are
    numbered; the next takes over where the ids of the last end, so ids are
    dense over all batches and old rows keep theirs.  Two writers at once: the
    later one takes the next number and the ids after it.

    Values that the contract's types can't hold become null in the table and
    stand in ``rejected``: (batch, file, column, value, row as JSON).
    """

    def __init__(self, spark: SparkSession, path: str, contract: T.StructType):
        self.spark, self.path, self.contract = spark, path.rstrip("/"), contract

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def commits(self) -> list[dict]:
        """The records in order: one for each batch."""
        fs, at = self._fs(f"{self.path}/commits")
        if not fs.exists(at):
            return []
        found = []
        for status in fs.listStatus(at):
            if status.getPath().getName().endswith(".json"):
                stream = fs.open(status.getPath())
                text = bytes(stream.readAllBytes()).decode()
                stream.close()
                if text:  # a writer that died between creating and filling its record: its number stays unused
                    found.append(json.loads(text) | {"number": int(status.getPath().getName()[:-5])})
        return sorted(found, key=lambda r: r["number"])

    def _record(self, number: int, entry: dict) -> bool:
        fs, at = self._fs(f"{self.path}/commits/{number:012d}.json")
        fs.mkdirs(at.getParent())
        try:
            stream = fs.create(at, False)
        except Exception:  # the bridge gives one kind for all of Hadoop's errors
            if fs.exists(at):
                return False
            raise
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        return True

    def append(self, raw: DataFrame, batch: str, aliases: Sequence[tuple[str, str]] = (), order: Sequence[str] = (), file: str | None = None) -> DataFrame:
        """Harmonise and append ``raw`` as ``batch``; (file, rows, rejected) of what was written.

        ``order``: contract columns by which the ids of the batch ascend (ties by
        all other columns); ``file``: the column that names a row's source file.
        """
        done = [c for c in self.commits() if c["batch"] == batch]
        if not done:
            named = rename_by_dictionary(raw, aliases)
            there = [f for f in self.contract.fields if f.name in named.columns]
            cast = {f.name: F.col(f.name).try_cast(f.dataType) if f in there else F.lit(None).cast(f.dataType) for f in self.contract.fields}
            bad = [F.when(F.col(f.name).isNotNull() & cast[f.name].isNull(), F.struct(F.lit(f.name).alias("column"), F.col(f.name).cast("string").alias("value"))) for f in there]
            refused = F.filter(F.array(*bad), lambda x: x.isNotNull()) if bad else F.array().cast("array<struct<column:string,value:string>>")
            source = (F.col(file) if file else F.lit(None)).cast("string")
            rows = named.select(*[c.alias(n) for n, c in cast.items()], source.alias("_file"), refused.alias("_rejected"), F.when(F.size(refused) > 0, F.to_json(F.struct(*named.columns))).alias("_row"))
            first = [*order, *[f.name for f in self.contract.fields if f.name not in order and not isinstance(f.dataType, T.MapType)]]
            placed = dense_ids(rows, [*[F.col(c).asc_nulls_first() for c in first], F.col("_file").asc_nulls_first(), F.col("_row").asc_nulls_first()], "_place")
            folder = f"{self.path}/data/{uuid.uuid4().hex}"
            placed.write.parquet(folder)
            n = self.spark.read.parquet(folder).count()  # of the files' footers
            while True:
                held = self.commits()
                if any(c["batch"] == batch for c in held):
                    break  # another run was quicker
                base = held[-1]["first_id"] + held[-1]["rows"] - 1 if held else 0
                number = max((c["number"] for c in held), default=0) + 1
                if self._record(number, {"batch": batch, "folder": folder, "rows": n, "first_id": base + 1}):
                    break
                if len(self.commits()) == len(held):  # an empty record stands in the way
                    raise RuntimeError(f"{self.path}/commits/{number:012d}.json is empty: its writer died; delete it")
            done = [c for c in self.commits() if c["batch"] == batch]
        return self._folder(done[0]).groupBy(F.col("_file").alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("_rejected")).alias("rejected"))

    def _schema(self) -> T.StructType:
        refused = T.ArrayType(T.StructType().add("column", "string").add("value", "string"))
        return T.StructType([*self.contract.fields]).add("_file", "string").add("_rejected", refused).add("_row", "string").add("_place", "long")

    def _folder(self, commit: dict) -> DataFrame:
        return self.spark.read.schema(self._schema()).parquet(commit["folder"]).withColumns({"id": F.col("_place") + (commit["first_id"] - 1), "_batch": F.lit(commit["batch"])})

    def _all(self) -> DataFrame:
        held = self.commits()
        if held:
            return stack([self._folder(c) for c in held])
        return self.spark.createDataFrame([], T.StructType([*self._schema().fields, T.StructField("id", T.LongType()), T.StructField("_batch", T.StringType())]))

    def read(self) -> DataFrame:
        """``id`` and the contract's columns of all committed batches."""
        return self._all().select("id", *[f.name for f in self.contract.fields])

    def rejected(self) -> DataFrame:
        rows = self._all().filter(F.size("_rejected") > 0)
        return rows.select(F.col("_batch").alias("batch"), F.col("_file").alias("file"), F.explode("_rejected").alias("_x"), F.col("_row").alias("row")).select("batch", "file", "_x.column", "_x.value", "row")
