"""Sources and sinks."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.recode import rename_by_dictionary
from ..operators.reshape import stack
from ..operators.windows import fill

#: Texts that stand for a missing value in files.
NULL_TOKENS = ("#NULL!", "", "NA")


def null_tokens(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Null for the tokens in every text column."""
    return df.withColumns({c: F.when(~F.col(c).isin(*tokens), F.col(c)) for c, t in df.dtypes if t == "string"})


def to_contract(df: DataFrame, contract: T.StructType, aliases: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Names by dictionary, then the columns and types of the contract; what can't be cast or isn't there is null."""
    named = rename_by_dictionary(df, aliases)
    return named.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in named.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in contract.fields])


def ingest_append(spark: SparkSession, path: str, target: str, contract: T.StructType, fmt: str = "parquet", aliases: Sequence[tuple[str, str]] = (), options: Mapping | None = None) -> DataFrame:
    """Read, harmonise and append; gives the rows of each source file."""
    raw = spark.read.options(**(options or {})).format(fmt).load(path)
    files = raw.select(F.col("_metadata.file_name").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    to_contract(raw, contract, aliases).write.mode("append").parquet(target)
    return files


def read_folder(spark: SparkSession, path: str, fmt: str = "csv", tokens: Sequence[str] = NULL_TOKENS, year_pattern: str = r"(\d{4})", kind_pattern: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Many files to one table with file name, and the year (and kind) its name holds."""
    reader = spark.read.format(fmt).option("header", True)
    df = (reader.schema(schema) if schema is not None else reader).load(path).select("*", F.col("_metadata.file_name").alias("file_name"))
    df = null_tokens(df, tokens).withColumn("file_year", F.regexp_extract("file_name", year_pattern, 1).try_cast("int"))
    return df.withColumn("file_kind", F.nullif(F.regexp_extract("file_name", kind_pattern, 1), F.lit(""))) if kind_pattern else df


def read_decimal_comma_csv(spark: SparkSession, path: str, numbers: Sequence[str], tokens: Sequence[str] = NULL_TOKENS, sep: str = ";") -> DataFrame:
    """All columns as text, numbers with a decimal comma to double."""
    df = null_tokens(spark.read.csv(path, header=True, inferSchema=False, sep=sep), tokens)
    return df.withColumns({c: F.regexp_replace(c, ",", ".").try_cast("double") for c in numbers if c in df.columns})


def read_typed_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_vintages(tables: Mapping[int, DataFrame], aliases: Sequence[tuple[str, str]], prefer: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One register per year with drifting names: aliased by pattern, stacked with ``year``.

    ``prefer``: where several columns would get one name, the first of the list
    that is there is taken.
    """
    out = []
    for year, df in tables.items():
        for name, candidates in (prefer or {}).items():
            there = [c for c in candidates if c in df.columns]
            df = df.drop(*there[1:]).withColumnRenamed(there[0], name) if there else df
        out.append(rename_by_dictionary(df, aliases).withColumn("year", F.lit(year)))
    return stack(out)


def read_by_key(df: DataFrame, key: Sequence[Mapping], year: int, form: str | None = None) -> DataFrame:
    """Columns chosen and renamed by a key table (name, definition, year, type): a driver-side list of column names."""
    hit = [k for k in key if k["year"] == year and (form is None or k.get("type") == form) and k["name"] in df.columns]
    return df.select(*[F.col(k["name"]).alias(k["definition"]) for k in hit], F.lit(year).alias("year"))


def jdbc_table(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options) -> DataFrame:
    """A database table, read in parallel ranges of a number column; credentials come from options."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def materialise(df: DataFrame, name: str, temporary: bool = False) -> DataFrame:
    """A named result: a table, or a cached view of the session."""
    if temporary:
        df.persist().createOrReplaceTempView(name)
    else:
        df.write.mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def write_files(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", header: bool = True) -> None:
    df.write.mode(mode).options(**({"header": header} if fmt == "csv" else {})).format(fmt).save(path)


def read_assignments(spark: SparkSession, path: str, point: str = "id") -> DataFrame:
    """Space-separated files with ``#`` comments: cluster = number in the file's name + 1; points of the noise file get ids after the last."""
    raw = spark.read.csv(path, sep=" ", comment="#", schema=f"{point} long, x double, y double, code long").select("*", F.col("_metadata.file_name").alias("f"))
    number = F.regexp_extract("f", r"cluster_(\d+)", 1).try_cast("long") + 1
    rows = raw.withColumns({"cluster": number, "noise": F.col("f").contains("noise")})
    noise = rows.filter("noise")
    last = rows.agg(F.coalesce(F.max("cluster"), F.lit(0)).alias("last"))  # one row
    from ..operators.graph import dense_ids

    numbered = dense_ids(noise.drop("cluster"), [F.col(point), F.col("x"), F.col("y")], "k").join(F.broadcast(last), F.lit(True)).withColumn("cluster", F.col("k") + F.col("last"))
    names = [point, "x", "y", "code", "cluster", "noise"]
    return rows.filter(~F.col("noise")).select(*names).unionByName(numbered.select(*names))


def read_indented_listing(df: DataFrame, line: str, label: str, code: str, header: str, sheet: Sequence[str]) -> DataFrame:
    """Header rows carry the code of the rows under them (within each sheet): fill down, drop headers, build the id."""
    head = F.lower(label).rlike(header)
    marked = df.withColumns({"area": F.when(head, F.col(code)), "_head": head})
    rows = fill(marked, ["area"], list(sheet), [F.col(line)]).filter(~F.col("_head")).drop("_head")
    return rows.withColumn("place_id", F.concat(F.lpad("area", 6, "0"), F.lpad(F.col(code).cast("string"), 4, "0")))


def factor_dictionary(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The table with dense codes for the categories, and the (variable, level, value) dictionary."""
    levels = df.select(*[F.col(c).cast("string").alias(c) for c in names]).unpivot([], list(names), "variable", "value").dropna(subset=["value"]).distinct()
    book = levels.withColumn("level", F.row_number().over(Window.partitionBy("variable").orderBy("value")))  # one row per level
    out = df
    for c in names:
        codes = book.filter(F.col("variable") == c).select(F.col("value").alias("_v"), F.col("level").alias("_l"))
        out = out.join(codes, F.col(c).cast("string") == F.col("_v"), "left").withColumn(c, F.col("_l")).drop("_v", "_l")
    return out.select(*df.columns), book.select("variable", "level", "value")


def vintage_of(name: str) -> int | None:
    """The year in a name."""
    found = re.search(r"(19|20)\d\d", name)
    return int(found[0]) if found else None
