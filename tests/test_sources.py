"""Files in, files out."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterloom.sources import ingest
from rosterloom.streaming.incremental import ingest_incremental


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_folder_and_decimal_comma(spark, tmp_path):
    write(f"{tmp_path}/in/matricula2013.csv", "a,b\n1,#NULL!\n2,NA\n")
    write(f"{tmp_path}/in/matricula2014.csv", "a,b\n3,x\n")
    df = ingest.read_folder(spark, f"{tmp_path}/in", kind_pattern=r"^([a-z]+)")
    assert sorted((r.a, r.b, r.file_year, r.file_kind) for r in df.collect()) == [("1", None, 2013, "matricula"), ("2", None, 2013, "matricula"), ("3", "x", 2014, "matricula")]
    write(f"{tmp_path}/c/x.csv", "a;b\n1,5;NA\nz;2,25\n")
    got = ingest.read_decimal_comma_csv(spark, f"{tmp_path}/c", ["a", "b"]).collect()
    assert [(r.a, r.b) for r in got] == [(1.5, None), (None, 2.25)]


def test_append_and_contract(spark, tmp_path):
    contract = T.StructType([T.StructField("person", T.LongType()), T.StructField("name", T.StringType()), T.StructField("born", T.DateType())])
    spark.createDataFrame([("7", "ana"), ("x", "bo")], "`Id  Persona` string, NAME string").write.parquet(f"{tmp_path}/raw")
    for _ in range(2):
        report = ingest.ingest_append(spark, f"{tmp_path}/raw", f"{tmp_path}/out", contract, aliases=[("id persona", "person")])
    assert sum(r.rows for r in report.collect()) == 2
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.schema == contract and out.count() == 4 and out.filter("person = 7").count() == 2


def test_vintages_and_key(spark):
    a = spark.createDataFrame([(1, "x")], "codccpp int, nom_cp string")
    b = spark.createDataFrame([(2, 3, "y")], "codcpsig int, codcp_med int, nomcp string")
    out = ingest.read_vintages({2013: a, 2014: b}, [("nom_cp", "nomcp"), ("codcpsig", "codccpp")], {"codccpp": ["codcp_med", "codcpsig", "codccpp"]})
    assert sorted((r.codccpp, r.nomcp, r.year) for r in out.collect()) == [(1, "x", 2013), (3, "y", 2014)]
    key = [{"name": "p01", "definition": "age", "year": 2013}, {"name": "zz", "definition": "no", "year": 2013}, {"name": "p02", "definition": "sex", "year": 2014}]
    assert ingest.read_by_key(spark.createDataFrame([(4, 5)], "p01 int, p02 int"), key, 2013).columns == ["age", "year"]


def test_assignments_listing_factors(spark, tmp_path):
    write(f"{tmp_path}/g/cluster_0.txt", "# id x y code\n1 0.5 1.5 10\n2 0.6 1.6 11\n")
    write(f"{tmp_path}/g/cluster_1.txt", "3 9 9 12\n")
    write(f"{tmp_path}/g/noise.txt", "# none\n4 1 1 13\n5 2 2 14\n")
    got = sorted((r.id, r.cluster, r.noise) for r in ingest.read_assignments(spark, f"{tmp_path}/g").collect())
    assert got == [(1, 1, False), (2, 1, False), (3, 2, False), (4, 3, True), (5, 4, True)]
    sheet = spark.createDataFrame([("s", 1, "Distrito A", "10101"), ("s", 2, "x", "7"), ("s", 3, "y", "8"), ("s", 4, "distrito B", "10102"), ("s", 5, "z", "9")], "sheet string, line int, label string, code string")
    assert sorted(r.place_id for r in ingest.read_indented_listing(sheet, "line", "label", "code", "^distrito", ["sheet"]).collect()) == ["0101010007", "0101010008", "0101020009"]
    coded, book = ingest.factor_dictionary(spark.createDataFrame([("b", 1), ("a", 2), (None, 3)], "c string, v int"), ["c"])
    assert sorted((r.c or 0, r.v) for r in coded.collect()) == [(0, 3), (1, 2), (2, 1)]
    assert [(r.level, r.value) for r in book.orderBy("level").collect()] == [(1, "a"), (2, "b")]


def test_incremental(spark, tmp_path):
    df = spark.range(5).withColumn("v", F.col("id") * 2)
    df.write.parquet(f"{tmp_path}/src/a")
    args = (spark, f"{tmp_path}/src/*", f"{tmp_path}/dst", f"{tmp_path}/ck", df.schema)
    assert ingest_incremental(*args) == 5 and ingest_incremental(*args) == 0
    df.write.parquet(f"{tmp_path}/src/b")
    assert ingest_incremental(*args) == 5 and spark.read.parquet(f"{tmp_path}/dst").count() == 10


def test_materialise_and_files(spark, tmp_path):
    df = spark.range(3)
    assert ingest.materialise(df, "kept_rows", temporary=True).count() == 3
    ingest.write_files(df, f"{tmp_path}/o", "csv")
    ingest.write_files(df, f"{tmp_path}/o", "csv", "append", header=False)
    assert spark.read.text(f"{tmp_path}/o").filter("value rlike '^[0-9]+$'").count() == 6
    assert ingest.read_typed_csv(spark, f"{tmp_path}/o", "id long").columns == ["id"]


def test_jdbc_round_trip(spark, tmp_path):
    """Derby comes with Spark: a table is appended to and read again in ranges."""
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.range(100).select("id", (F.col("id") * 2).alias("v"))
    ingest.write_jdbc(df, url, "numbers", "overwrite", **driver)
    ingest.write_jdbc(df.filter("id < 10").withColumn("id", F.col("id") + 100), url, "numbers", **driver)
    out = ingest.jdbc_table(spark, url, "numbers", column="id", bounds=(0, 110), parts=3, **driver)
    assert out.rdd.getNumPartitions() == 3
    assert sorted((r[0], r[1]) for r in out.collect()) == [(k, 2 * k) for k in range(100)] + [(100 + k, 2 * k) for k in range(10)]
    assert ingest.jdbc_table(spark, url, "numbers", **driver).count() == 110
