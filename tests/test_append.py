"""Repeatable appends, interval joins of many rules, factored links, batch distances, and groups of null."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterloom.functions import recode
from rosterloom.operators import aggs, fuzzy, linkage, reshape, space, windows
from rosterloom.sources.append import AppendTable

CONTRACT = T.StructType().add("k", "long").add("n", "integer")


def test_append_survives_crashes_and_reruns(spark, tmp_path, monkeypatch):
    table = AppendTable(spark, f"file://{tmp_path}/t", CONTRACT)
    assert table.read().count() == table.rejected().count() == 0
    one = spark.createDataFrame([("1", "5", "a"), ("2", "x", "a"), (None, "7", "b")], "k string, n string, f string")
    with monkeypatch.context() as m:  # dies after the data is written, before the record
        m.setattr(AppendTable, "_record", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.append(one, "b1", file="f")
    assert table.read().count() == 0
    told = sorted(map(tuple, table.append(one, "b1", order=["k"], file="f").collect()))
    assert told == [("a", 2, 1), ("b", 1, 0)] and sorted(map(tuple, table.append(one, "b1", file="f").collect())) == told
    first = sorted(map(tuple, table.read().collect()), key=str)
    assert first == sorted([(1, None, 7), (2, 1, 5), (3, 2, None)], key=str)
    table.append(spark.createDataFrame([("9", "9", 1), ("8", "8", 1)], "k string, n string, more int"), "b2", order=["k"])
    got = {r.id: r.k for r in table.read().collect()}
    assert got == {1: None, 2: 1, 3: 2, 4: 8, 5: 9}
    assert [(r.batch, r.file, r.column, r.value) for r in table.rejected().collect()] == [("b1", "a", "n", "x")] and '"n":"x"' in table.rejected().first().row
    # two writers: the second finds its number taken and goes on after it
    held, stale = table.commits(), []
    other = AppendTable(spark, f"file://{tmp_path}/t", CONTRACT)
    real = other.commits
    monkeypatch.setattr(other, "commits", lambda: real() if stale or stale.append(1) else held)
    table.append(spark.createDataFrame([(7, 7)], "k long, n int"), "b3")
    other.append(spark.createDataFrame([(6, 6)], "k long, n int"), "b4")
    assert [(c["batch"], c["first_id"], c["rows"]) for c in table.commits()] == [("b1", 1, 3), ("b2", 4, 2), ("b3", 6, 1), ("b4", 7, 1)]
    table.append(spark.createDataFrame([], "k long, n int"), "b5")
    assert sorted(r.id for r in table.read().collect()) == list(range(1, 8))


def test_interval_pairs_equal_the_nested_loop(spark):
    r = random.Random(4)
    rules = [(i, a, a + r.choice([0, 0.5, 3, 40, 1000, float("inf")])) for i in range(300) for a in [r.choice([r.uniform(-50, 50), float(r.randint(-20, 20))])]] + [(900, 5.0, 4.0), (901, None, 4.0)]
    points = [(k, r.choice([float(r.randint(-60, 60)), r.uniform(-60, 1200), rules[k][1]])) for k in range(200)] + [(999, None)]
    out = recode.interval_pairs(spark.createDataFrame(points, "p int, x double"), spark.createDataFrame(rules, "i int, lo double, hi double"), "x", "lo", "hi")
    assert out.columns == ["p", "x", "i", "lo", "hi"]
    assert sorted((o.p, o.i) for o in out.collect()) == sorted((p, i) for p, x in points for i, a, b in rules if x is not None and a is not None and a <= x <= b)
    many = spark.range(200_000).select(F.col("id").alias("i"), (F.col("id") * 3).cast("double").alias("lo"), (F.col("id") * 3 + F.col("id") % 3).cast("double").alias("hi"))
    hit = recode.interval_pairs(spark.range(0, 600_000, 1000).select(F.col("id").cast("double").alias("x")), many, "x", "lo", "hi")
    assert hit.count() == sum(x % 3 <= (x // 3) % 3 for x in range(0, 600_000, 1000))


def test_factored_links_equal_the_cube(spark):
    r = random.Random(5)
    rows = lambda n: [(k, r.choice("uvw"), r.choice([None, 1, 2, 3])) for k in range(n)]
    x, a, b = (spark.createDataFrame(rows(n), f"{i} int, key string, own int") for n, i in ((20, "xid"), (15, "aid"), (12, "bid")))
    cube = linkage.link_three(x.drop("own"), a.drop("own"), b.drop("own"), ["key"], "xid", "aid", "bid")
    counts = {r_.key: r_.pairs for r_ in linkage.link_three_counts(x, a, b, ["key"]).collect()}
    assert counts == {r_.key: r_["count"] for r_ in cube.groupBy("key").count().collect()}
    own = {n: {q[0]: q[2] for q in t.collect()} for n, t in (("x", x), ("a", a), ("b", b))}
    rank = lambda s, i, base: (1 if own["x"][base] is not None and own[s][i] == own["x"][base] else 2 if own[s][i] is None else 3, i)
    best: dict = {}
    for c in cube.collect():
        best[c.xid] = min(best.get(c.xid, ((9,),)), (rank("a", c.aid, c.xid), rank("b", c.bid, c.xid)))
    got = linkage.link_three_best(x, a, b, ["key"], "xid", "aid", "bid", "own").collect()
    assert {g.xid: (g.aid, g.bid) for g in got} == {k: (p[1], q[1]) for k, (p, q) in best.items()}
    assert all(g.pairs_per_key == counts[g.key] for g in got)


def test_batch_distances_equal_the_plain_ones(spark):
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcdé") for _ in range(r.randint(0, n)))
    pairs = [(word(9), word(9)) for _ in range(1500)] + [("a" * 70, "ab" * 40), ("", "")]
    assert fuzzy.damerau_distances(pairs).tolist() == [fuzzy._damerau(*p) for p in pairs]
    assert fuzzy.within_distances(pairs).tolist() == [fuzzy._within(*p) for p in pairs]
    df = spark.createDataFrame([("abc", "acb"), (None, "a"), ("a", None), ("xyz", "abcdefgh")], "a string, b string")
    got = df.select(fuzzy.damerau_levenshtein("a", "b").alias("d"), fuzzy.substring_distance(F.col("a"), F.col("b"), 2).alias("w")).collect()
    assert [tuple(x) for x in got] == [(1, 1), (None, None), (None, None), (8, -1)]


def test_null_groups_and_counts(spark):
    df = spark.createDataFrame([(None, 1.0, 0.0), (None, 2.0, 4.0), (None, 9.0, 0.0), (1, 3.0, 1.0), (1, 5.0, 2.0)], "g int, x double, y double")
    assert {r.g: r.n for r in aggs.boxplot(df, ["g"], "x").collect()} == {None: 3, 1: 2}
    assert {r.g: r.n for r in space.footprint(df, "g", "x", "y", 1.0).collect()} == {None: 3, 1: 2}
    assert sorted((r.x, r.n) for r in windows.with_count(df, ["g"]).collect()) == [(1.0, 3), (2.0, 3), (3.0, 2), (5.0, 2), (9.0, 3)]
    assert sorted((r.g is None, r.n, r.place) for r in windows.number_by_count(df.unionByName(df.filter("g = 1").limit(1)).withColumn("g", F.coalesce("g", F.lit(7))), ["g"]).collect()) == [(False, 3, 1), (False, 3, 2)]
    wide = spark.range(12_000).select((F.col("id") % 3).alias("a"), "id")
    assert reshape.complete(wide, "a", "id", {}).count() == 36_000


def test_place_steps_keep_the_plan_short(spark):
    x = spark.createDataFrame([(1, "010101", "santa rosa"), (2, "020202", "villa marya"), (3, "030303", "otro")], "row int, place string, name string")
    ref = spark.createDataFrame([(10, "010101", "santa rosa", 0.0, 0.0), (11, "020202", "villa maria", 1.0, 1.0)], "id int, place string, name string, px double, py double")
    out = space.resolve_places(x, ref, "row", "place", "name", "id", "px", "py")
    assert sorted((r.row, r.id) for r in out.collect()) == [(1, 10), (2, 11)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 4


def test_places_of_one_name_are_not_multiplied(spark, monkeypatch):
    """40 rows and 30 candidates of one area and name: one pick for all of them, not 1,200 rows to pick from."""
    x = spark.createDataFrame([(k, f"0101{k:06}", "santa rosa") for k in range(40)] + [(7, "0202000000", "villa")], "row int, place string, name string")
    ref = spark.createDataFrame([(k, f"0101{k:06}", "santa rosa", 0.0, k / 10) for k in range(100, 130)] + [(k, "0202000000", "villa", 0.0, 1.0) for k in (1, 2)], "id int, place string, name string, px double, py double")
    sizes, plain = [], space.random_row

    def counted(df, *args):
        sizes.append(df.count())
        return plain(df, *args)

    monkeypatch.setattr(space, "random_row", counted)
    got = {r_.row: r_.id for r_ in space.resolve_places(x, ref, "row", "place", "name", "id", "px", "py", steps=((1, 4),)).collect()}
    first = lambda ids: min(ids, key=lambda k: hashlib.md5(f"1:{k}".encode()).hexdigest())
    # row 7 stands in two places: it is picked for from the candidates of both
    assert got == {k: first([*range(100, 130), 1, 2] if k == 7 else range(100, 130)) for k in range(40)}
    assert max(sizes) <= 41
