"""Null, tie and order policies of the operators, on small frames."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterloom.functions import recode, scalars
from rosterloom.operators import aggs, checks, estimate, fuzzy, graph, indices, joins, linkage, panel, reshape, space, windows
from rosterloom.plans import catalog, more  # noqa: F401  (more adds its queries)

D = dt.date


def values(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def one(spark, expr, **cols):
    """The value of a column expression over one row of literals."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr.alias("x")).first()["x"]


# joins: null policy


def test_joins_null_policy(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (None, "q")], "k int, b string")
    assert values(joins.keyed_join(a, b, ["k"]), "a", "b") == [("x", "p")]
    assert values(joins.keyed_join(a, b, ["k"], null_safe=True), "a", "b") == [("x", "p"), ("y", "q")]
    assert values(joins.keyed_join(a, b, ["k"], "left_anti"), "a") == [("y",)]
    assert joins.keyed_join(a, b, ["k"], "left_anti", null_safe=True).count() == 0
    assert joins.keyed_join(a, b, ["k"], "full", null_safe=True).count() == 2


def test_coalesce_and_fallback_join(spark):
    a = spark.createDataFrame([(1, "l", None), (2, None, 5)], "k int, v string, w int")
    b = spark.createDataFrame([(1, "r", 7), (3, "s", None)], "k int, v string, w int")
    assert values(joins.coalesce_join(a, b, ["k"]), "k", "v", "w") == [(1, "l", 7), (2, None, 5), (3, "s", None)]
    assert ("r" in {x[1] for x in values(joins.coalesce_join(a, b, ["k"], reverse=True), "k", "v")})
    ref = spark.createDataFrame([(1, "a", 9), (1, "a", 8), (1, "b", 7)], "x int, y string, z int")
    df = spark.createDataFrame([(1, "a"), (1, "zz"), (5, "a")], "x int, y string")
    assert values(joins.fallback_join(df, ref, ["x", "y"], ["x"], "z"), "x", "y", "z") == [(1, "a", 8), (1, "zz", 7), (5, "a", None)]
    full = joins.full_join_all([a.select("k", "v"), b.select("k", F.col("w").alias("u"))], "k")
    assert values(full, "k", "v", "u") == [(1, "l", 7), (2, None, None), (3, None, None)]


# aggregates: nulls and ties


def test_aggregate_policies(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 4)], "g string, v int")
    assert values(aggs.summary(df, ["g"], "v"), "g", "mean") == [("a", 1.0), ("b", 3.0)]
    assert values(aggs.summary(df, ["g"], "v", skip_null=False), "g", "mean") == [("a", None), ("b", 3.0)]
    two = df.groupBy("g").agg(aggs.single_or_null(F.col("v")).alias("s"), aggs.single_or_null(F.col("v"), True).alias("t"))
    assert values(two, "g", "s", "t") == [("a", 1, None), ("b", None, None)]


@pytest.mark.parametrize("tie, want", [("min", ["x"]), ("max", ["z"]), ("first", ["z"]), ("last", ["x"]), ("all", ["x", "z"])])
def test_mode_ties(spark, tie, want):
    df = spark.createDataFrame([(1, "z", 1), (1, "x", 2), (1, "x", 3), (1, "z", 4), (1, "y", 5), (1, None, 6), (1, None, 7), (1, None, 8)], "g int, v string, o int")
    assert [v for (v,) in values(aggs.mode(df, ["g"], "v", tie, "o"), "v")] == want


def test_reduce_vintages(spark):
    df = spark.createDataFrame([(1, 2001, "a"), (1, 2002, "b"), (1, 2003, None)], "k int, year int, v string")
    assert values(aggs.reduce_vintages(df, ["k"], "v", "year", "latest"), "v") == [("b",)]
    assert values(aggs.reduce_vintages(df, ["k"], "v", "year", "mode_last"), "v") == [("b",)]


def test_percentile_groups_keep_ties_together(spark):
    df = spark.createDataFrame([(v,) for v in [1, 1, 1, 1, 2, 3, 4, 5]], "v int")
    groups = {}
    for v, g in values(aggs.percentile_groups(df, "v", 4), "v", "group"):
        groups.setdefault(v, set()).add(g)
    assert all(len(g) == 1 for g in groups.values())


def test_density_integrates_to_one(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(20, 80)], "g string, v double")
    rows = values(aggs.density(df, ["g"], "v", 0.0, 100.0, 201, 2.0), "x", "density")
    assert sum(d for _, d in rows) * 0.5 == pytest.approx(1, abs=0.01)


# windows: conditions see the whole group


def test_first_row_must_itself_be_accepted(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 1, 1)], "k int, o int, ok int")
    assert values(windows.first_row(df, ["k"], [F.col("o")], F.col("ok") == 1), "k", "o") == [(2, 1)]
    reg = linkage.yearly_registry(df.withColumn("y", F.lit(2013)), "k", "y", [F.col("o")], F.col("ok") == 1)
    assert values(reg, "k", "transfers") == [(2, 0)]


def test_extreme_is_taken_before_the_filter(spark):
    df = spark.createDataFrame([(1, 1, "no"), (1, 2, "yes"), (2, 1, "yes")], "k int, d int, c string")
    assert values(windows.extreme_rows(df, ["k"], "d", also=F.col("c") == "yes"), "k", "d") == [(2, 1)]


def test_fill_lags_changes(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, "a"), (1, 3, None), (1, 4, "b")], "k int, o int, v string")
    order = [F.col("o")]
    assert [v for _, v in values(windows.fill(df, ["v"], ["k"], order, "down"), "o", "v")] == [None, "a", "a", "b"]
    assert [v for _, v in values(windows.fill(df, ["v"], ["k"], order, "up"), "o", "v")] == ["a", "a", "b", "b"]
    assert [v for _, v in values(windows.fill(df, ["v"], ["k"], order, "downup"), "o", "v")] == ["a", "a", "a", "b"]
    t = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, None), (1, 4, 0)], "k int, o int, t int")
    assert values(windows.changes(t, ["k"], "t", order), "changes")[0] == (1,)


def test_ids_are_dense_and_ordered(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",), ("c",)], "v string")
    assert values(windows.with_group_id(df, ["v"]), "v", "group_id") == [("a", 2), ("a", 2), ("b", 3), ("c", 4), (None, 1)]
    big = spark.range(1000).select((999 - F.col("id")).alias("id"))
    assert all(a + 1 == b for a, b in values(windows.surrogate_key(big, ["id"]), "id", "row_id"))


def test_random_row_does_not_depend_on_layout(spark):
    df = spark.range(200).select((F.col("id") % 7).alias("g"), "id")
    assert values(windows.random_row(df, ["g"], ["id"], 5), "g", "id") == values(windows.random_row(df.repartition(3), ["g"], ["id"], 5), "g", "id")


# reshaping


def test_reshape(spark):
    wide = spark.createDataFrame([(1, 2, None), (2, 3, 4)], "id int, `a.x` int, `a.y` int")
    wide = wide.toDF("id", "a_x", "a_y")
    long = reshape.longer(wide, ["id"], "^a_", ["kind", "which"], "v", r"^(a)_(.)$")
    assert values(long, "id", "kind", "which", "v") == [(1, "a", "x", 2), (1, "a", "y", None), (2, "a", "x", 3), (2, "a", "y", 4)]
    assert reshape.longer(wide, ["id"], "^a_", drop_null=True).count() == 3
    back = reshape.wider(long, ["id"], "which", "v", ["x", "y"], fill=0)
    assert values(back, "id", "x", "y") == [(1, 2, 0), (2, 3, 4)]
    grid = reshape.complete(spark.createDataFrame([(1, 2000, 5), (2, 2001, 6)], "c int, y int, n int"), "c", "y", {"n": 0})
    assert values(grid, "c", "y", "n") == [(1, 2000, 5), (1, 2001, 0), (2, 2000, 0), (2, 2001, 6)]
    s = reshape.split_column(spark.createDataFrame([("a-b-c",), ("d",)], "v string"), "v", ["p", "q"], "-")
    assert values(s, "p", "q") == [("a", "b-c"), ("d", None)]
    e = reshape.drop_empty_columns(spark.createDataFrame([(1, None), (2, None)], "a int, b int"))
    assert e.columns == ["a"]


# scalars


def test_clean_text(spark):
    f = lambda v, **k: one(spark, scalars.clean_text(F.col("v"), **k), v=v)
    assert f("  José   NÚÑEZ-díaz. ") == "jose nunezdiaz" and f("#null!") is None and f("") is None
    assert f("a - b") == "a  b" and f("a - b", strict=True) == "a b"
    assert f(".") == "" and f(".", strict=True) is None and f("1+1<$3") == "1+1<$3" and f("straße") == "strasse"


def test_numbers_and_dates(spark):
    v = F.col("v")
    assert one(spark, scalars.safe_int(v), v="12.5") == 12 and one(spark, scalars.safe_int(v), v="99999999999") is None
    assert one(spark, scalars.digits_to_int(v), v="DNI 123") == 123 and one(spark, scalars.digits_to_int(v), v="99999999") is None
    assert one(spark, scalars.safe_long(v), v="9007199254740993") == 9007199254740993
    assert one(spark, scalars.repair_date(v), v="dd-mm-2001") == D(2001, 1, 1) and one(spark, scalars.repair_date(v), v="91-05-013") == D(2013, 5, 1)
    parts = lambda y, m, d: one(spark, scalars.date_from_parts(F.col("y"), F.col("m"), F.col("d")), y=y, m=m, d=d)
    assert parts(2011, 2, 31) == D(2011, 2, 28) and parts(2012, 13, 0) == D(2012, 12, 1) and parts(2014, 1, 1) is None
    assert one(spark, scalars.nearest_year(v), v=D(2010, 6, 30)) == 2010 and one(spark, scalars.nearest_year(v), v=D(2010, 7, 1)) == 2011
    assert one(spark, scalars.entry_cohort(v), v=D(2000, 3, 31)) == 2005 and one(spark, scalars.entry_cohort(v), v=D(2000, 4, 1)) == 2006
    assert one(spark, scalars.area_code(v), v=123456789) == "012345" and one(spark, scalars.local_code(v), v=123456789) == "6789"


@pytest.mark.parametrize("a, b, want", [
    (D(2001, 1, 31), D(2001, 1, 31), 1), (D(2001, 1, 31), D(2002, 1, 31), 2), (D(2001, 1, 31), D(2001, 2, 28), 3), (D(2001, 2, 1), D(2001, 1, 31), -2),
    (D(2001, 3, 5), D(2001, 4, 5), 2), (D(2002, 3, 5), D(2001, 3, 5), -2), (D(2001, 1, 1), D(2009, 1, 1), 3), (None, D(2009, 1, 1), 3),
])
def test_calendar_diff(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a date, b date")
    assert df.select(scalars.calendar_diff_code(F.col("a"), F.col("b"))).first()[0] == want


# recoding


def test_recode(spark):
    df = spark.createDataFrame([("nunca", 1), ("siempre", 2), ("quizas", None), (None, 4)], "a string, b int")
    assert [r.a for r in recode.orderize(df, "^a$", "time").collect()] == [0, 3, None, None]
    assert [r.a for r in recode.binarize(df, "^a$", "nunca").collect()] == [True, None, None, None]
    assert [r.a for r in recode.binarize(df, "^a$", "nunca", else_false=True).collect()] == [True, False, False, None]
    assert recode.dummify(df, "zz", "q", "x") is df
    chain = recode.translate_values(F.col("a"), [("nunca", "siempre"), ("siempre", "x")])
    assert [r[0] for r in df.select(chain).collect()] == ["x", "x", "quizas", None]
    with pytest.raises(ValueError):
        recode.rename_by_dictionary(df, [("a|b", "c")])
    bins = df.select(recode.bin_values(F.col("b"), [1, 2, 4]).alias("l"), recode.bin_values(F.col("b"), [1, 2, 4], right=True).alias("r"), recode.bin_values(F.col("b"), [1, 2, 4], include_lowest=True).alias("i"))
    assert [tuple(r) for r in bins.collect()] == [(1, None, 1), (2, 1, 2), (None, None, None), (None, 2, 2)]
    flags = spark.createDataFrame([(True, None), (None, None), (False, False)], "a boolean, b boolean")
    assert [r[0] for r in flags.select(recode.merge_flags(F.col("a"), F.col("b"))).collect()] == [True, None, False]
    assert values(recode.delete_where(df, F.col("b") > 1), "b") == [(1,), (None,)]
    p = recode.patch_rows(df.select("b", "a"), spark.createDataFrame([(1, "new"), (2, None)], "b int, a string"), "b")
    assert ("new",) in values(p, "a") and ("siempre",) in values(p, "a")


def test_rule_recode(spark):
    df = spark.createDataFrame([(2003, "f", 5), (2003, "f", 9), (2015, "f", 5), (2003, "g", 5)], "y int, f string, c int")
    rules = spark.createDataFrame([(2000, 2010, "f", 1, 6, 2, "late"), (2003, 2003, "f", 5, 5, 1, "first")], "year_lo int, year_hi int, form string, code_lo int, code_hi int, priority int, label string")
    assert values(recode.rule_recode(df, rules, "y", "f", "c"), "c", "label") == [(5, "first")]


# linkage


def test_links(spark):
    x = spark.createDataFrame([(1, "ana", "A", 5), (2, "bo", "A", 6), (3, "bo", "A", 7), (4, "cy", "B", 8)], "xid int, n string, s string, b int")
    y = spark.createDataFrame([(11, "ana", "A", 5), (12, "bo", "A", 7), (13, "cy", "Z", 8), (14, "cy", None, 1)], "yid int, n string, s string, b int")
    got = values(linkage.cascade(x, y, "xid", "yid", [["n", "s", "b"], ["n", "b"], ["n", "s"]]), "xid", "yid", "filter_stage")
    assert got == [(1, 11, 1), (2, None, None)][:1] + [(3, 12, 1), (4, 13, 2)]
    f = values(linkage.fallback_link(x, y, "xid", "yid", [["n", "s", "b"], ["n"]]), "xid", "yid", "priority")
    assert f == [(1, 11, 1), (2, 12, 2), (3, 12, 1), (4, 13, 2)]
    z = linkage.null_conflicts(spark.createDataFrame([("a", 1, D(2000, 1, 1)), ("a", 2, D(2000, 1, 1)), ("b", 3, D(2000, 1, 1)), ("b", 3, D(2001, 1, 1))], "n string, id int, d date"), ["n"], "id", "d")
    assert values(z, "n", "id", "d") == [("a", None, D(2000, 1, 1)), ("b", 3, None)]
    d = linkage.dedupe_exact(x, ["n", "s"], [F.desc("b"), F.col("xid")])
    assert values(d, "xid") == values(linkage.dedupe_exact(d, ["n", "s"], [F.desc("b"), F.col("xid")]), "xid") == [(1,), (3,), (4,)]


# fuzzy work


@pytest.mark.parametrize("most, transpositions", [(1, False), (2, False), (1, True), (2, True)])
def test_fuzzy_pairs_equal_brute_force(spark, most, transpositions):
    r = random.Random(4)
    texts = ["".join(r.choice("abcd") for _ in range(r.randint(3, 12))) for _ in range(120)]
    texts += ["".join(t[:k] + t[k + 1 : k + 2] + t[k : k + 1] + t[k + 2 :]) for t in texts[:40] for k in [r.randrange(len(t) - 1)]]
    df = spark.createDataFrame([(t,) for t in set(texts)], "t string")
    plain = lambda a, b: _levenshtein(a, b)
    d = fuzzy._damerau if transpositions else plain
    want = sorted((a, b, d(a, b)) for a in set(texts) for b in set(texts) if d(a, b) <= most)
    assert values(fuzzy.fuzzy_pairs(df, df, "t", "t", most, transpositions), "left_text", "right_text", "distance") == sorted(want, key=repr)


def test_fuzzy_names_d2_compares_all_names(spark, sf_dir):
    names = {r[0] for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").collect()}
    want = sorted(((a, b, d) for a in names for b in names if (d := _levenshtein(a, b)) <= 2), key=repr)
    got = values(catalog.QUERIES["fuzzy_names_d2"](spark, sf_dir), "left_text", "right_text", "distance")
    assert got == want and len(want) > len(names)


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_damerau_and_substring(spark):
    assert fuzzy._damerau("ca", "abc") == 2 and fuzzy._damerau("abcd", "abdc") == 1
    df = spark.createDataFrame([("abc", "xxabdxx"), ("abc", None), ("abc", "zzz")], "p string, t string")
    assert [r[0] for r in df.select(fuzzy.substring_distance(F.col("p"), F.col("t"), 2)).collect()] == [1, None, -1]


def test_cluster_strings_leaders(spark):
    r = random.Random(9)
    texts = list(dict.fromkeys("".join(r.choice("ab") for _ in range(r.randint(4, 9))) for _ in range(60)))
    df = spark.createDataFrame(list(enumerate(texts)), "o int, t string")
    want: dict = {}
    for t in texts:
        lead = next((x for x in texts if want.get(x) == x and fuzzy._damerau(t, x) <= 1), None)
        want[t] = lead or t
    assert {x.text: x.leader for x in fuzzy.cluster_strings(df, "t", 1, "o").collect()} == want
    comp = fuzzy.cluster_strings(df, "t", 1, "o", "components")
    assert comp.count() == len(texts) and comp.select("leader").distinct().count() <= len(set(want.values()))


def _calls(spark, monkeypatch, most: int) -> tuple[int, int]:
    """Rows found among 300 texts that begin alike, and pairs that are left to the distance."""
    r = random.Random(4)
    texts = [f"Customer#000{k:06}" for k in r.sample(range(1_000_000), 299)] + ["odd one"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    asked = spark.sparkContext.accumulator(0)

    def counted(a, b, most):
        @F.udf("int")
        def run(x, y):
            asked.add(1)
            return _levenshtein(x, y)

        return run(a, b)

    monkeypatch.setattr(fuzzy.F, "levenshtein", counted)
    found = fuzzy.fuzzy_pairs(df, df, "s", "s", most).collect()
    want = {(a, b) for a in texts for b in texts if _levenshtein(a, b) <= most}
    assert len(found) == len(want) and {(x.left_text, x.right_text) for x in found} == want
    return len(found), asked.value


@pytest.mark.parametrize("most", [1, 2])
def test_fuzzy_pairs_try_few_pairs_of_one_beginning(spark, monkeypatch, most):
    rows, asked = _calls(spark, monkeypatch, most)
    assert rows >= 300 and rows <= asked < 0.12 * 300 * 300


@pytest.mark.parametrize("transpositions", [False, True])
def test_fuzzy_pairs_of_texts_that_begin_alike(spark, transpositions):
    """Every pair once, also of texts that share a beginning, are shorter than it, empty or in no block."""
    r = random.Random(8)
    word = lambda: r.choice(["Customer#0", "Customer#", "Cus", ""]) + "".join(r.choice("01é") for _ in range(r.randint(0, 6)))
    x, y = ([(r.choice(["u", "v", None]), word()) for _ in range(n)] + [("u", ""), ("u", None)] for n in (90, 70))
    d = fuzzy._damerau if transpositions else _levenshtein
    want = sorted((g, a, b, d(a, b)) for g, a in set(x) for h, b in set(y) if g is not None and g == h and a is not None and b is not None and d(a, b) <= 2)
    left, right = spark.createDataFrame(x, "g string, a string"), spark.createDataFrame(y, "g string, b string")
    assert sorted(tuple(p) for p in fuzzy.fuzzy_pairs(left, right, "a", "b", 2, transpositions, ["g"]).collect()) == want


def test_fuzzy_left_join_keeps_rows(spark):
    x = spark.createDataFrame([(1, "lima"), (2, "cuzco"), (3, "xxxxxx")], "i int, n string")
    y = spark.createDataFrame([(7, "limaa"), (8, "cusco")], "j int, n string")
    assert values(fuzzy.fuzzy_left_join(x, y, "n", 1), "i", "j", "distance") == [(1, 7, 1), (2, 8, 1), (3, None, None)]


# graphs and space


def test_components_do_not_depend_on_order(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (200, 200)] + [(r.randrange(300, 330), r.randrange(300, 330)) for _ in range(40)]
    root: dict = {}
    find = lambda k: k if root.setdefault(k, k) == k else find(root[k])
    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = {k: find(k) for k in list(root)}
    for order in (edges, edges[::-1], r.sample(edges, len(edges))):
        df = spark.createDataFrame(order, "u long, v long").repartition(3)
        assert {x.node: x.component for x in graph.components(df).collect()} == want


def test_merge_groupings(spark):
    df = spark.createDataFrame([(1, 1, 10), (2, 2, 10), (3, 2, 11), (4, 3, None), (5, 4, 12), (6, None, 12), (7, None, None)], "r int, a int, b int")
    got = {x.r: x.group_id for x in graph.merge_groupings(df, "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 2, 5: 3, 6: 3, 7: None}


def test_footprint(spark):
    pts = [(1, x, y) for x in (0.0, 1.0, 0.5) for y in (0.0, 2.0, 1.0)] + [(2, 0.0, 0.0), (2, 3.0, 0.0), (3, 5.0, 5.0)]
    got = {r.g: r.area for r in space.footprint(spark.createDataFrame(pts, "g int, x double, y double").repartition(3), "g", "x", "y", 1.0).collect()}
    assert set(got) == {1, 2} and got[1] == pytest.approx(2 + 6 + np.pi) and got[2] == pytest.approx(6 + np.pi)


def test_select_scale(spark):
    df = spark.createDataFrame([(1, 5, 1.0, 6, 99.0), (2, 5, 1.0, 6, 2.0), (3, 5, 1.0, 0, None), (4, 5, 99.0, 6, 99.0)], "r int, i1 long, a1 double, i2 long, a2 double")
    got = space.select_scale(df, [("small", "i1", "a1"), ("large", "i2", "a2")], 10)
    assert values(got, "r", "scale_id", "scale") == [(1, 5, "small"), (2, 6, "large"), (3, 0, "large"), (4, 0, None)]


def test_resolve_places(spark):
    x = spark.createDataFrame([(1, 101010001, "san pedro"), (2, 101010002, "los andess"), (3, 909090001, "nada")], "r int, p long, n string")
    ref = spark.createDataFrame([(51, 101010009, "san pedrro", 0.0, 0.0), (52, 101010008, "los andes", 0.0, 0.0), (53, 101010007, "los andes", 10.0, 10.0)], "id int, p long, n string, x double, y double")
    got = values(space.resolve_places(x, ref, "r", "p", "n", "id", "x", "y", steps=((2, 6), (2, 4))), "r", "id", "step")
    assert got[0] == (1, 51, 1) and got[1][0] == 2 and got[1][1] in (52, 53) and len(got) == 2


def test_resolve_places_query_takes_all_parts(spark, sf_dir):
    parts = {r.p_partkey: (r.p_partkey % 7, r.p_name) for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    got = {r.p_partkey: (r.ref_id, r.step) for r in catalog.QUERIES["resolve_places"](spark, sf_dir).collect()}
    assert set(got) == {k for k, (_, n) in parts.items() if n is not None}
    for k, (ref, step) in got.items():
        area, name = parts[k]
        near = min(_levenshtein(name + "s", n) for a, n in parts.values() if a == area and n is not None)
        assert step == 1 and parts[ref][0] == area and _levenshtein(name + "s", parts[ref][1]) == near
    assert {ref % 5 for ref, _ in got.values()} == set(range(5))


# panels


def test_panels(spark):
    p = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 1, 1), (2, 2, 0), (3, 1, 0), (3, 2, 0)], "u int, t int, d int")
    assert {r.u: r.switcher for r in panel.switchers(p, "u", "d").collect()} == {1: True, 2: True, 3: False}
    assert {r.u: r.monotone for r in panel.monotone_switchers(p, "u", "d", [F.col("t")]).collect()} == {1: True, 2: False, 3: False}
    assert values(panel.first_treated(p, "u", "t", "d"), "u", "t", "first_treated") == [(1, 1, 2), (1, 2, 2), (2, 1, 1), (3, 1, None), (3, 2, None)]
    h = spark.createDataFrame([(1, D(2000, 1, 1), True, 1, 0), (1, D(2003, 1, 1), True, 0, 0), (1, D(1970, 1, 1), False, 0, None)], "h int, b date, c boolean, w int, v int")
    got = panel.household_features(h, "h", "b", F.col("c"), ["w"], ["w", "v"])
    assert values(got, "children", "welfare", "healthcare", "first_born") == [(2, 0, 0, False), (2, 0, None, False), (2, 1, 1, True)]


# estimation


def _frame(n=400, seed=0):
    r = np.random.default_rng(seed)
    g, k, x, z, w = r.integers(0, 25, n), r.integers(0, 6, n), r.normal(size=n), r.normal(size=n), r.uniform(0.5, 2, n)
    y = 2 * x - z + g * 0.3 + k * 0.7 + r.normal(size=n)
    return g, k, x, z, w, y


def test_fixed_effects_equal_dummies(spark):
    g, k, x, z, w, y = _frame()
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(g, k, x, z, w, y, strict=True)], "g double, k double, x double, z double, w double, y double")
    for effects in (["g"], ["g", "k"]):
        dummies = [np.stack([(v == u).astype(float) for u in np.unique(v)], 1) for v in ([g] if len(effects) == 1 else [g, k])]
        m = np.column_stack([x, z, *dummies]) * np.sqrt(w)[:, None]
        want = np.linalg.lstsq(m, y * np.sqrt(w), rcond=None)[0][:2]
        got = {r.term: r for r in estimate.fe_regression(df, "y", ["x", "z"], effects, "w", ["g"]).collect()}
        assert [got["x"].estimate, got["z"].estimate] == pytest.approx(list(want), abs=1e-6)
        assert 0.02 < got["x"].se < 0.2 and got["x"].p < 1e-6
    ols = {r.term: r for r in estimate.fe_regression(df, "y", ["x"]).collect()}
    want = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
    assert [ols["(intercept)"].estimate, ols["x"].estimate] == pytest.approx(list(want), abs=1e-8)


def test_effects_recover_the_truth(spark):
    r = np.random.default_rng(1)
    rows = [(u, t, float(u % 7 + t + (3.0 if u % 3 == 0 and t >= 3 else 0) + 0.01 * r.normal()), 3 if u % 3 == 0 else None, int(u % 3 == 0 and t >= 3)) for u in range(60) for t in range(6)]
    df = spark.createDataFrame(rows, "u int, t int, y double, g int, d int")
    att = estimate.att_gt(df, "u", "t", "y", "g")
    assert estimate.att_simple(att).first().att == pytest.approx(3, abs=0.05)
    assert estimate.imputation_effect(df, "u", "t", "y", "d").first().effect == pytest.approx(3, abs=0.05)
    assert 0 <= estimate.att_bootstrap(df, "u", "t", "y", "g", 10).first().se < 0.1


def test_balance_and_weights(spark):
    r = np.random.default_rng(5)
    rows = [(int(k % 20), int(r.random() < 0.5), float(r.normal()), float(r.normal())) for k in range(300)]
    df = spark.createDataFrame(rows, "u int, d int, a double, b double")
    b = {x.variable: x for x in estimate.balance_table(df, "d", ["a", "b"]).collect()}
    one_, zero = [x[2] for x in rows if x[1]], [x[2] for x in rows if not x[1]]
    assert b["a"].mean_1 == pytest.approx(np.mean(one_)) and b["a"].t == pytest.approx((np.mean(one_) - np.mean(zero)) / np.sqrt(np.var(one_, ddof=1) / len(one_) + np.var(zero, ddof=1) / len(zero)))
    w = estimate.propensity_weights(panel.switchers(df, "u", "d", "s").withColumn("s", F.col("s").cast("int")).withColumn("s", F.when(F.col("u") == 0, 0).otherwise(F.col("s"))), "d", "s", ["a", "b"], "u", 0.01)
    assert w.filter("weight <= 0 or weight is null").count() == 0 and w.count() > 200


# indices


def test_component_index(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=200)
    x = np.column_stack([base + 0.3 * r.normal(size=200) for _ in range(4)])
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double, d double")
    got = np.array([r_["index"] for r_ in indices.component_index(df, ["a", "b", "c", "d"]).collect()])
    z = (x - x.mean(0)) / x.std(0)
    v = np.linalg.eigh(np.corrcoef(x.T))[1][:, -1]
    assert np.corrcoef(got, z @ v)[0, 1] ** 2 == pytest.approx(1)


@pytest.mark.parametrize("rows", [[(0, 0), (1, 1), (2, 2), (3, 1), (4, -3)], [(0, 3), (1, 1), (2, 2), (3, 0)], [(5, 0), (0, 5), (1, 1)]])
def test_component_of_two_opposed_items(spark, rows):
    """Weights sum to 0: the first item's is positive in either order."""
    df = spark.createDataFrame([tuple(map(float, v)) for v in rows], "a double, b double")
    x = np.array(rows, float)
    z = (x - x.mean(0)) / x.std(0)
    for names, want in ((["a", "b"], z[:, 0] - z[:, 1]), (["b", "a"], z[:, 1] - z[:, 0])):
        got = {(r.a, r.b): r["index"] for r in indices.component_index(df, names).collect()}
        assert [got[tuple(v)] for v in x] == pytest.approx(list(want / np.sqrt(2)))


def test_chained_imputation(spark):
    r = np.random.default_rng(3)
    rows = [(k, None if k % 5 == 0 else float(k), float(2 * k + r.normal()), None if k % 7 == 0 else float(-k + r.normal())) for k in range(150)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double")
    run = lambda: {(x.i, x.imputation): (x.a, x.b, x.c) for x in indices.chained_imputation(df, "i", ["a", "b", "c"], 2, 3).collect()}
    got = run()
    assert len(got) == 300 and all(v is not None for x in got.values() for v in x)
    assert all(got[(k, m)][0] == a for k, a, *_ in rows if a is not None for m in (1, 2))
    assert max(abs(got[(k, 1)][0] - k) for k in range(0, 150, 5)) < 12 and got[(0, 1)] != got[(0, 2)] and run() == got


# checks


def test_checks(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (2, None), (None, 7)], "k int, r int")
    assert values(checks.duplicate_keys(df, ["k"]), "k", "n") == [(1, 2), (None, 1)]
    ref = spark.createDataFrame([(5,), (7,)], "id int")
    assert values(checks.orphans(df, ref, ["r"], ["id"]), "r") == [(6,)]
    assert tuple(checks.coverage(df.select("k"), spark.createDataFrame([(2,), (9,)], "k int"), "k").first()) == (1, 1, 1)


# loops end, and say so where they don't


def test_components_of_a_long_chain(spark):
    n = (1 << 12) + 57
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[k], order[k + 1]) for k in range(n - 1)] + [(n + 5, n + 6)], "u long, v long").repartition(4)
    out = graph.components(edges)
    assert out.count() == n + 2 and values(out.groupBy("component").count(), "component", "count") == [(0, n), (n + 5, 2)]
    with pytest.raises(RuntimeError):
        graph.components(edges, max_rounds=2)


def test_unfinished_loops_raise(spark):
    r = random.Random(2)
    rows = [(k % 7, r.randrange(5), float(r.randrange(11)), r.random()) for k in range(400)]
    df = spark.createDataFrame(rows, "a int, b int, x double, y double")
    with pytest.raises(RuntimeError):
        estimate.demean(df, ["x", "y"], ["a", "b"], rounds=1)
    three = estimate.demean(df.withColumn("c", (F.col("x") % 3).cast("int")), ["y"], ["a", "b", "c"])
    for e in ("a", "b", "c"):
        assert max(abs(m) for (m,) in values(three.groupBy(e).agg(F.avg("y").alias("m")), "m")) < 1e-8
    with pytest.raises(RuntimeError):
        estimate.imputation_effect(df.withColumn("t", (F.rand(1) < 0.3).cast("int")), "a", "x", "y", "t", rounds=1)


# exact quantiles of any group


def test_quantiles_equal_numpy(spark):
    r = random.Random(5)
    rows = [("hot" if k % 3 else r.choice(["a", "b", None]), r.choice([1.0, 2.5, r.gauss(0, 9), None])) for k in range(900)] + [("single", 4.0), ("null", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {x["g"]: x["q"] for x in aggs.quantiles(df, ["g"], "v", (0, 0.1, 0.25, 0.5, 0.99, 1)).collect()}
    assert set(got) == {"hot", "a", "b", None, "single"}
    for g, q in got.items():
        assert q == pytest.approx(list(np.quantile([v for h, v in rows if h == g and v is not None], (0, 0.1, 0.25, 0.5, 0.99, 1))))
    every = [v for _, v in rows if v is not None]
    assert aggs.quantiles(df, [], "v", (0.3,)).first()["q"] == pytest.approx([np.quantile(every, 0.3)])


# linkage by rules


def test_cascade_rules_by_stage(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, "x", 9), (3, "y", 1)], "l int, n string, s int")
    b = spark.createDataFrame([(10, "x", 5), (11, "y", 1), (12, "x", 8)], "r int, n string, s2 int")
    near = lambda pairs: pairs.filter(F.abs(F.col("s") - F.col("s2")) <= 1)
    assert values(linkage.cascade(a, b, "l", "r", [["n"], ["n"]], accept=[None, near]), "l", "r", "filter_stage") == [(1, 10, 2), (2, 12, 2), (3, 11, 1)]
    assert values(linkage.cascade(a, b, "l", "r", [["n"]], accept=near), "l", "r") == [(1, 10), (2, 12), (3, 11)]


def test_cascade_links_the_nearest_of_both_sides(spark, tmp_path):
    """As the rule over all pairs of a name says, ties by the least id; a table of one name makes no pairs."""
    r = random.Random(12)
    a = [(k, r.choice(["u", "v", None]), r.choice([*range(0, 40, 3), None])) for k in r.sample(range(1000), 60)]
    b = [(k, r.choice(["u", "v", "w"]), r.choice([*range(0, 60, 4), None])) for k in r.sample(range(1000), 50)]

    def mutual(a, b):
        near = {(i, j): abs(s - t) for i, n, s in a for j, m, t in b if n is not None and n == m and s is not None and t is not None}
        first = lambda own, other: {i: min((d, p[other]) for p, d in near.items() if p[own] == i)[1] for i in {p[own] for p in near}}
        x, y = first(0, 1), first(1, 0)
        return sorted(((i, j, 1) for i, j in x.items() if y[j] == i), key=repr)

    left, right = spark.createDataFrame(a, "l int, n string, s int"), spark.createDataFrame(b, "r int, n string, t int")
    assert mutual(a, b) and values(linkage.cascade(left, right, "l", "r", [["n"]], accept=linkage.Nearest("s", "t")), "l", "r", "filter_stage") == mutual(a, b)
    # 60,000 rows of one name: 900 million pairs
    many = spark.range(60_000).selectExpr("id as p_partkey", "'bolt' as p_name", "'b' as p_brand", "cast(id % 50 + 1 as int) as p_size")
    many.write.parquet(f"{tmp_path}/part.parquet")
    assert values(catalog.QUERIES["cascade_rules"](spark, str(tmp_path)), "xid", "yid", "filter_stage") == [(24, 25, 2)]


def test_link_three_leaves_out_common_keys_only_if_asked(spark):
    t = lambda k, n: spark.createDataFrame([(i, "common") for i in range(n)] + [(99, "rare")], f"{k} int, n string")
    base, a, b = t("i", 4), t("j", 3), t("k", 2)
    assert linkage.link_three(base, a, b, ["n"], "i", "j", "k").count() == 25
    assert values(linkage.common_keys(base, a, b, ["n"], 10), "n", "pairs") == [("common", 24)]
    assert values(linkage.link_three(base, a, b, ["n"], "i", "j", "k", most_pairs=10), "i", "j", "k") == [(99, 99, 99)]


def test_link_three_of_repeated_ids_and_common_keys(spark, monkeypatch):
    """As the plain joins, with ids that stand on several keys, repeated rows and nulls; no link is moved after it is made."""
    monkeypatch.setattr(linkage, "CELL", 3)
    r = random.Random(3)
    rows = lambda n, ids: [(r.choice([*range(ids), None]), r.choice(["u", "u", "v", "w", None]), r.choice([1, 1, 2])) for _ in range(n)]
    base, a, b = rows(40, 25), rows(20, 30), rows(15, 30)
    x = [(i, j, n, s) for i, n, s in base for j, m, t in a if n is not None and (n, s) == (m, t)]
    y = [(i, j) for i, n, s in base for j, m, t in b if n is not None and (n, s) == (m, t)]
    cube = [(i, j, k, n, s) for i, j, n, s in x for h, k in y if i is not None and i == h]
    per = {g: sum(c[3:] == g for c in cube) for g in {c[3:] for c in cube}}
    sides = (spark.createDataFrame(t, f"{i} int, n string, s int") for t, i in ((base, "i"), (a, "j"), (b, "k")))
    out = linkage.link_three(*sides, ["n", "s"], "i", "j", "k")
    assert out.columns == ["i", "j", "n", "s", "k", "pairs_per_key"] and "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((tuple(o) for o in out.collect()), key=repr) == sorted(((i, j, n, s, k, per[n, s]) for i, j, k, n, s in cube), key=repr)


def test_added_level(spark):
    got = [one(spark, linkage.added_level(F.col("v"), F.col("i"), F.col("d")), v=1, i=i, d=d) for i, d in ((1, 4), (2, 2), (2, 5), (3, 1), (4, 3), (4, 4), (5, 1), (5, 3), (5, 5), (6, 1), (2, 1), (9, 1))]
    assert got == [1, 3, 4, 1, 4, 5, 5, 6, 7, 3, None, None]


def _leaders(texts: list[str], most: int) -> dict:
    led: dict = {}
    for t in texts:
        led[t] = next((x for x in led if led[x] == x and fuzzy._damerau(t, x) <= most), t)
    return led


def test_merged_groups_equal_brute_force(spark):
    r = random.Random(3)
    texts = sorted({"".join(r.choice("ab") for _ in range(r.randint(4, 9))) for _ in range(40)})
    order = texts[:]
    r.shuffle(order)
    df = spark.createDataFrame(list(enumerate(order)), "k int, t string")
    groups: dict = {}
    for t, leader in _leaders(order, 1).items():
        groups.setdefault(leader, []).append(t)
    held = {min(ts): sorted(ts) for ts in groups.values()}
    while True:
        again = _leaders(sorted(held), 2)
        new: dict = {}
        for first, leader in again.items():
            new.setdefault(leader, []).extend(held[first])
        new = {min(ts): sorted(ts) for ts in new.values()}
        if len(new) == len(held):
            break
        held = new
    out = fuzzy.merge_close_groups(fuzzy.cluster_strings(df, "t", 1, "k"), 2)
    assert values(out, "text", "leader", "label") == sorted(((t, f, ", ".join(ts)) for f, ts in new.items() for t in ts), key=repr)


# indices


def test_latent_correlation_recovers_the_traits(spark):
    rng = np.random.default_rng(1)
    for rho in (-0.7, 0.0, 0.45, 0.9):
        z = rng.multivariate_normal([0, 0], [[1, rho], [rho, 1]], 40_000)
        a, b = np.digitize(z[:, 0], [-0.8, 0.3, 1.2]), np.digitize(z[:, 1], [-0.2, 0.9])
        table = np.zeros((4, 3))
        np.add.at(table, (a, b), 1)
        assert indices.latent_correlation(table) == pytest.approx(rho, abs=0.02)
    # of two halves: the closed form of the tetrachoric correlation with medians as thresholds
    assert indices.latent_correlation(np.array([[40.0, 10], [10, 40]])) == pytest.approx(np.sin(np.pi / 2 * 0.6), abs=1e-4)
    df = spark.createDataFrame([(int(x), int(y), None if k == 0 else 1) for k, (x, y) in enumerate(zip(a[:2000], b[:2000], strict=True))], "a int, b int, c int")
    assert indices.latent_correlations(df, ["a", "b"])[0, 1] > 0.85
    out = indices.component_index(df, ["a", "b"], latent=True)
    assert out.filter("index is null").count() == 0 and abs(out.agg(F.avg("index")).first()[0]) < 1e-9
    with pytest.raises(ValueError):
        indices.latent_correlations(spark.range(100).selectExpr("id as a", "id as b"), ["a", "b"])


def test_imputation_kinds(spark):
    r = random.Random(9)
    rows = []
    for k in range(600):
        x = r.gauss(0, 1)
        rows.append((k, x, None if k % 5 == 0 else float(r.random() < 1 / (1 + np.exp(-3 * x))), None if k % 7 == 0 else float(min(3, max(0, round(1.5 + x))))))
    df = spark.createDataFrame(rows, "k int, x double, yes double, grade double")
    args = (df, "k", ["x", "yes", "grade"], 3, 3)
    out = indices.chained_imputation(*args, kinds={"yes": "binary", "grade": "ordered"}, order=["grade", "yes", "x"]).collect()
    assert len(out) == 1800 and {o.yes for o in out} == {0.0, 1.0} and {o.grade for o in out} == {0.0, 1.0, 2.0, 3.0}
    known = {k: (yes, grade) for k, _, yes, grade in rows}
    assert all(known[o.k][0] in (None, o.yes) and known[o.k][1] in (None, o.grade) for o in out)
    high, low = ([o.yes for o in out if known[o.k][0] is None and (o.x > 0.5) == side and abs(o.x) > 0.5] for side in (True, False))
    assert np.mean(high) > np.mean(low) + 0.3
    assert sorted(out) == sorted(indices.chained_imputation(*args, kinds={"yes": "binary", "grade": "ordered"}, order=["grade", "yes", "x"]).collect())


def test_balance_of_categories(spark):
    df = spark.createDataFrame([(0, "a")] * 30 + [(0, "b")] * 10 + [(1, "a")] * 15 + [(1, "b")] * 25 + [(1, None), (None, "a")], "t int, c string")
    got = {r["level"]: r for r in estimate.balance_categories(df, "t", ["c"]).collect()}
    e = [45 / 2, 35 / 2]
    chi2 = sum((n - x) ** 2 / x for n, x in ((30, e[0]), (15, e[0]), (10, e[1]), (25, e[1])))
    assert got["a"]["n_0"] == 30 and got["b"]["share_1"] == pytest.approx(25 / 40) and got["a"]["df"] == 1
    assert got["a"]["chi2"] == pytest.approx(chi2) and got["a"]["p"] == pytest.approx(0.00072, abs=3e-4)


@pytest.mark.parametrize(("rx", "to"), [("15-dd-mm-2001", None), ("dd-mm-2001", D(2001, 1, 1)), ("31-11-2013", D(2013, 11, 30)), ("05-06-013", D(2013, 6, 5)), ("91-06-2007", D(2007, 6, 1)), ("05-06-197", D(1997, 6, 5)), ("05-06-0002", D(2000, 6, 5)), ("05-06-0206", D(2006, 6, 5)), ("05-06-2025", D(2005, 6, 5)), ("05-06-1098", D(1998, 6, 5)), ("31-02-2007", None)])
def test_date_repairs(spark, rx, to):
    assert one(spark, scalars.repair_date(F.col("s")), s=rx) == to
