"""Registered queries over the driver's tables, with the SQL that gives the same rows.

``orders`` stands for a yearly registry (person = customer, year of the order),
``lineitem`` for repeated measurements, ``part.p_name`` for names, ``events``
for a panel (user, day, purchase = treated).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import recode, scalars
from ..operators import aggs, checks, estimate, fuzzy, graph, indices, joins, linkage, panel, reshape, space, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of a table reader under its name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: _t(spark, sf_dir, name))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _registry(t) -> DataFrame:
    return t("orders").withColumn("year", F.year("o_orderdate"))


def _panel(t) -> DataFrame:
    """A row per user and day: events, purchases, mean value, treated or not."""
    day = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    e = t("events").withColumn("day", day)
    return e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("y"), F.max((F.col("event_type") == "purchase").cast("int")).alias("treated"))


_PANEL = "(select user_id, date_diff('day', date '2024-01-01', ts::date)::int as day, count(*) as n, avg(value) as y, max((event_type = 'purchase')::int) as treated from events group by all)"


# --- linkage -------------------------------------------------------------


@query("""select o_orderkey, o_custkey, year, transfers from (
  select o_orderkey, o_custkey, o_orderstatus, year(o_orderdate)::int as year, count(*) over w - 1 as transfers,
    row_number() over (w order by o_orderpriority, o_orderkey) as rn from orders window w as (partition by o_custkey, year(o_orderdate)))
  where rn = 1 and o_orderstatus = 'F'""")
def yearly_registry(t):
    out = linkage.yearly_registry(_registry(t), "o_custkey", "year", [F.col("o_orderpriority"), F.col("o_orderkey")], F.col("o_orderstatus") == "F")
    return out.select("o_orderkey", "o_custkey", "year", "transfers")


@query("""select o_custkey, a as in_1996, b as in_1997, c as in_1998, a and b and c as in_all, a and b as in_1996_1997, b and c as in_1997_1998 from (
  select o_custkey, bool_or(year(o_orderdate) = 1996) a, bool_or(year(o_orderdate) = 1997) b, bool_or(year(o_orderdate) = 1998) c from orders group by 1)""")
def presence_panel(t):
    return linkage.presence_panel(_registry(t), "o_custkey", "year", [1996, 1997, 1998])


@query("""select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity from (
  select *, row_number() over (partition by l_orderkey, l_linenumber order by l_returnflag, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) rn from lineitem) where rn = 1""")
def dedupe_exact(t):
    order = [F.col(c) for c in ("l_returnflag", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")]
    return linkage.dedupe_exact(t("lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")


@query("""with a as (select * from (select *, count(*) over (partition by p_partkey) n from part) where n = 1 and p_name is not null and p_brand is not null),
  b as (select *, count(*) over (partition by p_name, p_brand) - 1 as homonyms, count(*) over (partition by p_name, p_brand, p_size) m from a)
  select p_partkey, p_name, p_brand, p_size, homonyms from b where m = 1""")
def unique_population(t):
    return linkage.unique_population(t("part"), "p_partkey", ["p_name", "p_brand"], ["p_name", "p_brand", "p_size"]).select("p_partkey", "p_name", "p_brand", "p_size", "homonyms")


@query("""select p_partkey, count(*) over (partition by p_name) - 1 as homonyms_all, count(*) over (partition by p_name, p_brand) - 1 as homonyms_brand,
  count(*) over (partition by p_name, p_brand, p_type) - 1 as homonyms_type from part""")
def homonym_profile(t):
    grains = [("all", []), ("brand", ["p_brand"]), ("type", ["p_brand", "p_type"])]
    return linkage.homonym_profile(t("part"), ["p_name"], grains).select("p_partkey", *[f"homonyms_{g}" for g, _ in grains])


@query("""with x as (select a.p_partkey base, b.p_partkey aid, a.p_name, a.p_brand, a.p_type from part a join part b using (p_name, p_brand, p_type) where a.p_size <= 25 and b.p_size between 10 and 40),
  y as (select a.p_partkey base, b.p_partkey bid from part a join part b using (p_name, p_brand, p_type) where a.p_size <= 25 and b.p_size > 20)
  select base, aid, bid, count(*) over (partition by p_name, p_brand, p_type) as pairs_per_key from x join y using (base)""")
def link_three(t):
    p = t("part")
    src = lambda c, k: p.filter(c).select(F.col("p_partkey").alias(k), "p_name", "p_brand", "p_type")
    out = linkage.link_three(src("p_size <= 25", "base"), src("p_size between 10 and 40", "aid"), src("p_size > 20", "bid"), ["p_name", "p_brand", "p_type"], "base", "aid", "bid")
    return out.select("base", "aid", "bid", "pairs_per_key")


_IDS = "(select o_orderkey, case when o_orderkey % 11 <> 0 then o_custkey end as own, case when o_orderkey % 5 = 0 then null when o_orderkey % 3 = 0 then o_custkey + 1 else o_custkey end as a, case when o_orderkey % 7 = 0 then null when o_orderkey % 4 = 0 then o_custkey + 1 else o_custkey end as b, o_orderdate::date as d, case o_orderkey % 6 when 0 then o_orderdate::date when 1 then (o_orderdate + interval 1 year)::date when 2 then o_orderdate::date - 1 when 3 then (o_orderdate + interval 1 month)::date when 4 then o_orderdate::date + 40 end as d2 from orders)"


def _ids(t) -> DataFrame:
    k, c, d = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("date")
    return t("orders").select(
        "o_orderkey", F.when(k % 11 != 0, c).alias("own"),
        F.when(k % 5 == 0, None).when(k % 3 == 0, c + 1).otherwise(c).alias("a"), F.when(k % 7 == 0, None).when(k % 4 == 0, c + 1).otherwise(c).alias("b"),
        d.alias("d"), F.when(k % 6 == 0, d).when(k % 6 == 1, F.add_months(d, 12)).when(k % 6 == 2, F.date_sub(d, 1)).when(k % 6 == 3, F.add_months(d, 1)).when(k % 6 == 4, F.date_add(d, 40)).alias("d2"),
    )


_ID3 = "case when own = a and own = b then 1 when own = a and b is null then 2 when a is null and own = b then 3 when own <> a and own = b then 4 when own = a and own <> b then 5 when a = b and own <> b then 6 when a is null and own <> b then 7 when own <> a and b is null then 8 when own <> a and own <> b then 9 when a is null and b is null then 10 end"
_ONE = "((d + interval 1 year)::date = d2 and day(d) = day(d2)) or ((d + interval 1 month)::date = d2 and day(d) = day(d2)) or d + 1 = d2"
_BACK = "((d2 + interval 1 year)::date = d and day(d) = day(d2)) or ((d2 + interval 1 month)::date = d and day(d) = day(d2)) or d2 + 1 = d"
_DIFF = f"case when d = d2 then 1 when {_ONE} then 2 when {_BACK} then -2 else 3 end"
_DATE = f"case when d = d2 then 1 when d <> d2 and ({_DIFF}) = 2 then 2 when d <> d2 and ({_DIFF}) = -2 then 3 when d <> d2 then 4 when d2 is null then 5 end"


@query(f"select o_orderkey, {_ID3}::int as agreement, case when ({_ID3}) = 6 then b else own end as id from {_IDS}")
def agreement_id3(t):
    x = _ids(t).withColumn("agreement", linkage.agreement_id3(F.col("own"), F.col("a"), F.col("b")))
    return x.select("o_orderkey", "agreement", linkage.id_swap(F.col("own"), F.col("agreement"), F.col("b")).alias("id"))


@query(f"select o_orderkey, ({_DIFF})::int as code from {_IDS}")
def calendar_diff(t):
    return _ids(t).select("o_orderkey", scalars.calendar_diff_code(F.col("d"), F.col("d2")).alias("code"))


@query(f"select o_orderkey, ({_DATE})::int as agreement from {_IDS}")
def agreement_date(t):
    return _ids(t).select("o_orderkey", linkage.agreement_date(F.col("d"), F.col("d2")).alias("agreement"))


@query(f"""with g as (select *, {_ID3} as ids, {_DATE} as dates, o_orderkey % 2 as h, o_orderkey % 3 as ha, o_orderkey % 4 as hb, o_orderkey % 5 as ht from {_IDS})
  select o_orderkey, (case when hb = 0 and ha = 0 and h = 0 then 1 when ids = 1 then 2 when ids = 2 and hb = 0 then 3 when b is null and ht = 0 and ha = 0 and h = 0 then 4
    when ids between 3 and 4 and dates = 1 then 5 when ids = 10 and dates = 1 and hb = 0 then 6 end)::int as level from g""")
def confidence_level(t):
    k = F.col("o_orderkey")
    x = _ids(t).withColumns({"ids": linkage.agreement_id3(F.col("own"), F.col("a"), F.col("b")), "dates": linkage.agreement_date(F.col("d"), F.col("d2"))})
    return x.select("o_orderkey", linkage.confidence_level(F.col("ids"), F.col("dates"), k % 2, k % 3, k % 4, k % 5, F.col("b")).alias("level"))


@query("""select l_orderkey, l_partkey, l_quantity from (select *, row_number() over (partition by l_orderkey order by l_quantity desc, l_extendedprice, l_partkey, l_linenumber, l_suppkey, l_shipdate) rn from lineitem)
  where rn = 1 and l_returnflag <> 'R'""")
def best_candidate(t):
    order = [F.desc("l_quantity"), *[F.col(c) for c in ("l_extendedprice", "l_partkey", "l_linenumber", "l_suppkey", "l_shipdate")]]
    return linkage.best_candidate(t("lineitem"), "l_orderkey", order, F.col("l_returnflag") != "R").select("l_orderkey", "l_partkey", "l_quantity")


_SIDES = """x as (select p_partkey as xid, p_name n, p_brand b, p_type ty, p_size s from part where p_partkey % 2 = 0),
  y as (select p_partkey as yid, p_name n, p_brand b, p_type ty, p_size s from part where p_partkey % 2 = 1)"""


def _sides(t):
    p = t("part").select("p_partkey", F.col("p_name").alias("n"), F.col("p_brand").alias("b"), F.col("p_type").alias("ty"), F.col("p_size").alias("s"))
    return p.filter("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "xid"), p.filter("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "yid")


def _stage(k: int, keys: str, before: str) -> str:
    out = f"x{k} as (select * from x where xid not in (select xid from ({before}))), y{k} as (select * from y where yid not in (select yid from ({before})))," if before else f"x{k} as (select * from x), y{k} as (select * from y),"
    one = lambda s: f"(select * from (select *, count(*) over (partition by {keys}) c from {s}{k}) where c = 1)"
    return f"{out} s{k} as (select xid, yid, {k} as filter_stage from {one('x')} join {one('y')} using ({keys}))"


@query(f"""with {_SIDES}, {_stage(1, 'n, b, ty, s', '')}, {_stage(2, 'n, b, s', 'select * from s1')}, {_stage(3, 'n, b, ty', 'select * from s1 union all select * from s2')}
  select xid, yid, filter_stage from (select * from s1 union all select * from s2 union all select * from s3)""")
def cascade(t):
    x, y = _sides(t)
    return linkage.cascade(x, y, "xid", "yid", [["n", "b", "ty", "s"], ["n", "b", "s"], ["n", "b", "ty"]])


@query(f"""with {_SIDES}, c as (select xid, min(yid) as yid, 1 as priority from x join y using (n, b, s) group by 1 union all
  select xid, min(yid), 2 from x join y using (n, b, ty) group by 1 union all select xid, min(yid), 3 from x join y using (n, s) group by 1)
  select xid, yid, priority from (select *, row_number() over (partition by xid order by priority, yid) rn from c) where rn = 1""")
def fallback_link(t):
    x, y = _sides(t)
    return linkage.fallback_link(x, y, "xid", "yid", [["n", "b", "s"], ["n", "b", "ty"], ["n", "s"]])


@query("""with g as (select p_name, p_brand, count(distinct p_size) ids from part group by all), a as (
  select p.p_name, p.p_brand, case when g.ids = 1 then p.p_size end as id, p.p_type as d from part p join g on p.p_name is not distinct from g.p_name and p.p_brand is not distinct from g.p_brand)
  select distinct p_name, p_brand, id, case when min(d) over w = max(d) over w then d end as d from a window w as (partition by p_name, p_brand, id)""")
def null_conflicts(t):
    p = t("part").select("p_name", "p_brand", F.col("p_size").alias("id"), F.col("p_type").alias("d"))
    return linkage.null_conflicts(p, ["p_name", "p_brand"], "id", "d")


@query("""select part, count(*) as n from (select case when own is not null and d2 is not null then 'both' when own is not null then 'id' when d2 is not null then 'date' else 'none' end as part from %s) group by part""" % _IDS)
def missingness_parts(t):
    return linkage.missingness_part(_ids(t), "own", "d2").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("""select o.o_orderkey, o.o_custkey, year(o.o_orderdate)::int as year from orders o join (select c_custkey from customer where c_acctbal > 0) c on c.c_custkey = o.o_custkey
  where o.o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')""")
def registry_to_panel(t):
    links = t("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    schools = t("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return linkage.registry_to_panel(links, _registry(t), schools, "o_custkey", "o_orderkey").select("o_orderkey", "o_custkey", "year")


@query("""select p_brand, p_size, count(*) as n from (select p_brand, p_size, count(*) over (partition by p_name, p_brand) c from part) where c > 1 group by all""")
def split_single_multiple(t):
    return linkage.split_single_multiple(t("part"), ["p_name", "p_brand"])[1].groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))


# --- joins ---------------------------------------------------------------


@query("""select c.c_custkey, n.n_name, o.o_orderkey from customer c left join nation n on c.c_nationkey = n.n_nationkey left join (select * from orders where o_orderstatus = 'F') o on o.o_custkey = c.c_custkey""")
def left_joins(t):
    n = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    o = t("orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return joins.keyed_join(joins.keyed_join(t("customer").select("c_custkey", "c_nationkey"), n, how="left"), o, how="left").select("c_custkey", "n_name", "o_orderkey")


@query("""select k, n_orders, total, n_low from (select o_custkey k, count(*) n_orders from orders where o_orderstatus = 'F' group by 1) full join
  (select o_custkey k, round(sum(o_totalprice), 2) total from orders where o_orderstatus = 'O' group by 1) using (k) full join
  (select o_custkey k, count(*) n_low from orders where o_orderpriority = '5-LOW' group by 1) using (k)""")
def full_join_all(t):
    o = t("orders").withColumnRenamed("o_custkey", "k")
    tables = [
        o.filter("o_orderstatus = 'F'").groupBy("k").agg(F.count(F.lit(1)).alias("n_orders")),
        o.filter("o_orderstatus = 'O'").groupBy("k").agg(F.round(F.sum("o_totalprice"), 2).alias("total")),
        o.filter("o_orderpriority = '5-LOW'").groupBy("k").agg(F.count(F.lit(1)).alias("n_low")),
    ]
    return joins.full_join_all(tables, "k")


@query("""with a as (select o_custkey, min(o_orderpriority) p from orders where year(o_orderdate) = 1996 group by 1), b as (select o_custkey, min(o_orderpriority) p, count(*) n from orders where year(o_orderdate) = 1997 group by 1)
  select o_custkey, coalesce(b.p, a.p) as p, n from a full join b using (o_custkey)""")
def coalesce_join(t):
    r = _registry(t)
    a = r.filter("year = 1996").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("p"))
    b = r.filter("year = 1997").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("p"), F.count(F.lit(1)).alias("n"))
    return joins.coalesce_join(a, b, ["o_custkey"], reverse=True)


@query("""select p.p_partkey, coalesce(f.v, c.v) as v from part p left join (select p_name, p_brand, min(p_retailprice) v from part where p_size < 10 group by all) f using (p_name, p_brand)
  left join (select p_name, min(p_retailprice) v from part where p_size < 10 group by all) c on c.p_name = p.p_name""")
def fallback_join(t):
    p = t("part")
    ref = p.filter("p_size < 10").select("p_name", "p_brand", F.col("p_retailprice").alias("v"))
    return joins.fallback_join(p.select("p_partkey", "p_name", "p_brand"), ref, ["p_name", "p_brand"], ["p_name"], "v").select("p_partkey", "v")


@query("select c.c_custkey, count(*) as n from (select c_custkey, right(c_name, 9) k from customer) c join orders o on try_cast(c.k as bigint) = o.o_custkey group by 1")
def cast_join(t):
    c = t("customer").select("c_custkey", F.right("c_name", F.lit(9)).alias("k"))
    return joins.cast_join(c, t("orders").select("o_custkey"), "k", "o_custkey", "bigint").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 40)")
def anti_membership(t):
    keys = t("lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.membership(t("orders").select("o_orderkey"), keys, ["o_orderkey"], inside=False)


@query("""select x.c_custkey, y.year, y.n from (select o_custkey c_custkey, min(year(o_orderdate)) a, max(year(o_orderdate)) b from orders group by 1) x
  join (select year(o_orderdate)::int as year, count(*) n from orders group by 1) y on y.year between x.a and x.b""")
def explode_years(t):
    r = _registry(t)
    spans = r.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("year").alias("a"), F.max("year").alias("b"))
    return joins.interval_join(spans, r.groupBy("year").agg(F.count(F.lit(1)).alias("n")), "a", "b", "year").select("c_custkey", "year", "n")


@query("select p_name, count(*) as rows, count(distinct p_brand) as keys from part group by 1")
def two_aggregates(t):
    return joins.two_aggregates(t("part"), ["p_brand"], ["p_name"])


@query("""select o_orderkey, label from (select o_orderkey, case when year(o_orderdate) between 1990 and 1996 and o_totalprice < 200000 then 'early small'
  when year(o_orderdate) between 1990 and 2010 and o_totalprice between 100000 and 300000 then 'middle' when year(o_orderdate) >= 1997 and o_totalprice > 250000 then 'late large' end as label from orders where o_orderstatus = 'F') where label is not null""")
def rule_recode(t):
    r = _registry(t).withColumn("cents", F.col("o_totalprice"))
    rules = t("region").limit(1).select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("year_lo"), F.lit(b).alias("year_hi"), F.lit("F").alias("form"), F.lit(float(c)).alias("code_lo"), F.lit(float(d)).alias("code_hi"), F.lit(k).alias("priority"), F.lit(x).alias("label"))
        for k, (a, b, c, d, x) in enumerate([(1990, 1996, 0, 199999.999999, "early small"), (1990, 2010, 100000, 300000, "middle"), (1997, 9999, 250000.0000001, 1e12, "late large")])
    ])))
    return recode.rule_recode(r, rules, "year", "o_orderstatus", "cents").select("o_orderkey", "label")


# --- aggregates ----------------------------------------------------------

_MODES = "(select o_custkey, o_orderpriority v, count(*) n, min(o_orderkey) seen from orders group by all)"


def _mode_sql(order: str) -> str:
    return f"select o_custkey, v as o_orderpriority from (select *, rank() over (partition by o_custkey order by n desc{order}) r from {_MODES}) where r = 1"


@query(_mode_sql(", v"))
def mode_min(t):
    return aggs.mode(t("orders"), ["o_custkey"], "o_orderpriority", "min")


@query(_mode_sql(", v desc"))
def mode_max(t):
    return aggs.mode(t("orders"), ["o_custkey"], "o_orderpriority", "max")


@query(_mode_sql(", seen, v"))
def mode_first(t):
    return aggs.mode(t("orders"), ["o_custkey"], "o_orderpriority", "first", "o_orderkey")


@query(_mode_sql(", seen desc, v desc"))
def mode_last(t):
    return aggs.mode(t("orders"), ["o_custkey"], "o_orderpriority", "last", "o_orderkey")


@query(_mode_sql(""))
def mode_all(t):
    return aggs.mode(t("orders"), ["o_custkey"], "o_orderpriority", "all")


@query("select o_custkey, arg_max(o_orderpriority, (year(o_orderdate), o_orderpriority)) as o_orderpriority from orders where o_orderpriority is not null group by 1")
def reduce_vintages(t):
    return aggs.reduce_vintages(_registry(t), ["o_custkey"], "o_orderpriority", "year", "latest")


@query("select o_custkey, case when count(distinct o_orderstatus) = 1 then max(o_orderstatus) end as one from orders group by 1")
def single_or_null(t):
    return t("orders").groupBy("o_custkey").agg(aggs.single_or_null(F.col("o_orderstatus")).alias("one"))


@query("""select l_returnflag, count(*) as n, round(sum(l_quantity), 4) as sum, round(avg(l_quantity), 8) as mean, round(stddev_samp(l_quantity), 8) as sd, min(l_quantity) as min, max(l_quantity) as max from lineitem group by 1""")
def summary(t):
    s = aggs.summary(t("lineitem"), ["l_returnflag"], "l_quantity")
    return s.withColumns({"sum": F.round("sum", 4), "mean": F.round("mean", 8), "sd": F.round("sd", 8)})


@query("select size, count(*) as groups from (select count(*) as size from orders group by o_custkey) group by 1")
def count_of_counts(t):
    return aggs.count_of_counts(t("orders"), ["o_custkey"])


@query("select o_custkey, count(*) as n from orders group by 1 having count(*) >= 15")
def having(t):
    return aggs.having(t("orders"), ["o_custkey"], 15)


_Q = "quantile_cont(l_extendedprice, {0})"


@query(f"""select l_returnflag, min(l_extendedprice) as min, round({_Q.format(0.25)}, 6) as q1, round({_Q.format(0.5)}, 6) as median, round(avg(l_extendedprice), 6) as mean, round({_Q.format(0.75)}, 6) as q3, max(l_extendedprice) as max from lineitem group by 1""")
def six_number(t):
    out = aggs.six_number(t("lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.withColumns({c: F.round(c, 6) for c in ("q1", "median", "mean", "q3")})


@query(f"""with s as (select l_returnflag f, {_Q.format(0.25)} q1, {_Q.format(0.5)} median, {_Q.format(0.75)} q3 from lineitem group by 1),
  x as (select l.l_returnflag, s.*, l_extendedprice v, l_extendedprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside from lineitem l join s on s.f = l.l_returnflag)
  select l_returnflag, round(any_value(q1), 6) as q1, round(any_value(median), 6) as median, round(any_value(q3), 6) as q3, min(v) filter (inside) as whisker_low, max(v) filter (inside) as whisker_high, count(*) filter (not inside) as outliers, count(*) as n,
    round(any_value(median) - 1.58 * (any_value(q3) - any_value(q1)) / sqrt(count(*)), 6) as notch_low, round(any_value(median) + 1.58 * (any_value(q3) - any_value(q1)) / sqrt(count(*)), 6) as notch_high from x group by 1""")
def boxplot(t):
    out = aggs.boxplot(t("lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3", "notch_low", "notch_high")})


@query("""select bin, n, round(n / sum(n) over (), 10) as share from (select least(floor(l_quantity / 5)::bigint + 1, 10) as bin, count(*) as n from lineitem where l_quantity between 0 and 50 group by 1)""")
def histogram(t):
    return aggs.histogram(t("lineitem"), "l_quantity", 0, 50, 10).withColumn("share", F.round("share", 10))


@query("""select l_returnflag, l_quantity, round(sum(n) over (partition by l_returnflag order by l_quantity) / sum(n) over (partition by l_returnflag), 10) as share from (select l_returnflag, l_quantity, count(*) n from lineitem group by all)""")
def ecdf(t):
    return aggs.ecdf(t("lineitem"), ["l_returnflag"], "l_quantity").withColumn("share", F.round("share", 10))


@query("""with c as (select quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as q from orders)
  select o_orderkey, (1 + len(list_filter(q, lambda x: x < o_totalprice)))::int as "group" from orders, c""")
def xtile(t):
    return aggs.percentile_groups(t("orders"), "o_totalprice", 10).select("o_orderkey", "group")


@query("""with b as (select l_returnflag, least(floor(l_quantity / (50.0 / 512)), 511) k, count(*) n from lineitem where l_quantity between 0 and 50 group by all), g as (select i, i * 50.0 / 10 as x from range(11) r(i))
  select l_returnflag, x::double as x, round(sum(n * exp(-(((x - (k + 0.5) * 50.0 / 512) / 3.0) ^ 2) / 2)) / (sum(n) * 3.0 * 2.5066282746310002), 9) as density from b cross join g group by all""")
def kernel_density(t):
    return aggs.density(t("lineitem"), ["l_returnflag"], "l_quantity", 0.0, 50.0, 11, 3.0).withColumn("density", F.round("density", 9))


@query("""select l_returnflag, round(avg(m), 8) as mean, count(*) as groups from (select l_returnflag, l_suppkey, avg(l_quantity) m from lineitem group by all) group by 1""")
def nested_mean(t):
    return aggs.nested_mean(t("lineitem"), ["l_suppkey"], ["l_returnflag"], "l_quantity").withColumn("mean", F.round("mean", 8))


@query("select o_custkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) as o_orderstatus from orders group by 1")
def first_by(t):
    return aggs.first_by(t("orders"), ["o_custkey"], "o_orderstatus", ["o_orderdate", "o_orderkey"])


# --- windows and reshaping ----------------------------------------------


@query("""select o_orderkey, coalesce(last_value(p ignore nulls) over (w rows between unbounded preceding and current row), first_value(p ignore nulls) over (w rows between current row and unbounded following)) as p
  from (select o_orderkey, o_custkey, o_orderdate, case when o_orderkey % 3 = 0 then o_orderpriority end p from orders) window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")
def fill_downup(t):
    o = t("orders").withColumn("p", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")))
    return windows.fill(o, ["p"], ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "downup").select("o_orderkey", "p")


@query("""select o_orderkey, lag(o_totalprice) over w as o_totalprice_lag1, lag(o_totalprice, 2) over w as o_totalprice_lag2 from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")
def lags(t):
    return windows.lags(t("orders"), ["o_totalprice"], ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], (1, 2)).select("o_orderkey", "o_totalprice_lag1", "o_totalprice_lag2")


@query("""select o_custkey, coalesce(sum(c), 0)::bigint as changes from (select o_custkey, (o_orderstatus <> lag(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey))::int c from orders) group by 1""")
def value_changes(t):
    return windows.changes(t("orders"), ["o_custkey"], "o_orderstatus", [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "changes").distinct()


@query("select p_partkey, dense_rank() over (order by p_name, p_brand) as group_id from part")
def dense_group_id(t):
    return windows.with_group_id(t("part").select("p_partkey", "p_name", "p_brand"), ["p_name", "p_brand"]).select("p_partkey", "group_id")


@query("select c_custkey, row_number() over (order by c_name, c_custkey) as row_id from customer")
def surrogate_key(t):
    return windows.surrogate_key(t("customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"]).select("c_custkey", "row_id")


@query("select o_orderkey from (select *, min(o_totalprice) over (partition by o_custkey) m from orders) where o_totalprice = m and o_orderstatus <> 'P'")
def extreme_rows(t):
    return windows.extreme_rows(t("orders"), ["o_custkey"], "o_totalprice", also=F.col("o_orderstatus") != "P").select("o_orderkey")


@query("""select o_custkey, sum(case when rn = 1 then o_totalprice else 0 end) as first_total from (select *, row_number() over (partition by o_custkey, o_orderstatus order by o_orderdate, o_orderkey) rn from orders) group by 1""")
def once_per_group(t):
    o = windows.once_per_group(t("orders"), "o_totalprice", ["o_custkey", "o_orderstatus"], [F.col("o_orderdate"), F.col("o_orderkey")], "v")
    return o.groupBy("o_custkey").agg(F.sum("v").alias("first_total"))


@query("select o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) rn from orders) where rn = 1 or o_totalprice between 100000 and 120000")
def first_or_range(t):
    return windows.first_or(t("orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], F.col("o_totalprice").between(100000, 120000)).select("o_orderkey")


@query("select o_custkey, n, row_number() over (partition by n order by o_custkey) as place from (select o_custkey, count(*) n from orders group by 1)")
def number_by_count(t):
    return windows.number_by_count(t("orders"), ["o_custkey"]).withColumn("place", F.col("place").cast("long"))


@query("select o_orderkey, name, value from (unpivot (select o_orderkey, o_orderstatus, o_orderpriority from orders) on o_orderstatus, o_orderpriority into name name value value)")
def wide_long(t):
    return reshape.longer(t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderkey"], "^o_order")


@query("""select o_custkey, coalesce(sum(o_totalprice) filter (o_orderstatus = 'F'), 0) as s_F, coalesce(sum(o_totalprice) filter (o_orderstatus = 'O'), 0) as s_O, coalesce(sum(o_totalprice) filter (o_orderstatus = 'P'), 0) as s_P from orders group by 1""")
def pivot_sum(t):
    return reshape.wider(t("orders"), ["o_custkey"], "o_orderstatus", "o_totalprice", ["F", "O", "P"], "sum", fill=0.0, prefix="s_")


@query(f"select user_id, day, coalesce(n, 0) as n from (select distinct user_id from events) cross join (select distinct day from {_PANEL}) left join {_PANEL} using (user_id, day)")
def complete_grid(t):
    return reshape.complete(_panel(t).select("user_id", "day", "n"), "user_id", "day", {"n": 0})


@query("select p_partkey, string_split(p_name, ' ')[1] as first, string_split(p_name, ' ')[2] as second from part")
def split_names(t):
    return reshape.split_column(t("part"), "p_name", ["first", "second"], " ").select("p_partkey", "first", "second")


@query("select c_nationkey as k, 'c' as src from customer union select s_nationkey, 's' from supplier")
def set_union(t):
    return reshape.set_union(t("customer").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("src")), t("supplier").select(F.col("s_nationkey").alias("k"), F.lit("s").alias("src")))


# --- scalars and recoding ------------------------------------------------


@query("""select o_orderkey, case when o_totalprice >= 0 and o_totalprice < 100000 then 1 when o_totalprice >= 100000 and o_totalprice < 300000 then 2 when o_totalprice >= 300000 and o_totalprice <= 600000 then 3 end::int as bin from orders""")
def cohort_bins(t):
    return t("orders").select("o_orderkey", recode.bin_values(F.col("o_totalprice"), [0, 100000, 300000, 600000], include_lowest=True).alias("bin"))


@query("select o_orderkey, case o_orderpriority when '1-URGENT' then 'urgent' when '2-HIGH' then 'high' when '5-LOW' then 'low' else o_orderpriority end as p from orders")
def translate_values(t):
    return t("orders").select("o_orderkey", recode.translate_values(F.col("o_orderpriority"), [("1-URGENT", "urgent"), ("2-HIGH", "high"), ("5-LOW", "low")]).alias("p"))


@query("""with a as (select o_orderkey, case o_orderkey % 6 when 0 then 'nunca' when 1 then 'a veces' when 2 then 'muchas veces' when 3 then 'siempre' when 4 then 'otra cosa' end as answer from orders)
  select o_orderkey, case when answer = 'nunca' then 0 when answer = 'a veces' then 1 when answer = 'muchas veces' then 2 when answer = 'siempre' then 3 end::int as answer from a""")
def ordinal_scale(t):
    k = F.col("o_orderkey") % 6
    a = t("orders").select("o_orderkey", F.when(k == 0, "nunca").when(k == 1, "a veces").when(k == 2, "muchas veces").when(k == 3, "siempre").when(k == 4, "otra cosa").alias("answer"))
    return recode.orderize(a, "^answer$", "time")


@query("select o_orderkey, (year(o_orderdate) + case when month(o_orderdate) <= 3 then 5 else 6 end)::int as entry, year((o_orderdate + interval 6 month))::int as nearest from orders")
def entry_cohort(t):
    d = F.col("o_orderdate").cast("date")
    return t("orders").select("o_orderkey", scalars.entry_cohort(d).alias("entry"), scalars.nearest_year(d).alias("nearest"))


@query()
def clean_text(t):
    return t("documents").select("doc_id", scalars.clean_text(F.col("text")).alias("text"))


@query("select c_custkey, left(lpad(c_custkey::varchar, 10, '0'), 6) as area, right(lpad(c_custkey::varchar, 10, '0'), 4) as local from customer")
def place_codes(t):
    return t("customer").select("c_custkey", scalars.area_code(F.col("c_custkey")).alias("area"), scalars.local_code(F.col("c_custkey")).alias("local"))


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem where coalesce(not (l_quantity > 25), true) group by all")
def delete_where(t):
    return recode.delete_where(t("lineitem"), F.col("l_quantity") > 25).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("select p.p_partkey, coalesce(u.p_brand, p.p_brand) as p_brand from part p left join (select p_partkey, 'patched' as p_brand from part where p_size = 1) u using (p_partkey)")
def patch_rows(t):
    p = t("part").select("p_partkey", "p_brand")
    return recode.patch_rows(p, t("part").filter("p_size = 1").select("p_partkey", F.lit("patched").alias("p_brand")), "p_partkey")


@query(f"select o_orderkey, (case when a = b then a when a is null then b when b is null then a else 6 end) as picked from {_IDS}")
def conflict_pick(t):
    return _ids(t).select("o_orderkey", recode.conflict_pick(F.col("a"), F.col("b")).alias("picked"))


# --- fuzzy work, graphs, space -------------------------------------------


@query("""with n as (select distinct c_nationkey, c_mktsegment, c_name as s from customer)
  select c_nationkey, c_mktsegment, a.s as left_text, b.s as right_text, levenshtein(a.s, b.s)::int as distance from n a join n b using (c_nationkey, c_mktsegment) where levenshtein(a.s, b.s) <= 2""")
def fuzzy_join_d2(t):
    """All customers against all others of their nation and segment."""
    c = t("customer").select("c_nationkey", "c_mktsegment", "c_name")
    return fuzzy.fuzzy_pairs(c, c, "c_name", "c_name", 2, block=["c_nationkey", "c_mktsegment"])


@query()
def fuzzy_names_d2(t):
    """All distinct names against each other."""
    p = t("part").select("p_name")
    return fuzzy.fuzzy_pairs(p, p, "p_name", "p_name", 2)


@query()
def string_clusters(t):
    return fuzzy.cluster_strings(t("part").select("p_partkey", "p_name"), "p_name", 2, "p_partkey")


@query()
def merge_groupings(t):
    rows = t("lineitem").select("l_orderkey", F.when(F.col("l_linenumber") <= 2, F.col("l_partkey")).alias("p")).distinct()
    return graph.merge_groupings(rows, "l_orderkey", "p")


@query()
def footprint(t):
    e = t("embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return space.footprint(e, "label", "x", "y", 0.5)


@query("""select user_id, day, case when coalesce(w, 0) <= 12 then coalesce(day_id, 0) else case when coalesce(n, 0) <= 12 then coalesce(user_id, 0) else 0 end end as scale_id, case when coalesce(w, 0) <= 12 then 'wide' when coalesce(n, 0) <= 12 then 'near' end as scale from (
  select user_id, day, n::double as n, (n + day)::double as w, day::bigint as day_id from %s)""" % _PANEL)
def select_scale(t):
    p = _panel(t).select("user_id", "day", F.col("n").cast("double").alias("n"), (F.col("n") + F.col("day")).cast("double").alias("w"), F.col("day").cast("long").alias("day_id"))
    return space.select_scale(p, [("near", "user_id", "n"), ("wide", "day_id", "w")], 12.0).select("user_id", "day", "scale_id", "scale")


@query("select p_partkey, members from (select p_partkey, count(*) over (partition by p_brand, p_name) members from part where p_brand is not null and p_name is not null) where members > 1")
def same_name_groups(t):
    return space.same_name_groups(t("part").select("p_partkey", "p_brand", "p_name"), "p_brand", "p_name").select("p_partkey", "members")


# --- panels --------------------------------------------------------------


@query("""with r as (select o_custkey % 50 as cluster, o_orderkey as site, o_orderstatus as level, unnest(range(year(o_orderdate), least(year(o_orderdate) + o_orderkey % 3, 2002) + 1))::int as year from orders where o_orderkey % 3 = 0 or year(o_orderdate) <= 2002),
  w as (select cluster, year, count(*) filter (level = 'F') as section_F, count(*) filter (level = 'O') as section_O from r group by all)
  select c.cluster, y.year, coalesce(section_F, 0) as section_F, coalesce(section_O, 0) as section_O from (select distinct cluster from w) c cross join (select distinct year from w) y left join w using (cluster, year)""")
def supply_panel(t):
    y = F.year("o_orderdate")
    sites = t("orders").select((F.col("o_custkey") % 50).alias("cluster"), F.col("o_orderkey").alias("site"), F.col("o_orderstatus").alias("level"), y.alias("opens"), F.least(y + (F.col("o_orderkey") % 3).cast("int"), F.lit(2002)).alias("closes"))
    return panel.supply_panel(sites, "cluster", "site", "level", "year", "opens", "closes", ["F", "O"])


_LAGS = ", ".join(f"lag(n, {k}) over w > 0 as l{k}" for k in (1, 2, 3))


@query(f"""with x as (select user_id, day, n, treated, lag(treated) over w as tl, n > 0 as l0, {_LAGS} from {_PANEL} window w as (partition by user_id order by day))
  select user_id, day, treated = 1 and tl = 0 as opened, treated = tl + 1 as opened_one, treated > tl as opened_any,
  {", ".join(f"l{k} and ({c}) as {n}_with_{k}" for n, c in (("opened", "treated = 1 and tl = 0"), ("opened_one", "treated = tl + 1"), ("opened_any", "treated > tl")) for k in range(4))} from x""")
def rollout_flags(t):
    return panel.rollout_flags(_panel(t), "user_id", "day", "treated", "n").drop("n", "y", "treated")


@query(f"select user_id, day, (m > 0 and m < 1) as switcher from (select *, avg(treated) over (partition by user_id) m from {_PANEL})")
def switchers(t):
    return panel.switchers(_panel(t), "user_id", "treated").select("user_id", "day", "switcher")


@query(f"""with a as (select *, (treated <> lag(treated) over (partition by user_id order by day))::int ch, first_value(treated) over (partition by user_id order by day) f, avg(treated) over (partition by user_id) m from {_PANEL})
  select user_id, day, coalesce(m > 0 and m < 1 and coalesce(sum(ch) over (partition by user_id), 0) <= 1 and f = 0, false) as monotone from a""")
def monotone_switchers(t):
    return panel.monotone_switchers(_panel(t), "user_id", "treated", [F.col("day")]).select("user_id", "day", "monotone")


@query(f"select user_id, day, f as first_treated from (select *, min(case when treated = 1 then day end) over (partition by user_id) f from {_PANEL}) where treated = 1 or f is null or day < f")
def first_treated(t):
    return panel.first_treated(_panel(t), "user_id", "day", "treated").select("user_id", "day", "first_treated")


@query("""with m as (select user_id, day, event_type from (select *, rank() over (partition by user_id, day order by n desc) r from (select user_id, date_diff('day', date '2024-01-01', ts::date)::int as day, event_type, count(*) n from events where event_type <> 'error' group by all)) where r = 1),
  s as (select distinct user_id, date_diff('day', date '2024-01-01', ts::date)::int as day from events)
  select user_id, day, coalesce(last_value(event_type ignore nulls) over (w rows between unbounded preceding and current row), first_value(event_type ignore nulls) over (w rows between current row and unbounded following)) as event_type
  from s left join m using (user_id, day) window w as (partition by user_id order by day, event_type nulls first)""")
def location_history(t):
    e = t("events").select("user_id", F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("day"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"))
    return panel.location_history(e, "user_id", "day", "event_type")


@query(f"""select user_id, day, lo <> hi as mixed from (select user_id, day, count(*) over (partition by user_id % 20) h, count(*) over (partition by user_id % 20, user_id) p, min(treated) over (partition by user_id % 20) lo, max(treated) over (partition by user_id % 20) hi from {_PANEL}) where h > p""")
def sibling_sample(t):
    return panel.sibling_sample(_panel(t).withColumn("hh", F.col("user_id") % 20), "hh", "user_id", "treated").select("user_id", "day", "mixed")


@query(f"""select day, variable, round(avg(value) filter (treated = 0), 8) as mean_0, round(avg(value) filter (treated = 1), 8) as mean_1, round(stddev_samp(value) filter (treated = 0), 8) as sd_0, round(stddev_samp(value) filter (treated = 1), 8) as sd_1
  from (unpivot (select day, treated, n::double as n, y from {_PANEL}) on n, y into name variable value value) group by all""")
def cohort_profile(t):
    p = _panel(t).withColumn("n", F.col("n").cast("double"))
    out = panel.cohort_profile(p, ["day"], "treated", ["n", "y"])
    return out.withColumns({c: F.round(c, 8) for c in ("mean_0", "mean_1", "sd_0", "sd_1")})


@query("select o_custkey, count(distinct o_orderstatus) as answers from orders group by 1 having count(distinct o_orderstatus) > 1")
def treatment_conflicts(t):
    return panel.treatment_conflicts(t("orders"), "o_custkey", "o_orderstatus")


@query("select year(o_orderdate)::int as year, count(o_totalprice) as n, round(avg(o_totalprice), 6) as mean, round(stddev_samp(o_totalprice), 6) as sd, round(sum(o_totalprice * (o_orderkey % 10)) / sum(o_orderkey % 10), 6) as weighted_mean from orders group by 1")
def yearly_exam_summary(t):
    out = panel.yearly_exam_summary(_registry(t).withColumn("w", F.col("o_orderkey") % 10), "year", "o_totalprice", "w")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "sd", "weighted_mean")})


# --- estimation ----------------------------------------------------------


@query("""with x as (select (l_returnflag = 'R')::int as tr, unnest([{'variable': 'l_quantity', 'v': l_quantity}, {'variable': 'l_discount', 'v': l_discount}], recursive := true) from lineitem),
  s as (select variable, count(v) filter (tr = 0) n_0, avg(v) filter (tr = 0) mean_0, stddev_samp(v) filter (tr = 0) sd_0, count(v) filter (tr = 1) n_1, avg(v) filter (tr = 1) mean_1, stddev_samp(v) filter (tr = 1) sd_1 from x group by 1)
  select variable, n_0, round(mean_0, 8) as mean_0, round(sd_0, 8) as sd_0, n_1, round(mean_1, 8) as mean_1, round(sd_1, 8) as sd_1, round((mean_1 - mean_0) / sqrt(sd_0 * sd_0 / n_0 + sd_1 * sd_1 / n_1), 6) as t, round((mean_1 - mean_0) / sqrt((sd_0 * sd_0 + sd_1 * sd_1) / 2), 8) as std_diff from s""")
def balance_table(t):
    out = estimate.balance_table(t("lineitem").withColumn("tr", (F.col("l_returnflag") == "R").cast("int")), "tr", ["l_quantity", "l_discount"]).drop("p")
    return out.withColumns({c: F.round(c, 8) for c in ("mean_0", "sd_0", "mean_1", "sd_1", "std_diff")}).withColumn("t", F.round("t", 6))


@query("""with d as (select l_suppkey, l_quantity - avg(l_quantity) over (partition by l_suppkey) as x, l_extendedprice - avg(l_extendedprice) over (partition by l_suppkey) as y from lineitem),
  b as (select sum(x * y) / sum(x * x) as beta, sum(x * x) as xx, count(*) as n from d), c as (select l_suppkey, sum(x * (y - beta * x)) as s from d, b group by 1)
  select 'l_quantity' as term, round(any_value(beta), 4) as estimate, round(sqrt(sum(s * s) * count(*) / (count(*) - 1) * (any_value(n) - 1) / (any_value(n) - 1)) / any_value(xx), 4) as se, any_value(n) as n from c, b""")
def fe_regression_1(t):
    out = estimate.fe_regression(t("lineitem"), "l_extendedprice", ["l_quantity"], ["l_suppkey"], cluster=["l_suppkey"])
    return out.select("term", F.round("estimate", 4).alias("estimate"), F.round("se", 4).alias("se"), "n")


@query()
def fe_regression_2(t):
    rows = t("lineitem").withColumn("part20", F.col("l_partkey") % 20)
    out = estimate.fe_regression(rows, "l_extendedprice", ["l_quantity", "l_discount"], ["l_suppkey", "part20"], cluster=["l_suppkey", "part20"])
    return out.select("term", F.round("estimate", 4).alias("estimate"), F.round("se", 4).alias("se"), "n")


@query(f"""with p as (select user_id, day // 3 as t, avg(y) as y, max(treated) as tr from {_PANEL} where user_id % 4 <> 0 group by all union all select user_id, day // 3, avg(y), 0 from {_PANEL} where user_id % 4 = 0 group by all),
  g as (select *, min(case when tr = 1 then t end) over (partition by user_id) g from p), c as (select distinct g as cohort from g where g is not null),
  x as (select user_id, t, y, g, g as cohort from g where g is not null union all select user_id, t, y, g, cohort from g, c where g is null),
  d as (select x.cohort, x.t, x.g, x.y - b.y as d from x join g b on b.user_id = x.user_id and b.t = x.cohort - 1 where x.t <> x.cohort - 1)
  select cohort::bigint as g, t::bigint as t, round(avg(d) filter (g is not null) - avg(d) filter (g is null), 8) as att, count(*) filter (g is not null) as treated, count(*) filter (g is null) as controls from d group by cohort, t having count(*) filter (g is not null) > 0 and count(*) filter (g is null) > 0""")
def att_gt(t):
    p = _panel(t).withColumn("t", F.floor(F.col("day") / 3)).withColumn("treated", F.when(F.col("user_id") % 4 == 0, 0).otherwise(F.col("treated")))
    p = p.groupBy("user_id", "t").agg(F.avg("y").alias("y"), F.max("treated").alias("tr"))
    p = windows.spread(p, ["user_id"], {"g": F.min(F.when(F.col("tr") == 1, F.col("t")))})
    return estimate.att_gt(p, "user_id", "t", "y", "g").withColumn("att", F.round("att", 8))


@query()
def imputation_effect(t):
    out = estimate.imputation_effect(_panel(t), "user_id", "day", "y", "treated")
    return out.select(F.round("effect", 6).alias("effect"), "n")


@query()
def propensity_weights(t):
    rows = panel.switchers(_panel(t), "user_id", "treated", "sw").withColumns({"sw": F.col("sw").cast("int"), "n2": F.col("n") * F.col("day")})
    return estimate.propensity_weights(rows, "treated", "sw", ["n", "n2"], "user_id", 0.01).select("user_id", "day", F.round("weight", 4).alias("weight"))


@query()
def component_index(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    return indices.component_index(rows, ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("index", F.round("index", 6))


@query()
def chained_imputation(t):
    rows = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("price"), F.month("o_orderdate").cast("double").alias("month"))
    done = indices.chained_imputation(rows, "o_orderkey", ["price", "month"], 2, 2, posterior=False)
    return indices.pool_scores(done, "o_orderkey", "price").withColumn("price", F.round("price", 4))


# --- checks --------------------------------------------------------------


@query("""select count(*) as rows, count(distinct (o_custkey, o_orderdate)) as keys, count(*) filter (o_orderstatus is null) as null_o_orderstatus, count(*) filter (o_totalprice is null) as null_o_totalprice,
  count(*) filter (o_orderstatus is null and o_totalprice is null) as null_o_orderstatus_o_totalprice from orders""")
def profile(t):
    return checks.profile(t("orders"), ["o_custkey", "o_orderdate"], ["o_orderstatus", "o_totalprice"])


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1 or l_orderkey is null or l_linenumber is null")
def assert_keys(t):
    return checks.duplicate_keys(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query("select o_orderkey, o_custkey from orders where o_custkey is not null and o_custkey not in (select c_custkey from customer where c_acctbal > 0)")
def orphans(t):
    return checks.orphans(t("orders").select("o_orderkey", "o_custkey"), t("customer").filter("c_acctbal > 0"), ["o_custkey"], ["c_custkey"])


@query("""select o_orderpriority, count(*) as rows, count(*) filter (o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')) as linked from orders group by 1""")
def linkability(t):
    right = t("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return checks.linkability(t("orders"), right, ["o_custkey"], "o_orderpriority")


@query("select p_name, p_brand, count(distinct p_size) as identities from part group by all having count(distinct p_size) > 1")
def identity_uniqueness(t):
    return checks.identity_uniqueness(t("part"), ["p_name", "p_brand"], "p_size")


@query("""with a as (select distinct o_custkey k from orders where o_custkey is not null), b as (select distinct c_custkey k from customer where c_mktsegment = 'BUILDING')
  select (select count(*) from a where k in (select k from b)) as both, (select count(*) from a where k not in (select k from b)) as only_a, (select count(*) from b where k not in (select k from a)) as only_b""")
def coverage(t):
    return checks.coverage(t("orders").select(F.col("o_custkey").alias("k")), t("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k")), "k")


# --- more of the inventory ----------------------------------------------


@query("""select o_orderkey, case when o_orderpriority ~ '^[12]' then true when o_orderpriority ~ 'LOW$' then false end as urgent from orders""")
def dummify(t):
    return recode.dummify(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "urgent", "^[12]", "LOW$", drop=True)


@query("select p_partkey, coalesce(p_name ~ 'ring', false) as p_name, coalesce(p_type ~ 'ECON', false) as p_type from part")
def binarize(t):
    return recode.binarize(t("part").select("p_partkey", "p_name", "p_type"), "^p_(name|type)$", "ring|ECON", else_false=True).select("p_partkey", "p_name", "p_type")


SQL["binarize"] = "select p_partkey, p_name ~ 'ring|ECON' as p_name, p_type ~ 'ring|ECON' as p_type from part"


@query("""select l_orderkey, l_linenumber, l_partkey, round(coalesce(q, 0) + coalesce(l_discount, 0) + coalesce(l_tax, 0), 8) as total, greatest(q, l_discount, l_tax) as most,
  round((coalesce(q, 0) + coalesce(l_discount, 0) + coalesce(l_tax, 0)) / ((q is not null)::int + 2), 8) as mean from (select *, case when l_linenumber > 1 then l_quantity end q from lineitem)""")
def row_reduce(t):
    x = t("lineitem").withColumn("q", F.when(F.col("l_linenumber") > 1, F.col("l_quantity")))
    names = ["q", "l_discount", "l_tax"]
    return x.select("l_orderkey", "l_linenumber", "l_partkey", F.round(recode.row_reduce(names, "sum"), 8).alias("total"), recode.row_reduce(names, "max").alias("most"), F.round(recode.row_reduce(names, "mean"), 8).alias("mean"))


@query("select p_partkey, p_brand || '.' || p_type as cell, case p_type when 'STANDARD' then 1 when 'PROMO' then 2 else 3 end as place from part")
def combine_levels(t):
    return t("part").select("p_partkey", recode.combine_levels("p_brand", "p_type").alias("cell"), recode.relevel(F.col("p_type"), ["STANDARD", "PROMO"]).cast("int").alias("place"))


@query("select o_orderkey, case when o_orderstatus = 'P' then 0.0 else o_totalprice end as o_totalprice from orders")
def update_where(t):
    return recode.update_where(t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), F.col("o_orderstatus") == "P", {"o_totalprice": 0.0}).drop("o_orderstatus")


@query(f"select o_orderkey, case when own is null and a is null then null else coalesce(own % 2 = 0, false) or coalesce(a % 2 = 0, false) end as flag, ((own + a) > 0)::int as positive from {_IDS}")
def merge_flags(t):
    x = _ids(t)
    return x.select("o_orderkey", recode.merge_flags(F.col("own") % 2 == 0, F.col("a") % 2 == 0).alias("flag"), recode.any_positive("own", "a").alias("positive"))


@query("""select o_orderkey, least(make_date(year(o_orderdate), least(greatest(m, 1), 12), 1) + (least(greatest(d, 1), 31) - 1)::int, last_day(make_date(year(o_orderdate), least(greatest(m, 1), 12), 1))) as d
  from (select *, (o_orderkey % 14)::int m, (o_orderkey % 33)::int d from orders) where year(o_orderdate) <= 2013""")
def date_from_parts(t):
    k = F.col("o_orderkey")
    return t("orders").filter(F.year("o_orderdate") <= 2013).select("o_orderkey", scalars.date_from_parts(F.year("o_orderdate"), (k % 14).cast("int"), (k % 33).cast("int")).alias("d"))


@query("select o_orderkey, (year(o_orderdate) - o_orderkey % 7 - case when o_orderkey % 12 > 6 then 1 else 0 end)::int as opened, round((least(0.5 * (o_orderkey % 2), 8.0 / 24) * 86400 + (o_orderkey % 5) * 3600), 6)::double as seconds from orders")
def travel_and_opening(t):
    k = F.col("o_orderkey")
    return t("orders").select(
        "o_orderkey", scalars.opening_year(F.year("o_orderdate"), k % 7, k % 12).cast("int").alias("opened"),
        F.round(scalars.travel_seconds(0.5 * (k % 2), (k % 5).cast("double"), F.lit(0.0)), 6).alias("seconds"),
    )


@query("""select p_partkey, damerau_levenshtein(p_name, lower(p_type))::int as by_type, damerau_levenshtein(p_name, lower(p_brand))::int as by_brand from part""")
def edit_distances(t):
    by = lambda c: fuzzy.damerau_levenshtein(F.col("p_name"), F.lower(c))
    return t("part").select("p_partkey", by("p_type").alias("by_type"), by("p_brand").alias("by_brand"))


@query("""select c.c_custkey, y.s_suppkey, levenshtein(c.c_name, replace(y.s_name, 'Supplier', 'Customer'))::int as distance from customer c left join supplier y on levenshtein(c.c_name, replace(y.s_name, 'Supplier', 'Customer')) <= 1 and y.s_nationkey = c.c_nationkey""")
def fuzzy_left_join(t):
    x = t("customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_name").alias("s"))
    y = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("s"))
    return fuzzy.fuzzy_left_join(x, y, "s", 1, block=["nation"]).select("c_custkey", "s_suppkey", "distance")


@query()
def substring_distance(t):
    return t("part").select("p_partkey", fuzzy.substring_distance(F.lit("rimg"), F.col("p_name"), 2).alias("distance"))


@query()
def name_key(t):
    return t("part").select("p_partkey", scalars.name_key(F.col("p_name"), F.col("p_brand")).alias("key"))


@query()
def resolve_places(t):
    place = lambda k: (F.col(k) % 7 + 1) * 100_000_000 + F.col(k)
    x = t("part").select("p_partkey", place("p_partkey").alias("place"), F.concat("p_name", F.lit("s")).alias("name"))
    ref = t("part").select(F.col("p_partkey").alias("ref_id"), place("p_partkey").alias("place"), F.col("p_name").alias("name"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return space.resolve_places(x, ref, "p_partkey", "place", "name", "ref_id", "x", "y", steps=((1, 4), (2, 2)))


@query()
def merge_with_names(t):
    rows = t("supplier").select("s_suppkey", (F.col("s_suppkey") % 30).alias("cluster"), F.when(F.col("s_nationkey") < 5, F.col("s_nationkey")).alias("names"), (F.col("s_suppkey") % 9 == 0).alias("noise"))
    return graph.merge_with_names(rows, "s_suppkey", "cluster", "names", "noise")


@query("""select c_nationkey, sum(case when rn = 1 then c_acctbal else 0 end) as total, round(avg(half), 6) as half, bool_or(c_acctbal > 9000) as rich, count(*) as members, any_value(m.seg) as c_mktsegment from (
  select *, c_acctbal / 2 as half, row_number() over (partition by c_nationkey, c_mktsegment order by c_custkey) rn from customer) c
  join (select c_nationkey k, arg_min(c_mktsegment, (-n, c_mktsegment)) seg from (select c_nationkey, c_mktsegment, count(*) n from customer group by all) group by 1) m on m.k = c.c_nationkey group by 1""")
def cluster_summary(t):
    c = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.col("c_acctbal").alias("total"), (F.col("c_acctbal") / 2).alias("half"), (F.col("c_acctbal") > 9000).alias("rich"))
    out = space.cluster_summary(c, "c_nationkey", ["total"], ["c_mktsegment"], ["half"], ["rich"], once="c_mktsegment")
    return out.withColumns({"total": F.round("total", 2), "half": F.round("half", 6)})


SQL["cluster_summary"] = SQL["cluster_summary"].replace("sum(case when rn = 1 then c_acctbal else 0 end) as total", "round(sum(case when rn = 1 then c_acctbal else 0 end), 2) as total")


@query("select distinct p_size as cluster, p_brand as area, p_partkey as id, name from (unpivot (select p_size, p_brand, p_partkey, p_name, p_type from part) on p_name, p_type into name v value name)")
def conversion_table(t):
    p = t("part").select(F.col("p_size").alias("cluster"), F.col("p_brand").alias("area"), F.col("p_partkey").alias("id"), "p_name", "p_type")
    return space.conversion_table(p, "cluster", "area", "id", ["p_name", "p_type"])


@query("""select c_custkey, coalesce(case when area = left(lpad(c_custkey::varchar, 10, '0'), 9) then area end, r.area2, area) as area from (
  select c_custkey, case when c_custkey % 3 = 0 then left(lpad(c_custkey::varchar, 10, '0'), 9) else 'x' end as area from customer) c left join (select o_custkey, min(o_orderstatus) as area2 from orders group by 1) r on r.o_custkey = c.c_custkey""")
def reconcile_codes(t):
    c = t("customer").withColumn("area", F.when(F.col("c_custkey") % 3 == 0, scalars.area_code(F.col("c_custkey"), 9)).otherwise("x"))
    ref = t("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("area"))
    return space.reconcile_codes(c.select("c_custkey", "area"), "area", "c_custkey", [ref], "c_custkey", 9).select("c_custkey", "area")


@query("""select o_orderkey, (o_orderstatus = 'F' and d = first) as first_born, count(*) filter (o_orderstatus = 'F') over (partition by o_custkey) as children, (w > 0)::int as welfare, ((w + h) > 0)::int as healthcare from (
  select *, o_orderdate::date d, o_orderkey % 2 w, o_orderkey % 3 h, min(case when o_orderstatus = 'F' then o_orderdate::date end) over (partition by o_custkey) first from orders)""")
def household_features(t):
    o = t("orders").withColumns({"d": F.col("o_orderdate").cast("date"), "w": F.col("o_orderkey") % 2, "h": F.col("o_orderkey") % 3})
    out = panel.household_features(o, "o_custkey", "d", F.col("o_orderstatus") == "F", ["w"], ["w", "h"])
    return out.select("o_orderkey", F.coalesce("first_born", F.lit(False)).alias("first_born"), "children", "welfare", "healthcare")


SQL["household_features"] = SQL["household_features"].replace("(o_orderstatus = 'F' and d = first) as first_born", "coalesce(o_orderstatus = 'F' and d = first, false) as first_born")


@query("""select o_orderkey, gap::int as age_gap, abs(gap) > 3 as inconsistent from (select *, year(o_orderdate) - 1990 - o_orderkey % 8 as gap, row_number() over (partition by o_custkey, o_orderstatus order by o_orderkey) rn from orders) where rn = 1 or gap between 2 and 3""")
def clean_person_tests(t):
    o = _registry(t).withColumns({"born": (F.lit(1990) + F.col("o_orderkey") % 8).cast("int")})
    out = panel.clean_person_tests(o, "o_custkey", "o_orderstatus", "year", "born", F.lit(0), [F.col("o_orderkey")])
    return out.select("o_orderkey", "age_gap", "inconsistent")


@query("select o_custkey, greatest(least(min(year(o_orderdate)), min(1990 + o_orderkey % 30)), 1997)::int as opens, greatest(max(year(o_orderdate)), max(1990 + o_orderkey % 30))::int as closes from orders group by 1")
def open_years(t):
    o = _registry(t).withColumn("y2", (F.lit(1990) + F.col("o_orderkey") % 30).cast("int"))
    return panel.open_years(o, ["o_custkey"], ["year", "y2"], ["year", "y2"], 1997)


@query("select o_custkey, count(*) filter (o_orderstatus = 'P') = 0 as uniparental from orders group by 1")
def uniparental(t):
    return panel.uniparental(t("orders"), "o_custkey", F.col("o_orderstatus") == "P")


@query("""select o_orderkey, round(coalesce(price, avg(price) over (partition by o_custkey)), 6) as price from (select *, case when o_orderkey % 4 <> 0 then o_totalprice end price from orders) o join customer c on c.c_custkey = o.o_custkey""")
def regression_table(t):
    o = t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("price"))
    out = panel.regression_table(o, t("customer").select("c_custkey", "c_acctbal"), ["c_custkey"], [(["c_custkey"], {"price": F.avg("price")})])
    return out.select("o_orderkey", F.round("price", 6).alias("price"))


@query(f"select o_orderkey, coalesce((own % 2)::int, (a >= 100)::int) as treated from {_IDS}")
def attendance_or_eligibility(t):
    return _ids(t).select("o_orderkey", panel.attendance_or_eligibility(F.col("own") % 2, F.col("a"), 100).alias("treated"))


@query("select l_returnflag, bool_or(l_quantity > 49) as some, count(*) filter (l_discount > 0.05) as many, round(avg((l_tax > 0.04)::int), 8) as share, count(distinct l_suppkey) as suppliers from lineitem group by 1")
def boolean_aggregates(t):
    return t("lineitem").groupBy("l_returnflag").agg(
        F.bool_or(F.col("l_quantity") > 49).alias("some"), F.count_if(F.col("l_discount") > 0.05).alias("many"),
        F.round(aggs.share_of(F.col("l_tax") > 0.04), 8).alias("share"), F.count_distinct("l_suppkey").alias("suppliers"),
    )


@query("""with h as (select *, (own is not null)::int + (a is not null)::int + (b is not null)::int as held from %s) select o_orderkey from h where held >= 0.65 * (select max(held) from h)""" % _IDS)
def completeness_filter(t):
    return indices.completeness_filter(_ids(t), ["own", "a", "b"]).select("o_orderkey")


@query("""select o_custkey, o_orderkey, most from (select *, max(o_totalprice) over (partition by o_custkey) most, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) rn from orders) where rn = 1""")
def household_reduce(t):
    o = t("orders").withColumn("most", F.col("o_totalprice"))
    return indices.household_reduce(o, "o_custkey", ["most"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "most")


@query("select 'orders' as src, o_custkey as k, o_totalprice as v, null::varchar as seg from orders union all select 'customer', c_custkey, c_acctbal, c_mktsegment from customer")
def stack_named(t):
    tables = {("orders",): t("orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v")), ("customer",): t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("seg"))}
    return reshape.stack_named(tables, ["src"])


@query("select variable, dense_rank() over (partition by variable order by value)::int as level, value from (unpivot (select distinct o_orderstatus, o_orderpriority from orders) on o_orderstatus, o_orderpriority into name variable value value) group by variable, value")
def factor_dictionary(t):
    from ..sources.ingest import factor_dictionary as build

    return build(t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"])[1]


@query("select o_custkey as person, year(o_orderdate)::int as year, o_orderstatus as status, try_cast(o_orderpriority as int) as priority from orders")
def ingest_round_trip(t):
    from pyspark.sql import types as T

    from ..sources.ingest import to_contract

    contract = T.StructType([T.StructField("person", T.LongType()), T.StructField("year", T.IntegerType()), T.StructField("status", T.StringType()), T.StructField("priority", T.IntegerType())])
    raw = _registry(t).select("o_custkey", "year", "o_orderstatus", "o_orderpriority")
    return graph.materialised(to_contract(raw, contract, [("o_custkey", "person"), ("o_orderstatus", "status"), ("o_orderpriority", "priority")]), "ingested")


@query("select sheet, line, area || lpad(code, 4, '0') as place_id from (select *, last_value(case when head then lpad(code, 6, '0') end ignore nulls) over (partition by sheet order by line rows between unbounded preceding and current row) area from (select p_size as sheet, p_partkey as line, (p_partkey % 1000)::varchar as code, p_type = 'PROMO' as head from part)) where not head and area is not null")
def indented_listing(t):
    from ..sources.ingest import read_indented_listing

    p = t("part").select(F.col("p_size").alias("sheet"), F.col("p_partkey").alias("line"), F.col("p_type").alias("label"), (F.col("p_partkey") % 1000).cast("string").alias("code"))
    out = read_indented_listing(p, "line", "label", "code", "^promo$", ["sheet"])
    return out.filter("place_id is not null").select("sheet", "line", "place_id")
