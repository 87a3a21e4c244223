"""More registered queries: the operators that the catalog's own queries leave out, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import recode, scalars
from ..operators import aggs, estimate, fuzzy, graph, indices, joins, linkage, reshape, space, windows
from ..sources import ingest
from ..streaming.incremental import ingest_incremental
from .catalog import _DATE, _ID3, _IDS, _PANEL, SQL, _ids, _panel, query

# --- projection and recoding ----------------------------------------------


@query("select c_custkey, c_acctbal, c_name from customer")
def columns_by_rule(t):
    c = t("customer")
    named = recode.select_matching(c, prefix="c_cust", regex="bal$", any_of=["c_name", "not there"])
    text = recode.select_matching(c, kind="string", drop=True)  # what isn't text
    return named.join(text.select("c_custkey"), "c_custkey").select("c_custkey", "c_acctbal", "c_name")


@query("""with a as (select o_orderkey, ['< nivel 1', 'en inicio', 'en proceso', 'satisfactorio', 'previo al inicio', 'nada'][o_orderkey % 6 + 1] as v, ['sin estudios', 'primaria completa', 'superior universitaria completa', 'otro'][o_orderkey % 4 + 1] as e from orders)
  select o_orderkey, case when v in ('< nivel 1', 'previo al inicio') then 0 when v = 'en inicio' then 1 when v = 'en proceso' then 2 when v = 'satisfactorio' then 3 end::int as level,
  case e when 'sin estudios' then 0.0 when 'primaria completa' then 6.0 when 'superior universitaria completa' then 16.0 end::double as years from a""")
def answers_to_numbers(t):
    k = F.col("o_orderkey")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))
    level = pick(["< nivel 1", "en inicio", "en proceso", "satisfactorio", "previo al inicio", "nada"], 6)
    years = pick(["sin estudios", "primaria completa", "superior universitaria completa", "otro"], 4)
    return t("orders").select("o_orderkey", recode.codify_level(level).alias("level"), recode.recode_midpoint(years, recode.EDUCATION_YEARS).alias("years"))


@query("""select p_partkey, [1, 2, 3, 2, 2, 4, 5, 1][p_size % 10] as wall, [6, 5, 4, 3, 2, 1, 1][p_size % 9] as floor,
  case p_type when 'PROMO' then 'offer' when 'STANDARD' then 'plain' else p_type end as kind from part""")
def recode_books(t):
    size = F.col("p_size")
    kind = recode.recode_levels(F.col("p_type"), {"PROMO": "offer", "STANDARD": "plain"})
    return t("part").select("p_partkey", recode.recode_codes(size % 10, recode.WALL_CODES[0]).alias("wall"), recode.recode_codes(size % 9, recode.FLOOR_CODES[1]).alias("floor"), kind.alias("kind"))


@query(f"select o_orderkey, own, a from {_IDS} where own is not null and a is not null")
def rows_without_null(t):
    return recode.drop_null(_ids(t).select("o_orderkey", "own", "a"), "own", "a")


@query("""select o_orderkey, try_cast(try_cast(o_orderpriority[1:1] || case when o_orderkey % 3 = 0 then '.0' when o_orderkey % 3 = 1 then 'x' else '' end as double) as int) as i,
  (o_orderkey * 1000003)::bigint as l, try_cast(case when o_orderkey % 2 = 0 then o_totalprice::varchar else 'none' end as double) as d from orders""")
def coerced(t):
    k = F.col("o_orderkey")
    text = F.concat(F.substring("o_orderpriority", 1, 1), F.when(k % 3 == 0, ".0").when(k % 3 == 1, "x").otherwise(""))
    return t("orders").select("o_orderkey", scalars.safe_int(text).alias("i"), scalars.safe_long(k * 1000003).alias("l"), scalars.safe_double(F.when(k % 2 == 0, F.col("o_totalprice").cast("string")).otherwise("none")).alias("d"))


@query("select s_suppkey as suppkey, s_acctbal as acctbal, s_name as name, s_nationkey as nationkey from supplier")
def reordered(t):
    return recode.reorder(t("supplier"), ["s_suppkey", "s_acctbal"], strip_prefix="s_")


# --- joins, order and sets -------------------------------------------------


@query("select n.n_name, c.c_custkey from (select * from nation where n_regionkey < 2) n right join customer c on c.c_nationkey = n.n_nationkey")
def right_join(t):
    n = t("nation").filter("n_regionkey < 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.keyed_join(n, t("customer").select("c_custkey", "c_nationkey"), how="right").select("n_name", "c_custkey")


@query("select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as place from orders qualify place <= 25")
def top_orders(t):
    rows = reshape.top_rows(t("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 25)
    return windows.surrogate_key(rows.withColumn("_m", -F.col("o_totalprice")), ["_m", "o_orderkey"], "place").select("o_orderkey", "place")


@query("""select o_orderkey, row_number() over (order by o_orderstatus desc, o_totalprice, o_orderkey) as place from orders""")
def mixed_order(t):
    """A sort in mixed directions as places: a total order over all tasks."""
    return graph.dense_ids(t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), [F.desc("o_orderstatus"), F.col("o_totalprice"), F.col("o_orderkey")], "place").select("o_orderkey", "place")


@query("select k, v from (select c_custkey as k, c_acctbal as v from customer union all select s_suppkey, s_acctbal from supplier)")
def bag_union(t):
    c, s = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), t("supplier").select("s_suppkey", "s_acctbal")
    return c.union(s)


@query("select k, name from (select c_custkey as k, c_name as name from customer union all select s_suppkey, s_name from supplier)")
def shared_columns(t):
    c = t("customer").withColumnsRenamed({"c_custkey": "k", "c_name": "name", "c_mktsegment": "segment"})
    s = t("supplier").withColumnsRenamed({"s_suppkey": "k", "s_name": "name"})
    names = reshape.shared_columns(c, s)
    assert "segment" in reshape.extra_columns(c, s)
    return c.select(names).union(s.select(names))


# --- windows and reshaping -------------------------------------------------


@query("select l_orderkey, l_linenumber, l_partkey, l_quantity from (select *, row_number() over (partition by l_orderkey order by l_quantity desc, l_partkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate) rn from lineitem) where rn > 1")
def later_rows(t):
    order = [F.desc("l_quantity"), *[F.col(c) for c in ("l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate")]]
    return windows.later_rows(t("lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("""select o_orderkey, first_value(p ignore nulls) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as p
  from (select *, case when o_orderkey % 4 = 0 then o_orderpriority end p from orders)""")
def first_known(t):
    o = t("orders").withColumn("p", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")))
    return o.select("o_orderkey", windows.first_known("p", ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).alias("p"))


@query("select l_orderkey, unnest(list(l_partkey order by l_linenumber, l_partkey, l_suppkey)) as part, unnest(list(l_suppkey order by l_linenumber, l_partkey, l_suppkey)) as supplier from lineitem group by 1")
def lists_to_rows(t):
    rows = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    lists = rows.select("l_orderkey", F.transform("x", lambda s: s["l_partkey"]).alias("part"), F.transform("x", lambda s: s["l_suppkey"]).alias("supplier"))
    return reshape.explode_lists(lists, ["part", "supplier"])


@query("select o_orderkey, o_orderstatus from orders")
def columns_with_values(t):
    o = t("orders").select("o_orderkey", "o_orderstatus", F.lit(None).cast("string").alias("empty"), F.when(F.col("o_orderkey") < 0, 1).alias("never"))
    return reshape.drop_empty_columns(o)


@query("""select o_orderkey, o_custkey from (select *, row_number() over (partition by o_custkey order by md5('1:' || o_orderkey::varchar), o_orderkey) rn from orders) where rn = 1""")
def random_row(t):
    return windows.random_row(t("orders").select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"])


# --- scalars ----------------------------------------------------------------

_ASCII = "text"
for _a, _b in (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("þ", "th"), ("Þ", "TH")):
    _ASCII = f"replace({_ASCII}, '{_a}', '{_b}')"
_ASCII = f"translate({_ASCII}, '{scalars._ACCENTED}', '{scalars._PLAIN}')"
_SQUISH = r"trim(regexp_replace({0}, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')"

SQL["clean_text"] = f"""select doc_id, case when text not in ('', '#null!', '\\.') then {_ASCII.replace("(text,", f"(regexp_replace({_SQUISH.format('lower(text)')}, '" + r"\p{P}" + "', '', 'g'),")} end as text from documents"""


@query(f"""select doc_id, {_SQUISH.format("text")} as squished, length({_ASCII}) as n_ascii, md5({_ASCII}) as ascii_md5 from documents""")
def plain_text(t):
    plain = scalars.to_ascii(F.col("text"))
    return t("documents").select("doc_id", scalars.squish(F.col("text")).alias("squished"), F.length(plain).cast("long").alias("n_ascii"), F.md5(plain).alias("ascii_md5"))


@query("""select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') as title, nullif(case when p_size % 5 = 0 then '' else p_brand end, '') as brand,
  regexp_replace(p_brand, '[0-9]', '', 'g') as letters, case when p_size % 3 = 0 then p_name else p_name || ', ' || p_type end as label from part""")
def text_parts(t):
    p, size = t("part"), F.col("p_size")
    return p.select(
        "p_partkey", scalars.title(F.col("p_name")).alias("title"), scalars.empty_to_null(F.when(size % 5 == 0, "").otherwise(F.col("p_brand"))).alias("brand"),
        scalars.remove_digits(F.col("p_brand")).alias("letters"), scalars.concat_optional(F.col("p_name"), F.when(size % 3 != 0, F.col("p_type")), ", ").alias("label"),
    )


@query("""select o_orderkey, nullif(try_cast(case when o_orderkey % 10 = 0 then '99999999' when o_orderkey % 10 = 1 then '1-2' else o_custkey::varchar end as int), 99999999) as id, case when o_orderkey % 5 - 1 not in (-1, 0) then o_orderkey % 5 - 1 end as code,
  case when o_custkey >= 100 then o_custkey end as long_id, case when year(o_orderdate) between 1996 and 1999 then o_orderdate end as within from orders""")
def missing_values(t):
    k = F.col("o_orderkey")
    text = F.when(k % 10 == 0, F.lit("ab 99999999")).when(k % 10 == 1, F.lit("1-2")).otherwise(F.concat(F.lit("No "), F.col("o_custkey").cast("string"), F.lit(" x")))
    return t("orders").select(
        "o_orderkey", scalars.digits_to_int(text).alias("id"), scalars.missing_codes(k % 5 - 1).alias("code"), scalars.above(F.col("o_custkey"), 100).alias("long_id"), scalars.year_within(F.col("o_orderdate"), 1996, 1999).alias("within"),
    )


_REPAIRED = "replace(s, 'DD-MM', '01-01')"
for _a, _b in (("31-11-2013", "30-11-2013"), ("-013$", "-2013"), ("^91-", "01-"), ("-197$", "-1997"), ("-0002$", "-2000"), ("-0206", "-2006"), ("-20[2-9](.)$", r"-200\1"), ("-1[0-7](..)$", r"-19\1")):
    _REPAIRED = f"regexp_replace({_REPAIRED}, '{_a}', '{_b}')"


@query(f"""with a as (select o_orderkey, case o_orderkey % 8 when 0 then strftime(o_orderdate, 'DD-MM-%Y') when 1 then '31-11-2013' when 2 then strftime(o_orderdate, '%d-%m-013') when 3 then strftime(o_orderdate, '91-%m-%Y') when 4 then strftime(o_orderdate, '%d-%m-197')
    when 5 then strftime(o_orderdate, '%d-%m-0002') when 6 then strftime(o_orderdate, '%d-%m-0206') else strftime(o_orderdate, '%d-%m-%Y') end as s from orders)
  select o_orderkey, try_strptime({_REPAIRED}, '%d-%m-%Y')::date as d from a""")
def repaired_dates(t):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    part = lambda f: F.date_format(d, f)
    s = (
        F.when(k % 8 == 0, F.concat(F.lit("DD-MM-"), part("yyyy"))).when(k % 8 == 1, "31-11-2013").when(k % 8 == 2, F.concat(part("dd-MM"), F.lit("-013"))).when(k % 8 == 3, F.concat(F.lit("91-"), part("MM-yyyy")))
        .when(k % 8 == 4, F.concat(part("dd-MM"), F.lit("-197"))).when(k % 8 == 5, F.concat(part("dd-MM"), F.lit("-0002"))).when(k % 8 == 6, F.concat(part("dd-MM"), F.lit("-0206"))).otherwise(part("dd-MM-yyyy"))
    )
    return t("orders").select("o_orderkey", scalars.repair_date(s).alias("d"))


@query("""select l_orderkey, l_linenumber, l_partkey, (l_extendedprice - 500.0) / 100.0 as score, case when l_discount = 0 then -1.0 else l_tax / l_discount end as ratio,
  case when l_discount <> 0 then l_tax / l_discount end as known, case when l_returnflag is null then 'none' when l_returnflag = 'R' then 'back' else 'kept' end as flag, l_quantity / 60 * 5.0 as km from lineitem""")
def number_rules(t):
    r = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax") / F.when(F.col("l_discount") != 0, F.col("l_discount")))
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", scalars.standard_score(F.col("l_extendedprice")).alias("score"), scalars.nan_to(r, -1.0).alias("ratio"), scalars.finite(r).alias("known"),
        scalars.if_else(F.col("l_returnflag") == "R", "back", "kept", F.lit("none")).alias("flag"), scalars.speed_distance(F.col("l_quantity"), F.lit(5.0)).alias("km"),
    )


@query("select o_orderkey, o_orderkey % 90 / 60 * case when o_custkey % 4 = 0 then 12.0 when o_custkey % 4 = 1 and o_orderstatus = 'F' then 5.0 when o_custkey % 4 > 1 then 40.0 end as km from orders")
def travel_distance(t):
    c = F.col("o_custkey") % 4
    speed = F.when(c == 0, 12.0).when(c > 1, 40.0)
    return t("orders").select("o_orderkey", space.travel_distance(F.col("o_orderkey") % 90, F.col("o_orderstatus") == "F", speed).alias("km"))


_CODES = "translate(regexp_replace(upper({0}), '[^A-Z]', '0', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623017202')"


def _soundex(joined: str) -> str:
    """SQL of the phonetic code of a text that begins with a letter: h and w are skipped, equal codes side by side count once."""
    runs = "left(c, 1) || replace(c[2:], '7', '')"
    for d in "0123456":
        runs = f"regexp_replace({runs}, '{d}+', '{d}', 'g')"
    return f"select p_partkey, upper(j[1]) || rpad(left(replace(({runs})[2:], '0', ''), 3), 3, '0') as key from (select p_partkey, j, {_CODES.format('j')} as c from ({joined}))"


SQL["name_key"] = _soundex("select p_partkey, replace(array_to_string(list_sort([coalesce(p_name, ''), coalesce(p_brand, '')]), ''), ' ', '') as j from part")

def _metaphone(text: str) -> str:
    out = f"regexp_replace(upper({text}), '[^A-Z]', '', 'g')"
    for letter in "ABDEFHIJKLMNOPQRSTUVWXYZ":
        out = f"regexp_replace({out}, '{letter}+', '{letter}', 'g')"
    for pattern, sound in scalars.METAPHONE:
        out = f"regexp_replace({out}, '{pattern}', '{sound}', 'g')"
    return f"upper({out})"


@query(
    f"""select p_partkey, {_metaphone("array_to_string(list_sort([coalesce(p_name, ''), coalesce(p_type, ''), coalesce(p_brand, '')]), '')")} as key,
  {_metaphone("p_name")} as name_sound from part"""
)
def metaphone_key(t):
    return t("part").select("p_partkey", scalars.metaphone_key(F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("key"), scalars.metaphone(F.col("p_name")).alias("name_sound"))


SQL["substring_distance"] = """select p_partkey, (case when min(levenshtein('rimg', substr(p_name, i::int, n::int))) <= 2 then min(levenshtein('rimg', substr(p_name, i::int, n::int))) else -1 end)::int as distance
  from part, range(1, 65) s(i), range(0, 7) l(n) where i <= length(p_name) group by 1"""

# --- fuzzy work and graphs --------------------------------------------------

SQL["fuzzy_names_d2"] = "with n as (select distinct p_name as s from part) select a.s as left_text, b.s as right_text, levenshtein(a.s, b.s)::int as distance from n a, n b where levenshtein(a.s, b.s) <= 2"

@query("with n as (select distinct url as s from pages where url is not null) select a.s as left_text, b.s as right_text, levenshtein(a.s, b.s)::int as distance from n a, n b where levenshtein(a.s, b.s) <= 12")
def fuzzy_urls_d12(t):
    """All distinct addresses against each other at a large distance, without a block."""
    p = t("pages").select("url")
    return fuzzy.gram_pairs(p, p, "url", "url", 12)


# texts in row order; one with earlier neighbours leads if all of them don't
SQL["string_clusters"] = """with recursive n as (select p_name as txt, min(p_partkey) as pos from part where p_name is not null group by 1),
  near as (select a.txt, a.pos, b.txt as other, b.pos as other_pos from n a, n b where a.txt <> b.txt and damerau_levenshtein(a.txt, b.txt) <= 2 and (b.pos, b.txt) < (a.pos, a.txt)),
  waiting as (select txt, list(other) as others, row_number() over (order by pos, txt) as k from near group by txt, pos),
  steps as (select 0::bigint as k, []::varchar[] as led union all select o.k, case when list_has_all(s.led, o.others) then s.led else list_append(s.led, o.txt) end from steps s join waiting o on o.k = s.k + 1),
  led as (select unnest(led) as txt from steps where k = (select max(k) from steps)),
  own as (select txt, txt as leader from n where txt not in (select txt from led) union all
    select txt, arg_min(other, (other_pos, other)) from near where txt in (select txt from led) and other not in (select txt from led) group by txt),
  labels as (select leader, array_to_string(list_sort(list(txt)), ', ') as label from own group by 1)
  select txt as text, leader, label from own join labels using (leader)"""


@query()
def string_groups(t):
    """Clusters whose first members are close are merged, again and again."""
    return fuzzy.merge_close_groups(fuzzy.cluster_strings(t("part").select("p_partkey", "p_name"), "p_name", 1, "p_partkey"), 2)


_SPREAD = """cc(node, comp) using key (node) as (select node, node from nodes union
  (select e.v, min(c.comp) from cc c join edges e on c.node = e.u join recurring.cc r on r.node = e.v where c.comp < r.comp group by e.v))"""

SQL["merge_groupings"] = f"""with recursive rows as (select distinct l_orderkey, case when l_linenumber <= 2 then l_partkey end as p from lineitem),
  half as (select l_orderkey as u, -1 - p as v from rows where p is not null), edges as (select u, v from half union select v, u from half),
  nodes as (select distinct l_orderkey as node from rows union select -1 - p from rows where p is not null), {_SPREAD},
  least as (select comp, min(node) filter (node >= 0) as f from cc group by 1)
  select l_orderkey, p, dense_rank() over (order by f) as group_id from rows join cc on cc.node = rows.l_orderkey join least using (comp)"""

SQL["merge_with_names"] = f"""with recursive rows as (select s_suppkey, s_suppkey % 30 as cluster, case when s_nationkey < 5 then s_nationkey end as names, s_suppkey % 9 = 0 as noise, case when s_suppkey % 9 = 0 then 'p' || s_suppkey else 'c' || (s_suppkey % 30) end as c from supplier),
  half as (select c as u, 'n' || names as v from rows where names is not null), edges as (select u, v from half union select v, u from half),
  nodes as (select c as node from rows union select 'n' || names from rows where names is not null), {_SPREAD},
  facts as (select cc.comp, min(c) as f, min(names) as s, count(distinct c) as cs, bool_or(names is not null) as named, bool_or(not noise) as clustered from rows join cc on cc.node = rows.c group by 1),
  ids as (select *, row_number() over (order by f, s) as group_id from facts)
  select s_suppkey, cluster, names, noise, group_id, case when named and clustered and cs > 1 then 'both' when named and cs > 1 then 'names' when clustered then 'cluster' else 'noise' end as source
  from rows join cc on cc.node = rows.c join ids using (comp)"""

# an edge of the hull has no point on its right
SQL["footprint"] = """with p as (select distinct label, embedding[1]::double as x, embedding[2]::double as y from embeddings),
  e as (select a.label, a.x, a.y, b.x as u, b.y as v from p a join p b on a.label = b.label and (a.x <> b.x or a.y <> b.y)
    where not exists (select 1 from p c where c.label = a.label and (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0)),
  s as (select label, sum(sqrt((u - x) ^ 2 + (v - y) ^ 2)) as around, abs(sum(x * v - u * y)) / 2 as area from e group by 1)
  select label, (select count(*) from embeddings where embeddings.label = s.label) as n, area + around * 0.5 + pi() * 0.25 as area from s"""

SQL["resolve_places"] = """with x as (select p_partkey, lpad(((p_partkey % 7 + 1) * 100000000 + p_partkey)::varchar, 10, '0') as place, p_name || 's' as name from part),
  ref as (select p_partkey as ref_id, lpad(((p_partkey % 7 + 1) * 100000000 + p_partkey)::varchar, 10, '0') as place, p_name as name from part),
  k1 as (select x.p_partkey, r.ref_id, levenshtein(x.name, r.name) as d from x join ref r on left(x.place, 4) = left(r.place, 4) where levenshtein(x.name, r.name) <= 1),
  s1 as (select p_partkey, ref_id, 1 as step from (select *, row_number() over (partition by p_partkey order by d, md5('1:' || ref_id), ref_id) rn from k1) where rn = 1),
  k2 as (select x.p_partkey, r.ref_id, levenshtein(x.name, r.name) as d from x join ref r on left(x.place, 2) = left(r.place, 2) where x.p_partkey not in (select p_partkey from s1) and levenshtein(x.name, r.name) <= 2),
  s2 as (select p_partkey, ref_id, 2 as step from (select *, row_number() over (partition by p_partkey order by d, md5('1:' || ref_id), ref_id) rn from k2) where rn = 1)
  select * from s1 union all select * from s2"""

# --- estimation --------------------------------------------------------------


def _demeaned(rounds: int) -> str:
    """Rows less their means by supplier and by part group, in turn."""
    names = ("y", "x1", "x2")
    out = ["d0 as (select l_suppkey as s, l_partkey % 20 as p, l_extendedprice as y, l_quantity as x1, l_discount as x2 from lineitem)"]
    for k in range(rounds):
        for half, e in (("a", "s"), ("", "p")):
            name, before = f"d{k + 1}{half}", f"d{k}" if half else f"d{k + 1}a"
            out.append(f"{name} as materialized (select s, p, {', '.join(f'{n} - avg({n}) over (partition by {e}) as {n}' for n in names)} from {before})")
    return ", ".join(out)


def _meat(keys: str) -> str:
    return f"(select {{'g': count(*), 'a': sum(u1 * u1), 'b': sum(u1 * u2), 'c': sum(u2 * u2)}} from (select sum(x1 * u) as u1, sum(x2 * u) as u2 from res group by {keys}))"


SQL["fe_regression_2"] = f"""with {_demeaned(8)}, d as materialized (select * from d8),
  m as (select sum(x1 * x1) as a, sum(x1 * x2) as b, sum(x2 * x2) as c, sum(x1 * y) as e, sum(x2 * y) as f, count(*) as n from d),
  v as (select *, c / (a * c - b * b) as i11, -b / (a * c - b * b) as i12, a / (a * c - b * b) as i22 from m),
  o as (select *, i11 * e + i12 * f as b1, i12 * e + i22 * f as b2 from v),
  res as materialized (select d.*, y - b1 * x1 - b2 * x2 as u from d, o),
  w as (select {_meat('s')} as ms, {_meat('p')} as mp, {_meat('s, p')} as mb),
  k as (select {", ".join(f"(n - 1) / (n - 2)::double * (ms.{z} * ms.g / (ms.g - 1) + mp.{z} * mp.g / (mp.g - 1) - mb.{z} * mb.g / (mb.g - 1)) as t{z}" for z in "abc")}, o.* from w, o)
  select 'l_quantity' as term, round(b1, 4) as estimate, round(sqrt(greatest(0, i11 * i11 * ta + 2 * i11 * i12 * tb + i12 * i12 * tc)), 4) as se, n from k union all
  select 'l_discount', round(b2, 4), round(sqrt(greatest(0, i12 * i12 * ta + 2 * i12 * i22 * tb + i22 * i22 * tc)), 4), n from k"""

SQL["imputation_effect"] = f"""with recursive panel as materialized {_PANEL}, clean as materialized (select user_id, day, y from panel where treated = 0),
  steps as (select 0 as k, map_from_entries(list((day, b))) as bs from (select day, avg(y) as b from clean group by 1) union all
    select k + 1, (select map_from_entries(list((day, b))) from (select day, avg(y - a) as b from (select day, y, avg(y - steps.bs[day]) over (partition by user_id) as a from clean) group by 1)) from steps where k < 80),
  last as materialized (select bs from steps where k = 80), units as (select user_id, avg(y - bs[day]) as a from clean, last group by 1)
  select round(avg(p.y - a - bs[day]), 6) as effect, count(*) as n from panel p join units using (user_id), last where treated = 1 and bs[day] is not null"""

# the first eigenvector: the correlation matrix is squared again and again
SQL["component_index"] = """with recursive c as (select corr(l_quantity, l_extendedprice) as qp, corr(l_quantity, l_discount) as qd, corr(l_extendedprice, l_discount) as pd, avg(l_quantity) as mq, avg(l_extendedprice) as mp, avg(l_discount) as md,
    stddev_pop(l_quantity) as sq, stddev_pop(l_extendedprice) as sp, stddev_pop(l_discount) as sd from lineitem where l_quantity is not null and l_extendedprice is not null and l_discount is not null),
  s as (select 0 as k, 1.0::double as a, qp as b, qd as d, 1.0::double as e, pd as f, 1.0::double as g from c union all
    select k + 1, (a * a + b * b + d * d) / r, (a * b + b * e + d * f) / r, (a * d + b * f + d * g) / r, (b * b + e * e + f * f) / r, (b * d + e * f + f * g) / r, (d * d + f * f + g * g) / r
      from (select *, a * a + e * e + g * g + 2 * (b * b + d * d + f * f) as r from s) where k < 40),
  w as (select case when a >= e and a >= g then [a, b, d] when e >= g then [b, e, f] else [d, f, g] end as w from s where k = 40),
  v as (select list_transform(w, lambda x: x / sqrt(w[1] ^ 2 + w[2] ^ 2 + w[3] ^ 2) * case when w[1] + w[2] + w[3] >= 0 then 1 else -1 end) as v from w)
  select l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, round(v[1] * (l_quantity - mq) / sq + v[2] * (l_extendedprice - mp) / sp + v[3] * (l_discount - md) / sd, 6) as index from lineitem, c, v"""


@query()
def latent_index(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.floor(F.col("l_quantity") / 10).alias("q"), F.floor(F.col("l_extendedprice") / 10000).alias("e"), (F.col("l_discount") * 100).cast("int").alias("d"))
    return indices.component_index(rows, ["q", "e", "d"], latent=True).withColumn("index", F.round("index", 4))


@query()
def composite_index(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    out = indices.composite_index(rows, {"size": ["l_quantity", "l_extendedprice"], "terms": ["l_discount", "l_tax"]}, out="index")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("size", 6).alias("size"), F.round("terms", 6).alias("terms"), F.round("index", 6).alias("index"))


def _pair_index(a: str, b: str) -> str:
    """The first component of two items: both weigh 1 / sqrt 2, with the sign of their correlation."""
    return f"(z{a} + case when corr(z{a}, z{b}) over () >= 0 then z{b} else -z{b} end) / sqrt(2)"


_Z = ", ".join(f"({c} - avg({c}) over ()) / stddev_pop({c}) over () as z{k}" for k, c in (("q", "l_quantity"), ("p", "l_extendedprice"), ("d", "l_discount"), ("t", "l_tax")))
SQL["composite_index"] = f"""with z as (select l_orderkey, l_linenumber, l_partkey, {_Z} from lineitem), i as (select *, {_pair_index('q', 'p')} as size, {_pair_index('d', 't')} as terms from z),
  s as (select *, (size - avg(size) over ()) / stddev_pop(size) over () as zs, (terms - avg(terms) over ()) / stddev_pop(terms) over () as ze from i)
  select l_orderkey, l_linenumber, l_partkey, round(size, 6) as size, round(terms, 6) as terms, round({_pair_index('s', 'e')}, 6) as index from s"""

_U = "((('0x' || substr(md5(o_orderkey::varchar || ':' || copy || ':1-1-0-{0}'), 1, 10))::bigint + 0.5) / 1099511627776.0::double)"
SQL["chained_imputation"] = f"""with o as (select o_orderkey, case when o_orderkey % 10 <> 0 then o_totalprice end as price, month(o_orderdate)::double as month from orders),
  m as (select regr_slope(price, month) as b, regr_intercept(price, month) as a, sqrt(greatest(0, regr_syy(price, month) - regr_slope(price, month) * regr_sxy(price, month)) / (count(price) - 2)) as s from o where price is not null),
  c as (select o_orderkey, coalesce(price, a + b * month + s * sqrt(-2 * ln({_U.format(0)})) * cos(2 * pi() * {_U.format(1)})) as price from o, m, (values (1), (2)) v(copy))
  select o_orderkey, round(avg(price), 4) as price from c group by 1"""




def _logit(y: str, rounds: int = 14) -> str:
    """Newton's steps of a logistic model of ``y`` on the standardised columns x1 and x2, with a penalty of 0.01 on both."""
    grad = ["avg(y - p)", "avg((y - p) * x1) - 0.01 * any_value(b1)", "avg((y - p) * x2) - 0.01 * any_value(b2)"]
    hess = ["avg(w)", "avg(w * x1)", "avg(w * x2)", "avg(w * x1 * x1) + 0.01", "avg(w * x1 * x2)", "avg(w * x2 * x2) + 0.01"]
    sums = ", ".join(f"{e} as {n}" for e, n in zip([*grad, *hess], ["ga", "gb", "gc", "a", "b", "c", "d", "e", "f"], strict=True))
    det = "(a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d))"
    s0 = f"(ga * (d * f - e * e) + gb * (c * e - b * f) + gc * (b * e - c * d)) / {det}"
    s1 = f"(ga * (c * e - b * f) + gb * (a * f - c * c) + gc * (b * c - a * e)) / {det}"
    s2 = f"(ga * (b * e - c * d) + gb * (b * c - a * e) + gc * (a * d - b * b)) / {det}"
    inner = f"select k, b0, b1, b2, {y} as y, x1, x2, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) as p, p * (1 - p) as w from z, fit_{y}"
    return f"""fit_{y} as (select 0 as k, 0.0::double as b0, 0.0::double as b1, 0.0::double as b2 union all
    select k + 1, b0 + {s0}, b1 + {s1}, b2 + {s2} from (select k, any_value(b0) as b0, any_value(b1) as b1, any_value(b2) as b2, {sums} from ({inner}) group by k) where k < {rounds})"""


SQL["propensity_weights"] = f"""with recursive p as (select user_id, day, treated, n::double as n, (n * day)::double as n2, (avg(treated) over (partition by user_id) > 0 and avg(treated) over (partition by user_id) < 1)::int as sw from {_PANEL}),
  z as materialized (select *, n / stddev_samp(n) over () as x1, n2 / stddev_samp(n2) over () as x2 from p), {_logit('treated')}, {_logit('sw')},
  t as (select b0, b1, b2 from fit_treated where k = 14), s as (select b0, b1, b2 from fit_sw where k = 14),
  w as (select user_id, day, 1 / (1 + exp(-(t.b0 + t.b1 * x1 + t.b2 * x2))) * case when min(sw) over () = max(sw) over () then 1 / sw else 1 + exp(-(s.b0 + s.b1 * x1 + s.b2 * x2)) end / nullif(var_pop(treated) over (partition by user_id), 0) * avg(sw) over () / avg(treated) over () as weight from z, t, s)
  select user_id, day, round(weight, 4) as weight from w where weight is not null"""


@query("""select variable, level, n_0, round(n_0 / t0, 8) as share_0, n_1, round(n_1 / t1, 8) as share_1, round(sum((n_0 - e0) ^ 2 / e0 + (n_1 - e1) ^ 2 / e1) over (partition by variable), 6) as chi2, count(*) over (partition by variable) - 1 as df from (
  select *, (n_0 + n_1) * t0 / (t0 + t1) as e0, (n_0 + n_1) * t1 / (t0 + t1) as e1 from (select *, sum(n_0) over (partition by variable) as t0, sum(n_1) over (partition by variable) as t1 from (
    select variable, level, count(*) filter (tr = 0) as n_0, count(*) filter (tr = 1) as n_1 from (unpivot (select (o_totalprice > 150000)::int as tr, o_orderstatus, o_orderpriority from orders) on o_orderstatus, o_orderpriority into name variable value level) group by all)))""")
def balance_categories(t):
    out = estimate.balance_categories(t("orders").withColumn("tr", (F.col("o_totalprice") > 150000).cast("int")), "tr", ["o_orderstatus", "o_orderpriority"])
    return out.select("variable", "level", "n_0", F.round("share_0", 8).alias("share_0"), "n_1", F.round("share_1", 8).alias("share_1"), F.round("chi2", 6).alias("chi2"), "df")


@query("""with m as (select regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a, count(*) as n, sum(l_quantity) as sx, sum(l_quantity ^ 2) as sxx from lineitem),
  r as (select l_quantity as x, l_extendedprice - a - b * l_quantity as u, m.* from lineitem, m), s as (select sum(u * u) as s11, sum(u * u * x) as s12, sum(u * u * x * x) as s22, any_value(n) as n, any_value(sx) as sx, any_value(sxx) as sxx, any_value(a) as a, any_value(b) as b, any_value(n * sxx - sx * sx) as det from r)
  select '(intercept)' as term, round(a, 4) as estimate, round(sqrt(n / (n - 2) * (sxx * sxx * s11 - 2 * sxx * sx * s12 + sx * sx * s22)) / det, 4) as se, n from s union all
  select 'l_quantity', round(b, 4), round(sqrt(n / (n - 2) * (sx * sx * s11 - 2 * n * sx * s12 + n * n * s22)) / det, 4), n from s""")
def least_squares(t):
    out = estimate.fe_regression(t("lineitem"), "l_extendedprice", ["l_quantity"])
    return out.select("term", F.round("estimate", 4).alias("estimate"), F.round("se", 4).alias("se"), "n")


@query(f"""with b as (select l_returnflag, least(floor(l_discount * 10 / (1.0 / 512)), 511) k, count(*) n from lineitem where l_discount * 10 between 0 and 1 group by all), g as (select i * 1.0 / 20 as x from range(21) r(i))
  select l_returnflag, x::double as x, round(sum(n * exp(-(((x - (k + 0.5) / 512) / 0.05) ^ 2) / 2)) / (sum(n) * 0.05 * 2.5066282746310002), 8) as density from b cross join g group by all""")  # noqa: F541
def overlap(t):
    out = estimate.overlap_density(t("lineitem").withColumn("score", F.col("l_discount") * 10), "score", "l_returnflag", 21)
    return out.select("l_returnflag", F.round("x", 10).alias("x"), F.round("density", 8).alias("density"))


@query(f"""select o_orderkey, case when ids = 1 then level when ids = 2 and dates between 2 and 3 then level + 2 when ids = 2 and dates between 4 and 5 then level + 3 when ids = 3 then level when ids = 4 and dates between 1 and 3 then level + 3
  when ids = 4 and dates between 4 and 5 then level + 4 when ids = 5 and dates = 1 then level + 4 when ids = 5 and dates between 2 and 3 then level + 5 when ids = 5 and dates between 4 and 5 then level + 6 when ids = 6 then level + 2 end::int as level
  from (select o_orderkey, (o_orderkey % 3 + 1)::int as level, {_ID3} as ids, {_DATE} as dates from {_IDS})""")
def added_level(t):
    x = _ids(t).withColumns({"ids": linkage.agreement_id3(F.col("own"), F.col("a"), F.col("b")), "dates": linkage.agreement_date(F.col("d"), F.col("d2")), "level": (F.col("o_orderkey") % 3 + 1).cast("int")})
    return x.select("o_orderkey", linkage.added_level(F.col("level"), F.col("ids"), F.col("dates")).alias("level"))


@query("""with k as (select p_name, p_brand, p_type, count(*) filter (p_size <= 25) * count(*) filter (p_size between 10 and 40) * count(*) filter (p_size > 20) as pairs from part group by all) select p_name, p_brand, p_type, pairs from k where pairs > 2""")
def common_keys(t):
    p = t("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return linkage.common_keys(p.filter("p_size <= 25"), p.filter("p_size between 10 and 40"), p.filter("p_size > 20"), ["p_name", "p_brand", "p_type"], 2)


@query("""with x as (select p_partkey as xid, p_name n, p_brand b, p_size s from part where p_size <= 25), y as (select p_partkey as yid, p_name n, p_brand b, p_size s from part where p_size > 25),
  s1 as (select xid, yid, 1 as filter_stage from (select *, count(*) over (partition by n, b) c from x) join (select *, count(*) over (partition by n, b) c2 from y) using (n, b) where c = 1 and c2 = 1),
  x2 as (select * from x where xid not in (select xid from s1)), y2 as (select * from y where yid not in (select yid from s1)),
  s2 as (select xid, yid, 2 as filter_stage from (select xid, yid, row_number() over (partition by xid order by abs(x2.s - y2.s), yid) rx, row_number() over (partition by yid order by abs(x2.s - y2.s), xid) ry from x2 join y2 using (n)) where rx = 1 and ry = 1)
  select * from s1 union all select * from s2""")
def cascade_rules(t):
    """Stages with rules of their own: unique keys first, then the nearest on both sides."""
    p = t("part").select("p_partkey", F.col("p_name").alias("n"), F.col("p_brand").alias("b"), F.col("p_size").alias("s"))
    x, y = p.filter("s <= 25").withColumnRenamed("p_partkey", "xid"), p.filter("s > 25").withColumnsRenamed({"p_partkey": "yid", "s": "s2"})
    return linkage.cascade(x, y, "xid", "yid", [["n", "b"], ["n"]], accept=[None, linkage.Nearest("s", "s2")])


@query(f"""with p as (select user_id, day, n::double as y, treated from {_PANEL}) select round(avg(y) filter (treated = 1) - avg(y) filter (treated = 0), 8) as gap, count(*) as n from p""")
def strict_means(t):
    """A gap of means, null as soon as one value of an arm is."""
    p = _panel(t)
    arms = p.groupBy("treated").agg(aggs.strict(F.avg("n"), F.col("n")).alias("m"), F.count(F.lit(1)).alias("c"))
    return arms.agg(F.round(F.max(F.when(F.col("treated") == 1, F.col("m"))) - F.max(F.when(F.col("treated") == 0, F.col("m"))), 8).alias("gap"), F.sum("c").alias("n"))


# --- sources: written by Spark, read back ------------------------------------


def _at(t, name: str) -> tuple:
    import uuid

    spark = t("region").sparkSession
    return spark, f"{graph.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("select o_orderkey, o_orderstatus, o_totalprice from orders")
def incremental_rounds(t):
    """Files that come in two rounds are each read once."""
    spark, path = _at(t, "stream")
    rows = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    for part in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'"):
        rows.filter(part).write.mode("append").parquet(f"{path}/in")
        ingest_incremental(spark, f"{path}/in", f"{path}/out", f"{path}/check", rows.schema)
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


@query("select c_custkey::varchar as c_custkey, nullif(c_mktsegment, 'BUILDING') as c_mktsegment, c_acctbal from customer")
def decimal_commas(t):
    spark, path = _at(t, "commas")
    rows = t("customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "#NULL!").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.replace(F.col("c_acctbal").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(",")).alias("c_acctbal"))
    rows.write.option("sep", ";").option("header", True).csv(path)
    return ingest.read_decimal_comma_csv(spark, path, ["c_acctbal"])


@query("select p_partkey, p_name, p_size from part")
def typed_files(t):
    spark, path = _at(t, "typed")
    rows = t("part").select("p_partkey", "p_name", "p_size")
    ingest.write_files(rows, path, "csv")
    return ingest.read_typed_csv(spark, path, rows.schema)


@query("select s_suppkey::varchar as s_suppkey, s_name, s_nationkey::varchar as s_nationkey, true as named from supplier")
def folder_files(t):
    spark, path = _at(t, "folder-2014")
    t("supplier").select("s_suppkey", "s_name", "s_nationkey").write.option("header", True).csv(path)
    out = ingest.read_folder(spark, path, kind_pattern="^(part)-")
    return out.select("s_suppkey", "s_name", "s_nationkey", (F.col("file_kind") == "part").alias("named"))


@query("select o_custkey as person, o_orderstatus as status, 1996 as year from orders where year(o_orderdate) = 1996 union all select o_custkey, o_orderstatus, 1997 from orders where year(o_orderdate) = 1997")
def vintages(t):
    o = t("orders").withColumn("y", F.year("o_orderdate"))
    one = o.filter("y = 1996").select(F.col("o_custkey").alias("Person  Id"), F.col("o_orderstatus").alias("STATUS"))
    two = o.filter("y = 1997").select(F.col("o_custkey").alias("person"), F.col("o_orderstatus").alias("State"))
    return ingest.read_vintages({1996: one, 1997: two}, [("person id", "person"), ("state", "status")])


@query("select o_custkey as person, o_totalprice as amount, 1996 as year from orders")
def keyed_columns(t):
    key = [{"name": "o_custkey", "definition": "person", "year": 1996}, {"name": "o_totalprice", "definition": "amount", "year": 1996}, {"name": "o_orderstatus", "definition": "status", "year": 1997}]
    return ingest.read_by_key(t("orders"), key, 1996)


@query("select o_custkey, count(*) as n from orders group by 1")
def named_result(t):
    out = ingest.materialise(t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), "orders_per_customer", temporary=True)
    return out.filter("n > 0")


# --- donors, inference, factored links, repeatable appends ---------------------


@query("""with d as (select c_custkey, c_acctbal, row_number() over (order by c_acctbal, c_custkey) as r from customer where c_custkey % 3 <> 0), x as (select c_custkey, c_acctbal, (select count(*) from d where d.c_acctbal < c.c_acctbal) as b from customer c where c_custkey % 3 = 0),
  p as (select x.c_custkey, d.c_custkey as donor, row_number() over (partition by x.c_custkey order by abs(x.c_acctbal - d.c_acctbal), abs(d.r - x.b - 0.5), d.r) as place from x join d on true) select c_custkey, place::int as place, donor from p where place <= 5""")
def nearest_donors(t):
    from ..operators import models

    c = t("customer").select("c_custkey", "c_acctbal")
    donors = c.filter("c_custkey % 3 <> 0").withColumnRenamed("c_custkey", "donor")
    out = models.nearest_donors(c.filter("c_custkey % 3 = 0"), donors, "c_acctbal", "donor", 5)
    return out.select("c_custkey", F.posexplode("donors")).select("c_custkey", (F.col("pos") + 1).alias("place"), "col.donor")


@query(f"""with p as (select user_id, day // 3 as t, avg(y) as y, max(treated) as tr from {_PANEL} where user_id % 4 <> 0 group by all union all select user_id, day // 3, avg(y), 0 from {_PANEL} where user_id % 4 = 0 group by all),
  r as (select *, min(case when tr = 1 then t end) over (partition by user_id) g from p), c as (select g, t, avg(y) as m, count(*) as n from r group by all),
  e as (select a.g, a.t, a.m - b.m - x.m + z.m as att, a.n as treated, x.n as controls from c a join c b on b.g = a.g and b.t = a.g - 1 join c x on x.g is null and x.t = a.t join c z on z.g is null and z.t = a.g - 1 where a.g is not null and a.t <> a.g - 1),
  psi as (select e.g, e.t, r.user_id, sum(case when r.g is null then -1 else 1 end * case when r.t = e.t then 1 else -1 end * (r.y - c.m) / c.n) as v from e join r on (r.g = e.g or r.g is null) and (r.t = e.t or r.t = e.g - 1) join c on c.g is not distinct from r.g and c.t = r.t group by all)
  select e.g::bigint as g, e.t::bigint as t, round(any_value(att), 7) as att, round(sqrt(sum(v * v)), 7) as se, any_value(treated) as treated, any_value(controls) as controls from e join psi using (g, t) group by e.g, e.t""")
def att_inference(t):
    p = _panel(t).withColumn("t", F.floor(F.col("day") / 3)).withColumn("treated", F.when(F.col("user_id") % 4 == 0, 0).otherwise(F.col("treated")))
    p = p.groupBy("user_id", "t").agg(F.avg("y").alias("y"), F.max("treated").alias("tr"))
    p = windows.spread(p, ["user_id"], {"g": F.min(F.when(F.col("tr") == 1, F.col("t")))})
    return estimate.att_inference(p, "user_id", "t", "y", "g").select("g", "t", F.round("att", 7).alias("att"), F.round("se", 7).alias("se"), "treated", "controls")


_OWN = "case when p_partkey % 5 <> 0 then p_partkey // 7 end"
_AGREE = """case when x.own = a.own and x.own = b.own then 1 when x.own = a.own and b.own is null then 2 when a.own is null and x.own = b.own then 3 when x.own <> a.own and x.own = b.own then 4 when x.own = a.own and x.own <> b.own then 5
  when a.own = b.own and x.own <> b.own then 6 when a.own is null and x.own <> b.own then 7 when x.own <> a.own and b.own is null then 8 when x.own <> a.own and x.own <> b.own then 9 when a.own is null and b.own is null then 10 end"""


@query(f"""with p as (select *, {_OWN} as own from part), m as (select x.p_partkey as base, a.p_partkey as aid, b.p_partkey as bid, {_AGREE} as id_agreement, x.p_name, x.p_brand,
    row_number() over (partition by x.p_partkey order by case when a.own = x.own then 1 when a.own is null then 2 else 3 end, a.p_partkey, case when b.own = x.own then 1 when b.own is null then 2 else 3 end, b.p_partkey) as rn, count(*) over (partition by x.p_name, x.p_brand) as pairs_per_key
    from p x join p a using (p_name, p_brand) join p b using (p_name, p_brand) where x.p_size <= 25 and a.p_size between 10 and 40 and b.p_size > 20)
  select base, aid, bid, id_agreement::int as id_agreement, pairs_per_key from m where rn = 1""")
def link_three_best(t):
    p = t("part").withColumn("own", F.when(F.col("p_partkey") % 5 != 0, F.floor(F.col("p_partkey") / 7)))
    src = lambda c, k: p.filter(c).select(F.col("p_partkey").alias(k), "p_name", "p_brand", "own")
    out = linkage.link_three_best(src("p_size <= 25", "base"), src("p_size between 10 and 40", "aid"), src("p_size > 20", "bid"), ["p_name", "p_brand"], "base", "aid", "bid", "own")
    return out.select("base", "aid", "bid", "id_agreement", "pairs_per_key")


def _appended(t):
    """Orders come in two batches; the first is sent twice."""
    from pyspark.sql import types as T

    from ..sources.append import AppendTable

    spark, path = _at(t, "appended")
    table = AppendTable(spark, path, T.StructType().add("order_key", "long").add("priority", "integer").add("status", "string"))
    k = F.col("o_orderkey")
    raw = t("orders").select(k, F.when(k % 3 == 0, F.concat(F.lit("x"), k)).otherwise((k % 7).cast("string")).alias("prio"), F.col("o_orderstatus").alias("status"), (k % 4).cast("string").alias("src"))
    for batch in ("even", "odd", "even"):
        table.append(raw.filter(k % 2 == (0 if batch == "even" else 1)), batch, [("o_orderkey", "order_key"), ("prio", "priority")], ["order_key"], "src")
    return table


@query("""select row_number() over (order by o_orderkey % 2, o_orderkey) as id, o_orderkey as order_key, case when o_orderkey % 3 <> 0 then o_orderkey % 7 end::int as priority, o_orderstatus as status from orders""")
def append_serial(t):
    """Ids stay dense over appends, and a batch that is sent again adds nothing."""
    return _appended(t).read()


@query("""select case when o_orderkey % 2 = 0 then 'even' else 'odd' end as batch, (o_orderkey % 4)::varchar as file, 'priority' as "column", 'x' || o_orderkey as value from orders where o_orderkey % 3 = 0""")
def append_rejected(t):
    return _appended(t).rejected().drop("row")
