"""Record linkage: registries, candidate links, graded agreement, cascades."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import calendar_diff_code
from .graph import materialised
from .windows import by_group_size, first_row


#: Rows of base and of ``a`` whose links ``link_three`` makes in one task.
CELL = 256

#: Takes the joined rows of both sides and keeps those that are links.
Accept = Callable[[DataFrame], DataFrame]


def dedupe_exact(df: DataFrame, keys: Sequence[str], prefer: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the preference order."""
    return first_row(df, keys, prefer)


def yearly_registry(df: DataFrame, person: str, year: str, order: Sequence[Column], valid: Column) -> DataFrame:
    """Per person and year the first record, with ``transfers`` (its other records); the first must itself be valid."""
    w = Window.partitionBy(person, year)
    ranked = df.withColumns({"transfers": F.count(F.lit(1)).over(w) - 1, "_rn": F.row_number().over(w.orderBy(*order))})
    return ranked.filter((F.col("_rn") == 1) & valid).drop("_rn")


def presence_panel(df: DataFrame, person: str, year: str, years: Sequence[int]) -> DataFrame:
    """Per person whether it is there in each year, in all of them and in each adjacent pair: one aggregate, no joins."""
    flags = {y: F.coalesce(F.bool_or(F.col(year) == y), F.lit(False)) for y in years}
    out = df.groupBy(person).agg(*[f.alias(f"in_{y}") for y, f in flags.items()])
    out = out.withColumn("in_all", reduce(lambda a, b: a & b, [F.col(f"in_{y}") for y in years]))
    return out.withColumns({f"in_{a}_{b}": F.col(f"in_{a}") & F.col(f"in_{b}") for a, b in zip(years, years[1:], strict=False)})


def unique_population(df: DataFrame, id_: str, names: Sequence[str], composite: Sequence[str]) -> DataFrame:
    """Ids held once, no null name, other holders of the names (``homonyms``), unique on the composite key."""
    once = by_group_size(df, [id_]).dropna(subset=list(names))
    counted = once.withColumn("homonyms", F.count(F.lit(1)).over(Window.partitionBy(*names)) - 1)
    return by_group_size(counted, composite)


def homonym_profile(df: DataFrame, names: Sequence[str], grains: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Other holders of the names at nested grains, widest first: (label, extra keys).

    All windows are partitioned by the names first, so the rows are shuffled
    once by the widest grain.
    """
    return df.withColumns({f"homonyms_{label}": F.count(F.lit(1)).over(Window.partitionBy(*names, *extra)) - 1 for label, extra in grains})


def link_pairs(base: DataFrame, other: DataFrame, keys: Sequence[str], base_id: str, other_id: str, carry: Sequence[str] = ()) -> DataFrame:
    """Candidate pairs on equal keys with the partners of each side."""
    out = base.select(base_id, *keys).join(other.select(other_id, *keys, *carry), list(keys))
    return out.withColumns({
        "partners": F.count(F.lit(1)).over(Window.partitionBy(base_id)),
        "other_partners": F.count(F.lit(1)).over(Window.partitionBy(other_id)),
    })


def common_keys(base: DataFrame, a: DataFrame, b: DataFrame, keys: Sequence[str], most_pairs: int) -> DataFrame:
    """(keys, pairs): the keys of which ``link_three`` would make more than ``most_pairs`` rows, counted without making them."""
    counts = [t.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_n{k}")) for k, t in enumerate((base, a, b))]
    joined = counts[0].join(counts[1], list(keys)).join(counts[2], list(keys))
    return joined.select(*keys, (F.col("_n0") * F.col("_n1") * F.col("_n2")).alias("pairs")).filter(F.col("pairs") > most_pairs)


def link_three(base: DataFrame, a: DataFrame, b: DataFrame, keys: Sequence[str], base_id: str, a_id: str, b_id: str, most_pairs: int | None = None) -> DataFrame:
    """Base linked with two sources on the same keys, then both on the base id.

    ``pairs_per_key`` tells how far a common key blows up.  By default no key is
    left out; ``most_pairs`` leaves out those that ``common_keys`` lists.

    The last join makes the rows, and nothing moves or sorts them after it:
    ``pairs_per_key`` is counted from the members of each key.  The rows of a
    common key are made in cells of ``CELL`` by ``CELL`` rows of base and ``a``,
    spread over tasks.
    """
    keys = list(keys)
    known = lambda t, names: t.filter(reduce(lambda p, q: p & q, [F.col(n).isNotNull() for n in names]))
    if most_pairs is not None:
        base = base.join(common_keys(base, a, b, keys, most_pairs), keys, "left_anti")
    a, b = known(a.select(a_id, *keys), keys), known(b.select(b_id, *keys), keys)
    rows = known(base, [base_id, *keys]).groupBy(base_id, *keys).agg(F.count(F.lit(1)).alias("_times"))
    n_a, n_b = (t.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for t, n in ((a, "_n_a"), (b, "_n_b")))
    links = rows.join(n_b, keys, "left").groupBy(base_id).agg(F.sum(F.col("_times") * F.col("_n_b")).alias("_links"), F.count(F.lit(1)).alias("_sets"))
    rows = rows.join(links, base_id)
    cells = lambda n: F.ceil(F.col(n) / CELL).cast("int")
    facts = rows.join(n_a, keys).groupBy(*keys).agg(F.sum(F.col("_times") * F.col("_n_a") * F.col("_links")).alias("pairs_per_key"), F.count(F.lit(1)).alias("_n_base"), F.max("_n_a").alias("_n_a"))
    facts = facts.filter("pairs_per_key > 0").select(*keys, "pairs_per_key", cells("_n_base").alias("_is"), cells("_n_a").alias("_js"))
    copied = lambda t, n: t.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), n.cast("int")))).drop("_copy")
    one = lambda i, n: F.pmod(F.xxhash64(i), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # rows are few and links many, so they are spread by number, not by size
    tasks, cell = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*keys, "_i", "_j"]
    placed = lambda t, i, j: t.withColumn("_i", i).withColumn("_j", j).drop("_is", "_js").repartition(tasks, *cell)
    single = copied(rows.filter("_sets = 1").join(facts, keys), F.col("_times") * F.col("_times")).select(base_id, *keys, "pairs_per_key", "_is", "_js")
    sides = placed(single, one(base_id, "_is"), every("_js")), *[placed(t.join(facts.drop("pairs_per_key"), keys), every("_is"), j) for t, j in ((a, one(a_id, "_js")), (b, every("_js")))]
    names = [base_id, a_id, *keys, b_id, "pairs_per_key"]
    out = sides[0].join(sides[1], cell).join(sides[2], cell).select(*names)
    # an id that stands on several keys links the partners of one with those of another
    several = rows.filter("_sets > 1").select(base_id, *keys, "_times")
    y = several.join(b, keys).select(base_id, b_id, F.col("_times").alias("_times2"))
    x = several.join(facts.select(*keys, "pairs_per_key"), keys).join(a, keys)
    return out.unionByName(copied(x.join(y, base_id), F.col("_times") * F.col("_times2")).select(*names))


def link_three_counts(base: DataFrame, a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_base, n_a, n_b, pairs): the members of each key of all three sources, and the rows that ``link_three`` would make of it."""
    counts = [t.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for n, t in (("n_base", base), ("n_a", a), ("n_b", b))]
    return counts[0].join(counts[1], list(keys)).join(counts[2], list(keys)).withColumn("pairs", F.col("n_base") * F.col("n_a") * F.col("n_b"))


def link_three_best(base: DataFrame, a: DataFrame, b: DataFrame, keys: Sequence[str], base_id: str, a_id: str, b_id: str, own: str) -> DataFrame:
    """The best candidate of each base row in both sources, without the rows of ``link_three``.

    All three tables have ``keys`` and the id ``own``.  In each source a candidate
    with the base row's own id comes first, then one without, then another; ties
    by its row id.  That needs the least row of each (key, own id), of each key
    without an own id and of each key: three equal joins, and a result with a
    row per base row.  ``id_agreement`` is ``agreement_id3``; ``pairs_per_key`` and
    the members of the key are counted, not made.
    """
    out = base.select(base_id, *keys, F.col(own).alias("_own")).join(link_three_counts(base, a, b, keys), list(keys))
    for side, (t, i) in (("a", (a, a_id)), ("b", (b, b_id))):
        rows = t.dropna(subset=list(keys)).select(*keys, F.col(own).alias("_other"), F.col(i).alias("_id"))
        equal = rows.filter("_other is not null").groupBy(*keys, F.col("_other").alias("_own")).agg(F.min("_id").alias("_equal"))
        rest = rows.groupBy(*keys).agg(F.min(F.when(F.col("_other").isNull(), F.col("_id"))).alias("_none"), F.min_by(F.struct("_id", "_other"), F.when(F.col("_other").isNotNull(), F.col("_id"))).alias("_any"))
        out = out.join(equal, [*keys, "_own"], "left").join(rest, list(keys), "left")
        found = F.when(F.col("_equal").isNotNull(), F.struct(F.col("_equal").alias("_id"), F.col("_own").alias("_other"))).when(F.col("_none").isNotNull(), F.struct(F.col("_none").alias("_id"), F.lit(None).cast(base.schema[own].dataType).alias("_other"))).otherwise(F.col("_any"))
        out = out.withColumn("_hit", found).withColumns({i: F.col("_hit._id"), f"_{side}": F.col("_hit._other")}).drop("_equal", "_none", "_any", "_hit")
    agreement = agreement_id3(F.col("_own"), F.col("_a"), F.col("_b"))
    return out.select(base_id, *keys, a_id, b_id, agreement.alias("id_agreement"), "n_base", "n_a", "n_b", F.col("pairs").alias("pairs_per_key"))


def agreement_date(a: Column, b: Column) -> Column:
    """1 equal, 2 one unit later, 3 one unit earlier, 4 different, 5 the other missing; null if the own date is missing."""
    d = calendar_diff_code(a, b)
    return F.when(a == b, 1).when((a != b) & (d == 2), 2).when((a != b) & (d == -2), 3).when(a != b, 4).when(b.isNull(), 5)


def agreement_simple(a: Column, b: Column) -> Column:
    """1 equal, 2 different, 3 one of them missing."""
    return F.when(a == b, 1).when(a != b, 2).otherwise(3)


#: The agreements of an id with two other sources, 1 to 10 in the order of ``cases``.
def agreement_id3(own: Column, a: Column, b: Column) -> Column:
    """How an id agrees with two other sources, 1 (all agree) to 10 (both missing)."""
    cases = [
        (own == a) & (own == b), (own == a) & b.isNull(), a.isNull() & (own == b), (own != a) & (own == b), (own == a) & (own != b),
        (a == b) & (own != b), a.isNull() & (own != b), (own != a) & b.isNull(), (own != a) & (own != b), a.isNull() & b.isNull(),
    ]
    return F.coalesce(*[F.when(c, k) for k, c in enumerate(cases, 1)])


def agreement_id2(own: Column, other: Column) -> Column:
    """1 equal, 2 different, 3 the other missing."""
    return F.when(own == other, 1).when(own != other, 2).when(other.isNull(), 3)


#: The levels 1 to 6 in the order of ``rules``.
def confidence_level(ids: Column, dates: Column, homonyms: Column, homonyms_a: Column, homonyms_b: Column, homonyms_test: Column, id_b: Column) -> Column:
    """1 (a single full match) to 6, or null, from the agreements and the homonyms of each source."""
    rules = [
        (homonyms_b == 0) & (homonyms_a == 0) & (homonyms == 0),
        ids == 1,
        (ids == 2) & (homonyms_b == 0),
        id_b.isNull() & (homonyms_test == 0) & (homonyms_a == 0) & (homonyms == 0),
        ids.between(3, 4) & (dates == 1),
        (ids == 10) & (dates == 1) & (homonyms_b == 0),
    ]
    return F.coalesce(*[F.when(r, k) for k, r in enumerate(rules, 1)])


#: What an agreement of ids (first) and of dates (from, to; any where None) adds to a level.
LEVEL_STEPS = (
    (1, None, 0), (2, (2, 3), 2), (2, (4, 5), 3), (3, None, 0), (4, (1, 3), 3), (4, (4, 5), 4),
    (5, (1, 1), 4), (5, (2, 3), 5), (5, (4, 5), 6), (6, None, 2),
)


def added_level(level: Column, ids: Column, dates: Column, steps=LEVEL_STEPS) -> Column:
    """A level raised by the agreements of id and date; null where no step fits."""
    return F.coalesce(*[F.when((ids == i) & (dates.between(*between) if between else F.lit(True)), level + more) for i, between, more in steps])


def best_candidate(df: DataFrame, id_: str, order: Sequence[Column], accept: Column) -> DataFrame:
    """The best-ranked candidate per id, then the accept rule."""
    return first_row(df, [id_], order, accept)


@dataclass(frozen=True)
class Nearest:
    """A rule of ``cascade``: a pair is linked if each is the other's nearest by a number, the least id of equals."""

    value: str
    other_value: str


def nearest_partners(x: DataFrame, y: DataFrame, keys: Sequence[str], x_id: str, y_id: str, value: str, other_value: str) -> DataFrame:
    """(x id, y id, _far): for each x id its nearest y of its keys, ties by the least y id; no pairs are made.

    The nearest of a value is the next lower or equal one or the next higher
    one, so each distinct (keys, value) is placed between the others' distinct
    values of its keys, with the least id of each.  (A key's distinct values, not
    its rows, are sorted in one task.)  Whole numbers are compared
    exactly; of floats whose distances round to the same the nearer one counts.
    Rows without a key or value are nobody's partner.
    """
    keys = list(keys)
    asked = x.select(*keys, F.col(value).alias("_v")).filter("_v is not null").distinct()
    given = y.filter(F.col(other_value).isNotNull()).groupBy(*keys, F.col(other_value).alias("_v")).agg(F.min(y_id).alias("_id"))
    both = asked.withColumn("_own", F.lit(None).cast(given.schema["_id"].dataType)).unionByName(given.withColumnRenamed("_id", "_own"))
    both = both.groupBy(*keys, "_v").agg(F.max("_own").alias("_own"))
    w = Window.partitionBy(*keys).orderBy("_v")
    held = F.when(F.col("_own").isNotNull(), F.struct(F.col("_v").alias("v"), F.col("_own").alias("id")))
    low = F.last(held, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    high = F.first(held, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    far = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("_v") - F.col(f"{c}.v")).alias("far"), F.col(f"{c}.id").alias("id")))
    near = both.withColumns({"_low": low, "_high": high}).select(*keys, F.col("_v").alias(value), F.least(far("_low"), far("_high")).alias("_near")).filter("_near is not null")
    # an id that stands in several rows takes the nearest of all of them
    return x.select(x_id, *keys, value).join(near, [*keys, value]).groupBy(x_id).agg(F.min("_near").alias("_near")).select(x_id, F.col("_near.id").alias(y_id), F.col("_near.far").alias("_far"))


def cascade(base: DataFrame, other: DataFrame, base_id: str, other_id: str, stages: Sequence[Sequence[str]], accept: Accept | Nearest | Sequence[Accept | Nearest | None] | None = None) -> DataFrame:
    """Links by ever looser keys: (base id, other id, filter_stage).

    Each stage takes only ids that no earlier one linked, and links keys that
    are unique on both sides, or the rows of the joined sides that ``accept``
    keeps: one rule for all stages, or one (or None) for each.  A rule that takes
    joined rows makes all pairs of a key; ``Nearest`` makes none.  Results are
    written stage by stage.
    """
    rules = list(accept) if isinstance(accept, (list, tuple)) else [accept] * len(stages)
    done: DataFrame | None = None
    for k, keys in enumerate(stages, 1):
        x, y = base, other
        if done is not None:
            x, y = x.join(done.select(base_id), base_id, "left_anti"), y.join(done.select(other_id), other_id, "left_anti")
        x, y = x.dropna(subset=list(keys)), y.dropna(subset=list(keys))
        rule = rules[k - 1]
        if isinstance(rule, Nearest):
            ways = nearest_partners(x, y, keys, base_id, other_id, rule.value, rule.other_value), nearest_partners(y, x, keys, other_id, base_id, rule.other_value, rule.value)
            pairs = ways[0].join(ways[1], [base_id, other_id])
        else:
            pairs = rule(x.join(y, list(keys))) if rule else by_group_size(x, keys).select(base_id, *keys).join(by_group_size(y, keys).select(other_id, *keys), list(keys))
        found = pairs.select(base_id, other_id, F.lit(k).alias("filter_stage"))
        done = materialised(found if done is None else done.unionByName(found), f"cascade-{k}")
    return done


def id_swap(own: Column, agreement: Column, other: Column) -> Column:
    """The others' id where both agree against the own one (code 6)."""
    return F.when(agreement == 6, other).otherwise(own)


def fallback_link(base: DataFrame, other: DataFrame, base_id: str, other_id: str, keysets: Sequence[Sequence[str]]) -> DataFrame:
    """(base id, other id, priority): the partner by the first key set that has one, the least id of equals.

    Each key set contributes the least partner of its key, so nothing multiplies.
    """
    found = None
    for p, keys in enumerate(keysets, 1):
        ref = other.dropna(subset=list(keys)).groupBy(*keys).agg(F.min(other_id).alias(other_id))
        hit = base.dropna(subset=list(keys)).select(base_id, *keys).join(ref, list(keys)).select(base_id, other_id, F.lit(p).alias("priority"))
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy(base_id).agg(F.min(F.struct("priority", other_id)).alias("b"))
    return best.select(base_id, f"b.{other_id}", "b.priority")


def split_single_multiple(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    return by_group_size(df, keys), by_group_size(df, keys, keep=False)


def null_conflicts(df: DataFrame, person: Sequence[str], id_: str, date: str) -> DataFrame:
    """Different ids of one person make the id null; different dates of one person and id make the date null; then distinct."""
    own = {p: f"_p{k}" for k, p in enumerate(person)}
    ids = df.groupBy(*[F.col(p).alias(q) for p, q in own.items()]).agg((F.count_distinct(id_) > 1).alias("_clash"))
    cond = [F.col(p).eqNullSafe(F.col(q)) for p, q in own.items()]
    step = df.join(ids, cond).withColumn(id_, F.when(~F.col("_clash"), F.col(id_))).select(*df.columns)
    keys = [*person, id_]
    w = Window.partitionBy(*keys)
    spread = step.withColumns({"_lo": F.min(date).over(w), "_hi": F.max(date).over(w)})
    return spread.withColumn(date, F.when(F.col("_lo") == F.col("_hi"), F.col(date))).drop("_lo", "_hi").distinct()


def missingness_part(df: DataFrame, id_: str, date: str, out: str = "part") -> DataFrame:
    """Which of id and date are known: both, id, date or none, as a column for one pass."""
    a, b = F.col(id_).isNotNull(), F.col(date).isNotNull()
    return df.withColumn(out, F.when(a & b, "both").when(a, "id").when(b, "date").otherwise("none"))


def registry_to_panel(links: DataFrame, registry: DataFrame, schools: DataFrame, person: str, school: str) -> DataFrame:
    """The yearly records of linked persons in known schools."""
    return registry.join(links, person).join(schools.select(school).distinct(), school, "left_semi")
