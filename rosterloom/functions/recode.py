"""Projection and recoding: columns by rule, dictionaries, scales, rule tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ordinal scales, as (pattern, code) in order.
_TIME = (r"nunca$", r"(^a veces$)|(^pocas veces$)|(^unas cuantas veces al ano)", r"(^frecuentemente$)|(^muchas veces)|(^unas cuantas veces al mes)", r"(siempre$)|(^una o mas veces por semana$)")
_RANK = (r"(^muy baja)|(^muy mal)|(^regular)|(menos de 10)", r"(^baja)|(^mal)|(^no muy bueno)|(entre 11 y 14)", r"(^alta)|(^bien)|(^muy bueno)|(entre 15 y 17)", r"(^muy alta)|(^muy bien)|(^excelente)|(entre 18 y 20)")
_AGREE = (r"^totalmente en desacuerdo$", r"^en desacuerdo$", r"^de acuerdo$", r"^totalmente de acuerdo$")
_UNKNOWN = r"(^ni de acuerdo ni en desacuerdo$)|(^nunca me han solicitado participar por este motivo$)|(^no conozco si se realiza esta actividad$)|(^no conozco sobre este aspecto$)"
_SATISFIED = (r"(^muy en desacuerdo$)|(^nada satisfecho$)", r"(^en desacuerdo$)|(^poco satisfecho$)", r"(^de acuerdo$)|(^satisfecho$)", r"(^muy de acuerdo$)|(^muy satisfecho$)")
_IMPORTANT = (r"^nada importante$", r"^poco importante$", r"^importante$", r"^muy importante$")
_LEVEL = (r"(^<.nivel.1)|(^previo.al.inicio)", r"(^en.inicio)|(^nivel.1)", r"(^en.proceso)|(^nivel.2)", r"(^satisfactorio)|(^nivel.3)")

SCALES: dict[str, tuple[tuple[str, int], ...]] = {
    "time": tuple((p, k) for k, p in enumerate(_TIME)),
    "time_reversed": tuple((p, 3 - k) for k, p in enumerate(_TIME)),
    "rank": tuple((p, k) for k, p in enumerate(_RANK)),
    "agreement": tuple((p, k) for k, p in enumerate(_AGREE)),
    "agreement_augmented": ((_UNKNOWN, -1), *((p, k) for k, p in enumerate(_SATISFIED))),
    "agreement_augmented_reversed": ((_UNKNOWN, -1), *((p, 3 - k) for k, p in enumerate(_SATISFIED))),
    "importance": tuple((p, k) for k, p in enumerate(_IMPORTANT)),
    "level": tuple((p, k) for k, p in enumerate(_LEVEL)),
}


#: Banded answers, as (pattern, number) in order.
EDUCATION_YEARS = (
    (r"^sin estudios$", 0), (r"^primaria incompleta$", 3), (r"^primaria completa$", 6), (r"^secundaria incompleta$", 8.5), (r"^secundaria completa$", 11),
    (r"^educacion ocupacional incompleta$", 7.5), (r"^educacion ocupacional completa$", 9), (r"^superior no universitaria incompleta$", 12.5),
    (r"^superior no universitaria completa$", 14), (r"^superior universitaria incompleta$", 13.5), (r"^superior universitaria completa$", 16), (r"^posgrado$", 19),
)
AGE_BANDS = (
    (r"(^menor o igual a 25 anos$)|(menos de 12 anos$)", 1), (r"(^de 26 a 35 anos$)|(12 anos$)", 2), (r"(^de 36 a 45 anos$)|(13 anos$)", 3),
    (r"(^de 46 a 55 anos$)|(14 anos$)", 4), (r"(^de 56 a 65 anos$)|(15 anos a mas$)", 5), (r"^mas de 65 anos$", 6),
)
INCOME_BANDS = (
    (r"^menos de 200 soles$", 1), (r"^de 201 a 500 soles$", 2), (r"^de 501 a 800 soles$", 3), (r"^de 801 a 1200 soles$", 4),
    (r"^de 1201 a 2000 soles$", 5), (r"^de 2001 a 5000 soles$", 6), (r"^de 5001 a 8000 soles$", 7), (r"^mas de 8000 soles$", 8),
)
BOOK_BANDS = (
    (r"(^ninguno$)|(^1$)", 0), (r"(^entre 1 y 5 libros$)|(^2$)", 1), (r"(^entre 6 y 10 libros$)|(^3$)", 2), (r"(^entre 11 y 20 libros$)|(^4$)", 3),
    (r"(^entre 21 y 50 libros$)|(^5$)", 4), (r"(^entre 51 y 100 libros$)|(^6$)", 5), (r"(^mas de 100 libros$)|(^7$)", 6),
)
TRAVEL_MINUTES = (
    (r"^menos de 15 minutos$", 7.5), (r"^entre 5 y 15 minutos$", 10), (r"(^entre 15 y 30 minutos$)|(^entre 16 y 30 minutos$)", 22.5), (r"(^entre 30 minutos y 1 hora$)|(^entre 31 minutos y 1 hora$)", 45),
    (r"^entre 1 y 2 horas$", 90), (r"(^entre 1 a 3 horas$)|(^mas de 2 horas$)", 120), (r"^entre 3 a 6 horas$", 270), (r"^mas de 6 horas$", 360),
)
TRANSPORT_KMH = (
    (r"(^a pie$)|(^animal de carga$)", 5), (r"(^auto o taxi$)|(^lancha o peque peque$)|(^moto o mototaxi$)|(^moto$)", 40), (r"^bicicleta$", 15),
    (r"(^bus o custer$)|(^camion$)|(^colectivo$)|(^combi o bus$)|(^transporte fluvial$)", 30),
)
#: Numeric codes of two questionnaires to quality ranks of walls, roofs and floors, and of education to years.
WALL_CODES = ({1: 1, 2: 2, 3: 3, 4: 2, 5: 2, 6: 4, 7: 5, 8: 1}, {1: 5, 2: 2, 3: 4, 4: 2, 5: 2, 6: 3, 7: 1, 8: 1})
ROOF_CODES = ({1: 4, 2: 2, 3: 1, 4: 3, 5: 4, 6: 4, 7: 6, 8: 5, 9: 7, 10: 1}, {1: 7, 2: 5, 3: 6, 4: 4, 5: 3, 6: 2, 7: 4, 8: 1})
FLOOR_CODES = ({1: 1, 2: 3, 3: 2, 4: 4, 5: 5, 6: 6, 7: 1}, {1: 6, 2: 5, 3: 4, 4: 3, 5: 2, 6: 1, 7: 1})
EDUCATION_CODES = {1: 0, 2: 3, 3: 6, 4: 11, 5: 14, 6: 16, 7: 19}


def select_matching(df: DataFrame, prefix: str | None = None, regex: str | None = None, any_of: Iterable[str] = (), kind: str | None = None, drop: bool = False) -> DataFrame:
    """Columns by name, prefix, regex, list (missing names are fine) or type; ``drop`` keeps the others."""
    listed = set(any_of)
    types = dict(df.dtypes)
    hit = [c for c in df.columns if (prefix and c.startswith(prefix)) or (regex and re.search(regex, c)) or c in listed or (kind and types[c] == kind)]
    return df.select([c for c in df.columns if (c in hit) != drop])


def rename_by_dictionary(df: DataFrame, aliases: Sequence[tuple[str, str]]) -> DataFrame:
    """Lower-case squished names, then whole-word replacements in order; equal results raise ``ValueError``."""
    names = []
    for c in df.columns:
        name = re.sub(r"\s+", " ", c.lower()).strip()
        for pattern, to in aliases:
            name = re.sub(rf"\b(?:{pattern})\b", to, name)
        names.append(name)
    if len(set(names)) < len(names):
        raise ValueError(f"names clash: {sorted({n for n in names if names.count(n) > 1})}")
    return df.toDF(*names)


def translate_values(c: Column, dictionary: Sequence[tuple[str, str]]) -> Column:
    """Whole values replaced by a dictionary, in sequence where one result is another's key."""
    keys = {k for k, _ in dictionary}
    if keys & {v for _, v in dictionary}:
        return reduce(lambda x, kv: F.when(x == kv[0], kv[1]).otherwise(x), dictionary, c)
    table = F.create_map(*[F.lit(x) for kv in dict(dictionary).items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), c)


def across(df: DataFrame, names: Iterable[str], fn: Callable[[Column], Column], suffix: str = "") -> DataFrame:
    return df.withColumns({n + suffix: fn(F.col(n)) for n in names})


def by_pattern(c: Column, cases: Sequence[tuple[str, object]]) -> Column:
    """The value of the first pattern found; null if none is."""
    out = None
    for pattern, value in cases:
        out = F.when(c.rlike(pattern), value) if out is None else out.when(c.rlike(pattern), value)
    return out


def dummify(df: DataFrame, column: str, name: str, true: str, false: str | None = None, drop: bool = False) -> DataFrame:
    """TRUE, FALSE or null by pattern; the table itself if the column is missing."""
    if column not in df.columns:
        return df
    df = df.withColumn(name, by_pattern(F.col(column), [(true, True), *([(false, False)] if false else [])]))
    return df.drop(column) if drop and name != column else df


def binarize(df: DataFrame, regex: str, true: str, false: str | None = None, else_false: bool = False) -> DataFrame:
    """``dummify`` over all matching columns; without a false pattern the rest is null, or FALSE by choice."""
    cases = [(true, True), *([(false, False)] if false else [])]
    fn = lambda c: F.coalesce(by_pattern(c, cases), F.when(c.isNotNull(), False)) if else_false else by_pattern(c, cases)
    return across(df, [c for c in df.columns if re.search(regex, c)], fn)


def orderize(df: DataFrame, regex: str, scale: str) -> DataFrame:
    return across(df, [c for c in df.columns if re.search(regex, c)], lambda c: by_pattern(c, SCALES[scale]))


def codify_level(c: Column) -> Column:
    return by_pattern(c, SCALES["level"])


def recode_midpoint(c: Column, bands: Sequence[tuple[str, float]]) -> Column:
    """Banded answers to a number."""
    return by_pattern(c, [(p, float(v)) for p, v in bands])


def recode_codes(c: Column, codes: Mapping[int, int]) -> Column:
    """Codes to ranks; an unknown code gives null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), c.cast("int"))


def interval_pairs(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, also: Column | None = None) -> DataFrame:
    """The points with the intervals that hold them (both ends included), and for which ``also`` holds.

    An interval is cut into bins as wide as itself, rounded up to a power of two,
    so it lies in two at most (three by rounding), and a point looks into one
    bin of each width that occurs: an equal join, no table is broadcast for its
    sake.  Endless intervals have one bin for all.
    """
    length = F.col(high).cast("double") - F.col(low).cast("double")
    endless = length == F.lit(float("inf"))
    level = F.when(endless, F.lit(9999)).when(length > 1e-300, F.ceil(F.log2(length))).otherwise(F.lit(-9999)).cast("int")
    # a width for each level; points of single values have bins of their own
    cell = lambda x, lev: F.when(lev == 9999, F.lit("all")).when(lev == -9999, x.cast("double").cast("string")).otherwise(F.floor(x.cast("double") / F.pow(F.lit(2.0), lev)).cast("string"))
    rules = intervals.filter(F.col(low) <= F.col(high)).withColumn("_level", level)
    levels = sorted(r[0] for r in rules.select("_level").distinct().collect())  # powers of two: a few dozen
    inner = F.col("_level").between(-9998, 9998)
    first, last = (F.floor(F.col(c).cast("double") / F.pow(F.lit(2.0), F.col("_level"))) for c in (low, high))
    cells = F.when(inner, F.transform(F.sequence(first, last), lambda b: b.cast("string"))).otherwise(F.array(cell(F.col(low), F.col("_level"))))
    rules = rules.withColumn("_cell", F.explode(cells))
    probes = points.withColumn("_look", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
    probes = probes.withColumn("_in", cell(F.col(at), F.col("_look")))
    met = probes.join(rules, (F.col("_look") == F.col("_level")) & (F.col("_in") == F.col("_cell")) & F.col(at).between(F.col(low), F.col(high)) & (also if also is not None else F.lit(True)))
    return met.drop("_look", "_in", "_level", "_cell")


def rule_recode(df: DataFrame, rules: DataFrame, year: str, form: str, code: str, out: str = "label") -> DataFrame:
    """Labels by rules (year_lo, year_hi, form, code_lo, code_hi, priority, label); unmatched rows go.

    The least priority wins (of equal ones the least label), decided per
    distinct (year, form, code).  Rules of any number are met by ``interval_pairs``.
    """
    keys = df.select(F.col(year).alias("_y"), F.col(form).alias("_f"), F.col(code).alias("_c")).distinct()
    hit = interval_pairs(keys, rules, "_c", "code_lo", "code_hi", F.col("_f") == F.col("form")).filter(F.col("_y").between(F.col("year_lo"), F.col("year_hi")))
    best = hit.groupBy("_y", "_f", "_c").agg(F.min_by("label", F.struct("priority", "label")).alias(out))
    return df.join(best, (df[year] == best["_y"]) & (df[form] == best["_f"]) & (df[code] == best["_c"])).drop("_y", "_f", "_c")


def drop_null(df: DataFrame, *names: str) -> DataFrame:
    return df.dropna(subset=list(names) or None)


def row_reduce(names: Sequence[str], how: str) -> Column:
    """Across the columns of a row, nulls left out: sum, mean, max, min or any."""
    cols = [F.col(n) for n in names]
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])
    held = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return {
        "sum": lambda: total,
        "mean": lambda: F.when(held > 0, total / held),
        "max": lambda: F.greatest(*cols) if len(cols) > 1 else cols[0],
        "min": lambda: F.least(*cols) if len(cols) > 1 else cols[0],
        "any": lambda: F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(c.cast("boolean"), F.lit(False)) for c in cols]), F.lit(False)),
    }[how]()


def bin_values(c: Column, breaks: Sequence[float], labels: Sequence | None = None, right: bool = False, include_lowest: bool = False) -> Column:
    """Bins [a, b) or, with ``right``, (a, b]; ``include_lowest`` closes the outer end."""
    labels = list(range(1, len(breaks))) if labels is None else labels
    out = None
    for k, (a, b) in enumerate(zip(breaks, breaks[1:], strict=False)):
        hit = (c > a) & (c <= b) if right else (c >= a) & (c < b)
        if include_lowest and right and k == 0:
            hit |= c == a
        if include_lowest and not right and k == len(breaks) - 2:
            hit |= c == b
        out = F.when(hit, labels[k]) if out is None else out.when(hit, labels[k])
    return out


def combine_levels(*names: str, sep: str = ".") -> Column:
    """Interaction of two or more categories; null if one is null."""
    return reduce(lambda a, b: F.concat(a, F.lit(sep), b), [F.col(n).cast("string") for n in names])


def recode_levels(c: Column, mapping: Mapping[str, str]) -> Column:
    return translate_values(c, list(mapping.items()))


def relevel(c: Column, order: Sequence[str]) -> Column:
    """The place of a level in an order; levels not in it come last."""
    return F.when(c.isNull(), None).otherwise(F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), c), F.lit(0)), F.lit(len(order) + 1)))


def patch_rows(df: DataFrame, updates: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Overwrite the columns of matching rows (``updates`` has one row per key) where the update isn't null."""
    keys = [key] if isinstance(key, str) else list(key)
    changed = [c for c in updates.columns if c not in keys]
    new = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in changed])
    joined = df.join(new, keys, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in df.columns])


def update_where(df: DataFrame, cond: Column, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({n: F.when(cond, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(n)) for n, v in values.items()})


def delete_where(df: DataFrame, cond: Column) -> DataFrame:
    """Rows where the condition is not true (so null keeps the row, as SQL's delete does)."""
    return df.filter(~F.coalesce(cond, F.lit(False)))


def conflict_pick(a: Column, b: Column, conflict=6) -> Column:
    """Equal: that; one null: the other; both and different: ``conflict``."""
    return F.when(a == b, a).when(a.isNull(), b).when(b.isNull(), a).otherwise(conflict)


def merge_flags(a: Column, b: Column) -> Column:
    """OR of two answers; null only if both are null."""
    return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)))


def reorder(df: DataFrame, first: Sequence[str], strip_prefix: str | None = None) -> DataFrame:
    names = [*first, *[c for c in df.columns if c not in first]]
    return df.select(*[F.col(c).alias(c.removeprefix(strip_prefix) if strip_prefix else c) for c in names])


def any_positive(*names: str) -> Column:
    """1 if the sum of the indicators is over 0; null if one is null."""
    return (reduce(lambda a, b: a + b, [F.col(n) for n in names]) > 0).cast("int")
