"""Scalar functions: Column to Column, all inside whole-stage code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value.
NULL_TOKENS = ("", "#null!", "\\.")
#: Fixed value: the number that stands for a missing id.
MISSING_ID = 99999999


def _latin() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by Unicode decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()] + [("ø", "o"), ("Ø", "O"), ("ł", "l"), ("Ł", "L"), ("đ", "d"), ("Đ", "D"), ("ı", "i")]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _latin()


def to_ascii(c: Column) -> Column:
    """Latin letters without accents; ß, æ and œ become two letters."""
    for a, b in (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("þ", "th"), ("Þ", "TH")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, _ACCENTED, _PLAIN)


def squish(c: Column) -> Column:
    """One space between words, none outside."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_text(c: Column, tokens=NULL_TOKENS, strict: bool = False) -> Column:
    """Null tokens to null, lower case, squished, without punctuation (Unicode class P), in ASCII.

    Spaces beside removed punctuation stay and a lone sign gives "" unless
    ``strict``.
    """
    out = to_ascii(F.regexp_replace(squish(F.lower(c)), r"\p{P}", ""))
    if strict:
        out = F.nullif(squish(out), F.lit(""))
    return F.when(~c.isin(*tokens), out)


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def remove_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\d", "")


def title(c: Column) -> Column:
    return F.initcap(c)


def pad_left(c: Column, width: int, fill: str = "0") -> Column:
    """Pad, never cut."""
    s = c.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, fill))


def concat_optional(first: Column, second: Column, sep: str = " ") -> Column:
    """The first value, followed by the second where there is one."""
    return F.when(second.isNull(), first).otherwise(F.concat(first, F.lit(sep), second))


def safe_int(c: Column) -> Column:
    """Integer part of a number or of text; null if it isn't one or doesn't fit."""
    return c.cast("string").try_cast("double").try_cast("int")


def safe_long(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(s.try_cast("bigint"), s.try_cast("double").try_cast("bigint"))


def safe_double(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def digits_to_int(c: Column, missing: int = MISSING_ID) -> Column:
    """Letters and spaces go; the missing id becomes null."""
    return F.nullif(safe_int(F.regexp_replace(c, r"[\p{L}\s]", "")), F.lit(missing))


def missing_codes(c: Column, codes=(-1, 0)) -> Column:
    return F.when(~c.isin(*codes), c)


def above(c: Column, least) -> Column:
    """Null under a threshold (an id with too few digits)."""
    return F.when(c >= least, c)


def year_within(c: Column, first: int = 1916, last: int = 2015) -> Column:
    return F.when(F.year(c).between(first, last), c)


def name_key(*parts: Column) -> Column:
    """Phonetic key of the sorted name parts without spaces."""
    joined = F.array_join(F.array_sort(F.array(*[F.coalesce(p, F.lit("")) for p in parts])), "")
    return F.soundex(F.replace(joined, F.lit(" "), F.lit("")))


#: Metaphone as rewriting steps, in order: letters not yet read are upper case, sounds written are lower case or 0.
#: No step looks back or ahead, so any regular-expression engine can run them.
METAPHONE = (
    ("^AE", "E"), ("^[GKP]N", "N"), ("^WR", "R"), ("^WH", "W"), ("^X", "s"), ("MB$", "M"),
    ("SCH", "SK"), ("TCH", "x"), ("CIA", "xIA"), ("CH", "x"), ("SC([EIY])", r"s\1"), ("C([EIY])", r"s\1"), ("CK", "K"), ("C", "k"),
    ("DG([EIY])", r"j\1"), ("D", "t"), ("GG+", "k"),
    ("GH([AEIOU])", r"k\1"), ("GH$", "k"), ("GH", ""), ("G(N|NEt)$", r"\1"), ("G([EIY])", r"j\1"), ("G", "k"),
    ("TI([AO])", r"xI\1"), ("TH", "0"), ("T", "t"), ("SI([AO])", r"xI\1"), ("SH", "x"), ("S", "s"), ("PH", "f"), ("P", "p"),
    ("H([AEIOU])", r"h\1"), ("H", ""), ("W([AEIOU])", r"w\1"), ("Y([AEIOU])", r"y\1"), ("[WY]", ""),
    ("[KQ]", "k"), ("V", "f"), ("X", "ks"), ("Z", "s"), ("(.)[AEIOU]+", r"\1"),
)


def metaphone(c: Column) -> Column:
    """Metaphone key of a name: accents are folded, all but letters goes, letters repeated (but C and G) count once.

    ``H`` sounds only before a vowel, ``0`` is the sound of ``TH``, and vowels
    stand at the beginning only.  Null stays null; a text without a letter
    gives an empty key.
    """
    out = F.regexp_replace(F.regexp_replace(F.upper(to_ascii(c)), "[^A-Z]", ""), r"([ABD-FH-Z])\1+", "$1")
    for pattern, sound in METAPHONE:
        out = F.regexp_replace(out, pattern, sound.replace("\\", "$"))
    return F.upper(out)


def metaphone_key(*parts: Column) -> Column:
    """``metaphone`` of the sorted name parts; missing parts count as empty."""
    return metaphone(F.array_join(F.array_sort(F.array(*[F.coalesce(p, F.lit("")) for p in parts])), ""))


def area_code(place: Column, digits: int = 6) -> Column:
    """The leading digits of a place id of 9 or 10 digits, padded to 10."""
    return F.substring(pad_left(place, 10), 1, digits)


def local_code(place: Column) -> Column:
    """The last 4 digits of a place id."""
    return F.right(pad_left(place, 10), F.lit(4))


#: Repairs of date texts, applied one after the other.
DATE_REPAIRS = (
    (r"(?i)dd-mm", "01-01"),
    (r"31-11-2013", "30-11-2013"),
    (r"-013$", "-2013"),
    (r"^91-", "01-"),
    (r"-197$", "-1997"),
    (r"-0002$", "-2000"),
    (r"-0206", "-2006"),
    (r"-20[2-9](.)$", "-200$1"),
    (r"-1[0-7](..)$", "-19$1"),
)


def repair_date(c: Column, repairs=DATE_REPAIRS, pattern: str = "dd-MM-yyyy") -> Column:
    for rx, to in repairs:
        c = F.regexp_replace(c, rx, to)
    return F.try_to_timestamp(c, F.lit(pattern)).cast("date")


def date_from_parts(year: Column, month: Column, day: Column, last_year: int = 2013) -> Column:
    """Month and day clamped to 1-12 and 1-31; an impossible day gives the last of the month; late years null."""
    m = F.least(F.greatest(month, F.lit(1)), F.lit(12)).cast("int")
    d = F.least(F.greatest(day, F.lit(1)), F.lit(31)).cast("int")
    first = F.when((year >= 1) & (year <= last_year), F.make_date(year.cast("int"), m, F.lit(1)))
    return F.least(F.date_add(first, d - 1), F.last_day(first))


def nearest_year(c: Column) -> Column:
    """The year a date rounds to: from 1 July on the next one."""
    return F.year(F.add_months(c, 6))


def entry_cohort(birth: Column, age: int = 5, last_month: int = 3) -> Column:
    """Year of school entry: those born by the end of March enter at ``age``, others a year later."""
    return F.year(birth) + F.when(F.month(birth) <= last_month, age).otherwise(age + 1)


def opening_year(survey_year: Column, years: Column, months: Column) -> Column:
    """The year a place opened, from its age: over half a year of months counts as one."""
    return F.when(years.isNull() & months.isNull(), None).otherwise(survey_year - F.coalesce(years, F.lit(0)) - F.when(F.coalesce(months, F.lit(0)) > 6, 1).otherwise(0))


def travel_seconds(days: Column, hours: Column, minutes: Column, cap_days: float = 8 / 24) -> Column:
    """Seconds of a journey; days (of travel) are capped value by value."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    total = F.least(zero(days), F.lit(cap_days)) * 86400 + zero(hours) * 3600 + zero(minutes) * 60
    return F.when(days.isNull() & hours.isNull() & minutes.isNull(), None).otherwise(total)


def speed_distance(minutes: Column, kmh: Column) -> Column:
    return minutes / 60 * kmh


def calendar_diff_code(a: Column, b: Column) -> Column:
    """1 same day; 2 exactly a year, month or day later; -2 earlier; 3 otherwise; null dates give 3."""

    def exactly(x: Column, y: Column) -> Column:
        same_day = F.day(x) == F.day(y)
        return ((F.add_months(x, 12) == y) & same_day) | ((F.add_months(x, 1) == y) & same_day) | (F.date_add(x, 1) == y)

    return F.when(a == b, 1).when(exactly(a, b), 2).when(exactly(b, a), -2).otherwise(3)


def standard_score(c: Column, mean: float = 500.0, sd: float = 100.0) -> Column:
    return (c - mean) / sd


def nan_to(c: Column, value: float = 0.0) -> Column:
    return F.when(F.isnan(c), value).otherwise(c)


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def if_else(cond: Column, yes, no, missing=None) -> Column:
    return F.when(cond, yes).when(~cond, no).otherwise(missing)
