"""Panels and household features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.recode import any_positive
from .aggs import mode
from .reshape import complete, wider
from .windows import changes, fill, spread


def household_features(df: DataFrame, household: str, birth: str, child: Column, welfare: Sequence[str], health: Sequence[str]) -> DataFrame:
    """Programme flags, number of children, and whether a row is the household's first-born child."""
    born = F.when(child, F.col(birth))
    out = spread(df, [household], {"children": F.count_if(child), "_first": F.min(born)})
    return out.withColumns({"welfare": any_positive(*welfare), "healthcare": any_positive(*health), "first_born": child & (F.col(birth) == F.col("_first"))}).drop("_first")


def clean_person_tests(df: DataFrame, person: str, test: str, test_year: str, birth_year: str, usual_age: Column, order: Sequence[Column], lo: int = 2, hi: int = 3) -> DataFrame:
    """Age gap of each test, its consistency, the corrected entry year; the first record of a person and test, or gaps of ``lo`` to ``hi``."""
    gap = df.withColumn("age_gap", F.col(test_year) - F.col(birth_year) - usual_age)
    graded = gap.withColumns({"inconsistent": F.abs("age_gap") > hi, "entry_year": F.col(birth_year) + F.least(F.greatest("age_gap", F.lit(0)), F.lit(hi)) + 6})
    rn = F.row_number().over(Window.partitionBy(person, test).orderBy(*order))
    return graded.withColumn("_rn", rn).filter((F.col("_rn") == 1) | F.col("age_gap").between(lo, hi)).drop("_rn")


def supply_panel(sites: DataFrame, cluster: str, site: str, level: str, year: str, opens: str, closes: str, levels: Sequence[str]) -> DataFrame:
    """Open sites per cluster, year and level, zero-filled over all years."""
    rows = sites.filter(F.col(opens) <= F.col(closes)).withColumn(year, F.explode(F.sequence(opens, closes)))
    wide = wider(rows, [cluster, year], level, site, levels, "count", fill=0, prefix="section_")
    return complete(wide, cluster, year, {f"section_{v}": 0 for v in levels})


def rollout_flags(df: DataFrame, unit: str, year: str, a: str, b: str, steps: Sequence[int] = (0, 1, 2, 3)) -> DataFrame:
    """Openings of ``a`` (0 to 1; by exactly one; any increase) and whether ``b`` was there 0 to 3 years before."""
    w = Window.partitionBy(unit).orderBy(year)
    out = df.withColumn("_l", F.lag(a).over(w))
    out = out.withColumns({"opened": (F.col(a) == 1) & (F.col("_l") == 0), "opened_one": F.col(a) == F.col("_l") + 1, "opened_any": F.col(a) > F.col("_l")}).drop("_l")
    there = {k: (F.col(b) if k == 0 else F.lag(b, k).over(w)) > 0 for k in steps}
    return out.withColumns({f"{kind}_with_{k}": there[k] & F.col(kind) for kind in ("opened", "opened_one", "opened_any") for k in steps})


def open_years(df: DataFrame, key: Sequence[str], firsts: Sequence[str], lasts: Sequence[str], floor: int = 2000) -> DataFrame:
    """The earliest and latest year over several sources, not before ``floor``."""
    out = df.groupBy(*key).agg(*[F.min(c).alias(f"_a{i}") for i, c in enumerate(firsts)], *[F.max(c).alias(f"_b{i}") for i, c in enumerate(lasts)])
    lo = F.least(*[F.col(f"_a{i}") for i in range(len(firsts))]) if len(firsts) > 1 else F.col("_a0")
    hi = F.greatest(*[F.col(f"_b{i}") for i in range(len(lasts))]) if len(lasts) > 1 else F.col("_b0")
    return out.select(*key, F.greatest(lo, F.lit(floor)).alias("opens"), hi.alias("closes"))


def location_history(df: DataFrame, household: str, year: str, place: str) -> DataFrame:
    """The most frequent place of each household and year (all of equals), known years carried forward, then back."""
    seen = df.select(household, year).distinct()
    modes = mode(df, [household, year], place, "all")
    rows = seen.join(modes, [household, year], "left")
    return fill(rows, [place], [household], [F.col(year), F.col(place)], "downup")


def uniparental(df: DataFrame, household: str, head_with_partner: Column) -> DataFrame:
    """Households without a head that has a partner."""
    return df.groupBy(household).agg((F.count_if(head_with_partner) == 0).alias("uniparental"))


def regression_table(persons: DataFrame, supply: DataFrame, on: Sequence[str], fills: Sequence[tuple[Sequence[str], dict[str, Column]]]) -> DataFrame:
    """Persons with their supply; nulls from the group's aggregate, group after group (one shuffle per key)."""
    out = persons.join(supply, list(on), "left")
    for keys, values in fills:
        w = Window.partitionBy(*keys)
        out = out.withColumns({n: F.coalesce(F.col(n), a.over(w)) for n, a in values.items()})
    return out


def switchers(df: DataFrame, unit: str, treat: str, out: str = "switcher") -> DataFrame:
    """Units whose treated share is strictly between 0 and 1."""
    m = F.avg(F.col(treat).cast("double")).over(Window.partitionBy(unit))
    return df.withColumn(out, (m > 0) & (m < 1))


def monotone_switchers(df: DataFrame, unit: str, treat: str, order: Sequence[Column], out: str = "monotone") -> DataFrame:
    """Switchers whose first row is untreated and that change once at most."""
    step = changes(switchers(df, unit, treat, "_s"), [unit], treat, order, "_changes")
    first = F.first(treat).over(Window.partitionBy(unit).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return step.withColumn(out, F.coalesce(F.col("_s") & (F.col("_changes") <= 1) & (first == 0), F.lit(False))).drop("_s", "_changes")


def first_treated(df: DataFrame, unit: str, period: str, treat: str) -> DataFrame:
    """The period of the first treatment; treated rows, and untreated rows before it (or of units never treated)."""
    out = spread(df, [unit], {"first_treated": F.min(F.when(F.col(treat) == 1, F.col(period)))})
    return out.filter((F.col(treat) == 1) | F.col("first_treated").isNull() | (F.col(period) < F.col("first_treated")))


def treatment_conflicts(df: DataFrame, person: str, answer: str) -> DataFrame:
    """Persons whose repeated answers disagree."""
    return df.groupBy(person).agg(F.count_distinct(answer).alias("answers")).filter("answers > 1")


def sibling_sample(df: DataFrame, household: str, person: str, treat: str) -> DataFrame:
    """Rows of households with more records than the person has, and whether treatment is mixed there."""
    out = spread(df, [household], {"_h": F.count(F.lit(1)), "_lo": F.min(treat), "_hi": F.max(treat)})
    out = out.withColumn("_p", F.count(F.lit(1)).over(Window.partitionBy(household, person)))
    return out.filter("_h > _p").withColumn("mixed", F.col("_lo") != F.col("_hi")).drop("_h", "_p", "_lo", "_hi")


def cohort_profile(df: DataFrame, by: Sequence[str], treat: str, values: Sequence[str]) -> DataFrame:
    """Mean and standard deviation of each value by group and treatment arm, one column per arm."""
    rows = df.unpivot([*by, treat], list(values), "variable", "value").dropna(subset=["value"])
    arm = lambda f, k: f(F.when(F.col(treat) == k, F.col("value")))
    return rows.groupBy(*by, "variable").agg(*[arm(f, k).alias(f"{n}_{k}") for n, f in (("mean", F.avg), ("sd", F.stddev_samp)) for k in (0, 1)])


def attendance_or_eligibility(observed: Column, supply: Column, least: float = 1) -> Column:
    """The observed treatment, else whether the local supply reaches a threshold."""
    return F.coalesce(observed.cast("int"), (supply >= least).cast("int"))


def yearly_exam_summary(df: DataFrame, year: str, score: str, weight: str) -> DataFrame:
    return df.groupBy(year).agg(
        F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("sd"),
        (F.sum(F.col(score) * F.col(weight)) / F.sum(F.when(F.col(score).isNotNull(), F.col(weight)))).alias("weighted_mean"),
    )
