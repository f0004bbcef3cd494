"""Metric roll-ups (A8-A14, J11): person values from long rows, then cohorts.

Long rows have `person_id, org_unit_id, metric_date, metric_key, metric_value`.
One wide aggregation gives every person's values of all metrics; it is turned
long again and compared with the company or the person's own unit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from workmart.functions.scalars import rounded
from workmart.operators.quantiles import exact_quantiles
from workmart.operators.reshape import unpivot
from workmart.session import store

def _key() -> Column:
    return F.col("metric_key")


def _value() -> Column:
    return F.col("metric_value")


def total(*keys: str) -> Column:
    """Sum of the values of some keys; 0 when there is none."""
    return F.coalesce(F.sum(F.when(_key().isin(*keys), _value())), F.lit(0.0))


def total_if_any(key: str) -> Column:
    return F.sum(F.when(_key() == key, F.coalesce(_value(), F.lit(0.0))))


def mean(key: str) -> Column:
    return F.avg(F.when(_key() == key, _value()))


def seen(key: str) -> Column:
    """1 when the person has a row of this key, else NULL."""
    return F.max(F.when(_key() == key, F.lit(1.0)))


def days_above_zero(key: str) -> Column:
    return F.count_if((_key() == key) & (_value() > 0)).cast("double")


def percent(num: Column, den: Column, digits: int | None = 1, cap: float | None = None) -> Column:
    """100 x ratio of sums, NULL when the denominator is not positive (A10)."""
    out = F.lit(100.0) * num / F.nullif(den, F.lit(0.0))
    if digits is not None:
        out = rounded(out, digits)
    if cap is not None:
        out = F.least(F.lit(cap), out)
    return F.when(den > 0, out)


def per(num: Column, den: Column, digits: int | None = None) -> Column:
    out = num / F.nullif(den, F.lit(0.0))
    return F.when(den > 0, rounded(out, digits) if digits is not None else out)


def fold_accuracy(key: str, top: float = 200.0) -> Column:
    """100 - mean distance from 100 over values in (0, top]."""
    fits = (_key() == key) & (_value() > 0) & (_value() <= top)
    off = F.avg(F.when(fits, F.abs(F.lit(100.0) - _value())))
    return F.when(off.isNotNull(), F.greatest(F.lit(0.0), F.lit(100.0) - off))


def supported_ratio(key: str, support: float = 5.0) -> Column:
    """Negative share of signed counts, only with enough positives."""
    gains = F.coalesce(F.sum(F.when((_key() == key) & (_value() > 0), _value())), F.lit(0.0))
    losses = F.coalesce(F.sum(F.when((_key() == key) & (_value() < 0), _value())), F.lit(0.0))
    return F.when(gains >= support, rounded(F.abs(losses) / F.nullif(gains, F.lit(0.0)) * 100, 1))


def nothing() -> Column:
    """A metric without a source stays NULL."""
    return F.max(F.lit(None).cast("double"))


@dataclass(frozen=True)
class Metrics:
    """One section of the metric surface.

    values: metric -> aggregate over a person's rows.
    medians: metric -> row key whose exact median it is.
    tail: metrics whose range ends at the 95th percentile instead of the max.
    active: 0/1 metrics; a group's value is a head count, its range 0..people.
    """

    values: dict[str, Column]
    medians: dict[str, str] = field(default_factory=dict)
    tail: Sequence[str] = ()
    active: Sequence[str] = ()

    def names(self) -> list[str]:
        return [*self.values, *self.medians]


def in_period(rows: DataFrame, period: tuple[str, str] | None, day: str = "metric_date") -> DataFrame:
    """Rows with start <= day <= end. Applied before any aggregation, as the
    optimizer cannot move it below one (Q2)."""
    if period is None:
        return rows
    start, end = period
    return rows.filter((F.col(day) >= F.lit(start).cast("date")) & (F.col(day) <= F.lit(end).cast("date")))


def person_values(rows: DataFrame, metrics: Metrics) -> DataFrame:
    """person_id, org_unit_id, metric_key, v: one row per person and metric.
    Medians read the rows several times (counts, bands, cells), so the rows are
    stored first where there are any."""
    if metrics.medians:
        rows = store(rows)
    wide = rows.groupBy("person_id").agg(
        F.max("org_unit_id").alias("org_unit_id"), *[c.alias(f"v_{n}") for n, c in metrics.values.items()])
    out = unpivot(wide, ["person_id", "org_unit_id"], {n: F.col(f"v_{n}") for n in metrics.values}, value="v")
    if not metrics.medians:
        return out
    by_key = {k: n for n, k in metrics.medians.items()}
    source = rows.filter(F.col("metric_key").isin(*by_key))
    found = exact_quantiles(source, ["person_id", "metric_key"], "metric_value", {"v": 0.5})
    name = F.coalesce(*[F.when(F.col("metric_key") == k, F.lit(n)) for k, n in by_key.items()])
    found = found.select("person_id", name.alias("metric_key"), "v")
    # Everyone gets a row for every median, NULL when there is nothing.
    everyone = wide.select("person_id", "org_unit_id", F.explode(F.array(*[F.lit(n) for n in metrics.medians])).alias("metric_key"))
    return out.unionByName(everyone.join(found, ["person_id", "metric_key"], "left"))


def cohort_range(values: DataFrame, metrics: Metrics, by: Sequence[str]) -> DataFrame:
    """median, range_min, range_max of the person values in each cohort."""
    keys = [*by, "metric_key"]
    active = F.col("metric_key").isin(*metrics.active) if metrics.active else F.lit(False)
    tail = F.col("metric_key").isin(*metrics.tail) if metrics.tail else F.lit(False)
    plain = values.groupBy(*keys).agg(F.count("v").alias("__n"), F.count(F.lit(1)).alias("__people"),
                                      F.min("v").alias("__min"), F.max("v").alias("__max"))
    # Active flags need no quantile: they are left out of the ranking.
    ranked = exact_quantiles(values.filter(~active), keys, "v", {"__p50": 0.5, "__p95": 0.95})
    names = {c: f"__of_{c}" for c in keys}
    ranked = ranked.select(*[F.col(c).alias(n) for c, n in names.items()], "__p50", "__p95")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    joined = plain.join(ranked, same, "left")
    flat = lambda x: F.when(F.col("__n") > 0, x.cast("double"))
    return joined.select(
        *keys,
        F.when(active, flat(F.lit(0))).otherwise(F.col("__p50")).alias("median"),
        F.when(active, flat(F.lit(0))).otherwise(F.col("__min")).alias("range_min"),
        F.when(active, flat(F.col("__people"))).when(tail, F.col("__p95")).otherwise(F.col("__max")).alias("range_max"))


def team_bullet(rows: DataFrame, metrics: Metrics, period: tuple[str, str] | None = None,
                org_unit: str | None = None) -> DataFrame:
    """A unit's value of each metric against the whole company (Q5). The
    person values, one row per person and metric, are stored: value and range
    both read them, and the metric rows are scanned once."""
    values = store(person_values(in_period(rows, period), metrics))
    member = F.lit(True) if org_unit is None else (F.col("org_unit_id") == org_unit)
    active = F.col("metric_key").isin(*metrics.active) if metrics.active else F.lit(False)
    mine = values.filter(member).groupBy("metric_key").agg(F.sum("v").alias("__sum"), F.avg("v").alias("__avg"))
    mine = mine.select("metric_key", F.when(active, F.col("__sum")).otherwise(F.col("__avg")).alias("value"))
    return mine.join(cohort_range(values, metrics, []), "metric_key", "left")


def team_bullets(rows: DataFrame, metrics: Metrics, period: tuple[str, str] | None = None) -> DataFrame:
    """`team_bullet` of every unit at once."""
    values = store(person_values(in_period(rows, period), metrics))
    active = F.col("metric_key").isin(*metrics.active) if metrics.active else F.lit(False)
    mine = values.groupBy("org_unit_id", "metric_key").agg(F.sum("v").alias("__sum"), F.avg("v").alias("__avg"))
    mine = mine.select("org_unit_id", "metric_key", F.when(active, F.col("__sum")).otherwise(F.col("__avg")).alias("value"))
    return mine.join(cohort_range(values, metrics, []), "metric_key", "left")


def person_bullet(rows: DataFrame, metrics: Metrics, period: tuple[str, str] | None = None,
                  person: str | None = None) -> DataFrame:
    """A person's value of each metric against their own unit (Q6); without a
    person, those of everyone."""
    values = store(person_values(in_period(rows, period), metrics))
    ranges = cohort_range(values, metrics, ["org_unit_id"])
    mine = values if person is None else values.filter(F.col("person_id") == person)
    return mine.join(ranges, ["org_unit_id", "metric_key"], "left").select(
        "person_id", "metric_key", F.col("v").alias("value"), "median", "range_min", "range_max")


def by_rule(rules: dict[str, Sequence[str]], default: str = "avg", value: str = "metric_value",
            key: str = "metric_key") -> Column:
    """Aggregate chosen by the metric key (A13). `key` must be grouped by."""
    fns = {"sum": F.sum, "max": F.max, "avg": F.avg, "min": F.min}
    out = None
    for fn, keys in rules.items():
        case = F.col(key).isin(*keys)
        out = F.when(case, fns[fn](value)) if out is None else out.when(case, fns[fn](value))
    return fns[default](value) if out is None else out.otherwise(fns[default](value))


def person_period(rows: DataFrame, rules: dict[str, Sequence[str]]) -> DataFrame:
    """One value per person and metric over all days."""
    return rows.groupBy("metric_key", "person_id").agg(
        F.max("org_unit_id").alias("org_unit_id"), F.max("metric_date").alias("metric_date"), by_rule(rules).alias("v"))


def company_stats(values: DataFrame, active: Sequence[str] = ()) -> DataFrame:
    """Company value, median and range per metric (G27). `company_p5` and
    `company_p95` hold the minimum and maximum, as published."""
    metrics = Metrics(values={}, active=active)
    flags = F.col("metric_key").isin(*active) if active else F.lit(False)
    mine = values.groupBy("metric_key").agg(F.sum("v").alias("__sum"), F.avg("v").alias("__avg"))
    ranges = cohort_range(values, metrics, [])
    return mine.join(ranges, "metric_key", "left").select(
        "metric_key", F.when(flags, F.col("__sum")).otherwise(F.col("__avg")).alias("company_value"),
        F.col("median").alias("company_median"), F.col("range_min").alias("company_p5"), F.col("range_max").alias("company_p95"))


def having(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on aggregated columns."""
    return df.filter(condition)
