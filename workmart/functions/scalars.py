"""Scalar expressions shared by the conformers (P3-P14 and the F list)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from workmart.functions import fixed
from workmart.functions.keys import as_column

# Landed timestamps are text in several shapes; the first that parses wins.
TIMESTAMP_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSZ", "dd/MM/yyyy", "MMM dd, yyyy")


# --- numbers ---------------------------------------------------------------

def number(value: Column | str, type_: str = "double") -> Column:
    """Dirty text to a number, NULL when it is none (ANSI mode would raise)."""
    return as_column(value).cast("string").try_cast(type_)


def number_or_zero(value: Column | str, type_: str = "double") -> Column:
    return F.coalesce(number(value, type_), F.lit(0).cast(type_))


def whole_div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by).cast("bigint"))


def rounded(value: Column | str, digits: int) -> Column:
    """Half-up rounding that does not depend on how rows were partitioned:
    the last bits of a sum of doubles do, so they are rounded off first. Most
    values are whole, and rounding goes through decimals, so whole ones are
    taken as they are (with -0.0 as 0.0, as rounding has it)."""
    value = as_column(value).cast("double")
    return F.when(value == F.rint(value), value + F.lit(0.0)).otherwise(F.round(F.round(value, digits + 8), digits))


def ratio(numerator: Column, denominator: Column, scale: float = 1.0) -> Column:
    """NULL instead of a division by zero."""
    den = F.nullif(denominator.cast("double"), F.lit(0.0))
    return F.lit(scale) * numerator.cast("double") / den


def clamp(value: Column, low=None, high=None) -> Column:
    """Bound a value; NULL stays NULL."""
    out = value
    if low is not None:
        out = F.greatest(F.lit(low), out)
    if high is not None:
        out = F.least(F.lit(high), out)
    return F.when(value.isNotNull(), out)


# --- text ------------------------------------------------------------------

def text(value: Column | str) -> Column:
    return F.coalesce(as_column(value).cast("string"), F.lit(""))


def filled(value: Column) -> Column:
    """Neither NULL nor ''."""
    return value.isNotNull() & (value != "")


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(F.trim(as_column(value)), F.lit(""))


def normal_email(value: Column | str) -> Column:
    return F.lower(F.trim(as_column(value)))


def person_key(email: Column | str, fallback: Column | str) -> Column:
    """Lower-case e-mail, or the lower-case name when there is no e-mail."""
    mail = as_column(email)
    return F.when(filled(mail), F.lower(mail)).otherwise(F.lower(as_column(fallback)))


def flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def any_positive(*counters: Column | str) -> Column:
    """True when at least one counter is above zero."""
    return reduce(lambda a, b: a | b, [F.coalesce(number(c), F.lit(0.0)) > 0 for c in counters])


def file_category(path: Column | str) -> Column:
    path = as_column(path)
    return (
        F.when(path.rlike(fixed.SPEC_PATH), "spec")
        .when(path.rlike(fixed.CONFIG_PATH), "config")
        .otherwise("code")
    )


def file_extension(path: Column | str) -> Column:
    parts = F.split(text(path), r"\.")
    return F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise("")


def seniority(title: Column | str) -> Column:
    title = as_column(title)
    holds = lambda words: reduce(lambda a, b: a | b, [title.ilike(f"%{w}%") for w in words])
    return (
        F.when(holds(fixed.SENIOR_TITLE), "Senior")
        .when(holds(fixed.JUNIOR_TITLE), "Junior")
        .otherwise("Mid")
    )


def executive_title(title: Column | str) -> Column:
    title = as_column(title)
    return reduce(lambda a, b: a | b, [title.ilike(p) for p in fixed.EXECUTIVE_TITLE_LIKE])


def typed_reference(value: Column | str, prefix: str) -> Column:
    """A reference whose first characters name its type; NULL for others."""
    value = as_column(value)
    return F.when(value.startswith(prefix), value)


def split_display_name(name: Column | str) -> Column:
    """'Last, First' or 'First Rest' -> struct(first_name, last_name)."""
    trimmed = F.trim(F.coalesce(as_column(name), F.lit("")))
    around = lambda pattern, group: F.trim(F.regexp_extract(trimmed, pattern, group))
    comma, space = r"^([^,]*),(.*)$", r"^([^ ]*) (.*)$"
    first = (
        F.when(trimmed.contains(","), around(comma, 2))
        .when(trimmed.contains(" "), around(space, 1))
        .otherwise(trimmed)
    )
    last = (
        F.when(trimmed.contains(","), around(comma, 1))
        .when(trimmed.contains(" "), around(space, 2))
        .otherwise("")
    )
    return F.struct(first.alias("first_name"), last.alias("last_name"))


# --- time ------------------------------------------------------------------

def moment(value: Column | str) -> Column:
    """Best-effort text to timestamp, NULL when nothing matches."""
    raw = as_column(value).cast("string")
    parsed = [raw.try_cast("timestamp")]
    parsed += [F.try_to_timestamp(raw, F.lit(f)) for f in TIMESTAMP_FORMATS]
    return F.coalesce(*parsed)


def day(value: Column | str) -> Column:
    return F.to_date(moment(value))


def millis(value: Column | str) -> Column:
    return F.unix_millis(as_column(value).cast("timestamp"))


def from_millis(value: Column | str) -> Column:
    return F.timestamp_millis(as_column(value).cast("bigint"))


def seconds_between(start: Column, end: Column) -> Column:
    return F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))


def week(value: Column | str) -> Column:
    """Monday of the week, as a date."""
    return F.to_date(F.date_trunc("week", as_column(value)))


def iso_duration_seconds(value: Column | str) -> Column:
    """`P1DT1H30M45.5S` to seconds; NULL reads as zero. Minutes count only
    after the `T`, so that months are not taken for them."""
    raw = F.coalesce(as_column(value), F.lit("PT0S"))
    part = lambda pattern: F.coalesce(
        F.nullif(F.regexp_extract(raw, pattern, 1), F.lit("")).try_cast("double"), F.lit(0.0)
    )
    return (
        part(r"(\d+)D") * 86400
        + part(r"T.*?(\d+)H") * 3600
        + part(r"T(?:\d+H)?(\d+)M") * 60
        + part(r"(\d+(?:\.\d+)?)S")
    )


# --- JSON and arrays ---------------------------------------------------------

def json_text(doc: Column | str, *path: str) -> Column:
    """Text at a path, '' when missing."""
    return F.coalesce(F.get_json_object(as_column(doc), "$" + "".join(f".{p}" for p in path)), F.lit(""))


def json_number(doc: Column | str, *path: str) -> Column:
    return number_or_zero(F.get_json_object(as_column(doc), "$" + "".join(f".{p}" for p in path)))


def json_items(doc: Column | str) -> Column:
    """A JSON array as an array of the raw JSON text of its items."""
    return F.coalesce(
        F.from_json(as_column(doc), "array<string>"), F.array().cast("array<string>")
    )


def json_map(**values: Column) -> Column:
    """A flat JSON object; missing numbers read as 0 like the published maps."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]))


def first_item(items: Column | str) -> Column:
    return F.try_element_at(as_column(items), F.lit(1))
