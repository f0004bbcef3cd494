"""Keys and hashes (K1-K6)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def unique_key(*parts: Column | str, sep: str = "-", missing: str = "") -> Column:
    """Join the natural key parts into one string; NULL becomes `missing`."""
    return F.concat_ws(sep, *[F.coalesce(as_column(p).cast("string"), F.lit(missing)) for p in parts])


def hashed_key(*parts: Column | str, sep: str = "-") -> Column:
    """MD5 of the joined key: fixed width for long natural keys."""
    return F.md5(unique_key(*parts, sep=sep))


def stable_uuid(*parts: Column | str) -> Column:
    """The same text always gives the same UUID-shaped id, on any machine."""
    digest = F.md5(unique_key(*parts, sep="|"))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def row_hash(*columns: Column | str) -> Column:
    """Content hash of tracked columns, NULL kept apart from ''. The unit
    separator keeps ('a','bc') and ('ab','c') apart."""
    from workmart.functions.fixed import NULL_MARK

    return F.sha2(unique_key(*columns, sep="\u001f", missing=NULL_MARK), 256)


def surrogate_id(*natural_key: Column | str) -> Column:
    """Surrogate id that a re-run repeats (K5)."""
    return stable_uuid(F.lit("surrogate"), *natural_key)


def value_hash(value: Column | str) -> Column:
    """Hash used for the uniqueness of an observation (K6)."""
    return F.sha2(F.coalesce(as_column(value).cast("string"), F.lit("")), 256)
