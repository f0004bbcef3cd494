"""Change history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from workmart.functions.keys import as_column, row_hash, stable_uuid, unique_key
from workmart.functions.scalars import filled, json_text, millis, text
from workmart.operators.ordered import with_neighbours


def scd2_append(current: DataFrame, previous: DataFrame | None, key: str, tracked: Sequence[str],
                json_tracked: Sequence[str] = (), as_of: Column | str = "_extracted_at",
                json_column: str = "raw_data") -> DataFrame:
    """New versions to append: keys that are new or whose tracked content
    changed (H1). `current` holds one row per key; `as_of` stamps the version."""
    content = row_hash(*tracked, *[json_text(json_column, name) for name in json_tracked])
    stamped = current.withColumn("_row_hash", content).withColumn("_tracked_at", as_column(as_of))
    if previous is None:
        return stamped
    known = previous.groupBy(key).agg(F.max_by("_row_hash", F.struct("_tracked_at", "_row_hash")).alias("__known"))
    joined = stamped.join(known, key, "left")
    return joined.filter(~F.col("_row_hash").eqNullSafe(F.col("__known"))).select(*stamped.columns)


def field_changes(versions: DataFrame, key: str, entity: str, fields: Sequence[str],
                  json_fields: Sequence[str] = (), json_column: str = "raw_data",
                  at: str = "_tracked_at") -> DataFrame:
    """One row per field that differs from the previous version; the first
    version counts as a change from '' (H2). NULL is read as ''."""
    names = list(fields) + list(json_fields)
    values = [text(f) for f in fields] + [json_text(json_column, f) for f in json_fields]
    rows = versions.select(
        F.col(key).alias("__key"), F.col(entity).cast("string").alias("entity_id"), "tenant_id", "source_id",
        F.array(*values).alias("__now"), F.col(at).alias("updated_at"),
    )
    rows = with_neighbours(rows, ["__key"], ["updated_at", "__now"], previous={"__before": F.col("__now")})
    pairs = F.transform(
        F.array(*[F.lit(n) for n in names]),
        lambda name, i: F.struct(
            name.alias("field_name"),
            F.coalesce(F.get("__before", i), F.lit("")).alias("old_value"),
            F.get("__now", i).alias("new_value"),
        ),
    )
    changed = F.filter(pairs, lambda p: p.old_value != p.new_value)
    return rows.select("entity_id", "tenant_id", "source_id", F.inline(changed), "updated_at")


def identity_inputs(changes: DataFrame, source_type: str, mapping: Sequence[tuple[str, str, str]],
                    deactivated: Column, since: Column | None = None) -> DataFrame:
    """Identity observations from a change log (H3), in one pass.

    `mapping`: (field, value_type, value_field_name). Every change of an
    entity also confirms its `id`; a deactivation deletes all mapped values.
    """
    log = changes if since is None else changes.filter(F.col("updated_at") > since)
    gone = F.coalesce(deactivated, F.lit(False))

    def signal(when: Column, value_type: str, value: Column, field: str, operation: str) -> Column:
        return F.when(when, F.struct(
            F.lit(value_type).alias("value_type"), value.alias("value"),
            F.lit(field).alias("value_field_name"), F.lit(operation).alias("operation_type")))

    upserts = [signal((F.col("field_name") == f) & (F.col("new_value") != ""), t, F.col("new_value"), path, "UPSERT")
               for f, t, path in mapping]
    deletes = [signal(gone, t, F.lit(""), path, "DELETE") for _, t, path in mapping]
    own = f"{source_type}.entity_id"
    ids = [signal(filled(F.col("entity_id")), "id", F.col("entity_id"), own, "UPSERT"),
           signal(gone, "id", F.lit(""), own, "DELETE")]
    signals = F.filter(F.array(*upserts, *deletes, *ids), lambda s: s.isNotNull())
    rows = log.select("*", F.inline(signals))
    at = millis("updated_at")
    return rows.select(
        unique_key(F.col("tenant_id"), F.lit(source_type), F.col("entity_id"),
                   F.col("value_type"), F.col("operation_type"), at).alias("unique_key"),
        stable_uuid(text("tenant_id")).alias("tenant_id"),
        stable_uuid(text("source_id")).alias("source_id"),
        F.lit(source_type).alias("source_type"),
        F.col("entity_id").alias("source_account_id"),
        "value_type", "value", "value_field_name", "operation_type",
        F.col("updated_at").alias("_synced_at"), at.alias("_version"),
    )


def close_out(observations: DataFrame, keys: Sequence[str], at: str, ties: Sequence[str] = ()) -> DataFrame:
    """Add `valid_from` and `valid_to`, the time of the next observation."""
    out = with_neighbours(observations, keys, [at, *ties], following={"valid_to": F.col(at)})
    return out.withColumn("valid_from", F.col(at))


def active_intervals(log: DataFrame, keys: Sequence[str], at: str, active: Column,
                     ties: Sequence[str] = ()) -> DataFrame:
    """Periods in which the latest state is active; equal states in a row are
    one (H21). An open period has a NULL end."""
    order = ["__at", *[f"__t{i}" for i in range(len(ties))]]
    states = log.select(*keys, F.col(at).alias("__at"),
                        *[F.col(c).alias(f"__t{i}") for i, c in enumerate(ties)],
                        F.coalesce(active, F.lit(False)).alias("__on"))
    states = with_neighbours(states, keys, order, previous={"__was": F.col("__on")})
    switches = states.filter(F.col("__was").isNull() | (F.col("__was") != F.col("__on"))).drop("__was")
    spans = with_neighbours(switches, keys, order, following={"interval_end": F.col("__at")})
    return spans.filter("__on").select(*keys, F.col("__at").alias("interval_start"), "interval_end")
