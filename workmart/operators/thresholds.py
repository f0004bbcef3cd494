"""Metric catalogue and thresholds (Q17-Q19)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from workmart.functions import fixed

SPREAD = 64


def resolve_thresholds(catalog: DataFrame, thresholds: DataFrame, contexts: DataFrame) -> DataFrame:
    """The threshold that holds for each metric in each context (Q17).

    contexts: tenant_id, role_slug, team_id (one row per viewer context).
    Scopes go from broad to narrow and the narrowest wins, but nothing
    narrower than the first locked scope counts.
    """
    rank = F.coalesce(*[F.when(F.col("scope") == s, F.lit(i)) for i, s in enumerate(fixed.THRESHOLD_SCOPES)])
    known = thresholds.withColumn("__rank", rank).filter(F.col("__rank").isNotNull())
    enabled = catalog.filter(F.col("is_enabled"))
    values = ["scope", "good", "warn", "alert_trigger", "alert_bad", "is_locked"]
    packed = known.withColumn("__value", F.struct(*values))

    # Each scope names the context columns it is bound to, so every candidate
    # is found by an equality join instead of one join with alternatives.
    bound = {"product-default": [], "tenant": ["tenant_id"], "role": ["tenant_id", "role_slug"],
             "team": ["tenant_id", "team_id"], "team+role": ["tenant_id", "role_slug", "team_id"]}
    base = contexts.select("tenant_id", "role_slug", "team_id").distinct()
    parts = []
    for scope, on in bound.items():
        rows = packed.filter(F.col("scope") == scope).select(*on, "metric_key", "__rank", "__value")
        if on:
            parts.append(base.join(rows, on).select("tenant_id", "role_slug", "team_id", "metric_key", "__rank", "__value"))
        else:
            # Defaults hold in every context. Contexts are spread over buckets
            # and the few default rows repeated per bucket.
            bucket = F.pmod(F.xxhash64(*base.columns), F.lit(SPREAD)).cast("int")
            spread = rows.withColumn("__bucket", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
            parts.append(base.withColumn("__bucket", bucket).join(spread, "__bucket").select(
                "tenant_id", "role_slug", "team_id", "metric_key", "__rank", "__value"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    context = ["tenant_id", "role_slug", "team_id", "metric_key"]
    lock = F.min(F.when(F.col("__value.is_locked"), F.col("__rank"))).over(Window.partitionBy(*context))
    allowed = found.withColumn("__lock", lock).filter(F.col("__lock").isNull() | (F.col("__rank") <= F.col("__lock")))
    won = allowed.groupBy(*context).agg(
        F.max_by("__value", F.struct("__rank")).alias("__value"), F.max(F.col("__lock").isNotNull()).alias("bounded_by_lock"))
    return won.join(enabled.select("metric_key"), "metric_key", "left_semi").select(
        *context, F.col("__value.scope").alias("scope"), F.col("__value.good").alias("good"), F.col("__value.warn").alias("warn"),
        F.col("__value.alert_trigger").alias("alert_trigger"), F.col("__value.alert_bad").alias("alert_bad"), "bounded_by_lock")


def query_links(links: DataFrame, catalog: DataFrame) -> DataFrame:
    """Metrics of each query, in order (Q18). A query shows a few dozen
    metrics at most: the list is bounded by the catalogue."""
    enabled = catalog.filter(F.col("is_enabled")).select("metric_key")
    return links.join(enabled, "metric_key", "left_semi").groupBy("query_id").agg(
        F.array_sort(F.collect_set("metric_key")).alias("metric_keys"))


def probe_schema(df: DataFrame, columns: Sequence[str] = (), long_format: bool = False) -> dict[str, bool]:
    """Do the columns a metric reads exist? Long tables need key and value (Q19)."""
    wanted = [*columns, *(["metric_key", "metric_value"] if long_format else [])]
    return {c: c in df.columns for c in wanted}
