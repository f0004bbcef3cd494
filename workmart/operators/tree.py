"""Org tree (O6-O8, O11, J14).

A level of the tree is one join of the frontier with the edges. Levels are
written to reliable storage every few steps, so neither the plan nor a lost
executor makes the next level dearer. Rows met before are taken out of the
frontier, which ends cycles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from workmart.operators.latest import latest_by
from workmart.operators.reshape import pivot_latest, union_all, valid_at
from workmart.session import store

SPREAD = 64
ATTRIBUTES = ("email", "display_name", "job_title", "status")


def descend(seeds: DataFrame, edges: DataFrame, max_depth: int | None = None,
            group: Sequence[str] = ()) -> DataFrame:
    """All nodes below the seeds with their depth.

    seeds: [*group] person_id. edges: child_person_id, parent_person_id.
    Result: [*group] person_id, parent_person_id, depth; a seed has no parent.
    A node reached again is kept only at its smallest depth.
    """
    group = list(group)
    node = [*group, "person_id"]
    steps = edges.filter(F.col("parent_person_id").isNotNull()).select("child_person_id", "parent_person_id").distinct()
    steps = store(steps)
    found = store(seeds.select(*node).distinct().select(
        *node, F.lit(None).cast("string").alias("parent_person_id"), F.lit(0).alias("depth")))
    levels, frontier = [found], found
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.select(*group, F.col("person_id").alias("parent_person_id")).join(steps, "parent_person_id")
        reached = step.select(*group, F.col("child_person_id").alias("person_id"), "parent_person_id")
        # A node with two parents on one level keeps the smaller parent id.
        reached = reached.groupBy(*node).agg(F.min("parent_person_id").alias("parent_person_id"))
        known = union_all(level.select(*node) for level in levels)
        frontier = store(reached.join(known, node, "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        levels.append(frontier)
    return union_all(levels)


def org_at(org_chart: DataFrame, tenant: str, source_type: str, at: Column | None = None) -> DataFrame:
    """The edges of one source that hold at a time."""
    rows = org_chart.filter((F.col("tenant_id") == tenant) & (F.col("source_type") == source_type))
    return valid_at(rows, at)


def with_attributes(nodes: DataFrame, persons: DataFrame, at: Column | None = None,
                    names: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """Add the latest observed attributes of each node."""
    seen = persons if at is None else persons.filter(F.col("created_at") <= at)
    rows = seen.withColumn("__value", F.coalesce("value_id", "value_full_text"))
    wide = pivot_latest(rows, ["person_id"], "value_type", "__value", names, ["created_at", "__value"])
    return nodes.join(wide, "person_id", "left")


def subtree(org_chart: DataFrame, root: str, tenant: str, source_type: str,
            max_depth: int | None = None, at: Column | None = None) -> DataFrame:
    """One person and everyone below."""
    seed = org_chart.sparkSession.range(1).select(F.lit(root).alias("person_id"))
    return descend(seed, org_at(org_chart, tenant, source_type, at), max_depth)


def granted(viewers: DataFrame, visibility: DataFrame, everyone: DataFrame, tenant: str,
            at: Column | None = None) -> DataFrame:
    """viewer_person_id, person_id: oneself, direct grants, and everyone for a
    wildcard grant (a NULL viewed person)."""
    asked = viewers.select("viewer_person_id").distinct()
    grants = valid_at(visibility.filter(F.col("tenant_id") == tenant), at).join(asked, "viewer_person_id", "left_semi")
    direct = grants.filter(F.col("viewed_person_id").isNotNull()).select(
        "viewer_person_id", F.col("viewed_person_id").alias("person_id"))
    # A wildcard viewer sees every person, so this part has that size by
    # definition. People are spread over buckets to share the work.
    wild = grants.filter(F.col("viewed_person_id").isNull()).select("viewer_person_id").distinct().withColumn(
        "__bucket", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    people = everyone.filter(F.col("tenant_id") == tenant).select("person_id").distinct().withColumn(
        "__bucket", F.pmod(F.xxhash64("person_id"), F.lit(SPREAD)).cast("int"))
    of_all = wild.join(people, "__bucket").select("viewer_person_id", "person_id")
    own = asked.select("viewer_person_id", F.col("viewer_person_id").alias("person_id"))
    return own.unionByName(direct).unionByName(of_all).distinct()


def visible_set(viewers: DataFrame, visibility: DataFrame, everyone: DataFrame, org_chart: DataFrame,
                tenant: str, source_type: str, at: Column | None = None) -> DataFrame:
    """viewer_person_id, person_id: grants closed under 'below in the tree'."""
    start = granted(viewers, visibility, everyone, tenant, at)
    return descend(start, org_at(org_chart, tenant, source_type, at), group=["viewer_person_id"]).select(
        "viewer_person_id", "person_id")


def is_visible(targets: DataFrame, visible: DataFrame) -> DataFrame:
    """viewer/viewed pairs with a flag."""
    hits = visible.select("viewer_person_id", F.col("person_id").alias("viewed_person_id"), F.lit(True).alias("__hit")).distinct()
    return targets.join(hits, ["viewer_person_id", "viewed_person_id"], "left").withColumn(
        "is_visible", F.coalesce("__hit", F.lit(False))).drop("__hit")


def forest(visible: DataFrame, org_chart: DataFrame, tenant: str, source_type: str,
           max_depth: int | None = None, at: Column | None = None) -> DataFrame:
    """The trees a viewer sees (O7). A root is a visible person without a
    visible parent; roots without children are left out."""
    edges = org_at(org_chart, tenant, source_type, at)
    members = edges.select(F.col("child_person_id").alias("person_id"), "parent_person_id").distinct()
    with_children = edges.filter(F.col("parent_person_id").isNotNull()).select(F.col("parent_person_id").alias("person_id")).distinct()
    # Only persons with children can be roots: the others go before they meet what the viewers see.
    inside = visible.join(members.join(with_children, "person_id", "left_semi"), "person_id")
    parents = visible.select("viewer_person_id", F.col("person_id").alias("parent_person_id")).join(
        with_children.select(F.col("person_id").alias("parent_person_id")), "parent_person_id", "left_semi").join(
        members.select(F.col("person_id").alias("parent_person_id")).distinct(), "parent_person_id", "left_semi")
    # The anti join keeps rows without a parent.
    tops = inside.join(parents, ["viewer_person_id", "parent_person_id"], "left_anti")
    roots = tops.select("viewer_person_id", "person_id").distinct()
    return descend(roots, edges, max_depth, group=["viewer_person_id"])


def current_parents(org_chart: DataFrame, child: str | None = None) -> DataFrame:
    """Open edges, of one child or of all."""
    rows = valid_at(org_chart, None)
    rows = rows if child is None else rows.filter(F.col("child_person_id") == child)
    return rows.select("tenant_id", "source_type", "source_id", "child_person_id", "parent_person_id", "valid_from")


def current_children(org_chart: DataFrame, parent: str | None = None) -> DataFrame:
    rows = valid_at(org_chart, None).filter(F.col("parent_person_id").isNotNull())
    rows = rows if parent is None else rows.filter(F.col("parent_person_id") == parent)
    return rows.select("tenant_id", "source_type", "source_id", "parent_person_id", "child_person_id", "valid_from")
