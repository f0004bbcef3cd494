"""Identity resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from workmart.functions import fixed
from workmart.functions.keys import stable_uuid, unique_key, value_hash
from workmart.functions.scalars import filled, split_display_name, text
from workmart.operators.history import active_intervals, close_out
from workmart.operators.latest import latest_by
from workmart.operators.ordered import with_neighbours
from workmart.operators.reshape import overlap_join

ACCOUNT = ["tenant_id", "source_type", "source_id", "source_account_id"]
SOURCE = ["tenant_id", "source_type", "source_id"]
MEMBER = [*SOURCE, "person_id"]


def account_profiles(inputs: DataFrame) -> DataFrame:
    """Per account: latest e-mail and whether its latest row closes it (O1).

    DELETE rows without a value stay in: they are what closes an account.
    """
    kept = inputs.filter(F.col("operation_type").isin("UPSERT", "DELETE") & (
        (F.col("operation_type") == "DELETE") | filled(F.col("value"))))
    mail = (F.col("value_type") == "email") & (F.trim(text("value")) != "")
    newest = F.struct("_synced_at", "value")
    # At one instant a DELETE counts after an UPSERT.
    last = F.struct("_synced_at", F.when(F.col("operation_type") == "DELETE", 1).otherwise(0))
    return kept.groupBy(*ACCOUNT).agg(
        F.max_by("value", F.when(mail, newest)).alias("latest_email"),
        (F.max_by("operation_type", last) == "DELETE").alias("is_closed"))


def known_bindings(persons: DataFrame) -> DataFrame:
    """Account -> person, from the latest `id` observation."""
    ids = persons.filter((F.col("value_type") == "id") & F.col("value_id").isNotNull())
    ids = ids.withColumn("source_account_id", F.col("value_id"))
    return latest_by(ids, ACCOUNT, ["created_at", "id"]).select(*ACCOUNT, F.col("person_id").alias("bound_person"))


def email_bindings(persons: DataFrame) -> DataFrame:
    """(tenant, lower e-mail) -> person, from the latest `email` observation."""
    mails = persons.filter((F.col("value_type") == "email") & filled(F.col("value_id"))).withColumn("email_key", F.lower("value_id"))
    return latest_by(mails, ["tenant_id", "email_key"], ["created_at", "id"]).select(
        "tenant_id", "email_key", F.col("person_id").alias("email_person"))


def resolve_persons(profiles: DataFrame, persons: DataFrame) -> DataFrame:
    """Assign a person to each account (O2).

    Accounts with the same e-mail form a group; an account without one is its
    own group. A group reuses the person one of its accounts is bound to, else
    the person known for its e-mail, else gets a new id if an account of it is
    open. Result: ACCOUNT, latest_email, is_closed, person_id, outcome.
    """
    own = unique_key(*ACCOUNT, sep="|")
    grouped = profiles.withColumn("email_key", F.lower("latest_email")).withColumn(
        "group_key", F.when(filled(F.col("email_key")), F.concat(F.lit("mail|"), "email_key")).otherwise(F.concat(F.lit("account|"), own)))
    bound = grouped.join(known_bindings(persons), ACCOUNT, "left")
    # One row per group: pre-aggregated, so a shared mailbox costs one row per task.
    groups = bound.groupBy("tenant_id", "group_key").agg(
        F.min_by("bound_person", F.when(F.col("bound_person").isNotNull(), own)).alias("bound_person"),
        F.max("email_key").alias("email_key"), F.max(~F.col("is_closed")).alias("has_open"))
    groups = groups.join(email_bindings(persons), ["tenant_id", "email_key"], "left")
    no_mail = ~F.coalesce(filled(F.col("email_key")), F.lit(False))
    outcome = (
        F.when(F.col("bound_person").isNotNull(), "reused_known")
        .when(no_mail, "skipped_no_email")
        .when(F.col("email_person").isNotNull(), "linked_by_email")
        .when(~F.col("has_open"), "skipped_closed")
        .otherwise("minted"))
    person = (
        F.when(F.col("outcome") == "reused_known", F.col("bound_person"))
        .when(F.col("outcome") == "linked_by_email", F.col("email_person"))
        .when(F.col("outcome") == "minted", stable_uuid(F.lit("person"), "tenant_id", "group_key")))
    decided = groups.withColumn("outcome", outcome).withColumn("person_id", person).select(
        "tenant_id", "group_key", "person_id", "outcome")
    return grouped.join(decided, ["tenant_id", "group_key"]).select(
        *ACCOUNT, "latest_email", "is_closed", "person_id", "outcome")


def resolution_counts(assignments: DataFrame) -> DataFrame:
    """Accounts per outcome."""
    return assignments.groupBy("tenant_id", "outcome").agg(F.count(F.lit(1)).alias("accounts"))


def route_value(value_type: Column, value: Column) -> Column:
    """struct(value_id, value_full_text, value): exactly one is filled. A
    value has no length limit: a column here is as wide as its values (O3)."""
    is_id, is_text = value_type.isin(*fixed.ID_VALUE_TYPES), value_type.isin(*fixed.TEXT_VALUE_TYPES)
    return F.struct(
        F.when(is_id, value).alias("value_id"),
        F.when(is_text, value).alias("value_full_text"),
        F.when(~is_id & ~is_text, value).alias("value"))


def observations(inputs: DataFrame, assignments: DataFrame, author: str) -> DataFrame:
    """Observation rows of the assigned accounts, one per distinct fact."""
    ups = inputs.filter((F.col("operation_type") == "UPSERT") & filled(F.col("value")))
    rows = ups.join(assignments.filter(F.col("person_id").isNotNull()).select(*ACCOUNT, "person_id", "outcome"), ACCOUNT)
    routed = rows.withColumn("__to", route_value(F.col("value_type"), F.col("value")))
    routed = routed.filter(F.coalesce("__to.value_id", "__to.value_full_text", "__to.value").isNotNull())
    out = routed.select(
        "value_type", "source_type", "source_id", "tenant_id",
        F.col("__to.value_id").alias("value_id"), F.col("__to.value_full_text").alias("value_full_text"),
        F.col("__to.value").alias("value"), "person_id", F.lit(author).alias("author_person_id"),
        F.when(F.col("outcome") == "linked_by_email", "auto-seed-link").otherwise("").alias("reason"),
        F.col("_synced_at").alias("created_at"))
    out = out.withColumn("value_effective", F.coalesce("value_id", "value_full_text", "value"))
    out = out.withColumn("value_hash", value_hash("value_effective"))
    # Of one fact's rows the one with the greatest reason stays: a link tells more than none.
    return latest_by(out, ["tenant_id", "person_id", "source_type", "source_id", "value_type", "value_hash", "created_at"], ["reason"], ["author_person_id"])


def account_person_map(persons: DataFrame) -> DataFrame:
    """Validity periods of account bindings."""
    ids = persons.filter((F.col("value_type") == "id") & F.col("value_id").isNotNull()).withColumn(
        "source_account_id", F.col("value_id"))
    return close_out(ids, ACCOUNT, "created_at", ["id"]).select(
        *ACCOUNT, "person_id", "author_person_id", "reason", "valid_from", "valid_to")


def org_chart(persons: DataFrame, author: str) -> DataFrame:
    """Parent edges over time.

    Explicit parent ids count first. Parent e-mails are resolved to persons
    and hold only while the child is active. Everybody else of a source gets a
    row without a parent for the active lifetime.
    """
    is_status = (F.col("value_type") == "status") & F.col("value_full_text").isNotNull()
    spans = active_intervals(
        persons.filter(is_status), MEMBER, "created_at",
        ~F.col("value_full_text").isin(*fixed.INACTIVE_OBSERVATIONS), ["id"])

    mailed = persons.filter((F.col("value_type") == "parent_email") & F.col("value_id").isNotNull())
    with_status = persons.filter(F.col("value_type") == "status").select(*MEMBER).distinct()
    always = mailed.select(*MEMBER).distinct().join(with_status, MEMBER, "left_anti").select(
        *MEMBER, F.lit("1970-01-01").cast("timestamp").alias("interval_start"), F.lit(None).cast("timestamp").alias("interval_end"))
    active = spans.unionByName(always)

    given = persons.filter((F.col("value_type") == "parent_person_id") & F.col("value_id").isNotNull())
    explicit = given.filter(
        F.col("value_id").rlike(fixed.UUID_PATTERN) & (F.lower("value_id") != F.lower("person_id")))
    explicit = close_out(explicit, MEMBER, "created_at", ["id"]).select(
        *MEMBER, F.lower("value_id").alias("parent_person_id"), "author_person_id", "reason", "valid_from", "valid_to")

    periods = with_neighbours(mailed, MEMBER, ["created_at", "id"], following={"pe_to": F.col("created_at")})
    periods = periods.select(*MEMBER, F.lower("value_id").alias("email_key"), "author_person_id", "reason",
                             F.col("created_at").alias("pe_from"), "pe_to")
    periods = periods.join(given.select(*MEMBER).distinct(), MEMBER, "left_anti")
    parents = email_bindings(persons)
    linked = periods.join(parents, ["tenant_id", "email_key"]).filter(F.col("email_person") != F.col("person_id"))
    by_mail = overlap_join(linked, active, MEMBER, ("pe_from", "pe_to"), ("interval_start", "interval_end")).select(
        *MEMBER, F.col("email_person").alias("parent_person_id"), "author_person_id", "reason", "valid_from", "valid_to")
    edges = explicit.unionByName(by_mail)

    far = F.lit("9999-12-31 23:59:59.999999").cast("timestamp")
    members = persons.groupBy(*MEMBER).agg(
        F.min("created_at").alias("valid_from"), F.max((F.col("value_type") == "status").cast("int")).alias("__has_status"))
    last = spans.groupBy(*MEMBER).agg(
        F.max_by(F.struct("interval_end"), F.struct("interval_start", F.coalesce("interval_end", far))).alias("__last"))
    alone = members.join(edges.select(*MEMBER).distinct(), MEMBER, "left_anti").join(last, MEMBER, "left")
    alone = alone.filter((F.col("__has_status") == 0) | F.col("__last").isNotNull()).select(
        *MEMBER, F.lit(None).cast("string").alias("parent_person_id"), F.lit(author).alias("author_person_id"),
        F.lit("").alias("reason"), "valid_from", F.col("__last.interval_end").alias("valid_to"))
    return edges.unionByName(alone).withColumnRenamed("person_id", "child_person_id")


# --- look-ups (O9) ------------------------------------------------------------

def current_observations(persons: DataFrame, value_type: str) -> DataFrame:
    """The current value of a type per person and source."""
    rows = persons.filter(F.col("value_type") == value_type)
    return latest_by(rows, MEMBER, ["created_at", "id"])


def persons_by_email(persons: DataFrame, wanted: DataFrame) -> DataFrame:
    """person ids whose current e-mail is asked for; wanted: tenant_id, email."""
    now = current_observations(persons, "email").withColumn("__mail", F.lower("value_id"))
    asked = wanted.select("tenant_id", "email", F.lower("email").alias("__mail"))
    return asked.join(now, ["tenant_id", "__mail"]).select("tenant_id", "email", "person_id").distinct()


def persons_by_source_id(persons: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: tenant_id, source_type, source_id, value_id."""
    now = current_observations(persons, "id")
    return wanted.join(now, [*SOURCE, "value_id"]).select(*SOURCE, "value_id", "person_id").distinct()


def source_ids(persons: DataFrame) -> DataFrame:
    """All current source ids of each person."""
    return current_observations(persons, "id").select("person_id", *SOURCE, "value_id")


def assemble_persons(persons: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """One row per person with the latest value of each type (O10). Without a
    first and last name the display name is split."""
    names = ["email", *fixed.TEXT_VALUE_TYPES]
    at = F.struct("created_at", "id")
    wide = persons.groupBy("tenant_id", "person_id").agg(*[
        F.coalesce(F.max_by("value_effective", F.when(F.col("value_type") == n, at)), F.lit("")).alias(n) for n in names])
    nameless = (F.trim("first_name") == "") & (F.trim("last_name") == "") & (F.trim("display_name") != "")
    parts = split_display_name("display_name")
    out = (
        wide.withColumn("__parts", parts).withColumn("__nameless", nameless)
        .withColumn("first_name", F.when(F.col("__nameless"), F.col("__parts.first_name")).otherwise(F.col("first_name")))
        .withColumn("last_name", F.when(F.col("__nameless"), F.col("__parts.last_name")).otherwise(F.col("last_name")))
        .drop("__parts", "__nameless"))
    if edges is None:
        return out
    parent = latest_by(edges.filter(F.col("valid_to").isNull() & F.col("parent_person_id").isNotNull()),
                       ["tenant_id", "child_person_id"], ["valid_from"], ["source_type", "source_id"])
    parent = parent.select("tenant_id", F.col("child_person_id").alias("person_id"), "parent_person_id")
    shown = out.select("tenant_id", F.col("person_id").alias("parent_person_id"), F.col("email").alias("supervisor_email"),
                       F.col("display_name").alias("supervisor_name"))
    return out.join(parent, ["tenant_id", "person_id"], "left").join(shown, ["tenant_id", "parent_person_id"], "left")
