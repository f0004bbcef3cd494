"""Wikis -> class_wiki_*."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from workmart.functions.keys import unique_key
from workmart.functions.scalars import filled, moment, normal_email
from workmart.operators.latest import latest_by
from workmart.operators.ordered import with_position
from workmart.operators.reshape import union_all
from workmart.operators.sessions import sessionize
from workmart.plans.registry import Landed, feeds
from workmart.plans.staging.shape import count0, labels, shape, version

EDIT_GAP_SECONDS = 1800
PLACE = ["tenant_id", "source_id"]


def _people(t: Landed, table: str, key: list[str], account: str) -> DataFrame:
    """Account -> e-mail, one row per account."""
    df = latest_by(t(table).filter(filled(F.trim("email"))), key, ["_extracted_at"], ["email"])
    return df.select(*[c for c in key if c != account], F.col(account).alias("account"), normal_email("email").alias("mail"))


def _with_mail(df: DataFrame, people: DataFrame | None, account: str, name: str) -> DataFrame:
    if people is None:
        return df.withColumn(name, F.lit(None).cast("string"))
    on = [c for c in people.columns if c in PLACE]
    renamed = people.select(*on, F.col("account").alias(account), F.col("mail").alias(name))
    return df.join(renamed, [*on, account], "left")


def _edits(versions: DataFrame) -> DataFrame:
    """Number the edit sessions of each author on each page."""
    return sessionize(versions, [*PLACE, "page_id", "author_id"], "at", EDIT_GAP_SECONDS, ties=["unique_key"], name="session")


def _activity(edits: DataFrame, first_version: Column, mail: Column) -> DataFrame:
    """Per author and day. Pages and sessions are counted exactly: first one
    row per (author, day, page, session), then two plain sums."""
    day = F.to_date("at").alias("day")
    sessions = edits.groupBy(*PLACE, "author_id", day, "page_id", "session").agg(
        F.count_if(first_version).alias("created"), F.max("collected").alias("collected"), F.max("_extracted_at").alias("extracted"),
        F.max_by(mail, F.struct("at", "unique_key")).alias("mail"), F.max(F.struct("at", "unique_key")).alias("last"))
    pages = sessions.groupBy(*PLACE, "author_id", "day", "page_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("created").alias("created"), F.max("collected").alias("collected"),
        F.max("extracted").alias("extracted"), F.max_by("mail", "last").alias("mail"), F.max("last").alias("last"))
    return pages.groupBy(*PLACE, "author_id", "day").agg(
        F.count(F.lit(1)).alias("pages_edited"), F.sum("sessions").alias("total_edits"), F.sum("created").alias("pages_created"),
        F.max("collected").alias("collected_at"), F.max("extracted").alias("_extracted_at"), F.max_by("mail", "last").alias("mail"))


def _activity_rows(df: DataFrame, mail: Column, source: str) -> DataFrame:
    return shape(df, *PLACE, "author_id", "day", "pages_edited", "total_edits", "pages_created", "collected_at",
                 unique_key=unique_key(*PLACE, "author_id", "day"), author_email=mail,
                 **labels(source=source, data_source=source), _version=version())


def _versions(t: Landed, table: str) -> DataFrame:
    return t.newest(table).withColumn("at", moment("created_at")).withColumn("collected", moment("collected_at")).filter(
        F.col("at").isNotNull())


def _confluence_people(t: Landed) -> DataFrame | None:
    """Wiki accounts are tracker accounts; without the tracker no e-mail is known."""
    if not t.has("bronze_jira.jira_user"):
        return None
    return _people(t, "bronze_jira.jira_user", ["tenant_id", "account_id"], "account_id")


@feeds("class_wiki_activity", "confluence", "bronze_confluence.wiki_page_versions")
def confluence_activity(t: Landed) -> DataFrame:
    versions = _versions(t, "bronze_confluence.wiki_page_versions").filter(filled(F.col("author_id")))
    daily = _activity(_edits(versions), count0("version_number") == 1, F.lit(None).cast("string"))
    daily = _with_mail(daily, _confluence_people(t), "author_id", "author_email")
    return _activity_rows(daily, F.col("author_email"), "confluence")


@feeds("class_wiki_activity", "outline", "bronze_outline.wiki_page_versions", "bronze_outline.wiki_users")
def outline_activity(t: Landed) -> DataFrame:
    versions = _versions(t, "bronze_outline.wiki_page_versions")
    # The first revision of a page, by whomever, created it.
    versions = with_position(versions, [*PLACE, "page_id"], ["at", "unique_key"], "ordinal")
    daily = _activity(_edits(versions.filter(filled(F.col("author_id")))), F.col("ordinal") == 1, F.nullif("author_email", F.lit("")))
    daily = _with_mail(daily, _people(t, "bronze_outline.wiki_users", [*PLACE, "user_id"], "user_id"), "author_id", "known_mail")
    return _activity_rows(daily, F.coalesce("mail", "known_mail"), "outline")


def _engagement(comments: DataFrame, source: str) -> DataFrame:
    """Comments per page and day. Commenters are counted in two steps, so one
    busy page is pre-aggregated by author."""
    is_reply, inline = F.col("is_reply"), F.col("is_inline")
    kept = comments.withColumn("day", F.to_date(moment("created_at"))).filter(F.col("day").isNotNull() & filled(F.col("page_id")))
    counters = {
        "total_comments": F.lit(True), "footer_comments": ~inline & ~is_reply, "inline_comments": inline & ~is_reply,
        "replies": is_reply, "unresolved_inline_count": inline & ~is_reply & (F.col("resolution_status") == "open"),
    }
    by_author = kept.groupBy(*PLACE, "page_id", "day", "author_id").agg(
        *[F.count_if(c).alias(n) for n, c in counters.items()], F.max("_extracted_at").alias("_extracted_at"))
    df = by_author.groupBy(*PLACE, "page_id", "day").agg(
        *[F.sum(n).alias(n) for n in counters], F.count(F.lit(1)).alias("unique_commenters"), F.max("_extracted_at").alias("_extracted_at"))
    return shape(df, *PLACE, "page_id", "day", *counters, "unique_commenters", unique_key=unique_key(*PLACE, "page_id", "day"),
                 **labels(source=source, data_source=source), collected_at=F.col("_extracted_at"), _version=version())


CONFLUENCE_COMMENTS = {
    # landed table: (is a reply, is inline)
    "wiki_footer_comments": (False, False), "wiki_footer_comment_replies": (True, False),
    "wiki_inline_comments": (False, True), "wiki_inline_comment_replies": (True, True),
}


@feeds("class_wiki_engagement", "confluence", *[f"bronze_confluence.{n}" for n in CONFLUENCE_COMMENTS])
def confluence_engagement(t: Landed) -> DataFrame:
    parts = []
    for name, (reply, inline) in CONFLUENCE_COMMENTS.items():
        df = t.newest(f"bronze_confluence.{name}").filter(filled(F.col("author_id")))
        status = F.lit(None).cast("string") if reply else F.col("resolution_status")
        parts.append(shape(df, *PLACE, "page_id", "author_id", "created_at", "_extracted_at", resolution_status=status,
                           is_reply=F.lit(reply), is_inline=F.lit(inline)))
    return _engagement(union_all(parts), "confluence")


@feeds("class_wiki_engagement", "outline", "bronze_outline.wiki_comments")
def outline_engagement(t: Landed) -> DataFrame:
    df = t.newest("bronze_outline.wiki_comments").filter(filled(F.col("author_id")))
    has = lambda c: F.coalesce(filled(F.col(c)), F.lit(False))
    return _engagement(shape(df, *PLACE, "page_id", "author_id", "created_at", "_extracted_at", "resolution_status",
                             is_reply=has("parent_comment_id"), is_inline=has("anchor_text")), "outline")


def _pages(t: Landed, schema: str, people: DataFrame | None, source: str, embedded: bool) -> DataFrame:
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    mail = lambda c: empty(c) if embedded else F.lit(None).cast("string")
    pages = shape(
        t.newest(f"{schema}.wiki_pages"), *PLACE, "unique_key", "page_id", "title", "status", "_extracted_at", space_id=empty("space_id"),
        author_id=empty("author_id"), last_editor_id=empty("last_editor_id"), parent_page_id=empty("parent_page_id"),
        own_mail=mail("author_email"), own_editor_mail=mail("last_editor_email"), version_count=count0("version_number"),
        created_at=moment("created_at"), updated_at=moment("updated_at"), collected_at=moment("collected_at"))
    spaces = t.newest(f"{schema}.wiki_spaces").select(
        *PLACE, "space_id", F.col("name").alias("space_name"), F.col("url").alias("space_url"))
    df = pages.join(spaces, [*PLACE, "space_id"], "left")
    df = _with_mail(df, people, "author_id", "known_mail")
    df = _with_mail(df, people, "last_editor_id", "known_editor_mail")
    return df.withColumn("author_email", F.coalesce("own_mail", "known_mail")).withColumn(
        "last_editor_email", F.coalesce("own_editor_mail", "known_editor_mail")).select(
        "*", F.lit(source).alias("source"), F.lit(source).alias("data_source"), version().alias("_version"))


@feeds("class_wiki_pages", "confluence", "bronze_confluence.wiki_pages", "bronze_confluence.wiki_spaces")
def confluence_pages(t: Landed) -> DataFrame:
    return _pages(t, "bronze_confluence", _confluence_people(t), "confluence", embedded=False)


@feeds("class_wiki_pages", "outline", "bronze_outline.wiki_pages", "bronze_outline.wiki_spaces", "bronze_outline.wiki_users")
def outline_pages(t: Landed) -> DataFrame:
    people = _people(t, "bronze_outline.wiki_users", [*PLACE, "user_id"], "user_id")
    return _pages(t, "bronze_outline", people, "outline", embedded=True)
