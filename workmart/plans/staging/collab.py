"""Chat, mail, meetings, documents -> class_collab_*."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from workmart.functions.keys import hashed_key
from workmart.functions.scalars import (
    clamp, day, filled, iso_duration_seconds, millis, moment, seconds_between, text,
)
from workmart.operators.latest import latest_by
from workmart.operators.sessions import sessionize
from workmart.plans.registry import Landed, feeds
from workmart.plans.staging.shape import count, count0, shape, total0, truth, unique_key

MEETING_GAP_SECONDS = 300


def _stamp(t: Landed, data_source: str) -> dict[str, Column]:
    return {"collected_at": t.as_of, "data_source": F.lit(data_source), "_version": millis(t.as_of)}


def _m365(t: Landed, table: str, *key: Column | str, **columns: Column) -> DataFrame:
    """Daily report rows of one suite report; the account name is the e-mail."""
    name = F.col("userPrincipalName")
    df = t(f"bronze_m365.{table}").filter(filled(name))
    return shape(
        df, "tenant_id", "source_id", unique_key=hashed_key("tenant_id", "source_id", name, "reportRefreshDate", *key),
        user_id=name, user_name=name, email=name, person_key=F.lower(name), date=F.to_date("reportRefreshDate"),
        **columns, report_period=F.col("reportPeriod"), **_stamp(t, "m365"))


@feeds("class_collab_chat_activity", "m365", "bronze_m365.teams_activity")
def m365_chats(t: Landed) -> DataFrame:
    return _m365(
        t, "teams_activity", direct_messages=count("privateChatMessageCount"),
        direct_and_group_messages=count("privateChatMessageCount"),
        total_chat_messages=total0("privateChatMessageCount", "teamChatMessageCount"),
        channel_posts=count("postMessages"), channel_replies=count("replyMessages"), urgent_messages=count("urgentMessages"))


@feeds("class_collab_meeting_activity", "m365", "bronze_m365.teams_activity")
def m365_meetings(t: Landed) -> DataFrame:
    return _m365(
        t, "teams_activity", calls_count=count0("callCount"), meetings_organized=count0("meetingsOrganizedCount"),
        meetings_attended=count0("meetingsAttendedCount"), adhoc_meetings_organized=count0("adHocMeetingsOrganizedCount"),
        adhoc_meetings_attended=count0("adHocMeetingsAttendedCount"),
        scheduled_meetings_organized=total0("scheduledOneTimeMeetingsOrganizedCount", "scheduledRecurringMeetingsOrganizedCount"),
        scheduled_meetings_attended=total0("scheduledOneTimeMeetingsAttendedCount", "scheduledRecurringMeetingsAttendedCount"),
        audio_duration_seconds=iso_duration_seconds("audioDuration"), video_duration_seconds=iso_duration_seconds("videoDuration"),
        screen_share_duration_seconds=iso_duration_seconds("screenShareDuration"))


@feeds("class_collab_email_activity", "m365", "bronze_m365.email_activity")
def m365_emails(t: Landed) -> DataFrame:
    return _m365(
        t, "email_activity", sent_count=count("sendCount"), received_count=count("receiveCount"), read_count=count("readCount"),
        meetings_created=count("meetingCreatedCount"), meetings_interacted=count("meetingInteractedCount"))


def _m365_documents(t: Landed, product: str, **more: Column) -> DataFrame:
    return _m365(
        t, f"{product}_activity", F.lit(product), product=F.lit(product), viewed_or_edited_count=count("viewedOrEditedFileCount"),
        synced_count=count("syncedFileCount"), shared_internally_count=count("sharedInternallyFileCount"),
        shared_externally_count=count("sharedExternallyFileCount"), **more)


feeds("class_collab_document_activity", "m365_onedrive", "bronze_m365.onedrive_activity")(
    lambda t: _m365_documents(t, "onedrive"))
feeds("class_collab_document_activity", "m365_sharepoint", "bronze_m365.sharepoint_activity")(
    lambda t: _m365_documents(t, "sharepoint", visited_page_count=count("visitedPageCount")))


@feeds("class_collab_chat_activity", "slack", "bronze_slack.users_details")
def slack_chats(t: Landed) -> DataFrame:
    df = t("bronze_slack.users_details").withColumn("__day", day("date")).filter(
        filled(F.col("user_id")) & F.col("__day").isNotNull())
    mail = text("email_address")
    return shape(
        df, "tenant_id", "source_id", "user_id", unique_key=hashed_key("tenant_id", "source_id", "user_id", "__day"),
        user_name=mail, email=mail, person_key=F.when(mail != "", F.lower(mail)).otherwise(F.lower("user_id")), date=F.col("__day"),
        direct_and_group_messages=clamp(count0("messages_posted_count") - count0("channel_messages_posted_count"), low=0),
        total_chat_messages=count0("messages_posted_count"), channel_posts=count("channel_messages_posted_count"),
        **_stamp(t, "slack"))


def slack_users_latest(t: Landed) -> DataFrame:
    """Newest daily row with an e-mail per chat user."""
    df = t("bronze_slack.users_details").filter(filled(F.col("email_address")))
    newest = latest_by(df, ["tenant_id", "source_id", "user_id"], ["date"], ["email_address"])
    return shape(newest, "tenant_id", "source_id", "user_id", "is_guest", "is_billable_seat",
                 email=F.col("email_address"), unique_key=unique_key("tenant_id", "source_id", "user_id"))


@feeds("class_collab_chat_activity", "zulip_proxy", "bronze_zulip_proxy.messages", "bronze_zulip_proxy.users")
def zulip_chats(t: Landed) -> DataFrame:
    where = ["tenant_id", "source_id"]
    messages = latest_by(t("bronze_zulip_proxy.messages").withColumn("date", day("created_at")).filter("date is not null"),
                         [*where, "uniq"], ["_extracted_at"], ["sender_id"])
    # Per sender and day before the join: a bot's messages become a few rows.
    daily = messages.groupBy(*where, "sender_id", "date").agg(F.sum(count0("count")).alias("messages"))
    users = t.newest("bronze_zulip_proxy.users").filter(filled(F.col("email"))).select(
        *where, F.col("id").alias("sender_id"), F.lower("email").alias("email"), "full_name")
    df = daily.join(users, [*where, "sender_id"]).groupBy(*where, "email", "date").agg(
        F.sum("messages").alias("total_chat_messages"), F.coalesce(F.min("full_name"), F.lit("")).alias("user_name"))
    return shape(df, *where, "email", "date", "user_name", "total_chat_messages",
                 unique_key=hashed_key(*where, "email", "date"), user_id=F.col("email"), person_key=F.col("email"),
                 **_stamp(t, "zulip_proxy"))


def zoom_sessions(t: Landed) -> DataFrame:
    """Meeting instances of one meeting id that follow each other within five
    minutes are one logical meeting."""
    known = t("bronze_zoom.meetings").filter(F.col("id").isNotNull() & filled(F.col("uuid")))
    rows = latest_by(known, ["uuid"], ["_extracted_at"], ["tenant_id", "source_id"]).select(
        "tenant_id", "source_id", F.col("id").cast("string").alias("id"), "uuid", "has_video", "has_screen_share",
        moment("start_time").alias("start_ts"), moment("end_time").alias("end_ts")).filter("start_ts is not null")
    rows = sessionize(rows, ["tenant_id", "source_id", "id"], "start_ts", MEETING_GAP_SECONDS, "end_ts", ["uuid"], "cluster")
    return shape(rows, "tenant_id", "source_id", "uuid", "id", "has_video", "has_screen_share",
                 unique_key=unique_key("tenant_id", "source_id", "uuid"),
                 logical_meeting_id=unique_key("id", "cluster", sep="#"), collected_at=t.as_of, _version=millis(t.as_of))


@feeds("class_collab_meeting_activity", "zoom", "bronze_zoom.participants", "bronze_zoom.meetings")
def zoom_meetings(t: Landed) -> DataFrame:
    where = ["tenant_id", "source_id"]
    joins = t("bronze_zoom.participants").withColumn("__join", moment("join_time")).filter(
        F.col("__join").isNotNull() & filled(F.col("email")))
    joins = latest_by(joins, ["meeting_uuid", "participant_uuid", "join_time"], ["_extracted_at"], [*where, "email"])
    logical = zoom_sessions(t).select(*where, F.col("uuid").alias("meeting_uuid"), "logical_meeting_id")
    df = joins.join(logical, [*where, "meeting_uuid"], "left")
    spent = F.coalesce(seconds_between(F.col("__join"), moment("leave_time")), F.lit(0))
    shared = truth("share_desktop") | truth("share_application") | truth("share_whiteboard")
    df = df.groupBy(*where, "email", F.to_date("__join").alias("date")).agg(
        F.coalesce(F.min("user_name"), F.lit("")).alias("user_name"),
        F.count_distinct(F.coalesce("logical_meeting_id", "meeting_uuid")).alias("meetings_attended"),
        F.sum(spent).alias("audio_duration_seconds"),
        F.sum(F.when(filled(F.col("camera")), spent).otherwise(0)).alias("video_duration_seconds"),
        F.sum(F.when(shared, spent).otherwise(0)).alias("screen_share_duration_seconds"))
    return shape(df, *where, "email", "date", "user_name", "meetings_attended", "audio_duration_seconds",
                 "video_duration_seconds", "screen_share_duration_seconds",
                 unique_key=hashed_key(*where, F.lower("email"), "date"), user_id=F.col("email"),
                 person_key=F.lower("email"), **_stamp(t, "zoom"))
