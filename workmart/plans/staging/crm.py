"""CRM systems -> class_crm_*."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from workmart.functions.scalars import filled, flag, moment, number, typed_reference, whole_div
from workmart.operators.reshape import union_all
from workmart.plans.registry import Landed, feeds
from workmart.plans.staging.shape import KEYS, count, first_of, flat_json, shape, truth

DEAL_PREFIX, ACCOUNT_PREFIX = "006", "001"


# --- HubSpot: live tables plus their archives, when those exist --------------------

def _hubspot(t: Landed, name: str) -> DataFrame:
    return t.together(f"bronze_hubspot.{name}", f"bronze_hubspot.{name}_archived")


def _hubspot_version() -> Column:
    zero = F.lit(0).cast("bigint")
    at = lambda c: F.coalesce(F.unix_millis(moment(c)), zero)
    return F.greatest(at("updatedAt"), at("archivedAt"))


def _hubspot_rows(df: DataFrame, details: dict[str, str], **columns: Column) -> DataFrame:
    facts = flat_json(**details, archived=truth("archived"))
    return shape(df, *KEYS, "data_source", **columns, metadata=facts, _version=_hubspot_version())


def _properties(*names: str) -> dict[str, str]:
    return {n: f"properties_{n}" for n in names}


@feeds("class_crm_accounts", "hubspot", "bronze_hubspot.companies")
def hubspot_accounts(t: Landed) -> DataFrame:
    return _hubspot_rows(
        _hubspot(t, "companies"), _properties("city", "state", "country", "numberofemployees", "annualrevenue"),
        account_id=F.col("id"), name=F.col("properties_name"), domain=F.col("properties_domain"),
        industry=F.col("properties_industry"), owner_id=F.col("properties_hubspot_owner_id"),
        created_at=moment("createdAt"), updated_at=moment("updatedAt"))


@feeds("class_crm_contacts", "hubspot", "bronze_hubspot.contacts")
def hubspot_contacts(t: Landed) -> DataFrame:
    return _hubspot_rows(
        _hubspot(t, "contacts"),
        _properties("phone", "city", "state", "country", "jobtitle", "hs_lead_status", "hs_analytics_source"),
        contact_id=F.col("id"), email=F.col("properties_email"), first_name=F.col("properties_firstname"),
        last_name=F.col("properties_lastname"), owner_id=F.col("properties_hubspot_owner_id"),
        account_id=first_of("associations_companies"), lifecycle_stage=F.col("properties_lifecyclestage"),
        created_at=moment("createdAt"), updated_at=moment("updatedAt"))


@feeds("class_crm_deals", "hubspot", "bronze_hubspot.deals")
def hubspot_deals(t: Landed) -> DataFrame:
    yes = lambda c: flag(F.coalesce(F.col(c).cast("string"), F.lit("false")) == "true")
    return _hubspot_rows(
        _hubspot(t, "deals"), {"pipeline": "properties_pipeline", "deal_type": "properties_dealtype"},
        deal_id=F.col("id"), name=F.col("properties_dealname"), forecast_category=F.col("properties_hs_manual_forecast_category"),
        stage=F.col("properties_dealstage"), amount=number("properties_amount"),
        amount_home=number("properties_amount_in_home_currency"), acv=number("properties_hs_acv"),
        tcv=number("properties_hs_tcv"), arr=number("properties_hs_arr"), close_date=F.to_date(moment("properties_closedate")),
        owner_id=F.col("properties_hubspot_owner_id"), created_by_user_id=F.col("properties_hs_created_by_user_id"),
        account_id=first_of("associations_companies"), is_closed=yes("properties_hs_is_closed"),
        is_won=yes("properties_hs_is_closed_won"), lead_source=F.col("properties_hs_analytics_source"),
        probability=number("properties_hs_deal_stage_probability"), deal_type=F.col("properties_dealtype"),
        lost_reason=F.col("properties_closed_lost_reason"), pipeline_id=F.col("properties_pipeline"),
        created_at=moment("createdAt"), updated_at=moment("updatedAt"))


@feeds("class_crm_users", "hubspot", "bronze_hubspot.owners")
def hubspot_users(t: Landed) -> DataFrame:
    return _hubspot_rows(
        _hubspot(t, "owners").filter(filled(F.col("email"))), {"userId": "userId"}, user_id=F.col("id"),
        hs_user_id=F.col("userId").cast("string"), email=F.col("email"), first_name=F.col("firstName"),
        last_name=F.col("lastName"), is_active=flag(~truth("archived")), collected_at=moment("collected_at"))


# Engagement kinds: landed table, result column, JSON details.
ENGAGEMENTS = {
    "call": ("engagements_calls", "properties_hs_call_disposition",
             {"title": "properties_hs_call_title", "direction": "properties_hs_call_direction"}),
    "email": ("engagements_emails", "properties_hs_email_status",
              {"subject": "properties_hs_email_subject", "direction": "properties_hs_email_direction"}),
    "meeting": ("engagements_meetings", "properties_hs_meeting_outcome",
                {"title": "properties_hs_meeting_title", "location": "properties_hs_meeting_location"}),
    "task": ("engagements_tasks", "properties_hs_task_status",
             {"subject": "properties_hs_task_subject", "priority": "properties_hs_task_priority", "type": "properties_hs_task_type"}),
}


def _engagement(t: Landed, kind: str) -> DataFrame:
    table, outcome, details = ENGAGEMENTS[kind]
    # Meetings have no archive of their own.
    df = t(f"bronze_hubspot.{table}") if kind == "meeting" else _hubspot(t, table)
    none = F.lit(None).cast("bigint")
    happened = [moment("properties_hs_timestamp"), moment("createdAt"), F.timestamp_seconds(F.lit(0))]
    length = none
    if kind == "call":
        length = whole_div(count("properties_hs_call_duration"), 1000)
    if kind == "meeting":
        start, end = moment("properties_hs_meeting_start_time"), moment("properties_hs_meeting_end_time")
        happened.insert(0, start)
        length = whole_div(F.unix_millis(end) - F.unix_millis(start), 1000)
    if "archivedAt" not in df.columns:
        df = df.withColumn("archivedAt", F.lit(None).cast("string"))
    return _hubspot_rows(
        df, details, activity_id=F.col("id"), activity_type=F.lit(kind), owner_id=F.col("properties_hubspot_owner_id"),
        created_by_user_id=F.col("properties_hs_created_by_user_id"), contact_id=first_of("associations_contacts"),
        deal_id=first_of("associations_deals"), account_id=first_of("associations_companies"),
        timestamp=F.coalesce(*happened), duration_seconds=length, outcome=F.col(outcome), created_at=moment("createdAt"))


@feeds("class_crm_activities", "hubspot", *[f"bronze_hubspot.{v[0]}" for v in ENGAGEMENTS.values()])
def hubspot_activities(t: Landed) -> DataFrame:
    return union_all(_engagement(t, kind) for kind in ENGAGEMENTS)


# --- Salesforce ------------------------------------------------------------------------

def _salesforce(t: Landed, table: str, details: tuple[str, ...], **columns: Column) -> DataFrame:
    facts = flat_json(**{n: n for n in details}, IsDeleted=truth("IsDeleted"))
    return shape(t(f"bronze_salesforce.{table}"), *KEYS, "custom_fields", "data_source", **columns, metadata=facts,
                 _version=F.unix_millis(moment("SystemModstamp")))


def _dated() -> dict[str, Column]:
    return {"created_at": moment("CreatedDate"), "updated_at": moment("LastModifiedDate")}


@feeds("class_crm_accounts", "salesforce", "bronze_salesforce.Account")
def salesforce_accounts(t: Landed) -> DataFrame:
    host = F.regexp_extract("Website", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://|//)?(?:[^@/]*@)?([^:/?#]+)", 1)
    return _salesforce(
        t, "Account", ("Type", "BillingCity", "BillingState", "BillingCountry", "NumberOfEmployees", "AnnualRevenue"),
        account_id=F.col("Id"), name=F.col("Name"), domain=host, industry=F.col("Industry"), owner_id=F.col("OwnerId"),
        parent_account_id=F.col("ParentId"), **_dated())


@feeds("class_crm_contacts", "salesforce", "bronze_salesforce.Contact")
def salesforce_contacts(t: Landed) -> DataFrame:
    return _salesforce(
        t, "Contact", ("Title", "Phone", "LeadSource"), contact_id=F.col("Id"), email=F.col("Email"),
        first_name=F.col("FirstName"), last_name=F.col("LastName"), owner_id=F.col("OwnerId"), account_id=F.col("AccountId"), **_dated())


@feeds("class_crm_deals", "salesforce", "bronze_salesforce.Opportunity")
def salesforce_deals(t: Landed) -> DataFrame:
    return _salesforce(
        t, "Opportunity", ("Type",), deal_id=F.col("Id"), name=F.col("Name"), forecast_category=F.col("ForecastCategory"),
        stage=F.col("StageName"), amount=number("Amount"), amount_home=number("Amount"), close_date=F.col("CloseDate").try_cast("date"),
        owner_id=F.col("OwnerId"), created_by_user_id=F.col("CreatedById"), account_id=F.col("AccountId"),
        is_closed=flag(truth("IsClosed")), is_won=flag(truth("IsWon")), lead_source=F.col("LeadSource"),
        probability=number("Probability"), deal_type=F.col("Type"), **_dated())


@feeds("class_crm_users", "salesforce", "bronze_salesforce.User")
def salesforce_users(t: Landed) -> DataFrame:
    return _salesforce(
        t, "User", ("Username", "ProfileId", "UserRoleId"), user_id=F.col("Id"), email=F.col("Email"),
        first_name=F.col("FirstName"), last_name=F.col("LastName"), title=F.col("Title"), department=F.col("Department"),
        is_active=flag(truth("IsActive")), collected_at=moment("collected_at"))


@feeds("class_crm_activities", "salesforce", "bronze_salesforce.Task", "bronze_salesforce.Event")
def salesforce_activities(t: Landed) -> DataFrame:
    linked = {
        "activity_id": F.col("Id"), "owner_id": F.col("OwnerId"), "created_by_user_id": F.col("CreatedById"),
        "contact_id": F.col("WhoId"), "deal_id": typed_reference("WhatId", DEAL_PREFIX),
        "account_id": typed_reference("WhatId", ACCOUNT_PREFIX), "created_at": moment("CreatedDate"),
    }
    is_call = F.col("CallType").isNotNull()
    tasks = _salesforce(
        t, "Task", ("Subject", "Priority", "TaskSubtype", "CallType"), **linked,
        activity_type=F.when(is_call, "call").when(F.col("TaskSubtype") == "Email", "email").otherwise("task"),
        timestamp=moment(F.coalesce(F.col("ActivityDate").cast("string"), F.col("CreatedDate").cast("string"))),
        duration_seconds=F.when(is_call, count("CallDurationInSeconds")), outcome=F.col("Status"))
    meets = F.coalesce(F.col("EventSubtype"), F.lit("Event")) != "Event"
    when = F.coalesce(*[F.col(c).cast("string") for c in ("StartDateTime", "ActivityDate", "CreatedDate")])
    events = _salesforce(
        t, "Event", ("Subject", "Location", "EndDateTime", "EventSubtype"), **linked,
        activity_type=F.when(meets, "meeting").otherwise("event"), timestamp=moment(when),
        duration_seconds=count("DurationInMinutes") * 60)
    return union_all([tasks, events])


