"""HR directories and account lists -> class_people, class_hr_*, identity_inputs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from workmart.functions.keys import stable_uuid, surrogate_id, unique_key
from workmart.functions.scalars import filled, json_text, millis, moment, normal_email, number, text
from workmart.operators.history import field_changes, identity_inputs, scd2_append
from workmart.operators.incremental import unknown_keys
from workmart.operators.latest import latest_by
from workmart.plans.registry import Landed, feeds
from workmart.plans.staging.collab import slack_users_latest
from workmart.plans.staging.shape import labels, shape, truth, version

HOURS_PER_DAY, HOURS_PER_WEEK = 8.0, 40.0
NIL_UUID = "00000000-0000-0000-0000-000000000000"


# --- people ------------------------------------------------------------------------

def _person(df: DataFrame, source: str, changed: str, extras: dict[str, Column], **columns: Column) -> DataFrame:
    pairs = [x for n, c in extras.items() for x in (F.lit(n), c)]
    return shape(
        df, "tenant_id", "source_id", unique_key=unique_key("unique_key", F.coalesce(F.col(changed).cast("string"), F.lit(""))),
        workspace_id=text("tenant_id"), valid_from=moment(changed), source=F.lit(source), **columns,
        custom_str_attrs=F.create_map(*pairs), custom_num_attrs=F.create_map().cast("map<string,double>"), ingested_at=F.col("_extracted_at"))


@feeds("class_people", "bamboohr", "bronze_bamboohr.employees")
def bamboohr_people(t: Landed) -> DataFrame:
    status = F.when(F.col("status") == "Active", "active").when(
        F.col("employmentHistoryStatus") == "Terminated", "terminated").otherwise("active")
    return _person(
        t("bronze_bamboohr.employees"), "bamboohr", "lastChanged", {"division": text("division")},
        source_person_id=F.col("id").cast("string"), employee_number=F.col("employeeNumber"), display_name=F.col("displayName"),
        first_name=F.col("firstName"), last_name=F.col("lastName"), email=F.col("workEmail"), job_title=F.col("jobTitle"),
        department_name=F.col("department"), manager_person_id=F.col("supervisorEId"), status=status,
        employment_type=F.lit("full_time"), hire_date=moment("hireDate"), termination_date=moment("terminationDate"),
        location=F.col("location"), country=F.col("country"))


@feeds("class_people", "ms_entra", "bronze_ms_entra.users")
def entra_people(t: Landed) -> DataFrame:
    enabled = F.coalesce(F.col("accountEnabled").cast("string").try_cast("boolean"), F.lit(True))
    return _person(
        t("bronze_ms_entra.users"), "ms-entra", "createdDateTime",
        {"user_type": text("userType"), "sam_account_name": text("onPremisesSamAccountName")},
        source_person_id=F.col("id"), employee_number=F.col("employeeId"), display_name=F.col("displayName"),
        first_name=F.col("givenName"), last_name=F.col("surname"), email=F.coalesce("mail", "userPrincipalName"),
        job_title=F.col("jobTitle"), department_name=F.col("department"),
        status=F.when(enabled, "active").otherwise("terminated"), employment_type=F.lit("full_time"))


@feeds("class_people", "workday", "bronze_workday.workers")
def workday_people(t: Landed) -> DataFrame:
    status = F.when(F.col("Worker_Status") == "Terminated", "terminated").when(
        F.col("Worker_Status") == "On Leave", "on_leave").otherwise("active")
    return _person(
        t("bronze_workday.workers"), "workday", "Last_Functionally_Updated",
        {"job_profile": text("Job_Profile"), "worker_type": text("Worker_Type")}, source_person_id=F.col("Employee_ID"),
        employee_number=F.col("Employee_ID"), display_name=F.col("Display_Name"), first_name=F.col("First_Name"),
        last_name=F.col("Last_Name"), email=F.col("Work_Email"), job_title=F.col("Business_Title"),
        department_name=F.col("Supervisory_Organization"), manager_person_id=F.col("Manager_Employee_ID"), status=status,
        employment_type=F.when(F.col("Worker_Type") == "Contingent Worker", "contractor").otherwise("full_time"),
        hire_date=moment("Hire_Date"), termination_date=moment("Termination_Date"), location=F.col("Location"), country=F.col("Country"))


@feeds("class_hr_working_hours", "bamboohr", "bronze_bamboohr.employees")
def bamboohr_hours(t: Landed) -> DataFrame:
    df = t("bronze_bamboohr.employees").filter((F.col("status") == "Active") & F.col("id").isNotNull() & F.col("workEmail").isNotNull())
    return shape(df, "tenant_id", "source_id", "unique_key", source_person_id=F.col("id").cast("string"), email=F.col("workEmail"),
                 display_name=F.coalesce("displayName", "workEmail"), employment_type=F.col("employmentHistoryStatus"),
                 source=F.lit("bamboohr"), working_hours_per_day=F.lit(HOURS_PER_DAY), working_hours_per_week=F.lit(HOURS_PER_WEEK),
                 ingested_at=F.col("_extracted_at"))


@feeds("class_hr_working_hours", "workday", "bronze_workday.workers")
def workday_hours(t: Landed) -> DataFrame:
    df = t("bronze_workday.workers").filter(
        (F.col("Worker_Status") == "Active") & F.col("Employee_ID").isNotNull() & F.col("Work_Email").isNotNull())
    weekly = F.coalesce(number("Scheduled_Weekly_Hours"), F.lit(HOURS_PER_WEEK))
    return shape(df, "tenant_id", "source_id", "unique_key", source_person_id=F.col("Employee_ID"), email=F.col("Work_Email"),
                 display_name=F.coalesce("Display_Name", "Work_Email"), employment_type=F.col("Worker_Type"),
                 source=F.lit("workday"), working_hours_per_day=weekly / 5.0, working_hours_per_week=weekly,
                 ingested_at=F.col("_extracted_at"))


def _leave(df: DataFrame, source: str, start: str, end: str, **columns: Column) -> DataFrame:
    dated = df.withColumn("start_date", moment(start)).withColumn("end_date", moment(end)).filter(
        F.col("start_date").isNotNull() & F.col("end_date").isNotNull())
    return shape(dated, "tenant_id", "source_id", "unique_key", "email", "start_date", "end_date", **columns,
                 **labels(event_type="leave", source=source), ingested_at=F.col("_extracted_at"), _version=version())


@feeds("class_hr_events", "bamboohr", "bronze_bamboohr.leave_requests", "bronze_bamboohr.employees")
def bamboohr_events(t: Landed) -> DataFrame:
    mails = t.newest("bronze_bamboohr.employees").select("tenant_id", F.col("id").alias("employeeId"), F.col("workEmail").alias("email"))
    df = t("bronze_bamboohr.leave_requests").filter(F.col("employeeId").isNotNull()).join(mails, ["tenant_id", "employeeId"], "left")
    return _leave(
        df, "bamboohr", "start", "end", source_person_id=F.col("employeeId").cast("string"),
        event_subtype=json_text("type", "name"), duration_amount=number(json_text("amount", "amount")),
        duration_unit=json_text("amount", "unit"), request_status=json_text("status", "status"), created_at=moment("created"))


@feeds("class_hr_events", "workday", "bronze_workday.leave_requests", "bronze_workday.workers")
def workday_events(t: Landed) -> DataFrame:
    who = ["tenant_id", "source_id", "Employee_ID"]
    mails = t.newest("bronze_workday.workers").select(*who, F.col("Work_Email").alias("email"))
    df = t("bronze_workday.leave_requests").filter(F.col("Employee_ID").isNotNull()).join(mails, who, "left")
    return _leave(
        df, "workday", "Start_Date", "End_Date", source_person_id=F.col("Employee_ID"), event_subtype=F.col("Time_Off_Type"),
        duration_amount=number("Quantity"), duration_unit=F.col("Unit"), request_status=F.col("Status"),
        created_at=moment("Submitted_Moment"))


# --- account histories ----------------------------------------------------------------

@dataclass(frozen=True)
class Directory:
    """An account list whose changes are tracked (H1-H3)."""

    source_type: str
    table: str
    entity: str
    tracked: tuple[str, ...]
    # (field, value type) of what identifies a person
    identity: tuple[tuple[str, str], ...] = ()
    # (field, values in lower case) that end an account
    ends: tuple[str, tuple[str, ...]] | None = None
    custom: tuple[str, ...] = field(default=())

    def rows(self, t: Landed) -> DataFrame:
        return slack_users_latest(t) if self.source_type == "slack" else t.newest(self.table)

    def snapshot(self, t: Landed, previous: DataFrame | None = None) -> DataFrame:
        return scd2_append(self.rows(t), previous, "unique_key", self.tracked, self.custom, t.as_of)

    def changes(self, versions: DataFrame) -> DataFrame:
        return field_changes(versions, "unique_key", self.entity, self.tracked, self.custom)

    def inputs(self, changes: DataFrame, since: Column | None = None) -> DataFrame:
        name, values = self.ends
        gone = (F.col("field_name") == name) & F.lower("new_value").isin(*values)
        return identity_inputs(changes, self.source_type,
                               [(f, v, f"{self.table}.{f}") for f, v in self.identity], gone, since)


# Tracked fields, identifying fields, end states.
DIRECTORIES = {d.source_type: d for d in (
    Directory(
        "bamboohr", "bronze_bamboohr.employees", "id",
        ("displayName", "firstName", "lastName", "workEmail", "employeeNumber", "jobTitle", "department", "division",
         "status", "employmentHistoryStatus", "supervisorEId", "supervisorEmail", "location", "country", "city",
         "hireDate", "terminationDate"),
        (("workEmail", "email"), ("employeeNumber", "employee_id"), ("displayName", "display_name"),
         ("firstName", "first_name"), ("lastName", "last_name"), ("department", "department"), ("division", "division"),
         ("jobTitle", "job_title"), ("status", "status"), ("supervisorEmail", "parent_email"), ("supervisorEId", "parent_id")),
        ("status", ("inactive", "terminated"))),
    Directory(
        "ms-entra", "bronze_ms_entra.users", "id",
        ("userPrincipalName", "mail", "displayName", "givenName", "surname", "employeeId", "department", "jobTitle",
         "accountEnabled", "onPremisesSamAccountName", "userType"),
        (("mail", "email"), ("userPrincipalName", "email"), ("employeeId", "employee_id"),
         ("displayName", "display_name"), ("onPremisesSamAccountName", "sam_account")),
        ("accountEnabled", ("false",))),
    Directory(
        "workday", "bronze_workday.workers", "Employee_ID",
        ("Display_Name", "First_Name", "Last_Name", "Work_Email", "Business_Title", "Job_Profile", "Worker_Type",
         "Worker_Status", "Supervisory_Organization", "Manager_Employee_ID", "Manager_Work_Email", "Location", "Country",
         "City", "Hire_Date", "Original_Hire_Date", "Termination_Date", "Scheduled_Weekly_Hours"),
        (("Work_Email", "email"), ("Employee_ID", "employee_id"), ("Display_Name", "display_name"),
         ("First_Name", "first_name"), ("Last_Name", "last_name"), ("Supervisory_Organization", "department"),
         ("Business_Title", "job_title"), ("Worker_Status", "status"), ("Manager_Work_Email", "parent_email"),
         ("Manager_Employee_ID", "parent_id")),
        ("Worker_Status", ("terminated",))),
    Directory(
        "zoom", "bronze_zoom.users", "id",
        ("first_name", "last_name", "display_name", "email", "dept", "status", "role_id", "timezone", "language",
         "phone_number", "employee_unique_id", "type"),
        (("email", "email"), ("employee_unique_id", "employee_id"), ("display_name", "display_name")),
        ("status", ("inactive",))),
    Directory(
        "zulip_proxy", "bronze_zulip_proxy.users", "id",
        ("full_name", "email", "is_active", "role", "recipient_id", "uuid"),
        (("email", "email"), ("full_name", "display_name")), ("is_active", ("false",))),
    Directory(
        "outline", "bronze_outline.wiki_users", "user_id", ("name", "email", "role", "is_suspended"),
        (("email", "email"), ("name", "display_name")), ("is_suspended", ("true",))),
    Directory("cursor", "bronze_cursor.cursor_members", "id", ("name", "role", "isRemoved")),
    Directory("slack", "bronze_slack.users_details", "unique_key", ("email", "is_guest", "is_billable_seat")),
    Directory("jira", "bronze_jira.jira_user", "account_id", ("display_name", "email", "active", "account_type")),
)}


def _register(d: Directory) -> None:
    if d.identity:
        feeds("identity_inputs", d.source_type, d.table)(lambda t: d.inputs(d.changes(d.snapshot(t))))


for _directory in DIRECTORIES.values():
    _register(_directory)


# --- seeds from member lists (H4-H6) ----------------------------------------------------

@dataclass(frozen=True)
class MemberList:
    source_type: str
    table: str
    removed: str | None = None


MEMBER_LISTS = {m.source_type: m for m in (
    MemberList("cursor", "bronze_cursor.cursor_members", "isRemoved"),
    MemberList("claude_admin", "bronze_claude_admin.claude_admin_users"),
)}


def _members(t: Landed, m: MemberList) -> DataFrame:
    """Newest row per tenant and e-mail."""
    df = t(m.table).filter(filled(F.trim("email"))).withColumn("mail", normal_email("email")).withColumn(
        "person_tenant", stable_uuid(text("tenant_id")))
    return latest_by(df, ["mail", "person_tenant"], ["_extracted_at"], [F.col("id").cast("string")])


def seed_persons(t: Landed, source_type: str, known: DataFrame | None = None) -> DataFrame:
    """Golden records of members nobody knows yet (H5); a third of the seven
    attributes can come from a member list."""
    m = MEMBER_LISTS[source_type]
    df = _members(t, m)
    status = F.when(truth(m.removed), "inactive").otherwise("active") if m.removed else F.lit("active")
    have = [F.coalesce(filled(F.col(c)), F.lit(False)).cast("int") for c in ("name", "email", "role")]
    rows = shape(
        df, id=surrogate_id(F.lit("person"), "person_tenant", "mail"), tenant_id=F.col("person_tenant"),
        display_name=text("name"), display_name_source=F.lit(source_type), status=status, email=F.col("mail"),
        email_source=F.lit(source_type), role=text("role"), role_source=F.lit(source_type),
        **labels(username="", username_source="", manager_person_id=NIL_UUID, manager_person_id_source="", org_unit_id=NIL_UUID,
                 org_unit_id_source="", location="", location_source="", conflict_status="clean"),
        completeness_score=(have[0] + have[1] + have[2]) / 7.0, created_at=t.as_of, updated_at=t.as_of, is_deleted=F.lit(0),
        _version=millis(t.as_of))
    if known is None:
        return rows
    live = known.filter("is_deleted = 0").select("tenant_id", F.lower("email").alias("email"))
    return unknown_keys(rows, live, ["tenant_id", "email"])


def _facts(df: DataFrame, m: MemberList, keep: list[str]) -> DataFrame:
    """E-mail, id and display name of each member as rows."""
    fact = lambda kind, value, column: F.when(filled(value), F.struct(
        F.lit(kind).alias("value_type"), value.alias("value"), F.lit(f"{m.table}.{column}").alias("value_field_name")))
    facts = F.array(fact("email", F.col("mail"), "email"), fact("id", F.trim(F.col("id").cast("string")), "id"),
                    fact("display_name", F.trim("name"), "name"))
    return df.withColumn("source_account_id", F.col("id").cast("string")).select(
        *keep, "source_account_id", F.inline(F.filter(facts, lambda f: f.isNotNull())))


def seed_identity_inputs(t: Landed, source_type: str, known: DataFrame | None = None) -> DataFrame:
    """Observations of a member list that are not there yet (H4)."""
    m = MEMBER_LISTS[source_type]
    rows = _facts(_members(t, m), m, ["person_tenant"]).select(
        F.col("person_tenant").alias("tenant_id"), F.lit(NIL_UUID).alias("source_id"), F.lit(source_type).alias("source_type"),
        "source_account_id", "value_type", "value", "value_field_name", F.lit("UPSERT").alias("operation_type"),
        t.as_of.alias("_synced_at"), millis(t.as_of).alias("_version"))
    rows = rows.withColumn("unique_key", unique_key(
        "tenant_id", "source_type", "source_account_id", "value_type", "operation_type", "_version"))
    if known is None:
        return rows
    return unknown_keys(rows, known, ["tenant_id", "source_type", "source_account_id", "value_type", "value"])


def seed_aliases(t: Landed, source_type: str, persons: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Aliases of known persons from a member list (H6)."""
    m = MEMBER_LISTS[source_type]
    owners = persons.select(F.col("tenant_id").alias("person_tenant"), F.lower("email").alias("mail"), F.col("id").alias("person_id"))
    members = _members(t, m).join(owners, ["person_tenant", "mail"])
    rows = _facts(members, m, ["person_tenant", "person_id"])
    rows = shape(
        rows, "person_id", "value_type", "value", "value_field_name", "source_account_id", tenant_id=F.col("person_tenant"),
        id=surrogate_id(F.lit("alias"), "person_id", F.lit(source_type), "source_account_id", "value_type", "value"),
        source_id=F.lit(NIL_UUID), source_type=F.lit(source_type), confidence=F.lit(1.0), is_active=F.lit(1), effective_from=t.as_of,
        effective_to=F.lit(None).cast("timestamp"), first_observed_at=t.as_of, last_observed_at=t.as_of, is_deleted=F.lit(0),
        _version=millis(t.as_of))
    if known is None:
        return rows
    live = known.filter("is_deleted = 0")
    return unknown_keys(rows, live, ["tenant_id", "source_type", "source_account_id", "value_type", "value"])


for _source in MEMBER_LISTS.values():
    feeds("identity_inputs", f"seed_{_source.source_type}", _source.table)(
        lambda t, s=_source.source_type: seed_identity_inputs(t, s))

__all__ = ["DIRECTORIES", "MEMBER_LISTS"]
