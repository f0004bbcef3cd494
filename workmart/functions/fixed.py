"""Fixed values. They must equal the published definitions for right results."""

# Workflow states in which an issue counts as finished.
CLOSED_STATUSES = ("Closed", "Resolved", "Verified")

# Workflow states in which someone is working on an issue. The fourth name
# with two spaces is a spelling found in real workflows.
ACTIVE_STATUSES = (
    "In Progress",
    "In Development",
    "In  Development",
    "Code Review",
    "In Review",
    "In PM Review",
    "In QA",
    "In Design",
    "Waiting for Merge",
)

# File path categories.
SPEC_PATH = r"(?i)(\.spec\.|\.test\.|__tests__/|/tests?/)"
CONFIG_PATH = (
    r"(?i)(\.lock$|package-lock\.json|yarn\.lock|poetry\.lock|"
    r"\.ya?ml$|\.toml$|\.cfg$|\.ini$)"
)

# Words in a job title that decide seniority.
SENIOR_TITLE = ("senior", "lead", "principal", "architect", "director", "head")
JUNIOR_TITLE = ("junior", "intern", "trainee")

# Titles that count as senior in the team view, whatever else they hold.
EXECUTIVE_TITLE_LIKE = (
    "%vice president%", "%chief%", "%president%", "%ceo%", "%cto%",
    "%cfo%", "%coo%", "%vp of%", "vp %", "%executive%",
)

# Values of a `status` observation that end an active period.
INACTIVE_OBSERVATIONS = ("Inactive", "Terminated", "inactive", "terminated")

# Which column of an observation holds a value of this type, and its limit.
ID_VALUE_TYPES = (
    "id", "email", "username", "employee_id",
    "parent_email", "parent_id", "parent_person_id",
)
TEXT_VALUE_TYPES = (
    "display_name", "first_name", "last_name",
    "department", "division", "job_title", "status",
)

# Threshold scopes from broad to narrow.
THRESHOLD_SCOPES = ("product-default", "tenant", "role", "team", "team+role")

UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"

# Separator of multi-value lists in old change log entries.
LIST_SEPARATOR = ", "

# Missing-value marks inside keys and row hashes.
NULL_MARK = "__null__"

DEFAULT_WORKING_HOURS = 8.0
