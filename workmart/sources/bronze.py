"""Landed tables that are compacted on `unique_key`.

Fixed values: the schemas and tables a landing run produces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from workmart.sources.sinks import promote, write_table
from workmart.sources.tables import landed

# The tables of each schema.
LANDED = {
    "bronze_chatgpt_team": (
        "chatgpt_team_seats", "chatgpt_team_chat_activity", "chatgpt_team_codex_user_daily", "chatgpt_team_subscription_usage",
        "chatgpt_team_subscription_balance",
    ),
    "bronze_claude_enterprise": (
        "claude_enterprise_chat_projects", "claude_enterprise_connectors", "claude_enterprise_skills",
        "claude_enterprise_summaries", "claude_enterprise_users",
    ),
    "bronze_claude_team": (
        "claude_team_members", "claude_team_code_metrics",
    ),
    "bronze_cursor": (
        "cursor_audit_logs", "cursor_daily_usage", "cursor_members", "cursor_usage_events", "cursor_usage_events_daily_resync",
    ),
    "bronze_github_copilot": (
        "copilot_seats", "copilot_user_metrics", "copilot_org_metrics",
    ),
    "bronze_openai": (
        "users", "usage_completions", "usage_embeddings", "usage_moderations", "usage_images", "usage_audio_speeches",
        "usage_audio_transcriptions", "usage_vector_stores", "usage_code_interpreter", "costs",
    ),
    "bronze_m365": (
        "email_activity", "onedrive_activity", "sharepoint_activity", "teams_activity",
    ),
    "bronze_slack": (
        "channels", "messages", "users", "users_details",
    ),
    "bronze_zoom": (
        "meetings", "participants", "users",
    ),
    "bronze_zulip_proxy": (
        "users", "messages",
    ),
    "bronze_hubspot": (
        "contacts", "contacts_archived", "companies", "companies_archived", "deals", "deals_archived", "owners", "owners_archived",
        "engagements_calls", "engagements_calls_archived", "engagements_emails", "engagements_emails_archived",
        "engagements_meetings", "engagements_tasks", "engagements_tasks_archived", "leads", "leads_archived", "tickets",
        "tickets_archived",
    ),
    "bronze_salesforce": (
        "Account", "Contact", "Opportunity", "OpportunityHistory", "Task", "Event", "User", "Lead", "Case",
        "OpportunityContactRole", "OpportunityLineItem", "CampaignMember", "Campaign", "Product2", "Pricebook2", "PricebookEntry",
    ),
    "bronze_bitbucket_cloud": (
        "branches", "commits", "file_changes", "pull_requests", "pull_request_comments", "pull_request_commits", "repositories",
    ),
    "bronze_bamboohr": (
        "employees", "leave_requests", "meta_fields",
    ),
    "bronze_ms_entra": (
        "users",
    ),
    "bronze_workday": (
        "workers", "leave_requests",
    ),
    "bronze_jira": (
        "jira_projects", "jira_user", "jira_sprints", "jira_fields", "jira_issue", "jira_comments", "jira_worklogs",
        "jira_issue_history", "jira_issue_keys",
    ),
    "bronze_youtrack": (
        "youtrack_projects", "youtrack_user", "youtrack_agiles", "youtrack_sprints", "youtrack_issue_link_types", "youtrack_issue",
        "youtrack_issue_history", "youtrack_comments", "youtrack_worklogs", "youtrack_project_custom_fields",
    ),
    "bronze_figma": (
        "design_projects", "design_files", "design_file_meta", "design_file_versions", "design_file_comments",
    ),
    "bronze_confluence": (
        "wiki_pages", "wiki_page_versions", "wiki_spaces", "wiki_footer_comments", "wiki_footer_comment_replies",
        "wiki_inline_comments", "wiki_inline_comment_replies",
    ),
    "bronze_outline": (
        "wiki_spaces", "wiki_pages", "wiki_page_versions", "wiki_comments", "wiki_users",
    ),
}


def landed_tables() -> Iterator[tuple[str, str]]:
    for schema, names in LANDED.items():
        for name in names:
            yield schema, name


def promote_all(read: Callable[[str, str], DataFrame | None], target: str) -> list[str]:
    """Compact every landed table that exists into `target/schema/table`."""
    done = []
    for schema, name in landed_tables():
        df = read(schema, name)
        if df is not None:
            write_table(promote(landed(df)), f"{target}/{schema}/{name}")
            done.append(f"{schema}.{name}")
    return done
