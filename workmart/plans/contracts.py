"""Class contracts: the columns every contributing model produces, in order, with their types."""

from __future__ import annotations

from pyspark.sql import types as T

TYPES = {
    "string": T.StringType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "decimal(18,4)": T.DecimalType(18, 4),
    "array<string>": T.ArrayType(T.StringType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
    "map<string,double>": T.MapType(T.StringType(), T.DoubleType()),
}

# Fixed values: (column, type) of every class.
COLUMNS = {
    "class_ai_api_usage": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("email", "string"), ("api_key_id", "string"),
        ("workspace_id", "string"), ("day", "date"), ("provider", "string"), ("channel", "string"), ("input_tokens", "long"),
        ("output_tokens", "long"), ("cache_read_tokens", "long"), ("cache_creation_tokens", "long"),
        ("cost_amount", "decimal(18,4)"), ("cost_currency", "string"), ("source", "string"), ("data_source", "string"),
        ("collected_at", "timestamp"), ("_version", "long"),
    ),
    "class_ai_assistant_usage": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("email", "string"), ("day", "date"),
        ("tool", "string"), ("surface", "string"), ("session_count", "long"), ("conversation_count", "long"),
        ("message_count", "long"), ("action_count", "long"), ("files_uploaded_count", "long"), ("artifacts_created_count", "long"),
        ("projects_created_count", "long"), ("projects_used_count", "long"), ("skills_used_count", "long"),
        ("connectors_used_count", "long"), ("thinking_message_count", "long"), ("dispatch_turn_count", "long"),
        ("search_count", "long"), ("cost_cents", "long"), ("surface_metrics_json", "string"), ("source", "string"),
        ("data_source", "string"), ("collected_at", "timestamp"), ("_version", "long"),
    ),
    "class_ai_dev_usage": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("email", "string"), ("api_key_id", "string"),
        ("day", "date"), ("tool", "string"), ("session_count", "long"), ("lines_added", "long"), ("lines_removed", "long"),
        ("total_lines_added", "long"), ("total_lines_removed", "long"), ("tool_use_offered", "long"),
        ("tool_use_accepted", "long"), ("agent_sessions", "long"), ("chat_requests", "long"), ("cost_cents", "long"),
        ("commits_count", "long"), ("pull_requests_count", "long"), ("prs_with_cc_count", "long"), ("prs_total_count", "long"),
        ("tool_action_breakdown_json", "string"), ("source", "string"), ("data_source", "string"), ("collected_at", "timestamp"),
        ("_version", "long"),
    ),
    "class_ai_org_usage": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("day", "date"), ("organization_id", "string"),
        ("enterprise_id", "string"), ("daily_active_users", "long"), ("weekly_active_users", "long"),
        ("monthly_active_users", "long"), ("monthly_active_chat_users", "long"), ("monthly_active_agent_users", "long"),
        ("user_initiated_interaction_count", "long"), ("code_generation_activity_count", "long"),
        ("code_acceptance_activity_count", "long"), ("loc_added_sum", "long"), ("loc_deleted_sum", "long"),
        ("pull_requests_json", "string"), ("source", "string"), ("data_source", "string"), ("collected_at", "timestamp"),
        ("_version", "long"),
    ),
    "class_collab_chat_activity": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("user_id", "string"), ("user_name", "string"),
        ("email", "string"), ("person_key", "string"), ("date", "date"), ("direct_messages", "long"),
        ("group_chat_messages", "long"), ("direct_and_group_messages", "long"), ("total_chat_messages", "long"),
        ("channel_posts", "long"), ("channel_replies", "long"), ("urgent_messages", "long"), ("report_period", "string"),
        ("collected_at", "timestamp"), ("data_source", "string"), ("_version", "long"),
    ),
    "class_collab_document_activity": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("user_id", "string"), ("user_name", "string"),
        ("email", "string"), ("person_key", "string"), ("date", "date"), ("product", "string"), ("viewed_or_edited_count", "long"),
        ("synced_count", "long"), ("shared_internally_count", "long"), ("shared_externally_count", "long"),
        ("visited_page_count", "long"), ("report_period", "string"), ("collected_at", "timestamp"), ("data_source", "string"),
        ("_version", "long"),
    ),
    "class_collab_email_activity": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("user_id", "string"), ("user_name", "string"),
        ("email", "string"), ("person_key", "string"), ("date", "date"), ("sent_count", "long"), ("received_count", "long"),
        ("read_count", "long"), ("meetings_created", "long"), ("meetings_interacted", "long"), ("report_period", "string"),
        ("collected_at", "timestamp"), ("data_source", "string"), ("_version", "long"),
    ),
    "class_collab_meeting_activity": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("user_id", "string"), ("user_name", "string"),
        ("email", "string"), ("person_key", "string"), ("date", "date"), ("calls_count", "long"), ("meetings_organized", "long"),
        ("meetings_attended", "long"), ("adhoc_meetings_organized", "long"), ("adhoc_meetings_attended", "long"),
        ("scheduled_meetings_organized", "long"), ("scheduled_meetings_attended", "long"), ("audio_duration_seconds", "long"),
        ("video_duration_seconds", "long"), ("screen_share_duration_seconds", "long"), ("report_period", "string"),
        ("collected_at", "timestamp"), ("data_source", "string"), ("_version", "long"),
    ),
    "class_crm_accounts": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("account_id", "string"), ("name", "string"),
        ("domain", "string"), ("industry", "string"), ("owner_id", "string"), ("parent_account_id", "string"),
        ("metadata", "string"), ("custom_fields", "string"), ("created_at", "timestamp"), ("updated_at", "timestamp"),
        ("data_source", "string"), ("_version", "long"),
    ),
    "class_crm_activities": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("activity_id", "string"),
        ("activity_type", "string"), ("owner_id", "string"), ("created_by_user_id", "string"), ("contact_id", "string"),
        ("deal_id", "string"), ("account_id", "string"), ("timestamp", "timestamp"), ("duration_seconds", "long"),
        ("outcome", "string"), ("metadata", "string"), ("custom_fields", "string"), ("created_at", "timestamp"),
        ("data_source", "string"), ("_version", "long"),
    ),
    "class_crm_contacts": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("contact_id", "string"), ("email", "string"),
        ("first_name", "string"), ("last_name", "string"), ("owner_id", "string"), ("account_id", "string"),
        ("lifecycle_stage", "string"), ("metadata", "string"), ("custom_fields", "string"), ("created_at", "timestamp"),
        ("updated_at", "timestamp"), ("data_source", "string"), ("_version", "long"),
    ),
    "class_crm_deals": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("deal_id", "string"), ("name", "string"),
        ("forecast_category", "string"), ("stage", "string"), ("amount", "double"), ("amount_home", "double"), ("acv", "double"),
        ("tcv", "double"), ("arr", "double"), ("close_date", "date"), ("owner_id", "string"), ("created_by_user_id", "string"),
        ("account_id", "string"), ("is_closed", "long"), ("is_won", "long"), ("lead_source", "string"), ("probability", "double"),
        ("deal_type", "string"), ("lost_reason", "string"), ("pipeline_id", "string"), ("metadata", "string"),
        ("custom_fields", "string"), ("created_at", "timestamp"), ("updated_at", "timestamp"), ("data_source", "string"),
        ("_version", "long"),
    ),
    "class_crm_users": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("user_id", "string"),
        ("hs_user_id", "string"), ("email", "string"), ("first_name", "string"), ("last_name", "string"), ("title", "string"),
        ("department", "string"), ("is_active", "long"), ("metadata", "string"), ("custom_fields", "string"),
        ("collected_at", "timestamp"), ("data_source", "string"), ("_version", "long"),
    ),
    "class_git_commits": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("project_key", "string"),
        ("repo_slug", "string"), ("commit_hash", "string"), ("branch", "string"), ("author_name", "string"),
        ("author_email", "string"), ("committer_name", "string"), ("committer_email", "string"), ("message", "string"),
        ("date", "timestamp"), ("files_changed", "long"), ("lines_added", "long"), ("lines_removed", "long"),
        ("is_merge_commit", "long"), ("data_source", "string"), ("_version", "long"), ("_extracted_at", "timestamp"),
    ),
    "class_git_file_changes": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("project_key", "string"),
        ("repo_slug", "string"), ("commit_hash", "string"), ("file_path", "string"), ("file_extension", "string"),
        ("change_type", "string"), ("lines_added", "long"), ("lines_removed", "long"), ("source_type", "string"),
        ("data_source", "string"), ("_version", "long"), ("_extracted_at", "timestamp"),
    ),
    "class_git_pull_requests": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("project_key", "string"),
        ("repo_slug", "string"), ("pr_id", "long"), ("pr_number", "long"), ("title", "string"), ("description", "string"),
        ("state", "string"), ("author_name", "string"), ("author_email", "string"), ("source_branch", "string"),
        ("destination_branch", "string"), ("created_on", "timestamp"), ("updated_on", "timestamp"), ("closed_on", "timestamp"),
        ("merge_commit_hash", "string"), ("files_changed", "long"), ("lines_added", "long"), ("lines_removed", "long"),
        ("data_source", "string"), ("_version", "long"), ("_extracted_at", "timestamp"),
    ),
    "class_git_pull_requests_comments": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("project_key", "string"),
        ("repo_slug", "string"), ("pr_id", "long"), ("comment_id", "long"), ("content", "string"), ("author_name", "string"),
        ("author_uuid", "string"), ("created_at", "timestamp"), ("updated_at", "timestamp"), ("is_inline", "long"),
        ("file_path", "string"), ("line_number", "long"), ("data_source", "string"), ("_version", "long"),
        ("_extracted_at", "timestamp"),
    ),
    "class_git_pull_requests_commits": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("project_key", "string"),
        ("repo_slug", "string"), ("pr_id", "long"), ("commit_hash", "string"), ("commit_order", "long"), ("data_source", "string"),
        ("_version", "long"), ("_extracted_at", "timestamp"),
    ),
    "class_git_pull_requests_reviewers": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("project_key", "string"),
        ("repo_slug", "string"), ("pr_id", "long"), ("reviewer_name", "string"), ("reviewer_uuid", "string"), ("status", "string"),
        ("approved", "long"), ("reviewed_at", "timestamp"), ("data_source", "string"), ("_version", "long"),
        ("_extracted_at", "timestamp"),
    ),
    "class_git_repositories": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("project_key", "string"),
        ("repo_slug", "string"), ("repo_uuid", "string"), ("name", "string"), ("full_name", "string"), ("description", "string"),
        ("is_private", "long"), ("created_on", "timestamp"), ("updated_on", "timestamp"), ("size", "long"), ("language", "string"),
        ("has_issues", "long"), ("has_wiki", "long"), ("metadata", "string"), ("data_source", "string"), ("_version", "long"),
        ("_extracted_at", "timestamp"),
    ),
    "class_git_repository_branches": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("project_key", "string"),
        ("repo_slug", "string"), ("branch_name", "string"), ("is_default", "long"), ("last_commit_hash", "string"),
        ("last_commit_date", "timestamp"), ("data_source", "string"), ("_version", "long"), ("_extracted_at", "timestamp"),
    ),
    "class_hr_events": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("source_person_id", "string"),
        ("email", "string"), ("event_type", "string"), ("event_subtype", "string"), ("start_date", "timestamp"),
        ("end_date", "timestamp"), ("duration_amount", "double"), ("duration_unit", "string"), ("request_status", "string"),
        ("source", "string"), ("created_at", "timestamp"), ("ingested_at", "timestamp"), ("_version", "long"),
    ),
    "class_hr_working_hours": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("source_person_id", "string"),
        ("email", "string"), ("display_name", "string"), ("employment_type", "string"), ("source", "string"),
        ("working_hours_per_day", "double"), ("working_hours_per_week", "double"), ("ingested_at", "timestamp"),
    ),
    "class_people": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("workspace_id", "string"),
        ("person_id", "string"), ("valid_from", "timestamp"), ("valid_to", "timestamp"), ("source", "string"),
        ("source_person_id", "string"), ("employee_number", "string"), ("display_name", "string"), ("first_name", "string"),
        ("last_name", "string"), ("email", "string"), ("job_title", "string"), ("department_name", "string"),
        ("org_unit_id", "string"), ("manager_person_id", "string"), ("status", "string"), ("employment_type", "string"),
        ("hire_date", "timestamp"), ("termination_date", "timestamp"), ("location", "string"), ("country", "string"),
        ("fte", "double"), ("custom_str_attrs", "map<string,string>"), ("custom_num_attrs", "map<string,double>"),
        ("ingested_at", "timestamp"),
    ),
    "class_task_comments": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("comment_id", "string"),
        ("id_readable", "string"), ("author_id", "string"), ("created_at", "timestamp"), ("updated_at", "timestamp"),
        ("body", "string"), ("is_deleted", "long"), ("data_source", "string"), ("_version", "long"),
    ),
    "class_task_field_metadata": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("project_key", "string"),
        ("field_id", "string"), ("field_name", "string"), ("is_multi", "long"), ("field_type", "string"), ("has_id", "long"),
        ("observed_at", "timestamp"), ("data_source", "string"), ("_version", "long"),
    ),
    "class_task_projects": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("project_id", "string"),
        ("project_key", "string"), ("name", "string"), ("lead_id", "string"), ("project_type", "string"),
        ("project_style", "string"), ("archived", "long"), ("collected_at", "timestamp"), ("data_source", "string"),
        ("_version", "long"),
    ),
    "class_task_sprints": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("sprint_id", "string"),
        ("board_id", "string"), ("board_name", "string"), ("sprint_name", "string"), ("project_key", "string"),
        ("state", "string"), ("start_date", "timestamp"), ("end_date", "timestamp"), ("complete_date", "timestamp"),
        ("collected_at", "timestamp"), ("data_source", "string"), ("_version", "long"),
    ),
    "class_task_users": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("user_id", "string"), ("email", "string"),
        ("display_name", "string"), ("username", "string"), ("account_type", "string"), ("is_active", "long"),
        ("collected_at", "timestamp"), ("data_source", "string"), ("_version", "long"),
    ),
    "class_task_worklogs": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("worklog_id", "string"),
        ("id_readable", "string"), ("author_id", "string"), ("work_date", "timestamp"), ("duration_seconds", "double"),
        ("description", "string"), ("collected_at", "timestamp"), ("data_source", "string"), ("_version", "long"),
    ),
    "class_task_field_history": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("issue_id", "string"),
        ("id_readable", "string"), ("event_id", "string"), ("event_at", "timestamp"), ("event_kind", "string"), ("_seq", "long"),
        ("author_id", "string"), ("author_display", "string"), ("field_id", "string"), ("field_name", "string"),
        ("field_cardinality", "string"), ("delta_action", "string"), ("delta_value_id", "string"),
        ("delta_value_display", "string"), ("value_ids", "array<string>"), ("value_displays", "array<string>"),
        ("value_id_type", "string"), ("collected_at", "timestamp"), ("data_source", "string"), ("_version", "long"),
    ),
    "class_wiki_activity": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("author_id", "string"),
        ("author_email", "string"), ("day", "date"), ("pages_edited", "long"), ("total_edits", "long"), ("pages_created", "long"),
        ("source", "string"), ("data_source", "string"), ("collected_at", "timestamp"), ("_version", "long"),
    ),
    "class_wiki_engagement": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("page_id", "string"), ("day", "date"),
        ("total_comments", "long"), ("footer_comments", "long"), ("inline_comments", "long"), ("replies", "long"),
        ("unique_commenters", "long"), ("unresolved_inline_count", "long"), ("source", "string"), ("data_source", "string"),
        ("collected_at", "timestamp"), ("_version", "long"),
    ),
    "class_wiki_pages": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("page_id", "string"), ("space_id", "string"),
        ("space_name", "string"), ("title", "string"), ("status", "string"), ("author_id", "string"), ("author_email", "string"),
        ("last_editor_id", "string"), ("last_editor_email", "string"), ("parent_page_id", "string"), ("version_count", "long"),
        ("created_at", "timestamp"), ("updated_at", "timestamp"), ("space_url", "string"), ("source", "string"),
        ("data_source", "string"), ("collected_at", "timestamp"), ("_version", "long"),
    ),
    "identity_inputs": (
        ("tenant_id", "string"), ("source_id", "string"), ("unique_key", "string"), ("source_type", "string"),
        ("source_account_id", "string"), ("value_type", "string"), ("value", "string"), ("value_field_name", "string"),
        ("operation_type", "string"), ("_synced_at", "timestamp"), ("_version", "long"),
    ),
}

# Classes whose rows carry no version, so that any row per key will do.
VERSIONLESS = ("class_people", "class_hr_working_hours")


def contract(cls: str) -> T.StructType:
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in COLUMNS[cls]])
