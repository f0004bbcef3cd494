"""Code hosts -> class_git_*.

The two hosts land the same things under other names. A `Host` lists the
names; each class has one builder that serves both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from workmart.functions.scalars import file_extension, flag, json_items, json_text, millis, moment, text
from workmart.plans.registry import Landed, feeds
from workmart.plans.staging.shape import KEYS, count0, shape, truth, unique_key


@dataclass(frozen=True)
class Host:
    name: str
    project: str
    repo: str

    @property
    def schema(self) -> str:
        return f"bronze_{self.name}"

    def rows(self, df: DataFrame, tables: Landed, repo: Column | None = None, project: Column | None = None,
             **columns: Column) -> DataFrame:
        return shape(
            df, *KEYS, "_extracted_at",
            project_key=text(self.project) if project is None else project,
            repo_slug=text(self.repo) if repo is None else repo,
            **columns, data_source=F.lit(self.name), _version=millis(tables.as_of))


GITHUB = Host("github", "repo_owner", "repo_name")
BITBUCKET = Host("bitbucket_cloud", "workspace", "repo_slug")


@feeds("class_git_commits", "github", "bronze_github.commits")
def github_commits(t: Landed) -> DataFrame:
    df = t("bronze_github.commits")
    listed = df.schema["parent_hashes"].dataType.typeName() == "array"
    parents = F.coalesce(F.size("parent_hashes") if listed else F.json_array_length("parent_hashes"), F.lit(0))
    return GITHUB.rows(
        df, t, commit_hash=text("oid"), branch=text("branch_name"), author_name=text("author_name"),
        author_email=text("author_email"), committer_name=text("committer_name"), committer_email=text("committer_email"),
        message=text("message"), date=moment("committed_date"), files_changed=count0("changed_files"),
        lines_added=count0("additions"), lines_removed=count0("deletions"), is_merge_commit=flag(parents > 1))


def _per_commit(t: Landed, key: list[str]) -> DataFrame:
    """File counts and lines per commit: added up before any join."""
    return t.newest("bronze_bitbucket_cloud.file_changes").groupBy(*key).agg(
        F.count(F.lit(1)).alias("files"), F.sum(count0("additions")).alias("added"), F.sum(count0("deletions")).alias("removed"))


@feeds("class_git_commits", "bitbucket_cloud", "bronze_bitbucket_cloud.commits", "bronze_bitbucket_cloud.file_changes")
def bitbucket_commits(t: Landed) -> DataFrame:
    key = ["tenant_id", "workspace", "repo_slug", "sha"]
    commits = t.newest("bronze_bitbucket_cloud.commits").withColumn("sha", F.col("hash"))
    df = commits.join(_per_commit(t, key), key, "left")
    parents = F.coalesce(F.json_array_length(F.coalesce(F.col("parent_hashes").cast("string"), F.lit("[]"))), F.lit(0))
    return BITBUCKET.rows(
        df, t, commit_hash=text("hash"), branch=text("branch_name"), author_name=text("author_name"),
        author_email=text("author_email"), committer_name=F.lit(""), committer_email=F.lit(""), message=text("message"),
        date=moment("date"), files_changed=count0("files"), lines_added=count0("added"), lines_removed=count0("removed"),
        is_merge_commit=flag(parents > 1))


def _file_changes(host: Host, sha: str, t: Landed) -> DataFrame:
    return host.rows(
        t(f"{host.schema}.file_changes"), t, commit_hash=text(sha), file_path=text("filename"),
        file_extension=file_extension("filename"), change_type=text("status"), lines_added=count0("additions"),
        lines_removed=count0("deletions"), source_type=text("source_type"))


feeds("class_git_file_changes", "github", "bronze_github.file_changes")(
    lambda t: _file_changes(GITHUB, "commit_hash", t))
feeds("class_git_file_changes", "bitbucket_cloud", "bronze_bitbucket_cloud.file_changes")(
    lambda t: _file_changes(BITBUCKET, "sha", t))


@feeds("class_git_pull_requests", "github", "bronze_github.pull_requests")
def github_pull_requests(t: Landed) -> DataFrame:
    return GITHUB.rows(
        t("bronze_github.pull_requests"), t, pr_id=count0("database_id"), pr_number=count0("number"), title=text("title"),
        description=text("body"), state=text("state"), author_name=text("author_login"), author_email=text("author_email"),
        source_branch=text("head_ref"), destination_branch=text("base_ref"), created_on=moment("created_at"),
        updated_on=moment("updated_at"), closed_on=moment("closed_at"), merge_commit_hash=text("merge_commit_sha"),
        files_changed=count0("changed_files"), lines_added=count0("additions"), lines_removed=count0("deletions"))


@feeds("class_git_pull_requests", "bitbucket_cloud", "bronze_bitbucket_cloud.pull_requests",
       "bronze_bitbucket_cloud.pull_request_commits", "bronze_bitbucket_cloud.file_changes")
def bitbucket_pull_requests(t: Landed) -> DataFrame:
    # Lines of a pull request are those of its commits. Files are added up per
    # commit first, so the join multiplies one row per commit, not per file.
    where = ["tenant_id", "workspace", "repo_slug"]
    commits = t.newest("bronze_bitbucket_cloud.pull_request_commits").withColumn("sha", F.col("hash"))
    per_pr = commits.join(_per_commit(t, [*where, "sha"]), [*where, "sha"]).groupBy(*where, F.col("pr_id").alias("id")).agg(
        F.sum("files").alias("files"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    df = t.newest("bronze_bitbucket_cloud.pull_requests").join(per_pr, [*where, "id"], "left")
    done = F.col("state").isin("MERGED", "DECLINED", "SUPERSEDED")
    return BITBUCKET.rows(
        df, t, pr_id=count0("id"), pr_number=count0("id"), title=text("title"), description=text("description"),
        state=F.when(F.col("state") == "SUPERSEDED", "DECLINED").otherwise(text("state")),
        author_name=text("author_display_name"), author_email=F.lit(""), source_branch=text("source_branch"),
        destination_branch=text("destination_branch"), created_on=moment("created_on"), updated_on=moment("updated_on"),
        closed_on=F.when(done, moment("updated_on")), merge_commit_hash=text("merge_commit_hash"),
        files_changed=count0("files"), lines_added=count0("added"), lines_removed=count0("removed"))


@feeds("class_git_pull_requests_comments", "github", "bronze_github.pull_request_comments")
def github_comments(t: Landed) -> DataFrame:
    return GITHUB.rows(
        t("bronze_github.pull_request_comments"), t, pr_id=count0("pr_database_id"), comment_id=count0("database_id"),
        content=text("body"), author_name=text("author_login"), author_uuid=count0("author_database_id").cast("string"),
        created_at=moment("created_at"), updated_at=moment("updated_at"), is_inline=flag(truth("is_inline")),
        file_path=text("path"), line_number=count0("line"))


@feeds("class_git_pull_requests_comments", "bitbucket_cloud", "bronze_bitbucket_cloud.pull_request_comments")
def bitbucket_comments(t: Landed) -> DataFrame:
    return BITBUCKET.rows(
        t("bronze_bitbucket_cloud.pull_request_comments"), t, pr_id=count0("pr_id"), comment_id=count0("comment_id"),
        content=text("body"), author_name=text("author_display_name"), author_uuid=text("author_uuid"),
        created_at=moment("created_on"), updated_at=moment("updated_on"), is_inline=flag(truth("is_inline")),
        file_path=text("inline_path"), line_number=count0(F.coalesce("inline_to", "inline_from")))


@feeds("class_git_pull_requests_commits", "github", "bronze_github.pull_request_commits")
def github_pr_commits(t: Landed) -> DataFrame:
    return GITHUB.rows(t("bronze_github.pull_request_commits"), t, pr_id=count0("pr_database_id"),
                       commit_hash=text("commit_hash"), commit_order=count0("commit_order"))


@feeds("class_git_pull_requests_commits", "bitbucket_cloud", "bronze_bitbucket_cloud.pull_request_commits")
def bitbucket_pr_commits(t: Landed) -> DataFrame:
    return BITBUCKET.rows(t("bronze_bitbucket_cloud.pull_request_commits"), t, pr_id=count0("pr_id"),
                          commit_hash=text("hash"), commit_order=F.lit(0))


@feeds("class_git_pull_requests_reviewers", "github", "bronze_github.pull_request_reviews")
def github_reviewers(t: Landed) -> DataFrame:
    return GITHUB.rows(
        t("bronze_github.pull_request_reviews"), t, pr_id=count0("pr_database_id"), reviewer_name=text("author_login"),
        reviewer_uuid=count0("author_database_id").cast("string"), status=text("state"),
        approved=flag(F.col("state") == "APPROVED"), reviewed_at=moment("submitted_at"))


@feeds("class_git_pull_requests_reviewers", "bitbucket_cloud", "bronze_bitbucket_cloud.pull_requests")
def bitbucket_reviewers(t: Landed) -> DataFrame:
    df = t("bronze_bitbucket_cloud.pull_requests").withColumn("p", F.explode(json_items(F.col("participants").cast("string"))))
    df = df.filter(json_text("p", "role") == "REVIEWER").withColumn("unique_key", unique_key(
        "tenant_id", "source_id", "workspace", "repo_slug", "id", json_text("p", "uuid"), sep=":"))
    return BITBUCKET.rows(
        df, t, pr_id=count0("id"), reviewer_name=json_text("p", "display_name"), reviewer_uuid=json_text("p", "uuid"),
        status=json_text("p", "state"), approved=flag(json_text("p", "approved") == "true"))


@feeds("class_git_repositories", "github", "bronze_github.repositories")
def github_repositories(t: Landed) -> DataFrame:
    return GITHUB.rows(
        t("bronze_github.repositories"), t, project=json_text("owner", "login"), repo=text("name"),
        repo_uuid=count0("id").cast("string"), name=text("name"), full_name=text("full_name"), description=text("description"),
        is_private=flag(truth("private")), created_on=moment("created_at"),
        updated_on=moment(F.coalesce("pushed_at", "updated_at")), size=count0("size"), language=text("language"),
        has_issues=flag(truth("has_issues")), has_wiki=flag(truth("has_wiki")), metadata=F.lit(""))


@feeds("class_git_repositories", "bitbucket_cloud", "bronze_bitbucket_cloud.repositories")
def bitbucket_repositories(t: Landed) -> DataFrame:
    return BITBUCKET.rows(
        t("bronze_bitbucket_cloud.repositories"), t, repo=text("slug"), repo_uuid=text("uuid"), name=text("name"),
        full_name=text("full_name"), description=text("description"), is_private=flag(truth("is_private")),
        created_on=moment("created_on"), updated_on=moment("updated_on"), size=count0("size"), language=text("language"),
        has_issues=flag(truth("has_issues")), has_wiki=flag(truth("has_wiki")), metadata=F.lit(""))


@feeds("class_git_repository_branches", "github", "bronze_github.branches")
def github_branches(t: Landed) -> DataFrame:
    return GITHUB.rows(
        t("bronze_github.branches"), t, branch_name=text("name"), is_default=flag(F.col("name") == F.col("default_branch_name")),
        last_commit_hash=json_text("commit", "sha"), last_commit_date=moment("pushed_at"))


@feeds("class_git_repository_branches", "bitbucket_cloud", "bronze_bitbucket_cloud.branches")
def bitbucket_branches(t: Landed) -> DataFrame:
    return BITBUCKET.rows(
        t("bronze_bitbucket_cloud.branches"), t, branch_name=text("name"), is_default=flag(truth("is_default")),
        last_commit_hash=text("target_hash"), last_commit_date=moment("target_date"))

