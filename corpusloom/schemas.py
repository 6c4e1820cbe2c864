"""Fixed schemas. Nothing on a hot path infers a schema."""

from __future__ import annotations

FILES = "repo string, path string, content string, language string, n_lines int, n_bytes bigint, last_modified timestamp"
MANIFEST = "repo string, path string, sha256 string, snapshot_ts timestamp"
BASELINE = "repo string, ref_path string, sha256 string, saved_at timestamp"
PACKAGE_JSON = (
    "name string, version string, description string, main string, private boolean, "
    "dependencies map<string,string>, devDependencies map<string,string>"
)
PULL_REQUEST = (
    "repo string, number bigint, title string, body string, mergedAt timestamp, author struct<login:string>, "
    "labels array<struct<name:string>>, files array<struct<path:string>>"
)
ISSUE = (
    "repo string, number bigint, title string, body string, closedAt timestamp, author struct<login:string>, "
    "labels array<struct<name:string>>"
)
PR_REVIEWS = (
    "repo string, number bigint, reviews array<struct<state:string,body:string,author:struct<login:string>>>, "
    "comments array<struct<body:string,author:struct<login:string>>>"
)
MILESTONES = (
    "version int, updated_at string, milestones array<struct<name:string, items:array<struct<name:string, "
    "status:string, detect:struct<file_exists:string,grep:string,grep_path:string,export_exists:string>>>>>"
)
FINDING = (
    "repo string, analyzer string, kind string, confidence double, data map<string,string>, status string, error string"
)
PARTIAL_FINDING = "repo string, analyzer string, key string, value bigint, text string, path string, position bigint, error string"
TELEMETRY = "anonymous_id string, ts timestamp, command string, language string, repo_lines bigint, enabled boolean, do_not_track boolean"
