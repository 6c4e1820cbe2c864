"""Commits, decisions, pull requests, workspaces, progress, versions and benchmark runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from corpusloom.functions import claims as CL
from corpusloom.functions import text as T
from corpusloom.operators import filters as P
from corpusloom.operators import history as H
from corpusloom.operators import progress as PR
from corpusloom.operators import surface as SU
from corpusloom.operators import usage as U
from corpusloom.operators import workspace as WS
from corpusloom.plans import verbs
from corpusloom.runtime import scratch_path
from corpusloom.sources import files as SF
from corpusloom.sources import history as SH
from corpusloom.sources import tables as ST

NOW = "timestamp '2001-08-02 00:00:00'"


def now():
    return F.to_timestamp_ntz(F.lit("2001-08-02 00:00:00"))


@query("s7_read_commit_log", "SELECT repo, hash, author, subject, files, insertions, deletions FROM v_commits")
def _(t):
    """The commits written as log exports and read back: one file set per repository, a blank line after each commit."""
    path = scratch_path(t.spark, "log")
    stat = F.concat(
        F.lit(" "), F.col("files").cast("string"), F.lit(" files changed, "), F.col("insertions").cast("string"), F.lit(" insertions(+), "),
        F.col("deletions").cast("string"), F.lit(" deletions(-)"))
    header = F.concat_ws("|", "hash", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "author", F.concat("subject", F.lit(" | "), "repo"))
    t.commits.select(F.concat(header, F.lit("\n"), stat, F.lit("\n")).alias("value")).write.text(path)
    read = SH.read_commit_log(t.spark, path)
    part = F.split("subject", r" \| ")
    return read.select(part[1].alias("repo"), "hash", "author", part[0].alias("subject"), "files", "insertions", "deletions")


PR_JSON = "repo, number, title, body, merged_at AS mergedAt, named_struct('login', author) AS author, array(named_struct('name', label_a), named_struct('name', label_b)) AS labels, array(named_struct('path', file_a), named_struct('path', file_b)) AS files"


@query("s8_read_prs", """
    SELECT repo, number, title, length(body) AS n_body, author, CAST(merged_at AS VARCHAR) AS merged_at, label_a || ',' || label_b AS labels, file_a || ',' || file_b AS files FROM v_prs""")
def _(t):
    path = scratch_path(t.spark, "prs")
    t.prs.selectExpr(*split_args(PR_JSON)).withColumn("mergedAt", F.date_format("mergedAt", "yyyy-MM-dd'T'HH:mm:ss'Z'")).write.json(path)
    return SH.read_prs(t.spark, path).select(
        "repo", "number", "title", F.length("body").cast("bigint").alias("n_body"), "author", F.date_format("merged_at", "yyyy-MM-dd HH:mm:ss").alias("merged_at"),
        F.array_join("labels", ",").alias("labels"), F.array_join("files", ",").alias("files"))


def split_args(text: str) -> list[str]:
    """Top-level comma separated expressions."""
    out, depth, last = [], 0, 0
    for i, ch in enumerate(text):
        depth += {"(": 1, ")": -1}.get(ch, 0)
        if ch == "," and depth == 0:
            out.append(text[last:i])
            last = i + 1
    return [*out, text[last:]]


@query("s8_read_issues", "SELECT repo, number, title, author, CAST(closed_at AS VARCHAR) AS closed_at, label_a AS labels FROM v_issues")
def _(t):
    path = scratch_path(t.spark, "issues")
    t.issues.selectExpr("repo", "number", "title", "body", "date_format(closed_at, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS closedAt", "named_struct('login', author) AS author", "array(named_struct('name', label_a)) AS labels").write.json(path)
    return SH.read_issues(t.spark, path).select(
        "repo", "number", "title", "author", F.date_format("closed_at", "yyyy-MM-dd HH:mm:ss").alias("closed_at"), F.array_join("labels", ",").alias("labels"))


@query("s9_read_reviews", "SELECT repo, number, kind, state, length(body) AS n_body, author FROM v_reviews")
def _(t):
    """Each conversation turn is a review or comment document of its pull request."""
    path = scratch_path(t.spark, "reviews")
    entry = F.struct("state", "body", F.struct(F.col("author").alias("login")).alias("author"))
    comment = F.struct("body", F.struct(F.col("author").alias("login")).alias("author"))
    is_review = F.col("kind") == "review"
    t.reviews.select("repo", "number", F.when(is_review, F.array(entry)).alias("reviews"), F.when(~is_review, F.array(comment)).alias("comments")).write.json(path)
    return SH.read_reviews(t.spark, path).select("repo", "number", "kind", "state", F.length("body").cast("bigint").alias("n_body"), "author")


@query("p11_non_merge", "SELECT repo, hash FROM v_commits WHERE NOT is_merge")
def _(t):
    return P.non_merge(t.commits).select("repo", "hash")


@query("p12_since", f"SELECT repo, hash FROM v_commits WHERE ts >= {NOW} - INTERVAL 30 DAY")
def _(t):
    return P.since(t.commits, 30, now()).select("repo", "hash")


@query("p13_merged_prs", "SELECT repo, number, 'pr' AS kind FROM v_prs WHERE merged_at IS NOT NULL UNION ALL SELECT repo, number, 'issue' FROM v_issues WHERE closed_at IS NOT NULL")
def _(t):
    prs = P.merged_prs(t.prs).select("repo", "number", F.lit("pr").alias("kind"))
    return prs.unionByName(P.closed_issues(t.issues).select("repo", "number", F.lit("issue").alias("kind")))


@query("f12_decision_reason", "SELECT repo, hash, reason FROM v_decisions")
def _(t):
    reason = CL.decision_reason(F.col("subject"), F.col("files"), F.col("insertions"), F.col("deletions"))
    return t.commits.select("repo", "hash", reason.alias("reason")).filter("reason is not null")


@query("a16_repo_history_summary", f"""
    SELECT repo, count(*) AS total_commits, min(ts) AS first_commit, max(ts) AS last_commit, count(DISTINCT author) AS authors,
      count(*) FILTER (WHERE ts >= {NOW} - INTERVAL 30 DAY) AS recent_commits FROM v_commits GROUP BY repo""")
def _(t):
    return H.repo_history_summary(t.commits, now())


@query("a17_contributors", "SELECT repo, author, count(*) AS commits FROM v_commits WHERE NOT is_merge GROUP BY repo, author")
def _(t):
    return H.contributors(t.commits)


@query("t3_top_contributors", """
    SELECT * FROM (SELECT repo, author, count(*) AS commits, CAST(row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, author) AS INTEGER) AS rank
      FROM v_commits WHERE NOT is_merge GROUP BY repo, author) WHERE rank <= 5""")
def _(t):
    return H.top_contributors(t.commits)


HOT_SQL = """SELECT f.repo, f.path, count(*) AS changes FROM v_commit_files f JOIN (SELECT repo, hash FROM (SELECT repo, hash, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, hash) AS rn FROM v_commits)
    WHERE rn <= 100) c ON c.hash = f.hash GROUP BY f.repo, f.path"""


@query("a18_hotspots", HOT_SQL)
def _(t):
    return H.hotspots(t.commits, t.commit_files)


@query("t4_top_hotspots", f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY changes DESC, path) AS INTEGER) AS rank FROM ({HOT_SQL})) WHERE rank <= 10")
def _(t):
    return H.top_hotspots(t.commits, t.commit_files)


@query("a19_decision_counts", "SELECT repo, reason, count(*) AS decisions FROM v_decisions GROUP BY repo, reason UNION ALL SELECT repo, 'TOTAL', count(*) FROM v_decisions GROUP BY repo")
def _(t):
    return H.decision_counts(H.decisions(t.commits))


@query("t2_last_commits", "SELECT repo, hash FROM (SELECT repo, hash, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, hash) AS rn FROM v_commits) WHERE rn <= 50")
def _(t):
    return H.last_commits(t.commits.select("repo", "hash", "ts")).select("repo", "hash")


PATHS_SQL = """SELECT repo, hash, path, CAST(rn AS INTEGER) AS rank FROM (SELECT repo, hash, path, row_number() OVER (PARTITION BY repo, hash ORDER BY path) AS rn FROM
    (SELECT DISTINCT f.repo, f.hash, f.path FROM v_commit_files f JOIN v_decisions d ON d.hash = f.hash)) WHERE rn <= {0}"""


@query("j10_commit_paths", PATHS_SQL.format(20))
def _(t):
    return H.commit_paths(H.decisions(t.commits), t.commit_files)


@query("t7_paths_per_commit", PATHS_SQL.format(3))
def _(t):
    return H.commit_paths(H.decisions(t.commits), t.commit_files, 3)


@query("w7_sessions", "SELECT repo, hash, session FROM v_sessions")
def _(t):
    return H.decision_sessions(H.decisions(t.commits)).select("repo", "hash", "session")


@query("w7_sessions_hot", "SELECT repo, hash, session FROM v_sessions")
def _(t):
    return H.decision_sessions(H.decisions(t.commits), gap_days=3).select("repo", "hash", "session")


@query("w7_group_decisions", "SELECT repo, hash, session, decision_group FROM v_groups")
def _(t):
    return H.group_decisions(H.decisions(t.commits), t.commit_files).select("repo", "hash", "session", "decision_group")


NUMBERED_SQL = """
    SELECT repo, decision_group, 'ADR-' || digits AS adr, title, reason, first_ts, commits,
      digits || '-' || replace(replace(lower(title), ' ', '-'), ':', '') || '.md' AS path FROM (
      SELECT *, CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS digits FROM (
      SELECT *, row_number() OVER (PARTITION BY repo ORDER BY first_ts, decision_group) AS n FROM (
        SELECT repo, {g} AS decision_group, arg_min(subject, ts::VARCHAR || hash) AS title, arg_min(reason, ts::VARCHAR || hash) AS reason, min(ts) AS first_ts, count(*) AS commits
        FROM {v} GROUP BY repo, {g})))"""


@query("w6_number_decisions", NUMBERED_SQL.format(g="session", v="v_sessions"))
def _(t):
    return H.number_decisions(H.decision_sessions(H.decisions(t.commits)).withColumn("decision_group", F.col("session")))


CONTEXT_SQL = """
    WITH tf AS (SELECT DISTINCT f.repo, f.path, d.ts, d.hash FROM v_commit_files f JOIN v_decisions d ON d.hash = f.hash),
    pf AS (SELECT repo, file_a AS path, merged_at, number FROM v_prs WHERE merged_at IS NOT NULL UNION SELECT repo, file_b, merged_at, number FROM v_prs WHERE merged_at IS NOT NULL),
    c AS (SELECT tf.repo, tf.hash, pf.number, pf.merged_at, count(DISTINCT tf.path) AS n FROM tf JOIN pf ON pf.repo = tf.repo AND pf.path = tf.path
      AND pf.merged_at >= tf.ts GROUP BY ALL),
    b AS (SELECT repo, hash, number, n FROM (SELECT *, row_number() OVER (PARTITION BY repo, hash ORDER BY n DESC, merged_at, number) AS rn FROM c) WHERE rn = 1)
    SELECT d.repo, d.hash, d.reason, b.number AS pr, b.n AS overlap, p.title AS pr_title, p.label_a || ',' || p.label_b AS labels, p.number // 100 + 1000 AS issue, i.title AS issue_title
    FROM v_decisions d LEFT JOIN b ON b.hash = d.hash LEFT JOIN v_prs p ON p.number = b.number LEFT JOIN v_issues i ON i.number = p.number // 100 + 1000"""


@query("j20_decision_requests", CONTEXT_SQL)
def _(t):
    return H.decision_context(H.decisions(t.commits), t.commit_files, t.prs_full, t.issues).select(
        "repo", "hash", "reason", "pr", "overlap", "pr_title", "labels", "issue", "issue_title")


@query("c5_decision_records", "SELECT repo, decision_group, count(*) AS commits, min(ts) AS first_ts FROM v_groups GROUP BY repo, decision_group")
def _(t):
    groups = H.group_decisions(H.decisions(t.commits), t.commit_files)
    return verbs.decision_records(t.commits, t.commit_files, t.prs_full, groups).select("repo", "decision_group", "commits", "first_ts")


@query("w7_related_decisions", "SELECT repo, hash, session, decision_group FROM v_related")
def _(t):
    return H.related_decisions(H.decisions(t.commits), t.commit_files).select("repo", "hash", "session", "decision_group")


@query("w6_number_groups", NUMBERED_SQL.format(g="decision_group", v="v_related"))
def _(t):
    """Records of the real groups, numbered by date."""
    return H.number_decisions(H.related_decisions(H.decisions(t.commits), t.commit_files))


BEST_SQL = CONTEXT_SQL.strip().replace("SELECT d.repo, d.hash, d.reason", "@", 1).split("@")[0].rstrip()


@query("c5_records_with_evidence", f"""
    {BEST_SQL},
    n AS ({NUMBERED_SQL.format(g="decision_group", v="v_related")}),
    f AS (SELECT hash, least(count(DISTINCT path), 20) AS n_paths FROM v_commit_files GROUP BY hash)
    SELECT n.repo, n.decision_group, n.adr, n.title, n.reason, n.first_ts, n.commits, n.path, CAST(coalesce(sum(f.n_paths), 0) AS BIGINT) AS paths, min(b.number) AS first_pr
    FROM n JOIN v_related r ON r.repo = n.repo AND r.decision_group = n.decision_group LEFT JOIN f ON f.hash = r.hash LEFT JOIN b ON b.repo = r.repo AND b.hash = r.hash GROUP BY ALL""")
def _(t):
    """The records with every column: number, title, reason, paths and the first request behind them."""
    return verbs.decision_records(t.commits, t.commit_files, t.prs_full)


@query("f27_is_fresh", "SELECT event_id, epoch(timestamp '2024-01-15 12:00:00') - floor(epoch(ts)) <= 3600 AS fresh FROM events")
def _(t):
    return t.events.select("event_id", T.is_fresh(F.col("ts").cast("timestamp"), F.lit("2024-01-15 12:00:00").cast("timestamp")).alias("fresh"))


@query("f31_slug", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_type || ')'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def _(t):
    return t.part.select("p_partkey", T.slug(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("slug"))


@query("a24_pr_labels", "SELECT repo, number, label_a || ',' || label_b AS labels, CAST(2 AS BIGINT) AS files_changed FROM v_prs")
def _(t):
    return H.pr_labels(t.prs_full)


@query("a24_review_counts", "SELECT repo, number, count(*) FILTER (WHERE kind = 'review') AS reviews, count(body) AS comments FROM v_reviews GROUP BY repo, number")
def _(t):
    return H.review_counts(t.reviews)


@query("t5_recent_tags", """SELECT repo, tag, rank FROM (SELECT repo, tag, CAST(row_number() OVER (PARTITION BY repo ORDER BY ts DESC, tag DESC) AS INTEGER) AS rank FROM v_tags) WHERE rank <= 5""")
def _(t):
    return H.recent_tags(t.tags).select("repo", "tag", "rank")


@query("t5_tags_by_version", """
    SELECT 'region' || n_regionkey AS repo, 'v' || n_nationkey || '.' || n_regionkey || '.0' AS tag, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS position FROM nation""")
def _(t):
    return H.tags_by_version(t.tags).select("repo", "tag", "position")


@query("t10_recent_prs", """SELECT repo, number, kind FROM (
      SELECT repo, number, 'pr' AS kind, row_number() OVER (PARTITION BY repo ORDER BY merged_at DESC, number DESC) AS rn FROM v_prs WHERE merged_at IS NOT NULL
      UNION ALL SELECT repo, number, 'issue', row_number() OVER (PARTITION BY repo ORDER BY closed_at DESC, number DESC) FROM v_issues WHERE closed_at IS NOT NULL) WHERE rn <= 20""")
def _(t):
    prs = H.recent_prs(P.merged_prs(t.prs)).select("repo", "number", F.lit("pr").alias("kind"))
    return prs.unionByName(H.recent_issues(P.closed_issues(t.issues)).select("repo", "number", F.lit("issue").alias("kind")))


# Workspaces.
IS_WS = "n_nationkey % 5 <> 4"


@query("w9_workspace_type", """
    SELECT 'n' || n_nationkey AS repo, n_nationkey % 5 <> 4 AS is_monorepo, CASE n_nationkey % 5 WHEN 0 THEN 'pnpm-workspaces' WHEN 1 THEN 'lerna' WHEN 4 THEN 'none' ELSE 'npm-workspaces' END AS workspace_type FROM nation""")
def _(t):
    return WS.workspace_type(SF.read_manifests(t.ws_files)).select("repo", "is_monorepo", "workspace_type")


@query("w9_workspace_type_config", """
    SELECT 'n' || n_nationkey AS repo, CASE WHEN n_regionkey = 1 THEN false WHEN n_regionkey = 2 THEN true ELSE n_nationkey % 5 <> 4 END AS is_monorepo FROM nation""")
def _(t):
    config = t.nation.filter("n_regionkey IN (1, 2)").selectExpr("'n' || n_nationkey AS repo", "n_regionkey = 2 AS enabled")
    return WS.workspace_type(SF.read_manifests(t.ws_files), config).select("repo", "is_monorepo")


@query("j15_resolve_packages", f"""
    SELECT 'n' || s_nationkey AS repo, s_name AS name, 'packages/' || s_suppkey AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'typescript' ELSE 'javascript' END AS language,
      'Package ' || s_suppkey AS description FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE {IS_WS}""")
def _(t):
    _, packages, _, _ = verbs.workspace_map(t.ws_files)
    return packages


EDGES_SQL = """SELECT DISTINCT a.repo, a.name AS "from", b.name AS "to" FROM v_pkg_deps d JOIN v_packages a ON a.repo = d.repo AND a.path = d.path JOIN v_packages b ON b.repo = d.repo AND b.name = d.dep WHERE a.name <> b.name"""


@query("j8_package_edges", EDGES_SQL)
def _(t):
    return WS.package_edges(t.packages, t.pkg_deps)


SHARED_SQL = "SELECT repo, dep, count(DISTINCT path) AS packages FROM v_ext_deps GROUP BY repo, dep HAVING count(DISTINCT path) > 1"


@query("a20_shared_dependencies", SHARED_SQL)
def _(t):
    return WS.shared_dependencies(t.packages, t.ext_deps)


@query("t6_top_shared_deps", f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY packages DESC, dep DESC) AS INTEGER) AS rank FROM ({SHARED_SQL})) WHERE rank <= 10")
def _(t):
    return WS.top_shared_deps(WS.shared_dependencies(t.packages, t.ext_deps))


@query("c7_workspace_map", f"""
    SELECT k.repo, k.n AS packages, coalesce(e.n, 0) AS edges, coalesce(s.n, 0) AS shared FROM (
      SELECT s_nationkey, 'n' || s_nationkey AS repo, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE {IS_WS} GROUP BY s_nationkey) k
    LEFT JOIN (SELECT a.s_nationkey, count(*) AS n FROM supplier a JOIN supplier b ON b.s_suppkey = (a.s_suppkey + 1) % 100 AND a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY a.s_nationkey) e ON e.s_nationkey = k.s_nationkey
    LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM (SELECT s_nationkey, dep FROM (SELECT s_nationkey, 'express' AS dep FROM supplier
        UNION ALL SELECT s_nationkey, CAST((s_suppkey + 1) % 100 AS VARCHAR) FROM supplier) GROUP BY s_nationkey, dep HAVING count(*) > 1) GROUP BY s_nationkey) s ON s.s_nationkey = k.s_nationkey""")
def _(t):
    _, packages, edges, shared = verbs.workspace_map(t.ws_files)
    count = lambda df, name: df.groupBy("repo").agg(F.count("*").alias(name))
    return count(packages, "packages").join(count(edges, "edges"), "repo", "left").join(count(shared, "shared"), "repo", "left").fillna(0, ["edges", "shared"])


# Progress.
PROGRESS_SQL = r"""
    SELECT m.repo, m.milestone, m.item, CASE WHEN m.status = 'done' THEN 'done' WHEN CASE m.detect_type
        WHEN 'file_exists' THEN EXISTS (SELECT 1 FROM v_code f WHERE f.repo = m.repo AND f.path = m.detect_value)
        WHEN 'grep' THEN EXISTS (SELECT 1 FROM grep_hits g WHERE g.repo = m.repo AND g.regex = m.detect_value AND g.root = m.detect_path)
        ELSE EXISTS (SELECT 1 FROM v_exports e WHERE e.repo = m.repo AND e.name = m.detect_value) END THEN 'detected' ELSE 'pending' END AS state FROM v_milestones m"""
GREP_CTE = """grep_hits AS (SELECT DISTINCT r.repo, r.regex, r.root FROM (SELECT DISTINCT repo, detect_value AS regex, detect_path AS root FROM v_milestones WHERE detect_type = 'grep' AND status = 'pending') r
    JOIN v_code f ON f.repo = r.repo AND starts_with(f.path, r.root || '/') AND regexp_matches(f.content, r.regex))"""


@query("p14_pending_items", "SELECT repo, milestone, item FROM v_milestones WHERE status = 'pending'")
def _(t):
    return P.pending_items(t.milestones).select("repo", "milestone", "item")


@query("j17_detect_progress", f"WITH {GREP_CTE} {PROGRESS_SQL}")
def _(t):
    return PR.detect_progress(t.milestones, t.code, SU.exported_names(t.code)).select("repo", "milestone", "item", "state")


REPORT_SQL = """SELECT repo, {m} AS milestone, count(*) AS total, count(*) FILTER (WHERE state <> 'pending') AS done, count(*) FILTER (WHERE state = 'pending') AS pending,
    count(*) FILTER (WHERE state = 'detected') AS newly_detected, CAST(count(*) FILTER (WHERE state <> 'pending') * 100 // count(*) AS BIGINT) AS percent FROM d GROUP BY {g}"""
FULL_REPORT = f"WITH {GREP_CTE}, d AS ({PROGRESS_SQL}) {REPORT_SQL.format(m='milestone', g='repo, milestone')} UNION ALL {REPORT_SQL.format(m=chr(39) + 'TOTAL' + chr(39), g='repo')}"


@query("a23_progress_report", FULL_REPORT)
def _(t):
    return PR.progress_report(PR.detect_progress(t.milestones, t.code, SU.exported_names(t.code)))


@query("c8_progress", FULL_REPORT)
def _(t):
    _, report = verbs.progress(t.milestones, t.code)
    return report


@query("c8_save_progress", FULL_REPORT)
def _(t):
    """The whole job: detect, write the new statuses back, report on the written snapshot."""
    return verbs.save_progress(t.milestones, t.code, scratch_path(t.spark, "milestones"), F.lit("2024-01-01 00:00:00").cast("timestamp"))


@query("s11_read_milestones", """
    SELECT repo, milestone, item, status, detect_type, detect_value, detect_path FROM v_milestones""")
def _(t):
    """Each item as a one-item milestone document, read, written as a new snapshot and read back."""
    rule = lambda kind: F.when(F.col("detect_type") == kind, F.col("detect_value")).alias(kind)
    detect = F.struct(rule("file_exists"), rule("grep"), F.col("detect_path").alias("grep_path"), rule("export_exists"))
    item = F.struct(F.col("item").alias("name"), "status", detect.alias("detect"))
    doc = F.to_json(F.struct(F.lit(1).alias("version"), F.array(F.struct(F.col("milestone").alias("name"), F.array(item).alias("items"))).alias("milestones")))
    items = ST.read_milestones(t.milestones.select("repo", doc.alias("content")))
    path = scratch_path(t.spark, "milestones")
    ST.write_milestones(items, path, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    columns = ["repo", "milestone", "item", "status", "detect_type", "detect_value", "detect_path"]
    return t.spark.read.schema(", ".join(f"{c} string" for c in columns)).json(path)


# Versions and benchmark runs.
@query("s10_snapshot_docs", """
    SELECT repo, doc, tag, length(content) AS n_chars FROM v_docs CROSS JOIN (VALUES ('v1'), ('v2')) AS x(tag)""")
def _(t):
    path = scratch_path(t.spark, "versions")
    stamp = lambda s: F.lit(s).cast("timestamp")
    ST.snapshot_docs(t.docs, path, "v1", stamp("2023-01-01 00:00:00"))
    ST.snapshot_docs(t.docs.withColumn("content", F.lit("draft")), path, "v2", stamp("2023-02-01 00:00:00"))
    ST.snapshot_docs(t.docs, path, "v2", stamp("2023-03-01 00:00:00"))
    return ST.read_versions(t.spark, path).select("repo", "doc", "tag", F.length("content").cast("bigint").alias("n_chars"))


@query("j16_tag_snapshots", "SELECT repo, tag, tag IN (SELECT tag FROM v_versions) AS has_snapshot FROM v_tags")
def _(t):
    return U.tag_snapshots(t.tags, t.versions)


@query("w10_current_version", """
    SELECT f.repo, coalesce(s.tag, f.tag) AS current FROM (SELECT repo, arg_min(tag, created) AS tag FROM v_versions GROUP BY repo) f
    LEFT JOIN (SELECT repo, arg_max(tag, switched_at) AS tag FROM v_switches GROUP BY repo) s ON s.repo = f.repo""")
def _(t):
    return U.current_version(t.versions, t.switches)


BENCH_SQL = """
    SELECT stage, run_ts, ms, prev_ms, ms - prev_ms AS diff_ms, abs(ms - prev_ms) * 100 // prev_ms AS percent,
      CASE WHEN prev_ms IS NULL THEN 'no previous data' WHEN ms <= prev_ms THEN 'faster' ELSE 'slower' END AS direction
    FROM (SELECT *, lag(ms) OVER (PARTITION BY stage ORDER BY run_ts) AS prev_ms FROM v_bench)"""


@query("w4_bench_compare", BENCH_SQL)
def _(t):
    return U.bench_compare(t.bench)


@query("w4_bench_compare_hot", BENCH_SQL)
def _(t):
    return U.bench_compare(t.bench)
