"""Scanning: files, filters, secrets, languages, frameworks, entry points."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from corpusloom import fixed_values as fv
from corpusloom.fixed_values import SecretPattern
from corpusloom.functions import code as C
from corpusloom.functions import text as T
from corpusloom.operators import filters as P
from corpusloom.operators import secrets as S
from corpusloom.operators import surface as SU
from corpusloom.operators import usage as U
from corpusloom.operators import verification as V
from corpusloom.operators import workspace as WS
from corpusloom.runtime import scratch_path
from corpusloom.sources import files as SF

BARE = SecretPattern(17, "Bare Token", r"""token\s*=\s*"[a-f0-9]{40}\"""", "medium", ("token",))
PATTERNS = [*fv.SECRET_PATTERNS, BARE]


def sql_patterns() -> str:
    rows = ", ".join("({}, '{}', '{}')".format(p.pattern_id, p.name, p.regex.replace("'", "''")) for p in PATTERNS)
    return f"(SELECT * FROM (VALUES {rows}) AS x(pattern_id, name, regex))"


FINDINGS_SQL = f"""SELECT l.repo, l.path, CAST(l.pos AS INTEGER) AS line, p.pattern_id, p.name AS pattern FROM
  (SELECT repo, path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS pos
   FROM v_files WHERE NOT regexp_matches(path, '\\.(md|hbs|lock|svg|png|jpg)$')) l
  JOIN {sql_patterns()} p ON regexp_matches(l.text, p.regex)"""


@query("s1_read_corpus", "SELECT repo, path, n_lines, n_bytes, sha256(content) AS sha256 FROM v_files")
def _(t):
    path = scratch_path(t.spark, "files")
    SF.write_files(t.files.select("repo", "path", "content", "language", "n_lines", "n_bytes", F.lit(None).cast("timestamp").alias("last_modified")), path)
    return SF.read_files(t.spark, path).select("repo", "path", "n_lines", "n_bytes", T.content_hash(F.col("content")).alias("sha256"))


@query("s2_read_manifests", """
    SELECT repo, path, CASE WHEN path LIKE '%package.json' THEN 'npm' WHEN path = 'lerna.json' THEN 'lerna' WHEN path LIKE 'pnpm%' THEN 'pnpm'
        WHEN path = 'go.mod' THEN 'go' ELSE 'pip' END AS kind,
      CASE WHEN path LIKE '%package.json' THEN json_extract_string(content, '$.name') WHEN path = 'go.mod' THEN regexp_extract(content, 'module ([^\\s]+)', 1) END AS name,
      CASE WHEN path LIKE '%.json' THEN json_extract_string(content, '$.version') END AS version,
      CASE WHEN path LIKE '%package.json' THEN json_extract_string(content, '$.main') END AS main,
      CASE WHEN path LIKE '%package.json' THEN array_to_string(list_sort(json_keys(content, '$.dependencies')), ',')
        WHEN path = 'go.mod' THEN 'github.com/gin-gonic/gin' WHEN path = 'requirements.txt' THEN 'Django,pytest' ELSE '' END AS deps,
      CASE WHEN path IN ('lerna.json', 'pnpm-workspace.yaml') OR content LIKE '%"workspaces"%' THEN 'packages/*' END AS workspaces
    FROM v_ws_files WHERE regexp_matches(path, '(^|/)(package\\.json|lerna\\.json|pnpm-workspace\\.yaml|go\\.mod|requirements\\.txt)$')""".replace("\\\\", "\\"))
def _(t):
    return SF.read_manifests(t.ws_files).select(
        "repo", "path", "kind", "name", "version", "main",
        F.array_join(F.array_sort(F.map_keys("dependencies")), ",").alias("deps"), F.array_join("workspaces", ",").alias("workspaces"))


@query("p1_hard_excludes", "SELECT repo, path, n_lines FROM v_files WHERE path NOT LIKE 'node_modules/%'")
def _(t):
    return P.hard_excludes(t.files).select("repo", "path", "n_lines")


@query("p2_exclude_globs", "SELECT repo, path FROM v_files WHERE path NOT LIKE '%.test.%'")
def _(t):
    return P.exclude_globs(t.files).select("repo", "path")


@query("p3_include_prefixes", "SELECT repo, path FROM v_files WHERE path LIKE 'src/%'")
def _(t):
    return P.include_prefixes(t.files).select("repo", "path")


@query("p4_skip_binary", "SELECT repo, path, strlen(content) AS n_bytes FROM v_files WHERE position(chr(0) IN content) = 0")
def _(t):
    kept, _ = P.skip_binary(t.files)
    return kept.select("repo", "path", F.octet_length("content").cast("bigint").alias("n_bytes"))


@query("p5_skip_non_code", "SELECT repo, path FROM v_files WHERE path NOT LIKE '%.md'")
def _(t):
    return P.skip_non_code(t.files).select("repo", "path")


@query("p6_source_dirs", "SELECT repo, path FROM v_files WHERE path LIKE 'src/%'")
def _(t):
    return P.source_dirs(t.files).select("repo", "path")


@query("p7_drop_tests", "SELECT repo, path FROM v_files WHERE path NOT LIKE '%test%' AND path NOT LIKE 'node_modules/%'")
def _(t):
    return P.drop_tests(t.files).select("repo", "path")


@query("p8_select_docs", "SELECT repo, path AS doc, length(content) AS n_chars FROM v_files WHERE path LIKE 'docs/%.md'")
def _(t):
    return P.select_docs(t.files).select("repo", "doc", F.length("content").cast("bigint").alias("n_chars"))


@query("p9_docs_with_markers", "SELECT repo, doc, length(content) AS n_chars FROM v_docs WHERE content LIKE '%docs:start:%'")
def _(t):
    return P.docs_with_markers(t.docs).select("repo", "doc", F.length("content").cast("bigint").alias("n_chars"))


@query("p10_consented", "SELECT event_id, command FROM v_telemetry WHERE enabled AND NOT do_not_track")
def _(t):
    return P.consented(t.telemetry).select("event_id", "command")


@query("p17_ignore_patterns", "SELECT repo, doc FROM v_docs WHERE doc NOT LIKE 'docs/fr/%' AND doc NOT LIKE '%/1.md'")
def _(t):
    return P.ignore_patterns(t.docs, ["docs/fr/*", "**/1.md"]).select("repo", "doc")


@query("p18_oversized", "SELECT repo, path, n_lines FROM v_files WHERE n_lines > 50")
def _(t):
    return P.oversized(t.files, 50).select("repo", "path", "n_lines")


@query("j1_scan_secrets", FINDINGS_SQL)
def _(t):
    return S.scan_secrets(t.files, PATTERNS).select("repo", "path", "line", "pattern_id", "pattern")


@query("a2_secret_summary", f"SELECT repo, pattern, count(*) AS found, count(*) AS redacted, count(DISTINCT path) AS files FROM ({FINDINGS_SQL}) GROUP BY repo, pattern")
def _(t):
    return S.secret_summary(S.scan_secrets(t.files, PATTERNS))


@query("f23_redact", r"""SELECT repo, path, sha256(regexp_replace(content, 'token\s*=\s*"[a-f0-9]{40}"', '[REDACTED: Bare Token detected]', 'g')) AS redacted_sha256 FROM v_files""")
def _(t):
    return t.files.select("repo", "path", F.sha2(S.redact(F.col("content"), [BARE]), 256).alias("redacted_sha256"))


@query("j18_frameworks", """
    SELECT repo, string_agg(label, ',' ORDER BY label) AS frameworks FROM (
      SELECT 'n' || n_nationkey AS repo, unnest(['react', 'express', 'vitest']) AS label FROM nation
      UNION ALL SELECT 'n' || n_nationkey, unnest(['django', 'pytest']) FROM nation WHERE n_regionkey = 1
      UNION ALL SELECT 'n' || n_nationkey, 'gin' FROM nation WHERE n_regionkey = 2
      UNION ALL SELECT 'n' || n_nationkey, 'vite' FROM nation WHERE n_regionkey = 3) GROUP BY repo""")
def _(t):
    deps = SF.dependency_rows(SF.read_manifests(t.ws_files))
    return WS.frameworks(t.ws_files, deps).select("repo", F.array_join("frameworks", ",").alias("frameworks"))


@query("w8_entry_points", """
    SELECT DISTINCT repo, path FROM (SELECT 'n' || n_nationkey AS repo, 'src/index.js' AS path FROM nation
      UNION ALL SELECT 'n' || n_nationkey, 'cmd/tool/main.go' FROM nation WHERE n_regionkey = 2)""")
def _(t):
    return WS.entry_points(t.ws_files.select("repo", "path"), SF.read_manifests(t.ws_files))


@query("f29_detect_language", """
    SELECT 'n' || n_nationkey AS repo, 'javascript' || CASE n_regionkey WHEN 1 THEN ',python' ELSE '' END AS languages FROM nation WHERE n_regionkey <> 2
    UNION ALL SELECT 'n' || n_nationkey, 'go,javascript' FROM nation WHERE n_regionkey = 2""")
def _(t):
    deps = SF.dependency_rows(SF.read_manifests(t.ws_files))
    return WS.detect_language(t.ws_files.select("repo", "path"), deps).select("repo", F.array_join("languages", ",").alias("languages"))


@query("f30_package_language", """
    SELECT 'n' || s_nationkey AS repo, 'packages/' || s_suppkey AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'typescript' ELSE 'javascript' END AS language
    FROM supplier""")
def _(t):
    base = T.basename(F.col("path"))
    marker = lambda *names: F.bool_or(base.isin(list(names)))
    inside = t.ws_files.filter("path LIKE 'packages/%' AND path NOT LIKE '%/src/%'")
    return inside.groupBy("repo", T.dirname(F.col("path")).alias("path")).agg(WS.package_language(marker).alias("language"))


@query("u5_merge_labels", """
    SELECT repo, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT repo, language AS label FROM v_files
      UNION SELECT DISTINCT repo, regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) FROM v_files) GROUP BY repo""".replace("\\\\", "\\"))
def _(t):
    langs = t.files.select("repo", F.col("language").alias("label"))
    kinds = t.files.select("repo", T.suffix(F.col("path")).alias("label"))
    return WS.merge_labels(langs, kinds).select("repo", F.array_join("labels", ",").alias("labels"))


@query("a1_scan_summary", f"""
    SELECT f.repo, count(*) AS files, CAST(sum(n_lines) AS BIGINT) AS lines, string_agg(DISTINCT f.language, ' ' ORDER BY f.language) AS languages,
      string_agg(DISTINCT regexp_extract(f.path, '\\.([A-Za-z0-9]+)$', 1), ' ' ORDER BY regexp_extract(f.path, '\\.([A-Za-z0-9]+)$', 1)) AS frameworks,
      min(f.path) AS entry_points, any_value(coalesce(s.n, 0)) AS secrets
    FROM v_files f LEFT JOIN (SELECT repo, count(*) AS n FROM ({FINDINGS_SQL}) GROUP BY repo) s ON s.repo = f.repo GROUP BY f.repo""")
def _(t):
    langs = WS.merge_labels(t.files.select("repo", F.col("language").alias("label"))).withColumnRenamed("labels", "languages")
    kinds = WS.merge_labels(t.files.select("repo", T.suffix(F.col("path")).alias("label"))).withColumnRenamed("labels", "frameworks")
    entries = t.files.groupBy("repo").agg(F.min("path").alias("path"))
    return WS.scan_summary(t.files, langs, kinds, entries, S.scan_secrets(t.files, PATTERNS))


@query("t1_sorted_files", "SELECT repo, path, n_lines FROM v_files")
def _(t):
    return SF.sorted_files(t.files)


@query("u1_doc_locations", "SELECT DISTINCT repo, path AS doc FROM v_files WHERE path LIKE 'docs/%.md' UNION SELECT repo, doc FROM v_docs")
def _(t):
    return P.select_docs(t.files).select("repo", "doc").union(t.docs.select("repo", "doc")).distinct()


@query("f1_content_hash", "SELECT repo, path, sha256(content) AS sha256 FROM v_files")
def _(t):
    return t.files.select("repo", "path", T.content_hash(F.col("content")).alias("sha256"))


@query("f2_line_count", "SELECT repo, path, len(string_split(content, chr(10))) - 1 AS n FROM v_files")
def _(t):
    return t.files.select("repo", "path", T.line_count(F.col("content")).cast("bigint").alias("n"))


@query("f3_path_parts", """
    SELECT repo, path, array_to_string(string_split(path, '/')[1:-2], '/') AS dir, string_split(path, '/')[-1] AS base,
      '.' || CASE WHEN path LIKE 'docs/%' THEN '|docs' WHEN path LIKE 'node_modules/%' THEN '|node_modules|node_modules/x'
        ELSE '|src|' || array_to_string(string_split(path, '/')[1:2], '/') END AS ancestors FROM v_files""")
def _(t):
    p = F.col("path")
    return t.files.select("repo", "path", T.dirname(p).alias("dir"), T.basename(p).alias("base"), F.array_join(T.ancestors(p), "|").alias("ancestors"))


@query("f26_short_hash", "SELECT repo, path, left(sha256(content), 12) AS short FROM v_files")
def _(t):
    return t.files.select("repo", "path", T.short_hash(T.content_hash(F.col("content"))).alias("short"))


@query("f35_glob_match", """
    SELECT repo, path, path LIKE 'src/%.ts' AS a, regexp_matches(path, '^.*/d[0-9]\\..*$') AS b, path LIKE '%.test.%' AS c FROM v_files""".replace("\\\\", "\\"))
def _(t):
    p = F.col("path")
    return t.files.select("repo", "path", T.glob_match(p, "src/*.ts").alias("a"), T.glob_match(p, "*/d[0-9].*").alias("b"), T.glob_match(p, "*.test.*").alias("c"))


@query("f28_frontmatter", """
    SELECT repo, path, 'Notes on ' || lang AS description, CASE WHEN doc_id % 2 = 0 THEN '*.' || lang END AS file_filter
    FROM v_files JOIN documents USING (doc_id)""")
def _(t):
    header = F.concat(
        F.lit("---\ndescription: Notes on "), "language", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\nfile-filter: *."), "language")).otherwise(""),
        F.lit("\n---\n"), "content")
    rows = t.files.select("repo", "path", header.alias("content"))
    return rows.select("repo", "path", T.frontmatter(F.col("content"), "description").alias("description"), T.frontmatter(F.col("content"), "file-filter").alias("file_filter"))


@query("f25_env_vars", """
    SELECT repo, path, CASE lang WHEN 'en' THEN 'PORT_' ELSE 'KEY_' END || (doc_id % 13) AS env_vars FROM v_code JOIN documents USING (doc_id)""")
def _(t):
    return t.code.select("repo", "path", F.array_join(C.env_vars(F.col("content")), ",").alias("env_vars"))


@query("f33_graphql_hint", """
    SELECT repo, path, regexp_matches(content, 'typeDefs|resolvers|@(Query|Mutation|Subscription)\\b') AS graphql FROM v_code""".replace("\\\\", "\\"))
def _(t):
    return t.code.select("repo", "path", C.graphql_hint(F.col("path"), F.col("content")).alias("graphql"))


@query("a22_size_buckets", """
    SELECT CASE WHEN lines < 10000 THEN 'small' WHEN lines < 100000 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS repos, CAST(sum(lines) AS BIGINT) AS lines
    FROM (SELECT repo, sum(n_lines) AS lines FROM v_files GROUP BY repo) GROUP BY 1""")
def _(t):
    return U.size_buckets(t.files)


@query("a22_language_distribution", "SELECT language, count(DISTINCT repo) AS repos FROM v_files GROUP BY language")
def _(t):
    return U.language_distribution(t.files.select("repo", "language"))


@query("u3_union_detections", "SELECT repo, path, line, framework AS kind FROM v_endpoints UNION ALL SELECT repo, path, line, kind FROM v_exports")
def _(t):
    return SU.union_detections(
        SU.endpoints(t.code).select("repo", "path", "line", F.col("framework").alias("kind")), SU.exports(t.code).select("repo", "path", "line", "kind"))


@query("j13_repo_features", "SELECT repo, false AS has_manifest, false AS has_license FROM v_files GROUP BY repo")
def _(t):
    return V.repo_features(t.files)
