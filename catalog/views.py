"""Stand-in tables: deterministic projections of the given tables, stated once for Spark and once for SQL.

A view over one table is a list of column expressions in the SQL subset both engines share; views that
aggregate or join are written out for each engine. All of them cover every row of their input.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

COMPUTED_TEXT = {"v_code"}

K = "cast(floor(doc_id / 20) as bigint)"
PLAIN_PATH = (
    "'src/' || lang || '/d' || doc_id || CASE lang WHEN 'en' THEN '.ts' WHEN 'fr' THEN '.py' WHEN 'de' THEN '.go' ELSE '.rs' END"
)
FILE_PATH = (
    f"CASE {K} % 10 WHEN 0 THEN 'src/' || lang || '/d' || doc_id || '.test.js' WHEN 1 THEN 'docs/d' || doc_id || '.md' "
    f"WHEN 2 THEN 'node_modules/x/d' || doc_id || '.js' ELSE {PLAIN_PATH} END"
)
CODE_PATH = (
    f"CASE WHEN {K} % 10 = 0 THEN 'src/' || lang || '/d' || doc_id || '.test.js' ELSE CASE lang WHEN 'en' THEN 'src/en/d' || doc_id || '.ts' "
    "WHEN 'fr' THEN 'app/fr/d' || doc_id || '.py' WHEN 'de' THEN 'internal/de/d' || doc_id || '.go' ELSE 'src/es/d' || doc_id || '.rs' END END"
)
N_LINES = "cast(length({0}) - length(replace({0}, chr(10), '')) as int)"
VERB = f"split_part('get,post,put,patch,delete', ',', cast({K} % 5 + 1 as int))"
RES = "split_part('users,orders,auth,items,files,tags,logs', ',', cast(doc_id % 7 + 1 as int))"
GUARD = "CASE WHEN doc_id % 3 = 0 THEN 'requireAuth, ' ELSE '' END"
CODE_EN = (
    f"'import {{ h }} from ' || chr(39) || './d' || (doc_id + 20) || chr(39) || ';' || chr(10) || "
    f"'const lib = require(' || chr(39) || 'express' || chr(39) || ');' || chr(10) || "
    f"'router.' || {VERB} || '(' || chr(39) || '/api/' || {RES} || '/:id' || chr(39) || ', ' || {GUARD} || 'h' || doc_id || ');' || chr(10) || "
    f"'export function fn' || doc_id || '() {{}}' || chr(10) || 'const port = process.env.PORT_' || (doc_id % 13) || ';'"
)
CODE_FR = (
    f"'from pkg.mod' || (doc_id % 9) || ' import thing' || chr(10) || '@app.' || {VERB} || '(\"/api/' || {RES} || '\")' || chr(10) || "
    f"'def make_' || doc_id || '(x):' || chr(10) || '    return os.environ[\"KEY_' || (doc_id % 13) || '\"]'"
)
CODE_DE = (
    f"'import \"example.com/lib' || (doc_id % 9) || '\"' || chr(10) || 'r.' || upper({VERB}) || '(\"/api/' || {RES} || '\", h)' || chr(10) || "
    f"'func Name' || doc_id || '() {{}}' || chr(10) || 'key := os.Getenv(\"KEY_' || (doc_id % 13) || '\")'"
)
CODE_ES = (
    f"'use crate::mod' || (doc_id % 9) || ';' || chr(10) || '#[' || {VERB} || '(\"/api/' || {RES} || '\")]' || chr(10) || "
    f"'pub fn name' || doc_id || '() {{}}' || chr(10) || 'let key = env::var(\"KEY_' || (doc_id % 13) || '\");'"
)
CODE = f"text || chr(10) || CASE lang WHEN 'en' THEN {CODE_EN} WHEN 'fr' THEN {CODE_FR} WHEN 'de' THEN {CODE_DE} ELSE {CODE_ES} END || chr(10)"
# Code with imports of every language, of which most name another document's file.
UNIT_REPO = "'g' || cast(floor(doc_id / 64) as bigint)"
UNIT_PATH = (
    "CASE doc_id % 4 WHEN 0 THEN 'crates/core/src/m' || doc_id || '.rs' WHEN 1 THEN 'py/pkg/m' || doc_id || '.py' "
    "WHEN 2 THEN 'svc/d' || doc_id || '/x.go' ELSE 'web/src/s' || doc_id || '/index.ts' END"
)
UNIT_RS = (
    "'use crate::{m' || (doc_id + 4) || ', helper::{self, Tool}};' || chr(10) || 'mod sub;' || chr(10) || 'extern crate serde;' || chr(10) || "
    "'pub use super::m' || (doc_id + 8) || '::*;'"
)
UNIT_PY = "'from . import m' || (doc_id + 4) || ', other' || chr(10) || 'import os, ' || chr(92) || chr(10) || '  sys' || chr(10) || 'from pkg.m' || (doc_id + 8) || ' import (thing,' || chr(10) || ' more)'"
UNIT_GO = "'import (' || chr(10) || '  \"fmt\"' || chr(10) || '  z \"example.com/svc/d' || (doc_id + 4) || '\"' || chr(10) || ')'"
UNIT_TS = (
    "'const a = await import(' || chr(96) || '../s' || (doc_id + 4) || chr(96) || ');' || chr(10) || "
    "'import b from ' || chr(39) || '@web/app/s' || (doc_id + 8) || chr(39) || ';'"
)
UNIT_CODE = f"coalesce(text, '') || chr(10) || CASE doc_id % 4 WHEN 0 THEN {UNIT_RS} WHEN 1 THEN {UNIT_PY} WHEN 2 THEN {UNIT_GO} ELSE {UNIT_TS} END || chr(10)"
#: Files that every unit repo has beside: path and content.
UNIT_ROOTS = [
    ("crates/core/src/lib.rs", "pub mod helper;"), ("py/pkg/__init__.py", ""), ("svc/go.mod", "module example.com/svc"), ("web/package.json", '{"name": "@web/app"}'),
]
DOC = "'docs/' || lang || '/' || cast(floor(doc_id / 1000) as bigint) || '.md'"
T0 = "timestamp '1995-01-01 00:00:00'"

# name -> (base table, {column: expression}, filter). SHA(...) is SHA-256 in hexadecimal.
SIMPLE: dict[str, tuple[str, dict[str, str], str | None]] = {
    "v_files": ("documents", {
        "repo": "source", "path": FILE_PATH, "content": "text", "language": "lang", "n_lines": N_LINES.format("text"),
        "n_bytes": "cast(octet_length(SHAB(text)) as bigint)", "doc_id": "doc_id"}, None),
    "v_code": ("documents", {
        "repo": "source", "path": CODE_PATH, "content": CODE, "language": "lang", "n_lines": N_LINES.format("text") + " + 1",
        "doc_id": "doc_id"}, None),
    "v_units": ("documents", {"repo": UNIT_REPO, "path": UNIT_PATH, "content": UNIT_CODE, "doc_id": "doc_id"}, None),
    "v_refs": ("documents", {
        "repo": "source", "doc": DOC, "section": "'s' || (doc_id % 3)",
        "path": f"{FILE_PATH} || CASE WHEN doc_id % 9 = 0 THEN '.gone' ELSE '' END", "doc_id": "doc_id"}, None),
    "v_code_refs": ("documents", {"repo": "source", "path": CODE_PATH, "doc_id": "doc_id"}, "doc_id % 3 = 0"),
    "v_manifest": ("documents", {
        "repo": "source", "path": FILE_PATH, "sha256": "SHA(text || CASE WHEN doc_id % 7 = 0 THEN '#' ELSE '' END)",
        "snapshot_ts": "timestamp '2024-01-01 00:00:00'"}, f"{K} % 5 <> 0"),
    "v_baseline": ("documents", {
        "repo": "source", "ref_path": FILE_PATH, "sha256": f"SHA(text || CASE WHEN {K} % 4 = 0 THEN '#' ELSE '' END)",
        "saved_at": "timestamp '2024-01-01 00:00:00'"}, f"{K} % 6 <> 0"),
    "v_baseline2": ("documents", {
        "repo": "source", "ref_path": FILE_PATH, "sha256": "SHA(text || CASE WHEN doc_id % 47 = 0 THEN '#' ELSE '' END)",
        "saved_at": "timestamp '2024-01-01 00:00:00'"}, "doc_id % 61 <> 0"),
    "v_telemetry": ("events", {
        "anonymous_id": "cast(user_id as varchar(20))", "ts": "ts", "command": "event_type",
        "language": "split_part('javascript,python,go,rust', ',', cast(user_id % 4 + 1 as int))", "repo_lines": "user_id * 1000",
        "enabled": "user_id % 2 = 0", "do_not_track": "user_id % 5 = 0", "event_id": "event_id"}, None),
    "v_prs": ("conversations", {
        "repo": "'r' || (conv_id % 40)", "number": "conv_id * 100 + turn", "title": "'change ' || conv_id || '/' || turn",
        "body": "text || chr(10) || 'Fixes #' || (conv_id + 1000)", "author": "'u' || (conv_id % 7)",
        "merged_at": f"CASE WHEN (conv_id + turn) % 10 <> 9 THEN {T0} + (((conv_id * 7 + turn * 31) % 2400) * interval '1' day) END",
        "label_a": "role", "label_b": "'area-' || (conv_id % 3)",
        "file_a": "'src/m' || (length(text) % 50) || '/p' || (length(text) % 200) || '.py'",
        "file_b": "'src/m' || ((length(text) + turn) % 50) || '/p' || ((length(text) + turn) % 200) || '.py'"}, None),
    "v_issues": ("conversations", {
        "repo": "'r' || (conv_id % 40)", "number": "conv_id + 1000", "title": "'issue ' || conv_id", "body": "text",
        "author": "'u' || (conv_id % 5)",
        "closed_at": f"CASE WHEN conv_id % 4 <> 0 THEN {T0} + ((conv_id % 2400) * interval '1' day) END", "label_a": "role"}, "turn = 0"),
    "v_issue_turns": ("conversations", {
        "repo": "'r' || (conv_id % 40)", "number": "conv_id * 100 + turn", "title": "'issue ' || conv_id || '/' || turn", "body": "text",
        "author": "'u' || (conv_id % 5)",
        "closed_at": f"CASE WHEN (conv_id + turn) % 4 <> 0 THEN {T0} + (((conv_id + turn * 3) % 2400) * interval '1' day) END", "label_a": "role"}, None),
    "v_reviews": ("conversations", {
        "repo": "'r' || (conv_id % 40)", "number": "conv_id", "kind": "CASE WHEN role = 'assistant' THEN 'review' ELSE 'comment' END",
        "state": "CASE WHEN role <> 'assistant' THEN NULL WHEN turn % 4 = 1 THEN 'APPROVED' ELSE 'COMMENTED' END", "body": "text",
        "author": "role", "turn": "turn"}, None),
    "v_milestones": ("part", {
        "repo": "'src' || (p_partkey % 20)", "milestone": "p_brand", "item": "'p' || p_partkey",
        "status": "CASE WHEN p_size % 3 = 0 THEN 'done' ELSE 'pending' END",
        "detect_type": "split_part('file_exists,grep,export_exists', ',', cast(p_partkey % 3 + 1 as int))",
        "detect_value": "CASE p_partkey % 3 WHEN 0 THEN 'src/en/d' || (p_partkey % 1100) || '.ts' "
                        "WHEN 1 THEN '(PORT|KEY)_' || (p_partkey % 13) || '[^0-9]' ELSE 'fn' || (p_partkey % 1100) END",
        "detect_path": "CASE WHEN p_partkey % 3 = 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'src' ELSE 'app' END END"}, None),
    "v_tags": ("nation", {
        "repo": "'region' || n_regionkey", "tag": "'v' || n_nationkey || '.' || n_regionkey || '.0'",
        "ts": f"{T0} + ((n_nationkey * 7 % 25) * interval '1' day)"}, None),
    "v_versions": ("nation", {
        "repo": "'region' || n_regionkey", "tag": "'v' || n_nationkey || '.' || n_regionkey || '.0'", "doc": "'docs/' || n_name || '.md'",
        "content": "'# ' || n_name", "created": f"{T0} + ((n_nationkey * 11 % 25) * interval '1' day)"}, "n_nationkey % 2 = 0"),
    "v_switches": ("nation", {
        "repo": "'region' || n_regionkey", "tag": "'v' || n_nationkey || '.' || n_regionkey || '.0'",
        "switched_at": f"{T0} + (n_nationkey * interval '1' day)"}, "n_regionkey % 2 = 0"),
    "v_packages": ("supplier", {
        "repo": "'n' || s_nationkey", "name": "s_name", "path": "'packages/' || s_suppkey", "s_suppkey": "s_suppkey"}, None),
    "v_pages": ("pages", {"page_id": "page_id", "url": "url", "html": "html"}, None),
}

# Views over other views or several tables, for the SQL side; their Spark twins are methods of Tables.
COMPOSED_SQL: dict[str, str] = {
    "v_docs": """
        SELECT repo, doc, string_agg(body, chr(10) ORDER BY section) AS content FROM (
          SELECT repo, doc, section,
            '<!-- docs:start:' || section || ' -->' || chr(10) || '## ' ||
            CASE section WHEN 's0' THEN 'Overview' WHEN 's1' THEN 'Installation' ELSE 'Usage' END || chr(10) ||
            'The service has ' || count(*) || ' API endpoints and runs on Express ' || (4 + count(*) % 2) || '.' || chr(10) ||
            'GET /api/' || section || ' lists everything.' || chr(10) ||
            '<!-- docs:refs:' || string_agg(path, ',' ORDER BY path) || ' -->' ||
            CASE WHEN section = 's1' AND count(*) % 5 = 0 THEN '' ELSE chr(10) || '<!-- docs:end:' || section || ' -->' END AS body
          FROM v_refs GROUP BY repo, doc, section) GROUP BY repo, doc""",
    "v_doc_lines": """
        SELECT repo, doc, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM v_docs""",
    "v_sections": """
        SELECT repo, doc, section, ord AS section_ord, refs FROM (
          SELECT repo, doc, ord, max(start_name) AS section, max(CASE WHEN end_name = cur THEN 1 ELSE 0 END) AS closed,
            max(ref_list) AS refs
          FROM (SELECT *, max(start_name) OVER (PARTITION BY repo, doc, ord) AS cur FROM (
            SELECT repo, doc, line, pos, sum(CASE WHEN line LIKE '%<!-- docs:start:%' THEN 1 ELSE 0 END) OVER (PARTITION BY repo, doc ORDER BY pos) AS ord,
              nullif(regexp_extract(line, '<!-- docs:start:([^ >]+)', 1), '') AS start_name,
              nullif(regexp_extract(line, '<!-- docs:end:([^ >]+)', 1), '') AS end_name,
              nullif(regexp_extract(line, '<!-- docs:refs:([^>]*) -->', 1), '') AS ref_list
            FROM v_doc_lines)) WHERE ord > 0 GROUP BY repo, doc, ord) WHERE closed = 1""",
    "v_section_refs": """
        SELECT repo, doc, section, section_ord, trim(r) AS path FROM (
          SELECT repo, doc, section, section_ord, unnest(string_split(refs, ',')) AS r FROM v_sections) WHERE trim(r) <> ''""",
    "v_hashes": "SELECT repo, path, sha256(content) AS sha256 FROM v_files",
    "v_compared": """
        SELECT r.repo, r.path AS ref_path, CASE WHEN h.sha256 IS NULL THEN 'missing' WHEN b.sha256 IS NULL THEN 'new'
          WHEN h.sha256 <> b.sha256 THEN 'changed' ELSE 'unchanged' END AS state
        FROM (SELECT DISTINCT repo, path FROM v_refs) r LEFT JOIN v_hashes h ON r.repo = h.repo AND r.path = h.path
        LEFT JOIN v_baseline b ON r.repo = b.repo AND r.path = b.ref_path""",
    "v_states": """
        SELECT f.repo, f.path, f.n_lines, CASE WHEN m.sha256 = sha256(f.content) THEN 'cached' ELSE 'changed' END AS state
        FROM v_files f LEFT JOIN v_manifest m ON f.repo = m.repo AND f.path = m.path""",
    "v_section_status": """
        SELECT s.repo, s.doc, s.section, s.section_ord, count(r.path) AS n_refs,
          count(r.path) FILTER (WHERE b.sha256 IS NULL OR h.sha256 IS NULL OR h.sha256 <> b.sha256) AS n_changed,
          coalesce(string_agg(DISTINCT r.path, '|' ORDER BY r.path) FILTER (WHERE b.sha256 IS NULL OR h.sha256 IS NULL OR h.sha256 <> b.sha256), '') AS changed_refs,
          CASE WHEN count(r.path) = 0 THEN 'possibly-stale'
            WHEN count(r.path) FILTER (WHERE b.sha256 IS NULL OR h.sha256 IS NULL OR h.sha256 <> b.sha256) = 0 THEN 'current' ELSE 'stale' END AS status
        FROM v_sections s LEFT JOIN v_section_refs r USING (repo, doc, section, section_ord)
        LEFT JOIN v_hashes h ON r.repo = h.repo AND r.path = h.path LEFT JOIN v_baseline2 b ON r.repo = b.repo AND r.path = b.ref_path
        GROUP BY s.repo, s.doc, s.section, s.section_ord""",
    "v_overall": """
        SELECT repo, CASE WHEN count(*) = 0 THEN 'no_docs' WHEN count(*) FILTER (WHERE status = 'stale') > count(*) // 2 THEN 'very-stale'
            WHEN count(*) FILTER (WHERE status = 'stale') > 0 THEN 'stale' WHEN count(*) FILTER (WHERE status = 'possibly-stale') > 0 THEN 'slightly-stale'
            ELSE 'current' END AS overall,
          count(*) AS total, count(*) FILTER (WHERE status = 'current') AS current,
          count(*) FILTER (WHERE status = 'possibly-stale') AS possibly_stale, count(*) FILTER (WHERE status = 'stale') AS stale
        FROM v_section_status GROUP BY repo""",
    "v_dirs": """
        SELECT DISTINCT repo, '.' AS path FROM v_files UNION SELECT DISTINCT repo, array_to_string(string_split(path, '/')[1:i], '/') AS path
        FROM (SELECT repo, path, unnest(range(1, len(string_split(path, '/')))) AS i FROM v_files)""",
    "v_code_lines": """
        SELECT repo, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM v_code""",
    "v_endpoints": r"""
        SELECT repo, path, CAST(pos AS INTEGER) AS line, family AS framework,
          CASE WHEN upper(regexp_extract(line, '(?:\.|\[)([A-Za-z]+)\(', 1)) IN ('GET', 'POST', 'PUT', 'PATCH', 'DELETE', 'OPTIONS', 'HEAD')
            THEN upper(regexp_extract(line, '(?:\.|\[)([A-Za-z]+)\(', 1)) ELSE 'ANY' END AS method,
          regexp_extract(line, '(/api/[^''"]*)', 1) AS route, regexp_extract(line, '/api/([a-z]+)', 1) AS resource,
          CASE WHEN line LIKE '%requireAuth%' THEN true END AS auth
        FROM (SELECT *, CASE
            WHEN regexp_matches(path, '^(src|lib|app|routes)/.*\.(js|ts)$') AND NOT regexp_matches(path, 'test|spec|mock')
              AND regexp_matches(line, '\.(get|post|put|patch|delete|options|head|all)\s*\(\s*[''"]/') THEN 'js'
            WHEN regexp_matches(path, '^(src|lib|app)/.*\.py$') AND regexp_matches(line, '@(app|router|api)\.(route|get|post|put|patch|delete)') THEN 'python'
            WHEN regexp_matches(path, '^(cmd|pkg|internal)/.*\.go$') AND regexp_matches(line, '(HandleFunc|\.GET|\.POST|\.PUT|\.DELETE|\.PATCH)\(') THEN 'go'
            WHEN regexp_matches(path, '^src/.*\.rs$') AND regexp_matches(line, '#\[(get|post|put|delete|patch)\(') THEN 'rust' END AS family
          FROM v_code_lines) WHERE family IS NOT NULL""",
    "v_exports": r"""
        SELECT repo, path, CAST(pos AS INTEGER) AS line, language,
          CASE language WHEN 'js' THEN regexp_extract(line, 'export (?:default )?(?:async )?([a-z]+)', 1) WHEN 'rust' THEN regexp_extract(line, '^pub ([a-z]+)', 1)
            ELSE regexp_extract(line, '^([a-z]+) ', 1) END AS kind,
          regexp_extract(line, '(?:function|def|class|func|type|fn|struct|enum) ([A-Za-z_0-9]+)', 1) AS name
        FROM (SELECT *, CASE
            WHEN regexp_matches(path, '^(src|lib|app)/.*\.(js|ts)$') AND NOT regexp_matches(path, 'test|spec|mock')
              AND regexp_matches(line, '(module\.exports|export (default )?(async )?(function|class|const|let|var|interface|type|enum))\s') THEN 'js'
            WHEN regexp_matches(path, '^(src|lib|app)/.*\.py$') AND NOT regexp_matches(path, 'test|spec|mock') AND regexp_matches(line, '^(def|class) [A-Za-z]') THEN 'python'
            WHEN regexp_matches(path, '^(cmd|pkg|internal)/.*\.go$') AND regexp_matches(line, '^(func|type) [A-Z]') THEN 'go'
            WHEN regexp_matches(path, '^src/.*\.rs$') AND regexp_matches(line, '^pub (fn|struct|enum|trait|type|const)') THEN 'rust' END AS language
          FROM v_code_lines) WHERE language IS NOT NULL""",
    "v_imports": r"""
        SELECT DISTINCT repo, src, dst FROM (
          SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS repo, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1), ''), '/') AS src,
            unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages)""",
    "v_commits": """
        SELECT 'r' || (o_custkey % 40) AS repo, sha256(CAST(o_orderkey AS VARCHAR)) AS hash, o_orderdate AS ts, 'u' || o_custkey AS author,
          CASE o_orderkey % 8 WHEN 0 THEN 'add Docker pipeline' WHEN 1 THEN 'upgrade logging library' WHEN 2 THEN 'refactor storage layer'
            WHEN 3 THEN 'deprecate old endpoint' WHEN 4 THEN 'fix typo' WHEN 5 THEN 'feat: search' WHEN 6 THEN 'docs: notes' ELSE 'test: cases' END AS subject,
          o_orderstatus = 'P' AS is_merge, coalesce(n, 0) AS files, coalesce(q, 0) AS insertions, coalesce(d, 0) AS deletions
        FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q, CAST(sum(l_linenumber) AS BIGINT) AS d
          FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""",
    "v_commit_files": """
        SELECT 'r' || (o_custkey % 40) AS repo, sha256(CAST(o_orderkey AS VARCHAR)) AS hash, 'src/m' || (l_partkey % 50) || '/p' || l_partkey || '.py' AS path
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "v_decisions": """
        SELECT * FROM (SELECT *, CASE WHEN files >= 10 THEN 'large-refactor' WHEN insertions + deletions >= 200 THEN 'large-change'
            WHEN subject LIKE '%Docker%' THEN 'infrastructure-change' WHEN subject LIKE 'upgrade%library' THEN 'dependency-change'
            WHEN subject LIKE 'refactor%' THEN 'architecture-change' WHEN subject LIKE 'deprecate%' THEN 'breaking-change' END AS reason
          FROM v_commits) WHERE reason IS NOT NULL""",
    "v_sessions": """
        SELECT repo, hash, ts, subject, reason, CAST(sum(opens) OVER (PARTITION BY repo ORDER BY ts, hash ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (
          SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY repo ORDER BY ts, hash) IS NULL
            OR ts > lag(ts) OVER (PARTITION BY repo ORDER BY ts, hash) + INTERVAL 3 DAY THEN 1 ELSE 0 END AS opens FROM v_decisions)""",
    "v_groups": """
        SELECT s.repo, s.hash, s.ts, s.subject, s.reason, s.session, l.label AS decision_group FROM v_sessions s JOIN v_labels l USING (repo, session)""",
    "v_bench": "SELECT date_trunc('day', ts) AS run_ts, event_type AS stage, count(*) AS ms FROM events GROUP BY 1, 2",
    "v_unit_edges": """
        SELECT DISTINCT w.repo, w.src, coalesce(f.path, w.other) AS dst, f.path IS NOT NULL OR w.own AS is_internal FROM (
          SELECT repo, path AS src, unnest(CASE doc_id % 4
            WHEN 0 THEN [{'want': 'crates/core/src/m' || (doc_id + 4) || '.rs', 'other': 'crates/core/src/lib.rs', 'own': true}, {'want': 'crates/core/src/m' || (doc_id + 8) || '.rs', 'other': 'crates/core/src/lib.rs', 'own': true},
              {'want': '-', 'other': 'crates/core/src/lib.rs', 'own': true}, {'want': '-', 'other': 'self::sub', 'own': true}, {'want': '-', 'other': 'serde', 'own': false}]
            WHEN 1 THEN [{'want': 'py/pkg/m' || (doc_id + 4) || '.py', 'other': 'py/pkg/__init__.py', 'own': true}, {'want': '-', 'other': 'py/pkg/__init__.py', 'own': true}, {'want': '-', 'other': 'os', 'own': false},
              {'want': '-', 'other': 'sys', 'own': false}, {'want': 'py/pkg/m' || (doc_id + 8) || '.py', 'other': 'pkg.m' || (doc_id + 8), 'own': false}]
            WHEN 2 THEN [{'want': '-', 'other': 'fmt', 'own': false}, {'want': 'svc/d' || (doc_id + 4) || '/x.go', 'other': 'example.com/svc/d' || (doc_id + 4), 'own': false}]
            ELSE [{'want': 'web/src/s' || (doc_id + 4) || '/index.ts', 'other': '../s' || (doc_id + 4), 'own': true}, {'want': 'web/src/s' || (doc_id + 8) || '/index.ts', 'other': '@web/app/s' || (doc_id + 8), 'own': false}] END, recursive := true)
          FROM v_units
          UNION ALL SELECT DISTINCT repo, 'crates/core/src/lib.rs', '-', 'self::helper', true FROM v_units) w
        LEFT JOIN v_units f ON f.repo = w.repo AND f.path = w.want""",
    "v_pkg_deps": """
        SELECT DISTINCT 'n' || a.s_nationkey AS repo, 'packages/' || a.s_suppkey AS path, b.s_name AS dep
        FROM lineitem JOIN supplier a ON a.s_suppkey = l_suppkey JOIN supplier b ON b.s_suppkey = l_partkey % 100""",
    "v_ext_deps": """
        SELECT DISTINCT 'n' || s_nationkey AS repo, 'packages/' || s_suppkey AS path, p_name AS dep
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey""",
    "v_ws_files": """
        SELECT 'n' || s_nationkey AS repo, 'packages/' || s_suppkey || '/package.json' AS path,
          '{"name":"' || s_name || '","version":"' || (s_suppkey % 9) || '.' || s_nationkey || '.0","description":"Package ' || s_suppkey ||
          '","main":"src/index.js","dependencies":{"Supplier#' || lpad(CAST((s_suppkey + 1) % 100 AS VARCHAR), 9, '0') ||
          '":"^1.0.0","express":"^4.18.2"},"devDependencies":{"jest":"^29.0.0"}}' AS content FROM supplier
        UNION ALL SELECT 'n' || s_nationkey, 'packages/' || s_suppkey || '/src/index.js', 'module.exports = {};' FROM supplier
        UNION ALL SELECT 'n' || s_nationkey, 'packages/' || s_suppkey || '/tsconfig.json', '{}' FROM supplier WHERE s_suppkey % 2 = 0
        UNION ALL SELECT 'n' || n_nationkey, 'package.json',
          '{"name":"root-' || n_name || '","main":"src/index.js","dependencies":{"react":"^18.2.0","express":"^' || (4 + n_nationkey % 2) || '.0.0"}' ||
          CASE WHEN n_nationkey % 5 = 2 THEN ',"workspaces":["packages/*"]' WHEN n_nationkey % 5 = 3 THEN ',"workspaces":{"packages":["packages/*"]}' ELSE '' END ||
          ',"devDependencies":{"vitest":"^1.0.0"}}' FROM nation
        UNION ALL SELECT 'n' || n_nationkey, 'src/index.js', 'module.exports = {};' FROM nation
        UNION ALL SELECT 'n' || n_nationkey, 'requirements.txt', 'Django==4.' || n_regionkey || chr(10) || 'pytest>=7' || chr(10) FROM nation WHERE n_regionkey = 1
        UNION ALL SELECT 'n' || n_nationkey, 'go.mod', 'module example.com/' || n_name || chr(10) || 'require github.com/gin-gonic/gin v1.9.' || n_regionkey || chr(10) FROM nation WHERE n_regionkey = 2
        UNION ALL SELECT 'n' || n_nationkey, 'cmd/tool/main.go', 'package main' FROM nation WHERE n_regionkey = 2
        UNION ALL SELECT 'n' || n_nationkey, 'vite.config.ts', 'export default {};' FROM nation WHERE n_regionkey = 3
        UNION ALL SELECT 'n' || n_nationkey, 'pnpm-workspace.yaml', 'packages:' || chr(10) || '  - ' || chr(39) || 'packages/*' || chr(39) || chr(10) FROM nation WHERE n_nationkey % 5 = 0
        UNION ALL SELECT 'n' || n_nationkey, 'lerna.json', '{"packages":["packages/*"],"version":"0.0.0"}' FROM nation WHERE n_nationkey % 5 = 1""",
    "v_languages": """
        SELECT repo, CASE WHEN max(CASE WHEN path LIKE '%.ts' THEN 1 ELSE 0 END) = 1 THEN 'typescript' ELSE 'python' END AS language FROM v_files GROUP BY repo""",
}

# The smallest session of each connected component, by recursion over sessions that share a path.
LABELS_SQL = """
    v_links AS (SELECT DISTINCT a.repo, a.session AS u, b.session AS v FROM (SELECT s.repo, s.session, f.path FROM v_sessions s JOIN v_commit_files f ON f.hash = s.hash) a
      JOIN (SELECT s.repo, min(s.session) AS session, f.path FROM v_sessions s JOIN v_commit_files f ON f.hash = s.hash GROUP BY s.repo, f.path) b ON a.repo = b.repo AND a.path = b.path WHERE a.session <> b.session),
    v_both AS (SELECT repo, u, v FROM v_links UNION SELECT repo, v, u FROM v_links),
    v_reach AS (SELECT DISTINCT repo, session AS node, session AS label FROM v_sessions UNION SELECT b.repo, b.v, r.label FROM v_reach r JOIN v_both b ON b.repo = r.repo AND b.u = r.node AND r.label < b.v),
    v_labels AS (SELECT repo, node AS session, min(label) AS label FROM v_reach GROUP BY repo, node)"""


# Sessions that follow one another at a file and start within 30 days, weighted by how rare the files are and how alike the subjects.
RELATED_SQL = """
    v_touched AS (SELECT DISTINCT s.repo, s.session, f.path FROM v_sessions s JOIN v_commit_files f ON f.repo = s.repo AND f.hash = s.hash),
    v_steps AS (SELECT repo, session AS u, lag(session) OVER (PARTITION BY repo, path ORDER BY session) AS v, 1000 // nullif(count(*) OVER (PARTITION BY repo, path) - 1, 0) AS w FROM v_touched),
    v_words AS (SELECT DISTINCT repo, session, unnest(string_split(lower(subject), ' ')) AS word FROM v_sessions),
    v_signs AS (SELECT repo, session, k, min(('0x' || substr(md5(k || ':' || word), 1, 15))::BIGINT) AS sign FROM v_words, (SELECT unnest(range(16)) AS k) GROUP BY ALL),
    v_starts AS (SELECT repo, session, min(ts) AS since FROM v_sessions GROUP BY ALL),
    v_pairs AS (SELECT p.repo, p.u, p.v, sum(p.w) AS files FROM v_steps p JOIN v_starts a ON a.repo = p.repo AND a.session = p.u JOIN v_starts b ON b.repo = p.repo AND b.session = p.v
      WHERE a.since <= b.since + INTERVAL 30 DAY GROUP BY ALL),
    v_alike AS (SELECT p.repo, p.u, p.v, count(*) FILTER (WHERE a.sign = b.sign) AS n FROM v_pairs p JOIN v_signs a ON a.repo = p.repo AND a.session = p.u
      JOIN v_signs b ON b.repo = p.repo AND b.session = p.v AND b.k = a.k GROUP BY ALL),
    v_bound AS (SELECT p.repo, p.u, p.v FROM v_pairs p JOIN v_alike l USING (repo, u, v) WHERE p.files + l.n * 500 // 16 >= 1000),
    v_linked AS (SELECT repo, u, v FROM v_bound UNION SELECT repo, v, u FROM v_bound),
    v_near AS (SELECT DISTINCT repo, session AS node, session AS label FROM v_sessions UNION SELECT b.repo, b.v, r.label FROM v_near r JOIN v_linked b ON b.repo = r.repo AND b.u = r.node AND r.label < b.v),
    v_names AS (SELECT repo, node AS session, min(label) AS label FROM v_near GROUP BY repo, node),
    v_related AS (SELECT s.repo, s.hash, s.ts, s.subject, s.reason, s.session, n.label AS decision_group FROM v_sessions s JOIN v_names n USING (repo, session))"""
#: Definitions of several views, of which the last may be recursive, under the name that queries use.
RECURSIVE_SQL = {"v_labels": LABELS_SQL, "v_related": RELATED_SQL}


def _dialect(expr: str, duck: bool) -> str:
    expr = expr.replace("octet_length(SHAB(text))", "strlen(text)" if duck else "octet_length(text)")
    if duck:
        return re.sub(r"\bSHA\(", "sha256(", expr).replace("length(text)", "length(text)")
    out, start = expr, expr.find("SHA(")
    while start >= 0:
        depth, i = 1, start + 4
        while depth:
            depth += {"(": 1, ")": -1}.get(out[i], 0)
            i += 1
        out = out[:start] + "sha2(" + out[start + 4:i - 1] + ", 256)" + out[i:]
        start = out.find("SHA(")
    return out


def simple_sql(name: str) -> str:
    base, cols, where = SIMPLE[name]
    body = ", ".join(f"{_dialect(e, True)} AS {c}" for c, e in cols.items())
    return f"SELECT {body} FROM {base}" + (f" WHERE {where}" if where else "")


def with_views(sql: str) -> str:
    """Prefix a query with the definitions of the views it names, directly or through others."""
    order: list[tuple[str, str]] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_[a-z0-9_]+", text):
            if name in seen:
                continue
            seen.add(name)
            if name in RECURSIVE_SQL:
                visit("v_sessions v_commit_files")
                order.append(("", RECURSIVE_SQL[name]))
            elif name in SIMPLE:
                order.append((name, simple_sql(name)))
            elif name in COMPOSED_SQL:
                visit(COMPOSED_SQL[name])
                order.append((name, COMPOSED_SQL[name]))

    visit(sql)
    if not order:
        return sql
    parts = [body if not name else f"{name} AS ({body})" for name, body in order]
    recursive = "RECURSIVE " if any(not n for n, _ in order) else ""
    tail = sql.strip()
    joiner = ", " if tail[:5].upper() == "WITH " else " "
    return f"WITH {recursive}" + ",\n".join(parts) + joiner + (tail[5:] if joiner == ", " else tail)


class Tables:
    """The given tables and the stand-ins, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._tables[name]

    def stream(self, name: str) -> DataFrame:
        """A table as a stream, whether it is one file or a folder of files. The pattern names it alone; without one, a
        stream takes its path for a folder."""
        return self.spark.readStream.schema(self.base(name).schema).parquet(f"{self.dir}/{name}.parque[t]")

    def simple(self, name: str) -> DataFrame:
        table, cols, where = SIMPLE[name]
        df = self.base(table)
        if where:
            df = df.filter(_dialect(where, False))
        made = {c: F.expr(_dialect(e, False)) for c, e in cols.items()}
        if name in COMPUTED_TEXT:
            # A composed text stands for a stored column: the optimizer must not repeat its expression in every test.
            made["content"] = F.when(F.monotonically_increasing_id() >= 0, made["content"])
        return df.select(*[e.alias(c) for c, e in made.items()])

    def __getattr__(self, name: str) -> DataFrame:
        if "v_" + name in SIMPLE:
            made = self.simple("v_" + name)
        elif name in BASE:
            made = self.base(name)
        else:
            raise AttributeError(name)
        self.__dict__[name] = made
        return made

    @cached_property
    def docs(self) -> DataFrame:
        """Markdown per (repo, doc); a document cites at most a thousand files, so its lists are bounded."""
        parts = self.refs.groupBy("repo", "doc", "section").agg(
            F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("path")), ",").alias("paths"))
        title = F.when(F.col("section") == "s0", "Overview").when(F.col("section") == "s1", "Installation").otherwise("Usage")
        ending = F.when((F.col("section") == "s1") & (F.col("n") % 5 == 0), "").otherwise(
            F.concat(F.lit("\n<!-- docs:end:"), "section", F.lit(" -->")))
        body = F.concat(
            F.lit("<!-- docs:start:"), "section", F.lit(" -->\n## "), title, F.lit("\nThe service has "), F.col("n").cast("string"),
            F.lit(" API endpoints and runs on Express "), (F.col("n") % 2 + 4).cast("string"), F.lit(".\nGET /api/"), "section",
            F.lit(" lists everything.\n<!-- docs:refs:"), "paths", F.lit(" -->"), ending)
        return parts.groupBy("repo", "doc").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", body.alias("body")))), lambda x: x["body"]), "\n").alias("content"))

    @cached_property
    def prs_full(self) -> DataFrame:
        return self.prs.withColumn("labels", F.array("label_a", "label_b")).withColumn("files", F.array("file_a", "file_b"))

    @cached_property
    def commits(self) -> DataFrame:
        per_order = self.lineitem.groupBy("l_orderkey").agg(
            F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("q"), F.sum("l_linenumber").alias("d"))
        subjects = ["add Docker pipeline", "upgrade logging library", "refactor storage layer", "deprecate old endpoint", "fix typo",
                    "feat: search", "docs: notes", "test: cases"]
        subject = F.element_at(F.array(*[F.lit(s) for s in subjects]), (F.col("o_orderkey") % 8 + 1).cast("int"))
        return self.orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
            F.expr("'r' || (o_custkey % 40)").alias("repo"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("hash"),
            F.col("o_orderdate").alias("ts"), F.expr("'u' || o_custkey").alias("author"), subject.alias("subject"),
            (F.col("o_orderstatus") == "P").alias("is_merge"), F.coalesce("n", F.lit(0)).alias("files"),
            F.coalesce("q", F.lit(0)).alias("insertions"), F.coalesce("d", F.lit(0)).alias("deletions"))

    @cached_property
    def commit_files(self) -> DataFrame:
        owners = self.orders.select(
            "o_orderkey", F.expr("'r' || (o_custkey % 40)").alias("repo"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("hash"))
        return self.lineitem.select("l_orderkey", "l_partkey").join(owners, F.col("o_orderkey") == F.col("l_orderkey")).select(
            "repo", "hash", F.expr("'src/m' || (l_partkey % 50) || '/p' || l_partkey || '.py'").alias("path"))

    @cached_property
    def imports(self) -> DataFrame:
        return self.pages.select(
            F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("repo"),
            F.coalesce(F.nullif(F.regexp_extract("url", r"^https?://[^/?#]+(/[^?#]*)", 1), F.lit("")), F.lit("/")).alias("src"),
            F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("dst")).distinct()

    @cached_property
    def unit_files(self) -> DataFrame:
        units = self.units.select("repo", "path", "content")
        roots = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(c).alias("content")) for p, c in UNIT_ROOTS])
        repos = self.documents.selectExpr(f"{UNIT_REPO} AS repo").distinct()
        return units.unionByName(repos.select("repo", F.inline(roots)))

    @cached_property
    def unit_docs(self) -> DataFrame:
        """A document per unit repo that cites every third of its files."""
        cited = self.units.filter("doc_id % 3 = 0").groupBy("repo").agg(F.array_join(F.sort_array(F.collect_list("path")), ",").alias("paths"))
        text = F.concat(F.lit("<!-- docs:start:code -->\n<!-- docs:refs:"), "paths", F.lit(" -->\n<!-- docs:end:code -->"))
        return cited.select("repo", F.lit("docs/units.md").alias("doc"), text.alias("content"))

    @cached_property
    def unit_baseline(self) -> DataFrame:
        """Saved hashes of the cited files; every fifth file has changed since."""
        then = F.sha2(F.concat("content", F.expr("CASE WHEN doc_id % 5 = 0 THEN '#' ELSE '' END")), 256)
        return self.units.filter("doc_id % 3 = 0").select("repo", F.col("path").alias("ref_path"), then.alias("sha256"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("saved_at"))

    @cached_property
    def bench(self) -> DataFrame:
        return self.events.groupBy(F.date_trunc("day", "ts").alias("run_ts"), F.col("event_type").alias("stage")).agg(F.count("*").alias("ms"))

    @cached_property
    def pkg_deps(self) -> DataFrame:
        other = self.supplier.select(F.col("s_suppkey").alias("o_key"), F.col("s_name").alias("dep"))
        firsts = self.lineitem.select("l_suppkey", (F.col("l_partkey") % 100).alias("o_key")).distinct()
        return firsts.join(self.supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(other, "o_key").selectExpr(
            "'n' || s_nationkey AS repo", "'packages/' || s_suppkey AS path", "dep").distinct()

    @cached_property
    def ext_deps(self) -> DataFrame:
        used = self.lineitem.select("l_suppkey", "l_partkey").distinct()
        return used.join(self.supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(self.part, F.col("p_partkey") == F.col("l_partkey")).selectExpr(
            "'n' || s_nationkey AS repo", "'packages/' || s_suppkey AS path", "p_name AS dep").distinct()

    @cached_property
    def ws_files(self) -> DataFrame:
        """Workspace files built from suppliers (packages) and nations (repositories)."""
        def file(table: DataFrame, repo: str, path: str, content: str, where: str = "true") -> DataFrame:
            return table.filter(where).selectExpr(f"'n' || {repo} AS repo", f"{path} AS path", f"{content} AS content")

        sup, nat = self.supplier, self.nation
        package = (
            "'{\"name\":\"' || s_name || '\",\"version\":\"' || (s_suppkey % 9) || '.' || s_nationkey || '.0\",\"description\":\"Package ' || s_suppkey || "
            "'\",\"main\":\"src/index.js\",\"dependencies\":{\"Supplier#' || lpad(cast((s_suppkey + 1) % 100 as string), 9, '0') || "
            "'\":\"^1.0.0\",\"express\":\"^4.18.2\"},\"devDependencies\":{\"jest\":\"^29.0.0\"}}'")
        root = (
            "'{\"name\":\"root-' || n_name || '\",\"main\":\"src/index.js\",\"dependencies\":{\"react\":\"^18.2.0\",\"express\":\"^' || (4 + n_nationkey % 2) || '.0.0\"}' || "
            "CASE WHEN n_nationkey % 5 = 2 THEN ',\"workspaces\":[\"packages/*\"]' WHEN n_nationkey % 5 = 3 THEN ',\"workspaces\":{\"packages\":[\"packages/*\"]}' ELSE '' END || "
            "',\"devDependencies\":{\"vitest\":\"^1.0.0\"}}'")
        frames = [
            file(sup, "s_nationkey", "'packages/' || s_suppkey || '/package.json'", package),
            file(sup, "s_nationkey", "'packages/' || s_suppkey || '/src/index.js'", "'module.exports = {};'"),
            file(sup, "s_nationkey", "'packages/' || s_suppkey || '/tsconfig.json'", "'{}'", "s_suppkey % 2 = 0"),
            file(nat, "n_nationkey", "'package.json'", root),
            file(nat, "n_nationkey", "'src/index.js'", "'module.exports = {};'"),
            file(nat, "n_nationkey", "'requirements.txt'", "'Django==4.' || n_regionkey || chr(10) || 'pytest>=7' || chr(10)", "n_regionkey = 1"),
            file(nat, "n_nationkey", "'go.mod'", "'module example.com/' || n_name || chr(10) || 'require github.com/gin-gonic/gin v1.9.' || n_regionkey || chr(10)", "n_regionkey = 2"),
            file(nat, "n_nationkey", "'cmd/tool/main.go'", "'package main'", "n_regionkey = 2"),
            file(nat, "n_nationkey", "'vite.config.ts'", "'export default {};'", "n_regionkey = 3"),
            file(nat, "n_nationkey", "'pnpm-workspace.yaml'", "'packages:' || chr(10) || '  - ' || chr(39) || 'packages/*' || chr(39) || chr(10)", "n_nationkey % 5 = 0"),
            file(nat, "n_nationkey", "'lerna.json'", "'{\"packages\":[\"packages/*\"],\"version\":\"0.0.0\"}'", "n_nationkey % 5 = 1"),
        ]
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out
