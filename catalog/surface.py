"""Endpoints, exports, imports, coverage, claims and verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from corpusloom.functions import claims as CL
from corpusloom.functions import code as C
from corpusloom.functions import text as T
from corpusloom.operators import graph as G
from corpusloom.operators import sections as SE
from corpusloom.operators import surface as SU
from corpusloom.operators import verification as V
from corpusloom.plans import verbs

FAMILIES = "(VALUES ('js'), ('python'), ('go'), ('rust')) AS f(family)"


@query("a5_endpoint_counts", f"""
    SELECT r.repo, f.family, count(e.path) AS endpoints FROM (SELECT DISTINCT repo FROM v_code) r CROSS JOIN {FAMILIES}
    LEFT JOIN v_endpoints e ON e.repo = r.repo AND e.framework = f.family GROUP BY r.repo, f.family""")
def _(t):
    return SU.endpoint_counts(t.code)


@query("a5_endpoint_counts_verify", """
    SELECT r.repo, count(e.path) AS endpoints FROM (SELECT DISTINCT repo FROM v_code) r
    LEFT JOIN v_endpoints e ON e.repo = r.repo AND e.framework <> 'rust' GROUP BY r.repo""")
def _(t):
    return SU.family_total(SU.endpoint_counts(t.code, "verify"), "endpoints")


@query("a5_endpoint_counts_reference", r"""
    SELECT repo, count(*) FILTER (WHERE regexp_matches(path, '^(src|lib|app|routes)/') AND NOT regexp_matches(path, 'test|spec|mock|\.min\.')
        AND regexp_matches(line, '\.(get|post|put|patch|delete|options|head|all)\s*\(')) AS js,
      count(*) FILTER (WHERE regexp_matches(path, '^(src|lib|app)/') AND regexp_matches(line, '@(app|router|api)\.(route|get|post|put|patch|delete)')) AS python,
      count(*) FILTER (WHERE regexp_matches(path, '^(cmd|pkg|internal)/') AND regexp_matches(line, '(HandleFunc|\.GET|\.POST|\.PUT|\.DELETE|\.PATCH)\(')) AS go,
      count(*) FILTER (WHERE regexp_matches(path, '^src/') AND regexp_matches(line, '#\[(get|post|put|delete|patch)\(')) AS rust
    FROM v_code_lines GROUP BY repo""")
def _(t):
    counts = SU.endpoint_counts(t.code, "reference")
    return counts.groupBy("repo").agg(*[F.sum(F.when(F.col("family") == f, F.col("endpoints"))).alias(f) for f in ("js", "python", "go", "rust")])


@query("a7_export_counts", f"""
    SELECT r.repo, f.family, count(e.path) AS exports FROM (SELECT DISTINCT repo FROM v_code) r CROSS JOIN {FAMILIES}
    LEFT JOIN v_exports e ON e.repo = r.repo AND e.language = f.family GROUP BY r.repo, f.family""")
def _(t):
    return SU.export_counts(t.code)


@query("f13_endpoint_family", "SELECT repo, path, line, framework FROM v_endpoints")
def _(t):
    return SU.endpoints(t.code).select("repo", "path", "line", "framework")


@query("f14_route_method_path", "SELECT repo, path, line, method, route FROM v_endpoints")
def _(t):
    return SU.endpoints(t.code).select("repo", "path", "line", "method", "route")


@query("f15_exports", "SELECT repo, path, line, language, kind, name FROM v_exports")
def _(t):
    return SU.exports(t.code)


@query("f22_resource_of", "SELECT repo, path, line, resource FROM v_endpoints")
def _(t):
    return SU.endpoints(t.code).select("repo", "path", "line", "resource")


@query("f32_auth_hint", "SELECT repo, path, line, auth FROM v_endpoints")
def _(t):
    return SU.endpoints(t.code).select("repo", "path", "line", "auth")


@query("a6_route_methods", """
    SELECT repo, method, count(*) AS endpoints FROM v_endpoints GROUP BY repo, method UNION ALL SELECT repo, 'TOTAL', count(*) FROM v_endpoints GROUP BY repo""")
def _(t):
    return SU.route_methods(SU.endpoints(t.code))


@query("a25_resource_groups", """
    SELECT repo, resource, count(*) AS endpoints, string_agg(DISTINCT method, ',' ORDER BY method) AS methods, min(route) AS base_path,
      count(*) FILTER (WHERE auth) AS with_auth FROM v_endpoints GROUP BY repo, resource""")
def _(t):
    return SU.resource_groups(SU.endpoints(t.code))


@query("c6_api_surface", """
    SELECT g.repo, g.resource, g.endpoints, m.endpoints AS repo_total FROM (SELECT repo, resource, count(*) AS endpoints FROM v_endpoints GROUP BY repo, resource) g
    JOIN (SELECT repo, count(*) AS endpoints FROM v_endpoints GROUP BY repo) m ON m.repo = g.repo""")
def _(t):
    _, groups, methods = verbs.api_surface(t.code)
    totals = methods.filter("method = 'TOTAL'").select("repo", F.col("endpoints").alias("repo_total"))
    return groups.join(totals, "repo").select("repo", "resource", "endpoints", "repo_total")


DOCUMENTED = """(SELECT DISTINCT c.repo, c.path FROM v_code_refs r JOIN v_code c ON c.repo = r.repo AND c.path = r.path)"""
INVENTORY_SQL = f"""
    SELECT c.repo, count(*) FILTER (WHERE NOT regexp_matches(c.path, 'test')) AS files, any_value(e.n) AS endpoints, any_value(x.n) AS exports,
      any_value(d.n) AS doc_files, any_value(k.n) AS documented_files, any_value(d.m) AS documented_endpoints, any_value(e.n) + any_value(x.n) AS entities
    FROM v_code c JOIN (SELECT r.repo, count(e.path) AS n FROM (SELECT DISTINCT repo FROM v_code) r LEFT JOIN v_endpoints e ON e.repo = r.repo GROUP BY r.repo) e ON e.repo = c.repo
    JOIN (SELECT r.repo, count(e.path) AS n FROM (SELECT DISTINCT repo FROM v_code) r LEFT JOIN v_exports e ON e.repo = r.repo GROUP BY r.repo) x ON x.repo = c.repo
    JOIN (SELECT repo, count(DISTINCT doc) AS n, count(*) FILTER (WHERE regexp_matches(line, '(GET|POST|PUT|PATCH|DELETE)\\s+/')) AS m FROM v_doc_lines GROUP BY repo) d ON d.repo = c.repo
    JOIN (SELECT repo, count(*) AS n FROM {DOCUMENTED} GROUP BY repo) k ON k.repo = c.repo GROUP BY c.repo""".replace("\\\\", "\\")


def inventory(t):
    return SU.entity_inventory(t.code, t.docs, t.code_refs)


@query("a26_entity_inventory", INVENTORY_SQL)
def _(t):
    return inventory(t)


def pct(a: str, b: str) -> str:
    return f"({a}) * 1000 // {b} // 10 || '.' || ({a}) * 1000 // {b} % 10"


@query("a8_coverage_report", f"""
    SELECT repo, {pct('documented_files', 'files')} AS file_coverage, {pct('documented_endpoints', 'endpoints')} AS endpoint_coverage,
      {pct('documented_endpoints + documented_files', 'entities')} AS entity_coverage FROM ({INVENTORY_SQL})""")
def _(t):
    return SU.coverage_report(inventory(t)).select("repo", "file_coverage", "endpoint_coverage", "entity_coverage")


@query("a29_doc_endpoint_mentions", "SELECT repo, doc, count(*) FILTER (WHERE regexp_matches(line, '(GET|POST|PUT|PATCH|DELETE)\\s+/')) AS mentions FROM v_doc_lines GROUP BY repo, doc".replace("\\\\", "\\"))
def _(t):
    return SU.doc_endpoint_mentions(t.docs)


@query("f16_doc_endpoint_mention", "SELECT repo, doc, count(*) FILTER (WHERE regexp_matches(line, '(GET|POST|PUT|PATCH|DELETE)\\s+/')) AS mentions FROM v_doc_lines GROUP BY repo, doc".replace("\\\\", "\\"))
def _(t):
    return t.docs.select("repo", "doc", CL.doc_endpoint_mentions(F.col("content")).cast("bigint").alias("mentions"))


GAP_LINE = r"(module\.exports|export |^pub |^func [A-Z]|^type [A-Z]|^def |^class )"


@query("j7_doc_gaps", rf"""
    SELECT repo, path, count(*) AS exports FROM v_code_lines WHERE regexp_matches(path, '^(src|lib|app|cmd|pkg|internal|routes)/.*\.(js|ts|tsx|py|go|rs)$')
      AND NOT regexp_matches(path, 'test|spec|mock') AND regexp_matches(line, '{GAP_LINE}')
      AND (repo, path) NOT IN (SELECT (repo, path) FROM v_code_refs) GROUP BY repo, path""")
def _(t):
    return SU.doc_gaps(t.code, t.code_refs)


@query("u7_documented_split", f"""
    SELECT repo, 'documented' AS side, count(*) AS n FROM {DOCUMENTED} WHERE path NOT LIKE '%test%' GROUP BY repo
    UNION ALL SELECT repo, 'undocumented', count(*) FROM v_code WHERE path NOT LIKE '%test%' AND doc_id % 3 <> 0 GROUP BY repo""")
def _(t):
    named, unnamed = SU.documented_split(t.code, t.code_refs)
    both = named.withColumn("side", F.lit("documented")).unionByName(unnamed.withColumn("side", F.lit("undocumented")))
    return both.groupBy("repo", "side").agg(F.count("*").alias("n"))


# Imports of the code view: the next file of the same repo exists only when it is an English one.
IMPORT_EDGES_SQL = r"""
    SELECT DISTINCT e.repo, e.src, coalesce(f.path, e.target) AS dst, e.is_internal FROM (
      SELECT repo, path AS src, line, CASE
          WHEN regexp_matches(path, '\.(js|ts)$') AND line LIKE 'const lib = require(%' THEN 'express'
          WHEN regexp_matches(path, '\.(js|ts)$') AND line LIKE 'import { h } from %' THEN regexp_extract(line, '(\./d[0-9]+)', 1)
          WHEN regexp_matches(path, '\.(js|ts)$') AND line LIKE 'import "%' THEN regexp_extract(line, '"([^"]+)"', 1)
          WHEN path LIKE '%.py' AND line LIKE 'from pkg.mod%' THEN regexp_extract(line, '(pkg\.mod[0-9])', 1)
          WHEN path LIKE '%.go' AND line LIKE 'import "%' THEN regexp_extract(line, '"([^"]+)"', 1)
          WHEN path LIKE '%.rs' AND line LIKE 'use crate::%' THEN regexp_extract(line, 'use ([a-z0-9:]+)', 1) END AS target,
        line LIKE 'import { h } from %' OR line LIKE 'use crate%' AS is_internal FROM v_code_lines) e
    LEFT JOIN (SELECT repo, path FROM v_code WHERE regexp_matches(path, '\.(js|ts)$')) f
      ON f.repo = e.repo AND e.target LIKE './%' AND regexp_extract(e.src, '^(.*)/', 1) || substr(e.target, 2) = regexp_replace(f.path, '\.(js|ts)$', '')
    WHERE e.target IS NOT NULL"""


@query("f24_import_targets", IMPORT_EDGES_SQL)
def _(t):
    return G.imports(t.code)


@query("f24_resolved_imports", "SELECT repo, src, dst, is_internal FROM v_unit_edges")
def _(t):
    return G.imports(t.unit_files)


@query("j9_import_graph", """
    SELECT repo, node, CAST(sum(o) AS BIGINT) AS imports, CAST(sum(i) AS BIGINT) AS imported_by FROM (
      SELECT repo, src AS node, 1 AS o, 0 AS i FROM v_unit_edges UNION ALL SELECT repo, dst, 0, 1 FROM v_unit_edges) GROUP BY repo, node""")
def _(t):
    """The graph over files of four languages, fed by their imports."""
    return G.module_graph(G.imports(t.unit_files))


@query("c3_update_context", """
    WITH c AS (SELECT repo, path FROM v_units WHERE doc_id % 15 = 0)
    SELECT c.repo, 'code' AS section, c.path AS ref, 'imports' AS direction, e.dst AS other FROM c JOIN v_unit_edges e ON e.repo = c.repo AND e.src = c.path
    UNION ALL SELECT c.repo, 'code', c.path, 'imported_by', e.src FROM c JOIN v_unit_edges e ON e.repo = c.repo AND e.dst = c.path""")
def _(t):
    """What stands around the changed files behind each section to regenerate."""
    _, context = verbs.update_context(t.unit_docs, t.unit_files, t.unit_baseline)
    return context.select("repo", "section", "ref", "direction", "other")


@query("j9_module_graph", """
    SELECT repo, node, CAST(sum(o) AS BIGINT) AS imports, CAST(sum(i) AS BIGINT) AS imported_by FROM (
      SELECT repo, src AS node, 1 AS o, 0 AS i FROM v_imports UNION ALL SELECT repo, dst, 0, 1 FROM v_imports) GROUP BY repo, node""")
def _(t):
    return G.module_graph(t.imports)


@query("j19_neighbors", """
    SELECT repo, 'imports' AS direction, src AS member, dst AS other FROM v_imports WHERE src = '/en' OR src LIKE '/en/%'
    UNION ALL SELECT repo, 'imported_by', dst, src FROM v_imports WHERE dst = '/en' OR dst LIKE '/en/%'""")
def _(t):
    return G.neighbors(t.imports, "/en")


@query("j22_related_files", """
    WITH k AS (SELECT repo, path, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '/([^./]*)[^/]*$', 1) AS stem FROM v_files),
    g AS (SELECT k.* FROM k JOIN (SELECT repo, max(path) AS path FROM v_files GROUP BY repo) m USING (repo, path))
    SELECT g.repo, g.path AS target, k.path, 'same_directory' AS relation FROM g JOIN k ON k.repo = g.repo AND k.dir = g.dir AND k.path <> g.path
    UNION ALL SELECT g.repo, g.path, k.path, 'test' FROM g JOIN k ON k.repo = g.repo AND k.stem = g.stem AND k.path <> g.path AND k.path LIKE '%.test.%'""")
def _(t):
    targets = t.files.groupBy("repo").agg(F.max("path").alias("path"))
    return G.related_files(targets, t.files)


@query("t8_key_files", """
    SELECT repo, path, rank FROM (SELECT f.repo, f.path, CAST(row_number() OVER (PARTITION BY f.repo ORDER BY (e.path IS NOT NULL) DESC, coalesce(r.n, 0) DESC, n_lines DESC, f.path) AS INTEGER) AS rank
      FROM v_files f LEFT JOIN (SELECT repo, min(path) AS path FROM v_files GROUP BY repo) e ON e.repo = f.repo AND e.path = f.path
      LEFT JOIN (SELECT repo, path, count(*) AS n FROM v_refs GROUP BY repo, path) r ON r.repo = f.repo AND r.path = f.path) WHERE rank <= 5""")
def _(t):
    entries = t.files.groupBy("repo").agg(F.min("path").alias("path"))
    return G.key_files(t.files, entries, t.refs.select("repo", F.col("path").alias("dst")), 5).select("repo", "path", "rank")


@query("s15_export_mermaid", """
    WITH e AS (SELECT DISTINCT repo, src, dst FROM v_imports WHERE src <> dst),
    d AS (SELECT repo, node, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, node) AS rank FROM (SELECT repo, src AS node FROM e UNION ALL SELECT repo, dst FROM e) GROUP BY repo, node)
    SELECT e.repo, 'graph TD' || chr(10) || string_agg('    n' || a.rank || '["' || e.src || '"] --> n' || b.rank || '["' || e.dst || '"]', chr(10) ORDER BY a.rank, b.rank) AS diagram
    FROM e JOIN d a ON a.repo = e.repo AND a.node = e.src AND a.rank <= 20 JOIN d b ON b.repo = e.repo AND b.node = e.dst AND b.rank <= 20 GROUP BY e.repo""")
def _(t):
    return G.export_mermaid(t.imports)


# Claims.
MENTIONS_SQL = r"""SELECT DISTINCT repo, doc, unnest(regexp_extract_all(line, '(src|lib|app|cmd|pkg|internal|tests?|scripts?)/[a-zA-Z0-9_./-]+\.[a-zA-Z]{1,5}')) AS path FROM v_doc_lines"""
COUNTS_SQL = r"""SELECT repo, doc, CAST(unnest(regexp_extract_all(line, '(?i)([0-9]+) (api )?(endpoints?|routes?|apis?)', 1)) AS BIGINT) AS claimed FROM v_doc_lines"""
VERSIONS_SQL = r"""SELECT repo, doc, lower(regexp_extract(line, '(?i)(express|react)\s+v?([0-9]+)', 1)) AS name, CAST(regexp_extract(line, '(?i)(express|react)\s+v?([0-9]+)', 2) AS BIGINT) AS major
    FROM v_doc_lines WHERE regexp_matches(line, '(?i)(express|react)\s+v?[0-9]+')"""
FILE_CHECK = f"""SELECT m.repo, m.doc, 'file_exists' AS type, m.path AS claim, 'exists' AS expected, CASE WHEN f.path IS NULL THEN 'missing' ELSE 'exists' END AS actual, f.path IS NOT NULL AS passed
    FROM ({MENTIONS_SQL}) m LEFT JOIN v_files f ON f.repo = m.repo AND f.path = m.path"""
ANCHOR_CHECK = """SELECT r.repo, r.doc, 'ref_anchor' AS type, r.path AS claim, 'exists' AS expected, CASE WHEN f.path IS NULL THEN 'missing' ELSE 'exists' END AS actual, f.path IS NOT NULL AS passed
    FROM v_refs r LEFT JOIN v_files f ON f.repo = r.repo AND f.path = r.path"""
COUNT_CHECK = f"""SELECT c.repo, c.doc, 'endpoint_count' AS type, claimed || ' endpoints' AS claim, CAST(claimed AS VARCHAR) AS expected, CAST(n AS VARCHAR) AS actual, n = 0 OR abs(claimed - n) <= 2 AS passed
    FROM ({COUNTS_SQL}) c JOIN (SELECT r.repo, count(e.path) AS n FROM (SELECT DISTINCT repo FROM v_code) r LEFT JOIN v_endpoints e ON e.repo = r.repo AND e.framework <> 'rust' GROUP BY r.repo) e ON e.repo = c.repo"""
# Each repo with an even number declares Express 4, the others declare nothing.
VERSION_CHECK = f"""SELECT repo, doc, 'dep_version' AS type, name || ' ' || major AS claim, CAST(major AS VARCHAR) AS expected,
      CASE WHEN CAST(substr(repo, 4) AS INTEGER) % 2 = 0 THEN '4' ELSE 'none' END AS actual, CAST(substr(repo, 4) AS INTEGER) % 2 = 1 OR major = 4 AS passed
    FROM ({VERSIONS_SQL})"""
COVERAGE_SQL = r"""
    SELECT d.repo, d.doc, s.section, count(*) FILTER (WHERE regexp_matches(d.line, '(?i)## .*(' || s.names || ')') OR regexp_matches(d.line, '(?i)<!-- docs:start:(' || s.names || ')')) > 0 AS found
    FROM v_doc_lines d CROSS JOIN (VALUES ('description', 'description|overview|about|introduction|header'), ('installation', 'installation|install|setup|quickstart|quick-start|getting-started'),
      ('usage', 'usage|api|endpoints|commands|examples'), ('features', 'features|highlights|capabilities')) AS s(section, names) GROUP BY d.repo, d.doc, s.section"""
CHECKS_SQL = f"{FILE_CHECK} UNION ALL {ANCHOR_CHECK} UNION ALL {COUNT_CHECK} UNION ALL {VERSION_CHECK}"


def express_versions(t):
    repos = t.files.select("repo").distinct()
    declared = F.expr("cast(substr(repo, 4) as int) % 2 = 0")
    return repos, repos.filter(declared).select("repo", F.lit("express").alias("name"), F.lit("^4.18.2").alias("version"))


def all_checks(t):
    counts = SU.family_total(SU.endpoint_counts(t.code, "verify"), "endpoints")
    repos, versions = express_versions(t)
    return V.union_checks(
        V.check_file_refs(t.docs, t.files), V.check_ref_anchors(t.docs, t.files), V.check_endpoint_counts(t.docs, counts),
        V.check_versions(t.docs, versions, repos))


@query("f20_mentioned_paths", f"SELECT repo, doc, path FROM ({MENTIONS_SQL})")
def _(t):
    return t.docs.select("repo", "doc", F.explode(CL.mentioned_paths(F.col("content"))).alias("path"))


@query("f17_count_claims", COUNTS_SQL)
def _(t):
    return t.docs.select("repo", "doc", F.explode(CL.count_claims(F.col("content"))).alias("claimed"))


@query("f18_version_claims", VERSIONS_SQL)
def _(t):
    return t.docs.select("repo", "doc", F.explode(CL.version_claims(F.col("content"))).alias("c")).select("repo", "doc", "c.name", "c.major")


@query("f19_first_int", "SELECT repo, path, CAST(nullif(regexp_extract('^' || n_lines || '.18.' || n_bytes, '[0-9]+'), '') AS BIGINT) AS major FROM v_files")
def _(t):
    return t.files.select("repo", "path", CL.first_int(F.expr("'^' || n_lines || '.18.' || n_bytes")).alias("major"))


@query("j6_check_file_refs", FILE_CHECK)
def _(t):
    return V.check_file_refs(t.docs, t.files)


@query("j6_check_ref_anchors", ANCHOR_CHECK)
def _(t):
    return V.check_ref_anchors(t.docs, t.files)


@query("j12_check_endpoint_counts", COUNT_CHECK)
def _(t):
    return V.check_endpoint_counts(t.docs, SU.family_total(SU.endpoint_counts(t.code, "verify"), "endpoints"))


@query("j11_check_versions", VERSION_CHECK)
def _(t):
    repos, versions = express_versions(t)
    return V.check_versions(t.docs, versions, repos)


@query("u4_union_checks", f"SELECT type, passed, count(*) AS n FROM ({CHECKS_SQL}) GROUP BY type, passed")
def _(t):
    return all_checks(t).groupBy("type", "passed").agg(F.count("*").alias("n"))


@query("j13_section_coverage", COVERAGE_SQL)
def _(t):
    return V.section_coverage(t.docs, V.repo_features(t.files))


@query("a15_anchor_count", "SELECT repo, doc, count(*) FILTER (WHERE line LIKE '%<!-- docs:refs:%') AS refs FROM v_doc_lines GROUP BY repo, doc")
def _(t):
    return V.anchor_count(t.docs)


QUALITY_SQL = f"""
    SELECT repo, doc, checks, passed, checks - passed AS failed, CAST(a / 100.0 AS DECIMAL(5,2)) AS accuracy, CAST(c / 100.0 AS DECIMAL(5,2)) AS coverage,
      CAST((a * 50 + c * 35 + 1500) // 100 AS BIGINT) AS overall, refs FROM (
      SELECT k.repo, k.doc, checks, passed, passed * 100 // checks AS a, present * 100 // expected AS c, refs
      FROM (SELECT repo, doc, count(*) AS checks, count(*) FILTER (WHERE passed) AS passed FROM ({CHECKS_SQL}) GROUP BY repo, doc) k
      JOIN (SELECT repo, doc, count(*) AS expected, count(*) FILTER (WHERE found) AS present FROM ({COVERAGE_SQL}) GROUP BY repo, doc) v USING (repo, doc)
      JOIN (SELECT repo, doc, count(*) FILTER (WHERE line LIKE '%<!-- docs:refs:%') AS refs FROM v_doc_lines GROUP BY repo, doc) a USING (repo, doc))"""


@query("a14_quality_score", QUALITY_SQL)
def _(t):
    quality = V.quality_score(all_checks(t), V.section_coverage(t.docs, V.repo_features(t.files)), V.anchor_count(t.docs))
    return quality.drop("freshness")


@query("c4_verify_docs", f"""
    SELECT repo, doc, checks, passed, passed < checks AND passed * 100 // checks < 80 AS needs_fix FROM (
      SELECT repo, doc, count(*) AS checks, count(*) FILTER (WHERE passed) AS passed FROM (
        SELECT repo, doc, passed FROM ({FILE_CHECK}) UNION ALL SELECT repo, doc, passed FROM ({ANCHOR_CHECK}) UNION ALL SELECT repo, doc, passed FROM ({COUNT_CHECK})
        UNION ALL SELECT repo, doc, major = 5 FROM ({VERSIONS_SQL})) GROUP BY repo, doc)""")
def _(t):
    deps = t.files.select("repo").distinct().selectExpr("repo", "'package.json' AS path", "'npm' AS kind", "'express' AS dep", "'^5.0.0' AS version", "false AS is_dev")
    code = t.code.select("repo", "path", "content")
    prose = t.files.select("repo", "path", F.lit("").alias("content"))
    _, quality = verbs.verify_docs(t.docs, merged(prose, code), deps)
    return quality.select("repo", "doc", "checks", "passed", "needs_fix")


def merged(prose, code):
    """One file per path: the code where a path occurs in both stand-ins."""
    both = prose.withColumn("k", F.lit(1)).unionByName(code.withColumn("k", F.lit(0)))
    return both.groupBy("repo", "path").agg(F.min_by("content", "k").alias("content"))
