"""Hashes, snapshots, sections, staleness, chunks and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from corpusloom.functions import budget as B
from corpusloom.functions import text as T
from corpusloom.operators import chunks as CH
from corpusloom.operators import filters as P
from corpusloom.operators import sections as SE
from corpusloom.operators import snapshots as SN
from corpusloom.plans import verbs
from corpusloom.runtime import scratch_path
from corpusloom.sources import tables as ST

TS = "timestamp '2024-01-01 00:00:00'"
LANES_SQL = ", ".join(
    f"bit_xor(CAST('0x' || substr(sha256(path || chr(10) || sha256), {1 + 15 * i}, 15) AS BIGINT)) AS lane{i}" for i in range(4))
DIGEST_SQL = f"""SELECT repo, dir AS path, n AS n_files, sha256(n || '|' || lane0 || '|' || lane1 || '|' || lane2 || '|' || lane3) AS sha256 FROM (
    SELECT h.repo, d.path AS dir, count(*) AS n, {LANES_SQL.replace("(path ||", "(h.path ||")}
    FROM v_hashes h JOIN v_dirs d ON h.repo = d.repo AND (d.path = '.' OR starts_with(h.path, d.path || '/')) GROUP BY h.repo, d.path)"""


def utc(name: str):
    return F.lit(name).cast("timestamp")


@query("s3_write_manifest", f"SELECT repo, path, sha256, {TS} AS snapshot_ts FROM v_hashes")
def _(t):
    path = scratch_path(t.spark, "manifest")
    ST.write_manifest(t.files, path, utc("2023-01-01 00:00:00"))
    ST.write_manifest(t.files, path, utc("2024-01-01 00:00:00"))
    return ST.read_manifest(t.spark, path)


@query("s4_save_baseline", f"""
    SELECT DISTINCT r.repo, r.path AS ref_path, h.sha256, {TS} AS saved_at FROM v_section_refs r JOIN v_hashes h ON r.repo = h.repo AND r.path = h.path""")
def _(t):
    path = scratch_path(t.spark, "baseline")
    ST.save_baseline(SE.section_refs(SE.parse_sections(t.docs)), t.files, path, utc("2024-01-01 00:00:00"))
    return ST.read_baseline(t.spark, path)


@query("s5_read_baseline", """
    SELECT repo, ref_path, coalesce(b2, b1) AS sha256, CASE WHEN b2 IS NULL THEN timestamp '2023-01-01 00:00:00' ELSE timestamp '2024-01-01 00:00:00' END AS saved_at
    FROM (SELECT repo, ref_path, max(CASE WHEN k = 1 THEN sha256 END) AS b1, max(CASE WHEN k = 2 THEN sha256 END) AS b2
      FROM (SELECT 1 AS k, repo, ref_path, sha256 FROM v_baseline UNION ALL SELECT 2, repo, ref_path, sha256 FROM v_baseline2) GROUP BY repo, ref_path)""")
def _(t):
    path = scratch_path(t.spark, "baseline")
    t.baseline.select("repo", "ref_path", "sha256", utc("2023-01-01 00:00:00").alias("saved_at")).write.mode("append").parquet(path)
    t.baseline2.select("repo", "ref_path", "sha256", utc("2024-01-01 00:00:00").alias("saved_at")).write.mode("append").parquet(path)
    return ST.read_baseline(t.spark, path)


@query("s5_read_baseline_as_of", "SELECT repo, ref_path, sha256 FROM v_baseline")
def _(t):
    path = scratch_path(t.spark, "baseline")
    t.baseline.select("repo", "ref_path", "sha256", utc("2023-01-01 00:00:00").alias("saved_at")).write.mode("append").parquet(path)
    t.baseline2.select("repo", "ref_path", "sha256", utc("2024-01-01 00:00:00").alias("saved_at")).write.mode("append").parquet(path)
    return ST.read_baseline(t.spark, path, utc("2023-06-01 00:00:00")).select("repo", "ref_path", "sha256")


LEVELS_SQL = """
    SELECT repo, path, sha256, CASE k WHEN 1 THEN timestamp '2023-01-01 00:00:00' WHEN 2 THEN timestamp '2023-06-01 00:00:00' ELSE timestamp '2024-01-01 00:00:00' END AS snapshot_ts FROM (
      SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY k DESC) AS rn FROM (SELECT 1 AS k, repo, path, sha256(content) AS sha256 FROM v_files WHERE doc_id % 3 <> 0
        UNION ALL SELECT 2, repo, path, sha256(content || '#') FROM v_files WHERE doc_id % 4 = 0 UNION ALL SELECT 3, repo, path, sha256(content || '##') FROM v_files WHERE doc_id % 5 = 0)
      WHERE k <= {0}) WHERE rn = 1"""


def leveled(t):
    """Three snapshots, of which the first two are compacted."""
    path = scratch_path(t.spark, "levels")
    some = lambda where, mark: t.files.filter(where).select("repo", "path", F.concat("content", F.lit(mark)).alias("content"))
    ST.write_manifest(some("doc_id % 3 <> 0", ""), path, utc("2023-01-01 00:00:00"))
    ST.write_manifest(some("doc_id % 4 = 0", "#"), path, utc("2023-06-01 00:00:00"))
    ST.compact_manifest(t.spark, path)
    ST.write_manifest(some("doc_id % 5 = 0", "##"), path, utc("2024-01-01 00:00:00"))
    return path


@query("s3_manifest_levels", LEVELS_SQL.format(3))
def _(t):
    return ST.read_manifest(t.spark, leveled(t))


@query("s3_manifest_levels_as_of", LEVELS_SQL.format(1))
def _(t):
    """As of a time before the compacted state: the older delta alone."""
    return ST.read_manifest(t.spark, leveled(t), utc("2023-03-01 00:00:00"))


@query("s6_cache_lookup", "SELECT h.repo, h.path, c.payload FROM v_hashes h LEFT JOIN (SELECT sha256, min(path) AS payload FROM v_manifest GROUP BY sha256) c ON h.sha256 = c.sha256")
def _(t):
    cache = t.manifest.groupBy("sha256").agg(F.min("path").alias("payload"))
    return ST.cache_lookup(SN.file_hashes(t.files), cache).select("repo", "path", "payload")


@query("s6_cache_store", """
    SELECT sha256, coalesce(max(CASE WHEN age = 0 THEN payload END), min(CASE WHEN age = 1 THEN payload END)) AS payload FROM (
      SELECT 0 AS age, sha256, min(path) AS payload FROM v_manifest GROUP BY sha256 UNION ALL SELECT 1, sha256, 'new:' || path FROM v_hashes) GROUP BY sha256""")
def _(t):
    cache = t.manifest.groupBy("sha256").agg(F.min("path").alias("payload"))
    return ST.cache_store(cache, SN.file_hashes(t.files).select("sha256", F.concat(F.lit("new:"), "path").alias("payload")))


@query("j2_changed_files", "SELECT repo, path, state FROM v_states")
def _(t):
    return SN.changed_files(t.files, t.manifest).select("repo", "path", "state")


@query("a12_cache_counts", "SELECT repo, count(*) AS total, count(*) FILTER (WHERE state = 'changed') AS changed, count(*) FILTER (WHERE state = 'cached') AS cached FROM v_states GROUP BY repo")
def _(t):
    return SN.cache_counts(SN.changed_files(t.files, t.manifest))


@query("j3_compare_baseline", "SELECT repo, ref_path, state FROM v_compared")
def _(t):
    return SN.compare_baseline(t.refs, SN.path_hashes(t.files, t.refs), t.baseline)


@query("a11_baseline_counts", """
    SELECT repo, count(*) AS total, count(*) FILTER (WHERE state = 'unchanged') AS unchanged, count(*) FILTER (WHERE state = 'changed') AS changed,
      count(*) FILTER (WHERE state = 'missing') AS missing, count(*) FILTER (WHERE state = 'new') AS new FROM v_compared GROUP BY repo""")
def _(t):
    return SN.baseline_counts(SN.compare_baseline(t.refs, SN.path_hashes(t.files, t.refs), t.baseline))


ORPHANS = "SELECT DISTINCT CASE WHEN sha256 IN (SELECT sha256 FROM v_manifest) THEN 'kept' ELSE 'removed' END AS fate, sha256 FROM (SELECT sha256 FROM v_hashes UNION SELECT sha256 FROM v_baseline)"


@query("j4_orphaned_cache", f"SELECT fate, count(*) AS n FROM ({ORPHANS}) GROUP BY fate")
def _(t):
    cache = SN.file_hashes(t.files).select("sha256").union(t.baseline.select("sha256")).distinct()
    kept, removed = SN.orphaned_cache(cache, t.manifest)
    return kept.withColumn("fate", F.lit("kept")).union(removed.withColumn("fate", F.lit("removed"))).groupBy("fate").agg(F.count("*").alias("n"))


@query("j5_ref_changes", """
    SELECT r.repo, r.doc, r.section, r.path, coalesce(h.sha256 <> b.sha256, true) AS changed FROM v_section_refs r
    LEFT JOIN v_hashes h ON r.repo = h.repo AND r.path = h.path LEFT JOIN v_baseline2 b ON r.repo = b.repo AND r.path = b.ref_path""")
def _(t):
    refs = SE.section_refs(SE.parse_sections(t.docs))
    return SN.ref_changes(refs, SN.path_hashes(t.files, refs), t.baseline2).select("repo", "doc", "section", "path", "changed")


@query("j14_dir_hash", f"SELECT repo, path, n_files, sha256 FROM ({DIGEST_SQL}) WHERE path IN (SELECT regexp_replace(path, '/[^/]*$', '') FROM v_files)")
def _(t):
    refs = t.files.select("repo", T.dirname(F.col("path")).alias("path"))
    return SN.dir_hash(refs, t.files)


@query("a13_dir_digest", DIGEST_SQL)
def _(t):
    return SN.dir_digest(SN.file_hashes(t.files))


@query("w5_latest_snapshot", """
    SELECT repo, path, sha256 FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY k DESC) AS rn FROM (
      SELECT 1 AS k, repo, path, sha256 FROM v_hashes UNION ALL SELECT 2, repo, path, sha256 FROM v_manifest)) WHERE rn = 1""")
def _(t):
    old = SN.file_hashes(t.files).withColumn("saved_at", utc("2023-01-01 00:00:00"))
    new = t.manifest.select("repo", "path", "sha256", utc("2024-01-01 00:00:00").alias("saved_at"))
    return SN.latest_snapshot(old.unionByName(new), ["repo", "path"]).select("repo", "path", "sha256")


@query("u2_distinct_refs", "SELECT DISTINCT repo, path AS ref_path FROM v_section_refs")
def _(t):
    return SN.distinct_refs(SE.section_refs(SE.parse_sections(t.docs)))


@query("w3_parse_sections", "SELECT repo, doc, section, CAST(section_ord AS INTEGER) AS section_ord, len(string_split(refs, ',')) AS n_refs, refs FROM v_sections")
def _(t):
    return SE.parse_sections(t.docs).select(
        "repo", "doc", "section", "section_ord", F.size("refs").cast("bigint").alias("n_refs"), F.array_join("refs.path", ",").alias("refs"))


@query("a9_section_status", "SELECT repo, doc, section, status, n_refs, n_changed, changed_refs FROM v_section_status")
def _(t):
    status, _ = verbs.check_sections(t.docs, t.files, t.baseline2)
    return status.select("repo", "doc", "section", "status", "n_refs", "n_changed", F.array_join("changed_refs", "|").alias("changed_refs"))


@query("a10_overall_status", "SELECT * FROM v_overall")
def _(t):
    status, _ = verbs.check_sections(t.docs, t.files, t.baseline2)
    return SE.overall_status(status)


@query("c2_check", "SELECT * FROM v_overall")
def _(t):
    return verbs.check(t.docs, t.files, t.baseline2)


@query("c2_check_after_changes", "SELECT * FROM v_overall")
def _(t):
    """Every tenth file has changed and one is gone since the hash state was stored: only those are read."""
    now = t.files.select("repo", "path", "content")
    changed = F.col("doc_id") % 10 == 0
    gone = t.files.select("repo", F.lit("src/gone.md").alias("path")).distinct()
    then = t.files.select("repo", "path", F.when(changed, "as it was").otherwise(F.col("content")).alias("content"))
    path = scratch_path(t.spark, "hash-state")
    SN.hash_state(then.unionByName(gone.withColumn("content", F.lit("gone")))).write.parquet(path)
    changes = t.files.filter(changed).select(*now.columns).unionByName(gone.withColumn("content", F.lit(None).cast("string")))
    return verbs.check_after(t.docs, t.spark.read.parquet(path), changes, t.baseline2)


@query("c2_check_no_baseline", """
    SELECT f.repo, CASE WHEN s.n IS NULL THEN 'no_docs' ELSE 'slightly-stale' END AS overall, coalesce(s.n, 0) AS total, CAST(0 AS BIGINT) AS current,
      coalesce(s.n, 0) AS possibly_stale, CAST(0 AS BIGINT) AS stale
    FROM (SELECT repo FROM v_files UNION SELECT repo FROM v_commits) f LEFT JOIN (SELECT repo, count(*) AS n FROM v_sections GROUP BY repo) s ON s.repo = f.repo""")
def _(t):
    """Without any baseline; the repositories of the commits have no documents at all."""
    none = t.spark.createDataFrame([], "repo string, ref_path string, sha256 string, saved_at timestamp")
    return verbs.check(t.docs, t.files, none, t.files.select("repo").union(t.commits.select("repo")))


@query("c3_update_plan", "SELECT repo, doc, section, 'writer' AS writer, n_changed, changed_refs FROM v_section_status WHERE status = 'stale'")
def _(t):
    return verbs.update_plan(t.docs, t.files, t.baseline2).withColumn("changed_refs", F.array_join("changed_refs", "|"))


@query("p15_update_targets", "SELECT repo, doc, section, 'writer' AS writer FROM v_section_status WHERE status = 'stale'")
def _(t):
    status, _ = verbs.check_sections(t.docs, t.files, t.baseline2)
    return P.update_targets(status).select("repo", "doc", "section", "writer")


@query("p16_ci_gate", "SELECT repo, overall, stale AS stale_count, overall IN ('stale', 'very-stale') AS fail FROM v_overall")
def _(t):
    return P.ci_gate(verbs.check(t.docs, t.files, t.baseline2))


@query("s14_write_report", """
    SELECT repo, 'DOCS_STATUS=' || overall || chr(10) || 'DOCS_STALE_COUNT=' || stale || chr(10) || 'DOCS_TOTAL_SECTIONS=' || total || chr(10) || 'DOCS_BASELINE=present' AS report
    FROM v_overall""")
def _(t):
    path = scratch_path(t.spark, "report")
    ST.write_report(ST.ci_lines(verbs.check(t.docs, t.files, t.baseline2), t.baseline2), path, "json")
    return t.spark.read.schema("repo string, report string").json(path)


@query("f4_parse_ref", """
    SELECT repo, path, 'p' || doc_id AS ref_path, CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id AS INTEGER) END AS line_start,
      CASE WHEN doc_id % 3 = 1 THEN CAST(doc_id + 5 AS INTEGER) END AS line_end FROM v_files""")
def _(t):
    ref = F.expr("' p' || doc_id || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ':' || doc_id || '-' || (doc_id + 5) ELSE ':' || doc_id END || ' '")
    return t.files.select("repo", "path", T.parse_ref(ref).alias("r")).select("repo", "path", F.col("r.path").alias("ref_path"), "r.line_start", "r.line_end")


@query("f5_markers", """
    SELECT kind, count(*) AS n, count(DISTINCT value) AS n_values FROM (
      SELECT 'start' AS kind, regexp_extract(line, 'docs:start:([^ >]+)', 1) AS value FROM v_doc_lines WHERE line LIKE '<!-- docs:start:%'
      UNION ALL SELECT 'refs', regexp_extract(line, 'docs:refs:([^>]+) -->', 1) FROM v_doc_lines WHERE line LIKE '<!-- docs:refs:%'
      UNION ALL SELECT 'end', regexp_extract(line, 'docs:end:([^ >]+)', 1) FROM v_doc_lines WHERE line LIKE '<!-- docs:end:%') GROUP BY kind""")
def _(t):
    lines = t.docs.select(F.explode(F.split("content", "\n")).alias("line"))
    found = lines.select(T.marker_start(F.col("line")).alias("start"), T.marker_refs(F.col("line")).alias("refs"), T.marker_end(F.col("line")).alias("end"))
    return found.unpivot([], ["start", "refs", "end"], "kind", "value").filter("value is not null").groupBy("kind").agg(
        F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


@query("f6_split_refs", "SELECT repo, doc, count(*) AS n, min(path) AS first_ref, max(path) AS last_ref FROM v_refs GROUP BY repo, doc")
def _(t):
    listed = F.flatten(F.transform(F.regexp_extract_all("content", F.lit("docs:refs:([^>]*) -->"), F.lit(1)), lambda r: T.split_refs(F.concat(F.lit(" ,"), r, F.lit(",")))))
    return t.docs.select("repo", "doc", listed.alias("r")).select(
        "repo", "doc", F.size("r").cast("bigint").alias("n"), F.array_min("r").alias("first_ref"), F.array_max("r").alias("last_ref"))


# Chunks: directories in path order, the smallest path of a repo is its entry point.
CHUNKS_SQL = """
    WITH g AS (SELECT f.repo, f.path, f.n_lines, CASE WHEN e.path IS NOT NULL THEN 0 ELSE 1 END AS r,
        CASE WHEN e.path IS NOT NULL THEN 'entry-points' ELSE regexp_replace(f.path, '/[^/]*$', '') END AS grp
      FROM v_files f LEFT JOIN (SELECT repo, min(path) AS path FROM v_files GROUP BY repo) e ON e.repo = f.repo AND e.path = f.path),
    p AS (SELECT *, (row_number() OVER (PARTITION BY repo, r, grp ORDER BY path) - 1) // 7 AS piece FROM g),
    c AS (SELECT *, dense_rank() OVER (PARTITION BY repo ORDER BY r, grp, piece) - 1 AS chunk_index FROM p),
    n AS (SELECT *, CASE WHEN piece = 0 THEN grp ELSE grp || '-' || chunk_index END AS name FROM c) """


def chunked(t):
    entries = t.files.groupBy("repo").agg(F.min("path").alias("path"))
    return CH.index_chunks(CH.assign_chunks(t.files, entries, 7))


@query("w1_assign_chunks", CHUNKS_SQL + "SELECT repo, path, grp, piece FROM n")
def _(t):
    entries = t.files.groupBy("repo").agg(F.min("path").alias("path"))
    return CH.assign_chunks(t.files, entries, 7).select("repo", "path", "grp", "piece")


@query("w1_assign_chunks_hot", CHUNKS_SQL + "SELECT repo, path, chunk_index, name FROM n")
def _(t):
    return chunked(t).select("repo", "path", "chunk_index", "name")


@query("w2_chunk_index", CHUNKS_SQL + "SELECT repo, path, chunk_index, name FROM n")
def _(t):
    return chunked(t).select("repo", "path", "chunk_index", "name")


@query("a3_chunk_totals", CHUNKS_SQL + """SELECT repo, chunk_index, name, count(*) AS n_files, CAST(sum(n_lines) AS BIGINT) AS n_lines,
    CAST(sum(n_lines) * 400 // 35 AS BIGINT) AS est_tokens, string_agg(path, '|' ORDER BY path) AS files FROM n GROUP BY repo, chunk_index, name""")
def _(t):
    return CH.chunk_totals(chunked(t)).withColumn("files", F.array_join("files", "|"))


@query("a3_plan_totals", CHUNKS_SQL + """SELECT repo, CAST(sum(k) AS BIGINT) AS total_files, count(*) AS chunks, CAST(sum(l) AS BIGINT) AS total_lines, CAST(sum(l * 400 // 35) AS BIGINT) AS total_est_tokens
    FROM (SELECT repo, chunk_index, count(*) AS k, sum(n_lines) AS l FROM n GROUP BY repo, chunk_index) GROUP BY repo""")
def _(t):
    return CH.plan_totals(CH.chunk_totals(chunked(t)))


@query("j21_entry_point_files", "SELECT f.repo, f.path, f.n_lines FROM v_files f JOIN (SELECT repo, min(path) AS path FROM v_files GROUP BY repo) e ON e.repo = f.repo AND e.path = f.path")
def _(t):
    entries = t.files.groupBy("repo").agg(F.min("path").alias("path"))
    return CH.entry_point_files(t.files, entries).select("repo", "path", "n_lines")


@query("t9_order_files", """
    SELECT repo, path, -CAST(n AS BIGINT) AS prio FROM (SELECT f.repo, f.path, coalesce(r.n, 0) AS n FROM v_files f
      LEFT JOIN (SELECT repo, path, count(*) AS n FROM v_refs GROUP BY repo, path) r ON r.repo = f.repo AND r.path = f.path)""")
def _(t):
    changes = t.refs.groupBy("repo", "path").agg(F.count("*").alias("changes"))
    return CH.order_files(t.files, "change-frequency", changes=changes).select("repo", "path", "prio")


BUDGET_SQL = """
    SELECT repo, files, lines, greatest((files + 49) // 50, 1) AS chunks, oversized, CAST(a AS BIGINT) AS analysis, CAST(20700 + a AS BIGINT) AS total,
      CASE WHEN 20700 + a > 30000 THEN 'ABORT' WHEN 20700 + a > 24000 THEN 'WARN' ELSE 'SILENT' END AS decision FROM (
      SELECT repo, count(*) AS files, CAST(sum(n_lines) AS BIGINT) AS lines, count(*) FILTER (WHERE n_lines > 50) AS oversized,
        (sum(n_lines) * 400 // CASE WHEN any_value(language) = 'typescript' THEN 35 ELSE 40 END) * 40 // 100 + 3000 AS a
      FROM (SELECT repo, n_lines FROM v_files) f JOIN v_languages USING (repo) GROUP BY repo)"""


def repo_languages(t):
    has_ts = F.max(F.col("path").endswith(".ts"))
    return t.files.groupBy("repo").agg(has_ts.alias("ts")).select("repo", F.array(F.when(F.col("ts"), "typescript").otherwise("python")).alias("languages"))


@query("a4_estimate_budget", BUDGET_SQL)
def _(t):
    return CH.estimate_budget(t.files, repo_languages(t), "balanced", oversize=50, max=30000, warn=24000).select(
        "repo", "files", "lines", "chunks", "oversized", F.col("passes.analysis").alias("analysis"), "total", "decision")


@query("a27_cost_report", """
    SELECT repo, CAST(f AS BIGINT) AS analysis_tokens, CAST(9000 AS BIGINT) AS generation_tokens, CAST(11700 AS BIGINT) AS review_tokens, CAST(20700 + f AS BIGINT) AS total_tokens,
      CAST(f - c AS BIGINT) AS saved_tokens, CAST(20700 + c AS BIGINT) AS net_tokens FROM (
      SELECT repo, (sum(n_lines) * 400 // r) * 40 // 100 + 3000 AS f, (coalesce(sum(n_lines) FILTER (WHERE state = 'changed'), 0) * 400 // r) * 40 // 100 + 3000 AS c
      FROM (SELECT s.repo, s.n_lines, s.state, CASE WHEN language = 'typescript' THEN 35 ELSE 40 END AS r FROM v_states s JOIN v_languages USING (repo)) GROUP BY repo, r)""")
def _(t):
    return CH.cost_report(SN.changed_files(t.files, t.manifest), t.files, repo_languages(t))


@query("f7_estimate_tokens", """SELECT repo, path, CAST((n_lines * 400 // 35) * 40 // 100 + 3000 AS BIGINT) AS analysis, CAST((n_lines * 400 // 35) * 40 // 100 + 3000 + 9000 + 14400 AS BIGINT) AS total FROM v_files""")
def _(t):
    passes = B.estimate_tokens(F.col("n_lines"), F.array(F.lit("python"), F.lit("javascript")), "thorough")
    return t.files.withColumn("p", passes).select("repo", "path", F.col("p.analysis").alias("analysis"), B.pass_total(F.col("p")).alias("total"))


@query("f8_bytes_per_token", "SELECT repo, path, CAST(CASE language WHEN 'en' THEN 35 WHEN 'fr' THEN 40 WHEN 'de' THEN 33 ELSE 38 END AS BIGINT) AS tenths FROM v_files")
def _(t):
    langs = F.expr("CASE language WHEN 'en' THEN array('go', 'typescript') WHEN 'fr' THEN array('python', 'ruby') WHEN 'de' THEN array('kotlin') ELSE array('elm') END")
    return t.files.select("repo", "path", B.bytes_per_token_tenths(langs).alias("tenths"))


@query("f9_chunk_tokens", "SELECT repo, path, CAST(n_lines * 400 // 35 AS BIGINT) AS tokens FROM v_files")
def _(t):
    return t.files.select("repo", "path", B.chunk_tokens(F.col("n_lines")).alias("tokens"))


@query("f10_budget_decision", """
    SELECT repo, path, CASE WHEN n_lines * 4000 > 100000 THEN 'ABORT' WHEN n_lines * 4000 > 50000 THEN 'WARN' ELSE 'SILENT' END AS frugal,
      CASE WHEN n_lines * 4000 > 150000 THEN 'WARN' ELSE 'SILENT' END AS balanced, CASE WHEN n_lines * 4000 > 30000 THEN 'ABORT' ELSE 'SILENT' END AS hard FROM v_files""")
def _(t):
    total = F.col("n_lines").cast("bigint") * 4000
    return t.files.select("repo", "path", B.budget_decision(total, "frugal").alias("frugal"), B.budget_decision(total).alias("balanced"), B.budget_decision(total, budget=30000).alias("hard"))


@query("f21_pct_trunc", "SELECT repo, CAST(count(*) FILTER (WHERE n_lines > 3) * 100 // count(*) AS BIGINT) AS pct, CAST(count(*) FILTER (WHERE n_lines > 3) * 1000 // count(*) AS BIGINT) AS tenths FROM v_files GROUP BY repo")
def _(t):
    counted = t.files.groupBy("repo").agg(F.count_if(F.col("n_lines") > 3).alias("a"), F.count("*").alias("b"))
    return counted.select("repo", T.pct_trunc(F.col("a"), F.col("b")).alias("pct"), (T.pct_trunc1(F.col("a"), F.col("b")) * 10).cast("bigint").alias("tenths"))
