"""Telemetry, streams, analyzers and the full context."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import SIMPLE
from corpusloom import plugins as PL
from corpusloom.functions import text as T
from corpusloom.operators import usage as U
from corpusloom.plans import verbs
from corpusloom.runtime import scratch_path
from corpusloom.sources import tables as ST
from corpusloom.streaming import jobs as J

CONSENT = "enabled AND NOT do_not_track"


@query("a21_command_counts", f"SELECT command, count(*) AS n FROM v_telemetry WHERE {CONSENT} GROUP BY command")
def _(t):
    return U.command_counts(t.telemetry)


@query("s13_append_telemetry", "SELECT event_id, command, CAST(ts AS VARCHAR)[1:10] AS day FROM v_telemetry")
def _(t):
    path = scratch_path(t.spark, "telemetry")
    ST.append_telemetry(t.telemetry.filter("event_id % 2 = 0"), path)
    ST.append_telemetry(t.telemetry.filter("event_id % 2 = 1"), path)
    return t.spark.read.parquet(path).select("event_id", "command", F.col("day").cast("string").alias("day"))


@query("s12_read_findings", """
    SELECT source AS repo, 'scan-' || doc_id AS analyzer, 0.5 AS confidence, 'n=' || n_chars || ',lang=' || lang AS data, 'chars ' || n_chars AS findings FROM documents""".replace("0.5 AS", "CAST(0.5 AS DOUBLE) AS"))
def _(t):
    block = F.concat(
        F.lit("=== CUSTOM FINDINGS ===\nANALYZER: scan-"), F.col("doc_id").cast("string"), F.lit("\nCONFIDENCE: 0.5\n\nFINDINGS:\n  - chars "), F.col("n_chars").cast("string"),
        F.lit("\n\nDATA:\n  N_CHARS: "), F.col("n_chars").cast("string"), F.lit("\n  LANG: "), "lang", F.lit("\n\n========================\n"), "text")
    read = ST.read_findings(t.documents.select(F.col("source").alias("repo"), block.alias("text")))
    return read.select(
        "repo", "analyzer", "confidence", F.concat(F.lit("n="), F.col("data")["N_CHARS"], F.lit(",lang="), F.col("data")["LANG"]).alias("data"),
        F.array_join("findings", ",").alias("findings"))


def event_stream(t):
    """The events table as a stream."""
    return t.stream("events").select(
        F.col("user_id").cast("string").alias("anonymous_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("command"),
        (F.col("user_id") % 2 == 0).alias("enabled"), (F.col("user_id") % 5 == 0).alias("do_not_track"), "event_id", "user_id")


def finish(running) -> None:
    running.awaitTermination()
    if running.exception() is not None:
        raise running.exception()


@query("st1_telemetry_counts_stream", f"""
    SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, command, count(*) AS n FROM v_telemetry WHERE {CONSENT}
    GROUP BY 1, 2 HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM v_telemetry WHERE {CONSENT}) - INTERVAL 1 HOUR""")
def _(t):
    path, mark = scratch_path(t.spark, "counts"), scratch_path(t.spark, "mark")
    finish(J.start_append(J.telemetry_counts_stream(event_stream(t)), path, mark))
    return t.spark.read.schema("window_start timestamp, command string, n bigint").parquet(path)


@query("st1_telemetry_counts_complete", f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, command, count(*) AS n FROM v_telemetry WHERE {CONSENT} GROUP BY 1, 2")
def _(t):
    path, mark = scratch_path(t.spark, "counts"), scratch_path(t.spark, "mark")
    finish(J.start_complete(J.telemetry_counts_stream(event_stream(t)), path, mark))
    return t.spark.read.schema("window_start timestamp, command string, n bigint").parquet(path)


@query("st2_activity_30d_stream", """
    SELECT CAST(d - k * INTERVAL 1 DAY AS TIMESTAMP) AS window_start, repo, count(*) AS n FROM (SELECT date_trunc('day', ts) AS d, 'r' || (user_id % 40) AS repo FROM events)
    CROSS JOIN range(0, 30) AS x(k) GROUP BY 1, 2""")
def _(t):
    path, mark = scratch_path(t.spark, "activity"), scratch_path(t.spark, "mark")
    commits = event_stream(t).select("ts", F.concat(F.lit("r"), (F.col("user_id") % 40).cast("string")).alias("repo"))
    finish(J.start_complete(J.activity_30d_stream(commits), path, mark))
    return t.spark.read.schema("window_start timestamp, repo string, n bigint").parquet(path)


@query("st2_activity_panes", """
    WITH d AS (SELECT 'r' || (user_id % 40) AS repo, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n FROM events GROUP BY 1, 2
      HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)
    SELECT repo, day, CAST(sum(n) OVER (PARTITION BY repo ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM d""")
def _(t):
    """Daily counts in append mode, whose state expires, and the 30 days up to each of them from the written table."""
    path, mark = scratch_path(t.spark, "days"), scratch_path(t.spark, "mark")
    commits = event_stream(t).select("ts", F.concat(F.lit("r"), (F.col("user_id") % 40).cast("string")).alias("repo"))
    finish(J.start_append(J.activity_days_stream(commits), path, mark))
    return J.trailing_activity(t.spark.read.schema("day timestamp, repo string, n bigint").parquet(path))


@query("st3_staleness_stream", """SELECT repo, doc, section, status, n_refs, n_changed FROM v_section_status s WHERE EXISTS (
    SELECT 1 FROM v_section_refs r JOIN v_hashes h ON h.repo = r.repo AND h.path = r.path WHERE r.repo = s.repo AND r.doc = s.doc AND r.section = s.section)""")
def _(t):
    """Every file arrives as a change, so the stream writes the status of each section that cites an existing file."""
    status, saved, mark, docs = (scratch_path(t.spark, n) for n in ("status", "baseline", "mark", "docs"))
    t.docs.write.parquet(docs)
    names = {c: e for c, e in SIMPLE["v_files"][1].items() if c in ("repo", "path", "content")}
    changes = t.stream("documents").select(*[F.expr(e).alias(c) for c, e in names.items()])
    finish(J.staleness_stream(
        changes, t.spark.read.schema("repo string, doc string, content string").parquet(docs), lambda: t.files, lambda: t.baseline2, status, saved, mark))
    schema = "repo string, doc string, section string, status string, n_refs bigint, n_changed bigint, batch_id bigint"
    return t.spark.read.schema(schema).parquet(status).drop("batch_id")


@query("st4_response_cache_stream", """
    WITH RECURSIVE e AS (SELECT 'r' || (user_id % 40) AS repo, event_type || '-' || user_id AS key, ts FROM events),
    r AS (SELECT repo, key, min(ts) AS ts FROM e GROUP BY repo, key
      UNION SELECT r.repo, r.key, min(e.ts) FROM r JOIN e ON e.repo = r.repo AND e.key = r.key AND e.ts > r.ts + INTERVAL 1 HOUR GROUP BY r.repo, r.key, r.ts)
    SELECT repo, key, ts FROM r""")
def _(t):
    path, mark = scratch_path(t.spark, "responses"), scratch_path(t.spark, "mark")
    responses = event_stream(t).select(
        "ts", F.concat(F.lit("r"), (F.col("user_id") % 40).cast("string")).alias("repo"), F.concat("command", F.lit("-"), F.col("user_id").cast("string")).alias("key"))
    finish(J.start_append(J.response_cache_stream(responses), path, mark))
    return t.spark.read.schema("ts timestamp, repo string, key string").parquet(path)


def line_totals(files):
    """Example analyzer: lines and files of one batch."""
    return [("LINES", int(files["n_lines"].sum())), ("FILES", len(files))]


def fragile(files):
    """Example analyzer that cannot handle one repository."""
    if files["repo"].iloc[0] == "src3":
        raise ValueError("unreadable")
    return [("FILES", len(files))]


def route_frame(files):
    """Example native analyzer: route registrations per repo."""
    lines = files.groupBy("repo").agg(F.sum(T.matching_lines(F.col("content"), r"router\.(get|post|put|patch|delete)\(")).cast("bigint").alias("value"))
    return lines.select("repo", F.lit("ROUTES").alias("key"), "value", F.lit(None).cast("string").alias("text"))


def registry() -> PL.Registry:
    made = PL.Registry()
    made.register_analyzer("line-totals", line_totals, "Lines and files", confidence=0.9)
    made.register_analyzer("fragile", fragile, "Fails for one repository", confidence=0.8)
    made.register_analyzer("routes", route_frame, "Routes", file_filter="*.ts", kind="frame", confidence=0.95)
    return made


FINDING = "repo, analyzer, status, confidence, data, error"


def flat(findings):
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("data")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return findings.select("repo", "analyzer", "status", "confidence", pairs.alias("data"), "error")


LINES_SQL = "SELECT repo, 'line-totals' AS analyzer, 'success' AS status, CAST(0.9 AS DOUBLE) AS confidence, 'FILES=' || count(*) || ',LINES=' || sum(n_lines) AS data, CAST(NULL AS VARCHAR) AS error FROM v_code GROUP BY repo"
FRAGILE_SQL = """SELECT repo, 'fragile' AS analyzer, CASE WHEN repo = 'src3' THEN 'error' ELSE 'success' END AS status, CASE WHEN repo <> 'src3' THEN CAST(0.8 AS DOUBLE) END AS confidence,
    CASE WHEN repo <> 'src3' THEN 'FILES=' || count(*) END AS data, CASE WHEN repo = 'src3' THEN 'ValueError: unreadable' END AS error FROM v_code GROUP BY repo"""
ROUTES_SQL = r"""SELECT repo, 'routes' AS analyzer, 'success' AS status, CAST(0.95 AS DOUBLE) AS confidence, 'ROUTES=' || count(*) FILTER (WHERE regexp_matches(line, 'router\.(get|post|put|patch|delete)\(')) AS data,
    CAST(NULL AS VARCHAR) AS error FROM v_code_lines WHERE path LIKE '%.ts' GROUP BY repo"""


@query("x1_register_analyzer", f"SELECT {FINDING} FROM ({LINES_SQL})")
def _(t):
    return flat(registry().run_analyzer("line-totals", t.code))


@query("x2_run_all", f"SELECT {FINDING} FROM ({LINES_SQL}) UNION ALL SELECT {FINDING} FROM ({FRAGILE_SQL}) UNION ALL SELECT {FINDING} FROM ({ROUTES_SQL})")
def _(t):
    return flat(registry().run_all(t.code))


def notes(files):
    """Example analyzer: every line that reads the environment, with its place."""
    return [
        ("ENV", 1, line, path, k + 1) for path, text in zip(files["path"], files["content"], strict=True) for k, line in enumerate(text.split("\n")) if "env" in line
    ]


NOTES_SQL = "SELECT repo, 'notes' AS analyzer, 'ENV' AS key, path, CAST(pos AS BIGINT) AS position, line AS text FROM v_code_lines WHERE contains(line, 'env')"


def noted(t):
    made = registry()
    made.register_analyzer("notes", notes)
    return made.text_findings(t.code)


@query("x1_text_findings", NOTES_SQL)
def _(t):
    return noted(t)


@query("x1_first_texts", f"""
    SELECT repo, analyzer, key, n_texts, string_agg(text, '|' ORDER BY rn) AS texts FROM (
      SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path, position, text) AS rn, count(*) OVER (PARTITION BY repo) AS n_texts FROM ({NOTES_SQL})) WHERE rn <= 20 GROUP BY ALL""")
def _(t):
    return PL.first_texts(noted(t)).withColumn("texts", F.array_join("texts", "|"))


@query("x2_run_not_found", "SELECT DISTINCT repo, 'nonexistent' AS analyzer, 'not_found' AS status FROM v_code")
def _(t):
    return registry().run_analyzer("nonexistent", t.code).select("repo", "analyzer", "status")


@query("x3_fault_isolation", f"SELECT {FINDING} FROM ({FRAGILE_SQL})")
def _(t):
    return flat(registry().run_analyzer("fragile", t.code))


@query("x4_file_filter", f"SELECT {FINDING} FROM ({ROUTES_SQL})")
def _(t):
    return flat(registry().run_analyzer("routes", t.code))


def plugin_files(t):
    """Documents as plugin definitions: scripts, agents and generators."""
    kind = F.expr("CASE doc_id % 3 WHEN 0 THEN 'analyzers/a' || doc_id || '.sh' WHEN 1 THEN 'analyzers/b' || doc_id || '.md' ELSE 'generators/g' || doc_id || '.md' END")
    script = F.concat(F.lit("#!/usr/bin/env bash\n# description: checks "), "lang", F.lit("\n# file-filter: *."), "lang", F.lit("\n"), "text")
    agent = F.concat(F.lit("---\nname: b\ndescription: reads "), "lang", F.lit("\n---\n"), "text")
    generator = F.concat(F.lit("---\ndescription: writes "), "lang", F.when(F.col("doc_id") % 2 == 0, F.lit("\noutput-file: docs/OUT.md")).otherwise(""), F.lit("\n---\n"), "text")
    content = F.when(F.col("doc_id") % 3 == 0, script).when(F.col("doc_id") % 3 == 1, agent).otherwise(generator)
    return t.documents.select(F.col("source").alias("repo"), F.concat(F.lit(".docs/"), kind).alias("path"), content.alias("content"))


PLUGINS_SQL = """
    SELECT source AS repo, CASE doc_id % 3 WHEN 0 THEN 'script' WHEN 1 THEN 'agent' ELSE 'generator' END AS kind,
      CASE doc_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'g' END || doc_id AS name,
      CASE doc_id % 3 WHEN 0 THEN 'checks ' WHEN 1 THEN 'reads ' ELSE 'writes ' END || lang AS description,
      CASE doc_id % 3 WHEN 0 THEN '*.' || lang WHEN 1 THEN '*' END AS file_filter,
      CASE WHEN doc_id % 3 = 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'docs/OUT.md' ELSE 'docs/g' || doc_id || '.md' END END AS output_file FROM documents"""


@query("x5_list_plugins", PLUGINS_SQL)
def _(t):
    return PL.list_plugins(plugin_files(t)).drop("path")


@query("a28_plugin_counts", f"""
    SELECT repo, count(*) FILTER (WHERE kind = 'script') AS scripts, count(*) FILTER (WHERE kind = 'agent') AS agents, count(*) FILTER (WHERE kind <> 'generator') AS analyzers,
      count(*) FILTER (WHERE kind = 'generator') AS generators FROM ({PLUGINS_SQL}) GROUP BY repo""")
def _(t):
    return PL.plugin_counts(PL.list_plugins(plugin_files(t)))


@query("u6_merge_findings", f"SELECT {FINDING}, CAST(NULL AS VARCHAR) AS note FROM ({LINES_SQL}) UNION ALL SELECT repo, 'agent', 'success', CAST(1.0 AS DOUBLE), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 'read ' || count(*) FROM v_code GROUP BY repo")
def _(t):
    agent = t.code.groupBy("repo").agg(F.concat(F.lit("read "), F.count("*").cast("string")).alias("note")).select(
        "repo", F.lit("agent").alias("analyzer"), F.lit("success").alias("status"), F.lit(1.0).alias("confidence"), "note")
    return PL.merge_findings(flat(registry().run_analyzer("line-totals", t.code)), agent)


@query("x6_merge_context", f"""
    SELECT r.repo, r.files, CASE WHEN r.repo = 'src3' THEN NULL ELSE '{{"FILES":"' || r.files || '"}}' END AS fragile, '{{"FILES":"' || r.files || '","LINES":"' || r.lines || '"}}' AS line_totals
    FROM (SELECT repo, count(*) AS files, sum(n_lines) AS lines FROM v_code GROUP BY repo) r""")
def _(t):
    base = t.code.groupBy("repo").agg(F.count("*").alias("files"))
    merged = PL.merge_context(base, registry().run_all(t.code))
    return merged.select("repo", "files", F.col("analyzers")["fragile"].alias("fragile"), F.col("analyzers")["line-totals"].alias("line_totals"))


SCANNED = "(SELECT * FROM v_code WHERE path NOT LIKE '%.test.%' AND (path LIKE 'src/%' OR path LIKE 'app/%' OR path LIKE 'internal/%'))"


@query("c1_generate_context", f"""
    SELECT repo, count(*) AS files, CAST(sum(n_lines) AS BIGINT) AS lines, count(DISTINCT dir) AS dirs, count(*) AS changed,
      CAST(20700 + (sum(n_lines) * 400 // 38) * 40 // 100 + 3000 AS BIGINT) AS total
    FROM (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir FROM {SCANNED}) GROUP BY repo""")
def _(t):
    context = verbs.generate_context(t.code, t.manifest)
    changed = context.states.filter("state = 'changed'").groupBy("repo").agg(F.count("*").alias("changed"))
    dirs = context.chunks.select("repo", T.dirname(F.col("files")[0]).alias("d")).groupBy("repo").agg(F.countDistinct("d").alias("dirs"))
    return context.summary.select("repo", "files", "lines").join(context.budget.select("repo", "total"), "repo").join(changed, "repo").join(dirs, "repo")
