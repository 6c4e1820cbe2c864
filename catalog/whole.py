"""Whole jobs of operators that other queries apply to a part of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.scan import PATTERNS
from catalog.surface import IMPORT_EDGES_SQL
from corpusloom import fixed_values as fv
from corpusloom.functions import text as T
from corpusloom.operators import filters as P
from corpusloom.operators import graph as G
from corpusloom.operators import history as H
from corpusloom.operators import secrets as S
from corpusloom.plans import verbs
from corpusloom.runtime import scratch_path
from corpusloom.sources import files as SF
from corpusloom.sources import history as SH


def redact_sql(text: str) -> str:
    for p in PATTERNS:
        text = "regexp_replace({}, '{}', '[REDACTED: {} detected]', 'g')".format(text, p.regex.replace("'", "''"), p.name)
    return text


@query("f23_redact_all", f"""
    SELECT repo, path, sha256(string_agg({redact_sql("line")}, chr(10) ORDER BY pos)) AS redacted_sha256 FROM (
      SELECT repo, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM v_files) GROUP BY repo, path""")
def _(t):
    """Every pattern, in every line of every file."""
    return t.files.select("repo", "path", F.sha2(S.redact(F.col("content"), PATTERNS), 256).alias("redacted_sha256"))


@query("s1_read_corpus_files", """
    SELECT source AS repo, CAST(doc_id AS VARCHAR) AS doc, CAST(strlen(text) + 1 AS BIGINT) AS n_bytes, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS n_lines,
      sha256(text || chr(10)) AS sha256, 'txt' AS language FROM documents""")
def _(t):
    """A folder per repository and a file per document, written as text and read as a checked-out corpus."""
    root = scratch_path(t.spark, "corpus")
    files = t.documents.select(F.col("source").alias("repo"), F.col("doc_id").alias("doc"), F.col("text").alias("value"))
    SF.write_corpus(files, root)
    found = SF.read_corpus(t.spark, root, "*.txt")
    return found.select(
        F.regexp_extract("repo", r"^repo=(.*)$", 1).alias("repo"), F.regexp_extract("path", r"^doc=([0-9]+)[./]", 1).alias("doc"), "n_bytes",
        F.col("n_lines").cast("bigint").alias("n_lines"), T.content_hash(F.col("content")).alias("sha256"), "language")


@query("s8_read_issue_turns", "SELECT repo, number, title, length(body) AS n_body, author, CAST(closed_at AS VARCHAR) AS closed_at, label_a AS labels FROM v_issue_turns")
def _(t):
    """Every turn of every conversation as an issue document, with its text."""
    path = scratch_path(t.spark, "issues")
    t.issue_turns.selectExpr(
        "repo", "number", "title", "body", "date_format(closed_at, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS closedAt", "named_struct('login', author) AS author",
        "array(named_struct('name', label_a)) AS labels").write.json(path)
    return SH.read_issues(t.spark, path).select(
        "repo", "number", "title", F.length("body").cast("bigint").alias("n_body"), "author", F.date_format("closed_at", "yyyy-MM-dd HH:mm:ss").alias("closed_at"),
        F.array_join("labels", ",").alias("labels"))


@query("p13_closed_issue_turns", "SELECT repo, number FROM v_issue_turns WHERE closed_at IS NOT NULL")
def _(t):
    return P.closed_issues(t.issue_turns).select("repo", "number")


@query("t10_recent_issue_turns", """
    SELECT repo, number, rank FROM (SELECT repo, number, CAST(row_number() OVER (PARTITION BY repo ORDER BY closed_at DESC, number DESC) AS INTEGER) AS rank FROM v_issue_turns WHERE closed_at IS NOT NULL)
    WHERE rank <= 20""")
def _(t):
    return H.recent_issues(P.closed_issues(t.issue_turns)).select("repo", "number", "rank")


@query("j22_related_groups", """
    WITH k AS (SELECT repo, path, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '/([^./]*)[^/]*$', 1) AS stem, path LIKE '%.test.%' AS is_test FROM v_files)
    SELECT repo, relation, name, path, is_test, n FROM (
      SELECT repo, 'same_directory' AS relation, dir AS name, path, is_test, count(*) OVER (PARTITION BY repo, dir) AS n, true AS ok FROM k
      UNION ALL SELECT repo, 'test', stem, path, is_test, count(*) OVER (PARTITION BY repo, stem), bool_or(is_test) OVER (PARTITION BY repo, stem) FROM k) WHERE n > 1 AND ok""")
def _(t):
    """Every file with the groups it is in: files of one group are related, without writing out the pairs."""
    return G.related_groups(t.files)


TAKES_PART = "path NOT LIKE '%.test.%' AND (path LIKE 'src/%' OR path LIKE 'app/%' OR path LIKE 'internal/%')"
SCANNED_EDGES = IMPORT_EDGES_SQL.replace("FROM v_code_lines)", f"FROM v_code_lines WHERE {TAKES_PART})").replace("FROM v_code WHERE", f"FROM v_code WHERE {TAKES_PART} AND")
SCANNED_SECRETS = " UNION ALL ".join(
    "SELECT repo FROM v_code_lines WHERE {} AND regexp_matches(line, '{}')".format(TAKES_PART, p.regex.replace("'", "''")) for p in fv.SECRET_PATTERNS)


@query("c1_context_facts", f"""
    SELECT f.repo, f.files, coalesce(s.n, 0) AS secrets, coalesce(e.n, 0) AS imports, coalesce(e.own, 0) AS internal, f.cached FROM
      (SELECT c.repo, count(*) AS files, count(*) FILTER (WHERE m.sha256 = sha256(c.content)) AS cached FROM v_code c LEFT JOIN v_manifest m ON m.repo = c.repo AND m.path = c.path
       WHERE c.{TAKES_PART.replace("(path", "(c.path").replace("OR path", "OR c.path")} GROUP BY c.repo) f
      LEFT JOIN (SELECT repo, count(*) AS n FROM ({SCANNED_SECRETS}) GROUP BY repo) s ON s.repo = f.repo
      LEFT JOIN (SELECT repo, count(*) AS n, count(*) FILTER (WHERE is_internal) AS own FROM ({SCANNED_EDGES}) GROUP BY repo) e ON e.repo = f.repo""")
def _(t):
    """The facts of a context that its totals leave out: secrets, imports and what is cached."""
    context = verbs.generate_context(t.code, t.manifest)
    count = lambda df, *cols: df.groupBy("repo").agg(*cols)
    edges = count(context.imports, F.count("*").alias("imports"), F.count_if("is_internal").alias("internal"))
    cached = count(context.states, F.count_if(F.col("state") == "cached").alias("cached"))
    found = context.summary.select("repo", "files", F.col("secrets").cast("bigint").alias("secrets")).join(edges, "repo", "left").join(cached, "repo")
    return found.fillna(0, ["imports", "internal"])
