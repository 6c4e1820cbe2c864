"""Documentation sections, their references, and how stale they are."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def parse_sections(docs: DataFrame, namespace: str = T.DEFAULT_NAMESPACE) -> DataFrame:
    """Closed sections of each document, in order, with the references inside.

    Works inside the row: the text is cut at every start marker, so a piece reaches to the next start (a new
    start replaces an open section), and a piece counts when it holds an end marker of its own name. A
    document is never exploded into lines and nothing is shuffled.
    """
    ns = re.escape(namespace)
    starts = F.split("content", rf"<!-- {ns}:start:(?=[^ >\n])")
    pieces = docs.select("repo", "doc", F.posexplode(starts).alias("section_ord", "piece")).filter("section_ord > 0")
    named = pieces.withColumn("section", F.regexp_extract("piece", r"^([^ >\n]+)", 1)).withColumn(
        "ends", F.split("piece", rf"<!-- {ns}:end:")
    )
    tails = F.slice("ends", 2, F.greatest(F.size("ends") - 1, F.lit(0)))
    closing = F.array_position(F.transform(tails, lambda e: F.regexp_extract(e, r"^([^ >\n]*)", 1)), F.col("section"))
    closed = named.withColumn("closing", closing.cast("int")).filter("closing > 0")
    body = F.array_join(F.slice("ends", 1, F.col("closing")), f"<!-- {namespace}:end:")
    markers = F.regexp_extract_all("body", F.lit(rf".*<!-- {ns}:refs:([^>\n]+) -->"), F.lit(1))
    refs = F.flatten(F.transform(markers, T.split_refs))
    return closed.withColumn("body", body).select(
        "repo", "doc", "section", "section_ord",
        F.regexp_replace("body", r"^[^\n]*\n?", "").alias("body"),
        F.transform(refs, T.parse_ref).alias("refs"),
    )


def section_refs(sections: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per reference of a section; directories lose their trailing slash.

    With ``keep_empty`` a section without references keeps one row whose path is NULL, so that a single pass
    over the documents feeds both the references and the sections.
    """
    fan = F.explode_outer if keep_empty else F.explode
    rows = sections.select("repo", "doc", "section", "section_ord", fan("refs").alias("ref")).select(
        "repo", "doc", "section", "section_ord", F.regexp_replace("ref.path", r"(.)/+$", "$1").alias("path"),
        "ref.line_start", "ref.line_end")
    return rows if keep_empty else rows.filter(F.col("path") != "")


def document_refs(docs: DataFrame, namespace: str = T.DEFAULT_NAMESPACE) -> DataFrame:
    """Every reference in a document, whether or not it lies in a section."""
    markers = F.regexp_extract_all("content", F.lit(rf".*<!-- {re.escape(namespace)}:refs:([^>\n]+) -->"), F.lit(1))
    refs = F.flatten(F.transform(markers, T.split_refs))
    return docs.select("repo", "doc", F.explode(F.transform(refs, T.ref_path)).alias("path")).filter(F.col("path") != "")


def section_status(changes: DataFrame, has_baseline: DataFrame) -> DataFrame:
    """Status per section: possibly-stale without refs or without a baseline, else current or stale.

    ``changes`` are the reference rows of all sections (see ``section_refs(keep_empty=True)``) with ``changed``;
    ``has_baseline`` holds the repos that have a baseline.
    """
    keys = ["repo", "doc", "section", "section_ord"]
    is_ref = F.col("path").isNotNull() & (F.col("path") != "")
    hit = is_ref & F.col("changed")
    counted = changes.groupBy(*keys).agg(
        F.count_if(is_ref).alias("n_refs"),
        F.count_if(hit).alias("n_changed"),
        F.sort_array(F.collect_set(F.when(hit, F.col("path")))).alias("changed_refs"),
    )
    marked = counted.join(has_baseline.select("repo", F.lit(True).alias("_b")).distinct(), "repo", "left")
    status = (
        F.when((F.col("n_refs") == 0) | F.col("_b").isNull(), "possibly-stale")
        .when(F.col("n_changed") == 0, "current")
        .otherwise("stale")
    )
    return marked.select(*keys, status.alias("status"), "n_refs", "n_changed", "changed_refs")


def overall_status(status: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Overall state per repo; repos given without any section are ``no_docs``."""
    counts = status.groupBy("repo").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in ("current", "possibly-stale", "stale")],
    )
    if repos is not None:
        counts = repos.select("repo").distinct().join(counts, "repo", "left").fillna(0)
    overall = (
        F.when(F.col("total") == 0, "no_docs")
        .when(F.col("stale") > F.floor(F.col("total") / 2), "very-stale")
        .when(F.col("stale") > 0, "stale")
        .when(F.col("possibly_stale") > 0, "slightly-stale")
        .otherwise("current")
    )
    return counts.select("repo", overall.alias("overall"), "total", "current", "possibly_stale", "stale")
