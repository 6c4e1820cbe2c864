"""Secret findings and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed_values as fv
from corpusloom.fixed_values import SecretPattern
from corpusloom.operators.filters import any_of, skip_non_code

def patterns_from_table(patterns: DataFrame) -> list[SecretPattern]:
    """A pattern dictionary as a list, so that every regex is a literal compiled once per task."""
    rows = patterns.orderBy("pattern_id").collect()
    return [SecretPattern(r["pattern_id"], r["name"], r["regex"], r["severity"]) for r in rows]


def may_hold(text: Column, pattern: SecretPattern, whole: bool = False) -> Column:
    """Whether a line matches; the regex only runs where one of the pattern's needles is found by a byte search. A
    ``whole`` text is tested for its lines: ``^`` and ``$`` stand for their ends."""
    match = text.rlike(("(?m)" if whole else "") + pattern.regex)
    return any_of([text.contains(n) for n in pattern.needles]) & match if pattern.needles else match


def scan_secrets(files: DataFrame, patterns: list[SecretPattern] | None = None) -> DataFrame:
    """One finding per (line, pattern).

    Map-only: a file is first tested as a whole, which leaves the patterns it can match at all; only such files
    are split, and the hits of a line fan out from a small array. Nothing is joined or shuffled.
    """
    chosen = patterns or fv.SECRET_PATTERNS
    text = F.col("content")
    lines = (
        skip_non_code(files)
        .filter(any_of([may_hold(text, p, whole=True) for p in chosen]))
        .select("repo", "path", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    )
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    may_hold(F.col("text"), p),
                    F.struct(F.lit(p.pattern_id).alias("pattern_id"), F.lit(p.name).alias("pattern"),
                             F.lit(p.severity).alias("severity")),
                )
                for p in chosen
            ]
        )
    )
    return lines.select("repo", "path", (F.col("pos") + 1).alias("line"), F.explode(hits).alias("hit")).select(
        "repo", "path", "line", "hit.pattern_id", "hit.pattern", "hit.severity", F.lit(True).alias("redacted")
    )


def redact(content: Column, patterns: list[SecretPattern] | None = None) -> Column:
    """Replace every secret by a note that names its kind, line by line as they are found; texts without any needle
    are passed through untouched."""
    chosen = patterns or fv.SECRET_PATTERNS

    def clean(line: Column) -> Column:
        for p in chosen:
            line = F.regexp_replace(line, p.regex, f"[REDACTED: {p.name} detected]")
        return line

    cleaned = F.array_join(F.transform(F.split(content, "\n"), clean), "\n")
    if not all(p.needles for p in chosen):
        return cleaned
    return F.when(any_of([content.contains(n) for p in chosen for n in p.needles]), cleaned).otherwise(content)


def secret_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo", "pattern").agg(
        F.count("*").alias("found"), F.sum(F.col("redacted").cast("bigint")).alias("redacted"),
        F.countDistinct("path").alias("files"),
    )
