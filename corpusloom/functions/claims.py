"""Claims found in documentation prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions import text as T


FRAMEWORK_NAMES = fv.VERSION_CLAIM_NAMES


def doc_endpoint_mentions(content: Column) -> Column:
    """Number of lines that mention ``METHOD /path``."""
    return T.matching_lines(content, fv.DOC_ENDPOINT_MENTION, fv.DOC_ENDPOINT_NEEDLES)


def count_claim_digits(content: Column) -> Column:
    """Every ``N endpoints`` style claim in text order, as digits without leading zeros: a claim may have any length."""
    found = F.regexp_extract_all(T.candidate_lines(content, ["endpoint", "route", "api"], True), F.lit(fv.COUNT_CLAIM), F.lit(1))
    return F.transform(found, lambda n: F.regexp_replace(n, r"^0+(?=[0-9])", ""))


def count_claims(content: Column) -> Column:
    """The claims as whole numbers; one that no long can hold is NULL here."""
    return F.transform(count_claim_digits(content), lambda n: n.try_cast("bigint"))


def version_claims(content: Column) -> Column:
    """Every ``Framework N`` claim as (name, major)."""
    lines = T.candidate_lines(content, FRAMEWORK_NAMES, True)
    names = F.regexp_extract_all(lines, F.lit(fv.VERSION_CLAIM), F.lit(1))
    majors = F.regexp_extract_all(lines, F.lit(fv.VERSION_CLAIM), F.lit(2))
    return F.transform(
        F.arrays_zip(names.alias("name"), majors.alias("major")),
        lambda c: F.struct(F.lower(c["name"]).alias("name"), c["major"].try_cast("bigint").alias("major")),
    )


def first_int(version: Column) -> Column:
    """First whole number in a version range (``^4.18.2`` gives 4)."""
    return F.regexp_extract(version, r"([0-9]+)", 1).try_cast("bigint")


def mentioned_paths(content: Column) -> Column:
    lines = T.candidate_lines(content, ["/"])
    return F.array_distinct(F.regexp_extract_all(lines, F.lit(fv.MENTIONED_PATH), F.lit(0)))


def decision_reason(subject: Column, files: Column, insertions: Column, deletions: Column) -> Column:
    """Why a commit is a decision; size rules first, then keywords in their fixed order, else NULL."""
    lowered = F.lower(subject)
    churn = F.coalesce(insertions, F.lit(0)) + F.coalesce(deletions, F.lit(0))
    rule = F.when(files >= fv.LARGE_REFACTOR_FILES, "large-refactor").when(
        churn >= fv.LARGE_CHANGE_LINES, "large-change"
    )
    for reason, pattern in fv.DECISION_KEYWORDS:
        rule = rule.when(lowered.rlike(pattern), reason)
    return rule
