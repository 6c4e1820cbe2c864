"""Paths, hashes, globs, references and document markers."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_NAMESPACE = "docs"


def content_hash(content: Column) -> Column:
    """SHA-256 of the bytes, as 64 lower-case hex digits."""
    return F.sha2(content, 256)


def short_hash(commit: Column) -> Column:
    return F.substring(commit, 1, 12)


def line_count(content: Column) -> Column:
    """Number of newline characters (a last line without newline is not counted)."""
    return (F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))).cast("int")


def holds_any(text: Column, needles: Sequence[str]) -> Column:
    """Whether any of some plain texts occurs: byte searches, far cheaper than a regex. No needles means maybe."""
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles]) if needles else F.lit(True)


def line_matches(line: Column, pattern: str, needles: Sequence[str] = ()) -> Column:
    """A regex on one line that only runs where one of its needles occurs."""
    return holds_any(line, needles) & line.rlike(pattern) if needles else line.rlike(pattern)


def matching_lines(content: Column, pattern: str, needles: Sequence[str] = ()) -> Column:
    """How many lines match, counted inside the row: lines never become rows and are never shuffled."""
    lines = F.filter(F.split(content, "\n"), lambda line: line_matches(line, pattern, needles))
    counted = F.size(lines).cast("bigint")
    return F.when(holds_any(content, needles), counted).otherwise(F.lit(0).cast("bigint")) if needles else counted


def candidate_lines(content: Column, needles: Sequence[str], ignore_case: bool = False) -> Column:
    """The lines in which a needle occurs, as one text; regexes on it skip everything else."""
    seen = lambda line: holds_any(F.lower(line) if ignore_case else line, needles)
    return F.array_join(F.filter(F.split(content, "\n"), seen), "\n")


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """Base name up to its first dot after the first character (``users.test.js`` gives ``users``)."""
    return F.regexp_extract(basename(path), r"^(\.?[^.]*)", 1)


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)


def ancestors(path: Column) -> Column:
    """Every directory above a path, root (``.``) first."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    nested = F.when(
        depth > 0,
        F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit(".")), nested)


def parse_ref(ref: Column) -> Column:
    """``path:12-40`` as (path, line_start, line_end); the line range is optional."""
    text = F.trim(ref)
    return F.struct(
        F.trim(F.regexp_replace(text, r":[0-9].*$", "")).alias("path"),
        F.regexp_extract(text, r":([0-9]+)", 1).try_cast("int").alias("line_start"),
        F.regexp_extract(text, r":[0-9]+-([0-9]+)", 1).try_cast("int").alias("line_end"),
    )


def split_refs(refs: Column) -> Column:
    return F.filter(F.transform(F.split(refs, ","), lambda r: F.trim(r)), lambda r: r != "")


def ref_path(ref: Column) -> Column:
    """The path of a reference, without line range and without a trailing slash."""
    return F.regexp_replace(parse_ref(ref)["path"], r"(.)/+$", "$1")


def marker_start(line: Column, namespace: str = DEFAULT_NAMESPACE) -> Column:
    return F.nullif(F.regexp_extract(line, rf"<!-- {re.escape(namespace)}:start:([^ >\n]*)", 1), F.lit(""))


def marker_refs(line: Column, namespace: str = DEFAULT_NAMESPACE) -> Column:
    return F.nullif(F.regexp_extract(line, rf"<!-- {re.escape(namespace)}:refs:([^>\n]*) -->", 1), F.lit(""))


def marker_end(line: Column, namespace: str = DEFAULT_NAMESPACE) -> Column:
    return F.nullif(F.regexp_extract(line, rf"<!-- {re.escape(namespace)}:end:([^ >\n]*)", 1), F.lit(""))


def slug(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def four_digits(number: Column) -> Column:
    """At least four digits; larger numbers keep all of theirs."""
    digits = number.cast("string")
    return F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)


def adr_path(number: Column, title: Column) -> Column:
    return F.concat(four_digits(number), F.lit("-"), slug(title), F.lit(".md"))


def glob_body(glob: str) -> str:
    """A shell glob as an unanchored regular expression; ``*`` crosses ``/``."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        close = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            inside = glob[i + 1:close].replace("\\", "\\\\")
            out.append("[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]")
            i = close
        else:
            out.append(re.escape(ch) if ch in r"\.^$+{}()|[]" else ch)
        i += 1
    return re.sub(r"(\.\*)+", ".*", "".join(out))


def glob_regex(glob: str) -> str:
    return "^" + glob_body(glob) + "$"


def glob_match(path: Column, glob: str) -> Column:
    return path.rlike(glob_regex(glob))


def frontmatter(content: Column, key: str) -> Column:
    """A value from a ``---`` header block, else from a ``# key: value`` comment; NULL when absent."""
    name = re.escape(key)
    block = F.regexp_extract(content, r"(?s)\A\s*---\n(.*?)\n---", 1)
    fenced = F.regexp_extract(block, rf"(?m)^{name}:[ \t]*(.*)$", 1)
    comment = F.regexp_extract(content, rf"(?m)^#[ \t]*{name}:[ \t]*(.*)$", 1)
    return F.coalesce(F.nullif(F.trim(fenced), F.lit("")), F.nullif(F.trim(comment), F.lit("")))


def is_fresh(ts: Column, now: Column, ttl_seconds: int = 3600) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(ts) <= ttl_seconds


def int_div(a: Column, b: Column | int) -> Column:
    """Whole-number division towards zero."""
    divisor = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a.cast("bigint"), divisor.cast("bigint"))


def pct_trunc(part: Column, whole: Column) -> Column:
    """Percentage truncated to a whole number, 0 when there is nothing to count."""
    return F.when(whole > 0, int_div(part.cast("bigint") * 100, F.nullif(whole, F.lit(0)))).otherwise(F.lit(0).cast("bigint"))


def pct_trunc1(part: Column, whole: Column) -> Column:
    """Percentage truncated to one decimal; NULL when the whole is zero."""
    tenths = int_div(part.cast("bigint") * 1000, F.nullif(whole, F.lit(0)))
    return (tenths.cast("decimal(18,0)") / F.lit(10).cast("decimal(2,0)")).cast("decimal(18,1)")
