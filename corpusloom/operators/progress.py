"""Milestone items and what the code says about them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.filters import pending_items
from corpusloom.operators.paths import known_paths

#: Rules that one row holds; a repo with more has several rows.
RULES_PER_SET = 256
#: Seconds that one search may take before its rule counts as an error.
SEARCH_SECONDS = 10.0
#: Compiled rules that a task keeps.
COMPILED = 10_000


def required_text(rule: str) -> str:
    """The longest run of plain characters that every match of a rule holds; '' where none is sure."""
    best, run, depth, k = "", "", 0, 0
    if "(?" in rule or "[[" in rule:
        return ""
    while k < len(rule):
        c = rule[k]
        plain = None
        if c == "\\":
            k += 1
            if k < len(rule) and not rule[k].isalnum():
                plain = rule[k]
        elif c == "[":
            k = rule.find("]", k + 2 if rule[k + 1 : k + 2] != "^" else k + 3)
            if k < 0:
                return ""
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|":
            if not depth:
                return ""
        elif c in "?*{":
            run = run[:-1]
            if c == "{":
                k = rule.find("}", k)
                if k < 0:
                    return ""
        elif c not in ".^$+":
            plain = c
        if plain is not None and not depth:
            run += plain
        else:
            best, run = max(best, run, key=len), ""
        k += 1
    return max(best, run, key=len)


def compiled(rule: str):
    import regex

    return regex.compile(rule, regex.MULTILINE)


def checked_rules(items: DataFrame) -> DataFrame:
    """Distinct search rules: (repo, regex, root, needle, error). Each is compiled once here; a rule that is no regular
    expression carries its error."""

    @F.pandas_udf("needle string, error string")
    def inspect(rules: pd.Series) -> pd.DataFrame:
        out = []
        for rule in rules:
            try:
                compiled(rule)
                out.append((required_text(rule), None))
            except Exception as e:
                out.append(("", f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["needle", "error"])

    rules = items.filter((F.col("detect_type") == "grep") & F.col("detect_value").isNotNull()).select(
        "repo", F.col("detect_value").alias("regex"), F.coalesce("detect_path", F.lit(".")).alias("root")).distinct()
    return rules.withColumn("i", inspect("regex")).select("repo", "regex", "root", "i.needle", "i.error")


def grep_states(items: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, regex, root, state) of search rules that match any file below their root (``found``) or that can't be
    searched (``error``).

    One pass over the texts: each meets the rules of its repo, of which those stay whose required text it holds; only
    for them it goes on to the compiled rules, which a task keeps. Rules go to the texts by broadcast as long as Spark's
    size estimate allows it, else both meet by repo. No job runs to find that out.
    """
    rules = checked_rules(items)
    usable = rules.filter("error IS NULL").drop("error")
    sizes = usable.groupBy("repo").agg(F.ceil(F.count("*") / RULES_PER_SET).cast("int").alias("_sets"))
    dealt = usable.join(sizes, "repo").withColumn("set", F.pmod(F.xxhash64("regex", "root"), F.col("_sets")))
    sets = dealt.groupBy("repo", "set").agg(F.collect_list(F.struct("regex", "root", "needle")).alias("rules"))
    below = lambda root: (root == ".") | (F.col("path") == root) | F.startswith(F.col("path"), F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))
    hopeful = F.filter("rules", lambda r: below(r["root"]) & F.contains(F.col("content"), r["needle"]))
    met = files.select("repo", "path", "content").join(sets, "repo").select("repo", "content", hopeful.alias("rules")).filter(F.size("rules") > 0)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patterns, known = {}, set()
        for frame in frames:
            out = []
            for repo, content, some in zip(frame["repo"], frame["content"], frame["rules"], strict=True):
                for rule in some:
                    key = (repo, rule["regex"], rule["root"])
                    if key in known:
                        continue
                    if rule["regex"] not in patterns:
                        if len(patterns) >= COMPILED:
                            patterns.clear()
                        patterns[rule["regex"]] = compiled(rule["regex"])
                    try:
                        if patterns[rule["regex"]].search(content, timeout=SEARCH_SECONDS) is None:
                            continue
                        out.append((*key, "found"))
                    except TimeoutError:
                        out.append((*key, "error"))
                    known.add(key)
            yield pd.DataFrame(out, columns=["repo", "regex", "root", "state"])

    hits = met.mapInPandas(search, "repo string, regex string, root string, state string")
    broken = rules.filter("error IS NOT NULL").select("repo", "regex", "root", F.lit("error").alias("state"))
    # A rule that matched somewhere is found, also where another search of it took too long.
    return hits.unionByName(broken).groupBy("repo", "regex", "root").agg(F.max("state").alias("state"))


def detect_progress(items: DataFrame, files: DataFrame, exports: DataFrame) -> DataFrame:
    """Every item with its new status: ``detected`` marks pending items that the code shows to be done, ``error`` pending
    ones whose search rule is no regular expression or takes too long.

    Three semi-joins by rule type. Items without a known rule stay as they are.
    """
    pending = pending_items(items)
    by_type = lambda t: pending.filter(F.col("detect_type") == t)
    keys = ["repo", "milestone", "item"]
    wanted = by_type("file_exists").withColumn("path", F.regexp_replace("detect_value", r"(.)/+$", "$1"))
    exist = wanted.join(known_paths(files), ["repo", "path"], "left_semi").select(*keys)
    hits = grep_states(pending, files)
    searched = by_type("grep").withColumn("regex", F.col("detect_value")).withColumn("root", F.coalesce("detect_path", F.lit(".")))
    grep = searched.join(hits, ["repo", "regex", "root"]).select(*keys, F.col("state").alias("_found"))
    names = exports.filter("name is not null").select(F.col("repo").alias("_repo"), F.col("name").alias("_name"), F.col("path").alias("_path"))
    rule = by_type("export_exists")
    root = F.rtrim(F.coalesce(rule["detect_path"], F.lit(".")), F.lit("/"))
    where = (rule["repo"] == F.col("_repo")) & (rule["detect_value"] == F.col("_name")) & (
        (root == ".") | (F.col("_path") == root) | F.startswith(F.col("_path"), F.concat(root, F.lit("/"))))
    exported = rule.join(names, where, "left_semi").select(*keys)
    found = exist.unionByName(exported).withColumn("_found", F.lit("found")).unionByName(grep).groupBy(*keys).agg(F.max("_found").alias("_found"))
    done = F.col("status") == "done"
    detected = F.coalesce(F.col("_found") == "found", F.lit(False)) & ~done
    failed = F.coalesce(F.col("_found") == "error", F.lit(False)) & ~done
    return items.join(found, keys, "left").select(
        *items.columns[: items.columns.index("status")],
        F.when(detected, "done").otherwise(F.col("status")).alias("status"),
        F.when(detected, "detected").when(failed, "error").when(done, "done").otherwise("pending").alias("state"),
        *items.columns[items.columns.index("status") + 1:],
    )


def progress_report(detected: DataFrame) -> DataFrame:
    """Totals and whole-number completion per milestone and per repo (grouping sets). What failed is still pending."""
    is_done = F.col("state").isin("done", "detected")
    counts = detected.groupingSets([[F.col("repo"), F.col("milestone")], [F.col("repo")]], "repo", "milestone").agg(
        F.count("*").alias("total"), F.count_if(is_done).alias("done"),
        F.count_if(~is_done).alias("pending"), F.count_if(F.col("state") == "detected").alias("newly_detected"),
    )
    return counts.withColumn("milestone", F.coalesce("milestone", F.lit("TOTAL"))).withColumn(
        "percent", T.pct_trunc(F.col("done"), F.col("total")))
