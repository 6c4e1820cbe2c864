"""Usage events, document versions and benchmark runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions.text import int_div
from corpusloom.operators.filters import consented
from corpusloom.runtime import ordered_lag


def command_counts(events: DataFrame) -> DataFrame:
    return consented(events).groupBy("command").agg(F.count("*").alias("n"))


def language_distribution(repo_languages: DataFrame) -> DataFrame:
    """Repos per language, from (repo, language)."""
    return repo_languages.groupBy("language").agg(F.countDistinct("repo").alias("repos"))


def size_bucket(lines: Column) -> Column:
    rule = None
    for name, bound in fv.SIZE_BUCKETS:
        rule = F.when(lines < bound, name) if rule is None else rule.when(lines < bound, name)
    return rule.otherwise("large")


def size_buckets(files: DataFrame) -> DataFrame:
    """Repos per size class. A repo is first reduced to one number, map-side."""
    sized = files.groupBy("repo").agg(F.sum("n_lines").alias("lines"))
    return sized.groupBy(size_bucket(F.col("lines")).alias("bucket")).agg(F.count("*").alias("repos"), F.sum("lines").alias("lines"))


def tag_snapshots(tags: DataFrame, versions: DataFrame) -> DataFrame:
    """Each tag with whether documentation was stored for it."""
    stored = versions.select("repo", "tag").distinct().withColumn("_s", F.lit(True))
    return tags.join(stored, ["repo", "tag"], "left").select("repo", "tag", F.col("_s").isNotNull().alias("has_snapshot"))


def current_version(versions: DataFrame, switches: DataFrame | None = None) -> DataFrame:
    """The version in force: the last explicit switch, else the first stored snapshot."""
    first = versions.groupBy("repo").agg(F.min_by("tag", F.struct("created", "tag")).alias("_first"))
    if switches is None:
        return first.select("repo", F.col("_first").alias("current"))
    last = switches.groupBy("repo").agg(F.max_by("tag", F.struct("switched_at", "tag")).alias("_last"))
    return first.join(last, "repo", "full").select("repo", F.coalesce("_last", "_first").alias("current"))


def bench_compare(runs: DataFrame) -> DataFrame:
    """Each run against the one before it, per stage: difference, whole percent and direction."""
    coarse = F.date_trunc("day", F.col("run_ts"))
    lagged = ordered_lag(runs.select("run_ts", "stage", "ms"), ["stage"], ["run_ts"], ["ms"], coarse)
    none = F.coalesce(F.col("prev_ms") == 0, F.lit(True))
    diff = F.col("ms") - F.col("prev_ms")
    return lagged.select(
        "stage", "run_ts", "ms", "prev_ms", F.when(~none, diff).alias("diff_ms"),
        F.when(~none, int_div(F.abs(diff) * 100, F.nullif(F.col("prev_ms"), F.lit(0)))).alias("percent"),
        F.when(none, "no previous data").when(F.col("ms") <= F.col("prev_ms"), "faster").otherwise("slower").alias("direction"),
    )
