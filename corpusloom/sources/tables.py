"""Saved tables: manifests, baselines, caches, versions, milestones, findings, telemetry and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.operators import snapshots as SN
from corpusloom.sources import levels as LV


def write_manifest(files: DataFrame, path: str, snapshot_ts: Column) -> None:
    """Append the hash of every file as one snapshot."""
    LV.append_level(SN.file_hashes(files).withColumn("snapshot_ts", snapshot_ts), path, snapshot_ts)


def read_manifest(spark: SparkSession, path: str, as_of: Column | None = None, repos: list[str] | None = None) -> DataFrame:
    """Newest hash per file, from the newest compacted state and what was written since."""
    return _newest(spark, path, schemas.MANIFEST, ["repo", "path"], "snapshot_ts", as_of, repos)


def compact_manifest(spark: SparkSession, path: str, upto: Column | None = None) -> None:
    LV.compact(spark, path, schemas.MANIFEST, ["repo", "path"], "snapshot_ts", upto)


def save_baseline(refs: DataFrame, files: DataFrame, path: str, saved_at: Column) -> None:
    """Append the hash of every distinct referenced path that exists now; only what is referenced is read."""
    LV.append_level(SN.baseline_rows(refs, files, saved_at), path, saved_at)


def read_baseline(spark: SparkSession, path: str, as_of: Column | None = None, repos: list[str] | None = None) -> DataFrame:
    """Newest saved hash per referenced path; empty when nothing was ever saved."""
    return _newest(spark, path, schemas.BASELINE, ["repo", "ref_path"], "saved_at", as_of, repos)


def compact_baseline(spark: SparkSession, path: str, upto: Column | None = None) -> None:
    LV.compact(spark, path, schemas.BASELINE, ["repo", "ref_path"], "saved_at", upto)


def _newest(spark: SparkSession, path: str, schema: str, keys: list[str], ts: str, as_of: Column | None, repos: list[str] | None) -> DataFrame:
    if LV.is_leveled(spark, path):
        return LV.read_levels(spark, path, schema, keys, ts, as_of, repos)
    # A folder of plain appends.
    saved = spark.read.schema(schema).parquet(path)
    return SN.latest_snapshot(saved if repos is None else saved.filter(F.col("repo").isin(repos)), keys, ts, as_of)


def cache_lookup(hashes: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached analysis by content hash, NULL payload on a miss."""
    return hashes.join(cache.select("sha256", "payload"), "sha256", "left")


def cache_store(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Cache with new entries added; the first payload stored for a hash stays."""
    aged = cache.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    return aged.groupBy("sha256").agg(F.min(F.struct("_age", "payload"))["payload"].alias("payload"))


def snapshot_docs(docs: DataFrame, path: str, tag: str, created: Column, source: str = "docs") -> None:
    """Store documents under a version tag; storing a tag again replaces that tag only."""
    (
        docs.select("repo", "doc", "content", created.alias("created"), F.lit(source).alias("source"), F.lit(tag).alias("tag"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tag").parquet(path)
    )


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    schema = "repo string, doc string, content string, created timestamp, source string, tag string"
    return spark.read.schema(schema).parquet(path)


def read_milestones(states: DataFrame) -> DataFrame:
    """Milestone JSON (repo, content) as one row per item with its detect rule."""
    parsed = states.select("repo", F.from_json("content", schemas.MILESTONES)["milestones"].alias("m"))
    items = parsed.select("repo", F.posexplode("m").alias("milestone_ord", "m")).select(
        "repo", "milestone_ord", F.col("m.name").alias("milestone"), F.posexplode("m.items").alias("item_ord", "i")
    )
    d = "i.detect"
    kind = (
        F.when(F.col(f"{d}.export_exists").isNotNull(), "export_exists")
        .when(F.col(f"{d}.grep").isNotNull(), "grep")
        .when(F.col(f"{d}.file_exists").isNotNull(), "file_exists")
    )
    return items.select(
        "repo", "milestone", F.col("i.name").alias("item"), F.col("i.status").alias("status"), kind.alias("detect_type"),
        F.coalesce(f"{d}.export_exists", f"{d}.grep", f"{d}.file_exists").alias("detect_value"),
        F.col(f"{d}.grep_path").alias("detect_path"),
    )


def write_milestones(items: DataFrame, path: str, updated_at: Column) -> None:
    """Write the items with their new statuses as a new snapshot."""
    items.withColumn("updated_at", updated_at).write.mode("append").json(path)


def read_findings(blocks: DataFrame) -> DataFrame:
    """Findings blocks (repo, text) of ``KEY: value`` lines as rows with a data map and a findings list."""
    value = lambda key: F.nullif(F.trim(F.regexp_extract("text", rf"(?m)^{key}:[ \t]*(.*)$", 1)), F.lit(""))
    listed = F.regexp_extract("text", r"(?ms)^FINDINGS:[^\n]*\n(.*?)(?=^[A-Z=]|\z)", 1)
    data = F.regexp_extract("text", r"(?ms)^DATA:[^\n]*\n(.*?)(?=^[A-Z=]|\z)", 1)
    pair = r"(?m)^\s+([A-Za-z0-9_]+):[ \t]*(.*?)[ \t]*$"
    names = F.regexp_extract_all(data, F.lit(pair), F.lit(1))
    values = F.regexp_extract_all(data, F.lit(pair), F.lit(2))
    keys = F.array_distinct(names)
    mapped = F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(values, (F.array_position(names, k) - 1).cast("int"))))
    return blocks.select(
        "repo", value("ANALYZER").alias("analyzer"), value("CONFIDENCE").try_cast("double").alias("confidence"),
        F.regexp_extract_all(listed, F.lit(r"(?m)^\s*-\s+(.*?)[ \t]*$"), F.lit(1)).alias("findings"), mapped.alias("data"),
    )


def append_telemetry(events: DataFrame, path: str) -> None:
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def write_report(report: DataFrame, path: str, fmt: str = "json") -> None:
    report.write.mode("overwrite").format(fmt).save(path)


def ci_lines(overall: DataFrame, has_baseline: DataFrame, prefix: str = "DOCS") -> DataFrame:
    """Machine-readable ``KEY=value`` lines per repo for a build log."""
    marked = overall.join(has_baseline.select("repo", F.lit("present").alias("_b")).distinct(), "repo", "left")
    template = f"{prefix}_STATUS=%s\n{prefix}_STALE_COUNT=%d\n{prefix}_TOTAL_SECTIONS=%d\n{prefix}_BASELINE=%s"
    return marked.select(
        "repo", F.format_string(template, F.col("overall"), F.col("stale"), F.col("total"), F.coalesce("_b", F.lit("missing"))).alias("report"),
    )
