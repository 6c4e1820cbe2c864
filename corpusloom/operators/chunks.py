"""Size-bounded chunks and token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions import budget as B
from corpusloom.functions import text as T
from corpusloom.runtime import ordered_sum

ENTRY_GROUP = "entry-points"


def entry_point_files(files: DataFrame, entry_points: DataFrame) -> DataFrame:
    """Files that are entry points, by equality of the path."""
    return files.join(entry_points.select("repo", "path").distinct(), ["repo", "path"], "left_semi")


def order_files(
    files: DataFrame,
    priority: str = "entry-points-first",
    entry_points: DataFrame | None = None,
    changes: DataFrame | None = None,
) -> DataFrame:
    """Add ``prio``, smaller first: entry points, most changed files, or nothing but the name."""
    if priority == "entry-points-first" and entry_points is not None:
        marks = entry_points.select("repo", "path", F.lit(0).cast("bigint").alias("prio")).distinct()
        return files.join(marks, ["repo", "path"], "left").withColumn("prio", F.coalesce("prio", F.lit(1).cast("bigint")))
    if priority == "change-frequency" and changes is not None:
        counts = changes.select("repo", "path", (-F.col("changes")).cast("bigint").alias("prio"))
        return files.join(counts, ["repo", "path"], "left").withColumn("prio", F.coalesce("prio", F.lit(0).cast("bigint")))
    return files.withColumn("prio", F.lit(0).cast("bigint"))


def assign_chunks(
    files: DataFrame,
    entry_points: DataFrame | None = None,
    max_files: int = fv.MAX_FILES_PER_CHUNK,
) -> DataFrame:
    """Each file with its group (entry points or directory) and the piece of that group it falls into."""
    narrow = files.select("repo", "path", "n_lines")
    path = F.col("path")
    directory = T.dirname(path)
    if entry_points is None:
        grouped = narrow.withColumn("grp", directory).withColumn("grp_rank", F.lit(1))
    else:
        marks = entry_points.select("repo", "path", F.lit(True).alias("_e")).distinct()
        grouped = (
            narrow.join(marks, ["repo", "path"], "left")
            .withColumn("grp_rank", F.when(F.col("_e"), 0).otherwise(1))
            .withColumn("grp", F.when(F.col("_e"), ENTRY_GROUP).otherwise(directory))
            .drop("_e")
        )
    numbered = ordered_sum(
        grouped, ["repo", "grp_rank", "grp"], [F.col("path")], F.lit(1), "_n", path.substr(F.lit(1), F.length("grp") + 3)
    )
    return numbered.withColumn("piece", B.int_div(F.col("_n") - 1, max_files)).drop("_n")


def index_chunks(assigned: DataFrame) -> DataFrame:
    """Zero-based chunk index and name per repo: entry points, then directories in order.

    The order is resolved on one row per group (its number of pieces); files only look their offset up.
    """
    groups = assigned.groupBy("repo", "grp_rank", "grp").agg((F.max("piece") + 1).alias("pieces"))
    offsets = ordered_sum(
        groups, ["repo"], [F.col("grp_rank"), F.col("grp")], F.col("pieces"), "_end", F.struct("grp_rank", F.substring("grp", 1, 8))
    ).select("repo", "grp_rank", "grp", (F.col("_end") - F.col("pieces")).alias("_offset"))
    index = F.col("_offset") + F.col("piece")
    name = F.when(F.col("piece") == 0, F.col("grp")).otherwise(F.concat_ws("-", "grp", index.cast("string")))
    return (
        assigned.join(offsets, ["repo", "grp_rank", "grp"])
        .withColumn("chunk_index", index).withColumn("name", name).drop("_offset")
    )


def chunk_totals(indexed: DataFrame) -> DataFrame:
    """Files, lines and tokens per chunk, with the file list (at most the chunk size long)."""
    return (
        indexed.groupBy("repo", "chunk_index", "name")
        .agg(
            F.count("*").alias("n_files"), F.sum("n_lines").alias("n_lines"),
            F.sort_array(F.collect_list("path")).alias("files"),
        )
        .withColumn("est_tokens", B.chunk_tokens(F.col("n_lines")))
        .select("repo", "chunk_index", "name", "n_files", "n_lines", "est_tokens", "files")
    )


def plan_totals(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("repo").agg(
        F.sum("n_files").alias("total_files"), F.count("*").alias("chunks"), F.sum("n_lines").alias("total_lines"),
        F.sum("est_tokens").alias("total_est_tokens"),
    )


def estimate_budget(
    files: DataFrame,
    languages: DataFrame,
    preset: str = "balanced",
    profile: str | None = None,
    budget: int | None = None,
    oversize: int = fv.OVERSIZE_LINES,
    chunk_size: int = fv.MAX_FILES_PER_CHUNK,
    **limits: int | None,
) -> DataFrame:
    """Tokens per pass, total and decision per repo; ``languages`` is (repo, languages array)."""
    rule = B.resolve_preset(preset, profile)
    sized = files.groupBy("repo").agg(
        F.count("*").alias("files"), F.sum("n_lines").alias("lines"),
        F.count_if(F.col("n_lines") > oversize).alias("oversized"),
    )
    empty: Column = F.array().cast("array<string>")
    with_lang = sized.join(languages.select("repo", "languages"), "repo", "left")
    passes = B.estimate_tokens(F.col("lines"), F.coalesce("languages", empty), rule["profile"])
    return (
        with_lang.withColumn("passes", passes)
        .withColumn("total", B.pass_total(F.col("passes")))
        .select(
            "repo", "files", "lines",
            F.greatest(B.int_div(F.col("files") + (chunk_size - 1), chunk_size), F.lit(1)).alias("chunks"),
            "oversized", "passes", "total",
            B.budget_decision(F.col("total"), preset, budget, **limits).alias("decision"),
        )
    )


def cost_report(states: DataFrame, files: DataFrame, languages: DataFrame, profile: str = "standard") -> DataFrame:
    """Analysis tokens with and without the cache, per repo: only changed files are read again."""
    sized = (
        files.select("repo", "path", "n_lines").join(states.select("repo", "path", "state"), ["repo", "path"])
        .groupBy("repo")
        .agg(F.sum("n_lines").alias("lines"),
             F.coalesce(F.sum(F.when(F.col("state") == "changed", F.col("n_lines"))), F.lit(0)).alias("changed_lines"))
        .join(languages.select("repo", "languages"), "repo", "left")
    )
    empty = F.array().cast("array<string>")
    langs = F.coalesce("languages", empty)
    full = B.estimate_tokens(F.col("lines"), langs, profile)
    net = B.estimate_tokens(F.col("changed_lines"), langs, profile)
    return sized.withColumn("full", full).withColumn("net", net).select(
        "repo",
        F.col("full.analysis").alias("analysis_tokens"), F.col("full.generation").alias("generation_tokens"),
        F.col("full.review").alias("review_tokens"), B.pass_total(F.col("full")).alias("total_tokens"),
        (B.pass_total(F.col("full")) - B.pass_total(F.col("net"))).alias("saved_tokens"),
        B.pass_total(F.col("net")).alias("net_tokens"),
    )
