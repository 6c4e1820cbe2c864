"""Exported commit logs, pull requests, issues and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import schemas

HEADER = r"(?m)^([a-f0-9]{7,64}\|[^|\n]*\|[^|\n]*\|.*)$"


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits from log exports (``hash|date|author|subject`` with a shortstat line), one file per repository.

    A blank line ends a commit that has statistics, so it is the record separator: the text stays splittable
    and a commit never has to be matched with its statistics across rows. A block may hold several headers
    (commits without changes); the statistics belong to its last one.
    """
    blocks = spark.read.option("lineSep", "\n\n").text(path).select(
        _repo_of_file().alias("repo"), "value"
    )
    return parse_commit_blocks(blocks)


def parse_commit_blocks(blocks: DataFrame) -> DataFrame:
    headers = F.regexp_extract_all("value", F.lit(HEADER), F.lit(1))
    stat = F.regexp_extract("value", r"(?m)^ *([0-9]+ files? changed.*)$", 1)
    rows = blocks.select("repo", stat.alias("stat"), F.size(headers).alias("n"), F.posexplode(headers).alias("pos", "header"))
    own = F.col("pos") == F.col("n") - 1
    number = lambda p: F.when(own, F.coalesce(F.regexp_extract("stat", p, 1).try_cast("bigint"), F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    part = F.split("header", r"\|", 4)
    return rows.select(
        "repo",
        part[0].alias("hash"), part[1].try_cast("timestamp").alias("ts"), part[2].alias("author"), part[3].alias("subject"),
        part[3].rlike(r"^Merge (branch|pull request|remote|tag|commit)").alias("is_merge"),
        number(r"([0-9]+) files?").alias("files"), number(r"([0-9]+) insertion").alias("insertions"),
        number(r"([0-9]+) deletion").alias("deletions"),
    )


def _repo_of_file() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[A-Za-z]+)?$", 1)


def read_commit_files(spark: SparkSession, path: str) -> DataFrame:
    """(repo, hash, path) from exports of ``git log --format=%x00%H --name-only``, one file per repository.

    The zero byte before each hash separates the records, so a commit and its paths are one splittable row.
    """
    records = spark.read.option("lineSep", "\0").text(path).select(_repo_of_file().alias("repo"), F.split("value", "\n").alias("lines"))
    paths = F.filter(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))), lambda x: F.trim(x) != "")
    hashed = records.filter(F.col("lines")[0].rlike("^[a-f0-9]{7,64}$"))
    return hashed.select("repo", F.col("lines")[0].alias("hash"), F.explode(F.array_distinct(paths)).alias("path"))


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """(repo, tag, ts) from exports of ``git for-each-ref --format='%(refname:short)|%(creatordate:iso-strict)' refs/tags``,
    one file per repository. The last separator counts, as a tag may hold one itself."""
    lines = spark.read.text(path).select(_repo_of_file().alias("repo"), "value")
    parts = lambda group: F.regexp_extract("value", r"^(.+)\|([^|]+)$", group)
    return lines.filter(parts(1) != "").select("repo", parts(1).alias("tag"), parts(2).try_cast("timestamp").alias("ts"))


def read_prs(spark: SparkSession, path: str) -> DataFrame:
    """Pull requests from JSON (objects or arrays, one per line)."""
    raw = spark.read.schema(schemas.PULL_REQUEST).json(path)
    return raw.select(
        "repo", "number", "title", "body", F.col("mergedAt").alias("merged_at"), F.col("author.login").alias("author"),
        F.transform("labels", lambda x: x["name"]).alias("labels"), F.transform("files", lambda x: x["path"]).alias("files"),
    )


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.ISSUE).json(path)
    return raw.select(
        "repo", "number", "title", "body", F.col("closedAt").alias("closed_at"), F.col("author.login").alias("author"),
        F.transform("labels", lambda x: x["name"]).alias("labels"),
    )


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Reviews and comments of pull requests as one row each: (repo, number, kind, state, body)."""
    raw = spark.read.schema(schemas.PR_REVIEWS).json(path)
    item = "struct<kind:string,state:string,body:string,author:string>"
    reviews = F.transform(
        F.coalesce("reviews", F.array()),
        lambda r: F.struct(F.lit("review").alias("kind"), r["state"].alias("state"), r["body"].alias("body"), r["author"]["login"].alias("author")),
    )
    comments = F.transform(
        F.coalesce("comments", F.array()),
        lambda c: F.struct(F.lit("comment").alias("kind"), F.lit(None).cast("string").alias("state"), c["body"].alias("body"), c["author"]["login"].alias("author")),
    )
    items = F.concat(reviews.cast(f"array<{item}>"), comments.cast(f"array<{item}>"))
    return raw.select("repo", "number", F.explode(items).alias("i")).select("repo", "number", "i.*")
