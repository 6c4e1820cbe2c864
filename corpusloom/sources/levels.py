"""Snapshot histories in two levels: full states, and dated deltas between them.

A history is one folder of Parquet files: ``kind=delta/at=…/bucket=…`` holds the rows of one write, ``kind=base/at=…``
the newest row of every key up to that time. A read opens the newest base at or before the time it asks for and the
deltas after it, nothing else; ``compact`` adds a base, so that reads stay as short as they were. Older levels stay, for
reads as of their time. Buckets (a hash of the repo) let a read of few repos skip the others.

Only the deltas are aggregated; the base, which has one row per key already, passes an anti-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.snapshots import latest_snapshot

BUCKETS = 16
FORMAT = "yyyy-MM-dd'T'HH-mm-ss.SSSSSS"
LEVEL = "kind string, at string, bucket int"


def bucket_of(repo: Column) -> Column:
    return F.pmod(F.xxhash64(repo), F.lit(BUCKETS)).cast("int")


def _write(rows: DataFrame, path: str, kind: str, at: Column) -> None:
    placed = rows.withColumns({"kind": F.lit(kind), "at": F.date_format(at, FORMAT), "bucket": bucket_of(F.col("repo"))})
    # Files of about the advisory size: a large bucket becomes several files, small ones share a task.
    placed.hint("rebalance", "bucket").write.mode("append").partitionBy("kind", "at", "bucket").parquet(path)


def append_level(rows: DataFrame, path: str, at: Column) -> None:
    """Add the rows of one snapshot, taken at the (constant) time ``at``."""
    _write(rows, path, "delta", at)


def level_times(spark: SparkSession, path: str, kind: str) -> list[str]:
    """The times of a kind of level, oldest first: a listing of one folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind={kind}")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    return sorted(name[3:] for name in (s.getPath().getName() for s in store.listStatus(folder)) if name.startswith("at="))


def is_leveled(spark: SparkSession, path: str) -> bool:
    return bool(level_times(spark, path, "delta") or level_times(spark, path, "base"))


def read_levels(spark: SparkSession, path: str, schema: str, keys: list[str], ts: str, as_of: Column | None = None, repos: list[str] | None = None) -> DataFrame:
    """Newest row per key at or before ``as_of``, of all repos or of some."""
    # A constant, folded without a job.
    wanted = None if as_of is None else spark.sql("SELECT 1 AS x").select(F.date_format(as_of, FORMAT)).first()[0]
    bases = [at for at in level_times(spark, path, "base") if wanted is None or at <= wanted]
    rows = spark.read.schema(f"{schema}, {LEVEL}").parquet(path)
    if repos is not None:
        kept = [r[0] for r in spark.createDataFrame([(r,) for r in repos], "repo string").select(bucket_of(F.col("repo"))).distinct().collect()]
        rows = rows.filter(F.col("bucket").isin(kept) & F.col("repo").isin(repos))
    columns = [c for c in rows.columns if c not in ("kind", "at", "bucket")]
    delta = rows.filter(F.col("kind") == "delta")
    if bases:
        delta = delta.filter(F.col("at") > bases[-1])
    if wanted is not None:
        delta = delta.filter(F.col("at") <= wanted)
    newest = latest_snapshot(delta.select(*columns), keys, ts)
    if not bases:
        return newest
    base = rows.filter((F.col("kind") == "base") & (F.col("at") == bases[-1])).select(*columns)
    return base.join(newest.select(*keys), keys, "left_anti").select(*columns).unionByName(newest)


def compact(spark: SparkSession, path: str, schema: str, keys: list[str], ts: str, upto: Column | None = None) -> None:
    """Add a base that holds everything up to a time (all there is, where none is given)."""
    times = level_times(spark, path, "delta")
    if not times:
        return
    at = F.to_timestamp(F.lit(times[-1]), FORMAT) if upto is None else upto
    _write(read_levels(spark, path, schema, keys, ts, at), path, "base", at)
