"""Session helpers: shared folders, lineage cuts and ordered running sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Where it is unset, a local one is made, but only for a
    local master: executors on other machines could not read it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="corpusloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder, never reused."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor."""
    folder = shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def ordered_sum(
    df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str, coarse: Column, descending: bool = False
) -> DataFrame:
    """Running sum of ``value`` per ``keys`` in a total order, for groups of any size.

    ``coarse`` is a value of the order (the day, leading characters): rows of a group with different values of it
    follow one another by it. Every such bucket is summed on its own, and the bucket totals (one row per key and
    bucket, combined map-side) give the offsets.
    """
    spread = df.withColumn("_b", coarse).withColumn("_v", value.cast("bigint"))
    before = W.partitionBy(*keys).orderBy(F.desc("_b") if descending else F.asc("_b")).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        spread.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t"))
        .withColumn("_o", F.coalesce(F.sum("_t").over(before), F.lit(0)))
        .drop("_t")
    )
    local = W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        spread.join(offsets, [*keys, "_b"])
        .withColumn(out, (F.sum("_v").over(local) + F.col("_o")).cast("bigint"))
        .drop("_v", "_b", "_o")
    )


def ordered_lag(df: DataFrame, keys: list[str], order: list[str], fields: list[str], coarse: Column) -> DataFrame:
    """Add ``prev_<field>``, the value one row earlier per key, for groups of any size.

    Buckets as in :func:`ordered_sum`; only the last row of each, found by a map-side aggregate, crosses to the next.
    """
    spread = df.withColumn("_b", coarse)
    ends = spread.groupBy(*keys, "_b").agg(
        F.max_by(F.struct(*fields), F.struct(*order)).alias("_last")
    )
    carried = ends.withColumn("_carry", F.lag("_last").over(W.partitionBy(*keys).orderBy("_b"))).drop("_last")
    window = W.partitionBy(*keys, "_b").orderBy(*order)
    first = F.row_number().over(window) == 1
    joined = spread.join(carried, [*keys, "_b"])
    return joined.select(
        "*",
        *[
            F.when(first, F.col(f"_carry.{f}")).otherwise(F.lag(f).over(window)).alias(f"prev_{f}")
            for f in fields
        ],
    ).drop("_b", "_carry")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per group; Catalyst cuts each map task to ``k`` rows per group before the shuffle."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)
