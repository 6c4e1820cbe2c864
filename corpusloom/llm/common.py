"""What several operators of this subpackage share: stored steps, held-out folds, components of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.runtime import scratch_path

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back: lineage ends there and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """The fold kept out of every fit: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def require(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, so that columns with other names can't clash with the operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest node reachable over undirected edges, for nodes that have an edge.

    Alternating large-star and small-star steps. Each round is written to the shared folder; minima are combined
    map-side, and the joins with them are plain equi-joins that adaptive execution splits where a node is a hub.
    """
    cur = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links"
    )
    before = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        cur = stored(small.select("e.u", "e.v").filter("u <> v").distinct(), "links")
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    labels = cur.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def popcount64(x):
    """Set bits of each unsigned 64-bit integer of an array."""
    import numpy as np

    return np.bitwise_count(x)


def local_components(n: int, a, b):
    """For nodes 0..n-1 the smallest node reachable over the links (a[k], b[k]): labels sink along the links."""
    import numpy as np

    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        apart = label[a] != label[b]
        if not apart.any():
            break
        a, b = a[apart], b[apart]
    while True:
        nxt = label[label]
        if (nxt == label).all():
            return label
        label = nxt
