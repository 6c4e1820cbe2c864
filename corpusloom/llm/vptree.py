"""Nearest neighbours by cosine with a vantage-point tree per shard.

Distinct vectors are dealt into shards of bounded size by a hash. A shard's rows and all queries are sorted into one
task; there the shard's tree is built once, and the queries stream past it (past a million queries, the shard meets
them in groups of that size). A node has a vantage vector and the median distance to it, which
splits the rest into an inner and an outer half, down to leaves. On unit vectors the chord is a metric that orders
like the cosine, so a half whose bound by the triangle inequality lies beyond the k-th distance found can't hold a
nearer vector. ``factor`` relaxes that: halves are visited while their bound is at most ``factor`` times that
distance; 1 is exact, less visits less. Queries go down together, as products of matrices.

Defined cases: vectors that are null, zero, or hold null or non-finite components, or have another length than most,
take no part; rows without vec_id neither; equal vectors are searched once and rank by vec_id; rows that share a
vec_id count as one; with fewer candidates than ``k`` all are returned; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.llm.common import partitions, stored
from corpusloom.llm.vectors import matrix, smallest_ids, unit, valid

FACTOR = 0.7
SHARD, QUERIES, LEAF = 8192, 1 << 20, 256
#: Neighbours kept beyond k until they are ranked by the exact measure.
SPARE = 4


class Tree:
    """Vantage-point tree over the rows of ``units`` (unit vectors)."""

    def __init__(self, units, leaf: int = LEAF, seed: int = 7):
        import numpy as np

        self.units, self.leaf = units, leaf
        self.draw = np.random.default_rng(seed)
        self.root = self.build(np.arange(len(units)))

    def build(self, rows):
        import numpy as np

        if len(rows) <= self.leaf:
            return rows, None, 0.0, None, None
        at = self.draw.integers(len(rows))
        vantage, rest = rows[at], np.delete(rows, at)
        far = chord(self.units[rest], self.units[vantage : vantage + 1])[:, 0]
        middle = np.median(far)
        inner = far <= middle
        if inner.all():  # all at one distance: halves of any kind do
            inner = np.arange(len(rest)) < len(rest) // 2
        return None, vantage, middle, self.build(rest[inner]), self.build(rest[~inner])

    def search(self, queries, k: int, factor: float):
        """(distances, rows) of the k nearest found per query, row -1 where there are fewer."""
        import numpy as np

        best = np.full((len(queries), k), np.inf), np.full((len(queries), k), -1, dtype=np.int64)

        def offer(who, rows):
            for a in range(0, len(who), 512):
                some = who[a : a + 512]
                far = np.concatenate([best[0][some], chord(queries[some], self.units[rows])], axis=1)
                ids = np.concatenate([best[1][some], np.broadcast_to(rows, (len(some), len(rows)))], axis=1)
                near = np.argpartition(far, k - 1, axis=1)[:, :k] if far.shape[1] > k else np.tile(np.arange(k), (len(some), 1))
                best[0][some], best[1][some] = np.take_along_axis(far, near, 1), np.take_along_axis(ids, near, 1)

        def visit(node, who):
            rows, vantage, middle, inner, outer = node
            if not len(who):
                return
            if vantage is None:
                if len(rows):
                    offer(who, rows)
                return
            offer(who, np.array([vantage]))
            far = chord(queries[who], self.units[vantage : vantage + 1])[:, 0]
            inside = far <= middle
            visit(inner, who[inside])
            visit(outer, who[~inside])
            open_ = np.abs(far - middle) <= factor * best[0][who].max(axis=1)
            visit(outer, who[inside & open_])
            visit(inner, who[~inside & open_])

        visit(self.root, np.arange(len(queries)))
        return best


def chord(a, b):
    import numpy as np

    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest other rows found for each row where ``is_query`` holds."""

    def search(frames):
        import numpy as np
        import pandas as pd

        now, held, tree, ids = None, [], None, []
        for frame in frames:
            out = {"query_id": [], "vec_id": [], "score": []}
            for key, part in frame.groupby(["shard", "part"], sort=False):
                if key != now:
                    now, held, tree = key, [], None
                points = part[part["kind"] == 0]
                if len(points):
                    held.append(points)
                asked = part[part["kind"] == 1]
                if not len(asked) or not held:
                    continue
                if tree is None:
                    points = pd.concat(held)
                    tree, ids, held = Tree(unit(matrix(points["v"]))), points["ids"].tolist(), [points.iloc[:0]]
                directions = unit(matrix(asked["v"]))
                # The query's own class may be among the nearest with no other row.
                _, rows = tree.search(directions, k + 1 + SPARE, factor)
                for query, own, found in zip(directions, asked["query_id"].tolist(), rows, strict=True):
                    found = found[found >= 0]
                    score = np.einsum("ij,j->i", tree.units[found], query)
                    each = sorted((-s, i) for s, r in zip(score.tolist(), found.tolist(), strict=True) for i in ids[r] if i != own)[:k]
                    out["query_id"] += [own] * len(each)
                    out["vec_id"] += [i for _, i in each]
                    out["score"] += [-s for s, _ in each]
            yield pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    rows = valid(vectors)
    classes = stored(smallest_ids(rows, k + 1), "vector-classes")
    queries = stored(rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "v"), "vector-queries")
    shards = -(-classes.count() // SHARD) or 1
    parts = -(-queries.count() // QUERIES) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = classes.select(
        F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), every(parts).alias("part"), F.lit(0).alias("kind"), "v", "ids", F.lit(0).cast("bigint").alias("query_id")
    )
    right = queries.select(
        every(shards).alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "v",
        F.array().cast("array<bigint>").alias("ids"), "query_id",
    )
    met = left.unionByName(right).repartition(partitions(vectors.sparkSession), "shard", "part").sortWithinPartitions("shard", "part", "kind")
    found = met.mapInPandas(search, "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
