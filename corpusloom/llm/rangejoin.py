"""Near-duplicate vectors by an exact metric range join.

Unit vectors with the angle between them are a metric space, and a cosine of at least ``cosine`` is an angle of at most
``reach``. Pivots from a bounded sample partition the vectors: each has its home at the nearest pivot. If x with home p
and y with home q are linked, the triangle inequality gives d(y, p) <= d(y, q) + 2 reach and d(y, p) <= r(p) + reach,
with r(p) the largest distance in home p. Rows are replicated to the pivots that fulfil both. Of the two homes
where a pair could meet, the parity of their numbers picks one, so each pair meets once. Cells join independently, in
blocks of bounded size: a crowded cell becomes more tasks, not a larger one. Only spanning links and sums per row
leave a task, never all pairs.

Where vectors fill many dimensions evenly, the inequality excludes little and the join compares nearly all pairs of
blocks; it stays exact.

Defined cases: vectors that are null, zero, or hold null or non-finite components, or have another length than most,
link with nothing; equal vectors are joined once and count as linked with each other; rows that share a vec_id
are one node; a null vec_id links with nothing and is kept; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import components, local_components, require, stored
from corpusloom.llm.vectors import matrix, unit, valid

#: Rows of a cell at best, of a block at most about, and pivots at most.
CELL, BLOCK, PIVOTS = 16_384, 16_384, 1024
#: Rounding of angles near 0; bounds are widened by it.
SLACK = 1e-6


def angles(units, pivots):
    import numpy as np

    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def linked(a, b, cosine: float):
    """Which rows of units ``a`` and ``b`` have at least that cosine. Values within rounding of it are summed again
    in one fixed order."""
    import numpy as np

    values = a @ b.T
    hit = values >= cosine
    i, j = np.nonzero(np.abs(values - cosine) < 1e-12)
    if len(i):
        hit[i, j] = np.einsum("ij,ij->i", a[i], b[j]) >= cosine
    return hit


def join_blocks(part, cosine: float):
    """Links between side 0 and side 1 of a task, or inside side 0 if it has no other side."""
    import numpy as np
    import pandas as pd

    side = part["side"].to_numpy()
    inner = not (side == 1).any() and bool(part["inner"].iloc[0])
    if not inner and (not (side == 1).any() or not (side == 0).any()):
        return pd.DataFrame({"node": [], "other": [], "links": []}).astype("int64")
    unit_of, node, n = unit(matrix(part["v"])), part["node"].to_numpy(), part["n"].to_numpy()
    rows = np.flatnonzero(side == 0)
    cols = rows if inner else np.flatnonzero(side == 1)
    links, a, b = np.zeros(len(part), np.int64), [], []
    for k in range(0, len(rows), 256):
        some = rows[k : k + 256]
        hit = linked(unit_of[some], unit_of[cols], cosine)
        if inner:
            hit[np.arange(len(some)), np.arange(k, k + len(some))] = False
            links[some] += hit @ n[cols]
        else:
            links[some] += hit @ n[cols]
            links[cols] += n[some] @ hit
        i, j = np.nonzero(hit)
        if len(i):
            places, at = np.unique(np.concatenate([some[i], cols[j]]), return_inverse=True)
            label = local_components(len(places), at[: len(i)], at[len(i) :])
            far = np.flatnonzero(label != np.arange(len(places)))
            a.append(places[far])
            b.append(places[label[far]])
    label = local_components(len(part), *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)))
    out = np.flatnonzero((links > 0) | (label != np.arange(len(part))))
    return pd.DataFrame({"node": node[out], "other": node[label[out]], "links": links[out]})


def near_duplicates(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``."""
    import numpy as np
    import pandas as pd

    spark = vectors.sparkSession
    reach = math.acos(cosine) + SLACK
    rows = valid(vectors)
    classes = stored(rows.groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")), "vector-classes")
    total = classes.count()
    wanted = max(1, min(PIVOTS, -(-total // CELL)))
    few = classes.select("v", F.xxhash64("node").alias("h"), "node").orderBy("h", "node").limit(wanted).collect()
    pivots = unit(np.array([r["v"] for r in few], dtype=np.float64).reshape(len(few), -1)) if few else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(pivots)

    def homes(parts):
        for part in parts:
            far = angles(unit(matrix(part["v"])), shared.value)
            yield pd.DataFrame({"node": part["node"], "n": part["n"], "v": part["v"], "home": far.argmin(axis=1), "far": far.min(axis=1)})

    vector = dict(classes.dtypes)["v"]
    at_home = stored(classes.mapInPandas(homes, f"node bigint, n bigint, v {vector}, home int, far double"), "vector-homes")
    radius = np.full(max(1, len(pivots)), -np.inf)
    for r in at_home.groupBy("home").agg(F.max("far").alias("far")).collect():  # one row per pivot at most
        radius[r["home"]] = r["far"]

    def replicas(parts):
        for part in parts:
            far = angles(unit(matrix(part["v"])), shared.value)
            home = part["home"].to_numpy()
            number = np.arange(len(shared.value))
            near = (far <= part["far"].to_numpy()[:, None] + 2 * reach) & (far <= radius[None, :] + reach)
            mine = (number[None, :] < home[:, None]) == ((number[None, :] + home[:, None]) % 2 == 0)
            row, cell = np.nonzero(near & mine & (number[None, :] != home[:, None]))
            yield part.iloc[row].assign(cell=cell, side=1)[["cell", "side", "node", "n", "v"]]

    schema = f"cell int, side int, node bigint, n bigint, v {vector}"
    local = at_home.select(F.col("home").alias("cell"), F.lit(0).alias("side"), "node", "n", "v")
    cells = local.unionByName(at_home.mapInPandas(replicas, schema))
    sizes = cells.groupBy("cell").agg(
        F.ceil(F.count_if(F.col("side") == 0) / BLOCK).alias("own_blocks"), F.ceil(F.count_if(F.col("side") == 1) / BLOCK).alias("other_blocks")
    )
    sized = cells.join(F.broadcast(sizes), "cell")  # one row per pivot at most
    block = F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, F.col("own_blocks")).otherwise(F.col("other_blocks")))
    sized = sized.withColumn("block", block)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    own = F.col("own_blocks")
    # Tasks (i, j): own block i with own block j >= i, numbered from 0, or with replica block j - own_blocks.
    as_first = F.transform(F.sequence(F.col("block"), own + F.col("other_blocks") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    as_second = F.transform(F.filter(upto(own), lambda i: i < F.col("block")), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side")))
    as_replica = F.transform(upto(own), lambda i: F.struct(i.alias("i"), (F.col("block") + own).alias("j"), F.lit(1).alias("side")))
    tasks = sized.withColumn("t", F.explode(F.when(F.col("side") == 0, F.concat(as_first, as_second)).otherwise(as_replica)))
    tasks = tasks.select("cell", "t.i", "t.j", "t.side", (F.col("t.i") == F.col("t.j")).alias("inner"), "node", "n", "v")
    found = tasks.groupBy("cell", "i", "j").applyInPandas(lambda part: join_blocks(part, cosine), "node bigint, other bigint, links bigint")
    found = stored(found, "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.filter("node <> other").select("node", "other"), "node", "other")
    known = classes.join(links, "node", "left").join(labels, "node", "left").select(
        F.col("v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("label", "node").alias("component_id")
    )
    ids = rows.join(known, "v").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    every = require(vectors, "vec_id").select(F.col("vec_id").cast("bigint").alias("vec_id"))
    return every.join(ids, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id"))).alias("kept"),
    )
