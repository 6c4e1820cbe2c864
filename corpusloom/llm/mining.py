"""Hard negatives by an inverted multi-index.

Vectors are scaled to integers, so scores (inner products) are exact. Each vector is cut into two halves; a codebook per
half, fitted on a bounded sample, gives every row a cell (two codes). With the largest distance of a row to its code as
radius, ``q1 . c1 + |q1| r1`` bounds the score that a row of code ``c1`` can reach in that half, and the sum over both
halves bounds a cell. For an anchor, a heap walks over the sums of the two sorted lists of half bounds, best first. It
stops as soon as the next bound can't enter the window that is sought: the k-th score found so far, or the window's lower
end. What is behind is certified not to matter, so the result is exact.

On Spark, a walk has two rounds: first the best cells with together ``FIRST`` rows, which give the k-th score; then all
further cells that this score doesn't exclude. Cells are cut into blocks of bounded size. A round sorts blocks and the
anchors that visit them into the same tasks, where a block is held while its anchors stream past. The index is read once
in a round however many anchors there are (once for each million). First the positives are found, then negatives in the
windows that the positives' scores open. Anchors with equal vectors and labels walk once; equal rows are one row with
its smallest ids.

Defined cases: rows with a null label, id or vector, with null or non-finite components, or of another length than most,
take no part; rows that share an id count as one, the least by label and vector; scaled components are limited to 2^26,
so that a score fits a long; fewer rows than asked for give fewer results; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.llm.common import partitions, require, stored

#: Rows of a cell on average, of a block at most about, codes per half at most, rows that a codebook is fitted on.
CELL, BLOCK, CODES, SAMPLE = 2048, 4096, 256, 16_384
#: Rows of the cells that an anchor visits first; anchors that pass one block in one task.
FIRST, ANCHORS = 8192, 1 << 20
LIMIT = 1 << 26
SALT = 16


def usable(vectors: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, q) of the rows that take part; ``label`` is computed from vec_id and label."""
    rows = require(vectors, "vec_id", "embedding", "label").select(
        F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.transform("embedding", lambda x: x.cast("double")).alias("v")
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite & (F.size("v") > 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.filter(F.size("v") == (usual["n"] if usual else 0))
    scaled = F.transform("v", lambda x: F.least(F.greatest(F.floor(x * 256), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    one = rows.select("vec_id", F.struct(F.col("label"), scaled.alias("q")).alias("r")).groupBy("vec_id").agg(F.min("r").alias("r"))
    return one.select("vec_id", F.col("r.label").alias("label"), F.col("r.q").alias("q")).withColumn("label", label)


def same(label: str = "label", q: str = "q") -> Column:
    """Names rows of equal label and vector."""
    return F.sha2(F.concat_ws(",", F.col(label).cast("string"), F.array_join(q, ",")), 256)


def codebook(points, codes: int):
    """Centres of a few rounds of k-means from distinct points."""
    import numpy as np

    points = np.unique(points, axis=0)
    draw = np.random.default_rng(11)
    centres = points[draw.choice(len(points), min(codes, len(points)), replace=False)]
    for _ in range(12):
        near = nearest_code(points, centres)[0]
        size = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def nearest_code(points, centres):
    """(code, distance) per row; the distance is summed anew from differences, since it becomes a radius."""
    import numpy as np

    code = (np.einsum("ij,ij->i", centres, centres) - 2.0 * (points @ centres.T)).argmin(axis=1)
    return code, np.sqrt(((points - centres[code]) ** 2).sum(axis=1))


class Walk:
    """Cells in the order of their bounds, by a heap over two sorted lists of half bounds."""

    def __init__(self, books, cells, first: int):
        import numpy as np

        self.books, self.half, self.first = books, books[0].shape[1], first
        #: (code 1, code 2): rows, radii of the cell's own rows, first block, blocks
        self.cells = cells
        self.radius = [np.zeros(len(b)) for b in books]
        for (a, b), cell in cells.items():
            self.radius[0][a] = max(self.radius[0][a], cell[1])
            self.radius[1][b] = max(self.radius[1][b], cell[2])

    def of(self, q):
        """(bound, blocks, rows, lowest and highest score of the cell itself), best bound first; empty cells are left out."""
        import numpy as np

        parts = q[: self.half].astype(float), q[self.half :].astype(float)
        norms = [float(np.sqrt(p @ p)) for p in parts]
        middle = [b @ p for b, p in zip(self.books, parts, strict=True)]
        bounds = [m + n * r for m, n, r in zip(middle, norms, self.radius, strict=True)]
        order = [np.argsort(-b, kind="stable") for b in bounds]
        slack = 1.0 + 1e-9 * sum(float(np.abs(b).max()) + n for b, n in zip(bounds, norms, strict=True))
        first, second = (b[o] for b, o in zip(bounds, order, strict=True))
        heap, known = [(-(first[0] + second[0]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < len(first) and b < len(second) and (a, b) not in known:
                    known.add((a, b))
                    heapq.heappush(heap, (-(first[a] + second[b]), a, b))
            a, b = int(order[0][i]), int(order[1][j])
            cell = self.cells.get((a, b))
            if cell:
                rows, r1, r2, block, blocks = cell
                centre, reach = middle[0][a] + middle[1][b], norms[0] * r1 + norms[1] * r2 + slack
                yield -bound + slack, range(block, block + blocks), rows, centre - reach, centre + reach

    def visits(self, q, further: bool, low, high) -> list[int]:
        """Blocks of the first cells, or of all further ones that may hold a score from ``low`` to ``high``."""
        blocks, rows = [], 0
        for bound, some, n, least, most in self.of(q):
            if further and low is not None and bound < low:
                break
            if rows < self.first:
                rows += n
                if not further:
                    blocks += some
                continue
            if not further:
                break
            if (low is None or most >= low) and (high is None or least <= high):
                blocks += some
        return blocks


class Index:
    """The rows of all classes in blocks, and the walk over their cells."""

    def __init__(self, rows: DataFrame, ids: int):
        import numpy as np

        self.spark = rows.sparkSession
        nth = F.row_number().over(W.partitionBy("label", "q").orderBy("vec_id"))
        classes = rows.withColumn("_n", nth).filter(F.col("_n") <= ids).groupBy("label", "q").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        classes = stored(classes, "classes")
        n = classes.count()
        sample = [r["q"] for r in classes.select("q").orderBy(F.xxhash64("q", "label")).limit(SAMPLE).collect()]
        points = np.array(sample, dtype=float).reshape(len(sample), -1) if sample else np.zeros((1, 2))
        codes = int(min(CODES, max(1, round((n / CELL) ** 0.5))))
        half = points.shape[1] // 2
        books = [codebook(points[:, :half], codes), codebook(points[:, half:], codes)]

        def assign(frames):
            for frame in frames:
                points = np.array(frame["q"].tolist(), dtype=float).reshape(len(frame), -1)
                (a, ra), (b, rb) = nearest_code(points[:, :half], books[0]), nearest_code(points[:, half:], books[1])
                yield frame.assign(a=a, b=b, ra=ra, rb=rb)

        coded = stored(classes.mapInPandas(assign, "label bigint, q array<int>, ids array<bigint>, a int, b int, ra double, rb double"), "coded")
        # At most CODES * CODES cells.
        cells, block = {}, 0
        for r in coded.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("ra").alias("ra"), F.max("rb").alias("rb")).orderBy("a", "b").collect():
            blocks = -(-r["n"] // BLOCK)
            cells[r["a"], r["b"]] = (r["n"], r["ra"], r["rb"], block, blocks)
            block += blocks
        self.walk = Walk(books, cells, FIRST)
        places = self.spark.createDataFrame([(a, b, c[3], c[4]) for (a, b), c in cells.items()], "a int, b int, first bigint, blocks bigint")
        block_no = F.col("first") + F.pmod(F.xxhash64("q", "label"), "blocks")
        self.blocks = stored(coded.join(F.broadcast(places), ["a", "b"]).select(block_no.alias("block"), "label", "q", "ids"), "index")

    def search(self, anchors: DataFrame, same_label: bool, k: int, further: bool) -> DataFrame:
        """(aid, key, score, vec_id): the k best rows of each block visited, for each of an anchor's ``windows``.

        ``anchors``: aid, label, q, windows. A window has a key, the highest score (null: open), and its ``floor``: the lowest
        score that is sought, or the k-th reached so far.
        """
        walk = self.walk

        def plan(frames):
            for frame in frames:
                out = [
                    walk.visits(q, further, at_least([w["floor"] for w in windows]), at_most([w["high"] for w in windows]))
                    for q, windows in zip(frame["q"], frame["windows"], strict=True)
                ]
                yield frame.assign(block=out)

        kind = "array<struct<key:bigint,high:bigint,floor:bigint>>"
        groups = -(-anchors.count() // ANCHORS) or 1
        going = anchors.mapInPandas(plan, f"aid string, label bigint, q array<int>, windows {kind}, block array<bigint>")
        none = F.array().cast("array<bigint>")
        going = going.withColumn("block", F.explode("block")).select(
            "block", F.pmod(F.xxhash64("aid"), F.lit(groups)).alias("part"), F.lit(1).alias("kind"), "label", "q", none.alias("ids"), "aid", "windows"
        )
        held = self.blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>"))).select(
            "block", "part", F.lit(0).alias("kind"), "label", "q", "ids", F.lit("").alias("aid"), F.array().cast(kind).alias("windows")
        )
        met = held.unionByName(going).repartition(partitions(self.spark), "block", "part").sortWithinPartitions("block", "part", "kind")

        def meet(frames):
            import numpy as np
            import pandas as pd

            now, rows = None, []
            for frame in frames:
                keys = list(zip(frame["block"].tolist(), frame["part"].tolist(), strict=True))
                out = {"aid": [], "key": [], "score": [], "vec_id": []}
                held = None
                for at, key in enumerate(keys):
                    if key != now:
                        now, rows, held = key, [], None
                    if not frame["kind"].iat[at]:
                        rows.append((frame["label"].iat[at], frame["q"].iat[at], frame["ids"].iat[at]))
                        continue
                    if not rows:
                        continue
                    held = held or Held(rows)
                    for name, score, vec_id in held.best(frame["q"].iat[at], frame["label"].iat[at], frame["windows"].iat[at], same_label, k):
                        out["aid"].append(frame["aid"].iat[at])
                        out["key"].append(name)
                        out["score"].append(score)
                        out["vec_id"].append(vec_id)
                yield pd.DataFrame({c: np.array(v, dtype=object) if c == "aid" else pd.array(v, dtype="Int64") for c, v in out.items()})

        return met.mapInPandas(meet, "aid string, key bigint, score bigint, vec_id bigint")


class Held:
    """The rows of one block."""

    def __init__(self, rows):
        import numpy as np

        self.label = np.array([r[0] for r in rows])
        self.q = np.array([r[1] for r in rows], dtype=np.int64)
        self.least = np.array([min(r[2]) for r in rows])
        self.ids = [r[2] for r in rows]
        self.exact = self.q.astype(float) if 0 < np.abs(self.q).max(initial=0) ** 2 * self.q.shape[1] < 2**53 else None

    def best(self, q, label, windows, same_label: bool, k: int):
        import numpy as np

        q = np.asarray(q, dtype=np.int64)
        # Products of doubles are exact, and faster, where all sums stay below 2^53.
        if self.exact is not None and int(np.abs(q).max(initial=0)) * int(np.abs(self.q).max()) * len(q) < 2**53:
            score = (self.exact @ q.astype(float)).astype(np.int64)
        else:
            score = self.q @ q
        fits = self.label == label if same_label else self.label != label
        for w in windows:
            some = fits if w["floor"] is None else fits & (score >= w["floor"])
            at = np.flatnonzero(some if w["high"] is None else some & (score <= w["high"]))
            if len(at) > k:
                at = at[score[at] >= np.partition(score[at], -k)[-k]]
            at = at[np.lexsort((self.least[at], -score[at]))][:k]
            rows = sorted((-int(score[i]), int(vec_id)) for i in at for vec_id in self.ids[i])[:k]
            yield from ((w["key"], -s, vec_id) for s, vec_id in rows)


def at_least(floors):
    return None if not len(floors) or any(x is None for x in floors) else min(floors)


def at_most(highs):
    return None if any(x is None for x in highs) else max(highs, default=None)


def best_in_windows(index: Index, anchors: DataFrame, same_label: bool, k: int) -> DataFrame:
    """(aid, key, found): the k best rows of each window, found by the first cells and then all further ones."""
    open_key = F.lit(-(1 << 62))
    first = stored(top(index.search(anchors, same_label, k, further=False), k), "first")
    reached = first.withColumn("w", F.struct(F.coalesce("key", open_key).alias("name"), F.when(F.size("found") >= k, F.element_at("found", -1)["score"]).alias("kth")))
    reached = reached.groupBy("aid").agg(F.map_from_entries(F.collect_list("w")).alias("reached"))
    kth = lambda w: F.element_at("reached", F.coalesce(w["key"], open_key))
    raised = F.transform(
        "windows", lambda w: F.struct(w["key"].alias("key"), w["high"].alias("high"), F.when(kth(w).isNull(), w["floor"]).otherwise(F.greatest(w["floor"], kth(w))).alias("floor"))
    )
    again = anchors.join(reached, "aid", "left").withColumn("windows", raised).drop("reached")
    more = index.search(stored(again, "anchors"), same_label, k, further=True)
    return top(first.select("aid", "key", F.inline("found")).unionByName(more), k)


def top(found: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(W.partitionBy("aid", "key").orderBy(F.desc("score"), "vec_id"))
    kept = found.withColumn("n", nth).filter(F.col("n") <= k)
    order = F.sort_array(F.collect_list(F.struct("n", "score", "vec_id")))
    return kept.groupBy("aid", "key").agg(F.transform(order, lambda x: F.struct(x["score"].alias("score"), x["vec_id"].alias("vec_id"))).alias("found"))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor's best ``positives`` rows
    of its label, the best rows of other labels that score ``low`` to ``high`` percent of the positive."""
    rows = stored(usable(vectors, F.col("label") if label is None else label), "vectors")
    index = Index(rows, max(positives + 1, negatives))
    own = rows.filter(is_anchor).withColumn("aid", same())
    open_ = F.struct(*[F.lit(None).cast("bigint").alias(c) for c in ("key", "high", "floor")])
    anchors = stored(own.groupBy("aid").agg(F.first("label").alias("label"), F.first("q").alias("q")).withColumn("windows", F.array(open_)), "anchors")
    # One more than asked for, since an anchor is not its own positive.
    near = stored(best_in_windows(index, anchors, True, positives + 1).select("aid", F.col("found").alias("positives")), "positives")
    s = F.col("s")
    least, most = F.ceil(s * low / F.lit(100).cast("decimal(3,0)")), F.floor(s * high / F.lit(100).cast("decimal(3,0)"))
    scores = near.select("aid", F.explode(F.array_distinct(F.col("positives.score"))).alias("s"))
    window = F.struct(s.alias("key"), most.cast("bigint").alias("high"), least.cast("bigint").alias("floor"))
    windows = scores.select("aid", window.alias("w")).filter("w.floor <= w.high").groupBy("aid").agg(F.sort_array(F.collect_list("w")).alias("windows"))
    seeking = stored(anchors.drop("windows").join(windows, "aid"), "seeking")
    hard = best_in_windows(index, seeking, False, negatives)
    hard = hard.groupBy("aid").agg(F.map_from_entries(F.collect_list(F.struct("key", "found"))).alias("negatives"))
    found = near.join(hard, "aid").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")))
    salted = own.select(F.col("vec_id").alias("anchor_id"), "aid").withColumn("salt", F.pmod(F.xxhash64("anchor_id"), F.lit(SALT)))
    each = salted.join(found, ["aid", "salt"])
    others = F.slice(F.filter("positives", lambda x: x["vec_id"] != F.col("anchor_id")), 1, positives)
    each = each.select("anchor_id", F.explode(others).alias("p"), "negatives")
    each = each.select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.posexplode(F.element_at("negatives", F.col("p.score"))).alias("at", "x"))
    return each.select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score")
    )
