from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import rangejoin, vptree

SCHEMA = "vec_id bigint, embedding array<float>, label int, node string, v string, score string, home string"


def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [centres[k % 12] + rng.normal(size=16) * rng.choice([0.05, 0.3, 2.0]) for k in range(400)]
    rows += [rows[7], rows[7], rows[8] * 3] + [rows[9]] * 12
    out = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(rows)]
    nan, inf = float("nan"), float("inf")
    bad = [None, [0.0] * 16, [nan] * 16, [inf] + [1.0] * 15, [None] + [1.0] * 15, [], [1.0, 2.0]]
    out += [(1000 + 50 * k, b) for k, b in enumerate(bad)] + [(None, out[3][1]), out[20], out[20]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x", "x") for i, v in rows], SCHEMA)


def usable(rows):
    return {i: np.array(v, dtype=np.float64) for i, v in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}


def cosines(rows):
    ids = sorted(rows)
    u = np.array([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    return ids, np.round(u @ u.T, 12)


@pytest.mark.parametrize("small", [False, True])
def test_nearest_is_exact_at_factor_one(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(vptree, "SHARD", 90)
        monkeypatch.setattr(vptree, "QUERIES", 9)
    ids, values = cosines(usable(vectors()))
    got = vptree.nearest(frame(spark, vectors()), F.col("vec_id") % 20 == 0, k=5, factor=1.0).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(found) == {i for i in ids if i % 20 == 0}
    for q, ranks in found.items():
        row = values[ids.index(q)]
        want = sorted((-s, i) for s, i in zip(row, ids, strict=True) if i != q)[:5]
        assert [ranks[k][0] for k in range(1, 6)] == [i for _, i in want]
        assert np.allclose([ranks[k][1] for k in range(1, 6)], [-s for s, _ in want], atol=1e-9)


def test_tree_prunes_and_keeps_recall():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(40, 3))[rng.integers(40, size=6000)] + rng.normal(size=(6000, 3)) * 0.05
    points /= np.linalg.norm(points, axis=1)[:, None]
    queries = points[::60]
    exact = vptree.Tree(points, leaf=32).search(queries, 5, 1.0)[0]
    assert np.allclose(np.sort(exact, 1), np.sort(vptree.chord(queries, points), 1)[:, :5], atol=1e-7)
    near = vptree.Tree(points, leaf=32).search(queries, 5, vptree.FACTOR)[0]
    assert (np.sort(near, 1) <= np.sort(exact, 1)[:, -1:] + 1e-7).mean() >= 0.95


def test_recall_over_a_hundred_shards(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD", 60)
    rng = np.random.default_rng(4)
    points = rng.normal(size=(6000, 24)).astype(np.float32)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(points)]
    got = vptree.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, k=5).collect()
    units = points.astype(float) / np.linalg.norm(points.astype(float), axis=1)[:, None]
    hits = 0
    for q in range(0, 6000, 50):
        score = units @ units[q]
        score[q] = -2
        hits += len(set(np.argsort(-score)[:5].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert len(got) == 600 and hits >= 0.95 * 600


def test_few_candidates_and_empty_table(spark):
    got = vptree.nearest(frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0])]), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    assert vptree.nearest(frame(spark, [(0, [1.0, 0.0])]), F.col("vec_id") == 0).count() == 0
    assert vptree.nearest(frame(spark, []), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_range_join_agrees_with_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(rangejoin, "CELL", 60)
        monkeypatch.setattr(rangejoin, "BLOCK", 25)
    rows = vectors()
    ids, values = cosines(usable(rows))
    hit = values >= 0.9
    np.fill_diagonal(hit, False)
    label = {i: i for i in ids}
    while True:
        new = {i: min([label[i], *(label[ids[j]] for j in np.flatnonzero(hit[k]))]) for k, i in enumerate(ids)}
        if new == label:
            break
        label = new
    want = {i: (int(hit[k].sum()), label[i], label[i] == i) for k, i in enumerate(ids)}
    got = [tuple(r) for r in rangejoin.near_duplicates(frame(spark, rows)).collect()]
    assert len(got) == len(rows)
    for i, n, component, kept in got:
        if i in want and i != 20:  # row 20 stands three times under one id
            # Copies of row 20 aren't other ids, yet count as links of their class.
            extra = 2 if 20 in ids and hit[ids.index(i), ids.index(20)] else 0
            assert (n - extra, component, kept) == want[i]
        elif i not in want:
            assert (n, component, kept) == (0, i, True)


def test_range_join_of_an_empty_table(spark):
    assert rangejoin.near_duplicates(frame(spark, [])).count() == 0
    assert [tuple(r) for r in rangejoin.near_duplicates(frame(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]
