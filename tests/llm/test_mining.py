from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mining
from tests.llm.test_vectors import SCHEMA


def rows():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 11))
    each = [(centres[k % 6] + rng.normal(size=11) * rng.choice([0.2, 1.0])) / 4 for k in range(300)]
    out = [(k, [float(np.float32(x)) for x in v], int(rng.integers(4))) for k, v in enumerate(each)]
    # A large group of copies, with the same label and with others.
    out += [(300 + k, out[7][1], 1) for k in range(60)] + [(400 + k, out[7][1], k % 4) for k in range(40)]
    nan, inf = float("nan"), float("inf")
    bad = [None, [nan] * 11, [inf] + [1.0] * 10, [None] + [1.0] * 10, [], [1.0, 2.0]]
    out += [(1000 + 10 * k, b, 1) for k, b in enumerate(bad)] + [(1100, out[3][1], None), (None, out[3][1], 1), (1110, [0.0] * 11, 2), (1120, [1e30] * 11, 2)]
    return out + [out[20], out[20]]


def brute(table, anchor, positives=5, negatives=10):
    usable = {}
    for i, v, label in table:
        if i is not None and label is not None and v and len(v) == 11 and None not in v and np.isfinite(v).all():
            q = [max(min(math.floor(256 * x), mining.LIMIT), -mining.LIMIT) for x in v]
            usable[i] = min(usable.get(i, (label, q)), (label, q))
    out = set()
    for a in filter(anchor, usable):
        label, q = usable[a]
        scored = sorted((-sum(x * y for x, y in zip(q, w, strict=True)), i, m) for i, (m, w) in usable.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            hard = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out |= {(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(hard)}
    return out


def frame(spark, table):
    return spark.createDataFrame([(i, v, label, "x", "x", "x", "x") for i, v, label in table], SCHEMA)


@pytest.mark.parametrize("small", [False, True])
def test_agrees_with_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("CELL", 6), ("BLOCK", 5), ("FIRST", 20), ("ANCHORS", 4)):
            monkeypatch.setattr(mining, name, value)
    got = mining.hard_negatives(frame(spark, rows()), F.col("vec_id") % 10 == 0).collect()
    want = brute(rows(), lambda i: i % 10 == 0)
    assert len(got) == len(want) > 500
    assert {tuple(r) for r in got} == want


def test_walk_visits_only_what_may_enter_a_window():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(8, 8))[rng.integers(8, size=4000)] * 100 + rng.normal(size=(4000, 8))
    points = np.floor(points).astype(int)
    books = [mining.codebook(points[:, :4].astype(float), 8), mining.codebook(points[:, 4:].astype(float), 8)]
    (a, ra), (b, rb) = (mining.nearest_code(points[:, s].astype(float), book) for s, book in ((slice(4), books[0]), (slice(4, 8), books[1])))
    cells = {}
    for cell in sorted(set(zip(a.tolist(), b.tolist(), strict=True))):
        at = (a == cell[0]) & (b == cell[1])
        cells[cell] = (int(at.sum()), float(ra[at].max()), float(rb[at].max()), len(cells), 1)
    walk = mining.Walk(books, cells, 100)
    of_block = {c[3]: (a == x) & (b == y) for (x, y), c in cells.items()}
    for q in points[::500]:
        score = points @ q
        bounds = [x[0] for x in walk.of(q)]
        assert bounds == sorted(bounds, reverse=True) and len(bounds) == len(cells)
        kth = int(np.sort(score)[-50])
        seen = walk.visits(q, False, None, None) + walk.visits(q, True, kth, None)
        assert sum(of_block[k] for k in seen)[score >= kth].all()
        assert len(seen) < len(cells)


def test_small_and_empty_tables(spark):
    assert mining.hard_negatives(frame(spark, []), F.col("vec_id") == 0).count() == 0
    assert mining.hard_negatives(frame(spark, [(0, [1.0, 0.0], 1)]), F.col("vec_id") == 0).count() == 0
    some = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (3, [0.95, 0.0], 2), (4, [0.1, 9.0], 2)]
    got = [tuple(r) for r in mining.hard_negatives(frame(spark, some), F.col("vec_id") == 0).collect()]
    assert got == [(0, 1, 1, 2, 65536, 32768)]
    one = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)]
    assert [tuple(r) for r in mining.hard_negatives(frame(spark, one), F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 65536, 32768)]
