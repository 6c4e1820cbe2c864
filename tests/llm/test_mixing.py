from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import functions as F

from corpusloom.llm import mixing
from tests.llm import cases


def targets(sizes: dict) -> dict:
    """Water filling by rounds, as the rule says it."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mix_meets_the_targets(spark):
    got = mixing.mixed_sizes(mixing.mix(cases.documents(spark))).collect()
    sizes, taken, count = defaultdict(int), defaultdict(int), len(cases.rows())
    for _, text, _, source, *_ in cases.rows():
        sizes[source] += len(words(text))
    assert len(got) == count
    want = targets(sizes)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for source, target in want.items():
        assert abs(taken[source] - target) <= 0.02 * target + 20


def test_reruns_agree(spark):
    one, two = (sorted(map(tuple, mixing.mixed_sizes(mixing.mix(cases.documents(spark).repartition(n))).drop("row_id").collect()), key=str) for n in (2, 5))
    assert one == two


def test_targets_with_caps_and_ties(spark):
    for sizes in ({"a": 10, "b": 10, "c": 10, "d": 1000}, {"a": 5, "b": 2, "c": 1}, {"a": 0, "b": 7, None: 9}, {"a": 0}, {"x": 3}):
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
        assert got.keys() == sizes.keys()
        assert all(abs(got[s] - t) < 1e-9 * max(1, t) for s, t in targets(sizes).items())


def test_slots_follow_the_targets_at_every_prefix(spark):
    rows = spark.createDataFrame([("a", 0, 60.0), ("b", 0, 30.0), (None, 0, 10.0)], "source string, source_size bigint, target double")
    slots = mixing.schedule(rows, 1, 1000).orderBy("slot").collect()
    assert [r["slot"] for r in slots] == list(range(1000))
    seen = defaultdict(int)
    for n, r in enumerate(slots, 1):
        assert r["turn"] == seen[r["source"]]
        seen[r["source"]] += 1
        for source, share in (("a", 0.6), ("b", 0.3), (None, 0.1)):
            assert abs(seen[source] - n * share) < 8


def test_mixed_documents_hold_the_words_taken(spark):
    docs = cases.documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"]).cache()
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got, size = defaultdict(int), {}
    for r in out.collect():
        got[r["doc_id"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    for r in mixing.mixed_sizes(mixing.mix(docs)).collect():
        size[r["doc_id"]] = r["taken"]
    assert got == {k: v for k, v in size.items() if v}


def test_tiny_sources_beside_huge_ones_meet_their_targets(spark):
    # Documents of 5,000 words, long enough together for blocks of hundreds of words.
    long = F.array_join(F.array_repeat(F.lit("w"), 5000), " ")
    small = [("a", 1), ("b", 7), ("c", 100), ("d", 300), ("e", 500), ("f", 1000), ("g", 2000), ("h", 6000), ("i", 20_000), (None, 4500)]
    huge = spark.range(3000).select(F.col("id").alias("doc_id"), long.alias("text"), F.when(F.col("id") < 2000, "x").otherwise("y").alias("source"))
    tiny = [(10_000 + 100 * k + part, " ".join(["w"] * (n // 2 + n % 2 if part else n // 2)), s) for k, (s, n) in enumerate(small) for part in (0, 1)]
    docs = huge.unionByName(spark.createDataFrame(tiny, "doc_id bigint, text string, source string"))
    parts = mixing.mix(docs).cache()
    taken = {r["source"]: (r["taken"], r["target"]) for r in mixing.mixed_sizes(parts).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert taken.keys() == {"x", "y", *(s for s, _ in small)}
    for source, (got, target) in taken.items():
        assert abs(got - target) <= 0.01 * target + 0.5, source
    for source, n in small:
        slots = [r["slot"] for r in parts.filter(F.col("source").eqNullSafe(F.lit(source)) & F.col("slot").isNotNull()).select("slot").collect()]
        if n >= 300:
            # Spread over the whole schedule (of about 65,536 slots), not bunched.
            assert abs(sum(slots) / len(slots) / 65_536 - 0.5) < 0.1, source


def test_empty_tables(spark):
    assert mixing.mixed_sizes(mixing.mix(cases.empty(spark))).count() == 0
    nothing = cases.documents(spark, [(1, None, None, "s", None) + ("x",) * len(cases.CLASHES)])
    assert [r["taken"] for r in mixing.mixed_sizes(mixing.mix(nothing)).collect()] == [0]
