from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from corpusloom.llm import simhash, substrings
from corpusloom.llm.common import components, local_components
from tests.llm import cases

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    data = (text or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", data.translate(LOWER) if lower else data)


def fingerprint(text):
    found = words(text, lower=True)
    if not found:
        return 0
    values = [xxhash.xxh64_intdigest(b" ".join(found[i : i + 4]), 42) for i in range(max(1, len(found) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def linked_groups(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def simhash_brute(rows):
    fps = [(r[0], fingerprint(r[1])) for r in rows]
    distinct = sorted({f for _, f in fps})
    group = linked_groups(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 4])
    low = {}
    for i, f in fps:
        if i is not None:
            low[group[f]] = min(low.get(group[f], i), i)
    return sorted(((i, f, low.get(group[f])) for i, f in fps), key=str)


def simhash_found(docs, **options):
    return sorted(((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(docs, **options).collect()), key=str)


def test_simhash_agrees_with_brute_force(spark):
    assert simhash_found(cases.documents(spark)) == simhash_brute(cases.rows())


@pytest.mark.parametrize("block", [2048, 8])
def test_simhash_near_copies_with_crowded_keys(spark, monkeypatch, block):
    rng = random.Random(2)
    base = cases.sentence(rng, 300, 3000).split()
    texts = [cases.sentence(rng, 60) for _ in range(30)]
    for _ in range(60):
        copy = list(base)
        copy[rng.randrange(len(copy))] = f"new{rng.randrange(9)}"
        texts.append(" ".join(copy))
    monkeypatch.setattr(simhash, "BLOCK", block)
    docs = cases.plain(spark, texts)
    assert simhash_found(docs) == simhash_brute([(k, t) for k, t in enumerate(texts)])


def test_every_near_fingerprint_shares_a_key():
    rng = np.random.default_rng(1)
    left = rng.integers(0, 1 << 64, 2000, dtype=np.uint64)
    right = left.copy()
    for k in range(len(right)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            right[k] ^= np.uint64(1) << np.uint64(bit)
    a, b = ({*zip(*(x.tolist() for x in simhash.key_rows(f)), strict=True)} for f in (left, right))
    assert {row for _, row in a & b} == set(range(len(left)))


def test_components_of_long_chains(spark):
    rng = random.Random(7)
    links = [(k, k + 1) for k in range(200) if k % 50 != 49] + [(1000, k) for k in range(1001, 1100)] + [(5, 5)]
    rng.shuffle(links)
    nodes = {n for link in links for n in link}
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == linked_groups(nodes, links)
    a, b = (np.array([link[k] for link in links]) for k in (0, 1))
    label = local_components(1200, a, b)
    assert {n: int(label[n]) for n in nodes} == linked_groups(nodes, links)


def repeats_brute(rows, window):
    first, out = {}, []
    last = (1 << 63) - 1

    def rank(i, text):
        return last - (42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42) & 0xFFFFFFFF) if i is None else i

    for i, text, *_ in rows:
        found = words(text)
        for p in range(len(found) - window + 1):
            key = tuple(found[p : p + window])
            first[key] = min(first.get(key, last), rank(i, text))
    for i, text, *_ in rows:
        found = words(text)
        gone = [False] * len(found)
        for p in range(len(found) - window + 1):
            if first[tuple(found[p : p + window])] < rank(i, text):
                gone[p : p + window] = [True] * window
        out.append((i, len(found), sum(gone), b" ".join(w for w, g in zip(found, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


def repeats_found(docs, **options):
    return sorted((tuple(r) for r in substrings.remove_repeats(docs, **options).collect()), key=str)


@pytest.mark.parametrize("window", [6, 13])
def test_substrings_agree_with_brute_force(spark, window):
    assert repeats_found(cases.documents(spark), window=window) == repeats_brute(cases.rows(), window)


def test_substrings_with_passages_in_very_many_documents(spark, monkeypatch):
    rng = random.Random(9)
    shared = [cases.sentence(rng, 30) for _ in range(4)]
    texts = []
    for _ in range(300):
        parts = [cases.sentence(rng, rng.randrange(0, 30), 50)] + rng.sample(shared, rng.randrange(0, 3)) + [cases.sentence(rng, 10)]
        texts.append(" ".join(parts))
    texts += texts[:20]
    monkeypatch.setattr(substrings, "ANCHORS_AT_ONCE", 50)
    docs = cases.plain(spark, texts).repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        assert repeats_found(docs) == repeats_brute(list(enumerate(texts)), 13)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_prefixes_keep_equal_suffixes_together():
    rng = random.Random(12)
    pool = [cases.sentence(rng, 60, 12) for _ in range(40)]
    hot = "h1 h2 h3 h4 h5 h6"
    suffixes = [b" ".join(t.encode().split()[k : k + 6]) for t in pool for k in range(55)] + [hot.encode()] * 6000
    made = substrings.Prefixes(rng.sample(suffixes, 1500), 40, 6)
    assert len({p.count(b" ") for p in made.nodes if p}) >= 2  # prefixes of several lengths
    group = {}
    for doc, text in enumerate([*pool, *[hot] * 500]):
        words = text.encode().split()
        begin = [0]
        for w in words:
            begin.append(begin[-1] + len(w) + 1)
        for at in range(len(words) - 5):
            found = made.group(b" ".join(words), begin, at, doc)
            assert 0 <= found < made.groups
            group.setdefault(tuple(words[at : at + 6]), set()).add(found)
    for key, groups in group.items():
        assert len(groups) == 1 or groups <= made.split, key
    assert len(group[tuple(hot.encode().split())]) > 5
    sizes = [sum(found in groups for groups in group.values()) for found in range(made.groups)]
    assert max(sizes) < 0.2 * sum(sizes)
    assert substrings.Prefixes([], 32, 13).group(b"a b c d", [0, 2, 4, 6, 8], 1, 5) < 8


@pytest.mark.parametrize("sample", [0, 40, 5000])
def test_substrings_don_t_depend_on_the_sample(spark, monkeypatch, sample):
    monkeypatch.setattr(substrings, "SAMPLE", sample)
    rng = random.Random(sample)
    passage = cases.sentence(rng, 25)
    texts = [f"{cases.sentence(rng, 8)} {passage if k % 2 else ''} {cases.sentence(rng, 20, 4)}" for k in range(120)]
    assert repeats_found(cases.plain(spark, texts).repartition(5)) == repeats_brute(list(enumerate(texts)), 13)


def test_empty_tables(spark):
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0
    assert substrings.remove_repeats(cases.empty(spark)).count() == 0
