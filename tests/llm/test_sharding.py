from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import sharding
from tests.llm import cases

SHARDS = [f"shard-{k:03d}" for k in range(64)]


def by_turns(shards, slots):
    """The rule with whole preference lists."""
    orders = []
    for s in shards:
        start, step = sharding.hash_of(s, "start") % slots, sharding.hash_of(s, "step") % (slots - 1) + 1
        orders.append([(start + k * step) % slots for k in range(slots)])
    table = {}
    while len(table) < slots:
        for number, order in enumerate(orders):
            free = next((x for x in order if x not in table), None)
            if free is not None:
                table[free] = number
    return [table[k] for k in range(slots)]


def test_table_is_filled_by_turns():
    for n in (1, 3, 7):
        assert sharding.lookup_table(SHARDS[:n], 101) == by_turns(SHARDS[:n], 101)


def test_load_is_even_and_most_slots_stay():
    table = sharding.lookup_table(SHARDS)
    load = Counter(table)
    assert len(load) == 64 and max(load.values()) - min(load.values()) <= 1
    fewer = sharding.lookup_table(SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 63)
    assert moved / len(table) < 0.2


def test_wrong_tables_are_refused():
    for shards, slots in (([], 101), (["a", "a"], 101), (["a"], 100), ([str(k) for k in range(8)], 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(shards, slots)


def test_place(spark):
    docs = cases.documents(spark)
    got = sharding.place(docs.withColumn("shard", F.lit(1)), "doc_id", SHARDS)
    assert sorted(got.columns) == sorted({*docs.columns, "slot", "shard"})
    rows = got.collect()
    assert len(rows) == len(cases.rows())
    table = sharding.lookup_table(SHARDS)
    import hashlib

    for r in rows:
        text = "" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r["slot"], r["shard"]) == (slot, SHARDS[table[slot]])
    assert sharding.place(cases.empty(spark), "doc_id", SHARDS).count() == 0
