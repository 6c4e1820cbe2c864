from __future__ import annotations

import os
import random

import pytest

import corpus_pipeline
from corpusloom.llm import mixing
from corpusloom.llm.common import stored
from tests.llm import cases
from tests.llm.test_duplicates import repeats_brute, simhash_brute

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(docs):
    return [tuple(r) for r in docs.collect()]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_stages_agree_with_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    kept = stored(stages["language"](spark, docs, SF_DIR), "t")
    assert kept.columns == columns
    assert {r[0] for r in rows(docs.select("doc_id", "text")) if any(c.isalpha() for c in r[1] or "")} == {r[0] for r in rows(kept)}
    unique = stored(stages["near_duplicates"](spark, kept, SF_DIR), "t")
    want = {i for i, _, c in simhash_brute(rows(kept.select("doc_id", "text"))) if i == c}
    assert unique.columns == columns
    assert sorted(r[0] for r in rows(unique)) == sorted(want)
    cut = stored(stages["repeated_passages"](spark, unique, SF_DIR), "t")
    brute = {r[0]: r for r in repeats_brute(rows(unique.select("doc_id", "text")), 13)}
    before = dict(rows(unique.select("doc_id", "text")))
    assert cut.columns == columns
    for doc_id, text in rows(cut.select("doc_id", "text")):
        assert text == (brute[doc_id][3] if brute[doc_id][2] else before[doc_id])
    mix = stored(stages["mixed"](spark, cut, SF_DIR), "t")
    assert mix.columns == columns
    taken = {r["doc_id"]: r["taken"] for r in mixing.mixed_sizes(mixing.mix(cut)).collect()}
    got = dict.fromkeys(taken, 0)
    for doc_id, text in rows(mix.select("doc_id", "text")):
        got[doc_id] += len(text.split())
    assert got == taken
    packed = stages["packing"](spark, mix, SF_DIR).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)
    assert {r["doc_id"] for r in packed} == {r[0] for r in rows(mix)}


def test_awkward_documents_pass_through(spark):
    docs = cases.documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, ""), "t")
        assert docs.columns == cases.SCHEMA.names
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count() > 0
    empty = cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0


def test_language_keeps_documents_whatever_the_number_of_languages(spark):
    nothing = cases.plain(spark, ["one two three", "vier", "12 !"], lang=None)
    assert corpus_pipeline.language(spark, nothing, "").count() == 3
    # Forty languages that share their words: none stands out.
    some = [(k, "pa re mi to", f"l{k % 40}", "s", 11) + ("x",) * len(cases.CLASHES) for k in range(400)]
    docs = cases.documents(spark, [*some, (400, "12 !", "l0", "s", 4) + ("x",) * len(cases.CLASHES)])
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").select("doc_id").collect()} == set(range(400))


def test_language_fills_what_is_missing(spark):
    texts = {"en": "the cat and the dog went over the hill with the others", "de": "der Hund und die Katze gingen mit den anderen nach Hause"}
    some = [(k, f"{texts[lang]} {k}", lang if k < 200 else None, "s", 50) + ("x",) * len(cases.CLASHES) for k in range(260) for lang in [("en", "de")[k % 2]]]
    got = corpus_pipeline.language(spark, cases.documents(spark, some), "").collect()
    assert len(got) == 260 and all(r["lang"] == ("en", "de")[r["doc_id"] % 2] for r in got)


def test_near_duplicates_decide_per_row(spark):
    rng = random.Random(3)
    one, two, three, four = (cases.sentence(rng, 60, 3000) for _ in range(4))
    some = [(1, one), (5, one), (5, two), (7, two), (7, three), (7, three), (9, None), (8, ""), (None, four), (None, four), (None, one), (None, three)]
    docs = cases.documents(spark, [(i, t, "en", "s", 1) + ("x",) * len(cases.CLASHES) for i, t in some])
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == sorted([(1, one), (5, two), (7, three), (8, ""), (0, four)])


def test_every_dealt_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert any(name.startswith(f"op{n}_") for name in names)
