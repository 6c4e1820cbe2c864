from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import langid, toxicity
from corpusloom.llm.common import held_out
from tests.llm import cases

SF_DIR = os.environ.get("TEST_SF_DIR_LLM", "/root/testdata/sf0.01")
there = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@there
def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = langid.identify(docs, langid.fit(docs), ["doc_id", "lang"])
    rows = found.filter(held_out(F.col("doc_id")) & F.col("lang").isNotNull()).collect()
    assert len(rows) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_defined_cases(spark):
    docs = cases.documents(spark)
    found = langid.identify(docs, langid.fit(docs))
    assert set(found.columns) == set(docs.columns)
    rows = found.collect()
    assert len(rows) == len(cases.rows())
    for r in rows:
        known = bool(r["text"] and any(c.isalpha() for c in r["text"]))
        assert (r["lang_pred"] == "und") == (not known)
        assert r["lang_pred"] in ("und", "en", "de")
    nothing = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(docs, nothing, ["doc_id"]).collect()} == {("und", 0.0)}
    assert langid.identify(cases.empty(spark), langid.fit(cases.empty(spark))).count() == 0


def test_kernel_is_the_normalised_number_of_shared_grams():
    import numpy as np

    a, b = "abc abd", "Abd x"
    kept = np.unique(np.concatenate([langid.grams(a), langid.grams(b)]))
    model = langid.Model(kept, np.stack([np.isin(kept, langid.grams(t)) for t in (a, b)]).astype(np.uint8))
    sets = [set(langid.grams(t).tolist()) for t in (a, b)]
    want = len(sets[0] & sets[1]) / (len(sets[0]) * len(sets[1])) ** 0.5
    assert np.allclose(model.kernel([a, b]), [[1, want], [want, 1]], atol=1e-5)


def test_language_scores_are_kernel_ridge_regression(spark):
    """Where every training row is a landmark, the Nyström map is exact: compare with the dual solution over all kernels."""
    import zlib

    import numpy as np

    rng = random.Random(6)
    vocabulary = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(60)] for lang, letters in (("a", "abcdefgh"), ("b", "efghijkl"), ("c", "ijklabmn"))}
    text = lambda lang: " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.randrange(3, 25)))
    docs = [(k, text(lang), lang, "s", 1) + ("x",) * len(cases.CLASHES) for k in range(150) for lang in ["abc"[k % 3]]]
    model = langid.fit(cases.documents(spark, docs))
    train = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 5]
    sets = [set(langid.grams(d[1]).tolist()) for d in train]
    assert max(sum(d[2] == lang for d in train) for lang in "abc") <= langid.LANDMARKS_PER_LANGUAGE
    known = set().union(*sets)
    kernel = lambda x, y: len(x & y) / max(1.0, (len(x) * len(y)) ** 0.5)
    among = np.array([[kernel(x, y) for y in sets] for x in sets])
    n = len(train)
    centring = np.eye(n) - 1 / n
    wanted = np.where(np.array([d[2] for d in train])[:, None] == np.array(["a", "b", "c"])[None, :], 1.0, -1.0)
    offset = wanted.mean(axis=0)
    alpha = np.linalg.solve(centring @ among @ centring + langid.RIDGE * n / 100 * np.eye(n), wanted - offset)
    assert model.languages == ["a", "b", "c"]
    for probe in [text(lang) for lang in "abc" for _ in range(15)]:
        k = np.array([kernel(set(langid.grams(probe).tolist()) & known, x) for x in sets])
        want = (k - among.mean(axis=0)) @ centring @ alpha + offset
        assert np.allclose(model.kernel([probe]) @ model.weights + model.bias, want, atol=5e-3)


@there
def test_toxicity_of_held_out_texts(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.rate(docs, toxicity.fit(docs, labels), ["doc_id"]).join(labels, "doc_id")
    rows = found.filter(held_out(F.col("doc_id"))).collect()
    toxic, clean = [[r["score"] for r in rows if r["toxic"] == k] for k in (1, 0)]
    pairs = [(a > b) + (a == b) / 2 for a in toxic for b in clean]
    assert sum(pairs) / len(pairs) > 0.8
    assert sum(s < 0.5 for s in clean) / len(clean) > 0.9


def labelled(spark):
    rng = random.Random(1)
    calm = "the weather over some hills was fine and calm while boats went along green shores without any hurry".split()
    texts = [" ".join(rng.choices(calm, k=30)) for _ in range(300)]
    # Neighbours differ: a word counts once for each context.
    texts += [f"you are ab{chr(97 + k % 26)}{chr(97 + k // 26)} gruntish today" for k in range(150)]
    texts += [f"he said you are cd{chr(97 + k % 26)}{chr(97 + k // 26)} gruntish today" for k in range(150)]
    docs = cases.plain(spark, texts)
    labels = spark.createDataFrame([(k, int(300 <= k < 450)) for k in range(len(texts))], "doc_id bigint, toxic int")
    return docs, labels


def test_toxicity_weighs_the_clause(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    assert any(s.startswith("grunt") for s in model.stems)
    assert model.score("you are a gruntish one") >= 0.5 > model.score("he said you are a gruntish one")
    assert model.score(None) == model.score("") == model.score("nothing here") < 0.5


def test_toxicity_of_a_table_copied_many_times(spark):
    # 5 % toxic; a weak word stands in 40 toxic and 57 clean texts. The copies exceed both limits of the sample.
    rng = random.Random(2)
    calm = "the weather over some hills was fine and calm while boats went along green shores without any hurry".split()
    texts = []
    for k in range(1000):
        words = rng.choices(calm, k=20) + [f"z{''.join(rng.choices('abcdefghij', k=6))}", "grumpish", f"z{''.join(rng.choices('abcdefghij', k=6))}"]
        texts.append(" ".join(words if k < 40 or 50 <= k < 107 else words[:20]))
    docs = cases.plain(spark, texts).select("doc_id", "text").cache()
    labels = spark.createDataFrame([(k, int(k < 50)) for k in range(len(texts))], "doc_id bigint, toxic int").cache()
    copies = spark.range(120).select((F.col("id") * 10_000).alias("base"))
    many = [df.crossJoin(copies).withColumn("doc_id", F.col("doc_id") + F.col("base")).drop("base") for df in (docs, labels)]
    train = many[1].filter(~held_out(F.col("doc_id")))
    assert train.filter("toxic = 1").count() > toxicity.TOXIC_ROWS and train.filter("toxic = 0").count() > toxicity.CLEAN_ROWS
    once, often = toxicity.fit(docs, labels), toxicity.fit(*many)
    assert once.stems and 0.3 < once.score(texts[0]) < 0.5
    for text in texts[::7] + texts[:110]:
        assert abs(once.score(text) - often.score(text)) < 0.08
        assert (once.score(text) >= 0.5) == (often.score(text) >= 0.5)


def test_toxicity_defined_cases(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(k, k % 3 == 0 and 1 or None) for k in range(20)] + [(None, 1)], "doc_id bigint, toxic int")
    found = toxicity.rate(docs, toxicity.fit(docs, labels)).collect()
    assert len(found) == len(cases.rows())
    assert {(r["score"], r["predicted"]) for r in found} == {(0.0, 0)}
    empty = cases.empty(spark)
    assert toxicity.rate(empty, toxicity.fit(empty, labels.limit(0))).count() == 0


@pytest.mark.parametrize(
    ("classes", "labels"),
    [
        ("insult", "insult"),
        ("target other insult", "target other aimed"),
        ("insult other target", "aimed other target"),
        ("insult other other other other target", "insult other other other other target"),
        ("negation other insult", "negation other negated"),
        ("report target other insult", "report target other reported"),
        ("threat target", "threat target"),
        ("threat other other other other other target", "other other other other other other target"),
        ("negation threat target", "negation negated target"),
        ("other target threat", "other target other"),
    ],
)
def test_grammar(classes, labels):
    assert toxicity.grammar().best(classes.split()) == labels.split()
