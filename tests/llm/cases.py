"""Small documents with the awkward cases: nulls, empty and long texts, repeated rows, clashing column names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Extra columns whose names the operators use themselves.
CLASHES = ("score", "lang_pred", "predicted", "fp", "words", "ids", "length", "slot", "target", "covered", "kept", "tag", "doc", "size")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHES]
)


def sentence(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rows() -> list[tuple]:
    rng = random.Random(5)
    passage, long = sentence(rng, 40), sentence(rng, 30_000, 5000)
    base = [sentence(rng, rng.randrange(5, 120)) for _ in range(40)]
    texts = [None, "", " \t\n ", "one", "One ONE one", *base]
    texts += [base[3], base[3], base[3] + " more", base[4].upper(), f"{base[5]} {passage} {base[6]}", f"x {passage} y", passage]
    texts += [long, long + " tail", "ünïcödé ß 日本 " + base[7], "a  b\n\n\nc\t d", f"{base[8]}\n{base[9]}"]
    out = [(k, t, random.Random(k).choice(["en", "de", None]), random.Random(k).choice(["s1", "s2", "s3", None]), len(t or "")) for k, t in enumerate(texts)]
    out += [out[10], out[10], (12, "another text under a known id", "en", "s1", 29), (None, base[11], "en", "s2", 5), (None, None, None, None, None)]
    return [r + ("x",) * len(CLASHES) for r in out]


def documents(spark: SparkSession, some: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def plain(spark: SparkSession, texts: list[str | None], lang: str = "en", source: str = "s") -> DataFrame:
    return spark.createDataFrame([(k, t, lang, source, len(t or "")) + ("x",) * len(CLASHES) for k, t in enumerate(texts)], SCHEMA)
