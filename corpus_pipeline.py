"""From raw documents to packed training sequences, in stages of the training-data operators.

Each stage takes the documents that its predecessor kept, written and read again in between, and its decisions take
effect. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import langid, mixing, simhash, substrings
from corpusloom.llm.common import stored, table
from corpusloom.llm.queries import packed


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters have no language and go; the others get the language found for them where they name
    none. Where no language could be learned, all documents stay as they are. A low score is no reason to drop: it is
    shared out over all learned languages, so what it means depends on their number."""
    model = langid.fit(docs)
    if not model.languages:
        return docs
    found = langid.identify(docs, model)
    named = F.coalesce(F.col("lang").cast("string"), F.col("lang_pred")).cast(docs.schema["lang"].dataType).alias("lang")
    return found.filter(F.col("lang_pred") != langid.UNKNOWN).select(*[named if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints link, directly or through others, the one with the smallest doc_id stays; where
    none has an id, one of them. Rows that share an id are told apart by their fingerprints: another text under a known id
    is judged by its own links, and of several rows of the smallest id the least (fingerprint, then text) stays."""
    found = stored(simhash.near_duplicates(docs).withColumn("keeps", F.col("doc_id").eqNullSafe(F.col("component_id"))), "groups")
    rows_of = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("keeps").alias("keeps")).filter("keeps")
    ids = lambda where: rows_of.filter(where).select("doc_id")
    once = docs.join(ids("n = 1 AND doc_id IS NOT NULL"), "doc_id", "left_semi").select(*docs.columns)
    # The few rows of shared or missing ids are fingerprinted again, with their columns.
    shared = docs.join(ids("n > 1 AND doc_id IS NOT NULL"), "doc_id", "left_semi").select(*docs.columns)
    again = simhash.fingerprints(shared.unionByName(docs.filter("doc_id IS NULL")), keep=docs.columns)
    roots = found.filter("keeps").select("doc_id", "fp", "root").distinct()
    again = again.join(roots.withColumnRenamed("doc_id", "own"), (F.col("own").eqNullSafe(F.col("doc_id"))) & (roots["fp"] == again["fp"])).select("root", again["fp"], "others")
    first = again.groupBy("root").agg(F.min(F.struct("fp", F.col("others.text").alias("text"), "others")).alias("x"))
    return once.unionByName(first.select("x.others.*"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words go that stand in a passage of 13 or more words which an earlier document has; other texts stay as they
    are. A document of which nothing is left stays with an empty text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    found = substrings.remove_repeats(docs, keep=others, as_written=True)
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return found.select(*[made.get(c, F.col(f"others.`{c}`")).alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by target weights: a document comes once for each pass that takes it."""
    return mixing.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences of 2048."""
    return packed(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixed", mixed),
    ("packing", packing),
]

#: Fingerprints, tokenizers and the language model are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
