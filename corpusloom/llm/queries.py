"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import alignment, langid, mining, mixing, packing, rangejoin, sanitising, sharding, simhash, substrings, token_files, toxicity, vptree
from corpusloom.llm import sql as duckdb_sql
from corpusloom.llm.common import held_out, require, stored, table
from corpusloom.runtime import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Fitted models, tokenizers and XXH64 are not expressible in SQL; op5's scores differ in their last bits.
ORACLES: dict[str, str] = {
    "op4_mixing": duckdb_sql.MIXING, "op6_substrings": duckdb_sql.SUBSTRINGS, "op8_rangejoin": duckdb_sql.RANGE_JOIN,
    "op11_mining": duckdb_sql.HARD_NEGATIVES,
}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = require(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    found = langid.identify(docs, langid.fit(docs), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = require(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = toxicity.rate(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of all documents with their place in the packed sequences; ids as a checksum."""
    pieces = packing.cut_documents(docs, tokenizer_file("word_bpe_49k.json"))
    narrow = stored(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), "pieces")
    return packing.pack(narrow)


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(mixing.mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


@query
def op5_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: Names of the shards that documents are placed on.
SHARDS = [f"shard-{k:03d}" for k in range(64)]


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(require(table(spark, sf_dir, "documents"), "doc_id"), "doc_id", SHARDS)
    return placed.select("doc_id", "slot", "shard")


@query
def op8_rangejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangejoin.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_file("byte_bpe_50k.json"))
    return token_files.digests(token_files.read_token_files(spark, folder))


@query
def op11_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    return mining.hard_negatives(table(spark, sf_dir, "embeddings"), vec_id % 100 == 0, F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


@query
def op13_sanitising(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitising.digests(sanitising.personal_data(table(spark, sf_dir, "documents")))
