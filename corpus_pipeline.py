"""From raw documents to token ids: five stages, each written as Parquet and read by the next.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the
last return the columns of documents. Texts emptied by a stage stay as rows; an empty table
gives no rows; columns of documents keep their values whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from survlake.llm import bpe, decontam, jaccard, language, suffixes
from survlake.llm.queries import tokenizer_path
from survlake.llm.tables import read, stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or in no language the network is sure of go."""
    return language.accepted(docs, language.fit(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row stays: the smallest doc_id, then the smallest hash of the text.

    Rows equal in both, also such with a null doc_id, count as copies: one of them stays. A null doc_id comes last.
    """
    text_hash = F.coalesce(F.xxhash64("text"), F.lit(0))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), text_hash.alias("hash"))
    found = jaccard.near_duplicates(docs.select(key.alias("doc_id"), "text"))
    stay = stored(found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
                  .select(F.col("doc_id.id").alias("_id"), F.col("doc_id.hash").alias("_of"), "_n"))
    keyed = docs.withColumn("_hash", text_hash)
    once, often = (keyed.join(stay.where(c).withColumnRenamed("_of", "_hash_of"), keyed["doc_id"].eqNullSafe(F.col("_id"))
                              & (keyed["_hash"] == F.col("_hash_of")), "left_semi") for c in ("_n = 1", "_n > 1"))
    return once.unionByName(often.dropDuplicates(["doc_id", "_hash"])).select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 50 and more that a document with a smaller doc_id has are cut out; null text becomes empty."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = suffixes.remove_repeats(docs, carry=carry, with_text=True).withColumn("text", F.col("kept"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("kept").cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark window go."""
    judged = decontam.decontaminate(docs.select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    bad = judged.where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    keyed = docs.withColumn("_text_hash", F.coalesce(F.xxhash64("text"), F.lit(0)))
    return keyed.join(bad, keyed["doc_id"].eqNullSafe(bad["_id"]) & (keyed["_text_hash"] == bad["_hash"]), "left_anti").drop("_text_hash")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids."""
    return bpe.encode_documents(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_near_copies),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmarks),
    ("BPE encoding and decoding", token_ids),
]

#: Training a network and merging suffixes are not expressible in SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
