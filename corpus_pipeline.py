"""Documents to packed training sequences: five stages, each over all that the one before kept.

language     documents whose language can't be told go (no text, no letters, or an ambiguous codeword)
near_copies  of each group of near copies the one of smallest doc_id stays
passages     words of passages that an earlier document has go; documents left without words go
benchmark    documents that hold benchmark passages go
packing      the rest is packed into sequences of 2048 tokens

A row without doc_id gets one in `language`, made of a hash of its text and larger than 2 ** 62.  Rows of
equal doc_id are told apart by their texts; of equal rows one stays, as they are copies of each other.
A table without rows gives no sequences.  Other columns than those of documents are left behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshspark.llm import decontaminate, langid, packing, queries, similarity, windows
from meshspark.llm.shared import load, materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _key() -> Column:
    """Of a row: by its id and text."""
    return F.xxhash64("doc_id", "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is told: not `und` and not ambiguous."""
    made = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), made).alias("doc_id"), *COLUMNS[1:])
    labelled = langid.predict(docs, langid.train(docs))
    return labelled.where(F.col("lang_pred") != langid.UNDETERMINED).where(~F.col("ambiguous")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component: that of smallest doc_id."""
    keyed = docs.select(*COLUMNS, _key().alias("_key"))
    groups = similarity.similar_groups(keyed, id_col="_key").select(F.col("doc_id").alias("_key"), "component_id").distinct()
    first = groups.join(keyed.select("_key", "doc_id"), "_key").groupBy("component_id").agg(F.min(F.struct("doc_id", "_key"))["_key"].alias("_key"))
    return keyed.join(first.select("_key"), "_key", "left_semi").dropDuplicates(["_key"]).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated windows; n_chars follows the text."""
    cut = windows.substring_dedup(docs.select(*COLUMNS), with_text=True)
    kept = cut.where(F.col("n_removed") < F.col("n_words"))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a benchmark passage."""
    keyed = docs.select(*COLUMNS, _key().alias("_key"))
    hits = decontaminate.contamination(keyed.select(F.col("_key").alias("doc_id"), "text"), load(spark, sf_dir, "benchmark"))
    bad = hits.where("contaminated").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(bad, "_key", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and offset."""
    return packing.pack_documents(docs, queries.BYTE_BPE)


STAGES = [("language", language), ("near_copies", near_copies), ("passages", passages), ("benchmark", benchmark), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
