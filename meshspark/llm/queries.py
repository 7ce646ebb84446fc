"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .shared import load
from .tokens import public

WORD_BPE, BYTE_BPE = public("word_bpe_49k.json", drop_space=True), public("byte_bpe_50k.json", drop_space=False)


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .records import token_records

    return token_records(load(spark, sf_dir, "documents"), WORD_BPE)


def op2_difference_cover_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import remove_repeats

    return remove_repeats(load(spark, sf_dir, "documents"))


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(load(spark, sf_dir, "documents"))


def op4_fragment_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .similarity import similar_groups

    return similar_groups(load(spark, sf_dir, "documents"))


def op5_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(load(spark, sf_dir, "documents"), BYTE_BPE)


def op6_crf_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import deduplicated

    return deduplicated(load(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id")


def op8_doubled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .windows import substring_dedup

    return substring_dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op10_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(load(spark, sf_dir, "documents"))


def op11_lobpcg_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(load(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .counts import token_counts

    return token_counts(load(spark, sf_dir, "documents"), BYTE_BPE)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_records, op2_difference_cover_repeats, op3_feistel_shards, op4_fragment_jaccard, op5_configuration_packing, op6_crf_line_quality, op7_warc_revisits, op8_doubled_windows, op9_wu_manber_decontamination, op10_ecoc_language, op11_lobpcg_whitening, op12_token_counts, op13_source_divergence)}

ORACLE_SQL: dict[str, str] = {
    "op4_fragment_jaccard": oracles.FRAGMENT_JACCARD,
    "op7_warc_revisits": oracles.WARC_REVISITS,
    "op8_doubled_windows": oracles.DOUBLED_WINDOWS,
    "op9_wu_manber_decontamination": oracles.WU_MANBER,
    "op13_source_divergence": oracles.SOURCE_DIVERGENCE,
}
