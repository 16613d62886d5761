"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm import decontaminate, divergence, mixing, phrases, pii, quality, secrets, simhash, substrings, suffixes, tokens, toxicity, warc
from chronoloom.llm.common import dropped_shuffles, small_batches, table


def whole(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table, whose texts go to Python in small batches."""
    small_batches(spark)
    return table(spark, sf_dir, name)


def op1_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(whole(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(whole(spark, sf_dir, "documents"))


def op3_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(whole(spark, sf_dir, "documents"))
    return rows.select("row.doc_id", "domain", "language", "source", "n_tokens", "copies")


def op4_inverted_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(whole(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def near_benchmark_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4's proximity matches: test phrases whose words stand a few words off their places."""
    return decontaminate.contamination(whole(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=decontaminate.SLOP)


def op5_gated_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(whole(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_repair_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_round_trip(whole(spark, sf_dir, "documents"))


def op7_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(whole(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(whole(spark, sf_dir, "documents"))


def op9_deobfuscated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(whole(spark, sf_dir, "documents"))


def op10_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(whole(spark, sf_dir, "documents"))


def op11_vocabulary_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(whole(spark, sf_dir, "documents"))


def op12_prefix_growth_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    with dropped_shuffles(spark):
        return phrases.collocations(whole(spark, sf_dir, "documents"))


def op13_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.detect(whole(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_dictionary": op1_warc_dictionary,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_hierarchical_mixing": op3_hierarchical_mixing,
    "op4_inverted_index_decontamination": op4_inverted_index_decontamination,
    "near_benchmark_phrases": near_benchmark_phrases,
    "op5_gated_recurrent_toxicity": op5_gated_recurrent_toxicity,
    "op6_repair_token_shards": op6_repair_token_shards,
    "op7_risk_controlled_quality": op7_risk_controlled_quality,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_deobfuscated_pii": op9_deobfuscated_pii,
    "op10_difference_cover_dedup": op10_difference_cover_dedup,
    "op11_vocabulary_divergence": op11_vocabulary_divergence,
    "op12_prefix_growth_collocations": op12_prefix_growth_collocations,
    "op13_linked_secrets": op13_linked_secrets,
}
ORACLES: dict[str, str] = {
    "op1_warc_dictionary": warc.ORACLE,
    "op3_hierarchical_mixing": mixing.ORACLE,
    "op4_inverted_index_decontamination": decontaminate.ORACLE,
    "near_benchmark_phrases": decontaminate.NEAR_ORACLE,
    "op7_risk_controlled_quality": quality.ORACLE,
    "op8_suffix_array_dedup": suffixes.ORACLE,
    "op10_difference_cover_dedup": substrings.ORACLE,
    "op11_vocabulary_divergence": divergence.ORACLE,
    "op12_prefix_growth_collocations": phrases.ORACLE,
}
