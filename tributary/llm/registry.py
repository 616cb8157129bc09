"""The queries opN_<name> over the whole tables, by their contracts, and the oracle SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import bpe, lexical, lm, mixing, neardup, oracles, packing, pii, quality, resample, secrets, sharding, topk, warc
from tributary.session import materialize, table


def op1_nra_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score")


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"))
    dealt = sharding.shard_by_bytes(rows, F.col("key"), F.col("size"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_importance_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.find(table(spark, sf_dir, "documents"), size=2)


def op6_bounded_space_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), order=3)


def op8_assignment_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op9_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.by_page(warc.round_trip(table(spark, sf_dir, "pages")))


def op10_bpe_word_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                             public_tokenizers.PATTERN, keep_ids=False)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    mixed = mixing.mix(materialize(sizes, "sizes"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op13_impact_ordered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_nra_top_k": op1_nra_top_k,
    "op2_pii_spans": op2_pii_spans,
    "op3_histogram_sort": op3_histogram_sort,
    "op4_importance_rules": op4_importance_rules,
    "op5_lsh_forest": op5_lsh_forest,
    "op6_bounded_space_packing": op6_bounded_space_packing,
    "op7_elias_fano_lm": op7_elias_fano_lm,
    "op8_assignment_secrets": op8_assignment_secrets,
    "op9_warc_transactions": op9_warc_transactions,
    "op10_bpe_word_shuffle": op10_bpe_word_shuffle,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_pareto_mixing": op12_pareto_mixing,
    "op13_impact_ordered_search": op13_impact_ordered_search,
}
ORACLES: dict[str, str] = {
    "op1_nra_top_k": oracles.TOP_K,
    "op5_lsh_forest": oracles.NEAR_DUPLICATES,
    "op9_warc_transactions": oracles.WARC,
    "op11_importance_resampling": oracles.RESAMPLE,
    "op12_pareto_mixing": oracles.MIXING,
    "op13_impact_ordered_search": oracles.SEARCH,
}
