"""Queries of the corpus operators over the test tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adgauge.llm import codes, exact, licenses, lm, mixing, packing, quality, repeats, sharding, simhash, tokens, turns, urls
from adgauge.llm.common import table

SHARDS = 16
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(table(spark, folder, "pages").select("page_id", "url")).drop("url")


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge_quality(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*first, *[c for c in judged.columns if c not in first])


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents").select("doc_id", "text", "lang", "source")).drop("text", "lang", "source")


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.place(table(spark, folder, "documents").select("doc_id", "text"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        "spans", F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact.find_copies(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, tokens.read_vocabulary(VOCABULARY)).drop("text")


def op10_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.find_near(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.compress(table(spark, folder, "embeddings")).drop("label")


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    return turns.repair(conversations, turns.damage(conversations))


def op13_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_texts(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_license_scan, op3_url_filter, op4_quality_rules, op5_mixing, op6_sharding,
        op7_suffix_array_dedup, op8_exact_dedup, op9_token_counts, op10_simhash_near_dedup,
        op11_vector_codes, op12_conversation_repair, op13_lm_scoring,
    )
}
ORACLES = {"op2_license_scan": licenses.SQL, "op3_url_filter": urls.SQL, "op8_exact_dedup": exact.SQL, "op11_vector_codes": codes.SQL}
