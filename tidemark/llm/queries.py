"""The registered queries of the training-data operators, with production parameters on whole tables.

None of them has an oracle in SQL: the fingerprints, components, tokens, packings and models aren't
expressible there, or too slow on whole tables.  ``tests/llm`` holds them against brute force, planted
truth or invariants instead, as the README says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, kdshards, lines, packing, pii, quality, repeats, rules, simhash, warc
from .common import table


def op1_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdshards.shard(table(spark, sf_dir, "documents"), shards=8)


def op7_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rules.judge(table(spark, sf_dir, "documents")).select("doc_id", *counted, "base_failed", "kept", "p_good")


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages"))).drop("record")


def op10_prefix_free_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bradley_terry, op2_decontaminate, op3_simhash, op4_contextual_pii, op5_fuzzy_lines, op6_kd_shards, op7_sum_of_squares, op8_weak_rules, op9_warc_derivatives, op10_prefix_free_repeats)
}
ORACLE: dict[str, str] = {}
