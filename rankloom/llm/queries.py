"""Registered queries of this subpackage; each gets its rows through its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, html_text, lm, mixing, near_dedup, oracle, quality, repeats, secrets, shards
from .store import fresh, table


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = shards.shard_documents(table(spark, sf_dir, "documents"), fresh(spark, "shards"))
    text = F.coalesce("text", F.lit(""))
    version = F.lit(store.manifest()["version"])
    return store.read(shard="shard").select("doc_id", "shard", "source", F.octet_length(text).alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"), version.alias("version"))


def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op4_multinomial_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(mixing.Mix(table(spark, sf_dir, "documents")))


def op5_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85, rows=7, bands=36)


def op6_crf_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op7_consensus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op8_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.report(hits)


def op9_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op10_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


# the fixed columns of some queries again, where SQL can say what they are


def quality_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_rule_ensemble(spark, sf_dir).select("doc_id", "held_out")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_multinomial_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_crf_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_bottom_k(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_attention_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


_ALL = (op1_rule_ensemble, op2_tiered_shards, op3_suffix_repeats, op4_multinomial_mix, op5_hyperminhash, op6_crf_secrets, op7_consensus_paths, op8_prefix_decontamination, op9_bottom_k, op10_attention_lm, quality_split, mix_targets, secret_base_spans, edited_texts, lm_base_scores)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    """What SQL can express; the other queries are tested against brute force."""
    return {
        "op3_suffix_repeats": oracle.OP3, "op5_hyperminhash": oracle.OP5, "op8_prefix_decontamination": oracle.OP8, "quality_split": oracle.QUALITY_SPLIT,
        "mix_targets": oracle.MIX_TARGETS, "secret_base_spans": oracle.SECRET_BASE, "edited_texts": oracle.EDITED_TEXTS, "lm_base_scores": oracle.LM_BASE,
    }
