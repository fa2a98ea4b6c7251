"""The queries over the given tables, one for each operator, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, bpe, chat, decontaminate, fill_in_middle, langid, line_dedup, near_dup, oracles, quality, secret_scan, token_counts, toxicity
from .common import table

RANKS, PIECES, BYTE_LEVEL = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model", "byte_bpe_50k.json"


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    return bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return secret_scan.find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scan.written(F.filter(spans, lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        secret_scan.written(spans).alias("spans"),
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=True).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"),
        F.sha2(F.array_join("near_items", ","), 256).alias("near_sha256"),
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["end"])), ",")
    return chat.perspectives(table(spark, sf_dir, "conversations")).select(
        "conv_id", "perspective", "block", "n_turns", "n_own", F.sha2("text", 256).alias("text_sha256"), mask.alias("mask")
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    restored = fill_in_middle.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_LEVEL))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_ann": op2_ann,
    "op3_langid": op3_langid,
    "op4_quality": op4_quality,
    "op5_secrets": op5_secrets,
    "op6_decontaminate": op6_decontaminate,
    "op7_near_dup": op7_near_dup,
    "op8_bpe": op8_bpe,
    "op9_chat": op9_chat,
    "op10_line_dedup": op10_line_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_alignment": op12_alignment,
    "op13_token_counts": op13_token_counts,
}
ORACLES: dict[str, str] = {
    "op5_secrets": oracles.secrets(secret_scan.KINDS, secret_scan.SCOPE),
    "op6_decontaminate": oracles.OP6,
    "op7_near_dup": oracles.OP7,
    "op9_chat": oracles.OP9,
    "op10_line_dedup": oracles.OP10,
    "op11_fill_in_middle": oracles.OP11,
}
