"""From raw documents to token ids: quality, repeated lines, near-duplicates, test items, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanlake.llm import bpe, decontaminate, line_dedup, near_dup, quality
from cleanlake.llm.common import cut, labelled_sample, small_enough, table

#: A document stays if the classifier gives it at least this probability of being good.
GOOD = 0.7
LEARN_FOLDS, LEFT_OUT = 4, 2
RANKS = "byte_bpe_50k.tiktoken"


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one, so that no name of theirs can meet an operator's own."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text"))).alias("rest"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, learned from the labels of docs outside the held-out fold, accepts."""
    model = quality.fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", LEARN_FOLDS, LEFT_OUT, quality.SAMPLE))
    return unpacked(quality.apply(packed(docs), model).where(F.col("_quality") >= GOOD), docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, lines of 20 characters or more that 3 documents share only in the last of them; n_chars follows."""
    kept = unpacked(line_dedup.dedup_lines(packed(docs)), docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (0.8 of five-word shingles), that of the smallest id.

    Of a group's rows of that id one stays, the one of the largest set (then of the largest hash of the text, then the
    least row); rows of one id that are not alike are documents of their own.
    """
    row, own = ["doc_id", "text_hash"], packed(docs)
    found = cut(near_dup.linked_rows(own))
    gone = cut(found.where(~F.col("kept")).select(*row).distinct())
    left = own.withColumn("text_hash", F.xxhash64("text")).join(small_enough(gone, 24), row, "left_anti")
    groups = found.where("kept and doc_id is not null").select(*row, "n_shingles", F.coalesce("group", F.lit(-1)).alias("group"))
    twice = cut(groups.groupBy("doc_id", "group").agg(F.count("*").alias("k"), F.max(F.struct("n_shingles", "text_hash")).alias("best")).where("k > 1"))
    if not twice.isEmpty():
        rows = groups.join(small_enough(twice, 48), ["doc_id", "group"]).select(*row, (F.col("text_hash") == F.col("best.text_hash")).alias("best"))
        rows = cut(rows.distinct())
        one = left.join(small_enough(rows.where("best").select(*row), 24), row, "left_semi").groupBy(*row).agg(F.min(F.struct(*own.columns)).alias("r"))
        left = left.join(small_enough(rows.select(*row), 24), row, "left_anti").select(own.columns).unionByName(one.select("r.*"))
    return unpacked(left, docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no ten words in a row of any test item, nor a whole shorter item."""
    own = packed(docs)
    found = decontaminate.contamination(own, table(spark, sf_dir, "benchmark"))
    gone = small_enough(cut(found.where("n_hit > 0").select(*decontaminate.KEYS).distinct()), 32)
    keyed = own.select("*", *decontaminate.row_key(own["doc_id"], own["text"]))
    return unpacked(keyed.join(gone, decontaminate.KEYS, "left_anti"), docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and whether the ids decode to the document's text (ids_sha256, decoded_sha256)."""
    path = public_tokenizers.path(RANKS)
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    return coded.select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", good_documents),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_duplicates),
    ("decontaminate", without_test_items),
    ("encode", encoded),
]

#: SQL cannot express the classifier; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if i < len(STAGES) - 1 else docs
    return docs
