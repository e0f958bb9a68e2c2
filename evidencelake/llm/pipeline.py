"""The corpus pipeline: quality, line dedup, near duplicates, mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and all that its predecessor kept; all but the
last return the columns of ``documents``. Null texts and ids pass through stages that have
no reason to drop them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard_join, line_dedup, mixing, quality_model, queries
from .storage import drop, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIX_SHARE = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; learnt from the labelled ones outside
    the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(queries.fold(3) != 1).select("doc_id", F.col("quality").alias("label"))
    scored = quality_model.predict(docs, quality_model.fit(docs, labels), score_col="_score")
    return scored.where("_score >= 0.5").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of repeated three-line windows; a document of which no
    word is left goes. n_chars is that of the new text."""
    out = line_dedup.remove_repeated(docs, removed_col="_removed")
    empty = F.col("_removed").cast("boolean") & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^ \t\n\r\x0b\x0c]")
    changed = F.when(F.col("_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(~empty).withColumn("n_chars", changed).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id (null last).
    Of rows with equal id and text one stays; documents without words stay."""
    groups = jaccard_join.near_duplicates(docs.select("doc_id", "text"))
    # an id may come with several texts, so two hashes name a row; neither is null
    gone = groups.where(~F.col("first")).select(F.xxhash64("doc_id").alias("_id"), F.col("text_hash").alias("_code"))
    named = docs.select(*COLUMNS).withColumn("_id", F.xxhash64("doc_id")).withColumn("_code", F.xxhash64("text"))
    return named.join(gone, ["_id", "_code"], "left_anti").dropDuplicates(["_id", "_code"]).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take, each at most once."""
    levels, tokens = queries.mix_levels(), queries.mix_tokens()
    return mixing.mix(docs.select(*COLUMNS), levels, tokens, queries.MIX_WEIGHTS, share=MIX_SHARE, max_epochs=1, seed=17).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to its bytes."""
    out = bpe.encode(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded_col="_decoded")
    same = F.col("_decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        F.size("token_ids").cast("long").alias("n_tokens"),
        "token_ids",
        same.alias("round_trip"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("tokens", tokens),
]

#: The classifier's features and the ids have no SQL form; tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the table ``documents``, each written before the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
