"""Freshness, manifests and provenance by content hashes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import digest


def stale_documents(sources: DataFrame, manifests: DataFrame, model: str, version: str, *, force: bool = False) -> DataFrame:
    """document_id, stale, reason: sources (document_id, source_hash) whose stage must run
    again. The first reason counts: forced, no manifest, model, version, source."""
    old = manifests.select(
        "document_id",
        F.col("model").alias("_m"),
        F.col("version").alias("_v"),
        F.col("source_hash").alias("_h"),
        F.lit(True).alias("_known"),
    )
    rows = sources.join(old, "document_id", "left")
    reason = F.when(F.lit(force), "forced").when(F.col("_known").isNull(), "no_manifest").when(
        ~F.col("_m").eqNullSafe(F.lit(model)),
        "model",
    ).when(~F.col("_v").eqNullSafe(F.lit(version)), "version")
    reason = reason.when(~F.col("_h").eqNullSafe(F.col("source_hash")), "source")
    return rows.select("document_id", reason.isNotNull().alias("stale"), reason.alias("reason"))


def incremental_refresh(inputs: DataFrame, stored: DataFrame, stale: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``build`` of the stale documents' inputs, with what is stored of the others."""
    ids = stale.where("stale").select("document_id")
    return build(inputs.join(ids, "document_id", "left_semi")).unionByName(stored.join(ids, "document_id", "left_anti"))


def manifests(stages: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One row for each stage and document of tables with document_id: stage, document_id,
    rows, checksum (of the named column's values in any order)."""

    def one(name: str, df: DataFrame, column: str) -> DataFrame:
        line = F.sha2(F.coalesce(F.col(column).cast("string"), F.lit("~")).cast("binary"), 256)
        return digest(df.select("document_id", line.alias("line")), "document_id").withColumn("stage", F.lit(name))

    return reduce(DataFrame.unionByName, [one(k, df, c) for k, (df, c) in stages.items()])


def provenance(answers: DataFrame, citations: DataFrame, evidence: DataFrame, stages: DataFrame) -> DataFrame:
    """One row for each answer (answer_id, document_id): the versions of all stages of its
    document, the units that it cites and a hash of the evidence shown."""
    versions = stages.groupBy("document_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "stage", "checksum"))), ";").alias("versions")
    )
    cited = citations.where("ku_id is not null").groupBy("answer_id").agg(F.array_join(F.array_sort(F.collect_set("ku_id")), ",").alias("cited"))
    bundle = evidence.groupBy("answer_id").agg(
        F.sha2(
            F.array_join(
                F.array_sort(F.collect_list(F.concat_ws("|", "label", "ku_id", F.sha2(F.col("text").cast("binary"), 256)))),
                ";",
            ).cast("binary"),
            256,
        ).alias("bundle")
    )
    return answers.join(versions, "document_id", "left").join(cited, "answer_id", "left").join(bundle, "answer_id", "left").select(
        "answer_id",
        "document_id",
        "versions",
        "cited",
        "bundle",
    )
