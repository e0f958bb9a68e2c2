"""Integrity checks: every violation of a rule is a row (document_id, rule, id, detail).

No row means that all rules hold. Ids are strings; detail may be null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import cut


def _rows(df: DataFrame, rule: str, id_: Column | None = None, detail: Column | None = None, document: str = "document_id") -> DataFrame:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return df.select(
        F.col(document).cast("string").alias("document_id"),
        F.lit(rule).alias("rule"),
        text(id_).alias("id"),
        text(detail).alias("detail"),
    )


def _all(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def _twice(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_papers(papers: DataFrame, sections: DataFrame, children: DataFrame, captions: DataFrame, visuals: DataFrame) -> DataFrame:
    """Papers (document_id), sections (document_id, id, parent), children (document_id, id,
    paper_id), captions and visuals (document_id, kind, id). A paper is empty without sections
    and children. A cycle is reported for each section from which no root is reached."""
    contents = children.select("document_id").unionByName(sections.select("document_id")).distinct()
    orphan = sections.where("parent is not null").join(
        sections.select("document_id", F.col("id").alias("parent")),
        ["document_id", "parent"],
        "left_anti",
    )
    subject = ["document_id", "kind", "id"]
    return _all(
        _rows(papers.join(contents, "document_id", "left_anti"), "empty_paper"),
        _rows(children.where("paper_id <> document_id"), "wrong_paper", F.col("id"), F.col("paper_id")),
        _rows(orphan.distinct(), "unknown_parent", F.col("id"), F.col("parent")),
        _rows(rootless(sections), "section_cycle", F.col("id")),
        _rows(captions.join(visuals, subject, "left_anti"), "caption_without_subject", F.col("id")),
        _rows(visuals.join(captions, subject, "left_anti"), "uncaptioned_visual", F.col("id")),
    )


def rootless(sections: DataFrame) -> DataFrame:
    """(document_id, id) of the sections whose parents lead into a cycle. A section that comes
    with several parents has the largest.

    Steps up are doubled until a round settles no section: as long as one is left from which a
    root is reached, the next round settles some. A parent that does not exist ends its chain.
    """
    up = sections.groupBy("document_id", "id").agg(F.max("parent").alias("far")).where("far is not null")
    up, before = cut(up), None
    while (left := up.count()) not in (0, before):
        before = left
        hop = up.select("document_id", F.col("id").alias("far"), F.col("far").alias("next"))
        up = cut(up.join(hop, ["document_id", "far"]).select("document_id", "id", F.col("next").alias("far")))
    return up.select("document_id", "id")


def check_units(papers: DataFrame, units: DataFrame, sections: DataFrame, relationships: DataFrame) -> DataFrame:
    """Units (document_id, id, ord, paper_id, section), sections (document_id, id) and
    relationships (document_id, source, target)."""
    ids = units.select("document_id", "id")
    lost = lambda end: relationships.join(ids.withColumnRenamed("id", end), ["document_id", end], "left_anti")
    return _all(
        _rows(papers.join(ids.select("document_id").distinct(), "document_id", "left_anti"), "no_units"),
        _rows(_twice(units, "document_id", "ord"), "duplicate_order", F.col("ord"), F.col("n")),
        _rows(units.where("paper_id <> document_id"), "wrong_paper", F.col("id"), F.col("paper_id")),
        _rows(
            units.where("section is not null").join(
                sections.select("document_id", F.col("id").alias("section")),
                ["document_id", "section"],
                "left_anti",
            ),
            "unknown_section",
            F.col("id"),
            F.col("section"),
        ),
        _rows(lost("source"), "dangling_source", F.col("source"), F.col("target")),
        _rows(lost("target"), "dangling_target", F.col("source"), F.col("target")),
    )


def check_embeddings(documents: DataFrame, vectors: DataFrame, units: DataFrame) -> DataFrame:
    """Vectors (document_id, id, target, dimension, vector) against units (document_id, id)."""
    sizes = vectors.groupBy("document_id").agg(F.count_distinct("dimension").alias("n")).where("n > 1")
    return _all(
        _rows(documents.join(vectors.select("document_id").distinct(), "document_id", "left_anti"), "no_embeddings"),
        _rows(vectors.join(units, ["document_id", "id"], "left_anti"), "unknown_unit", F.col("id")),
        _rows(_twice(vectors, "document_id", "id", "target"), "duplicate_embedding", F.col("id"), F.col("target")),
        _rows(sizes, "inconsistent_dimension", None, F.col("n")),
        _rows(vectors.where(F.size("vector") != F.col("dimension")), "wrong_length", F.col("id"), F.size("vector")),
    )


def check_index(points: DataFrame, vectors: DataFrame, manifest: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Points against vectors (document_id, id) and the manifest (document_id, dimension,
    points)."""
    counts = manifest.join(
        points.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")),
        "document_id",
        "left",
    ).where(~F.coalesce("n", F.lit(0)).eqNullSafe(F.col("points")))
    sizes = points.join(manifest.select("document_id", "dimension"), "document_id").where(F.size("vector") != F.col("dimension"))
    missing = [_rows(points.where(F.col(c).isNull()), "missing_field", F.col("id"), F.lit(c)) for c in required]
    return _all(
        _rows(sizes, "dimension_mismatch", F.col("id"), F.size("vector")),
        _rows(counts, "count_mismatch", None, F.coalesce("n", F.lit(0))),
        _rows(vectors.join(points, ["document_id", "id"], "left_anti"), "missing_point", F.col("id")),
        *missing,
    )


def check_graph(nodes: DataFrame, edges: DataFrame, expected: DataFrame) -> DataFrame:
    """Nodes (document_id, id, label), edges (document_id, src, dst, type) and the number of
    units that each document should have (document_id, units)."""
    kinds = nodes.select("document_id", "id", "label").dropDuplicates(["document_id", "id"])
    end = lambda name: kinds.select("document_id", F.col("id").alias(name), F.col("label").alias(f"{name}_label"))
    typed = edges.join(end("src"), ["document_id", "src"], "left").join(end("dst"), ["document_id", "dst"], "left")
    unit = "KnowledgeUnit"
    wrong = (F.col("type") != "BELONGS_TO") & (
        (F.col("src_label") != unit) | (F.col("dst_label") != unit)
    ) | (F.col("type") == "BELONGS_TO") & ((F.col("dst_label") == unit) | (F.col("src_label") == "Document"))
    name = F.concat_ws(" ", "src", "type", "dst")
    touched = edges.select("document_id", F.col("src").alias("id")).unionByName(edges.select("document_id", F.col("dst").alias("id"))).distinct()
    counts = nodes.where(F.col("label") == unit).groupBy("document_id").agg(F.count_distinct("id").alias("n"))
    return _all(
        _rows(_twice(nodes, "document_id", "id"), "duplicate_node", F.col("id"), F.col("n")),
        _rows(_twice(edges, "document_id", "src", "dst", "type"), "duplicate_edge", name, F.col("n")),
        _rows(typed.where("src_label is null or dst_label is null"), "dangling_edge", name),
        _rows(typed.where(wrong), "wrong_endpoint", name),
        _rows(nodes.where("label <> 'Document'").join(touched, ["document_id", "id"], "left_anti"), "orphan_node", F.col("id")),
        _rows(expected.join(counts, "document_id", "left").where("units <> coalesce(n, 0)"), "incomplete", None, F.coalesce("n", F.lit(0))),
    )


def check_retrieval(
    candidates: DataFrame,
    ranked: DataFrame,
    groups: DataFrame,
    statistics: DataFrame,
    phases: DataFrame,
    required: tuple[str, ...],
) -> DataFrame:
    """By query_id: candidates (id, path: ids along the hops), ranked (id, final_rank, fused),
    groups (id), statistics (scored) and phases (phase)."""
    order = Window.partitionBy("query_id").orderBy("final_rank")
    before = ranked.withColumn("_r", F.lag("final_rank").over(order)).withColumn("_f", F.lag("fused").over(order))
    counts = statistics.join(ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").where("scored <> coalesce(n, 0)")
    needed = statistics.select("query_id").distinct().withColumn("phase", F.explode(F.array(*map(F.lit, required))))
    of = "query_id"
    return _all(
        _rows(_twice(candidates, "query_id", "id"), "duplicate_candidate", F.col("id"), F.col("n"), of),
        _rows(candidates.where(F.size(F.array_distinct("path")) < F.size("path")), "path_cycle", F.col("id"), None, of),
        _rows(before.where("final_rank <> coalesce(_r, 0) + 1"), "rank_gap", F.col("id"), F.col("final_rank"), of),
        _rows(before.where("fused > _f"), "rising_score", F.col("id"), F.col("final_rank"), of),
        _rows(_twice(groups, "query_id", "id"), "unit_in_two_groups", F.col("id"), F.col("n"), of),
        _rows(counts, "statistics_mismatch", None, F.coalesce("n", F.lit(0)), of),
        _rows(needed.join(phases, ["query_id", "phase"], "left_anti"), "missing_phase", F.col("phase"), None, of),
    )


def check_answers(answers: DataFrame, citations: DataFrame, support: DataFrame, phases: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """By answer_id: answers (citations: their stated number), citations (label, ku_id),
    support (label) and phases (phase). Support must be among the resolved citations, except
    where none resolves."""
    counts = answers.join(citations.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n")), "answer_id", "left").where("citations <> coalesce(n, 0)")
    resolved = citations.where("ku_id is not null").select("answer_id", "label").distinct()
    stray = support.join(resolved, ["answer_id", "label"], "left_anti").join(resolved.select("answer_id").distinct(), "answer_id", "left_semi")
    needed = answers.select("answer_id").distinct().withColumn("phase", F.explode(F.array(*map(F.lit, required))))
    of = "answer_id"
    return _all(
        _rows(counts, "citation_count", None, F.coalesce("n", F.lit(0)), of),
        _rows(_twice(citations, "answer_id", "label"), "repeated_citation", F.col("label"), F.col("n"), of),
        _rows(stray, "support_not_cited", F.col("label"), None, of),
        _rows(needed.join(phases, ["answer_id", "phase"], "left_anti"), "missing_phase", F.col("phase"), None, of),
    )


def check_cases(cases: DataFrame) -> DataFrame:
    """An empty dataset, and case ids that repeat."""
    empty = cases.agg(F.count(F.lit(1)).alias("n")).where("n = 0").withColumn("case_id", F.lit(None).cast("string"))
    return _all(
        _rows(empty, "empty_dataset", None, None, "case_id"),
        _rows(_twice(cases, "case_id"), "duplicate_case", F.col("case_id"), F.col("n"), "case_id"),
    )
