"""Evidence-shaped views of the plain tables, each a pure function of their columns.

Every function takes ``(spark, sf_dir)`` and returns a DataFrame; ``SQL`` has the same views
as DuckDB queries, by name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paper_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, text: the filled lines of each document and their line numbers."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    return lines.select("doc_id", "pos", F.trim("text").alias("text")).where("text <> ''")


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, text: the rows of ``paper_lines`` with pos 0, without splitting whole texts."""
    line = F.trim(F.substring_index("text", "\n", 1))
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("pos"), line.alias("text")).where("text <> ''")


def content_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, kind, level, text: a content stream with headings, tables and figures. Levels
    go down to eight; every fifth heading has none."""
    kind = F.expr("case when pos % 7 = 0 then 'heading' when pos % 11 = 5 then 'table' when pos % 13 = 8 then 'figure' else 'paragraph' end")
    level = F.expr("case when pos % 7 = 0 and pos % 35 <> 28 then cast(1 + (doc_id % 2 + pos div 7) % 8 as int) end")
    return paper_lines(spark, sf_dir).select("doc_id", "pos", kind.alias("kind"), level.alias("level"), "text")


def titled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``content_items`` with numbered headings, some of them abstract or references."""
    title = F.expr(
        "case when kind <> 'heading' then text when pos = 0 and doc_id % 3 = 0 then '1. Abstract:' when pos % 28 = 21 then 'References' "
        "else concat(pos div 7, '.', doc_id % 4, ' ', text) end"
    )
    return content_items(spark, sf_dir).withColumn("text", title)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, page, y0: where three of four lines stand on their pages."""
    return boxes_of(paper_lines(spark, sf_dir))


def boxes_of(lines: DataFrame) -> DataFrame:
    """``boxes`` of lines that were read before."""
    return lines.where("pos % 4 <> 3").selectExpr(
        "doc_id",
        "pos",
        "cast(1 + pos div 20 as int) as page",
        "cast((pos * 37) % 20 * 10 as double) as y0",
    )


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, subject_pos, subject_type, text: numbered captions of tables and figures, tables of
    odd documents by roman numerals, some of them in an unusual form."""
    return captions_of(content_items(spark, sf_dir))


def captions_of(items: DataFrame) -> DataFrame:
    """``captions`` of items that were read before."""
    number = F.row_number().over(_by("doc_id", "kind").orderBy("pos"))
    items = items.where("kind in ('table', 'figure')").withColumn("n", number)
    printed = F.when((F.col("kind") == "table") & (F.col("doc_id") % 2 == 1), roman(F.col("n"))).otherwise(F.col("n").cast("string"))
    printed = F.when(
        F.col("doc_id") % 3 == 0,
        F.replace(F.replace(printed, F.lit("IV"), F.lit("IIII")), F.lit("IX"), F.lit("VIIII")),
    ).otherwise(printed)
    return items.select(
        "doc_id",
        F.col("pos").alias("subject_pos"),
        F.col("kind").alias("subject_type"),
        F.concat(F.initcap("kind"), F.lit(" "), printed, F.lit(" "), "text").alias("text"),
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ref_order, raw_text: five benchmark items for each document."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("raw_text"))
    count = items.count()
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("ref_order"))
    docs = docs.withColumn("item_id", (F.col("doc_id") + F.col("ref_order")) % max(count, 1))
    return docs.join(items, "item_id").select("doc_id", "ref_order", "raw_text")


def cited_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, text: paragraphs with citation marks and mentions of a figure or table."""
    text = F.expr(
        "concat(text, case when pos % 3 = 1 then concat(' [', 1 + pos % 6, ']') else '' end, case when pos % 5 = 2 then ' Figure 1' when "
        "pos % 5 = 4 then concat(' Table ', elt(1 + pos div 5 % 4, 'I', 'ii', 'IIII', '2a')) else '' end)"
    )
    return content_items(spark, sf_dir).where("kind = 'paragraph'").select("doc_id", "pos", text.alias("text"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ku_id, document_id, section_id, ord, vector, text: vectors as points of ten documents."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    labels = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    order = F.row_number().over(_by("label").orderBy("vec_id")) - 1
    text = F.coalesce("text", F.concat(F.lit("vector "), F.col("vec_id").cast("string")))
    return labels.withColumn("ord", order).join(vectors, "vec_id").join(docs, "vec_id", "left").select(
        F.col("vec_id").alias("ku_id"),
        F.col("label").alias("document_id"),
        F.expr("label * 1000 + vec_id div 40").alias("section_id"),
        "ord",
        F.col("embedding").alias("vector"),
        text.alias("text"),
    )


def point_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, type over points: strings ``k<id>``, ``s<section>``, ``d<document>``."""
    p = points(spark, sf_dir).select("ku_id", "document_id", "section_id", "ord").withColumn("n", F.count(F.lit(1)).over(_by("document_id")))
    to = p.select(F.col("document_id").alias("d2"), F.col("ord").alias("o2"), F.col("ku_id").alias("dst"))

    def linked(rank: str, where: str, kind: str) -> DataFrame:
        own = p.where(where).withColumn("o", F.expr(rank))
        rows = own.join(to, (own["document_id"] == to["d2"]) & (own["o"] == to["o2"])).where("ku_id <> dst")
        return rows.select(_key("k", "ku_id").alias("src"), _key("k", "dst").alias("dst"), F.lit(kind).alias("type"))

    edges = linked("ord + 1", "true", "NEXT").unionByName(
        linked("(ord * 7 + 3) % n", "ku_id % 4 = 0", "CITES")
    ).unionByName(linked("(ord * 5 + 2) % n", "ku_id % 9 = 1", "REFERENCES"))
    part = p.select(
        _key("k", "ku_id").alias("src"),
        _key("s", "section_id").alias("dst"),
    ).unionByName(p.select(_key("k", "ku_id").alias("src"), _key("d", "document_id").alias("dst")))
    part = part.unionByName(p.select(_key("s", "section_id").alias("src"), _key("d", "document_id").alias("dst")).distinct())
    return edges.unionByName(part.withColumn("type", F.lit("BELONGS_TO")))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, document_id, vector, text: every 25th point asks with its first words."""
    words = F.array_join(F.slice(F.split("text", " ", -1), 1, 12), " ")
    return points(spark, sf_dir).where("ku_id % 25 = 0").select(F.col("ku_id").alias("query_id"), "document_id", "vector", words.alias("text"))


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, ku_id: points of the question's document in its class modulo three."""
    q = questions(spark, sf_dir).select("query_id", "document_id")
    p = points(spark, sf_dir).select("ku_id", "document_id")
    return q.join(p, "document_id").where("ku_id <> query_id and ku_id % 3 = query_id % 3").select("query_id", "ku_id")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """answer_id, turn, text: assistant turns with a citation before most sentence ends."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant' and turn > 0")
    parts = F.split("text", r"(?<=[.])\s+", -1)
    cited = F.array_join(
        F.transform(
            parts,
            lambda x, i: F.when((i % 5 == 4) | ~x.endswith("."), x).otherwise(
                F.concat(F.substring(x, F.lit(1), F.char_length(x) - 1), F.lit(" [KU"), (1 + F.col("turn") % 4).cast("string"), F.lit("]."))
            ),
        ),
        " ",
    )
    return turns.select(F.concat_ws("-", "conv_id", "turn").alias("answer_id"), "conv_id", "turn", cited.alias("text"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """answer_id, label, ku_id, context, text: the earlier turns of the conversation. A turn has
    the same number as evidence of every later answer, so turns are numbered, not pairs."""
    n = F.row_number().over(_by("conv_id").orderBy("turn"))
    turns = table(spark, sf_dir, "conversations").withColumn("n", n)
    own = turns.where("role = 'assistant' and turn > 0").select("conv_id", F.col("turn").alias("own"))
    rows = own.join(turns, "conv_id").where("turn < own")
    return rows.select(
        F.concat_ws("-", "conv_id", "own").alias("answer_id"),
        F.concat(F.lit("KU"), "n").alias("label"),
        F.concat_ws("/", "conv_id", "turn").alias("ku_id"),
        F.concat(F.lit("Section: "), "role").alias("context"),
        "text",
    )


def turn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, turn_id, kind, ts from the event stream."""
    kind = F.expr("case event_type when 'signup' then 'start' when 'purchase' then 'complete' when 'error' then 'fail' end")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("document_id"),
        F.expr("event_id div 3").alias("turn_id"),
        kind.alias("kind"),
        "ts",
        "event_id",
    ).where("kind is not null")


def roman(n: Column) -> Column:
    """Roman numeral of a number from 1 to 3,999."""
    out = F.lit("")
    for unit, signs in (
        (1000, ("", "M", "MM", "MMM", "", "", "", "", "", "")),
        (100, _signs("C", "D", "M")),
        (10, _signs("X", "L", "C")),
        (1, _signs("I", "V", "X")),
    ):
        out = F.concat(out, F.element_at(F.array(*map(F.lit, signs)), (F.floor(n / unit) % 10 + 1).cast("int")))
    return out


def _signs(one: str, five: str, ten: str) -> tuple[str, ...]:
    return ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)


def _key(mark: str, column: str) -> Column:
    return F.concat(F.lit(mark), F.col(column).cast("string"))


def _by(*columns: str) -> WindowSpec:
    return Window.partitionBy(*columns)


SQL = {
    "paper_lines": (
        "SELECT doc_id, i - 1 AS pos, trim(l) AS text "
        "FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i "
        "FROM documents) WHERE trim(l) <> ''"
    ),
    "content_items": (
        "SELECT doc_id, pos, CASE WHEN pos % 7 = 0 THEN 'heading' WHEN pos % 11 = 5 THEN 'table' WHEN pos % 13 = 8 THEN 'figure' "
        "ELSE 'paragraph' END AS kind, CASE WHEN pos % 7 = 0 "
        "AND pos % 35 <> 28 THEN CAST(1 + (doc_id % 2 + pos // 7) % 8 AS INT) END AS level, text FROM paper_lines"
    ),
    "titled_items": (
        "SELECT doc_id, pos, kind, level, CASE WHEN kind <> 'heading' THEN text WHEN pos = 0 AND doc_id % 3 = 0 THEN '1. Abstract:' "
        "WHEN pos % 28 = 21 THEN 'References' ELSE (pos // 7) || '.' || (doc_id % 4) || ' ' || text END AS text FROM content_items"
    ),
    "boxes": "SELECT doc_id, pos, CAST(1 + pos // 20 AS INT) AS page, CAST((pos * 37) % 20 * 10 AS DOUBLE) AS y0 FROM paper_lines WHERE pos % 4 <> 3",
    "romans": (
        "SELECT i AS n, list_extract(['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'], i // 100 % 10 + 1) || "
        "list_extract(['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'], i // 10 % 10 + 1) || "
        "list_extract(['','I','II','III','IV','V','VI','VII','VIII','IX'], i % 10 + 1) AS roman FROM range(1, 1000) t(i)"
    ),
    "captions": (
        "SELECT doc_id, pos AS subject_pos, kind AS subject_type, upper(kind[1]) || kind[2:] || ' ' || CASE WHEN kind = 'table' "
        "AND doc_id % 2 = 1 THEN CASE WHEN doc_id % 3 = 0 THEN replace(replace(roman, 'IV', 'IIII'), 'IX', 'VIIII') ELSE roman END "
        "ELSE CAST(c.n AS VARCHAR) END || ' ' || text AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind "
        "ORDER BY pos) AS n FROM content_items WHERE kind IN ('table', 'figure')) c JOIN romans r ON r.n = c.n"
    ),
    "references_v": (
        "SELECT d.doc_id, r.i AS ref_order, b.text AS raw_text FROM documents d, range(0, 5) r(i) "
        "JOIN benchmark b ON b.item_id = (d.doc_id + r.i) % (SELECT count(*) FROM benchmark)"
    ),
    "cited_paragraphs": (
        "SELECT doc_id, pos, text || CASE WHEN pos % 3 = 1 THEN ' [' || (1 + pos % 6) || ']' ELSE '' END || CASE "
        "WHEN pos % 5 = 2 THEN ' Figure 1' WHEN pos % 5 = 4 THEN ' Table ' || list_extract(['I', 'ii', 'IIII', '2a'], 1 + pos // 5 % 4) "
        "ELSE '' END AS text FROM content_items WHERE kind = 'paragraph'"
    ),
    "points": (
        "SELECT v.vec_id AS ku_id, CAST(v.label AS BIGINT) AS document_id, CAST(v.label AS BIGINT) * 1000 + v.vec_id // 40 AS "
        "section_id, row_number() OVER (PARTITION BY v.label "
        "ORDER BY v.vec_id) - 1 AS ord, v.embedding AS vector, coalesce(d.text, 'vector ' || v.vec_id) AS text FROM embeddings v LEFT "
        "JOIN documents d ON d.doc_id = v.vec_id"
    ),
    "point_edges": """SELECT 'k' || a.ku_id AS src, 'k' || b.ku_id AS dst, 'NEXT' AS type FROM points a JOIN points b ON a.document_id = b.document_id AND b.ord = a.ord + 1
        UNION ALL SELECT 'k' || a.ku_id, 'k' || b.ku_id, 'CITES' FROM sized a JOIN points b ON a.document_id = b.document_id AND b.ord = (a.ord * 7 + 3) % a.n WHERE a.ku_id % 4 = 0 AND a.ku_id <> b.ku_id
        UNION ALL SELECT 'k' || a.ku_id, 'k' || b.ku_id, 'REFERENCES' FROM sized a JOIN points b ON a.document_id = b.document_id AND b.ord = (a.ord * 5 + 2) % a.n WHERE a.ku_id % 9 = 1 AND a.ku_id <> b.ku_id
        UNION ALL SELECT 'k' || ku_id, 's' || section_id, 'BELONGS_TO' FROM points
        UNION ALL SELECT 'k' || ku_id, 'd' || document_id, 'BELONGS_TO' FROM points
        UNION ALL SELECT DISTINCT 's' || section_id, 'd' || document_id, 'BELONGS_TO' FROM points""",
    "sized": "SELECT ku_id, document_id, ord, count(*) OVER (PARTITION BY document_id) AS n FROM points",
    "questions": (
        "SELECT ku_id AS query_id, document_id, vector, list_aggregate(string_split(text, ' ')[1:12], 'string_agg', ' ') AS text "
        "FROM points WHERE ku_id % 25 = 0"
    ),
    "relevance": (
        "SELECT q.query_id, p.ku_id FROM questions q JOIN points p USING (document_id) "
        "WHERE p.ku_id <> q.query_id AND p.ku_id % 3 = q.query_id % 3"
    ),
    "answers": (
        "SELECT conv_id || '-' || turn AS answer_id, conv_id, turn, list_aggregate(list_transform(string_split(regexp_replace(text, "
        "'([.])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1)), lambda x, i: CASE "
        "WHEN (i - 1) % 5 = 4 OR NOT ends_with(x, '.') THEN x "
        "ELSE left(x, length(x) - 1) || ' [KU' || (1 + turn % 4) || '].' END), 'string_agg', ' ') AS text FROM conversations "
        "WHERE role = 'assistant' AND turn > 0"
    ),
    "evidence": (
        "SELECT a.conv_id || '-' || a.turn AS answer_id, 'KU' || row_number() OVER (PARTITION BY a.conv_id, a.turn "
        "ORDER BY t.turn) AS label, t.conv_id || '/' || t.turn AS ku_id, 'Section: ' || t.role AS context, t.text FROM conversations a "
        "JOIN conversations t ON a.conv_id = t.conv_id AND t.turn < a.turn WHERE a.role = 'assistant' AND a.turn > 0"
    ),
    "turn_events": (
        "SELECT * FROM (SELECT user_id AS document_id, event_id // 3 AS turn_id, CASE event_type WHEN 'signup' THEN 'start' "
        "WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' END AS kind, ts, event_id FROM events) WHERE kind IS NOT NULL"
    ),
}
_NEEDS = {
    "content_items": ["paper_lines"], "titled_items": ["content_items"], "boxes": ["paper_lines"], "captions": ["content_items", "romans"], "cited_paragraphs": ["content_items"],
    "point_edges": ["points", "sized"], "sized": ["points"], "questions": ["points"], "relevance": ["questions", "points"],
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """A DuckDB query in front of which the views that it names are defined. ``extra``: more
    named queries, in an order that lets each use those before."""
    extra = extra or {}
    text = " ".join([body, *extra.values()])
    found: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, []):
            add(x)
        if name not in found:
            found.append(name)

    for name in SQL:
        if re.search(rf"\b{name}\b", text):
            add(name)
    parts = [f"{x} AS ({SQL[x]})" for x in found] + [f"{k} AS ({v})" for k, v in extra.items()]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
