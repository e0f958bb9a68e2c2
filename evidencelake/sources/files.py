"""Uploaded files: validation, registry; layout, labelled cases and HTML pages as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_BYTES = 50 * 1024 * 1024


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as (filename, content_type, content); the type is told by the name."""
    rows = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/", -1), -1)
    return rows.select(
        name.alias("filename"),
        F.when(F.lower(name).endswith(".pdf"), "application/pdf").otherwise("application/octet-stream").alias("content_type"),
        "content",
    )


def upload_reason(max_bytes: int = MAX_BYTES) -> Column:
    """Why a file (filename, content_type, content) is refused: the first failing rule; null if
    it is accepted."""
    size = F.length("content")
    typed = F.lower("filename").rlike(r"[^/]\.pdf$") & (F.col("content_type") == "application/pdf")
    headed = F.substring("content", 1, 5) == F.lit(b"%PDF-")
    return F.when(
        ~F.coalesce(typed, F.lit(False)),
        "unsupported_type",
    ).when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size > max_bytes, "too_large").when(~headed, "not_pdf")


def register(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One registry row for each accepted file: filename, bytes, sha256, status."""
    return files.where(upload_reason(max_bytes).isNull()).select(
        "filename",
        F.length("content").cast("long").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
        F.lit("completed").alias("status"),
    )


def layout(elements: dict[str, DataFrame]) -> DataFrame:
    """Located elements (doc_id, id, boxes: array of (page, y0)) by kind to one row for each
    page: doc_id, page, elements (kind, id, y0 of each box in order)."""
    rows = [df.select("doc_id", F.lit(kind).alias("kind"), "id", F.explode("boxes").alias("b")) for kind, df in elements.items()]
    every = reduce(DataFrame.unionByName, rows).select(
        "doc_id",
        F.col("b.page").alias("page"),
        F.struct(F.col("b.y0").alias("y0"), "kind", "id").alias("e"),
    )
    return every.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("e")).alias("elements"))


def page_content(pages: DataFrame) -> DataFrame:
    """HTML pages (page_id, html) to an ordered content stream: page_id, pos, kind, level, text.

    Headings, paragraphs, tables and figures in order; scripts, styles, comments, navigation
    and footers are removed first, and a first heading that equals the title is dropped.
    """
    body = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style|nav|footer|header)\b.*?</\1>", " ")
    title = _plain(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    blocks = F.regexp_extract_all(
        body,
        F.lit(r"(?is)(<(?:h[1-6]|p|table|figure)\b[^>]*>.*?(?=<(?:h[1-6]|p|table|figure)\b|</(?:h[1-6]|p|table|figure)>|$))"),
        1,
    )
    rows = pages.select("page_id", title.alias("title"), F.posexplode(blocks).alias("at", "block"))
    tag = F.lower(F.regexp_extract("block", r"^<([A-Za-z]+[1-6]?)", 1))
    kind = F.when(tag.startswith("h"), "heading").when(tag == "p", "paragraph").otherwise(tag)
    level = F.when(tag.startswith("h"), F.substring(tag, 2, 1).try_cast("int"))
    rows = rows.select("page_id", "title", "at", kind.alias("kind"), level.alias("level"), _plain(F.col("block")).alias("text")).where("text <> ''")
    order = Window.partitionBy("page_id").orderBy("at")
    first = F.sum((F.col("kind") == "heading").cast("int")).over(order) == 1
    rows = rows.withColumn("_drop", (F.col("kind") == "heading") & first & (F.col("text") == F.col("title"))).where("not _drop")
    return rows.select("page_id", (F.row_number().over(order) - 1).alias("pos"), "kind", "level", "text")


def _plain(html: Column) -> Column:
    """Text of a fragment: tags out, the five basic entities resolved, white space single."""
    text = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def content_hash(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """sha256 of the rows of each key, whatever their order: ``by``, version."""
    line = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns)).cast("binary"), 256)
    return digest(rows.select(by, line.alias("line")), by).select(by, F.col("checksum").alias("version"))


def digest(lines: DataFrame, by: str) -> DataFrame:
    """Lines (``by``, line: a hex digest) to one row for each key: ``by``, rows, checksum,
    whatever their order. Lines are hashed, in order, with those that begin with the same
    three digits, and a key's 4,096 parts then by their digits, so that neither a cell nor a
    task has all lines of a key."""
    joined = lambda x: F.sha2(F.array_join(x, "").cast("binary"), 256)
    part = F.substring("line", 1, 3).alias("part")
    parts = lines.groupBy(by, part).agg(F.count(F.lit(1)).alias("n"), joined(F.array_sort(F.collect_list("line"))).alias("sha"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "sha"))), lambda x: x["sha"])
    return parts.groupBy(by).agg(F.sum("n").alias("rows"), joined(ordered).alias("checksum"))
