"""Conversation and library state, citation tokens, and where evidence stands on pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import cut
from .substrings import LIGHT, by_prints, contained, heavy_groups

NEEDLE, MIN_LINE = 120, 18
STATUS = {"start": "pending", "complete": "complete", "fail": "failed"}
CITATION = r"\[[A-Za-z0-9_-]+\]|[\[(][ \t\n\r\f\x0B]*KU[0-9]+(?:[ \t\n\r\f\x0B]*,[ \t\n\r\f\x0B]*KU[0-9]+)*[ \t\n\r\f\x0B]*[\])]"


def conversation_state(events: DataFrame) -> DataFrame:
    """Turn events (document_id, turn_id, kind, ts, event_id) folded to the current turns:
    document_id, turn_id, status, updated.

    Kinds are start, complete, fail and clear. A clear empties the document; completions and
    failures count for turns that were started since. Ties in time go by event_id.
    """
    at = F.struct("ts", "event_id")
    clear = events.where("kind = 'clear'").groupBy("document_id").agg(F.max(at).alias("cleared"))
    rows = events.where("kind <> 'clear'").join(clear, "document_id", "left").where(F.col("cleared").isNull() | (at > F.col("cleared")))
    rows = rows.withColumn("at", at)
    started = F.min(F.when(F.col("kind") == "start", F.col("at"))).over(Window.partitionBy("document_id", "turn_id"))
    rows = rows.withColumn("started", started).where(
        F.col("started").isNotNull() & (F.col("at") >= F.col("started")) & ~((F.col("kind") == "start") & (F.col("at") > F.col("started")))
    )
    last = rows.groupBy("document_id", "turn_id").agg(F.max_by("kind", "at").alias("kind"), F.max("at").alias("at"))
    status = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in STATUS.items()))
    return last.select("document_id", "turn_id", status.alias("status"), F.col("at.ts").alias("updated"))


def library_state(events: DataFrame) -> DataFrame:
    """Library events (document_id, kind: add, stage, status, rename, remove; value, ts,
    event_id) to the library: document_id, filename, stage, status. What was said before an
    add or remove is void; a removed document is absent until it is added again."""
    at = F.struct("ts", "event_id")
    rows = events.withColumn("at", at)
    border = F.max(F.when(F.col("kind").isin("add", "remove"), F.struct("at", "kind"))).over(Window.partitionBy("document_id"))
    rows = rows.withColumn("border", border).where((F.col("border.kind") == "add") & (F.col("at") >= F.col("border.at")))
    pick = lambda *kinds: F.max_by("value", F.when(F.col("kind").isin(*kinds), F.col("at")))
    return rows.groupBy("document_id").agg(pick("add", "rename").alias("filename"), pick("stage").alias("stage"), pick("status").alias("status"))


def evidence_history(turns: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence (answer_id, ku_id, place) of completed turns (document_id, answer_id, ts),
    newest first, one row for each unit: document_id, n, ku_id."""
    rows = turns.join(evidence, "answer_id")
    first = F.row_number().over(Window.partitionBy("document_id", "ku_id").orderBy(F.desc("ts"), "answer_id", "place"))
    rows = rows.withColumn("_n", first).where("_n = 1")
    n = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("ts"), "answer_id", "place"))
    return rows.select("document_id", n.alias("n"), "ku_id")


def answer_tokens(answers: DataFrame) -> DataFrame:
    """answer_id, n, kind (text or citation), value; the values of an answer, one after
    another, are its text. A group of labels such as '(KU4, KU8)' is cut into its labels and
    what stands between; '[label]' is one citation."""
    mark = "\x01"
    # single labels in brackets first, then the labels inside the groups that are left
    cut = F.regexp_replace("text", r"(\[[A-Za-z0-9_-]+\])", f"{mark}$1{mark}")
    pieces = F.split(cut, mark, -1)
    group = CITATION.split("|", 1)[1]

    def token(value: Column, citation: Column) -> Column:
        return F.struct(F.when(citation, "citation").otherwise("text").alias("kind"), value.alias("value"))

    def labels(x: Column) -> Column:
        return F.transform(F.split(F.regexp_replace(x, "(KU[0-9]+)", f"{mark}$1{mark}"), mark, -1), lambda y: token(y, y.rlike("^KU[0-9]+$")))

    def inner(piece: Column) -> Column:
        grouped = F.split(F.regexp_replace(piece, f"({group})", f"{mark}$1{mark}"), mark, -1)
        return F.flatten(F.transform(grouped, lambda x: F.when(x.rlike(f"^(?:{group})$"), labels(x)).otherwise(F.array(token(x, F.lit(False))))))

    tokens = F.flatten(F.transform(pieces, lambda x: F.when(x.rlike(r"^\[[A-Za-z0-9_-]+\]$"), F.array(token(x, F.lit(True)))).otherwise(inner(x))))
    return answers.select(
        "answer_id",
        F.posexplode(F.filter(tokens, lambda x: x["value"] != "")).alias("n", "t"),
    ).select("answer_id", "n", "t.kind", "t.value")


def strip_for_match(text: Column) -> Column:
    """Lower-case, single white space, without hyphens (at line breaks with the break) and
    quotes, so that typography does not hide a match."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r\f\x0B]+", " "))
    plain = F.regexp_replace(F.regexp_replace(plain, "[-–—][ ]+", ""), "[-–—]", "")
    return F.regexp_replace(plain, "[\"'“”‘’]", "")


def stripped(rows: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """The rows with ``strip_for_match`` of the column text, or its first characters, as ``name``, in
    one pass over the bytes instead of one for each pattern."""
    keep = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([x and _bare(x) for x in batch.column("text").cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), made.cast(pa.string())], names=[*keep, name])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), f"`{name}` string"])
    out = rows.select(*keep, F.lower("text").alias("text")).mapInArrow(run, schema)
    return out.withColumn(name, F.substring(name, 1, most)) if most else out


def _bare(text: bytes) -> bytes:
    """Lower-case UTF-8 as ``strip_for_match`` has it."""
    text = b" ".join(text.split()).replace(b"- ", b"")
    if b"\xe2\x80" in text:  # what the signs beyond ASCII begin with
        for sign in ("– ", "— ", *"–—“”‘’"):
            text = text.replace(sign.encode(), b"")
    return text.translate(None, b"-\"'")


def evidence_locate(evidence: DataFrame, pages: DataFrame, light: int = LIGHT) -> DataFrame:
    """Evidence (document_id, id, text, box_pages, pages) to its page: document_id, id, page,
    matched, source.

    The first boxed page whose text has the evidence's first characters, else the first boxed
    page; without boxes the same with the recorded pages; without either the first page with the
    text; else no page. Pages without a number are no result.

    Texts of pages are stripped and stored once. Evidence meets the pages of its document in one join by
    document, with its first characters only. In a document where all evidence, compared with all pages, would go
    through more than ``light`` bytes, it meets the pages that it names, and what names none finds its
    pages by fingerprints (``substrings.by_prints``), equal texts once.
    """
    listed = F.when(F.size("box_pages") > 0, F.col("box_pages")).when(F.size("pages") > 0, F.col("pages"))
    source = F.when(F.size("box_pages") > 0, "bounding-boxes").when(F.size("pages") > 0, "page-numbers").otherwise("text-search")
    # lower-cased beside the given text: Spark takes lower(upper(x)) as lower(x), which keeps "ß", only in one step
    rows = evidence.withColumn("text", F.lower("text")).withColumn("listed", listed).withColumn("source", source)
    text = cut(stripped(pages.select("document_id", "page", "text"), "text"))
    some = stripped(rows.select("document_id", "id", "listed", "text"), "needle", NEEDLE).where("needle <> ''")
    heavy = heavy_groups(rows, text, ("document_id",), light)
    few = (some, text) if heavy is None else tuple(x.join(heavy, "document_id", "left_anti") for x in (some, text))
    place = F.when(F.col("listed").isNull(), F.col("page")).otherwise(F.nullif(F.array_position("listed", F.col("page")), F.lit(0)))
    met = few[0].join(few[1], "document_id").where(F.contains("text", F.col("needle")))
    found = met.select("document_id", "id", "page", place.alias("place")).where("place is not null")
    if heavy is not None:
        found = found.unionByName(_located(*(x.join(heavy, "document_id", "left_semi") for x in (some, text))))
    best = found.groupBy("document_id", "id").agg(F.min_by("page", "place").alias("hit"))
    out = rows.join(best, ["document_id", "id"], "left")
    page = F.coalesce("hit", F.get("listed", F.lit(0)))
    return out.select(
        "document_id",
        "id",
        page.alias("page"),
        F.col("hit").isNotNull().alias("matched"),
        F.when(page.isNotNull(), F.col("source")).otherwise("none").alias("source"),
    )


def _located(some: DataFrame, text: DataFrame) -> DataFrame:
    """Pages (document_id, id, page, place) that have the needles, in documents with many."""
    named = some.select("document_id", "id", "needle", F.posexplode("listed").alias("place", "page")).join(text, ["document_id", "page"])
    open_ended = some.where("listed is null").select("document_id", "id", "needle")
    sought = open_ended.select("document_id", "needle", F.col("needle").alias("sought")).distinct()
    search = by_prints(sought, text.where("page is not null"), ("document_id",), needle_ids=("sought",), text_ids=("page",))
    search = search.groupBy("document_id", F.col("sought").alias("needle")).agg(F.min("page").alias("page"))
    search = open_ended.join(search, ["document_id", "needle"]).withColumn("place", F.col("page"))
    columns = ("document_id", "id", "page", "place")
    return named.where(F.contains("text", F.col("needle"))).select(*columns).unionByName(search.select(*columns))


def line_marks(lines: DataFrame, evidence: DataFrame, light: int = LIGHT) -> DataFrame:
    """Lines (document_id, page, line, text) of 18 stripped characters or more that are
    contained in evidence (document_id, id, page, text) of their page: the line and the id, once
    however often rows are repeated. On pages where comparing all lines with all evidence would go
    through more than ``light`` bytes, they meet by fingerprints."""
    own = stripped(lines.select("document_id", "page", "line", "text"), "needle").where(F.char_length("needle") >= MIN_LINE)
    there = stripped(evidence.select("document_id", "page", "id", "text"), "text")
    heavy = heavy_groups(lines, evidence, ("document_id", "page"), light)
    return contained(own, there, ("document_id", "page"), heavy, needle_ids=("line",), text_ids=("id",), shortest=MIN_LINE)
