"""From an ordered content stream to sections, paragraphs, captions and references.

Content items are rows (doc_id, pos, kind, level, text); a section is named by its document
and the position of its heading.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.stage import cut

SPACE = r"[ \t\n\r\f\x0B]"
DOC = ("doc_id",)


def normalize_heading(title: Column) -> Column:
    """Without leading section number and trailing colon, lower-case."""
    bare = F.regexp_replace(title, rf"^{SPACE}*[0-9]+(\.[0-9]+)*\.?{SPACE}*", "")
    return F.lower(F.trim(F.regexp_replace(F.trim(bare), r":+$", "")))


def heading_role(title: Column) -> Column:
    """'abstract', 'references' or 'section'."""
    name = normalize_heading(title)
    return F.when(name == "abstract", "abstract").when(name.isin("references", "bibliography"), "references").otherwise("section")


def _in_order(rows: DataFrame, fold: Callable[[], Callable], made: str) -> DataFrame:
    """(doc_id, pos) with what ``fold`` makes of each row of a document, in the order of pos.

    ``fold()`` gives a document's step, which is called with pos and the further columns and
    returns the new ones. Documents are sorted in their partitions and go by in batches, so a task holds
    one batch and one step's state, however long a document is.
    """
    schema = T.StructType([rows.schema["doc_id"], rows.schema["pos"], *T.StructType.fromDDL(made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, last, step = to_arrow_schema(schema), None, None
        for batch in batches:
            out = []
            for document, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if step is None or document != last:
                    last, step = document, fold()
                out.append(step(*values))
            new = [pa.array(list(c), types.field(k + 2).type) for k, c in enumerate(zip(*out, strict=True))] if out else [pa.array([], f.type) for f in list(types)[2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], names=schema.names)

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "pos").mapInArrow(run, schema)


def special_sections(items: DataFrame) -> DataFrame:
    """Items with a column ``mode``: abstract, references or body.

    A special heading of level L holds until a heading of level L or less, which is tested
    anew; deeper headings inside it get the mode 'dropped'. A heading without a level has level
    1. Headings are gone through document by document, in order; other items take the mode of
    the heading before them.
    """
    role, level = heading_role(F.col("text")), F.coalesce("level", F.lit(1))
    heads = items.where("kind = 'heading'").select("doc_id", "pos", level.alias("level"), role.alias("role"))

    def fold() -> Callable[[int, int, str], tuple[str, str]]:
        mode, held = "body", 0

        def step(_: int, level: int, role: str) -> tuple[str, str]:
            nonlocal mode, held
            if mode != "body" and level > held:
                return mode, "dropped"
            mode, held = ("body" if role == "section" else role), level
            return mode, mode

        return step

    folded = _in_order(heads, fold, "after string, own string")
    order = Window.partitionBy("doc_id").orderBy("pos")
    joined = items.join(folded, ["doc_id", "pos"], "left")
    before = F.coalesce(F.last("after", ignorenulls=True).over(order), F.lit("body"))
    return joined.withColumn("mode", F.coalesce("own", before)).drop("after", "own")


def section_tree(heads: DataFrame) -> DataFrame:
    """Headings (doc_id, pos, level, text) with parent_pos, the nearest earlier heading of a
    smaller level; ord, the number of earlier children of the same parent; and path, the
    positions of all headings from the root to itself, which sorts depth first.

    Any level and depth; a heading without a level has level 1. One pass over a document's
    headings keeps a stack of those that are still open, of rising level; it is as long as they are deep.
    """
    own = heads.select("doc_id", "pos", F.coalesce("level", F.lit(1)).cast("int").alias("level"))

    def fold() -> Callable[[int, int], tuple[int | None, list[int]]]:
        levels, open_ = [], []

        def step(pos: int, level: int) -> tuple[int | None, list[int]]:
            while levels and levels[-1] >= level:
                levels.pop()
                open_.pop()
            parent = open_[-1] if open_ else None
            levels.append(level)
            open_.append(pos)
            return parent, open_.copy()

        return step

    paths = _in_order(own, fold, "parent_pos int, path array<int>")
    out = heads.join(paths, ["doc_id", "pos"])
    return out.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id", "parent_pos").orderBy("pos")) - 1)


def attach_to_section(items: DataFrame) -> DataFrame:
    """Paragraphs, tables and figures with section_pos (null before the first heading) and
    ord: within the section for paragraphs, within the document for tables and figures."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    section = F.last(F.when(F.col("kind") == "heading", F.col("pos")), ignorenulls=True).over(order)
    rows = items.withColumn("section_pos", section).where("kind <> 'heading'")
    group = F.when(F.col("kind") == "paragraph", F.col("section_pos"))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id", "kind", group).orderBy("pos")) - 1)


def captions_extract(items: DataFrame, captions: DataFrame) -> DataFrame:
    """One row for each table or figure with a caption: doc_id, subject_type, subject_pos, text."""
    subjects = items.where("kind in ('table', 'figure')").select("doc_id", F.col("pos").alias("subject_pos"), F.col("kind").alias("subject_type"))
    return subjects.join(captions, ["doc_id", "subject_pos", "subject_type"]).select("doc_id", "subject_type", "subject_pos", "text")


def abstract_join(items: DataFrame) -> DataFrame:
    """doc_id, abstract: the abstract's paragraphs with a blank line between, null if empty."""
    own = F.when((F.col("mode") == "abstract") & (F.col("kind") == "paragraph"), F.struct("pos", "text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["text"]), "\n\n")
    return items.groupBy("doc_id").agg(F.nullif(F.trim(text), F.lit("")).alias("abstract"))


def references_split(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, pos, text) to entries doc_id, entry (from 0), text.

    With two ``[n]`` marks or more in a document's blocks, an entry starts at each mark;
    otherwise each block is an entry. Blank entries go.
    """
    filled = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: F.trim(x["text"])), lambda x: x != "")
    rows = blocks.groupBy("doc_id").agg(filled.alias("parts")).withColumn("joined", F.array_join("parts", " "))
    marked = F.regexp_count("joined", F.lit(r"\[[0-9]+\]")) >= 2
    parts = F.when(marked, F.split("joined", r"(?=\[[0-9]+\])", -1)).otherwise(F.col("parts"))
    parts = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("doc_id", F.posexplode(parts).alias("entry", "text"))


def section_paths(sections: DataFrame) -> DataFrame:
    """Sections (doc_id, pos, parent_pos, ord) of any source with ``path``: the sibling orders
    from the root down, which sorts depth first. One join for each level that there is, until
    none has children; sections in a cycle, or below an unknown parent, have no path."""
    level = sections.where("parent_pos is null").select("doc_id", "pos", F.array("ord").alias("path"))
    found = level
    children = sections.where("parent_pos is not null").select("doc_id", "pos", "ord", "parent_pos")
    while True:
        above = level.select("doc_id", F.col("pos").alias("parent_pos"), "path")
        level = cut(children.join(above, ["doc_id", "parent_pos"]).select("doc_id", "pos", F.array_append("path", F.col("ord")).alias("path")))
        if level.isEmpty():
            return found
        found = found.unionByName(level)


def reading_order(items: DataFrame, sections: DataFrame, boxes: DataFrame) -> DataFrame:
    """Attached items with reading_pos (from 0): items without a section first, sections depth
    first by their ``path``; inside one by box (page, y0; items without a box last), kind and
    order."""
    paths = sections.select("doc_id", F.col("pos").alias("section_pos"), "path")
    rank = F.when(F.col("kind") == "paragraph", 0).when(F.col("kind") == "figure", 1).otherwise(2)
    rows = items.join(paths, ["doc_id", "section_pos"], "left").join(boxes, ["doc_id", "pos"], "left")
    order = Window.partitionBy("doc_id").orderBy(
        F.coalesce("path", F.array().cast("array<int>")),
        F.col("page").isNull(),
        "page",
        "y0",
        rank,
        "ord",
        "pos",
    )
    return rows.select(*items.columns, (F.row_number().over(order) - 1).alias("reading_pos"))


def table_markdown(cells: DataFrame) -> DataFrame:
    """Cells (doc_id, table, row, col, text, is_header) to one row for each table row:
    doc_id, table, row, line ('| a | b |'; a rule of dashes follows the header)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"])
    rows = cells.groupBy("doc_id", "table", "row").agg(
        F.array_join(ordered, " | ").alias("t"),
        F.bool_and("is_header").alias("h"),
        F.count(F.lit(1)).cast("int").alias("n"),
    )
    line = F.concat(F.lit("| "), "t", F.lit(" |"))
    return rows.select(
        "doc_id",
        "table",
        "row",
        F.when(F.col("h"), F.concat(line, F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("n")))).otherwise(line).alias("line"),
    )
