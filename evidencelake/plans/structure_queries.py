"""Queries of content structure and knowledge units, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relations, structure, units
from ..sources import views
from ..sources.stage import cut
from ..sources.views import with_views

Spark = SparkSession


def heading_normalize(spark: Spark, d: str) -> DataFrame:
    heads = views.titled_items(spark, d).where("kind = 'heading'")
    return heads.select(
        "doc_id",
        "pos",
        structure.normalize_heading(F.col("text")).alias("title"),
        structure.heading_role(F.col("text")).alias("role"),
    )


def special_sections(spark: Spark, d: str) -> DataFrame:
    return structure.special_sections(views.titled_items(spark, d)).select("doc_id", "pos", "kind", "mode")


def _sections(spark: Spark, d: str) -> DataFrame:
    return structure.section_tree(views.content_items(spark, d).where("kind = 'heading'"))


def section_tree(spark: Spark, d: str) -> DataFrame:
    return _sections(spark, d).select("doc_id", "pos", "level", "parent_pos", "ord")


def attach_to_section(spark: Spark, d: str) -> DataFrame:
    return structure.attach_to_section(views.content_items(spark, d)).select("doc_id", "pos", "kind", "section_pos", "ord")


def captions_extract(spark: Spark, d: str) -> DataFrame:
    return structure.captions_extract(views.content_items(spark, d), views.captions(spark, d))


def abstract_join(spark: Spark, d: str) -> DataFrame:
    return structure.abstract_join(structure.special_sections(views.titled_items(spark, d)))


def _reference_blocks(spark: Spark, d: str) -> DataFrame:
    marked = F.when(
        F.col("doc_id") % 2 == 0,
        F.concat(F.lit("["), (F.col("ref_order") + 1).cast("string"), F.lit("] "), "raw_text"),
    ).otherwise(F.col("raw_text"))
    return views.references(spark, d).select("doc_id", F.col("ref_order").alias("pos"), marked.alias("text"))


def references_split(spark: Spark, d: str) -> DataFrame:
    return structure.references_split(_reference_blocks(spark, d))


def reading_order(spark: Spark, d: str) -> DataFrame:
    items = structure.attach_to_section(views.content_items(spark, d))
    return structure.reading_order(items, _sections(spark, d), views.boxes(spark, d)).select("doc_id", "pos", "reading_pos")


def table_markdown(spark: Spark, d: str) -> DataFrame:
    rows = views.content_items(spark, d).where("kind = 'table'").select(
        "doc_id",
        F.col("pos").alias("table"),
        F.posexplode(F.split("text", " ", -1)).alias("n", "text"),
    )
    cells = rows.select(
        "doc_id",
        "table",
        F.expr("cast(n div 3 as int)").alias("row"),
        (F.col("n") % 3).alias("col"),
        "text",
        (F.col("n") < 3).alias("is_header"),
    )
    return structure.table_markdown(cells)


def _runs(spark: Spark, d: str) -> DataFrame:
    return units.paragraph_runs(structure.attach_to_section(views.content_items(spark, d)))


def _blocks(spark: Spark, d: str) -> DataFrame:
    return units.merge_tiny(_runs(spark, d)).drop("front")


def paragraph_runs(spark: Spark, d: str) -> DataFrame:
    return _runs(spark, d).select("doc_id", "pos", "run", "section_pos")


def merge_tiny(spark: Spark, d: str) -> DataFrame:
    return _blocks(spark, d)


def split_oversized(spark: Spark, d: str) -> DataFrame:
    docs = views.table(spark, d, "documents").select("doc_id", "text")
    return units.split_oversized(docs, ("doc_id",))


def front_matter_label(spark: Spark, d: str) -> DataFrame:
    opening = F.expr("case doc_id % 4 when 0 then concat('Abstract: ', text) when 1 then concat('Index  terms - ', text) else text end")
    items = views.content_items(spark, d).withColumn("text", opening).where("not (kind = 'heading' and pos = 0)")
    runs = units.paragraph_runs(structure.attach_to_section(items))
    return units.front_matter_label(runs).select("doc_id", "pos", "context")


def section_context(spark: Spark, d: str) -> DataFrame:
    return units.section_context(_blocks(spark, d), _sections(spark, d)).select("doc_id", "run", "block", "context")


def _titles(spark: Spark, d: str) -> DataFrame:
    return views.first_lines(spark, d)


def ku_title(spark: Spark, d: str) -> DataFrame:
    return units.single_units(_titles(spark, d), "title", F.col("text"))


def ku_abstract(spark: Spark, d: str) -> DataFrame:
    return units.single_units(abstract_join(spark, d), "abstract", F.col("abstract"), F.lit("Abstract"))


def ku_reference(spark: Spark, d: str) -> DataFrame:
    return units.reference_units(references_split(spark, d))


def _some_captions(spark: Spark, d: str) -> DataFrame:
    """Captions of which every other is blank."""
    return views.captions(spark, d).withColumn("text", F.expr("case when subject_pos % 2 = 0 then text else ' ' end"))


def ku_table(spark: Spark, d: str) -> DataFrame:
    items, captions = views.content_items(spark, d), _some_captions(spark, d)
    return units.visual_units(items, captions, "table", relations.printed_numbers(captions), F.when(F.col("pos") % 3 > 0, F.col("text")))


def ku_figure(spark: Spark, d: str) -> DataFrame:
    items, captions = views.content_items(spark, d), _some_captions(spark, d)
    return units.visual_units(items, captions, "figure", relations.printed_numbers(captions))


def knowledge_units(spark: Spark, d: str) -> DataFrame:
    """All units of the documents: doc_id, ord, kind, pos, part, text, context, words. Body units
    are in reading order, which is their pos; paragraphs of the abstract and of the references
    section are no body. Documents are split once; items are placed without their texts, which join them afterwards."""
    lines = cut(views.titled_items(spark, d))
    text = lines.select("doc_id", "pos", "kind", "text")
    titles = lines.withColumn("text", F.when(F.col("kind") == "heading", F.col("text")))
    moded = cut(structure.special_sections(titles))
    body = moded.where("kind in ('table', 'figure') or mode = 'body'").drop("mode")
    heads = body.where("kind = 'heading'")
    items = structure.reading_order(structure.attach_to_section(body.drop("text")), structure.section_tree(heads), views.boxes_of(lines))
    items = cut(items)

    def texts(rows: DataFrame, kinds: tuple[str, ...], how: str = "inner") -> DataFrame:
        return rows.join(text.where(F.col("kind").isin(*kinds)), ["doc_id", "pos", "kind"], how)

    # the window that finds the runs brings a document's texts together, so that folding them needs no further shuffle
    runs = units.paragraph_runs(texts(items, ("paragraph",), "left"), "reading_pos")
    titled = units.section_context(units.merge_tiny(runs, order_col="reading_pos"), heads).withColumnRenamed("context", "section")
    split = units.split_oversized(titled, ("doc_id", "first_pos", "front", "section"), max_words=40)
    split = units.front_matter_label(split).withColumn("context", F.coalesce("context", "section"))

    seen = ("table", "figure")
    captions = views.captions_of(text)
    tables = F.when(F.col("kind") == "table", F.col("text"))
    visuals = units.visual_units(texts(items, seen), captions, seen, relations.printed_numbers(captions), tables, ("kind", "reading_pos"))
    abstract = texts(moded.where("mode = 'abstract' and kind = 'paragraph'").drop("text"), ("paragraph",))

    parts = {
        "title": ku_title(spark, d),
        "abstract": units.single_units(structure.abstract_join(abstract), "abstract", F.col("abstract"), F.lit(units.ABSTRACT)),
        "text": split.select("doc_id", F.col("first_pos").alias("pos"), "part", "text", "context"),
        "visual": visuals.drop("pos").withColumnRenamed("reading_pos", "pos"),
        "reference": ku_reference(spark, d).withColumnRenamed("entry", "pos"),
    }
    return units.assemble_units(parts)


def ku_assemble(spark: Spark, d: str) -> DataFrame:
    return knowledge_units(spark, d).select("doc_id", "ord", "kind", "pos", "part", F.md5(F.col("text").cast("binary")).alias("text_md5"), "context")


def token_count(spark: Spark, d: str) -> DataFrame:
    return knowledge_units(spark, d).groupBy("doc_id", "kind").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("units"))


def printed_numbers(spark: Spark, d: str) -> DataFrame:
    return relations.printed_numbers(views.captions(spark, d)).select("doc_id", "subject_type", "subject_pos", "number")


def edges_continues(spark: Spark, d: str) -> DataFrame:
    parts = split_oversized(spark, d)
    return relations.edges_continues(parts, ("doc_id",), "part")


def _cited(spark: Spark, d: str) -> DataFrame:
    return views.cited_paragraphs(spark, d)


def edges_cites(spark: Spark, d: str) -> DataFrame:
    return relations.edges_cites(_cited(spark, d), references_split(spark, d))


def edges_references(spark: Spark, d: str) -> DataFrame:
    return relations.edges_references(_cited(spark, d), relations.printed_numbers(views.captions(spark, d)))


def citation_counts(spark: Spark, d: str) -> DataFrame:
    return relations.citation_counts(references_split(spark, d).select("doc_id", "entry"), edges_cites(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        heading_normalize, special_sections, section_tree, attach_to_section, captions_extract, abstract_join, references_split, reading_order, table_markdown, paragraph_runs, merge_tiny, split_oversized,
        front_matter_label, section_context, ku_title, ku_abstract, ku_reference, ku_table, ku_figure, ku_assemble, token_count, printed_numbers, edges_continues, edges_cites, edges_references, citation_counts,
    )
}

_WS = r"[ \t\n\r\f\v]"
_WORDS = f"len(list_filter(string_split_regex({{}}, '{_WS}+'), lambda x: x <> ''))"
_NORMAL = rf"lower(trim(regexp_replace(trim(regexp_replace(text, '^{_WS}*[0-9]+(\.[0-9]+)*\.?{_WS}*', '')), ':+$', '')))"
_HEADS = {"heads": "SELECT doc_id, pos, level, coalesce(level, 1) AS depth, text FROM content_items WHERE kind = 'heading'"}
_TREE = _HEADS | {
    "linked": (
        "SELECT *, (SELECT max(o.pos) FROM heads o WHERE o.doc_id = h.doc_id AND o.pos < h.pos AND o.depth < h.depth) AS parent_pos "
        "FROM heads h"
    ),
    "sections": "SELECT *, row_number() OVER (PARTITION BY doc_id, parent_pos ORDER BY pos) - 1 AS ord FROM linked",
}
_ATTACHED = {
    "placed": "SELECT *, max(CASE WHEN kind = 'heading' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS section_pos FROM content_items",
    "attached": (
        "SELECT *, row_number() OVER (PARTITION BY doc_id, kind, CASE WHEN kind = 'paragraph' THEN section_pos END "
        "ORDER BY pos) - 1 AS ord FROM placed WHERE kind <> 'heading'"
    ),
}
_MODES = {
    "marked": (
        f"SELECT doc_id, pos, coalesce(level, 1) AS level, CASE WHEN {_NORMAL} = 'abstract' THEN 'abstract' "
        f"WHEN {_NORMAL} IN ('references', 'bibliography') THEN 'references' "
        f"ELSE 'section' END AS role, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM titled_items WHERE kind = 'heading'"
    ),
    "walk": """SELECT doc_id, pos, n, CASE WHEN role = 'section' THEN 'body' ELSE role END AS mode, level AS mode_level, CASE WHEN role = 'section' THEN 'body' ELSE role END AS own FROM marked WHERE n = 1
        UNION ALL SELECT m.doc_id, m.pos, m.n,
            CASE WHEN w.mode <> 'body' AND m.level > w.mode_level THEN w.mode WHEN m.role = 'section' THEN 'body' ELSE m.role END,
            CASE WHEN w.mode <> 'body' AND m.level > w.mode_level THEN w.mode_level ELSE m.level END,
            CASE WHEN w.mode <> 'body' AND m.level > w.mode_level THEN 'dropped' WHEN m.role = 'section' THEN 'body' ELSE m.role END
        FROM walk w JOIN marked m ON m.doc_id = w.doc_id AND m.n = w.n + 1""",
    "moded": (
        "SELECT t.doc_id, t.pos, t.kind, t.level, t.text, coalesce(w.own, (SELECT arg_max(x.mode, x.pos) FROM walk x "
        "WHERE x.doc_id = t.doc_id AND x.pos < t.pos), 'body') AS mode FROM titled_items t LEFT "
        "JOIN walk w ON w.doc_id = t.doc_id AND w.pos = t.pos"
    ),
}
_ABSTRACT = _MODES | {
    "abstracts": (
        "SELECT doc_id, nullif(trim(coalesce(string_agg(CASE WHEN mode = 'abstract' "
        "AND kind = 'paragraph' THEN text END, chr(10) || chr(10) ORDER BY pos), '')), '') AS abstract FROM moded GROUP BY doc_id"
    )
}
_ENTRIES = {
    "blocks": (
        "SELECT doc_id, ref_order AS pos, CASE WHEN doc_id % 2 = 0 THEN '[' || (ref_order + 1) || '] ' || raw_text "
        "ELSE raw_text END AS text FROM references_v"
    ),
    "joined": (
        "SELECT doc_id, string_agg(trim(text), ' ' ORDER BY pos) AS j, list(trim(text) ORDER BY pos) AS parts FROM blocks "
        "WHERE trim(text) <> '' GROUP BY doc_id"
    ),
    "cut": (
        r"SELECT doc_id, list_filter(list_transform(CASE "
        r"WHEN len(regexp_extract_all(j, '\[[0-9]+\]')) >= 2 THEN string_split(regexp_replace(j, '(\[[0-9]+\])', chr(1) || '\1', 'g'), "
        r"chr(1)) ELSE parts END, lambda x: trim(x)), lambda x: x <> '') AS p FROM joined"
    ),
    "entries": "SELECT doc_id, generate_subscripts(p, 1) - 1 AS entry, unnest(p) AS text FROM cut",
}
_PATHS = {
    "paths": (
        "SELECT doc_id, pos, [ord] AS path FROM sections WHERE parent_pos IS NULL "
        "UNION ALL SELECT s.doc_id, s.pos, list_append(p.path, s.ord) FROM paths p "
        "JOIN sections s ON s.doc_id = p.doc_id AND s.parent_pos = p.pos"
    )
}
_READING = (
    "row_number() OVER (PARTITION BY a.doc_id "
    "ORDER BY coalesce(p.path, CAST([] AS BIGINT[])), b.page IS NULL, b.page, b.y0, CASE a.kind WHEN 'paragraph' THEN 0 "
    "WHEN 'figure' THEN 1 ELSE 2 END, a.ord, a.pos) - 1 AS reading_pos FROM attached a LEFT "
    "JOIN paths p ON p.doc_id = a.doc_id AND p.pos = a.section_pos LEFT JOIN boxes b ON b.doc_id = a.doc_id AND b.pos = a.pos"
)
_RUNS = _ATTACHED | {
    "flagged": (
        "SELECT *, CASE WHEN kind = 'paragraph' AND (lag(kind) OVER w IS NULL OR lag(kind) OVER w <> 'paragraph' OR lag(section_pos) "
        "OVER w IS DISTINCT FROM section_pos) THEN 1 ELSE 0 END AS new FROM attached WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"
    ),
    "runs": (
        "SELECT * FROM (SELECT *, sum(new) OVER w - 1 AS run, NOT bool_or(kind <> 'paragraph' OR section_pos IS NOT NULL) OVER w AS "
        "front FROM flagged WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE kind = 'paragraph'"
    ),
}
_BLOCKS = _RUNS | {
    "counted": (
        f"SELECT doc_id, run, section_pos, front, pos, text, {_WORDS.format('text')} AS words, row_number() OVER (PARTITION BY doc_id, "
        f"run ORDER BY pos) AS n FROM runs"
    ),
    "steps": """SELECT doc_id, run, n, 0 AS g, words AS open FROM counted WHERE n = 1
        UNION ALL SELECT c.doc_id, c.run, c.n, CASE WHEN s.open < 4 THEN s.g ELSE s.g + 1 END, CASE WHEN s.open < 4 THEN s.open + c.words ELSE c.words END FROM steps s JOIN counted c ON c.doc_id = s.doc_id AND c.run = s.run AND c.n = s.n + 1""",
    "lasts": "SELECT doc_id, run, max(g) AS g, arg_max(open, n) AS open FROM steps GROUP BY doc_id, run",
    "tiny": (
        "SELECT c.*, CASE WHEN s.g = l.g AND l.open < 4 AND l.g > 0 THEN s.g - 1 ELSE s.g END AS block FROM counted c "
        "JOIN steps s ON s.doc_id = c.doc_id AND s.run = c.run AND s.n = c.n JOIN lasts l ON l.doc_id = c.doc_id AND l.run = c.run"
    ),
    "merged": (
        "SELECT doc_id, run, block, section_pos, any_value(front) AS front, min(pos) AS first_pos, count(*) AS n_paragraphs, "
        "string_agg(text, ' ' ORDER BY pos) AS text FROM tiny GROUP BY doc_id, run, block, section_pos"
    ),
}


def _split_sql(source: str, keys: str, most: int) -> dict[str, str]:
    on = " AND ".join(f"x.{k} IS NOT DISTINCT FROM p.{k}" for k in keys.split(", "))
    cut = (
        rf"list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){_WS}+', '\1' || chr(1), 'g'), chr(1)), lambda x: "
        rf"trim(x)), lambda x: x <> '')"
    )
    own = ", ".join(f"x.{k}" for k in keys.split(", "))
    return {
        "sentences": f"SELECT {keys}, unnest(s) AS sentence, generate_subscripts(s, 1) AS n FROM (SELECT {keys}, {cut} AS s FROM {source})",
        "weighed": f"SELECT *, {_WORDS.format('sentence')} AS w FROM sentences",
        "packed": (
            f"SELECT {keys}, n, 0 AS part, w AS words, w AS last FROM weighed WHERE n = 1 "
            f"UNION ALL SELECT {own}, x.n, CASE WHEN p.words + x.w > {most} THEN p.part + 1 ELSE p.part END, CASE "
            f"WHEN p.words + x.w > {most} THEN p.last + x.w ELSE p.words + x.w END, x.w FROM packed p JOIN weighed x ON {on} AND x.n = p.n + 1"
        ),
        "whole": f"SELECT {keys}, part, n FROM packed UNION ALL SELECT {keys}, part, min(n) - 1 FROM packed WHERE part > 0 GROUP BY {keys}, part",
        "parts": (
            f"SELECT {own}, x.part, string_agg(p.sentence, ' ' ORDER BY p.n) AS text FROM whole x JOIN sentences p ON {on} AND p.n = x.n "
            f"GROUP BY {own}, x.part"
        ),
    }


_SPLIT = _split_sql("documents", "doc_id", 250)
_ROMAN = (
    "list_reduce(list_prepend({'total': 0, 'top': 0}, list_transform(string_split(reverse(token), ''), lambda c: {'total': CASE c "
    "WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 "
    "ELSE 1000 END, 'top': 0})), lambda a, x: {'total': CASE WHEN x.total < a.top THEN a.total - x.total "
    "ELSE a.total + x.total END, 'top': greatest(a.top, x.total)}).total"
)
_VALUE = (
    f"CASE WHEN regexp_matches(token, '^[0-9]+$') THEN CAST(token AS INT) "
    f"WHEN regexp_matches(token, '^[IVXLCDM]+$') THEN nullif(greatest({_ROMAN}, 0), 0) END"
)
_NUMBERS = {
    "printed": (
        r"SELECT doc_id, subject_type, subject_pos, upper(regexp_extract(text, '^[ \t]*(?i:figure|fig\.?|table)[ "
        r"\t]+([0-9]+|[ivxlcdmIVXLCDM]+\b)', 1)) AS token FROM captions"
    ),
    "valued": f"SELECT doc_id, subject_type, subject_pos, {_VALUE} AS number FROM printed",
    "numbers": (
        "SELECT doc_id, subject_type, min(subject_pos) AS subject_pos, number FROM valued WHERE number IS NOT NULL "
        "GROUP BY doc_id, subject_type, number"
    ),
}
_EVEN = {
    "even": "SELECT doc_id, subject_pos, subject_type, CASE WHEN subject_pos % 2 = 0 THEN text ELSE ' ' END AS text FROM captions",
    **{k: v.replace("FROM captions", "FROM even") for k, v in _NUMBERS.items()},
}
_CITES = _ENTRIES | {
    "marks": r"SELECT doc_id, pos, unnest(regexp_extract_all(text, '\[([0-9]+)\]', 1)) AS mark FROM cited_paragraphs",
    "cites": (
        "SELECT DISTINCT m.doc_id, m.pos AS source_pos, e.entry AS target_entry FROM marks m "
        "JOIN entries e ON e.doc_id = m.doc_id AND e.entry + 1 = CAST(m.mark AS BIGINT)"
    ),
}
_VISUAL = (
    "SELECT i.doc_id, i.pos, {text} AS text, '{name}' || coalesce(' ' || n.number, '') AS context FROM content_items i LEFT "
    "JOIN {captions} c ON c.doc_id = i.doc_id AND c.subject_pos = i.pos LEFT "
    "JOIN numbers n ON n.doc_id = i.doc_id AND n.subject_pos = i.pos WHERE i.kind = '{kind}'"
)
_TITLE = "SELECT doc_id, 'title' AS kind, trim(text) AS text, CAST(NULL AS VARCHAR) AS context FROM paper_lines WHERE pos = 0"
_TABLE_TEXT = "coalesce(nullif(concat_ws(chr(10) || chr(10), nullif(trim(c.text), ''), {}), ''), 'Untitled table')"
_CONTEXT = _BLOCKS | {
    "titled": (
        "SELECT m.doc_id, m.run, m.block, m.first_pos, m.text, 'Section: ' || h.text AS context FROM merged m LEFT "
        "JOIN content_items h ON h.doc_id = m.doc_id AND h.pos = m.section_pos"
    )
}
_FRONT = (
    f"CASE WHEN regexp_matches(lower(text), '^{_WS}*abstract\\b') THEN 'Abstract' "
    f"WHEN regexp_matches(lower(text), '^{_WS}*(index{_WS}+terms|keywords)\\b') THEN 'Keywords (index terms)' "
    f"ELSE 'Authors and affiliations (title page)' END"
)
_BODY = {"body": "SELECT * FROM moded WHERE kind IN ('table', 'figure') OR mode = 'body'"}
_ORDERED = {
    "ordered": f"SELECT a.doc_id, a.kind, a.level, a.text, a.section_pos, a.pos AS item_pos, {_READING}",
    "read": "SELECT *, reading_pos AS pos FROM ordered",
}
_SPLIT_BODY = _split_sql("headed", "doc_id, first_pos, front, context", 40)


def _of(source: str, named: dict[str, str], old: str = "content_items") -> dict[str, str]:
    """Named queries that read ``source`` in place of ``old``."""
    return {k: v.replace(f"FROM {old}", f"FROM {source}") for k, v in named.items()}


_UNITS = (
    _ABSTRACT
    | _BODY
    | _of("body", _TREE | _ATTACHED)
    | _PATHS
    | _ORDERED
    | {k: v for k, v in _of("read", _BLOCKS, "attached").items() if k not in _ATTACHED}
    | {
        "headed": (
            "SELECT m.doc_id, m.first_pos, m.front, m.text, 'Section: ' || h.text AS context FROM merged m LEFT "
            "JOIN body h ON h.doc_id = m.doc_id AND h.pos = m.section_pos"
        )
    }
    | _SPLIT_BODY
    | _ENTRIES
    | _NUMBERS
    | {
        "pieces": f"""SELECT doc_id, 0 AS r, kind, 0 AS pos, 0 AS part, text, context FROM ({_TITLE})
        UNION ALL SELECT doc_id, 1, 'abstract', 0, 0, abstract, 'Abstract' FROM abstracts WHERE abstract IS NOT NULL
        UNION ALL SELECT doc_id, 2, 'text', first_pos, part, text, CASE WHEN front THEN {_FRONT} ELSE context END FROM parts
        UNION ALL SELECT v.doc_id, 2, 'table', o.reading_pos, 0, v.text, v.context FROM ({_VISUAL.format(text=_TABLE_TEXT.format("i.text"), name="Table", captions="captions", kind="table")}) v JOIN ordered o ON o.doc_id = v.doc_id AND o.item_pos = v.pos
        UNION ALL SELECT v.doc_id, 2, 'figure', o.reading_pos, 0, v.text, v.context FROM ({_VISUAL.format(text="coalesce(nullif(trim(c.text), ''), 'Untitled figure')", name="Figure", captions="captions", kind="figure")}) v JOIN ordered o ON o.doc_id = v.doc_id AND o.item_pos = v.pos
        UNION ALL SELECT doc_id, 3, 'reference', entry, 0, text, 'Bibliography reference [' || (entry + 1) || ']' FROM entries""",
        "assembled": (
            f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id "
            f"ORDER BY r, pos, part) - 1 AS ord, kind, pos, part, text, context, CASE "
            f"WHEN kind NOT IN ('table', 'figure') THEN {_WORDS.format('text')} END AS words FROM pieces"
        ),
    }
)

ORACLE_SQL = {
    "heading_normalize": with_views(
        f"SELECT doc_id, pos, {_NORMAL} AS title, CASE WHEN {_NORMAL} = 'abstract' THEN 'abstract' "
        f"WHEN {_NORMAL} IN ('references', 'bibliography') THEN 'references' ELSE 'section' END AS role FROM titled_items "
        f"WHERE kind = 'heading'"
    ),
    "special_sections": with_views("SELECT doc_id, pos, kind, mode FROM moded", _MODES),
    "section_tree": with_views("SELECT doc_id, pos, level, parent_pos, ord FROM sections", _TREE),
    "attach_to_section": with_views("SELECT doc_id, pos, kind, section_pos, ord FROM attached", _ATTACHED),
    "captions_extract": with_views(
        "SELECT c.doc_id, c.subject_type, c.subject_pos, c.text FROM captions c "
        "JOIN content_items i ON i.doc_id = c.doc_id AND i.pos = c.subject_pos AND i.kind = c.subject_type"
    ),
    "abstract_join": with_views("SELECT doc_id, abstract FROM abstracts", _ABSTRACT),
    "references_split": with_views("SELECT doc_id, entry, text FROM entries", _ENTRIES),
    "reading_order": with_views(
        f"SELECT a.doc_id, a.pos, {_READING}",
        _TREE | _ATTACHED | _PATHS,
    ),
    "table_markdown": with_views(
        "SELECT doc_id, tab AS \"table\", \"row\", '| ' || string_agg(text, ' | ' "
        "ORDER BY n) || ' |' || CASE WHEN \"row\" = 0 THEN chr(10) || '|' || repeat(' --- |', count(*)) ELSE '' END AS line FROM cells "
        "GROUP BY doc_id, tab, \"row\"",
        {
            "cells": (
                "SELECT doc_id, tab, CAST((n - 1) // 3 AS INT) AS \"row\", n, text "
                "FROM (SELECT doc_id, pos AS tab, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) AS n "
                "FROM content_items WHERE kind = 'table')"
            )
        },
    ),
    "paragraph_runs": with_views("SELECT doc_id, pos, run, section_pos FROM runs", _RUNS),
    "merge_tiny": with_views("SELECT * EXCLUDE (front) FROM merged", _BLOCKS),
    "split_oversized": with_views(f"SELECT doc_id, part, text, {_WORDS.format('text')} AS words FROM parts", _SPLIT),
    "front_matter_label": with_views(
        f"SELECT doc_id, pos, CASE WHEN front THEN CASE WHEN regexp_matches(lower(text), '^{_WS}*abstract\\b') THEN 'Abstract' "
        f"WHEN regexp_matches(lower(text), '^{_WS}*(index{_WS}+terms|keywords)\\b') THEN 'Keywords (index terms)' "
        f"ELSE 'Authors and affiliations (title page)' END END AS context FROM runs",
        {
            "opened": (
                "SELECT doc_id, pos, kind, level, CASE doc_id % 4 WHEN 0 THEN 'Abstract: ' || text WHEN 1 THEN 'Index  terms - ' || text "
                "ELSE text END AS text FROM content_items WHERE NOT (kind = 'heading' AND pos = 0)"
            )
        }
        | {k: v.replace("FROM content_items", "FROM opened") for k, v in _RUNS.items()},
    ),
    "section_context": with_views("SELECT doc_id, run, block, context FROM titled", _CONTEXT),
    "ku_title": with_views(_TITLE),
    "ku_abstract": with_views(
        "SELECT doc_id, 'abstract' AS kind, abstract AS text, 'Abstract' AS context FROM abstracts WHERE abstract IS NOT NULL",
        _ABSTRACT,
    ),
    "ku_reference": with_views("SELECT doc_id, entry, text, 'Bibliography reference [' || (entry + 1) || ']' AS context FROM entries", _ENTRIES),
    "ku_table": with_views(
        _VISUAL.format(text=_TABLE_TEXT.format("CASE WHEN i.pos % 3 > 0 THEN i.text END"), name="Table", captions="even", kind="table"),
        _EVEN,
    ),
    "ku_figure": with_views(
        _VISUAL.format(text="coalesce(nullif(trim(c.text), ''), 'Untitled figure')", name="Figure", captions="even", kind="figure"),
        _EVEN,
    ),
    "ku_assemble": with_views("SELECT doc_id, ord, kind, pos, part, md5(text) AS text_md5, context FROM assembled", _UNITS),
    "token_count": with_views(
        "SELECT doc_id, kind, CAST(sum(words) AS BIGINT) AS words, count(*) AS units FROM assembled GROUP BY doc_id, kind",
        _UNITS,
    ),
    "printed_numbers": with_views("SELECT doc_id, subject_type, subject_pos, number FROM numbers", _NUMBERS),
    "edges_continues": with_views(
        "SELECT doc_id, part AS source, part + 1 AS target FROM parts WHERE part + 1 IN (SELECT part FROM parts o WHERE o.doc_id = parts.doc_id)",
        _SPLIT,
    ),
    "edges_cites": with_views("SELECT * FROM cites", _CITES),
    "edges_references": with_views(
        "SELECT DISTINCT m.doc_id, m.pos AS source_pos, n.subject_type, n.subject_pos AS target_pos FROM mentions m "
        "JOIN numbers n ON n.doc_id = m.doc_id AND n.subject_type = m.kind AND n.number = m.number",
        _NUMBERS
        | {
            "found": (
                r"SELECT doc_id, pos, unnest(regexp_extract_all(text, '\b(?i:figure|fig\.?|table)[ \t\n\r\f\v]+(?:[0-9]+|[ivxlcdmIVXLCDM]+\b)')) "
                r"AS m FROM cited_paragraphs"
            ),
            "tokens": (
                r"SELECT doc_id, pos, CASE WHEN lower(m) LIKE 'table%' THEN 'table' "
                r"ELSE 'figure' END AS kind, upper(regexp_extract(m, '([0-9A-Za-z]+)$', 1)) AS token FROM found"
            ),
            "mentions": f"SELECT doc_id, pos, kind, {_VALUE} AS number FROM tokens",
        },
    ),
    "citation_counts": with_views(
        "SELECT e.doc_id, e.entry, count(c.source_pos) AS citations FROM entries e LEFT "
        "JOIN cites c ON c.doc_id = e.doc_id AND c.target_entry = e.entry GROUP BY e.doc_id, e.entry",
        _CITES,
    ),
}
