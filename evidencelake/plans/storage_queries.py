"""Queries of files, freshness, integrity, conversations and locations, with DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, conversation, freshness, structure
from ..sources import files, stage, views
from ..sources.views import with_views
from . import retrieval_queries, search_queries, structure_queries
from .retrieval_queries import _CITED
from .search_queries import _NODES, UNITS_SQL

Spark = SparkSession
MAX_BYTES = 20_000


def _files(spark: Spark, d: str) -> DataFrame:
    name = F.expr("concat('doc', doc_id, case when doc_id % 5 = 0 then '.txt' else '.PDF' end)")
    kind = F.expr("case when doc_id % 7 = 3 then 'text/plain' else 'application/pdf' end")
    content = F.expr("case when doc_id % 11 = 4 then '' when doc_id % 3 = 0 then text else concat('%PDF-1.7 ', text) end")
    return views.table(spark, d, "documents").select(
        "doc_id",
        name.alias("filename"),
        kind.alias("content_type"),
        content.cast("binary").alias("content"),
    )


def upload_validate(spark: Spark, d: str) -> DataFrame:
    return _files(spark, d).select("filename", files.upload_reason(MAX_BYTES).alias("reason"))


def upload_register(spark: Spark, d: str) -> DataFrame:
    return files.register(_files(spark, d), MAX_BYTES)


def read_stage_json(spark: Spark, d: str) -> DataFrame:
    """Units written as JSON objects, one for each part of a document, without a field that is
    newer, and read together."""
    rows = search_queries._units(spark, d)
    docs = stage.pack_units(
        rows.select(
            "document_id",
            F.col("ku_id").cast("string").alias("id"),
            F.col("ord").cast("int").alias("order"),
            "modality",
            "text",
            F.array(F.col("asset")).alias("source_element_ids"),
        )
    )
    path = stage.scratch(spark, "units")
    docs.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    out = stage.unpack_units(spark.read.schema(stage.UNITS_JSON).json(path))
    return out.select("document_id", "id", "order", "modality", "text", "retrieval_context")


def write_stage(spark: Spark, d: str) -> DataFrame:
    """Stored units of all documents, then those of documents below five replaced. Several
    documents share each bucket."""
    rows = search_queries._units(spark, d).select("document_id", "ku_id", F.lit("first").alias("state"))
    path = stage.scratch(spark, "written")
    stage.write_stage(rows, path, buckets=4)
    stage.write_stage(rows.where("document_id < 5 and ku_id % 2 = 0").withColumn("state", F.lit("second")), path, buckets=4)
    return spark.read.schema("document_id long, ku_id long, state string").parquet(path).drop("bucket")


def layout_view(spark: Spark, d: str) -> DataFrame:
    boxes = views.boxes(spark, d).select(
        "doc_id",
        "pos",
        F.array(F.struct("page", "y0"), F.struct((F.col("page") + 1).alias("page"), F.lit(0.0).alias("y0"))).alias("boxes"),
    )
    items = views.content_items(spark, d).join(boxes, ["doc_id", "pos"]).withColumn("id", F.col("pos").cast("long"))
    out = files.layout({k: items.where(F.col("kind") == k).select("doc_id", "id", "boxes") for k in ("heading", "paragraph", "table", "figure")})
    text = F.array_join(F.transform("elements", lambda e: F.concat_ws(" ", e["y0"].cast("int"), e["kind"], e["id"])), ",")
    return out.select("doc_id", "page", text.alias("elements"))


def pages_to_content(spark: Spark, d: str) -> DataFrame:
    out = files.page_content(views.table(spark, d, "pages").select("page_id", "html"))
    return out.select("page_id", "pos", "kind", "level", F.char_length("text").alias("chars"))


def content_hash(spark: Spark, d: str) -> DataFrame:
    return files.content_hash(search_queries._units(spark, d), "document_id", ["ku_id", "modality", "context", "text"])


def _stale(spark: Spark, d: str) -> DataFrame:
    sources = content_hash(spark, d).withColumnRenamed("version", "source_hash")
    old = sources.where("document_id % 4 <> 1").select(
        "document_id",
        F.when(F.col("document_id") == 2, "other").otherwise("m").alias("model"),
        F.when(F.col("document_id") == 3, F.lit(None)).otherwise("v1").alias("version"),
        F.when(F.col("document_id") % 5 == 4, "changed").otherwise(F.col("source_hash")).alias("source_hash"),
    )
    return freshness.stale_documents(sources, old, "m", "v1")


def stale_documents(spark: Spark, d: str) -> DataFrame:
    return _stale(spark, d)


def incremental_refresh(spark: Spark, d: str) -> DataFrame:
    rows = views.points(spark, d).select("document_id", "ku_id")
    build = lambda df: df.withColumn("state", F.lit("new"))
    return freshness.incremental_refresh(rows, rows.withColumn("state", F.lit("old")), _stale(spark, d), build)


def _manifests(spark: Spark, d: str) -> DataFrame:
    units = search_queries._units(spark, d)
    edges = views.point_edges(spark, d).where("type = 'CITES'").select(
        F.expr("cast(substring(src, 2) as bigint)").alias("ku_id"),
        "dst",
    ).join(units.select("ku_id", "document_id"), "ku_id")
    return freshness.manifests({"units": (units, "text"), "embeddings": (units.select("document_id", "ku_id"), "ku_id"), "citations": (edges, "dst")})


def manifests(spark: Spark, d: str) -> DataFrame:
    return _manifests(spark, d)


def provenance(spark: Spark, d: str) -> DataFrame:
    answers = views.answers(spark, d).select("answer_id", (F.col("conv_id") % 10).alias("document_id"))
    return freshness.provenance(answers, retrieval_queries.citations_resolve(spark, d), views.evidence(spark, d), _manifests(spark, d))


def dq_paper(spark: Spark, d: str) -> DataFrame:
    """Papers with planted faults: some without content and some with sections only, a parent
    that is missing, one that is a cycle, foreign children, captions without subject and
    captions of the other kind."""
    docs = views.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    tree = structure.section_tree(views.content_items(spark, d).where("kind = 'heading'"))
    parent = F.expr("case when doc_id % 50 = 7 and pos = 14 then 9999 when doc_id % 50 = 9 and pos = 0 then pos else parent_pos end")
    sections = tree.where("doc_id % 100 <> 4").select(F.col("doc_id").alias("document_id"), F.col("pos").alias("id"), parent.alias("parent"))
    items = views.content_items(spark, d).where("kind <> 'heading'")
    children = items.where("doc_id % 100 not in (3, 4)").select(
        F.col("doc_id").alias("document_id"),
        F.col("pos").alias("id"),
        F.expr("case when doc_id % 100 = 5 and pos = 1 then doc_id + 1 else doc_id end").alias("paper_id"),
    )
    kind = F.expr("case when doc_id % 20 = 6 and subject_type = 'figure' then 'table' else subject_type end")
    captions = views.captions(spark, d).where("subject_pos <> 5 or doc_id % 10 <> 1").select(
        F.col("doc_id").alias("document_id"),
        kind.alias("kind"),
        F.col("subject_pos").alias("id"),
    )
    visuals = items.where(
        "kind in ('table', 'figure') and (pos <> 8 or doc_id % 10 <> 2)"
    ).select(F.col("doc_id").alias("document_id"), "kind", F.col("pos").alias("id"))
    return checks.check_papers(docs, sections, children, captions, visuals)


def dq_units(spark: Spark, d: str) -> DataFrame:
    u = views.points(spark, d)
    papers = views.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"))
    units = u.select(
        "document_id",
        F.col("ku_id").alias("id"),
        F.expr("case when ku_id % 100 = 11 then 0 else ord end").alias("ord"),
        F.expr("case when ku_id % 90 = 5 then document_id + 1 else document_id end").alias("paper_id"),
        F.col("section_id").alias("section"),
    )
    sections = u.where("section_id % 7 <> 3").select("document_id", F.col("section_id").alias("id")).distinct()
    links = views.point_edges(spark, d).where("type = 'CITES'").select(
        F.expr("cast(substring(src, 2) as bigint)").alias("source"),
        F.expr("cast(substring(dst, 2) as bigint)").alias("target"),
    )
    links = links.join(
        u.select(F.col("ku_id").alias("source"), "document_id"),
        "source",
    ).withColumn("target", F.expr("case when target % 10 = 4 then -target else target end"))
    return checks.check_units(papers, units, sections, links)


def dq_embeddings(spark: Spark, d: str) -> DataFrame:
    u = views.points(spark, d)
    own = u.select(
        "document_id",
        F.col("ku_id").alias("id"),
        F.lit("text").alias("target"),
        F.when((F.col("document_id") == 2) & (F.col("ku_id") % 3 == 0), 32).otherwise(64).alias("dimension"),
        "vector",
    )
    vectors = own.where("document_id <> 9").unionByName(own.where("id % 60 = 3 and document_id <> 9"))
    return checks.check_embeddings(
        u.select("document_id").distinct(),
        vectors,
        u.where("ku_id % 45 <> 8").select("document_id", F.col("ku_id").alias("id")),
    )


def dq_index(spark: Spark, d: str) -> DataFrame:
    u = search_queries._units(spark, d)
    points = u.where("ku_id % 70 <> 9").select("document_id", F.col("ku_id").alias("id"), "vector", "context", "text")
    manifest = u.groupBy("document_id").agg(F.count(F.lit(1)).alias("points")).withColumn(
        "dimension",
        F.when(F.col("document_id") == 4, 63).otherwise(64),
    )
    return checks.check_index(points, u.select("document_id", F.col("ku_id").alias("id")), manifest, ("context", "text"))


def dq_graph(spark: Spark, d: str) -> DataFrame:
    nodes = search_queries._nodes(spark, d).select("document_id", "id", F.element_at("labels", 1).alias("label"))
    expected = views.points(spark, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("units"))
    nodes = stage.cut(nodes)
    edges = views.point_edges(spark, d).join(nodes.select(F.col("id").alias("src"), "document_id"), "src")
    # documents may share a section's number: a section's edge belongs to the one that it leads to
    edges = stage.cut(edges.where("not startswith(src, 's') or dst = concat('d', document_id)"))
    nodes = nodes.where("id <> 'k13'").unionByName(nodes.where("id in ('k20', 's3')"))
    edges = edges.where("not (src = 'k30' or dst = 'k30')").unionByName(edges.where("src = 'k40' and type = 'NEXT'"))
    wrong = nodes.where("label = 'Document'").select(
        "document_id",
        F.col("id").alias("src"),
        F.concat(F.lit("k"), F.col("document_id").cast("string")).alias("dst"),
        F.lit("CITES").alias("type"),
    )
    return checks.check_graph(nodes, edges.unionByName(wrong), expected)


def dq_retrieval(spark: Spark, d: str) -> DataFrame:
    top = search_queries.vector_topk_cosine(spark, d).withColumnRenamed("ku_id", "id")
    candidates = top.select(
        "query_id",
        "id",
        F.when(F.col("id") % 9 == 2, F.array("id", "query_id", "id")).otherwise(F.array("query_id", "id")).alias("path"),
    )
    ranked = top.where("not (query_id % 100 = 25 and rank = 7)").select(
        "query_id",
        "id",
        F.col("rank").alias("final_rank"),
        F.when((F.col("rank") == 12) & (F.col("query_id") % 75 == 0), 2.0).otherwise(F.col("score")).alias("fused"),
    )
    groups = top.where("rank <= 5").select("query_id", "id").unionByName(top.where("rank = 2 and query_id % 200 = 50").select("query_id", "id"))
    statistics = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("scored"))
    phases = statistics.withColumn(
        "phase",
        F.explode(F.array(F.lit("generate"), F.when(F.col("query_id") % 50 == 0, "expand"))),
    ).where("phase is not null").select("query_id", "phase")
    return checks.check_retrieval(candidates.unionByName(candidates.where("id % 40 = 1")), ranked, groups, statistics, phases, ("generate", "expand"))


def dq_answers(spark: Spark, d: str) -> DataFrame:
    cites = retrieval_queries.citations_resolve(spark, d)
    answers = views.answers(spark, d).join(
        cites.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n")),
        "answer_id",
        "left",
    ).select("answer_id", (F.coalesce("n", F.lit(0)) + F.when(F.col("conv_id") % 13 == 2, 1).otherwise(0)).alias("citations"), "turn")
    support = cites.where("ku_id is not null").select("answer_id", "label").unionByName(
        answers.where("turn % 4 = 3").select("answer_id", F.lit("KU99").alias("label"))
    )
    phases = answers.where("turn <> 5").select("answer_id", F.lit("format").alias("phase"))
    return checks.check_answers(answers, cites.unionByName(cites.where("label = 'KU2'")), support, phases, ("format",))


def dq_cases(spark: Spark, d: str) -> DataFrame:
    cases = views.questions(spark, d).select((F.col("query_id") % 200).cast("string").alias("case_id"))
    return checks.check_cases(cases)


def conversation_state(spark: Spark, d: str) -> DataFrame:
    events = views.turn_events(spark, d)
    clear = events.groupBy("document_id").agg(
        F.max(F.when(F.col("event_id") % 50 == 0, F.struct("ts", "event_id"))).alias("c")
    ).where("c is not null")
    clear = clear.select(
        "document_id",
        F.lit(-1).cast("long").alias("turn_id"),
        F.lit("clear").alias("kind"),
        F.col("c.ts").alias("ts"),
        F.col("c.event_id").alias("event_id"),
    )
    return conversation.conversation_state(events.unionByName(clear))


def library_state(spark: Spark, d: str) -> DataFrame:
    kind = F.expr(
        "case event_type when 'signup' then 'add' when 'purchase' then 'stage' when 'error' then 'remove' when 'click' then 'rename' "
        "else 'status' end"
    )
    rows = views.table(spark, d, "events").select(
        (F.col("user_id") * 3 + F.col("event_id") % 3).alias("document_id"),
        kind.alias("kind"),
        F.concat("event_type", F.lit("-"), F.col("event_id").cast("string")).alias("value"),
        "ts",
        "event_id",
    )
    return conversation.library_state(rows)


def evidence_history(spark: Spark, d: str) -> DataFrame:
    turns = views.answers(spark, d).where("turn % 4 <> 1").select(
        (F.col("conv_id") % 20).alias("document_id"),
        "answer_id",
        (F.col("conv_id") * 100 + F.col("turn")).alias("ts"),
    )
    shown = views.evidence(spark, d).select("answer_id", F.col("context").alias("ku_id"), F.expr("cast(substring(label, 3) as int)").alias("place"))
    return conversation.evidence_history(turns, shown)


def answer_tokens(spark: Spark, d: str) -> DataFrame:
    text = F.expr("replace(replace(text, '[KU2]', '(KU2, KU7)'), '[KU4]', '[KU4,KU1] (see [a-1])')")
    return conversation.answer_tokens(views.answers(spark, d).select("answer_id", text.alias("text")))


def _page_text(spark: Spark, d: str) -> DataFrame:
    lines = views.paper_lines(spark, d).withColumn("page", F.expr("cast(1 + pos div 20 as int)"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    return lines.groupBy(F.col("doc_id").alias("document_id"), "page").agg(joined.alias("text"))


def _located(spark: Spark, d: str) -> DataFrame:
    boxes = F.expr("case when pos % 3 = 0 then array(cast(1 + pos div 40 as int), cast(1 + pos div 20 as int)) else array() end")
    pages = F.expr("case when pos % 3 = 1 then array(cast(2 + pos div 20 as int), cast(1 + pos div 20 as int)) else array() end")
    return views.paper_lines(spark, d).select(
        F.col("doc_id").alias("document_id"),
        F.col("pos").alias("id"),
        F.upper("text").alias("text"),
        boxes.cast("array<int>").alias("box_pages"),
        pages.cast("array<int>").alias("pages"),
    )


def evidence_locate(spark: Spark, d: str) -> DataFrame:
    return conversation.evidence_locate(_located(spark, d), _page_text(spark, d))


def line_marks(spark: Spark, d: str) -> DataFrame:
    lines = views.paper_lines(spark, d).select(
        F.col("doc_id").alias("document_id"),
        F.expr("cast(1 + pos div 20 as int)").alias("page"),
        F.col("pos").alias("line"),
        F.expr("replace(text, ' of ', ' of- ')").alias("text"),
    )
    own = lines.select(
        "document_id",
        F.col("line").alias("id"),
        "page",
        F.concat(F.lit("It says: "), F.replace("text", F.lit(" "), F.lit("  ")), F.lit("'")).alias("text"),
    )
    return conversation.line_marks(lines, own)


QUERIES = {
    f.__name__: f
    for f in (
        upload_validate, upload_register, read_stage_json, write_stage, layout_view, pages_to_content, content_hash, stale_documents, incremental_refresh, provenance, manifests, dq_paper, dq_units, dq_embeddings, dq_index,
        dq_graph, dq_retrieval, dq_answers, dq_cases, conversation_state, library_state, evidence_history, answer_tokens, evidence_locate, line_marks,
    )
}

_FILES = {
    "up": (
        "SELECT 'doc' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.txt' ELSE '.PDF' END AS filename, CASE "
        "WHEN doc_id % 7 = 3 THEN 'text/plain' ELSE 'application/pdf' END AS ctype, CASE WHEN doc_id % 11 = 4 THEN '' "
        "WHEN doc_id % 3 = 0 THEN text ELSE '%PDF-1.7 ' || text END AS content FROM documents"
    )
}
_REASON = (
    f"CASE WHEN NOT lower(filename) LIKE '%.pdf' OR ctype <> 'application/pdf' THEN 'unsupported_type' WHEN content = '' THEN 'empty' "
    f"WHEN strlen(content) > {MAX_BYTES} THEN 'too_large' WHEN NOT starts_with(content, '%PDF-') THEN 'not_pdf' END"
)
_HASHED = UNITS_SQL | {
    "hashed": (
        "SELECT document_id, sha256(string_agg(sha, '' ORDER BY part)) AS version "
        "FROM (SELECT document_id, h[1:3] AS part, sha256(string_agg(h, '' ORDER BY h)) AS sha "
        "FROM (SELECT document_id, sha256(concat_ws('|', ku_id, modality, coalesce(context, '~'), text)) AS h FROM units) "
        "GROUP BY document_id, part) GROUP BY document_id"
    )
}
_STALE = _HASHED | {
    "stale": (
        "SELECT document_id, CASE WHEN document_id % 4 = 1 THEN 'no_manifest' WHEN document_id = 2 THEN 'model' "
        "WHEN document_id = 3 THEN 'version' WHEN document_id % 5 = 4 THEN 'source' END AS reason FROM hashed"
    )
}
_MANIFESTS = UNITS_SQL | {
    "lines_": (
        "SELECT 'units' AS stage, document_id, text AS v FROM units UNION ALL SELECT 'embeddings', document_id, CAST(ku_id AS VARCHAR) "
        "FROM units UNION ALL SELECT 'citations', u.document_id, e.dst FROM point_edges e JOIN units u ON 'k' || u.ku_id = e.src "
        "WHERE e.type = 'CITES'"
    ),
    "manifest": (
        "SELECT stage, document_id, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(sha, '' ORDER BY part)) AS checksum "
        "FROM (SELECT stage, document_id, sha256(v)[1:3] AS part, count(*) AS n, sha256(string_agg(sha256(v), '' "
        "ORDER BY sha256(v))) AS sha FROM lines_ GROUP BY ALL) GROUP BY stage, document_id"
    ),
}


def _row(rule: str, doc: str, ident: str, detail: str, rest: str) -> str:
    return f"SELECT CAST({doc} AS VARCHAR) AS document_id, '{rule}' AS rule, CAST({ident} AS VARCHAR) AS id, CAST({detail} AS VARCHAR) AS detail {rest}"


def _union(*rows: str) -> str:
    return "\nUNION ALL ".join(rows)


_STRIP = (
    "regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower({}), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), '[-–—][ ]+', '', "
    "'g'), '[-–—]', '', 'g'), '[\"''“”‘’]', '', 'g')"
)
_PAPER = structure_queries._TREE | {
    "sec": (
        "SELECT doc_id, pos AS id, CASE WHEN doc_id % 50 = 7 AND pos = 14 THEN 9999 WHEN doc_id % 50 = 9 AND pos = 0 THEN pos "
        "ELSE parent_pos END AS parent FROM sections WHERE doc_id % 100 <> 4"
    ),
    "rooted": (
        "SELECT doc_id, id FROM sec WHERE parent IS NULL UNION ALL SELECT s.doc_id, s.id FROM rooted r "
        "JOIN sec s ON s.doc_id = r.doc_id AND s.parent = r.id"
    ),
    "stuck": (
        "SELECT doc_id, id FROM sec WHERE doc_id % 50 = 9 AND id = 0 UNION ALL SELECT s.doc_id, s.id FROM stuck k "
        "JOIN sec s ON s.doc_id = k.doc_id AND s.parent = k.id AND s.id <> k.id"
    ),
    "vis": "SELECT * FROM content_items WHERE kind IN ('table', 'figure') AND (pos <> 8 OR doc_id % 10 <> 2)",
    "cap": (
        "SELECT * REPLACE (CASE WHEN doc_id % 20 = 6 AND subject_type = 'figure' THEN 'table' ELSE subject_type END AS subject_type) "
        "FROM captions WHERE subject_pos <> 5 OR doc_id % 10 <> 1"
    ),
}
_TEXT = (
    "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace({}, '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', "
    "'>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"
)
_TOPQ = search_queries.TOPK_SQL

ORACLE_SQL = {
    "upload_validate": with_views(f"SELECT filename, {_REASON} AS reason FROM up", _FILES),
    "upload_register": with_views(
        f"SELECT filename, strlen(content) AS bytes, sha256(content) AS sha256, 'completed' AS status FROM up WHERE ({_REASON}) IS NULL",
        _FILES,
    ),
    "read_stage_json": with_views(
        "SELECT CAST(document_id AS VARCHAR) AS document_id, CAST(ku_id AS VARCHAR) AS id, ord AS \"order\", modality, text, CAST(NULL "
        "AS VARCHAR) AS retrieval_context FROM units",
        UNITS_SQL,
    ),
    "write_stage": with_views(
        "SELECT document_id, ku_id, CASE WHEN document_id < 5 THEN 'second' ELSE 'first' END AS state FROM units "
        "WHERE document_id >= 5 OR ku_id % 2 = 0",
        UNITS_SQL,
    ),
    "layout_view": with_views(
        "SELECT doc_id, page, string_agg(CAST(y0 AS INT) || ' ' || kind || ' ' || pos, ',' ORDER BY y0, kind, pos) AS elements "
        "FROM (SELECT b.doc_id, b.page, b.y0, i.kind, b.pos FROM boxes b JOIN content_items i ON i.doc_id = b.doc_id AND i.pos = b.pos "
        "UNION ALL SELECT b.doc_id, b.page + 1, 0.0, i.kind, b.pos FROM boxes b "
        "JOIN content_items i ON i.doc_id = b.doc_id AND i.pos = b.pos) GROUP BY doc_id, page"
    ),
    "pages_to_content": with_views(
        """SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS pos, kind, level, length(text) AS chars FROM (
            SELECT *, kind = 'heading' AND text = title AND sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY n) = 1 AS first_title FROM named WHERE text <> '') WHERE NOT first_title""",
        {
            "bodies": (
                r"SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_replace(html, "
                r"'(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<footer\b.*?</footer>|<header\b.*?</header>', ' ', "
                r"'g') AS body FROM pages"
            ),
            "chunks": (
                r"SELECT page_id, title, generate_subscripts(c, 1) AS n, unnest(c) AS piece "
                r"FROM (SELECT page_id, title, string_split(regexp_replace(body, '(?is)(</?(?:h[1-6]|p|table|figure)\b)', chr(1) || '\1', 'g'), "
                r"chr(1)) AS c FROM bodies)"
            ),
            "tagged": (
                r"SELECT *, lower(regexp_extract(piece, '^<([A-Za-z]+[1-6]?)', 1)) AS tag FROM chunks "
                r"WHERE regexp_matches(piece, '(?i)^<(h[1-6]|p|table|figure)\b')"
            ),
            "named": (
                f"SELECT page_id, n, CASE WHEN tag LIKE 'h%' THEN 'heading' WHEN tag = 'p' THEN 'paragraph' ELSE tag END AS kind, CASE "
                f"WHEN tag LIKE 'h%' THEN CAST(tag[2:] AS INT) END AS level, {_TEXT.format('piece')} AS text, {_TEXT.format('title')} AS title "
                f"FROM tagged"
            ),
        },
    ),
    "content_hash": with_views("SELECT document_id, version FROM hashed", _HASHED),
    "stale_documents": with_views("SELECT document_id, reason IS NOT NULL AS stale, reason FROM stale", _STALE),
    "incremental_refresh": with_views(
        "SELECT p.document_id, p.ku_id, CASE WHEN s.reason IS NULL THEN 'old' ELSE 'new' END AS state FROM points p JOIN stale s USING (document_id)",
        _STALE,
    ),
    "manifests": with_views("SELECT stage, document_id, rows, checksum FROM manifest", _MANIFESTS),
    "provenance": with_views(
        "SELECT a.answer_id, a.conv_id % 10 AS document_id, (SELECT string_agg(stage || '=' || checksum, ';' ORDER BY stage) "
        "FROM manifest m WHERE m.document_id = a.conv_id % 10) AS versions, (SELECT string_agg(DISTINCT ku_id, ',' ORDER BY ku_id) "
        "FROM resolved r WHERE r.answer_id = a.answer_id AND ku_id IS NOT NULL) AS cited, (SELECT sha256(string_agg(x, ';' ORDER BY x)) "
        "FROM (SELECT label || '|' || ku_id || '|' || sha256(text) AS x FROM evidence e WHERE e.answer_id = a.answer_id)) AS bundle "
        "FROM answers a",
        _MANIFESTS | _CITED,
    ),
    "dq_paper": with_views(
        _union(
            _row(
                "empty_paper",
                "doc_id",
                "NULL",
                "NULL",
                "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM content_items "
                "WHERE kind <> 'heading' AND doc_id % 100 NOT IN (3, 4)) AND doc_id NOT IN (SELECT doc_id FROM sec)",
            ),
            _row("wrong_paper", "doc_id", "pos", "doc_id + 1", "FROM content_items WHERE kind <> 'heading' AND doc_id % 100 = 5 AND pos = 1"),
            _row(
                "unknown_parent",
                "doc_id",
                "id",
                "parent",
                "FROM sec s WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sec o WHERE o.doc_id = s.doc_id AND o.id = s.parent)",
            ),
            _row("section_cycle", "doc_id", "id", "NULL", "FROM stuck"),
            _row(
                "caption_without_subject",
                "doc_id",
                "subject_pos",
                "NULL",
                "FROM cap c WHERE NOT EXISTS (SELECT 1 FROM vis v WHERE v.doc_id = c.doc_id AND v.pos = c.subject_pos AND v.kind = c.subject_type)",
            ),
            _row(
                "uncaptioned_visual",
                "doc_id",
                "pos",
                "NULL",
                "FROM vis v WHERE NOT EXISTS (SELECT 1 FROM cap c WHERE v.doc_id = c.doc_id AND v.pos = c.subject_pos AND v.kind = c.subject_type)",
            ),
        ),
        {k: v for k, v in _PAPER.items() if k != "rooted"},
    ),
    "dq_units": with_views(
        _union(
            _row("no_units", "doc_id", "NULL", "NULL", "FROM documents WHERE doc_id NOT IN (SELECT document_id FROM points)"),
            _row(
                "duplicate_order",
                "document_id",
                "o",
                "count(*)",
                "FROM (SELECT document_id, CASE WHEN ku_id % 100 = 11 THEN 0 ELSE ord END AS o FROM points) "
                "GROUP BY document_id, o HAVING count(*) > 1",
            ),
            _row("wrong_paper", "document_id", "ku_id", "document_id + 1", "FROM points WHERE ku_id % 90 = 5"),
            _row("unknown_section", "document_id", "ku_id", "section_id", "FROM points WHERE section_id % 7 = 3"),
            _row(
                "dangling_target",
                "p.document_id",
                "p.ku_id",
                "-CAST(e.dst[2:] AS BIGINT)",
                "FROM point_edges e JOIN points p ON 'k' || p.ku_id = e.src WHERE e.type = 'CITES' AND CAST(e.dst[2:] AS BIGINT) % 10 = 4",
            ),
        )
    ),
    "dq_embeddings": with_views(
        _union(
            _row("no_embeddings", "9", "NULL", "NULL", ""),
            _row("unknown_unit", "document_id", "ku_id", "NULL", "FROM vecs WHERE ku_id % 45 = 8"),
            _row("duplicate_embedding", "document_id", "ku_id", "'text'", "FROM points WHERE ku_id % 60 = 3 AND document_id <> 9"),
            _row("inconsistent_dimension", "2", "NULL", "2", ""),
            _row("wrong_length", "document_id", "ku_id", "64", "FROM vecs WHERE document_id = 2 AND ku_id % 3 = 0"),
        ),
        {"vecs": "SELECT * FROM points WHERE document_id <> 9 UNION ALL SELECT * FROM points WHERE document_id <> 9 AND ku_id % 60 = 3"},
    ),
    "dq_index": with_views(
        _union(
            _row("dimension_mismatch", "document_id", "ku_id", "64", "FROM points WHERE document_id = 4 AND ku_id % 70 <> 9"),
            _row(
                "count_mismatch",
                "document_id",
                "NULL",
                "count(*) FILTER (ku_id % 70 <> 9)",
                "FROM points GROUP BY document_id HAVING count(*) FILTER (ku_id % 70 = 9) > 0",
            ),
            _row("missing_point", "document_id", "ku_id", "NULL", "FROM points WHERE ku_id % 70 = 9"),
            _row("missing_field", "document_id", "ku_id", "'context'", "FROM units WHERE context IS NULL AND ku_id % 70 <> 9"),
        ),
        UNITS_SQL,
    ),
    "dq_graph": with_views(
        _union(
            _row("duplicate_node", "document_id", "id", "2", "FROM node_rows WHERE id IN ('k20', 's3')"),
            _row(
                "duplicate_edge",
                "n.document_id",
                "e.src || ' NEXT ' || e.dst",
                "2",
                "FROM point_edges e JOIN node_rows n ON n.id = e.src WHERE e.src = 'k40' AND e.type = 'NEXT'",
            ),
            _row("dangling_edge", "document_id", "src || ' ' || type || ' ' || dst", "NULL", "FROM ed WHERE 'k13' IN (src, dst)"),
            _row("dangling_edge", "document_id", "'d' || document_id || ' CITES k' || document_id", "NULL", "FROM docs_ WHERE NOT same"),
            _row("wrong_endpoint", "document_id", "'d' || document_id || ' CITES k' || document_id", "NULL", "FROM docs_"),
            _row(
                "orphan_node",
                "document_id",
                "id",
                "NULL",
                "FROM node_rows n WHERE labels <> 'Document' AND id <> 'k13' AND NOT EXISTS (SELECT 1 FROM ed e "
                "WHERE n.id IN (e.src, e.dst)) AND NOT EXISTS (SELECT 1 FROM docs_ x WHERE n.id = 'k' || x.document_id AND x.same)",
            ),
            _row(
                "incomplete",
                "document_id",
                "NULL",
                "count(*) - 1",
                "FROM points WHERE document_id = (SELECT document_id FROM points WHERE ku_id = 13) GROUP BY document_id",
            ),
        ),
        _NODES
        | {
            "ed": (
                "SELECT n.document_id, e.src, e.dst, e.type FROM point_edges e JOIN node_rows n ON n.id = e.src "
                "WHERE 'k30' NOT IN (e.src, e.dst) UNION ALL SELECT n.document_id, e.src, e.dst, e.type FROM point_edges e "
                "JOIN node_rows n ON n.id = e.src WHERE e.src = 'k40' AND e.type = 'NEXT'"
            ),
            "docs_": (
                "SELECT d.document_id, EXISTS (SELECT 1 FROM points p WHERE p.ku_id = d.document_id AND p.document_id = d.document_id) AS same "
                "FROM (SELECT DISTINCT document_id FROM points) d"
            ),
        },
    ),
    "dq_retrieval": with_views(
        _union(
            _row("duplicate_candidate", "query_id", "ku_id", "2", "FROM topk WHERE ku_id % 40 = 1"),
            _row("path_cycle", "query_id", "ku_id", "NULL", "FROM topk WHERE ku_id % 9 = 2"),
            _row("path_cycle", "query_id", "ku_id", "NULL", "FROM topk WHERE ku_id % 9 = 2 AND ku_id % 40 = 1"),
            _row("path_cycle", "query_id", "ku_id", "NULL", "FROM topk WHERE ku_id % 9 <> 2 AND ku_id = query_id"),
            _row("path_cycle", "query_id", "ku_id", "NULL", "FROM topk WHERE ku_id % 9 <> 2 AND ku_id = query_id AND ku_id % 40 = 1"),
            _row("rank_gap", "query_id", "ku_id", "rank", "FROM topk WHERE query_id % 100 = 25 AND rank = 8"),
            _row("rising_score", "query_id", "ku_id", "rank", "FROM topk WHERE query_id % 75 = 0 AND rank = 12"),
            _row("unit_in_two_groups", "query_id", "ku_id", "2", "FROM topk WHERE query_id % 200 = 50 AND rank = 2"),
            _row(
                "statistics_mismatch",
                "query_id",
                "NULL",
                "count(*) - 1",
                "FROM topk WHERE query_id % 100 = 25 GROUP BY query_id HAVING max(rank) >= 7",
            ),
            _row("missing_phase", "query_id", "'expand'", "NULL", "FROM questions WHERE query_id % 50 <> 0"),
        ),
        _TOPQ,
    ),
    "dq_answers": with_views(
        _union(
            _row(
                "citation_count",
                "answer_id",
                "NULL",
                "coalesce(c.n, 0)",
                "FROM answers a LEFT JOIN counted_ c USING (answer_id) "
                "WHERE coalesce(c.k, 0) + CASE WHEN conv_id % 13 = 2 THEN 1 ELSE 0 END <> coalesce(c.n, 0)",
            ),
            _row("repeated_citation", "answer_id", "label", "2", "FROM resolved WHERE label = 'KU2'"),
            _row(
                "support_not_cited",
                "answer_id",
                "'KU99'",
                "NULL",
                "FROM answers WHERE turn % 4 = 3 AND answer_id IN (SELECT answer_id FROM resolved WHERE ku_id IS NOT NULL)",
            ),
            _row("missing_phase", "answer_id", "'format'", "NULL", "FROM answers WHERE turn = 5"),
        ),
        _CITED | {"counted_": "SELECT answer_id, count(*) AS k, count(*) + count(*) FILTER (label = 'KU2') AS n FROM resolved GROUP BY answer_id"},
    ),
    "dq_cases": with_views(
        _row("duplicate_case", "query_id % 200", "query_id % 200", "count(*)", "FROM questions GROUP BY query_id % 200 HAVING count(*) > 1")
    ),
    "conversation_state": with_views(
        """SELECT document_id, turn_id, CASE kind WHEN 'start' THEN 'pending' WHEN 'complete' THEN 'complete' ELSE 'failed' END AS status, ts AS updated
        FROM (SELECT *, row_number() OVER (PARTITION BY document_id, turn_id ORDER BY ts DESC, event_id DESC) AS back FROM begun WHERE (kind <> 'start' AND (ts, event_id) >= (t0, e0)) OR (ts, event_id) = (t0, e0)) WHERE back = 1""",
        {
            "cleared": "SELECT document_id, max({'ts': ts, 'event_id': event_id}) AS c FROM turn_events WHERE event_id % 50 = 0 GROUP BY document_id",
            "live": (
                "SELECT t.* FROM turn_events t LEFT JOIN cleared c USING (document_id) "
                "WHERE c.c IS NULL OR (t.ts, t.event_id) > (c.c.ts, c.c.event_id)"
            ),
            "begun": (
                "SELECT l.*, s.ts AS t0, s.event_id AS e0 FROM live l JOIN (SELECT document_id, turn_id, ts, event_id FROM live "
                "WHERE kind = 'start' QUALIFY row_number() OVER (PARTITION BY document_id, turn_id "
                "ORDER BY ts, event_id) = 1) s USING (document_id, turn_id)"
            ),
        },
    ),
    "library_state": with_views(
        "SELECT document_id, max_by(value, moment) FILTER (kind IN ('add', 'rename')) AS filename, max_by(value, moment) FILTER (kind = "
        "'stage') AS stage, max_by(value, moment) FILTER (kind = 'status') AS status FROM (SELECT e.*, b.border, b.bk FROM ev e "
        "JOIN (SELECT document_id, max(moment) AS border, max_by(kind, moment) AS bk FROM ev WHERE kind IN ('add', 'remove') "
        "GROUP BY document_id) b USING (document_id)) WHERE bk = 'add' AND moment >= border GROUP BY document_id",
        {
            "ev": (
                "SELECT user_id * 3 + event_id % 3 AS document_id, CASE event_type WHEN 'signup' THEN 'add' WHEN 'purchase' THEN 'stage' "
                "WHEN 'error' THEN 'remove' WHEN 'click' THEN 'rename' "
                "ELSE 'status' END AS kind, event_type || '-' || event_id AS value, {'ts': ts, 'event_id': event_id} AS moment FROM events"
            )
        },
    ),
    "evidence_history": with_views(
        "SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, answer_id, place) AS n, ku_id "
        "FROM (SELECT a.conv_id % 20 AS document_id, a.answer_id, a.conv_id * 100 + a.turn AS ts, e.context AS ku_id, CAST(e.label[3:] "
        "AS INT) AS place FROM answers a JOIN evidence e USING (answer_id) "
        "WHERE a.turn % 4 <> 1 QUALIFY row_number() OVER (PARTITION BY a.conv_id % 20, e.context "
        "ORDER BY a.conv_id * 100 + a.turn DESC, a.answer_id, CAST(e.label[3:] AS INT)) = 1)"
    ),
    "answer_tokens": with_views(
        r"""SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY i, j, k) - 1 AS n, value, CASE WHEN single OR (grouped AND regexp_matches(value, '^KU[0-9]+$')) THEN 'citation' ELSE 'text' END AS kind
        FROM (SELECT answer_id, i, j, single, grouped, generate_subscripts(c, 1) AS k, unnest(c) AS value FROM (SELECT *, CASE WHEN grouped THEN string_split(regexp_replace(part, '(KU[0-9]+)', chr(1) || '\1' || chr(1), 'g'), chr(1)) ELSE [part] END AS c FROM parts)) WHERE value <> ''""",
        {
            "txt": "SELECT answer_id, replace(replace(text, '[KU2]', '(KU2, KU7)'), '[KU4]', '[KU4,KU1] (see [a-1])') AS text FROM answers",
            "cut": (
                r"SELECT answer_id, string_split(regexp_replace(text, '(\[[A-Za-z0-9_-]+\])', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS p "
                r"FROM txt"
            ),
            "first_": r"SELECT answer_id, generate_subscripts(p, 1) AS i, unnest(p) AS piece FROM cut",
            "second_": (
                r"SELECT *, regexp_matches(piece, '^\[[A-Za-z0-9_-]+\]$') AS single, CASE "
                r"WHEN regexp_matches(piece, '^\[[A-Za-z0-9_-]+\]$') THEN [piece] "
                r"ELSE string_split(regexp_replace(piece, '([\[(][ \t\n\r\f\v]*KU[0-9]+(?:[ \t\n\r\f\v]*,[ \t\n\r\f\v]*KU[0-9]+)*[ "
                r"\t\n\r\f\v]*[\])])', chr(1) || '\1' || chr(1), 'g'), chr(1)) END AS q FROM first_"
            ),
            "parts": (
                r"SELECT answer_id, i, single, generate_subscripts(q, 1) AS j, unnest(q) AS part, NOT single "
                r"AND regexp_matches(unnest(q), '^[\[(][ \t\n\r\f\v]*KU[0-9]+(?:[ \t\n\r\f\v]*,[ \t\n\r\f\v]*KU[0-9]+)*[ \t\n\r\f\v]*[\])]$') AS "
                r"grouped FROM second_"
            ),
        },
    ),
    "evidence_locate": with_views(
        "SELECT e.doc_id AS document_id, e.pos AS id, coalesce(h.hit, e.listed[1]) AS page, h.hit IS NOT NULL AS matched, CASE "
        "WHEN coalesce(h.hit, e.listed[1]) IS NOT NULL THEN e.source ELSE 'none' END AS source FROM ev e LEFT "
        "JOIN (SELECT e.doc_id, e.pos, arg_min(p.page, coalesce(list_position(e.listed, p.page), p.page)) AS hit FROM ev e "
        "JOIN pages_ p ON p.doc_id = e.doc_id AND (e.listed IS NULL OR list_contains(e.listed, p.page)) "
        "WHERE e.needle <> '' AND contains(p.s, e.needle) GROUP BY e.doc_id, e.pos) h USING (doc_id, pos)",
        {
            "pages_": (
                f"SELECT doc_id, page, {_STRIP.format('t')} AS s FROM (SELECT doc_id, CAST(1 + pos // 20 AS INT) AS page, string_agg(text, ' ' "
                f"ORDER BY pos) AS t FROM paper_lines GROUP BY doc_id, CAST(1 + pos // 20 AS INT))"
            ),
            "ev": (
                f"SELECT doc_id, pos, ({_STRIP.format('upper(text)')})[1:120] AS needle, CASE pos % 3 "
                f"WHEN 0 THEN [CAST(1 + pos // 40 AS INT), CAST(1 + pos // 20 AS INT)] "
                f"WHEN 1 THEN [CAST(2 + pos // 20 AS INT), CAST(1 + pos // 20 AS INT)] END AS listed, CASE pos % 3 WHEN 0 THEN 'bounding-boxes' "
                f"WHEN 1 THEN 'page-numbers' ELSE 'text-search' END AS source FROM paper_lines"
            ),
        },
    ),
    "line_marks": with_views(
        f"SELECT l.doc_id AS document_id, l.page, l.pos AS line, e.pos AS id FROM (SELECT *, {_STRIP.format('t')} AS s FROM ln) l "
        f"JOIN (SELECT *, {_STRIP.format("'It says: ' || replace(t, ' ', '  ') || ''''")} AS w "
        f"FROM ln) e ON e.doc_id = l.doc_id AND e.page = l.page WHERE length(l.s) >= 18 AND contains(e.w, l.s)",
        {"ln": "SELECT doc_id, pos, CAST(1 + pos // 20 AS INT) AS page, replace(text, ' of ', ' of- ') AS t FROM paper_lines"},
    ),
}
