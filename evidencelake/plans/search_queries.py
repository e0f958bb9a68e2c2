"""Queries of embedding, index, vector search and graph, with their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, search, vector_index
from ..sources import views
from ..sources.stage import scratch
from ..sources.views import with_views

Spark = SparkSession
MODEL, VERSION, PREFIX = "lab/text-model v2", "0a1b2c3d4e5f", "ev"


def _units(spark: Spark, d: str) -> DataFrame:
    """Points as units: with modality, context, asset and pages."""
    modality = F.expr("case ku_id % 6 when 0 then 'table' when 1 then 'figure' else 'text' end")
    p = views.points(spark, d)
    return p.select(
        "ku_id",
        "document_id",
        F.expr("case when ku_id % 11 <> 5 then section_id end").alias("section_id"),
        "ord",
        modality.alias("modality"),
        F.expr("case when ku_id % 7 <> 0 then concat('Section: ', section_id) end").alias("context"),
        F.expr("case when ku_id % 6 = 1 then concat('asset-', ku_id) end").alias("asset"),
        F.expr("array(1 + ku_id % 5, 1 + ku_id % 3, 1 + ku_id % 5)").alias("pages"),
        "text",
        "vector",
    )


def embed_plan(spark: Spark, d: str) -> DataFrame:
    return search.embed_plan(_units(spark, d))


def embed_input(spark: Spark, d: str) -> DataFrame:
    text = search.embed_input(F.col("context"), F.col("text"))
    return _units(spark, d).select("ku_id", F.char_length(text).alias("chars"), F.sha2(text.cast("binary"), 256).alias("checksum"))


def embed_batch(spark: Spark, d: str) -> DataFrame:
    rows = _units(spark, d).select("ku_id", search.embed_input(F.col("context"), F.col("text")).alias("text"))
    out = search.embed_batch(rows, "text")
    return out.select("ku_id", F.size("vector").alias("dimension"), F.round(search.dot(F.col("vector"), F.col("vector")), 6).alias("length"), "error")


def truncation_flag(spark: Spark, d: str) -> DataFrame:
    return search.truncation_flag(_units(spark, d), "text", 400).select("ku_id", "words", "truncated")


def embed_manifest(spark: Spark, d: str) -> DataFrame:
    status = F.expr("case when target = 'image' then 'skipped' when ku_id % 17 = 3 then 'failed' else 'ok' end")
    tasks = search.embed_plan(_units(spark, d)).select(
        "document_id",
        "target",
        status.alias("status"),
        F.lit(MODEL).alias("model"),
        F.lit(64).alias("dimension"),
    )
    return search.embed_manifest(tasks)


def _vectors(spark: Spark, d: str) -> DataFrame:
    return _units(spark, d).select(
        "ku_id",
        "vector",
        F.lit(MODEL).alias("model"),
        F.when(F.col("document_id") < 5, VERSION).otherwise("ffff").alias("version"),
        F.when(F.col("asset").isNull(), "text").otherwise("image").alias("target"),
    )


def index_plan(spark: Spark, d: str) -> DataFrame:
    return search.index_plan(_vectors(spark, d), PREFIX)


def index_points(spark: Spark, d: str) -> DataFrame:
    units = _units(spark, d)
    citations = views.point_edges(spark, d).where("type = 'CITES'").groupBy(
        F.expr("cast(substring(dst, 2) as bigint)").alias("ku_id")
    ).agg(F.count(F.lit(1)).alias("citations"))
    manifest = units.select("document_id").distinct().withColumn("model", F.lit(MODEL))
    out = search.index_points(
        _vectors(spark, d).select("ku_id"),
        units.select("ku_id", "document_id", "section_id", "modality", "pages"),
        citations,
        manifest,
    )
    return out.select(
        "ku_id",
        "document_id",
        "section_id",
        "modality",
        "citations",
        "model",
        F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"),
    )


def index_upsert(spark: Spark, d: str) -> DataFrame:
    old = _units(spark, d).where("ku_id % 5 <> 4").select("ku_id", "document_id", F.lit("old").alias("state"), F.lit(1).alias("version"))
    new = _units(spark, d).where("ku_id % 3 = 0").select("ku_id", "document_id", F.lit("new").alias("state"), F.lit(2).alias("version"))
    return search.upsert(old, new, "ku_id", "version")


def index_count(spark: Spark, d: str) -> DataFrame:
    return _units(spark, d).where((F.col("document_id") == 3) & (F.col("modality") == "text")).agg(F.count(F.lit(1)).alias("points"))


def point_lookup(spark: Spark, d: str) -> DataFrame:
    ids = views.table(spark, d, "documents").select((F.col("doc_id") * 2).alias("ku_id"))
    return search.lookup(_units(spark, d), ids, "ku_id").select("ku_id", "document_id", "modality")


def vector_topk_cosine(spark: Spark, d: str) -> DataFrame:
    return search.topk_scoped(views.questions(spark, d), views.points(spark, d))


def vector_topk_dot(spark: Spark, d: str) -> DataFrame:
    return search.topk_all(views.questions(spark, d), views.points(spark, d), metric="dot")


def vector_topk_euclid(spark: Spark, d: str) -> DataFrame:
    return search.topk_all(views.questions(spark, d), views.points(spark, d), metric="euclid")


def vector_topk_ann(spark: Spark, d: str) -> DataFrame:
    """Against an index that is fitted and stored once, then read."""
    points, path = views.points(spark, d), scratch(spark, "index")
    vector_index.build(points, path)
    return vector_index.topk(views.questions(spark, d), points, path)


def query_normalize(spark: Spark, d: str) -> DataFrame:
    text = F.expr(
        "case query_id % 4 when 0 then concat('Who  wrote ', text) when 1 then concat(text, ' Keywords?') when 2 then concat('Which "
        "approach \n', text) else concat('  ', text, ' by the authors ') end"
    )
    q = views.points(spark, d).select(F.col("ku_id").alias("query_id"), F.array_join(F.slice(F.split("text", " ", -1), 1, 12), " ").alias("text"))
    return q.select("query_id", search.normalize_query(text).alias("normalized"))


def graph_nodes(spark: Spark, d: str) -> DataFrame:
    return graph.nodes(_units(spark, d)).select("id", "document_id", F.array_join("labels", ",").alias("labels"))


def graph_containment(spark: Spark, d: str) -> DataFrame:
    return graph.containment(views.points(spark, d))


def graph_next(spark: Spark, d: str) -> DataFrame:
    return graph.sequence(views.points(spark, d))


def _relationships(spark: Spark, d: str) -> DataFrame:
    e = views.point_edges(spark, d).where("type in ('CITES', 'REFERENCES')")
    return e.select(
        F.expr("cast(substring(src, 2) as bigint)").alias("source"),
        F.expr("cast(substring(dst, 2) as bigint)").alias("target"),
        F.lower("type").alias("type"),
    )


def graph_project(spark: Spark, d: str) -> DataFrame:
    return graph.project(views.points(spark, d), _relationships(spark, d))


def _nodes(spark: Spark, d: str) -> DataFrame:
    return graph.nodes(_units(spark, d).drop("section_id").join(views.points(spark, d).select("ku_id", "section_id"), "ku_id"))


def graph_summary(spark: Spark, d: str) -> DataFrame:
    return graph.summary(_nodes(spark, d), views.point_edges(spark, d))


def graph_replace(spark: Spark, d: str) -> DataFrame:
    old = _nodes(spark, d).select("id", "document_id", F.lit("old").alias("state"))
    fresh = _nodes(spark, d).where("document_id < 2 and id like 'k%'").select("id", "document_id", F.lit("new").alias("state"))
    return graph.replace(old, fresh.unionByName(fresh), ("id",))


def graph_neighbors(spark: Spark, d: str) -> DataFrame:
    wanted = views.points(spark, d).select(graph.key("k", "ku_id").alias("id"))
    out = graph.neighbors(views.point_edges(spark, d), _nodes(spark, d), wanted, ["CITES", "REFERENCES"], "in")
    return out.select("node", "neighbor", "type", F.array_join("labels", ",").alias("labels"))


def adjacency_ranked(spark: Spark, d: str) -> DataFrame:
    return graph.adjacency(views.point_edges(spark, d)).select("node", "neighbor", "type", "direction", "place", "degree")


def near(spark: Spark, d: str) -> Callable[[DataFrame], DataFrame]:
    """Neighbours of the nodes that it is called with."""
    edges = views.point_edges(spark, d)
    return lambda nodes: graph.adjacency(edges, nodes=nodes)


def seeds(spark: Spark, d: str) -> DataFrame:
    return vector_topk_cosine(spark, d).select("query_id", graph.key("k", "ku_id").alias("id"), "rank")


def expand_budgeted(spark: Spark, d: str) -> DataFrame:
    found, _ = graph.expand(seeds(spark, d), near(spark, d))
    path = F.array_join(F.transform("hops", lambda x: F.concat_ws(" ", x["source"], x["type"], x["direction"], x["target"])), "; ")
    return found.select("query_id", "id", "place", "depth", path.alias("path"))


def expansion_stats(spark: Spark, d: str) -> DataFrame:
    _, cost = graph.expand(seeds(spark, d), near(spark, d))
    return cost


QUERIES = {
    f.__name__: f
    for f in (
        embed_plan, embed_input, embed_batch, truncation_flag, embed_manifest, index_plan, index_points, index_upsert, index_count, point_lookup, vector_topk_cosine, vector_topk_dot, vector_topk_euclid,
        vector_topk_ann, query_normalize, graph_nodes, graph_containment, graph_next, graph_project, graph_summary, graph_replace, graph_neighbors, adjacency_ranked, expand_budgeted, expansion_stats,
    )
}

_WS = r"[ \t\n\r\f\v]"
UNITS_SQL = {
    "units": (
        "SELECT ku_id, document_id, CASE WHEN ku_id % 11 <> 5 THEN section_id END AS section_id, section_id AS full_section, ord, "
        "CASE ku_id % 6 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' ELSE 'text' END AS modality, CASE "
        "WHEN ku_id % 7 <> 0 THEN 'Section: ' || section_id END AS context, CASE "
        "WHEN ku_id % 6 = 1 THEN 'asset-' || ku_id END AS asset, [1 + ku_id % 5, 1 + ku_id % 3, 1 + ku_id % 5] AS pages, text, vector "
        "FROM points"
    )
}
_INPUT = "CASE WHEN context IS NOT NULL THEN context || ': ' || text ELSE text END"
_TASKS = UNITS_SQL | {
    "tasks": "SELECT ku_id, document_id, 'text' AS target FROM units UNION ALL SELECT ku_id, document_id, 'image' FROM units WHERE asset IS NOT NULL"
}
_Q, _P = "CAST(q.vector AS DOUBLE[])", "CAST(p.vector AS DOUBLE[])"
COSINE = f"round(list_inner_product({_Q}, {_P}) / (sqrt(list_inner_product({_Q}, {_Q})) * sqrt(list_inner_product({_P}, {_P}))), 6)"
TOPK_SQL = {
    "topk": (
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ku_id) AS rank "
        f"FROM (SELECT q.query_id, p.ku_id, {COSINE} AS score FROM questions q JOIN points p USING (document_id))) WHERE rank <= 20"
    )
}
_NODES = UNITS_SQL | {
    "node_rows": (
        "SELECT DISTINCT 'd' || document_id AS id, document_id, 'Document' AS labels FROM units "
        "UNION ALL SELECT DISTINCT 's' || full_section, document_id, 'Section' FROM units "
        "UNION ALL SELECT 'k' || ku_id, document_id, 'KnowledgeUnit,' || upper(modality[1]) || modality[2:] FROM units"
    )
}


def _all_pairs(score: str, order: str) -> str:
    return with_views(
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, ku_id) AS rank "
        f"FROM (SELECT q.query_id, p.ku_id, round({score}, 6) AS score FROM questions q, points p)) WHERE rank <= 20"
    )


_POLICY = ", ".join(f"('{t}', '{x}', {k})" for k, (t, x) in enumerate(graph.POLICY))
ADJACENT_SQL = {
    "directed": (
        f"SELECT CASE WHEN r.direction = 'out' THEN src ELSE dst END AS node, CASE WHEN r.direction = 'out' THEN dst "
        f"ELSE src END AS neighbor, e.type, r.direction, r.policy FROM point_edges e "
        f"JOIN (VALUES {_POLICY}) AS r(type, direction, policy) ON r.type = e.type"
    ),
    "adjacent": (
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node "
        "ORDER BY policy, neighbor) AS place, count(*) OVER (PARTITION BY node) AS degree FROM directed) WHERE place <= 10"
    ),
}
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _level(n: int, frontier: str, visited: str, cost: str, found: str) -> dict[str, str]:
    return {
        f"own{n}": f"SELECT f.query_id, f.id, f.place, f.path, coalesce(g.degree, 0) AS degree, {cost} + coalesce(sum(coalesce(g.degree, 0)) OVER (PARTITION BY f.query_id ORDER BY f.place {_BEFORE}), 0) AS cost, {found} AS found0 FROM {frontier} f LEFT JOIN (SELECT DISTINCT node, degree FROM adjacent) g ON g.node = f.id",
        f"open{n}": f"SELECT * FROM own{n} WHERE cost < 500 AND found0 < 50",
        f"rows{n}": f"SELECT o.query_id, o.id, o.place, o.path, o.found0, a.neighbor, a.type, a.direction, a.place AS n FROM open{n} o JOIN adjacent a ON a.node = o.id WHERE NOT EXISTS (SELECT 1 FROM {visited} v WHERE v.query_id = o.query_id AND v.id = a.neighbor) QUALIFY row_number() OVER (PARTITION BY o.query_id, a.neighbor ORDER BY o.place, a.place) = 1",
        f"count{n}": f"SELECT *, found0 + coalesce(sum(CASE WHEN neighbor LIKE 'k%' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY place, n {_BEFORE}), 0) AS upto FROM rows{n}",
        f"taken{n}": f"SELECT query_id, neighbor AS id, row_number() OVER (PARTITION BY query_id ORDER BY place, n) AS place, CASE WHEN path = '' THEN '' ELSE path || '; ' END || id || ' ' || type || ' ' || direction || ' ' || neighbor AS path, type AS last_type, id AS last_source FROM count{n} WHERE upto < 50",
        f"units{n}": f"SELECT query_id, id, place, {n} AS depth, path, last_type, last_source FROM taken{n} WHERE id LIKE 'k%'",
        f"reached{n}": f"SELECT o.query_id, o.degree, o.found0 + coalesce(sum(coalesce(u.c, 0)) OVER (PARTITION BY o.query_id ORDER BY o.place {_BEFORE}), 0) AS found_before FROM open{n} o LEFT JOIN (SELECT query_id, id, count(*) AS c FROM rows{n} WHERE neighbor LIKE 'k%' GROUP BY ALL) u ON u.query_id = o.query_id AND u.id = o.id",
    }


EXPAND_SQL = (
    TOPK_SQL
    | ADJACENT_SQL
    | {"front1": "SELECT query_id, 'k' || ku_id AS id, rank AS place, '' AS path FROM topk"}
    | _level(1, "front1", "front1", "0", "0")
    | {
        "state1": (
            "SELECT q.query_id, coalesce((SELECT sum(degree) FROM reached1 r "
            "WHERE r.query_id = q.query_id AND r.found_before < 50), 0) AS cost, (SELECT count(*) FROM units1 u "
            "WHERE u.query_id = q.query_id) AS found FROM (SELECT DISTINCT query_id FROM topk) q"
        ),
        "front2": (
            "SELECT t.query_id, t.id, t.place, t.path, s.cost AS cost_so_far, s.found AS found_so_far FROM taken1 t "
            "JOIN state1 s USING (query_id)"
        ),
        "seen2": "SELECT query_id, id FROM front1 UNION ALL SELECT query_id, id FROM taken1",
    }
    | _level(2, "front2", "seen2", "f.cost_so_far", "f.found_so_far")
    | {
        "found": (
            "SELECT query_id, id, row_number() OVER (PARTITION BY query_id "
            "ORDER BY depth, place) AS place, depth, path, last_type, last_source FROM (SELECT * FROM units1 UNION ALL SELECT * FROM units2)"
        )
    }
)


def _why(n: int) -> str:
    return f"CASE WHEN (SELECT count(*) FROM own{n} o WHERE o.query_id = s.query_id) > 0 THEN CASE WHEN (SELECT bool_or(o.found0 >= 50) FROM own{n} o WHERE o.query_id = s.query_id) OR coalesce((SELECT bool_or(c.upto >= 50) FROM count{n} c WHERE c.query_id = s.query_id), false) OR coalesce((SELECT bool_or(r.found_before >= 50) FROM reached{n} r WHERE r.query_id = s.query_id), false) THEN 'max_total_evidence' WHEN (SELECT bool_or(o.cost >= 500) FROM own{n} o WHERE o.query_id = s.query_id) THEN 'max_traversal_cost' END END"


_HINT_SQL = " || ".join(
    f"CASE WHEN regexp_matches(t, '(?i){p}') AND NOT contains(lower(t), '{h.split()[0]}') THEN chr(1) || '{h}' ELSE '' END" for p, h in search.HINTS
)

ORACLE_SQL = {
    "embed_plan": with_views("SELECT * FROM tasks", _TASKS),
    "embed_input": with_views(f"SELECT ku_id, length({_INPUT}) AS chars, sha256({_INPUT}) AS checksum FROM units", UNITS_SQL),
    "truncation_flag": with_views(
        f"SELECT ku_id, len(list_filter(string_split_regex(text, '{_WS}+'), lambda x: x <> '')) AS words, "
        f"len(list_filter(string_split_regex(text, '{_WS}+'), lambda x: x <> '')) > 400 AS truncated FROM units",
        UNITS_SQL,
    ),
    "embed_manifest": with_views(
        f"SELECT document_id, count(*) FILTER (target = 'text' AND ku_id % 17 <> 3) AS embedded, count(*) FILTER (target = 'text' "
        f"AND ku_id % 17 = 3) AS failed, count(*) FILTER (target = 'image') AS skipped_images, '{MODEL}' AS model, 64 AS dimension "
        f"FROM tasks GROUP BY document_id",
        _TASKS,
    ),
    "index_plan": with_views(
        f"SELECT '{MODEL}' AS model, version, target, max(len(vector)) AS dimension, count(*) AS points, "
        f"lower('{PREFIX}_lab_text_model_v2_' || version[1:8] || '_' || target) AS collection "
        f"FROM (SELECT *, CASE WHEN document_id < 5 THEN '{VERSION}' ELSE 'ffff' END AS version, CASE WHEN asset IS NULL THEN 'text' "
        f"ELSE 'image' END AS target FROM units) GROUP BY version, target",
        UNITS_SQL,
    ),
    "index_points": with_views(
        f"SELECT u.ku_id, document_id, section_id, modality, coalesce(c.n, 0) AS citations, '{MODEL}' AS model, "
        f"list_aggregate(list_sort(list_distinct(pages)), 'string_agg', ',') AS pages FROM units u LEFT JOIN (SELECT dst, count(*) AS n "
        f"FROM point_edges WHERE type = 'CITES' GROUP BY dst) c ON c.dst = 'k' || u.ku_id",
        UNITS_SQL,
    ),
    "index_upsert": with_views(
        "SELECT ku_id, document_id, CASE WHEN ku_id % 3 = 0 THEN 'new' ELSE 'old' END AS state, CASE WHEN ku_id % 3 = 0 THEN 2 "
        "ELSE 1 END AS version FROM units WHERE ku_id % 5 <> 4 OR ku_id % 3 = 0",
        UNITS_SQL,
    ),
    "index_count": with_views("SELECT count(*) AS points FROM units WHERE document_id = 3 AND modality = 'text'", UNITS_SQL),
    "point_lookup": with_views("SELECT ku_id, document_id, modality FROM units WHERE ku_id IN (SELECT doc_id * 2 FROM documents)", UNITS_SQL),
    "vector_topk_cosine": with_views("SELECT * FROM topk", TOPK_SQL),
    "vector_topk_dot": _all_pairs(f"list_inner_product({_Q}, {_P})", "DESC"),
    "vector_topk_euclid": _all_pairs(f"list_distance({_Q}, {_P})", ""),
    "query_normalize": with_views(
        f"SELECT query_id, CASE WHEN t = '' OR {_HINT_SQL} = '' THEN t "
        f"ELSE t || ' | ' || replace(({_HINT_SQL})[2:], chr(1), ' ') END AS normalized FROM normal",
        {
            "asked": "SELECT ku_id AS query_id, list_aggregate(string_split(text, ' ')[1:12], 'string_agg', ' ') AS text FROM points",
            "normal": (
                f"SELECT query_id, trim(regexp_replace(CASE query_id % 4 WHEN 0 THEN 'Who  wrote ' || text WHEN 1 THEN text || ' Keywords?' "
                f"WHEN 2 THEN 'Which approach ' || chr(10) || text ELSE '  ' || text || ' by the authors ' END, '{_WS}+', ' ', 'g')) AS t "
                f"FROM asked"
            ),
        },
    ),
    "graph_nodes": with_views(
        "SELECT * FROM node_rows",
        UNITS_SQL | {
            "node_rows": _NODES["node_rows"].replace(
                "full_section, document_id, 'Section' FROM units",
                "section_id, document_id, 'Section' FROM units WHERE section_id IS NOT NULL",
            )
        },
    ),
    "graph_containment": with_views("SELECT src, dst, type FROM point_edges WHERE type = 'BELONGS_TO'"),
    "graph_next": with_views("SELECT src, dst, type FROM point_edges WHERE type = 'NEXT'"),
    "graph_project": with_views("SELECT src, dst, type FROM point_edges"),
    "graph_summary": with_views(
        "SELECT n.document_id, count(*) AS nodes, CAST(sum(coalesce(e.c, 0)) AS BIGINT) AS edges FROM node_rows n LEFT "
        "JOIN (SELECT src, count(*) AS c FROM point_edges GROUP BY src) e ON e.src = n.id GROUP BY n.document_id",
        _NODES,
    ),
    "graph_replace": with_views(
        "SELECT id, document_id, 'old' AS state FROM node_rows WHERE document_id >= 2 UNION ALL SELECT id, document_id, 'new' "
        "FROM node_rows WHERE document_id < 2 AND id LIKE 'k%'",
        _NODES,
    ),
    "graph_neighbors": with_views(
        "SELECT e.dst AS node, e.src AS neighbor, e.type, n.labels FROM point_edges e JOIN node_rows n ON n.id = e.src "
        "WHERE e.type IN ('CITES', 'REFERENCES') AND e.dst IN (SELECT 'k' || ku_id FROM points)",
        _NODES,
    ),
    "adjacency_ranked": with_views("SELECT node, neighbor, type, direction, place, degree FROM adjacent", ADJACENT_SQL),
    "expand_budgeted": with_views("SELECT query_id, id, place, depth, path FROM found", EXPAND_SQL),
    "expansion_stats": with_views(
        f"SELECT s.query_id, s.cost + coalesce((SELECT sum(degree) FROM reached2 r "
        f"WHERE r.query_id = s.query_id AND r.found_before < 50), 0) AS cost, coalesce({_why(2)}, {_why(1)}) AS exhausted FROM state1 s",
        EXPAND_SQL,
    ),
}
