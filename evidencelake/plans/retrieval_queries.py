"""Queries of retrieval, evidence, claims and citations, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import CLAIM_STOPWORDS, QUERY_STOPWORDS, terms_sql
from ..operators import evidence, graph, retrieval
from ..sources import views
from ..sources.stage import cut
from ..sources.views import with_views
from . import search_queries
from .search_queries import EXPAND_SQL, TOPK_SQL, UNITS_SQL

Spark = SparkSession
WINDOW, MAX_TOKENS = 8192, 1024


def _units(spark: Spark, d: str) -> DataFrame:
    own = search_queries._units(spark, d)
    return own.select(graph.key("k", "ku_id").alias("id"), "section_id", "modality", "context", "text")


def pool(spark: Spark, d: str, expanded: bool = True) -> DataFrame:
    """Candidates of all questions: seeds, then what the graph leads to."""
    top = cut(search_queries.vector_topk_cosine(spark, d))
    none = F.lit(None).cast("string")
    rows = top.select(
        "query_id",
        graph.key("k", "ku_id").alias("id"),
        F.col("rank").alias("pool_pos"),
        F.col("score").alias("dense"),
        F.lit(0).alias("hops"),
        none.alias("last_type"),
        none.alias("last_source"),
    )
    if expanded:
        found, _ = graph.expand(top.select("query_id", graph.key("k", "ku_id").alias("id"), "rank"), search_queries.near(spark, d))
        last = F.element_at("hops", -1)
        rows = rows.unionByName(
            found.select(
                "query_id",
                "id",
                (F.col("place") + 20).alias("pool_pos"),
                F.lit(None).cast("double").alias("dense"),
                F.col("depth").alias("hops"),
                last["type"].alias("last_type"),
                last["source"].alias("last_source"),
            )
        )
    return rows.join(_units(spark, d), "id")


def fused(spark: Spark, d: str, expanded: bool = True) -> DataFrame:
    return retrieval.fuse(retrieval.signals(pool(spark, d, expanded), views.questions(spark, d)))


def lexical_overlap(spark: Spark, d: str) -> DataFrame:
    return retrieval.overlaps(views.questions(spark, d), search_queries._units(spark, d))


def lexical_topk(spark: Spark, d: str) -> DataFrame:
    return retrieval.lexical_topk(
        views.questions(spark, d).select("query_id", "text"),
        search_queries._units(spark, d).select("ku_id", "context", "text"),
    )


def signal_confidence(spark: Spark, d: str) -> DataFrame:
    return pool(spark, d).select("query_id", "id", retrieval.confidence(F.col("dense"), F.col("last_type")).alias("confidence"))


def signal_proximity(spark: Spark, d: str) -> DataFrame:
    return pool(spark, d).select("query_id", "id", F.round(1 / (1 + F.col("hops")), 6).alias("proximity"))


def signal_ranks(spark: Spark, d: str) -> DataFrame:
    return retrieval.signal_ranks(retrieval.signals(pool(spark, d), views.questions(spark, d)))


def rrf_fuse(spark: Spark, d: str) -> DataFrame:
    return fused(spark, d).select("query_id", "id", "fused", "final_rank")


def diversity_bucket(spark: Spark, d: str) -> DataFrame:
    context = F.expr("case ku_id % 3 when 0 then null when 1 then concat('Bibliography reference [', ku_id % 9, ']') else context end")
    return search_queries._units(spark, d).select("ku_id", retrieval.diversity_bucket(F.col("section_id"), context).alias("bucket"))


def retrieve_hybrid(spark: Spark, d: str) -> DataFrame:
    return retrieval.assemble(fused(spark, d))


def assemble_groups(spark: Spark, d: str) -> DataFrame:
    return retrieval.assemble(fused(spark, d), most_groups=8, most_primaries=1)


def dropped_log(spark: Spark, d: str) -> DataFrame:
    return retrieval.dropped(fused(spark, d))


def retrieve_dense(spark: Spark, d: str) -> DataFrame:
    return retrieval.assemble(fused(spark, d, expanded=False))


def retrieval_stats(spark: Spark, d: str) -> DataFrame:
    ranked = cut(fused(spark, d).select("query_id", "id", "final_rank", "last_source", "last_type", "section_id", "context"))
    groups = retrieval.assemble(ranked).groupBy("query_id").agg(
        F.count_if(F.col("role") == "primary").alias("groups"),
        F.count(F.lit(1)).alias("items"),
    )
    own = ranked.groupBy("query_id").agg(
        F.count_if(F.col("last_type").isNull()).alias("generated"),
        F.count_if(F.col("last_type").isNotNull()).alias("expanded"),
        F.count(F.lit(1)).alias("scored"),
    )
    return own.join(groups, "query_id")


def bundle(spark: Spark, d: str) -> DataFrame:
    """Members of the evidence groups with what their units say; only theirs are looked up."""
    ranked = cut(fused(spark, d))
    members = retrieval.assemble(ranked).join(ranked.select("query_id", "id", "dense", "last_type", "modality", "context"), ["query_id", "id"])
    return members.join(_units(spark, d).select("id", "text"), "id")


def _asked(spark: Spark, d: str) -> DataFrame:
    words = F.expr(
        "case query_id div 25 % 8 when 0 then 'Compare ' when 1 then 'How to ' when 2 then 'Cite ' when 3 then 'Figure ' when 4 then "
        "'Table ' when 5 then 'What is ' else '' end"
    )
    return views.questions(spark, d).select("query_id", F.concat(words, "text").alias("text"))


def _facts(members: DataFrame) -> DataFrame:
    top = F.max(F.when((F.col("group_rank") == 1) & (F.col("member_pos") == 0), F.col("modality")))
    return members.groupBy("query_id").agg(
        F.max("group_rank").alias("groups"),
        top.alias("top_modality"),
        F.bool_or(F.col("last_type").isNotNull()).alias("graph_found"),
    )


def question_classify(spark: Spark, d: str) -> DataFrame:
    return evidence.classify(_asked(spark, d), _facts(bundle(spark, d)))


def answer_plan(spark: Spark, d: str) -> DataFrame:
    return evidence.answer_plan(question_classify(spark, d))


def context_flatten(spark: Spark, d: str) -> DataFrame:
    return evidence.flatten(bundle(spark, d)).select("query_id", "pos", "id")


def _deduplicated(spark: Spark, d: str) -> DataFrame:
    return evidence.remove_redundant(cut(evidence.flatten(bundle(spark, d))))


def context_redundancy(spark: Spark, d: str) -> DataFrame:
    return _deduplicated(spark, d).select("query_id", "pos", "id")


def _context(spark: Spark, d: str) -> DataFrame:
    return evidence.fit(cut(_deduplicated(spark, d)), WINDOW, MAX_TOKENS)


def context_fit(spark: Spark, d: str) -> DataFrame:
    return _context(spark, d).select("query_id", "id", "tokens", "label")


def prompt_rows(spark: Spark, d: str) -> DataFrame:
    out = evidence.prompt_rows(_context(spark, d), _asked(spark, d))
    return out.select("query_id", F.char_length("prompt").alias("chars"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


def prompt_checks(spark: Spark, d: str) -> DataFrame:
    broken = F.expr("case when query_id % 75 = 0 and label = 'KU2' then 'KU1' when query_id % 100 = 25 and label = 'KU1' then 'K1' else label end")
    rows = cut(_context(spark, d)).withColumn("label", broken).where("query_id % 175 <> 50")
    return evidence.prompt_checks(rows, _asked(spark, d).withColumn("text", F.expr("case when query_id % 200 = 100 then ' ' else text end")), 4000)


def figure_notes_join(spark: Spark, d: str) -> DataFrame:
    members = evidence.flatten(bundle(spark, d)).withColumn(
        "label",
        F.concat(F.lit("KU"), F.col("pos").cast("string")),
    ).withColumn("question_type", F.when(F.col("query_id") % 50 == 0, "figure").otherwise("factual"))
    described = search_queries._units(spark, d).where("ku_id % 12 = 1").select(
        graph.key("k", "ku_id").alias("id"),
        F.concat(F.lit("shows "), F.col("ku_id").cast("string")).alias("description"),
    )
    out = evidence.figure_notes(members, described)
    return out.select("query_id", "id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "note")


def _answers(spark: Spark, d: str) -> DataFrame:
    quoted = F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.lit(" (Section: user)"))).otherwise(F.col("text"))
    return views.answers(spark, d).select(
        "answer_id",
        "conv_id",
        "turn",
        (25 * ((F.col("conv_id") + F.col("turn")) % 20)).alias("query_id"),
        quoted.alias("text"),
    )


def claims_split(spark: Spark, d: str) -> DataFrame:
    return evidence.claims(_answers(spark, d))


def citation_labels(spark: Spark, d: str) -> DataFrame:
    text = F.expr("replace(replace(text, '[KU2]', '(KU2; KU7 and KU1)'), '[KU3]', '[KU3,KU4&KU9] (Doe, 2021)')")
    return _answers(spark, d).select("answer_id", F.array_join(evidence.citation_labels(text), " ").alias("labels"))


def _verdicts(spark: Spark, d: str) -> DataFrame:
    return evidence.verdicts(claims_split(spark, d), views.evidence(spark, d))


def claims_verdict(spark: Spark, d: str) -> DataFrame:
    return _verdicts(spark, d).select("answer_id", "claim", "verdict", F.array_join("labels", " ").alias("labels"))


def grounding_summary(spark: Spark, d: str) -> DataFrame:
    return evidence.grounding_summary(_verdicts(spark, d))


def citations_resolve(spark: Spark, d: str) -> DataFrame:
    return evidence.resolve_citations(_answers(spark, d), views.evidence(spark, d))


def answer_quality(spark: Spark, d: str) -> DataFrame:
    members = cut(bundle(spark, d))
    plans = evidence.answer_plan(evidence.classify(_asked(spark, d), _facts(members)))
    return evidence.quality(
        _answers(spark, d),
        members.where("member_pos = 0").select("query_id", "dense"),
        plans,
        members.select("query_id", "modality"),
        grounding_summary(spark, d),
        citations_resolve(spark, d),
    )


def answer_report(spark: Spark, d: str) -> DataFrame:
    shown = views.evidence(spark, d).withColumn(
        "discovery",
        F.when(F.col("context") == "Section: user", "Matched your question directly").otherwise("Connected to matched evidence (next)"),
    )
    out = evidence.report(_answers(spark, d), shown, citations_resolve(spark, d), _verdicts(spark, d))
    return out.select("answer_id", "summary", "support", F.md5(F.col("references").cast("binary")).alias("references_md5"), "limitations", "warnings")


QUERIES = {
    f.__name__: f
    for f in (
        lexical_overlap, lexical_topk, signal_confidence, signal_proximity, signal_ranks, rrf_fuse, assemble_groups, diversity_bucket, dropped_log, retrieve_hybrid, retrieve_dense, retrieval_stats, question_classify,
        answer_plan, context_flatten, context_redundancy, context_fit, prompt_rows, prompt_checks, figure_notes_join, claims_split, citation_labels, claims_verdict, grounding_summary, citations_resolve, answer_quality, answer_report,
    )
}


def _q(text: str) -> str:
    return terms_sql(text, QUERY_STOPWORDS)


_TYPED = (
    "CASE WHEN p.last_type IS NULL THEN 4 WHEN p.last_type IN ('CITES', 'REFERENCES') THEN 3 "
    "WHEN p.last_type IN ('CONTINUES', 'NEXT') THEN 2 WHEN p.last_type = 'BELONGS_TO' THEN 1 ELSE 0 END"
)
_SEEDS = (
    "SELECT query_id, 'k' || ku_id AS id, rank AS pool_pos, score AS dense, 0 AS hops, CAST(NULL AS VARCHAR) AS last_type, CAST(NULL "
    "AS VARCHAR) AS last_source FROM topk"
)
_REST = {
    "terms_q": f"SELECT query_id, text, {_q('text')} AS terms FROM questions",
    "terms_u": f"SELECT *, 'k' || ku_id AS id, {_q("concat_ws(' ', context, text)")} AS terms FROM units",
    "scored": (
        f"SELECT p.*, u.section_id, u.modality, u.context, u.text, CASE WHEN len(q.terms) = 0 THEN 0.0 "
        f"ELSE round(len(list_intersect(q.terms, u.terms)) / len(q.terms), 9) END AS lexical, CAST({_TYPED} AS DOUBLE) AS confidence, "
        f"round(1 / (1 + p.hops), 9) AS proximity FROM pool p JOIN terms_q q USING (query_id) JOIN terms_u u ON u.id = p.id"
    ),
    "ranks": "SELECT *, " + ", ".join(
        f"rank() OVER (PARTITION BY query_id ORDER BY {n} DESC NULLS LAST) AS {n}_rank" for n in retrieval.SIGNALS
    ) + " FROM scored",
    "fused": (
        "SELECT *, row_number() OVER (PARTITION BY query_id "
        "ORDER BY fused DESC, pool_pos) AS final_rank, coalesce(CAST(section_id AS VARCHAR), CASE "
        "WHEN context IS NOT NULL THEN 'ctx:' || trim(string_split(context, '[')[1]) END, '__no_section__') AS bucket "
        "FROM (SELECT *, round(0.0 + "
    )
    + " + ".join(f"1 / (60 + {n}_rank)" for n in retrieval.SIGNALS)
    + ", 9) AS fused FROM ranks)",
}
POOL_SQL = UNITS_SQL | EXPAND_SQL | {
    "pool": f"{_SEEDS} UNION ALL SELECT query_id, id, 20 + place, NULL, depth, last_type, last_source FROM found"
} | _REST


def _assembly(groups: int = 5, primaries: int = 2) -> dict[str, str]:
    members = "list_transform(list_filter(l.pool, lambda o: NOT list_contains(w.claimed, o.id) AND o.id <> c.id AND o.src = c.id), lambda o: o.id)"
    skip, full = "list_contains(w.claimed, c.id)", f"len(w.groups) >= {groups}"
    crowded = f"len(list_filter(w.buckets, lambda b: b = c.bucket)) >= {primaries}"
    opens = f"NOT {skip} AND NOT {full} AND NOT {crowded}"
    return {
        "pools": "SELECT query_id, list({'id': id, 'src': coalesce(last_source, '')} ORDER BY final_rank) AS pool FROM fused GROUP BY query_id",
        "folded": f"""SELECT query_id, 0 AS i, CAST([] AS VARCHAR[]) AS claimed, CAST([] AS VARCHAR[]) AS groups, CAST([] AS VARCHAR[]) AS buckets, CAST([] AS VARCHAR[]) AS dropped, CAST([] AS VARCHAR[][]) AS members FROM pools
        UNION ALL SELECT w.query_id, w.i + 1,
            CASE WHEN {opens} THEN list_concat(w.claimed, [c.id], {members}) ELSE w.claimed END,
            CASE WHEN {opens} THEN list_append(w.groups, c.id) ELSE w.groups END,
            CASE WHEN {opens} THEN list_append(w.buckets, c.bucket) ELSE w.buckets END,
            CASE WHEN NOT {skip} AND NOT ({opens}) THEN list_append(w.dropped, c.id || '|' || CASE WHEN {full} THEN 'group budget' ELSE 'bucket full' END) ELSE w.dropped END,
            CASE WHEN {opens} THEN list_append(w.members, list_concat([c.id], {members})) ELSE w.members END
        FROM folded w JOIN fused c ON c.query_id = w.query_id AND c.final_rank = w.i + 1 JOIN pools l ON l.query_id = w.query_id""",
        "ended": "SELECT * FROM folded QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i DESC) = 1",
        "grouped": "SELECT query_id, generate_subscripts(members, 1) AS group_rank, unnest(members) AS m FROM ended",
        "evid": (
            "SELECT query_id, group_rank, member_pos, id, CASE WHEN member_pos = 0 THEN 'primary' ELSE 'supporting' END AS role "
            "FROM (SELECT query_id, group_rank, generate_subscripts(m, 1) - 1 AS member_pos, unnest(m) AS id FROM grouped)"
        ),
    }


HYBRID_SQL = POOL_SQL | _assembly()
_DENSE = UNITS_SQL | TOPK_SQL | {"pool": _SEEDS} | _REST | _assembly()
_BUNDLE = HYBRID_SQL | {
    "bundle": "SELECT e.*, f.dense, f.last_type, f.modality, f.context, f.text FROM evid e JOIN fused f USING (query_id, id)",
    "asked": (
        "SELECT query_id, CASE query_id // 25 % 8 WHEN 0 THEN 'Compare ' WHEN 1 THEN 'How to ' WHEN 2 THEN 'Cite ' WHEN 3 THEN 'Figure ' "
        "WHEN 4 THEN 'Table ' WHEN 5 THEN 'What is ' ELSE '' END || text AS text FROM questions"
    ),
}


def _has(kind: str) -> str:
    return "(" + " OR ".join(f"contains(t, '{m}')" for m in evidence.MARKERS[kind]) + ")"


_PLANNED = _BUNDLE | {
    "facts": (
        "SELECT query_id, max(group_rank) AS groups, max(CASE WHEN group_rank = 1 "
        "AND member_pos = 0 THEN modality END) AS top, bool_or(last_type IS NOT NULL) AS graph_found FROM bundle GROUP BY query_id"
    ),
    "typed": (
        f"SELECT query_id, CASE WHEN {_has('comparative')} THEN 'comparative' WHEN {_has('procedural')} THEN 'procedural' "
        f"WHEN {_has('citation')} THEN 'citation' WHEN {_has('figure')} OR top = 'figure' THEN 'figure' "
        f"WHEN {_has('table')} OR top = 'table' THEN 'table' WHEN groups >= 3 AND graph_found THEN 'multi_hop' "
        f"WHEN {_has('descriptive')} THEN 'descriptive' ELSE 'factual' END AS question_type "
        f"FROM (SELECT a.query_id, ' ' || lower(a.text) || ' ' AS t, coalesce(f.top, '') AS top, coalesce(f.groups, 0) AS groups, "
        f"coalesce(f.graph_found, false) AS graph_found FROM asked a LEFT JOIN facts f USING (query_id))"
    ),
    "planned": (
        "SELECT query_id, question_type, CASE WHEN question_type IN ('comparative', 'multi_hop') THEN 2 ELSE 1 END AS required_groups, "
        "CASE WHEN question_type IN ('figure', 'table') THEN question_type END AS required_modality FROM typed"
    ),
}
_FLAT = _BUNDLE | {"flat": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY group_rank, member_pos) AS pos FROM bundle"}
_UNIQUE = _FLAT | {
    "uniq": (
        "SELECT * FROM flat f WHERE NOT EXISTS (SELECT 1 FROM flat o "
        "WHERE o.query_id = f.query_id AND o.pos < f.pos AND contains(o.text, f.text))"
    )
}
_ROOM = WINDOW - MAX_TOKENS - evidence.RESERVED_TOKENS
_FIT = _UNIQUE | {
    "weighed": "SELECT *, greatest(length(text) // 4, 1) AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS k FROM uniq",
    "packing": (
        f"SELECT query_id, 0 AS k, CAST(0 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT query_id FROM weighed) "
        f"UNION ALL SELECT p.query_id, w.k, CASE WHEN p.used + w.tokens <= {_ROOM} THEN p.used + w.tokens ELSE p.used END, CASE "
        f"WHEN p.used + w.tokens <= {_ROOM} THEN list_append(p.kept, w.pos) ELSE p.kept END FROM packing p "
        f"JOIN weighed w ON w.query_id = p.query_id AND w.k = p.k + 1"
    ),
    "packed": "SELECT query_id, kept FROM packing QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k DESC) = 1",
    "shown": (
        "SELECT w.*, 'KU' || list_position(p.kept, w.pos) AS label FROM weighed w "
        "JOIN packed p ON p.query_id = w.query_id AND list_contains(p.kept, w.pos)"
    ),
}
_WS = r"[ \t\n\r\f\v]"
_ANSWERS = {
    "said": (
        "SELECT answer_id, conv_id, turn, 25 * ((conv_id + turn) % 20) AS query_id, text || CASE "
        "WHEN conv_id % 3 = 0 THEN ' (Section: user)' ELSE '' END AS text FROM answers"
    )
}
_EDGE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_CLAIMS = _ANSWERS | {
    "pieces": (
        rf"SELECT answer_id, list_filter(list_transform(string_split(regexp_replace(trim(text, {_EDGE}), '([.!?]){_WS}+', '\1' || chr(1), "
        rf"'g'), chr(1)), lambda x: trim(x, {_EDGE})), lambda x: len(regexp_extract_all(x, '\p{{L}}')) >= 3) AS c FROM said"
    ),
    "claims": "SELECT answer_id, generate_subscripts(c, 1) - 1 AS claim, unnest(c) AS text FROM pieces",
}


def _labels(text: str) -> str:
    group = r"[\[(][ \t\n\r\f\v]*(KU[0-9]+(?:[ \t\n\r\f\v]*(?:,|;|and|&)[ \t\n\r\f\v]*KU[0-9]+)*)[ \t\n\r\f\v]*[\])]"
    return f"flatten(list_transform(regexp_extract_all({text}, '{group}', 1), lambda g: regexp_extract_all(g, 'KU[0-9]+')))"


_VERDICTS = _CLAIMS | {
    "labelled": f"SELECT *, {_labels('text')} AS labels, {terms_sql('text', CLAIM_STOPWORDS)} AS own FROM claims",
    "cited": "SELECT DISTINCT answer_id, claim, unnest(labels) AS label FROM labelled",
    "known": (
        f"SELECT c.answer_id, c.claim, count(*) FILTER (e.label IS NULL) AS unknown, "
        f"coalesce(flatten(list({terms_sql("concat_ws(' ', e.context, e.text)", CLAIM_STOPWORDS)}) FILTER (e.label IS NOT NULL)), []) AS "
        f"found FROM cited c LEFT JOIN evidence e ON e.answer_id = c.answer_id AND e.label = c.label GROUP BY c.answer_id, c.claim"
    ),
    "verdicts": (
        "SELECT l.answer_id, l.claim, l.labels, CASE WHEN len(l.labels) = 0 THEN 'missing_citation' "
        "WHEN k.unknown > 0 THEN 'unresolved_citation' "
        "WHEN len(l.own) = 0 OR len(list_filter(l.own, lambda w: list_contains(k.found, w))) / len(l.own) >= 0.5 THEN 'grounded' "
        "ELSE 'unsupported' END AS verdict FROM labelled l LEFT JOIN known k ON k.answer_id = l.answer_id AND k.claim = l.claim"
    ),
    "summed": (
        "SELECT answer_id, count(*) AS claims, count(*) FILTER (verdict = 'grounded') AS grounded, round(count(*) FILTER (verdict = "
        "'grounded') / count(*), 9) AS ratio FROM verdicts GROUP BY answer_id"
    ),
}
_CITED = _ANSWERS | {
    "used": (
        f"SELECT answer_id, label, min(p) AS p FROM (SELECT answer_id, unnest({_labels('text')}) AS label, "
        f"generate_subscripts({_labels('text')}, 1) AS p FROM said) GROUP BY answer_id, label"
    ),
    "quoted": (
        "SELECT e.answer_id, e.label, instr(a.text, '(' || e.context || ')') AS p FROM evidence e "
        "JOIN said a ON a.answer_id = e.answer_id WHERE instr(a.text, '(' || e.context || ')') > 0 AND NOT EXISTS (SELECT 1 FROM used u "
        "WHERE u.answer_id = e.answer_id AND u.label = e.label)"
    ),
    "resolved": (
        "SELECT a.answer_id, row_number() OVER (PARTITION BY a.answer_id ORDER BY a.kind, a.p, a.label) AS n, a.label, e.ku_id "
        "FROM (SELECT *, 0 AS kind FROM used UNION ALL SELECT *, 1 FROM quoted) a LEFT "
        "JOIN evidence e ON e.answer_id = a.answer_id AND e.label = a.label"
    ),
}
_TOPIC = {
    "lexed": f"SELECT ku_id, unnest({_q("concat_ws(' ', context, text)")}) AS term FROM units",
    "asks": f"SELECT query_id, unnest({_q('text')}) AS term FROM questions",
}

ORACLE_SQL = {
    "lexical_overlap": with_views(
        "SELECT q.query_id, u.ku_id, CASE WHEN len(q.terms) = 0 THEN 0.0 "
        "ELSE round(len(list_intersect(q.terms, u.terms)) / len(q.terms), 6) END AS overlap FROM terms_q q "
        "JOIN questions x USING (query_id) JOIN terms_u u ON u.document_id = x.document_id",
        UNITS_SQL | {k: _REST[k] for k in ("terms_q", "terms_u")},
    ),
    "lexical_topk": with_views(
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ku_id) AS rank "
        "FROM (SELECT a.query_id, l.ku_id, round(count(*) / any_value(s.n), 6) AS score FROM asks a JOIN lexed l USING (term) "
        "JOIN (SELECT query_id, count(*) AS n FROM asks GROUP BY query_id) s USING (query_id) GROUP BY a.query_id, l.ku_id)) "
        "WHERE rank <= 20",
        UNITS_SQL | _TOPIC,
    ),
    "signal_confidence": with_views(f"SELECT query_id, id, CAST({_TYPED} AS DOUBLE) AS confidence FROM pool p", POOL_SQL),
    "signal_proximity": with_views("SELECT query_id, id, round(1 / (1 + hops), 6) AS proximity FROM pool", POOL_SQL),
    "signal_ranks": with_views(
        " UNION ALL ".join(
            f"SELECT query_id, id, '{n}' AS signal, coalesce({n}, 0.0) AS value, {n}_rank AS rank FROM ranks" for n in retrieval.SIGNALS
        ),
        POOL_SQL,
    ),
    "rrf_fuse": with_views("SELECT query_id, id, fused, final_rank FROM fused", POOL_SQL),
    "assemble_groups": with_views("SELECT query_id, group_rank, member_pos, id, role FROM evid", POOL_SQL | _assembly(8, 1)),
    "diversity_bucket": with_views(
        "SELECT ku_id, coalesce(CAST(section_id AS VARCHAR), CASE "
        "WHEN c IS NOT NULL THEN 'ctx:' || trim(string_split(c, '[')[1]) END, '__no_section__') AS bucket "
        "FROM (SELECT *, CASE ku_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Bibliography reference [' || (ku_id % 9) || ']' "
        "ELSE context END AS c FROM units)",
        UNITS_SQL,
    ),
    "dropped_log": with_views(
        "SELECT query_id, string_split(x, '|')[1] AS id, string_split(x, '|')[2] AS reason FROM (SELECT query_id, unnest(dropped) AS x FROM ended)",
        HYBRID_SQL,
    ),
    "retrieve_hybrid": with_views("SELECT query_id, group_rank, member_pos, id, role FROM evid", HYBRID_SQL),
    "retrieve_dense": with_views("SELECT query_id, group_rank, member_pos, id, role FROM evid", _DENSE),
    "retrieval_stats": with_views(
        "SELECT f.query_id, count(*) FILTER (last_type IS NULL) AS generated, count(*) FILTER (last_type IS NOT NULL) AS expanded, "
        "count(*) AS scored, any_value(e.g) AS groups, any_value(e.n) AS items FROM fused f "
        "JOIN (SELECT query_id, max(group_rank) AS g, count(*) AS n FROM evid GROUP BY query_id) e USING (query_id) GROUP BY f.query_id",
        HYBRID_SQL,
    ),
    "question_classify": with_views("SELECT query_id, question_type FROM typed", _PLANNED),
    "answer_plan": with_views("SELECT query_id, question_type, required_groups, required_modality FROM planned", _PLANNED),
    "context_flatten": with_views("SELECT query_id, pos, id FROM flat", _FLAT),
    "context_redundancy": with_views("SELECT query_id, pos, id FROM uniq", _UNIQUE),
    "context_fit": with_views("SELECT query_id, id, tokens, label FROM shown", _FIT),
    "prompt_rows": with_views(
        "SELECT query_id, length(prompt) AS chars, md5(prompt) AS prompt_md5 "
        "FROM (SELECT a.query_id, 'Evidence:' || chr(10) || coalesce((SELECT string_agg('[' || s.label || ']' || CASE "
        "WHEN s.context IS NOT NULL THEN ' (' || s.context || ')' ELSE '' END || ' ' || s.text, chr(10) ORDER BY s.pos) || chr(10) "
        "FROM shown s WHERE s.query_id = a.query_id), '') || chr(10) || 'Question: ' || a.text AS prompt FROM asked a)",
        _FIT,
    ),
    "prompt_checks": with_views(
        """SELECT query_id, 'token_budget' AS rule, CAST(sum(tokens) AS VARCHAR) AS detail FROM bad GROUP BY query_id HAVING sum(tokens) > 4000
        UNION ALL SELECT query_id, 'no_evidence', NULL FROM asked WHERE query_id NOT IN (SELECT query_id FROM bad)
        UNION ALL SELECT query_id, 'duplicate_unit', id FROM bad GROUP BY query_id, id HAVING count(*) > 1
        UNION ALL SELECT query_id, 'malformed_label', label FROM bad WHERE NOT regexp_matches(label, '^KU[0-9]+$')
        UNION ALL SELECT query_id, 'repeated_label', label FROM bad GROUP BY query_id, label HAVING count(*) > 1
        UNION ALL SELECT query_id, 'blank_question', NULL FROM asked WHERE query_id % 200 = 100""",
        _FIT | {
            "bad": (
                "SELECT query_id, id, tokens, CASE WHEN query_id % 75 = 0 AND label = 'KU2' THEN 'KU1' WHEN query_id % 100 = 25 "
                "AND label = 'KU1' THEN 'K1' ELSE label END AS label FROM shown WHERE query_id % 175 <> 50"
            )
        },
    ),
    "figure_notes_join": with_views(
        "SELECT query_id, id, md5(text || CASE WHEN fig AND n % 12 = 1 THEN chr(10) || chr(10) || 'Visual analysis: shows ' || n "
        "ELSE '' END) AS text_md5, CASE WHEN fig THEN 'KU' || pos || CASE WHEN n % 12 = 1 THEN ': figure image analyzed' "
        "ELSE ': visual analysis unavailable; caption only' END END AS note "
        "FROM (SELECT *, query_id % 50 = 0 AND modality = 'figure' AS fig, CAST(id[2:] AS BIGINT) AS n FROM flat)",
        _FLAT,
    ),
    "claims_split": with_views("SELECT answer_id, claim, text FROM claims", _CLAIMS),
    "citation_labels": with_views(
        f"SELECT answer_id, coalesce(list_aggregate({_labels('t')}, 'string_agg', ' '), '') AS labels "
        f"FROM (SELECT answer_id, replace(replace(text, '[KU2]', '(KU2; KU7 and KU1)'), '[KU3]', '[KU3,KU4&KU9] (Doe, 2021)') AS t "
        f"FROM said)",
        _ANSWERS,
    ),
    "claims_verdict": with_views(
        "SELECT answer_id, claim, verdict, coalesce(list_aggregate(labels, 'string_agg', ' '), '') AS labels FROM verdicts",
        _VERDICTS,
    ),
    "grounding_summary": with_views("SELECT * FROM summed", _VERDICTS),
    "citations_resolve": with_views("SELECT * FROM resolved", _CITED),
    "answer_quality": with_views(
        """SELECT answer_id, round(retrieval, 6) AS retrieval, round(ratio, 6) AS ratio, round(coverage, 6) AS coverage, round(completeness, 6) AS completeness, round((retrieval + ratio + coverage + completeness) / 4, 6) AS confidence,
            CASE WHEN NOT has THEN 'insufficient' WHEN ratio >= 1 AND completeness >= 1 THEN 'sufficient' WHEN ratio > 0 THEN 'partially_sufficient' ELSE 'unverified' END AS status FROM parted""",
        _PLANNED | _VERDICTS | {k: v for k, v in _CITED.items() if k != "said"}
        | {
            "prim": "SELECT query_id, avg(coalesce(dense, 0.5)) AS retrieval, count(*) AS groups FROM bundle WHERE member_pos = 0 GROUP BY query_id",
            "parted": """SELECT a.answer_id, coalesce(p.retrieval, 0.0) AS retrieval, coalesce(s.ratio, 0.0) AS ratio, coalesce(c.coverage, 1.0) AS coverage, EXISTS (SELECT 1 FROM bundle b WHERE b.query_id = a.query_id) AS has,
                (least(coalesce(p.groups, 0) / l.required_groups, 1.0) + CASE WHEN l.required_modality IS NULL OR EXISTS (SELECT 1 FROM bundle b WHERE b.query_id = a.query_id AND b.modality = l.required_modality) THEN 1.0 ELSE 0.0 END) / 2 AS completeness
                FROM said a LEFT JOIN planned l ON l.query_id = a.query_id LEFT JOIN prim p ON p.query_id = a.query_id LEFT JOIN summed s ON s.answer_id = a.answer_id
                LEFT JOIN (SELECT answer_id, count(ku_id) / count(*) AS coverage FROM resolved GROUP BY answer_id) c ON c.answer_id = a.answer_id""",
        },
    ),
    "answer_report": with_views(
        """SELECT a.answer_id, CASE WHEN least(nullif(instr(a.text, '. '), 0), nullif(instr(a.text, '! '), 0), nullif(instr(a.text, '? '), 0)) IS NULL THEN a.text ELSE left(a.text, least(nullif(instr(a.text, '. '), 0), nullif(instr(a.text, '! '), 0), nullif(instr(a.text, '? '), 0))) END AS summary,
            coalesce(c.cited, (SELECT string_agg(e.label || ' ' || e.ku_id || ' Shown to the model as context (not cited in the answer)', chr(10) ORDER BY e.label) FROM evidence e WHERE e.answer_id = a.answer_id)) AS support,
            md5(coalesce(c.refs, '')) AS references_md5,
            CASE WHEN v.n > 0 THEN v.n || ' statement(s) could not be verified against the evidence' END AS limitations, CASE WHEN u.n > 0 THEN u.n || ' citation(s) referred to evidence that was not shown' END AS warnings
        FROM said a LEFT JOIN (SELECT r.answer_id, string_agg(r.label || ' ' || r.ku_id || CASE WHEN e.context = 'Section: user' THEN ' Matched your question directly' ELSE ' Connected to matched evidence (next)' END, chr(10) ORDER BY r.n) AS cited, string_agg('[' || r.label || '] ' || e.text, chr(10) ORDER BY r.n) AS refs FROM resolved r JOIN evidence e ON e.answer_id = r.answer_id AND e.label = r.label GROUP BY r.answer_id) c ON c.answer_id = a.answer_id
        LEFT JOIN (SELECT answer_id, count(*) FILTER (verdict <> 'grounded') AS n FROM verdicts GROUP BY answer_id) v ON v.answer_id = a.answer_id
        LEFT JOIN (SELECT answer_id, count(*) FILTER (ku_id IS NULL) AS n FROM resolved GROUP BY answer_id) u ON u.answer_id = a.answer_id""",
        _VERDICTS | {k: v for k, v in _CITED.items() if k != "said"},
    ),
}
