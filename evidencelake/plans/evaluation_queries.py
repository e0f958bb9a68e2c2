"""Queries of metrics, benchmark aggregates and run comparison, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, retrieval
from ..sources import views
from ..sources.files import content_hash
from ..sources.stage import cut
from ..sources.views import with_views
from . import retrieval_queries, search_queries
from .retrieval_queries import _CITED, _VERDICTS, POOL_SQL
from .search_queries import TOPK_SQL

Spark = SparkSession


def _cases(spark: Spark, d: str) -> DataFrame:
    level = F.expr("case query_id div 25 % 3 when 0 then 'easy' when 1 then 'medium' else 'hard' end")
    return views.questions(spark, d).select(
        "query_id",
        level.alias("difficulty"),
        F.concat(F.lit("c"), (F.col("query_id") / 25 % 4).cast("int").cast("string")).alias("category"),
        "text",
        "document_id",
    )


def _retrieval(spark: Spark, d: str, ranked: DataFrame | None = None) -> DataFrame:
    ranked = search_queries.vector_topk_cosine(spark, d) if ranked is None else ranked
    return evaluation.retrieval_metrics(ranked.select("query_id", "ku_id", "rank"), views.relevance(spark, d), _cases(spark, d))


def _metric(prefix: str):
    def query(spark: Spark, d: str) -> DataFrame:
        return _retrieval(spark, d).where(F.col("metric").startswith(prefix))

    return query


def _answer_rows(spark: Spark, d: str) -> DataFrame:
    resolved = retrieval_queries.citations_resolve(spark, d).groupBy("answer_id").agg(
        F.count("ku_id").alias("resolved"),
        F.count_if(F.col("ku_id").isNull()).alias("unresolved"),
        F.array_sort(F.collect_set("ku_id")).alias("cited"),
    )
    claims = retrieval_queries.grounding_summary(spark, d).select("answer_id", "grounded", F.col("claims").alias("total"))
    expected = views.evidence(spark, d).where("label in ('KU1', 'KU3')").groupBy("answer_id").agg(
        F.array_sort(F.collect_set("ku_id")).alias("expected")
    )
    rows = views.answers(spark, d).select("answer_id", "conv_id", "turn").join(resolved, "answer_id", "left").join(claims, "answer_id", "left").join(expected, "answer_id", "left")
    zero, none = F.lit(0), F.array().cast("array<string>")
    return rows.select(
        F.col("answer_id").alias("case_id"),
        "conv_id",
        "turn",
        F.coalesce("resolved", zero).alias("resolved"),
        F.coalesce("unresolved", zero).alias("unresolved"),
        F.coalesce("grounded", zero).alias("grounded"),
        F.coalesce("total", zero).alias("total"),
        F.coalesce("cited", none).alias("cited"),
        F.coalesce("expected", none).alias("expected"),
    )


ANSWER_METRICS = ("citation_accuracy", "grounding_accuracy", "unsupported_rate", "answer_completeness", "evidence_coverage")


def _answer_metric(name: str):
    def query(spark: Spark, d: str) -> DataFrame:
        return evaluation.answer_metrics(_answer_rows(spark, d)).select("case_id", F.col(name).alias("value"))

    return query


def bench_retrieval_agg(spark: Spark, d: str) -> DataFrame:
    fused = retrieval_queries.fused(spark, d).select(
        "query_id",
        F.expr("cast(substring(id, 2) as bigint)").alias("ku_id"),
        F.col("final_rank").alias("rank"),
    )
    dense = _retrieval(spark, d).withColumn("system", F.lit("dense"))
    return evaluation.mean_by(dense.unionByName(_retrieval(spark, d, fused).withColumn("system", F.lit("hybrid"))), "system")


def _long_answers(spark: Spark, d: str) -> DataFrame:
    wide = cut(evaluation.answer_metrics(_answer_rows(spark, d)))
    return wide.unpivot("case_id", list(ANSWER_METRICS), "metric", "value")


def bench_generation_agg(spark: Spark, d: str) -> DataFrame:
    return evaluation.mean_by(_long_answers(spark, d))


def _log(spark: Spark, d: str) -> DataFrame:
    e = views.table(spark, d, "events").where("value is not null")
    return e.select(
        (F.col("user_id") % 5).alias("run_id"),
        F.round("value", 2).alias("retrieval_ms"),
        F.round(F.col("value") * 3, 2).alias("generation_ms"),
        (F.col("event_id") % 700).cast("double").alias("memory_mb"),
        (F.col("event_id") % 90).cast("double").alias("cpu_ms"),
        "event_id",
    )


def bench_performance_agg(spark: Spark, d: str) -> DataFrame:
    return evaluation.performance(_log(spark, d))


def _statuses(spark: Spark, d: str) -> DataFrame:
    g = retrieval_queries.grounding_summary(spark, d)
    got = F.when(F.col("ratio") >= 1, "sufficient").when(F.col("ratio") > 0, "partially_sufficient").otherwise("unverified")
    want = F.when(F.col("claims") % 2 == 0, "partially_sufficient").otherwise("sufficient")
    return g.select("answer_id", got.alias("status"), want.alias("expected"), "claims", "grounded")


def bench_status_accuracy(spark: Spark, d: str) -> DataFrame:
    return _statuses(spark, d).agg(F.round(F.avg((F.col("status") == F.col("expected")).cast("double")), 6).alias("accuracy"))


def bench_breakdown(spark: Spark, d: str) -> DataFrame:
    return evaluation.breakdown(_retrieval(spark, d).join(_cases(spark, d).select("query_id", "difficulty", "category"), "query_id"))


def bench_failures(spark: Spark, d: str) -> DataFrame:
    """Cases without claims or with more unresolved than resolved citations fail; the means
    are over the others."""
    rows = _answer_rows(spark, d)
    reason = F.when(F.col("total") == 0, "no claims").when(F.col("unresolved") > F.col("resolved"), "unresolved citations")
    return rows.select("case_id", reason.alias("reason")).where("reason is not null")


def bench_compare_systems(spark: Spark, d: str) -> DataFrame:
    dense = evaluation.mean_by(_retrieval(spark, d)).withColumn("system", F.lit("dense"))
    euclid = search_queries.vector_topk_euclid(spark, d)
    other = evaluation.mean_by(_retrieval(spark, d, euclid).where("metric <> 'mrr'")).withColumn("system", F.lit("euclid"))
    return evaluation.compare_systems(dense.unionByName(other), "dense", "euclid")


def _runs(spark: Spark, d: str) -> DataFrame:
    base = evaluation.mean_by(_retrieval(spark, d)).unionByName(
        spark.createDataFrame([("unsupported_claim_rate", 0.2), ("cpu_time_ms", 40.0), ("peak_memory_mb", 0.0)], "metric string, value double")
    )
    factor = 1 + ((F.length("metric") * 7) % 21 - 10) / 100
    first = base.select(F.lit("run1").alias("run_id"), "metric", "value", F.lit("v1").alias("dataset_version"))
    second = base.where("metric <> 'recall@1'").select(
        F.lit("run2").alias("run_id"),
        "metric",
        F.when(F.col("metric") == "peak_memory_mb", 0.5).otherwise(F.round(F.col("value") * factor, 6)).alias("value"),
        F.lit("v1").alias("dataset_version"),
    )
    return first.unionByName(second)


def bench_regression(spark: Spark, d: str) -> DataFrame:
    runs = cut(_runs(spark, d))
    return evaluation.regression(runs.where("run_id = 'run1'"), runs.where("run_id = 'run2'"))


def bench_latest(spark: Spark, d: str) -> DataFrame:
    runs = views.table(spark, d, "events").groupBy((F.col("user_id")).alias("run_id")).agg(F.max("ts").alias("created_at"))
    last = views.table(spark, d, "events").agg(F.max("ts").alias("t")).first()["t"]
    return evaluation.latest(runs, F.lit(last)).select("run_id")


def bench_recommend(spark: Spark, d: str) -> DataFrame:
    perf = evaluation.performance(_log(spark, d)).select(
        "run_id",
        F.lit("end_to_end_latency_ms").alias("metric"),
        F.round(F.col("end_to_end_latency_ms") * (F.col("run_id") + 1) * 40, 3).alias("value"),
    )
    means = evaluation.mean_by(_long_answers(spark, d)).where("metric in ('citation_accuracy', 'grounding_accuracy')")
    every = means.withColumn("run_id", F.explode(F.array(*(F.lit(k).cast("long") for k in range(3))))).select("run_id", "metric", "value")
    return evaluation.recommend(perf.unionByName(every))


def bench_case_table(spark: Spark, d: str) -> DataFrame:
    s = _statuses(spark, d)
    return s.select(
        F.col("answer_id").alias("case_id"),
        "expected",
        "status",
        F.when(F.col("status") == F.col("expected"), "OK").otherwise("MISMATCH").alias("verdict"),
        "claims",
        "grounded",
    )


def load_cases(spark: Spark, d: str) -> DataFrame:
    """Cases with the content hash of their category's part of the dataset."""
    cases = _cases(spark, d)
    return cases.join(
        content_hash(cases, "category", ["query_id", "text", "difficulty", "document_id"]),
        "category",
    ).select("query_id", "difficulty", "category", "version")


QUERIES = {
    "precision_at_k": _metric("precision"), "recall_at_k": _metric("recall"), "hit_rate_at_k": _metric("hit_rate"), "mrr": _metric("mrr"), "ndcg_at_k": _metric("ndcg"),
    **{
        k: _answer_metric(v) for k, v in {
            "citation_accuracy": "citation_accuracy",
            "grounding_accuracy": "grounding_accuracy",
            "unsupported_rate": "unsupported_rate",
            "answer_completeness": "answer_completeness",
            "evidence_coverage": "evidence_coverage",
        }.items()
    },
    **{
        f.__name__: f for f in (
            bench_retrieval_agg,
            bench_generation_agg,
            bench_performance_agg,
            bench_status_accuracy,
            bench_breakdown,
            bench_failures,
            bench_compare_systems,
            bench_regression,
            bench_latest,
            bench_recommend,
            bench_case_table,
            load_cases,
        )
    },
}


def flagship(spark: Spark, d: str) -> DataFrame:
    """nDCG@10 by question of vector top-k fused with lexical overlap."""
    top = search_queries.vector_topk_cosine(spark, d)
    rows = top.join(
        search_queries._units(spark, d).select("ku_id", "context", "text"),
        "ku_id",
    ).select(
        "query_id",
        F.col("ku_id").alias("id"),
        F.col("rank").alias("pool_pos"),
        F.col("score").alias("dense"),
        F.lit(0).alias("hops"),
        F.lit(None).cast("string").alias("last_type"),
        "context",
        "text",
    )
    fused = retrieval.fuse(retrieval.signals(rows, views.questions(spark, d)))
    return _retrieval(spark, d, fused.select("query_id", F.col("id").alias("ku_id"), F.col("final_rank").alias("rank"))).where("metric = 'ndcg@10'")


QUERIES["flagship"] = flagship


def _metric_sql(ranked: str, extra: str = "") -> str:
    within = "len(list_filter(ranks, lambda r: r <= {k}))"
    gain = "list_sum(list_transform({l}, lambda r: 1 / log2(r + 1.0)))"
    parts = []
    for k in evaluation.KS:
        w = within.format(k=k)
        dcg = f"coalesce({gain.format(l=f'list_filter(ranks, lambda r: r <= {k})')}, 0)"
        parts += [
            f"SELECT query_id, 'precision@{k}' AS metric, round({w} / {k}, 6) AS value FROM {ranked}",
            f"SELECT query_id, 'recall@{k}', CASE WHEN relevant > 0 THEN round({w} / relevant, 6) END FROM {ranked}",
            f"SELECT query_id, 'hit_rate@{k}', CASE WHEN {w} > 0 THEN 1.0 ELSE 0.0 END FROM {ranked}",
            f"SELECT query_id, 'ndcg@{k}', CASE WHEN relevant > 0 THEN round({dcg} / {gain.format(l=f'range(1, least(relevant, {k}) + 1)')}, "
            f"6) ELSE 0.0 END FROM {ranked}",
        ]
    parts.append(f"SELECT query_id, 'mrr', round(coalesce(1 / list_min(ranks), 0), 6) FROM {ranked}")
    return " UNION ALL ".join(parts)


def _hits_sql(source: str) -> str:
    return f"SELECT q.query_id, coalesce(r.n, 0) AS relevant, coalesce(h.ranks, []) AS ranks FROM questions q LEFT JOIN (SELECT query_id, count(*) AS n FROM relevance GROUP BY query_id) r USING (query_id) LEFT JOIN (SELECT t.query_id, list(t.rank ORDER BY t.rank) AS ranks FROM {source} t JOIN relevance v ON v.query_id = t.query_id AND v.ku_id = t.ku_id GROUP BY t.query_id) h USING (query_id)"


_RET = TOPK_SQL | {"hits": _hits_sql("topk"), "metrics": _metric_sql("hits")}
_CASES = {
    "cases": (
        "SELECT query_id, document_id, text, CASE query_id // 25 % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' "
        "ELSE 'hard' END AS difficulty, 'c' || (query_id // 25 % 4) AS category FROM questions"
    )
}
_ANS = (
    _VERDICTS
    | {k: v for k, v in _CITED.items() if k != "said"}
    | {
        "cit": (
            "SELECT answer_id, count(ku_id) AS resolved, count(*) FILTER (ku_id IS NULL) AS unresolved, list(DISTINCT ku_id) FILTER (ku_id "
            "IS NOT NULL) AS cited FROM resolved GROUP BY answer_id"
        ),
        "want": "SELECT answer_id, list(DISTINCT ku_id) AS expected FROM evidence WHERE label IN ('KU1', 'KU3') GROUP BY answer_id",
        "rows_": (
            "SELECT a.answer_id AS case_id, coalesce(c.resolved, 0) AS resolved, coalesce(c.unresolved, 0) AS unresolved, "
            "coalesce(s.grounded, 0) AS grounded, coalesce(s.claims, 0) AS total, coalesce(c.cited, []) AS cited, coalesce(w.expected, []) "
            "AS expected FROM answers a LEFT JOIN cit c USING (answer_id) LEFT JOIN summed s USING (answer_id) LEFT "
            "JOIN want w USING (answer_id)"
        ),
        "am": """SELECT case_id, round(CASE WHEN resolved + unresolved > 0 THEN resolved / (resolved + unresolved) ELSE 1.0 END, 6) AS citation_accuracy, CASE WHEN total > 0 THEN round(grounded / total, 6) END AS grounding_accuracy, CASE WHEN total > 0 THEN round((total - grounded) / total, 6) END AS unsupported_rate,
            round(CASE WHEN len(expected) > 0 THEN len(list_intersect(cited, expected)) / len(expected) ELSE 1.0 END, 6) AS answer_completeness, round(CASE WHEN len(cited) > 0 THEN len(list_intersect(cited, expected)) / len(cited) ELSE 0.0 END, 6) AS evidence_coverage FROM rows_""",
    }
)
_LOG = {
    "logged": (
        "SELECT user_id % 5 AS run_id, round(value, 2) AS retrieval_ms, round(value * 3, 2) AS generation_ms, CAST(event_id % 700 AS "
        "DOUBLE) AS memory_mb, CAST(event_id % 90 AS DOUBLE) AS cpu_ms FROM events WHERE value IS NOT NULL"
    ),
    "perf": (
        "SELECT run_id, round(avg(retrieval_ms), 4) AS retrieval_latency_ms, round(avg(generation_ms), 4) AS generation_latency_ms, "
        "round(avg(retrieval_ms + generation_ms), 4) AS end_to_end_latency_ms, round(max(memory_mb), 4) AS peak_memory_mb, "
        "round(avg(cpu_ms), 4) AS cpu_time_ms, round(count(*) * 1000 / sum(retrieval_ms + generation_ms), 4) AS cases_per_second "
        "FROM logged GROUP BY run_id"
    ),
}
_STATUS = _VERDICTS | {
    "stat": (
        "SELECT answer_id, claims, grounded, CASE WHEN ratio >= 1 THEN 'sufficient' WHEN ratio > 0 THEN 'partially_sufficient' "
        "ELSE 'unverified' END AS status, CASE WHEN claims % 2 = 0 THEN 'partially_sufficient' ELSE 'sufficient' END AS expected "
        "FROM summed"
    )
}
_MEANS = "SELECT metric, round(avg(value), 6) AS value FROM metrics GROUP BY metric"
_FUSED = POOL_SQL | {
    "hyb": "SELECT query_id, CAST(id[2:] AS BIGINT) AS ku_id, final_rank AS rank FROM fused",
    "hits": _hits_sql("topk"),
    "metrics": _metric_sql("hits"),
    "hits2": _hits_sql("hyb"),
    "metrics2": _metric_sql("hits2"),
}
_LOWER = "('" + "', '".join(evaluation.LOWER_IS_BETTER) + "')"
_RULES = ", ".join(f"('{m}', '{b}', {t}, '{a}')" for m, b, t, a in evaluation.RULES)

ORACLE_SQL = {
    **{
        q: with_views(
            f"SELECT * FROM metrics WHERE metric LIKE '{p}%'",
            _RET,
        ) for q, p in {"precision_at_k": "precision", "recall_at_k": "recall", "hit_rate_at_k": "hit", "mrr": "mrr", "ndcg_at_k": "ndcg"}.items()
    },
    **{q: with_views(f"SELECT case_id, {q} AS value FROM am", _ANS) for q in ANSWER_METRICS},
    "bench_retrieval_agg": with_views(
        "SELECT 'dense' AS system, metric, round(avg(value), 6) AS value FROM metrics GROUP BY metric "
        "UNION ALL SELECT 'hybrid', metric, round(avg(value), 6) FROM metrics2 GROUP BY metric",
        _FUSED,
    ),
    "bench_generation_agg": with_views(
        " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 6) AS value FROM am" for m in ANSWER_METRICS),
        _ANS,
    ),
    "bench_performance_agg": with_views("SELECT * FROM perf", _LOG),
    "bench_status_accuracy": with_views("SELECT round(avg(CASE WHEN status = expected THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM stat", _STATUS),
    "bench_breakdown": with_views(
        "SELECT CASE WHEN grouping(difficulty) = 0 THEN 'difficulty' WHEN grouping(category) = 0 THEN 'category' "
        "ELSE 'all' END AS grouping, coalesce(difficulty, category, 'all') AS name, metric, round(avg(value), 6) AS value FROM metrics "
        "JOIN cases USING (query_id) GROUP BY GROUPING SETS ((metric), (metric, difficulty), (metric, category))",
        _RET | _CASES,
    ),
    "bench_failures": with_views(
        "SELECT case_id, CASE WHEN total = 0 THEN 'no claims' ELSE 'unresolved citations' END AS reason FROM rows_ "
        "WHERE total = 0 OR unresolved > resolved",
        _ANS,
    ),
    "bench_compare_systems": with_views(
        f"SELECT metric, a.value AS dense, b.value AS euclid FROM ({_MEANS}) a FULL JOIN (SELECT metric, round(avg(value), 6) AS value "
        f"FROM metrics2 WHERE metric <> 'mrr' GROUP BY metric) b USING (metric)",
        _RET | {
            "near": (
                "SELECT query_id, ku_id, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 6), ku_id) AS rank "
                "FROM (SELECT q.query_id, p.ku_id, list_distance(CAST(q.vector AS DOUBLE[]), CAST(p.vector AS DOUBLE[])) AS dist "
                "FROM questions q, points p) QUALIFY rank <= 20"
            ),
            "hits2": _hits_sql("near"),
            "metrics2": _metric_sql("hits2"),
        },
    ),
    "bench_regression": with_views(
        f"""SELECT metric, baseline, candidate, round(candidate - baseline, 6) AS delta, round(percent, 4) AS delta_percent, CASE WHEN abs(percent) < 5 THEN 'unchanged' WHEN (metric IN {_LOWER} AND percent < 0) OR (metric NOT IN {_LOWER} AND percent > 0) THEN 'improvement' ELSE 'regression' END AS direction, true AS same_dataset
        FROM (SELECT *, CASE WHEN baseline = 0 THEN CASE WHEN candidate = baseline THEN 0.0 ELSE (candidate - baseline) / 0.01 * 100 END ELSE (candidate - baseline) / abs(baseline) * 100 END AS percent FROM both_)""",
        _RET | {
            "base": (
                f"{_MEANS} UNION ALL SELECT * FROM (VALUES ('unsupported_claim_rate', 0.2), ('cpu_time_ms', 40.0), ('peak_memory_mb', 0.0)) "
                f"v(metric, value)"
            ),
            "both_": (
                "SELECT metric, CAST(value AS DOUBLE) AS baseline, CASE WHEN metric = 'peak_memory_mb' THEN 0.5 "
                "ELSE round(CAST(value AS DOUBLE) * (1 + ((length(metric) * 7) % 21 - 10) / 100), 6) END AS candidate FROM base "
                "WHERE metric <> 'recall@1'"
            ),
        },
    ),
    "bench_latest": (
        "SELECT run_id FROM (SELECT user_id AS run_id, max(ts) AS created_at FROM events GROUP BY user_id) "
        "WHERE created_at < (SELECT max(ts) FROM events) ORDER BY created_at DESC, run_id DESC LIMIT 1"
    ),
    "bench_recommend": with_views(
        f"SELECT v.run_id, v.metric, v.value, r.advice FROM vals v JOIN rules r ON r.metric = v.metric "
        f"WHERE CASE WHEN r.bad = 'below' THEN v.value < r.threshold ELSE v.value > r.threshold END "
        f"UNION ALL SELECT DISTINCT run_id, NULL, NULL, 'all monitored metrics are within expected thresholds' FROM vals "
        f"WHERE run_id NOT IN (SELECT v.run_id FROM vals v JOIN rules r ON r.metric = v.metric "
        f"WHERE CASE WHEN r.bad = 'below' THEN v.value < r.threshold ELSE v.value > r.threshold END)",
        _ANS | _LOG | {
            "rules": f"SELECT * FROM (VALUES {_RULES}) v(metric, bad, threshold, advice)",
            "vals": (
                "SELECT run_id, 'end_to_end_latency_ms' AS metric, round(end_to_end_latency_ms * (run_id + 1) * 40, 3) AS value FROM perf "
                "UNION ALL SELECT r, 'citation_accuracy', (SELECT round(avg(citation_accuracy), 6) FROM am) FROM range(3) t(r) "
                "UNION ALL SELECT r, 'grounding_accuracy', (SELECT round(avg(grounding_accuracy), 6) FROM am) FROM range(3) t(r)"
            ),
        },
    ),
    "bench_case_table": with_views(
        "SELECT answer_id AS case_id, expected, status, CASE WHEN status = expected THEN 'OK' "
        "ELSE 'MISMATCH' END AS verdict, claims, grounded FROM stat",
        _STATUS,
    ),
    "load_cases": with_views(
        "SELECT c.query_id, c.difficulty, c.category, v.version FROM cases c JOIN (SELECT category, sha256(string_agg(sha, '' "
        "ORDER BY part)) AS version FROM (SELECT category, h[1:3] AS part, sha256(string_agg(h, '' ORDER BY h)) AS sha "
        "FROM (SELECT category, sha256(concat_ws('|', query_id, text, difficulty, document_id)) AS h FROM cases) "
        "GROUP BY category, part) GROUP BY category) v USING (category)",
        _CASES,
    ),
    "flagship": with_views(
        "SELECT * FROM metrics2 WHERE metric = 'ndcg@10'",
        {
            k: v for k, v in POOL_SQL.items() if k in ("units", "topk")
        } | {
            "pool": (
                "SELECT query_id, 'k' || ku_id AS id, rank AS pool_pos, score AS dense, 0 AS hops, CAST(NULL AS VARCHAR) AS last_type, CAST(NULL "
                "AS VARCHAR) AS last_source FROM topk"
            )
        } | {
            k: POOL_SQL[k] for k in ("terms_q", "terms_u", "scored", "ranks", "fused")
        } | {
            "hyb": "SELECT query_id, CAST(id[2:] AS BIGINT) AS ku_id, final_rank AS rank FROM fused",
            "hits2": _hits_sql("hyb"),
            "metrics2": _metric_sql("hits2"),
        },
    ),
}
