"""Retrieval and answer metrics, benchmark aggregates and run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)
DEAD_BAND, ZERO_BASELINE = 5.0, 0.01
#: Metrics of which less is better.
LOWER_IS_BETTER = (
    "unsupported_claim_rate",
    "retrieval_latency_ms",
    "generation_latency_ms",
    "end_to_end_latency_ms",
    "peak_memory_mb",
    "cpu_time_ms",
)
#: Metric, whether it is bad below or above, threshold, advice.
RULES = (
    ("failed_cases", "above", 0.0, "investigate failed cases before trusting the results"),
    ("grounding_accuracy", "below", 0.7, "review grounding rules and context"),
    ("unsupported_claim_rate", "above", 0.3, "many claims lack support"),
    ("answer_status_accuracy", "below", 0.8, "review answer planning and quality thresholds"),
    ("citation_accuracy", "below", 0.7, "citation labels may be invented or mistyped"),
    ("end_to_end_latency_ms", "above", 15000.0, "answers are slow"),
)


def _hits(ranked: DataFrame, relevant: DataFrame, cases: DataFrame) -> DataFrame:
    """One row a case: ranks of its hits, and the number of relevant units."""
    hit = ranked.join(relevant, ["query_id", "ku_id"]).groupBy("query_id").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    count = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    rows = cases.select("query_id").join(count, "query_id", "left").join(hit, "query_id", "left")
    return rows.select(
        "query_id",
        F.coalesce("relevant", F.lit(0)).alias("relevant"),
        F.coalesce("ranks", F.array().cast("array<int>")).alias("ranks"),
    )


def _within(k: int) -> Column:
    return F.size(F.filter("ranks", lambda r: r <= k))


def precision(k: int) -> Column:
    return _within(k) / F.lit(k)


def recall(k: int) -> Column:
    """Null where nothing is relevant: such a case is an error."""
    return F.when(F.col("relevant") > 0, _within(k) / F.col("relevant"))


def hit_rate(k: int) -> Column:
    return (_within(k) > 0).cast("double")


def mrr() -> Column:
    return F.coalesce(1 / F.array_min("ranks"), F.lit(0.0))


def ndcg(k: int) -> Column:
    gain = lambda ranks: F.aggregate(ranks, F.lit(0.0), lambda a, r: a + 1 / F.log2(r + F.lit(1.0)))
    ideal = gain(F.sequence(F.lit(1), F.greatest(F.least("relevant", F.lit(k)), F.lit(1)).cast("int")))
    return F.when(F.col("relevant") > 0, gain(F.filter("ranks", lambda r: r <= k)) / ideal).otherwise(0.0)


METRICS = {"precision": precision, "recall": recall, "hit_rate": hit_rate, "ndcg": ndcg}


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, cases: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Long form: query_id, metric ('precision@5', .. and 'mrr'), value (null: error)."""
    rows = _hits(ranked, relevant, cases)
    each = [F.struct(F.lit(f"{name}@{k}").alias("metric"), F.round(f(k), 6).alias("value")) for name, f in METRICS.items() for k in ks]
    each.append(F.struct(F.lit("mrr").alias("metric"), F.round(mrr(), 6).alias("value")))
    return rows.select("query_id", F.explode(F.array(*each)).alias("m")).select("query_id", "m.*")


def answer_metrics(rows: DataFrame) -> DataFrame:
    """Rows (case_id, resolved, unresolved, grounded, total, cited, expected) with
    citation_accuracy, grounding_accuracy, unsupported_rate (both null without claims),
    answer_completeness and evidence_coverage."""
    cites = F.col("resolved") + F.col("unresolved")
    common = F.size(F.array_intersect("cited", "expected"))
    claims = F.when(F.col("total") > 0, F.col("total"))
    return rows.select(
        "case_id",
        F.round(F.when(cites > 0, F.col("resolved") / cites).otherwise(1.0), 6).alias("citation_accuracy"),
        F.round(F.col("grounded") / claims, 6).alias("grounding_accuracy"),
        F.round((F.col("total") - F.col("grounded")) / claims, 6).alias("unsupported_rate"),
        F.round(F.when(F.size("expected") > 0, common / F.size("expected")).otherwise(1.0), 6).alias("answer_completeness"),
        F.round(F.when(F.size("cited") > 0, common / F.size("cited")).otherwise(0.0), 6).alias("evidence_coverage"),
    )


def mean_by(metrics: DataFrame, *keys: str) -> DataFrame:
    """Means of (metric, value) over cases, errors left out."""
    return metrics.groupBy(*keys, "metric").agg(F.round(F.avg("value"), 6).alias("value"))


def breakdown(metrics: DataFrame) -> DataFrame:
    """Means of all cases, by difficulty and by category: grouping, name, metric, value."""
    sets = metrics.groupingSets([["metric"], ["metric", "difficulty"], ["metric", "category"]], "metric", "difficulty", "category")
    rows = sets.agg(F.round(F.avg("value"), 6).alias("value"), F.grouping("difficulty").alias("gd"), F.grouping("category").alias("gc"))
    grouping = F.when(F.col("gd") == 0, "difficulty").when(F.col("gc") == 0, "category").otherwise("all")
    return rows.select(
        grouping.alias("grouping"),
        F.coalesce(F.when(F.col("gd") == 0, F.col("difficulty")), F.when(F.col("gc") == 0, F.col("category")), F.lit("all")).alias("name"),
        "metric",
        "value",
    )


def performance(log: DataFrame) -> DataFrame:
    """Run log (run_id, retrieval_ms, generation_ms, memory_mb, cpu_ms) to one row a run: mean
    latencies, largest memory, mean CPU, and cases a second."""
    total = F.col("retrieval_ms") + F.col("generation_ms")
    r = lambda c, name: F.round(c, 4).alias(name)
    return log.groupBy("run_id").agg(
        r(
            F.avg("retrieval_ms"),
            "retrieval_latency_ms",
        ), r(
            F.avg("generation_ms"),
            "generation_latency_ms",
        ), r(F.avg(total), "end_to_end_latency_ms"), r(F.max("memory_mb"), "peak_memory_mb"), r(F.avg("cpu_ms"), "cpu_time_ms"),
        r(F.when(F.sum(total) > 0, F.count(F.lit(1)) * 1000 / F.sum(total)).otherwise(0.0), "cases_per_second"),
    )


def compare_systems(aggregates: DataFrame, a: str, b: str) -> DataFrame:
    """Two systems side by side over the metrics that either has: metric, a, b."""
    side = lambda name: aggregates.where(F.col("system") == name).select("metric", F.col("value").alias(name))
    return side(a).join(side(b), "metric", "full")


def regression(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Metrics (metric, value, dataset_version) that both runs have: delta, percent of the
    baseline, direction, and whether the datasets match."""
    b = baseline.select("metric", F.col("value").alias("baseline"), F.col("dataset_version").alias("_v"))
    rows = candidate.select("metric", F.col("value").alias("candidate"), "dataset_version").join(b, "metric")
    delta = F.col("candidate") - F.col("baseline")
    percent = F.when(
        F.col("baseline") == 0,
        F.when(delta == 0, 0.0).otherwise(delta / ZERO_BASELINE * 100),
    ).otherwise(delta / F.abs("baseline") * 100)
    better = F.when(F.col("metric").isin(*LOWER_IS_BETTER), percent < 0).otherwise(percent > 0)
    direction = F.when(F.abs(percent) < DEAD_BAND, "unchanged").when(better, "improvement").otherwise("regression")
    return rows.select(
        "metric",
        "baseline",
        "candidate",
        F.round(delta, 6).alias("delta"),
        F.round(percent, 4).alias("delta_percent"),
        direction.alias("direction"),
        F.col("dataset_version").eqNullSafe(F.col("_v")).alias("same_dataset"),
    )


def latest(runs: DataFrame, before: Column) -> DataFrame:
    """The latest run (run_id, created_at) before a time: one row at most."""
    found = runs.where(F.col("created_at") < before).agg(F.max(F.struct("created_at", "run_id")).alias("r"))
    return found.select("r.run_id", "r.created_at").where("run_id is not null")


def recommend(values: DataFrame) -> DataFrame:
    """Metrics (run_id, metric, value) that break a rule, with advice; an all-clear row for a
    run that breaks none."""
    rules = values.sparkSession.createDataFrame(list(RULES), "metric string, bad string, threshold double, advice string")
    rows = values.join(F.broadcast(rules), "metric", "left")
    broken = F.when(F.col("bad") == "below", F.col("value") < F.col("threshold")).otherwise(F.col("value") > F.col("threshold"))
    hit = rows.where(broken).select("run_id", "metric", "value", "advice")
    clear = values.select("run_id").distinct().join(hit, "run_id", "left_anti")
    return hit.unionByName(
        clear.select(
            "run_id",
            F.lit(None).cast("string").alias("metric"),
            F.lit(None).cast("double").alias("value"),
            F.lit("all monitored metrics are within expected thresholds").alias("advice"),
        )
    )
