"""Unit cases of the operators' boundaries, and plain sequential statements of their rules."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidencelake.operators import checks, conversation, evaluation, evidence, freshness, graph, relations, retrieval, search, structure, units
from evidencelake.sources import files, stage


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("token", "value"),
    [
        ("4", 4),
        ("IV", 4),
        ("xii", 12),
        ("MCMXC", 1990),
        ("IIII", 4),
        ("IC", 99),
        ("VIIII", 9),
        ("VX", 5),
        ("IIX", 8),
        ("XIIX", 18),
        ("abc", None),
        ("", None),
        ("X1", None),
        ("99999999999", None),
    ],
)
def test_numbers(spark, token, value):
    assert one(spark, relations.parse_number(F.lit(token))) == value


@pytest.mark.parametrize(
    ("title", "role"),
    [
        ("1. Abstract:", "abstract"),
        ("Bibliography", "references"),
        ("7.2 REFERENCES", "references"),
        ("Abstract thoughts", "section"),
        ("", "section"),
    ],
)
def test_heading_roles(spark, title, role):
    assert one(spark, structure.heading_role(F.lit(title))) == role


def plain_merge(words, least=4):
    done, pending = [], []
    for k, w in enumerate(words):
        pending.append(k)
        if sum(words[i] for i in pending) >= least:
            done.append(pending)
            pending = []
    if pending:
        if done:
            done[-1] = done[-1] + pending
        else:
            done.append(pending)
    return done


def plain_split(sentences, most):
    parts, now, n = [], [sentences[0]], len(sentences[0].split())
    for s in sentences[1:]:
        w = len(s.split())
        if n + w > most:
            parts.append(" ".join(now))
            now, n = [now[-1], s], len(now[-1].split()) + w
        else:
            now.append(s)
            n += w
    return [*parts, " ".join(now)]


def test_merge_and_split_equal_their_sequential_rules(spark):
    random.seed(1)
    runs = [[random.randint(0, 6) for _ in range(random.randint(1, 9))] for _ in range(150)]
    rows = [(r, 0, 5, p, " ".join(["w"] * n)) for r, run in enumerate(runs) for p, n in enumerate(run)]
    out = units.merge_tiny(spark.createDataFrame(rows, "doc_id int, run int, section_pos int, pos int, text string")).collect()
    for r, run in enumerate(runs):
        own = sorted((x["block"], x["first_pos"], x["n_paragraphs"]) for x in out if x["doc_id"] == r)
        assert own == [(k, b[0], len(b)) for k, b in enumerate(plain_merge(run))]
    texts = [
        [" ".join(["w"] * random.randint(1, 7)) + random.choice(".!?") for _ in range(random.randint(1, 12))] for _ in range(120)
    ] + [["w " * 30 + "end."]]
    parts = units.split_oversized(
        spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id int, text string"),
        ("doc_id",),
        max_words=10,
    ).collect()
    for k, t in enumerate(texts):
        assert [x["text"] for x in sorted(parts, key=lambda x: x["part"]) if x["doc_id"] == k] == plain_split(t, 10)
    assert units.split_oversized(spark.createDataFrame([(1, " "), (2, None)], "doc_id int, text string"), ("doc_id",)).count() == 0


def plain_expand(seeds, near, degree, depth=2, most_evidence=50, most_cost=500):
    visited, frontier, found, cost = set(seeds), list(seeds), [], 0
    for _ in range(depth):
        if not frontier or len(found) >= most_evidence or cost >= most_cost:
            break
        following = []
        for node in frontier:
            if len(found) >= most_evidence or cost >= most_cost:
                break
            cost += degree.get(node, 0)
            for n in near.get(node, []):
                if n in visited:
                    continue
                if len(found) >= most_evidence:
                    break
                visited.add(n)
                if n.startswith("k"):
                    found.append(n)
                following.append(n)
        frontier = following
    return found, cost


@pytest.mark.parametrize(("evidence_budget", "cost_budget"), [(50, 500), (5, 500), (50, 12), (3, 9)])
def test_expansion_equals_the_traversal(spark, evidence_budget, cost_budget):
    random.seed(evidence_budget * 1000 + cost_budget)
    names = [f"k{i}" for i in range(30)] + [f"s{i}" for i in range(4)] + ["d0"]
    edges = list(
        {
            (
                random.choice(names[:30]),
                random.choice(names),
                random.choice(["CITES", "NEXT", "REFERENCES", "BELONGS_TO", "CONTINUES"]),
            ) for _ in range(80)
        }
    )
    adjacent = graph.adjacency(spark.createDataFrame(edges, "src string, dst string, type string"), 4)
    near, degree = {}, {}
    for r in adjacent.orderBy("node", "place").collect():
        near.setdefault(r["node"], []).append(r["neighbor"])
        degree[r["node"]] = r["degree"]
    seeds = [(q, f"k{(q * 7 + i * 3) % 30}", i + 1) for q in range(6) for i in range(4)]
    found, cost = graph.expand(
        spark.createDataFrame(seeds, "query_id long, id string, rank int"),
        adjacent,
        most_evidence=evidence_budget,
        most_cost=cost_budget,
    )
    got = {}
    for r in found.orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    costs = {r["query_id"]: r["cost"] for r in cost.collect()}
    for q in range(6):
        wanted, spent = plain_expand([s for a, s, _ in seeds if a == q], near, degree, most_evidence=evidence_budget, most_cost=cost_budget)
        assert got.get(q, []) == wanted and costs[q] == spent


def test_vector_topk(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(40, 5)), 3)
    v[3] = 0
    points = spark.createDataFrame([(k, k % 2, x.tolist()) for k, x in enumerate(v)], "ku_id long, document_id long, vector array<double>")
    questions = points.where("ku_id < 4").select(F.col("ku_id").alias("query_id"), "document_id", "vector")
    with np.errstate(all="ignore"):
        cosine = np.nan_to_num(v @ v.T / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1)))
    for metric, score in (("cosine", -cosine), ("dot", -(v @ v.T)), ("euclid", np.linalg.norm(v[:, None] - v[None], axis=2))):
        for scoped in (True, False):
            run = search.topk_scoped if scoped else search.topk_all
            got = {}
            for r in run(questions, points, 6, metric).orderBy("query_id", "rank").collect():
                got.setdefault(r["query_id"], []).append(r["ku_id"])
            for q in range(4):
                pool = [k for k in range(40) if not scoped or k % 2 == q % 2]
                assert got[q] == sorted(pool, key=lambda k: (round(score[q, k], 6) + 0.0, k))[:6]
    with pytest.raises(ValueError, match="more than 2"):
        search.topk_all(questions, points, max_queries=2)
    assert search.topk_all(questions.where("false"), points).count() == 0


def test_any_number_of_questions_is_asked_in_blocks(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(60, 5)), 3)
    points = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "ku_id long, vector array<double>").repartition(3)
    questions = points.where("ku_id < 47").select(F.col("ku_id").alias("query_id"), "vector").repartition(5)
    for block in (1, 7, 46, 47):
        got = {}
        for r in search.topk_all(questions, points, 6, "dot", block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["ku_id"])
        assert got == {q: sorted(range(60), key=lambda k: (-round(float(v[q] @ v[k]), 6) + 0.0, k))[:6] for q in range(47)}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_index_finds_the_true_neighbours(spark, sf):
    points = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("ku_id"), F.col("embedding").alias("vector"))
    questions = points.where("ku_id % 25 = 0").select(F.col("ku_id").alias("query_id"), "vector")
    true = {(r["query_id"], r["ku_id"]) for r in search.topk_all(questions, points).collect()}
    found = {(r["query_id"], r["ku_id"]) for r in search.topk_ann(questions, points).collect()}
    assert len(found) == len(true) == 20 * questions.count()
    assert len(true & found) >= 0.9 * len(true)


def test_index_fills_questions_with_few_candidates(spark):
    rng = np.random.default_rng(3)
    points = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(rng.normal(size=(50, 8)))], "ku_id long, vector array<double>")
    questions = points.where("ku_id < 5").select(F.col("ku_id").alias("query_id"), "vector")
    one_each = search.Cells(np.array([x["vector"] for x in points.collect()]), 1, np.ones(50, np.int64))
    got = search.topk_ann(questions, points, 20, cells=one_each).orderBy("query_id", "rank").collect()
    assert got == search.topk_all(questions, points, 20).orderBy("query_id", "rank").collect()
    assert search.topk_ann(questions, points, 60).count() == 5 * 50
    assert search.topk_ann(questions, points.where("false")).count() == 0 == search.topk_ann(questions.where("false"), points).count()


@pytest.mark.parametrize("part_bytes", [32 << 20, 4096])
def test_index_compares_few_pairs_where_vectors_cluster(spark, part_bytes):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    vectors = centres[np.arange(4000) % 40] + 0.15 * rng.normal(size=(4000, 16))
    rows = [(k, x.tolist()) for k, x in enumerate(vectors)]
    points = spark.createDataFrame([*rows, (9999, None), (None, rows[0][1])], "ku_id long, vector array<double>").repartition(3)
    questions = spark.createDataFrame([*rows[::80], (None, rows[1][1]), (77, None)], "query_id long, vector array<double>")
    cells = search.fit_cells(points, part_bytes=part_bytes)
    assert cells.probes <= 0.15 * len(cells.centroids) and (cells.parts.max() > 1) == (part_bytes < 1 << 20)
    true = {(r["query_id"], r["ku_id"]) for r in search.topk_all(questions, points).collect()}
    found = {(r["query_id"], r["ku_id"]) for r in search.topk_ann(questions, points, cells=cells).collect()}
    assert len(found) == len(true) == 20 * 50 and len(true & found) >= 0.9 * len(true)


def test_vectors_of_unequal_lengths_are_an_error(spark):
    points = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0]), (3, [1.0, 2.0])], "ku_id long, vector array<double>").coalesce(1)
    for run in (search.topk_all, search.topk_ann):
        with pytest.raises(Exception, match="components"):
            run(points.where("ku_id = 3").withColumnRenamed("ku_id", "query_id"), points).collect()


def test_stored_objects_do_not_grow_with_their_document(spark):
    units = spark.range(1000).select(
        F.lit(7).alias("document_id"),
        F.col("id").cast("string").alias("id"),
        F.col("id").cast("int").alias("order"),
        F.lit("text").alias("modality"),
    )
    packed = stage.pack_units(units)
    assert packed.agg(F.max(F.size("chunks")), F.sum("count")).first() == (stage.PART, 1000)
    assert stage.unpack_units(packed).orderBy("order").collect() == units.withColumn("document_id", F.lit("7")).orderBy("order").collect()


def test_checksums_are_hashes_of_the_hashes_of_parts(spark):
    """A key's lines are hashed with those of the same first three digits, then the parts."""
    rows = [(k if (k := n % 3) else None, f"v{n * n % 4100}") for n in range(9000)] + [(5, None)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    hashes, parts = {}, {}
    for key, value in rows:
        line = sha(value or "~")
        hashes.setdefault(key, []).append(line)
        parts.setdefault(key, {}).setdefault(line[:3], []).append(line)
    wanted = {k: sha("".join(sha("".join(sorted(own))) for _, own in sorted(x.items()))) for k, x in parts.items()}
    df = spark.createDataFrame(rows, "document_id long, v string").repartition(5)
    hashed, listed = files.content_hash(df, "document_id", ["v"]), freshness.manifests({"s": (df, "v")})
    assert {r["document_id"]: r["version"] for r in hashed.collect()} == wanted
    assert {r["document_id"]: (r["rows"], r["checksum"]) for r in listed.collect()} == {k: (len(hashes[k]), x) for k, x in wanted.items()}
    assert files.content_hash(df.where("false"), "document_id", ["v"]).count() == 0


def test_a_failing_embedder_gives_rows_not_a_failed_job(spark):
    rows = spark.createDataFrame([("a", ), (None,), ("bad",)], "text string").coalesce(1)

    def embedder(texts):
        if "bad" in texts:
            raise ValueError("no")
        return np.ones((len(texts), 3))

    out = search.embed_batch(rows, "text", embedder, batch=1).collect()
    assert [r["error"] for r in out] == [None, None, "ValueError: no"]
    assert abs(sum(x * x for x in out[0]["vector"]) - 1) < 1e-9 and out[2]["vector"] is None


@pytest.mark.parametrize(
    ("answer", "failed"),
    [
        (lambda texts: np.ones((len(texts) - 1, 3)), 40),
        (lambda texts: np.ones(len(texts)), 40),
        (lambda texts: np.ones((len(texts), 0)), 40),
        (lambda texts: [[1.0, float("nan") if t == "t7" else 1e300] for t in texts], 1),
        (lambda texts: np.ones((len(texts), 2 if "t7" in texts else 3)), 1),
        (lambda texts: 1 / 0 if "t7" in texts else np.ones((len(texts), 2)), 1),
        (lambda texts: 1 / 0 if {"t7", "t8", "t39"} & set(texts) else np.ones((len(texts), 2)), 3),
    ],
)
def test_wrong_answers_of_an_embedder_are_failed_rows(spark, answer, failed):
    rows = spark.createDataFrame([(f"t{39 - k}",) for k in range(40)], "text string").coalesce(1)
    out = search.embed_batch(rows, "text", answer, backoff=0).collect()
    assert len(out) == 40 and sum(r["vector"] is None for r in out) == failed == sum(r["error"] is not None for r in out)
    assert all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-9 for r in out if r["vector"])


def test_attempts_wait_longer_each_time(monkeypatch):
    waits, calls = [], []
    monkeypatch.setattr(search.time, "sleep", waits.append)

    def late(texts):
        calls.append(len(texts))
        return np.ones((len(texts), 2)) if len(calls) == 3 else 1 / 0

    assert all(e is None for _, e in search._Attempts(late, 3, 0.5)(["a", "b"])) and waits == [0.5, 1.0] and calls == [2, 2, 2]


def test_questions_without_terms_and_missing_signals(spark):
    assert one(spark, retrieval.lexical(F.lit(None).cast("string"), F.lit("water"), F.lit("what is the"))) == 0
    assert one(spark, retrieval.lexical(F.lit("cold"), F.lit("water"), F.lit("Cold WATER stone now"))) == 0.5
    rows = [(1, "a", 1, 0.9, 0.0, 4.0, 1.0), (1, "b", 2, None, 0.5, 1.0, 0.5), (1, "c", 3, None, 0.5, 2.0, 0.5)]
    df = spark.createDataFrame(rows, "query_id long, id string, pool_pos int, dense double, lexical double, confidence double, proximity double")
    ranks = {(r["id"], r["signal"]): (r["value"], r["rank"]) for r in retrieval.signal_ranks(df).collect()}
    assert ranks[("b", "dense")] == ranks[("c", "dense")] == (0.0, 2) and ranks[("b", "lexical")][1] == ranks[("c", "lexical")][1] == 1


def test_a_candidate_its_bucket_shut_out_may_still_support(spark):
    rows = [(1, "a", 1, None, 9), (1, "b", 2, None, 9), (1, "c", 3, "d", 9), (1, "d", 4, None, 8)]
    df = spark.createDataFrame(
        rows,
        "query_id long, id string, final_rank int, last_source string, section_id long",
    ).withColumn("context", F.lit(None).cast("string"))
    groups = {(r["group_rank"], r["member_pos"]): r["id"] for r in retrieval.assemble(df).collect()}
    assert groups == {(1, 0): "a", (2, 0): "b", (3, 0): "d", (3, 1): "c"}
    assert [(r["id"], r["reason"]) for r in retrieval.dropped(df).collect()] == [("c", "bucket full")]


@pytest.mark.parametrize(
    ("text", "labels"),
    [("x [KU1]. (KU4, KU8) [KU2; KU3 and KU4]", "KU1 KU4 KU8 KU2 KU3 KU4"), ("(Doe, 2021) KU5 [KU1 x]", ""), ("", "")],
)
def test_citation_grammar(spark, text, labels):
    assert " ".join(one(spark, evidence.citation_labels(F.lit(text)))) == labels


def test_verdicts(spark):
    shown = spark.createDataFrame(
        [("x", "KU1", "Figure 2", "cold water under stone"), ("x", "KU2", None, None)],
        "answer_id string, label string, context string, text string",
    )
    said = ["The cold water [KU1].", "Nothing cited here.", "Cold [KU9].", "Warm summer garden [KU1].", "It is [KU2]. ok"]
    claims = spark.createDataFrame([("x", k, t) for k, t in enumerate(said)], "answer_id string, claim int, text string")
    got = {r["claim"]: r["verdict"] for r in evidence.verdicts(claims, shown).collect()}
    assert [got[k] for k in range(4)] == ["grounded", "missing_citation", "unresolved_citation", "unsupported"]


def test_answer_without_citations_or_claims(spark):
    answers = spark.createDataFrame([("x", 1, "ok")], "answer_id string, query_id long, text string")
    nothing = spark.createDataFrame(
        [],
        "answer_id string, n int, label string, ku_id string, ratio double, query_id long, dense double, modality string",
    )
    plans = spark.createDataFrame([(1, 1, None)], "query_id long, required_groups int, required_modality string")
    r = evidence.quality(
        answers,
        nothing.select("query_id", "dense"),
        plans,
        nothing.select("query_id", "modality"),
        nothing.select("answer_id", "ratio"),
        nothing.select("answer_id", "ku_id"),
    ).first()
    assert (r["retrieval"], r["ratio"], r["coverage"], r["completeness"], r["status"]) == (0, 0, 1, 0.5, "insufficient")


def test_metrics_at_their_borders(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1)], "query_id long, ku_id long, rank int")
    relevant = spark.createDataFrame([(1, 11), (1, 12), (1, 99)], "query_id long, ku_id long")
    m = {
        (r["query_id"], r["metric"]): r["value"] for r in evaluation.retrieval_metrics(
            ranked,
            relevant,
            spark.createDataFrame([(1,), (2,)], "query_id long"),
        ).collect()
    }
    assert m[(1, "precision@5")] == 0.4 and m[(1, "recall@3")] == 0.666667 and m[(1, "mrr")] == 0.5 and m[(1, "hit_rate@1")] == 0
    assert m[(1, "ndcg@3")] == round((1 / np.log2(3) + 1 / np.log2(4)) / (1 + 1 / np.log2(3) + 1 / np.log2(4)), 6)
    assert m[(2, "recall@1")] is None and m[(2, "mrr")] == 0 and m[(2, "ndcg@10")] == 0


def test_regression_against_a_zero_baseline(spark):
    runs = lambda *v: spark.createDataFrame([(m, x, "v1") for m, x in v], "metric string, value double, dataset_version string")
    got = {
        r["metric"]: (r["delta_percent"], r["direction"]) for r in evaluation.regression(
            runs(("a", 0.0), ("b", 1.0), ("cpu_time_ms", 10.0), ("gone", 1.0)),
            runs(("a", 0.001), ("b", 1.04), ("cpu_time_ms", 9.0)),
        ).collect()
    }
    assert got == {"a": (10.0, "improvement"), "b": (4.0, "unchanged"), "cpu_time_ms": (-10.0, "improvement")}


def test_stale_reasons_and_force(spark):
    sources = spark.createDataFrame([(1, "h"), (2, "h"), (3, None)], "document_id long, source_hash string")
    old = spark.createDataFrame([(1, "m", "v", "h"), (3, "m", "v", None)], "document_id long, model string, version string, source_hash string")
    assert {
        r["document_id"]: r["reason"] for r in freshness.stale_documents(sources, old, "m", "v").collect()
    } == {1: None, 2: "no_manifest", 3: None}
    assert {r["reason"] for r in freshness.stale_documents(sources, old, "m", "v", force=True).collect()} == {"forced"}


def test_tokens_join_to_the_text(spark):
    texts = ["a [KU1] b (KU4, KU8) c", "[x-1][KU2]", "", "(KU1)", "KU5[a]KU6", "no [spaced label]"]
    rows = conversation.answer_tokens(
        spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "answer_id int, text string")
    ).orderBy("answer_id", "n").collect()
    for k, t in enumerate(texts):
        assert "".join(r["value"] for r in rows if r["answer_id"] == k) == t
    assert [r["value"] for r in rows if r["kind"] == "citation"] == ["[KU1]", "KU4", "KU8", "[x-1]", "[KU2]", "KU1", "[a]"]


def test_overlaps_of_all_pairs_in_parts(spark):
    words = ["red", "the", "ox", "Sea-mill", "x1 x2", "of", None]
    units = [(k, k % 3 if k % 17 else None, words[k % 7], " ".join(w for w in words[k % 5 : k % 5 + k % 4] if w) if k % 6 else None) for k in range(90)]
    asked = [(k, k % 4 if k % 11 else None, " ".join(w for w in words[k % 6 : k % 6 + 3] if w) if k % 5 else None) for k in range(40)]
    units = spark.createDataFrame([*units, units[4]], "ku_id long, document_id int, context string, text string")
    asked = spark.createDataFrame([*asked, (99, 1, "of the"), (99, 1, "OX sea zebra")], "query_id string, document_id int, text string")
    score = F.round(retrieval.lexical(F.col("context"), F.col("text"), F.col("question")), 6)
    pairs = asked.withColumnRenamed("text", "question").join(units, "document_id").select("query_id", "ku_id", score.alias("overlap"))
    expected = sorted(tuple(r) for r in pairs.collect())
    assert len({x[2] for x in expected}) > 4
    for part in (1024, 5):
        assert sorted(tuple(r) for r in retrieval.overlaps(asked, units, part).collect()) == expected
    assert retrieval.overlaps(asked, units.where("false")).count() == 0 == retrieval.overlaps(asked.where("false"), units).count()


def test_lexical_topk_equals_brute_force(spark):
    random.seed(6)
    words = ["common", "usual"] + [f"w{k}" for k in range(40)]
    units_ = [
        (
            k,
            random.choice([None, "Section"]),
            " ".join([*random.sample(words[:2], random.choice([0, 1, 2, 2, 2])), *random.sample(words[2:], random.choice([0, 0, 3]))]),
        ) for k in range(300)
    ]
    asked = [
        (q, " ".join(random.sample(words, 4)) + " the of") for q in range(40)
    ] + [(90, "common usual"), (91, "the of"), (92, None), (93, "unknown")]
    wanted = {}
    for q, text in asked:
        own = set((text or "").split()) - {"the", "of"}
        scored = sorted((-round(len(own & set(f"{c or ''} {x}".lower().split())) / len(own), 6), k) for k, c, x in units_) if own else []
        wanted[q] = [(k, -s) for s, k in scored if s < 0][:7]
    questions, units = spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(
        [*units_, (None, None, "common")],
        "ku_id long, context string, text string",
    )
    for block in (5, 20_000):
        got = {q: [] for q, _ in asked}
        for r in retrieval.lexical_topk(questions, units, 7, block=block).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["ku_id"], r["score"]))
        assert got == wanted
    assert retrieval.lexical_topk(questions, units.where("false")).count() == 0 == retrieval.lexical_topk(questions.where("false"), units).count()


def plain_tree(levels):
    """Parent of each heading by popping a stack."""
    stack, out = [], []
    for k, level in enumerate(levels):
        while stack and stack[-1][0] >= (level or 1):
            stack.pop()
        out.append(stack[-1][1] if stack else None)
        stack.append((level or 1, k))
    return out


def test_a_merge_shuffles_the_changes_only(spark, tmp_path, monkeypatch):
    old = [(k, k % 7, "old", 1) for k in range(500)] + [(None, 1, "old", 1)]
    schema = "id long, document_id long, state string, version int"
    spark.createDataFrame(old, schema).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    changes = spark.createDataFrame([(3, 3, "new", 2), (4, 4, "late", 0), (900, 1, "new", 2), (None, 1, "new", 2)], schema)
    wanted = {k: "old" for k in range(500)} | {3: "new", 900: "new", None: "new"}
    for most in (64 << 20, 0):
        monkeypatch.setattr(search, "sent", lambda keys, most=most: stage.sent(keys, most))
        out = search.upsert(table, changes, "id", "version")
        assert sorted(((r["id"], r["state"]) for r in out.collect()), key=str) == sorted(wanted.items(), key=str)
    plan = graph.replace(table, changes, ("id",))._jdf.queryExecution().executedPlan().toString()
    stays = plan[: plan.index("Aggregate")]  # the rows that stay come first in the union
    assert "BroadcastHashJoin" in stays and "hashpartitioning" not in stays and "SortMergeJoin" not in plan
    assert sorted(((r["id"], r["state"]) for r in graph.replace(table, changes, ("id",)).collect()), key=str) == sorted(
        [(k, "old") for k in range(500) if k % 7 not in (1, 3, 4)] + [(3, "new"), (4, "late"), (900, "new"), (None, "new")], key=str
    )


def test_lexical_topk_by_bytes_and_bounds(spark, monkeypatch):
    """Blocks of some bytes, terms that all units have, ties at the last place."""
    rng = random.Random(6)
    words = [f"t{k}" for k in range(60)] + ["common"]
    units = [(k, "", " ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) + " common") for k in range(900)]
    asked = [(q, " ".join({rng.choice(words) for _ in range(rng.randint(1, 9))})) for q in range(70)]
    u = spark.createDataFrame(units, "ku_id long, context string, text string").repartition(3)
    q = spark.createDataFrame(asked, "query_id long, text string")
    wanted = {}
    for n, text in asked:
        own = set(text.split())
        score = sorted((-round(len(own & set(t.split())) / len(own), 6), k) for k, _, t in units if own & set(t.split()))
        wanted[n] = [k for _, k in score[:5]]
    for most in (64 << 20, 3000):
        monkeypatch.setattr(retrieval, "BLOCK_BYTES", most)
        got = {}
        for r in retrieval.lexical_topk(q, u, 5).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["ku_id"])
        assert got == wanted


def test_questions_in_blocks_of_bytes(spark, monkeypatch):
    v = np.round(np.random.default_rng(2).normal(size=(60, 5)), 3)
    points = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "ku_id long, vector array<double>").repartition(3)
    questions = points.where("ku_id < 47").select(F.col("ku_id").alias("query_id"), "vector")
    whole = search.topk_all(questions, points, 6).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(search, "BLOCK_BYTES", 1500)
    assert search.topk_all(questions, points, 6).orderBy("query_id", "rank").collect() == whole


def test_section_tree_of_any_level_and_depth(spark):
    random.seed(7)
    docs = {
        d: [random.choice([None, 1, 2, 3, 7, 8, 40]) for _ in range(25)] for d in range(20)
    } | {50: [1, 6, 7, 8], 51: list(range(1, 60)), 52: [None]}
    heads = spark.createDataFrame(
        [(d, k, level, "t") for d, levels in docs.items() for k, level in enumerate(levels)],
        "doc_id long, pos int, level int, text string",
    )
    tree = structure.section_tree(heads)
    rows = tree.collect()
    parents = {d: plain_tree(levels) for d, levels in docs.items()}
    for r in rows:
        assert r["parent_pos"] == parents[r["doc_id"]][r["pos"]]
        assert r["ord"] == sum(p == r["parent_pos"] for p in parents[r["doc_id"]][: r["pos"]])
        path = [r["pos"]]
        while parents[r["doc_id"]][path[0]] is not None:
            path.insert(0, parents[r["doc_id"]][path[0]])
        assert r["path"] == path
    assert len(rows) == heads.count()
    # paths of any source, by sibling orders, sort alike
    by_order = {(r["doc_id"], r["pos"]): r["path"] for r in structure.section_paths(tree.drop("path")).collect()}
    assert len(by_order) == len(rows)
    for d in docs:
        own = [r for r in rows if r["doc_id"] == d]
        assert sorted(own, key=lambda r: r["path"]) == sorted(own, key=lambda r: by_order[(d, r["pos"])])
    cycle = spark.createDataFrame([(1, 0, None, 0), (1, 1, 2, 0), (1, 2, 1, 0), (1, 3, 99, 0)], "doc_id long, pos int, parent_pos int, ord int")
    assert [r["pos"] for r in structure.section_paths(cycle).collect()] == [0]


def test_many_headings_of_one_document(spark):
    """Time in proportion: 200,000 headings of a document, whose batches the stack outlives."""
    heads = spark.range(200_000).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("pos"), (1 + F.col("id") % 7).cast("int").alias("level"), F.lit("x").alias("text"))
    start = time.time()
    assert structure.section_tree(heads).where("(pos % 7 = 0 and parent_pos is null) or (pos % 7 > 0 and parent_pos = pos - 1 and size(path) = 1 + pos % 7)").count() == 200_000
    modes = structure.special_sections(heads.withColumn("kind", F.lit("heading")).withColumn("text", F.when(F.col("pos") % 7 == 2, "References").otherwise("x")))
    assert modes.groupBy("mode").count().where("mode = 'references'").first()["count"] == sum(k % 7 == 2 for k in range(200_000))
    assert time.time() - start < 60


def test_headings_without_level_are_of_level_one(spark):
    rows = [
        (1, 0, "heading", None, "Abstract"),
        (1, 1, "paragraph", None, "a"),
        (1, 2, "heading", 2, "deeper"),
        (1, 3, "heading", None, "Intro"),
        (1, 4, "paragraph", None, "b"),
    ]
    out = structure.special_sections(spark.createDataFrame(rows, "doc_id long, pos int, kind string, level int, text string"))
    assert [r["mode"] for r in out.orderBy("pos").collect()] == ["abstract", "abstract", "dropped", "body", "body"]


@pytest.mark.parametrize(
    ("text", "numbers"),
    [("Figure 2a shows", [2]), ("fig. iv, Table 12", [4, 12]), ("Tables 3", []), ("Figure IVth", []), ("TABLE IIII.", [4])],
)
def test_mentions(spark, text, numbers):
    captions = spark.createDataFrame(
        [(1, kind, n * 10 + k, f"{kind.title()} {n} x") for k, kind in enumerate(("table", "figure")) for n in (2, 3, 4, 12)],
        "doc_id long, subject_type string, subject_pos int, text string",
    )
    edges = relations.edges_references(
        spark.createDataFrame([(1, 0, text)], "doc_id long, pos int, text string"),
        relations.printed_numbers(captions),
    )
    assert sorted(r["target_pos"] // 10 for r in edges.collect()) == sorted(numbers)


def test_visuals_with_several_captions_are_one_unit_each(spark):
    items = spark.createDataFrame(
        [(1, 3, "table", "a b"), (1, 5, "figure", None), (1, 7, "table", None), (1, 8, "paragraph", "x")],
        "doc_id long, pos int, kind string, text string",
    )
    captions = spark.createDataFrame(
        [(1, 3, "table", "Table 9 z"), (1, 3, "table", "Table 2 y"), (1, 5, "figure", "Fig. IX w"), (1, 7, "figure", "Figure 4")],
        "doc_id long, subject_pos int, subject_type string, text string",
    )
    numbers = relations.printed_numbers(captions)
    out = units.visual_units(items, captions, ("table", "figure"), numbers, F.when(F.col("kind") == "table", F.col("text")), ("kind",))
    assert sorted(tuple(r) for r in out.collect()) == [
        (1, 3, "Table 2 y\n\na b", "Table 2", "table"),
        (1, 5, "Fig. IX w", "Figure 9", "figure"),
        (1, 7, "Untitled table", "Table", "table"),
    ]
    alone = units.visual_units(items, captions, "table", numbers)
    assert alone.columns == ["doc_id", "pos", "text", "context"]
    assert sorted(r["text"] for r in alone.collect()) == ["Table 2 y", "Untitled table"]


def test_checks_of_papers(spark):
    papers = spark.createDataFrame([(k,) for k in range(1, 6)], "document_id long")
    chain = [(1, k, k - 1 if k else None) for k in range(300)]  # deep, but no cycle
    sections = [*chain, *chain[:50], (2, 0, 1), (2, 1, 0), (2, 2, 1), (2, 3, None), (3, 0, None), (4, 5, 77)]
    sections = spark.createDataFrame(sections, "document_id long, id long, parent long")
    children = spark.createDataFrame([(2, 9, 2)], "document_id long, id long, paper_id long")
    captions = spark.createDataFrame([(2, "table", 9), (2, "figure", 8)], "document_id long, kind string, id long")
    visuals = spark.createDataFrame([(2, "figure", 9), (2, "figure", 8)], "document_id long, kind string, id long")
    got = sorted((r["document_id"], r["rule"], r["id"]) for r in checks.check_papers(papers, sections, children, captions, visuals).collect())
    assert got == sorted(
        [
            ("5", "empty_paper", None),
            ("4", "unknown_parent", "5"),
            *(("2", "section_cycle", str(k)) for k in range(3)),
            ("2", "caption_without_subject", "9"),
            ("2", "uncaptioned_visual", "9"),
        ],
        key=lambda x: (x[0], x[1], x[2] or ""),
    )
