import numpy as np
import pytest
from pyspark.sql import functions as F

from evidencelake.operators import search, vector_index

POINTS, QUESTIONS = "ku_id long, vector array<double>", "query_id long, vector array<double>"


def pairs(df):
    return {(r["query_id"], r["ku_id"]) for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_stored_index_finds_the_true_neighbours(spark, tmp_path, sf):
    points = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("ku_id"), F.col("embedding").alias("vector"))
    questions = points.where("ku_id % 25 = 0").select(F.col("ku_id").alias("query_id"), "vector")
    model = vector_index.build(points, str(tmp_path))
    stored = spark.read.parquet(f"{tmp_path}/codes")
    assert stored.count() == points.count() and model.books.shape[0] == 16  # bytes of a code, of 512 of a vector
    true, out = search.topk_all(questions, points), vector_index.topk(questions, points, str(tmp_path))
    assert len(pairs(out)) == 20 * questions.count()
    assert len(pairs(true) & pairs(out)) >= 0.9 * true.count()
    exact = {(r["query_id"], r["ku_id"]): r["score"] for r in true.collect()}
    assert all(abs(exact.get((r["query_id"], r["ku_id"]), r["score"]) - r["score"]) < 2e-6 for r in out.collect())


def test_clustered_vectors_blocks_and_odd_rows(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(40, 18))[np.arange(4000) % 40] + 0.15 * rng.normal(size=(4000, 18))
    rows = [(k, x.tolist()) for k, x in enumerate(vectors)]
    points = spark.createDataFrame([*rows, (9999, None), (None, rows[0][1])], POINTS).repartition(3)
    questions = spark.createDataFrame([*rows[::80], (None, rows[1][1]), (77, None)], QUESTIONS)
    model = vector_index.build(points, str(tmp_path))
    assert model.cells.probes <= 0.15 * len(model.cells.centroids) and model.kept <= 400
    true = pairs(search.topk_all(questions, points))
    for most in (vector_index.BLOCK_BYTES, 1 << 18):
        monkeypatch.setattr(vector_index, "BLOCK_BYTES", most)
        found = pairs(vector_index.topk(questions, points, str(tmp_path)))
        assert len(found) == len(true) == 20 * 50 and len(true & found) >= 0.9 * len(true)


def test_few_points_none_and_gone(spark, tmp_path):
    points = spark.createDataFrame([(k, [float(k), 1.0, 0.0]) for k in range(9)], POINTS)
    questions = points.where("ku_id < 2").select(F.col("ku_id").alias("query_id"), "vector")
    vector_index.build(points, f"{tmp_path}/a", sample=50)
    assert pairs(vector_index.topk(questions, points, f"{tmp_path}/a")) == {(q, k) for q in (0, 1) for k in range(9)}
    assert pairs(vector_index.topk(questions, points.where("ku_id <> 3"), f"{tmp_path}/a", 8)) == {(q, k) for q in (0, 1) for k in range(9) if k != 3}
    assert vector_index.build(points.where("false"), f"{tmp_path}/b") is None
    assert vector_index.topk(questions, points.where("false"), f"{tmp_path}/b").count() == 0
    assert vector_index.topk(questions.where("false"), points, f"{tmp_path}/a").count() == 0


def test_a_search_shuffles_no_codes(spark, tmp_path):
    points = spark.createDataFrame([(k, np.random.default_rng(k).normal(size=8).tolist()) for k in range(500)], POINTS)
    model = vector_index.build(points, str(tmp_path))
    asked = points.limit(3).select(F.col("ku_id").alias("query_id"), "vector").toPandas()
    stored = spark.read.parquet(f"{tmp_path}/codes")
    plan = vector_index._candidates(asked, stored, model, 40)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "vector" not in plan


def test_candidates_are_the_best_codes_and_few_are_gathered():
    """Most points do not reach a question's floor; before, each was sorted with the best for each question."""
    rng, ids = np.random.default_rng(6), np.arange(100, 150)
    books, codes, split = rng.normal(size=(4, 16, 4)), rng.integers(0, 16, (60_000, 4)), rng.normal(size=(50, 16))
    table = np.einsum("qjw,jkw->qjk", split.reshape(50, 4, 4), books).astype(np.float32)
    score = split.astype(np.float32) @ vector_index.decoded(books.astype(np.float32), codes).T
    assert np.abs(score - vector_index.scored(table, codes)).max() < 1e-4
    best, gathered = vector_index.Reached(ids, 30), 0
    for at in range(0, 60_000, 1000):
        before = best.size
        best.show(np.arange(50), np.arange(at, at + 1000), score[:, at : at + 1000])
        gathered += max(best.size - before, 0) if at > 30_000 else 0
    assert gathered < 0.1 * 50 * 30_000
    found = best.rows().to_pandas()
    for q in range(50):
        own = np.lexsort((np.arange(60_000), -np.round(score[q].astype(float), 6)))[:30]
        assert found[found["query_id"] == ids[q]]["ku_id"].tolist() == own.tolist()
