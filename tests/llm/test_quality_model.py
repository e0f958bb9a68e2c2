import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from evidencelake.llm import quality_model, queries


def test_isotonic_pools_adjacent_violators():
    x, y = np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1])
    knots, heights = quality_model.isotonic(x, y)
    assert (np.diff(heights) >= 0).all() and set(knots) == {1, 2, 3, 4}
    fitted = np.interp(x, knots, heights)
    assert fitted[1] == fitted[2] and fitted[0] < fitted[1] < fitted[3]


def test_random_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(0)
    d = len(quality_model.STATISTICS)
    model = quality_model.Model(
        np.zeros(d),
        np.ones(d),
        rng.normal(size=(d, 4096)) / (1.5 * np.sqrt(d)),
        rng.uniform(0, 2 * np.pi, 4096),
        None,
        None,
        None,
    )
    x = rng.normal(size=(6, d))
    z = model.features(x)[:, :-1]
    wanted = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * 1.5**2 * d))
    assert np.abs(z @ z.T - wanted).max() < 0.08


def test_statistics_of_empty_texts_are_zero_and_equal_texts_agree():
    x = quality_model.statistics(pa.array(["", None, " \n", "Some words, HERE!!", "zz", "Some words, HERE!!"]))
    assert (x[:2] == 0).all() and np.isfinite(x).all() and (x[3] == x[5]).all()


def test_odd_rows_and_missing_labels(spark, odd, empty):
    assert quality_model.fit(odd, empty.select("doc_id", F.lit(1).alias("label"))) is None
    assert quality_model.fit(empty, odd.select("doc_id", F.lit(1).alias("label"))) is None
    assert {r["score"] for r in quality_model.predict(odd, None).select("score").collect()} == {0.5}
    labels = odd.select("doc_id", (F.col("doc_id") % 2).alias("label"))
    model = quality_model.fit(odd, labels)
    out = quality_model.predict(odd.withColumn("score", F.lit("x")), model)
    rows = out.select("text", "score").collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    by_text = {}
    assert all(by_text.setdefault(r["text"], r["score"]) == r["score"] for r in rows)
    assert quality_model.predict(empty, model).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op2_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(out) > 50
    assert sum(r["predicted"] == r["quality"] for r in out) >= 0.95 * len(out)


def test_weights_equal_a_dense_ridge_fit(spark):
    """The sums over partitions against one matrix of all rows that the fit keeps."""
    random.seed(1)
    words = "the of and reading water river stone light under over again never bright cold".split()
    texts = [" ".join(random.choice(words) for _ in range(random.randint(5, 60))) + random.choice([".", "!!! ***", " ABC 12"]) for _ in range(300)]
    rows = [(k, t, float("***" in t or k % 11 == 0)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label double")
    model = quality_model.fit(df.select("doc_id", "text"), df.select("doc_id", "label"), features=32)
    fold = {
        r["doc_id"]: r["f"] for r in df.select(
            "doc_id",
            (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fold")), F.lit(4)) == 0).alias("f"),
        ).collect()
    }
    x, y = quality_model.statistics(pa.array(texts)), np.array([r[2] for r in rows])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-6))
    own = np.array([not fold[k] for k in range(len(rows))])
    z = model.features(x[own])
    penalty = quality_model.RIDGE * own.sum() * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + penalty, z.T @ y[own]), atol=1e-6)


def test_byte_entropy_tells_all_bytes_apart():
    k = quality_model.STATISTICS.index("byte_entropy")
    assert np.allclose(quality_model.statistics(pa.array(["a!", "ab", "aa", "", None, "abcd" * 9]))[:, k], [1, 1, 0, 0, 0, 2])


def test_scores_rank_texts_inside_a_step():
    d = len(quality_model.STATISTICS)
    rng = np.random.default_rng(0)
    model = quality_model.Model(
        np.zeros(d),
        np.ones(d),
        rng.normal(size=(d, 8)),
        rng.uniform(size=8),
        rng.normal(size=9),
        np.array([-9.0, 9.0]),
        np.array([0.7, 0.7]),
    )
    x = rng.normal(size=(200, d))
    raw, score = model.features(x) @ model.weights, model.score(x)
    assert (np.argsort(raw, kind="stable") == np.argsort(score, kind="stable")).all() and ((score > 0.69) & (score < 0.71)).all()
