import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from evidencelake.llm import line_crf, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_base_counts_equal_the_definition(spark, odd):
    random.seed(5)
    more = [" ".join(random.choice("ab#|") for _ in range(n)) + "\n" * (n % 3) for n in range(60)] + ["a b\na b\n a b\n\n\na b", "x x x x"]
    df = odd.select("text").unionByName(spark.createDataFrame([(t,) for t in more], "text string"))
    for r in line_crf.annotate(df).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain(r["text"])
        assert not (r["kept"] and r["base_failed"])


def test_viterbi_finds_the_best_labelling():
    rng = np.random.default_rng(2)
    for _ in range(300):
        gain, stay = np.round(rng.normal(size=rng.integers(1, 8)), 2), float(np.round(rng.normal(), 2))

        def score(labels, gain=gain, stay=stay):
            return sum(g for g, y in zip(gain, labels, strict=True) if y) + stay * sum(a == b for a, b in itertools.pairwise(labels))

        best = max(score(y) for y in itertools.product([False, True], repeat=len(gain)))
        assert abs(score(line_crf.viterbi(gain, stay).tolist()) - best) < 1e-9


def test_gradient_of_the_likelihood_is_right():
    rng = np.random.default_rng(4)
    x, y, first = rng.normal(size=(6, 3)), np.array([1.0, 0, 1, 1, 0, 1]), np.array([True, False, False, True, False, False])

    def likelihood(field):
        gain, total = x @ field.emission + first * field.start, 0.0
        for a, b in ((0, 3), (3, 6)):
            def score(labels, a=a, b=b):
                return sum(g for g, l in zip(gain[a:b], labels, strict=True) if l) + field.stay * sum(p == q for p, q in itertools.pairwise(labels))

            total += score(y[a:b]) - np.log(sum(np.exp(score(l)) for l in itertools.product([0, 1], repeat=b - a)))
        return total

    field = line_crf.Field(np.array([0.3, -0.2, 0.1]), 0.4, -0.3)
    emission, stay, start = line_crf._gradient(x, y, first, field)
    for k in range(3):
        step = np.eye(3)[k] * 1e-5
        wanted = (
            likelihood(
                line_crf.Field(field.emission + step, field.stay, field.start)
            ) - likelihood(line_crf.Field(field.emission - step, field.stay, field.start))
        ) / 2e-5
        assert abs(emission[k] - wanted) < 1e-6
    assert abs(
        stay - (
            likelihood(
                line_crf.Field(field.emission, field.stay + 1e-5, field.start)
            ) - likelihood(line_crf.Field(field.emission, field.stay - 1e-5, field.start))
        ) / 2e-5
    ) < 1e-6
    assert abs(
        start - (
            likelihood(
                line_crf.Field(field.emission, field.stay, field.start + 1e-5)
            ) - likelihood(line_crf.Field(field.emission, field.stay, field.start - 1e-5))
        ) / 2e-5
    ) < 1e-6


def test_labels_of_a_mixed_text():
    prose = "The water in the reading house was cold and very bright that winter."
    parsed = line_crf.Parsed(pa.array([f"{prose}\n| a | b | c | d |\n*** ### $$$ ***\n{prose} Again.", None]))
    assert line_crf.decode(parsed, line_crf.DEFAULT).tolist() == [True, False, False, True]


def test_odd_tables(spark, odd, empty):
    assert line_crf.annotate(empty).count() == 0
    assert line_crf.fit(odd, empty.select("doc_id", F.lit(1).alias("label"))) is line_crf.DEFAULT
    out = line_crf.annotate(odd.withColumn("kept", F.lit("x")), line_crf.fit(odd, odd.select("doc_id", (F.col("doc_id") % 2).alias("label"))))
    assert out.count() == odd.count() and dict(out.dtypes)["kept"] == "boolean"


def test_keeps_clean_documents_and_rejects_junk(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op3_line_crf(spark, d).where("not base_failed").join(
        spark.read.parquet(f"{d}/labels.parquet"),
        "doc_id",
    ).groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in out}
    assert n.get((1, False), 0) <= 0.02 * n[(1, True)]
    assert n.get((0, True), 0) <= 0.05 * sum(v for (q, _), v in n.items() if q == 0)


def test_structured_lines_are_told_apart(spark):
    """Lines that a hash by powers of a base, modulo a power of two, takes for equal."""
    from tests.llm.test_jaccard_join import thue_morse

    texts = []
    for k in range(8, 17):
        one = thue_morse(1 << k)
        two = one.translate(str.maketrans("ab", "ba"))
        texts += [f"{one}\n{two}", f"{one}\n{two}\n{one}", f"{one} {two} x {two} {one} x"]
    rows = line_crf.annotate(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain(r["text"])


def test_fit_is_the_same_in_any_order_and_takes_all_lines(spark):
    """The driver sees sums alone; a document of 60,000 lines is many chains."""
    good = "\n".join("a plain line of words that says something" for _ in range(40))
    junk = "\n".join("### | $$ | ** !! ## |" if k % 2 else "a plain line of words that says something" for k in range(60_000))
    docs = spark.createDataFrame([(k, good) for k in range(30)] + [(99, junk), (98, None), (97, "")], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 90).cast("int").alias("label"))
    one = line_crf.fit(docs, labels, steps=4)
    other = line_crf.fit(docs.repartition(7).orderBy(F.desc("doc_id")), labels, steps=4)
    assert (one.emission == other.emission).all() and (one.stay, one.start) == (other.stay, other.start)
    assert (one.emission != line_crf.DEFAULT.emission).any()


def test_chains_are_independent():
    rng = np.random.default_rng(3)
    x, y = rng.random((9, len(line_crf.LINE_FEATURES))), rng.integers(0, 2, 9).astype(float)
    first = np.array([1, 0, 0, 0, 1, 0, 0, 0, 0], bool)
    head = np.array([1, 0, 0, 0, 0, 0, 0, 0, 0], bool)
    whole = np.stack(line_crf._line_gradients(x, y, first, head, line_crf.DEFAULT), axis=1)
    parts = [np.stack(line_crf._line_gradients(x[s], y[s], first[s], head[s], line_crf.DEFAULT), axis=1) for s in (slice(0, 4), slice(4, 9))]
    assert np.allclose(whole, np.concatenate(parts), rtol=0, atol=1e-12)
