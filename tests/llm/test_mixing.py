import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evidencelake.llm import mixing


def test_share_out():
    assert mixing.share_out(100, [1, 1], [1000, 1000]) == [50, 50]
    assert mixing.share_out(100, [3, 1], [1000, 1000]) == [75, 25]
    assert mixing.share_out(100, [1, 1, 2], [10, 1000, 1000]) == [10, 30, 60]
    assert mixing.share_out(100, [1, 1], [20, 30]) == [20, 30]
    assert mixing.share_out(10, [0, 1], [100, 4]) == [0, 4]
    random.seed(2)
    for _ in range(300):
        n = random.randint(1, 6)
        limits, weights, budget = [random.randint(0, 40) for _ in range(n)], [random.choice([0, 1, 2.5]) for _ in range(n)], random.randint(0, 200)
        got = mixing.share_out(budget, weights, limits)
        assert sum(got) == min(
            budget,
            sum(m for m, w in zip(limits, weights, strict=True) if w),
        ) and all(0 <= g <= m for g, m in zip(got, limits, strict=True))
        assert not any(g for g, w in zip(got, weights, strict=True) if not w)


def test_shortage_goes_to_siblings_before_ancestors():
    capacity = {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 100}
    assert mixing.leaf_budgets(100, capacity, {}) == {("a", "x"): 10, ("a", "y"): 40, ("b", "z"): 50}
    assert mixing.leaf_budgets(180, capacity, {}) == {("a", "x"): 10, ("a", "y"): 80, ("b", "z"): 90}
    assert mixing.leaf_budgets(50, {}, {}) == {}
    # what is below a weight of 0 is no capacity: the shortage goes to the others
    assert mixing.leaf_budgets(150, capacity, {("a", "y"): 0}) == {("a", "x"): 10, ("a", "y"): 0, ("b", "z"): 100}
    assert mixing.leaf_budgets(150, capacity, {("a",): 0}) == {("a", "x"): 0, ("a", "y"): 0, ("b", "z"): 100}


def plain(rows, given, seed):
    """rows: (id, leaf, tokens). Takes whole epochs, then a prefix of the next."""
    leaves, out = defaultdict(list), Counter()
    for key, leaf, tokens in rows:
        leaves[leaf].append((key, tokens))
    for leaf, docs in leaves.items():
        total = sum(t for _, t in docs)
        if not total or not given[leaf]:
            continue
        whole, rest = divmod(given[leaf], total)
        for epoch in range(whole):
            out.update((key, epoch) for key, _ in docs)
        passed = 0
        for key, tokens in sorted(docs, key=lambda x: (hashlib.md5(f"{seed}|{whole}|{x[0]}".encode()).hexdigest(), str(x[0]))):
            if passed < rest:
                out[(key, whole)] += 1
            passed += tokens
    return out


@pytest.mark.parametrize(("share", "epochs"), [(0.5, 1), (0.9, 3), (2.5, 3), (1.0, 1)])
def test_equals_the_definition(spark, share, epochs):
    random.seed(9)
    rows = [(k, random.choice("abc"), random.choice("xy"), random.randint(0, 50)) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, d string, s string, tokens long")
    weights = {("a",): 3.0, ("a", "x"): 0.2}
    out = mixing.mix(df, {"d": F.col("d"), "s": F.col("s")}, F.col("tokens"), weights, share=share, max_epochs=epochs, seed=4)
    size = Counter()
    for _, d, s, t in rows:
        size[(d, s)] += t
    given = mixing.leaf_budgets(int(share * sum(size.values())), {k: v * epochs for k, v in size.items()}, weights)
    assert Counter((r["doc_id"], r["mix_epoch"]) for r in out.collect()) == plain([(k, (d, s), t) for k, d, s, t in rows], given, 4)


def test_odd_rows(spark, odd, empty):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    out = mixing.mix(odd, levels, F.char_length("text"), {}, share=0.5, seed=1)
    assert out.columns == [*odd.columns, "mix_epoch"] and 0 < out.count() <= odd.count()
    every = mixing.mix(odd, levels, F.lit(1), {}, share=1.0, seed=1)
    assert every.count() == odd.count()
    assert mixing.mix(empty, levels, F.lit(1), {}, share=0.5).count() == 0
    assert mixing.mix(odd, levels, F.lit(1), {}, budget=0).count() == 0


def test_a_branch_of_weight_zero_gives_nothing(spark):
    rows = [(k, "ab"[k % 2], 10) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    out = mixing.mix(df, {"source": F.col("source")}, F.col("tokens"), {("a",): 1.0, ("b",): 0.0}, share=0.8)
    got = out.groupBy("source").count().collect()
    assert [(r["source"], r["count"]) for r in got] == [("a", 20)]
