import pathlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidencelake.llm import jaccard_join
from evidencelake.llm import text as X

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def plain(rows, threshold=0.8):
    s = {k: sets(t) for k, t in rows}
    parent, n = {k: k for k in s}, defaultdict(int)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(s)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if s[a] and s[b] and len(s[a] & s[b]) >= threshold * len(s[a] | s[b]) - 1e-9:
                n[a] += 1
                n[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (find(k), n[k]) for k in keys}


def corpus(n, seed=1):
    random.seed(seed)
    base = [[random.choice("abcdefghijklmnop") + str(random.randint(0, 99)) for _ in range(random.choice([3, 20, 60]))] for _ in range(n // 4)]
    rows = []
    for k in range(n):
        w = list(random.choice(base))
        for _ in range(random.choice([0, 0, 0, 1, 1, 3])):
            w[random.randrange(len(w))] = "edit" + str(k)
        rows.append((k, " ".join(w)))
    return rows


def test_banding_reaches_its_recall():
    for threshold, recall in ((0.8, 0.999), (0.6, 0.95), (0.9, 0.9995)):
        bands, rows = jaccard_join.banding(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 128
    with pytest.raises(ValueError, match="no banding"):
        jaccard_join.banding(0.001, 0.999, 8)


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 4}, {"block_shingles": 300}])
def test_links_and_classes_equal_brute_force(spark, blocks):
    rows = corpus(160)
    out = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **blocks)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in out.collect()}
    assert got == plain(rows)


def test_a_large_group_of_copies_and_near_copies(spark):
    random.seed(4)
    words = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join(words)) for k in range(300)]
    for k in range(300, 420):
        w = list(words)
        w[random.randrange(len(w))] = f"e{k}"
        rows.append((k, " ".join(w)))
    out = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_rows=32)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in out.collect()} == plain(rows)


def test_odd_rows(spark, odd, empty):
    rows = jaccard_join.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    got = defaultdict(set)
    for r in rows:
        got[r["doc_id"]].add((r["class_id"], r["n_links"]))
    assert got[100] == {(100, 0)} and got[101] == {(101, 0)} and got[102] == {(102, 0)} and got[None] == {(None, 0)}
    assert got[105] == {(105, 2)} and got[106] == {(105, 2)}
    assert [r["first"] for r in rows if r["doc_id"] in (105, 106)].count(True) == 2
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(101, 100), (100, 101), (7, 7)], "a long, b long")
    got = {r["id"]: r["group"] for r in jaccard_join.connected_components(edges).collect()}
    assert all(got[k] == 0 for k in range(1, 61)) and got[101] == 100
    assert jaccard_join.connected_components(edges.where(F.lit(False))).count() == 0


def thue_morse(n):
    bits = "a"
    while len(bits) < n:
        bits += bits.translate(str.maketrans("ab", "ba"))
    return bits


def test_structured_words_do_not_collide(spark):
    """A hash that is a polynomial in the bytes, modulo a power of two, is the same for these."""
    texts = [x for k in range(8, 17) for x in (thue_morse(1 << k), thue_morse(1 << k).translate(str.maketrans("ab", "ba")))]
    rows = jaccard_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in rows) == [(k, k, 0) for k in range(len(texts))]
    data, offsets = X.utf8(pa.array([" ".join(texts)]))
    w = X.words(data, offsets)
    one, two = X.hashes(data, w), X.hashes(data, w, 7)
    assert len(set(one.tolist()) | set(two.tolist())) == 2 * len(texts)


def test_null_ids_and_texts_that_share_an_id(spark):
    words = [f"w{k}" for k in range(60)]
    near = [" ".join([*words[:k], "x", *words[k + 1 :]]) for k in (5, 20, 40)]
    other = " ".join(f"v{k}" for k in range(60))
    rows = [
        (None, near[0]),
        (None, near[1]),
        (7, " ".join(words)),
        (7, other),
        (9, other.replace("v30", "y")),
        (None, other + " end"),
        (None, "alone is this text of null id"),
    ]
    rows += [(None, "u1 u2 u3 u4 u5 " * 3 + f"u{k}") for k in (5, 5)] + [(None, "t " * 30), (None, "t " * 31)]
    out = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_text = {}
    for r in out:
        by_text.setdefault(r["text_hash"], []).append((r["doc_id"], r["class_id"], r["n_links"], r["first"]))
    hashes = {t: h for t, h in spark.createDataFrame(sorted({(t,) for _, t in rows}), "t string").select("t", F.xxhash64("t")).collect()}
    got = {t: by_text[h] for t, h in hashes.items()}
    assert got[near[0]] == [(None, 7, 1, False)] and got[" ".join(words)] == [(7, 7, 2, True)]
    assert got[other] == [(7, 7, 2, True)] and got[other.replace("v30", "y")] == [(9, 7, 2, False)]
    assert got["alone is this text of null id"] == [(None, None, 0, True)]
    assert sum(r[3] for x in ("t " * 30, "t " * 31) for r in got[x]) == 1


def test_staged_tables_are_deleted(spark, tmp_path):
    from evidencelake.llm.storage import drop
    from evidencelake.sources.stage import shared_dir

    folder = pathlib.Path(shared_dir(spark).removeprefix("file:")) / "staged" / spark.sparkContext.applicationId
    before = set(folder.glob("*"))
    out = jaccard_join.near_duplicates(spark.createDataFrame(corpus(40), "doc_id long, text string"))
    assert len(set(folder.glob("*")) - before) == 1
    drop(out)
    assert set(folder.glob("*")) == before


@pytest.mark.parametrize("members", [1, 3])
def test_very_large_sets_are_compared_to_the_last_shingle(members):
    n = 900_000  # two such sets are linked from 800,000 common shingles on

    def block(starts):
        sets = [np.arange(a, a + n, dtype=np.uint64).tobytes() for a in starts]
        rows = {"node": range(len(sets)), "copies": [1] * len(sets), "keys": [[0]] * len(sets), "shingles": sets}
        return jaccard_join._Block([pa.RecordBatch.from_pydict(rows)])

    held, other = block([0] * members), block([100_000, 100_001, 99_999][:members])
    assert jaccard_join._near(held, other, 0, 0.8).tolist() == [[True, False, True][:members]] * members
    if members == 1:
        assert jaccard_join._near(held, block([100_001]), 0, 0.8).tolist() == [[False]]
