import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from evidencelake.llm import periodic_runs, queries


def plain(words, least=24):
    """All runs by their definition: (start, length, period)."""
    out = set()
    n = len(words)
    for q in range(n // 3, 0, -1):
        k = 0
        while k + q < n:
            a = k
            while k + q < n and words[k] == words[k + q]:
                k += 1
            if k + q - a >= max(least, 3 * q):
                out = {x for x in out if x[:2] != (a, k + q - a)} | {(a, k + q - a, q)}
            k += 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def collapsed(words, runs):
    gone = {i for a, size, q in runs for i in range(a + q, a + size)}
    return [w for i, w in enumerate(words) if i not in gone]


def found(texts, least=24):
    runs, count, first, stays = periodic_runs.runs_of(pa.array([" ".join(t) for t in texts], pa.string()), least)
    rows = [[] for _ in texts]
    for text, *run in runs.tolist():
        rows[text].append(tuple(run))
    assert count.tolist() == [len(t) for t in texts]
    for k, t in enumerate(texts):
        assert [w for w, ok in zip(t, stays[first[k] : first[k + 1]], strict=True) if ok] == collapsed(t, rows[k])
    return rows


def periodic(rng, letters):
    """Words with runs inside runs, at several scales."""
    out = []
    for _ in range(rng.randint(1, 5)):
        block = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 9, 17, 20, 33, 50, 70]))]
        if rng.random() < 0.5:
            block = block * rng.randint(1, 6) + block[: rng.randint(0, len(block))]
        if rng.random() < 0.5:
            block += [rng.choice(letters) for _ in range(rng.randint(0, 3))]
        out += block * rng.randint(1, 5) + block[: rng.randint(0, len(block))]
        if rng.random() < 0.3:
            out[rng.randrange(len(out))] = rng.choice(letters)
    return out[:1200]


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz"])
def test_equals_the_definition(letters):
    rng = random.Random(len(letters))
    texts = [periodic(rng, letters) for _ in range(60)] + [[], ["a"] * 23, ["a"] * 24, ["a", "b"] * 400]
    assert found(texts) == [plain(t) for t in texts]
    assert found(texts, 1) == [plain(t, 1) for t in texts]


def test_strings_that_repeat_at_every_scale():
    fib, last, thue = ["a", "b"], ["a"], ["a"]
    for _ in range(13):
        fib, last = fib + last, fib
    for _ in range(10):
        thue += [{"a": "b", "b": "a"}[w] for w in thue]
    ruler = [str((k & -k).bit_length()) for k in range(1, 1000)]
    texts = [fib[:1000], thue[:900], ruler, fib[:300] * 4, thue[:129] * 7, ruler[:63] * 16]
    assert found(texts) == [plain(t) for t in texts]


def test_copies_in_one_batch_are_not_pairs_of_one_text():
    rng = random.Random(1)
    block = [rng.choice("abcdefgh") for _ in range(100)]
    assert found([block] * 6) == [plain(block)] * 6


def test_a_long_text():
    rng = np.random.default_rng(2)
    block = [f"w{k}" for k in rng.integers(0, 5000, 30_000)]
    text = block * 3 + block[:7]
    assert found([text, block]) == [[(0, 90_007, 30_000)], []]


def contract(doc_id, text):
    """The row of the query, by its definition."""
    words = [w.decode() for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (
        doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(collapsed(words, runs)).encode()).hexdigest(),
    )


def test_query_equals_the_contract(spark, tmp_path):
    rng = random.Random(7)
    rows = [(k, " ".join(periodic(rng, "abcdef"))) for k in range(300)]
    rows += [(k, "  ".join(rng.choice(["x\ty", "é", "z\n", "漢"]) for _ in range(rng.randint(0, 90)))) for k in range(300, 600)]
    rows += [(601, None), (602, ""), (None, "a " * 30), (None, None), (7, "a b " * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op12_periodic_runs(spark, str(tmp_path))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(r) for r in out.select(columns).collect()]
    assert sorted(got, key=str) == sorted((contract(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 200
    assert all(out.schema[c].dataType.simpleString() == "bigint" for c in columns[1:6])


def test_odd_rows(odd, empty):
    out = periodic_runs.find(odd)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == [*odd.columns, "n_words", "runs", "collapsed"] and out.count() == odd.count()
    assert (rows[100]["runs"], rows[100]["collapsed"], rows[100]["text"]) == ([], "", None)
    assert [tuple(x) for x in rows[109]["runs"]] == [(0, 40000, 1)] and rows[109]["collapsed"] == "a"
    assert len(rows[107]["runs"]) == 1 and 19 < rows[107]["runs"][0]["length"] / rows[107]["runs"][0]["period"] < 20
    assert periodic_runs.find(empty).count() == 0
