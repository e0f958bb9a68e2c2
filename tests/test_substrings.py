"""The substring join against comparing everything with everything."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidencelake.operators import conversation, substrings
from evidencelake.plans import catalog

NEEDLES = "doc int, nid int, needle string"
TEXTS = "doc int, tid int, text string"


def found(spark, needles, texts, shortest=1):
    """The pairs by fingerprints, by comparing all, and with some groups each way; all the same."""
    a, b = spark.createDataFrame(needles, NEEDLES), spark.createDataFrame(texts, TEXTS)
    ids = {"needle_ids": ("nid",), "text_ids": ("tid",), "shortest": shortest}
    out = [substrings.by_prints(a, b, ("doc",), **ids).distinct(), substrings.contained(a, b, ("doc",), None, **ids)]
    out.append(substrings.contained(a, b, ("doc",), spark.createDataFrame([(1,)], "doc int"), **ids))
    first, *others = (sorted((tuple(r) for r in x.collect()), key=str) for x in out)
    assert all(x == first for x in others)
    return first


def by_hand(needles, texts):
    pairs = {(d, n, t) for d, n, x in needles for e, t, y in texts if d is not None and d == e and x and y is not None and x in y}
    return sorted(pairs, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_pairs_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    alphabet = ["ab", "abcdefgh äöß中\U0001f600\0", "a"][seed]
    texts = [(rng.randrange(3), i, "".join(rng.choices(alphabet, k=rng.choice([0, 1, 5, 40, 300])))) for i in range(60)]
    needles = []
    for i in range(120):
        d, _, text = rng.choice(texts)
        a, n = rng.randrange(len(text) + 1), rng.choice([1, 2, 3, 4, 7, 8, 15, 16, 17, 31, 32, 33, 63, 64, 65, 120])
        needles.append((d, i, text[a : a + n] if i % 3 else "".join(rng.choices(alphabet, k=n))))
    assert found(spark, needles, texts) == by_hand(needles, texts)


def test_nulls_repeats_and_empty_tables(spark):
    texts = [(1, None, "one two three"), (1, None, "one two three"), (1, 7, None), (None, 8, "one two"), (1, 9, ""), (1, 9, "two"), (1, 9, "three")]
    needles = [(1, 1, "two"), (1, 1, "two"), (1, None, "three"), (None, 2, "one"), (1, 3, ""), (1, 4, None)]
    assert found(spark, needles, texts) == by_hand(needles, texts)
    assert found(spark, [], texts) == found(spark, needles, []) == []


def test_a_text_longer_than_a_piece_is_covered(spark, monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(97, 123, n))) for n in (5, 1000, 0, 333)]
    monkeypatch.setattr(substrings, "PIECE", 1 << 20)
    whole = substrings._prints(pa.array(texts), substrings.LENGTHS, False).to_pylist()
    for piece in (1, 17, 64, 250):
        monkeypatch.setattr(substrings, "PIECE", piece)
        assert substrings._prints(pa.array(texts), substrings.LENGTHS, False).to_pylist() == whole
    assert substrings._prints(pa.array(["x", *texts]).slice(1), substrings.LENGTHS, False).to_pylist() == whole


def test_a_needle_has_one_print_and_its_text_has_it():
    text = "the quick brown fox jumps over the lazy dog and a second line that is as long as the first"
    for n in substrings.LENGTHS:
        held = set(substrings._prints(pa.array([text]), (n,), False)[0].as_py())
        for a in range(len(text) - n + 1):
            (print_,) = substrings._prints(pa.array([text[a : a + n].encode()]), (n,), True)[0].as_py()
            assert print_ in held
    # windows far apart share their least gram, so a text carries few fingerprints
    assert len(held) < len(text) / 4


def test_compared_pairs_grow_with_the_hits(spark):
    pages = spark.range(2000).selectExpr("1 as doc", "cast(id as int) as tid", "concat('page number ', id, ' says ', sha2(cast(id as string), 256), ' at its end') as text")
    needles = pages.selectExpr("doc", "tid as nid", "substring(text, 20, 60) as needle")
    looked = substrings.with_prints(needles.selectExpr("doc", "nid", "substring(cast(needle as binary), 1, 32) as h"), "h", substrings.LENGTHS, whole=True)
    held = substrings.with_prints(pages, "text", substrings.LENGTHS)
    assert looked.join(held, ["doc", "print"]).count() < 2000 * 1.1
    heavy = substrings.heavy_groups(needles, pages, ("doc",), 1 << 20)
    assert [r[0] for r in heavy.collect()] == [1] and substrings.heavy_groups(needles, pages, ("doc",), 1 << 30) is None
    pairs = substrings.contained(needles, pages, ("doc",), heavy, needle_ids=("nid",), text_ids=("tid",))
    assert pairs.count() == pairs.where("nid = tid").count() == 2000


@pytest.mark.parametrize("light", [0, substrings.LIGHT])
def test_evidence_and_lines_find_their_pages(spark, light):
    evidence = [
        (1, 1, "Some WORDS on  a page", [], []),
        (1, 2, "only on page three, said twice", [], []),
        (1, 3, "nowhere", [], []),
        (1, 4, "some words", [], [9, 3]),
        (1, 5, None, [], []),
        (2, 6, "some words", [], []),
    ]
    evidence = spark.createDataFrame(evidence, "document_id int, id int, text string, box_pages array<int>, pages array<int>")
    pages = spark.createDataFrame(
        [(1, 3, "Only on page three, said twice. Some words on a page"), (1, 2, "some words on a page"), (1, None, "nowhere"), (2, 1, None)],
        "document_id int, page int, text string",
    )
    rows = {r["id"]: (r["page"], r["matched"], r["source"]) for r in conversation.evidence_locate(evidence, pages, light).collect()}
    assert rows == {
        1: (2, True, "text-search"),
        2: (3, True, "text-search"),
        3: (None, False, "none"),
        4: (3, True, "page-numbers"),
        5: (None, False, "none"),
        6: (None, False, "none"),
    }
    lines = spark.createDataFrame(
        [(1, 3, 0, "only on page three, said"), (1, 3, 0, "only on page three, said"), (1, 3, 1, "short line"), (1, 2, 2, "only on page three, said"), (1, 3, 3, None)],
        "document_id int, page int, line int, text string",
    )
    whole = spark.createDataFrame([(1, 3, 8, "Only on page three, said “twice”"), (1, 3, 9, None)], "document_id int, page int, id int, text string")
    assert [tuple(r) for r in conversation.line_marks(lines, whole, light).collect()] == [(1, 3, 0, 8)]


def test_texts_are_stripped_as_the_patterns_say(spark):
    """Also the order matters: a blank goes with the hyphen before it, not with one that a quote parts from it."""
    rng, signs = random.Random(3), "aBΣİ  -–—\"'“”‘’\t\n\r\f\x0b\x1c\xa0\u2003é中…"
    texts = ["".join(rng.choices(signs, k=rng.choice([0, 1, 3, 8, 40, 300]))) + " " * rng.choice([0, 1, 20]) for _ in range(4000)]
    df = spark.createDataFrame([*((i, x) for i, x in enumerate(texts)), (-1, None)], "id int, text string")
    expected = dict(df.select("id", conversation.strip_for_match(F.col("text"))).collect())
    assert dict(conversation.stripped(df, "needle").collect()) == expected
    assert dict(conversation.stripped(df, "needle", 7).collect()) == {k: x and x[:7] for k, x in expected.items()}


@pytest.mark.parametrize("query", ["evidence_locate", "line_marks"])
def test_no_pattern_is_searched_for_each_text(spark, query):
    """Filters and joins that look at stripped texts made them anew, with five patterns each time."""
    plan = catalog.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan and "MapInArrow" in plan
