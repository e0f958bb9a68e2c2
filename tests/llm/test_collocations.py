import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidencelake.llm import collocations


def plain(rows, limit, least, percent=80):
    """The result by its definition; rows: (text, lang)."""
    out = []
    for lang in {(lang or "und") for _, lang in rows}:
        f = Counter()
        for text, own in rows:
            if (own or "und") != lang or not text:
                continue
            lower = re.sub("[A-Z]", lambda m: m.group().lower(), text)
            for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
                w = tuple(re.findall("[^ \t]+", piece))
                f.update(w[i : i + m] for m in (1, 2, 3, 4) for i in range(len(w) - m + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        own = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in own.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if not any(len(q) > len(p) and 100 * b >= percent * a and inside(q) for q, b in own.items()):
                kept.append((lang, " ".join(p), a, f[p[:k]], f[p[k:]], n, score))
        kept.sort(key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(x[0], i + 1, *x[1:]) for i, x in enumerate(kept[:limit])]
    return sorted(out)


def rows(seed, docs=150):
    rng = random.Random(seed)
    frequent = "the of and to a in Is IT".split()
    rare = [f"w{k}" for k in range(25)] + ["été", "漢字", "x-y", "É"]
    sayings = [" ".join(rng.choice(frequent + rare) for _ in range(rng.randint(2, 6))) for _ in range(12)]
    out = []
    for _ in range(docs):
        parts = []
        for _ in range(rng.randint(0, 40)):
            parts.append(rng.choice(sayings) if rng.random() < 0.4 else rng.choice(frequent if rng.random() < 0.6 else rare))
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0c", "; "]))
        out.append(("".join(parts), rng.choice(["en", "en", "en", "de", None])))
    return out + [(None, "en"), ("", "fr"), (" . ", "fr"), ("a b a b a b a b", "es")]


def got(spark, data, **named):
    out = collocations.mine(spark.createDataFrame(data, "text string, lang string"), **named)
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize(("limit", "least", "frontier"), [(2000, 3, 2), (12, 3, 1), (5, 5, 1), (40, 2, 1)])
def test_equals_the_definition(spark, limit, least, frontier):
    data = rows(limit)
    wanted = plain(data, limit, least)
    assert got(spark, data, limit=limit, min_count=least, frontier=frontier) == wanted and len(wanted) > 10


def test_any_cover_percentage_and_a_small_filter(spark):
    data = rows(3)
    assert got(spark, data, limit=30, min_count=3, cover_percent=40, frontier=1, bits=1 << 15) == plain(data, 30, 3, 40)


def test_the_rest_of_a_phrase_that_does_not_grow_from_its_own_first_word(spark):
    data = [("rare of the end", "en")] * 9 + [("of", "en")] * 400 + [("the", "en")] * 400 + [("of the", "en")] * 30 + [("rare of the end", "en")]
    for limit in (1, 2, 3):
        assert got(spark, data, limit=limit, min_count=3, frontier=1) == plain(data, limit, 3)


def test_another_seed_where_words_share_a_hash(spark, monkeypatch):
    true = collocations.count_words
    monkeypatch.setattr(collocations, "count_words", lambda docs, seed: true(docs, seed).withColumn("distinct", F.lit(seed > 1)))
    data = rows(4)[:60]
    assert got(spark, data, limit=10, min_count=3) == plain(data, 10, 3)
    docs = spark.createDataFrame([("a b", "en")], "text string, lang string")
    assert collocations.Miner(docs, 3, 80, 1 << 15, 0).seed == 2


def test_words_that_are_names_of_languages(spark):
    data = [(f"{w} x {w} y", lang) for w in ("en", "de") for lang in ("en", "de")] * 5
    docs = spark.createDataFrame(data, "text string, lang string")
    assert collocations.Miner(docs, 3, 80, 1 << 15, 0).seed == 0
    assert got(spark, data, limit=10, min_count=3) == plain(data, 10, 3)


def test_filter_bits(spark):
    rng = np.random.default_rng(1)
    codes = rng.integers(-(2**63), 2**63 - 1, (500, 2))
    own = collocations.make_filter(spark.createDataFrame(codes.tolist(), "w1 long, w2 long"), ["w1", "w2"], 1 << 16)
    assert own.lets([codes[:, k].view(np.uint64) for k in (0, 1)]).all()
    other = rng.integers(-(2**63), 2**63 - 1, (20_000, 2))
    assert own.lets([other[:, k].view(np.uint64) for k in (0, 1)]).mean() < 0.02


def test_scores_do_not_overflow(spark):
    a = 9 * 10**17
    df = spark.createDataFrame([(a, 10**18, 8 * 10**17 + 7)], "a long, x long, y long")
    assert collocations._scored(df, [("x", "y")]).first()["score"] == 2_000_000 * a // (10**18 + 8 * 10**17 + 7)


def test_odd_tables(spark, odd, empty):
    out = collocations.mine(odd, min_count=5)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in out.collect()) == plain([(r["text"], r["lang"]) for r in odd.collect()], 2000, 5)
    assert collocations.mine(empty).count() == 0
