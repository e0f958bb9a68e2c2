import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from evidencelake.llm import ppm
from evidencelake.llm.text import utf8


def plain_counts(texts):
    """Counts of byte contexts of every order, from the same windows as the fit."""
    found = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    for t in texts:
        b = t.encode()
        for i in range(ppm.ORDER, len(b)):
            for k in range(ppm.ORDER + 1):
                found[k][b[i - k : i]][b[i]] += 1
    return found


def plain_bits(counts, text):
    """Code length by the definition: longest known context, escapes with exclusion."""
    b, total = text.encode(), 0.0
    for i in range(len(b)):
        ruled_out = set()
        for k in range(min(i, ppm.ORDER), -1, -1):
            seen = counts[k].get(b[i - k : i])
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in ruled_out}
            size = sum(left.values()) + len(left)
            if b[i] in left:
                total -= math.log2(left[b[i]] / size)
                break
            if left:
                total -= math.log2(len(left) / size)
            ruled_out |= set(seen)
        else:
            total += math.log2(256 - len(counts[0][b""]))
    return total


def test_code_lengths_equal_the_definition():
    training = {"aa": ["the cat sat on the mat and the hat", "a cat and a rat"], "bb": ["der hund und die katze", "über den hügel"]}
    arrays = {}
    for lang, texts in training.items():
        data, offsets = utf8(pa.array(texts))
        ((_, place, code),) = ppm._pieces(data, offsets)
        key, n = np.unique(code[place >= ppm.ORDER], return_counts=True)
        arrays[lang] = (key, n.astype(float))
    model = ppm.Model(arrays)
    texts = ["the cat", "der hund", "xyz 漢", "", "t", "ü", "the the über zz"]
    got = model.code_lengths(*utf8(pa.array(texts))) / ppm._UNIT
    for k, lang in enumerate(model.langs):
        counts = plain_counts(training[lang])
        assert np.allclose(got[:, k], [plain_bits(counts, t) for t in texts], atol=1e-6)


def test_predicts_held_out_texts_and_odd_rows(spark, odd, empty):
    en = ["the reading of the water and the stone %d" % k for k in range(40)]
    de = ["das lesen und der stein über dem wasser %d" % k for k in range(40)]
    train = spark.createDataFrame([(t, "en") for t in en] + [(t, "de") for t in de] + [(None, "en"), ("x", None)], "text string, lang string")
    model = ppm.fit(train)
    assert model.langs == ["de", "en"]
    rows = ppm.predict(
        spark.createDataFrame([("the stone and water",), ("der stein und das wasser",), (None,), ("12 34",), ("",)], "text string"),
        model,
    ).collect()
    assert [r["lang_pred"] for r in rows] == ["en", "de", "und", "und", "und"]
    assert all(0 <= r["lang_score"] <= 1 for r in rows)
    assert ppm.predict(odd, model).count() == odd.count()
    assert ppm.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in ppm.predict(odd, ppm.fit(empty)).select("lang_pred").collect()} == {"und"}


def test_accuracy_on_the_held_out_fold(spark):
    from evidencelake.llm import queries

    d = "/root/testdata/sf0.001"
    out = queries.op5_ppm_language(spark, d).join(
        spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"),
        "doc_id",
    ).where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.95 * len(out) > 0


def test_a_language_of_copies_is_sampled_by_distinct_texts(spark):
    # more copies than max_docs: all of them were drawn or none
    texts = [
        ("en", "the water under the stone is cold"),
        ("de", "das Wasser unter dem Stein ist kalt"),
        ("fr", "une eau froide sous la pierre"),
        ("es", "el agua bajo la piedra es muy clara"),
        ("it", "la pietra sotto il fiume era chiara"),
    ]
    rows = [(text, lang) for lang, text in texts for _ in range(40)]
    model = ppm.fit(spark.createDataFrame(rows, "text string, lang string"), max_docs=2)
    assert model.langs == ["de", "en", "es", "fr", "it"]
    once = ppm.fit(spark.createDataFrame([(text, lang) for lang, text in texts], "text string, lang string"), max_docs=2)
    assert [x.levels[ppm.ORDER]["n"].tolist() for x in model.trees] == [x.levels[ppm.ORDER]["n"].tolist() for x in once.trees]


def small_model():
    arrays = {}
    for lang, text in {"aa": "the cat sat on the mat and the hat", "bb": "der hund und die katze über den hügel"}.items():
        ((_, place, code),) = ppm._pieces(*utf8(pa.array([text])))
        key, n = np.unique(code[place >= ppm.ORDER], return_counts=True)
        arrays[lang] = (key, n.astype(float))
    return ppm.Model(arrays)


def test_equal_texts_have_equal_scores_in_any_batch_and_piece(monkeypatch):
    random.seed(8)
    texts = ["".join(random.choice("abcdehtü ß漢") for _ in range(random.choice([0, 1, 3, 40, 900]))) for _ in range(200)]
    model = small_model()
    whole = model.code_lengths(*utf8(pa.array(texts)))
    order = random.sample(range(len(texts)), len(texts))
    assert (model.code_lengths(*utf8(pa.array([texts[k] for k in order]))) == whole[order]).all()
    for most in (1, 7, 1000):
        monkeypatch.setattr(ppm._pieces, "__defaults__", (most,))
        assert (model.code_lengths(*utf8(pa.array(texts))) == whole).all()


def test_one_table_in_two_orders(spark):
    model, rows = small_model(), [(k, "the cat and der hund %d " % k * (k % 50)) for k in range(300)]
    scores = []
    for own in (rows, rows[::-1]):
        out = ppm.predict(spark.createDataFrame(own, "doc_id long, text string").coalesce(1), model).collect()
        scores.append({r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in out})
    assert scores[0] == scores[1]


def test_a_long_text_takes_little_memory():
    model, text = small_model(), pa.array(["the hund über the mat " * (64 << 20 >> 4)])[0:1]
    data, offsets = utf8(text)
    assert len(data) > 64 << 20
    tracemalloc.start()
    model.code_lengths(data, offsets)
    assert tracemalloc.get_traced_memory()[1] < 256 << 20
    tracemalloc.stop()


def test_a_repeated_text_is_a_language_and_too_many_are_an_error(spark):
    rows = [("der stein über dem wasser %d" % k, "de") for k in range(50)] + [("one text of many copies", "xx")] * 9000
    assert ppm.fit(spark.createDataFrame(rows, "text string, lang string"), max_docs=20).langs == ["de", "xx"]
    dirty = spark.createDataFrame([(f"text {k}", f"l{k}") for k in range(30)], "text string, lang string")
    with pytest.raises(ValueError, match="more than 20 languages"):
        ppm.fit(dirty, max_langs=20)


def test_no_language_is_lost_at_the_limit_of_grams(spark):
    """One text of grams that occur once each, beside another language, and many languages."""
    unique = "".join(chr(0x4E00 + k) for k in range(400))
    rows = spark.createDataFrame([("plain words of a text " * 20, "x")] * 3 + [(unique, "y")], "text string, lang string")
    for most in (1 << 20, 2000, 800, 10, 1):
        model = ppm.fit(rows, max_grams=most)
        assert model.langs == ["x", "y"]
    many = spark.createDataFrame([("".join(chr(0x4E00 + (7 * k + j) % 20000) for j in range(500)), f"l{k:03}") for k in range(1000)], "text string, lang string")
    assert len(ppm.fit(many).langs) == 1000
