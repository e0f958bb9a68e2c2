import random
import re

import numpy as np
import pyarrow as pa

from evidencelake.llm import text as X

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["a b  c\n\nb c d e f g", None, "", " ", "é x\n", "one two three four five six", "\n\n", "tail\n", "漢字 😀"]


def pieces(data, spans):
    return [data[a:b].tobytes().decode() for a, b in zip(spans.start, spans.end, strict=True)]


def test_words_and_lines_match_regular_expressions():
    data, offsets = X.utf8(pa.array(TEXTS))
    assert pieces(data, X.words(data, offsets)) == [w for t in TEXTS for w in WORD.findall(t or "")]
    assert pieces(data, X.lines(data, offsets)) == [x for t in TEXTS for x in (t or "").split("\n")]


def test_hashes_do_not_depend_on_the_batch():
    data, offsets = X.utf8(pa.array(["zz yy a b c", "a b c yy"]))
    w = X.words(data, offsets)
    h = X.hashes(data, w)
    by_word = {}
    for word, value in zip(pieces(data, w), h, strict=True):
        assert by_word.setdefault(word, value) == value
    assert len(set(by_word.values())) == 5


def test_shingles_equal_sets_of_word_windows():
    random.seed(1)
    texts = [" ".join(random.choice("abcd") for _ in range(n)) for n in (0, 1, 2, 4, 5, 6, 30, 3)]
    data, offsets = X.utf8(pa.array(texts))
    w = X.words(data, offsets)
    value, owner = X.shingles(X.hashes(data, w), w)
    seen = {}
    for k, t in enumerate(texts):
        words = t.split()
        expected = [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
        own = value[owner == k]
        assert len(own) == len(expected)
        for s, v in zip(expected, own, strict=True):
            assert seen.setdefault(s, v) == v
    assert len(set(seen.values())) == len(seen)


def test_slices_keep_all_rows():
    batch = pa.record_batch({"text": pa.array(["x" * 100, None, "", "y" * 5000, "z"] * 3)})
    got = [t for s in X.slices(iter([batch]), most=500) for t in s.column("text").to_pylist()]
    assert got == batch.column("text").to_pylist()
    assert np.all([s.num_rows > 0 for s in X.slices(iter([batch]), most=1)])
