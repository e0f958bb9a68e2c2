import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidencelake.llm import phrase_fingerprint as P
from evidencelake.llm.text import utf8


def names(texts):
    data, offsets = utf8(pa.array(texts, pa.string()))
    owner, name = P.phrases(data, offsets)
    return [set(name[owner == k].tolist()) for k in range(len(texts))]


def test_equal_substrings_share_names_at_any_offset():
    random.seed(1)
    letters = "abcdefghij klmnop"
    shared = "".join(random.choice(letters) for _ in range(3000))
    a, b = ("".join(random.choice(letters) for _ in range(n)) for n in (37, 1000))
    one, two, other = names([a + shared, b + shared + a, "".join(random.choice(letters) for _ in range(3000))])
    inside = names([shared])[0]
    assert len(one & two) > 0.9 * len(inside)
    assert len(one & other) < 0.05 * len(one)


def test_names_do_not_depend_on_neighbours_in_the_batch():
    texts = ["", "a", "aaaaaaaaaaaaaaaaaaaaaaa", "abababababababababababab", "the water and the stone in winter", "漢字漢字漢字漢字", "x" * 5000, None]
    alone = [names([t])[0] for t in texts]
    assert names(texts) == alone
    assert all(alone[k] for k in (1, 2, 3, 4, 5, 6)) and not alone[0] and not alone[7]


def test_phrases_are_short():
    """Landmarks come often: each level is shorter than the one below by a constant factor."""
    random.seed(2)
    data = np.frombuffer(bytes(random.randrange(256) for _ in range(20000)), np.uint8)
    data = data[np.append(True, data[1:] != data[:-1])]
    first = np.zeros(1, np.int64)
    gaps = np.diff(P._phrase_starts(P._toss(data, first), first))
    assert gaps[1:].min() >= 2 and gaps.max() <= 12  # the text itself may start one before a landmark


def test_likeness():
    a, b = np.array([1, 2, 3, 4], np.uint32), np.array([3, 4, 5, 6], np.uint32)
    assert P.likeness(a, a) == 1 and P.likeness(a[:0], a[:0]) == 1 and P.likeness(a, a[:0]) == 0
    assert P.likeness(a, b) == 0.5


@pytest.mark.parametrize("ranges", [1, 7, 100, None])
def test_edits_follow_descending_ids(spark, odd, ranges):
    coded = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", "t", F.xxhash64("t").alias("code")).collect()
    rows = [(r["doc_id"], r["t"]) for r in sorted(coded, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["code"]))]
    wanted = []
    for k, (key, text) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(text) // 2
        wanted.append((key, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    out = P.compare_with_edits(odd, ranges=ranges).collect()
    got = [(r["doc_id"], r["n_chars"], hashlib.sha256(r["edited"].encode()).hexdigest()) for r in out]
    assert sorted(map(str, got)) == sorted(map(str, wanted))
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    assert [r["near_edited"] for r in out if r["n_chars"] < 2] == [1.0] * sum(r["n_chars"] < 2 for r in out)


def test_tables_of_one_and_no_row(spark, empty, odd):
    assert P.compare_with_edits(empty).count() == 0
    assert P.fingerprint(empty).count() == 0
    one = P.compare_with_edits(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert one["edited"] == "abcabc" and one["near_next"] == 1.0
    texts = {}
    for r in P.fingerprint(odd).select("text", "fingerprint").collect():
        assert texts.setdefault(r["text"] or "", r["fingerprint"]) == r["fingerprint"]


def test_edited_texts_are_nearer_than_next_ones(spark):
    from evidencelake.llm import queries

    out = queries.op10_phrase_fingerprint(spark, "/root/testdata/sf0.001").where("n_chars > 200").collect()
    assert np.mean([r["near_edited"] for r in out]) > 0.4 > 0.05 > np.mean([r["near_next"] for r in out])


def plain_names(text):
    """The parse by its definition, symbol by symbol."""
    symbols = [(int(P._BYTE_NAMES[b]), 1, b) for b in text.encode()]
    found, level = set(), 0
    while symbols:
        runs = []
        for name, size, label in symbols:
            if runs and runs[-1][0] == name:
                runs[-1][1] += size
                runs[-1][3] += 1
            else:
                runs.append([name, size, label, 1])
        named = [(mix(name + times * STEP) if times > 1 else name, size, label) for name, size, label, times in runs]
        labels = [x[2] if level == 0 else x[0] for x in named]
        for _ in range(3 if level == 0 else 4):
            labels = toss(labels)
        starts = [k for k in range(len(labels)) if k == 0 or 0 < k < len(labels) - 1 and labels[k - 1] < labels[k] > labels[k + 1]]
        symbols = []
        for a, b in zip(starts, [*starts[1:], len(named)], strict=True):
            total = sum(mix(named[a + k][0] + (k + 1) * STEP) for k in range(b - a))
            symbols.append((mix(total), sum(x[1] for x in named[a:b]), None))
        found |= {name for name, size, _ in symbols if size >= P.MIN_BYTES or len(symbols) == 1}
        if len(symbols) == 1:
            break
        level += 1
    return found


STEP, ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def mix(x):
    x &= ALL
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = ((x ^ (x >> 33)) * factor) & ALL
    return x ^ (x >> 33)


def toss(labels):
    out = []
    for k, x in enumerate(labels):
        differ = x ^ labels[k - 1] if k else 1
        low = (differ & -differ).bit_length() - 1 if differ else 0
        out.append(2 * low + ((x >> low) & 1))
    return out


def test_parse_equals_the_definition():
    random.seed(11)
    texts = [
        "a",
        "ab",
        "aaaa",
        "abababab" * 5,
        "été 漢字 " * 9,
        "".join(random.choice("ab") for _ in range(300)),
        "".join(random.choice("abcdefgh ij") for _ in range(2000)),
        "x" * 900 + "y" * 40 + "z",
    ]
    for text, got in zip(texts, names(texts), strict=True):
        assert got == plain_names(text), text[:20]


def test_fingerprint_is_the_least_hashes_of_the_names(spark):
    texts = ["the water and the stone " * 30, "été 漢字 " * 9, "short"]
    rows = P.fingerprint(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    for r in rows:
        wanted = sorted({mix(x ^ 0x5851F42D4C957F2D) >> 32 for x in plain_names(r["text"])})[: P.SKETCH]
        assert r["fingerprint"] == "".join(f"{x:08x}" for x in wanted)


def test_a_hot_id_is_dealt_to_several_ranges(spark):
    rows = spark.createDataFrame([(5, f"text number {k}") for k in range(400)] + [(None, f"other {k}") for k in range(400)], "id long, text string")
    dealt = P._dealt(rows, 20)
    sizes = [r["count"] for r in dealt.where("not ghost").groupBy("part").count().collect()]
    assert sum(sizes) == 800 and len(sizes) > 15 and max(sizes) < 120
    assert dealt.where("ghost").count() == len(sizes)
