import random

from evidencelake.llm import line_dedup

BLANK = " \t\r\x0b\x0c"


def plain(rows, width=3):
    """rows: (id, text), in the order of first occurrences."""
    first, out = {}, {}
    for key, text in rows:
        if text is None:
            continue
        lines = text.split("\n")
        filled = [i for i, x in enumerate(lines) if x.strip(BLANK)]
        gone = set()
        for k in range(len(filled) - width + 1):
            w = tuple(lines[i].strip(BLANK) for i in filled[k : k + width])
            if first.setdefault(w, (key, k)) != (key, k):
                gone |= set(range(filled[k], filled[k + width - 1] + 1))
        out[key] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return out


def test_equals_the_definition(spark):
    random.seed(8)
    rows = [(k, "\n".join(random.choice(["a", "b", " a", "c", "", " ", "d\t"]) for _ in range(random.randint(0, 25)))) for k in range(80)]
    wanted = plain(rows)
    got = {
        r["doc_id"]: (r["text"], r["lines_removed"]) for r in line_dedup.remove_repeated(
            spark.createDataFrame(rows, "doc_id long, text string")
        ).collect()
    }
    assert got == wanted


def test_odd_rows(spark, odd, empty):
    out = line_dedup.remove_repeated(odd)
    rows = out.collect()
    assert out.columns == [*odd.columns, "lines_removed"]
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(map(str, (r["doc_id"] for r in odd.collect())))
    assert [r["text"] for r in rows if r["doc_id"] == 100] == [None]
    assert line_dedup.remove_repeated(empty).count() == 0


def test_a_passage_shared_by_many_stays_once(spark):
    rows = [(k, f"head {k}\none line\ntwo line\nthree line\nfour line\ntail {k}") for k in range(50)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == rows[0][1]
    assert all(out[k] == f"head {k}\ntail {k}" for k in range(1, 50))
