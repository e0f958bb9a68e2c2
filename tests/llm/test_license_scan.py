import re

import pytest

from evidencelake.llm import license_scan

TEMPLATES = {"mit-line": "Released under the MIT License.", "gpl-line": "This work is licensed under the GNU General Public License, version 3."}


def shingles(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]


def plain(text, templates):
    found, own = {}, shingles(text)
    for name, template in templates.items():
        wanted = set(shingles(template))
        reach = 1 << (len(wanted) - 1).bit_length()
        for start in range(-reach, max(len(own), 1), reach):
            share = len(wanted & set(own[max(start, 0) : max(start + 2 * reach, 0)])) / len(wanted)
            found[name] = max(found.get(name, 0), share)
    return {k: v for k, v in found.items() if v >= 0.8}


def test_bands_reach_their_recall():
    n = license_scan.bands_for(0.2, 0.999)
    assert 1 - 0.8**n >= 0.999 > 1 - 0.8 ** (n - 1)


def test_equals_brute_force(spark):
    filler = "the water and the stone were cold that winter " * 3
    mit, gpl = TEMPLATES.values()
    long = license_scan.TEMPLATES["mit-permission"]
    texts = [
        filler,
        filler + mit,
        gpl.upper() + "\n" + filler,
        mit + " " + gpl,
        filler * 20 + gpl + filler * 9,
        mit.replace("MIT", "BSD"),
        long,
        long.replace("merge", "join"),
        " ".join(long.split()[:60]),
        filler + long + filler,
        "",
        None,
        "Released under",
        gpl * 4,
    ]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert {
            x["template"]: round(x["containment"], 9) for x in r["licenses"]
        } == {k: round(v, 9) for k, v in plain(texts[r["doc_id"]], license_scan.TEMPLATES).items()}


def test_no_python_in_the_plan(spark, odd):
    plan = license_scan.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows(spark, odd, empty):
    out = license_scan.scan(odd)
    assert out.count() == odd.count()
    assert license_scan.scan(empty).count() == 0
    with pytest.raises(ValueError, match="fewer than five"):
        license_scan.scan(odd, {"short": "All rights reserved."})


#: Written down from the documents table, not from TEMPLATES.
LINES = {
    "Licensed under the Apache License, Version 2.0.": "apache-2.0-line",
    "Released under the MIT License.": "mit-line",
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0-line",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0-short",
}


def test_license_lines_of_the_documents_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    wanted = {k: {LINES[x] for x in text.split("\n") if x in LINES} for k, text in texts.items()}
    assert {x for names in wanted.values() for x in names} == set(LINES.values())
    found = {r["doc_id"]: {x["template"] for x in r["licenses"]} for r in license_scan.scan(docs).collect()}
    assert {k: names for k, names in wanted.items() if names} == {k: found[k] for k in wanted if wanted[k]}


@pytest.mark.parametrize("kind", ["BY", "BY-NC", "BY-NC-ND", "BY-NC-SA", "BY-ND", "BY-SA"])
def test_short_creative_commons_lines_are_told_apart(spark, kind):
    rows = license_scan.scan(
        spark.createDataFrame([(1, f"A cold winter.\nLicensed under CC {kind} 4.0.\nThe end.")], "doc_id long, text string")
    ).collect()
    assert [x["template"] for x in rows[0]["licenses"]] == [f"cc-{kind.lower()}-4.0-short"]


def test_bands_reach_their_recall_for_the_smallest_template():
    # one shingle in a window of two places, the other held by another template
    assert license_scan.least_jaccard({"one": (1, 1), "long": (64, 64)}) == 52 / (64 + 128 - 52)
    assert license_scan.least_jaccard({"one": (1, 1)}) == 1 / 2
    assert license_scan.least_jaccard({"two": (2, 2), "five": (5, 8)}) == 4 / 17


def test_every_verbatim_template_is_found_amid_other_known_shingles(spark):
    """1,200 templates of one to five shingles, each between shingles of another template."""
    other = " ".join(f"w{k}" for k in range(60))
    lines = {f"line{n}": " ".join(f"{x}{n}" for x in "abcdefghi"[: 5 + n % 5]) for n in range(1200)}
    texts = spark.createDataFrame([(n, f"{other} {x} {other}") for n, x in enumerate(lines.values())], "doc_id long, text string")
    rows = license_scan.scan(texts, {"other": other, **lines}).collect()
    missed = [r["doc_id"] for r in rows if {x["template"] for x in r["licenses"]} != {"other", f"line{r['doc_id']}"}]
    assert missed == []
