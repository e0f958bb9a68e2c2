from evidencelake.llm import mixing, pipeline, queries
from tests.llm.test_jaccard_join import plain as near_plain
from tests.llm.test_line_dedup import plain as lines_plain
from tests.llm.test_mixing import plain as mix_plain

D = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = {}
    for name, step in pipeline.STAGES:
        out = step(spark, docs, D)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != "tokens":
            assert set(docs.columns) == set(pipeline.COLUMNS)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    there = {r["doc_id"] for r in kept["quality"]}
    assert sum((k in there) == bool(q) for k, q in labels.items()) >= 0.9 * len(labels)

    wanted = lines_plain(sorted((r["doc_id"], r["text"]) for r in kept["quality"]))
    wanted = {k: t for k, (t, n) in wanted.items() if t.strip() or not n}
    assert {r["doc_id"]: r["text"] for r in kept["lines"]} == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in kept["lines"])

    groups = near_plain([(r["doc_id"], r["text"]) for r in kept["lines"]])
    assert {r["doc_id"] for r in kept["near_duplicates"]} == {k for k, (c, _) in groups.items() if c == k}

    def leaf(r):
        number = int(r["source"][3:])
        return ("crawl" if r["source"] == "src0" else "web" if number < 12 else "curated", r["lang"], r["source"])

    rows = [(r["doc_id"], leaf(r), -(-len(r["text"]) // 4)) for r in kept["near_duplicates"]]
    size = {}
    for _, x, t in rows:
        size[x] = size.get(x, 0) + t
    given = mixing.leaf_budgets(int(pipeline.MIX_SHARE * sum(size.values())), size, queries.MIX_WEIGHTS)
    assert {r["doc_id"] for r in kept["mix"]} == {k for k, _ in mix_plain(rows, given, 17)}

    assert {r["doc_id"] for r in kept["tokens"]} == {r["doc_id"] for r in kept["mix"]}
    assert all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in kept["tokens"])
    assert sorted(map(str, pipeline.run(spark, D).collect())) == sorted(map(str, kept["tokens"]))


def test_stages_handle_odd_documents(spark, odd):
    docs = odd.select(*pipeline.COLUMNS)
    for name, step in pipeline.STAGES:
        out = step(spark, docs, D)
        assert out.count() <= odd.count(), name
        assert step(spark, docs.limit(0), D).count() == 0, name
    left = pipeline.near_duplicates(spark, docs, D).collect()
    assert sum(r["doc_id"] in (105, 106) for r in left) == 1


def test_texts_that_share_an_id_are_judged_each_for_itself(spark):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join([*words[:30], "x", *words[31:]]), " ".join(f"v{k}" for k in range(60)), "", "alone"]
    rows = [(3, texts[0]), (5, texts[1]), (5, texts[2]), (None, texts[1]), (None, texts[3]), (None, texts[4]), (3, texts[0])]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r["doc_id"]), r["text"]) for r in pipeline.near_duplicates(spark, docs, D).collect())
    assert got == sorted([("3", texts[0]), ("5", texts[2]), ("None", ""), ("None", "alone")])


def test_structured_words_are_not_duplicates(spark):
    from tests.llm.test_jaccard_join import thue_morse

    one = thue_morse(1024)
    docs = spark.createDataFrame(
        [(1, one, "en", "s", 1024), (2, one.translate(str.maketrans("ab", "ba")), "en", "s", 1024)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    assert pipeline.near_duplicates(spark, docs, D).count() == 2
