"""Answer plans, evidence context, claims and citations of supplied answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import CLAIM_STOPWORDS, share, terms
from .structure import SPACE

#: The wordings that tell a question's type, in the order of the tests.
MARKERS = {
    "comparative": (
        "compare",
        "comparison",
        "versus",
        " vs ",
        "vs.",
        "difference between",
        "differences between",
        "better than",
        "compared to",
        "compared with",
    ),
    "procedural": ("how to", "how do", "how does one", "steps to", "procedure for", "process for"),
    "citation": ("who wrote", "which paper", "cite", "citation", "reference", "according to"),
    "figure": ("figure", "chart", "graph", "diagram", "image", "plot", "architecture", "workflow", "illustration"),
    "table": ("table",),
    "descriptive": ("what is", "what are", "describe", "explain", "overview of"),
}
#: Groups and modality that an answer to each type needs.
PLANS = (
    ("factual", 1, None),
    ("descriptive", 1, None),
    ("comparative", 2, None),
    ("procedural", 1, None),
    ("multi_hop", 2, None),
    ("figure", 1, "figure"),
    ("table", 1, "table"),
    ("citation", 1, None),
)
#: How evidence that no citation names is announced, and added descriptions.
UNCITED, VISUAL = "Shown to the model as context (not cited in the answer)", "\n\nVisual analysis: "
RESERVED_TOKENS, CHARS_A_TOKEN = 512, 4
SUPPORT, MIN_LETTERS, GRAPH_SIMILARITY = 0.5, 3, 0.5
LABEL_GROUP = r"[\[(][ \t\n\r\f\x0B]*(KU[0-9]+(?:[ \t\n\r\f\x0B]*(?:,|;|and|&)[ \t\n\r\f\x0B]*KU[0-9]+)*)[ \t\n\r\f\x0B]*[\])]"


def classify(questions: DataFrame, bundles: DataFrame) -> DataFrame:
    """query_id, question_type from questions (query_id, text) and bundles (query_id, groups,
    top_modality, graph_found); a question without a bundle has no groups."""
    rows = questions.join(bundles, "query_id", "left")
    text = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))

    def has(kind: str) -> Column:
        test = F.lit(False)
        for marker in MARKERS[kind]:
            test = test | F.contains(text, F.lit(marker))
        return test

    top = F.coalesce("top_modality", F.lit(""))
    hops = (F.coalesce("groups", F.lit(0)) >= 3) & F.coalesce("graph_found", F.lit(False))
    kind = F.when(has("comparative"), "comparative").when(has("procedural"), "procedural").when(has("citation"), "citation")
    kind = kind.when(has("figure") | (top == "figure"), "figure").when(has("table") | (top == "table"), "table").when(hops, "multi_hop").when(has("descriptive"), "descriptive")
    return rows.select("query_id", kind.otherwise("factual").alias("question_type"))


def answer_plan(classified: DataFrame) -> DataFrame:
    """Classified questions with required_groups and required_modality."""
    rules = classified.sparkSession.createDataFrame(list(PLANS), "question_type string, required_groups int, required_modality string")
    return classified.join(F.broadcast(rules), "question_type")


def flatten(groups: DataFrame) -> DataFrame:
    """Members (query_id, group_rank, member_pos, id) with pos (from 1) in the context."""
    order = Window.partitionBy("query_id").orderBy("group_rank", "member_pos")
    return groups.withColumn("pos", F.row_number().over(order))


def remove_redundant(rows: DataFrame) -> DataFrame:
    """Rows (query_id, pos, text) whose text is in no earlier text of the question.
    Containment is transitive, so it does not matter whether the earlier one was kept."""
    earlier = rows.select(F.col("query_id").alias("q"), F.col("pos").alias("p"), F.col("text").alias("t"))
    return rows.join(earlier, (F.col("query_id") == F.col("q")) & (F.col("p") < F.col("pos")) & F.contains(F.col("t"), F.col("text")), "left_anti")


def fit(rows: DataFrame, window: int, max_tokens: int) -> DataFrame:
    """Rows that fit in order into the window; one that does not fit is skipped, later ones
    may. Adds tokens and label (KU1, KU2, ..)."""
    room = max(window - max_tokens - RESERVED_TOKENS, 0)
    size = F.greatest(F.floor(F.char_length("text") / CHARS_A_TOKEN), F.lit(1))
    rows = rows.withColumn("tokens", size)
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + x["tokens"] <= room
        return F.struct(
            F.when(fits, s["used"] + x["tokens"]).otherwise(s["used"]).alias("used"),
            F.when(fits, F.array_append(s["kept"], x["pos"].cast("long"))).otherwise(s["kept"]).alias("kept"),
        )

    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tokens"))).alias("l"))
    kept = lists.select("query_id", F.posexplode(F.aggregate("l", start, step, lambda s: s["kept"])).alias("n", "pos"))
    return rows.join(kept, ["query_id", "pos"]).withColumn("label", F.concat(F.lit("KU"), (F.col("n") + 1).cast("string"))).drop("n")


def prompt_rows(context: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, prompt: the evidence block and the question, as one text."""
    identity = F.when(F.nullif("context", F.lit("")).isNotNull(), F.concat(F.lit(" ("), "context", F.lit(")"))).otherwise("")
    line = F.concat(F.lit("["), "label", F.lit("]"), identity, F.lit(" "), "text")
    blocks = context.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]).alias("lines")
    )
    rows = questions.select("query_id", "text").join(blocks, "query_id", "left")
    lines = F.concat(
        F.array(F.lit("Evidence:")),
        F.coalesce("lines", F.array().cast("array<string>")),
        F.array(F.lit(""), F.concat(F.lit("Question: "), "text")),
    )
    return rows.select("query_id", F.array_join(lines, "\n").alias("prompt"))


def prompt_checks(context: DataFrame, questions: DataFrame, room: int) -> DataFrame:
    """Every violation as a row: query_id, rule, detail."""
    out = lambda df, rule, detail: df.select("query_id", F.lit(rule).alias("rule"), detail.alias("detail"))
    tokens = context.groupBy("query_id").agg(F.sum("tokens").alias("tokens")).where(F.col("tokens") > room)
    none = questions.join(context, "query_id", "left_anti")
    twice = context.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    labels = context.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    checks = (
        out(
            tokens,
            "token_budget",
            F.col("tokens").cast("string"),
        ), out(none, "no_evidence", F.lit(None).cast("string")), out(twice, "duplicate_unit", F.col("id")),
        out(
            context.where(~F.col("label").rlike("^KU[0-9]+$")),
            "malformed_label",
            F.col("label"),
        ), out(labels, "repeated_label", F.col("label")), out(questions.where("trim(text) = ''"), "blank_question", F.lit(None).cast("string")),
    )
    every = checks[0]
    for df in checks[1:]:
        every = every.unionByName(df)
    return every


def figure_notes(context: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Context of figure questions (question_type) with descriptions (id, description) added
    to figure evidence, and a note; other rows have no note."""
    rows = context.join(descriptions, "id", "left")
    own = (F.col("question_type") == "figure") & (F.col("modality") == "figure")
    text = F.when(own & F.col("description").isNotNull(), F.concat("text", F.lit(VISUAL), "description")).otherwise(F.col("text"))
    note = F.when(
        own,
        F.concat(
            "label",
            F.when(F.col("description").isNotNull(), ": figure image analyzed").otherwise(": visual analysis unavailable; caption only"),
        ),
    )
    return rows.withColumn("text", text).withColumn("note", note).drop("description")


def citation_labels(text: Column) -> Column:
    """Labels in order of appearance, repeats included, from groups of labels alone."""
    groups = F.regexp_extract_all(text, F.lit(LABEL_GROUP), 1)
    return F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit("(KU[0-9]+)"), 1)))


def claims(answers: DataFrame) -> DataFrame:
    """Sentences of answers with three letters or more: answer_id, claim (from 0), text."""
    parts = F.transform(F.split(F.btrim("text", F.lit(" \t\n\r\f\v")), rf"(?<=[.!?]){SPACE}+", -1), lambda x: F.btrim(x, F.lit(" \t\n\r\f\v")))
    parts = F.filter(parts, lambda x: F.regexp_count(x, F.lit(r"\p{L}")) >= MIN_LETTERS)
    return answers.select("answer_id", F.posexplode(parts).alias("claim", "text"))


def verdicts(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """answer_id, claim, labels, verdict: missing_citation, unresolved_citation, grounded or
    unsupported. Evidence: answer_id, label, context, text."""
    rows = claims.withColumn("labels", citation_labels(F.col("text")))
    cited = rows.select("answer_id", "claim", F.explode("labels").alias("label")).distinct()
    own = evidence.select("answer_id", "label", terms(F.concat_ws(" ", "context", "text"), CLAIM_STOPWORDS).alias("found"))
    known = cited.join(own, ["answer_id", "label"], "left").groupBy("answer_id", "claim").agg(
        F.count_if(F.col("found").isNull()).alias("unknown"),
        F.flatten(F.collect_list("found")).alias("found"),
    )
    rows = rows.join(known, ["answer_id", "claim"], "left")
    support = share(terms(F.col("text"), CLAIM_STOPWORDS), F.col("found"))
    verdict = F.when(F.size("labels") == 0, "missing_citation").when(F.col("unknown") > 0, "unresolved_citation").when(
        F.coalesce(support, F.lit(1.0)) >= SUPPORT,
        "grounded",
    ).otherwise("unsupported")
    return rows.select("answer_id", "claim", "labels", verdict.alias("verdict"))


def grounding_summary(verdicts: DataFrame) -> DataFrame:
    """answer_id, claims, grounded, ratio."""
    out = verdicts.groupBy("answer_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("verdict") == "grounded").alias("grounded"))
    return out.withColumn("ratio", F.round(F.col("grounded") / F.col("claims"), 9))


def resolve_citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """answer_id, n (from 1), label, ku_id (null: unresolved). Labels in order of their first
    appearance, then those whose context an answer quotes in parentheses, in order of place
    and label."""
    used = answers.select(
        "answer_id",
        F.posexplode(citation_labels(F.col("text"))).alias("p", "label"),
    ).groupBy("answer_id", "label").agg(F.min("p").alias("p"))
    quoted = evidence.where("context <> ''").join(answers.select("answer_id", F.col("text").alias("answer")), "answer_id")
    quoted = quoted.select("answer_id", "label", F.instr("answer", F.concat(F.lit("("), "context", F.lit(")"))).alias("p")).where("p > 0")
    quoted = quoted.join(used.select("answer_id", "label"), ["answer_id", "label"], "left_anti")
    every = used.withColumn("kind", F.lit(0)).unionByName(quoted.withColumn("kind", F.lit(1)))
    n = F.row_number().over(Window.partitionBy("answer_id").orderBy("kind", "p", "label"))
    return every.withColumn("n", n).join(
        evidence.select("answer_id", "label", "ku_id"),
        ["answer_id", "label"],
        "left",
    ).select("answer_id", "n", "label", "ku_id")


def quality(answers: DataFrame, primaries: DataFrame, plans: DataFrame, context: DataFrame, grounding: DataFrame, citations: DataFrame) -> DataFrame:
    """Four parts, their mean (confidence) and the status of each answer (answer_id, query_id).

    primaries: query_id, dense of each group's first unit; plans: query_id, required_groups,
    required_modality; context: query_id, modality of each unit shown; grounding: answer_id,
    ratio; citations: answer_id, ku_id.
    """
    retrieval = primaries.groupBy("query_id").agg(
        F.avg(F.coalesce("dense", F.lit(GRAPH_SIMILARITY))).alias("retrieval"),
        F.count(F.lit(1)).alias("groups"),
    )
    shown = context.groupBy("query_id").agg(F.collect_set("modality").alias("shown"))
    cited = citations.groupBy("answer_id").agg((F.count("ku_id") / F.count(F.lit(1))).alias("coverage"))
    rows = answers.select("answer_id", "query_id").join(plans, "query_id", "left").join(retrieval, "query_id", "left").join(shown, "query_id", "left").join(grounding.select("answer_id", "ratio"), "answer_id", "left").join(cited, "answer_id", "left")
    rows = rows.withColumn(
        "retrieval",
        F.coalesce("retrieval", F.lit(0.0)),
    ).withColumn("ratio", F.coalesce("ratio", F.lit(0.0))).withColumn("coverage", F.coalesce("coverage", F.lit(1.0)))
    enough = F.least(F.coalesce("groups", F.lit(0)) / F.col("required_groups"), F.lit(1.0))
    modal = F.when(
        F.col("required_modality").isNull() | F.coalesce(F.array_contains("shown", F.col("required_modality")), F.lit(False)),
        1.0,
    ).otherwise(0.0)
    rows = rows.withColumn("completeness", (enough + modal) / 2)
    status = F.when(F.col("shown").isNull(), "insufficient").when(
        (F.col("ratio") >= 1) & (F.col("completeness") >= 1),
        "sufficient",
    ).when(F.col("ratio") > 0, "partially_sufficient").otherwise("unverified")
    mean = (F.col("retrieval") + F.col("ratio") + F.col("coverage") + F.col("completeness")) / 4
    r = lambda c: F.round(c, 6)
    return rows.select(
        "answer_id",
        r(F.col("retrieval")).alias("retrieval"),
        r(F.col("ratio")).alias("ratio"),
        r(F.col("coverage")).alias("coverage"),
        r(F.col("completeness")).alias("completeness"),
        r(mean).alias("confidence"),
        status.alias("status"),
    )


def first_sentence(text: Column) -> Column:
    """Up to the first mark that ends a sentence before a space; the text if there is none."""
    ends = [F.nullif(F.instr(text, F.lit(mark)), F.lit(0)) for mark in (". ", "! ", "? ")]
    end = F.least(*ends)
    return F.coalesce(F.substring(text, F.lit(1), end), text)


def report(answers: DataFrame, evidence: DataFrame, citations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row for each answer: summary, support ('label id discovery' of what is cited, or of
    all that was shown where nothing resolves), references, unverified claims, unresolved
    citations, limitations and warnings."""
    resolved = citations.where("ku_id is not null").join(evidence.select("answer_id", "label", "discovery", "text"), ["answer_id", "label"])
    listed = lambda line, order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("line")))), lambda x: x["line"]), "\n")
    cited = resolved.groupBy("answer_id").agg(
        listed(F.concat_ws(" ", "label", "ku_id", "discovery"), F.col("n")).alias("cited"),
        listed(F.concat(F.lit("["), "label", F.lit("] "), "text"), F.col("n")).alias("references"),
    )
    shown = evidence.groupBy("answer_id").agg(listed(F.concat_ws(" ", "label", "ku_id", F.lit(UNCITED)), F.col("label")).alias("shown"))
    counts = verdicts.groupBy("answer_id").agg(F.count_if(F.col("verdict") != "grounded").alias("unverified"))
    lost = citations.groupBy("answer_id").agg(F.count_if(F.col("ku_id").isNull()).alias("unresolved"))
    rows = answers.join(cited, "answer_id", "left").join(shown, "answer_id", "left").join(counts, "answer_id", "left").join(lost, "answer_id", "left")
    unverified, unresolved = F.coalesce("unverified", F.lit(0)), F.coalesce("unresolved", F.lit(0))
    return rows.select(
        "answer_id", first_sentence(F.col("text")).alias("summary"), F.coalesce("cited", "shown").alias("support"), F.coalesce("references", F.lit("")).alias("references"),
        F.when(
            unverified > 0,
            F.concat(unverified.cast("string"), F.lit(" statement(s) could not be verified against the evidence")),
        ).alias("limitations"),
        F.when(unresolved > 0, F.concat(unresolved.cast("string"), F.lit(" citation(s) referred to evidence that was not shown"))).alias("warnings"),
    )
