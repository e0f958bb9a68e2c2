"""Knowledge units: runs of paragraphs, merged and split; titles, tables, figures, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .structure import SPACE

MIN_WORDS = 4
MAX_WORDS = 250
#: What units say of themselves where their text does not.
ABSTRACT, KEYWORDS, AUTHORS = "Abstract", "Keywords (index terms)", "Authors and affiliations (title page)"
SECTION, REFERENCE = "Section: ", "Bibliography reference ["
_PLACEHOLDER = {"table": "Untitled table", "figure": "Untitled figure"}


def word_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.size(F.filter(F.split(text, SPACE + "+", -1), lambda x: x != ""))


def paragraph_runs(items: DataFrame, order_col: str = "pos") -> DataFrame:
    """Attached items in order to paragraphs with run (from 0 in each document) and front
    (whether only paragraphs without a section came so far): a table, a figure or another
    section ends a run."""
    order = Window.partitionBy("doc_id").orderBy(order_col)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    previous = F.lag(F.struct("kind", "section_pos")).over(order)
    new = (F.col("kind") == "paragraph") & (
        previous.isNull() | (previous["kind"] != "paragraph") | ~previous["section_pos"].eqNullSafe(F.col("section_pos"))
    )
    run = F.sum(new.cast("int")).over(upto) - 1
    front = ~F.max((F.col("kind") != "paragraph") | F.col("section_pos").isNotNull()).over(upto)
    return items.withColumn("run", run).withColumn("front", front).where("kind = 'paragraph'")


def merge_tiny(runs: DataFrame, min_words: int = MIN_WORDS, order_col: str = "pos") -> DataFrame:
    """Paragraphs with a run to blocks: doc_id, run, block, section_pos, front (where the rows
    have it), first_pos (by ``order_col``), n_paragraphs, text.

    A block below ``min_words`` takes in the next paragraph; a last one below it joins the
    block before; a run of nothing else is one block. Each run is folded once; the fold's
    state is the blocks done, by their first paragraph, and the words of the open one.
    """
    rows = runs.withColumn("words", word_count(F.col("text")))
    part = F.struct(F.col(order_col).alias("pos"), "words", "text")
    keys = ["doc_id", "run", "section_pos", *(["front"] if "front" in runs.columns else [])]
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    start = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(min_words).alias("open"), F.lit(0).alias("i"))

    def step(state: Column, x: Column) -> Column:
        closed = state["open"] >= min_words
        return F.struct(
            F.when(closed, F.array_append(state["cuts"], state["i"])).otherwise(state["cuts"]).alias("cuts"),
            F.when(closed, x["words"]).otherwise(state["open"] + x["words"]).alias("open"),
            (state["i"] + 1).alias("i"),
        )

    cuts = F.aggregate(
        "parts",
        start,
        step,
        lambda s: F.when((s["open"] < min_words) & (F.size(s["cuts"]) > 1), F.slice(s["cuts"], 1, F.size(s["cuts"]) - 1)).otherwise(s["cuts"]),
    )
    grouped = grouped.withColumn("cuts", cuts)
    blocks = grouped.select(*keys, "parts", "cuts", F.posexplode("cuts").alias("block", "a"))
    end = F.coalesce(F.get("cuts", F.col("block") + 1), F.size("parts"))
    own = F.slice("parts", F.col("a") + 1, end - F.col("a"))
    return blocks.select(
        *keys,
        "block",
        F.element_at(own, 1)["pos"].alias("first_pos"),
        F.size(own).alias("n_paragraphs"),
        F.array_join(F.transform(own, lambda x: x["text"]), " ").alias("text"),
    )


def split_oversized(blocks: DataFrame, keys: tuple[str, ...], max_words: int = MAX_WORDS, text_col: str = "text") -> DataFrame:
    """Blocks to parts: the keys, part (from 0), text, words.

    Sentences are packed until the next would exceed ``max_words``; a new part starts with
    the last sentence of the one before it, and counts from the two of them. Sentences are
    never cut. Blank texts have no part.
    """
    sentences = F.filter(F.transform(F.split(F.col(text_col), rf"(?<=[.!?]){SPACE}+", -1), lambda x: F.trim(x)), lambda x: x != "")
    rows = blocks.select(*keys, sentences.alias("s")).where(F.size("s") > 0)
    rows = rows.withColumn("w", F.transform("s", word_count))
    start = F.struct(F.array(F.lit(0)).alias("cuts"), F.lit(0).alias("words"), F.lit(0).alias("last"), F.lit(0).alias("i"))

    def step(state: Column, w: Column) -> Column:
        over = (state["i"] > 0) & (state["words"] + w > max_words)
        return F.struct(
            F.when(over, F.array_append(state["cuts"], state["i"])).otherwise(state["cuts"]).alias("cuts"),
            (F.when(over, state["last"]).otherwise(state["words"]) + w).alias("words"),
            w.alias("last"),
            (state["i"] + 1).alias("i"),
        )

    rows = rows.withColumn("cuts", F.aggregate("w", start, step, lambda s: s["cuts"]))
    parts = rows.select(*keys, "s", "cuts", F.posexplode("cuts").alias("part", "a"))
    first = F.greatest(F.col("a") - 1, F.lit(0))
    end = F.coalesce(F.get("cuts", F.col("part") + 1), F.size("s"))
    text = F.array_join(F.slice("s", first + 1, end - first), " ")
    return parts.select(*keys, "part", text.alias("text")).withColumn("words", word_count(F.col("text")))


def front_matter_label(rows: DataFrame) -> DataFrame:
    """Paragraphs or parts of blocks (front, text) with ``context``: before any section, table
    or figure, what their first words say they are; null elsewhere."""
    text = F.lower("text")
    label = F.when(
        text.rlike(rf"^{SPACE}*abstract\b"),
        ABSTRACT,
    ).when(text.rlike(rf"^{SPACE}*(index{SPACE}+terms|keywords)\b"), KEYWORDS).otherwise(AUTHORS)
    return rows.withColumn("context", F.when(F.col("front"), label))


def section_context(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """Blocks with ``context``: 'Section: ' and the title of their section, null without one."""
    titles = sections.select("doc_id", F.col("pos").alias("section_pos"), F.concat(F.lit(SECTION), "text").alias("context"))
    return blocks.join(titles, ["doc_id", "section_pos"], "left")


def single_units(rows: DataFrame, kind: str, text: Column, context: Column | None = None) -> DataFrame:
    """One unit for each row with a filled text: doc_id, kind, text, context."""
    out = rows.select(
        "doc_id",
        F.lit(kind).alias("kind"),
        F.trim(text).alias("text"),
        (F.lit(None).cast("string") if context is None else context).alias("context"),
    )
    return out.where("text <> ''")


def reference_units(entries: DataFrame) -> DataFrame:
    """One unit for each bibliography entry; its context has the number it is cited by."""
    context = F.concat(F.lit(REFERENCE), (F.col("entry") + 1).cast("string"), F.lit("]"))
    return entries.select("doc_id", "entry", "text", context.alias("context"))


def visual_units(
    items: DataFrame,
    captions: DataFrame,
    kinds: str | tuple[str, ...],
    number: DataFrame | None = None,
    body: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Units of the items that are of one of the ``kinds`` (table, figure): caption, blank line,
    body, whichever exist, or a placeholder; context is the kind and the printed number, if there is one.
    Of several captions of a subject the first by text counts, of several numbers the smallest.
    ``keep``: further columns of the items."""
    kinds = (kinds,) if isinstance(kinds, str) else kinds
    subject = ("doc_id", F.col("subject_pos").alias("pos"), F.col("subject_type").alias("kind"))
    own = captions.where(F.col("subject_type").isin(*kinds)).groupBy(*subject).agg(F.min("text").alias("caption"))
    rows = items.where(F.col("kind").isin(*kinds)).join(own, ["doc_id", "pos", "kind"], "left")
    if number is not None:
        numbers = number.where(F.col("subject_type").isin(*kinds)).groupBy(*subject).agg(F.min("number").alias("number"))
        rows = rows.join(numbers, ["doc_id", "pos", "kind"], "left")
    else:
        rows = rows.withColumn("number", F.lit(None).cast("int"))
    text = F.concat_ws(
        "\n\n",
        F.nullif(F.trim("caption"), F.lit("")),
        F.nullif(F.trim(body), F.lit("")) if body is not None else F.lit(None).cast("string"),
    )
    placeholder = F.create_map(*(F.lit(x) for item in _PLACEHOLDER.items() for x in item))[F.col("kind")]
    return rows.select(
        "doc_id",
        "pos",
        F.coalesce(F.nullif(text, F.lit("")), placeholder).alias("text"),
        F.concat_ws(" ", F.initcap("kind"), F.col("number").cast("string")).alias("context"),
        *keep,
    )


def assemble_units(parts: dict[str, DataFrame]) -> DataFrame:
    """Units of all kinds with one gap-free order for each document: doc_id, ord, kind, pos,
    part, text, context, words. ``parts`` has title, abstract, body kinds and references, in
    that order; body kinds share their reading positions. Rows with a column kind are of that kind."""
    rank = {"title": 0, "abstract": 1, "reference": 3}
    every = None
    for kind, df in parts.items():
        columns = [F.col(c) if c in df.columns else F.lit(0).alias(c) for c in ("pos", "part")]
        context = F.col("context") if "context" in df.columns else F.lit(None).cast("string").alias("context")
        rows = df.select("doc_id", (F.col("kind") if "kind" in df.columns else F.lit(kind).alias("kind")), F.lit(rank.get(kind, 2)).alias("_rank"), *columns, "text", context)
        every = rows if every is None else every.unionByName(rows)
    order = Window.partitionBy("doc_id").orderBy("_rank", "pos", "part")
    words = F.when(~F.col("kind").isin("table", "figure"), word_count(F.col("text")))
    return every.withColumn("ord", F.row_number().over(order) - 1).withColumn("words", words).drop("_rank")
