"""Typed links between knowledge units: continuations, citations, mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .structure import SPACE

#: The digits of roman numerals.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
_TOKEN = r"[0-9]+|[ivxlcdmIVXLCDM]+\b"


def parse_number(token: Column) -> Column:
    """Value of an arabic or roman number in any case; null for anything else. Roman digits
    need not be in their usual form: each counts against the number if a larger one is
    anywhere behind it (IIII is 4, IC is 99)."""
    value = F.create_map(*(F.lit(v) for item in ROMAN.items() for v in item))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("most"))

    def step(state: Column, digit: Column) -> Column:
        x = value[digit]
        return F.struct(
            (state["total"] + F.when(x < state["most"], -x).otherwise(x)).alias("total"),
            F.greatest(state["most"], x).alias("most"),
        )

    # from the last digit to the first, with the largest of those behind it
    total = F.aggregate(F.reverse(F.split(F.upper(token), "")), start, step, lambda s: F.when(s["total"] > 0, s["total"]))
    roman = F.when(token.rlike("^[ivxlcdmIVXLCDM]{1,100}$"), total)
    return F.when(token.rlike("^[0-9]{1,9}$"), token.try_cast("int")).otherwise(roman)


def printed_numbers(captions: DataFrame) -> DataFrame:
    """The number printed at the start of each caption; of several captions of a document and
    kind with one number the first subject has it: doc_id, subject_type, subject_pos, number."""
    token = F.regexp_extract("text", rf"^[ \t]*(?i:figure|fig\.?|table)[ \t]+({_TOKEN})", 1)
    rows = captions.withColumn("number", parse_number(token)).where("number is not null")
    return rows.groupBy("doc_id", "subject_type", "number").agg(F.min("subject_pos").alias("subject_pos"))


def edges_continues(parts: DataFrame, keys: tuple[str, ...], part_col: str = "part") -> DataFrame:
    """Each part of a split block to the next: the keys, source, target."""
    order = Window.partitionBy(*keys).orderBy(part_col)
    return parts.select(*keys, F.col(part_col).alias("source"), F.lead(part_col).over(order).alias("target")).where("target is not null")


def edges_cites(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """``[n]`` marks of texts (doc_id, pos, text) to the n-th bibliography entry, once for
    each pair; marks without an entry are dropped: doc_id, source_pos, target_entry."""
    marks = texts.select("doc_id", F.col("pos").alias("source_pos"), F.explode(F.regexp_extract_all("text", F.lit(r"\[([0-9]+)\]"), 1)).alias("mark"))
    marks = marks.select("doc_id", "source_pos", (F.col("mark").try_cast("int") - 1).alias("target_entry"))
    return marks.join(
        entries.select("doc_id", F.col("entry").alias("target_entry")),
        ["doc_id", "target_entry"],
    ).select("doc_id", "source_pos", "target_entry").distinct()


def edges_references(texts: DataFrame, numbers: DataFrame) -> DataFrame:
    """Mentions such as 'Figure 2' or 'Table IV' to the subject with that printed number, once
    for each pair: doc_id, source_pos, subject_type, target_pos."""
    found = F.regexp_extract_all("text", F.lit(rf"\b((?i:figure|fig\.?|table){SPACE}+(?:{_TOKEN}))"), 1)
    rows = texts.select("doc_id", F.col("pos").alias("source_pos"), F.explode(found).alias("m"))
    kind = F.when(F.lower("m").startswith("table"), "table").otherwise("figure")
    rows = rows.select("doc_id", "source_pos", kind.alias("subject_type"), parse_number(F.regexp_extract("m", "([0-9A-Za-z]+)$", 1)).alias("number"))
    own = numbers.select("doc_id", "subject_type", "number", F.col("subject_pos").alias("target_pos"))
    return rows.join(own, ["doc_id", "subject_type", "number"]).select("doc_id", "source_pos", "subject_type", "target_pos").distinct()


def citation_counts(entries: DataFrame, cites: DataFrame) -> DataFrame:
    """Number of incoming citations of each entry, 0 included."""
    counts = cites.groupBy("doc_id", F.col("target_entry").alias("entry")).agg(F.count(F.lit(1)).alias("citations"))
    return entries.join(counts, ["doc_id", "entry"], "left").select("doc_id", "entry", F.coalesce("citations", F.lit(0)).alias("citations"))
