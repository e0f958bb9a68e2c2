"""Line dedup by overlapping three-line windows.

Every run of ``width`` consecutive filled lines of a text is hashed; a window that occurs
several times in the corpus stays where it occurs first, and everywhere else its lines are
removed. Overlapping windows of a text are merged to ranges first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 3
_BLANKS = " \t\r\x0b\x0c"


def _windows(text: Column, width: int) -> Column:
    """Array of (k, a, b, h1, h2): the k-th window, its first and last line, its hashes.

    Lines are compared without white space at their ends; lines of nothing else don't count.
    """
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(_BLANKS)).alias("line")))
    filled = F.filter(lines, lambda x: x["line"] != "")

    def window(own: Column) -> Column:
        def one(k: Column) -> Column:
            parts = [own[k + j]["line"] for j in range(width)]
            return F.struct(
                k.alias("k"), own[k]["at"].alias("a"), own[k + width - 1]["at"].alias("b"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *reversed(parts)).alias("h2")
            )

        return F.when(F.size(own) >= width, F.transform(F.sequence(F.lit(0), F.size(own) - width), one))

    # one-element array: the filled lines are worked out once for all windows
    return F.flatten(F.transform(F.array(filled), window))


def repeated_ranges(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, code, ranges): the lines to remove from each text that has any, as ascending
    ranges (a, b) of line numbers from 0; code is a hash of the text.

    The first of several occurrences is that of the smallest id (null first), then code,
    then place. Rows with the same id and text count as one.
    """
    key = F.struct("id", "code", "k")
    rows = df.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("code"),
        F.explode(_windows(F.col(text_col), width)).alias("w"),
    ).select("id", "code", "w.*")
    often = rows.groupBy("h1", "h2").agg(
        F.min(key).alias("first"),
        F.max(key).alias("last"),
    ).where(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    later = rows.join(often, ["h1", "h2"]).where(~key.eqNullSafe(F.col("first"))).select("id", "code", "k", "a", "b").distinct()
    order = Window.partitionBy("id", "code").orderBy("k")
    island = F.sum(F.when(F.col("k") - F.lag("k").over(order) < width, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = later.withColumn("island", island).groupBy("id", "code", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.groupBy("id", "code").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("ranges"))


def remove_repeated(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    removed_col: str = "lines_removed",
    width: int = WIDTH,
) -> DataFrame:
    """``df`` with later occurrences of repeated windows cut from the texts, and the number
    of lines removed (blank lines inside a removed range are removed with it).

    All rows and columns stay (a column named ``removed_col`` is replaced). A null text stays
    null, a text of fewer than ``width`` filled lines stays as it is, and one of which
    nothing is left becomes empty. Two shuffles of hashes and one of texts; a window that
    a third of all texts share is summed before the shuffle, and the join back to it is one
    that adaptive execution can split.
    """
    ranges = repeated_ranges(df, id_col=id_col, text_col=text_col, width=width)
    kept = [c for c in df.columns if c != removed_col]
    own = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_code"))
    joined = own.join(ranges, own["_id"].eqNullSafe(ranges["id"]) & (own["_code"] == ranges["code"]), "left")
    lines = F.split(F.col("row")[text_col], "\n", -1)
    left = F.filter(lines, lambda x, i: ~F.exists("ranges", lambda r: i.between(r["a"], r["b"])))
    gone = F.aggregate("ranges", F.lit(0), lambda n, r: n + r["b"] - r["a"] + 1)
    text = F.when(F.col("ranges").isNull(), F.col("row")[text_col]).otherwise(F.array_join(left, "\n"))
    return joined.select(*(text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in kept), F.coalesce(gone, F.lit(0)).alias(removed_col))
