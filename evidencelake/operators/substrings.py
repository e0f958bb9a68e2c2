"""Which short texts stand inside which longer ones: a join by winnowed fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import sent

#: Window lengths in bytes. A needle goes by the longest that it fills.
LENGTHS = (1, 2, 4, 8, 16, 32, 64)
PIECE = 1 << 20
#: Needles times bytes of texts up to which a group's needles and texts are all compared.
LIGHT = 1 << 26


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def window_minima(data: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """For each length, the least hash of the grams of half that length inside the window that
    starts at each byte. Hashes and minima of doubled lengths come from those of the single ones."""
    grams, size, out = _mix(data.astype(np.uint64) + np.uint64(1)), 1, {}
    for length in LENGTHS:
        if length > len(data) or length > max(lengths):
            break
        while size * 2 <= length // 2:
            grams = _mix(grams[:-size] * np.uint64(0xD6E8FEB86659FD93) + grams[size:])
            size *= 2
        if length not in lengths:
            continue
        least, wide, grams_in = grams, 1, length - size + 1
        while wide * 2 <= grams_in:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        rest = grams_in - wide
        out[length] = (np.minimum(least[: len(least) - rest], least[rest:]) if rest else least) + np.uint64(length)
    return out


def _prints(texts: pa.Array, lengths: tuple[int, ...], whole: bool) -> pa.Array:
    """The distinct window minima of each text; with ``whole`` only of windows that are all of
    their text. Goes through the bytes in pieces, so temporary arrays are as long as a piece."""
    if not len(texts):
        return pa.array([], pa.list_(pa.int64()))
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    rows, values = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for a in range(int(offsets[0]), int(offsets[-1]), PIECE):
        part = data[a : min(a + PIECE + max(lengths) - 1, int(offsets[-1]))]
        owner = np.searchsorted(offsets, np.arange(a, min(a + PIECE, int(offsets[-1]))), side="right") - 1
        for length, least in window_minima(part, lengths).items():
            least = least[:PIECE]
            at, row = a + np.arange(len(least)), owner[: len(least)]
            fits = at + length <= offsets[row + 1]
            if whole:
                fits &= offsets[row + 1] - offsets[row] == length
            row, least = row[fits], least[fits]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1])
            rows.append(row[new])
            values.append(least[new])
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    cuts = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(value.view(np.int64)))


def with_prints(df: DataFrame, text_col: str, lengths: tuple[int, ...], whole: bool = False) -> DataFrame:
    """The rows with ``print`` instead of the text, one row for each fingerprint."""
    keep = [c for c in df.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = _prints(batch.column(text_col), lengths, whole)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), prints], names=[*keep, "prints"])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "prints array<bigint>"])
    return df.mapInArrow(run, schema).select(*keep, F.explode("prints").alias("print"))


def heavy_groups(needles: DataFrame, texts: DataFrame, on: tuple[str, ...], light: int = LIGHT) -> DataFrame | None:
    """The keys of the groups in which comparing each needle with each text (column text, of any
    form that is not shorter than what is compared) would go through more than ``light`` bytes; None if there are none."""
    count = needles.groupBy(*on).agg(F.count(F.lit(1)).alias("_needles"))
    size = texts.groupBy(*on).agg(F.sum(F.octet_length("text")).alias("_bytes"))
    over = F.col("_needles").cast("double") * F.col("_bytes") > light
    keys = sent(count.join(size, [*on]).where(over).select(*on))
    return None if keys.isEmpty() else keys


def contained(
    needles: DataFrame,
    texts: DataFrame,
    on: tuple[str, ...],
    heavy: DataFrame | None,
    *,
    needle_ids: tuple[str, ...],
    text_ids: tuple[str, ...],
    shortest: int = 1,
) -> DataFrame:
    """Pairs of a needle (on, needle_ids, needle) and a text (on, text_ids, text) that contains it,
    within equal ``on`` (nulls match nothing): on, needle_ids, text_ids, each pair once. Null or
    empty needles and null texts give nothing; null ids are kept.

    Groups that are ``heavy`` (``heavy_groups``) go by fingerprints, so that their needles do not meet
    all of their texts; in the others, which are small, that is cheaper than fingerprints.
    """
    keys = [*on]
    few = (needles, texts) if heavy is None else tuple(x.join(heavy, keys, "left_anti") for x in (needles, texts))
    pairs = few[0].where("needle <> ''").join(few[1].select(*on, *text_ids, "text"), keys)
    out = pairs.where(F.contains("text", F.col("needle"))).select(*on, *needle_ids, *text_ids)
    if heavy is not None:
        many = (x.join(heavy, keys, "left_semi") for x in (needles, texts))
        out = out.unionByName(by_prints(*many, on, needle_ids=needle_ids, text_ids=text_ids, shortest=shortest))
    return out.distinct()


def by_prints(
    needles: DataFrame, texts: DataFrame, on: tuple[str, ...], *, needle_ids: tuple[str, ...], text_ids: tuple[str, ...], shortest: int = 1
) -> DataFrame:
    """The pairs of ``contained`` by fingerprints.

    Grams of half a window are hashed and each window keeps its least hash. A needle's first
    window, as long as the needle allows up to 64 bytes, also stands in every text that contains the
    needle, so its one fingerprint is among the text's: a join by fingerprint finds every pair, and
    the texts themselves are compared then. Pairs that are compared share a gram of a quarter of the
    needle's bytes at least (of 32 for long needles), so they grow with the pairs that are found,
    not with all. Texts are moved once, not with their fingerprints. Needles have ``shortest`` bytes
    or more: with less than that they may be left out, and texts carry fewer fingerprints for it.
    """
    lengths = tuple(n for n in LENGTHS if n * 2 > shortest)
    size = F.octet_length("needle")
    window = F.coalesce(*(F.when(size >= n, n) for n in reversed(lengths)))
    needles = needles.select(*on, *needle_ids, "needle").where(window.isNotNull())
    head = F.expr("cast(needle as binary)").substr(F.lit(1), window)
    looked = with_prints(needles.withColumn("_head", head), "_head", lengths, whole=True)
    texts = texts.select(*on, *text_ids, "text", F.xxhash64("text").alias("_code")).where("text is not null")
    held = with_prints(texts, "text", lengths)
    pairs = looked.join(held, [*on, "print"]).drop("print").distinct()
    texts = texts.select(*(F.col(c).alias(f"_t_{c}") for c in (*on, *text_ids)), F.col("_code").alias("_t__code"), "text")
    same = F.lit(True)
    for c in (*on, "_code", *text_ids):
        same = same & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    return pairs.join(texts, same).where(F.contains("text", F.col("needle"))).select(*on, *needle_ids, *text_ids).distinct()
