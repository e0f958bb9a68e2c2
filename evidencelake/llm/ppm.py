"""Language identification by prediction by partial matching (PPM).

Each language has a context tree of byte contexts up to ``ORDER`` bytes long with the
counts of the bytes that follow. A byte's probability is that of the longest context of
the text's tree; where the byte is new there, an escape (method C: as probable as the
number of distinct followers) leads to the next shorter context, without the bytes that
the longer one has already ruled out, and last to the 256 bytes alike. The statistics are
frozen after fitting, so a text's code length is a sum over its positions, which numpy
looks up for a whole batch at once. Code lengths are counted in whole units of 2**-24 bit, so
that a sum does not depend on the order or the pieces it is taken in: equal texts have equal
code lengths, whatever batch they come in. The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import drop, stage
from .text import slices, utf8

ORDER = 3
MAX_DOCS = 2000
MAX_GRAMS = 1 << 20
MAX_LANGS = 1000
PIECE_BYTES = 1 << 19
_UNIT = float(1 << 24)
UNKNOWN = "und"
_HASH = np.uint32(2654435761)


def _grams(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each byte, itself with the three before it as one number (earlier texts' bytes
    replaced by zeros); ``place`` is its position in its own text."""
    d = data.astype(np.uint32)
    code = d.copy()
    for k in range(1, ORDER + 1):
        part = np.zeros_like(d)
        part[k:] = d[:-k] << np.uint32(8 * k)
        part[place < k] = 0
        code |= part
    return code


def _pieces(data: np.ndarray, offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owner, place, code) of the bytes of all texts, so many bytes at a time. A piece looks
    back at the bytes before it, so that a long text's grams are those of the whole."""
    for at in range(0, len(data), most):
        back, end = max(at - ORDER, 0), min(at + most, len(data))
        low, high = np.searchsorted(offsets, [back, end], side="right") - 1
        ends = np.clip(offsets[low : high + 2], back, end)
        owner = np.repeat(np.arange(low, low + len(ends) - 1), np.diff(ends))
        place = np.arange(back, end) - offsets[owner]
        code = _grams(data[back:end], place)
        yield owner[at - back :], place[at - back :], code[at - back :]


class _Index:
    """Where each of many 32-bit keys is in a table: open addressing, all keys at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(10, int(np.ceil(np.log2(max(len(keys), 1)))) + 2)
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        self.keys = keys
        left = np.arange(len(keys), dtype=np.int32)
        at = self._start(keys)
        self.probes = 0
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _HASH) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int32)
        at = self._start(keys)
        row = self.slots[at]
        wrong = np.flatnonzero((row >= 0) & (self.keys[row] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            row[wrong] = self.slots[at[wrong]]
            wrong = wrong[(row[wrong] >= 0) & (self.keys[row[wrong]] != keys[wrong])]
        return row


class Tree:
    """The frozen context tree of one language, from its counts of (context, byte)."""

    def __init__(self, code: np.ndarray, count: np.ndarray):
        self.levels = []  # of orders 0, 1, .. ORDER: gram keys and counts; sums by context
        for order in range(ORDER + 1):
            key = code & np.uint32((1 << (8 * (order + 1))) - 1) if order < 3 else code
            key, where = np.unique(key, return_inverse=True)
            n = np.bincount(where, weights=count, minlength=len(key))
            context, first = np.unique(key >> np.uint32(8), return_index=True)
            total = np.add.reduceat(n, first) if len(n) else n
            kinds = np.diff(np.append(first, len(key))).astype(float)
            self.levels.append(
                {"key": key, "n": n, "context": context, "total": total, "kinds": kinds, "grams": _Index(key), "contexts": _Index(context)}
            )
        for order in range(ORDER):
            # After an escape from a longer context its followers are ruled out here.
            low, high = self.levels[order], self.levels[order + 1]
            mask = np.uint32((1 << (8 * (order + 1))) - 1)
            inner = low["grams"].find(high["key"] & mask)
            owner = np.repeat(np.arange(len(high["context"])), high["kinds"].astype(int))
            gone = np.bincount(owner, weights=low["n"][inner], minlength=len(high["context"]))
            below = low["contexts"].find((high["context"] & (mask >> np.uint32(8))).astype(np.uint32))
            high["low_total"] = low["total"][below] - gone
            high["low_kinds"] = low["kinds"][below] - high["kinds"]

    def bits(self, code: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Code length of each byte given the bytes before it."""
        out = np.zeros(len(code))
        left = np.arange(len(code))
        escaped = np.full(len(code), -1)  # row of the longer context that was escaped from
        for order in range(ORDER, -1, -1):
            level = self.levels[order]
            mask = np.uint32((1 << (8 * (order + 1))) - 1) if order < 3 else np.uint32(0xFFFFFFFF)
            usable = place[left] >= order
            now, own = left[usable], code[left[usable]] & mask
            row = level["grams"].find(own)
            context = level["contexts"].find(own >> np.uint32(8))
            known = context >= 0
            from_above = escaped[now]
            total, kinds = level["total"][context], level["kinds"][context]
            if order < ORDER:
                above = self.levels[order + 1]
                cut = from_above >= 0
                total = np.where(cut, above["low_total"][from_above], total)
                kinds = np.where(cut, above["low_kinds"][from_above], kinds)
            hit = row >= 0
            with np.errstate(divide="ignore", invalid="ignore"):
                cost = np.log2(total + kinds) - np.log2(np.where(hit, level["n"][row], kinds))
            # an escape is certain, and free, where every follower is ruled out
            cost = np.where(known & (hit | (kinds > 0)), cost, 0.0)
            out[now] += cost
            escaped[now] = np.where(known, context, -1)
            left = np.concatenate((left[~usable], now[~hit]))
        seen = len(self.levels[0]["key"])
        out[left] += np.log2(max(256 - seen, 1))
        return out


class Model:
    """Trees of all languages, and their code lengths for all known grams in one table."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.trees = [Tree(*counts[x]) for x in self.langs]
        grams = np.unique(np.concatenate([x.levels[ORDER]["key"] for x in self.trees])) if self.trees else np.zeros(0, np.uint32)
        self.index = _Index(grams)
        full = np.full(len(grams), ORDER)
        self.table = np.stack([_units(x.bits(grams, full)) for x in self.trees], axis=1) if self.trees else None

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text (row) under each language (column), in units of 2**-24 bit."""
        sums = np.zeros((len(offsets) - 1, len(self.langs)), dtype=np.int64)
        for owner, place, code in _pieces(data, offsets):
            row = self.index.find(code)
            row[place < ORDER] = -1
            units = self.table[row] if len(self.table) else np.zeros((len(code), len(self.langs)), np.int64)
            rare = np.flatnonzero(row < 0)
            for k, tree in enumerate(self.trees):
                units[rare, k] = _units(tree.bits(code[rare], place[rare]))
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sums[owner[first]] += np.add.reduceat(units, first, axis=0)
        return sums


def _units(bits: np.ndarray) -> np.ndarray:
    return np.rint(bits * _UNIT).astype(np.int64)


def fit(
    df: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    max_docs: int = MAX_DOCS,
    max_grams: int = MAX_GRAMS,
    max_langs: int = MAX_LANGS,
) -> Model:
    """Frozen trees from texts with a language.

    Rows whose text or language is null are not learnt from. Fitted on a bounded sample:
    about ``max_docs`` distinct texts of each language, chosen by a hash of the text, all where
    there are fewer, so that no language is left out; copies of a text count once. The most
    frequent of their byte grams go to the driver, ``max_grams`` at most over all languages, as
    many of each (one at least), equal counts in the order of the grams. More than ``max_langs`` languages are an error: the column is not one of
    languages then.
    """
    known = df.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    coded = known.withColumn("code", F.xxhash64("text", F.lit("ppm")))
    sizes = coded.select("lang", "code").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_langs + 1).collect()
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not sizes:
        return Model({})
    share = [(r["lang"], int(min(1.0, max_docs / r["n"]) * (1 << 30))) for r in sizes]
    share = F.broadcast(df.sparkSession.createDataFrame(share, "lang string, share long"))
    drawn = coded.join(share, "lang").where(F.pmod("code", F.lit(1 << 30)) < F.col("share"))
    sample = drawn.groupBy("lang", "code").agg(F.first("text").alias("text")).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs = batch.column("lang").to_pylist()
            for lang in set(langs):
                data, offsets = utf8(pc.filter(batch.column("text"), pa.array([x == lang for x in langs])))
                for _, place, code in _pieces(data, offsets):
                    key, n = np.unique(code[place >= ORDER], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(key), pa.string()), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))],
                        names=["lang", "gram", "n"],
                    )

    counted = stage(sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    rows = _most_frequent(counted, max(1, max_grams // len(sizes))).toArrow()
    langs = np.asarray(rows["lang"].to_pylist(), dtype=object)
    gram, n = np.asarray(rows["gram"]).astype(np.uint32), np.asarray(rows["n"]).astype(float)
    for lang in sorted(r["lang"] for r in sizes):
        own = langs == lang
        if own.any():
            order = np.argsort(gram[own])
            found[lang] = (gram[own][order], n[own][order])
    drop(counted)
    return Model(found)


def _most_frequent(counted: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows of each language with the highest counts, equal ones in the order of
    the grams, so that every language keeps its whole share."""
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counted.withColumn("nth", nth).where(F.col("nth") <= most).select("lang", "gram", "n")


def predict(df: DataFrame, model: Model, *, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """``df`` with each text's language and the posterior probability of it, in place of any
    columns of the new names.

    ``und`` with score 0 where the text is null or has no letter, or where no language was
    learnt. Equal code lengths go to the first language by name. The posterior takes the
    code lengths as negative logarithms of likelihoods and all languages as equally likely.
    Long texts are gone through in pieces, which add up to the same code length. No shuffle;
    the model's size is bounded by its fit and it is broadcast.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    new = [lang_col, score_col]
    kept = [c for c in df.columns if c not in new]
    schema = T.StructType(
        [df.schema[c] for c in kept] + [T.StructField(lang_col, T.StringType(), False), T.StructField(score_col, T.DoubleType(), False)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches, text_col):
            data, offsets = utf8(batch.column(text_col))
            letters = np.asarray(pc.fill_null(pc.match_substring_regex(batch.column(text_col), r"\pL"), False))
            langs, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if model.langs:
                length = model.code_lengths(data, offsets)
                best = length.argmin(axis=1)
                sure = 1 / np.exp2(np.maximum((length.min(axis=1)[:, None] - length) / _UNIT, -1000)).sum(axis=1)
                langs = [model.langs[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)]
                score = np.where(letters, sure, 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(langs, pa.string()), pa.array(score)], names=[*kept, *new])

    return df.select(*(f"`{c}`" for c in dict.fromkeys([*kept, text_col]))).mapInArrow(run, schema)
