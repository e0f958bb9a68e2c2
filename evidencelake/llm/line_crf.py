"""Quality rules: line labelling by a linear-chain conditional random field.

Every line with a word gets features; the field scores the labels content and boilerplate
of each line and of each pair of neighbours, and Viterbi decoding finds the best labelling
of the whole text. The share of words in content lines decides whether a text is kept,
after the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import drop, stage
from .text import Spans, hashes, lines, mix64, slices, utf8, words

LINE_FEATURES = ("bias", "symbols", "pipes", "capitals", "digits", "exclamations", "repeats", "duplicate", "few_words", "long_words")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_CONTENT = 0.5
MAX_DOCS = 3000
CHAIN = 128
_UNIT = float(1 << 24)
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass
class Field:
    """Scores: ``emission`` of content less those of boilerplate by feature; ``stay`` for two
    neighbours with one label, less those with two; ``start`` of content less boilerplate."""

    emission: np.ndarray
    stay: float
    start: float


#: Used where there is nothing to learn from: prose is content, symbol and capital runs are not.
DEFAULT = Field(np.array([2.5, -18.0, -18.0, -6.0, -4.0, -12.0, -6.0, -3.0, 0.0, -1.0]), 1.0, 0.5)


class Parsed:
    """Words and lines of a batch of texts."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = utf8(texts)
        self.n = len(self.offsets) - 1
        self.words = words(self.data, self.offsets)
        self.word_hash = hashes(self.data, self.words)
        every = lines(self.data, self.offsets)
        line_hash = hashes(self.data, every)
        at = np.searchsorted(self.words.start, every.start)
        ends = np.searchsorted(self.words.start, every.end)
        filled = ends > at
        self.line_start, self.line_end, self.line_owner, self.line_hash = every.start[filled], every.end[filled], every.owner[filled], line_hash[filled]
        self.line_first, self.line_words = at[filled], (ends - at)[filled]
        order = np.lexsort((np.arange(len(self.line_hash)), self.line_hash, self.line_owner))
        self.duplicate = np.zeros(len(order), dtype=bool)
        same = (self.line_hash[order][1:] == self.line_hash[order][:-1]) & (self.line_owner[order][1:] == self.line_owner[order][:-1])
        self.duplicate[order[1:][same]] = True

    def per_text(self, owner: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(owner, weight, self.n)

    def word_chars(self) -> np.ndarray:
        points = np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))
        return self.per_text(self.words.owner, (points[self.words.end] - points[self.words.start]).astype(float)).astype(np.int64)

    def symbols(self) -> np.ndarray:
        at = np.flatnonzero(_SYMBOLS[self.data])
        return self.per_text(np.searchsorted(self.offsets, at, side="right") - 1)

    def repeat_words(self, width: int = 3) -> np.ndarray:
        """Words that lie in a window of ``width`` words found twice or more in the text."""
        n = len(self.words) - width + 1
        out = np.zeros(len(self.words), dtype=bool)
        if n > 0:
            own = self.words.owner[:n]
            whole = own == self.words.owner[width - 1 :]
            value = np.zeros(n, dtype=np.uint64)
            for k in range(width):
                value = mix64(value * np.uint64(0xD1B54A32D192ED03) + self.word_hash[k : n + k])
            at = np.flatnonzero(whole)
            order = at[np.lexsort((value[at], own[at]))]
            same = (value[order][1:] == value[order][:-1]) & (own[order][1:] == own[order][:-1])
            often = np.concatenate((order[1:][same], order[:-1][same]))
            for k in range(width):
                out[often + k] = True
        return self.per_text(self.words.owner[out])

    def features(self) -> np.ndarray:
        """One row of ``LINE_FEATURES`` for each line with a word."""
        size = np.maximum(self.line_end - self.line_start, 1)

        def count(test: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(test)))
            return total[self.line_end] - total[self.line_start]

        def share(test: np.ndarray) -> np.ndarray:
            return count(test) / size

        d = self.data
        again = np.zeros(len(self.words), dtype=bool)
        again[1:] = (self.word_hash[1:] == self.word_hash[:-1]) & (self.words.owner[1:] == self.words.owner[:-1])
        total = np.concatenate(([0], np.cumsum(again)))
        repeats = (total[self.line_first + self.line_words] - total[self.line_first]) / self.line_words
        return np.stack([
            np.ones(len(size)), share(_SYMBOLS[d] & (d != ord("|"))), np.minimum(count(d == ord("|")) / self.line_words, 1), share((d >= 65) & (d <= 90)), share((d >= 48) & (d <= 57)), share(d == ord("!")),
            repeats, self.duplicate.astype(float), (self.line_words < 4).astype(float), np.minimum(size / self.line_words / 20, 3),
        ], axis=1)


def viterbi(gain: np.ndarray, stay: float) -> np.ndarray:
    """Best labelling (True: content) of one text's lines, given what content gains over
    boilerplate on each. Ties go to content."""
    n = len(gain)
    lead, back = 0.0, []  # the best score that ends in content less that in boilerplate
    for k, g in enumerate(gain.tolist()):
        if k:
            # label before, for content and for boilerplate here
            back.append((lead + stay >= 0, lead - stay >= 0))
            lead = max(lead + stay, 0.0) - max(lead, stay)
        lead += g
    out = np.zeros(n, dtype=bool)
    label = lead >= 0
    for k in range(n - 1, -1, -1):
        out[k] = label
        if k:
            label = back[k - 1][0] if label else back[k - 1][1]
    return out


def decode(parsed: Parsed, field: Field) -> np.ndarray:
    """Label of each line (True: content), all texts of a batch."""
    gain = parsed.features() @ field.emission
    first = np.ones(len(gain), dtype=bool)
    first[1:] = parsed.line_owner[1:] != parsed.line_owner[:-1]
    gain = np.round(gain + first * field.start, 9)
    cuts = np.append(np.flatnonzero(first), len(gain))
    out = np.ones(len(gain), dtype=bool)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if (gain[a:b] < 0).any():  # else content throughout, whatever the neighbours
            out[a:b] = viterbi(gain[a:b], field.stay)
    return out


def _gradient(x: np.ndarray, y: np.ndarray, first: np.ndarray, field: Field) -> tuple[np.ndarray, float, float]:
    """Gradient of the conditional log-likelihood of whole texts."""
    parts = _line_gradients(x, y, first, first, field)
    return np.array([p.sum() for p in parts[:-2]]), float(parts[-2].sum()), float(parts[-1].sum())


def _line_gradients(x: np.ndarray, y: np.ndarray, first: np.ndarray, head: np.ndarray, field: Field) -> list[np.ndarray]:
    """What each line adds to the gradient, by weight (features, stay, start), by forward and
    backward messages inside chains, which ``first`` begins; ``head`` begins a text."""
    gain = (x * field.emission).sum(axis=1) + head * field.start
    n = len(gain)
    forward, backward = np.zeros(n), np.zeros(n)  # log-odds of content: from before, from after
    s = field.stay

    def message(lead: np.ndarray) -> np.ndarray:
        return np.logaddexp(lead + s, 0.0) - np.logaddexp(lead, s)

    # All chains at once, line by line
    place = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    steps = np.split(np.argsort(place, kind="stable"), np.cumsum(np.bincount(place))[:-1])
    for k in steps[1:]:
        forward[k] = message(forward[k - 1] + gain[k - 1])
    for k in reversed(steps[1:]):
        backward[k - 1] = message(backward[k] + gain[k])
    p = 1 / (1 + np.exp(-np.clip(gain + forward + backward, -500, 500)))
    inner = np.flatnonzero(~first)
    a, b = forward[inner - 1] + gain[inner - 1], backward[inner] + gain[inner]
    same = np.logaddexp(a + b, 0.0)
    expected = 1 / (1 + np.exp(np.clip(np.logaddexp(a, b) - same - s, -500, 500)))
    stay = np.zeros(n)
    stay[inner] = (y[inner] == y[inner - 1]) - expected
    return [*(x * (y - p)[:, None]).T, stay, head * (y - p)]


def fit(
    df: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "label",
    max_docs: int = MAX_DOCS,
    steps: int = 60,
    seed: int = 11,
) -> Field:
    """A field learnt from documents with a 0/1 label: the lines of a document with label 1
    count as content; of one with label 0, those whose symbols, capitals, repeats or
    duplicates are unlike prose count as boilerplate, the others as content.

    Fitted on a bounded sample of about ``max_docs`` labelled documents, chosen by a hash of
    the id, with all of their lines, whose features are written once. Each step sums the gradient in Spark, by
    partition first, so the driver gets one row a step, whatever the documents have. A
    document is a chain for each ``CHAIN`` of its lines. ``DEFAULT`` where none has a label.
    """
    labels = labels.select(
        F.col(id_col).alias("id"),
        F.col(label_col).cast("int").alias("y"),
    ).where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    n = labels.count()
    if not n:
        return DEFAULT
    labels = labels.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < min(1.0, max_docs / n) * (1 << 30))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(labels), "id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parsed = Parsed(batch.column("text"))
            x, own = parsed.features(), parsed.line_owner
            place = np.arange(len(own)) - np.searchsorted(own, own)
            starts = np.flatnonzero(place % CHAIN == 0)
            ends = np.append(starts, len(own))
            lines = pa.ListArray.from_arrays(pa.array((ends * x.shape[1]).astype(np.int32)), pa.array(x.ravel()))
            columns = [pa.array(np.asarray(batch.column("y"))[own[starts]].astype(np.int64)), pa.array(place[starts] == 0), lines]
            yield pa.RecordBatch.from_arrays(columns, names=["y", "head", "x"])

    chains = stage(rows.mapInArrow(measure, "y long, head boolean, x array<double>"), "chains")
    if not chains.limit(1).count():
        drop(chains)
        return DEFAULT
    field = learn(chains, steps)
    drop(chains)
    return field


def learn(chains: DataFrame, steps: int = 60) -> Field:
    """The field for chains of lines (y: label of the text, head: whether it begins the text,
    x: the features of its lines, one line after another)."""
    prose = chains.where("y = 1").select(F.explode(F.expr(f"filter(x, (v, k) -> k % {len(LINE_FEATURES)} = 3)")).alias("c")).agg(F.percentile_approx("c", 0.5, 100_000)).first()[0] or 0.0
    names = [f"g{k}" for k in range(len(LINE_FEATURES) + 2)] + ["n"]

    def summed(field: Field) -> list[int]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(names), np.int64)
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    x = np.asarray(batch.column("x").flatten()).reshape(-1, len(LINE_FEATURES))
                    size = np.asarray(pc.list_value_length(batch.column("x"))) // len(LINE_FEATURES)
                    starts = np.cumsum(size) - size
                    first, head = np.zeros(len(x), dtype=bool), np.zeros(len(x), dtype=bool)
                    first[starts] = True
                    head[starts] = np.asarray(batch.column("head"))
                    y = _line_labels(x, np.repeat(np.asarray(batch.column("y")), size), prose)
                    grads = np.add.reduceat(np.stack(_line_gradients(x, y, first, head, field), axis=1), starts)
                    # whole units a chain, so that the sum is the same in any order
                    total += np.append(np.rint(grads * _UNIT).astype(np.int64).sum(axis=0), len(x))
            yield pa.RecordBatch.from_arrays([pa.array([t]) for t in total], names=names)

        return list(chains.mapInArrow(run, ", ".join(f"{c} long" for c in names)).agg(*(F.sum(c) for c in names)).first())

    field = Field(DEFAULT.emission.copy(), DEFAULT.stay, DEFAULT.start)
    squares = np.zeros(len(names) - 1)
    pull = np.append(np.full(len(LINE_FEATURES), 1e-4), [1e-3, 1e-3])
    for _ in range(steps):  # AdaGrad with a weak pull to the default
        *grads, n = summed(field)
        away = np.append(field.emission - DEFAULT.emission, [field.stay - DEFAULT.stay, field.start - DEFAULT.start])
        grads = np.array(grads) / _UNIT - pull * n * away
        squares += grads**2
        move = 0.5 * grads / np.sqrt(squares + 1e-12)
        field = Field(field.emission + move[:-2], max(field.stay + move[-2], 0.0), field.start + move[-1])
    return Field(np.round(field.emission, 4), round(float(field.stay), 4), round(float(field.start), 4))


def _line_labels(x: np.ndarray, label: np.ndarray, capitals: float) -> np.ndarray:
    """1 for lines that count as content, given the labels of their texts and the usual share of capitals."""
    odd = (x[:, 1] > 0.05) | (x[:, 2] > 0.1) | (x[:, 3] > capitals + 0.25) | (x[:, 5] > 0.03) | (x[:, 6] > 0.2) | (x[:, 7] > 0)
    return np.where((label == 1) | ~odd, 1.0, 0.0)


def annotate(
    df: DataFrame,
    field: Field = DEFAULT,
    *,
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    min_content: float = MIN_CONTENT,
) -> DataFrame:
    """``df`` with the base counts and the verdict of the field on each whole text.

    New columns, in place of any of these names: n_words, word_chars (code points in words),
    n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share (words in content
    lines over words; 0 without words), boilerplate_lines (numbers, from 0, of the
    lines with a word that are not content), kept. Null and empty texts have no
    words, fail the base rules and are not kept. No shuffle.
    """
    new = {
        "n_words": "long",
        "word_chars": "long",
        "n_symbols": "long",
        "n_dup_lines": "long",
        "n_repeat_words": "long",
        "base_failed": "boolean",
        "content_share": "double",
        "boilerplate_lines": "array<int>",
        "kept": "boolean",
    }
    kept = [c for c in df.columns if c not in new]
    schema = T.StructType([df.schema[c] for c in kept] + T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in new.items())).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            parsed = Parsed(batch.column(text_col))
            content = decode(parsed, field)
            n_words, repeats = parsed.words.count, parsed.repeat_words()
            failed = (n_words < min_words) | (100 * repeats > max_repeat_percent * n_words)
            share = parsed.per_text(parsed.line_owner[content], parsed.line_words[content].astype(float)) / np.maximum(n_words, 1)
            place = np.arange(len(content)) - np.searchsorted(parsed.line_owner, parsed.line_owner)
            dropped = parsed.per_text(parsed.line_owner[~content])
            ends = np.concatenate(([0], np.cumsum(dropped))).astype(np.int32)
            marked = pa.ListArray.from_arrays(pa.array(ends), pa.array(place[~content].astype(np.int32)))
            made = [
                pa.array(n_words),
                pa.array(parsed.word_chars()),
                pa.array(parsed.symbols().astype(np.int64)),
                pa.array(parsed.per_text(parsed.line_owner[parsed.duplicate]).astype(np.int64)),
                pa.array(repeats.astype(np.int64)),
                pa.array(failed),
                pa.array(share),
                marked,
                pa.array(~failed & (share >= min_content)),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, *new])

    return df.select(*(f"`{c}`" for c in dict.fromkeys([*kept, text_col]))).mapInArrow(run, schema)
