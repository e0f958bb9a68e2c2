"""Quality classifier: a Gaussian kernel over document statistics, by random features.

Statistics of each whole text are standardised and mapped to random Fourier features,
whose inner products approximate a Gaussian kernel. Ridge regression on the features is
fitted from sums of normal equations over partitions, and isotonic regression on rows kept
out of that fit turns its output into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import hashes, lines, slices, utf8, words

#: Document statistics, in the order of the vector.
STATISTICS = (
    "log_bytes", "log_words", "upper", "digit", "symbol", "pipe", "exclamation", "stop", "comma", "other_punctuation", "white", "breaks", "non_ascii",
    "word_mean", "word_sd", "distinct_words", "same_as_before", "repeat_two_back", "log_line", "duplicate_lines", "symbol_words", "capital_words", "byte_entropy",
)
FEATURES = 256
MAX_ROWS = 100_000
FIT_PARTITIONS = 16
RISING = 0.01
RIDGE, WIDTH = 1e-3, 1.5

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#*$%&<>@^~=+_{}[]\\/`",
    "pipe": b"|",
    "exclamation": b"!",
    "stop": b".?",
    "comma": b",",
    "other_punctuation": b";:'\"()-",
    "white": b" \t\r\x0b\x0c",
    "breaks": b"\n",
}
_CLASS_OF = np.full(256, len(_CLASSES), dtype=np.uint8)
for _k, _v in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_v)] = _k
_CLASS_OF[128:] = len(_CLASSES) + 1


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text; all zeros for null and empty texts."""
    data, offsets = utf8(texts)
    n = len(offsets) - 1
    size = np.diff(offsets)
    shares, entropy = np.zeros((n, len(_CLASSES) + 2)), np.zeros(n)
    for a in range(0, n, 1024):
        b = min(a + 1024, n)
        counts = _byte_shares(data, offsets[a : b + 1])
        entropy[a:b] = -(counts * np.log2(np.where(counts > 0, counts, 1))).sum(axis=1)
        for k in range(shares.shape[1]):
            shares[a:b, k] = counts[:, _CLASS_OF == k].sum(axis=1)

    w = words(data, offsets)
    each = hashes(data, w)
    length = (w.end - w.start).astype(float)
    nw = np.maximum(w.count, 1)
    mean = np.bincount(w.owner, length, n) / nw
    sd = np.sqrt(np.maximum(np.bincount(w.owner, length**2, n) / nw - mean**2, 0))
    order = np.lexsort((each, w.owner))
    new = np.ones(len(w), dtype=bool)
    new[1:] = (each[order][1:] != each[order][:-1]) | (w.owner[order][1:] != w.owner[order][:-1])
    distinct = np.bincount(w.owner[order][new], minlength=n) / nw
    back = []
    for k in (1, 2):
        same = np.zeros(len(w), dtype=bool)
        same[k:] = (each[k:] == each[:-k]) & (w.owner[k:] == w.owner[:-k])
        back.append(np.bincount(w.owner[same], minlength=n) / nw)
    ends = _CLASS_OF[data[w.end - 1]] if len(w) else np.zeros(0, np.uint8)
    symbol_words = np.bincount(w.owner[(ends == 2) | (ends == 3)], minlength=n) / nw
    capital_words = np.bincount(w.owner[(_CLASS_OF[data[w.start]] == 0)] if len(w) else np.zeros(0, int), minlength=n) / nw

    li = lines(data, offsets)
    filled = li.end > li.start
    code = hashes(data, li)[filled]
    line_owner = li.owner[filled]
    order = np.lexsort((code, line_owner))
    again = np.zeros(len(code), dtype=bool)
    again[1:] = (code[order][1:] == code[order][:-1]) & (line_owner[order][1:] == line_owner[order][:-1])
    n_lines = np.maximum(np.bincount(line_owner, minlength=n), 1)
    duplicates = np.bincount(line_owner[order][again], minlength=n) / n_lines

    named = dict(zip(_CLASSES, shares.T, strict=False))
    named |= {
        "non_ascii": shares[:, -1],
        "log_bytes": np.log1p(size),
        "log_words": np.log1p(w.count),
        "word_mean": mean,
        "word_sd": sd,
        "distinct_words": distinct,
        "same_as_before": back[0],
        "repeat_two_back": back[1],
    }
    named |= {
        "log_line": np.log1p(size / n_lines),
        "duplicate_lines": duplicates,
        "symbol_words": symbol_words,
        "capital_words": capital_words,
        "byte_entropy": entropy,
    }
    return np.stack([named[x] for x in STATISTICS], axis=1) * (size > 0)[:, None]


def _byte_shares(data: np.ndarray, offsets: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """Shares of the 256 bytes in each of some texts, so many bytes at a time."""
    n = len(offsets) - 1
    counts = np.zeros(n * 256, dtype=np.int64)
    for at in range(offsets[0], offsets[-1], piece):
        end = min(at + piece, offsets[-1])
        owner = np.repeat(np.arange(n), np.diff(np.clip(offsets, at, end)))
        counts += np.bincount(owner * 256 + data[at:end], minlength=n * 256)
    return counts.reshape(n, 256) / np.maximum(np.diff(offsets), 1)[:, None]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    heights: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack((np.sqrt(2 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases), np.ones((len(x), 1))))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1, with a small part that rises with the raw output,
        so that texts of one isotonic step are still ranked."""
        raw = np.round(self.features(x) @ self.weights, 9)
        step = np.clip(np.interp(raw, self.knots, self.heights), 0, 1)
        return (1 - RISING) * step + RISING / (1 + np.exp(-np.clip(4 * raw - 2, -500, 500)))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and heights of the non-decreasing least-squares fit of y on x, by pooling
    adjacent violators; equal x count as one. Between knots it is linear."""
    at, where = np.unique(x, return_inverse=True)
    weight = np.bincount(where).astype(float)
    value = np.bincount(where, y) / weight
    blocks: list[list[float]] = []  # sum, weight, first, last
    for a, v, w in zip(at, value, weight, strict=True):
        blocks.append([v * w, w, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, w2, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + w2, blocks[-1][2], last]
    # half a row of either label at the ends keeps scores of one-sided blocks inside (0, 1)
    level = [(s + 0.5 * y.mean()) / (w + 0.5) for s, w, _, _ in blocks]
    knots = np.array([v for b in blocks for v in b[2:]])
    return knots, np.maximum.accumulate(np.repeat(level, 2))


def fit(
    df: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "label",
    features: int = FEATURES,
    ridge: float = RIDGE,
    width: float = WIDTH,
    max_rows: int = MAX_ROWS,
    seed: int = 7,
) -> Model | None:
    """The model for ``labels`` (id and a 0/1 label), or None where no text has a label.

    A document with several labels takes their mean; null ids and labels are left out.
    Fitted on a bounded sample: about ``max_rows`` labelled documents chosen by a hash of
    the id, all of them where there are fewer. That bound makes the broadcast of the
    labels safe. Every fourth of them calibrates, the others fit.
    """
    spark = df.sparkSession
    labels = labels.select(
        F.col(id_col).alias("id"),
        F.col(label_col).cast("double").alias("y"),
    ).where("id is not null and y is not null").groupBy("id").agg(F.avg("y").alias("y"))
    n = labels.count()
    if not n:
        return None
    labels = labels.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < min(1.0, max_rows / n) * (1 << 30))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(labels), "id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.string()), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))],
                names=["id", "y", "x"],
            )

    # The order of rows decides the last bits of sums: they are sorted before summing.
    measured = rows.mapInArrow(measure, "id string, y double, x array<double>").repartition(FIT_PARTITIONS, "id").sortWithinPartitions("id").persist()
    moments = measured.select("y", F.posexplode("x").alias("k", "v")).groupBy("k").agg(
        F.avg("v").alias("m"),
        F.stddev_pop("v").alias("s"),
    ).orderBy("k").collect()
    if not moments:
        measured.unpersist()
        return None
    random = np.random.default_rng(seed)
    d = len(STATISTICS)
    model = Model(
        np.array([r["m"] for r in moments]),
        np.maximum([r["s"] for r in moments], 1e-6),
        random.normal(size=(d, features)) / (width * np.sqrt(d)),
        random.uniform(0, 2 * np.pi, features),
        np.zeros(features + 1),
        np.zeros(1),
        np.zeros(1),
    )
    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(4)) == 0

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's sums: row i of the left side, with the right side's i at its end."""
        sums, part = np.zeros((features + 1, features + 2)), ""
        for batch in batches:
            if batch.num_rows:
                z = model.features(np.array(batch.column("x").to_pylist()))
                sums += z.T @ np.hstack((z, np.asarray(batch.column("y"))[:, None]))
                part = part or batch.column("id")[0].as_py()
        if part:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(features + 1)), pa.array([part] * (features + 1)), pa.array([x.tobytes() for x in sums], pa.binary())],
                names=["i", "part", "row"],
            )

    def total(rows: pa.Table) -> pa.Table:
        ordered = rows.sort_by("part")
        added = np.sum([np.frombuffer(x) for x in ordered["row"].to_pylist()], axis=0)
        return pa.table({"i": ordered["i"][:1], "row": pa.array([added.tobytes()], pa.binary())})

    # Partitions are summed by row before the driver sees them: it gets one system of equations.
    parts = measured.where(~fold).mapInArrow(equations, "i long, part string, row binary")
    sums = np.array([np.frombuffer(r["row"]) for r in sorted(parts.groupBy("i").applyInArrow(total, "i long, row binary").collect())])
    if not len(sums):
        sums = np.zeros((features + 1, features + 2))
    gram, right = sums[:, :-1], sums[:, -1]
    penalty = ridge * max(gram[-1, -1], 1.0) * np.eye(features + 1)
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(gram + penalty, right)

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = model.features(np.array(batch.column("x").to_pylist())) @ model.weights
                yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(raw)], names=["y", "raw"])

    held = measured.where(fold).mapInArrow(outputs, "y double, raw double").toPandas()
    if not len(held):
        held = measured.mapInArrow(outputs, "y double, raw double").toPandas()
    measured.unpersist()
    held = held.sort_values(["raw", "y"])
    model.knots, model.heights = isotonic(held["raw"].to_numpy(), held["y"].to_numpy())
    return model


def predict(df: DataFrame, model: Model | None, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with the probability that each text has label 1, in place of a column of that name.

    Null and empty texts are scored from statistics that are all zero. Without a model the
    score is 0.5. Every row is kept; equal texts have equal scores. No shuffle.
    """
    kept = [c for c in df.columns if c != score_col]
    if model is None:
        return df.select(*(f"`{c}`" for c in kept), F.lit(0.5).alias(score_col))
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(score_col, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            score = sent.value.score(statistics(batch.column(text_col)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score)], names=[*kept, score_col])

    return df.select(*(f"`{c}`" for c in dict.fromkeys([*kept, text_col]))).mapInArrow(run, schema)
