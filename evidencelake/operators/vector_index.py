"""A stored vector index: cells with product-quantised codes, and exact re-ranking.

The unit vectors of a bounded sample give the cells (``search.fit_cells``) and, for each few
components of a vector, a codebook; every point is then stored as its cell and one byte for each
codebook. A search scores the codes in the cells nearest to a question, decoded, keeps a few of
the best and ranks these by their true cosine. The index is made once; a search shuffles
neither its codes nor the points' vectors, only candidates.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search

WIDTH, WORDS = 4, 64
BLOCK_BYTES = 64 << 20


@dataclass
class Model:
    """Cells, codebooks (codebook, word, component; zero beyond a vector's end) and how many
    candidates of each question are ranked exactly."""

    cells: search.Cells
    books: np.ndarray
    kept: int

    def split(self, vectors: np.ndarray) -> np.ndarray:
        """Unit vectors in the parts that the codebooks are for."""
        books, _, width = self.books.shape
        out = np.zeros((len(vectors), books * width))
        out[:, : vectors.shape[1]] = search._unit(vectors)
        return out.reshape(len(vectors), books, width)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        parts = self.split(vectors)
        return np.stack([_nearest(parts[:, j], self.books[j]) for j in range(len(self.books))], axis=1).astype(np.uint8)

    def tables(self, vectors: np.ndarray) -> np.ndarray:
        """What each word of each codebook adds to a question's score."""
        return np.einsum("qjw,jkw->qjk", self.split(vectors), self.books).astype(np.float32)

    def saved(self) -> bytes:
        out = io.BytesIO()
        c = self.cells
        np.savez(out, centroids=c.centroids, probes=c.probes, parts=c.parts, books=self.books, kept=self.kept)
        return out.getvalue()

    @staticmethod
    def loaded(saved: bytes) -> Model:
        d = np.load(io.BytesIO(saved), allow_pickle=False)
        return Model(search.Cells(d["centroids"], int(d["probes"]), d["parts"]), d["books"], int(d["kept"]))


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words**2).sum(axis=1)[None, :] - 2 * x @ words.T, axis=1)


def _words(x: np.ndarray, count: int, rounds: int, random: np.random.Generator) -> np.ndarray:
    """k-means; a word that no part is nearest to stays where it was."""
    words = x[random.choice(len(x), count, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, words)
        sums = np.zeros_like(words)
        np.add.at(sums, own, x)
        size = np.bincount(own, minlength=count)[:, None]
        words = np.where(size > 0, sums / np.maximum(size, 1), words)
    return words


def scored(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate cosines of all questions (rows) and codes."""
    out = np.zeros((len(tables), len(codes)), np.float32)
    for j in range(codes.shape[1]):
        out += tables[:, j, codes[:, j]]
    return out


def decoded(books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The vectors that the codes stand for; their products with a question are ``scored``."""
    return books[np.arange(len(books)), codes].reshape(len(codes), -1)


def fit(points: DataFrame, k: int = search.TOP_K, *, recall: float = 0.95, sample: int = 20_000, rounds: int = 10, seed: int = 5) -> Model | None:
    """Cells and codebooks for points (ku_id, vector), or None where there is none.

    Fitted on about ``sample`` points at most. In the sample, the cells that are probed hold
    ``recall`` of the true k nearest, and the candidates that are kept (k, doubled as often as it takes)
    hold 0.98 of them. Every point is indexed later.
    """
    cells = search.fit_cells(points, k, recall=recall, sample=sample, rounds=rounds, seed=seed)
    if cells is None:
        return None
    rows = points.select("ku_id", "vector").where("ku_id is not null and vector is not null")
    n = rows.count()
    some = rows.where(F.pmod(F.xxhash64("ku_id", F.lit(seed)), F.lit(1 << 30)) < min(1.0, sample / n) * (1 << 30))
    x = search._unit(search.matrix(some.orderBy("ku_id").toArrow()["vector"].combine_chunks()))
    random = np.random.default_rng(seed)
    model = Model(cells, np.zeros((-(-x.shape[1] // WIDTH), 1, WIDTH)), k)
    parts, count = model.split(x), max(1, min(WORDS, len(x) // 8))
    model.books = np.stack([_words(parts[:, j], count, rounds, random) for j in range(parts.shape[1])])
    asked = random.choice(len(x), min(len(x), 200), replace=False)
    true = np.argsort(-(x[asked] @ x.T), axis=1, kind="stable")[:, :k]
    order = np.argsort(-scored(model.tables(x[asked]), model.codes(x)), axis=1, kind="stable")
    place = np.take_along_axis(np.argsort(order, axis=1), true, axis=1)
    while model.kept < len(x) and (place < model.kept).mean() < 0.98:
        model.kept *= 2
    return model


def build(points: DataFrame, path: str, **settings: object) -> Model | None:
    """Fit an index and store it under ``path``: the model, and (cell, id, code) of every point
    with an id and a vector, cell by cell, large cells in several files."""
    model, spark = fit(points, **settings), points.sparkSession
    saved = [(bytearray(model.saved()),)] if model else []
    spark.createDataFrame(saved, "model binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    if model is None:
        return None
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, search.TILE):
                batch = whole.slice(at, search.TILE)
                vectors = search.matrix(batch.column("vector"), model.cells.centroids.shape[1])
                codes = pa.array([c.tobytes() for c in model.codes(vectors)], pa.binary())
                cell = model.cells.nearest(search._unit(vectors), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), batch.column("id"), codes], names=["cell", "id", "code"])

    rows = points.select(F.col("ku_id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where("id is not null and vector is not null")
    coded = rows.mapInArrow(run, "cell long, id long, code binary")
    coded.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.mode("overwrite").parquet(f"{path}/codes")
    return model


def load(spark: SparkSession, path: str) -> Model | None:
    row = spark.read.schema("model binary").parquet(f"{path}/model").first()
    return Model.loaded(bytes(row[0])) if row else None


def topk(questions: DataFrame, points: DataFrame, path: str, k: int = search.TOP_K) -> DataFrame:
    """Approximate top-k by cosine with the index under ``path``: query_id, ku_id, score (the
    true cosine of the points' vectors), rank.

    Questions come in blocks of ``BLOCK_BYTES`` with their candidates at most, which are broadcast;
    each task decodes the codes of its cells and multiplies them with the questions that probe them. Questions
    with fewer than k points in their cells get their exact top-k. Points that were stored and
    are no more among ``points`` are not found; new ones are found when the index is built
    again. Rows without id or vector are left out.
    """
    spark = questions.sparkSession
    asked = questions.select("query_id", "vector").where("query_id is not null and vector is not null")
    model = load(spark, path)
    if model is None:
        return search.topk_all(asked, points, k)
    kept = max(model.kept, k)
    each = 48 * kept + 9 * len(model.cells.centroids) + 16 * model.cells.centroids.shape[1]
    stored = spark.read.schema("cell long, id long, code binary").parquet(f"{path}/codes")
    found = search.in_blocks(asked, lambda few: _candidates(few, stored, model, kept), BLOCK_BYTES, F.lit(each))
    best = search.ranked(found, kept).select("query_id", "ku_id")
    vectors = points.select(F.col("ku_id").cast("long").alias("ku_id"), F.col("vector").cast("array<double>").alias("p"))
    met = best.join(vectors, "ku_id").join(asked.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("q")), "query_id")
    exact = search.cut(search.ranked(met.select("query_id", "ku_id", F.round(search.cosine(F.col("q"), F.col("p")), 6).alias("score")), k))
    full = exact.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    short = search.cut(asked.join(full, "query_id", "left_anti"))
    if short.isEmpty():
        return exact
    return exact.join(full, "query_id", "left_semi").select(exact.columns).unionByName(search.topk_all(short, points, k))


class Reached:
    """The k best points of each of some questions: what reaches a question's floor is gathered,
    and cut to k where it has doubled, which raises the floors."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k, self.floor = ids, k, np.full(len(ids), -np.inf)
        self.parts, self.size, self.most = [], 0, 1 << 20

    def show(self, own: np.ndarray, point: np.ndarray, score: np.ndarray) -> None:
        """Scores of the questions at ``own`` (rows) and points."""
        row, column = np.nonzero(score >= (self.floor[own] - 1e-6).astype(score.dtype)[:, None])
        self.parts.append((own[row], point[column], np.round(score[row, column].astype(float), 6)))
        self.size += len(row)
        if self.size > self.most:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        at, point, score = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *self.parts, strict=True))
        order = np.lexsort((point, -score, at))
        at, point, score = at[order], point[order], score[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        last, best = place == self.k - 1, place < self.k
        self.floor[at[last]] = score[last]
        self.parts = [(at[best], point[best], score[best])]
        self.size = int(best.sum())
        self.most = 2 * self.size + (1 << 20)
        return self.parts[0]

    def rows(self) -> pa.RecordBatch:
        at, point, score = self.cut()
        return pa.RecordBatch.from_arrays([pa.array(self.ids[at]), pa.array(point), pa.array(score)], names=["query_id", "ku_id", "score"])


def _candidates(asked: pd.DataFrame, stored: DataFrame, model: Model, kept: int) -> DataFrame:
    """The best ``kept`` codes of each task for one block of questions."""
    vectors = search.matrix(pa.array(asked["vector"].tolist(), pa.list_(pa.float64())), model.cells.centroids.shape[1])
    probed = model.cells.nearest(search._unit(vectors), model.cells.probes)
    met = np.zeros((len(model.cells.centroids), len(asked)), dtype=bool)
    met[probed.reshape(-1), np.repeat(np.arange(len(asked)), probed.shape[1])] = True
    split = model.split(vectors).reshape(len(vectors), model.books.shape[0] * model.books.shape[2]).astype(np.float32)
    sent = stored.sparkSession.sparkContext.broadcast((asked["query_id"].to_numpy(dtype=np.int64), split, met, model.books.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, split, met, books = sent.value
        best = Reached(ids, kept)
        for whole in batches:
            cells = np.asarray(whole.column("cell"))
            cuts = np.flatnonzero(np.diff(cells)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cells)], strict=True) if len(cells) else ():
                own = np.flatnonzero(met[cells[a]])
                for at in range(a, b if len(own) else a, search.TILE):
                    part = whole.slice(at, min(search.TILE, b - at))
                    points = decoded(books, np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(part.num_rows, -1))
                    for few in (own[x : x + search.TILE] for x in range(0, len(own), search.TILE)):
                        best.show(few, np.asarray(part.column("id")), split[few] @ points.T)
        yield best.rows()

    some = np.flatnonzero(met.any(axis=1))
    if len(some) < len(met):
        stored = stored.where(F.col("cell").isin(some.tolist()))
    return stored.mapInArrow(run, search.CANDIDATES)
