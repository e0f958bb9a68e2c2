"""Embedding plans, index tables and exact or approximate vector top-k."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stage import cut, scratch, sent
from .structure import SPACE
from .units import word_count

TOP_K = 20
#: Bytes of the questions that are broadcast at once, with their candidates in a task.
BLOCK_BYTES = 64 << 20

#: Question wordings and the hint that is appended for each.
HINTS = (
    (
        r"who\s+(?:wrote|authored|developed|created|conducted)|which\s+(?:university|institution|lab|group)|\bauthors?\b|\baffiliations?\b",
        "authors affiliations title page",
    ),
    (r"\bkey\s?words?\b|\bindex\s+terms\b", "keywords index terms"),
    (r"\bmethodolog(?:y|ies)\b|\bapproach\b|\bhow\s+does\s+it\s+work\b", "method methodology proposed"),
)


def embed_plan(units: DataFrame) -> DataFrame:
    """Units (ku_id, document_id, asset) to tasks: one for the text, one for an asset."""
    targets = F.filter(F.array(F.lit("text"), F.when(F.col("asset").isNotNull(), "image")), lambda x: x.isNotNull())
    return units.select("ku_id", "document_id", F.explode(targets).alias("target"))


def embed_input(context: Column, text: Column) -> Column:
    """What is embedded: 'context: text', or the text where there is no context."""
    return F.when(F.nullif(context, F.lit("")).isNotNull(), F.concat(context, F.lit(": "), text)).otherwise(text)


def hashed_terms(texts: list[str], dimension: int = 64) -> np.ndarray:
    """A model-free embedder: counts of terms in hashed buckets."""
    out = np.zeros((len(texts), dimension))
    for k, text in enumerate(texts):
        for term in text.lower().split():
            out[k, zlib.crc32(term.encode()) % dimension] += 1
    return out


class _Attempts:
    """An embedder whose answers are checked, tried again and, where a batch fails, halved."""

    def __init__(self, embedder: Callable[[list[str]], np.ndarray], attempts: int, backoff: float):
        self.embedder, self.attempts, self.backoff = embedder, attempts, backoff
        self.dimension: int | None = None

    def _asked(self, texts: list[str], attempts: int) -> np.ndarray:
        for attempt in range(1, attempts + 1):
            try:
                v = np.asarray(self.embedder(texts), dtype=float)
                if v.ndim != 2 or len(v) != len(texts) or not v.shape[1]:
                    raise ValueError(f"{len(texts)} texts, vectors of shape {v.shape}")
                if self.dimension not in (None, v.shape[1]):
                    raise ValueError(f"dimension {v.shape[1]} after {self.dimension}")
                return v
            except Exception:  # any failure of the caller's embedder
                if attempt == attempts:
                    raise
                time.sleep(self.backoff * attempt)
        raise ValueError("no attempts")

    def __call__(self, texts: list[str], attempts: int | None = None) -> list[tuple[np.ndarray | None, str | None]]:
        """A unit vector or an error for each text."""
        try:
            v = self._asked(texts, attempts or self.attempts)
        except Exception as e:  # noqa: BLE001  a failed row, not a failed job
            if len(texts) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            half = len(texts) // 2
            return self(texts[:half], 1) + self(texts[half:], 1)
        self.dimension = v.shape[1]
        sound = np.isfinite(v).all(axis=1)
        largest = np.abs(np.where(sound[:, None], v, 0)).max(axis=1, keepdims=True)
        v = v / np.where(largest > 0, largest, 1)  # so that no square is out of range
        v = v / np.maximum(np.linalg.norm(np.where(sound[:, None], v, 0), axis=1, keepdims=True), 1e-12)
        return [(x, None) if ok else (None, "ValueError: a number that is not finite") for x, ok in zip(v, sound, strict=True)]


def embed_batch(
    rows: DataFrame,
    text_col: str,
    embedder: Callable[[list[str]], np.ndarray] = hashed_terms,
    *,
    attempts: int = 3,
    batch: int = 32,
    backoff: float = 0.5,
) -> DataFrame:
    """Rows with ``vector`` (unit length; null on failure) and ``error``.

    The embedder gets lists of texts, a null text as empty. It fails where it raises, or gives
    anything but one vector for each text, all of the dimension that the task saw first. A batch
    is tried ``attempts`` times, ``backoff`` seconds longer apart each time; then its halves are tried once each, and
    theirs, so that only the texts that fail alone are failed rows, with the error's text. A
    vector with a number that is not finite fails its own row. The job goes on. No shuffle.
    """
    kept = [c for c in rows.columns if c not in ("vector", "error")]
    schema = T.StructType(
        [rows.schema[c] for c in kept] + [T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _Attempts(embedder, attempts, backoff)
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                made, errors = zip(*asked([x or "" for x in part.column(text_col).to_pylist()]), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(made, pa.list_(pa.float64())), pa.array(errors, pa.string())],
                    names=[*kept, "vector", "error"],
                )

    return rows.select(*(f"`{c}`" for c in dict.fromkeys([*kept, text_col]))).mapInArrow(run, schema)


def truncation_flag(rows: DataFrame, text_col: str, most: int) -> DataFrame:
    """Rows with words and ``truncated``: more of them than the embedder takes."""
    return rows.withColumn("words", word_count(F.col(text_col))).withColumn("truncated", F.col("words") > most)


def embed_manifest(tasks: DataFrame) -> DataFrame:
    """Tasks (document_id, target, model, dimension, status) counted by document."""
    count = lambda test: F.count_if(test)
    return tasks.groupBy("document_id").agg(
        count((F.col("target") == "text") & (F.col("status") == "ok")).alias("embedded"),
        count(F.col("status") == "failed").alias("failed"),
        count(F.col("status") == "skipped").alias("skipped_images"),
        F.max("model").alias("model"),
        F.max("dimension").alias("dimension"),
    )


def collection_name(prefix: str, model: Column, version: Column, target: Column) -> Column:
    clean = F.btrim(F.regexp_replace(model, "[^a-zA-Z0-9]+", "_"), F.lit("_"))
    return F.lower(F.concat_ws("_", F.lit(prefix), clean, F.substring(version, 1, 8), target))


def index_plan(vectors: DataFrame, prefix: str) -> DataFrame:
    """One collection for each (model, version, target) of the vectors: name, dimension, size."""
    plan = vectors.groupBy("model", "version", "target").agg(F.max(F.size("vector")).alias("dimension"), F.count(F.lit(1)).alias("points"))
    return plan.withColumn("collection", collection_name(prefix, F.col("model"), F.col("version"), F.col("target")))


def index_points(vectors: DataFrame, units: DataFrame, citations: DataFrame, manifest: DataFrame) -> DataFrame:
    """Vectors (ku_id) with their unit, citation count (0 if none), model and sorted pages."""
    rows = vectors.join(units, "ku_id").join(citations, "ku_id", "left").join(manifest, "document_id")
    return rows.withColumn("citations", F.coalesce("citations", F.lit(0))).withColumn("pages", F.array_sort(F.array_distinct("pages")))


def upsert(points: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Points, one for each key, with changes put in: for each changed key the row of the
    highest version. Points whose key no change has pass as they are; while the changed keys are few
    enough to be sent (``stage.sent``), none of these is shuffled."""
    ids = sent(changes.select(F.col(key).alias("_key")))
    same = points[key].eqNullSafe(ids["_key"])
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))
    met = points.join(ids, same, "left_semi").unionByName(changes)
    return points.join(ids, same, "left_anti").unionByName(met.withColumn("_n", last).where("_n = 1").drop("_n"))


def lookup(points: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The points of the ids; those that don't exist are absent."""
    return points.join(ids.select(key).distinct(), key)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


METRICS = {"cosine": (cosine, True), "dot": (dot, True), "euclid": (euclid, False)}


def ranked(scored: DataFrame, k: int, descending: bool = True) -> DataFrame:
    """The first k of each query by score rounded to six places, then id. The limit goes
    below the window's shuffle, so each task sends k rows of a query at most."""
    score = F.col("score") if not descending else -F.col("score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(score, "ku_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def topk_scoped(questions: DataFrame, points: DataFrame, k: int = TOP_K, metric: str = "cosine", part_points: int = 20_000) -> DataFrame:
    """query_id, ku_id, score, rank: exact top-k among the points of the question's document.

    Vectors only are shuffled, by document; a document of more than ``part_points`` points is
    dealt to several parts, each of which gets its questions and gives k rows of each. Rows
    without id, document or vector are left out; texts are joined to the k rows later.
    """
    vector = F.col("vector").cast("array<double>").alias("vector")
    p = points.select("document_id", F.lit(0).alias("role"), F.col("ku_id").cast("long").alias("id"), vector)
    q = questions.select("document_id", F.lit(1).alias("role"), F.col("query_id").cast("long").alias("id"), vector)
    p, q = (x.where("document_id is not null and id is not null and vector is not null") for x in (p, q))
    parts = p.groupBy("document_id").agg(F.ceil(F.count(F.lit(1)) / part_points).cast("int").alias("parts"))
    p = p.join(parts, "document_id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    q = q.join(parts, "document_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = p.unionByName(q).drop("parts")
    return ranked(_met(met, ["document_id", "part"], k, metric), k, METRICS[metric][1])


def _met(rows: DataFrame, keys: list[str], k: int, metric: str) -> DataFrame:
    """Candidates of points (role 0) and questions (role 1) that share their keys: of each
    group k points of each question, which holds the group's points while its questions pass."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors = None, [], []
        for batch in batches:
            groups = list(zip(*(batch.column(c).to_pylist() for c in (*keys, "role")), strict=True))
            cuts = [n for n in range(1, len(groups)) if groups[n] != groups[n - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(groups)], strict=True) if groups else ():
                own, group, role = batch.slice(a, b - a), groups[a][:-1], groups[a][-1]
                if group != now:
                    now, ids, vectors = group, [], []
                if role == 0:
                    ids.append(np.asarray(own.column("id")))
                    vectors.append(matrix(own.column("vector")))
                for at in range(0, own.num_rows if role and ids else 0, 64):
                    few = own.slice(at, 64)
                    best = Best(np.asarray(few.column("id")), k, METRICS[metric][1])
                    for point, p in zip(ids, vectors, strict=True):
                        best.show(point, _scores(matrix(few.column("vector"), p.shape[1]), p, metric))
                    yield best.rows()

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "role", "id")
    return dealt.mapInArrow(score, CANDIDATES)


def topk_all(
    questions: DataFrame,
    points: DataFrame,
    k: int = TOP_K,
    metric: str = "cosine",
    max_queries: int | None = None,
    block: int | None = None,
) -> DataFrame:
    """As ``topk_scoped``, but among all points, for any number of questions. Questions and
    points without id or vector are left out; vectors of unequal lengths are an error.

    A block of questions (of ``BLOCK_BYTES`` with their candidates, or of ``block`` questions) is
    broadcast as one matrix; each task multiplies its points with it
    batch by batch and keeps k candidates of each query, so what is shuffled is k rows a
    query and task, not all pairs. With more than one block, the candidates of each are
    stored before the next is asked. ``max_queries`` refuses a larger set.
    """
    if max_queries is not None and questions.limit(max_queries + 1).count() > max_queries:
        raise ValueError(f"more than {max_queries} questions")
    asked = questions.select("query_id", "vector").where("query_id is not null and vector is not null")
    points = points.where("ku_id is not null and vector is not null")
    weight = None if block else 8 * F.size("vector") + 16 * k
    return ranked(in_blocks(asked, lambda own: _scored(own, points, k, metric), block or BLOCK_BYTES, weight), k, METRICS[metric][1])


def in_blocks(asked: DataFrame, candidates: Callable[[pd.DataFrame], DataFrame], most: int, weight: Column | None = None) -> DataFrame:
    """The candidates (query_id, ku_id, score) of all questions (query_id, ..), which come to the
    driver in blocks that weigh ``most`` (rows, or whatever ``weight`` counts), and one question at least.
    With more than one block, the candidates of each are stored before the next is asked."""
    spark, weight = asked.sparkSession, F.lit(1) if weight is None else weight
    total = asked.agg(F.sum(weight.cast("long"))).first()[0] or 0
    if total <= most:
        return candidates(asked.toPandas())
    rows = cut(asked.withColumn("_at", F.monotonically_increasing_id()).withColumn("_w", weight.cast("long")))
    part = F.shiftright("_at", 33)
    sizes = sorted(rows.groupBy(part.alias("part")).agg(F.sum("_w").alias("w")).collect())
    before = spark.createDataFrame([(p, sum(w for _, w in sizes[:n])) for n, (p, _) in enumerate(sizes)], "_part long, _before long")
    running = F.sum("_w").over(Window.partitionBy("_part").orderBy("_at")) - F.col("_w")
    placed = rows.withColumn("_part", part.cast("long")).withColumn("_own", running).join(before, "_part")
    placed = cut(placed.withColumn("_block", F.floor((F.col("_before") + F.col("_own")) / most)).drop("_part", "_own", "_before", "_at", "_w"))
    path = scratch(spark, "topk")
    for r in placed.select("_block").distinct().orderBy("_block").toLocalIterator():
        candidates(placed.where(F.col("_block") == r[0]).drop("_block").toPandas()).write.mode("append").parquet(path)
    return spark.read.schema(CANDIDATES).parquet(path)


def matrix(vectors: pa.Array, dimension: int | None = None) -> np.ndarray:
    """One row for each vector; all must have ``dimension`` components (those of the first)."""
    sizes = np.asarray(pc.list_value_length(vectors))
    dimension = int(sizes[0]) if dimension is None and len(sizes) else dimension
    if (sizes != dimension).any():
        raise ValueError(f"a vector has {sizes[sizes != dimension][0]} components, others have {dimension}")
    return np.asarray(vectors.flatten(), dtype=float).reshape(len(sizes), dimension or 0)


def _scores(q: np.ndarray, p: np.ndarray, metric: str) -> np.ndarray:
    """Scores of all questions (rows) and points, to six places."""
    inner = q @ p.T
    if metric == "cosine":
        length = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(p, axis=1)[None, :]
        inner = np.divide(inner, length, out=np.zeros_like(inner), where=length > 0)
    elif metric == "euclid":
        inner = np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] + (p**2).sum(axis=1)[None, :] - 2 * inner, 0))
    return np.round(inner, 6)


class Best:
    """The k best points of each of some questions, of all that were shown; those with a score
    of NaN are none."""

    def __init__(self, ids: np.ndarray, k: int, descending: bool):
        self.ids, self.k, self.sign = ids, k, -1 if descending else 1
        self.point, self.score = np.zeros((len(ids), 0), dtype=np.int64), np.zeros((len(ids), 0))

    def show(self, point: np.ndarray, score: np.ndarray) -> None:
        own = np.hstack((self.score, np.where(np.isnan(score), np.inf, self.sign * score)))
        points = np.hstack((self.point, np.tile(point, (len(own), 1))))
        order = np.lexsort((points, own), axis=1)[:, : self.k]
        self.score, self.point = np.take_along_axis(own, order, 1), np.take_along_axis(points, order, 1)

    def rows(self) -> pa.RecordBatch:
        there = self.score < np.inf
        ids = np.repeat(self.ids, self.score.shape[1])[there.reshape(-1)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(self.point[there]), pa.array(self.sign * self.score[there])],
            names=["query_id", "ku_id", "score"],
        )


CANDIDATES = "query_id long, ku_id long, score double"
TILE = 1024


def _scored(asked, points: DataFrame, k: int, metric: str) -> DataFrame:
    """The candidates of one block of questions."""
    vectors = matrix(pa.array(asked["vector"].tolist(), pa.list_(pa.float64())))
    sent = points.sparkSession.sparkContext.broadcast((asked["query_id"].to_numpy(dtype=np.int64), vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        tiles = [slice(at, at + TILE) for at in range(0, len(ids), TILE)]
        best = [Best(ids[x], k, METRICS[metric][1]) for x in tiles]
        for whole in batches:
            for at in range(0, whole.num_rows if tiles else 0, TILE):
                part = whole.slice(at, TILE)
                p, own = matrix(part.column("vector"), q.shape[1]), np.asarray(part.column("ku_id"))
                for x, found in zip(tiles, best, strict=True):
                    found.show(own, _scores(q[x], p, metric))
        for found in best:
            if found.score.size:
                yield found.rows()

    return points.select("ku_id", "vector").mapInArrow(run, CANDIDATES)


@dataclass
class Cells:
    """An inverted-file index: unit centroids of cells, how many of the nearest cells a
    question is compared with, and how many parts each cell's points are dealt to."""

    centroids: np.ndarray
    probes: int
    parts: np.ndarray

    def nearest(self, vectors: np.ndarray, n: int) -> np.ndarray:
        near = vectors @ self.centroids.T
        return near.argmax(axis=1)[:, None] if n == 1 else np.argsort(-near, axis=1, kind="stable")[:, :n]


def fit_cells(
    points: DataFrame,
    k: int = TOP_K,
    *,
    recall: float = 0.93,
    sample: int = 20_000,
    part_bytes: int = 32 << 20,
    rounds: int = 10,
    seed: int = 5,
) -> Cells | None:
    """Cells for points (ku_id, vector), or None where there is no point.

    Fitted on about ``sample`` points at most, chosen by a hash of the id: spherical k-means
    for some 1.4 times the square root of the number of points as cells, a sixteenth of the
    sample at most. ``probes`` is the least number of cells in which sampled questions find
    ``recall`` of their true k nearest among the sampled points. Every point is indexed later.
    """
    rows = points.select("ku_id", "vector").where("ku_id is not null and vector is not null")
    n = rows.count()
    some = rows.where(F.pmod(F.xxhash64("ku_id", F.lit(seed)), F.lit(1 << 30)) < min(1.0, sample / max(n, 1)) * (1 << 30))
    drawn = some.orderBy("ku_id").toArrow()
    if not drawn.num_rows:
        return None
    x = _unit(matrix(drawn["vector"].combine_chunks()))
    count = max(1, min(round(1.4 * n**0.5), len(x) // 16))
    random = np.random.default_rng(seed)
    cells = Cells(x[random.choice(len(x), count, replace=False)], 1, np.ones(count, np.int64))
    for _ in range(rounds):
        own = cells.nearest(x, 1)[:, 0]
        sums = np.zeros_like(cells.centroids)
        np.add.at(sums, own, x)
        cells.centroids = np.where(np.bincount(own, minlength=count)[:, None] > 0, _unit(sums), cells.centroids)
    own = cells.nearest(x, 1)[:, 0]
    per_part = max(part_bytes // (8 * x.shape[1]), 1)
    cells.parts = np.ceil(np.bincount(own, minlength=count) / len(x) * n / per_part).clip(1).astype(np.int64)

    asked = x[random.choice(len(x), min(len(x), 200), replace=False)]
    true = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :k]
    order = cells.nearest(asked, count)
    place = np.argsort(order, axis=1)  # of each cell in a question's order
    needed = np.take_along_axis(place, own[true], axis=1) + 1
    shares = [(needed <= probes).mean() for probes in range(1, count + 1)]
    cells.probes = 1 + int(np.argmax(np.array(shares) >= recall))
    return cells


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def topk_ann(questions: DataFrame, points: DataFrame, k: int = TOP_K, *, cells: Cells | None = None, **fit) -> DataFrame:
    """Approximate top-k by cosine: query_id, ku_id, score, rank. A question is compared, exactly,
    with the points of the cells that are nearest to it (``cells``, or what ``fit_cells`` makes
    of the points with the settings ``fit``).

    Points are shuffled by cell, large cells in parts; a question goes to each part of its
    cells. Questions that meet fewer than k points get their exact top-k, so that each has k
    rows where there are k points. Questions and points without id or vector are left out.
    """
    cells = cells or fit_cells(points, k, **fit)
    asked = questions.select("query_id", "vector").where("query_id is not null and vector is not null")
    if cells is None:
        return topk_all(asked, points, k)
    sent = points.sparkSession.sparkContext.broadcast(cells)

    def dealt(role: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Points (role 0) to a part of their cell, questions (role 1) to all parts of theirs."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = sent.value
            for whole in batches:
                for at in range(0, whole.num_rows, TILE):
                    batch = whole.slice(at, TILE)
                    ids = np.asarray(batch.column("id")).astype(np.int64)
                    near = cells.nearest(_unit(matrix(batch.column("vector"), cells.centroids.shape[1])), cells.probes if role else 1)
                    if role:
                        row, cell = np.repeat(np.arange(len(ids)), near.shape[1]), near.reshape(-1)
                        times = cells.parts[cell]
                        row, cell = np.repeat(row, times), np.repeat(cell, times)
                        part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    else:
                        row, cell = np.arange(len(ids)), near[:, 0]
                        part = np.abs(ids * 0x9E3779B1 >> 7) % cells.parts[cell]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(cell),
                            pa.array(part),
                            pa.array(np.full(len(row), role)),
                            pa.array(ids[row]),
                            batch.column("vector").take(pa.array(row)),
                        ],
                        names=["cell", "part", "role", "id", "vector"],
                    )

        return run

    schema = "cell long, part long, role long, id long, vector array<double>"
    vector = F.col("vector").cast("array<double>").alias("vector")
    stored = points.select(
        F.col("ku_id").cast("long").alias("id"),
        vector,
    ).where("id is not null and vector is not null").mapInArrow(dealt(0), schema)
    wanted = asked.select(F.col("query_id").cast("long").alias("id"), vector).mapInArrow(dealt(1), schema)

    met = _met(stored.unionByName(wanted), ["cell", "part"], k, "cosine")
    found = cut(ranked(met, k))
    full = found.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    short = cut(asked.join(full, "query_id", "left_anti"))
    if short.isEmpty():
        return found
    return found.join(full, "query_id", "left_semi").select(found.columns).unionByName(topk_all(short, points, k))


def normalize_query(query: Column) -> Column:
    """White space made single, and the hints of matching wordings appended after ' | ' unless
    a hint's first word is in the question."""
    text = F.trim(F.regexp_replace(query, SPACE + "+", " "))
    hints = [F.when(text.rlike("(?i)" + pattern) & ~F.contains(F.lower(text), F.lit(hint.split()[0])), F.lit(hint)) for pattern, hint in HINTS]
    added = F.concat_ws(" ", *hints)
    return F.when((text == "") | (added == ""), text).otherwise(F.concat_ws(" | ", text, added))
