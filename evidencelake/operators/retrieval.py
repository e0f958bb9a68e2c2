"""Signals, reciprocal rank fusion and assembly of evidence groups, all questions at once.

A candidate is a row (query_id, id, pool_pos, dense, hops, last_type, last_source,
section_id, modality, context, text); dense is null where only the graph led to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import QUERY_STOPWORDS, share, terms
from ..sources.stage import sent
from .search import BLOCK_BYTES, CANDIDATES, TILE, Best, in_blocks, ranked

RRF_K = 60
MAX_GROUPS, MAX_PRIMARIES = 5, 2
SIGNALS = ("dense", "lexical", "confidence", "proximity")
#: How far each relationship type is trusted.
TIERS = {"CITES": 3, "REFERENCES": 3, "CONTINUES": 2, "NEXT": 2, "BELONGS_TO": 1}
SEED_TIER = 4


def lexical(context: Column, text: Column, question: Column) -> Column:
    """Share of the question's content terms in context and text; 0 if it has none."""
    return F.coalesce(share(terms(question, QUERY_STOPWORDS), terms(F.concat_ws(" ", context, text), QUERY_STOPWORDS)), F.lit(0.0))


def overlaps(questions: DataFrame, units: DataFrame, part_units: int = 1024) -> DataFrame:
    """query_id, ku_id, overlap: ``lexical`` to six places of each question (query_id, document_id,
    text) and each unit (ku_id, document_id, context, text) of its document.

    Terms are taken once a text, not once a pair. A document's units are dealt to parts of about
    ``part_units``; a task holds the places of a part's terms while the document's questions pass, so
    neither texts nor terms are copied for the pairs that come out.
    """
    parts = units.groupBy("document_id").agg(F.ceil(F.count(F.lit(1)) / part_units).cast("int").alias("parts"))
    parts = sent(parts.where("document_id is not null"))
    asked = questions.select("document_id", "query_id", F.coalesce(terms(F.col("text"), QUERY_STOPWORDS), F.array().cast("array<string>")).alias("terms"))
    n = F.size("terms")
    # the overlap for each number of hits
    shares = F.when(n > 0, F.transform(F.sequence(F.lit(0), n), lambda hits: F.round(hits / n, 6))).otherwise(F.array(F.lit(0.0)))
    asked = asked.withColumn("shares", shares).join(parts, "document_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = units.select("document_id", "ku_id", terms(F.concat_ws(" ", "context", "text"), QUERY_STOPWORDS).alias("terms"))
    own = own.join(parts, "document_id").withColumn("part", F.pmod(F.xxhash64("ku_id"), F.col("parts")).cast("int"))
    rows = own.withColumn("role", F.lit(0)).unionByName(asked.withColumn("role", F.lit(1)), allowMissingColumns=True)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for batch in batches:
            groups = list(zip(*(batch.column(c).to_pylist() for c in ("document_id", "part", "role")), strict=True))
            cuts = [i for i in range(1, len(groups)) if groups[i] != groups[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(groups)], strict=True) if groups else ():
                few = batch.slice(a, b - a)
                if groups[a][:-1] != now:
                    now, held, index = groups[a][:-1], [], None
                if groups[a][-1] == 0:
                    held.append(few.select(["ku_id", "terms"]))
                elif held:
                    index = index or _Places(pa.Table.from_batches(held).combine_chunks())
                    yield from index.rows(few)

    schema = f"query_id {questions.schema['query_id'].dataType.simpleString()}, ku_id {units.schema['ku_id'].dataType.simpleString()}, overlap double"
    dealt = rows.select("document_id", "part", "role", "ku_id", "query_id", "terms", "shares").repartition("document_id", "part")
    return dealt.sortWithinPartitions("document_id", "part", "role").mapInArrow(met, schema)


class _Places:
    """Which units (ku_id, terms) have which terms: for each known term the units' places from
    ``first[term]`` on."""

    def __init__(self, units: pa.Table):
        self.ids, terms = units["ku_id"].combine_chunks(), units["terms"].combine_chunks()
        coded = terms.flatten().dictionary_encode()
        code = np.asarray(coded.indices)
        self.known = coded.dictionary
        self.unit = np.repeat(np.arange(len(terms)), np.asarray(pc.list_value_length(terms)))[np.argsort(code, kind="stable")]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(code, minlength=len(self.known)))))

    def rows(self, asked: pa.RecordBatch, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
        """query_id, ku_id, overlap of all pairs, about ``most`` at once."""
        units = len(self.ids)
        step = max(most // units, 1)
        for at in range(0, asked.num_rows, step):
            few = asked.slice(at, step)
            size, shares = (np.asarray(pc.list_value_length(few.column(c))) for c in ("terms", "shares"))
            term = pc.index_in(few.column("terms").flatten(), value_set=self.known)
            row, term = np.repeat(np.arange(len(size)), size)[np.asarray(pc.is_valid(term))], np.asarray(term.drop_null())
            times = self.first[term + 1] - self.first[term]
            place = np.repeat(self.first[term] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            hits = np.bincount(np.repeat(row, times) * units + self.unit[place], minlength=len(size) * units)
            question = np.repeat(np.arange(len(size)), units)
            overlap = np.asarray(few.column("shares").flatten())[(np.cumsum(shares) - shares)[question] + hits]
            yield pa.RecordBatch.from_arrays(
                [few.column("query_id").take(pa.array(question)), self.ids.take(pa.array(np.tile(np.arange(units), len(size)))), pa.array(overlap)],
                names=["query_id", "ku_id", "overlap"],
            )


def lexical_topk(questions: DataFrame, units: DataFrame, k: int = 20, block: int | None = None) -> DataFrame:
    """query_id, ku_id, score, rank by lexical overlap over all units that share a term with the
    question, however common the term. Questions and units without an id are left out.

    A term that most units have would pair all of them with each question that has it, so
    pairs are not joined: an index from terms to questions is broadcast, in blocks of ``BLOCK_BYTES`` (or of
    ``block`` questions); each task counts the hits of its units for the questions that can still
    enter their k best, and only those rows are shuffled.
    """
    asked = questions.select("query_id", terms(F.col("text"), QUERY_STOPWORDS).alias("terms")).where("query_id is not null and size(terms) > 0")
    own = units.select(
        "ku_id",
        terms(F.concat_ws(" ", "context", "text"), QUERY_STOPWORDS).alias("terms"),
    ).where("ku_id is not null and size(terms) > 0")
    bytes_ = F.aggregate("terms", F.lit(16 * k + 16).cast("long"), lambda n, t: n + F.octet_length(t) + 16)
    return ranked(in_blocks(asked, lambda few: _hits(few, own, k), block or BLOCK_BYTES, None if block else bytes_), k)


class _Index:
    """Which questions of a tile have which terms: for each known term, in order, the places
    of its questions from ``first[term]`` on."""

    def __init__(self, asked: pd.DataFrame):
        self.ids = asked["query_id"].to_numpy(dtype=np.int64)
        self.size = np.array([len(x) for x in asked["terms"]])
        known, column = np.unique(np.concatenate([np.asarray(x, dtype=object) for x in asked["terms"]]).astype(str), return_inverse=True)
        order = np.argsort(column, kind="stable")
        self.known = pa.array(known, pa.string())
        self.question = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.size)[order]
        self.first = np.searchsorted(column[order], np.arange(len(known) + 1)).astype(np.int32)

    def hits(self, terms: pa.ListArray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Questions that could score ``floor`` or more on these units, and their hits by unit."""
        row = np.repeat(np.arange(len(terms)), np.asarray(pc.list_value_length(terms)))
        column = pc.index_in(terms.flatten(), value_set=self.known)
        there = np.asarray(pc.is_valid(column))
        some, column = np.unique(np.asarray(column.drop_null()), return_inverse=True)
        times = self.first[some + 1] - self.first[some]
        at = np.repeat(self.first[some] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        question, term = self.question[at], np.repeat(np.arange(len(some)), times)
        most = np.bincount(question, minlength=len(self.ids))
        able = np.flatnonzero((most > 0) & (np.round(most / self.size, 6) >= floor))
        place = np.full(len(self.ids), -1)
        place[able] = np.arange(len(able))
        has = np.zeros((len(able), len(some)), dtype=np.float32)
        mine = place[question] >= 0
        has[place[question[mine]], term[mine]] = 1
        own = np.zeros((len(terms), len(some)), dtype=np.float32)
        own[row[there], column] = 1
        return able, (has @ own.T).astype(float)


def _hits(asked: pd.DataFrame, units: DataFrame, k: int) -> DataFrame:
    """The best k units of each task for one block of questions (query_id, terms)."""
    tiles = [_Index(asked.iloc[at : at + TILE]) for at in range(0, len(asked), TILE)]
    sent = units.sparkSession.sparkContext.broadcast(tiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = sent.value
        best = [Best(index.ids, k, True) for index in tiles]
        for own in best:
            own.point, own.score = np.zeros((len(own.ids), k), np.int64), np.full((len(own.ids), k), np.inf)
        for whole in batches:
            for at in range(0, whole.num_rows, TILE // 4):
                part = whole.slice(at, TILE // 4)
                for found, index in zip(best, tiles, strict=True):
                    able, hits = index.hits(part.column("terms"), -found.score[:, -1])
                    few = Best(index.ids[able], k, True)
                    few.point, few.score = found.point[able], found.score[able]
                    few.show(np.asarray(part.column("ku_id")), np.where(hits > 0, np.round(hits / index.size[able, None], 6), np.nan))
                    found.point[able], found.score[able] = few.point, few.score
        for found in best:
            yield found.rows()

    return units.mapInArrow(run, CANDIDATES)


def confidence(dense: Column, last_type: Column) -> Column:
    tier = F.coalesce(*(F.when(last_type == t, v) for t, v in TIERS.items()), F.lit(0))
    return F.when(last_type.isNull(), F.lit(SEED_TIER)).otherwise(tier).cast("double")


def signals(pool: DataFrame, questions: DataFrame) -> DataFrame:
    """The pool with its four signals; dense stays null where it is missing. Texts end here:
    what is sorted and joined later has none."""
    rows = pool.join(questions.select("query_id", F.col("text").alias("question")), "query_id")
    rows = rows.withColumn("lexical", F.round(lexical(F.col("context"), F.col("text"), F.col("question")), 9)).drop("text", "question")
    return rows.withColumn("confidence", confidence(F.col("dense"), F.col("last_type"))).withColumn("proximity", F.round(1 / (1 + F.col("hops")), 9))


def rank_signals(rows: DataFrame) -> DataFrame:
    """Competition ranks, highest first: missing values share the rank after all others."""
    for name in SIGNALS:
        order = Window.partitionBy("query_id").orderBy(F.col(name).desc_nulls_last())
        rows = rows.withColumn(f"{name}_rank", F.rank().over(order))
    return rows


def signal_ranks(rows: DataFrame) -> DataFrame:
    """Long form: query_id, id, signal, value (0 if missing), rank."""
    each = F.array(*(F.struct(F.lit(n).alias("signal"), F.coalesce(n, F.lit(0.0)).alias("value"), F.col(f"{n}_rank").alias("rank")) for n in SIGNALS))
    return rank_signals(rows).select("query_id", "id", F.explode(each).alias("s")).select("query_id", "id", "s.*")


def fuse(rows: DataFrame, k: int = RRF_K) -> DataFrame:
    """Ranked rows with fused, the sum of 1 / (k + rank), and final_rank (ties in pool order)."""
    total = F.lit(0.0)
    for n in SIGNALS:
        total = total + 1 / (F.lit(k) + F.col(f"{n}_rank"))
    out = rank_signals(rows).withColumn("fused", F.round(total, 9))
    return out.withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "pool_pos")))


def diversity_bucket(section: Column, context: Column) -> Column:
    family = F.concat(F.lit("ctx:"), F.trim(F.element_at(F.split(context, r"\[", -1), 1)))
    return F.coalesce(section.cast("string"), F.when(F.nullif(context, F.lit("")).isNotNull(), family), F.lit("__no_section__"))


def _assembled(fused: DataFrame, most_groups: int, most_primaries: int) -> DataFrame:
    """One row a question: groups (id, bucket, members) and dropped (id, reason).

    The fold walks a question's pool, a few dozen rows, in rank order. A candidate that its
    bucket shuts out is not claimed, so a later primary may still take it in.
    """
    item = F.struct(
        F.col("final_rank").alias("r"),
        "id",
        F.col("last_source").alias("from"),
        diversity_bucket(F.col("section_id"), F.col("context")).alias("bucket"),
    )
    pools = fused.select("query_id", item.alias("i")).groupBy("query_id").agg(F.array_sort(F.collect_list("i")).alias("pool"))
    start = F.struct(
        F.array().cast("array<string>").alias("claimed"), F.array().cast(
            "array<struct<id:string,bucket:string,members:array<string>>>"
        ).alias("groups"), F.array().cast("array<struct<id:string,reason:string>>").alias("dropped")
    )

    def step(s: Column, x: Column) -> Column:
        skip = F.array_contains(s["claimed"], x["id"])
        full = F.size(s["groups"]) >= most_groups
        crowded = F.size(F.filter(s["groups"], lambda g: g["bucket"] == x["bucket"])) >= most_primaries
        members = F.transform(
            F.filter(
                "pool",
                lambda o: ~F.array_contains(s["claimed"], o["id"]) & (o["id"] != x["id"]) & F.coalesce(o["from"] == x["id"], F.lit(False)),
            ),
            lambda o: o["id"],
        )
        opens = ~skip & ~full & ~crowded
        reason = F.when(full, "group budget").otherwise("bucket full")
        return F.struct(
            F.when(opens, F.concat(s["claimed"], F.array(x["id"]), members)).otherwise(s["claimed"]).alias("claimed"),
            F.when(
                opens,
                F.array_append(s["groups"], F.struct(x["id"].alias("id"), x["bucket"].alias("bucket"), members.alias("members"))),
            ).otherwise(s["groups"]).alias("groups"),
            F.when(
                ~skip & ~opens,
                F.array_append(s["dropped"], F.struct(x["id"].alias("id"), reason.alias("reason"))),
            ).otherwise(s["dropped"]).alias("dropped"),
        )

    return pools.select("query_id", F.aggregate("pool", start, step).alias("s")).select("query_id", "s.*")


def assemble(fused: DataFrame, most_groups: int = MAX_GROUPS, most_primaries: int = MAX_PRIMARIES) -> DataFrame:
    """query_id, group_rank (from 1), role, member_pos (0: the primary), id."""
    groups = _assembled(fused, most_groups, most_primaries).select("query_id", F.posexplode("groups").alias("g", "group"))
    members = groups.select(
        "query_id",
        (F.col("g") + 1).alias("group_rank"),
        F.posexplode(F.concat(F.array("group.id"), F.col("group.members"))).alias("member_pos", "id"),
    )
    return members.withColumn("role", F.when(F.col("member_pos") == 0, "primary").otherwise("supporting"))


def dropped(fused: DataFrame, most_groups: int = MAX_GROUPS, most_primaries: int = MAX_PRIMARIES) -> DataFrame:
    """query_id, id, reason of every candidate that no group opened for or took in in turn."""
    return _assembled(fused, most_groups, most_primaries).select("query_id", F.explode("dropped").alias("d")).select("query_id", "d.*")
