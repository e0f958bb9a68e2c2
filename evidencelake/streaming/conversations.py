"""Streams: stateful folding of turn events, and refresh of changed documents by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import freshness
from ..sources.stage import read_stage, write_stage

OUTPUT = "document_id long, turn_id long, status string, updated timestamp"
_STATUS = {"start": "pending", "complete": "complete", "fail": "failed"}
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Turns(StatefulProcessor):
    """The turns of a document since its last clear, one entry of the state store for each: all
    its starts and its last outcome, each with its time. What they make of a turn does not depend on
    the order in which they came, so an event counts by its time however late it is, and a
    batch reads and writes the turns that it names (a clear: all turns of its document)."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getMapState("turns", "turn string", "starts array<long>, kind string, ts long, event_id long", self.idle_ms)
        self.cleared = handle.getValueState("cleared", "ts long, event_id long", self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = tuple(self.cleared.get()) if self.cleared.exists() else _NEVER
        cleared, old, new = before, {}, {}
        for events in rows:
            for turn, kind, ts, number in zip(events["turn_id"], events["kind"], events["ts"], events["event_id"], strict=True):
                at = (_LEAST if pd.isna(ts) else pd.Timestamp(ts).value // 1000, _LEAST if pd.isna(number) else int(number))
                name = "" if pd.isna(turn) else str(int(turn))
                if kind == "clear":
                    cleared = max(cleared, at)
                elif kind in _STATUS:
                    if name not in new:
                        old[name] = new[name] = self._stored(name)
                    starts, outcome = new[name]
                    new[name] = (starts | {at}, outcome) if kind == "start" else (starts, max(outcome, (at, kind)))
        if cleared > before:
            self.cleared.update(cleared)
            for (name,), value in self.turns.iterator():
                if name not in new:
                    old[name] = new[name] = _opened(value)
        out = []
        for name, turn in new.items():
            turn = (frozenset(x for x in turn[0] if x > cleared), turn[1] if turn[1][0] > cleared else _NO_OUTCOME)
            if turn != old[name]:
                self._store(name, turn)
            was, now = _seen(old[name]), _seen(turn)
            if was != now:
                status, at = now or ("cleared", cleared)
                out.append((int(key[0]) if key[0] else None, int(name) if name else None, status, pd.NaT if at[0] == _LEAST else pd.Timestamp(at[0] * 1000)))
        frame = pd.DataFrame(out, columns=["document_id", "turn_id", "status", "updated"])
        # no generator: it would run when the state stands at another document
        return iter([frame.astype({"document_id": "Int64", "turn_id": "Int64", "updated": "datetime64[ns]"})])

    def _stored(self, name: str) -> tuple:
        return _opened(self.turns.getValue((name,))) if self.turns.containsKey((name,)) else _NO_TURN

    def _store(self, name: str, turn: tuple) -> None:
        starts, (at, kind) = turn
        if turn != _NO_TURN:
            self.turns.updateValue((name,), ([x for pair in sorted(starts) for x in pair], kind, *(at if kind else (0, 0))))
        elif self.turns.containsKey((name,)):
            self.turns.removeKey((name,))

    def close(self) -> None:
        pass


_LEAST = -(2**63)
#: Before any event; a clear that never was.
_NEVER = (_LEAST, _LEAST - 1)
_NO_OUTCOME = (_NEVER, "")
_NO_TURN = (frozenset(), _NO_OUTCOME)


def _opened(value: tuple) -> tuple:
    starts, kind, ts, number = value
    return frozenset(zip(starts[::2], starts[1::2], strict=True)), ((ts, number), kind) if kind else _NO_OUTCOME


def _seen(turn: tuple) -> tuple | None:
    """Status and time of a turn, by the rules of ``conversation_state``; nothing before its start."""
    starts, (at, kind) = turn
    if not starts:
        return None
    return (_STATUS[kind], at) if at >= min(starts) else (_STATUS["start"], min(starts))


def conversation_stream(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Streamed turn events (document_id, turn_id, kind, ts, event_id) to the turns that each
    micro-batch changes, in update mode; status 'cleared' for turns that a clear removes.

    The last row of each turn that is not 'cleared' is what ``conversation_state`` makes of all
    events so far, in whatever order they came (a null document is one by itself). With ``idle_ms``, turns and clears that no event has touched
    for so long (processing time) are dropped from the state; later events then find none of them. The
    session must keep its state in RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    if events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    # the state's key is never null: rows of a null key would be taken for those of another
    events = events.withColumn("document", F.coalesce(F.col("document_id").cast("string"), F.lit("")))
    return events.groupBy("document").transformWithStateInPandas(Turns(idle_ms), OUTPUT, "Update", "None" if idle_ms is None else "ProcessingTime")


def refresh_batches(
    manifests: Callable[[], DataFrame] | None,
    build: Callable[[DataFrame], DataFrame],
    path: str,
    model: str,
    version: str,
    buckets: int | None = None,
    writer: str = "refresh",
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that rebuilds the stale documents of each micro-batch
    (document_id, source_hash, ..) and replaces what is stored of them under ``path``.

    Documents and their manifests (document_id, model, version, source_hash; the table
    ``manifests`` of ``read_stage``) are replaced in one commit, which also keeps the batch's number: a batch
    that comes again changes nothing. A document of whose rebuild nothing is left has nothing
    stored any more, and a manifest. Without ``manifests`` the stored ones tell what is stale.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        sources = batch.select("document_id", "source_hash").distinct()
        known = manifests() if manifests else read_stage(spark, path, "manifests")
        if known is None:
            known = spark.createDataFrame([], "document_id long, model string, version string, source_hash string")
        stale = freshness.stale_documents(sources, known, model, version).where("stale").select("document_id").distinct()
        fresh = build(batch.join(stale, "document_id", "left_semi"))
        made = sources.join(stale, "document_id", "left_semi").groupBy("document_id").agg(F.max("source_hash").alias("source_hash"))
        made = made.select("document_id", F.lit(model).alias("model"), F.lit(version).alias("version"), "source_hash")
        write_stage(fresh, path, buckets, keys=stale, also={"manifests": made}, batch=number, writer=writer)

    return handle
