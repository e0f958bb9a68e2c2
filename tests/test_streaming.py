import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from evidencelake.operators import conversation
from evidencelake.sources import stage
from evidencelake.streaming import conversations

SCHEMA = "document_id long, turn_id long, kind string, ts timestamp, event_id long"


def rows():
    at = datetime.datetime(2024, 1, 1)
    kinds = ["start", "complete", "start", "fail", "clear", "complete", "start"]
    return [(d, (k // 2) if d % 2 else k % 3, kinds[k % 7], at + datetime.timedelta(minutes=k), k) for d in range(4) for k in range(12)]


def test_stream_agrees_with_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", conversations.ROCKSDB)
    events = spark.createDataFrame(rows(), SCHEMA)
    for n, (a, b) in enumerate([(0, 5), (5, 8), (8, 12)]):
        events.where((F.col("event_id") >= a) & (F.col("event_id") < b)).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    seen = []
    query = conversations.conversation_stream(source).writeStream.outputMode("update").foreachBatch(lambda df, k: seen.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    last = {}
    for r in seen:
        last[(r["document_id"], r["turn_id"])] = r["status"]
    batch = {(r["document_id"], r["turn_id"]): r["status"] for r in conversation.conversation_state(events).collect()}
    assert {k: v for k, v in last.items() if v != "cleared"} == batch


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch_for_any_order_and_split(spark, tmp_path, seed):
    """Late clears, outcomes before their starts, several starts, repeated and null times."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", conversations.ROCKSDB)
    rng, at = random.Random(seed), datetime.datetime(2024, 1, 1)
    kinds = ["start", "start", "complete", "fail", "clear"]
    data = [
        (d, rng.choice([0, 1, 2, None]), rng.choice(kinds if rng.random() < 0.5 else kinds[:4]), None if rng.random() < 0.03 else at + datetime.timedelta(seconds=rng.randint(0, 15)), n)
        for n, d in enumerate(rng.choice([*range(40), None]) for _ in range(600))
    ]
    rng.shuffle(data)
    cuts = sorted(rng.sample(range(1, len(data)), 3))
    parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
    parts[2] = parts[2] + parts[0][:50]  # events that come again
    for n, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    seen = []
    query = conversations.conversation_stream(source).writeStream.outputMode("update").foreachBatch(lambda df, k: seen.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    last = {(r["document_id"], r["turn_id"]): (r["status"], r["updated"]) for r in seen}
    batch = conversation.conversation_state(spark.createDataFrame(data, SCHEMA).where("document_id is not null")).collect()
    wanted = {(r["document_id"], r["turn_id"]): (r["status"], r["updated"]) for r in batch}
    assert {k: v for k, v in last.items() if v[0] != "cleared" and k[0] is not None} == wanted and len(wanted) > 40
    assert any(v[0] == "cleared" for v in last.values())


def test_idle_state_is_dropped(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", conversations.ROCKSDB)
    at = datetime.datetime(2024, 1, 1)
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    seen, done = [], []

    def take(df, _):
        done.extend(seen_now := df.collect())
        seen.extend(r for r in seen_now if r["turn_id"] == 1)

    query = conversations.conversation_stream(source, idle_ms=1).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", f"{tmp_path}/check").start()
    try:
        for n, rows in enumerate([[(1, 1, "start", at, 1)], [(1, 1, "complete", at + datetime.timedelta(seconds=1), 2), (2, 2, "start", at, 3)]]):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
            for _ in range(300):
                if len(done) > n:
                    break
                time.sleep(0.1)
    finally:
        query.stop()
    assert len(done) == 2 and [r["status"] for r in seen] == ["pending"]  # the start was forgotten


def test_refresh_replaces_changed_documents(spark, tmp_path):
    path = f"{tmp_path}/stored"
    manifests = spark.createDataFrame(
        [(1, "m", "v", "h1"), (2, "m", "v", "h2")],
        "document_id long, model string, version string, source_hash string",
    )
    build = lambda df: df.select("document_id", "source_hash")
    handle = conversations.refresh_batches(lambda: manifests, build, path, "m", "v")
    empty = manifests.where("false")
    conversations.refresh_batches(lambda: empty, build, path, "m", "v")(manifests.select("document_id", "source_hash"), 0)
    handle(spark.createDataFrame([(1, "h1"), (2, "new"), (3, "h3")], "document_id long, source_hash string"), 1)
    got = {r["document_id"]: r["source_hash"] for r in spark.read.parquet(path).collect()}
    assert got == {1: "h1", 2: "new", 3: "h3"}


def test_documents_that_share_a_bucket_stay(spark, tmp_path):
    path, schema = f"{tmp_path}/shared", "document_id long, source_hash string"
    stage.write_stage(spark.createDataFrame([(k, "old") for k in range(999)] + [(None, "old")], schema), path, buckets=4)
    stage.write_stage(spark.createDataFrame([(7, "new"), (7, "newer"), (5000, "new"), (None, "new")], schema), path, buckets=4)
    got = sorted((str(r["document_id"]), r["source_hash"]) for r in spark.read.parquet(path).collect())
    assert got == sorted([(str(k), "old") for k in range(999) if k != 7] + [("7", "new"), ("7", "newer"), ("5000", "new"), ("None", "new")])


def test_refresh_keeps_unchanged_documents_of_a_bucket(spark, tmp_path):
    path, schema = f"{tmp_path}/many", "document_id long, model string, version string, source_hash string"
    manifests = spark.createDataFrame([(k, "m", "v", "h") for k in range(1000)], schema)
    build = lambda df: df.select("document_id", "source_hash")
    conversations.refresh_batches(
        lambda: manifests.where("false"),
        build,
        path,
        "m",
        "v",
        buckets=4,
    )(manifests.select("document_id", "source_hash"), 0)
    conversations.refresh_batches(
        lambda: manifests,
        build,
        path,
        "m",
        "v",
        buckets=4,
    )(spark.createDataFrame([(5, "changed"), (6, "h")], "document_id long, source_hash string"), 1)
    got = {r["document_id"]: r["source_hash"] for r in spark.read.parquet(path).collect()}
    assert got == {k: "changed" if k == 5 else "h" for k in range(1000)}


STORED = "document_id long, s string"


def stored(spark, path, table=None):
    return sorted((str(r[0]), r[-1]) for r in stage.read_stage(spark, path, table).collect())


def test_a_rebuild_that_gives_nothing_leaves_nothing_and_a_manifest(spark, tmp_path):
    path, schema = f"{tmp_path}/t", "document_id long, source_hash string"
    build = lambda df: df.where("source_hash <> 'empty'")
    handle = conversations.refresh_batches(None, build, path, "m", "v")
    handle(spark.createDataFrame([(5, "b"), (6, "c")], schema), 0)
    handle(spark.createDataFrame([(5, "empty"), (7, "empty")], schema), 1)
    assert stored(spark, path) == [("6", "c")] == sorted((str(r["document_id"]), r["source_hash"]) for r in spark.read.parquet(path).collect())
    assert stored(spark, path, "manifests") == [("5", "empty"), ("6", "c"), ("7", "empty")]
    seen = []
    conversations.refresh_batches(None, lambda df: seen.extend(df.collect()) or df, path, "m", "v")(spark.createDataFrame([(5, "empty"), (6, "c")], schema), 2)
    assert seen == []


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    one, two = (spark.createDataFrame([(1, s)], STORED) for s in "ab")
    assert stage.write_stage(one, path, batch=0) and stage.write_stage(two, path, batch=1)
    assert not stage.write_stage(one, path, batch=0) and not stage.write_stage(one, path, batch=1)
    assert stored(spark, path) == [("1", "b")]
    assert stage.write_stage(one, path, batch=0, writer="other") and stored(spark, path) == [("1", "a")]


def test_a_failure_before_the_commit_leaves_the_old_state(spark, tmp_path):
    path, schema = f"{tmp_path}/t", "document_id long, v string"
    both = lambda s: (spark.createDataFrame([(1, s), (2, s)], STORED), {"manifests": spark.createDataFrame([(1, s), (2, s)], schema)})
    rows, also = both("old")
    stage.write_stage(rows, path, also=also, batch=0)
    rows, also = both("new")
    broken = {"manifests": also["manifests"].withColumn("v", F.raise_error(F.lit("stop")))}
    with pytest.raises(Exception, match="stop"):
        stage.write_stage(rows, path, also=broken, batch=1)
    assert stored(spark, path) == stored(spark, path, "manifests") == [("1", "old"), ("2", "old")]
    assert stage.write_stage(rows, path, also=also, batch=1)
    assert stored(spark, path) == stored(spark, path, "manifests") == [("1", "new"), ("2", "new")]


@pytest.mark.parametrize("moves", [0, 1, 3])
def test_a_failure_after_the_commit_is_made_good(spark, tmp_path, monkeypatch, moves):
    path = f"{tmp_path}/t"
    rows = lambda s, n: spark.createDataFrame([(k, s) for k in range(n)], STORED)
    stage.write_stage(rows("old", 12), path, buckets=4, also={"m": rows("old", 12)})
    true, done = stage.move, []

    def move(session, a, b):
        if "bucket=" in a:
            done.append(a)
            if len(done) > moves:
                raise OSError("lost")
        true(session, a, b)

    monkeypatch.setattr(stage, "move", move)
    keys = spark.range(14).select(F.col("id").alias("document_id"))
    with pytest.raises(OSError, match="lost"):
        stage.write_stage(rows("new", 10), path, keys=keys, also={"m": rows("new", 11)})
    monkeypatch.setattr(stage, "move", true)
    for _ in range(2):
        assert stored(spark, path) == [(str(k), "new") for k in sorted(range(10), key=str)]
        assert stored(spark, path, "m") == [(str(k), "new") for k in sorted(range(11), key=str)]
        stage.write_stage(rows("new", 1), path)
    assert spark.read.parquet(path).count() == 10


def test_buckets_grow_with_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stage, "BUCKET_BYTES", 4000)
    path, wanted = f"{tmp_path}/t", {}
    sizes = []
    for n in range(5):
        rows = [(k, f"{n}-{k}") for k in range(n * 300, n * 300 + 100 * (n + 1) ** 2)]
        wanted |= dict(rows)
        stage.write_stage(spark.createDataFrame(rows, STORED), path)
        sizes.append(len(stage.folders(spark, path)) - 1)  # and the state's own
    assert stored(spark, path) == sorted((str(k), v) for k, v in wanted.items())
    assert sizes == sorted(sizes) and sizes[-1] >= 4 * sizes[0]


def test_empty_writes_and_new_columns(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert stage.read_stage(spark, path) is None
    stage.write_stage(spark.createDataFrame([], STORED), path)
    assert stored(spark, path) == []
    stage.write_stage(spark.createDataFrame([(1, "a"), (None, "n")], STORED), path)
    stage.write_stage(spark.createDataFrame([(2, "b", 7)], STORED + ", more int"), path)
    assert sorted((str(r["document_id"]), r["s"], r["more"]) for r in stage.read_stage(spark, path).collect()) == [("1", "a", None), ("2", "b", 7), ("None", "n", None)]
    stage.write_stage(spark.createDataFrame([], STORED), path, keys=spark.createDataFrame([(None,), (2,), (9,)], "document_id long"))
    assert [tuple(r)[:2] for r in stage.read_stage(spark, path).collect()] == [(1, "a")]


def test_the_shared_folder(spark):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda key, default: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "applicationId": "a", "getCheckpointDir": staticmethod(lambda: None)})  # noqa: N815

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        stage.shared_dir(Cluster)
    Cluster.sparkContext.getCheckpointDir = staticmethod(lambda: "hdfs://host/folder/")
    assert stage.shared_dir(Cluster) == "hdfs://host/folder"
