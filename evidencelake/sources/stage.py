"""Reading and writing of stage tables, and lineage cuts, in folders that all executors share."""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL: dict[str, str] = {}
_SCRATCH: set[str] = set()

#: Stored units; a field that an older file lacks reads as null.
UNITS_JSON = (
    "document_id string, count int, chunks array<struct<id: string, section_id: string, `order`: int, modality: string, text: "
    "string, retrieval_context: string, token_count: int, source_element_ids: array<string>>>"
)

#: Places of a document whose units are one stored object.
PART = 32

#: Bytes of keys that may be broadcast.
SENT_BYTES = 64 << 20

#: Bytes of one bucket of a stored table, and the most buckets that one has.
BUCKET_BYTES, MAX_BUCKETS = 128 << 20, 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, else the
    one that ``setCheckpointDir`` was given. Where neither is set, a local session gets a
    temporary folder; a cluster gets an error, as its executors would write to their own disks. A
    folder that was set is taken as it is: on a cluster a ``file:`` one must be mounted by all."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[context.applicationId]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is still there when the driver's Python ends is
    deleted then; ``delete`` does it before."""
    root = f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}"
    if root not in _SCRATCH:
        _SCRATCH.add(root)
        atexit.register(_clean, spark._jvm, spark._jsc.hadoopConfiguration(), root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _clean(jvm, conf, root: str) -> None:
    try:
        where = jvm.org.apache.hadoop.fs.Path(root)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM may have ended before Python
        pass


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where, to = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    files = where.getFileSystem(conf)
    files.mkdirs(to.getParent())
    if not files.rename(where, to):
        raise OSError(f"{path} could not be moved to {to}")


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none if it does not exist."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in files.listStatus(where) if x.isDirectory()) if files.exists(where) else []


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files under ``path``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def save_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, there with all of its content or not at all."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path + ".new")
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    delete(spark, path)
    move(spark, path + ".new", path)


def load_text(spark: SparkSession, path: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    source = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint: computed once, however often it is used."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def sent(keys: DataFrame, most_bytes: int = SENT_BYTES) -> DataFrame:
    """Distinct ``keys`` to join with: broadcast where they are measured and have ``most_bytes`` at
    most, so that the other side is not shuffled; else left to a shuffle join."""
    keys = cut(keys.distinct())
    size = F.sum(F.lit(16) + sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in keys.columns), F.lit(0)))
    return F.broadcast(keys) if (keys.agg(size).first()[0] or 0) <= most_bytes else keys


def read_units_json(spark: SparkSession, path: str) -> DataFrame:
    """One row for each unit of stored unit files (one JSON object a file; a document may have several)."""
    return unpack_units(spark.read.schema(UNITS_JSON).option("multiLine", True).json(path))


def unpack_units(files: DataFrame) -> DataFrame:
    return files.select("document_id", F.explode("chunks").alias("c")).select("document_id", "c.*")


def pack_units(units: DataFrame, most: int = PART) -> DataFrame:
    """Units (document_id and the fields of a chunk) to objects of ``UNITS_JSON``, one for each
    ``most`` places of a document, so that no object grows with its document."""
    chunk = F.struct(*(c for c in units.columns if c != "document_id"))
    parts = units.groupBy(F.col("document_id").cast("string").alias("document_id"), F.floor(F.col("order") / most).alias("part"))
    return parts.agg(F.count(F.lit(1)).cast("int").alias("count"), F.collect_list(chunk).alias("chunks")).drop("part")


def read_stage(spark: SparkSession, path: str, table: str | None = None) -> DataFrame | None:
    """What is stored under ``path`` by ``write_stage``, or its further table of that name;
    nothing if there is none. Buckets that are committed but not yet in place are read from
    where they are; ``spark.read.parquet(path)`` reads what is in place."""
    state, pending = _state(spark, path)
    where, schema = _place(path, table), state["schemas"].get(table or "")
    places = {name: f"{where}/{name}" for name in folders(spark, where) if name.startswith("bucket=")}
    for work, plan in pending:
        new = plan["written"].get(table or "", [])
        places = {k: v for k, v in places.items() if k in new or (plan["touched"] is not None and k not in plan["touched"])}
        places |= {k: p for k in new if exists(spark, p := f"{work}/{table or 'rows'}/{k}")}
    if not schema:
        return spark.read.parquet(where).drop("bucket") if places else None
    read = spark.read.schema(T.StructType.fromJson(json.loads(schema)))
    if not places:
        return spark.createDataFrame([], T.StructType.fromJson(json.loads(schema)))
    return read.parquet(*places.values()) if pending else read.parquet(where).drop("bucket")


def write_stage(
    df: DataFrame,
    path: str,
    buckets: int | None = None,
    key: str = "document_id",
    *,
    keys: DataFrame | None = None,
    also: dict[str, DataFrame] | None = None,
    batch: int | None = None,
    writer: str = "",
) -> bool:
    """Replace what is stored under ``path`` of the keys in ``keys`` (or else in ``df``) by the
    rows of ``df``; all other keys stay. A key of ``keys`` without a row in ``df`` is gone then.

    ``also`` has further tables with the same key (manifests, say) that are replaced for the
    same keys in the same commit; ``read_stage`` reads them by name. ``batch`` is the number of a
    micro-batch of ``writer``: one that was stored already changes nothing, and False is returned.

    Buckets of the key's hash are the folders, as many as the table's bytes ask for (or
    ``buckets`` when it is first written); the number is stored with the table, and a table that has
    outgrown it is dealt anew. The buckets that the keys touch are read without those keys and written
    beside the table with the new rows, hot ones by several tasks; no other bucket is read.
    Then one small file commits them, and they are moved into place. A failure before the commit
    leaves the table as it was; one after it is made good by the next write.
    One writer at a time. A null key is a key as any other.
    """
    spark = df.sparkSession
    state, pending = _state(spark, path)
    for work, plan in pending:
        _finish(spark, path, work, plan)
    delete(spark, f"{path}/_next")  # of writes that failed
    if batch is not None and batch <= state["batches"].get(writer, -1):
        return False
    work = f"{path}/_next/{uuid.uuid4().hex}"
    new = {"": df} | (also or {})
    rows = {name: _written(part, f"{work}/_rows-{name}") for name, part in new.items()}
    gone = rows[""].select(key) if keys is None else _written(keys.select(key), f"{work}/_keys").unionByName(rows[""].select(key))
    gone = gone.select(F.col(key).alias("_gone")).distinct()
    count = _bucket_count(spark, path, state, buckets, sum(size_of(spark, f"{work}/_rows-{name}") for name in new))
    dealt = count != state["buckets"]  # every bucket is written anew
    bucket = lambda column: F.pmod(F.xxhash64(column), F.lit(count)).cast("int")
    touched = None if dealt else [r["b"] for r in gone.select(bucket("_gone").alias("b")).distinct().collect()]  # as many as buckets
    written: dict[str, list[str]] = {}
    for name, part in rows.items():
        where = _place(path, name)
        if any(x.startswith("bucket=") for x in folders(spark, where)):
            stored = spark.read.schema(T.StructType.fromJson(json.loads(state["schemas"][name])).add("bucket", T.IntegerType())) if name in state["schemas"] else spark.read
            stored = stored.parquet(where)
            stored = (stored if dealt else stored.where(F.col("bucket").isin(touched))).drop("bucket")
            part = part.unionByName(stored.join(gone, stored[key].eqNullSafe(gone["_gone"]), "left_anti"), allowMissingColumns=True)
        state["schemas"][name] = part.schema.json()
        part.withColumn("bucket", bucket(key)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{work}/{name or 'rows'}")
        written[name] = folders(spark, f"{work}/{name or 'rows'}")
    if batch is not None:
        state["batches"][writer] = batch
    state["buckets"] = count
    plan = {"state": state, "written": written, "touched": None if touched is None else [f"bucket={b}" for b in touched]}
    save_text(spark, f"{work}/_commit", json.dumps(plan))
    _finish(spark, path, work, plan)
    return True


def _place(path: str, table: str | None) -> str:
    return f"{path}/_tables/{table}" if table else path


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bucket_count(spark: SparkSession, path: str, state: dict, asked: int | None, more: int) -> int:
    """The table's number of buckets; a power of two that keeps them under twice ``BUCKET_BYTES``
    where nobody asked for another number."""
    if state["buckets"] and state["asked"]:
        return state["buckets"]
    if not state["buckets"] and any(x.startswith("bucket=") for x in folders(spark, path)):  # written before the number was stored
        state["asked"] = True
        return asked or 64
    if asked:
        state["asked"] = True
        return asked
    stored = size_of(spark, path) if state["buckets"] else 0
    need = max(1, (stored + more) // BUCKET_BYTES)
    return state["buckets"] if need < 2 * state["buckets"] else min(1 << (need - 1).bit_length(), MAX_BUCKETS)


def _state(spark: SparkSession, path: str) -> tuple[dict, list[tuple[str, dict]]]:
    """The table's state, and writes that are committed but not finished (one at most)."""
    works = [f"{path}/_next/{name}" for name in folders(spark, f"{path}/_next")]
    pending = [(w, json.loads(load_text(spark, f"{w}/_commit"))) for w in works if exists(spark, f"{w}/_commit")]
    if pending:
        return pending[-1][1]["state"], pending
    if exists(spark, f"{path}/_state"):
        return json.loads(load_text(spark, f"{path}/_state")), []
    return {"buckets": 0, "asked": False, "batches": {}, "schemas": {}}, []


def _finish(spark: SparkSession, path: str, work: str, plan: dict) -> None:
    """Move committed buckets into place; done twice it changes nothing more."""
    for table, names in plan["written"].items():
        where = _place(path, table)
        for name in folders(spark, where) if plan["touched"] is None else plan["touched"]:
            if name.startswith("bucket=") and name not in names:
                delete(spark, f"{where}/{name}")
        for name in names:
            if exists(spark, f"{work}/{table or 'rows'}/{name}"):
                delete(spark, f"{where}/{name}")
                move(spark, f"{work}/{table or 'rows'}/{name}", f"{where}/{name}")
    save_text(spark, f"{path}/_state", json.dumps(plan["state"]))
    delete(spark, work)
