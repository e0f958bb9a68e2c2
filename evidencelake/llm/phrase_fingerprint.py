"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases level by level. Runs of one symbol become one
symbol; deterministic coin tossing then turns symbols into a few labels, by the lowest bit
in which each differs from the one before, and a phrase starts at each local maximum of
the labels. A phrase's name is a hash of its symbols, and names are the symbols of the next
level. Where a phrase starts depends on a few symbols around it only, so equal substrings
get equal names inside, at any offset. The fingerprint is the smallest hashes of the names
of all phrases of at least ``MIN_BYTES`` bytes, and of the whole text's.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SLICE_BYTES, mix64, slices, utf8

MIN_BYTES = 8
SKETCH = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE_NAMES = mix64(np.arange(1, 257, dtype=np.uint64) * _STEP)


def _toss_table(size: int) -> np.ndarray:
    """Labels for all pairs (symbol, symbol before) of an alphabet of ``size``."""
    a, b = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    differ = a ^ b
    low = np.bitwise_count((differ & -differ) - 1)
    low[differ == 0] = 0
    return (2 * low + ((a >> low) & 1)).astype(np.uint8).reshape(-1)


#: After each toss an alphabet of 256, 16, 8 symbols has 16, 8, 6 left.
_TOSSES = ((256, _toss_table(256)), (16, _toss_table(16)), (8, _toss_table(8)))


def _toss(label: np.ndarray, first: np.ndarray, tosses: tuple = _TOSSES) -> np.ndarray:
    """Labels below 6 from small labels, of which no two neighbours are equal."""
    for size, table in tosses:
        pair = label.astype(np.uint16) * np.uint16(size)
        pair[1:] |= label[:-1]
        pair[first] = (label[first].astype(np.uint16) * np.uint16(size)) | (label[first] ^ 1)
        label = table[pair]
    return label


def _toss_large(name: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6 from 64-bit names: two tosses by arithmetic, two by table."""
    for dtype in (np.uint64, np.uint8):
        name = name.astype(dtype)
        differ = name.copy()
        differ[1:] ^= name[:-1]
        differ[first] = 1
        low = np.bitwise_count((differ & (~differ + dtype(1))) - dtype(1)).astype(dtype)
        name = (low * dtype(2) + ((name >> low) & dtype(1))).astype(np.uint8)
    return _toss(name, first, _TOSSES[1:])


def _phrase_starts(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Local maxima of the labels inside each text, and the texts' first symbols."""
    peak = np.zeros(len(label), dtype=bool)
    peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    peak[np.append(first[1:], len(label)) - 1] = False  # a text's last symbol has no successor
    peak[first] = True
    return np.flatnonzero(peak)


def _phrase_names(name: np.ndarray, start: np.ndarray, piece: int = 1 << 18) -> np.ndarray:
    """A hash of the symbols of each phrase in order, so many phrases at a time."""
    out = np.empty(len(start), dtype=np.uint64)
    for at in range(0, len(start), piece):
        own = start[at : at + piece]
        end = int(start[at + piece]) if at + piece < len(start) else len(name)
        place = np.arange(own[0], end) - np.repeat(own, np.diff(own, append=end))
        out[at : at + piece] = np.add.reduceat(mix64(name[own[0] : end] + (place.astype(np.uint64) + np.uint64(1)) * _STEP), own - own[0])
    return mix64(out)


def phrases(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, name) of every phrase of ``MIN_BYTES`` or more and of every whole text."""
    filled = np.flatnonzero(np.diff(offsets))
    first = offsets[:-1][filled]
    owner = filled
    name = size = None
    owners, names = [], []
    while len(first):
        # runs
        symbol = data if name is None else name
        new = np.ones(len(symbol), dtype=bool)
        new[1:] = symbol[1:] != symbol[:-1]
        new[first] = True
        start = np.flatnonzero(new).astype(np.int32 if len(symbol) < 1 << 31 else np.int64)
        del new
        times = np.diff(start, append=start.dtype.type(len(symbol)))
        many = times > 1
        length = times if size is None else np.add.reduceat(size, start)
        first = np.searchsorted(start, first)
        if name is None:
            label = _toss(symbol[start], first)
            name = _BYTE_NAMES[symbol[start]]
        else:
            name = symbol[start]
            label = None
        if many.any():
            name = name.copy()
            name[many] = mix64(name[many] + times[many].astype(np.uint64) * _STEP)
        if label is None:
            label = _toss_large(name, first)
        # phrases
        start = _phrase_starts(label, first)
        del label, times, many
        name = _phrase_names(name, start)
        size = np.add.reduceat(length, start)
        first = np.searchsorted(start, first)
        count = np.diff(np.append(first, len(name)))
        text = np.repeat(owner, count)
        keep = (size >= MIN_BYTES) | (np.repeat(count, count) == 1)
        owners.append(text[keep])
        names.append(name[keep])
        # texts of one phrase are done
        on = np.repeat(count > 1, count)
        name, size = name[on], size[on]
        owner, count = owner[count > 1], count[count > 1]
        first = np.cumsum(count) - count
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(names)


def sketches(texts: pa.Array, k: int = SKETCH) -> list[np.ndarray]:
    """For each text the ``k`` smallest 32-bit hashes of its phrase names, ascending."""
    data, offsets = utf8(texts)
    owner, name = phrases(data, offsets)
    value = (mix64(name ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.int64)
    both = np.unique((owner.astype(np.int64) << 32) | value)
    owner, value = both >> 32, (both & 0xFFFFFFFF).astype(np.uint32)
    cuts = np.searchsorted(owner, np.arange(len(offsets)))
    return [value[a : min(b, a + k)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _few(texts: list[str], most: int = SLICE_BYTES) -> Iterator[list[str]]:
    """The texts in runs of about ``most`` characters, a longer one alone."""
    own: list[str] = []
    held = 0
    for text in texts:
        if own and held + len(text) > most:
            yield own
            own, held = [], 0
        own.append(text)
        held += len(text)
    if own:
        yield own


def likeness(a: np.ndarray, b: np.ndarray, k: int = SKETCH) -> float:
    """Estimated share of phrases that two texts have in common (twice the common ones over
    the sum of both): 1 for equal sketches, two empty ones too."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    union = np.union1d(a, b)[:k]
    both = len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True))
    return 2 * both / (len(union) + both) if both else 0.0


def as_hex(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def fingerprint(df: DataFrame, *, text_col: str = "text", fingerprint_col: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of each text: its sketch, eight hex digits a hash, in place of
    a column of that name. Null and empty texts have an empty fingerprint. No shuffle."""
    kept = [c for c in df.columns if c != fingerprint_col]
    schema = df.select(*(f"`{c}`" for c in kept)).schema.add(fingerprint_col, "string", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            made = [as_hex(x) for x in sketches(batch.column(text_col))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(made, pa.string())], names=[*kept, fingerprint_col])

    return df.select(*(f"`{c}`" for c in dict.fromkeys([*kept, text_col]))).mapInArrow(run, schema)


def _starts(rows: DataFrame, ranges: int, seed: int = 3, sampled: int = 100) -> list[tuple]:
    """Keys (none, back, code) at which about equal amounts of text start, ascending: the least
    of all, then keys from a sample of some ``sampled`` rows a range. Only these go to the driver."""
    n, least = rows.agg(F.count(F.lit(1)), F.min("key")).first()
    if not n:
        return []
    drawn = rows.select("key", F.octet_length("text").alias("bytes")).sample(fraction=min(1.0, sampled * ranges / n), seed=seed)
    drawn = sorted((_plain(r["key"]), r["bytes"] + 64) for r in drawn.collect())
    total, upto, starts = sum(size for _, size in drawn), 0, [_plain(least)]
    for key, size in drawn:
        if upto * ranges >= total * len(starts) and key > starts[-1]:
            starts.append(key)
        upto += size
    return starts


def _plain(key) -> tuple:
    return key["none"], key["back"] or 0, key["code"]


def _dealt(df: DataFrame, ranges: int) -> DataFrame:
    """(text, key, id, part, ghost) of (id, text): rows dealt to ranges in the order in which
    documents follow each other: descending ids (null last), then a hash of the text.

    A range starts at the key of a row, so a row sees by its own key that it is a range's first
    one. It then also goes to the range before (from the first range to the last) as the ghost
    that follows that range: one boundary row for each range, found without a join.
    """
    key = F.struct(F.col("id").isNull().alias("none"), F.coalesce(F.bitwise_not("id"), F.lit(0)).alias("back"), F.xxhash64("text").alias("code"))
    rows = df.withColumn("key", key)
    starts = _starts(rows, ranges)
    n = max(len(starts), 1)
    known = F.from_json(
        F.lit(json.dumps([dict(zip(("none", "back", "code"), x, strict=True)) for x in starts])),
        "array<struct<none:boolean,back:bigint,code:bigint>>",
    )
    bits = (n - 1).bit_length()

    def halve(low: Column, step: Column) -> Column:
        return F.when((low + step < n) & (F.get(known, low + step) <= F.col("key")), low + step).otherwise(low)

    # the last start that is not behind the row's key, by halving
    part = F.aggregate(F.array(*(F.lit(1 << k) for k in reversed(range(bits)))), F.lit(0), halve) if bits else F.lit(0)
    rows = rows.withColumn("part", part)
    own = F.struct("part", F.lit(False).alias("ghost"))
    before = F.when(
        F.col("key") == F.get(known, F.col("part")),
        F.struct(F.pmod(F.col("part") - 1, F.lit(n)).alias("part"), F.lit(True).alias("ghost")),
    )
    places = F.filter(F.array(own, before), lambda x: x.isNotNull())
    dealt = rows.select("id", "text", "key", F.explode(places).alias("p")).select("id", "text", "key", "p.*")
    return dealt.repartitionById(n, "part").sortWithinPartitions("part", "ghost", "key", "text")


def compare_with_edits(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprint of each text and of its edit, and how alike they and the next text's are.

    Documents follow each other by descending id (null ids last; equal ids by a hash of the
    text), and after the last comes the first. In the edit, the last half of the code points
    (rounded down) is replaced by the first as many of the next document. One shuffle, by
    ``ranges`` ranges of ids (as many as there are shuffle partitions), which a task goes through in
    pieces; what crosses a border between ranges is one row for each. Rows that are equal in id
    and text stay in one range, all others can be in several. Ids are whole numbers (or strings
    of such); any other stops the job. Columns: the id, n_chars,
    edited (text), fingerprint, edited_fingerprint, near_edited, near_next.
    """
    own = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = _dealt(own, ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).select("id", "text", "part", "ghost")

    def finish(ids: list, texts: list[str]) -> pa.RecordBatch:
        """All but the last of the texts, which is that which follows."""
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts[:-1], texts[1:], strict=True)]
        made = [x for few in _few([*texts, *edited]) for x in sketches(pa.array(few, pa.large_string()))]
        plain, other = made[: len(texts)], made[len(texts) :]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array(edited, pa.string()), pa.array([as_hex(x) for x in plain[:-1]], pa.string()),
                pa.array([as_hex(x) for x in other], pa.string()), pa.array(
                    [likeness(a, b) for a, b in zip(plain, other, strict=False)],
                    pa.float64(),
                ), pa.array([likeness(a, b) for a, b in zip(plain[:-1], plain[1:], strict=True)], pa.float64()),
            ],
            names=["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        held, done = 0, None  # bytes held; the range whose ghost has come
        for batch in batches:
            for part, ghost, key, text in zip(
                batch.column("part").to_pylist(),
                batch.column("ghost").to_pylist(),
                batch.column("id").to_pylist(),
                batch.column("text"),
                strict=True,
            ):
                if ghost and part == done:
                    continue
                text = text.as_py()
                texts.append(text)
                if ghost:
                    yield finish(ids, texts)
                    ids, texts, held, done = [], [], 0, part
                    continue
                if held > SLICE_BYTES // 2:  # each text comes twice, plain and edited
                    yield finish(ids, texts)
                    ids, texts, held = [], [text], 0
                ids.append(key)
                held += len(text)
        if ids:
            raise RuntimeError("a range of ids has no successor")

    out = dealt.mapInArrow(
        run,
        "id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
    return out.withColumnRenamed("id", id_col)
