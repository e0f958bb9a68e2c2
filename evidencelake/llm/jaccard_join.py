"""N-gram Jaccard self-join: MinHash banding, then exact verification.

1. Texts with the same words form one class: rows are grouped by two independent 64-bit
   hashes of the word sequence, with partial sums before the shuffle, so that thousands of
   copies cost one row each. Only one row of each class goes on.
2. Its MinHash signature is cut into bands; band hashes are shuffled, and buckets with one
   member fall away. Of several buckets with the same members the first is enough.
3. The members of a bucket are dealt to blocks. A task group holds the 5-word shingle sets of
   one block and those of half of the other blocks stream past it, so each pair of blocks
   meets once, and a set is sent once for each block that it meets. A pair is counted in the
   first band that both members share, so once. What leaves a group are the number of links
   of each member and a spanning forest of the links: pairs are never emitted.
4. Connected components of the forests give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, stage
from .text import SHINGLE_WORDS, Spans, hashes, mix64, shingles, slices, utf8, words

THRESHOLD = 0.8
RECALL = 0.9995
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1 << 20
BROADCAST_IDS = 200_000
STRIP = 1 << 21
_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 128) -> tuple[int, int]:
    """Bands and rows a band: the most selective setting, of ``most`` hashes at most, that
    finds a pair at the threshold with probability ``recall`` or more."""
    for rows in range(most, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows))))
        if bands * rows <= most:
            return bands, rows
    raise ValueError(f"no banding of {most} hashes reaches recall {recall} at {threshold}")


def signatures(value: np.ndarray, owner: np.ndarray, n: int, hashes_wanted: int) -> np.ndarray:
    """MinHash values, one row for each of ``n`` sets; ``owner`` ascends."""
    out = np.zeros((n, hashes_wanted), dtype=np.uint32)
    if not len(value):
        return out
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    random = np.random.default_rng(1)
    factors = random.integers(1, 1 << 63, hashes_wanted, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    terms = random.integers(0, 1 << 63, hashes_wanted, dtype=np.uint64)
    for k in range(hashes_wanted):
        out[owner[first], k] = np.minimum.reduceat(((value * factors[k] + terms[k]) >> np.uint64(32)).astype(np.uint32), first)
    return out


def _class_keys(data: np.ndarray, w: Spans, h: np.ndarray) -> list[pa.Array]:
    """Two independent 64-bit hashes of each text's words in order, null without words; ``h``
    are the words' hashes."""
    place = (np.arange(len(w)) - w.first[w.owner]).astype(np.uint64)
    made = []
    for seed, own in ((_SEEDS[0], h), (_SEEDS[1], hashes(data, w, _SEEDS[1]))):
        total = np.zeros(len(w) + 1, dtype=np.uint64)
        np.cumsum(mix64(own ^ mix64(place * np.uint64(2) + np.uint64(seed))), out=total[1:])
        key = mix64(total[w.first[1:]] - total[w.first[:-1]] + w.count.astype(np.uint64))
        made.append(pa.array(key.view(np.int64), mask=w.count == 0))
    return made


def fingerprints(df: DataFrame, bands: int, rows: int, *, id_col: str, text_col: str) -> DataFrame:
    """(id, code, k1, k2, size, keys): a hash of the text, the hashes that name its class, the
    number of its shingles and its band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            w = words(data, offsets)
            h = hashes(data, w)
            value, owner = shingles(h, w)
            n = batch.num_rows
            keys = band_keys(value, owner, n, bands, rows).reshape(-1).view(np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys))
            size = pa.array(np.bincount(owner, minlength=n).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("code"), *_class_keys(data, w, h), size, keys],
                names=["id", "code", "k1", "k2", "size", "keys"],
            )

    texts = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("code"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "id long, code long, k1 long, k2 long, size long, keys array<long>")


def band_keys(value: np.ndarray, owner: np.ndarray, n: int, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each set and band."""
    signature = signatures(value, owner, n, bands * rows).astype(np.uint64).reshape(n, bands, rows)
    key = np.tile(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (n, 1))
    for k in range(rows):
        key = mix64(key ^ signature[:, :, k]) + np.uint64(k)
    return key


class _Block:
    """Members of a bucket: node, number of copies, band hashes and shingle set of each."""

    def __init__(self, parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts)
        self.node, self.copies = np.asarray(table["node"]), np.asarray(table["copies"])
        self.keys = np.array(table["keys"].to_pylist(), dtype=np.int64)
        self.sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        self.size = np.array([len(x) for x in self.sets])
        self._columns = None

    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct shingles, ascending, and (row, column) of each member's, by column."""
        if self._columns is None:
            value, row = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), self.size)
            order = np.argsort(value, kind="stable")
            value, row = value[order], row[order]
            new = np.append(True, value[1:] != value[:-1])
            self._columns = value[new], row, np.cumsum(new) - 1
        return self._columns


def _common(a: _Block, b: _Block) -> np.ndarray:
    """Number of shingles that each member of ``a`` and each of ``b`` have in common."""
    if len(a.sets) * len(b.sets) <= 4:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b.sets] for x in a.sets])
    value_a, row_a, column_a = a.columns()
    value_b, row_b, column_b = b.columns()
    if a is b:  # a shingle of one member links nothing
        both = np.flatnonzero(np.bincount(column_a) > 1)
        in_a = in_b = both
    else:
        _, in_a, in_b = np.intersect1d(value_a, value_b, assume_unique=True, return_indices=True)

    def kept(row: np.ndarray, column: np.ndarray, wanted: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        to = np.full(n, -1)
        to[wanted] = np.arange(len(wanted))
        own = to[column]
        return row[own >= 0], own[own >= 0]

    row_a, column_a = kept(row_a, column_a, in_a, len(value_a))
    row_b, column_b = kept(row_b, column_b, in_b, len(value_b))
    common = np.zeros((len(a.sets), len(b.sets)), dtype=np.int64)
    width = max(1, min(len(in_a), STRIP // (len(a.sets) + len(b.sets))))
    for at in range(0, len(in_a), width):
        strips = []
        for row, column, n in ((row_a, column_a, len(a.sets)), (row_b, column_b, len(b.sets))):
            low, high = np.searchsorted(column, [at, at + width])
            strips.append(np.zeros((n, width), dtype=np.float32))
            strips[-1][row[low:high], column[low:high] - at] = 1
        # a strip has fewer than 2^24 columns, so its float32 counts are whole
        common += (strips[0] @ strips[1].T).astype(np.int64)
    return common


def _near(a: _Block, b: _Block, band: int, threshold: float) -> np.ndarray:
    """Which members are linked, of the pairs whose first common band this is. The threshold is
    taken as a fraction (0.8 is 4/5), so whole numbers are compared."""
    common = _common(a, b)
    both = a.size[:, None] + b.size[None, :]
    least = Fraction(str(threshold)).limit_denominator(1_000_000)
    near = (common > 0) & (common * least.denominator >= least.numerator * (both - common))
    for k in range(band):
        near &= a.keys[:, k][:, None] != b.keys[:, k][None, :]
    if a is b:
        np.fill_diagonal(near, False)
    return near


class _Links:
    """Links of one held block, with its own members and with those that stream past."""

    def __init__(self, held: _Block, band: int, threshold: float):
        self.held, self.band, self.threshold = held, band, threshold
        near = _near(held, held, band, threshold)
        self.links = near @ held.copies
        self.root = np.arange(len(held.node))
        np.fill_diagonal(near, near.any(axis=0))
        self._join(near)

    def _join(self, near: np.ndarray) -> None:
        """Give one root to all held members that a column of ``near`` links."""
        roots = np.where(near, self.root[:, None], len(self.root))
        low, high = roots.min(axis=0), np.where(near, self.root[:, None], -1).max(axis=0)
        for k in np.flatnonzero(low < high):
            own = np.unique(self.root[near[:, k]])
            if len(own) > 1:
                self.root[np.isin(self.root, own)] = own[0]

    def past(self, other: _Block) -> pa.RecordBatch:
        """The links of the members of another block."""
        near = _near(self.held, other, self.band, self.threshold)
        self.links = self.links + near @ other.copies
        links = near.T @ self.held.copies
        self._join(near)
        some = links > 0
        return _found(other.node[some], links[some], self.held.node[near.argmax(axis=0)[some]])

    def own(self) -> pa.RecordBatch:
        some = self.links > 0
        return _found(self.held.node[some], self.links[some], self.held.node[self.root[some]])


def _found(node: np.ndarray, links: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links.astype(np.int64)), pa.array(root)], names=["node", "links", "root"])


def _verified(batches: Iterator[pa.RecordBatch], threshold: float, piece_rows: int, piece_shingles: int) -> Iterator[pa.RecordBatch]:
    """The links of rows that come by (key, block), each block's own members (role 0) before
    those that stream past it (role 1)."""
    last, links = None, None
    held: list[pa.RecordBatch] = []
    passing: list[pa.RecordBatch] = []
    weight = 0

    def settle() -> Iterator[pa.RecordBatch]:
        """Work off the members at hand."""
        nonlocal links, weight
        if links is None:
            if sum(x.num_rows for x in (*held, *passing)) < 2 or not held:
                return
            links = _Links(_Block(held), held[0].column("band")[0].as_py(), threshold)
        if passing:
            yield links.past(_Block(passing))
        passing.clear()
        weight = 0

    for now, part in _runs(batches, ["key", "block", "role"]):
        if now[:2] != last:
            yield from settle()
            if links is not None:
                yield links.own()
            last, links = now[:2], None
            held, passing, weight = [], [], 0
        if now[2] == 0:
            held.append(part)
            continue
        for at in range(0, part.num_rows, piece_rows):
            passing.append(part.slice(at, piece_rows))
            weight += int(np.asarray(passing[-1].column("size")).sum())
            if weight >= piece_shingles or sum(x.num_rows for x in passing) >= piece_rows:
                yield from settle()
    yield from settle()
    if links is not None:
        yield links.own()


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Parts of the batches whose rows have equal keys, in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in by], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield tuple(keys[a].tolist()), batch.slice(a, b - a)


def near_duplicates(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    block_rows: int = BLOCK_ROWS,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row for each row of ``df``: id, class_id, n_links.

    Two texts are linked where the Jaccard similarity of their sets of 5-word shingles is
    ``threshold`` or more; a text of fewer than five words has one shingle of all of them.
    n_links counts the other rows that are linked with the row, copies included; class_id
    is the smallest id that links lead to, over any number of steps, null where they lead to
    null ids only. Texts without words (null, empty, white space) have no links and their own
    id as class. Words are compared by 64-bit hashes of them as they are. Ids are integers;
    texts that share an id are compared each for itself. Columns of other names are not used.

    Two more columns tell which row stays where one of each group does: first (true for the
    smallest id, null last, and of several texts with it one; for texts without words; for all
    rows of equal id and text alike) and text_hash (xxhash64), which with the id names the row.

    The result is a staged table (``storage.drop`` deletes it); all others are deleted here.
    """
    bands, rows = banding(threshold, recall)
    ids = stage(fingerprints(df, bands, rows, id_col=id_col, text_col=text_col), "fingerprints")
    # One row for each class; its node is fixed by the file that it is written to.
    classes = ids.where("k1 is not null").groupBy("k1", "k2")
    classes = classes.agg(F.min("id").alias("rep"), F.first(F.struct("keys", "size")).alias("x"), F.count(F.lit(1)).alias("copies"))
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "rep", "x.keys", "x.size", "copies")
    classes = stage(classes, "classes")

    # Buckets with two members or more; of those with the same members, the first band's.
    buckets = classes.select("node", "size", F.posexplode("keys").alias("band", "key"))
    code = F.xxhash64("node")
    shared = (
        buckets.groupBy("key", "band")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("size").alias("total"),
            F.sum(code.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s"),
            F.sum(F.shiftrightunsigned(code, 32)).alias("t"),
            F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"),
        )
        .where("n > 1")
        .groupBy("n", "s", "t", "x")
        .agg(F.min(F.struct("band", "key", "total")).alias("b"))
        .select("b.key", "b.band", "n", "b.total")
    )
    blocks = F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("total") / block_shingles)).cast("int")
    members = stage(buckets.select("node", "key", "band").join(shared.select("key", "band", blocks.alias("blocks")), ["key", "band"]), "members")
    wanted = members.select("node").distinct().join(classes.select("node", "rep", "k1", "k2"), "node")
    wanted = stage(wanted, "wanted")

    # A class's set is that of any text with its smallest id and its words.
    reps = wanted.select("rep").distinct()
    if reps.count() <= BROADCAST_IDS:
        reps = F.broadcast(reps)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = texts.join(reps, texts["id"].eqNullSafe(reps["rep"]), "left_semi")
    sets = _shingle_sets(texts).groupBy("k1", "k2").agg(F.first("shingles").alias("shingles"))
    sets = sets.join(wanted.select("node", "k1", "k2"), ["k1", "k2"]).select("node", "shingles")
    sets = stage(sets.join(classes.select("node", "keys", "copies"), "node"), "sets")

    dealt = members.withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    # A block's members go past the half of the blocks that come before it, in a circle.
    past = F.filter(
        F.sequence(F.lit(1), F.floor(F.col("blocks") / 2).cast("int")),
        lambda k: (k * 2 < F.col("blocks")) | (F.col("own") * 2 < F.col("blocks")),
    )
    past = F.transform(past, lambda k: F.pmod(F.col("own") + k, F.col("blocks")))
    where = F.concat(F.array("own"), F.when(F.col("blocks") > 1, past).otherwise(F.array().cast("array<int>")))
    dealt = dealt.select("node", "key", "band", F.posexplode(where).alias("at", "block"))
    dealt = dealt.select("node", "key", "band", "block", F.least("at", F.lit(1)).alias("role")).join(sets, "node")
    dealt = dealt.withColumn("size", (F.octet_length("shingles") / 8).cast("long"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _verified(batches, threshold, max(block_rows // 2, 1), block_shingles)

    verified = dealt.repartition("key", "block").sortWithinPartitions("key", "block", "role", "node")
    verified = stage(verified.mapInArrow(verify, "node long, links long, root long"), "links")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    group = connected_components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b"))

    # The first row of each group: smallest id (null last), then class keys.
    own = F.struct(F.col("rep").isNull().alias("no_id"), "rep", "k1", "k2")
    named = classes.join(links, "node", "left").join(group.withColumnRenamed("id", "node"), "node", "left")
    named = named.select(
        "k1",
        "k2",
        own.alias("own"),
        F.coalesce("group", "node").alias("group"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.col("links").isNotNull().alias("linked"),
    )
    lead = named.where("linked").groupBy("group").agg(F.min("own").alias("lead"))
    named = named.join(lead, "group", "left").select("k1", "k2", F.coalesce("lead", "own").alias("lead"), "n_links")
    rows = ids.select("id", "code", "k1", "k2").join(
        named.withColumnsRenamed({"k1": "c1", "k2": "c2"}),
        (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")),
        "left",
    )
    none = F.col("k1").isNull()
    first = F.col("id").eqNullSafe(F.col("lead.rep")) & (F.col("k1") == F.col("lead.k1")) & (F.col("k2") == F.col("lead.k2"))
    result = rows.select(
        F.col("id").alias(id_col),
        F.when(none, F.col("id")).otherwise(F.col("lead.rep")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (none | first).alias("first"),
        F.col("code").alias("text_hash"),
    )
    result = stage(result, "near_duplicates")
    drop(ids, classes, members, wanted, sets, verified, group)
    return result


def _shingle_sets(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            w = words(data, offsets)
            h = hashes(data, w)
            value, owner = shingles(h, w)
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            sets = [np.unique(value[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*_class_keys(data, w, h), pa.array(sets, pa.binary())], names=["k1", "k2", "shingles"])

    return texts.mapInArrow(run, "k1 long, k2 long, shingles binary")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, group): the smallest id that each id of the edges (a, b) is connected with.

    Alternating large-star and small-star rounds over DataFrames: in each, a node's
    neighbours are linked to the smallest of them. Rounds needed grow with the logarithm of
    the number of nodes; each is staged, which cuts the lineage. Stars keep a row for each
    edge, never a node's neighbours in one row.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        small = stage(small.distinct(), "small")
        before, after = _content(now), _content(small)
        drop(now, large)
        now = small
        if before == after:
            out = now.select(F.col("u").alias("id"), F.col("v").alias("group"))
            out.staged_path = now.staged_path
            return out
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _content(edges: DataFrame) -> tuple:
    """Number of edges and two hashes of all of them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
