"""Collocations: the phrases of each language whose words keep together best.

A phrase's score is that of its worst cut into two parts, twice its count over theirs. A
prefix with count ``c`` whose first word has count ``f`` bounds the score of each phrase
that it begins: none has more than ``2 c / (f + c)``, as no longer phrase is more frequent and
no rest is rarer than the phrase. Growth is best first: a frontier of prefixes is expanded
down to a bound, all counts over the whole corpus, and the bound is lowered for the
languages in which fewer phrases than wanted survive above it. What was not expanded is then
below every phrase that was wanted.

Counting passes are Arrow functions with a sum of equal phrases in each task before the
shuffle. A word is known by a hash of its language and itself, a phrase by those of its
words; that no two words share a hash is checked, else another seed is taken. Which prefixes are to be
expanded goes to the tasks as a bitmap of fixed size; a prefix that it lets through by
chance is counted like any other, and whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import drop, stage
from .text import Spans, hashes, mix64, slices, utf8, words

LIMIT = 2000
MIN_COUNT = 30
COVER_PERCENT = 80
LONGEST = 4
SCALE = 1_000_000
UNKNOWN = "und"
FILTER_BITS = 1 << 24
FRONTIER = 2
SUMMED_ROWS = 1 << 20

_FOLD = np.uint64(0x9E3779B97F4A7C15)
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, *b".,;:!?"]] = True
_SPACED = np.where(_GAP, 0x20, np.arange(256)).astype(np.uint8)
_BREAK = _GAP.copy()
_BREAK[[0x20, 0x09]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Tokens:
    """Words of a batch of texts: their codes, and which word follows another in a piece."""

    def __init__(self, batch: pa.RecordBatch, seed: int):
        data, offsets = utf8(batch.column("text"))
        self.data = _LOWER[data]
        self.spans = words(_SPACED[self.data], offsets)
        langs, where = utf8(batch.column("lang"))
        own = hashes(langs, _each(where), seed)
        owner = self.spans.owner
        self.code = mix64(hashes(self.data, self.spans, seed) * _FOLD + own[owner]) if len(owner) else np.zeros(0, np.uint64)
        part = np.cumsum(_BREAK[self.data])[self.spans.start] if len(data) else np.zeros(0, np.int64)
        self.follows = (owner[1:] == owner[:-1]) & (part[1:] == part[:-1])

    def places(self, size: int) -> np.ndarray:
        """First words of the phrases of so many words."""
        whole = self.follows
        for _ in range(size - 2):
            whole = whole[1:] & self.follows[: len(whole) - 1] if len(whole) else whole
        return np.flatnonzero(whole)


def _each(offsets: np.ndarray) -> Spans:
    """One span for each text, empty ones too."""
    out = Spans.__new__(Spans)
    out.start, out.end = offsets[:-1], offsets[1:]
    return out


def fold(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash of each row of codes."""
    out = mix64(columns[0])
    for c in columns[1:]:
        out = mix64(out * _FOLD + c)
    return out


class Filter:
    """A bitmap of fixed size of phrases; it lets through all that were put in, and few others."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def lets(self, columns: list[np.ndarray]) -> np.ndarray:
        at = fold(columns) & self.mask
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _names(size: int) -> list[str]:
    return [f"w{k}" for k in range(1, size + 1)]


def make_filter(phrases: DataFrame, columns: list[str], bits: int = FILTER_BITS) -> Filter:
    """The filter of the phrases in ``columns``. Built in Spark; the driver gets its bits alone."""
    mask = np.uint64(bits - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = fold([_codes(batch.column(k)) for k in range(len(columns))]) & mask
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(at).astype(np.int64))], names=["at"])

    at = phrases.select(*columns).mapInArrow(place, "at long")
    width = 8 * 4096  # bits of one bitmap of bitmap_construct_agg
    parts = at.groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits"))
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for r in parts.collect():  # bits / 32,768 rows of 4 kB at most
        out[(r["part"] - 1) * (width // 8) :][:4096] = np.frombuffer(r["bits"], np.uint8)
    return Filter(out)


def _codes(column: pa.Array) -> np.ndarray:
    return np.asarray(column).astype(np.int64, copy=False).view(np.uint64)


def _summed(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns and the sums of ``n``."""
    key = fold(columns)
    order = np.argsort(key)
    key, columns, n = key[order], [c[order] for c in columns], n[order]
    new = np.append(True, key[1:] != key[:-1])
    for c in columns:  # two phrases of one hash stay apart: a row may come twice then, which does no harm
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.add.reduceat(n, first)


def count_phrases(docs: DataFrame, size: int, seed: int, wanted: list[list[tuple[int, int, Filter]]]) -> DataFrame:
    """Counts of phrases of ``size`` words that pass: w1, ..., n, over the whole of ``docs``.

    ``wanted`` lists conditions that must all hold; each is a list of (first word, words,
    filter) of which one must hold.
    """
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in slices(batches):
            tokens = Tokens(batch, seed)
            at = tokens.places(size)
            for condition in sent.value:
                passed = np.zeros(len(at), dtype=bool)
                for first, span, own in condition:
                    passed |= own.lets([tokens.code[at + first + k] for k in range(span)])
                at = at[passed]
            if len(at):
                held.append([*(tokens.code[at + k] for k in range(size)), np.ones(len(at), np.int64)])
                rows += len(at)
            if rows > SUMMED_ROWS:
                held = [_merged(held)]
                if len(held[0][0]) > SUMMED_ROWS // 2:
                    yield from _batches(held.pop())
                rows = sum(len(h[0]) for h in held)
        if held:
            yield from _batches(_merged(held))

    def _merged(held: list) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        keys, n = _summed(columns[:-1], columns[-1])
        return [*keys, n]

    def _batches(columns: list[np.ndarray], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(columns[0]), most):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + most].view(np.int64)) for c in columns], names=names)

    names = [*_names(size), "n"]
    counted = docs.mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return counted.groupBy(*_names(size)).agg(F.sum("n").alias("a"))


def count_words(docs: DataFrame, seed: int) -> DataFrame:
    """Counts of all words: w1, lang, word, a; ``distinct`` says whether the hash is of this word alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tokens = Tokens(batch, seed)
            code, first, n = np.unique(tokens.code, return_index=True, return_counts=True)
            word = [bytes(tokens.data[a:b]) for a, b in zip(tokens.spans.start[first], tokens.spans.end[first], strict=True)]
            langs = batch.column("lang").take(pa.array(tokens.spans.owner[first]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(code.view(np.int64)), langs, pa.array(word, pa.binary()).cast(pa.string()), pa.array(n)], names=["w1", "lang", "word", "n"]
            )

    rows = docs.mapInArrow(run, "w1 long, lang string, word string, n long")
    name = F.struct("lang", "word")
    out = rows.groupBy("w1").agg(F.sum("n").alias("a"), F.min(name).alias("low"), F.max(name).alias("high"))
    return out.select("w1", "low.lang", "low.word", "a", (F.col("low") == F.col("high")).alias("distinct"))


def _share(a: Column, parts: Column) -> Column:
    """floor(2 * SCALE * a / parts), exact: the product may pass 64 bits."""
    return F.call_function("div", F.lit(2 * SCALE).cast("decimal(7,0)") * a.cast("decimal(20,0)"), parts.cast("decimal(20,0)"))


def _scored(phrases: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """``phrases`` with score, l and r of the cut that scores least, the earliest of equal ones."""
    own = [
        F.struct(_share(F.col("a"), F.col(head) + F.col(rest)).alias("score"), F.lit(k).alias("k"), F.col(head).alias("l"), F.col(rest).alias("r"))
        for k, (head, rest) in enumerate(cuts)
    ]
    least = F.least(*own) if len(own) > 1 else own[0]
    return phrases.withColumn("least", least).select(*phrases.columns, "least.score", "least.l", "least.r")


def _bounded(phrases: DataFrame) -> DataFrame:
    """``phrases`` with the most that one of them, or a longer one that begins with it, can score."""
    return phrases.withColumn("bound", _share(F.col("a"), F.col("f1") + F.col("a")))


def _floors(pairs: DataFrame, wanted: int) -> DataFrame:
    """(lang, floor): the score that ``wanted`` pairs of the language reach, to the thousandth
    below; 0 where there are fewer. Made from counts of a thousand classes."""
    step = SCALE // 1000
    sizes = pairs.groupBy("lang", F.floor(F.col("score") / step).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, 0))
    reached = F.max(F.when(F.col("above") >= wanted, F.col("class")))
    return sizes.withColumn("above", above).groupBy("lang").agg((F.coalesce(reached, F.lit(0)) * step).alias("floor"))


def _part(phrases: DataFrame, first: int, size: int, **named: str) -> DataFrame:
    """Rows of ``phrases`` as parts of longer ones: words from w<first> on, other columns under new names."""
    return phrases.select(*(F.col(f"w{k}").alias(f"w{first + k - 1}") for k in range(1, size + 1)), *(F.col(c).alias(new) for c, new in named.items()))


def _covers(longer: DataFrame, size: int) -> DataFrame:
    """The most frequent phrase of one word more that contains each phrase of ``size`` words."""
    sides = [longer.select(*(F.col(f"w{k + shift}").alias(f"w{k}") for k in range(1, size + 1)), "a") for shift in (0, 1)]
    return sides[0].unionByName(sides[1]).groupBy(*_names(size)).agg(F.max("a").alias("cover"))


class Miner:
    """The corpus with its words and pairs; ``above`` mines all that scores a floor or more."""

    def __init__(self, docs: DataFrame, min_count: int, cover_percent: int, bits: int, seed: int):
        self.docs, self.min_count, self.cover_percent, self.bits = docs, min_count, cover_percent, bits
        self.staged: list[DataFrame] = []
        while True:
            self.words = self.keep(count_words(docs, seed), "words")
            if not self.words.where(~F.col("distinct")).limit(1).count():
                break
            seed += 1
        self.seed = seed
        often = self.words.where(F.col("a") >= min_count)
        known = make_filter(often, ["w1"], bits)
        pairs = self.count(2, [[(0, 1, known)], [(1, 1, known)]])
        pairs = pairs.join(_part(often, 1, 1, lang="lang", a="f1"), "w1").join(_part(often, 2, 1, a="f2"), "w2")
        self.pairs = self.keep(_bounded(_scored(pairs, [("f1", "f2")])), "pairs")
        self.known_pairs = make_filter(self.pairs, _names(2), bits)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.staged.append(stage(df, name))
        return self.staged[-1]

    def count(self, size: int, wanted: list) -> DataFrame:
        return count_phrases(self.docs, size, self.seed, wanted).where(F.col("a") >= self.min_count)

    def grow(self, size: int, prefixes: DataFrame) -> DataFrame:
        """Counts of phrases of ``size`` words made of frequent pairs whose first words are to be
        grown, or whose last words need to know what contains them."""
        own = _names(size - 1)
        growing = make_filter(prefixes.where("bound >= floor"), own, self.bits)
        asking = make_filter(prefixes.where("score >= floor"), own, self.bits)
        pairs = [[(k, 2, self.known_pairs)] for k in range(size - 1)]
        return self.count(size, [[(0, size - 1, growing), (1, size - 1, asking)], *pairs])

    def above(self, floors: DataFrame) -> DataFrame:
        """All phrases of the languages of ``floors`` that score their floor or more and survive."""
        pairs = self.pairs.join(floors, "lang")
        threes = self.grow(3, pairs)
        threes = threes.join(_part(self.pairs, 1, 2, lang="lang", f1="f1", a="f12"), _names(2))
        threes = threes.join(_part(self.pairs, 2, 2, a="f23", f2="f3"), ["w2", "w3"]).join(floors, "lang")
        threes = self.keep(_bounded(_scored(threes, [("f1", "f23"), ("f12", "f3")])), "threes")
        fours = self.keep(self.grow(4, threes), "fours")
        grown = fours.join(_part(threes, 1, 3, lang="lang", f1="f1", f12="f12", a="f123", floor="floor"), _names(3))
        grown = grown.join(_part(self.pairs, 3, 2, a="f34", f2="f4"), ["w3", "w4"])
        hopeful = [_share(F.col("a"), parts) >= F.col("floor") for parts in (F.col("f1") + F.col("a"), F.col("f12") + F.col("f34"), F.col("f123") + F.col("f4"))]
        grown = grown.where(reduce(Column.__and__, hopeful)).join(_part(threes, 2, 3, a="f234"), ["w2", "w3", "w4"], "left")
        grown = self.keep(grown, "grown")
        rest = grown.where("f234 is null").select(*(F.col(f"w{k + 1}").alias(f"w{k}") for k in (1, 2, 3))).distinct()
        if rest.limit(1).count():  # the last three words were not grown from their own first ones
            counted = self.count(3, [[(0, 3, make_filter(rest, _names(3), self.bits))]])
            more = self.keep(_part(counted, 2, 3, a="also"), "more")
            grown = grown.join(more, ["w2", "w3", "w4"], "left").withColumn("f234", F.coalesce("f234", "also"))
        fours_scored = _scored(grown, [("f1", "f234"), ("f12", "f34"), ("f123", "f4")])
        found = []
        for size, own, longer in ((2, pairs, threes), (3, threes, fours), (4, fours_scored, None)):
            own = own.where("score >= floor")
            if longer is not None:
                own = own.join(_covers(longer, size), _names(size), "left").where(F.expr(f"cover is null or 100 * cover < {self.cover_percent} * a"))
            words = [F.col(c) if k < size else F.lit(None).cast("long").alias(c) for k, c in enumerate(_names(LONGEST))]
            found.append(own.select("lang", *words, "a", "l", "r", "score"))
        return reduce(DataFrame.unionByName, found)


def mine(
    df: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    limit: int = LIMIT,
    min_count: int = MIN_COUNT,
    cover_percent: int = COVER_PERCENT,
    frontier: int = FRONTIER,
    bits: int = FILTER_BITS,
    seed: int = 0,
) -> DataFrame:
    """The first ``limit`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A to Z only) and split at ``.,;:!?`` and line ends into pieces and
    these at blanks into words. Candidates are phrases of 2 to 4 words of one piece with a
    count ``a`` of ``min_count`` or more. The score is floor(2,000,000 a / (l + r)) for counts
    ``l`` and ``r`` of the two parts, at the cut where it is least (the earliest of equal
    ones). A candidate inside a longer one that has ``cover_percent`` of its count or more goes;
    as counts fall with length, only those of one word more need be asked. ``n`` counts the
    language's words. Order is by score and ``a``, highest first, then by the phrase's bytes.

    A null text is empty, a null language is ``und``; repeated rows count each; an empty table
    gives no rows. The first frontier is what scores at least as the pair of rank ``frontier * limit``
    of its language; it is eight times as many pairs in each further round, for the languages that need one.
    A round reads the corpus two or three times. ``bits`` (a power of two, 2 MB by default) bounds what is
    broadcast; larger corpora may take more to let less through by chance. Runs when called.
    """
    docs = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    miner = Miner(docs, min_count, cover_percent, bits, seed)
    found, wanted, floors = [], frontier * limit, miner.keep(_floors(miner.pairs, frontier * limit), "floors")
    while True:
        round_ = miner.keep(miner.above(floors), "found")
        sizes = round_.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
        short = miner.keep(floors.join(sizes, "lang", "left").where(f"floor > 0 and coalesce(n, 0) < {limit}").select("lang"), "short")
        found.append(round_.join(short, "lang", "left_anti"))
        if not short.limit(1).count():
            break
        wanted *= 8
        floors = miner.keep(_floors(miner.pairs.join(short, "lang", "left_semi"), wanted), "floors")
    rows = _named(reduce(DataFrame.unionByName, found), miner.words)
    totals = miner.words.groupBy("lang").agg(F.sum("a").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)
    out = stage(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    drop(*miner.staged)
    return out


def _named(phrases: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``phrases`` with their words, one space apart, in place of the codes."""
    key = phrases.columns
    each = phrases.select(*key, F.posexplode(F.array(*_names(LONGEST))).alias("at", "w")).where("w is not null")
    told = each.join(vocabulary.select(F.col("w1").alias("w"), "word"), "w")
    words = F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])
    return told.groupBy(*key).agg(F.array_join(words, " ").alias("phrase")).drop(*_names(LONGEST))
