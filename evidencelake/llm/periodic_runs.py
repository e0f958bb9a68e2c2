"""Periodic runs of words, found by string synchronising sets, and texts without the repeats.

A *run* is a stretch of words with a smallest period ``q`` (words ``q`` apart are identical)
that is three periods long at least and that no neighbouring word extends. Periods of fewer
than ``2 * BASE`` words are found by comparing the text with itself so many words on. Longer
ones are found at dyadic scales: at scale ``t``, for periods of ``2 t`` to ``4 t - 1`` words,
a place is selected where the least hash of the stretches of ``t`` words that begin at it or
at one of the ``t`` places after it is at one of the two ends. What is selected depends on
the next ``2 t`` words alone, so a run has the same places selected in each of its periods, one at
least, unless its stretches have a period of a third of ``t`` or less. Those stretches lie in runs
that smaller scales have found; they are left out of the minima. Two selected places with the
same ``2 t`` next words propose their distance as a period, and comparing words exactly around
them decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .text import hashes, mix64, slices, utf8, words

BASE = 8
MIN_WORDS = 24
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0xD1B54A32D192ED03)
_PRIME, _POINT = np.uint64(2_147_483_647), 1_234_567_891


def _joined(names: np.ndarray, width: int) -> np.ndarray:
    """Names of stretches of twice ``width`` from those of ``width`` (random at the end)."""
    after = np.append(names[width:], np.arange(min(width, len(names)), dtype=np.uint64))
    return mix64(names * _STEP + after)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each value and the ``width`` values after it; ``width`` is a power of two."""
    out, reach = values.copy(), 1
    while reach < width:
        out[:-reach] = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    out[:-1] = np.minimum(out[:-1], out[1:])  # width + 1 values
    if width > 1:
        return np.minimum(out[: len(out)], np.append(values[width:], np.full(min(width, len(values)), _NONE)))
    return out


class _Prefixes:
    """Polynomial hashes of prefixes, to bound how far two stretches agree."""

    def __init__(self, codes: np.ndarray):
        power = np.ones(1, np.uint64)
        while len(power) < len(codes):
            power = np.concatenate((power, power * np.uint64(pow(_POINT, len(power), int(_PRIME))) % _PRIME))
        self.power = power[: len(codes)]
        self.total = np.append(np.zeros(1, np.uint64), np.cumsum(codes % _PRIME * self.power % _PRIME, dtype=np.uint64))

    def equal(self, at: np.ndarray, apart: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` codes from ``at`` on equal those ``apart`` codes later. Equal ones always do."""
        t = self.total
        own, other = (t[at + size] - t[at]) % _PRIME, (t[at + apart + size] - t[at + apart]) % _PRIME
        return own * self.power[apart] % _PRIME == other

    def reach(self, at: np.ndarray, apart: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many codes agree from ``at`` on (or before it), ``most`` at most; never too few."""
        low, high = np.zeros(len(at), np.int64), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(at - middle if back else at, apart, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def _extent(codes: np.ndarray, at: int, apart: int) -> tuple[int, int]:
    """The maximal stretch around ``at`` whose codes equal those ``apart`` later (exact)."""
    end, step = at, 64
    while end + apart < len(codes):
        own = codes[end : min(end + step, len(codes) - apart)] == codes[end + apart : end + apart + step]
        if not own.all():
            end += int(own.argmin())
            break
        end, step = end + len(own), min(step * 2, 1 << 16)
    start, step = at, 64
    while start > 0:
        low = max(start - step, 0)
        own = (codes[low:start] == codes[low + apart : start + apart])[::-1]
        if not own.all():
            start -= int(own.argmin())
            break
        start, step = low, min(step * 2, 1 << 16)
    return start, end


def _streaks(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of runs of consecutive numbers, and the places after their last ones."""
    cut = np.flatnonzero(np.diff(places) != 1) + 1
    if not len(places):
        return places, places
    return places[np.append(0, cut)], places[np.append(cut, len(places)) - 1] + 1


def _covered(stretches: np.ndarray, size: int, less: int = 0) -> np.ndarray:
    """Which of ``size`` places are in one of the stretches (start, end), each ``less`` shorter."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, stretches[:, 0], 1)
    np.add.at(edge, stretches[:, 1] - less, -1)
    return np.cumsum(edge[:-1]) > 0


def find_runs(codes: np.ndarray, first: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """Runs (start, end, period) of several texts, by start and then period.

    ``codes`` has the words' codes of all texts in a row with one code that occurs nowhere
    else after each text; ``first`` has the place where each text starts, and the length of ``codes``.
    """
    found = [np.zeros((0, 3), np.int64)]
    for period in range(1, min(2 * BASE, len(codes))):
        start, end = _streaks(np.flatnonzero(codes[:-period] == codes[period:]))
        good = end - start >= 2 * period
        found.append(np.stack([start[good], end[good] + period, np.full(int(good.sum()), period)], axis=1))
    size = np.diff(first)
    longest = int(size.max(initial=0))
    place = np.arange(len(codes))
    owner = np.repeat(np.arange(len(size)), size)
    names, scale, prefixes = codes, 1, None
    while scale < BASE:
        names, scale = _joined(names, scale), scale * 2
    while 6 * scale < longest:  # the code after a text counts in its size
        own = size[owner] > 6 * scale
        if 2 * own.sum() < len(own):
            names, place, owner = names[own], place[own], owner[own]
        known = np.concatenate(found)
        low = known[(known[:, 2] * 3 <= scale) & (known[:, 1] - known[:, 0] >= scale)]
        hashed = names.copy()
        if len(low):
            hashed[_covered(low, len(codes), scale - 1)[place]] = _NONE
        names = _joined(names, scale)
        least = _least(hashed, scale)
        ahead = np.append(hashed[scale:], np.full(min(scale, len(hashed)), _NONE))
        at = np.flatnonzero(((least == hashed) | (least == ahead)) & (least != _NONE))
        key = mix64(names[at] + owner[at].astype(np.uint64) * _STEP)
        order = np.argsort(key, kind="stable")
        key, at = key[order], place[at[order]]
        pairs = []
        for ahead in range(1, len(at)):
            near = np.flatnonzero((key[ahead:] == key[:-ahead]) & (at[ahead:] - at[:-ahead] < 4 * scale))
            if not len(near):
                break
            apart = at[near + ahead] - at[near]
            pairs.append(np.stack([at[near], apart], axis=1)[apart >= 2 * scale])
        pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
        if len(pairs):
            prefixes = prefixes or _Prefixes(codes)
            found.append(_verified(codes, prefixes, pairs))
        scale *= 2
    runs = np.concatenate(found)
    runs = runs[runs[:, 1] - runs[:, 0] >= min_words]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    again = np.append(False, (np.diff(runs[:, 0]) == 0) & (np.diff(runs[:, 1]) == 0)) if len(runs) else np.zeros(0, bool)
    runs = runs[~again]  # a multiple of the smallest period
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _verified(codes: np.ndarray, prefixes: _Prefixes, pairs: np.ndarray) -> np.ndarray:
    """Stretches of three periods or more around proposed (place, period) pairs."""
    at, period = pairs[:, 0], pairs[:, 1]
    after = prefixes.reach(at, period, np.minimum(2 * period, len(codes) - period - at), back=False)
    short = after < 2 * period
    before = np.zeros(len(at), np.int64)
    before[short] = prefixes.reach(at[short], period[short], np.minimum(2 * period[short], at[short]), back=True)
    pairs = pairs[after + before >= 2 * period]
    out, last, end = [], -1, -1
    for place, own in pairs[np.lexsort((pairs[:, 0], pairs[:, 1]))].tolist():
        if own == last and place < end:
            continue
        last, (start, end) = own, _extent(codes, place, own)
        if end - start >= 2 * own:
            out.append((start, end + own, own))
    return np.array(out, np.int64).reshape(-1, 3)


def runs_of(texts: pa.Array, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (text, start, length, period), words of each text, and which words of all texts stay."""
    data, offsets = utf8(texts)
    spans = words(data, offsets)
    n = len(offsets) - 1
    first = spans.first + np.arange(n + 1)
    codes = np.empty(first[-1], np.uint64)
    inner = np.ones(len(codes), dtype=bool)
    inner[first[1:] - 1] = False
    codes[inner] = hashes(data, spans)
    codes[~inner] = mix64(np.arange(n, dtype=np.uint64) + (_STEP << np.uint64(1)))
    runs = find_runs(codes, first, min_words)
    gone = _covered(np.stack([runs[:, 0] + runs[:, 2], runs[:, 1]], axis=1), len(codes))
    text = np.searchsorted(first, runs[:, 0], side="right") - 1
    placed = np.stack([text, runs[:, 0] - first[text], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1)
    return placed, spans.count, spans.first, ~gone[inner]


def find(
    df: DataFrame,
    *,
    text_col: str = "text",
    words_col: str = "n_words",
    runs_col: str = "runs",
    collapsed_col: str = "collapsed",
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """``df`` with each whole text's words (maximal stretches of anything but ASCII white
    space), its runs and the text without their repeats, in place of any columns of these names.

    ``runs`` is an array of (start, length, period) in words from 0, by start and then
    period, of all runs of ``min_words`` words and three periods at least. ``collapsed``
    are the words, one space apart, of which no run has one after its first period. Every row is kept; a
    null or empty text has 0 words, no runs and an empty string. No shuffle; a task holds
    one batch of texts, and one text at least, with about 25 numbers for each of its words.
    """
    new = [words_col, runs_col, collapsed_col]
    kept = [c for c in df.columns if c not in new]
    run_type = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
    schema = T.StructType(
        [df.schema[c] for c in kept]
        + [
            T.StructField(words_col, T.LongType(), False),
            T.StructField(runs_col, T.ArrayType(run_type, False), False),
            T.StructField(collapsed_col, T.StringType(), False),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = batch.column(text_col)
            runs, count, first, stays = runs_of(texts, min_words)
            ends = np.append(0, np.cumsum(np.bincount(runs[:, 0], minlength=len(texts)))).astype(np.int32)
            fields = [pa.array(runs[:, k]) for k in (1, 2, 3)]
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            collapsed, repeats = [], set(runs[:, 0].tolist())
            for k, text in enumerate(texts.to_pylist()):
                own = (text or "").encode().split()
                collapsed.append(b" ".join(compress(own, stays[first[k] : first[k + 1]].tolist()) if k in repeats else own))
            made = [pa.array(count), listed, pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, *new])

    return df.select(*(f"`{c}`" for c in dict.fromkeys([*kept, text_col]))).mapInArrow(run, schema)
