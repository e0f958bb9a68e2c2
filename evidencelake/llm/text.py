"""Vectorised words, lines and hashes of a batch of texts, over its UTF-8 bytes.

A *word* is a maximal run of characters other than the six ASCII white-space characters
``\\x20 \\x09-\\x0D``; a *line* is what ``\\n`` separates. Equal strings have equal hashes in
every batch, task and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
SHINGLE_WORDS = 5

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Masks of the first 0 to 8 bytes of a little-endian block.
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(33)
    return x


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the offsets of each (nulls count as empty)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in pieces of about ``most`` bytes of text; one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = batch.column(column)
        lengths = np.asarray(pc.fill_null(pc.binary_length(lengths), 0)).astype(np.int64)
        piece = np.maximum(np.cumsum(lengths) - lengths, 0) // most
        cuts = np.flatnonzero(np.diff(piece)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


class Spans:
    """Spans of bytes of the texts: where they start and end and which text they are of."""

    def __init__(self, start: np.ndarray, end: np.ndarray, offsets: np.ndarray):
        self.start, self.end = start, end
        self.owner = np.searchsorted(offsets, start, side="right") - 1
        n = len(offsets) - 1
        self.count = np.bincount(self.owner, minlength=n).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)))

    def __len__(self) -> int:
        return len(self.start)


def words(data: np.ndarray, offsets: np.ndarray) -> Spans:
    inside = np.concatenate((~_SPACE[data], [False]))
    before = np.concatenate(([False], inside[:-1]))
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    starts = inside & ~before
    starts[edge] |= inside[edge]
    ends = ~inside & before
    ends[edge] |= before[edge]
    return Spans(np.flatnonzero(starts), np.flatnonzero(ends), offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> Spans:
    """Every ``\\n``-separated line, empty ones too; a text without a byte has one empty line."""
    breaks = np.flatnonzero(data == 0x0A)
    start = np.concatenate((offsets[:-1], breaks + 1))
    end = np.concatenate((breaks, offsets[1:]))
    owner = np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1))
    order = np.lexsort((start, owner))
    out = Spans.__new__(Spans)
    out.start, out.owner = start[order], owner[order]
    out.end = end[np.lexsort((end, np.concatenate((owner[len(offsets) - 1 :], np.arange(len(offsets) - 1)))))]
    out.count = np.bincount(out.owner, minlength=len(offsets) - 1).astype(np.int64)
    out.first = np.concatenate(([0], np.cumsum(out.count)))
    return out


def hashes(data: np.ndarray, spans: Spans, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes; other seeds give independent ones.

    Each block of eight bytes is mixed with its place in the span before the blocks are
    summed, so that no arrangement of the same bytes or blocks cancels out.
    """
    size = spans.end - spans.start
    out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    padded = np.append(data, np.zeros(8, np.uint8))
    at_byte = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each one on
    keys = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed))
    first = at_byte[spans.start] & _FIRST_BYTES[np.minimum(size, 8)]
    out += mix64(first ^ keys[0])
    long = np.flatnonzero(size > 8)
    for chunk in np.array_split(long, max(1, int(size[long].sum()) // (SLICE_BYTES * 4))) if len(long) else ():
        blocks = (size[chunk] - 1) // 8  # after the first one
        if len(chunk) == 1:
            out[chunk] += _blocks(at_byte, int(spans.start[chunk[0]]), int(size[chunk[0]]), seed)
            continue
        ends = np.cumsum(blocks)
        place = np.arange(ends[-1]) - np.repeat(ends - blocks, blocks) + 1
        left = np.repeat(size[chunk], blocks) - 8 * place
        block = at_byte[np.repeat(spans.start[chunk], blocks) + 8 * place] & _FIRST_BYTES[np.minimum(left, 8)]
        out[chunk] += np.add.reduceat(mix64(block ^ _place_keys(place, keys, seed)), ends - blocks)
    return mix64(out)


def _place_keys(place: np.ndarray, keys: np.ndarray, seed: int) -> np.ndarray:
    if not len(place) or place.max() < len(keys):
        return keys[place]
    return mix64((place + 1).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed))


def _blocks(at_byte: np.ndarray, start: int, size: int, seed: int, step: int = 1 << 17) -> np.uint64:
    """Sum over the blocks, after the first, of one long span, so many at a time."""
    total = np.zeros(1, np.uint64)
    count = (size - 1) // 8
    for at in range(1, count + 1, step):
        place = np.arange(at, min(at + step, count + 1))
        block = at_byte[start + 8 * place] & _FIRST_BYTES[np.minimum(size - 8 * place, 8)]
        total += mix64(block ^ mix64((place + 1).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed))).sum()
    return total[0]


def shingles(word_hashes: np.ndarray, spans: Spans, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash and owner of each run of ``width`` words inside a text. A text with fewer words,
    but with one, has a single shingle of all its words."""
    n = len(word_hashes)
    start = np.zeros(n, dtype=bool)
    start[: max(n - width + 1, 0)] = spans.owner[: max(n - width + 1, 0)] == spans.owner[width - 1 :]
    value = _fold([word_hashes[k : max(n - width + 1, 0) + k] for k in range(width)])[start[: max(n - width + 1, 0)]]
    owner = spans.owner[start]
    short = np.flatnonzero((spans.count > 0) & (spans.count < width))
    for size in range(1, width):
        own = short[spans.count[short] == size]
        if len(own):
            value = np.concatenate((value, _fold([word_hashes[spans.first[own] + k] for k in range(size)])))
            owner = np.concatenate((owner, own))
    if len(short):
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    return value, owner


def _fold(parts: list[np.ndarray]) -> np.ndarray:
    value = np.zeros(len(parts[0]), dtype=np.uint64)
    for k, part in enumerate(parts):
        value ^= part
        value *= np.uint64(0xD1B54A32D192ED03)
        value += np.uint64(k + 1)
        value ^= value >> np.uint64(29)
    return mix64(value)
