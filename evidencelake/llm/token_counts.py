"""Token counts of whole texts by the tokenizers or sentencepiece library.

Texts are cut where no token can reach across, pieces that a task has met lately are not
encoded again, and the others go to the library in calls of about equal bytes; only lengths come back. Where
cuts are safe is a matter of the vocabulary's kind, and a vocabulary whose own answers to a
few probes differ from its answers to their pieces gets its texts whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .text import slices, utf8

SLICE_BYTES = 4 << 20
CALL_BYTES = 1 << 16
KNOWN_BYTES = 16 << 20

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_GRAPH = np.zeros(256, dtype=bool)
_GRAPH[0x21:0x7F] = True
#: First bytes of the two- and three-byte characters among which there is white space.
_BLANK_LEADS = np.zeros(256, dtype=bool)
_BLANK_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_PROBES = ("a b", "Ab1 2c", "the end. (it", "x! 'll y", "7 88 nine", "it's <|x|> so", "<s> A")


class Counter:
    """Numbers of tokens of strings, for one vocabulary file.

    ``name`` tells the library: ``.json`` is for tokenizers, ``.model`` for sentencepiece. No
    begin, end or other special tokens are added and nothing is truncated or padded; strings
    of special tokens inside texts are taken as the library does by default.
    """

    def __init__(self, content: bytes, name: str):
        self.drops_blank = name.endswith(".model")
        if self.drops_blank:
            import sentencepiece

            core = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.ids = lambda texts: core.encode(texts, num_threads=1)
            inner = any("▁" in core.id_to_piece(k).lstrip("▁") for k in range(core.get_piece_size()))
            byte_level = False
        elif name.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
            import json

            from tokenizers import Tokenizer

            core = Tokenizer.from_buffer(content)
            core.no_truncation()
            core.no_padding()
            self.ids = lambda texts: core.encode_batch(texts, add_special_tokens=False)
            told = json.loads(content)
            kind, added = told.get("pre_tokenizer") or {}, told.get("added_tokens") or []
            byte_level = not told.get("normalizer") and kind.get("type") == "ByteLevel" and kind.get("use_regex", True)
            inner = any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in added)
        else:
            raise ValueError(f"{name}: neither .json nor .model")
        self.wide = byte_level
        self.known, self.sizes = pa.array([], pa.large_string()), np.zeros(0, np.int64)
        self.cuts = not inner and all(self._same(p) for p in _PROBES)

    def _same(self, probe: str) -> bool:
        parts = self.pieces(*utf8(pa.array([probe])))[0].to_pylist()
        plain = [list(x if self.drops_blank else x.ids) for x in self.ids([probe, *parts])]
        return plain[0] == [i for part in plain[1:] for i in part]

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Pieces of all texts in a row, and which text each is of.

        Byte-level vocabularies: before ASCII white space that follows anything else but
        white space. Others: before white space that follows visible ASCII. Sentencepiece: at
        a single space between visible ASCII, which goes, as each string gets its own.
        """
        before = np.zeros(len(data), dtype=bool)
        if len(data) > 1:
            solid = _GRAPH[data]
            if self.wide:
                lead = _BLANK_LEADS[data]
                solid |= (data >= 0x80) & ~np.append(False, lead[:-1]) & ~np.append([False, False], lead[:-2])[: len(data)]
            before[1:] = _BLANK[data[1:]] & solid[:-1]
            if self.drops_blank:
                before[-1] = False
                before[1:-1] &= (data[1:-1] == 0x20) & _GRAPH[data[2:]]
        edge = offsets[:-1][np.diff(offsets) > 0]
        before[edge] = False
        if self.drops_blank:
            before[offsets[(offsets > 0) & (offsets < len(data))] - 1] = False  # a space at a text's end
        blank = np.flatnonzero(before)
        starts = np.union1d(edge, blank)
        if self.drops_blank:
            starts = np.union1d(starts, blank + 1)
        cut = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        if self.drops_blank and len(blank):
            kept = np.ones(len(starts), dtype=bool)
            kept[np.searchsorted(starts, blank)] = False
            cut, starts = cut.filter(pa.array(kept)), starts[kept]
        return cut, np.searchsorted(offsets, starts, side="right") - 1

    def lengths(self, distinct: list[str]) -> np.ndarray:
        """Tokens of each string, in calls of about ``CALL_BYTES``."""
        size = np.fromiter(map(len, distinct), np.int64, len(distinct)) + 8
        calls = np.flatnonzero(np.diff(np.cumsum(size) // CALL_BYTES)) + 1
        out = np.zeros(len(distinct), np.int64)
        for a, b in zip([0, *calls], [*calls, len(distinct)], strict=True):
            out[a:b] = [len(x) for x in self.ids(distinct[a:b])] if b > a else 0
        return out

    def distinct_lengths(self, pieces: pa.Array) -> np.ndarray:
        """Tokens of each piece; those of the last batches are remembered, up to ``KNOWN_BYTES``."""
        at = pc.index_in(pieces, value_set=self.known)
        new = np.asarray(pc.is_null(at))
        out = np.empty(len(pieces), np.int64)
        out[~new] = self.sizes[np.asarray(at.drop_null())]
        fresh = pieces.filter(pa.array(new))
        out[new] = self.lengths(fresh.to_pylist())
        self.known, self.sizes = pa.concat_arrays([self.known, fresh]), np.append(self.sizes, out[new])
        if self.known.nbytes > KNOWN_BYTES:
            self.known, self.sizes = (pieces, out) if pieces.nbytes <= KNOWN_BYTES else (self.known[:0], self.sizes[:0])
        return out

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; a null one counts as empty."""
        data, offsets = utf8(texts)
        if not self.cuts:
            return self.lengths([t or "" for t in texts.to_pylist()])
        cut, owner = self.pieces(data, offsets)
        coded = cut.dictionary_encode()
        total = np.append(0, np.cumsum(self.distinct_lengths(coded.dictionary)[np.asarray(coded.indices)]))
        ends = np.searchsorted(owner, np.arange(len(offsets)))
        return total[ends[1:]] - total[ends[:-1]]


def count_tokens(df: DataFrame, vocabulary: str, *, text_col: str = "text", bytes_col: str = "n_bytes", tokens_col: str = "n_tokens") -> DataFrame:
    """``df`` with the bytes (UTF-8) and the tokens of each whole text, in place of any
    columns of the new names.

    Every row and every other column is kept; a null or empty text has 0 of both. The
    vocabulary file is read on the driver and broadcast; its size is fixed. No shuffle.
    """
    with open(vocabulary, "rb") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())
    new = [bytes_col, tokens_col]
    kept = [c for c in df.columns if c not in new]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, T.LongType(), False) for c in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(content.value, vocabulary)
        for batch in slices(batches, text_col, SLICE_BYTES):
            texts = batch.column(text_col)
            made = [np.diff(utf8(texts)[1]), counter.count(texts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, made)], names=[*kept, *new])

    return df.select(*(f"`{c}`" for c in dict.fromkeys([*kept, text_col]))).mapInArrow(run, schema)
