"""Byte-level BPE encoding and decoding with a local rank file.

Texts are encoded by the tiktoken library under the pattern that belongs to the ranks,
without special tokens. A long text is first cut where no match of the pattern can reach
across: between a letter or digit and a following space or line feed. The ids of the
pieces, one after another, are then those of the whole text. A run of very many white
space characters, over which the pattern's look-ahead would backtrack, is cut into the
matches that the pattern gives and merged piece by piece.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .text import slices

PIECE_CHARS = 1 << 16
_SAFE = re.compile(r"[^\W_](?=[ \n])")
_LONG_SPACE = re.compile(r"(?<!\s)[ \t\n\r\x0b\x0c]{50000,}+(?!\s)")


def read_ranks(rank_bytes: bytes) -> dict[bytes, int]:
    """Token bytes and their ranks from the text of a ``.tiktoken`` file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_bytes.splitlines()) if token}


class Codec:
    """Encoder and decoder of one rank file and pattern."""

    def __init__(self, rank_bytes: bytes, pattern: str):
        import tiktoken

        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(rank_bytes), special_tokens={})

    def pieces(self, text: str) -> Iterator[str]:
        """Cuts at safe places, so that each piece has about ``PIECE_CHARS`` characters."""
        at = 0
        while len(text) - at > PIECE_CHARS:
            cut = _SAFE.search(text, at + PIECE_CHARS)
            if not cut:
                break
            yield text[at : cut.end()]
            at = cut.end()
        yield text[at:]

    def _spaced(self, piece: str) -> Iterator[np.ndarray]:
        """Ids of a piece around its very long runs of white space."""
        at = 0
        for run in _LONG_SPACE.finditer(piece):
            a, b = run.span()
            yield self.core.encode_to_numpy(piece[at:a], disallowed_special=())
            last = b < len(piece)  # the run's last character then belongs to the next match
            yield np.asarray(self.core._encode_single_piece(piece[a : b - last]), dtype=np.uint32)
            at = b - last
        yield self.core.encode_to_numpy(piece[at:], disallowed_special=())

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= PIECE_CHARS:
            return self.core.encode_to_numpy(text, disallowed_special=())
        return np.concatenate([ids for piece in self.pieces(text) for ids in self._spaced(piece)])

    def decode(self, ids: np.ndarray) -> bytes:
        """The raw bytes of the ids; they need not be valid UTF-8 for every list of ids."""
        return self.core.decode_bytes(ids.tolist())


def encode(
    df: DataFrame,
    rank_file: str,
    pattern: str,
    *,
    text_col: str = "text",
    ids_col: str = "token_ids",
    decoded_col: str | None = None,
) -> DataFrame:
    """``df`` with the token ids of each text and, if named, the bytes that they decode to.

    Every row and column of ``df`` is kept; a column that has one of the new names is
    replaced. A null text counts as empty: no ids, no bytes. The rank file is read on the
    driver and broadcast; its size is fixed by the vocabulary. No shuffle.
    """
    with open(rank_file, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    new = [ids_col, *([decoded_col] if decoded_col else [])]
    kept = [c for c in df.columns if c not in new]
    schema = T.StructType(
        [df.schema[c] for c in kept] + [
            T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)
        ] + ([T.StructField(decoded_col, T.BinaryType(), False)] if decoded_col else [])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value, pattern)
        for batch in slices(batches, text_col):
            ids = [codec.encode(t or "") for t in batch.column(text_col).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            made = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))]
            if decoded_col:
                made.append(pa.array([codec.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, *new])

    return df.select(*(f"`{c}`" for c in dict.fromkeys([*kept, text_col]))).mapInArrow(run, schema)
