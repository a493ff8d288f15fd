"""Byte-level BPE by monoid tree reduction, and back.

A text is halved until its parts are short; the parts are encoded, and neighbours are joined up the
tree. A join looks at a window of characters around the seam and widens it on either side until it
meets a stable cut: a space or line feed after a character that isn't white space. There a piece of
the vocabulary's pattern ends whatever follows and the next one starts whatever came before, so the
tokens outside two such cuts can't change; only the text between them is encoded again. If there is
no such cut the window reaches the end of the part, and that is right too. The result is the same as
encoding the whole text at once. Decoding concatenates bytes up the same kind of tree.

The vocabulary (a file of ranks) is read once on the driver and broadcast: its size is fixed.

Defined cases: a null text has null tokens and decodes to null; an empty one has none. The names of
special tokens are ordinary text. Columns that already have the names of the new ones are replaced. Ties
and repeated rows don't matter: each row is encoded by itself. Very long texts are what the tree is for;
an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from ..shipping import map_arrow
from . import _scale

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF, WINDOW = 4096, 32
OUT_BYTES = 4 << 20


class Codec:
    """A vocabulary with its encoder and the length in bytes of each token."""

    _made: dict[bytes, Codec] = {}

    def __init__(self, ranks: bytes):
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.sizes = [0] * (max(table.values()) + 1)
        for word, k in table.items():
            self.sizes[k] = len(word)

    @classmethod
    def of(cls, ranks: bytes) -> Codec:
        """One for each process."""
        if ranks not in cls._made:
            cls._made[ranks] = cls(ranks)
        return cls._made[ranks]

    def encode(self, text: str, leaf: int = LEAF, window: int = WINDOW) -> list[int]:
        return self._part(text, 0, len(text), leaf, window)

    def _part(self, text, start, end, leaf, window):
        if end - start <= leaf:
            return self.encoder.encode_ordinary(text[start:end])
        middle = (start + end) // 2
        left, right = self._part(text, start, middle, leaf, window), self._part(text, middle, end, leaf, window)
        return self._join(text, start, middle, end, left, right, window)

    def _join(self, text, start, middle, end, left, right, window):
        a = b = None
        size = window
        while a is None:  # the nearest stable cut at or before the seam
            low = max(start, middle - size)
            a = next((c for c in range(middle, max(low, start + 1) - 1, -1) if _stable(text, c)), start if low == start else None)
            size *= 2
        size = window
        if a == middle:
            return left + right
        while b is None:
            high = min(end, middle + size)
            b = next((c for c in range(middle + 1, min(high, end - 1) + 1) if _stable(text, c)), end if high == end else None)
            size *= 2
        return self._before(left, len(text[a:middle].encode())) + self.encoder.encode_ordinary(text[a:b]) + self._after(right, len(text[middle:b].encode()))

    def _before(self, tokens, gone):
        n = len(tokens)
        while gone > 0:
            n -= 1
            gone -= self.sizes[tokens[n]]
        assert gone == 0, "a stable cut lies inside a token"
        return tokens[:n]

    def _after(self, tokens, gone):
        n = 0
        while gone > 0:
            gone -= self.sizes[tokens[n]]
            n += 1
        assert gone == 0, "a stable cut lies inside a token"
        return tokens[n:]

    def decode_bytes(self, tokens, leaf: int = LEAF) -> bytes:
        if len(tokens) <= leaf:
            return self.encoder.decode_bytes(tokens)
        middle = len(tokens) // 2
        return self.decode_bytes(tokens[:middle], leaf) + self.decode_bytes(tokens[middle:], leaf)

    def decode(self, tokens, leaf: int = LEAF) -> str:
        """Bytes that aren't UTF-8, which only tokens of one's own making give, become U+FFFD."""
        return self.decode_bytes(tokens, leaf).decode("utf-8", "replace")


def _stable(text: str, c: int) -> bool:
    """Whether pieces end before character c however the text goes on, on both sides."""
    return c < len(text) and text[c] in " \n" and not text[c - 1].isspace()


def _ranks(spark, path):
    if os.path.exists(path):
        with open(path, "rb") as f:
            data = f.read()
    else:
        data = bytes(spark.read.format("binaryFile").load(path).first().content)
    return spark.sparkContext.broadcast(data)


def _map(docs: DataFrame, column: str, out, function) -> DataFrame:
    """Append the fields ``out``: function(value) gives their values for a row."""
    new = {f.name.lower() for f in out}
    docs = docs.select(*[_scale.column(docs, c) for c in docs.columns if c.lower() not in new or c.lower() == column.lower()])
    kinds = [pa.list_(pa.int32()) if isinstance(f.dataType, ArrayType) else pa.int32() if isinstance(f.dataType, IntegerType) else pa.bool_() if isinstance(f.dataType, BooleanType) else pa.string() for f in out]
    at = [c.lower() for c in docs.columns].index(column.lower())

    def run(batches):
        for b in batches:
            first, held, rows = 0, 0, []
            for i, value in enumerate(b.column(at)):
                value = value.as_py()
                rows.append(function(value))
                held += len(value) if value is not None else 0
                if held >= OUT_BYTES or i == b.num_rows - 1:
                    piece = b.slice(first, len(rows))
                    more = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays([*piece.columns, *more], names=[*b.schema.names, *[f.name for f in out]])
                    first, held, rows = i + 1, 0, []

    return map_arrow(docs, run, StructType([*docs.schema.fields, *out]))


def encode(docs: DataFrame, column: str = "text", vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """``docs`` with tokens (array<int>), n_tokens and exact: whether decoding gives the text back."""
    ranks = _ranks(docs.sparkSession, vocabulary)

    def one(text):
        if text is None:
            return None, None, None
        codec = Codec.of(ranks.value)
        tokens = codec.encode(text, leaf)
        return np.array(tokens, np.int32), len(tokens), codec.decode(tokens, leaf) == text

    out = [StructField("tokens", ArrayType(IntegerType())), StructField("n_tokens", IntegerType()), StructField("exact", BooleanType())]
    return _map(docs, column, out, one)


def decode(rows: DataFrame, column: str = "tokens", vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """``rows`` with decoded: the text of their tokens."""
    ranks = _ranks(rows.sparkSession, vocabulary)

    def one(tokens):
        return (None if tokens is None else Codec.of(ranks.value).decode(tokens, leaf),)

    return _map(rows, column, [StructField("decoded", StringType())], one)
