"""Encoding of texts with a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's fixed pattern, and each piece is merged on
its own: again and again the leftmost pair of the lowest rank becomes one token. A
segment tree over the piece's byte positions holds that minimum, so one merge costs a
logarithmic number of steps and a piece of n bytes n log n, however long it is.

Pieces repeat, so each worker keeps the ids of pieces it has met. The memory is emptied
when it holds ``MEMORY`` pieces, which changes speed and nothing else. Nothing is
shuffled: texts are encoded where they are read.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from tagloom.lex import WHITE_SPACE

#: Name of the vocabulary's file of ranks (lines of base64 token and rank).
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
#: Pieces a worker remembers at most.
MEMORY = 300_000
#: Pieces longer than this aren't remembered.
LONG = 64
_NO_PAIR = sys.maxsize


def vocabulary_path(name: str = BYTE_BPE_50K) -> str:
    """Where the installed tokenizer package keeps the file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@cache
def piece_pattern() -> re.Pattern:
    """The pattern that cuts a text: contractions; letters, digits or other signs, each
    with at most one blank before; white space, its last character left to the next word.

    ``\\w`` without ``\\d`` and ``_`` is letters plus the numbers that aren't decimal
    digits; the latter (categories Nl and No) are listed, so the classes are exact.
    """
    odd = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No")]
    runs = [[c for _, c in g] for _, g in groupby(enumerate(odd), lambda x: x[1] - x[0])]
    numbers = "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs)
    space, other = f"[{WHITE_SPACE}]", f"(?:[^\\w{WHITE_SPACE}{numbers}]|_)"
    return re.compile(
        f"'(?:[sdmt]|ll|ve|re)| ?[^\\W\\d_{numbers}]+| ?[\\d{numbers}]+| ?{other}+|{space}+(?![^{WHITE_SPACE}])|{space}+"
    )


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    # tree[size + i] is the rank of the pair that begins at byte i; a node holds the
    # least of its two halves. Tokens are [i, right[i]).
    tree = [_NO_PAIR] * (2 * size)
    right = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    for i in range(n - 1):
        tree[size + i] = ranks.get(piece[i : i + 2], _NO_PAIR)
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i: int, rank: int) -> None:
        i += size
        tree[i] = rank
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a <= b else b
            if tree[i] == low:
                return
            tree[i] = low
            i >>= 1

    def pair(i: int) -> int:
        if i < 0 or right[i] >= n:
            return _NO_PAIR
        return ranks.get(piece[i : right[right[i]]], _NO_PAIR)

    while tree[1] != _NO_PAIR:
        low, i = tree[1], 1
        while i < size:
            i = 2 * i if tree[2 * i] == low else 2 * i + 1  # ties: the left half first
        i -= size
        gone = right[i]
        right[i] = right[gone]
        if right[i] < n:
            left[right[i]] = i
        put(gone, _NO_PAIR)
        put(i, pair(i))
        if left[i] >= 0:
            put(left[i], pair(left[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : right[i]]])
        i = right[i]
    return out


class _Pieces(dict):
    """Piece to ids, filled on demand."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(merge(piece.encode("utf-8"), self.ranks))
        if len(piece) <= LONG:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = ids
        return ids


@cache
def _pieces(path: str) -> _Pieces:
    return _Pieces(load_ranks(path))


def encode(text: str | None, path: str) -> array:
    """Ids of one text; none for an empty or null one."""
    return array("i", chain.from_iterable(map(_pieces(path).__getitem__, piece_pattern().findall(text or ""))))


def encode_column(documents: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """``key`` and ``ids ARRAY<INT>``: every row's text as token ids, special tokens'
    names being ordinary text. Null and empty texts give an empty list; repeated rows are
    encoded each; other columns aren't read. Spark brings the vocabulary's file to every
    executor; two files of one name can't serve one application."""
    path = vocabulary or vocabulary_path()
    documents.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)
    narrow = documents.select(documents[key].alias("k"), documents[text].alias("t"))
    kind = narrow.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = SparkFiles.get(name)
        for batch in batches:
            flat, ends = array("i"), [0]
            for t in batch.column(1).to_pylist():
                flat.extend(encode(t, here))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, "int32")), pa.array(np.frombuffer(flat, "int32") if flat else np.zeros(0, "int32")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [key, "ids"])

    return narrow.mapInArrow(run, f"`{key}` {kind}, ids array<int>")
