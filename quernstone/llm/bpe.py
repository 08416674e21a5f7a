"""Problem 7: ids of every text by a public byte-level BPE vocabulary.

A text is cut by the vocabulary's pattern; each piece is encoded on a segment tree over
its byte positions whose nodes hold the leftmost minimum pair rank.  A merge reads the
root, joins two live neighbours and updates the ranks of at most three positions, each in
logarithmic time, so a piece of n bytes takes O(n log n) even when it has no breaks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a worker remembers; beyond it, pieces are simply encoded again.
REMEMBERED = 1 << 17
_NONE = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: always the leftmost pair of least rank is merged."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(n - 1, 1).bit_length()
    end = list(range(1, n + 1))  # end of the part that starts at a position
    before = list(range(-1, n - 1))  # start of the live part before it
    tree = [_NONE] * (2 * size)  # rank * n + position, so the least is also the leftmost
    for i in range(n - 1):
        if (r := ranks.get(piece[i : i + 2])) is not None:
            tree[size + i] = r * n + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a <= b else b
            i >>= 1

    while (least := tree[1]) != _NONE:
        at = least % n
        gone = end[at]
        stop = end[at] = end[gone]
        if stop < n:
            before[stop] = at
            r = ranks.get(piece[at : end[stop]])
            put(at, _NONE if r is None else r * n + at)
        else:
            put(at, _NONE)
        put(gone, _NONE)
        if (prior := before[at]) >= 0:
            r = ranks.get(piece[prior:stop])
            put(prior, _NONE if r is None else r * n + prior)
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


class Encoder:
    """Encodes texts with one vocabulary; remembers a bounded number of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks, self.cut, self.known = ranks, regex.compile(pattern).findall, {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.known, []
        for piece in self.cut(text):
            ids = known.get(piece)
            if ids is None:
                ids = encode_piece(piece.encode("utf-8", "surrogatepass"), self.ranks)
                if len(known) < REMEMBERED and len(piece) < 64:
                    known[piece] = ids
            out += ids
        return out


def encode_column(spark: SparkSession, text: Column, ranks_path: str) -> Column:
    """array<int> of the ids of ``text``: an empty list for empty and for null text.

    The vocabulary file is read once on the driver and broadcast (its size is that of the
    vocabulary, whatever the corpus). Whole texts are encoded, however long; repeated
    texts get equal ids. Special-token strings are ordinary text.
    """
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(shared.value)
        for s in batches:
            yield pd.Series([encoder.encode(x) for x in s], dtype=object)

    return ids(text)


def encode_table(df: DataFrame, key: str, column: str, ranks_path: str) -> DataFrame:
    """(key, ids) for every row of ``df``; other columns are ignored."""
    return df.select(key, encode_column(df.sparkSession, F.col(column), ranks_path).alias("ids"))
