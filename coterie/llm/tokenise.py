"""Encoding of texts with a byte-level BPE vocabulary.

Within a piece of text, each mergeable pair of neighbours has a rank. A
segment tree over the pairs holds the smallest (rank, position) of each range:
its root is the leftmost pair of lowest rank. A merge updates three leaves, in
logarithmic time each, until no pair is mergeable. A piece of n bytes costs
O(n log n), however long it is.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pattern that splits text into pieces for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NONE = 1 << 62


class Encoder:
    """Ids of texts by one vocabulary of byte strings with ranks; the rank is the id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, remember: int = 100_000):
        self.ranks, self.split, self.remember = ranks, regex.compile(pattern), remember
        self.known: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ranks, n = self.ranks, len(piece)
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        size = 1 << max(0, (n - 1).bit_length())
        end = list(range(1, n + 1))  # end of the part that starts here
        start = list(range(-1, n))  # start of the part before the one that starts here
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            if (r := ranks.get(piece[i : i + 2])) is not None:
                tree[size + i] = r << 32 | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        def pair(i: int) -> int:
            j = end[i]
            if j >= n or (r := ranks.get(piece[i : end[j]])) is None:
                return NONE
            return r << 32 | i

        while (best := tree[1]) != NONE:
            i = best & 0xFFFFFFFF
            j = end[i]
            end[i] = end[j]
            if end[i] < n:
                start[end[i]] = i
            put(j, NONE)
            put(i, pair(i))
            if i:
                put(start[i], pair(start[i]))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty texts have none."""
        out: list[int] = []
        known = self.known
        for piece in self.split.findall(text or ""):
            ids = known.get(piece)
            if ids is None:
                ids = self.merge(piece.encode())
                if len(piece) <= 64:
                    if len(known) >= self.remember:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The encoder of a rank file, read once in each worker."""
    with open(path, "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in (line.split() for line in f)})


def encode_texts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of rows (doc_id, text), one row each, without special tokens.

    Null and empty texts give an empty list. What looks like a special token
    is ordinary text. Row by row: no shuffle, and other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            ends, flat = [0], []
            for text in batch.column("text").to_pylist():
                ids = enc.encode(text)
                flat.append(np.array(ids, np.int32))
                ends.append(ends[-1] + len(ids))
            values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32))
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")
