"""Encoding with a byte-level BPE vocabulary.

Method: a text is cut into pieces by the tokenizer's pattern, and a piece's bytes are merged with a segment tree over
the ranks of adjacent pairs. Its root gives the leftmost pair of the lowest rank; a merge changes three leaves, each
by a point update in logarithmic time, until the root holds no mergeable pair. A piece of n bytes takes n log n steps,
so one of millions of bytes is no obstacle. Each Python worker keeps the ids of the pieces it has met, as far as a
bound allows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary lies on every machine of the cluster.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts a text into pieces for this vocabulary.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker remembers, and the longest of them in bytes.
REMEMBERED, REMEMBERED_BYTES = 200_000, 64


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, which is also the token's id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece, merged by lowest rank, leftmost first.

    Node k of the tree holds rank * n + place of the best pair below it, so that the least value is the leftmost pair
    of the lowest rank; leaf i belongs to the pair that starts with the part at i."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    width = 1 << max(0, n - 2).bit_length()
    none = (len(ranks) + 1) * n
    tree = [none] * (2 * width)
    end = list(range(1, n + 1))  # where the part that starts here ends
    start = list(range(-1, n))  # where the part that ends here starts, by end

    def value(i: int, j: int, k: int) -> int:
        rank = ranks.get(piece[i:k])
        return none if rank is None else rank * n + i

    for i in range(n - 1):
        tree[width + i] = value(i, i + 1, i + 2)
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def update(i: int, new: int) -> None:
        k = width + i
        tree[k] = new
        k >>= 1
        while k:
            best = tree[2 * k] if tree[2 * k] < tree[2 * k + 1] else tree[2 * k + 1]
            if tree[k] == best:
                break
            tree[k] = best
            k >>= 1

    while tree[1] < none:
        i = tree[1] % n
        middle = end[i]
        stop = end[middle]
        end[i] = stop
        start[stop] = i
        if middle < n - 1:
            update(middle, none)
        update(i, value(i, stop, end[stop]) if stop < n else none)
        before = start[i] if i else -1
        if before >= 0:
            update(before, value(before, i, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Encoder:
    """Encodes texts with one vocabulary; strings that look like special tokens are ordinary text."""

    def __init__(self, path: str = VOCABULARY):
        self.ranks = read_ranks(path)
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, list[int]] = {}

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, ids = self.known, []
        for piece in self.pieces.findall(text):
            own = known.get(piece)
            if own is None:
                own = merge_piece(piece.encode("utf-8", "replace"), self.ranks)
                if len(piece) <= REMEMBERED_BYTES:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = own
            ids += own
        return ids


@lru_cache(maxsize=4)
def encoder_of(path: str = VOCABULARY) -> Encoder:
    """The encoder of a vocabulary, kept by the process."""
    return Encoder(path)


def encode(df: DataFrame, key: str, text: str, path: str = VOCABULARY, only_count: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns of ``keep``, and ``ids`` ARRAY<INT> of the text, without special tokens; with
    ``only_count`` ``n_tokens`` BIGINT in place of the ids.

    Null and empty texts have no ids; blanks count as they are. Rows stay in their partition and texts of any length
    are encoded whole. Repeated keys stay repeated; other columns of ``df`` are not read."""
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *keep))
    n = 1 + len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            ids = [encoder(x) for x in batch.column(n).to_pylist()]
            made = pa.array([len(x) for x in ids], pa.int64()) if only_count else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], made], names=[*batch.schema.names[:n], "n_tokens" if only_count else "ids"])

    return df.select(key, *keep, text).mapInArrow(run, f"{fields}, {'n_tokens long' if only_count else 'ids array<int>'}")
