"""Byte-level BPE: merges by a segment tree over byte positions.

A text is split by the vocabulary's pattern. Inside a piece, position i holds a live token or nothing;
leaf i of a segment tree holds the rank of merging the token at i with its live right neighbour, joined
with i, so the root is the leftmost pair of least rank. A merge takes the root, links the neighbours
anew and updates three leaves and their ancestors. Many pieces of like size are worked on side by
side, one row of the arrays each.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_schema, as_bytes, batch_of, doc_texts
from .encoding import ChunkEncoder, held

#: cells of the trees that are worked on at a time
BLOCK_CELLS = 1 << 19
_NONE = np.iinfo(np.int64).max
_ENCODED = arrow_schema({"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary(), "decoded": pa.binary()})


class ByteBPE:
    """Encoder and decoder for a rank file (base64 of the bytes, rank) and its split pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.bytes_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        # every way to cut a token into two tokens is a merge with the token's rank
        merges = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    merges[(left << 32) | right] = rank
        keys = np.fromiter(merges.keys(), np.int64, len(merges))
        order = np.argsort(keys)
        self.merge_keys = keys[order]
        self.merge_ranks = np.fromiter(merges.values(), np.int64, len(merges))[order]

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
        return np.where(self.merge_keys[at] == key, self.merge_ranks[at], _NONE)

    def _merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of at most ``width`` bytes, a power of two."""
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.zeros((n, width), np.uint8)
        inside = np.arange(width) < sizes[:, None]
        raw[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.bytes_ids[raw]
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        live = inside.copy()
        tree = np.full((n, 2 * width), _NONE)
        ranks = self._pair_ranks(ids[:, :-1], ids[:, 1:])
        paired = inside[:, 1:] & (ranks != _NONE)
        tree[:, width : 2 * width - 1] = np.where(paired, ranks * width + np.arange(width - 1), _NONE)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            root = tree[rows, 1]
            at = root % width
            gone = after[rows, at]
            beyond = after[rows, gone]
            ids[rows, at] = root // width
            live[rows, gone] = False
            after[rows, at] = beyond
            linked = beyond < sizes[rows]
            before[rows[linked], beyond[linked]] = at[linked]
            self._set(tree, rows, gone, np.full(len(rows), _NONE), width)
            right = np.minimum(beyond, width - 1)
            rank = np.where(linked, self._pair_ranks(ids[rows, at], ids[rows, right]), _NONE)
            self._set(tree, rows, at, np.where(rank == _NONE, _NONE, rank * width + at), width)
            left = before[rows, at]
            has = left >= 0
            some, left = rows[has], left[has]
            rank = self._pair_ranks(ids[some, left], ids[some, at[has]])
            self._set(tree, some, left, np.where(rank == _NONE, _NONE, rank * width + left), width)
            rows = rows[tree[rows, 1] != _NONE]
        kept = ids[live].astype("<u4").tobytes()
        ends = 4 * np.cumsum(live.sum(axis=1))
        return [kept[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray, width: int) -> None:
        node = leaf + width
        tree[rows, node] = value
        while width > 1:
            node, width = node >> 1, width >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece; one that is a token itself is that token."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif piece:
                by_width.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, members in by_width.items():
            block = max(1, BLOCK_CELLS // width)
            for lo in range(0, len(members), block):
                some = members[lo : lo + block]
                for i, ids in zip(some, self._merge([pieces[i] for i in some], width)):
                    out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids (little-endian unsigned 32-bit) of texts; each distinct piece is merged once."""
        split = [[p.encode() for p in self.pattern.findall(t)] for t in texts]
        distinct = list(set().union(*split))
        known = dict(zip(distinct, self.pieces(distinct)))
        return [b"".join(map(known.__getitem__, p)) for p in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def coder(path: str, pattern: str) -> tuple[ByteBPE, ChunkEncoder]:
    """The worker's coder for a vocabulary, with the chunks it has encoded so far."""

    def make():
        bpe = ByteBPE(path, pattern)
        return bpe, ChunkEncoder(bpe.encode)

    return held("byte bpe", (path, pattern), make)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every whole text; ids are packed unsigned 32-bit integers.

    ``decoded`` is what the ids decode to, the text's bytes. A null text is an empty one: no ids. Repeated
    rows and null ids stay rows of their own; other columns of ``docs`` are not looked at.
    """

    def encode(batches):
        bpe, encoder = coder(path, pattern)
        for batch in batches:
            ids = encoder.texts([t.decode() for t in as_bytes(batch)])
            yield batch_of(
                _ENCODED, [batch.column("doc_id"), [len(b) // 4 for b in ids], ids, [bpe.decode(b) for b in ids]]
            )

    return doc_texts(docs).mapInArrow(encode, "doc_id long, n_tokens long, ids binary, decoded binary")
