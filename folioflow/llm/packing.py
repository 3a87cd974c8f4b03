"""Packing: concatenate all documents and cut the stream into fixed windows.

Two passes. The first encodes each partition's documents and keeps, with every document, the number of
tokens before it in its partition. The partitions' totals, one row each, give each partition's place in
the whole stream by a prefix sum. The second pass cuts every document at the multiples of the window
length; a document that crosses a boundary leaves one record per window it touches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, as_strings, batch_of, doc_texts, stash
from .encoding import ChunkEncoder, held, id_type, special_tokens, tokenizer_encode

#: offsets of at most this many partitions (16 bytes each) are sent to all executors; more are joined
BROADCAST_PARTS = 200_000

_TOKENS = arrow_schema({
    "part": pa.int64(), "before": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary(),
})
_PIECES = arrow_schema({
    "doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary(), "doc_tokens": pa.int64(),
    "sequence_id": pa.int64(), "offset": pa.int64(),
})


def token_table(docs: DataFrame, vocabulary: str, end_id: int, largest_id: int) -> DataFrame:
    """First pass: (part, before, doc_id, n_tokens, ids); ids are packed and close with ``end_id``."""
    dtype = id_type(largest_id)

    def encode(batches):
        encoder = held("packing", (vocabulary, dtype), lambda: ChunkEncoder(
            tokenizer_encode(vocabulary, dtype), special_tokens(vocabulary)
        ))
        part, before, end = TaskContext.get().partitionId(), 0, np.array([end_id], dtype).tobytes()
        width = np.dtype(dtype).itemsize
        for batch in batches:
            ids = [b + end for b in encoder.texts(as_strings(batch))]
            sizes = np.array([len(b) // width for b in ids], dtype=np.int64)
            ends = before + np.cumsum(sizes)
            yield batch_of(_TOKENS, [np.full(len(ids), part), ends - sizes, batch.column("doc_id"), sizes, ids])
            before = int(ends[-1]) if len(ends) else before

    return docs.mapInArrow(encode, "part long, before long, doc_id long, n_tokens long, ids binary")


def pack(
    docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 1, largest_id: int = 50256
) -> DataFrame:
    """Pieces of all documents in one gapless stream of windows of ``length`` tokens.

    Returns (doc_id, start, length, ids, doc_tokens, sequence_id, offset); ``ids`` holds the piece's
    tokens as little-endian unsigned 32-bit integers. The string of a special token in a text has that
    token's id, as the tokenizers library gives it. Only the last sequence is short. A null text is an
    empty one: its document holds the end id alone. Repeated rows and null ids are documents like any
    other; an empty table gives no pieces; other columns of ``docs`` are not looked at.
    """
    tokens = stash(token_table(doc_texts(docs), vocabulary, end_id, largest_id), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    bases = stash(bases, "bases")
    if bases.count() <= BROADCAST_PARTS:
        bases = F.broadcast(bases)
    placed = tokens.join(bases, "part").select("doc_id", "n_tokens", (F.col("base") + F.col("before")).alias("at"), "ids")
    dtype = id_type(largest_id)

    def cut(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in _PIECES]
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "at", "ids")]
            for doc_id, n_tokens, at, packed in zip(*columns):
                ids, start = np.frombuffer(packed, dtype).astype("<u4").tobytes(), 0
                while start < n_tokens:
                    sequence_id, offset = divmod(at + start, length)
                    size = min(length - offset, n_tokens - start)
                    piece = ids[4 * start : 4 * (start + size)]
                    for values, value in zip(rows, (doc_id, start, size, piece, n_tokens, sequence_id, offset)):
                        values.append(value)
                    start += size
            yield batch_of(_PIECES, rows)

    return placed.mapInArrow(
        cut,
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: (sequence_id, n_tokens, n_pieces, ids). A group is one window, so bounded."""
    part = F.struct("offset", "length", "ids")
    grouped = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return grouped.select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("n_tokens"),
        F.size("parts").alias("n_pieces"),
        joined.alias("ids"),
    )
