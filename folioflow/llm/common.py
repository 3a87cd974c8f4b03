"""Helpers the operators share: stored intermediates, text columns as bytes, bounded memos, folds."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Arrow batches stay small in rows and bytes, since a text can be very long
BATCH_ROWS, BATCH_BYTES = "1000", "32m"


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of the session's Python stages."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """More rows in the Arrow batches of what runs inside, for tables of short rows; the bytes stay bounded."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def folder_for(spark: SparkSession, what: str) -> str:
    """A fresh folder below the one all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stash(df: DataFrame, what: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back; lost executors do no harm."""
    path = folder_for(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def doc_texts(docs: DataFrame) -> DataFrame:
    """Only doc_id (as long) and text (as string); other columns, however named, stay behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def free_names(columns: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores in front as keep it apart from the columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def fold(modulus: int, column: str = "doc_id") -> Column:
    """Remainder of the crc32 of an id written as text; a null id falls into no fold."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def as_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A text column as UTF-8 bytes; null becomes empty."""
    return [b or b"" for b in batch.column(name).cast(pa.binary()).to_pylist()]


def as_strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)],
        schema=schema,
    )


class HashMemo(dict):
    """64-bit hashes of words, remembered up to about ``limit`` bytes, then anew."""

    #: bytes of an entry besides its word: the objects of word and hash, and their places in the dict
    ENTRY = 176

    def __init__(self, limit: int = 40 << 20):
        super().__init__()
        self.limit, self.held = limit, 0

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self.held += self.ENTRY + len(word)
            if self.held > self.limit:
                self.clear()
                self.held = 0
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


#: the one memo of a worker's operators; a worker that runs several stages holds no more than this
WORD_HASHES = HashMemo(24 << 20)
#: what else a worker keeps between tasks, of the operator that ran last
KEPT: dict = {}


def begin(operator: str) -> None:
    """Called where a task's work begins: a worker that ran another operator before drops what that one left.

    Workers outlive their tasks, and several run side by side on an executor, so what stages leave behind
    would add up.
    """
    if KEPT.get("operator") != operator:
        KEPT.clear()
        WORD_HASHES.clear()
        WORD_HASHES.held = 0
        KEPT["operator"] = operator
        gc.collect()
        give_back()


def give_back() -> None:
    """What allocators have in hand goes back to the system; other libraries than glibc have no such call."""
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def lower_words(text: bytes) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: what bytes.lower and bytes.split do."""
    return text.lower().split()


_MIX = np.uint64(0x9E3779B97F4A7C15)
_FINAL = np.uint64(0xD6E8FEB86659FD93)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-sensitive 64-bit hash of two hash arrays."""
    x = (a * _MIX) ^ ((b << np.uint64(31)) | (b >> np.uint64(33)))
    x = (x ^ (x >> np.uint64(32))) * _FINAL
    return x ^ (x >> np.uint64(29))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` words: each step doubles the window, the last may overlap."""
    have, reach = words, 1
    while reach < length:
        step = min(reach, length - reach)
        if len(have) <= step:
            return np.empty(0, np.uint64)
        have, reach = mixed(have[:-step], have[step:]), reach + step
    return have


def arrow_schema(fields: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(fields.items()))


def squeeze(docs: DataFrame, column: str = "text") -> DataFrame:
    """Replace a text column by its zstd frame, so that shuffles move less; null stays null."""
    kept = docs.withColumn(column, F.col(column).cast("binary"))

    def work(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            at = batch.schema.get_field_index(column)
            packed = [None if b is None else packer.compress(b) for b in batch.column(at).to_pylist()]
            yield batch.set_column(at, column, pa.array(packed, pa.binary()))

    return kept.mapInArrow(work, kept.schema)


def unsqueeze(docs: DataFrame, column: str = "text") -> DataFrame:
    """The texts back from their zstd frames."""
    schema = docs.withColumn(column, F.col(column).cast("string")).schema

    def work(batches):
        for batch in batches:
            at = batch.schema.get_field_index(column)
            texts = [None if b is None else b.decode() for b in unsqueezed(batch, column)]
            yield batch.set_column(at, column, pa.array(texts, pa.string()))

    return docs.mapInArrow(work, schema)


def unsqueezed(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    opener = zstandard.ZstdDecompressor()
    return [None if b is None else opener.decompress(b) for b in batch.column(column).to_pylist()]


def int_lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column from numpy arrays."""
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays], dtype=np.int64)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False), kind))
