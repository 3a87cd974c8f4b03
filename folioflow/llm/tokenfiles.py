"""Token files: equal-length sequences and their masks in Arrow's file format.

Documents are sorted by id over the cluster, each range of ids is encoded in order and written as two
files: the sequences, in batches of fixed-size lists that a reader can map into memory and address by
number, and an index of the range's documents. A range's last sequence is padded; the mask tells which
places hold tokens. A manifest, one row per range, lists the files of the tasks that were committed,
so files that a lost or repeated task left behind are never read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, as_strings, batch_of, doc_texts, stash
from .encoding import WordEncoder, held, id_type, special_tokens, tokenizer_encode

#: sequences in one record batch of a file
BATCH_SEQUENCES = 64

_INDEX = arrow_schema({"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64()})
_DOCS = arrow_schema({"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()})
_MANIFEST = arrow_schema({
    "part": pa.int64(), "path": pa.string(), "n_docs": pa.int64(), "n_tokens": pa.int64(), "length": pa.int64(),
})


def file_schema(length: int, dtype: str) -> pa.Schema:
    """One row per sequence: its ids and, per place, whether it holds a token."""
    kind = pa.uint16() if dtype == "<u2" else pa.uint32()
    return arrow_schema({"ids": pa.list_(kind, length), "mask": pa.list_(pa.bool_(), length)})


def _located(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("file:///", "/", 1) if uri.startswith("file:///") else uri)


class _SequenceWriter:
    """Appends token arrays to a file of fixed-length sequences."""

    def __init__(self, sink, length: int, dtype: str):
        self.length, self.dtype, self.schema = length, dtype, file_schema(length, dtype)
        self.writer, self.held, self.n_held, self.total = pa.ipc.new_file(sink, self.schema), [], 0, 0

    def _write(self, ids: np.ndarray, n_real: int) -> None:
        mask = np.arange(len(ids)) < n_real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(a), self.length) for a in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.total += len(ids)
        block = self.length * BATCH_SEQUENCES
        if self.n_held >= block:
            flat = np.concatenate(self.held)
            full = len(flat) // block * block
            for at in range(0, full, block):
                self._write(flat[at : at + block], block)
            self.held, self.n_held = [flat[full:]], len(flat) - full

    def close(self) -> None:
        flat = np.concatenate([np.empty(0, self.dtype), *self.held])
        if len(flat):
            padded = np.zeros(-(-len(flat) // self.length) * self.length, self.dtype)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        self.writer.close()


def write_files(
    docs: DataFrame, folder: str, vocabulary: str, length: int = 2048, end_id: int = 1, largest_id: int = 49407
) -> DataFrame:
    """Write all documents in ascending id order below ``folder``; returns the manifest.

    The string of a special token in a text has that token's id, as the tokenizers library gives it. A
    null text is an empty one and holds the end id alone; rows without an id come first; rows that
    share an id lie next to each other; an empty table gives an empty manifest. Other columns are not
    looked at. The manifest's rows: (part, path, n_docs, n_tokens, length, base), ``base`` being the
    number of tokens in all earlier ranges.
    """
    dtype = id_type(largest_id)
    ordered = doc_texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def write(batches):
        encoder = held("token files", (vocabulary, dtype), lambda: WordEncoder(
            tokenizer_encode(vocabulary, dtype, lower=True), True, special_tokens(vocabulary)
        ))
        end, part, n_docs, writer = np.array([end_id], dtype).tobytes(), TaskContext.get().partitionId(), 0, None
        name = f"{folder.rstrip('/')}/range-{part:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                system, path = _located(name)
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                sinks = [system.open_output_stream(f"{path}.{kind}.arrow") for kind in ("sequences", "index")]
                writer, index = _SequenceWriter(sinks[0], length, dtype), pa.ipc.new_file(sinks[1], _INDEX)
            starts, sizes = [], []
            for packed in encoder.texts(as_strings(batch)):
                ids = np.frombuffer(packed + end, dtype)
                starts.append(writer.total)
                sizes.append(len(ids))
                writer.add(ids)
            index.write_batch(batch_of(_INDEX, [batch.column("doc_id"), starts, sizes]))
            n_docs += batch.num_rows
        if writer is not None:
            writer.close()
            index.close()
            for sink in sinks:
                sink.close()
            yield batch_of(_MANIFEST, [[part], [name], [n_docs], [writer.total], [length]])

    manifest = stash(
        ordered.mapInArrow(write, "part long, path string, n_docs long, n_tokens long, length long"), "manifest"
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))


def read_documents(manifest: DataFrame) -> DataFrame:
    """Documents back from the files: (doc_id, start, n_tokens, ids), ids as unsigned 32-bit integers."""

    def read(batches):
        for batch in batches:
            for name, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                yield from _file_documents(name, base)

    spread = manifest.select("path", "base").repartition(max(1, manifest.count()))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _file_documents(name: str, base: int):
    system, path = _located(name)
    with system.open_input_file(f"{path}.index.arrow") as a, system.open_input_file(f"{path}.sequences.arrow") as b:
        index, sequences = pa.ipc.open_file(a), pa.ipc.open_file(b)
        held, held_from, next_batch = np.empty(0, np.uint32), 0, 0
        for i in range(index.num_record_batches):
            rows = index.get_batch(i)
            starts, sizes = rows.column("start").to_numpy(), rows.column("n_tokens").to_numpy()
            ids = []
            for start, size in zip(starts.tolist(), sizes.tolist()):
                if start + size > held_from + len(held):
                    kept = [held[start - held_from :]]
                    held_from, have = start, len(kept[0])
                    while have < size:
                        batch = sequences.get_batch(next_batch)
                        flat = batch.column("ids").flatten().to_numpy()
                        flat = flat[batch.column("mask").flatten().to_numpy(zero_copy_only=False)]
                        kept.append(flat)
                        next_batch, have = next_batch + 1, have + len(flat)
                    held = np.concatenate(kept)
                ids.append(held[start - held_from : start - held_from + size].astype("<u4").tobytes())
            yield batch_of(_DOCS, [rows.column("doc_id"), starts + base, sizes, ids])


def read_sequence(path: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one sequence of a local file, as views of the mapped file."""
    with pa.memory_map(f"{path}.sequences.arrow") as source:
        batch = pa.ipc.open_file(source).get_batch(number // BATCH_SEQUENCES)
    at = number % BATCH_SEQUENCES
    ids, mask = batch.column("ids"), batch.column("mask")
    length = ids.type.list_size
    return (
        ids.values.slice(at * length, length).to_numpy(),
        mask.values.slice(at * length, length).to_numpy(zero_copy_only=False),
    )

