"""Removal of passages that repeat across documents, by level-wise doubling of windows.

Level one looks at windows of half the asked length. Of these only anchors travel: for every window of
the full length, the half-length window of least hash inside it, so equal full windows always share an
anchor. Anchors found in one document alone are dropped. Around the rest, level two extends to windows
of the full length, grouped by their anchor: a window seen before in a smaller document is removed.
Longer windows cannot change which words are covered, so doubling ends at the asked length, or earlier
if no candidate is left. Exact copies of a smaller document go as a whole before the first level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    WORD_HASHES, arrow_schema, as_bytes, batch_of, begin, doc_texts, free_names, int_lists, mixed, squeeze, stash,
    unsqueezed, window_hashes,
)

#: anchors with more places than this are dealt over several tasks
HOT_PLACES = 20_000

_LEVEL_ONE = arrow_schema({
    "doc_id": pa.int64(), "n_words": pa.int64(), "digest": pa.binary(), "anchors": pa.list_(pa.int64()),
    "places": pa.list_(pa.int32()),
})
_WINDOWS = arrow_schema({
    "anchor": pa.int64(), "salt": pa.int32(), "salts": pa.int32(), "doc_id": pa.int64(), "start": pa.int32(),
    "windows": pa.binary(),
})
_DECIDED = arrow_schema({
    "anchor": pa.int64(), "doc_id": pa.int64(), "start": pa.int32(), "stop": pa.int32(), "window": pa.int64(),
})


def _owners(half: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` words, the place of the least half-length hash inside it."""
    inside = length - length // 2 + 1
    if len(half) < inside:
        return np.empty(0, np.int64)
    return sliding_window_view(half, inside).argmin(axis=1) + np.arange(len(half) - inside + 1)


def _level_one(docs: DataFrame, length: int) -> DataFrame:
    def work(batches):
        begin("substrings")
        for batch in batches:
            sizes, digests, anchors, places = [], [], [], []
            for text in as_bytes(batch):
                hashes = WORD_HASHES.of(text.split())
                half = window_hashes(hashes, length // 2)
                at = np.unique(_owners(half, length))
                sizes.append(len(hashes))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                anchors.append(half[at].view(np.int64))
                places.append(at)
            yield batch_of(_LEVEL_ONE, [
                batch.column("doc_id"), sizes, digests, int_lists(anchors, pa.int64()), int_lists(places, pa.int32()),
            ])

    return docs.mapInArrow(work, "doc_id long, n_words long, digest binary, anchors array<long>, places array<int>")


def _level_two(candidates: DataFrame, length: int) -> DataFrame:
    """Full windows around repeated anchors: one row per place, its windows' hashes packed."""

    def work(batches):
        begin("substrings")
        for batch in batches:
            rows: list[list] = [[] for _ in _WINDOWS]
            for doc_id, text, found in zip(
                batch.column("doc_id").to_pylist(), unsqueezed(batch), batch.column("found").to_pylist()
            ):
                half = window_hashes(WORD_HASHES.of((text or b"").split()), length // 2)
                owners = _owners(half, length)
                full = mixed(half[: len(owners)], half[length - length // 2 :])
                for hit in found:
                    lo, hi = np.searchsorted(owners, [hit["place"], hit["place"] + 1])
                    salt = xxhash.xxh3_64_intdigest(str(doc_id)) % hit["salts"]
                    values = (hit["anchor"], salt, hit["salts"], doc_id, int(lo), full[lo:hi].tobytes())
                    for column, value in zip(rows, values):
                        column.append(value)
            yield batch_of(_WINDOWS, rows)

    return candidates.mapInArrow(
        work, "anchor long, salt int, salts int, doc_id long, start int, windows binary"
    )


def _decide(windows: DataFrame) -> DataFrame:
    """Walk each anchor's places by document: windows seen in a smaller one are removed.

    Rows with a null ``window`` are removed runs [start, stop). Of an anchor dealt over several salts, the
    first of each distinct window within a salt comes back with its hash, still to be decided.
    """
    key = ["anchor", "salt"]
    placed = windows.repartition(*key).sortWithinPartitions(*key, "doc_id", "start")

    def work(batches):
        begin("substrings")
        last, first = None, {}
        for batch in batches:
            rows: list[list] = [[] for _ in _DECIDED]
            for anchor, salt, salts, doc_id, start, packed in zip(*(batch.column(f.name).to_pylist() for f in _WINDOWS)):
                if (anchor, salt) != last:
                    last, first = (anchor, salt), {}
                run = None
                for at, window in enumerate(np.frombuffer(packed, np.int64).tolist(), start):
                    if first.setdefault(window, doc_id) < doc_id:
                        if run is None:
                            run = at
                        continue
                    if run is not None:
                        _append(rows, (anchor, doc_id, run, at, None))
                        run = None
                    if salts > 1:
                        _append(rows, (anchor, doc_id, at, at + 1, window))
                if run is not None:
                    _append(rows, (anchor, doc_id, run, start + len(packed) // 8, None))
            yield batch_of(_DECIDED, rows)

    return placed.mapInArrow(work, "anchor long, doc_id long, start int, stop int, window long")


def _append(rows: list[list], values: tuple) -> None:
    for column, value in zip(rows, values):
        column.append(value)


def repeated_spans(docs: DataFrame, length: int = 50, squeezed: DataFrame | None = None) -> DataFrame:
    """(doc_id, spans): per document, the word ranges {start, stop} that repeat from a smaller one.

    A window is ``length`` consecutive words; every word under a window whose words also begin somewhere
    in a document with a smaller id is in a range. Ranges may overlap; documents without any are absent.
    Rows that share an id are taken to hold the same text; rows without an id take no part.
    """
    texts = doc_texts(docs).where("doc_id is not null")
    level = stash(_level_one(texts, length), "anchors").where(F.col("n_words") >= length)
    heads = level.groupBy("digest").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # written, so that both sides of each join are shuffled and hot keys can be split
    placed = level.join(stash(heads.select("digest", "head"), "heads"), "digest", "left")
    copies = placed.where("doc_id > head").select(
        "doc_id", F.lit(0).alias("start"), (F.col("n_words") - length + 1).cast("int").alias("stop")
    )
    single = placed.where("head is null or doc_id = head").select(
        "doc_id", F.explode(F.arrays_zip("anchors", "places")).alias("at")
    )
    single = single.select("doc_id", F.col("at.anchors").alias("anchor"), F.col("at.places").alias("place"))
    repeated = (
        single.groupBy("anchor")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
        .where("lo < hi")
        .select("anchor", F.ceil(F.col("n") / HOT_PLACES).cast("int").alias("salts"))
    )
    hits = single.join(stash(repeated, "repeated"), "anchor").groupBy("doc_id").agg(
        F.collect_list(F.struct("anchor", "place", "salts")).alias("found")
    )
    packed = squeeze(texts) if squeezed is None else squeezed.select("doc_id", "text")
    decided = stash(_decide(_level_two(packed.join(hits, "doc_id").select("doc_id", "text", "found"), length)), "decided")
    removed = decided.where("window is null").select("doc_id", "start", "stop")
    # the firsts of the salts of a hot anchor meet by window
    open_ = decided.where("window is not null").select("anchor", "window", "doc_id", "start", "stop")
    least = open_.groupBy("anchor", "window").agg(F.min("doc_id").alias("least"))
    late = open_.join(least, ["anchor", "window"]).where("doc_id > least").select("doc_id", "start", "stop")
    every = removed.union(late).union(copies)
    spans = every.select("doc_id", F.struct("start", (F.col("stop") + (length - 1)).alias("stop")).alias("span"))
    return spans.groupBy("doc_id").agg(F.collect_list("span").alias("spans"))


def added_names(docs: DataFrame) -> list[str]:
    """The names of the columns that :func:`remove_repeats` adds, apart from those that ``docs`` has."""
    return free_names(docs.columns, "_n_words", "_n_removed")


def remove_repeats(docs: DataFrame, length: int = 50, keep_untouched: bool = False) -> DataFrame:
    """``docs`` with ``text`` replaced by its kept words, joined by one space, and two columns more.

    ``_n_words`` and ``_n_removed`` count the words of the input and those that went. A text without any
    removed word is given as its words joined by one space as well, a null one as an empty one; with
    ``keep_untouched`` both stay as they are. All other columns stay; the result has one row for each
    row of ``docs``. See :func:`added_names` where ``docs`` has columns of those names.
    """
    n_words, n_removed = added_names(docs)
    own, ranges = free_names([*docs.columns, n_words, n_removed], "_doc_id", "_spans")
    packed = squeeze(docs.withColumn("text", F.col("text").cast("string")))
    found = repeated_spans(docs, length).select(F.col("doc_id").alias(own), F.col("spans").alias(ranges))
    joined = packed.join(found, packed["doc_id"].cast("long") == found[own], "left").drop(own)
    out = docs.withColumn("text", F.col("text").cast("string")).withColumns(
        {n_words: F.lit(0).cast("long"), n_removed: F.lit(0).cast("long")}
    )

    def strip(batches):
        begin("substrings")
        for batch in batches:
            texts, sizes, gone = [], [], []
            for text, spans in zip(unsqueezed(batch), batch.column(ranges).to_pylist()):
                words = (text or b"").split()
                kept = words
                if spans:
                    edges = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edges, [s["start"] for s in spans], 1)
                    np.add.at(edges, [s["stop"] for s in spans], -1)
                    kept = [w for w, n in zip(words, np.cumsum(edges[:-1]).tolist()) if not n]
                if keep_untouched and len(kept) == len(words):
                    texts.append(None if text is None else text.decode())
                else:
                    texts.append(b" ".join(kept).decode())
                sizes.append(len(words))
                gone.append(len(words) - len(kept))
            at = batch.schema.get_field_index("text")
            rest = batch.set_column(at, "text", pa.array(texts, pa.string())).drop_columns([ranges])
            yield rest.append_column(n_words, pa.array(sizes, pa.int64())).append_column(
                n_removed, pa.array(gone, pa.int64())
            )

    return joined.mapInArrow(strip, out.schema)
