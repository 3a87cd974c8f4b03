"""Document fingerprints that feel edits: order MinHash.

A text's elements are its windows of ``K`` code points, each with the number of equal windows before it.
Every one of ``SKETCHES`` permutations selects the ``PICKED`` least elements, puts them back into text
order and hashes the tuple of their windows. Two texts agree on a sketch when they share the least
elements and hold them in the same order, so both lost and moved passages lower the share of equal
sketches, as they raise the edit distance.

The text after a document is found in one exchange: rows are dealt into ranges of (doc_id, hash of the
text), and the first row of a range also travels to the range before it as its guest.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_strings, batch_of, doc_texts, mixed, unsqueezed, window_hashes

#: code points of a window, elements a permutation selects, permutations
K, PICKED, SKETCHES = 8, 2, 64
#: windows that all permutations look at together, so that a very long text needs no more memory
BLOCK = 4096
#: bytes of text in a range, and keys the driver sees to choose the ranges' ends
RANGE_BYTES, SAMPLE_KEYS = 8 << 20, 20_000

_rng = np.random.default_rng(11)
_FACTORS = _rng.integers(0, 1 << 31, SKETCHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, SKETCHES, dtype=np.uint32)
_SPREAD, _LIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def windows(text: str) -> np.ndarray:
    """Hashes of all windows of K code points; a shorter text is one window, an empty one has none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(points):
        return points
    return window_hashes((points + np.uint64(1)) * _SPREAD ^ _LIFT, min(K, len(points)))


def numbered(kmers: np.ndarray) -> np.ndarray:
    """32-bit hashes of (window, number of equal windows before it)."""
    n = len(kmers)
    low = np.uint64((1 << max(n - 1, 1).bit_length()) - 1)
    places = np.arange(n, dtype=np.uint64)
    # one sort of numbers that carry their place in the low bits
    packed = np.sort((kmers & ~low) | places)
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = (packed[1:] & ~low) != (packed[:-1] & ~low)
    first = np.maximum.accumulate(np.where(new, places, np.uint64(0)))
    times = np.empty(n, np.uint64)
    times[(packed & low).astype(np.int64)] = places - first
    return (mixed(kmers, times) >> np.uint64(32)).astype(np.uint32)


def sketch(text: str) -> np.ndarray:
    """The fingerprint as ``SKETCHES`` 32-bit hashes; all of an empty text are 0."""
    kmers = windows(text)
    if not len(kmers):
        return np.zeros(SKETCHES, np.uint32)
    marks = numbered(kmers)
    rows = np.arange(SKETCHES)
    values, places = np.empty((SKETCHES, 0), np.uint32), np.empty((SKETCHES, 0), np.int64)
    for at in range(0, len(marks), BLOCK):
        ranks = _FACTORS[:, None] * marks[None, at : at + BLOCK]
        ranks += _SHIFTS[:, None]
        for _ in range(min(PICKED, ranks.shape[1])):
            least = ranks.argmin(axis=1)
            values = np.column_stack([values, ranks[rows, least]])
            places = np.column_stack([places, least + at])
            ranks[rows, least] = np.iinfo(np.uint32).max
        if values.shape[1] > PICKED:
            # earlier windows first, so that a tie keeps the earlier one
            order = np.argsort(values, axis=1, kind="stable")[:, :PICKED]
            values, places = np.take_along_axis(values, order, 1), np.take_along_axis(places, order, 1)
    told = np.full(SKETCHES, _LIFT)
    for column in np.sort(places, axis=1).T:
        told = mixed(told, kmers[column])
    return (told >> np.uint64(32)).astype(np.uint32)


def shown(prints: np.ndarray) -> str:
    """A fingerprint as text: eight hexadecimal digits a sketch."""
    return prints.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal sketches."""
    return float((a == b).mean())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row: equal texts have equal fingerprints, a null text is empty."""
    schema = arrow_schema({"doc_id": pa.int64(), "fingerprint": pa.string()})

    def work(batches):
        for batch in batches:
            yield batch_of(schema, [batch.column("doc_id"), [shown(sketch(t)) for t in as_strings(batch)]])

    return doc_texts(docs).mapInArrow(work, "doc_id long, fingerprint string")


def edited_text(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many code points from the start of ``following``."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _key(doc_id: int | None, raw: bytes) -> tuple:
    """Order of rows: null ids first, then ids; rows that share an id by a hash of their text."""
    return (doc_id is not None, doc_id or 0, xxhash.xxh3_64_intdigest(raw) >> 1)


_KEYS = arrow_schema({"known": pa.bool_(), "doc_id": pa.int64(), "place": pa.int64()})
_DEALT = arrow_schema({
    "range": pa.int32(), "guest": pa.bool_(), "known": pa.bool_(), "doc_id": pa.int64(), "place": pa.int64(),
    "text": pa.binary(),
})
_DEALT_DDL = "range int, guest boolean, known boolean, doc_id long, place long, text binary"
_PAIRED = arrow_schema({
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited": pa.string(), "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(),
})


def _starts(texts: DataFrame) -> list[tuple]:
    """Least keys of the ranges, each the key of some row; the first is the least of all rows.

    The driver sees a bounded sample of keys, chosen by the hash of the text and the id.
    """
    size = texts.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    if not size[0]:
        return []
    n_ranges = max(1, -(-(size[1] or 0) // RANGE_BYTES))
    every = -(-size[0] // SAMPLE_KEYS)

    def keys(batches):
        best, out = None, [[], [], []]
        for batch in batches:
            raws = batch.column("text").cast(pa.binary()).to_pylist()
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), raws):
                key = _key(doc_id, raw or b"")
                best = key if best is None or key < best else best
                if (key[2] ^ (key[1] * 0x9E3779B1)) % every == 0:
                    for column, value in zip(out, key):
                        column.append(value)
        if best is not None:
            # the least key of each task keeps the least of all; repeated rows have one key
            for column, value in zip(out, best):
                column.append(value)
        yield batch_of(_KEYS, out)

    found = texts.mapInArrow(keys, "known boolean, doc_id long, place long")
    least = F.struct("known", "doc_id", "place")
    seen = sorted(tuple(r) for r in found.distinct().limit(4 * SAMPLE_KEYS).collect())
    first = tuple(found.agg(F.min(least).alias("least")).first()["least"])
    step = max(1, len(seen) // n_ranges)
    return sorted({first, *(k for k in seen[::step] if k > first)})


def _dealt(texts: DataFrame, starts: list[tuple]) -> DataFrame:
    """Rows in their ranges, the first row of each also as the last guest of the range before."""

    def deal(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            out: list[list] = [[] for _ in _DEALT]
            raws = batch.column("text").cast(pa.binary()).to_pylist()
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), raws):
                raw = raw or b""
                key = _key(doc_id, raw)
                own = bisect.bisect_right(starts, key) - 1
                places = [(own, False)]
                if starts[own] == key:
                    places.append(((own or len(starts)) - 1, True))
                packed = packer.compress(raw)
                for place, guest in places:
                    for column, value in zip(out, (place, guest, *key, packed)):
                        column.append(value)
            yield batch_of(_DEALT, out)

    rows = texts.mapInArrow(deal, _DEALT_DDL).repartition(len(starts), "range")
    return rows.sortWithinPartitions("range", "guest", "known", "doc_id", "place")


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how near it is to that and to the next text.

    The next document is the next row by ascending doc_id, after the last the first; rows without an id
    come first and rows that share an id follow each other by a hash of their text. The edited text is
    the text with its last quarter (rounded down) replaced by the start of the next one. Returns (doc_id,
    n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next). A null text is an empty
    one; a lone row is its own next; an empty table gives no rows; other columns are not looked at.
    """
    texts = doc_texts(docs)
    starts = _starts(texts)
    if not starts:
        nothing = {f.name: f.type for f in _PAIRED}
        kinds = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
        return texts.sparkSession.createDataFrame([], ", ".join(f"{n} {kinds[t]}" for n, t in nothing.items()))

    def pair(batches):
        held = None
        for batch in batches:
            out: list[list] = [[] for _ in _PAIRED]
            columns = [batch.column(c).to_pylist() for c in ("range", "guest", "known", "doc_id")]
            for place, guest, known, doc_id, raw in zip(*columns, unsqueezed(batch)):
                if guest and (held is None or held[0] != place):
                    continue
                text = raw.decode("utf-8", "surrogatepass")
                prints = sketch(text)
                if held is not None and held[0] == place:
                    _, before_id, before, before_prints = held
                    edited = edited_text(before, text)
                    edited_prints = before_prints if edited == before else sketch(edited)
                    row = (
                        before_id, len(before), edited, shown(before_prints), shown(edited_prints),
                        likeness(before_prints, edited_prints), likeness(before_prints, prints),
                    )
                    for column, value in zip(out, row):
                        column.append(value)
                # of several equal guests only the first is the next of somebody
                held = None if guest else (place, doc_id if known else None, text, prints)
            yield batch_of(_PAIRED, out)

    return _dealt(texts, starts).mapInArrow(
        pair,
        "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double",
    )
