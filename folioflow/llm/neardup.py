"""Near duplicates by HyperMinHash.

A document's set is its distinct 5-word shingles, hashed to 64 bits. The top bits of a hash choose a
bucket; a bucket keeps the least of the remaining bits, compressed to its number of leading zeros and
the next mantissa bits. 128 registers of 16 bits are banded, four to a band: sets that agree in a band
are candidates. Two sets with a similarity of 0.85 miss each other in all 32 bands with a probability
below 1e-10. 512 registers of 8 bits estimate the similarity of candidates.

Equal sets form one class first, and only class representatives go on. A band's representatives are
linked to the least of them, not to each other. Candidates pass the registers' estimate, corrected for
registers that agree by chance, and then a check on the full sets. Where a band still holds more than
one component, pairs across its components are estimated in blocks, so no link between them is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    WORD_HASHES, arrow_schema, as_bytes, batch_of, begin, doc_texts, free_names, int_lists, lower_words, squeeze,
    stash, unsqueeze, unsqueezed, window_hashes,
)
from .components import components

SHINGLE_WORDS = 5
#: registers that are banded, and their mantissa bits; registers that are estimated from, and theirs
BAND_BUCKETS, BAND_BITS, SKETCH_BUCKETS, SKETCH_BITS = 128, 10, 512, 4
BANDS, EMPTY = BAND_BUCKETS // 4, 0xFF
#: probability that sketch registers of different values agree: equal leading zeros, then equal mantissas
COLLISION = 1 / 3 / 2**SKETCH_BITS
#: standard deviations of the estimate that a candidate may fall short of the threshold
SLACK = 5.0
#: representatives of one band that are compared as one block
BLOCK = 1024

_SIGNED = arrow_schema({
    "doc_id": pa.int64(), "n_shingles": pa.int64(), "digest": pa.binary(), "bands": pa.list_(pa.int64()),
    "sketch": pa.binary(),
})


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; fewer words are one shingle, no word is none."""
    words = lower_words(text)
    if not words:
        return np.empty(0, np.uint64)
    hashes = WORD_HASHES.of(words)
    return np.unique(window_hashes(hashes, min(SHINGLE_WORDS, len(words))))


def registers(hashes: np.ndarray, buckets: int, bits: int, kind: type) -> np.ndarray:
    """HyperMinHash registers of a sorted set of hashes; an empty bucket holds the largest value."""
    shift = np.uint64(64 - buckets.bit_length() + 1)
    first = np.searchsorted(hashes, np.arange(buckets, dtype=np.uint64) << shift)
    last = np.append(first[1:], len(hashes))
    out = np.full(buckets, np.iinfo(kind).max, kind)
    full = first < last
    # 53 of the bits behind the bucket's, as an exact float: exponent and mantissa give zeros and bits
    rest = (hashes[first[full]] << np.uint64(64 - int(shift))) >> np.uint64(11)
    mantissa, exponent = np.frexp(np.maximum(rest, 1).astype(np.float64))
    most = np.iinfo(kind).max >> bits
    zeros = np.minimum(53 - exponent, most - 1)
    out[full] = (zeros << bits) | ((mantissa - 0.5) * 2 ** (bits + 1)).astype(np.int64)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, bands, sketch): a band is four registers in a long; a digest names the set."""

    def sign(batches):
        for batch in batches:
            sizes, digests, bands, sketches = [], [], [], []
            for text in as_bytes(batch):
                hashes = shingle_set(text)
                sizes.append(len(hashes))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                bands.append(registers(hashes, BAND_BUCKETS, BAND_BITS, np.uint16).view(np.int64))
                sketches.append(registers(hashes, SKETCH_BUCKETS, SKETCH_BITS, np.uint8).tobytes())
            yield batch_of(_SIGNED, [batch.column("doc_id"), sizes, digests, int_lists(bands, pa.int64()), sketches])

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary")


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity and the number of buckets it rests on, row by row of two register arrays."""
    used = (a != EMPTY) | (b != EMPTY)
    n = np.maximum(used.sum(axis=-1), 1)
    agree = ((a == b) & used).sum(axis=-1) / n
    return np.maximum(0.0, (agree - COLLISION) / (1 - COLLISION)), n


def plausible(a: np.ndarray, b: np.ndarray, size_a, size_b, threshold: float) -> np.ndarray:
    """Could the sets reach the threshold, as far as their sizes and registers tell?

    The buckets used are a sample, without repetition, of the union's shingles; the allowance is that of
    a pair exactly at the threshold.
    """
    near, n = estimate(a, b)
    union = np.maximum((size_a + size_b) / (1 + threshold), n)
    spread = threshold * (1 - threshold) / n * ((union - n) / np.maximum(union - 1, 1) + COLLISION)
    sizes = np.minimum(size_a, size_b) >= (threshold - 1e-9) * np.maximum(size_a, size_b)
    return sizes & (near >= threshold - SLACK * np.sqrt(spread) - 2 / n)


def _sketch_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH_BUCKETS)


def _plausible_pairs(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b), those whose registers allow a link."""
    sides = [
        classes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
        for c in "ab"
    ]

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                sketches = [_sketch_rows(batch.column(f"sketch_{c}")) for c in "ab"]
                sizes = [batch.column(f"n_{c}").to_numpy() for c in "ab"]
                yield batch.select(["a", "b"]).filter(pa.array(plausible(*sketches, *sizes, threshold)))

    return pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(keep, "a long, b long")


def _verified(pairs: DataFrame, packed: DataFrame, percent: int) -> DataFrame:
    """Pairs that link on their full sets: 100 * shared >= percent * union."""
    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()

    def to_sets(batches):
        schema = arrow_schema({"doc_id": pa.int64(), "hashes": pa.binary()})
        for batch in batches:
            sets = [shingle_set(t or b"").tobytes() for t in unsqueezed(batch)]
            yield batch_of(schema, [batch.column("doc_id"), sets])

    sets = packed.join(needed, "doc_id").select("doc_id", "text").mapInArrow(to_sets, "doc_id long, hashes binary")
    sets = stash(sets.dropDuplicates(["doc_id"]), "sets")
    sides = [sets.select(F.col("doc_id").alias(c), F.col("hashes").alias(f"set_{c}")) for c in "ab"]

    def check(batches):
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(check, "a long, b long")


def _cross_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """Plausible pairs (a, b) of different components within a band, estimated block against block.

    ``members`` holds (band, value, among, rep, component, n, bands, sketch). A band's members are dealt
    into blocks of about ``BLOCK``; a row goes to the tiles of its block with every block of the band.
    A pair counts in the first band that it shares, so it comes once.
    """
    blocks = F.ceil(F.col("among") / BLOCK).cast("int")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "band", "value", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "rep", "component", "n", "bands", "sketch",
    )
    key = ["band", "value", "i", "j"]
    placed = tiles.repartition(*key).sortWithinPartitions(*key, "block", "rep")
    schema = arrow_schema({"a": pa.int64(), "b": pa.int64()})

    def pairs(table: pa.Table):
        block, reps, comps, sizes = (table.column(c).to_numpy() for c in ("block", "rep", "component", "n"))
        sketches = _sketch_rows(table.column("sketch"))
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        band = table.column("band")[0].as_py()
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        left = np.arange(len(reps)) if same else np.flatnonzero(block == block[0])
        found = []
        for x in left.tolist():
            others = np.flatnonzero((comps != comps[x]) & ((reps > reps[x]) if same else (block != block[x])))
            earlier = (bands[others, :band] == bands[x, :band]) & (bands[x, :band] != -1)
            others = others[~earlier.any(axis=1)]
            if len(others):
                ok = plausible(sketches[x], sketches[others], sizes[x], sizes[others], threshold)
                found.extend((x, y) for y in others[ok].tolist())
        ends = np.array(found, dtype=np.int64).reshape(-1, 2)
        low, high = reps[ends[:, 0]], reps[ends[:, 1]]
        return batch_of(schema, [np.minimum(low, high), np.maximum(low, high)])

    def work(batches):
        begin("neardup")
        for group in key_groups(batches, key):
            yield pairs(group)

    return placed.mapInArrow(work, "a long, b long")


def key_groups(batches, key: list[str]):
    """Tables of consecutive rows with one key, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in key]
        changes = np.zeros(batch.num_rows, bool)
        for c in columns:
            changes[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(changes).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            now = tuple(c[lo] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Documents link when ``100 * shared >= percent * union`` of their shingle sets; ``component_id`` is
    the smallest id reachable and ``kept`` tells whether it is the row's own. A null, empty or blank
    text has no shingles and links with nothing; so does a row without an id, which is kept. Rows that
    share an id count as one document. Other columns of ``docs`` are not looked at.
    """
    threshold = percent / 100
    texts = doc_texts(docs)
    signed = stash(signatures(texts), "signatures")
    able = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stash(
        able.groupBy("digest").agg(
            F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch"),
        ),
        "classes",
    )
    packed = squeeze(texts.where("doc_id is not null"))
    banded = classes.select("rep", F.posexplode("bands").alias("band", "value")).where("value <> -1")
    leaders = banded.groupBy("band", "value").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("among"))
    shared = stash(banded.join(leaders.where("among > 1"), ["band", "value"]), "banded")
    near = stash(classes.join(shared.select("rep").distinct(), "rep").select("rep", "n", "bands", "sketch"), "sketches")
    star = shared.where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    first = stash(_verified(stash(_plausible_pairs(star, near, threshold), "pairs"), packed, percent), "links")
    named = components(first).select(F.col("node").alias("rep"), "component")
    placed = shared.join(named, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("band", "value").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = mixed.where("lo <> hi").select("band", "value")
    members = placed.join(mixed, ["band", "value"]).join(near, "rep")
    across = stash(_cross_pairs(members, threshold).join(star, ["a", "b"], "left_anti"), "pairs")
    if not across.isEmpty():
        first = first.union(stash(_verified(across, packed, percent), "links"))
        named = components(first).select(F.col("node").alias("rep"), "component")
    membership = classes.join(named, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    found = signed.join(membership, "digest", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each_group(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest id.

    All columns stay. Rows that share an id are one document and leave one row; rows without an id and
    texts without words have no near duplicates and stay.
    """
    (own,) = free_names(docs.columns, "_kept_id")
    kept = near_duplicates(docs, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias(own))
    named = docs.where("doc_id is not null").withColumn("text", F.col("text").cast("string"))
    rows = squeeze(named).join(kept.distinct(), F.col("doc_id").cast("long") == F.col(own), "left_semi")
    return unsqueeze(rows.dropDuplicates(["doc_id"])).unionByName(docs.where("doc_id is null"))
