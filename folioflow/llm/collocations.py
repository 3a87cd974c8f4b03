"""Phrase collocations counted inside the distinct chunks of a prefix-free parse.

A text is split into pieces and words. Wherever a window of ``OVERLAP`` words hashes to a trigger, a new
chunk begins; the chunk before it runs on to the end of that window. So two chunks share ``OVERLAP``
words, no chunk is the beginning of another, and equal passages fall into equal chunks wherever they
stand. The dictionary holds every distinct chunk of a language once, with its frequency in the parse.

Phrases of up to ``OVERLAP + 1`` words are counted in the dictionary, times the chunk's frequency. A
phrase belongs to the chunk in whose own part it starts: the words before the overlap, which is counted
with the next chunk. Passes over the dictionary count words, pairs of frequent words, longer phrases made
of frequent pairs, and at last the phrases that these counts let through. What the passes tell each other
is a bit table of fixed size: a set bit may be shared, so it can let a phrase through but never drop one,
and the last count is exact, by the words themselves.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_HASHES, arrow_schema, batch_of, batch_rows, mixed, stash, window_hashes

#: words two neighbouring chunks share: phrases have one more at most
OVERLAP, LONGEST = 4, 5
#: one window of OVERLAP words in so many is a trigger
TRIGGER = 32
MIN_COUNT, KEPT = 100, 2000
UNKNOWN = "und"
#: a bit table has 2^26 bits (8 MB), kept in segments of 8 KB
BITS, SEGMENT_BITS = 26, 16
#: entries a task counts before it passes them on, pairs it holds before it adds them up
HELD, HELD_KEYS = 400_000, 2_000_000
#: chunks are short, so many of them make a batch
BATCH_CHUNKS = 40_000

# Characters that end a piece, all as line ends; A-Z in lower case.
_PIECE_ENDS = b".,;:!?\x0b\x0c\r"
_FOLD = bytes.maketrans(_PIECE_ENDS, b"\n" * len(_PIECE_ENDS))

_CHUNKS = arrow_schema({"lang": pa.string(), "chunk": pa.binary(), "own": pa.int32(), "times": pa.int64()})
_WORDS = arrow_schema({"lang": pa.string(), "phrase": pa.binary(), "times": pa.int64()})
_COUNTED = arrow_schema({"key": pa.int64(), "times": pa.int64()})
_SEGMENTS = arrow_schema({"segment": pa.int32(), "bits": pa.binary()})


def pieces(text: bytes) -> list[list[bytes]]:
    """The words of a text, piece by piece, A-Z lower-cased."""
    return [p.split() for p in text.lower().translate(_FOLD).split(b"\n")]


def chunks(text: bytes) -> list[tuple[bytes, int]]:
    """The parse of a text: chunks as words joined by blanks, each with the number of its own words."""
    parts = [p for p in pieces(text) if p]
    words = [w for p in parts for w in p]
    ends = np.cumsum([len(p) for p in parts])
    hashes = window_hashes(WORD_HASHES.of(words), OVERLAP)
    triggers = np.nonzero(hashes % np.uint64(TRIGGER) == 0)[0]
    # a window that runs over the end of its piece is none, one at its beginning changes nothing
    held = np.searchsorted(ends, triggers, side="right")
    inside = triggers + OVERLAP <= ends[held] if len(triggers) else np.empty(0, bool)
    cuts: dict[int, list[int]] = {}
    for place, piece in zip(triggers[inside].tolist(), held[inside].tolist()):
        cuts.setdefault(piece, []).append(place)
    out, begin = [], 0
    for number, part in enumerate(parts):
        starts = [0, *(c - begin for c in cuts.get(number, ()) if c > begin)]
        for at, after in zip(starts, starts[1:]):
            out.append((b" ".join(part[at : after + OVERLAP]), after - at))
        out.append((b" ".join(part[starts[-1] :]), len(part) - starts[-1]))
        begin += len(part)
    return out


def dictionary(docs: DataFrame) -> DataFrame:
    """(lang, chunk, own, times): every distinct chunk of a language with its frequency in the parse.

    A null text is empty and has no chunks; a null lang is ``und``.
    """

    def parse(batches):
        found: dict[str, Counter] = {}
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for lang, text in zip(batch.column("lang").to_pylist(), texts):
                found.setdefault(lang, Counter()).update(chunks(text or b""))
                if sum(map(len, found.values())) > HELD:
                    yield from map(_chunk_rows, found, found.values())
                    found = {}
        yield from map(_chunk_rows, found, found.values())

    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text")
    )
    parsed = texts.mapInArrow(parse, "lang string, chunk binary, own int, times long")
    # the own part follows from the chunk's words, since no chunk is the beginning of another
    return stash(parsed.groupBy("lang", "chunk", "own").agg(F.sum("times").alias("times")), "chunks")


def _chunk_rows(lang: str, found: Counter) -> pa.RecordBatch:
    return batch_of(_CHUNKS, [[lang] * len(found), [k[0] for k in found], [k[1] for k in found], list(found.values())])


# -- bit tables ------------------------------------------------------------------------------


def bit_table(keys: DataFrame) -> np.ndarray:
    """Bits of all 64-bit keys in the column ``key``, put together segment by segment; its size does not depend on the keys."""
    segments = 1 << (BITS - SEGMENT_BITS)
    place = F.shiftrightunsigned("key", 64 - BITS).cast("int")
    spots = keys.select(
        F.shiftright(place, SEGMENT_BITS).alias("segment"), place.bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)).alias("spot")
    )

    def gather(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            numbers, spots = (batch.column(c).to_numpy() for c in ("segment", "spot"))
            order = np.argsort(numbers, kind="stable")
            cuts = np.nonzero(np.diff(numbers[order]))[0] + 1
            for part in np.split(order, cuts):
                if len(part):
                    bits = held.setdefault(int(numbers[part[0]]), np.zeros(1 << SEGMENT_BITS, bool))
                    bits[spots[part]] = True
        rows = [[k, np.packbits(b).tobytes()] for k, b in held.items()]
        yield batch_of(_SEGMENTS, list(zip(*rows)) or [[], []])

    # a segment's keys meet in one task, at most as many as it has bits
    made = spots.distinct().repartition(min(64, segments), "segment").mapInArrow(gather, "segment int, bits binary")
    table = np.zeros(1 << (BITS - 3), np.uint8)
    width = 1 << (SEGMENT_BITS - 3)
    for row in made.collect():
        table[row["segment"] * width : (row["segment"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return table


def _set(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    places = (keys >> np.uint64(64 - BITS)).astype(np.int64)
    return (table[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 > 0


# -- the passes ------------------------------------------------------------------------------


class _Batch:
    """The words of a batch of chunks, flat: numbers of distinct words, and where phrases may start."""

    def __init__(self, batch: pa.RecordBatch):
        langs = batch.column("lang").dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        listed = pc.split_pattern(batch.column("chunk"), " ")
        flat = listed.flatten().dictionary_encode()
        self.words, self.index = flat.dictionary, flat.indices.to_numpy()
        sizes = listed.value_lengths().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
        #: words from here to the chunk's end, and whether a phrase may start here
        self.left = sizes[row] - place
        self.own = place < batch.column("own").to_numpy()[row]
        self.times = batch.column("times").to_numpy()[row]
        self.lang = langs.indices.to_numpy()[row]

    def hashes(self) -> np.ndarray:
        """Hashes of all words, seasoned with the language."""
        words = WORD_HASHES.of(self.words.to_numpy(zero_copy_only=False).tolist())[self.index]
        return mixed(words, WORD_HASHES.of([x.encode() for x in self.langs])[self.lang]) if len(words) else words

    def phrases(self, pairs: np.ndarray):
        """(size, hash of the phrase from every place, the places where all pairs of one are in the table)."""
        hashes = self.hashes()
        linked = np.zeros(len(hashes), bool)
        told = hashes.copy()
        told[:-1] = mixed(hashes[:-1], hashes[1:])
        linked[:-1] = (self.left[:-1] > 1) & _set(pairs, told[:-1])
        reach = linked.copy()
        for size in range(2, LONGEST + 1):
            if size > 2:
                # a phrase one word longer needs the next pair, too
                step, inner = size - 2, max(len(hashes) - size + 1, 0)
                reach[:inner] &= linked[step : step + inner]
                reach[inner:] = False
                told[:inner] = mixed(told[:inner], hashes[size - 1 : size - 1 + inner])
            yield size, told, np.nonzero(reach & self.own)[0]


def _sums(places: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers per place; exact, since sums of a batch stay far below 2^53."""
    return np.bincount(places, times, minlength=n).astype(np.int64)


def word_counts(parsed: DataFrame) -> DataFrame:
    """(lang, phrase, times) of every word, from the chunks' own parts."""

    def count(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            b = _Batch(batch)
            n = len(b.words)
            sums = _sums((b.lang * n + b.index)[b.own], b.times[b.own], n * len(b.langs))
            found = np.nonzero(sums)[0]
            langs = pa.array(b.langs, pa.string()).take(pa.array(found // n))
            yield batch_of(_WORDS, [langs, b.words.take(pa.array(found % n)), sums[found]])

    counted = parsed.mapInArrow(count, "lang string, phrase binary, times long")
    return stash(counted.groupBy("lang", "phrase").agg(F.sum("times").alias("times")), "words")


def _key_counts(parsed: DataFrame, table: np.ndarray, found, least: int) -> DataFrame:
    """Keys that ``found`` gives for a batch and a bit table, with their counts, if those reach ``least``."""
    shared = parsed.sparkSession.sparkContext.broadcast(table)

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                held.extend(found(_Batch(batch), shared.value))
            if sum(len(k) for k, _ in held) > HELD_KEYS:
                yield _key_rows(held)
                held = []
        yield _key_rows(held)

    counted = parsed.mapInArrow(count, "key long, times long")
    return counted.groupBy("key").agg(F.sum("times").alias("times")).where(F.col("times") >= least)


def _key_rows(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    keys, times = (np.concatenate(x) for x in zip(*held)) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])[0]
    return batch_of(_COUNTED, [keys[first].view(np.int64), np.add.reduceat(times, first) if len(keys) else times])


def _pairs(b: _Batch, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of neighbouring words that are both in the table."""
    hashes = b.hashes()
    known = _set(words, hashes)
    at = np.nonzero(b.own[:-1] & (b.left[:-1] > 1) & known[:-1] & known[1:])[0]
    return [(mixed(hashes[at], hashes[at + 1]), b.times[at])]


def _longer(b: _Batch, pairs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(told[at], b.times[at]) for size, told, at in b.phrases(pairs) if size > 2]


def _exact(parsed: DataFrame, pairs: np.ndarray, longer: np.ndarray) -> DataFrame:
    """(lang, phrase, times) of the phrases of 2 to LONGEST words that the tables let through, by their words."""
    shared = parsed.sparkSession.sparkContext.broadcast((pairs, longer))

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            if batch.num_rows:
                _count_phrases(_Batch(batch), *shared.value, found)
            if len(found) > HELD:
                yield _phrase_rows(found)
                found = Counter()
        yield _phrase_rows(found)

    counted = parsed.mapInArrow(count, "lang string, phrase binary, times long")
    return counted.groupBy("lang", "phrase").agg(F.sum("times").alias("times"))


def _count_phrases(b: _Batch, pairs: np.ndarray, longer: np.ndarray, found: Counter) -> None:
    words = b.words.to_numpy(zero_copy_only=False)
    for size, told, at in b.phrases(pairs):
        if size > 2:
            at = at[_set(longer, told[at])]
        _, first, same = np.unique(told[at], return_index=True, return_inverse=True)
        spots = at[:, None] + np.arange(size)
        phrases = b.index[spots]
        # places of one hash hold the same words; should they ever differ, each counts by its own words
        if (phrases == phrases[first[same]]).all() and (b.lang[at] == b.lang[at[first[same]]]).all():
            counted = zip(first.tolist(), _sums(same, b.times[at], len(first)).tolist())
        else:
            counted = enumerate(b.times[at].tolist())
        for place, times in counted:
            found[b.langs[b.lang[at[place]]], b" ".join([words[i] for i in phrases[place]])] += times


def _phrase_rows(found: Counter) -> pa.RecordBatch:
    return batch_of(_WORDS, [[k[0] for k in found], [k[1] for k in found], list(found.values())])


def _keys(words: DataFrame) -> DataFrame:
    schema = arrow_schema({"key": pa.int64()})

    def work(batches):
        for batch in batches:
            langs, phrases = (batch.column(c).to_pylist() for c in ("lang", "phrase"))
            keys = mixed(WORD_HASHES.of(phrases), WORD_HASHES.of([x.encode() for x in langs])) if langs else np.empty(0, np.uint64)
            yield batch_of(schema, [keys.view(np.int64)])

    return words.select("lang", "phrase").mapInArrow(work, "key long")


def counts(docs: DataFrame, least: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, n) and (lang, phrase, n_words, times) of all words and phrases that occur ``least`` times or more."""
    parsed = dictionary(docs)
    with batch_rows(docs.sparkSession, BATCH_CHUNKS):
        words = word_counts(parsed)
        totals = words.groupBy("lang").agg(F.sum("times").alias("n"))
        frequent = words.where(F.col("times") >= least)
        pairs = bit_table(_key_counts(parsed, bit_table(_keys(frequent)), _pairs, least))
        longer = bit_table(_key_counts(parsed, pairs, _longer, least))
        both = frequent.unionByName(_exact(parsed, pairs, longer).where(F.col("times") >= least))
        text = F.col("phrase").cast("string")
        sized = both.select("lang", text.alias("phrase"), F.size(F.split(text, " ")).alias("n_words"), "times")
        return totals, stash(sized, "phrases")


def collocations(docs: DataFrame, least: int = MIN_COUNT, kept: int = KEPT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of every language.

    ``a`` is the phrase's count, ``l`` and ``r`` those of its parts at the cut that scores least (of equal
    scores the one after fewer words), ``n`` all words of the language. The score is the whole part of
    1000 a n / (l r), in exact decimals. A phrase inside a longer one with the same count is dropped.
    The first ``kept`` of a language stay, by score, count and phrase. Null texts are empty, a null lang
    is ``und``, repeated rows count as often as they occur, an empty table gives no rows; other columns
    are not looked at.
    """
    totals, found = counts(docs, least)
    found = found.select("lang", "phrase", "n_words", "times")
    candidates = found.where("n_words > 1")
    # a phrase keeps its count in some longer one just when it does in one a word longer
    inner = candidates.where("n_words > 2").select(
        "lang", "times", F.explode(F.array(
            F.expr("substring_index(phrase, ' ', n_words - 1)"), F.expr("substring_index(phrase, ' ', 1 - n_words)")
        )).alias("phrase"),
    )
    left = candidates.join(inner, ["lang", "phrase", "times"], "left_anti")
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1))).select(
        "lang", "phrase", F.col("times").alias("a"), "k",
        F.expr("substring_index(phrase, ' ', k)").alias("_first"),
        F.expr("substring_index(phrase, ' ', k - n_words)").alias("_rest"),
    )
    for side, name in (("_first", "l"), ("_rest", "r")):
        part = found.select("lang", F.col("phrase").alias(side), F.col("times").alias(name))
        cuts = cuts.join(part, ["lang", side])
    cuts = cuts.join(totals, "lang")
    whole = "cast({} as decimal(38,0))".format
    score = F.expr(
        f"({whole('cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(17,0))')}"
        f" div {whole('cast(l as decimal(17,0)) * cast(r as decimal(17,0))')})"
    )
    scored = cuts.select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("_cut"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min("_cut").alias("_cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    flat = best.select("lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")
    ranked = flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
