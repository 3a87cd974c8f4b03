"""Quality: base counts, and a logistic regression on hashed word and character n-grams.

Each family of n-grams (words, word pairs, character triples) is hashed into its own bins; a text is
the square roots of its shares. A last family holds how often a word repeats the one before it. The
regression learns from a bounded sample of labelled rows; its margins are calibrated on a part of the
sample that it did not learn from and compared with a fixed threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_HASHES, arrow_schema, as_bytes, batch_of, begin, doc_texts, mixed, window_hashes
from .learning import calibrated, distinct_texts, fit_logistic, sigmoid, text_sample

#: labelled rows of each class to learn from; bins of each family
SAMPLE_PER_CLASS, WORD_BINS, PAIR_BINS, CHAR_BINS = 1500, 2048, 1024, 2048
N_FEATURES = WORD_BINS + PAIR_BINS + CHAR_BINS + 1
#: a text is kept if it is good with at least this probability
THRESHOLD = 0.3
#: base rule: least words, and the largest share of repeated words in percent
MIN_WORDS, MAX_REPEATED = 50, 50

SYMBOLS = b"#*$%&|<>"
_BASE = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
         "n_repeat_words": pa.int64()}


def base_counts(text: bytes, hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text and its words' hashes."""
    raw = np.frombuffer(text, np.uint8)
    blanks = int(((raw == 32) | ((raw >= 9) & (raw <= 13))).sum())
    points = int(((raw & 0xC0) != 0x80).sum())
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n"):
        if line.strip():
            again += line in seen
            seen.add(line)
    triples = window_hashes(hashes, 3)
    repeated = 0
    if len(triples):
        _, place, counts = np.unique(triples, return_inverse=True, return_counts=True)
        twice = counts[place] > 1
        covered = np.zeros(len(hashes), bool)
        for shift in range(3):
            covered[shift : shift + len(twice)] |= twice
        repeated = int(covered.sum())
    return len(hashes), points - blanks, sum(map(text.count, (bytes([b]) for b in SYMBOLS))), again, repeated


def _shares(bins: np.ndarray, size: int) -> np.ndarray:
    counts = np.bincount(bins.astype(np.int64), minlength=size)
    return np.sqrt(counts / max(len(bins), 1))


def features(text: bytes, hashes: np.ndarray) -> np.ndarray:
    """The hashed n-grams of a text; an empty one has none."""
    raw = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
    triples = (raw[:-2] * 0x9E3779B1 ^ raw[1:-1] * 0x85EBCA6B ^ raw[2:] * 0xC2B2AE35) if len(raw) > 2 else raw[:0]
    triples = (triples * np.uint32(0x27D4EB2F)) >> np.uint32(32 - CHAR_BINS.bit_length() + 1)
    pairs = mixed(hashes[:-1], hashes[1:])
    same = np.count_nonzero(hashes[1:] == hashes[:-1]) / max(len(hashes), 1)
    return np.concatenate([
        _shares(hashes & np.uint64(WORD_BINS - 1), WORD_BINS), _shares(pairs & np.uint64(PAIR_BINS - 1), PAIR_BINS),
        _shares(triples, CHAR_BINS), [np.sqrt(same)],
    ])


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x @ self.weights + self.bias)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> QualityModel:
    """A model from ``labels`` (doc_id, quality 0 or 1); rows of one class alone keep every text.

    About ``per_class`` different texts of each class are read. Copies of a text count once, in the sample
    and in the classes' sizes; one with both labels is good.
    """
    texts = distinct_texts(docs, labels, "quality")
    sample = text_sample(docs, texts, "quality", per_class)
    schema = arrow_schema({"doc_id": pa.int64(), "label": pa.int32(), "x": pa.binary()})

    def extract(batches):
        begin("quality")
        for batch in batches:
            rows = [features(t, WORD_HASHES.of(t.lower().split())).astype(np.float16).tobytes() for t in as_bytes(batch)]
            yield batch_of(schema, [batch.column("doc_id"), batch.column("label").cast(pa.int32()), rows])

    rows = sorted(sample.mapInArrow(extract, "doc_id long, label int, x binary").collect(), key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return QualityModel(np.zeros(N_FEATURES), 4.0)
    x = np.stack([np.frombuffer(r["x"], np.float16).astype(np.float32) for r in rows])
    sizes = {r["label"]: r["count"] for r in texts.groupBy(F.col("quality").alias("label")).count().collect()}
    # classes weigh as they do among all labels, not as in the sample
    share = np.where(y == 1, sizes.get(1, 1) / y.sum(), sizes.get(0, 1) / (len(y) - y.sum()))
    aside = np.arange(len(y)) % 4 == 3
    w, b = fit_logistic(x[~aside], y[~aside], share[~aside], ridge=3e-5, rounds=400)
    if y[aside].min(initial=1) == y[aside].max(initial=0):
        return QualityModel(w, b)
    slope, offset = calibrated(x[aside] @ w + b, y[aside], share[aside])
    return QualityModel(slope * w, slope * b + offset)


def assess(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, the base counts, base_failed, score, kept) for every row of ``docs``.

    ``score`` is the probability of a good text; ``kept`` is false where the base rule fails, else whether
    the score reaches the threshold. A null or empty text has no words and fails. Other columns are not
    looked at; the model's size is fixed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = arrow_schema({"doc_id": pa.int64(), **_BASE, "base_failed": pa.bool_(), "score": pa.float64(), "kept": pa.bool_()})

    def work(batches):
        begin("quality")
        model = shared.value
        for batch in batches:
            counts, margins = [], []
            for text in as_bytes(batch):
                hashes = WORD_HASHES.of(text.split())
                counts.append(base_counts(text, hashes))
                lowered = text.lower()
                hashes = hashes if lowered == text else WORD_HASHES.of(lowered.split())
                margins.append(float(features(text, hashes) @ model.weights))
            columns = list(zip(*counts)) or [[]] * len(_BASE)
            n_words, repeated = np.array(columns[0], np.int64), np.array(columns[4], np.int64)
            failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEATED * n_words)
            score = sigmoid(np.array(margins) + model.bias)
            yield batch_of(schema, [batch.column("doc_id"), *columns, failed, score, ~failed & (score >= threshold)])

    return doc_texts(docs).mapInArrow(
        work,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, score double, kept boolean",
    )
