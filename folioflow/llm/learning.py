"""What the learned filters share: bounded samples of labelled rows and logistic regression in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, stash


def label_sample(labels: DataFrame, column: str, per_class: int) -> DataFrame:
    """About ``per_class`` labelled ids of each class, chosen by a hash of the id: (doc_id, label).

    The counts behind the shares cover all labels. An id that has both labels takes the larger; null
    ids and null labels take no part. The result is bounded by a little over 2 * ``per_class`` rows.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(column).cast("int")).alias("label"))
    )
    sizes = {row["label"]: row["count"] for row in known.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for label, size in sizes.items():
        share = F.when(F.col("label") == label, min(1.0, per_class / size)).otherwise(share)
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    return known.where(place < share).limit(3 * per_class)


def distinct_texts(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, ``column``) of each different text that has a label: the least id of the text, its largest label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias(column)
    )
    places = doc_texts(docs).select("doc_id", F.xxhash64("text").alias("place"))
    texts = places.join(known, "doc_id").groupBy("place")
    return stash(texts.agg(F.min("doc_id").alias("doc_id"), F.max(column).alias(column)).drop("place"), "texts")


def text_sample(docs: DataFrame, texts: DataFrame, column: str, per_class: int) -> DataFrame:
    """(doc_id, text, label) of a bounded sample of the texts that :func:`distinct_texts` gives, each once."""
    # bounded by the sample's size, see label_sample
    chosen = F.broadcast(label_sample(texts, column, per_class))
    sample = doc_texts(docs).join(chosen, "doc_id").withColumn("place", F.xxhash64("text"))
    return sample.dropDuplicates(["place"]).drop("place")


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(
    x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, ridge: float = 1e-4, rounds: int = 300
) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient steps on the mean log loss with a ridge penalty."""
    n = len(y)
    share = np.full(n, 1.0 / max(n, 1)) if weights is None else weights / weights.sum()
    w, b = np.zeros(x.shape[1]), 0.0
    if n == 0:
        return w, b
    ahead_w, ahead_b, t = w, b, 1.0
    step = 4.0 / (float(share @ (x * x).sum(axis=1)) + 1.0 + 4 * ridge)
    for _ in range(rounds):
        error = (sigmoid(x @ ahead_w + ahead_b) - y) * share
        new_w = ahead_w - step * (error @ x + ridge * ahead_w)
        new_b = ahead_b - step * error.sum()
        grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pull = (t - 1) / grown
        ahead_w, ahead_b = new_w + pull * (new_w - w), new_b + pull * (new_b - b)
        w, b, t = new_w, new_b, grown
    return w, float(b)


def calibrated(margin: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities (a logistic fit to one feature)."""
    spread = float(margin.std()) or 1.0
    w, b = fit_logistic((margin / spread)[:, None], y, weights, ridge=1e-3, rounds=400)
    return max(float(w[0]), 1e-6) / spread, b
