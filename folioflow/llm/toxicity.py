"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases a text, maps homoglyphs and digits that stand for letters to plain letters, and
turns everything that is no letter into blanks. Lexicon entries are beginnings of words (a closing
blank makes one a whole word); each weighs its log odds between toxic and clean labelled documents.
Phrases that hold an entry but are found in clean documents only are exceptions: a match inside one
does not count. The weights found, alone and relative to the text's length, give a calibrated score.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_strings, batch_of, begin, free_names, stash
from .learning import calibrated, distinct_texts, fit_logistic, sigmoid, text_sample

#: labelled documents of each class to learn from
SAMPLE_PER_CLASS = 4000
#: entries: least and greatest length of a word's beginning, least toxic documents, least log odds
MIN_LETTERS, MAX_LETTERS, MIN_DOCUMENTS, MIN_WEIGHT = 4, 14, 4, 2.5
THRESHOLD = 0.3

# Letters of other scripts and signs that look like Latin letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h",
    "ԁ": "d", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ſ": "s",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}


class _Fold(dict):
    """Translation table, filled as characters turn up; signs inside words stand for letters."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        value = self[code] = HOMOGLYPHS.get(char) or (char if char.isalpha() else " ")
        return value


_fold = _Fold()


def folded(text: str) -> str:
    """Lower-case words, one blank between two, one at both ends; whatever stood between counts alike."""
    return f" {' '.join(text.lower().translate(_fold).split())} "


@dataclass
class ToxicityModel:
    #: beginnings of words, led by a blank, with their weights
    entries: dict[str, float] = field(default_factory=dict)
    #: phrases, led and closed by a blank, in which entries do not count
    exceptions: set[str] = field(default_factory=set)
    weights: tuple[float, float] = (0.0, 0.0)
    bias: float = -3.0

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            found.add_word(entry, (len(entry), weight, entry in self.exceptions))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), self.entries.get(phrase, 0.0), True))
        if not len(found):
            return None
        found.make_automaton()
        return found


def matched(automaton: ahocorasick.Automaton | None, text: str) -> float:
    """Sum of the weights of all entries that count; of those that begin at one place, the heaviest."""
    if automaton is None:
        return 0.0
    hits: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight, exempt) in automaton.iter(text):
        start = end - size + 1
        if exempt:
            spared.append((start, end))
        if weight > hits.get(start, 0.0):
            hits[start] = weight
    spared.sort()
    total, reach, at = 0.0, -1, 0
    # both by place: a hit counts unless an exception that began before it reaches beyond it
    for start in sorted(hits):
        while at < len(spared) and spared[at][0] <= start:
            reach = max(reach, spared[at][1])
            at += 1
        if start >= reach:
            total += hits[start]
    return total


def features(total: float, text: str) -> tuple[float, float]:
    """What was found in a folded text, alone and per hundred of its words."""
    return math.log1p(total), math.log1p(100.0 * total / max(len(text.split()), 1)) if total else 0.0


def _beginnings(text: str) -> set[str]:
    out: set[str] = set()
    for word in set(text.split()):
        closed = word + " "
        for size in range(MIN_LETTERS, min(len(closed), MAX_LETTERS) + 1):
            out.add(closed[:size])
    return out


def _entries(rows, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Shortest telling beginnings, each drawn out while it keeps nearly all of its toxic documents."""
    toxic = {r["part"]: r["toxic"] for r in rows}
    clean = {r["part"]: r["clean"] for r in rows}
    longer = defaultdict(list)
    for part in toxic:
        longer[part[:-1]].append(part)

    def weight(part: str) -> float:
        return math.log((toxic[part] + 0.5) / (n_toxic + 1)) - math.log((clean[part] + 0.5) / (n_clean + 1))

    telling = [p for p in toxic if toxic[p] >= MIN_DOCUMENTS and weight(p) >= MIN_WEIGHT and clean[p] * 20 <= toxic[p]]
    chosen: dict[str, float] = {}
    for part in sorted(telling, key=lambda p: (len(p), p)):
        if any(part[:k] in chosen for k in range(MIN_LETTERS, len(part))):
            continue
        while True:
            wider = max(longer[part], key=lambda p: (toxic[p], p), default=None)
            if wider is None or toxic[wider] < 0.95 * toxic[part]:
                break
            part = wider
        chosen[part] = weight(part)
    return {" " + p: chosen[p] for p in sorted(chosen)}


def learn(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel:
    """A model from the labelled documents; ``labels`` holds (doc_id, toxic) of rows to learn from.

    About ``per_class`` different texts of each class are read, chosen by a hash of the least id of each.
    Copies of a text count once, in the sample and in the classes' sizes; one with both labels is toxic.
    Without toxic or without clean rows the model has no entries and scores every text alike.
    """
    texts = distinct_texts(docs, labels, "toxic")
    sample = stash(text_sample(docs, texts, "toxic", per_class), "sample")

    def count(batches):
        begin("toxicity")
        schema = arrow_schema({"part": pa.string(), "toxic": pa.int64(), "clean": pa.int64()})
        found = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(as_strings(batch), batch.column("label").to_pylist()):
                parts = _beginnings(folded(text))
                parts.add("")
                found[1 - label].update(parts)
                if sum(map(len, found)) > 1_000_000:
                    yield batch_of(schema, _counted(found))
                    found = (Counter(), Counter())
        yield batch_of(schema, _counted(found))

    counts = (
        sample.mapInArrow(count, "part string, toxic long, clean long")
        .groupBy("part").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("part") == "") | (F.col("toxic") >= MIN_DOCUMENTS) & (F.col("clean") * 10 <= F.col("toxic")))
    )
    # bounded by the sample: parts of at least MIN_DOCUMENTS of its toxic texts
    rows = counts.collect()
    total = next((r for r in rows if r["part"] == ""), None)
    if total is None or not total["toxic"] or not total["clean"]:
        return ToxicityModel()
    model = ToxicityModel(_entries([r for r in rows if r["part"]], total["toxic"], total["clean"]))
    model.exceptions = _exceptions(sample, model)
    sizes = {r["label"]: r["count"] for r in texts.groupBy(F.col("toxic").alias("label")).count().collect()}
    fit = sorted(tuple(r) for r in _features(sample, model).collect())
    x = np.array([found[:2] for found in fit])
    y = np.array([found[2] for found in fit], dtype=float)
    # classes weigh as they do among all labels, not as in the sample
    share = np.where(y == 1, sizes.get(1, 1) / max(y.sum(), 1), sizes.get(0, 1) / max(len(y) - y.sum(), 1))
    w, b = fit_logistic(x, y, share, ridge=1e-4, rounds=800)
    slope, offset = calibrated(x @ w + b, y, share)
    model.weights, model.bias = (float(slope * w[0]), float(slope * w[1])), slope * b + offset
    return model


def _counted(found: tuple[Counter, Counter]) -> list[list]:
    toxic, clean = found
    parts = list(toxic.keys() | clean.keys())
    return [parts, [toxic[p] for p in parts], [clean[p] for p in parts]]


def _exceptions(sample: DataFrame, model: ToxicityModel) -> set[str]:
    """Two-word phrases around matches that clean documents hold and toxic ones do not."""

    def phrases(batches):
        begin("toxicity")
        automaton = model.automaton()
        schema = arrow_schema({"phrase": pa.string(), "label": pa.int32()})
        for batch in batches:
            out: list[list] = [[], []]
            for text, label in zip(as_strings(batch), batch.column("label").to_pylist()):
                text = folded(text)
                found = set()
                for end, (size, _, _) in automaton.iter(text) if automaton else ():
                    start = end - size + 1
                    stop = text.index(" ", start + 1)
                    before, after = text.rfind(" ", 0, start), text.find(" ", stop + 1)
                    if before >= 0:
                        found.add(text[before : stop + 1])
                    if after >= 0:
                        found.add(text[start : after + 1])
                out[0].extend(found)
                out[1].extend([label] * len(found))
            yield batch_of(schema, out)

    counts = sample.mapInArrow(phrases, "phrase string, label int").groupBy("phrase").agg(
        F.sum(F.col("label")).alias("toxic"), F.sum(1 - F.col("label")).alias("clean")
    )
    # bounded by the sample, too
    return {r["phrase"] for r in counts.where("clean >= 3 and toxic = 0").collect()}


def text_features(automaton, texts: list[str]) -> np.ndarray:
    """The features of whole texts, as they are fitted and as they are scored."""
    low = map(folded, texts)
    return np.array([features(matched(automaton, t), t) for t in low], float).reshape(-1, 2)


def _features(sample: DataFrame, model: ToxicityModel) -> DataFrame:
    def work(batches):
        begin("toxicity")
        schema = arrow_schema({"found": pa.float64(), "dense": pa.float64(), "label": pa.int32()})
        automaton = model.automaton()
        for batch in batches:
            x = text_features(automaton, as_strings(batch))
            yield batch_of(schema, [x[:, 0], x[:, 1], batch.column("label").cast(pa.int32())])

    return sample.mapInArrow(work, "found double, dense double, label int")


def score_texts(model: ToxicityModel, automaton, texts: list[str]) -> np.ndarray:
    """Scores between 0 and 1; an empty text scores as one without any match."""
    return sigmoid(text_features(automaton, texts) @ np.array(model.weights) + model.bias)


def added_names(docs: DataFrame) -> list[str]:
    """The names of the columns that :func:`score` adds: ``_toxicity`` and ``_toxic``, unless ``docs`` has such."""
    return free_names(docs.columns, "_toxicity", "_toxic")


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``_toxicity`` (0 to 1) and ``_toxic`` (score >= threshold); all rows and columns stay.

    A null text scores like an empty one; see :func:`added_names` for columns of those names. The model's
    size is bounded by the sample it was learned from.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    degree, flag = added_names(docs)
    schema = docs.withColumns({degree: F.lit(0.0), flag: F.lit(False)}).schema

    def work(batches):
        begin("toxicity")
        model = shared.value
        automaton = model.automaton()
        for batch in batches:
            values = score_texts(model, automaton, [t or "" for t in batch.column("text").to_pylist()])
            yield batch.append_column(degree, pa.array(values, pa.float64())).append_column(
                flag, pa.array(values >= threshold)
            )

    return docs.mapInArrow(work, schema)
