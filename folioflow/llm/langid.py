"""Language by compression: the language whose dictionary compresses a text best.

For each language a zstandard raw-content dictionary is cut from labelled texts. A text is lower-cased
and compressed with every dictionary, in blocks short enough for the dictionary to matter, and the least total size
wins. The margin to the second says how sure that is; a narrow one is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, free_names, stash

#: per language: labelled texts to learn from, and characters taken of each; all of them make the dictionary
SAMPLE_TEXTS, SAMPLE_CHARS = 128, 768
BLOCK_BYTES, LEVEL = 2048, 5
#: share of the second best size that the best must save at least; sizes are whole bytes, so of a short
#: text a single byte is more than that, and only a tie is rejected
MARGIN = 0.004
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


@dataclass
class LanguageModel:
    #: language -> raw dictionary content, the most frequent language first
    contents: dict[str, bytes]

    def compressors(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        out = []
        for lang, content in self.contents.items():
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            out.append((lang, zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_dict_id=False)))
        return out


def learn(docs: DataFrame) -> LanguageModel:
    """Dictionaries from rows with a text and a non-null lang.

    Counts and samples are of different texts, so copies of one count once. The texts are a sample per
    language, bounded on its own: those of the ``SAMPLE_TEXTS`` smallest hashes, with ``SAMPLE_CHARS``
    characters at most of each. Without labelled rows there are no languages.
    """
    known = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where("lang is not null and text is not null").withColumn("place", F.xxhash64("text"))
    texts = stash(known.select("lang", "place").distinct(), "texts")
    sizes = {r["lang"]: r["count"] for r in texts.groupBy("lang").count().collect()}
    # the smallest hashes as numbers without sign, about 2 * SAMPLE_TEXTS a language, of which the least are kept
    share = F.lit(0.0)
    for lang, size in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, 2 * SAMPLE_TEXTS / size)).otherwise(share)
    spot = F.pmod("place", F.lit(1 << 52)) / float(1 << 52)
    least: dict[str, list] = {}
    for r in texts.where(spot < share).select("lang", "place", spot.alias("spot")).collect():
        least.setdefault(r["lang"], []).append((r["spot"], r["place"]))
    chosen = [(lang, place) for lang, found in least.items() for _, place in sorted(found)[:SAMPLE_TEXTS]]
    # the part of a long text is taken at a place that its hash chooses
    room = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    begin = (F.pmod(F.xxhash64("text", F.lit(1)), room) + 1).cast("int")
    part = F.substr("text", begin, F.lit(SAMPLE_CHARS))
    # bounded: SAMPLE_TEXTS of each language; copies have the same part
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "lang string, place long"))
    found = known.join(wanted, ["lang", "place"]).groupBy("lang", "place").agg(F.min(part).alias("part"))
    rows = found.collect()
    contents = {}
    for lang in sorted(sizes, key=lambda x: (-sizes[x], x)):
        parts = [r["part"] for r in sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["place"], r["part"]))]
        content = "\n".join(dict.fromkeys(parts)).lower().encode()
        if len(content) >= 8:
            contents[lang] = content
    return LanguageModel(contents)


def identify(text: str | None, compressors: list) -> tuple[str, float, float]:
    """(language, score, margin) of one whole text; the margin is 0 at a tie."""
    if not text or not compressors or not _LETTER.search(text):
        return UNKNOWN, 0.0, 0.0
    raw = text.lower().encode()
    blocks = [raw[at : at + BLOCK_BYTES] for at in range(0, len(raw), BLOCK_BYTES)]
    sizes = np.array([sum(len(c.compress(b)) for b in blocks) for _, c in compressors])
    best = int(sizes.argmin())
    others = np.delete(sizes, best)
    margin = float(1.0 - sizes[best] / others.min()) if len(others) else 1.0
    score = 1.0 - 0.5 * float(np.exp(-40.0 * margin))
    return compressors[best][0], score, margin


def added_names(docs: DataFrame) -> list[str]:
    """The names of the columns that :func:`predict` adds, apart from those that ``docs`` has."""
    return free_names(docs.columns, "_lang", "_lang_score", "_lang_rejected")


def predict(docs: DataFrame, model: LanguageModel, margin: float = MARGIN) -> DataFrame:
    """``docs`` with ``_lang``, ``_lang_score`` (0 to 1), ``_lang_rejected``; rows and columns stay.

    A null text, or one without a letter, is ``und`` with score 0 and rejected. A tie goes to the more
    frequent language with score 0.5 and is rejected, whatever the length. The dictionaries are bounded by
    their samples; see :func:`added_names` for columns of those names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lang, degree, rejected = added_names(docs)
    schema = docs.withColumns({lang: F.lit(""), degree: F.lit(0.0), rejected: F.lit(False)}).schema

    def work(batches):
        begin("langid")
        compressors = shared.value.compressors()
        for batch in batches:
            found = [identify(t, compressors) for t in batch.column("text").to_pylist()]
            yield (
                batch.append_column(lang, pa.array([f[0] for f in found], pa.string()))
                .append_column(degree, pa.array([f[1] for f in found], pa.float64()))
                .append_column(rejected, pa.array([f[0] == UNKNOWN or f[2] < margin for f in found], pa.bool_()))
            )

    return docs.mapInArrow(work, schema)
