"""From documents to packed sequences: five stages, each written and read again before the next.

Toxic documents go, then those whose language cannot be told, then all but one of each group of near
duplicates, then passages that repeat across documents; what is left is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import common, langid, neardup, packing, substrings, toxicity
from folioflow.session import read_table

#: SQL cannot express the learned stages; the tests hold run() against plain Python instead
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon learned from ``labels`` does not call toxic.

    A null or empty text scores as one without any match. A score at the threshold is toxic. Repeated rows
    go or stay alike; without labels of both classes nothing goes.
    """
    common.prepare(spark)
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    toxic = toxicity.added_names(docs)[1]
    return toxicity.score(docs, model).where(~F.col(toxic)).select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a sufficient margin.

    Null and empty texts and those without a letter go, and so do ties of two languages. Repeated rows go
    or stay alike; without any ``lang`` nothing can be told and all rows go.
    """
    common.prepare(spark)
    rejected = langid.added_names(docs)[2]
    return langid.predict(docs, langid.learn(docs)).where(~F.col(rejected)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a similarity of 0.8 or more on 5-word shingles.

    Of a group the smallest doc_id stays. Null and empty texts and rows without an id stay; rows that
    share an id leave one.
    """
    common.prepare(spark)
    return neardup.one_of_each_group(docs).select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words under 50-word windows that a smaller document also holds.

    Every row stays, also one whose text becomes empty. Texts that lose nothing stay as they are, null ones
    null; rows without an id neither lose words nor take them from others; rows that share an id lose alike.
    """
    common.prepare(spark)
    rest = substrings.remove_repeats(docs, keep_untouched=True)
    n_removed = substrings.added_names(docs)[1]
    n_chars = F.when(F.col(n_removed) > 0, F.length("text")).otherwise(F.col("n_chars"))
    return rest.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens with their ids.

    A null or empty text is its end id alone; repeated rows and rows without an id are packed like any.
    """
    common.prepare(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every other stage is written to the shared folder and reread."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stash(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
