"""The numbered operators bound to the test tables, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from . import (
    bytebpe, collocations, common, langid, lm, neardup, neighbours, orderprint, packing, quality, substrings, tokenfiles,
    toxicity, whitening,
)

BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: the same rows in SQL, where SQL can express an operator
SQL: dict[str, str] = {}


def _query(builder):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return builder(common.prepare(spark), folder)

    run.__name__, run.__doc__ = builder.__name__, builder.__doc__
    BUILDERS[builder.__name__] = run
    return run


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents")


@_query
def op1_packing(spark, folder):
    """Pieces of all documents in sequences of at most 2048 tokens."""
    pieces = packing.pack(_documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@_query
def op2_near_duplicates(spark, folder):
    """Near-duplicate components of all documents, similarity 0.85 on 5-word shingles."""
    return neardup.near_duplicates(_documents(spark, folder))


@_query
def op3_quality(spark, folder):
    """Base counts and the learned verdict on every whole text."""
    docs = _documents(spark, folder)
    labels = read_table(spark, folder, "labels").select("doc_id", "quality")
    return quality.assess(docs, quality.learn(docs, labels))


@_query
def op4_byte_bpe(spark, folder):
    """Every whole text encoded by the rank file and decoded again."""
    coded = bytebpe.encode_documents(
        _documents(spark, folder), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@_query
def op5_language(spark, folder):
    """Language of every whole text, learned from the rows outside the held-out fold."""
    docs = _documents(spark, folder)
    found = langid.predict(docs.select("doc_id", "text"), langid.learn(docs.where(common.fold(4) != 2)))
    return found.select(
        "doc_id", (common.fold(4) == 2).alias("held_out"), F.col("_lang").alias("lang_pred"),
        F.col("_lang_score").alias("score"), F.col("_lang_rejected").alias("rejected"),
    )


@_query
def op6_lm_score(spark, folder):
    """Log-probabilities of all texts, learned outside the held-out fold."""
    docs = _documents(spark, folder).select("doc_id", "text")
    scored = lm.score(docs, docs.where(common.fold(7) != 2))
    return scored.select(
        "doc_id", (common.fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@_query
def op7_neighbours(spark, folder):
    """The 20 nearest of every vector whose id is divisible by 20, by inner product."""
    return neighbours.nearest(read_table(spark, folder, "embeddings"))


@_query
def op8_token_files(spark, folder):
    """All documents' ids, written to token files in id order and read back."""
    manifest = tokenfiles.write_files(
        _documents(spark, folder), common.folder_for(spark, "token-files"), public_tokenizers.path("word_bpe_49k.json")
    )
    return tokenfiles.read_documents(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query
def op9_toxicity(spark, folder):
    """Toxicity scores of all documents, learned from labels outside the held-out fold."""
    docs = _documents(spark, folder).select("doc_id", "text")
    labels = read_table(spark, folder, "labels").select("doc_id", "toxic").where(common.fold(4) != 2)
    scored = toxicity.score(docs, toxicity.learn(docs, labels))
    return scored.select(
        "doc_id", (common.fold(4) == 2).alias("held_out"), F.col("_toxicity").alias("score"),
        F.col("_toxic").cast("int").alias("predicted"),
    )


@_query
def op10_substrings(spark, folder):
    """Words under 50-word windows that also begin in a smaller document, removed from all documents."""
    stripped = substrings.remove_repeats(_documents(spark, folder).select("doc_id", "text"))
    return stripped.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


@_query
def op11_fingerprints(spark, folder):
    """Fingerprints of every whole text and of its edited text, and what is near to what."""
    found = orderprint.edits(_documents(spark, folder))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


@_query
def op12_whitening(spark, folder):
    """All usable vectors on the 32 leading components of their covariance."""
    return whitening.whiten(read_table(spark, folder, "embeddings"))


@_query
def op13_collocations(spark, folder):
    """The 2000 best phrases of every language, from all whole texts."""
    return collocations.collocations(_documents(spark, folder))


# Words below 100 occurrences are in no candidate, so only runs of the others are cut into phrases.
SQL["op13_collocations"] = r"""
with pieces as (
  select lang, piece, row_number() over () as p from (
    select coalesce(lang, 'und') as lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)),
lists as (select lang, p, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
words as (select lang, p, unnest(w) as word, generate_subscripts(w, 1) as i from lists),
vocabulary as (select lang, word as phrase, count(*) as f from words group by all),
totals as (select lang, cast(sum(f) as bigint) as n from vocabulary group by 1),
known as (select words.* from words join vocabulary v on v.lang = words.lang and v.phrase = word and f >= 100),
runs as (select *, lead(word, 1) over w as w1, lead(i, 1) over w as i1, lead(word, 2) over w as w2, lead(i, 2) over w as i2,
                lead(word, 3) over w as w3, lead(i, 3) over w as i3, lead(word, 4) over w as w4, lead(i, 4) over w as i4
         from known window w as (partition by p order by i)),
grams as (
  select lang, 2 as size, concat_ws(' ', word, w1) as phrase from runs where i1 = i + 1
  union all select lang, 3, concat_ws(' ', word, w1, w2) from runs where i2 = i + 2
  union all select lang, 4, concat_ws(' ', word, w1, w2, w3) from runs where i3 = i + 3
  union all select lang, 5, concat_ws(' ', word, w1, w2, w3, w4) from runs where i4 = i + 4),
candidates as (select lang, size, phrase, count(*) as a from grams group by all having count(*) >= 100),
kept as (
  select * from candidates c where not exists (
    select 1 from candidates d where d.lang = c.lang and d.size > c.size and d.a >= c.a
      and contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
parts as (select lang, phrase, f from vocabulary union all select lang, phrase, a from candidates),
cuts as (
  select lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') as head,
         array_to_string(string_split(phrase, ' ')[k + 1:], ' ') as rest
  from (select *, unnest(range(1, size)) as k from kept)),
scored as (
  select c.lang, c.phrase, a, k, x.f as l, y.f as r, n,
         cast((1000::hugeint * a * n) // (x.f::hugeint * y.f) as bigint) as score
  from cuts c join parts x on x.lang = c.lang and x.phrase = head join parts y on y.lang = c.lang and y.phrase = rest
  join totals t on t.lang = c.lang),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank,
       phrase, a, l, r, n, score from best
qualify rank <= 2000
"""

SQL["op10_substrings"] = r"""
with docs as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
windows as (
  select doc_id, unnest(h) as h, generate_subscripts(h, 1) as i from (
    select doc_id, list_transform(range(1, len(w) - 48), lambda k: md5(array_to_string(w[k:k + 49], ' '))) as h
    from docs where len(w) >= 50)),
firsts as (select h, min(doc_id) as least from windows group by 1),
gone as (
  select distinct doc_id, unnest(range(i, i + 50)) as p from windows join firsts using (h) where least < doc_id),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from docs),
kept as (
  select words.doc_id, count(*) filter (where gone.p is null) as n_kept,
         string_agg(word, ' ' order by words.p) filter (where gone.p is null) as text
  from words left join gone on gone.doc_id = words.doc_id and gone.p = words.p group by 1)
select d.doc_id, len(w) as n_words, len(w) - coalesce(n_kept, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256
from docs d left join kept k on k.doc_id = d.doc_id
"""
