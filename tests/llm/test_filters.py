"""The learned filters: scored as fitted, ties rejected, columns of any name kept."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioflow.llm import langid, neardup, quality, substrings, toxicity
from folioflow.session import read_table

MODEL = toxicity.ToxicityModel({" idiot": 3.0, " zorg": 2.0, " moron ": 4.0}, {" idiot proof ", " not zorgy "}, (1.5, 0.7), -3.0)


def plain_score(model, text):
    """The same by a search for every entry and exception in turn."""
    words = "".join(toxicity.HOMOGLYPHS.get(c) or (c if c.isalpha() else " ") for c in text.lower()).split()
    low = " " + " ".join(words) + " "
    spared = [m.span(1) for x in model.exceptions for m in re.finditer(f"(?=({re.escape(x)}))", low)]
    best = {}
    for entry, weight in model.entries.items():
        for m in re.finditer(f"(?={re.escape(entry)})", low):
            if not any(a <= m.start() < b - 1 for a, b in spared):
                best[m.start()] = max(best.get(m.start(), 0), weight)
    total = sum(best.values())
    x = (math.log1p(total), math.log1p(100 * total / max(len(words), 1)))
    return 1 / (1 + math.exp(-(x[0] * model.weights[0] + x[1] * model.weights[1] + model.bias)))


def test_toxicity_is_what_a_plain_search_gives():
    rng = random.Random(1)
    parts = ["idiot", "idiots", "proof", "idiot proof", "zorgy", "not", "moron", "morons", "fine", ",", "\n", "!", "1d10t", "ідіот"]
    texts = ["", " ", "idiot"] + [" ".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(300)]
    found = toxicity.score_texts(MODEL, MODEL.automaton(), texts)
    assert [round(s, 9) for s in found] == [round(plain_score(MODEL, t), 9) for t in texts]


@pytest.mark.parametrize("between", [" ", ", ", " - ", "\n\n", "  "])
def test_signs_and_line_ends_change_neither_words_nor_exceptions(between):
    words = "some plain words then an idiot proof thing and a moron in it".split()
    plain, other = toxicity.score_texts(MODEL, MODEL.automaton(), [" ".join(words), between.join(words)])
    assert plain == other
    assert toxicity.matched(MODEL.automaton(), toxicity.folded(between.join(["idiot", "proof"]))) == 0.0


def test_many_exceptions_take_linear_time():
    text = "idiot proof " * 90_000
    begun = time.perf_counter()
    toxicity.score_texts(MODEL, MODEL.automaton(), [text])
    assert time.perf_counter() - begun < 5


def test_ties_are_rejected_at_any_length():
    same = b"the same content for both of them " * 20
    compressors = langid.LanguageModel({"aa": same, "bb": same}).compressors()
    for text in ("q", "some text", "longer " * 200):
        lang, score, margin = langid.identify(text, compressors)
        assert (lang, score, margin) == ("aa", 0.5, 0.0)
    clear = langid.LanguageModel({"aa": same, "bb": b"wholly different letters: qqq zzz " * 20}).compressors()
    assert langid.identify("the same content for both", clear)[2] > langid.MARGIN


def test_op5_scores_are_those_of_the_sizes(spark, folder, tables):
    docs = read_table(spark, folder, "documents")
    model = langid.learn(docs)
    compressors = model.compressors()
    names = langid.added_names(docs)
    assert names[0] == "__lang"
    found = langid.predict(docs, model).select("doc_id", "text", *names).collect()
    for r in found:
        raw = (r.text or "").lower().encode()
        blocks = [raw[k : k + langid.BLOCK_BYTES] for k in range(0, len(raw), langid.BLOCK_BYTES)]
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), n) for n, (_, c) in enumerate(compressors))
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert r[names[0]] == "und" and r[names[2]]
        else:
            assert r[names[0]] == compressors[sizes[0][1]][0]
            assert r[names[2]] == (sizes[0][0] > (1 - langid.MARGIN) * sizes[1][0])


def test_columns_of_the_operators_own_names_stay(spark):
    rows = [(i, f"some words of text number {i} " * 12, "en") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clashing = ["_toxic", "_TOXICITY", "_lang", "_lang_score", "_spans", "_n_words", "_n_removed", "_kept_id", "_doc_id"]
    docs = docs.withColumns({c: F.lit("mine") for c in clashing})
    model = toxicity.ToxicityModel()
    for out, added in (
        (toxicity.score(docs, model), toxicity.added_names(docs)), (langid.predict(docs, langid.learn(docs)), langid.added_names(docs)),
        (substrings.remove_repeats(docs), substrings.added_names(docs)), (neardup.one_of_each_group(docs), []),
    ):
        assert out.columns == [*docs.columns, *added]
        got = out.collect()
        assert got and all(r[c] == "mine" for r in got for c in clashing)


def test_op3_sample_is_of_different_texts(spark):
    rng = random.Random(3)
    words = [("".join(rng.choices("abcdefgh", k=5))) for _ in range(300)]
    texts = [(i, " ".join(rng.choices(words, k=60)), i % 2) for i in range(400)]
    hot = [(1000 + i, "copy " * 60, 1) for i in range(3000)]
    alone, crowded = (
        quality.learn(t.select("doc_id", "text"), t.select("doc_id", "quality"), 150)
        for t in (spark.createDataFrame(rows, "doc_id long, text string, quality int") for rows in (texts, texts + hot))
    )
    assert abs(alone.bias - crowded.bias) < 0.5


def test_stages_of_the_pipeline_keep_clashing_columns(spark, folder):
    docs = read_table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
