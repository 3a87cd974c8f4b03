import hashlib

import pytest
import regex
from pyspark.sql import functions as F

from folioflow.functions import geometry as G
from folioflow.functions import names as N
from folioflow.functions import text as T
from folioflow.operators import corpus as C
from folioflow.operators import specdiff as S


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize("text, want", [
    ("Stop  . Now :", "Stop. Now:"), ("a( b )", "a (b)"), ("key (s)", "key(s)"), ("menu>next", "menu >next"),
    ("10~20 km", "10–20 km"), ("10 - 20 km", "10–20 km"), ('say "hi there"', "say “hi there”"), ("car's", "car’s"),
    ("가(나)", "가 (나)"),
])
def test_normal_form(spark, text, want):
    assert one(spark, text, T.normalize_text) == want


def test_normal_form_is_stable(spark):
    df = spark.createDataFrame([("a ( b) 1~2 'x's \"q\" word(s) 3 - 4 .",), ("plain",)], "t string")
    twice = df.select(T.normalize_text(F.col("t")).alias("a")).select("a", T.normalize_text(F.col("a")).alias("b"))
    assert twice.where("a <> b").count() == 0


def test_content_hash(spark):
    digest = hashlib.sha256("10 ~ 20 km".encode()).hexdigest().upper()
    assert one(spark, "10–20 km", T.content_hash) == digest == one(spark, "10 ~ 20 km", T.content_hash)
    mixed = spark.sql("select array(struct('' as tag, 'a ' as text), struct('b' as tag, '1–2' as text)) as c")
    got = mixed.select(T.node_hash(F.col("c")).alias("h")).first().h
    assert got == hashlib.sha256("a b1 ~ 2".encode()).hexdigest().upper()


SENT = "map_title string, doc_id long, pos long, text string, class_tokens string, status string"


def test_replacement_and_report(spark):
    sents = C.hashed(spark.createDataFrame(
        [("m-en_US", 1, 0, "call the dealer", None, None), ("m-en_GB", 2, 0, "call the dealer", None, None),
         ("m-en_US", 3, 0, "keep the dealer", "note", None), ("m-en_US", 4, 0, "no match", None, None)], SENT))
    h = {r.text: r.hash for r in sents.collect()}
    pairs = spark.createDataFrame(
        [("NA", h["call the dealer"], "first", 1), ("NA", h["call the dealer"], "call the new dealer", 2),
         ("NA", h["keep the dealer"], "gone", 1)], "region string, hash string, new string, pos int")
    excluded = spark.createDataFrame([(h["keep the dealer"],)], "hash string")
    out = C.apply_replacements(C.flag_excluded(sents, excluded), pairs)
    assert {r.doc_id: (r.text, r.status, r.class_tokens) for r in out.collect()} == {
        1: ("call the new dealer", "changed", None), 2: ("call the dealer", None, None),
        3: ("keep the dealer", None, "note exclude"), 4: ("no match", None, None)}
    total = C.change_report(out, "dealer", []).first()
    assert (total.target_count, total.changed_count, total.unchanged_count, total.ratio) == (3, 1, 2, 33.33)
    assert C.change_report(out, "nowhere", []).first().ratio == 0.0
    left = C.unchanged_sentences(out, "dealer", ["map_title"], ["doc_id"], [F.col("doc_id")]).collect()
    assert [(r.doc_id, r.list_no) for r in left] == [(2, 1)]


DICT = "hash string, entry_no long, lang string, term string, pos int"


def test_dictionary_merge(spark):
    db = spark.createDataFrame([("h1", 1, "en", "a", 0), ("h1", 1, "EN", "b", 1), ("h1", 1, "FR", "c", 2)], DICT)
    upd = spark.createDataFrame([("h1", 1, "En ", "x", 0), ("h1", 1, "de", "d", 1), ("h2", 2, "en", "n", 0), ("h2", 3, "en", "later", 0), ("h2", 3, "fr", "later", 1)], DICT)
    merged = C.merge_dictionary(db, upd)
    assert {(r.hash, r.lang, r.term) for r in merged.collect()} == {("h1", "en", "a"), ("h1", "FR", "c"), ("h1", "de", "d"), ("h2", "en", "n")}
    # the second entry of h2 would count once h2 is known, so repeat without it
    again = C.merge_dictionary(merged, upd.where("entry_no <> 3"))
    assert again.exceptAll(merged).count() == 0 and again.count() == merged.count()


def test_translation(spark):
    wide = spark.createDataFrame([(1, "Hello  world", "Bonjour")], "row_no long, en string, fr string")
    terms = C.build_dictionary(wide, "row_no", ["en", "fr"])
    sents = spark.createDataFrame([(1, "fr", " Hello world "), (2, "fr", "Other")], "id long, lang string, text string")
    got = {r.id: (r.text, r.translated) for r in C.translate(sents, terms).collect()}
    assert got == {1: ("Bonjour", True), 2: ("Other", False)}


def tagged(spark, texts, terms):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    listed = spark.createDataFrame([(t,) for t in terms], "term string")
    hit = C.with_term_pattern(df, "text", listed, ["id"])
    rows = hit.select("id", C.tag_terms(F.col("text"), F.col("_pattern")).alias("text")).collect()
    return [r.text for r in sorted(rows, key=lambda r: r.id)]


def test_terms_longest_first(spark):
    texts = ["UP (TERRAIN MODE) TERRAIN, up A+B.", "a ++ b UPON", None, ""]
    got = tagged(spark, texts, ["UP", "TERRAIN", "TERRAIN MODE", "A+B", "++", " ", "UP"])
    t = '<term translate="no">{}</term>'.format
    assert got == [
        f"{t('UP')} ({t('TERRAIN MODE')}) {t('TERRAIN')}, up {t('A+B')}.", f"a {t('++')} b UPON", None, ""
    ]


@pytest.mark.parametrize("few", [64, 0])
def test_a_few_terms_and_many_mark_alike(spark, few, monkeypatch):
    monkeypatch.setattr(C, "FEW_TERMS", few)
    texts = ["UP -> on (->) UP->on", "-> a. «x» é é́", "a -> b -- c", "no hit", None, "", "été (été) v2.0 v2", "on on on"]
    terms = ["->", "on", "été", "v2.0", "«x»", "--", "b -- c", "é"]
    either = "|".join(regex.escape(x) for x in sorted(terms, key=len, reverse=True))
    plain = regex.compile(rf"(^|\s+|\p{{Ps}})({either})(\s+|\p{{P}}|\p{{Pe}}|$)")
    want = [t and plain.sub(r'\1<term translate="no">\2</term>\3', t) for t in texts]
    assert tagged(spark, texts, terms) == want and sum(t is not None and "<term" in t for t in want) == 5


def test_texts_without_a_possible_term_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(C, "FEW_TERMS", 0)
    df = spark.range(1000).select("id", F.lit("nothing here").alias("text"))
    terms = spark.createDataFrame([(f"term{k}",) for k in range(100)], "term string")
    plan = C.with_term_pattern(df, "text", terms, ["id"])
    assert plan.where("_pattern is not null").count() == 0 and plan.count() == 1000


def test_any_number_of_terms(spark):
    df = spark.createDataFrame([(1, "see w99999 and w100000 x7.")], "id long, text string")
    terms = spark.range(100_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("term"))
    row = C.with_term_pattern(df, "text", terms, ["id"]).select(C.tag_terms(F.col("text"), F.col("_pattern"))).first()
    assert row[0] == 'see <term translate="no">w99999</term> and w100000 x7.'


def test_xrefs(spark):
    ids = spark.createDataFrame(
        [("m", "T1", "t00000", "T1", "t00000", True, 0), ("m", "E1", "e00001", "T1", "t00000", False, 1), ("m", "E1", "e9", "T9", "t9", False, 9)],
        "map_id string, oid string, nid string, topic_oid string, topic_nid string, is_topic boolean, pos int")
    hrefs = ["#T1", "x.dita#T1/E1", "../o/x.dita#T1", "#none", "plain", None]
    refs = spark.createDataFrame([("m", i, h) for i, h in enumerate(hrefs)], "map_id string, i int, href string")
    new = {r.i: r.href for r in C.resolve_xrefs(refs, ids, "renumber").collect()}
    assert new == {0: "t00000.dita#t00000", 1: "t00000.dita#t00000/e00001", 2: None, 3: None, 4: None, 5: None}
    kept = {r.i: (r.href, r.mark) for r in C.resolve_xrefs(refs, ids, "keep").collect()}
    assert kept == {0: ("T1.dita#T1", None), 1: ("T1.dita#T1/E1", None), 2: (None, "###"), 3: (None, None), 4: (None, None), 5: (None, None)}


@pytest.mark.parametrize("name, want", [
    ("ACME-SP3-ICE-HEV-en-US-2027-OM", "SP3_ICE-HEV_27MY_US_HTML"), ("ACME-KA4_PE_ICE-en_EG-2027-x", "KA4_PE_ICE_27MY_EG_HTML"),
    ("ACME-LQ2a-ICE-en_GB_2027-x", "LQ2A_ICE_27MY_EG_HTML"), ("ACME-LQ2a-PE-ICE-en_GB_2027-x", "LQ2A_PE_ICE_27MY_EG_HTML"),
    ("ACME-KA4_PE_ICE-ko_KR-2027-x", "KA4_PE_ICE_27MY_KO_HTML"), ("ACME-KA4_PE_ICE-en_US-2027-x", "KA4_PE_ICE_27MY_US_HTML"),
    ("260317_ACME-SP3-ICE-HEV-en_GB-2027-x", "SP3_ICE-HEV_27MY_EG_HTML"), ("ACME-SP3-HEV-en_US-2027-OM_x", "SP3_HEV_27MY_US_HTML"),
    ("ACME-SP3-PHEV-en_US-2027-OM_x", "SP3_PHEV_27MY_US_HTML"), ("ACME-SV-EV-en_GB-2027-x", "SV_EV_27MY_EG_HTML"),
    ("240101_도안발주내역서_my:car.xlsx", "my_car"), (None, "color-check"),
])
def test_vehicle_label(spark, name, want):
    assert one(spark, name, lambda c: N.vehicle_label(c, "ACME")) == want


def test_names(spark):
    assert one(spark, "a/b\\c.dita#x/y", N.href_file) == "c.dita"
    assert one(spark, "a/b.dita#x/y", lambda c: N.href_rename(c, F.lit("n.dita"))) == "a/n.dita#x/y"
    assert one(spark, "b.dita", lambda c: N.href_rename(c, F.lit("n.dita"))) == "n.dita"
    assert one(spark, "m_en_US_x", lambda c: N.swap_locale(c, F.lit("fr-CA"))) == "m_fr_CA_x"
    assert one(spark, "AUSTRIA", N.region) == "NA" and one(spark, "AUSTRIA", lambda c: N.region(c, True)) == "EU"
    assert one(spark, "a review legal", T.filter_tokens) == "a" and one(spark, "review", T.filter_tokens) is None
    assert one(spark, "10-file", N.natural_key) > one(spark, "9-file", N.natural_key)


def test_geometry(spark):
    def rect(*v):
        return spark.createDataFrame([v], "x double, y double, w double, h double").select(
            G.normalize_rect(*[F.col(c) for c in "xywh"]).alias("r")).first().r

    assert tuple(rect(.25, .5, .2, .1)) == (.25, .5, .2, .1)
    assert rect(.55, .25, 0.0, 0.0) is None and rect(1.2, .1, .2, .2) is None and rect(None, .1, .1, .1) is None
    assert rect(.9, .1, .3, .1).w == pytest.approx(.1)
    held = '{"type":"text-highlight-rects","rects":[{"x":0.10,"y":0.10,"w":0.20,"h":0.05}]}'
    points = '[{"x":0.55,"y":0.55},{"x":0.65,"y":0.60},{"x":0.75,"y":0.55},{"x":9}]'
    assert [tuple(r) for r in one(spark, held, G.text_rects)] == [(.1, .1, .2, .05)]
    assert len(one(spark, points, G.drawing_points)) == 3
    assert one(spark, '[{"x":', G.text_rects) == [] and one(spark, None, G.drawing_points) == []
    assert one(spark, held, G.drawing_points) == []


SPEC = "sheet string, row_no long, item string, description string, cells array<string>"


def test_long_cells_are_compared_line_by_line(spark):
    def cells(last):
        rows = [("s", i, "A" if i == 0 else "", "", [f"v{i}" if i < 6 else last]) for i in range(7)]
        found = S.collapse_rows(spark.createDataFrame(rows, SPEC), "sheet", per_line=3)[1]
        return found.withColumnRenamed("col_no", "column")

    keys = ["sheet", "item"]
    for last, want in (("v6", []), ("w", [2]), ("", [2])):
        got = S.diff_cells(cells("v6"), cells(last), keys).where("changed").collect()
        assert [r.line_no for r in got] == want


def test_version_diff(spark):
    raw = spark.createDataFrame([("s", 1, "A1", "d", ["O", "x"]), ("s", 2, "", "", ["", "#"]), ("s", 3, "A2", "e", ["1", "2"])], SPEC)
    items, cells = S.collapse_rows(raw, "sheet")
    got = {(r.item, r.col_no): r.value for r in cells.collect()}
    assert got == {("A1", 1): "O", ("A1", 2): "x #", ("A2", 1): "1", ("A2", 2): "2"}
    assert {r.item: r.highlighted for r in items.collect()} == {"A1": True, "A2": False}
    after = spark.createDataFrame([("A1", "K1", "1"), ("A2", "K1", "1"), ("A3", "K1", "1"), ("A3", "K3", "9"), ("A4", "K1", "1")], "item string, column string, value string")
    before = spark.createDataFrame([("A1", "K1", "1"), ("A2", "K1", "2"), ("A3", "K1", "1"), ("A5", "K1", "1")], "item string, column string, value string")
    state = S.diff_rows(after, before, S.diff_cells(after, before, ["item"]), ["item"])
    assert {r.item: r.state for r in state.collect()} == {"A1": "", "A2": "changed", "A3": "", "A4": "new", "A5": "deleted"}
