"""Every query against plain Python over a table with nulls, repeats, ties, long and odd texts."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from folioflow.llm import neardup, packing, substrings, tokenfiles
from folioflow.llm.queries import BUILDERS
from folioflow.session import read_table


def rows(spark, name, folder):
    return BUILDERS[name](spark, folder).collect()


def crc(i, m):
    return None if i is None else zlib.crc32(str(i).encode()) % m


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def encoded(vocabulary, text):
    tokenizer = Tokenizer.from_file(P.path(vocabulary))
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_op1_pieces_rebuild_every_document(spark, folder, tables):
    found = rows(spark, "op1_packing", folder)
    at = 0
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 2048 + r.offset == at and r.offset + r.length <= 2048
        at += r.length
    texts = defaultdict(list)
    for i, t, _ in tables[0]:
        texts[i].append(encoded("byte_bpe_50k.json", t))
    assert at == sum(len(x) for v in texts.values() for x in v)
    for r in found:
        assert any(
            len(x) == r.doc_tokens and zlib.crc32(packed(x[r.start : r.start + r.length])) == r.ids_crc32
            for x in texts[r.doc_id]
        )


def test_packed_sequences_are_full_and_whole(spark, folder):
    pieces = packing.pack(read_table(spark, folder, "documents"), P.path("byte_bpe_50k.json"), length=64)
    made = sorted(packing.sequences(pieces).collect(), key=lambda r: r.sequence_id)
    assert [r.n_tokens for r in made[:-1]] == [64] * (len(made) - 1)
    assert all(len(r.ids) == 4 * r.n_tokens for r in made)


def test_op4_is_what_tiktoken_gives(spark, folder, tables):
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t, _ in tables[0]:
        ids = plain.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in rows(spark, "op4_byte_bpe", folder)) == want


def test_op8_files_hold_documents_in_order(spark, folder, tables):
    found = rows(spark, "op8_token_files", folder)
    want = defaultdict(Counter)
    for i, t, _ in tables[0]:
        ids = encoded("word_bpe_49k.json", t)
        want[i][(len(ids), zlib.crc32(packed(ids)))] += 1
    got = defaultdict(Counter)
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        got[r.doc_id][(r.n_tokens, r.ids_crc32)] += 1
    assert got == want
    ids = [r.doc_id for r in sorted(found, key=lambda r: r.start) if r.doc_id is not None]
    assert ids == sorted(ids)


def test_sequences_are_read_in_place(spark, folder, tmp_path):
    docs = read_table(spark, folder, "documents")
    manifest = tokenfiles.write_files(docs, f"file://{tmp_path}/files", P.path("word_bpe_49k.json"), length=32)
    first = manifest.orderBy("part").first()
    ids, mask = tokenfiles.read_sequence(first.path.removeprefix("file://"), 0)
    assert len(ids) == len(mask) == 32 and mask.all() and ids.dtype == np.uint16


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def components(docs, percent):
    sets = {i: shingles(t) for i, t, _ in docs if i is not None}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return sets, {i: top(i) for i in ids}


@pytest.mark.parametrize("block", [1024, 2])
def test_op2_links_are_those_of_all_pairs(spark, folder, tables, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    sets, want = components(tables[0], 85)
    for r in rows(spark, "op2_near_duplicates", folder):
        if r.doc_id is None:
            assert r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def repeats_removed(docs, length=50):
    first, words = {}, {}
    for i, t, _ in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        words[i] = (t or "").encode().split()
        for k in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][k : k + length]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        out[i] = (len(w), [x for k, x in enumerate(w) if k not in gone])
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
def test_op10_removes_what_brute_force_removes(spark, folder, tables, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_PLACES", hot)
    want = repeats_removed(tables[0])
    removed = 0
    for r in rows(spark, "op10_substrings", folder):
        if r.doc_id is not None:
            n, kept = want[r.doc_id]
            removed += r.n_removed
            assert (r.n_words, r.n_removed) == (n, n - len(kept))
            assert r.kept_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()
    assert removed > 0


def test_op3_base_counts(spark, folder, tables):
    want = Counter()
    for i, text, _ in tables[0]:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        triples = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {k + s for k in range(len(words) - 2) if triples[tuple(words[k : k + 3])] > 1 for s in range(3)}
        seen, again = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        want[(i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), failed)] += 1
    found = rows(spark, "op3_quality", folder)
    assert Counter(tuple(r)[:7] for r in found) == want
    assert all(not r.kept for r in found if r.base_failed) and all(0 <= r.score <= 1 for r in found)


def test_op5_tells_held_out_languages(spark, folder, tables):
    lang = {i: l for i, t, l in tables[0] if l and len((t or "").split()) >= 20}
    found = rows(spark, "op5_language", folder)
    assert len(found) == len(tables[0]) and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out and lang.get(r.doc_id) in ("en", "fr")]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert {r.lang_pred for r in found if r.doc_id in (300, 301, 302, 310)} == {"und"}


def test_op6_base_scores_and_a_better_model(spark, folder, tables):
    words = [(i, (t or "").encode().lower().split() + [b""]) for i, t, _ in tables[0]]
    counts = Counter()
    for i, w in words:
        if i is not None and crc(i, 7) != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, w in words:
        base = math.fsum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        want[(i, len(w), sum(counts[x] > 0 for x in w), n, round(base, 4))] += 1
    found = rows(spark, "op6_lm_score", folder)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_op7_is_exact(spark, folder, tables):
    able = {}
    for i, v in tables[2]:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            able[i] = np.array(v, np.float32).astype(float)
    want = []
    for q in sorted(i for i in able if i % 20 == 0):
        scored = sorted((-float((able[q] * c).sum()), i) for i, c in able.items() if i != q and len(c) == len(able[q]))
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scored[:20], 1)]
    found = sorted(tuple(r) for r in rows(spark, "op7_neighbours", folder))
    assert [f[:3] for f in found] == [w[:3] for w in want]
    assert np.allclose([f[3] for f in found], [w[3] for w in want], rtol=1e-12)


def test_op9_finds_toxic_words_and_leaves_the_rest(spark, folder, tables):
    toxic = {i for i, t, _ in tables[0] if "idiot" in (t or "")}
    found = rows(spark, "op9_toxicity", folder)
    assert len(found) == len(tables[0])
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert {r.doc_id for r in found if r.predicted} == toxic


@pytest.mark.parametrize("name", sorted(BUILDERS))
def test_empty_tables_give_no_rows(spark, empty_folder, name):
    assert rows(spark, name, empty_folder) == []


def test_pipeline_stages_do_their_work(spark, folder, tables):
    docs = read_table(spark, folder, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {(r.doc_id, r.text) for r in docs.collect()}
        docs = stage(spark, docs, folder)
        after = {(r.doc_id, r.text) for r in docs.collect()}
        assert docs.columns == columns
        if name == "toxicity":
            assert {i for i, t in before - after} == {i for i, t in before if "idiot" in (t or "")}
        if name == "language":
            assert {300, 301, 302, 310} <= {i for i, _ in before - after}
        if name == "near_dedup":
            _, want = components([(i, t, "") for i, t in before], 80)
            assert {i for i, _ in after if i is not None} == {i for i, top in want.items() if i == top}
        if name == "substring_dedup":
            want = repeats_removed([(i, t, "") for i, t in before])
            for i, text in after:
                if i is not None:
                    assert (text or "").encode().split() == want[i][1]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_pipeline_of_empty_tables(spark, empty_folder):
    assert corpus_pipeline.run(spark, empty_folder).count() == 0
