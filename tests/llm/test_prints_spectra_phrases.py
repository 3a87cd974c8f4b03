"""Fingerprints, whitening and collocations against plain Python."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from folioflow.llm import collocations, orderprint, whitening
from folioflow.llm.common import mixed
from folioflow.llm.queries import BUILDERS
from folioflow.session import read_table


def plain_sketch(text):
    kmers = [int(k) for k in orderprint.windows(text)]
    seen, marks = Counter(), []
    for k in kmers:
        marks.append(int(mixed(np.array([k], np.uint64), np.array([seen[k]], np.uint64))[0]) >> 32)
        seen[k] += 1
    out = []
    for factor, shift in zip(orderprint._FACTORS.tolist(), orderprint._SHIFTS.tolist()):
        least = sorted(range(len(marks)), key=lambda i: ((factor * marks[i] + shift) % 2**32, i))[: orderprint.PICKED]
        told = np.array([orderprint._LIFT])
        for place in sorted(least):
            told = mixed(told, np.array([kmers[place]], np.uint64))
        out.append(int(told[0]) >> 32 if least else 0)
    return out


def test_sketches_select_the_least_numbered_windows(monkeypatch):
    rng = random.Random(1)
    texts = ["", "a", "abc", "abcdefgh", "aaaaaaaaaaaaaaaaaaaa", "日本語テキスト😀ñandú", "".join(rng.choices("ab c", k=700))]
    whole = [orderprint.sketch(t).tolist() for t in texts]
    assert whole == [plain_sketch(t) for t in texts]
    monkeypatch.setattr(orderprint, "BLOCK", 64)
    assert whole == [orderprint.sketch(t).tolist() for t in texts]


def test_likeness_falls_with_edits_and_with_order():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    text, base = " ".join(words), orderprint.sketch(" ".join(words))
    few = list(words)
    few[50] = few[200] = "changed"
    many = [w if rng.random() < 0.7 else "other" for w in words]
    moved = words[200:] + words[:200]
    near = [orderprint.likeness(base, orderprint.sketch(" ".join(w))) for w in (words, few, moved, many)]
    assert near[0] == 1.0 and near[1] > 0.85 and near[1] > near[2] > near[3]
    # all windows are still there, only their order differs
    assert near[2] < 0.8
    assert orderprint.likeness(base, orderprint.sketch(text[::-1])) < 0.05


def test_op11_pairs_every_text_with_the_next(spark, folder, tables, monkeypatch):
    monkeypatch.setattr(orderprint, "RANGE_BYTES", 4000)

    def place(d):
        return (d[0] is not None, d[0] or 0, xxhash.xxh3_64_intdigest((d[1] or "").encode()) >> 1)

    docs = sorted(tables[0], key=place)
    want = Counter()
    for (i, t, _), (_, after, _) in zip(docs, docs[1:] + docs[:1]):
        t, after = t or "", after or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = (orderprint.sketch(x) for x in (t, edited, after))
        want[(
            i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a.astype(">u4").tobytes().hex(),
            b.astype(">u4").tobytes().hex(), (a == b).mean(), (a == c).mean(),
        )] += 1
    assert Counter(tuple(r) for r in BUILDERS["op11_fingerprints"](spark, folder).collect()) == want
    alone = spark.createDataFrame([(7, "abcdefgh" * 3)], "doc_id long, text string")
    assert [(r.near_edited, r.near_next) for r in orderprint.edits(alone).collect()][0][1] == 1.0


def test_fingerprints_of_equal_texts_are_equal(spark, folder, tables):
    found = {}
    for r in orderprint.fingerprints(read_table(spark, folder, "documents")).collect():
        found.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert found[0] == found[184] and found[300] == found[301] and len(found[1] | found[2]) == 2


@pytest.mark.parametrize("values", [
    [9, 7, 5, 3, 1, 0.5], [4, 4, 4, 1, 1, 1], [1, 1, 1, 1, 1, 1], [1e6, 1, 1, 1e-3, 1e-3, 0], [5, 5 - 1e-13, 2, 0, 0, 0], [0] * 6,
])
def test_leading_eigenpairs(values):
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.standard_normal((6, 6)))[0]
    matrix = turn @ np.diag(np.array(values, float)) @ turn.T
    matrix = (matrix + matrix.T) / 2
    e, v = whitening.leading(matrix, 4)
    want = [x for x in sorted(values, reverse=True)[:4] if x > 0]
    assert np.allclose(e, want, rtol=1e-9) and len(e) == len(want)
    assert np.allclose(v @ v.T, np.eye(len(e)), atol=1e-12)
    assert np.abs(matrix @ v.T - v.T * e).max(initial=0) <= 1e-13 * max(values)


def test_counts_above_a_shift():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 40):
        a = rng.integers(-3, 4, (n, n)).astype(float)
        a = a + a.T
        np.fill_diagonal(a, 0)
        own = np.linalg.eigvalsh(a)
        for shift in (-1.3, 0.21, 2.7):
            assert whitening.count_above(a, shift) == (own > shift).sum()


@pytest.mark.parametrize("broadcast", [1 << 16, 0])
def test_op12_whitens(spark, folder, tables, broadcast, monkeypatch):
    monkeypatch.setattr(whitening, "BROADCAST_DIMS", broadcast)
    able = {}
    for i, v in tables[2]:
        if v and all(c is not None and np.isfinite(c) and abs(c) < 2**55 for c in v):
            x = [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]
            able.setdefault(len(v), []).append((i, x))
    found = {}
    for r in BUILDERS["op12_whitening"](spark, folder).collect():
        found.setdefault((r.vec_id, r.component), []).append(r)
    total = 0
    for dim, rows in able.items():
        x = np.array([v for _, v in rows])
        n, s = len(x), x.sum(axis=0)
        y = x - s / n
        v = y.T @ y / n
        own, turn = np.linalg.eigh(v)
        own, turn = own[::-1], turn[:, ::-1]
        k = int((own > 1e-11 * own[0]).sum())
        far = Counter()
        for i, row in rows:
            far[(i, sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)))] += 1
        for component in range(1, k + 1):
            got = [r for (i, c), rs in found.items() if c == component for r in rs if r.n == n]
            assert Counter((r.vec_id, r.deviation) for r in got) == far
            want = np.sort(y @ turn[:, component - 1] / np.sqrt(own[component - 1]))
            have = np.sort([r.whitened for r in got])
            assert np.allclose(have, want, atol=1e-8) or np.allclose(-have[::-1], want, atol=1e-8)
            assert np.allclose([r.explained for r in got], own[component - 1] / np.trace(v), rtol=1e-10)
            assert max(r.identity_error for r in got) < 1e-8
            total += len(got)
    assert total == sum(map(len, found.values())) > 0


def test_op12_deviation_is_exact_or_null(spark):
    rows = [(1, [1e15, 0.5]), (2, [-1e15, 0.25]), (3, [3e12, -7.0]), (4, [1e7, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = [[int(64 * c // 1) + 1_000_000 for c in v] for _, v in rows]
    want = [sum((4 * a - sum(col)) ** 2 for a, col in zip(v, zip(*x))) for v in x]
    got = {r.vec_id: r.deviation for r in whitening.whiten(table).collect()}
    assert got == {i + 1: w if w < 2**63 else None for i, w in enumerate(want)}
    equal = spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<double>")
    assert whitening.whiten(equal).collect() == []


def plain_collocations(docs, least, kept):
    found, totals = Counter(), Counter()
    for _, text, lang in docs:
        low = (text or "").encode().lower()
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(rb"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for size in range(1, 6):
                found.update((lang or "und", tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    candidates = {k: a for k, a in found.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in candidates.items():
        if any(
            x == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            for (x, q), b in candidates.items()
        ):
            continue
        n = totals[lang]
        cuts = [(1000 * a * n // (found[lang, p[:k]] * found[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        row = (b" ".join(p), a, found[lang, p[:k]], found[lang, p[k:]], n, score)
        out.setdefault(lang, []).append(row)
    rows = []
    for lang, best in out.items():
        best.sort(key=lambda r: (-r[5], -r[1], r[0]))
        rows += [(lang, i, r[0].decode(), *r[1:]) for i, r in enumerate(best[:kept], 1)]
    return sorted(rows)


@pytest.mark.parametrize("least,kept,trigger,held", [(3, 40, 32, 400_000), (2, 10_000, 2, 50)])
def test_collocations_are_those_of_plain_counting(spark, folder, tables, least, kept, trigger, held, monkeypatch):
    monkeypatch.setattr(collocations, "TRIGGER", trigger)
    monkeypatch.setattr(collocations, "HELD", held)
    docs = [d for d in tables[0] if len(d[1] or "") < 20_000]
    docs += [(1000 + k, "One two; three FOUR five. one\ttwo three four five six\x0cone two\x1cx, a a a a a a a", None) for k in range(4)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(table, least, kept).collect())
    assert got == plain_collocations(docs, least, kept) and len(got) > 40


def test_op13_on_the_fixture(spark, folder, tables):
    got = sorted(tuple(r) for r in BUILDERS["op13_collocations"](spark, folder).collect())
    assert got == plain_collocations(tables[0], 100, 2000) and got


def test_chunks_cover_every_word_once_and_none_begins_another():
    rng = random.Random(5)
    text = " ".join(rng.choices(["a", "b", "c", "d"], k=5000)).encode()
    made = collocations.chunks(text)
    words = [w for chunk, own in made for w in chunk.split()[:own]]
    assert words == text.split() and len(made) > 50
    whole = {c + b" " for c, _ in made[:-1]}
    assert not any(a != b and b.startswith(a) for a in whole for b in whole)
    assert collocations.chunks(b"") == [] and collocations.chunks(b" ,.; \n") == []
