"""Learned operators use the whole corpus: no fixed vocabulary, shares or samples that copies can fill."""

import random

from folioflow.llm import langid, lm, toxicity


def test_op6_learns_more_than_a_fixed_number_of_words(spark):
    rng = random.Random(2)
    # 1400 words of about the same count, each second one told by the first
    texts = [" ".join(f"x{i} y{i}" for i in rng.choices(range(700), k=20)) for _ in range(2500)]
    training = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    asked = [(2 * i + k, f"x{i} y{(i + 350 * k) % 700}") for i in range(700) for k in (0, 1)]
    scored = lm.score(spark.createDataFrame(asked, "doc_id long, text string"), training)
    score = {r.doc_id: r.score for r in scored.collect()}
    better = sorted(score[2 * i] - score[2 * i + 1] for i in range(700))
    # far more pairs are told apart than 512 words could
    assert sum(d > 0.3 for d in better) > 500


def test_op6_scores_are_normalised():
    rng = random.Random(4)
    counts = {f"w{i}".encode(): rng.randint(5, 900) for i in range(3000)}
    model = lm.Model.fresh(counts, 50, [rng.randint(0, 90) for _ in range(7)])
    tokens = [r for r in [lm.STOP, *sorted(set(model.codes.values()) - {lm.STOP}), *model.buckets.tolist()]]
    assert len(tokens) == len(set(tokens)) == 3008
    np = lm.np
    drawn = np.array(rng.choices(tokens, k=20_000))
    model.train(drawn, np.roll(drawn, 1), np.roll(drawn, 2), 0.05, np.random.default_rng(1))
    for a, b in ((lm.START, lm.START), (tokens[5], tokens[2000]), (tokens[-1], tokens[40])):
        logs = model.log_probabilities(np.full(3008, a), np.full(3008, b), np.array(tokens))
        assert abs(float(np.exp(logs.astype(float)).sum()) - 1) < 1e-4


def test_op6_inputs_move_once_for_both_levels_and_for_neighbours(monkeypatch):
    rng, np = random.Random(5), lm.np
    counts = {f"w{i}".encode(): rng.randint(5, 900) for i in range(3000)}
    model = lm.Model.fresh(counts, 50, [30])
    tokens = np.array(rng.choices(sorted(model.codes.values()), k=20_000))
    moved, move = [], lm._move

    def counted(table, past, rows, steps, rate):
        moved.append(len(rows) if table is model.inputs else 0)
        move(table, past, rows, steps, rate)

    monkeypatch.setattr(lm, "_move", counted)
    model.train(tokens[:-2], tokens[1:-1], tokens[2:], 0.05, np.random.default_rng(3))
    # two rows a place and level before
    assert 20_000 <= sum(moved) < 1.2 * 20_000


def test_op6_words_of_arrow_are_those_of_python():
    texts = ["", None, "  ", "A b", "\x0bÄb\x1cC\x85d\xa0E\u2003f\t\n G\r", "x", "\n", "Z\x00y  z "]
    words, lengths = lm.split_words(lm.pa.array(texts))
    want = [(t or "").encode().lower().split() for t in texts]
    assert words.to_pylist() == [w for ws in want for w in ws]
    assert lengths.tolist() == [len(ws) for ws in want]


def prose(rng, letters, n):
    return " ".join("".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(n))


def test_op9_learns_a_term_of_few_documents_beside_many_copies(spark):
    rng = random.Random(6)
    plain = [prose(rng, "abcdefgh", 12) for _ in range(3000)]
    docs = [(i, t, 0) for i, t in enumerate(plain[:1500])]
    docs += [(2000 + i, t + " idiot", 1) for i, t in enumerate(plain[1500:2900])]
    docs += [(4000 + i, t + " zorgan", 1) for i, t in enumerate(plain[2900:2912])]
    docs += [(5000 + i, "quite harmless sentence idiot", 1) for i in range(1000)]
    table = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = toxicity.learn(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    assert any(e.startswith(" zorg") for e in model.entries)
    assert not any(e.startswith((" quit", " harm", " sent")) for e in model.entries)
    new = [plain[2950] + " zorgan", plain[2951] + " quite harmless"]
    scores = toxicity.score_texts(model, model.automaton(), new)
    assert scores[0] >= toxicity.THRESHOLD > scores[1]


def test_op5_dictionaries_do_not_shrink_with_copies(spark):
    rng = random.Random(8)
    docs = [(prose(rng, "abcdefgh", 150), "aa") for _ in range(600)] + [(prose(rng, "qrstuvwx", 150), "bb") for _ in range(300)]
    hot = [(docs[0][0], "aa")] * 20_000
    alone, crowded = (
        langid.learn(spark.createDataFrame(rows, "text string, lang string").repartition(4)) for rows in (docs, docs + hot)
    )
    assert min(map(len, alone.contents.values())) >= langid.SAMPLE_TEXTS * langid.SAMPLE_CHARS
    assert crowded.contents == alone.contents


def test_op6_scores_are_those_of_a_plain_softmax():
    rng = random.Random(9)
    counts = {f"w{i}".encode(): rng.randint(5, 300) for i in range(900)}
    model = lm.Model.fresh(counts, 40, [30, 20])
    np = lm.np
    tokens = [lm.STOP, *sorted(set(model.codes.values()) - {lm.STOP}), *model.buckets.tolist()]
    drawn = np.array(rng.choices(tokens, k=5000))
    model.train(drawn, np.roll(drawn, 1), np.roll(drawn, 2), 0.05, np.random.default_rng(2))
    far, near, token = (np.array(rng.choices(tokens, k=700)) for _ in range(3))
    found = model.log_probabilities(far, near, token)
    levels = model.level_of(token)
    for a, b, w, level, got in zip(far, near, token, levels, found):
        vector = model.predicted(np.array([a]), np.array([b]))[0].astype(float)
        first = model.outputs[: model.tail].astype(float) @ vector
        want = first[level] - np.log(np.exp(first[1:]).sum())
        if w >= model.tail:
            low, high = model.span((w - model.tail) // model.class_size)
            below = model.outputs[low:high].astype(float) @ vector
            want += below[w - low] - np.log(np.exp(below).sum())
        assert abs(got - want) < 1e-3
