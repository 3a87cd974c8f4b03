import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()),
    # columns whose names an operator might use for itself
    ("component", pa.string()), ("n", pa.int64()), ("rank", pa.int64()), ("part", pa.string()), ("ids", pa.string()),
    ("_toxic", pa.string()), ("_lang", pa.string()), ("_spans", pa.string()), ("_n_words", pa.string()),
    ("_kept_id", pa.string()), ("_doc_id", pa.string()), ("_N_REMOVED", pa.string()), ("guest", pa.string()),
])


def write(folder, documents, labels, vectors):
    rows = [dict(zip(("doc_id", "text", "lang"), d)) for d in documents]
    for r in rows:
        r |= {"source": "s", "n_chars": len(r["text"] or ""), "component": "c", "n": 1, "rank": 1, "part": "p", "ids": "i"}
    pq.write_table(pa.Table.from_pylist(rows, schema=SCHEMA), folder / "documents.parquet")
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])
    pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, x)) for x in labels], schema=schema), folder / "labels.parquet")
    schema = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])
    pq.write_table(
        pa.Table.from_pylist([dict(zip(schema.names, (*v, 0))) for v in vectors], schema=schema), folder / "embeddings.parquet"
    )
    return str(folder)


def documents():
    rng = random.Random(5)
    words = {
        "en": [a + b for a in ("th", "sh", "wh", "ing", "out", "er") for b in ("the", "ow", "ed", "ly", "ness")],
        "fr": [a + b for a in ("é", "qu", "eau", "ou", "ch") for b in ("elle", "eux", "ment", "ion", "é")],
    }

    def prose(lang, n):
        return " ".join(rng.choice(words[lang]) + rng.choice(["", "", ".", ","]) for _ in range(n))

    out = [(i, prose("fr" if i % 3 == 0 else "en", rng.randint(20, 160)), "fr" if i % 3 == 0 else "en") for i in range(160)]
    passage = prose("en", 70)
    for i in range(160, 172):
        out.append((i, f"{prose('en', 30)} {passage} {prose('en', 30)}", "en"))
    base = prose("en", 150).split()
    for i in range(172, 184):
        near = list(base)
        near[rng.randrange(150)] = f"changed{i}"
        out.append((i, " ".join(near), "en"))
    out += [(184 + i, out[0][1], "fr") for i in range(4)]
    out += [(188 + i, f"{prose('en', 40)} idiot {prose('en', 20)} moron", "en") for i in range(30)]
    out += [
        (300, None, None), (301, "", "en"), (302, " \n\t ", "en"), (303, "one", "en"), (304, "One two", None),
        (305, "x" * 3000, "en"), (306, " ".join(["again"] * 400), "en"), (307, "  odd\r\n spaces and\x1csigns  <|endoftext|> \n\n\nline\nline", "en"),
        (308, "日本語 テキスト 😀 é ñandú " * 30, "ja"), (None, prose("en", 60), "en"), (None, None, None),
        (311, "say <|endoftext|> or<|endoftext|>x <|ENDOFTEXT|> <|StartOfText|> \n<|startoftext|>\n <|endoftext|>  end", "en"),
        (309, prose("en", 4000), "en"), (310, "12 34 !!", "en"), (5, out[5][1], "fr"),
    ]
    return out


def labels(docs):
    return [(i, 0 if i is not None and i % 7 == 0 else 1, int("idiot" in (t or ""))) for i, t, _ in docs if i != 302] + [
        (None, 1, 0), (9999, None, None), (1, 1, 0),
    ]


def vectors():
    rng = random.Random(3)
    out = [(i, [float(rng.randint(-9, 9)) for _ in range(8)]) for i in range(240)]
    out += [(240 + i, out[3][1]) for i in range(60)]
    out += [
        (400, None), (420, [0.0] * 8), (440, [float("nan")] + [1.0] * 7), (460, [None] + [1.0] * 7), (None, [1.0] * 8),
        (480, [1.0, 2.0]), (481, [2.0, 2.0]), (500, []), (501, [float("inf")] * 8), (60, out[60][1]), (520, [3e37] * 8),
    ]
    return out


@pytest.fixture(scope="session")
def tables():
    docs = documents()
    return docs, labels(docs), vectors()


@pytest.fixture(scope="session")
def folder(tmp_path_factory, tables):
    return write(tmp_path_factory.mktemp("tables"), *tables)


@pytest.fixture(scope="session")
def empty_folder(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), [], [], [])
