import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import hierarchy as H
from folioflow.operators import listdiff as D
from folioflow.operators import markup as M
from folioflow.operators import toc as O
from folioflow.sources import files, markup
from folioflow.streaming import events as E


def stack(levels):
    depth, parent, open_rows = [], [], []
    for n, level in enumerate(levels, 1):
        while len(open_rows) >= level:
            open_rows.pop()
        parent.append(open_rows[-1] if open_rows else None)
        open_rows.append(n)
        depth.append(len(open_rows))
    return depth, parent


def test_levels_to_tree(spark):
    rng = random.Random(1)
    lists = {"fixed": [1, 3, 3, 2, 1, 4]}
    for i in range(20):
        lists[f"r{i}"] = [rng.randint(1, 6) for _ in range(30)]
    rows = [(m, n, lv, "t", f"f{n}") for m, ls in lists.items() for n, lv in enumerate(ls, 1)]
    df = spark.createDataFrame(rows, "map_id string, row_no long, level long, title string, file_name string")
    tree = {(r.map_id, r.row_no): (r.depth, r.parent_no) for r in O.tree_from_levels(df).collect()}
    ends = {(r.map_id, r.row_no): r.end_no for r in O.subtree_end(df).collect()}
    for m, levels in lists.items():
        depth, parent = stack(levels)
        assert [tree[m, n] for n in range(1, len(levels) + 1)] == list(zip(depth, parent))
        for n, level in enumerate(levels, 1):
            later = [k for k in range(n + 1, len(levels) + 1) if levels[k - 1] <= level]
            assert ends[m, n] == (later[0] if later else len(levels) + 1)
    assert [tree["fixed", n][0] for n in range(1, 7)] == [1, 2, 3, 2, 1, 2]


def plain_matches(a, b):
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_common_order_matches_full_table():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randint(0, 5) for _ in range(rng.randint(0, 25))]
        b = [rng.randint(0, 5) for _ in range(rng.randint(0, 25))]
        assert D.common_order(np.array(a), np.array(b)) == plain_matches(a, b)


def tiled(a, b, width):
    """The matches of two lists by tiles of ``width`` rows, without Spark."""
    cut = lambda x: [x[k : k + width] for k in range(0, len(x), width)]
    left, right, rows = cut(a), cut(b), {}
    for i in range(len(left) - 1, -1, -1):
        for j in range(len(right) - 1, -1, -1):
            lower = rows[i + 1, j][0] if i + 1 < len(left) else np.zeros(len(right[j]) + 1, np.int32)
            beside = rows[i, j + 1][:, 0] if j + 1 < len(right) else np.zeros(len(left[i]) + 1, np.int32)
            rows[i, j] = D.tile_rows(left[i], right[j], lower, beside)
    found, i, j, y, x = [], 0, 0, 0, 0
    while i < len(left) and j < len(right):
        part, y, x = D.tile_path(left[i], right[j], rows[i, j], y, x)
        found += [(i * width + p, j * width + q) for p, q in part]
        down, on = y == len(left[i]), x == len(right[j])
        i, j, y, x = i + down, j + on, 0 if down else y, 0 if on else x
    return found


def test_tiles_match_as_the_whole_table_does():
    rng = random.Random(6)
    for _ in range(10_000):
        a, b = (np.array([rng.randint(0, 5) for _ in range(rng.randint(0, 14))], int) for _ in range(2))
        assert tiled(a, b, rng.randint(1, 5)) == D.common_order(a, b)


@pytest.mark.parametrize("cells,tile", [(1 << 24, 1024), (0, 3), (30, 4)])
def test_lists_of_any_length_match_alike(spark, cells, tile, monkeypatch):
    monkeypatch.setattr(D, "WHOLE_CELLS", cells)
    monkeypatch.setattr(D, "TILE", tile)
    rng = random.Random(7)
    lists = {f"m{k}": [[rng.choice("abcdef") for _ in range(rng.randint(0, 11))] for _ in range(2)] for k in range(40)}
    lists["same"] = [list("abcabcabc")] * 2
    lists["apart"] = [list("aaaa"), list("bbbbb")]
    lists["once"] = [list("abc"), []]
    schema = "map_id string, row_no long, key string"
    sides = [
        spark.createDataFrame([(m, 10 * n + side, c) for m, x in lists.items() for n, c in enumerate(x[side])], schema)
        for side in (0, 1)
    ]
    got = {(r.map_id, r.master_no, r.manual_no) for r in D.match_lists(*sides).collect()}
    want = {(m, 10 * i, 10 * j + 1) for m, (a, b) in lists.items() for i, j in plain_matches(a, b)}
    assert got == want


def test_one_long_pair_is_spread_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(D, "TILE", 256)
    monkeypatch.setattr(D, "WHOLE_CELLS", 1 << 16)
    rng = random.Random(8)
    a = [str(rng.randint(0, 400)) for _ in range(900)]
    b = [x if rng.random() < 0.8 else str(rng.randint(0, 400)) for x in a if rng.random() < 0.9]
    schema = "map_id long, row_no long, key string"
    sides = [spark.createDataFrame([(1, n, c) for n, c in enumerate(x)], schema) for x in (a, b)]
    got = sorted((r.master_no, r.manual_no) for r in D.match_lists(*sides).collect())
    codes = {c: n for n, c in enumerate(dict.fromkeys(a + b))}
    assert got == D.common_order(np.array([codes[c] for c in a]), np.array([codes[c] for c in b]))


def test_subtree_ends_at_any_level(spark):
    rng = random.Random(9)
    levels = [rng.choice([1, 2, 3, 1_000_000, -5, 2**40]) for _ in range(200)]
    df = spark.createDataFrame([("m", n, lv) for n, lv in enumerate(levels, 1)], "map_id string, row_no long, level long")
    ends = {r.row_no: r.end_no for r in O.subtree_end(df).collect()}
    for n, level in enumerate(levels, 1):
        later = [k for k in range(n + 1, len(levels) + 1) if levels[k - 1] <= level]
        assert ends[n] == (later[0] if later else len(levels) + 1)


def test_languages_of_deep_nodes(spark):
    # a chain of 10,000 elements; each 100th names a language, the last 10 children sit at the bottom
    n = 10_000
    rows = [("d", k, n + 9, k, {"xml:lang": f"l{k}"} if k % 100 == 0 else {}) for k in range(n)]
    rows += [("d", n + k, n + k, n, {"xml:lang": "x"} if k == 4 else None) for k in range(10)]
    rows += [("none", 0, 0, 0, None)]
    nodes = spark.createDataFrame(rows, "doc_id string, node_id long, end_id long, depth long, attrs map<string,string>")
    found = {(r.doc_id, r.node_id): r.effective_lang for r in M.effective_lang(nodes).collect()}
    assert len(found) == n + 11 and found["none", 0] is None
    assert all(found["d", k] == f"l{k // 100 * 100}" for k in range(n))
    assert [found["d", n + k] for k in range(10)] == ["x" if k == 4 else "l9900" for k in range(10)]


def test_dropped_attributes(spark):
    nodes = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, None), (3, {})], "node_id long, attrs map<string,string>")
    assert [r.attrs for r in M.drop_attrs(nodes, ["a", "c"]).orderBy("node_id").collect()] == [{"b": "2"}, None, {}]


def test_ordered_diff_fixture(spark):
    def rows(names):
        return spark.createDataFrame([("m", i, n, n) for i, n in enumerate(names)], "map_id string, row_no long, file_name string, title string")

    master, manual = rows("abcd"), rows("acbe")
    got = {(r.master_no, r.manual_no) for r in O.lcs_diff(master, manual).collect()}
    assert got == {(0, 0), (2, 1)}
    left, right = O.diff_status(master, manual, rows("abcde"))
    assert {r.file_name: r.state for r in left.collect()} == {"a": "moved", "b": "moved", "c": "moved", "d": "master-unlinked"}
    assert {r.file_name: r.state for r in right.collect()}["e"] == "manual-only"


def plain_legal_tree(topics, targets, template):
    """The same by inserting one topic after the other into a list."""
    rows = [dict(level=lv, file=f, manual=False) for lv, f in template] + [dict(level=1, file="", manual=False)]
    group = len(rows) - 1
    find = lambda f, manual=False: next((i for i, r in enumerate(rows) if f and r["file"] == f and (r["manual"] or not manual)), -1)

    def end(i):
        j = i + 1
        while j < len(rows) and rows[j]["level"] > rows[i]["level"]:
            j += 1
        return j

    heading = rows[group]
    for level, file, parent in topics:
        if file not in targets:
            continue
        at = find(file)
        if at >= 0:
            rows[at]["manual"] = True
            continue
        up = find(parent, True)
        if up < 0:
            l1, l2 = targets[file]
            up = find(l2)
            up = find(l1) if up < 0 else up
        if up >= 0:
            rows.insert(end(up), dict(level=min(6, rows[up]["level"] + 1), file=file, manual=True))
        else:
            place = next(i for i, r in enumerate(rows) if r is heading) + 1
            rows.insert(place, dict(level=max(2, min(6, level)), file=file, manual=True))
    return [(r["level"], r["file"]) for r in rows]


def test_legal_tree_matches_insertion(spark):
    rng = random.Random(5)
    topics, targets, templates, want = [], [], [], {}
    for m in range(4):
        template = [(1, "l1"), (2, "l1a"), (2, "l1b"), (1, "l2"), (2, "l2a"), (2, "both")]
        listed, chosen, stack_ = [], {}, []
        for n in range(1, 26):
            level = min(len(stack_) + 1, rng.randint(1, 4))
            del stack_[level - 1:]
            file = "both" if n == 7 else f"t{n}"
            listed.append((level, file, stack_[-1][1] if stack_ else None))
            topics.append((m, n, level, file, file, stack_[-1][0] if stack_ else None))
            stack_.append((n, file))
            if rng.random() < 0.7:
                chosen[file] = (rng.choice(["l1", "l2", "none"]), rng.choice(["", "l1a", "l2a", "gone"]))
        templates += [(m, i, lv, f, f) for i, (lv, f) in enumerate(template, 1)]
        targets.append((m, chosen))
        want[m] = plain_legal_tree(listed, chosen, template)
    for m, chosen in targets:
        t = spark.createDataFrame([x for x in topics if x[0] == m], "map_id long, row_no long, level long, title string, file_name string, topic_parent long")
        k = spark.createDataFrame([(f, a, b) for f, (a, b) in chosen.items()], "file_name string, parent_l1_file string, parent_l2_file string")
        b = spark.createDataFrame([x for x in templates if x[0] == m], "map_id long, row_no long, level long, title string, file_name string")
        got = O.build_legal_tree(t, k, b).orderBy("key_position", "key_parent", "key_top", "key_arrival").collect()
        assert [(r.level, r.file_name) for r in got] == want[m]


def test_legal_target_names(spark):
    names = {"t12.dita": True, "legal_scr01.dita": True, "legal_01.dita": False, "legal_01_02.dita": False, "x.dita": False, "LEGAL_a.DITA": True}
    df = spark.createDataFrame([(n,) for n in names], "f string").select("f", O.is_legal_target(F.col("f")).alias("x"))
    assert {r.f: r.x for r in df.collect()} == names


XML = """<map xml:lang="en"><title>T</title><topicref href="a"><topicmeta><data href="img"/></topicmeta>
<group><topicref href="b" xml:lang="fr"><topicref href="c"/></topicref></group></topicref>
<draft-comment>x<b>y</b></draft-comment><topichead><topicref href="d"/></topichead></map>"""


def test_markup_nodes(spark):
    docs = spark.createDataFrame([("x", XML), ("broken", "<a><b></a>")], "doc_id string, body string")
    nodes = markup.node_table(docs, "doc_id", "body").cache()
    assert {r.doc_id for r in nodes.collect()} == {"x"}
    flat = M.flatten_tree(nodes).orderBy("node_id").collect()
    assert [(r.tag, r.attrs.get("href"), r.level) for r in flat] == [
        ("topicref", "a", 1), ("topicref", "b", 2), ("topicref", "c", 3), ("topichead", None, 1), ("topicref", "d", 2)]
    kept = M.prune(nodes, F.col("tag").isin("draft-comment", "topicmeta"))
    assert {r.tag for r in kept.collect()}.isdisjoint({"draft-comment", "b", "topicmeta", "data"})
    langs = {r.attrs.get("href"): r.effective_lang for r in M.effective_lang(nodes).where("tag = 'topicref'").collect()}
    assert langs == {"a": "en", "b": "fr", "c": "fr", "d": "en"}
    target = nodes.where("tag = 'topicref'").select("doc_id", "node_id", F.lit("href").alias("name"), F.lit(None).cast("string").alias("value"), F.lit(1).alias("seq"))
    changed = M.update_attrs(nodes, target).where("tag = 'topicref'").collect()
    assert sorted(len(r.attrs) for r in changed) == [0, 0, 0, 1]
    ids = O.assign_ids(spark.createDataFrame([("d", 0, "map", None), ("d", 1, "concept", "c1"), ("d", 2, "p", "p1"), ("d", 3, "task", None), ("d", 4, "p", "p2")], "doc_id string, node_id long, tag string, id string"))
    assert [r.nid for r in ids.orderBy("node_id").collect()] == [None, "t00000", "e00001", "t00001", "e00002"]


def test_inline_spacing_and_labels(spark):
    body = ("<c><p>Press<b>A</b>now</p><p>x(<b>UP</b>)</p><p>t<indexterm>k</indexterm>u</p><p>A: door</p>"
            "<tbody><entry><p>ZR</p></entry><entry><p><b>A, B</b></p></entry></tbody><menucascade><uicontrol>UP</uicontrol></menucascade>"
            "<uicontrol>UP</uicontrol><i>old</i></c>")
    nodes = markup.node_table(spark.createDataFrame([("d", body)], "doc_id string, body string"), "doc_id", "body").cache()
    spaced = M.space_inline(nodes)
    got = {r.text or r.tag: (r.space_before, r.space_after) for r in spaced.orderBy("node_id").collect() if r.parent_id and r.parent_id < 8}
    assert got["Press"] == (False, True) and got["now"] == (True, False) and got["b"] == (True, False)
    assert got["x("] == (False, False) and got[")"] == (False, False)
    rules = [(r.label, r.tag, r.rule) for r in M.refine_labels(nodes, ["UP"]).orderBy("node_id").collect()]
    assert ("A: door", "p", "label") in rules and ("ZR", "p", "letter") in rules and ("A, B", "b", "letters") in rules
    assert ("A", "b", "unwrap") in rules and ("UP", "b", "unwrap") in rules and ("old", "i", "plain") in rules
    assert [r for r in rules if r[1] == "uicontrol"] == [("UP", "uicontrol", None), ("UP", "uicontrol", "unwrap")]


def test_terms_in_places(spark):
    body = ('<c><title>UP here</title><p>go UP now</p><p translate="no">UP <b>UP</b></p><p>DOOR mode UP</p>'
            '<p>see B: UP</p><uicontrol>UP</uicontrol></c>')
    nodes = markup.node_table(spark.createDataFrame([("d", body)], "doc_id string, body string"), "doc_id", "body")
    terms = spark.createDataFrame([("UP",)], "term string")
    got = [r.text for r in M.tag_node_terms(nodes, terms).where("tag = '#text'").orderBy("node_id").collect()]
    t = '<term translate="no">{}</term>'.format
    assert got == ["UP here", f"go {t('UP')} now", "UP ", "UP", f"{t('DOOR')} mode UP", f"see {t('B')}: UP", "UP"]


def test_folder_paths(spark):
    rows = [("a", "root", "A"), ("loose", None, "L"), ("x", "y", "X"), ("y", "x", "Y")]
    rows += [(f"n{i}", f"n{i - 1}" if i else "a", f"N{i}") for i in range(20)]
    got = {r.id: (r.path, r.reached) for r in H.folder_path(spark.createDataFrame(rows, "id string, parent_id string, name string"), "root").collect()}
    assert got["a"] == ("", True) and got["n2"] == ("A/N0/N1", True)
    assert got["n19"][0] == "/".join(["A"] + [f"N{i}" for i in range(19)])
    assert got["loose"] == (None, False) and got["x"] == (None, False)


def test_file_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m.txt").write_text("# note\nar-AE=Arabic\nx=a=b\n\n")
    (tmp_path / "in" / "d.xml").write_text('<db><pair hash="H1"><new>n</new></pair><pair hash="H2"/></db>')
    assert {(r.key, r.value) for r in files.read_kv(spark, str(tmp_path / "in" / "m.txt")).collect()} == {("ar-AE", "Arabic"), ("x", "a=b")}
    pairs = files.read_dictionary(spark, str(tmp_path / "in" / "d.xml"), "pair", "_hash string, new string")
    assert {(r["_hash"], r.new) for r in pairs.collect()} == {("H1", "n"), ("H2", None)}
    assert [r.file_name for r in files.list_files(spark, str(tmp_path / "in"), [".XML"]).collect()] == ["d.xml"]
    assert markup.read_markup(spark, str(tmp_path / "in")).where("tag = 'pair'").count() == 2
    df = spark.range(100).select((F.col("id") % 3).alias("chapter"), "id")
    files.write_split(df, str(tmp_path / "split"), "chapter", "id")
    assert spark.read.parquet(str(tmp_path / "split")).count() == 100
    files.write_report(df, str(tmp_path / "report"), ["id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 100


def test_presence_counts_users_once(spark):
    log = [(1, "JOIN", 1, "a"), (2, "JOIN", 1, "b"), (3, "LEAVE", 1, "a"), (4, "JOIN", 2, "c"), (5, "LEAVE", 1, "b"), (6, "LEAVE", 1, "b"), (7, "PING", 9, "z")]
    df = spark.createDataFrame([(i, 7, u, t, s) for i, t, u, s in log], "event_id long, room long, user_id long, type string, session string").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 100))
    got = [r.present_users for r in E.presence(df).orderBy("event_id").collect()]
    assert got == [1, 1, 1, 2, 1, 1]


def test_streams_agree_with_tables(spark, tmp_path):
    log = [(1, 1, "STARTED"), (2, 1, "FAILED"), (3, 2, "STARTED"), (4, 3, "SUCCESS"), (90000, 4, "STARTED"), (200000, 4, "SUCCESS")]
    df = spark.createDataFrame(log, "s long, id long, status string").select(F.timestamp_seconds("s").alias("ts"), "id", "status")
    df.repartition(1).write.parquet(str(tmp_path / "log"))
    stream = E.read_events(spark, str(tmp_path / "log"), df.schema)
    merged = E.merge_runs(E.drain(E.job_stream(stream), combine=E.ends_of_runs))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, E.job_runs(df).collect()))
    assert {r.id: (r.status, r.elapsed_ms) for r in merged.collect()} == {1: ("FAILED", 1000), 2: ("STARTED", None), 4: ("SUCCESS", 110000000)}


@pytest.mark.parametrize("n_files", [1, 3, 10])
def test_streams_do_not_depend_on_batches_or_order(spark, tmp_path, n_files):
    log = [
        (i, 40_000 * (i * 7 % 20), i % 2, i % 3, "t" if i % 5 else "u", ["JOIN", "LEAVE", "JOIN"][i % 3]) for i in range(40)
    ]
    df = spark.createDataFrame(log, "event_id long, s long, room long, user_id long, session string, type string")
    df = df.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    # the newest events come in the first file
    df.orderBy(F.desc("ts")).repartitionByRange(n_files, F.desc("ts")).write.parquet(str(tmp_path / "log"))
    stream = E.read_events(spark, str(tmp_path / "log"), df.schema, files_per_batch=1)

    last = {}
    for r in df.orderBy("ts", "event_id").collect():
        last[r.room, r.user_id, r.session] = r.type
    rooms = {}
    for (room, user, _), kind in last.items():
        if kind == "JOIN":
            rooms.setdefault(room, set()).add(user)
    got = E.present_users(E.drain(E.presence_stream(stream), combine=E.last_moves))
    assert {r.room: r.present_users for r in got.collect()} == {k: len(v) for k, v in rooms.items()}
    ends = E.presence(df).groupBy("room").agg(F.max_by("present_users", F.struct("ts", "event_id")).alias("n"))
    assert {r.room: r.n for r in ends.where("n > 0").collect()} == {k: len(v) for k, v in rooms.items()}

    changes = stream.select(F.col("room").alias("doc_id"), "ts")
    sent = E.signals(E.drain(E.change_feed(changes, 86_400), combine=E.signals))
    days = {(room, s // 86_400) for _, s, room, *_ in log}
    got = sent.select("doc_id", F.unix_seconds("signal_at").alias("at")).collect()
    assert sorted((r.doc_id, r["at"] / 86_400) for r in got) == sorted(days)


def test_bad_messages_are_dropped(spark):
    df = spark.createDataFrame([(1, '{"type":"JOIN","commentId":5}'), (2, "{oops"), (3, "null")], "i int, m string")
    got = E.parse_messages(df, "m", "type string, commentId long").collect()
    assert [(r.i, r.type, r.commentId) for r in got] == [(1, "JOIN", 5)]


def test_rows_of_a_parent_loop_have_no_root(spark):
    from folioflow.operators.hierarchy import chain_roots

    rows = [(1, 1, 2), (1, 2, 1), (1, 3, 2), (1, 4, None), (1, 5, 4), (1, 6, 9)]
    items = spark.createDataFrame(rows, "map_id int, id int, up int")
    found = {r.id: (r.root, r.hops) for r in chain_roots(items, "map_id", "id", "up").collect()}
    assert found == {1: (None, None), 2: (None, None), 3: (None, None), 4: (4, 0), 5: (4, 1), 6: (6, 0)}


def test_topics_without_href_stay_and_lookups_are_unique(spark):
    from folioflow.operators import toc

    rows = spark.createDataFrame(
        [(1, 1, None, "a"), (1, 2, 1, "a"), (1, 3, 1, None)], "map_id int, row_no int, parent_no int, href string"
    )
    assert sorted(r.row_no for r in toc.split_topics(rows).collect()) == [1, 3]
    shown = spark.createDataFrame(
        [("a.dita", None, None, None, None)],
        "file_name string, navtitle_attr string, title string, navtitle string, linktext string",
    )
    topics = spark.createDataFrame([("a.dita", "B"), ("a.dita", "A")], "file_name string, title string")
    assert [r.shown_title for r in toc.title_of(shown, topics).collect()] == ["A"]
