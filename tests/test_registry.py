import datetime as dt

from pyspark.sql import functions as F

from folioflow.functions import chapters as CH
from folioflow.operators import layout as L
from folioflow.operators import registry as R
from folioflow.operators import upkeep as U
from folioflow.sources import sheets

T0 = dt.datetime(2026, 1, 1)
ROWS = [
    (4, "N_NEW_001", "v"), (5, "N_EXISTING_001", "V"), (6, "N_CHANGED_001", "v"), (7, "N_INVALID_001", "O"),
    (8, "", "X"), (9, "N_BLANK_NEW_001", ""), (10, "N_BLANK_EXISTING_001", ""), (11, " ", " "),
]
OLD = [("N_EXISTING_001", "V", T0), ("n_changed_001 ", "X", T0), ("N_BLANK_EXISTING_001", "V", T0)]


def data(spark, rows=ROWS):
    return (
        spark.createDataFrame(OLD, "name string, value string, reg_dt timestamp"),
        spark.createDataFrame(rows, "row_no long, name string, value string"),
    )


def test_import_outcomes(spark):
    registry, rows = data(spark)
    details = R.import_details(registry, rows)
    assert {r.row_no: (r.applied, r.result) for r in details.collect()} == {
        4: ("V", "new"), 5: ("V", "same"), 6: ("V", "changed"), 7: ("", "skipped"), 8: ("", "skipped"),
        9: ("X", "new"), 10: ("X", "changed"),
    }
    s = R.import_summary(details).first()
    assert (s.total_rows, s.inserted, s.updated, s.unchanged, s.skipped) == (7, 2, 2, 1, 2)


def test_second_import_changes_nothing(spark):
    registry, rows = data(spark)
    now = F.lit(dt.datetime(2026, 2, 1)).cast("timestamp")
    table, _ = R.upsert_registry(registry, rows, now)
    again = R.import_summary(R.import_details(table.drop("canon"), rows)).first()
    assert (again.inserted, again.updated, again.unchanged) == (0, 0, 5)
    kept = {r.canon: r.reg_dt for r in table.collect()}
    assert kept["N_CHANGED_001"] == T0 and kept["N_NEW_001"] == dt.datetime(2026, 2, 1)


def test_invalid_row_does_not_displace_a_valid_one(spark):
    registry, rows = data(spark, [(1, "A_0000001", "V"), (2, "a_0000001", "X"), (3, "A_0000001", "bad")])
    got = {r.row_no: (r.result, r.note) for r in R.import_details(registry, rows).collect()}
    assert got[1] == ("skipped", R.NOTE_SUPERSEDED)
    assert got[2][0] == "new" and got[3] == ("skipped", R.NOTE_BAD_VALUE)


def test_order_sheet_spine(spark):
    schema = "sheet string, row_no long, name string, color_value string, chapter string, chapter_no string"
    rows = [("s", 1, "a", "V", "", "q"), ("s", 2, "b", "v", "x", "2"), ("s", 3, "c", "X", "x", "3"),
            ("t", 1, "d", "V", "x", "12"), ("t", 2, "e", "V", "x", "A")]
    entries = R.selected_entries(spark.createDataFrame(rows, schema))
    got = {(r.sheet, r.chapter): (r.entry_count, r.amount) for r in R.order_summary(entries, "sheet").collect()}
    assert [c for s, c in got if s == "s"].__len__() == 12 and len([1 for s, _ in got if s == "t"]) == 13
    assert got["s", "Q"] == (1, 4500) and got["s", "2"] == (1, 4500) and got["s", "3"] == (0, 0)
    assert got["t", "12"] == (1, 4500) and got["t", "1"] == (1, 4500)
    lines = R.order_lines(entries, "sheet", F.lit("car"))
    assert lines.where("sheet = 's' and line_no = 1").first().chapter == R.DEFAULT_CHAPTER
    totals = {r.sheet: (r.quantity, r.amount) for r in R.order_totals(lines, "sheet").collect()}
    assert totals == {"s": (2, 9000), "t": (2, 9000), None: (4, 18000)}


def test_labels_and_first_occurrence(spark):
    lines = [("OCL4M035125N", 5.0, 1), ("MEMORY1", 7.0, 2), ("N_SP327_B06_060", 5.0, 3), ("n_sp327_b06_060", 5.0, 4),
             ("PLAINTEXT", 5.0, 5), ("A B1234567", 5.0, 6), ("XYZ_C00_048", 5.5, 7)]
    df = spark.createDataFrame([("d", 1, p, t, f) for t, f, p in lines], "doc_id string, page int, pos int, text string, font_size double")
    found = R.first_occurrence(R.drawing_lines(df), ["doc_id"], ["page", "pos"])
    assert {r.text for r in found.collect()} == {"OCL4M035125N", "N_SP327_B06_060", "XYZ_C00_048"}


def test_color_check_ignores_case_and_space(spark):
    registry = spark.createDataFrame([("  N_SP3I26_B04  ", " x ", T0), ("OTHER", "?", T0)], "name string, value string, reg_dt timestamp")
    entries = spark.createDataFrame([("N_SP3i26_B04",), ("other",), ("none",)], "name string")
    got = {r.name: r.check_value for r in R.with_color_check(entries, registry).collect()}
    assert got == {"N_SP3i26_B04": "X", "other": "", "none": ""}


def test_chapter_titles(spark):
    cases = {
        "제 7장 시동 및 주행": ("시동 및 주행", "7"), "비상시 응급조치": ("비상시 응급 조치", ""),
        "7 Hybrid vehicle guide": ("Hybrid vehicle guide", "7"), "Chapter 4 Door controls": ("Door controls", "4"),
        "7 Unknown words": None, "Chapter 4": None, "overview": ("Overview", "2"), "": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", CH.recognize_chapter(F.col("t")).alias("c"))
    assert {r.t: (tuple(r.c) if r.c else None) for r in df.collect()} == cases
    outline = spark.createDataFrame([("Q Quick start",)], "t string").select(CH.recognize_chapter(F.col("t"), True).alias("c")).first()
    assert tuple(outline.c) == ("Quick start", "Q")


def test_every_known_chapter_alias(spark):
    pairs = [(n, t) for t, others in CH.TITLES.items() for n in (t, *others)]
    df = spark.createDataFrame(pairs, "t string, want string")
    assert df.where(~CH.recognize_chapter(F.col("t"))["title"].eqNullSafe(F.col("want"))).count() == 0


def test_page_chapters(spark):
    pages = spark.createDataFrame([("d", p, t) for p, t in enumerate([None, "a", None, "b", None])], "doc_id string, page int, detected string")
    outline = spark.createDataFrame([("d", 3, "out", 1), ("d", 3, "out2", 2), ("d", 9, "late", 3)], "doc_id string, page int, title string, seq int")
    got = [r.chapter for r in L.chapter_for_pages(pages, outline).orderBy("page").collect()]
    assert got == [None, "a", "a", "out2", "out2"]


def test_sheet_scan(spark):
    cells = [("f", 1, 1, 0, "title"), ("f", 1, 3, 0, "도안명"), ("f", 1, 3, 1, "레드도안"), ("f", 1, 3, 2, "컬러 도안"),
             ("f", 1, 4, 0, "A"), ("f", 1, 4, 2, "v"), ("f", 1, 5, 0, "B"),
             ("late", 1, 25, 0, "도안명"), ("late", 1, 25, 1, "컬러도안"), ("late", 1, 26, 0, "C")]
    df = spark.createDataFrame(cells, "file string, sheet_no int, row_no long, col_no int, value string")
    roles = {"name": ["도안명"], "value": ["컬러도안"]}
    assert {(r.file, r.row_no, r.name, r.value) for r in sheets.read_sheet(df, roles).collect()} == {("f", 4, "A", "v"), ("f", 5, "B", "")}
    assert {r.file for r in sheets.discover_header(df, roles, max_rows=None).collect()} == {"f", "late"}


def test_register_gives_dense_new_ids(spark):
    table = spark.createDataFrame([("a", 7)], "ext string, id long")
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("b",)], "ext string")
    got = {r.ext: r.id for r in U.register(table, items, "ext", "id").collect()}
    assert got["a"] == 7 and sorted([got["b"], got["c"]]) == [8, 9]


def test_chapter_file_order(spark):
    names = ["02_Intro.xml", "00", "01.txt", "Foreword.xml", "zeta.xml", "Alpha.xml"]
    df = spark.createDataFrame([("d", n, i) for i, n in enumerate(names)], "dir string, file_name string, i int")
    got = [r.file_name for r in U.order_chapters(df, "dir", "i").orderBy("position").collect()]
    assert got == ["Foreword.xml", "00", "01.txt", "02_Intro.xml", "Alpha.xml", "zeta.xml"]


def test_bookmap_leaves_other_files_out(spark):
    names = ["02_Intro.xml", "00", "01.txt", "memo.txt"]
    df = spark.createDataFrame([("d", n, i) for i, n in enumerate(names)], "dir string, file_name string, i int")
    got = [r.file_name for r in U.bookmap(df, "dir", "i").orderBy("position").collect()]
    assert got == ["00", "01.txt", "02_Intro.xml"]


def test_large_chapters_are_counted(spark):
    from folioflow.operators import registry

    entries = spark.createDataFrame([(1, "99999999999"), (1, "2")], "doc_id int, chapter_no string")
    found = {r.chapter: r.entry_count for r in registry.order_summary(entries, "doc_id").collect()}
    assert found["99999999999"] == 1 and found["2"] == 1 and sum(found.values()) == 2 and found["11"] == 0


def test_order_sheets_are_dense_up_to_high_chapters(spark):
    from folioflow.operators import registry

    entries = spark.createDataFrame([(1, "1"), (1, "2000000"), (2, "3")], "doc_id int, chapter_no string")
    found = registry.order_summary(entries, "doc_id")
    sums = {r.doc_id: (r.n, r.top, r.entries) for r in found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("position").alias("top"), F.sum("entry_count").alias("entries")).collect()}
    assert sums == {1: (2_000_001, 2_000_000, 2), 2: (12, 11, 1)}
    assert found.where("doc_id = 1").select("position").distinct().count() == 2_000_001
