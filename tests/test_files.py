"""File sources and sinks: what is written comes back, broken rows apart."""

import hashlib
import os

from pyspark.sql import functions as F

from folioflow.operators import markup as M
from folioflow.sources import files, markup


def test_dictionaries_come_back(spark, tmp_path):
    rows = [("H1", "a & <b> \"q\"", 1), ("H2", "  spaced  ", 2), ("H3", "bad\x01char", 3), (None, "x", 4), ("H5", None, 5), ("H6", "ünï 日本 😀", 6)]
    df = spark.createDataFrame(rows, "_hash string, new string, _pos int")
    path = str(tmp_path / "pairs")
    files.write_dictionary(df, path, "db", "pair")
    back = files.read_dictionary(spark, path, "pair", "_hash string, new string, _pos int")
    want = {(h, n.replace("\x01", "�") if n else n, p) for h, n, p in rows}
    assert {(r["_hash"], r.new, r["_pos"]) for r in back.collect()} == want


def test_broken_dictionary_rows_are_set_apart(spark, tmp_path):
    path = tmp_path / "d.xml"
    path.write_text('<db><pair pos="1"><new>a</new></pair><pair pos="x"><new>b</new></pair><pair pos="3"><new>c</new></pair></db>')
    schema = "_pos int, new string"
    good = files.read_dictionary(spark, str(path), "pair", schema).collect()
    broken = files.broken_rows(spark, str(path), "pair", schema).collect()
    assert {r.new for r in good} == {"a", "c"} and len(broken) == 1
    assert '"new":"b"' in broken[0].row and broken[0].file.endswith("d.xml")


def test_key_values_come_back(spark, tmp_path):
    rows = [("a", "1"), ("b", "x=y"), ("c", "two\nlines"), (None, "n"), ("d", None)]
    files.write_kv(spark.createDataFrame(rows, "key string, value string"), str(tmp_path / "kv"), "note")
    back = {(r.key, r.value) for r in files.read_kv(spark, str(tmp_path / "kv")).collect()}
    assert back == {("a", "1"), ("b", "x=y"), ("c", "two lines")}


def test_a_hot_chapter_is_split_by_its_size(spark, tmp_path):
    df = spark.range(10_000).select(F.when(F.col("id") < 9000, 0).otherwise(F.col("id") % 5).alias("chapter"), "id")
    path = str(tmp_path / "split")
    files.write_split(df, path, "chapter", "id", rows_per_file=500)
    parts = [f for f in os.listdir(f"{path}/chapter=0") if f.endswith(".parquet")]
    assert len(parts) >= 15
    sizes = [spark.read.parquet(f"{path}/chapter=0/{f}").count() for f in parts]
    assert max(sizes) < 1500 and sum(sizes) == 9200
    assert spark.read.parquet(path).count() == 10_000
    files.write_split(df.where("id < 0"), str(tmp_path / "none"), "chapter", "id")


def test_named_files_and_inventory(spark, tmp_path):
    df = spark.createDataFrame([("a.xml", "<a/>"), ("b.XML", "<b/>"), ("none.xml", None), (None, "x"), ("c.txt", "é")], "name string, body string")
    written = files.write_named(df, str(tmp_path / "out"), "name", "body")
    assert {(r.file_name, r.n_bytes) for r in written.collect()} == {("a.xml", 4), ("b.XML", 4), ("none.xml", 0), ("c.txt", 2)}
    assert {r.file_name for r in files.list_files(spark, str(tmp_path / "out"), [".xml"]).collect()} == {"a.xml", "b.XML"}


def test_reports_keep_their_order(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), "id").repartition(7)
    files.write_report(df, str(tmp_path / "report"), ["k"])
    back = spark.read.schema("k long, id long").option("header", True).csv(str(tmp_path / "report")).select(
        "*", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line")
    )
    assert [r.k for r in files.placed_in_files(back, ["file"], "line").orderBy("place").collect()] == list(range(5000))


def test_block_hashes_take_all_text_below(spark):
    body = "<c><p>Go <b>2 – 3 <i>km</i></b> on<br/></p><p/><p>a<p>b</p></p></c>"
    nodes = markup.node_table(spark.createDataFrame([("d", body)], "doc_id string, body string"), "doc_id", "body")
    got = [r.hash for r in M.block_hashes(nodes, ["p"]).orderBy("node_id").collect()]
    want = ["Go b2  ~  3 km onbr", "", "apb", "b"]
    assert got == [hashlib.sha256(w.encode()).hexdigest().upper() for w in want]
