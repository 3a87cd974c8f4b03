"""Blocked scans against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import ordered
from folioflow.operators.ordered import Running, collected, first_per, gathered, number_blocks, numbered, running


@pytest.fixture(autouse=True, params=["blocks", "plain"])
def way(request, monkeypatch):
    monkeypatch.setattr(ordered, "HOT_ROWS", 0 if request.param == "blocks" else 10**9)
    return request.param


def rows(seed, n=400):
    rng = random.Random(seed)
    # one key holds most rows
    keys = ["hot" if rng.random() < 0.6 else rng.choice("abc") for _ in range(n)]
    order = rng.sample(range(-5000, 5000), n)
    return [(k, o, rng.choice([None, rng.randint(-9, 9)])) for k, o in zip(keys, order)]


def expected(data, reverse=False):
    out = {}
    for key in {r[0] for r in data}:
        mine = sorted((r for r in data if r[0] == key), key=lambda r: r[1], reverse=reverse)
        n, total, low, high, last = 0, None, None, None, None
        for k, o, v in mine:
            before = last
            n += 1
            if v is not None:
                total = v if total is None else total + v
                low = v if low is None else min(low, v)
                high = v if high is None else max(high, v)
                last = v
            out[(k, o)] = (n, total, low, high, last, before)
    return out


@pytest.mark.parametrize("width", [7, 1000, 10**6])
@pytest.mark.parametrize("reverse", [False, True])
def test_running_matches_plain_scan(spark, width, reverse):
    data = rows(width)
    df = spark.createDataFrame(data, "k string, o long, v long")
    v = F.col("v")
    outs = {
        "n": Running("count"), "total": Running("sum", v), "low": Running("min", v), "high": Running("max", v),
        "latest": Running("last", v), "was": Running("last", v, exclusive=True),
    }
    got = running(df, ["k"], ["o"], number_blocks("o", width), outs, reverse).collect()
    want = expected(data, reverse)
    assert len(got) == len(data)
    for r in got:
        assert (r.n, r.total, r.low, r.high, r.latest, r.was) == want[(r.k, r.o)]


def test_two_block_levels(spark):
    data = rows(3)
    df = spark.createDataFrame(data, "k string, o long, v long")
    blocks = number_blocks("o", 1000) + number_blocks("o", 50)
    got = numbered(df, ["k"], ["o"], blocks, start=0).collect()
    want = expected(data)
    assert {(r.k, r.o): r.row_no + 1 for r in got} == {k: v[0] for k, v in want.items()}


def test_only_hot_groups_walk_in_blocks(spark, monkeypatch):
    df = spark.range(10_000).select(F.lit("hot").alias("k"), F.col("id").alias("o"))
    for limit, blocked in ((9_999, True), (10_000, False)):
        monkeypatch.setattr(ordered, "HOT_ROWS", limit)
        got = numbered(df, ["k"], ["o"], number_blocks("o", 100))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert ("_block0" in plan) is blocked
        assert got.where("row_no <> o + 1").count() == 0


def test_gathered_keeps_everything_in_parts(spark):
    df = spark.range(1, 26).select(F.lit(1).alias("g"), F.col("id").alias("n"))
    parts = gathered(df, ["g"], "n", {"xs": F.col("n")}, per_part=10).orderBy("part_no").collect()
    assert [len(p.xs) for p in parts] == [10, 10, 5]
    assert [x for p in parts for x in p.xs] == list(range(1, 26))


def test_first_per(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None)], "k string, o int, v string")
    assert {(r.k, r.v) for r in first_per(df, ["k"], ["o"]).collect()} == {("a", "y"), ("b", None)}
    assert {(r.k, r.v) for r in first_per(df, ["k"], ["o"], last=True).collect()} == {("a", "x"), ("b", None)}


def test_collected_agrees_with_gathered(spark, way):
    df = spark.createDataFrame([(k, o, v) for k, o, v in rows(9)], "k string, o long, v long")
    got = collected(df, ["k"], ["o"], number_blocks("o", 100), {"vs": F.col("v")}, per_part=10**6).collect()
    for r in got:
        assert r.part_no == 0
        assert r.vs == [v for _, _, v in sorted((x for x in rows(9) if x[0] == r.k), key=lambda x: x[1])]


@pytest.mark.parametrize("reverse", [False, True])
def test_null_keys_and_times_stay_in_blocks(spark, monkeypatch, reverse):
    rows = [(d, None if i % 3 == 0 else f"2024-01-0{i % 7 + 1}", i) for d in (1, None) for i in range(20)]
    df = spark.createDataFrame(rows, "doc int, day string, id int")

    def run():
        blocks = ordered.dated_blocks("day", "id", 4)
        out = ordered.numbered(df, ["doc"], ["day", "id"], blocks, reverse=reverse)
        return sorted(((r.doc, r.day, r.id, r.row_no) for r in out.collect()), key=str)

    plain = run()
    monkeypatch.setattr(ordered, "HOT_ROWS", 0)
    assert len(plain) == 40 and run() == plain
