"""Streams that answer at every event, over several files, against the batch twins."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.streaming import events as E
from folioflow.streaming import live as L

SCHEMA = "event_id long, ts timestamp, room long, user_id long, session string, type string, comment_id long"


def history():
    rng = random.Random(4)
    kinds = [E.JOIN, E.LEAVE, E.EDITING_START, E.EDITING_STOP, "PING"]
    return [
        (i, 60_000_000 * (i // 3), rng.choice([1, 1, 1, 2, 3]), rng.randint(1, 4), rng.choice(["a", "b"]),
         rng.choice(kinds), rng.randint(1, 5))
        for i in range(600)
    ]


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.createDataFrame(history(), SCHEMA.replace("ts timestamp", "us long"))
    return rows.select("event_id", F.timestamp_micros("us").alias("ts"), "room", "user_id", "session", "type", "comment_id")


def in_files(spark, table, folder, n):
    for k in range(n):
        part = table.where(f"event_id div {600 // n} = {k}").coalesce(1)
        part.write.mode("append").parquet(str(folder))
    return E.read_events(spark, str(folder), SCHEMA, files_per_batch=1)


@pytest.mark.parametrize("n", [1, 3, 10])
def test_presence_is_pushed_at_every_move(spark, table, tmp_path, n):
    got = L.presence_live(in_files(spark, table, tmp_path, n)).collect()
    want = {(r.event_id, r.room, r.user_id, r.open_sessions, r.present_users) for r in E.presence(table).collect()}
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    assert len({r.batch_no for r in got}) == n


@pytest.mark.parametrize("n", [1, 3, 10])
def test_edits_end_in_the_stream(spark, table, tmp_path, n):
    comments = spark.createDataFrame([(c, r) for r in (1, 2, 3) for c in range(1, 5)], "comment_id long, doc_id long")
    updates = E.drain(L.editing_updates(in_files(spark, table, tmp_path, n), comments))
    got = {(r.event_id, r.room, r.user_id, r.comment_id, r.started_at, r.ended_at) for r in L.edits(updates.drop("batch_no")).collect()}
    want = {
        (r.event_id, r.room, r.user_id, r.comment_id, r.started_at, r.ended_at)
        for r in E.editing_intervals(table, comments).collect()
    }
    assert got == want and any(r[5] is None for r in got)


def test_state_ends_with_the_last_session(spark, tmp_path):
    moves = [(1, "a", E.JOIN), (1, "b", E.JOIN), (2, "a", E.JOIN), (1, "a", E.LEAVE), (2, "a", E.LEAVE), (1, "b", E.LEAVE)]
    rows = [(i, 0, 7, user, session, kind, None) for i, (user, session, kind) in enumerate(moves)]
    table = spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "us long")).select(
        "event_id", F.timestamp_micros("us").alias("ts"), "room", "user_id", "session", "type", "comment_id"
    )
    folder = tmp_path / "moves"
    for k in range(2):
        table.where(f"event_id div 3 = {k}").coalesce(1).write.mode("append").parquet(str(folder))
    stream = L.presence_steps(E.read_events(spark, str(folder), SCHEMA, files_per_batch=1))
    kept = []

    def watch(batch, number):
        kept.append(batch.count())

    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(watch).start()
    query.awaitTermination()
    left = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]
    assert kept == [3, 3] and left == [2, 0]
