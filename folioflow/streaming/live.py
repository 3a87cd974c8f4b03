"""Live answers at every event: who is present in a room, who edits which comment.

Sessions and open edits are keyed state of Spark's state store, one entry per room and part of its users
(``USER_PARTS``, so that calls into Python do not grow with the users), and they leave it when the
sessions or edits end. The store lies in the query's checkpoint folder, so
it survives lost executors. What concerns a whole room is not kept in one key, since one room may get a
third of all events: each micro-batch adds up the users' steps as an ordered running sum, which is walked
in blocks where a room is large, on top of the counts that the batch before has written.

Events count in the order they come: by (ts, event_id) inside a micro-batch, batch after batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordered import Running, running, time_blocks
from ..session import settle, shared_folder
from .events import JOIN, LEAVE, editing_feed

#: parts that the users of a room fall into; users that are null have one of their own
USER_PARTS = 64
STEPS = "event_id long, ts timestamp, room {room}, user_id {user}, open_sessions long, step long"
ROOMS = "room {room}, present_users long"
EDITS = "event_id long, room {room}, user_id {user}, comment_id long, started_at timestamp, ended_at timestamp"


def _typed(ddl: str, events: DataFrame) -> str:
    kinds = dict(events.dtypes)
    return ddl.format(room=kinds["room"], user=kinds["user_id"])


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The events of one key in one micro-batch."""
    return pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")


def _user_part():
    user = F.col("user_id")
    return F.when(user.isNull(), -1).otherwise(F.pmod(F.hash(user), F.lit(USER_PARTS)))


def _plain(values: pd.Series) -> list:
    """Values of a part, which holds either no null or nulls only."""
    return [None] * len(values) if values.isna().any() else values.tolist()


# -- presence --------------------------------------------------------------------------------


def presence_steps(events: DataFrame) -> DataFrame:
    """Open sessions of a user in a room after each join or leave, and the step from or to presence.

    A repeated join, or a leave of a session that is not open, changes nothing and gives a row, too.
    """
    moves = events.where(F.col("type").isin(JOIN, LEAVE)).select(
        F.col("event_id").cast("long").alias("event_id"), "ts", "room", "user_id",
        F.coalesce(F.col("session").cast("string"), F.lit("")).alias("session"), (F.col("type") == JOIN).alias("joins"),
    )

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened: dict[object, set[str]] = {}
        if state.exists:
            for user, session in zip(*state.get):
                opened.setdefault(user, set()).add(session)
        moved = _in_order(frames)
        users = _plain(moved["user_id"])
        counts, steps = [], []
        for user, session, joins in zip(users, moved["session"].tolist(), moved["joins"].tolist()):
            sessions = opened.setdefault(user, set())
            before = bool(sessions)
            if joins:
                sessions.add(session)
            else:
                sessions.discard(session)
            counts.append(len(sessions))
            steps.append(int(bool(sessions)) - int(before))
        left = [(user, session) for user, sessions in opened.items() for session in sorted(sessions)]
        if left:
            state.update(([user for user, _ in left], [session for _, session in left]))
        elif state.exists:
            state.remove()
        out = moved[["event_id", "ts"]]
        room = pd.Series([key[0]] * len(out), index=out.index, dtype=object)
        user_id = pd.Series(users, index=out.index, dtype=object)
        yield out.assign(room=room, user_id=user_id, open_sessions=counts, step=steps)

    return moves.withColumn("part", _user_part()).groupBy("room", "part").applyInPandasWithState(
        follow, _typed(STEPS, events), _typed("users array<{user}>, sessions array<string>", events), "append",
        GroupStateTimeout.NoTimeout,
    )


def room_counts(steps: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Present users after every step, and at the end in every room that has some.

    ``before`` holds (room, present_users) of rooms that had users before these steps.
    """
    moved = running(steps, ["room"], ["ts", "event_id"], time_blocks("ts"), {"_moved": Running("sum", F.col("step"))})
    known = before.select(F.col("room").alias("_room"), F.col("present_users").alias("_before"))
    counted = moved.join(known, F.col("room").eqNullSafe(F.col("_room")), "left")
    present = (F.col("_moved") + F.coalesce("_before", F.lit(0))).alias("present_users")
    rows = counted.select("event_id", "room", "user_id", "open_sessions", present)
    both = steps.select("room", F.col("step").alias("present_users")).unionByName(before)
    after = both.groupBy("room").agg(F.sum("present_users").alias("present_users")).where("present_users > 0")
    return rows, after


def presence_live(events: DataFrame) -> DataFrame:
    """Follow a stream of events to its present end: (event_id, room, user_id, open_sessions, present_users, batch_no).

    Every row is emitted in the micro-batch of its event, as it is written below the shared folder.
    """
    spark = events.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/presence-{uuid.uuid4().hex}"
    rooms = _typed(ROOMS, events)

    def keep(batch: DataFrame, number: int) -> None:
        steps = settle(batch)
        if number:
            before = spark.read.schema(rooms).parquet(f"{base}/rooms/batch_no={number - 1}")
        else:
            before = spark.createDataFrame([], rooms)
        rows, after = room_counts(steps, before)
        rows.write.mode("overwrite").parquet(f"{base}/rows/batch_no={number}")
        after.write.mode("overwrite").parquet(f"{base}/rooms/batch_no={number}")

    _run(presence_steps(events), keep, base)
    columns = _typed("event_id long, room {room}, user_id {user}, open_sessions long, present_users long, batch_no long", events)
    return spark.read.schema(columns).option("basePath", f"{base}/rows").parquet(f"{base}/rows")


def _run(stream: DataFrame, keep, base: str) -> None:
    query = (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    query.awaitTermination()


# -- editing ---------------------------------------------------------------------------------

STARTS, STOPS, LEFT = 1, 2, 3
#: no time, as numpy counts it
NEVER = -(1 << 63)


def editing_updates(events: DataFrame, comments: DataFrame) -> DataFrame:
    """A row at the start of an edit, with ``ended_at`` null, and one at its end.

    An edit ends with the next stop of the same comment by the user, or when the user leaves the room.
    """
    feed = editing_feed(events, comments)
    leaves = events.where(F.col("type") == LEAVE).select(
        "event_id", "ts", "room", "user_id", F.lit(0).cast("long").alias("comment_id"), F.lit(LEFT).alias("kind"),
    )
    kind = F.when(F.col("editing"), STARTS).otherwise(STOPS)
    kept = feed.select("event_id", "ts", "room", "user_id", F.col("comment_id").cast("long").alias("comment_id"), kind.alias("kind"))

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # open edits of every user by number: (comment, start in microseconds)
        opened: dict[object, dict[int, tuple[int, int]]] = {}
        if state.exists:
            for user, i, comment, start in zip(*state.get):
                opened.setdefault(user, {})[i] = (comment, start)
        moved = _in_order(frames)
        micros = moved["ts"].astype("datetime64[us]").astype("int64")
        out: list[tuple] = []
        for number, at, user, comment, kind in zip(
            moved["event_id"].tolist(), micros.tolist(), _plain(moved["user_id"]), moved["comment_id"].tolist(), moved["kind"].tolist()
        ):
            mine = opened.setdefault(user, {})
            if kind == STARTS:
                mine[number] = (comment, at)
                out.append((number, user, comment, at, NEVER))
                continue
            for i in [i for i, (c, _) in mine.items() if kind == LEFT or c == comment]:
                c, start = mine.pop(i)
                out.append((i, user, c, start, at))
        left = [(user, i, *edit) for user, mine in opened.items() for i, edit in mine.items()]
        if left:
            state.update(tuple(map(list, zip(*left))))
        elif state.exists:
            state.remove()
        frame = pd.DataFrame(out, columns=["event_id", "user_id", "comment_id", "started_at", "ended_at"]).astype({"user_id": object})
        frame.insert(1, "room", pd.Series([key[0]] * len(out), dtype=object))
        for column in ("started_at", "ended_at"):
            frame[column] = frame[column].to_numpy(dtype="int64").astype("datetime64[us]")
        yield frame

    return kept.unionByName(leaves).withColumn("part", _user_part()).groupBy("room", "part").applyInPandasWithState(
        follow, _typed(EDITS, events), _typed("users array<{user}>, ids array<long>, comments array<long>, starts array<long>", events),
        "append", GroupStateTimeout.NoTimeout,
    )


def edits(updates: DataFrame) -> DataFrame:
    """One row per edit from its updates; edits still open have no end."""
    return updates.groupBy("event_id", "room", "user_id", "comment_id", "started_at").agg(
        F.max("ended_at").alias("ended_at")
    )
