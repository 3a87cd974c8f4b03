"""Event streams of live review rooms and job logs, with batch twins.

Events carry (event_id, ts, room, user_id, session, type, comment_id). The specified behaviour keeps
its state in memory for ever and has no rule for late rows. Here streams keep no state: they emit small
updates that merge by least and greatest values, each micro-batch is combined before it is written, and
a batch step merges all of them. So the answer depends neither on how rows fall into batches nor on how
late they come. The batch twins read the same events as a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import reviews as R
from ..operators.ordered import Running, running, time_blocks
from ..session import settle, shared_folder

# Message types.
JOIN, LEAVE = "JOIN", "LEAVE"
EDITING_START, EDITING_STOP = "EDITING_START", "EDITING_STOP"
STARTED = "STARTED"


# -- sources ---------------------------------------------------------------------------------


def read_events(
    spark: SparkSession, folder: str, schema: StructType | str, name: str = "*", files_per_batch: int = 100
) -> DataFrame:
    """Stream the parquet files of a folder that match ``name``."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def parse_messages(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Open a JSON message column; unreadable messages leave. Works on streams and tables."""
    opened = df.withColumn("_m", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    first = StructType.fromDDL(schema).fieldNames()[0]
    return opened.where(F.col(f"_m.{first}").isNotNull()).select(
        *[c for c in df.columns if c != column], "_m.*"
    )


# -- presence --------------------------------------------------------------------------------


def presence_changes(events: DataFrame) -> DataFrame:
    """Open sessions per room and user after every join or leave, and by how much it changed them.

    A session is open from a join to its next leave; a repeated join, or a leave of a closed session,
    has ``session_change`` 0.
    """
    order, blocks = ["ts", "event_id"], time_blocks("ts")
    moves = events.where(F.col("type").isin(JOIN, LEAVE)).withColumn("_open", (F.col("type") == JOIN).cast("long"))
    previous = running(
        moves, ["room", "user_id", "session"], order, blocks,
        {"_was": Running("last", F.col("_open"), exclusive=True)},
    )
    change = F.col("_open") - F.coalesce("_was", F.lit(0))
    stepped = settle(previous.withColumn("session_change", change).drop("_open", "_was"))
    return running(
        stepped, ["room", "user_id"], order, blocks, {"open_sessions": Running("sum", F.col("session_change"))}
    )


def presence(events: DataFrame) -> DataFrame:
    """Distinct present users of a room after every join or leave."""
    before = F.col("open_sessions") - F.col("session_change")
    step = (F.col("open_sessions") > 0).cast("long") - (before > 0).cast("long")
    stepped = settle(presence_changes(events).withColumn("_step", step))
    room = {"present_users": Running("sum", F.col("_step"))}
    return running(stepped, ["room"], ["ts", "event_id"], time_blocks("ts"), room).drop("_step")


def presence_stream(events: DataFrame) -> DataFrame:
    """Every join or leave of a session, as a stream of updates without state.

    :func:`last_moves` combines the updates of a micro-batch, :func:`present_users` merges all of them;
    the greatest (ts, event_id) wins, so late rows count and repeated ones do no harm.
    """
    moves = events.where(F.col("type").isin(JOIN, LEAVE))
    return moves.select("room", "user_id", "session", F.struct("ts", "event_id", "type").alias("last"))


def last_moves(updates: DataFrame) -> DataFrame:
    """The last move of every session."""
    return updates.groupBy("room", "user_id", "session").agg(F.max("last").alias("last"))


def present_users(updates: DataFrame) -> DataFrame:
    """Distinct users with an open session per room; repeated updates do no harm."""
    opened = last_moves(updates).where(F.col("last.type") == JOIN).select("room", "user_id").distinct()
    return opened.groupBy("room").agg(F.count(F.lit(1)).alias("present_users"))


# -- editing ---------------------------------------------------------------------------------


def editing_feed(events: DataFrame, comments: DataFrame) -> DataFrame:
    """Valid start and stop signals: known type, and the comment belongs to the room."""
    known = events.where(F.col("type").isin(EDITING_START, EDITING_STOP))
    owned = comments.select("comment_id", F.col("doc_id").alias("room"))
    return known.join(owned, ["comment_id", "room"]).select(
        "event_id", "ts", "room", "user_id", "comment_id", (F.col("type") == EDITING_START).alias("editing")
    )


def editing_intervals(events: DataFrame, comments: DataFrame) -> DataFrame:
    """Start of editing to the next stop of the same comment or the user's leave, open ones with null."""
    feed = editing_feed(events, comments)
    order, blocks = ["ts", "event_id"], time_blocks("ts")
    stop = F.when(~F.col("editing"), F.col("ts"))
    ended = running(
        feed, ["room", "user_id", "comment_id"], order, blocks,
        {"stopped_at": Running("last", stop)}, reverse=True,
    ).where("editing")
    leaves = events.where(F.col("type") == LEAVE).select(
        "event_id", "ts", "room", "user_id", F.lit(None).cast("long").alias("comment_id"),
        F.lit(None).cast("timestamp").alias("stopped_at"), F.lit(True).alias("_leave"),
    )
    both = settle(
        ended.select("event_id", "ts", "room", "user_id", "comment_id", "stopped_at")
        .withColumn("_leave", F.lit(False))
        .unionByName(leaves)
    )
    left = running(
        both, ["room", "user_id"], order, blocks,
        {"left_at": Running("last", F.when(F.col("_leave"), F.col("ts")))},
        reverse=True,
    ).where(~F.col("_leave"))
    return left.select(
        "event_id", "room", "user_id", "comment_id", F.col("ts").alias("started_at"),
        F.least("stopped_at", "left_at").alias("ended_at"),
    )


# -- change signals and alerts ---------------------------------------------------------------


def change_feed(changes: DataFrame, delay_s: int = 600) -> DataFrame:
    """Payload-free signals (doc_id, signal_at) with the begin of the delay that a change falls into.

    :func:`signals` makes them distinct: at most one per document and delay, however the changes fall
    into micro-batches.
    """
    begin = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / F.lit(delay_s)) * F.lit(delay_s))
    return changes.select("doc_id", begin.alias("signal_at"))


def signals(updates: DataFrame) -> DataFrame:
    """One signal per document and delay; combines a micro-batch and merges all of them."""
    return updates.select("doc_id", "signal_at").distinct()


def alert_stream(comments: DataFrame, users: DataFrame, docs: DataFrame) -> DataFrame:
    """Mention alerts for new comments; users and documents are tables.

    Two mentions of one user sit in one comment and so in one micro-batch: :func:`alerts` combines them.
    """
    return R.mention_rows(comments, users, docs)


def alerts(updates: DataFrame) -> DataFrame:
    """One alert per comment and user."""
    return updates.select("comment_id", "target_user", "message").distinct()


# -- job log ---------------------------------------------------------------------------------


def _finished(runs: DataFrame) -> DataFrame:
    finished = F.col("_end.ts")
    return runs.where(F.col("started_at").isNotNull()).select(
        "id",
        F.coalesce(F.col("_end.status"), F.lit(STARTED)).alias("status"),
        "started_at",
        finished.alias("finished_at"),
        F.expr("timestampdiff(MICROSECOND, started_at, _end.ts) div 1000").alias("elapsed_ms"),
    )


def job_runs(log: DataFrame) -> DataFrame:
    """One row per job: start, finish, state and elapsed milliseconds; unfinished jobs stay STARTED."""
    return merge_runs(job_stream(log))


def job_stream(log: DataFrame) -> DataFrame:
    """Starts and finishes of jobs, as a stream of updates without state.

    :func:`ends_of_runs` combines the updates of a micro-batch, :func:`merge_runs` merges all of them,
    so a finish may come as late as it likes.
    """
    begun = F.when(F.col("status") == STARTED, F.col("ts"))
    ended = F.when(F.col("status") != STARTED, F.struct("ts", "status"))
    return log.select("id", begun.alias("begun"), ended.alias("ended"))


def ends_of_runs(updates: DataFrame) -> DataFrame:
    """First start and last finish of every job."""
    return updates.groupBy("id").agg(F.min("begun").alias("begun"), F.max("ended").alias("ended"))


def merge_runs(updates: DataFrame) -> DataFrame:
    """Job rows from stream updates; repeated updates do no harm."""
    return _finished(ends_of_runs(updates).select("id", F.col("begun").alias("started_at"), F.col("ended").alias("_end")))


# -- running a stream to its end -------------------------------------------------------------

def drain(
    stream: DataFrame, output_mode: str = "append", combine: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Process what is there now and return all emitted rows with their batch number.

    ``combine`` shortens the rows of a micro-batch before they are kept; it must not change the columns.
    Rows go to a table in the shared folder, one folder per batch; a repeated batch overwrites its own.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        rows = batch if combine is None else combine(batch)
        rows.write.mode("overwrite").parquet(f"{base}/rows/batch_no={number}")

    query = (
        stream.writeStream.outputMode(output_mode)
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    query.awaitTermination()
    schema = StructType(stream.schema.fields).add("batch_no", "long")
    return spark.read.schema(schema).option("basePath", f"{base}/rows").parquet(f"{base}/rows")
