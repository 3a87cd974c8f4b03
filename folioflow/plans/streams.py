"""Queries over event streams and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import read_table
from ..streaming import events as E
from ..streaming import live as L
from . import roles as role
from .catalog import query
from .roles import DOCS, USERS, sql

TYPE = """case event_type when 'signup' then 'JOIN' when 'error' then 'LEAVE' when 'view' then 'EDITING_START'
         when 'click' then 'EDITING_STOP' else 'PING' end"""


def room_events(df):
    """Events of review rooms: the room is in the JSON message, the comment number in the value."""
    opened = E.parse_messages(df, "props", "k long")
    return opened.selectExpr(
        "event_id", "cast(ts as timestamp) as ts", "k as room", "user_id",
        "concat(cast(user_id as string), '-', cast(event_id % 2 as string)) as session", f"{TYPE} as type",
        "cast(floor(value) as bigint) as comment_id",
    )


def table_events(spark, d):
    return room_events(read_table(spark, d, "events"))


def stream_events(spark, d):
    schema = read_table(spark, d, "events").schema
    return room_events(E.read_events(spark, d, schema, "events.parquet"))


ROOM_EVENTS = f"""room_events as (
  select event_id, ts, cast(json_extract(props, '$.k') as bigint) as room, user_id, {TYPE} as type,
         cast(floor(value) as bigint) as comment_id
  from events)"""

OPENED = """moves as (select *, event_id % 2 as tab, (type = 'JOIN')::int as is_open from room_events
                      where type in ('JOIN', 'LEAVE')),
changes as (select *, is_open - coalesce(lag(is_open) over
              (partition by room, user_id, tab order by ts, event_id), 0) as change from moves),
opened as (select *, cast(sum(change) over (partition by room, user_id order by ts, event_id) as bigint) as open_sessions
           from changes)"""


PRESENCE = sql(
    ROOM_EVENTS, OPENED,
    body="""
, steps as (select *, (open_sessions > 0)::int - (open_sessions - change > 0)::int as step from opened)
select event_id, room, user_id, open_sessions,
       cast(sum(step) over (partition by room order by ts, event_id) as bigint) as present_users from steps
""",
)


@query(PRESENCE)
def presence(spark, d):
    return E.presence(table_events(spark, d)).select(
        "event_id", "room", "user_id", "open_sessions", "present_users"
    )


@query(PRESENCE)
def presence_live(spark, d):
    """The same counts, emitted by the stream at each join and leave."""
    return L.presence_live(stream_events(spark, d)).drop("batch_no")


@query(
    sql(
        ROOM_EVENTS,
        body="""
, last_moves as (select room, user_id, event_id % 2 as tab, arg_max(type, (ts, event_id)) as type
                 from room_events where type in ('JOIN', 'LEAVE') group by 1, 2, 3)
select room, count(distinct user_id) as present_users from last_moves where type = 'JOIN' group by 1
""",
    )
)
def presence_stream(spark, d):
    """Users with an open session, two browser tabs each, after the stream has taken all events."""
    return E.present_users(E.drain(E.presence_stream(stream_events(spark, d)), combine=E.last_moves))


EDITING = """room_comments as (select p_partkey as comment_id, cast(p_size as bigint) as doc_id from part),
feed as (
  select e.event_id, e.ts, e.room, e.user_id, e.comment_id, type = 'EDITING_START' as editing
  from room_events e join room_comments c on c.comment_id = e.comment_id and c.doc_id = e.room
  where type in ('EDITING_START', 'EDITING_STOP'))"""


def room_comments(spark, d):
    return read_table(spark, d, "part").selectExpr(
        "p_partkey as comment_id", "cast(p_size as bigint) as doc_id"
    )


@query(sql(ROOM_EVENTS, EDITING, body="select * from feed"))
def editing_stream(spark, d):
    return E.drain(E.editing_feed(stream_events(spark, d), room_comments(spark, d))).drop("batch_no")


INTERVALS = sql(
    ROOM_EVENTS,
    body="""
, keyed as (select *, 0::bigint as doc from room_events),
feed as (select event_id, ts, room, user_id, room as comment_id, type from keyed where type in ('EDITING_START', 'EDITING_STOP')),
ends as (
  select f.*,
    (select min(ts) from feed s where s.type = 'EDITING_STOP' and s.room = f.room and s.user_id = f.user_id
        and s.comment_id = f.comment_id and (s.ts, s.event_id) > (f.ts, f.event_id)) as stopped,
    (select min(ts) from room_events l where l.type = 'LEAVE' and l.room = f.room and l.user_id = f.user_id
        and (l.ts, l.event_id) > (f.ts, f.event_id)) as gone
  from feed f where type = 'EDITING_START')
select event_id, room, user_id, comment_id, ts as started_at, least(stopped, gone) as ended_at from ends
""",
)


@query(INTERVALS)
def editing_intervals(spark, d):
    """Every room holds one comment, numbered like the room."""
    events = table_events(spark, d).withColumn("comment_id", F.col("room"))
    comments = events.selectExpr("room as comment_id", "room as doc_id").distinct()
    return E.editing_intervals(events, comments)


@query(INTERVALS)
def editing_live(spark, d):
    """The same intervals from the stream's starts and ends."""
    comments = table_events(spark, d).selectExpr("room as comment_id", "room as doc_id").distinct()
    events = stream_events(spark, d).withColumn("comment_id", F.col("room"))
    return L.edits(E.drain(L.editing_updates(events, comments)).drop("batch_no"))


@query(
    sql(
        ROOM_EVENTS,
        body="select distinct room as doc_id, time_bucket(interval '10 minutes', ts) as signal_at from room_events",
    )
)
def change_signals(spark, d):
    """One signal per document and ten minutes."""
    changes = stream_events(spark, d).withColumnRenamed("room", "doc_id")
    return E.signals(E.drain(E.change_feed(changes), combine=E.signals))


JOB_LOG = """job_log as (
  select event_id // 2 as id, ts, case when event_id % 2 = 0 or event_type = 'purchase' then 'STARTED'
         when event_type = 'error' then 'FAILED' else 'SUCCESS' end as status
  from events)"""


def job_log(df):
    """Two events are one job; a purchase never finishes one."""
    return df.selectExpr(
        "event_id div 2 as id", "cast(ts as timestamp) as ts",
        "case when event_id % 2 = 0 or event_type = 'purchase' then 'STARTED'"
        " when event_type = 'error' then 'FAILED' else 'SUCCESS' end as status",
    )


RUNS = """runs as (
  select id, min(case when status = 'STARTED' then ts end) as started_at,
         max(case when status <> 'STARTED' then ts end) as finished_at,
         coalesce(max(case when status <> 'STARTED' then status end), 'STARTED') as status
  from job_log group by 1)"""


@query(
    sql(
        JOB_LOG, RUNS,
        body="""
select id, status, started_at, finished_at,
       (epoch_us(finished_at) - epoch_us(started_at)) // 1000 as elapsed_ms from runs
""",
    )
)
def job_runs(spark, d):
    return E.job_runs(job_log(read_table(spark, d, "events")))


@query(sql(JOB_LOG, RUNS, body="""select id, status, started_at, finished_at,
       (epoch_us(finished_at) - epoch_us(started_at)) // 1000 as elapsed_ms from runs"""))
def job_stream(spark, d):
    schema = read_table(spark, d, "events").schema
    log = job_log(E.read_events(spark, d, schema, "events.parquet"))
    return E.merge_runs(E.drain(E.job_stream(log), combine=E.ends_of_runs))


@query(
    sql(
        USERS, DOCS,
        body="""
select o_orderkey as comment_id, 'C' || o_custkey as target_user,
       '경    로: ' || coalesce(nullif(d.file_path, ''), '-') || chr(10) ||
       '파 일 명: ' || coalesce(nullif(d.file_name, ''), 'PDF') || chr(10) ||
       '코 멘 트: Look' || chr(10) || '코멘트ID: ' || o_orderkey as message
from orders join users u on u.user_id = 'C' || o_custkey left join docs d on d.doc_id = o_custkey
""",
    )
)
def alert_stream(spark, d):
    schema = read_table(spark, d, "orders").schema
    said = E.read_events(spark, d, schema, "orders.parquet").selectExpr(
        "o_orderkey as comment_id", "o_custkey as doc_id", "concat('id', cast(o_orderkey as string)) as comment_code",
        "concat('Look @C', cast(o_custkey as string), ' @nobody @C', cast(o_custkey as string)) as comment_text",
    )
    sent = E.alert_stream(said, role.users(spark, d), role.docs(spark, d))
    return E.drain(sent, combine=E.alerts).drop("batch_no")
