"""Queries over review threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import reviews as R
from ..operators.ordered import numbered
from ..session import read_table
from . import roles as role
from .catalog import query
from .roles import ATTACHMENTS, COMMENTS, DOCS, REPLIES, USERS, sql

FILE_ROWS = """file_rows as (
  select comment_id, coalesce(reply_id, -1) as owner_reply, create_dt, attachment_id, original_name,
         coalesce(lower(content_type) in ('image/png', 'image/jpeg', 'image/jpg'), false) as image
  from attachments)"""
FILE_SUMMARY = FILE_ROWS + """,
files as (
  select comment_id, owner_reply, count(*) filter (where image) as image_count,
         count(*) filter (where not image) as other_count
  from file_rows group by all)"""
NAMES = FILE_ROWS + """,
names as (
  select comment_id, owner_reply, attachment_id, original_name,
         row_number() over (partition by comment_id, owner_reply order by create_dt, attachment_id) as position
  from file_rows where not image)"""


@query(
    sql(
        COMMENTS, REPLIES, USERS, ATTACHMENTS, FILE_SUMMARY,
        body="""
, sheet as (
  select c.doc_id, c.page_num, c.comment_id, cast(null as bigint) as reply_id, c.user_id, u.user_name,
         c.status, '원댓글' as kind, c.comment_text as text, c.create_dt, c.create_dt as comment_dt
  from comments c left join users u using (user_id)
  union all
  select c.doc_id, c.page_num, c.comment_id, r.reply_id, r.user_id, u.user_name, c.status, '답글',
         '↳ ' || r.reply_text, r.create_dt, c.create_dt
  from replies r join comments c using (comment_id) left join users u on u.user_id = r.user_id)
select s.*, case when status = 'RESOLVED' then '해결' else '미해결' end as status_label,
       coalesce(nullif(trim(user_name), ''), user_id, '') as author,
       coalesce(page_num || '페이지', '') as page_label,
       coalesce(s.reply_id, -1) as owner_reply, coalesce(image_count, 0) as image_count,
       coalesce(other_count, 0) as other_count
from sheet s left join files f
  on f.comment_id = s.comment_id and f.owner_reply = coalesce(s.reply_id, -1)
""",
    )
)
def review_sheet(spark, d):
    sheet = R.review_sheet(
        role.comments(spark, d),
        role.replies(spark, d),
        role.users(spark, d),
        role.attachments(spark, d),
    )
    return R.order_review(sheet)


@query(
    sql(
        COMMENTS, REPLIES, ATTACHMENTS,
        body="""
, reply_side as (select comment_id, count(*) as reply_count from replies group by 1),
file_side as (
  select comment_id, count(*) filter (where reply_id is null) as file_count,
         count(*) filter (where reply_id is not null) as reply_file_count
  from attachments group by 1)
select c.*, coalesce(reply_count, 0) as reply_count, coalesce(file_count, 0) as file_count,
       coalesce(reply_file_count, 0) as reply_file_count
from comments c left join reply_side using (comment_id) left join file_side using (comment_id)
""",
    )
)
def thread_assembly(spark, d):
    return R.assemble_threads(role.comments(spark, d), role.replies(spark, d), role.attachments(spark, d))


@query(
    sql(
        REPLIES, ATTACHMENTS, FILE_SUMMARY,
        body="""
select r.comment_id, r.reply_id,
       row_number() over (partition by r.comment_id order by r.create_dt, r.reply_id) as position,
       coalesce(image_count, 0) as image_count, coalesce(other_count, 0) as other_count
from replies r left join files f on f.comment_id = r.comment_id and f.owner_reply = r.reply_id
""",
    )
)
def thread_replies(spark, d):
    rows = R.thread_replies(role.replies(spark, d), role.attachments(spark, d), role.reply_blocks())
    return rows.select("comment_id", "reply_id", "position", "image_count", "other_count")


@query(
    sql(
        ATTACHMENTS,
        body="""
select comment_id, attachment_id, original_name, content_type,
       row_number() over (partition by comment_id order by create_dt, attachment_id) as position
from attachments where reply_id is null
""",
    )
)
def thread_files(spark, d):
    return R.thread_files(role.attachments(spark, d), role.attachment_blocks())


@query(
    sql(
        COMMENTS,
        body="""
, numbered as (select doc_id, comment_id,
  row_number() over (partition by doc_id order by create_dt, comment_id) - 1 as number from comments)
select doc_id, comment_id, number,
       'id' || case when number < 10000 then lpad(cast(number as varchar), 4, '0')
                    else cast(number as varchar) end as comment_code
from numbered
""",
    )
)
def comment_codes(spark, d):
    coded = R.assign_codes(role.comments(spark, d))
    return coded.select("doc_id", "comment_id", "number", "comment_code")


@query(
    sql(
        COMMENTS, DOCS,
        body="""
select d.doc_id, count(c.comment_id) as next_number
from docs d join comments c using (doc_id) group by 1
""",
    )
)
def next_comment_number(spark, d):
    known = role.docs(spark, d).select("doc_id")
    coded = R.assign_codes(role.comments(spark, d)).join(known, "doc_id", "left_semi")
    return R.next_code(coded)


@query(
    sql(
        COMMENTS, USERS,
        body="""
select c.*, u.user_name from comments c left join users u using (user_id) where c.status = 'OPEN'
""",
    )
)
def comment_list_open(spark, d):
    listed = R.filter_status(role.comments(spark, d), "OPEN")
    return R.order_recent(R.with_author(listed, role.users(spark, d)))


@query(sql(COMMENTS, USERS, body="select c.*, u.user_name from comments c left join users u using (user_id)"))
def comment_list_all(spark, d):
    return R.with_author(R.filter_status(role.comments(spark, d), "ALL"), role.users(spark, d))


@query(sql(COMMENTS, body="select * from comments where comment_id = 42"))
def comment_by_id(spark, d):
    return R.by_id(role.comments(spark, d), "comment_id", 42)


@query(
    sql(
        COMMENTS, REPLIES,
        body="""
select r.* from replies r where comment_id in (select comment_id from comments where status = 'RESOLVED')
""",
    )
)
def replies_by_comment_ids(spark, d):
    wanted = R.filter_status(role.comments(spark, d), "RESOLVED").select("comment_id")
    return R.by_ids(role.replies(spark, d), "comment_id", wanted)


@query(sql(ATTACHMENTS, body="select * from attachments where reply_id is null"))
def comment_level_attachments(spark, d):
    return R.comment_attachments(role.attachments(spark, d))


@query(
    """
select p_partkey, p_name, p_type from part
where contains(lower(coalesce(nullif(p_name, ''), '-')), 'ring')
   or contains(lower(coalesce(nullif(p_type, ''), '-')), 'ring')
"""
)
def keyword_search(spark, d):
    part = read_table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    return R.search(part, ["p_name", "p_type"], " RING ")


@query(
    sql(
        ATTACHMENTS,
        body="""
select attachment_id, comment_id, content_type from attachments
where contains(lower(coalesce(nullif(content_type, ''), '-')), '-')
""",
    )
)
def keyword_search_blank(spark, d):
    """A blank cell is shown as '-', so that keyword finds it."""
    rows = role.attachments(spark, d).select("attachment_id", "comment_id", "content_type")
    return R.search(rows, ["content_type"], "-")


@query(
    sql(
        COMMENTS, DOCS,
        body="""
select c.comment_id, c.doc_id, c.page_num from comments c join docs d using (doc_id)
where c.page_num between 1 and d.page_count
""",
    )
)
def valid_pages(spark, d):
    kept = R.valid_pages(role.comments(spark, d), role.docs(spark, d))
    return kept.select("comment_id", "doc_id", "page_num")


@query(sql(USERS, body="select user_id, user_name, user_email, user_role from users"))
def mention_users(spark, d):
    return R.mention_users(role.users(spark, d))


@query(
    sql(
        COMMENTS, DOCS, ATTACHMENTS,
        body="""
select a.comment_id, a.attachment_id from attachments a
where exists (select 1 from comments c join docs d using (doc_id)
              where c.comment_id = a.comment_id and d.file_path = 'building')
""",
    )
)
def reachable_attachments(spark, d):
    """Existence chain attachment, comment, document, for the documents of one folder."""
    folder = R.by_id(role.docs(spark, d), "file_path", "building")
    rows = role.attachments(spark, d).select("comment_id", "attachment_id")
    return R.reachable(rows, role.comments(spark, d), folder)


@query(
    sql(
        COMMENTS, REPLIES,
        body="select r.comment_id, r.reply_id, c.doc_id from replies r join comments c using (comment_id)",
    )
)
def reply_roots(spark, d):
    roots = R.root_of(role.replies(spark, d), role.comments(spark, d))
    return roots.select("comment_id", "reply_id", "doc_id")


MENTIONED = """mentioned as (
  select c_custkey as row_id, c_name as mention from customer
  union all select 1000000000 + s_suppkey, 'S' || s_suppkey from supplier
  union all select 2000000000 + n_nationkey, n_name from nation)"""


@query(
    sql(
        USERS, MENTIONED,
        body="""
, hits as (
  select m.mention, u.user_id, 0 as priority from mentioned m join users u on u.user_name = m.mention
  union all
  select m.mention, u.user_id, 1 from mentioned m join users u on u.user_id = m.mention),
best as (select *, row_number() over (partition by mention order by priority, user_id) as rn from hits)
select m.row_id, m.mention, b.user_id, b.priority from mentioned m join best b on b.mention = m.mention and rn = 1
""",
    )
)
def resolved_mentions(spark, d):
    """Mentions may be a user name or an id; names that nobody has give no row."""
    mentioned = (
        read_table(spark, d, "customer")
        .selectExpr("c_custkey as row_id", "c_name as mention")
        .unionByName(
            read_table(spark, d, "supplier").selectExpr(
                "1000000000 + s_suppkey as row_id", "concat('S', cast(s_suppkey as string)) as mention"
            )
        )
        .unionByName(
            read_table(spark, d, "nation").selectExpr(
                "cast(2000000000 + n_nationkey as bigint) as row_id", "n_name as mention"
            )
        )
    )
    return R.resolve_mentions(mentioned, role.users(spark, d))


OWNER = ["comment_id", "owner_reply"]


@query(
    sql(
        ATTACHMENTS, FILE_SUMMARY,
        body="select comment_id, owner_reply, image_count, other_count from files",
    )
)
def attachment_summary(spark, d):
    return R.attachment_summary(R.owned(role.attachments(spark, d)), OWNER)


@query(sql(ATTACHMENTS, NAMES, body="select * from names"))
def attachment_names(spark, d):
    return R.attachment_names(R.owned(role.attachments(spark, d)), OWNER, role.attachment_blocks())


@query(
    sql(
        ATTACHMENTS, NAMES,
        body="""
select comment_id, owner_reply, cast((position - 1) // 1000 as bigint) as line_no,
       coalesce(string_agg(original_name, ', ' order by position), '') as other_files
from names group by all
""",
    )
)
def joined_names(spark, d):
    names = R.attachment_names(R.owned(role.attachments(spark, d)), OWNER, role.attachment_blocks())
    return R.joined_names(names, OWNER)


@query(
    sql(
        ATTACHMENTS,
        body="""
, part_time as (select attachment_id, comment_id, case when attachment_id % 3 = 0 then null else create_dt end as create_dt
  from attachments)
select comment_id, attachment_id,
       row_number() over (partition by comment_id order by create_dt nulls first, attachment_id) as number
from part_time
""",
    )
)
def untimed_numbers(spark, d):
    """Numbering where a third of the times are null: those rows come first and none is lost."""
    files = role.attachments(spark, d).selectExpr(
        "attachment_id", "comment_id", "case when attachment_id % 3 = 0 then null else create_dt end as create_dt"
    )
    order = ["create_dt", "attachment_id"]
    return numbered(files, ["comment_id"], order, role.attachment_blocks(), out="number").drop("create_dt")


@query(
    sql(
        COMMENTS, USERS,
        body="""
select comment_id, case when status = 'RESOLVED' then '해결' else '미해결' end as status_label,
       coalesce(nullif(trim(user_name), ''), user_id, '') as author,
       coalesce(page_num || '페이지', '') as page_label
from comments left join users using (user_id)
""",
    )
)
def comment_labels(spark, d):
    named = R.with_author(role.comments(spark, d), role.users(spark, d))
    return R.labels(named).select("comment_id", "status_label", "author", "page_label")


CHANGES = """changes as (
  select o_orderkey as comment_id, 'C' || cast(o_custkey as varchar) as user_id,
         'new ' || o_orderpriority as comment_text, 'RESOLVED' as status from orders)"""


def _changes(spark, d):
    # the author of a change is the customer, who wrote only some of the comments
    return read_table(spark, d, "orders").selectExpr(
        "o_orderkey as comment_id",
        "concat('C', cast(o_custkey as string)) as user_id",
        "concat('new ', o_orderpriority) as comment_text",
        "'RESOLVED' as status",
    )


@query(
    sql(
        COMMENTS, CHANGES,
        body="""
select c.comment_id, coalesce(h.comment_text, c.comment_text) as comment_text,
       coalesce(h.status, c.status) as status, h.comment_id is not null as updated
from comments c left join changes h on h.comment_id = c.comment_id and h.user_id = c.user_id
""",
    )
)
def guarded_update(spark, d):
    changed = R.guarded_update(
        role.comments(spark, d), _changes(spark, d), ["comment_text", "status"]
    )
    return changed.select("comment_id", "comment_text", "status", "updated")


@query(
    sql(
        COMMENTS,
        body="""
select comment_id, comment_type in ('RECT', 'CALLOUT') as updated,
       case when comment_type in ('RECT', 'CALLOUT') then page_num / 100.0 else 0.5 end as rect_x
from comments
""",
    )
)
def guarded_geometry_update(spark, d):
    rows = role.comments(spark, d).withColumn("rect_x", F.lit(0.5))
    moves = rows.select("comment_id", "user_id", (F.col("page_num") / 100.0).alias("rect_x"))
    moved = R.guarded_update(rows, moves, ["rect_x"], geometry=True)
    return moved.select("comment_id", "updated", "rect_x")


@query(
    sql(
        COMMENTS, REPLIES, ATTACHMENTS, CHANGES,
        body="""
, owned as (select comment_id from comments where (comment_id, user_id) in
            (select (comment_id, user_id) from changes))
select 'attachments' as kind, count(*) as rows_left from attachments where comment_id not in (from owned)
union all select 'comments', count(*) from comments where comment_id not in (from owned)
union all select 'replies', count(*) from replies where comment_id not in (from owned)
""",
    )
)
def cascading_delete(spark, d):
    left = R.delete_threads(
        role.comments(spark, d), role.replies(spark, d), role.attachments(spark, d), _changes(spark, d)
    )
    frames = [
        df.agg(F.count(F.lit(1)).alias("rows_left")).select(F.lit(kind).alias("kind"), "rows_left")
        for kind, df in zip(("comments", "replies", "attachments"), left)
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


TAGGED = """tagged as (
  select conv_id as row_id, turn,
         'Hi @' || role || ', see a@b.example and (@' || role || ') or @user.' || conv_id || '  ok ' || text as text
  from conversations)"""


def _tagged(spark, d):
    return read_table(spark, d, "conversations").selectExpr(
        "conv_id as row_id",
        "turn",
        "concat('Hi @', role, ', see a@b.example and (@', role, ') or @user.', "
        "cast(conv_id as string), '  ok ', text) as text",
    )


@query(
    sql(
        TAGGED,
        body=r"""
select row_id, turn,
       list_aggregate(list_distinct(regexp_extract_all(text,
         '(?:^|[^\pL\pN._%+-])@([\pL\pN._-]+(?:@[A-Za-z0-9.-]+)?)', 1)), 'count') as mention_count,
       list_contains(regexp_extract_all(text,
         '(?:^|[^\pL\pN._%+-])@([\pL\pN._-]+(?:@[A-Za-z0-9.-]+)?)', 1), 'user.' || row_id) as tags_user,
       trim(regexp_replace(regexp_replace(text,
         '(^|[^\pL\pN._%+-])@[\pL\pN._-]+(?:@[A-Za-z0-9.-]+)?', '\1', 'g'), '\s{2,}', ' ', 'g')) as bare
from tagged
""",
    )
)
def mention_extraction(spark, d):
    """Mentions of whole conversation texts; addresses are no mentions."""
    found = T.mentions(F.col("text"))
    return _tagged(spark, d).select(
        "row_id",
        "turn",
        F.size(found).cast("long").alias("mention_count"),
        F.array_contains(found, F.concat(F.lit("user."), F.col("row_id").cast("string"))).alias(
            "tags_user"
        ),
        T.without_mentions(F.col("text")).alias("bare"),
    )


ALERT_TEXT = """said as (
  select o_orderkey as comment_id, o_custkey as doc_id, 'id' || lpad(cast(o_orderkey as varchar), 9, '0') as comment_code,
         'Ask @C' || o_custkey || ' and @S' || (o_custkey // 20) || ' please' as comment_text from orders)"""


@query(
    sql(
        USERS, DOCS, ALERT_TEXT,
        body="""
, who as (
  select comment_id, 'C' || doc_id as target_user from said
  union select comment_id, 'S' || (doc_id // 20) from said)
select s.comment_id, w.target_user,
       '경    로: ' || coalesce(nullif(d.file_path, ''), '-') || chr(10) ||
       '파 일 명: ' || coalesce(nullif(d.file_name, ''), 'PDF') || chr(10) ||
       '코 멘 트: Ask and please' || chr(10) || '코멘트ID: ' || replace(s.comment_code, 'id', '') as message
from said s join who w using (comment_id) join users u on u.user_id = w.target_user
left join docs d using (doc_id)
""",
    )
)
def mention_alerts(spark, d):
    said = read_table(spark, d, "orders").selectExpr(
        "o_orderkey as comment_id",
        "o_custkey as doc_id",
        "format_string('id%09d', o_orderkey) as comment_code",
        "concat('Ask @C', cast(o_custkey as string), ' and @S', cast(o_custkey div 20 as string), ' please') as comment_text",
    )
    return R.mention_alerts(said, role.users(spark, d), role.docs(spark, d))
