"""Review threads: comments, replies, attachments, authors, numbering and the review sheet.

Column names follow the roles: ``comment_id``, ``doc_id``, ``user_id``, ``create_dt`` and so on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ordered import dated_blocks, first_per, gathered, numbered

# Labels of the review sheet.
STATUS_RESOLVED = "해결"
STATUS_OPEN = "미해결"
KIND_COMMENT = "원댓글"
KIND_REPLY = "답글"
PAGE_SUFFIX = "페이지"
REPLY_MARK = "↳ "
IMAGE_TYPES = ("image/png", "image/jpeg", "image/jpg")
MOVABLE_TYPES = ("RECT", "CALLOUT")
CODE_FORMAT = "id%04d"


#: parts that comments fall into while their mentions are looked up
MENTION_PARTS = 16


# -- predicates ------------------------------------------------------------------------------


def filter_status(df: DataFrame, status: str | None) -> DataFrame:
    """Null, '' and 'ALL' mean no predicate."""
    return df if status in (None, "", "ALL") else df.where(F.col("status") == status)


def by_id(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def by_ids(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is listed. The list is made distinct first, so hot ids cost nothing."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi")


def comment_attachments(attachments: DataFrame) -> DataFrame:
    """Attachments of the comment itself, not of a reply."""
    return attachments.where(F.col("reply_id").isNull())


def search(df: DataFrame, columns: Sequence[str], keyword: str) -> DataFrame:
    return df.where(T.keyword_match([F.col(c) for c in columns], keyword))


def valid_pages(comments: DataFrame, docs: DataFrame) -> DataFrame:
    """Keep comments whose page exists in their document."""
    pages = docs.select("doc_id", "page_count")
    return comments.join(pages, "doc_id").where(F.col("page_num").between(1, F.col("page_count")))


def mention_users(users: DataFrame) -> DataFrame:
    """User list without secrets."""
    return users.select("user_id", "user_name", "user_email", "user_role").orderBy(
        "user_name", "user_id"
    )


# -- joins -----------------------------------------------------------------------------------


def with_author(df: DataFrame, users: DataFrame) -> DataFrame:
    """Add the author's name; of several users with one id, the least name."""
    names = users.groupBy("user_id").agg(F.min("user_name").alias("user_name"))
    return df.join(names, "user_id", "left")


def reachable(df: DataFrame, comments: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (replies or attachments) whose comment and document both exist."""
    known = comments.join(docs.select("doc_id"), "doc_id", "left_semi").select("comment_id")
    return df.join(known, "comment_id", "left_semi")


def root_of(replies: DataFrame, comments: DataFrame) -> DataFrame:
    """Document of each reply."""
    return replies.join(comments.select("comment_id", "doc_id"), "comment_id")


def mention_index(users: DataFrame) -> DataFrame:
    """One user per possible mention: a matching name goes before a matching id, ties by user id."""
    spelled = users.select(
        "user_id",
        F.inline(
            F.array(
                F.struct(F.col("user_name").alias("mention"), F.lit(0).alias("priority")),
                F.struct(F.col("user_id").alias("mention"), F.lit(1).alias("priority")),
            )
        ),
    )
    return first_per(spelled.where(F.col("mention").isNotNull()), ["mention"], ["priority", "user_id"])


def resolve_mentions(mentions: DataFrame, users: DataFrame) -> DataFrame:
    """Mentions with their user; unknown ones leave. The mentions may be a stream."""
    return mentions.join(mention_index(users), "mention")


def labels(df: DataFrame) -> DataFrame:
    """Display labels of status, author and page."""
    return df.select(
        "*",
        F.when(F.col("status") == "RESOLVED", STATUS_RESOLVED)
        .otherwise(STATUS_OPEN)
        .alias("status_label"),
        F.coalesce(T.blank_to_null(F.col("user_name")), F.col("user_id"), F.lit("")).alias("author"),
        F.coalesce(F.concat(F.col("page_num").cast("string"), F.lit(PAGE_SUFFIX)), F.lit("")).alias(
            "page_label"
        ),
    )


# -- aggregates and numbering ----------------------------------------------------------------


def next_code(comments: DataFrame) -> DataFrame:
    """Next free number per document from codes such as id0012."""
    number = F.expr("try_cast(substring(comment_code, 3) as bigint)")
    return comments.groupBy("doc_id").agg(
        F.coalesce(F.max(number) + 1, F.lit(0)).cast("long").alias("next_number")
    )


def assign_codes(comments: DataFrame, blocks: Sequence[Column] | None = None) -> DataFrame:
    """Number the comments of a document from 0 by time and id; the code is never truncated."""
    placed = numbered(
        comments,
        ["doc_id"],
        ["create_dt", "comment_id"],
        blocks or dated_blocks("create_dt", "comment_id"),
        out="number",
        start=0,
    )
    return placed.withColumn("comment_code", F.format_string(CODE_FORMAT, F.col("number")))


def is_image(content_type: Column) -> Column:
    return F.coalesce(F.lower(content_type).isin(*IMAGE_TYPES), F.lit(False))


def attachment_summary(attachments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per owner, one row whatever its size: how many images and how many other files it has."""
    image = is_image(F.col("content_type"))
    return attachments.groupBy(*keys).agg(
        F.count(F.when(image, 1)).alias("image_count"), F.count(F.when(~image, 1)).alias("other_count")
    )


def attachment_names(
    attachments: DataFrame, keys: Sequence[str], blocks: Sequence[Column] | None = None
) -> DataFrame:
    """Names of the files that are no images, one row each, numbered per owner by (create_dt, attachment_id).

    A list in rows has the same form for one file and for a million.
    """
    others = attachments.where(~is_image(F.col("content_type")))
    order = ["create_dt", "attachment_id"]
    placed = numbered(others, keys, order, blocks or dated_blocks(*order), out="position")
    return placed.select(*keys, "position", "attachment_id", "original_name")


def joined_names(names: DataFrame, keys: Sequence[str], width: int = 1000) -> DataFrame:
    """The numbered names of an owner as lines of ``width`` names joined by a comma; nulls are left out.

    Line 0 is the whole list of an owner with no more names than that; others go on in the next lines.
    """
    lines = gathered(names, keys, "position", {"names": F.col("original_name")}, width)
    return lines.select(
        *keys, F.col("part_no").alias("line_no"), F.array_join("names", ", ").alias("other_files")
    )


def thread_replies(
    replies: DataFrame, attachments: DataFrame, blocks: Sequence[Column] | None = None
) -> DataFrame:
    """Replies numbered per comment by (create_dt, reply_id), each with the counts of its files."""
    files = attachment_summary(attachments.where(F.col("reply_id").isNotNull()), ["comment_id", "reply_id"])
    order = ["create_dt", "reply_id"]
    placed = numbered(replies, ["comment_id"], order, blocks or dated_blocks(*order), out="position")
    return placed.join(files, ["comment_id", "reply_id"], "left").fillna(0, ["image_count", "other_count"])


def thread_files(attachments: DataFrame, blocks: Sequence[Column] | None = None) -> DataFrame:
    """A comment's own files numbered by (create_dt, attachment_id)."""
    order = ["create_dt", "attachment_id"]
    own = comment_attachments(attachments)
    placed = numbered(own, ["comment_id"], order, blocks or dated_blocks(*order), out="position")
    return placed.select("comment_id", "position", "attachment_id", "original_name", "content_type")


def assemble_threads(comments: DataFrame, replies: DataFrame, attachments: DataFrame) -> DataFrame:
    """Every comment once, with the number of its replies, of its own files and of its replies' files.

    The members follow in :func:`thread_replies` and :func:`thread_files`, so no row grows with a thread.
    """
    counted = replies.groupBy("comment_id").agg(F.count(F.lit(1)).alias("reply_count"))
    below = F.col("reply_id").isNotNull()
    files = attachments.groupBy("comment_id").agg(
        F.count(F.when(~below, 1)).alias("file_count"), F.count(F.when(below, 1)).alias("reply_file_count")
    )
    joined = comments.join(counted, "comment_id", "left").join(files, "comment_id", "left")
    return joined.fillna(0, ["reply_count", "file_count", "reply_file_count"])


# -- review sheet ----------------------------------------------------------------------------


def review_rows(
    comments: DataFrame, replies: DataFrame, users: DataFrame
) -> DataFrame:
    """Comments and replies as sheet rows; a reply takes page, status and place of its comment."""
    head = with_author(comments, users).withColumn("reply_id", F.lit(None).cast("long"))
    parent = comments.select(
        "comment_id", "doc_id", "page_num", "status", F.col("create_dt").alias("comment_dt")
    )
    tail = with_author(replies, users).join(parent, "comment_id")
    common = ["doc_id", "page_num", "comment_id", "reply_id", "user_id", "user_name", "status"]
    first = head.select(
        *common,
        F.lit(KIND_COMMENT).alias("kind"),
        F.col("comment_text").alias("text"),
        "create_dt",
        F.col("create_dt").alias("comment_dt"),
    )
    rest = tail.select(
        *common,
        F.lit(KIND_REPLY).alias("kind"),
        F.concat(F.lit(REPLY_MARK), F.col("reply_text")).alias("text"),
        "create_dt",
        "comment_dt",
    )
    return labels(first.unionByName(rest))


def order_review(df: DataFrame) -> DataFrame:
    """Page, then time, nulls last; each reply follows its comment.

    Of a whole sheet, what follows from other columns is made again after the sort and does not travel.
    """
    made = ["status_label", "author", "page_label", "owner_reply"]
    whole = set(made) | {"status", "user_name", "user_id", "page_num"} <= set(df.columns)
    narrow = df.drop(*made) if whole else df
    placed = narrow.orderBy(
        F.col("doc_id"),
        F.col("page_num").asc_nulls_last(),
        F.col("comment_dt").asc_nulls_last(),
        F.col("comment_id"),
        F.col("kind") == KIND_REPLY,
        F.col("create_dt"),
        F.col("reply_id"),
    )
    return labels(placed).withColumn("owner_reply", owner_reply()).select(*df.columns) if whole else placed


def owner_reply() -> Column:
    """The reply of a row or file, or -1 for the comment itself."""
    return F.coalesce("reply_id", F.lit(-1))


def order_recent(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("create_dt").desc(), F.col("comment_id").desc())


def review_sheet(
    comments: DataFrame, replies: DataFrame, users: DataFrame, attachments: DataFrame
) -> DataFrame:
    """The whole sheet, one row per comment or reply: labels and file counts.

    The names of a row's files are in :func:`attachment_names` and :func:`joined_names` under
    (comment_id, owner_reply); ``owner_reply`` is -1 for the comment itself.
    """
    rows = review_rows(comments, replies, users).withColumn("owner_reply", owner_reply())
    # one pass over the attachments serves comments and replies; null reply ids become a flag
    files = attachment_summary(owned(attachments), ["comment_id", "owner_reply"])
    sheet = rows.join(files, ["comment_id", "owner_reply"], "left")
    return sheet.select(
        *rows.columns,
        F.coalesce("image_count", F.lit(0)).alias("image_count"),
        F.coalesce("other_count", F.lit(0)).alias("other_count"),
    )


def owned(attachments: DataFrame) -> DataFrame:
    """Attachments with ``owner_reply``: the reply, or -1 for the comment itself."""
    return attachments.withColumn("owner_reply", owner_reply())


# -- maintenance -----------------------------------------------------------------------------


def guarded_update(
    comments: DataFrame, changes: DataFrame, columns: Sequence[str], geometry: bool = False
) -> DataFrame:
    """New table plus ``updated``: only the author's own rows change.

    ``changes`` holds comment_id, user_id and the new values. Of several rows for one (comment, user) the
    least by their values counts. With ``geometry`` only movable shapes change.
    """
    least = changes.groupBy("comment_id", "user_id").agg(F.min(F.struct(*columns)).alias("_least"))
    fresh = least.select(
        "comment_id", "user_id", F.lit(True).alias("_hit"), *[F.col(f"_least.{c}").alias(f"_{c}") for c in columns]
    )
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    if geometry:
        hit = hit & F.col("comment_type").isin(*MOVABLE_TYPES)
    joined = comments.join(fresh, ["comment_id", "user_id"], "left").withColumn("updated", hit)
    kept = [
        F.when(F.col("updated"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
        if c in columns
        else F.col(c)
        for c in comments.columns
    ]
    return joined.select(*kept, "updated")


def delete_threads(
    comments: DataFrame, replies: DataFrame, attachments: DataFrame, requests: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove requested comments of their own author, with replies and files."""
    asked = requests.select("comment_id", "user_id").distinct()
    owned = comments.join(asked, ["comment_id", "user_id"], "left_semi").select("comment_id")
    return (
        comments.join(owned, "comment_id", "left_anti"),
        replies.join(owned, "comment_id", "left_anti"),
        attachments.join(owned, "comment_id", "left_anti"),
    )


def mention_rows(comments: DataFrame, users: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per comment and mention that resolves, with the text to send. Works on streams."""
    # a mention that is in every comment, of a user or of nobody, meets a copy of the users in each part
    part = F.pmod(F.xxhash64("comment_id"), F.lit(MENTION_PARTS)).alias("_part")
    said = comments.select("*", part, F.explode(T.mentions(F.col("comment_text"))).alias("mention"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(MENTION_PARTS - 1).cast("long"))).alias("_part")
    who = mention_index(users).select("mention", F.col("user_id").alias("target_user"), parts)
    with_doc = said.join(who.hint("merge"), ["mention", "_part"]).join(
        docs.select("doc_id", "file_name", "file_path"), "doc_id", "left"
    )
    return with_doc.select(
        "comment_id",
        "target_user",
        T.notification(
            F.col("file_path"), F.col("file_name"), F.col("comment_text"), F.col("comment_code")
        ).alias("message"),
    )


def mention_alerts(comments: DataFrame, users: DataFrame, docs: DataFrame) -> DataFrame:
    """One alert per comment and user, also when two mentions name the same user."""
    return mention_rows(comments, users, docs).distinct()
