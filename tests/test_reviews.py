import datetime as dt

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import ordered
from folioflow.operators import reviews as R

AT = dt.datetime(2026, 6, 15, 8, 30)
COMMENT = "comment_id long, doc_id long, page_num long, user_id string, comment_text string, status string, create_dt timestamp"
REPLY = "reply_id long, comment_id long, user_id string, reply_text string, create_dt timestamp"
FILE = "attachment_id long, comment_id long, reply_id long, original_name string, content_type string, create_dt timestamp"


def tables(spark):
    comments = spark.createDataFrame([(10, 1, 3, "admin", "본문", "RESOLVED", AT), (11, 1, None, "x", "t", "OPEN", AT)], COMMENT)
    replies = spark.createDataFrame([(30, 10, "u2", "답글", AT + dt.timedelta(minutes=1))], REPLY)
    users = spark.createDataFrame([("admin", "관리자"), ("u2", "답글 작성자")], "user_id string, user_name string")
    files = spark.createDataFrame(
        [(20, 10, None, "a.png", "image/png", AT), (21, 10, None, "b.txt", None, AT), (22, 10, 30, "c.pdf", "x", AT)], FILE
    )
    return comments, replies, users, files


def test_review_sheet_rows(spark):
    comments, replies, users, files = tables(spark)
    rows = R.order_review(R.review_sheet(comments, replies, users, files)).collect()
    assert [(r.status_label, r.kind, r.page_label, r.author, r.text, r.other_count, r.image_count) for r in rows] == [
        ("해결", "원댓글", "3페이지", "관리자", "본문", 1, 1),
        ("해결", "답글", "3페이지", "답글 작성자", "↳ 답글", 1, 0),
        ("미해결", "원댓글", "", "x", "t", 0, 0),
    ]
    keys = ["comment_id", "owner_reply"]
    lines = R.joined_names(R.attachment_names(R.owned(files), keys), keys).collect()
    assert sorted((r.line_no, r.other_files) for r in lines) == [(0, "b.txt"), (0, "c.pdf")]


def test_threads_keep_one_row_per_comment_whatever_their_size(spark, monkeypatch):
    comments, _, users, files = tables(spark)
    replies = spark.createDataFrame(
        [(i, 10, "u2", f"r{i}", AT + dt.timedelta(seconds=i)) for i in range(7)], REPLY
    )
    many = spark.range(2500).select(
        (F.col("id") + 1000).alias("attachment_id"), F.lit(11).alias("comment_id"), F.lit(None).cast("long").alias("reply_id"),
        F.lit("p.png").alias("original_name"), F.lit("image/png").alias("content_type"), F.lit(AT).alias("create_dt"),
    )
    files = files.unionByName(many)
    for hot in (1 << 20, 0):
        monkeypatch.setattr(ordered, "HOT_ROWS", hot)
        rows = R.assemble_threads(comments, replies, files).orderBy("comment_id").collect()
        assert [(r.comment_id, r.reply_count, r.file_count) for r in rows] == [(10, 7, 2), (11, 0, 2500)]
        placed = R.thread_replies(replies, files).orderBy("position").collect()
        assert [(r.position, r.reply_id) for r in placed] == [(i + 1, i) for i in range(7)]
        own = R.thread_files(files)
        assert [r.original_name for r in own.where("comment_id = 10").orderBy("position").collect()] == ["a.png", "b.txt"]
        assert own.where("comment_id = 11").agg(F.max("position")).first()[0] == 2500
        sheet = R.review_sheet(comments, replies, users, files).where("comment_id = 11").collect()
        assert [(r.image_count, r.other_count) for r in sheet] == [(2500, 0)]


def test_codes_are_never_truncated(spark):
    many = spark.range(10_001).select(
        F.lit(1).alias("doc_id"), F.lit(AT).alias("create_dt"), F.col("id").alias("comment_id")
    )
    coded = R.assign_codes(many)
    assert coded.where("comment_id = 10000").first().comment_code == "id10000"
    assert coded.where("comment_id = 2").first().comment_code == "id0002"
    assert R.next_code(coded).first().next_number == 10001
    assert R.next_code(coded.withColumn("comment_code", F.lit("old"))).first().next_number == 0


def test_guarded_update_and_delete(spark):
    comments, replies, users, files = tables(spark)
    wrong = spark.createDataFrame([(10, "x", "new"), (11, "x", "new")], "comment_id long, user_id string, comment_text string")
    changed = {r.comment_id: (r.comment_text, r.updated) for r in R.guarded_update(comments, wrong, ["comment_text"]).collect()}
    assert changed == {10: ("본문", False), 11: ("new", True)}
    left = R.delete_threads(comments, replies, files, spark.createDataFrame([(10, "admin")], "comment_id long, user_id string"))
    assert [df.count() for df in left] == [1, 0, 0]


def test_mentions(spark):
    one = spark.createDataFrame([("@관리자 hi a@b.com, (@u.2) @u.2  and  @x",)], "t string")
    row = one.select(T.mentions(F.col("t")).alias("m"), T.without_mentions(F.col("t")).alias("b")).first()
    assert row.m == ["관리자", "u.2", "x"]
    assert row.b == "hi a@b.com, () and"


def test_mention_prefers_name_over_id(spark):
    users = spark.createDataFrame([("bob", "Al"), ("z", "bob"), ("y", "bob")], "user_id string, user_name string")
    asked = spark.createDataFrame([("bob",), ("nobody",)], "mention string")
    assert [(r.mention, r.user_id) for r in R.resolve_mentions(asked, users).collect()] == [("bob", "y")]


def test_repeated_changes_and_users_do_not_multiply_rows(spark):
    from folioflow.operators import reviews

    comments = spark.createDataFrame([(1, "u", "old"), (2, "u", "old")], "comment_id int, user_id string, comment_text string")
    changes = spark.createDataFrame([(1, "u", "b"), (1, "u", "a")], "comment_id int, user_id string, comment_text string")
    found = reviews.guarded_update(comments, changes, ["comment_text"]).collect()
    assert sorted((r.comment_id, r.comment_text, r.updated) for r in found) == [(1, "a", True), (2, "old", False)]
    users = spark.createDataFrame([("u", "Z"), ("u", "A")], "user_id string, user_name string")
    assert [r.user_name for r in reviews.with_author(comments, users).collect()] == ["A", "A"]
