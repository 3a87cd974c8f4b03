"""Work that must not grow faster than the tables."""

from pyspark.sql import functions as F

from folioflow.functions import names as N
from folioflow.operators import corpus as C
from folioflow.operators import markup as M
from folioflow.operators import reviews as R
from folioflow.sources import markup
from folioflow.streaming import events as E
from folioflow.streaming import live as L


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_languages_are_not_broadcast(spark):
    pages = spark.createDataFrame([(1, "<html lang='en'><title>a</title></html>")], "doc_id long, html string")
    got = M.effective_lang(markup.node_table(pages, "doc_id", "html", "html"), "lang")
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r.effective_lang for r in got.where("tag = 'title'").collect()] == ["en"]


def stream(spark, folder, kinds):
    rows = spark.range(1000).selectExpr(
        "id as event_id", "timestamp_micros(id) as ts", "7L as room", "if(id % 500 = 0, null, id % 500) as user_id",
        "'a' as session", f"case id div 500 when 0 then '{kinds[0]}' else '{kinds[1]}' end as type", "7L as comment_id",
    )
    rows.coalesce(1).write.parquet(str(folder / "in"))
    return E.read_events(spark, str(folder / "in"), rows.schema)


def state_rows(df, folder):
    kept = []
    query = (
        df.writeStream.option("checkpointLocation", str(folder / "state")).trigger(availableNow=True)
        .foreachBatch(lambda batch, number: kept.extend(batch.collect())).start()
    )
    query.awaitTermination()
    return kept, max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])


def test_presence_calls_python_once_a_part(spark, tmp_path):
    rows, state = state_rows(L.presence_steps(stream(spark, tmp_path, (E.JOIN, E.JOIN))), tmp_path)
    assert len(rows) == 1000 and sum(r.step for r in rows) == 500 and state <= L.USER_PARTS + 1
    assert sorted(r.event_id for r in rows if r.user_id is None) == [0, 500]


def test_editing_calls_python_once_a_part(spark, tmp_path):
    comments = spark.createDataFrame([(7, 7)], "comment_id long, doc_id long")
    events = stream(spark, tmp_path, (E.EDITING_START, E.EDITING_START))
    rows, state = state_rows(L.editing_updates(events, comments), tmp_path)
    assert len(rows) == 1000 and all(r.ended_at is None for r in rows) and state <= L.USER_PARTS + 1


def test_label_is_spelled_out_once(spark):
    assert len(str(N.vehicle_label(F.col("name"), "ACME"))) < 10_000


def test_a_common_mention_has_parts(spark):
    comments = spark.range(100).selectExpr(
        "id as comment_id", "1L as doc_id", "'x' as comment_code", "concat('Look @S', id, ' @nobody @all') as comment_text"
    )
    users = spark.createDataFrame([("S1", "all"), ("S2", "")], "user_id string, user_name string")
    docs = spark.createDataFrame([(1, "f", "p")], "doc_id long, file_name string, file_path string")
    got = R.mention_rows(comments, users, docs)
    assert "_part" in plan(got)
    found = [(r.comment_id, r.target_user) for r in got.collect()]
    assert sorted(found) == sorted([(i, "S1") for i in range(100)] + [(1, "S1"), (2, "S2")])


def test_made_columns_do_not_travel_in_the_sort(spark):
    comments = spark.createDataFrame(
        [(1, 5, 2, "u", "hi", "OPEN", None)],
        "comment_id long, doc_id long, page_num long, user_id string, comment_text string, status string, create_dt timestamp",
    )
    replies = spark.createDataFrame([(1, 3, "v", "re", None)], "comment_id long, reply_id long, user_id string, reply_text string, create_dt timestamp")
    users = spark.createDataFrame([("u", "U")], "user_id string, user_name string")
    files = spark.createDataFrame([(1, 3, "image/png")], "comment_id long, reply_id long, content_type string")
    sheet = R.review_sheet(comments, replies, users, files)
    got = R.order_review(sheet)
    before, _, below = plan(got).partition("Sort [")
    assert "AS author" in before and "AS author" not in below and "AS status_label" not in below
    assert got.columns == sheet.columns and got.collect() == sorted(sheet.collect(), key=lambda r: r.owner_reply)


def test_unchanged_sentences_join_once(spark, monkeypatch):
    kept, settle = [], C.settle
    monkeypatch.setattr(C, "settle", lambda df: kept.append(1) or settle(df))
    rows = spark.createDataFrame([("m", 1, "the a", None, None), ("m", 2, "b", None, None)], "map_title string, doc_id long, text string, class_tokens string, status string")
    got = C.unchanged_sentences(rows, "the", ["map_title"], ["doc_id"], [F.col("doc_id")])
    assert [(r.doc_id, r.list_no) for r in got.collect()] == [(1, 1)] and kept == [1]
