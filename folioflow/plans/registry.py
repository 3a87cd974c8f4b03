"""Queries over registries, order sheets and drawing labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import registry as R
from ..operators import upkeep as U
from ..operators.ordered import number_blocks, numbered
from ..session import read_table, read_texts
from ..sources import sheets
from .catalog import query
from .roles import sql


def import_rows(spark, d):
    return read_table(spark, d, "part").selectExpr(
        "p_partkey as row_no",
        "case when p_retailprice < 901 then ' ' else concat(p_name, ' ', p_brand, ' ') end as name",
        "case when p_size < 15 then 'v' when p_size < 30 then ' X' when p_size < 40 then '' else 'O' end as value",
    )


IMPORT_ROWS = """import_rows as (
  select p_partkey as row_no,
         case when p_retailprice < 901 then ' ' else p_name || ' ' || p_brand || ' ' end as name,
         case when p_size < 15 then 'v' when p_size < 30 then ' X' when p_size < 40 then '' else 'O' end as value
  from part)"""


def registered(spark, d):
    return read_table(spark, d, "part").where(F.col("p_type").isin("ECONOMY", "PROMO")).selectExpr(
        "upper(concat(p_name, ' ', p_brand)) as name",
        "case when p_size > 25 then 'v' when p_size > 5 then 'X' else '' end as value",
        "timestamp_seconds(1700000000 + p_partkey) as reg_dt",
    )


REGISTERED = """registered as (
  select upper(p_name || ' ' || p_brand) as name,
         case when p_size > 25 then 'v' when p_size > 5 then 'X' else '' end as value,
         make_timestamp((1700000000 + p_partkey) * 1000000) as reg_dt
  from part where p_type in ('ECONOMY', 'PROMO'))"""

CLASSIFIED = """classified as (
  select row_no, trim(name) as name, upper(trim(value)) as value, upper(trim(name)) as canon,
         trim(name) <> '' and upper(trim(value)) in ('V', 'X', '') as valid
  from import_rows where trim(name) <> '' or trim(value) <> ''),
judged as (
  select *, case when not valid then '' when value = '' then 'X' else value end as applied,
         valid and row_no = max(case when valid then row_no end) over (partition by canon) as winner,
         case when name = '' then 'name missing'
              when not valid then 'value must be V, X or blank'
              when row_no < max(case when valid then row_no end) over (partition by canon)
                then 'superseded by a later row'
              when value = '' then 'blank taken as X' else '' end as note
  from classified)"""

OLD = """old_registry as (
  select upper(trim(name)) as canon, name, value, reg_dt from (
    select *, row_number() over (partition by upper(trim(name)) order by reg_dt, name) as rn from registered)
  where rn = 1)"""

DETAILS = """details as (
  select j.row_no, j.canon, j.name, j.value, j.applied,
         case when j.winner then coalesce(o.value, '') else '' end as previous,
         case when j.winner is not true then 'skipped' when o.canon is null then 'new'
              when upper(o.value) = j.applied then 'same' else 'changed' end as result, j.note
  from judged j left join old_registry o using (canon))"""


@query(sql(IMPORT_ROWS, CLASSIFIED, body="select row_no, name, value, canon, valid, applied from judged"))
def import_classification(spark, d):
    judged = R.classify_import(import_rows(spark, d))
    return judged.select("row_no", "name", "value", "canon", "valid", "applied")


@query(sql(IMPORT_ROWS, CLASSIFIED, body="select row_no, canon, applied, note from judged where winner"))
def last_valid_rows(spark, d):
    judged = R.last_valid(R.classify_import(import_rows(spark, d)))
    return judged.where("winner").select("row_no", "canon", "applied", "note")


@query(sql(IMPORT_ROWS, CLASSIFIED, REGISTERED, OLD, DETAILS, body="select * from details"))
def import_details(spark, d):
    return R.import_details(registered(spark, d), import_rows(spark, d))


@query(
    sql(
        IMPORT_ROWS, CLASSIFIED, REGISTERED, OLD, DETAILS,
        body="""
select count(*) as total_rows, count(*) filter (where result = 'new') as inserted, count(*) filter (where result = 'changed') as updated,
       count(*) filter (where result = 'same') as unchanged, count(*) filter (where result = 'skipped') as skipped
from details
""",
    )
)
def import_summary(spark, d):
    return R.import_summary(R.import_details(registered(spark, d), import_rows(spark, d)))


NOW = "2026-01-01 00:00:00"


@query(
    sql(
        IMPORT_ROWS, CLASSIFIED, REGISTERED, OLD, DETAILS,
        body=f"""
, writes as (select * from details where result in ('new', 'changed'))
select canon, coalesce(o.name, w.name) as name, coalesce(w.applied, o.value) as value,
       coalesce(o.reg_dt, timestamp '{NOW}') as reg_dt
from old_registry o full outer join writes w using (canon)
""",
    )
)
def registry_upsert(spark, d):
    now = F.lit(NOW).cast("timestamp")
    merged, _ = R.upsert_registry(registered(spark, d), import_rows(spark, d), now)
    return merged


@query(
    sql(
        REGISTERED, OLD,
        body="""
select p_partkey, p_name || ' ' || p_brand as name,
       coalesce(case when upper(trim(value)) in ('V', 'X') then upper(trim(value)) end, '') as check_value
from part left join old_registry on canon = upper(trim(p_name || ' ' || p_brand))
""",
    )
)
def color_check_lookup(spark, d):
    entries = read_table(spark, d, "part").selectExpr(
        "p_partkey", "concat(p_name, ' ', p_brand) as name"
    )
    checked = R.with_color_check(entries, registered(spark, d))
    return checked.select("p_partkey", "name", "check_value")


def reviewed(spark, d):
    return read_table(spark, d, "part").selectExpr(
        "p_type as sheet",
        "p_partkey as row_no",
        "p_name as name",
        "case when p_size < 30 then ' v' when p_size < 45 then 'X' else '' end as color_value",
        "case when p_brand = 'Brand#1' then '' else p_brand end as chapter",
        "case when p_size < 4 then ' q' when p_size < 8 then 'A' else cast(p_size - 7 as string) end as chapter_no",
    )


REVIEWED = """reviewed as (
  select p_type as sheet, p_partkey as row_no, p_name as name,
         case when p_size < 30 then ' v' when p_size < 45 then 'X' else '' end as color_value,
         case when p_brand = 'Brand#1' then '' else p_brand end as chapter,
         case when p_size < 4 then ' q' when p_size < 8 then 'A' else cast(p_size - 7 as varchar) end as chapter_no
  from part),
entries as (select *, case when upper(trim(chapter_no)) = 'Q' or regexp_matches(trim(chapter_no), '^[1-9][0-9]*$')
              then upper(trim(chapter_no)) else '1' end as chapter_group
            from reviewed where upper(trim(color_value)) = 'V')"""


@query(
    sql(
        REVIEWED,
        body="""
, tops as (select sheet, greatest(11, coalesce(max(try_cast(chapter_group as int)), 0)) as top from entries group by 1),
spine as (select sheet, cast(x as bigint) as position,
                 case when x = 0 then 'Q' else cast(x as varchar) end as chapter
          from (select sheet, unnest(range(0, top + 1)) as x from tops))
select s.sheet, s.position, s.chapter, count(e.row_no) as entry_count, count(e.row_no) * 4500 as amount
from spine s left join entries e on e.sheet = s.sheet and e.chapter_group = s.chapter
group by all
""",
    )
)
def order_summary(spark, d):
    return R.order_summary(R.selected_entries(reviewed(spark, d)), "sheet")


ORDER_LINES = """order_lines as (
  select sheet, row_number() over (partition by sheet order by row_no) as line_no, name,
         case when trim(chapter) = '' then '도안' else chapter end as chapter, '설명도' as line_kind,
         4500 as unit_price, 1 as quantity, 4500 as amount, lower(sheet) as vehicle, chapter_no
  from entries)"""


@query(sql(REVIEWED, ORDER_LINES, body="select * from order_lines"))
def order_lines(spark, d):
    return R.order_lines(R.selected_entries(reviewed(spark, d)), "sheet", F.lower("sheet"))


@query(
    sql(
        REVIEWED, ORDER_LINES,
        body="""
select sheet, cast(sum(quantity) as bigint) as quantity, cast(sum(amount) as bigint) as amount
from order_lines group by rollup (sheet)
""",
    )
)
def order_totals(spark, d):
    lines = R.order_lines(R.selected_entries(reviewed(spark, d)), "sheet", F.lower("sheet"))
    return R.order_totals(lines, "sheet")


@query(
    sql(
        REVIEWED,
        body="""
select sheet, row_no, case when regexp_matches(trim(chapter_no), '^[1-9][0-9]*$') then cast(trim(chapter_no) as bigint)
       when upper(trim(chapter_no)) = 'Q' then 2147483646 else 2147483647 end as sort_key
from reviewed
""",
    )
)
def chapter_sort_keys(spark, d):
    rows = reviewed(spark, d)
    keyed = rows.select("sheet", "row_no", R.chapter_key(F.col("chapter_no")).alias("sort_key"))
    return keyed.orderBy("sheet", "sort_key", "row_no")


def text_lines(spark, d):
    words = read_texts(spark, d, "documents", "doc_id", "text").select(
        "doc_id", F.posexplode(F.split("text", "\\s+")).alias("pos", "word")
    )
    return words.selectExpr(
        "doc_id",
        "cast(pos div 40 as bigint) as page",
        "cast(pos as bigint) as pos",
        "concat(word, '_', cast(length(word) as string)) as text",
        "4.5 + length(word) / 8.0D as font_size",
    )


TEXT_LINES = r"""words as (
  select doc_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as pos
  from (select doc_id, regexp_split_to_array(text, '\s+') as w from documents)),
text_lines as (
  select doc_id, pos // 40 as page, pos, word || '_' || length(word) as text,
         4.5 + length(word) / 8.0 as font_size from words),
labels_found as (
  select * from text_lines
  where font_size <= 5.5 and regexp_matches(text, '^[A-Za-z][A-Za-z0-9_]{6,}$') and regexp_matches(text, '[0-9]'))"""


@query(sql(TEXT_LINES, body="select doc_id, page, pos, text from labels_found"))
def drawing_labels(spark, d):
    return R.drawing_lines(text_lines(spark, d)).select("doc_id", "page", "pos", "text")


@query(
    sql(
        TEXT_LINES,
        body="""
select doc_id, upper(text) as canon, min(pos) as pos, arg_min(text, pos) as text
from labels_found group by 1, 2
""",
    )
)
def first_labels(spark, d):
    found = R.drawing_lines(text_lines(spark, d))
    first = R.first_occurrence(found, ["doc_id"], ["page", "pos"])
    return first.select("doc_id", "canon", "pos", "text")


# -- table maintenance -----------------------------------------------------------------------


@query(
    """
with known as (select c_name as name, c_custkey as id from customer where c_acctbal >= 0),
rows as (select c_name as name, c_custkey as id from customer
         union all select s_name, s_suppkey from supplier)
select * from known
union all
select name, min(id) from rows where name not in (select name from known) group by 1
"""
)
def insert_missing(spark, d):
    customers = read_table(spark, d, "customer")
    known = customers.where("c_acctbal >= 0").selectExpr("c_name as name", "c_custkey as id")
    rows = customers.selectExpr("c_name as name", "c_custkey as id").unionByName(
        read_table(spark, d, "supplier").selectExpr("s_name as name", "s_suppkey as id")
    )
    return U.insert_missing(known, rows, ["name"], ["id"])


@query(
    """
select o_orderkey, o_custkey from orders
where o_custkey not in (select c_custkey from customer where c_acctbal < 0)
"""
)
def delete_by_key(spark, d):
    table = read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    gone = read_table(spark, d, "customer").where("c_acctbal < 0").selectExpr("c_custkey as o_custkey")
    return U.delete_keys(table, gone)


@query(
    """
with items as (select distinct p_name as external_id from part union select n_name from nation),
known as (select n_name as external_id, cast(n_nationkey as bigint) as id from nation where n_regionkey < 3)
select count(*) as row_count, count(distinct id) as id_count, max(id) as max_id,
       count(distinct external_id) as external_count
from (select * from known union all
      select external_id, (select max(id) from known) + row_number() over (order by external_id)
      from items where external_id not in (select external_id from known))
"""
)
def get_or_create(spark, d):
    """New external ids get dense ids above the highest known one (their order is free)."""
    nation = read_table(spark, d, "nation")
    known = nation.where("n_regionkey < 3").selectExpr(
        "n_name as external_id", "cast(n_nationkey as bigint) as id"
    )
    items = read_table(spark, d, "part").selectExpr("p_name as external_id").unionByName(
        nation.selectExpr("n_name as external_id")
    )
    table = U.register(known, items, "external_id", "id")
    return table.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.countDistinct("id").alias("id_count"),
        F.max("id").alias("max_id"),
        F.countDistinct("external_id").alias("external_count"),
    )


@query(
    """
select (select count(*) from part) as total_count,
       (select count(*) from part where contains(p_name, 'ring')) as shown_count
"""
)
def filter_summary(spark, d):
    part = read_table(spark, d, "part")
    return U.filter_summary(part, part.where(T.keyword_match([F.col("p_name")], "ring")))


@query("select count(*) as row_count from lineitem")
def row_count(spark, d):
    return U.count_all(read_table(spark, d, "lineitem"))


@query("select event_id as id, ts as started_at, event_type from events order by ts desc, event_id desc limit 500")
def recent_logs(spark, d):
    logs = read_table(spark, d, "events").selectExpr("event_id as id", "ts as started_at", "event_type")
    return U.recent_logs(logs, 100000)


# -- sheets ----------------------------------------------------------------------------------

HEADER_ALIASES = {"name": ["도안명"], "value": ["컬러도안"]}


def import_cells(spark, d):
    """The parts as import sheets, one file per type: a title, a header on row 3, data below."""
    placed = numbered(
        read_table(spark, d, "part"), ["p_type"], ["p_partkey"], number_blocks("p_partkey"), out="n"
    )
    data = placed.selectExpr(
        "p_type as file",
        "1 as sheet_no",
        "n + 3 as row_no",
        "stack(3, 0, p_name, 1, p_brand, 2, cast(p_size as string)) as (col_no, value)",
    )
    files = read_table(spark, d, "part").selectExpr("p_type as file").distinct()
    top = files.selectExpr(
        "file",
        "stack(6, 0, 1L, 0, '도안명', 0, 2L, 1, '컬러도안', 1, 1L, 0, 'title',"
        " 1, 3L, 0, '도안 명', 1, 3L, 1, '레드도안', 1, 3L, 2, ' 컬러 도안') as (sheet_no, row_no, col_no, value)",
    )
    return data.unionByName(top.select("file", "sheet_no", "row_no", "col_no", "value"))


@query(
    """
select p_type as file, p_name as name, cast(p_size as varchar) as value,
       3 + row_number() over (partition by p_type order by p_partkey) as row_no
from part
"""
)
def sheet_scan(spark, d):
    """Header discovery skips the first sheet, which never shows both headers in one row."""
    return sheets.read_sheet(import_cells(spark, d), HEADER_ALIASES)
