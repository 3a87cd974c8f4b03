"""How the given tables play the roles of review threads, registries, contents lists and so on.

Each role has a DataFrame builder and the same projection as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import dated_blocks
from ..session import SMALL_ROWS_BYTES, read_table, spread

#: reply and attachment ids pack part, supplier and line number
REPLY_ID = "l_partkey * 10000000 + l_suppkey * 10 + l_linenumber"
REPLY_ID_WIDTH = 10**10


def reply_blocks():
    return dated_blocks("create_dt", "reply_id", REPLY_ID_WIDTH)


def attachment_blocks():
    return dated_blocks("create_dt", "attachment_id", REPLY_ID_WIDTH)


def comments(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "orders").selectExpr(
        "o_orderkey as comment_id",
        "o_custkey as doc_id",
        "cast(month(o_orderdate) as bigint) as page_num",
        "concat('C', cast(o_orderkey div 10 as string)) as user_id",
        "concat('Hi @', o_orderpriority, ' at ', o_orderstatus) as comment_text",
        "case when o_orderstatus = 'F' then 'RESOLVED' else 'OPEN' end as status",
        "case o_orderstatus when 'F' then 'RECT' when 'O' then 'CALLOUT' else 'TEXT' end as comment_type",
        "o_orderdate as create_dt",
    )


COMMENTS = """comments as (
  select o_orderkey as comment_id, o_custkey as doc_id,
         cast(month(o_orderdate) as bigint) as page_num,
         'C' || cast(o_orderkey // 10 as varchar) as user_id,
         'Hi @' || o_orderpriority || ' at ' || o_orderstatus as comment_text,
         case when o_orderstatus = 'F' then 'RESOLVED' else 'OPEN' end as status,
         case o_orderstatus when 'F' then 'RECT' when 'O' then 'CALLOUT' else 'TEXT' end as comment_type,
         o_orderdate as create_dt
  from orders)"""


def lines(spark: SparkSession, folder: str) -> DataFrame:
    table = read_table(spark, folder, "lineitem")
    return spread(table, "l_orderkey", "l_partkey", "l_suppkey", limit=SMALL_ROWS_BYTES)


def replies(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder).selectExpr(
        "l_orderkey as comment_id",
        f"{REPLY_ID} as reply_id",
        "concat('S', cast(l_suppkey as string)) as user_id",
        "concat(l_returnflag, ' ', l_linestatus) as reply_text",
        "l_shipdate as create_dt",
    )


REPLIES = f"""replies as (
  select l_orderkey as comment_id, {REPLY_ID} as reply_id,
         'S' || cast(l_suppkey as varchar) as user_id,
         l_returnflag || ' ' || l_linestatus as reply_text, l_shipdate as create_dt
  from lineitem)"""


def users(spark: SparkSession, folder: str) -> DataFrame:
    customers = read_table(spark, folder, "customer").selectExpr(
        "concat('C', cast(c_custkey as string)) as user_id",
        "c_name as user_name",
        "lower(concat(c_mktsegment, '@example.com')) as user_email",
        "c_mktsegment as user_role",
    )
    suppliers = read_table(spark, folder, "supplier").selectExpr(
        "concat('S', cast(s_suppkey as string)) as user_id",
        # blank name: the sheet shows the id
        "case when s_acctbal < 0 then '' else s_name end as user_name",
        "'' as user_email",
        "'SUPPLIER' as user_role",
    )
    return customers.unionByName(suppliers)


USERS = """users as (
  select 'C' || cast(c_custkey as varchar) as user_id, c_name as user_name,
         lower(c_mktsegment || '@example.com') as user_email, c_mktsegment as user_role
  from customer
  union all
  select 'S' || cast(s_suppkey as varchar),
         case when s_acctbal < 0 then '' else s_name end, '', 'SUPPLIER'
  from supplier)"""


def attachments(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder).selectExpr(
        "l_orderkey as comment_id",
        f"{REPLY_ID} as attachment_id",
        f"case when l_linestatus = 'F' then {REPLY_ID} end as reply_id",
        "concat('file', cast(l_partkey as string), lower(l_returnflag)) as original_name",
        "case l_returnflag when 'A' then 'image/PNG' when 'R' then 'application/pdf' end as content_type",
        "l_shipdate as create_dt",
    )


ATTACHMENTS = f"""attachments as (
  select l_orderkey as comment_id, {REPLY_ID} as attachment_id,
         case when l_linestatus = 'F' then {REPLY_ID} end as reply_id,
         'file' || cast(l_partkey as varchar) || lower(l_returnflag) as original_name,
         case l_returnflag when 'A' then 'image/PNG' when 'R' then 'application/pdf' end as content_type,
         l_shipdate as create_dt
  from lineitem)"""


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "customer").selectExpr(
        "c_custkey as doc_id",
        "case when c_acctbal < 0 then '' else concat(c_name, '.pdf') end as file_name",
        "lower(c_mktsegment) as file_path",
        "cast(c_nationkey as bigint) as page_count",
        "concat('C', cast(c_custkey as string)) as reg_user_id",
    )


DOCS = """docs as (
  select c_custkey as doc_id,
         case when c_acctbal < 0 then '' else c_name || '.pdf' end as file_name,
         lower(c_mktsegment) as file_path, cast(c_nationkey as bigint) as page_count,
         'C' || cast(c_custkey as varchar) as reg_user_id
  from customer)"""


def sql(*roles: str, body: str) -> str:
    return "with " + ",\n".join(roles) + "\n" + body.strip()
