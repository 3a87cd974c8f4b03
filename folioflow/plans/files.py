"""Round trips over files that are written from the tables to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import corpus as C
from ..operators import markup as M
from ..session import read_table, read_texts, settle, shared_folder
from ..sources import files as S
from ..sources import markup as K
from . import corpus as P
from .catalog import query
from .markup import page_nodes
from .roles import sql


def fresh(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("select c_custkey::varchar as key, c_name || '=' || c_mktsegment as value from customer")
def key_values(spark, d):
    """Customers as key=value lines with comment lines between."""
    path = fresh(spark, "lines")
    rows = read_table(spark, d, "customer").selectExpr(
        "cast(c_custkey as string) as key", "concat(c_name, '=', c_mktsegment) as value"
    )
    S.write_kv(rows, path, "customers")
    return S.read_kv(spark, path)


@query(sql(P.LINES, body="select doc_id, pos, region, hash, class_tokens, text, status from replaced"))
def dictionary_files(spark, d):
    """Replacement pairs and exclusions written as dictionary files, read back and applied."""
    clean = settle(C.hashed(P.sents(spark, d)))
    keyed = clean.withColumn("region", N.region(F.col("map_title")))
    pairs = (
        keyed.groupBy(F.col("region").alias("_region"), F.col("hash").alias("_hash"))
        .agg(F.count(F.lit(1)).alias("n"), F.concat(F.lit("NEW "), F.max("text")).alias("new"))
        .where("n > 1")
        .selectExpr("_region", "_hash", "stack(2, 'old', 1, new, 2) as (new, _pos)")
    )
    listed = clean.groupBy(F.col("hash").alias("_hash")).count().where("count > 3").select("_hash")
    places = [fresh(spark, name) for name in ("pairs", "items")]
    S.write_dictionary(pairs, places[0], "db", "pair")
    S.write_dictionary(listed, places[1], "excludes", "item")
    read = S.read_dictionary(spark, places[0], "pair", "_region string, _hash string, _pos int, new string")
    pairs = read.withColumnsRenamed({"_region": "region", "_hash": "hash", "_pos": "pos"})
    listed = S.read_dictionary(spark, places[1], "item", "_hash string").withColumnRenamed("_hash", "hash")
    return C.apply_replacements(C.flag_excluded(clean, listed), pairs).select(
        "doc_id", "pos", "region", "hash", "class_tokens", "text", "status"
    )


def page_files(spark, d):
    """Every page as a file of its own; odd ones end in .HTM."""
    folder = fresh(spark, "pages")
    pages = read_texts(spark, d, "pages", "page_id", "html")
    ending = F.when(F.col("page_id") % 2 == 1, ".HTM").otherwise(".html")
    named = pages.select(F.concat(F.lit("page"), F.col("page_id").cast("string"), ending).alias("name"), "html")
    return folder, S.write_named(named, folder, "name", "html")


@query(
    """
select 'page' || page_id || case when page_id % 2 = 1 then '.HTM' else '.html' end as file_name, strlen(html) as n_bytes
from pages where page_id % 2 = 1
"""
)
def file_inventory(spark, d):
    """Files below a folder by extension, without case, joined with what the writer noted."""
    folder, written = page_files(spark, d)
    return S.list_files(spark, folder, [".htm"]).join(written, "file_name")


@query(
    r"""
select 'page' || page_id || case when page_id % 2 = 1 then '.HTM' else '.html' end as file_name, lower(tag) as tag,
       count(*) as element_count
from (select page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) as tag from pages) group by 1, 2
"""
)
def file_elements(spark, d):
    """Elements of a folder of markup files, one document per file."""
    folder, _ = page_files(spark, d)
    nodes = K.read_markup(spark, folder, "page*", "html").where("tag <> '#text'")
    name = F.substring_index("path", "/", -1).alias("file_name")
    return nodes.groupBy(name, "tag").agg(F.count(F.lit(1)).alias("element_count"))


@query(
    r"""
select page_id % 10 as chapter, lower(tag) as tag, count(*) as element_count
from (select page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) as tag from pages)
group by 1, 2
"""
)
def split_pages(spark, d):
    """Nodes written to one folder per chapter, ten pages' remainders being the chapters, and read back."""
    path = fresh(spark, "split")
    nodes = page_nodes(spark, d).withColumn("chapter", F.col("page_id") % 10)
    S.write_split(nodes, path, "chapter", "page_id")
    back = spark.read.schema(nodes.schema).parquet(path).where("tag <> '#text'")
    return back.groupBy("chapter", "tag").agg(F.count(F.lit(1)).alias("element_count"))


@query(
    """
select o_orderkey, o_orderpriority, o_totalprice,
       row_number() over (order by o_orderpriority, o_orderkey) as place from orders
"""
)
def written_report(spark, d):
    """A report in row order: its files, one after the other by name, hold the rows in order."""
    path = fresh(spark, "report")
    rows = read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    S.write_report(rows, path, ["o_orderpriority", "o_orderkey"])
    schema = "o_orderkey long, o_orderpriority string, o_totalprice double"
    back = spark.read.schema(schema).option("header", True).csv(path).select(
        "*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    )
    return S.placed_in_files(back, ["file", "start"], "line").select("o_orderkey", "o_orderpriority", "o_totalprice", "place")


@query(
    r"""
with links as (
  select page_id, string_agg(label, '' order by i) as labels from (
    select page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a [^>]*>([^<]*)</a>', 1)) as label,
           generate_subscripts(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a [^>]*>([^<]*)</a>', 1), 1) as i
    from pages) group by 1),
items as (
  select page_id, unnest(regexp_extract_all(html, '<li><a [^>]*>([^<]*)</a></li>', 1)) as label from pages),
parts as (select page_id, 'nav' as tag, 'ul' || labels as content from links
          union all select page_id, 'li', 'a' || label from items
          union all select page_id, 'title', regexp_extract(html, '<title>([^<]*)</title>', 1) from pages)
select page_id, tag, upper(sha256(regexp_replace(replace(content, '&amp;', '&'),
         '(\p{Nd}+\s*)–(\s*\p{Nd}+)', '\1 ~ \2', 'g'))) as hash, count(*) as uses
from parts group by all
"""
)
def block_hashes(spark, d):
    """Content hashes of navigation bars, list entries and titles, everything below them included."""
    hashes = M.block_hashes(page_nodes(spark, d), ["nav", "li", "title"], "page_id")
    return hashes.groupBy("page_id", "tag", "hash").agg(F.count(F.lit(1)).alias("uses"))
