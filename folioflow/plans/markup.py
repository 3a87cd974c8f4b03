"""Queries over markup nodes, page chapters and folder trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..operators import hierarchy as H
from ..operators import layout as L
from ..operators import markup as M
from ..operators import toc as O
from ..operators.ordered import number_blocks, numbered, time_blocks
from ..session import read_table, read_texts, settle
from ..sources import markup as S
from .catalog import query


def page_nodes(spark, d):
    """Nodes of all pages, parsed once and kept."""
    return settle(S.node_table(read_texts(spark, d, "pages", "page_id", "html"), "page_id", "html", "html"))


@query(
    r"""
select page_id, lower(tag) as tag, count(*) as element_count
from (select page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) as tag from pages)
group by 1, 2
"""
)
def element_counts(spark, d):
    nodes = S.node_table(read_texts(spark, d, "pages", "page_id", "html"), "page_id", "html", "html")
    return nodes.where("tag <> '#text'").groupBy("page_id", "tag").agg(
        F.count(F.lit(1)).alias("element_count")
    )


@query(
    r"""
select page_id, replace(href, '&amp;', '&') as href, count(*) as uses
from (select page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) as href from pages) group by 1, 2
"""
)
def page_links(spark, d):
    nodes = S.node_table(read_texts(spark, d, "pages", "page_id", "html"), "page_id", "html", "html")
    links = nodes.where("tag = 'a'").select("page_id", F.col("attrs")["href"].alias("href"))
    return links.where("href is not null").groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("uses"))


@query(
    r"""
select page_id, lower(tag) as tag, count(*) as element_count
from (select page_id, unnest(regexp_extract_all(
        regexp_replace(html, '(?s)<nav>.*?</nav>|<div class="ad">.*?</div>', '', 'g'), '<([a-zA-Z][a-zA-Z0-9]*)', 1)) as tag from pages)
group by 1, 2
"""
)
def pruned_elements(spark, d):
    """Navigation and advertisements leave with everything in them."""
    rule = (F.col("tag") == "nav") | ((F.col("tag") == "div") & (F.col("attrs")["class"] == "ad"))
    left = M.prune(page_nodes(spark, d), rule, "page_id")
    return left.where("tag <> '#text'").groupBy("page_id", "tag").agg(
        F.count(F.lit(1)).alias("element_count")
    )


@query(
    """
select page_id, coalesce(nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), ''), null) as effective_lang
from pages
"""
)
def page_languages(spark, d):
    nodes = M.effective_lang(page_nodes(spark, d), "lang", "page_id")
    return nodes.where("tag = 'title'").select("page_id", "effective_lang")


@query(
    r"""
select page_id, 'local' as scope, cast(null as varchar) as href, count(*) as link_count
from (select page_id, unnest(regexp_extract_all(html, '<a [^>]*>')) as link from pages) group by 1
"""
)
def attribute_updates(spark, d):
    """Every link gets a scope attribute and loses its href."""
    nodes = page_nodes(spark, d)
    links = nodes.where("tag = 'a'").select("page_id", "node_id")
    updates = links.select(
        "*", F.inline(F.array(
            F.struct(F.lit("scope").alias("name"), F.lit("local").alias("value"), F.lit(1).alias("seq")),
            F.struct(F.lit("href").alias("name"), F.lit(None).cast("string").alias("value"), F.lit(2).alias("seq")),
        ))
    )
    changed = M.update_attrs(nodes, updates, "page_id").where("tag = 'a'")
    return changed.groupBy(
        "page_id", F.col("attrs")["scope"].alias("scope"), F.col("attrs")["href"].alias("href")
    ).agg(F.count(F.lit(1)).alias("link_count"))


@query(
    r"""
with lists as (
  select page_id, unnest(regexp_extract_all(html, '(?s)<ul>(.*?)</ul>', 1)) as body,
         generate_subscripts(regexp_extract_all(html, '(?s)<ul>(.*?)</ul>', 1), 1) as n from pages)
select page_id, len(regexp_extract_all(body, '<li')) as group_count, count(*) as list_count
from lists where len(regexp_extract_all(body, '<li')) >= 2 group by 1, 2
"""
)
def grouped_lists(spark, d):
    """Lists with two or more entries, as a stand-in for tables with several column groups."""
    found = M.multi_group_tables(page_nodes(spark, d), "ul", "li", "page_id")
    return found.groupBy("page_id", "group_count").agg(F.count(F.lit(1)).alias("list_count"))


@query(
    r"""
select page_id, 'a' as tag, cast(1 as bigint) as level, count(*) as entry_count
from (select page_id, unnest(regexp_extract_all(html, '<a [^>]*href=')) as link from pages) group by 1
"""
)
def flattened_entries(spark, d):
    """Elements with an href by nesting level; links of pages do not nest."""
    entries = M.flatten_tree(page_nodes(spark, d), "page_id")
    return entries.groupBy("page_id", "tag", "level").agg(F.count(F.lit(1)).alias("entry_count"))


@query(
    """
with outline as (
  select o_custkey as doc_id, extract(epoch from o_orderdate)::bigint // 86400 as page,
         o_orderpriority as title, o_orderkey as seq from orders where o_orderstatus = 'F'),
entries as (select doc_id, page, arg_max(title, seq) as title from outline group by 1, 2),
pages_seen as (
  select o_custkey as doc_id, extract(epoch from o_orderdate)::bigint // 86400 as page,
         max(case when o_orderstatus = 'P' then o_orderpriority end) as detected
  from orders group by 1, 2)
select p.doc_id, p.page, p.detected,
       coalesce(e.title, last_value(p.detected ignore nulls) over
         (partition by p.doc_id order by p.page rows unbounded preceding)) as chapter
from pages_seen p asof left join entries e on e.doc_id = p.doc_id and e.page <= p.page
"""
)
def page_chapters(spark, d):
    orders = read_table(spark, d, "orders").selectExpr(
        "o_custkey as doc_id", "unix_date(cast(o_orderdate as date)) as day", "o_orderpriority", "o_orderstatus",
        "o_orderkey",
    ).withColumn("page", F.col("day").cast("long"))
    pages = orders.groupBy("doc_id", "page").agg(
        F.max(F.expr("case when o_orderstatus = 'P' then o_orderpriority end")).alias("detected")
    )
    outline = orders.where("o_orderstatus = 'F'").selectExpr(
        "doc_id", "page", "o_orderpriority as title", "o_orderkey as seq"
    )
    return L.chapter_for_pages(pages, outline)


@query(
    """
with labels as (
  select l_suppkey as page, ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 100 + cast(l_quantity as bigint) as label_id,
         cast(l_partkey % 600 as double) as x, cast(l_quantity * 7 as double) as y, 10.0::double as width
  from lineitem),
near as (
  select a.page, a.label_id, a.x + 5 as center,
         max(case when b.x < a.x then b.x + 5 end) as before, min(case when b.x >= a.x then b.x + 5 end) as after
  from labels a join labels b on a.page = b.page and a.label_id <> b.label_id and abs(a.y - b.y) < 20
  group by all)
select l.page, l.label_id,
       coalesce(center - coalesce(center - before, after - center) / 2, 0) as left_bound,
       coalesce(center + coalesce(after - center, center - before) / 2, 612) as right_bound
from labels l left join near n using (page, label_id)
"""
)
def label_limits(spark, d):
    """Bounds between neighbouring labels; lines of a supplier stand for the labels of a page."""
    labels = read_table(spark, d, "lineitem").selectExpr(
        "l_suppkey as page", "((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 100 + cast(l_quantity as bigint) as label_id",
        "cast(l_partkey % 600 as double) as x", "cast(l_quantity * 7 as double) as y", "cast(10 as double) as width",
    )
    pages = read_table(spark, d, "supplier").selectExpr(
        "s_suppkey as page", "cast(0 as double) as page_left", "cast(612 as double) as page_right"
    )
    return L.horizontal_limits(labels, pages).select("page", "label_id", "left_bound", "right_bound")


@query(
    """
with labels as (
  select l_suppkey as page, ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 100 + cast(l_quantity as bigint) as label_id,
         cast(l_partkey % 600 as double) as center, cast(l_quantity * 16 as double) as y
  from lineitem),
regions as (
  select ps as page, o_orderkey as region_no, l as "left", l + w as "right", b - h as top, b as bottom
  from (select o_orderkey, o_custkey % 100 as ps, cast(o_orderkey * 7 % 550 as double) as l,
               cast(o_orderkey * 13 % 120 as double) as w, cast(o_orderkey * 11 % 790 as double) as b,
               cast(30 + o_orderkey % 90 as double) as h from orders)),
scored as (
  select l.page, l.label_id, l.y, r.region_no, r.bottom,
         abs(l.y - r.bottom) + greatest(r."left" - l.center, l.center - r."right", 0) as score
  from labels l join regions r on l.page = r.page
  where r."right" - r."left" >= 40 and r.bottom - r.top >= 40 and r.bottom <= l.y + 12
    and greatest(r."left" - l.center, l.center - r."right", 0) <= greatest(60, 1.5 * (r."right" - r."left"))),
best as (
  select page, label_id, any_value(y) as y, arg_min(region_no, {'s': score, 'n': region_no}) as region_no,
         arg_min(bottom, {'s': score, 'n': region_no}) as bottom
  from scored group by 1, 2)
select l.page, l.label_id, case when abs(b.y - b.bottom) <= 160 then b.region_no end as region_no
from labels l left join best b using (page, label_id)
"""
)
def label_regions(spark, d):
    """Nearest image region of each label; lines stand for labels, orders for regions."""
    labels = read_table(spark, d, "lineitem").selectExpr(
        "l_suppkey as page", "((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 100 + cast(l_quantity as bigint) as label_id",
        "cast(l_partkey % 600 as double) as center", "cast(l_quantity * 16 as double) as y",
    )
    regions = (
        read_table(spark, d, "orders")
        .selectExpr(
            "o_custkey % 100 as page", "o_orderkey as region_no", "cast(o_orderkey * 7 % 550 as double) as left",
            "cast(o_orderkey * 13 % 120 as double) as w", "cast(o_orderkey * 11 % 790 as double) as bottom",
            "cast(30 + o_orderkey % 90 as double) as h",
        )
        .selectExpr("page", "region_no", "left", "left + w as right", "bottom - h as top", "bottom")
    )
    return L.nearest_regions(labels, regions).select("page", "label_id", "region_no")


FOLDERS = """folders as (
  select 'root' as id, null as parent_id, 'Root' as name
  union all select 'r' || r_regionkey, case when r_name = 'ASIA' then 'elsewhere' else 'root' end, r_name from region
  union all select 'n' || n_nationkey, 'r' || n_regionkey, n_name from nation
  union all select 'c' || c_custkey, 'n' || c_nationkey, c_name from customer
  union all select 'o' || o_orderkey, 'c' || o_custkey, o_orderpriority from orders)"""


@query(
    f"""
with recursive {FOLDERS},
paths as (
  select id, cast('' as varchar) as path, name from folders where parent_id = 'root'
  union all
  select f.id, case when p.path = '' then p.name else p.path || '/' || p.name end, f.name
  from folders f join paths p on f.parent_id = p.id)
select f.id, p.path, p.id is not null as reached
from folders f left join paths p on p.id = f.id where f.id <> 'root'
"""
)
def folder_paths(spark, d):
    parts = [
        ("region", "concat('r', r_regionkey)", "case when r_name = 'ASIA' then 'elsewhere' else 'root' end", "r_name"),
        ("nation", "concat('n', n_nationkey)", "concat('r', n_regionkey)", "n_name"),
        ("customer", "concat('c', c_custkey)", "concat('n', c_nationkey)", "c_name"),
        ("orders", "concat('o', o_orderkey)", "concat('c', o_custkey)", "o_orderpriority"),
    ]
    frames = [
        read_table(spark, d, t).selectExpr(f"{i} as id", f"{p} as parent_id", f"{n} as name")
        for t, i, p, n in parts
    ]
    items = frames[0]
    for frame in frames[1:]:
        items = items.unionByName(frame)
    return H.folder_path(items, "root").select("id", "path", "reached")


@query(
    """
select doc_id, lang, source, row_number() over (partition by lang order by cast(substr(source, 4) as int), doc_id) as place
from documents
"""
)
def natural_order(spark, d):
    """Place of every document among those of its language, sources in natural order (src9 before src10)."""
    docs = read_table(spark, d, "documents").select("doc_id", "source", "lang")
    keyed = docs.withColumn("key", F.collate(N.natural_key(F.col("source")), "UNICODE_CI_AI"))
    placed = numbered(keyed, ["lang"], ["key", "doc_id"], [F.col("key"), *number_blocks("doc_id")], "place")
    return placed.select("doc_id", "lang", "source", "place")


@query(
    """
select event_id, event_type, row_number() over (partition by event_type order by ts desc, event_id desc) as place
from events
"""
)
def numbered_recent(spark, d):
    """Display numbers after sorting, newest first."""
    events = read_table(spark, d, "events").select("event_id", "event_type", "ts")
    placed = numbered(events, ["event_type"], ["ts", "event_id"], time_blocks("ts"), "place", reverse=True)
    return placed.select("event_id", "event_type", "place")


@query(
    r"""
select doc_id, case when regexp_matches(first_line, '^[A-LR]:') then '<term translate="no">' || left(first_line, 1) || '</term>: ' ||
         trim(substr(first_line, 3)) else first_line end as text
from (select doc_id, case when lang = 'en' then 'B: ' else '' end ||
             trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) as first_line from documents)
"""
)
def label_rules(spark, d):
    """A paragraph that starts with a letter label gets the letter marked."""
    text = F.expr("concat(case when lang = 'en' then 'B:   ' else '' end, text)")
    return read_table(spark, d, "documents").select("doc_id", T.mark_label(text).alias("text"))


@query(
    """
select l_orderkey as table_id, o_custkey as doc_id, l_linenumber as group_pos, l_partkey * 10000 + l_suppkey as row_pos,
       row_number() over (partition by o_custkey, l_orderkey order by l_linenumber, l_partkey * 10000 + l_suppkey) as row_no,
       first_value(l_returnflag) over (partition by o_custkey, l_orderkey order by l_linenumber, l_returnflag) as header
from lineitem join orders on o_orderkey = l_orderkey
"""
)
def merged_groups(spark, d):
    lines = read_table(spark, d, "lineitem").join(
        read_table(spark, d, "orders").select("o_orderkey", "o_custkey"),
        F.col("o_orderkey") == F.col("l_orderkey"),
    )
    # a group has one header: the least of its lines' flags
    header = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("header"))
    rows = lines.join(header, ["l_orderkey", "l_linenumber"]).selectExpr(
        "o_custkey as doc_id", "l_orderkey as table_id", "l_linenumber as group_pos",
        "l_partkey * 10000 + l_suppkey as row_pos", "header",
    )
    return M.merge_groups(rows).select("doc_id", "table_id", "group_pos", "row_pos", "row_no", "header")


@query()
def inline_spacing(spark, d):
    """Text and bold nodes of all pages with the spaces they need; tested on a small fixture."""
    spaced = M.space_inline(page_nodes(spark, d), "page_id")
    return spaced.where("space_before or space_after").select(
        "page_id", "node_id", "tag", "space_before", "space_after"
    )


@query()
def refined_labels(spark, d):
    """Marking rules for bold, control and paragraph labels of all pages; tested on a small fixture."""
    return M.refine_labels(page_nodes(spark, d), ["The", "and"], "page_id").select(
        "page_id", "node_id", "tag", "label", "rule"
    )


@query(
    """
with nodes as (select o_custkey as doc_id, o_orderkey as node_id,
                      case o_orderstatus when 'F' then 'concept' when 'O' then 'p' else 'task' end as tag,
                      case when o_orderpriority < '3' then o_orderpriority end as id from orders),
counted as (select *, count(*) filter (where tag <> 'p') over w as topics, count(id) over w as ids from nodes
            window w as (partition by doc_id order by node_id rows between unbounded preceding and 1 preceding))
select doc_id, node_id, case when tag <> 'p' then 't' || lpad(topics::varchar, 5, '0')
       when id is not null then 'e' || lpad(ids::varchar, 5, '0') end as nid
from counted
"""
)
def assigned_ids(spark, d):
    nodes = read_table(spark, d, "orders").selectExpr(
        "o_custkey as doc_id", "o_orderkey as node_id",
        "case o_orderstatus when 'F' then 'concept' when 'O' then 'p' else 'task' end as tag",
        "case when o_orderpriority < '3' then o_orderpriority end as id",
    )
    return O.assign_ids(nodes).select("doc_id", "node_id", "nid")


@query(
    """
select p_partkey, case when p_size < 10 then p_size when p_size < 20 then 1 when p_size < 30 then p_size
       else 2147483647 end as chapter
from part
"""
)
def chapter_numbers(spark, d):
    declared = F.expr("case when p_size < 10 then concat(' ', p_size) when p_size < 20 then 'x' end")
    file = F.expr(
        "case when p_size < 20 then 'foreword.XML' when p_size < 30 then concat(p_size, '_a.xml') else 'a.xml' end"
    )
    return read_table(spark, d, "part").select(
        "p_partkey", N.chapter_number(declared, file).alias("chapter")
    )


@query()
def node_terms(spark, d):
    """Marked text nodes of all pages; tested on a small fixture."""
    terms = spark.createDataFrame([("The",), ("la",), ("en",)], "term string")
    tagged = M.tag_node_terms(page_nodes(spark, d), terms, "page_id")
    return tagged.where(F.contains("text", F.lit("<term"))).select("page_id", "node_id", "text")
