"""Queries over contents lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import toc as O
from ..operators.ordered import numbered
from ..session import read_table, settle
from .catalog import query
from .roles import sql


def atlas(spark, d):
    """Contents of one map per market segment: nations, their customers, and the customers' orders.

    Orders in progress jump a level, which leaves gaps.
    """
    customer = read_table(spark, d, "customer")
    orders = read_table(spark, d, "orders")
    nations = customer.select("c_mktsegment", "c_nationkey").distinct().selectExpr(
        "c_mktsegment as map_id", "cast(c_nationkey as bigint) as k1", "-1L as k2", "-1L as k3",
        "1L as level", "concat('Nation ', cast(c_nationkey as string)) as title",
        "format_string('legal_%02d.dita', c_nationkey) as file_name", "'' as href",
    )
    people = customer.selectExpr(
        "c_mktsegment as map_id", "cast(c_nationkey as bigint) as k1", "c_custkey as k2", "-1L as k3",
        "2L as level", "c_name as title", "concat('legal_c', cast(c_custkey as string), '.dita') as file_name",
        "concat('topics/', cast(c_custkey as string), '.dita') as href",
    )
    papers = customer.join(orders, F.col("c_custkey") == F.col("o_custkey")).selectExpr(
        "c_mktsegment as map_id", "cast(c_nationkey as bigint) as k1", "c_custkey as k2", "o_orderkey as k3",
        "case o_orderstatus when 'P' then 5L when 'F' then 3L else 4L end as level",
        "case when o_orderpriority = '1-URGENT' then ' Checked   Group' else o_orderpriority end as title",
        "case o_orderstatus when 'F' then concat('t', cast(o_orderkey as string), '.dita')"
        " when 'O' then concat('legal_scr', cast(o_orderkey as string), '.dita') else 'x.dita' end as file_name",
        "case when o_orderstatus = 'F' then 'topics/x.dita' else '' end as href",
    )
    rows = nations.unionByName(people).unionByName(papers)
    placed = numbered(rows, ["map_id"], ["k1", "k2", "k3"], [F.col("k1"), F.expr("k2 div 1000")])
    return settle(placed.drop("k1", "k2", "k3"))


ATLAS = """atlas_rows as (
  select c_mktsegment as map_id, c_nationkey::bigint as k1, -1::bigint as k2, -1::bigint as k3, 1::bigint as level,
         'Nation ' || c_nationkey as title, 'legal_' || lpad(c_nationkey::varchar, 2, '0') || '.dita' as file_name,
         '' as href
  from (select distinct c_mktsegment, c_nationkey from customer)
  union all
  select c_mktsegment, c_nationkey, c_custkey, -1, 2, c_name, 'legal_c' || c_custkey || '.dita',
         'topics/' || c_custkey || '.dita' from customer
  union all
  select c_mktsegment, c_nationkey, c_custkey, o_orderkey,
         case o_orderstatus when 'P' then 5 when 'F' then 3 else 4 end,
         case when o_orderpriority = '1-URGENT' then ' Checked   Group' else o_orderpriority end,
         case o_orderstatus when 'F' then 't' || o_orderkey || '.dita'
              when 'O' then 'legal_scr' || o_orderkey || '.dita' else 'x.dita' end,
         case when o_orderstatus = 'F' then 'topics/x.dita' else '' end
  from customer join orders on o_custkey = c_custkey),
atlas as (select map_id, level, title, file_name, href,
                 row_number() over (partition by map_id order by k1, k2, k3) as row_no from atlas_rows),
deep as (select *, cast(row_no + least(0, min(level - row_no) over (partition by map_id order by row_no)) as bigint) as depth
         from atlas)"""

#: parent by a running maximum per depth, one column for each depth that occurs
PARENTS = """tree as (
  select *, case depth when 2 then p1 when 3 then p2 when 4 then p3 when 5 then p4 end as parent_no from (
    select *, max(case when depth = 1 then row_no end) over w as p1, max(case when depth = 2 then row_no end) over w as p2,
           max(case when depth = 3 then row_no end) over w as p3, max(case when depth = 4 then row_no end) over w as p4
    from deep window w as (partition by map_id order by row_no)))"""

ENDS = """ends as (
  select *, coalesce(case level when 1 then e1 when 2 then e2 when 3 then e3 when 4 then e4 else e5 end,
                     last_no + 1) as end_no from (
    select *, max(row_no) over (partition by map_id) as last_no,
           min(case when level <= 1 then row_no end) over w as e1, min(case when level <= 2 then row_no end) over w as e2,
           min(case when level <= 3 then row_no end) over w as e3, min(case when level <= 4 then row_no end) over w as e4,
           min(case when level <= 5 then row_no end) over w as e5
    from atlas
    window w as (partition by map_id order by row_no rows between 1 following and unbounded following)))"""


@query(sql(ATLAS, PARENTS, body="select map_id, row_no, level, depth, parent_no from tree"))
def tree_from_levels(spark, d):
    return O.tree_from_levels(atlas(spark, d)).select("map_id", "row_no", "level", "depth", "parent_no")


@query(sql(ATLAS, ENDS, body="select map_id, row_no, level, end_no from ends"))
def subtree_ends(spark, d):
    return O.subtree_end(atlas(spark, d)).select("map_id", "row_no", "level", "end_no")


TARGETS = """targets as (
  select map_id, row_no, file_name, title, depth as level_no,
         last_value(case when depth = 1 then file_name end ignore nulls) over w as parent_l1_file,
         last_value(case when depth = 2 then file_name end ignore nulls) over w as parent_l2_file
  from deep window w as (partition by map_id order by row_no rows unbounded preceding)
  qualify depth >= 3 and (regexp_matches(file_name, '^t\\d+\\.dita$')
          or (regexp_matches(file_name, '^legal_[\\w-]+\\.dita$') and not regexp_matches(file_name, '^legal_\\d{2}(_\\d{2})?\\.dita$'))))"""


@query(sql(ATLAS, TARGETS, body="select * from targets"))
def legal_targets(spark, d):
    return O.legal_targets(O.depths(atlas(spark, d)))


def topic_rows(spark, d):
    """All orders as topics of a manual, in key order; every segment's map gets its own."""
    orders = read_table(spark, d, "orders")
    # a customer's first order stands above the others
    first = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("first"))
    return (
        orders.join(read_table(spark, d, "customer").join(first, "c_custkey"), F.col("c_custkey") == F.col("o_custkey"))
        .selectExpr(
            "c_mktsegment as map_id", "o_orderkey as row_no", "cast(length(o_orderpriority) as bigint) as level",
            "o_orderpriority as title", "concat('t', cast(o_orderkey as string), '.DITA') as file_name",
            "o_custkey", "o_orderstatus", "c_nationkey",
            "case when o_orderkey <> first then first end as topic_parent",
        )
    )


def target_rows(spark, d):
    """Target table: urgent topics name a customer file, some name only a nation, some nothing known."""
    return topic_rows(spark, d).where("title in ('1-URGENT', '2-HIGH')").selectExpr(
        "lower(file_name) as file_name",
        "case when o_orderstatus = 'P' then 'none.dita' else format_string('legal_%02d.dita', c_nationkey) end as parent_l1_file",
        "case when o_orderstatus = 'F' then concat('legal_c', cast(o_custkey as string), '.dita') else '' end as parent_l2_file",
    )


def template_rows(spark, d):
    return atlas(spark, d).where("level <= 2")


PLACED = """topics as (
  select c_mktsegment as map_id, o_orderkey as row_no, length(o_orderpriority)::bigint as level,
         o_orderpriority as title, 't' || o_orderkey || '.DITA' as file_name,
         case when o_orderstatus = 'P' then 'none.dita' else 'legal_' || lpad(c_nationkey::varchar, 2, '0') || '.dita' end as l1,
         case when o_orderstatus = 'F' then 'legal_c' || o_custkey || '.dita' end as l2,
         (select min(f.o_orderkey) from orders f where f.o_custkey = orders.o_custkey) as first
  from orders join customer on c_custkey = o_custkey where o_orderpriority in ('1-URGENT', '2-HIGH')),
template as (
  select map_id, level, title, file_name, row_number() over (partition by map_id order by k1, k2, k3) as row_no
  from atlas_rows where level <= 2),
places as (select map_id, file_name, min(row_no) as row_no, arg_min(level, row_no) as level from template group by 1, 2),
placed as (
  select t.*, coalesce(b.row_no, a.row_no) as parent_no, coalesce(b.level, a.level) as parent_level,
         case when a.row_no is null and b.row_no is null then 'unclassified' end as group_name
  from topics t left join places a on a.map_id = t.map_id and a.file_name = t.l1
  left join places b on b.map_id = t.map_id and b.file_name = t.l2)"""


def dense_template(spark, d):
    rows = template_rows(spark, d).withColumnRenamed("row_no", "k")
    return settle(numbered(rows, ["map_id"], ["k"], [F.expr("k div 1048576")]).drop("k"))


@query(
    sql(ATLAS, PLACED, body="select map_id, row_no, file_name, parent_no, parent_level, group_name from placed")
)
def placed_targets(spark, d):
    placed = O.place_targets(topic_rows(spark, d), target_rows(spark, d), dense_template(spark, d))
    return placed.select("map_id", "row_no", "file_name", "parent_no", "parent_level", "group_name")


@query(
    sql(
        ATLAS, PLACED,
        body="""
, ends as (
  select map_id, row_no, coalesce(min(case when level <= 1 then row_no end) over w, last_no + 1) as e1,
         coalesce(min(row_no) over w, last_no + 1) as e2, level
  from (select *, max(row_no) over (partition by map_id) as last_no from template)
  window w as (partition by map_id order by row_no rows between 1 following and unbounded following)),
joined as (select p.*, case when e.level = 1 then e.e1 else e.e2 end as end_no
           from placed p left join ends e on e.map_id = p.map_id and e.row_no = p.parent_no),
tops as (
  select map_id, row_no as root,
         case when group_name is null then least(6, parent_level + 1) else greatest(2, least(6, level)) end as top_level,
         case when group_name is null then end_no * 2 - 1 else 4611686018427387904 end as key_position,
         case when group_name is null then -parent_no else 0 end as key_parent,
         case when group_name is null then row_no else -row_no end as key_top
  from joined),
chained as (select t.*, case when f.row_no is not null then t.first else t.row_no end as root,
                   case when f.row_no is not null then 1 else 0 end as hops
            from topics t left join topics f on f.row_no = t.first and t.row_no <> t.first)
select map_id, level, file_name, title, 'template' as source, row_no * 2 as key_position,
       0::bigint as key_parent, 0::bigint as key_top, 0::bigint as key_arrival from template
union all
select c.map_id, least(6, top_level + hops), file_name, title, 'manual', key_position, key_parent, key_top, c.row_no
from chained c join tops t on t.map_id = c.map_id and t.root = c.root
union all
select distinct map_id, 1::bigint, '', 'unclassified', 'group', 4611686018427387903, 0::bigint, 0::bigint, 0::bigint
from template
""",
    )
)
def legal_tree(spark, d):
    return O.build_legal_tree(topic_rows(spark, d), target_rows(spark, d), dense_template(spark, d))


@query(
    sql(
        ATLAS,
        body="""
, kept as (select *, row_number() over (partition by map_id order by row_no) as n from atlas
           where lower(regexp_replace(trim(title), '\\s+', ' ', 'g')) <> 'checked group')
select map_id, row_no as source_no, n as row_no,
       cast(n + least(0, min(level - n) over (partition by map_id order by n)) as bigint) as depth,
       case when href <> '' then href else file_name end as href, 'topicref' as kind
from kept
""",
    )
)
def export_tree(spark, d):
    tree = O.export_tree(atlas(spark, d), "checked group")
    return tree.select("map_id", "source_no", "row_no", "depth", "href", "kind")


@query(sql(ATLAS, PARENTS, body="select distinct map_id, parent_no from tree where parent_no is not null"))
def expected_parents(spark, d):
    return O.expected_parents(O.tree_from_levels(atlas(spark, d)))


@query(
    sql(
        ATLAS, PARENTS,
        body="""
, named as (select *, map_id || row_no as topic_id from tree)
select c.map_id, c.topic_id as source_id, 'parent' as role, p.topic_id || '.dita#' || p.topic_id as href,
       p.title as link_text, c.row_no as link_order
from named c join named p on p.map_id = c.map_id and p.row_no = c.parent_no
union all
select c.map_id, p.topic_id, 'child', c.topic_id || '.dita#' || c.topic_id, c.title, c.row_no
from named c join named p on p.map_id = c.map_id and p.row_no = c.parent_no where c.depth = 2
""",
    )
)
def related_links(spark, d):
    tree = O.tree_from_levels(atlas(spark, d))
    named = tree.withColumn("topic_id", F.concat("map_id", F.col("row_no").cast("string")))
    return O.related_links(named)


@query(
    sql(
        ATLAS, PARENTS,
        body="""
select c.map_id, c.row_no, c.href from tree c
left join tree p on p.map_id = c.map_id and p.row_no = c.parent_no
where p.href is null or c.href <> p.href
""",
    )
)
def split_topics(spark, d):
    return O.split_topics(O.tree_from_levels(atlas(spark, d))).select("map_id", "row_no", "href")


CHAPTERS = """numbered as (
  select map_id, row_no, file_name, row_number() over (partition by map_id order by row_no) as ordinal
  from atlas where level = 1)"""


@query(
    sql(
        ATLAS, CHAPTERS,
        body="""
select n.map_id, n.ordinal, lpad((ordinal - 1)::varchar, 2, '0') as chapter,
       case when ordinal = 1 then file_name else lpad((ordinal - 1)::varchar, 2, '0') || '_' || file_name end as chapter_file,
       n_name as list_name
from numbered n
left join (select distinct c_mktsegment, n_nationkey, n_name from customer join nation on n_nationkey = c_nationkey) l
  on l.n_nationkey = n.ordinal and l.c_mktsegment = n.map_id
""",
    )
)
def numbered_chapters(spark, d):
    chapters = atlas(spark, d).where("level = 1")
    present = read_table(spark, d, "customer").select("c_mktsegment", "c_nationkey").distinct()
    listed = present.join(read_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        "c_mktsegment as map_id", "cast(n_nationkey as bigint) as ordinal", "n_name as list_name"
    )
    placed = O.number_chapters(chapters, listed)
    return placed.select("map_id", "ordinal", "chapter", "chapter_file", "list_name")


@query(
    sql(
        ATLAS, CHAPTERS,
        body="""
select n.map_id, n.file_name, n_name as content, n.ordinal
from numbered n join nation on file_name = 'legal_' || lpad(n_nationkey::varchar, 2, '0') || '.dita'
""",
    )
)
def merged_chapters(spark, d):
    order = O.number_chapters(atlas(spark, d).where("level = 1"))
    segments = read_table(spark, d, "customer").selectExpr("c_mktsegment as map_id", "c_nationkey as n_nationkey")
    chapters = segments.distinct().join(read_table(spark, d, "nation"), "n_nationkey").selectExpr(
        "map_id", "format_string('legal_%02d.dita', n_nationkey) as file_name", "n_name as content"
    )
    return O.merge_chapters(chapters, order)


@query(
    sql(
        ATLAS,
        body="""
select map_id, row_no, coalesce(case when level = 5 then title end, case when level = 1 then title end,
       case when level = 4 then title end, f.topic_title, regexp_replace(file_name, '\\.dita$', '')) as shown_title
from atlas a left join (select 'legal_c' || c_custkey || '.dita' as file_name, c_name || ' file' as topic_title
                        from customer where c_acctbal > 0) f using (file_name)
""",
    )
)
def shown_titles(spark, d):
    rows = atlas(spark, d).selectExpr(
        "map_id", "row_no", "file_name", "case when level = 5 then title else ' ' end as navtitle_attr",
        "case when level = 1 then title end as title", "'' as navtitle",
        "case when level = 4 then title end as linktext",
    )
    topics = read_table(spark, d, "customer").where("c_acctbal > 0").selectExpr(
        "concat('legal_c', cast(c_custkey as string), '.dita') as file_name", "concat(c_name, ' file') as title"
    )
    return O.title_of(rows, topics).select("map_id", "row_no", "shown_title")


# -- diffs -----------------------------------------------------------------------------------


def two_lists(spark, d):
    """Each customer's manual: parts of even order lines against those of odd ones, and files on disk."""
    lines = read_table(spark, d, "lineitem").join(
        read_table(spark, d, "orders").select("o_orderkey", "o_custkey"),
        F.col("l_orderkey") == F.col("o_orderkey"),
    )
    rows = lines.selectExpr(
        "o_custkey as map_id",
        "l_orderkey * 1000000000 + l_suppkey * 100000 + (l_partkey % 10000) * 10 + l_linenumber as row_no",
        "case when l_returnflag = 'A' then '' else concat('P', cast(l_suppkey as string), '.dita') end as file_name",
        "concat('Title ', cast(l_suppkey as string)) as title",
        "l_linestatus",
    )
    master = rows.where("l_linestatus = 'F'").drop("l_linestatus")
    manual = rows.where("l_linestatus = 'O'").drop("l_linestatus")
    disk = lines.where("l_discount > 0.05").selectExpr(
        "o_custkey as map_id", "concat('p', cast(l_suppkey as string), '.DITA') as file_name"
    )
    return master, manual, disk


LISTS = """list_rows as (
  select o_custkey as map_id,
         l_orderkey * 1000000000 + l_suppkey * 100000 + (l_partkey % 10000) * 10 + l_linenumber as row_no,
         case when l_returnflag = 'A' then '' else 'p' || l_suppkey || '.dita' end as file_key, l_linestatus, l_discount,
         'p' || l_suppkey || '.dita' as disk_key
  from lineitem join orders on o_orderkey = l_orderkey)"""


@query(
    sql(
        LISTS,
        body="""
select 'master' as side, map_id, row_no,
       case when file_key <> '' and (map_id, file_key) in (select (map_id, file_key) from list_rows where l_linestatus = 'O') then 'moved'
            when file_key <> '' and (map_id, file_key) in (select (map_id, disk_key) from list_rows where l_discount > 0.05) then 'master-unlinked'
            else 'master-only' end as state
from list_rows where l_linestatus = 'F'
union all
select 'manual', map_id, row_no,
       case when file_key <> '' and (map_id, file_key) in (select (map_id, file_key) from list_rows where l_linestatus = 'F') then 'moved'
            else 'manual-only' end
from list_rows where l_linestatus = 'O'
""",
    )
)
def diff_states(spark, d):
    master, manual = O.diff_status(*two_lists(spark, d))
    return master.select(F.lit("master").alias("side"), "map_id", "row_no", "state").unionByName(
        manual.select(F.lit("manual").alias("side"), "map_id", "row_no", "state")
    )


#: lengths of the common subsequence row by row from the end, then the path from the beginning
MATCHED = """sides as (
  select l_linestatus as side, map_id, list(row_no order by row_no) as nos,
         list(case when file_key <> '' then 'file:' || file_key else 'title:title ' || l_suppkey end order by row_no) as keys
  from (select l.*, l_suppkey from list_rows l join (
          select l_orderkey * 1000000000 + l_suppkey * 100000 + (l_partkey % 10000) * 10 + l_linenumber as row_no, l_suppkey
          from lineitem) using (row_no))
  group by 1, 2),
pairs as (
  select a.map_id, a.nos as nos_a, a.keys as a, b.nos as nos_b, b.keys as b
  from sides a join sides b on a.map_id = b.map_id and a.side = 'F' and b.side = 'O'),
lengths as (
  select map_id, a, b, len(a) + 1 as i, list_transform(range(len(b) + 1), lambda x: 0) as lengths from pairs
  union all
  select map_id, a, b, i - 1, list_transform(range(1, len(b) + 2), lambda j: list_max(list_transform(range(j, len(b) + 2),
           lambda k: case when k <= len(b) and b[k] = a[i - 1] then lengths[k + 1] + 1 else lengths[k] end)))
  from lengths where i > 1),
paths as (
  select map_id, a, b, nos_a, nos_b, cast(1 as bigint) as i, cast(1 as bigint) as j from pairs
  union all
  select p.map_id, p.a, p.b, nos_a, nos_b,
         case when p.a[p.i] = p.b[j] or below.lengths[j] >= here.lengths[j + 1] then p.i + 1 else p.i end,
         case when p.a[p.i] = p.b[j] or below.lengths[j] < here.lengths[j + 1] then j + 1 else j end
  from paths p join lengths here on here.map_id = p.map_id and here.i = p.i
  join lengths below on below.map_id = p.map_id and below.i = p.i + 1
  where p.i <= len(p.a) and j <= len(p.b))"""


@query(
    "with recursive " + LISTS + ",\n" + MATCHED + """
select map_id, nos_a[i] as master_no, nos_b[j] as manual_no from paths where i <= len(a) and j <= len(b) and a[i] = b[j]
"""
)
def ordered_diff(spark, d):
    """Matched rows of both lists of every customer."""
    master, manual, _ = two_lists(spark, d)
    return O.lcs_diff(master, manual)
