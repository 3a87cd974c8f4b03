"""Queries comparing two versions of a specification table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import specdiff as S
from ..operators import upkeep as U
from ..operators.ordered import number_blocks, numbered
from ..session import read_table
from ..sources import sheets
from .catalog import query
from .roles import sql


def spec_rows(spark, d):
    """Sheet rows with continuation lines: a blank item belongs to the item above."""
    return read_table(spark, d, "part").selectExpr(
        "p_type as sheet",
        "p_partkey as row_no",
        "case when p_size > 30 then ' ' else concat(p_name, ' ', p_brand) end as item",
        "p_name as description",
        "array(cast(p_size as string), case when p_size > 40 then '# ' else ' O  x' end, replace(p_brand, '#', '-')) as cells",
    )


SPEC_ROWS = """spec_rows as (
  select p_type as sheet, p_partkey as row_no,
         case when p_size > 30 then ' ' else p_name || ' ' || p_brand end as raw_item, p_name as description,
         cast(p_size as varchar) as c1, case when p_size > 40 then '#' else 'O x' end as c2, replace(p_brand, '#', '-') as c3
  from part),
filled as (
  select *, coalesce(last_value(nullif(trim(raw_item), '') ignore nulls)
                     over (partition by sheet order by row_no rows unbounded preceding), '') as item
  from spec_rows)"""


@query(
    sql(
        SPEC_ROWS,
        body="""
select sheet, item, min(row_no) as row_no, arg_min(description, row_no) as description,
       cast(3 as bigint) as column_count, count(*) as source_rows, bool_or(c2 = '#') as highlighted
from filled group by 1, 2
""",
    )
)
def collapsed_items(spark, d):
    return S.collapse_rows(spec_rows(spark, d), "sheet")[0]


@query(
    sql(
        SPEC_ROWS,
        body="""
, long as (select sheet, item, row_no, unnest([1, 2, 3]) as col_no, unnest([c1, c2, c3]) as value from filled)
, placed as (select *, (row_number() over (partition by sheet, item, col_no order by row_no) - 1) // 1000 as line_no from long)
select sheet, item, cast(col_no as bigint) as col_no, cast(line_no as bigint) as line_no,
       string_agg(value, ' ' order by row_no) as value
from placed group by all
""",
    )
)
def collapsed_cells(spark, d):
    return S.collapse_rows(spec_rows(spark, d), "sheet")[1]


@query(
    sql(
        SPEC_ROWS,
        body="""
, items as (select sheet, item from filled group by 1, 2),
authors as (select p_name || ' ' || p_brand as item, count(*) as editor_count from part where p_size > 25 group by 1),
important as (select distinct p_name || ' ' || p_brand as item from part where p_retailprice > 1000)
select i.sheet, i.item, coalesce(editor_count, 0) as editor_count, case when m.item is null then '' else 'V' end as important
from items i left join authors a using (item) left join important m using (item)
""",
    )
)
def item_lookups(spark, d):
    items = S.collapse_rows(spec_rows(spark, d), "sheet")[0].select("sheet", "item")
    important = (
        read_table(spark, d, "part").where("p_retailprice > 1000").selectExpr("concat(p_name, '  ', p_brand) as item")
    )
    return S.with_lookups(items, item_authors(spark, d), important)


def item_authors(spark, d):
    return read_table(spark, d, "part").where("p_size > 25").selectExpr(
        "concat(p_name, ' ', p_brand) as item_no", "p_type as name", "p_partkey as pos"
    )


@query(
    """
select p_name || ' ' || p_brand as item, p_type as name,
       row_number() over (partition by p_name || ' ' || p_brand order by p_partkey) as position
from part where p_size > 25
"""
)
def item_editors(spark, d):
    return S.item_editors(item_authors(spark, d))


def version_rows(spark, d):
    """Two versions: sale prices of the parts today, and an older list without the cheap ones."""
    part = read_table(spark, d, "part")
    after = part.where("p_size < 45").selectExpr(
        "p_type as sheet", "p_partkey as row_no", "concat(p_name, ' ', p_brand) as item",
        "p_name as description", "cast(p_size as string) as k1", "p_brand as k2", "p_type as k3",
    )
    before = part.where("p_size > 5").selectExpr(
        "p_type as sheet",
        "p_size * 10000000L + p_partkey as row_no",
        "concat(p_name, ' ', p_brand) as item",
        "upper(p_name) as description",
        "cast(case when p_size > 30 then p_size + 1 else p_size end as string) as k1",
        "p_brand as k2",
    )
    return after, before


VERSIONS = """after_rows as (
  select p_type as sheet, p_partkey as row_no, p_name || ' ' || p_brand as item, p_name as description,
         cast(p_size as varchar) as k1, p_brand as k2, p_type as k3 from part where p_size < 45),
before_rows as (
  select p_type as sheet, p_size * 10000000 + p_partkey as row_no, p_name || ' ' || p_brand as item,
         upper(p_name) as description,
         cast(case when p_size > 30 then p_size + 1 else p_size end as varchar) as k1, p_brand as k2
  from part where p_size > 5),
after_first as (
  select sheet, item, min(row_no) as after_pos, arg_min(description, row_no) as after_description,
         arg_min(k1, row_no) as k1, arg_min(k2, row_no) as k2, arg_min(k3, row_no) as k3,
         count(*) as after_count from after_rows group by 1, 2),
before_first as (
  select sheet, item, min(row_no) as before_pos, arg_min(description, row_no) as before_description,
         arg_min(k1, row_no) as k1, arg_min(k2, row_no) as k2, count(*) as before_count
  from before_rows group by 1, 2)"""


@query(
    sql(
        VERSIONS,
        body="""
, common as (select sheet, item, row_number() over (partition by sheet order by after_pos) <>
                    row_number() over (partition by sheet order by before_pos) as moved
             from after_first join before_first using (sheet, item))
select sheet, item, after_pos, after_description, coalesce(after_count, 0) as after_count, before_pos,
       before_description, coalesce(before_count, 0) as before_count, coalesce(moved, false) as moved
from after_first full outer join before_first using (sheet, item) left join common using (sheet, item)
""",
    )
)
def merged_versions(spark, d):
    return S.merge_versions(*version_rows(spark, d), "sheet")


KEYS = ["sheet", "item"]


def first_rows(df):
    from ..operators.ordered import first_per

    return first_per(df, KEYS, ["row_no"])


def long_cells(df, columns):
    return df.unpivot(["sheet", "item", "row_no"], columns, "column", "value")


def version_cells(spark, d):
    after, before = version_rows(spark, d)
    after, before = first_rows(after), first_rows(before)
    return (
        after,
        before,
        S.diff_cells(long_cells(after, ["k1", "k2", "k3"]), long_cells(before, ["k1", "k2"]), KEYS),
    )


@query(
    sql(
        VERSIONS,
        body="""
select a.sheet, a.item, 'k1' as "column", a.k1 as after_value, b.k1 as before_value, a.k1 <> b.k1 as changed
from after_first a join before_first b using (sheet, item)
union all
select a.sheet, a.item, 'k2', a.k2, b.k2, a.k2 <> b.k2 from after_first a join before_first b using (sheet, item)
""",
    )
)
def cell_diff(spark, d):
    return version_cells(spark, d)[2]


@query(
    sql(
        VERSIONS,
        body="""
select sheet, item, case when after_pos is null then 'deleted' when before_pos is null then 'new'
       when a.k1 <> b.k1 or a.k2 <> b.k2 then 'changed' else '' end as state
from after_first a full outer join before_first b using (sheet, item)
""",
    )
)
def row_states(spark, d):
    after, before, cells = version_cells(spark, d)
    return S.diff_rows(after, before, cells, KEYS)


def blank_version(spark, d, threshold):
    """Sheet rows in which the value column is blank for parts above a price, so items differ by a blank only."""
    return read_table(spark, d, "part").selectExpr(
        "p_type as sheet", "p_partkey as row_no",
        "case when p_size > 30 then ' ' else concat(p_name, ' ', p_brand) end as item", "p_name as description",
        f"array(p_brand, case when p_retailprice > {threshold} then ' ' else cast(p_size as string) end) as cells",
    )


def blank_versions_sql():
    """Both versions, collapsed to one value per item and column."""
    item = "case when p_size > 30 then '' else p_name || ' ' || p_brand end"
    out = []
    for name, threshold in (("after", 1200), ("before", 1500)):
        value = f"case when p_retailprice > {threshold} then null else cast(p_size as varchar) end"
        out.append(
            f"""{name}_raw as (select p_type as sheet, p_partkey as row_no, p_brand as c1, {value} as c2, {item} as raw_item
  from part),
{name}_items as (select *, coalesce(last_value(nullif(raw_item, '') ignore nulls) over
  (partition by sheet order by row_no rows unbounded preceding), '') as item from {name}_raw),
{name}_cells as (select sheet, item, string_agg(c1, ' ' order by row_no) as c1,
  coalesce(string_agg(c2, ' ' order by row_no), '') as c2 from {name}_items group by 1, 2)"""
        )
    return ", ".join(out)


@query(
    sql(
        blank_versions_sql(),
        body="""
select sheet, item, case when a.c1 <> b.c1 or a.c2 <> b.c2 then 'changed' else '' end as state
from after_cells a join before_cells b using (sheet, item)
""",
    )
)
def collapsed_row_states(spark, d):
    """States of collapsed items, blank cells included."""
    sides = [
        S.collapse_rows(blank_version(spark, d, threshold), "sheet")[1].withColumnRenamed("col_no", "column")
        for threshold in (1200, 1500)
    ]
    return S.diff_rows(*sides, S.diff_cells(*sides, KEYS), KEYS)


@query(
    sql(
        VERSIONS,
        body="""
select sheet, item, a.after_pos as after_row_no, a.k1 as after_k1, a.k3 as after_k3,
       b.before_pos as before_row_no, b.k1 as before_k1
from after_first a full outer join before_first b using (sheet, item)
""",
    )
)
def side_by_side(spark, d):
    after, before = (first_rows(df) for df in version_rows(spark, d))
    return S.side_by_side(
        after.select("sheet", "item", "row_no", "k1", "k3"),
        before.select("sheet", "item", "row_no", "k1"),
        KEYS,
    )


HEADERS = """after_headers as (select p_type as sheet, p_brand || ' ' || p_size as name, min(p_partkey) as pos from part
                               where p_size < 30 group by 1, 2),
before_headers as (select p_type as sheet, p_brand || ' ' || p_size as name, min(p_partkey) as pos from part
                   where p_size >= 20 group by 1, 2)"""


def headers(spark, d):
    """Headers of two versions that overlap; every part is in one of them."""
    part = read_table(spark, d, "part").selectExpr(
        "p_type as sheet", "concat(p_brand, ' ', p_size) as name", "p_partkey", "p_size"
    )
    keyed = [part.where("p_size < 30"), part.where("p_size >= 20")]
    return [df.groupBy("sheet", "name").agg(F.min("p_partkey").alias("pos")) for df in keyed]


@query(
    sql(
        HEADERS,
        body="""
select sheet, name, pos from after_headers where (sheet, name) not in (select (sheet, name) from before_headers)
""",
    )
)
def new_columns(spark, d):
    return U.new_columns(*headers(spark, d), ["sheet"])


@query(
    sql(
        HEADERS,
        body="""
select sheet, name, a.pos as after_pos, b.pos as before_pos
from after_headers a join before_headers b using (sheet, name)
""",
    )
)
def common_columns(spark, d):
    return U.common_columns(*headers(spark, d), ["sheet"])


@query(
    """
with rows as (select p_type as sheet, row_number() over (partition by p_type order by p_partkey) - 1 as row_no,
                     p_partkey, cast(p_size as varchar) as value from part)
select sheet, row_no, p_partkey, 'k3' as "column", value,
       case when row_no = 0 then 'First' when row_no = max(row_no) over (partition by sheet) then 'Last'
            else 'Middle' end as row_class
from rows
"""
)
def new_column_marks(spark, d):
    rows = numbered(
        read_table(spark, d, "part").selectExpr(
            "p_type as sheet", "p_partkey", "p_brand as k2", "cast(p_size as string) as k3"
        ),
        ["sheet"], ["p_partkey"], number_blocks("p_partkey"), out="row_no", start=0,
    )
    cells = rows.unpivot(["sheet", "row_no", "p_partkey"], ["k2", "k3"], "column", "value")
    fresh = rows.select("sheet", F.lit("k3").alias("column"))
    return S.mark_new_columns(cells, fresh, "sheet")


@query(
    """
select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag = 'R' as red, l_linestatus = 'F' as yellow,
       nullif((case when l_linenumber < 3 then 'LeftText' else '' end) ||
              (case when l_returnflag = 'R' then 'Red' else '' end) ||
              (case when l_linestatus = 'F' then 'BgYellow' else '' end), '') as style
from lineitem
"""
)
def style_flags(spark, d):
    cells = read_table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "case l_returnflag when 'R' then '#FF0000' when 'A' then '#000000' end as font_color",
        "case l_linestatus when 'F' then '#FFFF66' else '#FFFEFF' end as fill_color",
    )
    flagged = S.style_flags(cells)
    style = S.style_name(F.col("l_linenumber") < 3, F.col("red"), F.col("yellow"))
    return flagged.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "red", "yellow", style.alias("style")
    )


@query(
    r"""
select doc_id, lang as item, regexp_extract(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')), '^[^ ]*') as value
from documents
"""
)
def first_tokens(spark, d):
    cells = read_table(spark, d, "documents").selectExpr("doc_id", "lang as item", "text as value")
    return S.first_tokens(cells)


def spec_grid(spark, d):
    """The parts as raw sheets, one per type, with a titled band over the value columns.

    Types with long names carry the band on row 5, the others on row 3; the header text sits below.
    """
    part = read_table(spark, d, "part").selectExpr(
        "p_type as file", "case when length(p_type) > 5 then 5 else 3 end as band_row", "p_partkey",
        "p_name", "p_brand", "p_size", "p_retailprice",
    )
    placed = numbered(part, ["file"], ["p_partkey"], number_blocks("p_partkey"), out="n")
    data = placed.selectExpr(
        "file",
        "cast(band_row + 1 + n as bigint) as row_no",
        "stack(5, 1, p_name, 3, p_brand, 8, cast(p_size as string), 9, p_brand, 10, cast(p_partkey as string))"
        " as (col_no, value)",
    )
    files = part.select("file", "band_row").distinct()
    top = files.selectExpr(
        "file", "band_row",
        "stack(4, 0L, 8, '사양군 목록', 1L, 8, 'K1 ', 1L, 9, ' ', 1L, 10, 'K3') as (below, col_no, value)",
    ).selectExpr("file", "band_row + below as row_no", "col_no", "value")
    bands = files.selectExpr(
        "file", "cast(band_row as int) as row_no", "8 as col_no", "1 as row_count", "3 as col_count"
    )
    return data.unionByName(top.select("file", "row_no", "col_no", "value")), bands


@query(
    """
select p_type as file, case when length(p_type) > 5 then 6 else 4 end as header_row,
       unnest([8, 10]) as col_no, unnest(['K1', 'K3']) as name, unnest([1, 2]) as pos
from (select distinct p_type from part)
"""
)
def spec_columns(spark, d):
    return sheets.select_spec_columns(*spec_grid(spark, d))


@query(
    """
select p_type as file,
       case when length(p_type) > 5 then 6 else 4 end + row_number() over (partition by p_type order by p_partkey) as row_no,
       p_name as item, p_brand as description, p_partkey || '|' || p_size as cells
from part
"""
)
def spec_sheet_rows(spark, d):
    """Only the asked columns, in the asked order."""
    cells, bands = spec_grid(spark, d)
    rows = sheets.spec_rows(cells, sheets.select_spec_columns(cells, bands, keys=["k3", "K1"]))
    return rows.withColumn("cells", F.array_join("cells", "|"))
