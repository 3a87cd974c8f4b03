"""Queries over names, titles, geometry and other scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chapters as CH
from ..functions import geometry as G
from ..functions import names as N
from ..functions import text as T
from ..operators import upkeep as U
from ..session import read_table, spread
from .catalog import query

MODEL = "replace(p_brand, '#', '')"


@query(
    """
select p_partkey,
       case when p_type = 'STANDARD' then upper(replace(p_brand, '#', '')) || '_PE_ICE_27MY_EG_HTML'
            when p_type = 'PROMO' then upper(replace(p_brand, '#', '')) || '_ICE-HEV_26MY_US_HTML'
            when p_type = 'LARGE' then upper(replace(p_brand, '#', '')) || '_RED_PHEV_27MY_KO_HTML'
            when p_type = 'SMALL' then upper(replace(p_brand, '#', '')) || '_28MY_FR_HTML'
            when p_type = 'MEDIUM' then p_name || '_a_'
            else 'color-check' end as label
from part
"""
)
def vehicle_labels(spark, d):
    name = F.expr(
        f"""case
        when p_type = 'STANDARD' then concat('260317_ACME-', {MODEL}, '-PE-ICE-en_GB_2027-OM.xlsx')
        when p_type = 'PROMO' then concat('acme-', {MODEL}, '-ICE-HEV-en-US-2026-Full')
        when p_type = 'LARGE' then concat('x ACME-', {MODEL}, '_red_PHEV-ko_KR-2027-Full')
        when p_type = 'SMALL' then concat('ACME-', {MODEL}, '--fr_FR-2028-x_컬러체크.xls')
        when p_type = 'MEDIUM' then concat('260317_도안발주내역서_', p_name, '?a*')
        else ' ' end"""
    )
    parts = spread(read_table(spark, d, "part"), "p_partkey")
    return parts.select("p_partkey", N.vehicle_label(name, "ACME").alias("label"))


@query(
    """
select p_partkey,
       case p_type when 'STANDARD' then p_name when 'PROMO' then '시동 및 주행' when 'LARGE' then 'Hybrid vehicle guide'
                   when 'SMALL' then 'Overview' end as title,
       case p_type when 'STANDARD' then p_size || '.2' when 'PROMO' then cast(p_size as varchar)
                   when 'LARGE' then cast(p_size as varchar) when 'SMALL' then '2' end as number,
       case p_type when 'MEDIUM' then p_name when 'LARGE' then 'Hybrid vehicle guide' when 'STANDARD' then p_name
                   when 'PROMO' then '시동 및 주행' when 'SMALL' then 'Overview' end as outline_title
from part
"""
)
def chapter_titles(spark, d):
    line = F.expr(
        """case p_type
        when 'STANDARD' then concat(' chap. ', p_size, '.2 :  ', p_name)
        when 'PROMO' then concat('제 ', p_size, '장  시동  및 주행')
        when 'LARGE' then concat(p_size, '  hybrid system OVERVIEW')
        when 'SMALL' then 'overview '
        when 'MEDIUM' then concat(p_size, ' ', p_name)
        else p_name end"""
    )
    found, outline = CH.recognize_chapter(line), CH.recognize_chapter(line, outline=True)
    return read_table(spark, d, "part").select(
        "p_partkey",
        found["title"].alias("title"),
        found["number"].alias("number"),
        outline["title"].alias("outline_title"),
    )


@query(
    """
select p_partkey,
       case when p_size > 5 then 'ACME' end as platform, case when p_size > 5 then p_name end as model,
       case when p_size > 5 then 'PE-' || p_type end as base, case when p_size > 5 then p_type end as short_base,
       case when p_size > 5 then 'en_US' end as lang, case when p_size > 5 then cast(2000 + p_size as varchar) end as year
from part
"""
)
def title_metadata(spark, d):
    title = F.expr(
        "concat(case when p_size > 5 then 'ACME' else 'Other' end, '-', p_name, '-PE-', p_type, '-en_US-', 2000 + p_size)"
    )
    full = N.title_metadata(title, "acme")
    short = N.title_metadata(title, "acme", dropped=("PE",))
    return read_table(spark, d, "part").select(
        "p_partkey",
        full["platform"].alias("platform"),
        full["model"].alias("model"),
        full["base"].alias("base"),
        short["base"].alias("short_base"),
        full["lang"].alias("lang"),
        full["year"].alias("year"),
    )


@query(
    """
select doc_id, case lang when 'en' then 'm_fr_CA_' || source when 'de' then 'm-fr-CA-' || source else 'm-' || source end as name,
       case lang when 'en' then 'NA' else 'EU' end as region
from documents
"""
)
def locale_swaps(spark, d):
    name = F.expr(
        "concat(case lang when 'en' then 'm_en_US_' when 'de' then 'm-de-DE-' else 'm-' end, source)"
    )
    return read_table(spark, d, "documents").select(
        "doc_id", N.swap_locale(name, F.lit("fr-CA")).alias("name"), N.region(name, strict=True).alias("region")
    )


@query(
    r"""
select event_id, props as raw, regexp_replace(event_type || ' report', '[\\/:*?"<>|]', '_', 'g') as unused,
       '20260101_' || event_type || '_' || user_id || '_Comment.xlsx' as export_name,
       case event_type when 'click' then 'image/png' when 'view' then 'x/y' when 'error' then 'application/pdf'
            else 'application/octet-stream' end as content_type,
       event_type in ('click', 'view') as valid_name
from events
"""
)
def safe_names(spark, d):
    return read_table(spark, d, "events").select(
        "event_id",
        F.col("props").alias("raw"),
        F.expr("concat(event_type, ' report')").alias("unused"),
        N.safe_name(
            F.expr("concat(' ', event_type, ':', user_id, '.PDF')"), F.lit("20260101"), "xlsx"
        ).alias("export_name"),
        N.content_type(
            F.expr("case event_type when 'view' then 'x/y' else ' ' end"),
            F.expr("case event_type when 'click' then 'a.b.PNG' when 'error' then 'x.pdf' else 'noext' end"),
        ).alias("content_type"),
        N.valid_file_name(
            F.expr("case when event_type in ('click', 'view') then 'a-b_1.dita' else 'a b é.dita' end")
        ).alias("valid_name"),
    )


@query(
    """
select page_id, regexp_extract(regexp_replace(split_part(url, '#', 1), '/+$', ''), '[^/]*$') as file,
       regexp_extract(url, '^([^#]*/)?') || 'new.dita' || regexp_extract(url, '#.*$') as renamed
from pages where not regexp_matches(url, '/$')
union all
select page_id, regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$'), 'new.dita'
from pages where regexp_matches(url, '/$')
"""
)
def href_parts(spark, d):
    return read_table(spark, d, "pages").select(
        "page_id",
        N.href_file(F.col("url")).alias("file"),
        N.href_rename(F.col("url"), F.lit(" new.dita")).alias("renamed"),
    )


@query(
    """
select page_id, case when length(title) > 59 then substr(title, 1, 59) || '...' else title end as nav_title,
       case when contains(lower(title), 'en') then 'x' else 'y' end as kind
from (select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages)
"""
)
def nav_titles(spark, d):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return read_table(spark, d, "pages").select(
        "page_id",
        T.nav_title(title).alias("nav_title"),
        F.when(F.contains(F.lower(title), F.lit("en")), "x").otherwise("y").alias("kind"),
    )


@query(
    """
select p_partkey,
       case when p_size < 10 then 'opening_and_closing.xml' when p_size < 20 then 'Foreword.xml'
            when p_size < 30 then 'Safety.xml' when p_size < 40 then 'Spec.xml' end as file,
       case when p_size < 10 then 'hev.svg' when p_size < 20 then 'vehicle_controls.svg'
            when p_size < 30 then 'specifications_consumer_information.svg' end as tile,
       case when p_size < 10 then 'abbr' when p_size < 20 then 'appx' end as class_name
from part
"""
)
def chapter_files(spark, d):
    title = F.expr("case when p_size < 10 then ' Opening and  CLOSING' else p_name end")
    tile = F.expr(
        "case when p_size < 20 then null when p_size < 30 then './i/vehicle_safety_controls.svg'"
        " when p_size < 40 then 'x/specifications_consumer_information.svg' else 'none.svg' end"
    )
    file = F.expr(
        "case when p_size < 10 then '01_HEV_intro.xml' when p_size < 20 then '05_controls_and_Features.xml'"
        " when p_size < 30 then '09_Specifications.xml' else 'EV.xml' end"
    )
    plain = F.expr("case when p_size < 10 then 'Abbreviation' when p_size < 20 then 'Appendix' else p_name end")
    return read_table(spark, d, "part").select(
        "p_partkey",
        N.chapter_file(title, tile).alias("file"),
        N.tile_for(file).alias("tile"),
        N.class_for(plain).alias("class_name"),
    )


@query(
    r"""
select doc_id, trim(regexp_replace(replace(source || chr(160) || text, chr(160), ' '), '[ \t\r\n]+', ' ', 'g')) as cleaned,
       left(regexp_replace(text, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), 1000) as short
from documents
"""
)
def cell_cleanup(spark, d):
    return read_table(spark, d, "documents").select(
        "doc_id",
        T.clean_cell(F.concat("source", F.lit(" "), "text")).alias("cleaned"),
        T.short_text(F.col("text")).alias("short"),
    )


@query(
    """
select event_id, case event_type when 'click' then date_trunc('second', ts) when 'view' then date_trunc('minute', ts)
       when 'error' then date_trunc('second', ts) end as parsed,
       case when event_id < 1000 then event_id || 'ms' else printf('%.1fs', cast((event_id + 50) // 100 as double) / 10) end as elapsed
from events
"""
)
def lenient_times(spark, d):
    text = F.expr(
        """case event_type
        when 'click' then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
        when 'view' then concat(' ', date_format(ts, 'yyyy-MM-dd HH:mm'))
        when 'error' then date_format(ts, 'yyyy-MM-dd HH:mm:ss')
        else date_format(ts, 'dd.MM.yyyy') end"""
    )
    return read_table(spark, d, "events").select(
        "event_id",
        T.parse_reply_time(text).alias("parsed"),
        T.elapsed_label(F.col("event_id")).alias("elapsed"),
    )


BOXES = "3 * cast(embedding[{0}] as double) + 0.5"


@query(
    """
with boxes as (
  select vec_id, 3 * embedding[1]::double + 0.5 as x, 3 * embedding[2]::double + 0.5 as y,
         3 * embedding[3]::double as w, 3 * embedding[4]::double as h from embeddings),
clamped as (select *, greatest(0.0::double, least(1.0::double, x)) as l, greatest(0.0::double, least(1.0::double, y)) as t from boxes),
sized as (select *, least(greatest(w, 0.0::double), 1 - l) as rw, least(greatest(h, 0.0::double), 1 - t) as rh from clamped)
select vec_id, l as x, t as y, rw as w, rh as h from sized where rw > 0 and rh > 0
"""
)
def normalized_rects(spark, d):
    cols = [F.expr(BOXES.format(i)) for i in range(2)]
    cols += [F.expr(f"3 * cast(embedding[{i}] as double)") for i in (2, 3)]
    rects = read_table(spark, d, "embeddings").select("vec_id", G.normalize_rect(*cols).alias("r"))
    return rects.where("r is not null").select("vec_id", "r.x", "r.y", "r.w", "r.h")


@query(
    """
with boxes as (select vec_id, label, embedding[1]::double as x, embedding[2]::double as y,
                      embedding[3]::double as w, embedding[4]::double as h from embeddings),
rects as (select vec_id, label, greatest(0.0::double, least(1.0::double, x)) as l,
                 greatest(0.0::double, least(1.0::double, y)) as t, w, h from boxes)
select vec_id, case when label < 5 and least(greatest(w, 0), 1 - l) > 0 and least(greatest(h, 0), 1 - t) > 0 then 1 else 0 end as rect_count,
       case when label between 2 and 4 then 2 else 0 end as point_count,
       case when label between 2 and 4 then l end as first_x,
       case when label = 1 then 0.02::double else l end as anchor_x
from rects
"""
)
def annotation_geometry(spark, d):
    """Paths in both shapes, broken JSON included: labels 0 and 1 hold {"rects":..}, 2 to 4 a list,
    the others a truncated text."""
    path = F.expr(
        """case
        when label < 2 then concat('{"type":"text-highlight-rects","rects":[{"x":', x, ',"y":', y, ',"w":', w, ',"h":', h, '}]}')
        when label < 5 then concat('[{"x":', x, ',"y":', y, ',"w":', w, ',"h":', h, '},{"x":', y, ',"y":', x, '},{"x":1}]')
        else concat('[{"x":', x) end"""
    )
    boxes = read_table(spark, d, "embeddings").select(
        "vec_id", "label", *[F.expr(f"cast(embedding[{i}] as double)").alias(n) for i, n in enumerate("xywh")]
    )
    points = G.drawing_points(path)
    anchor = G.annotation_point(
        F.expr("case when label > 1 then x end"), F.col("y"), F.expr("case when label <> 1 then x end"), F.col("y")
    )
    return boxes.select(
        "vec_id",
        F.size(G.text_rects(path)).alias("rect_count"),
        F.size(points).alias("point_count"),
        F.get(points, F.lit(0))["x"].alias("first_x"),
        anchor["x"].alias("anchor_x"),
    )


# -- files -----------------------------------------------------------------------------------


@query(
    """
with files as (select p_type || '/' || p_brand as dir, p_name as file_name, p_type as root from part),
counts as (select root, dir, count(*) as n from files group by 1, 2)
select root, dir, n as file_count from (
  select *, row_number() over (partition by root order by n desc, dir desc) as rn from counts) where rn = 1
"""
)
def representative_dirs(spark, d):
    files = read_table(spark, d, "part").selectExpr(
        "p_type as root", "concat(p_type, '/', p_brand) as dir", "p_name as file_name"
    )
    return U.representative_dir(files, ["root"])


@query(
    """
with files as (select p_brand as root, case when p_size < 26 and p_brand < 'Brand#2' then 'a.XML'
                      when p_size > 40 and p_brand > 'Brand#15' then 'b.ditamap' else 'c.txt' end as file_name from part),
seen as (select root, bool_or(lower(file_name) like '%.xml') as x,
                bool_or(lower(file_name) like '%.dita' or lower(file_name) like '%.ditamap') as t from files group by 1)
select root, case when x and t then 'both' when x then 'xml' when t then 'dita' else 'none' end as format from seen
"""
)
def input_formats(spark, d):
    files = read_table(spark, d, "part").selectExpr(
        "p_brand as root",
        "case when p_size < 26 and p_brand < 'Brand#2' then 'a.XML'"
        " when p_size > 40 and p_brand > 'Brand#15' then 'b.ditamap' else 'c.txt' end as file_name",
    )
    return U.detect_format(files, ["root"])


@query(
    """
select p_type as dir, p_partkey, case when p_size < 4 then 'Foreword.xml' when p_size < 30 then
         lpad(p_size::varchar, 2, '0') || '_' || p_name || '.xml' else p_name || '.xml' end as file_name,
       row_number() over (partition by p_type order by case when p_size < 4 then 0 when p_size < 30 then 1 else 2 end,
         case when p_size between 4 and 29 then p_size else -1 end,
         case when p_size < 4 then 'foreword.xml' when p_size < 30 then lpad(p_size::varchar, 2, '0') || '_' || p_name
              else p_name end, p_partkey) as position
from part
"""
)
def chapter_order(spark, d):
    files = read_table(spark, d, "part").selectExpr(
        "p_type as dir", "p_partkey",
        "case when p_size < 4 then 'Foreword.xml' when p_size < 30 then"
        " concat(lpad(cast(p_size as string), 2, '0'), '_', p_name, '.xml') else concat(p_name, '.xml') end as file_name",
    )
    return U.order_chapters(files, "dir", tie="p_partkey").select("dir", "p_partkey", "file_name", "position")


@query(
    """
with files as (
  select p_type as dir, p_partkey, case when p_size < 4 then 'Foreword.xml' when p_size < 30 then
           lpad(p_size::varchar, 2, '0') || '_' || p_name || '.xml' when p_size < 45 then p_name || '.XML'
           else p_name || '.txt' end as file_name,
         case p_partkey % 3 when 0 then ' ' || p_partkey % 7 || ' ' when 1 then 'x' end as declared
  from part),
chapters as (
  select *, coalesce(try_cast(trim(declared) as integer),
           case when lower(file_name) = 'foreword.xml' then 1
                when regexp_matches(file_name, '^[0-9]{2}') then cast(left(file_name, 2) as integer)
                else 2147483647 end) as chapter
  from files where lower(file_name) like '%.xml')
select dir, p_partkey, file_name, chapter,
       row_number() over (partition by dir order by chapter, lower(file_name), p_partkey) as position
from chapters
"""
)
def declared_order(spark, d):
    files = read_table(spark, d, "part").selectExpr(
        "p_type as dir", "p_partkey",
        "case when p_size < 4 then 'Foreword.xml' when p_size < 30 then"
        " concat(lpad(cast(p_size as string), 2, '0'), '_', p_name, '.xml') when p_size < 45 then concat(p_name, '.XML')"
        " else concat(p_name, '.txt') end as file_name",
        "case p_partkey % 3 when 0 then concat(' ', p_partkey % 7, ' ') when 1 then 'x' end as declared",
    )
    placed = U.order_declared(files, "dir", tie="p_partkey")
    return placed.select("dir", "p_partkey", "file_name", "chapter", "position")


@query(
    """
with files as (
  select p_type as dir, p_partkey, case when p_size < 4 then 'Foreword.xml' when p_size < 30 then
           lpad(p_size::varchar, 2, '0') || '_' || p_name when p_size < 45 then p_name || '.XML'
           else p_name || '.txt' end as file_name
  from part)
select dir, p_partkey, file_name,
       row_number() over (partition by dir order by case when lower(file_name) = 'foreword.xml' then 0
           when regexp_matches(file_name, '^[0-9]{2}') then 1 else 2 end,
         case when regexp_matches(file_name, '^[0-9]{2}') then cast(left(file_name, 2) as integer) else -1 end,
         lower(file_name), p_partkey) as position
from files where lower(file_name) like '%.xml' or regexp_matches(file_name, '^[0-9]{2}')
"""
)
def chapter_list(spark, d):
    files = read_table(spark, d, "part").selectExpr(
        "p_type as dir", "p_partkey",
        "case when p_size < 4 then 'Foreword.xml' when p_size < 30 then"
        " concat(lpad(cast(p_size as string), 2, '0'), '_', p_name) when p_size < 45 then concat(p_name, '.XML')"
        " else concat(p_name, '.txt') end as file_name",
    )
    return U.bookmap(files, "dir", tie="p_partkey").select("dir", "p_partkey", "file_name", "position")


@query(
    """
select * from (
  select c_custkey, c_name, case when c_nationkey < 5 then 'folder' else 'pdf' end as type,
         case when c_nationkey = 7 and c_acctbal > 0 then 'target' || c_custkey else 'id' || c_custkey end as visible_id
  from customer where c_nationkey < 10 and not (c_nationkey = 8))
"""
)
def visible_items(spark, d):
    items = read_table(spark, d, "customer").selectExpr(
        "c_custkey", "c_name",
        "concat('id', cast(c_custkey as string)) as id",
        "case when c_nationkey < 5 then 'folder' when c_nationkey < 7 then 'pdf'"
        " when c_nationkey in (7, 8) then 'shortcut' when c_nationkey = 9 then 'pdf' else 'text' end as kind",
        "case when c_nationkey = 7 and c_acctbal > 0 then concat('target', cast(c_custkey as string)) end as target_id",
        "case when c_nationkey = 7 then 'pdf' when c_nationkey = 8 then 'text' end as target_kind",
    )
    shown = U.visible_items(items, name="c_name")
    return shown.select("c_custkey", "c_name", F.col("kind").alias("type"), "visible_id")
