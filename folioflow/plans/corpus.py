"""Queries over sentences, dictionaries, images, titles and cross references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..operators import corpus as C
from ..operators.ordered import number_blocks
from ..session import read_table, read_texts, settle
from .catalog import query
from .roles import sql


def _sql_chain(column: str) -> str:
    out = f"trim(regexp_replace({column}, '[ \\t\\r\\n]+', ' ', 'g'))"
    for pattern, replacement in T.NORMAL_FORM:
        pattern, replacement = (x.replace("'", "''") for x in (pattern, replacement))
        replacement = replacement.replace("$", "\\")
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return out


TITLE = "case lang when 'en' then 'en_US' when 'fr' then 'fr-CA' else lang end"


def sents(spark, d):
    docs = read_texts(spark, d, "documents", "doc_id", "lang", "source", "text").selectExpr(
        "doc_id", "lang", f"concat(source, '-', {TITLE}) as map_title", "text"
    )
    return C.sentences(docs, "doc_id", "text").select(
        "*", F.lit(None).cast("string").alias("class_tokens"), F.lit(None).cast("string").alias("status")
    )


LINES = f"""lines as (
  select doc_id, lang, map_title, unnest(l) as raw, generate_subscripts(l, 1) - 1 as pos
  from (select doc_id, lang, source || '-' || {TITLE} as map_title, string_split(text, chr(10)) as l
        from documents)),
normal as (select *, {_sql_chain('raw')} as text from lines),
hashed as (
  select *, upper(sha256(regexp_replace(text, '(\\p{{Nd}}+\\s*)–(\\s*\\p{{Nd}}+)', '\\1 ~ \\2', 'g'))) as hash,
         case when contains(upper(map_title), 'US') or contains(upper(map_title), 'CA')
                or contains(upper(map_title), 'MX') then 'NA' else 'EU' end as region
  from normal),
pairs as (select region, hash, 'NEW ' || max(text) as "new" from hashed group by 1, 2 having count(*) > 1),
listed as (select hash from hashed group by 1 having count(*) > 3),
replaced as (
  select h.doc_id, h.pos, h.map_title, h.region, h.hash,
         case when l.hash is not null then 'exclude' end as class_tokens,
         case when l.hash is null and p."new" is not null then p."new" else h.text end as text,
         case when l.hash is null and p."new" is not null then 'changed' end as status
  from hashed h left join listed l using (hash) left join pairs p on p.region = h.region and p.hash = h.hash)"""


@query(sql(LINES, body="select doc_id, pos, text, hash from hashed"))
def sentence_hashes(spark, d):
    return C.hashed(sents(spark, d)).select("doc_id", "pos", "text", "hash")


def replaced(spark, d):
    """Normalise, hash, flag exclusions, then replace, in this order."""
    clean = settle(C.hashed(sents(spark, d)))
    keyed = clean.withColumn("region", N.region(F.col("map_title")))
    pairs = (
        keyed.groupBy("region", "hash")
        .agg(F.count(F.lit(1)).alias("n"), F.concat(F.lit("NEW "), F.max("text")).alias("new"))
        .where("n > 1")
        # an older replacement of the same pair, which must lose
        .selectExpr("region", "hash", "stack(2, 'old', 1, new, 2) as (new, pos)")
    )
    listed = clean.groupBy("hash").count().where("count > 3").select("hash")
    return C.apply_replacements(C.flag_excluded(clean, listed), pairs)


@query(sql(LINES, body="select doc_id, pos, region, hash, class_tokens, text, status from replaced"))
def replaced_sentences(spark, d):
    return replaced(spark, d).select(
        "doc_id", "pos", "region", "hash", "class_tokens", "text", "status"
    )


@query(
    sql(
        LINES,
        body="""
select map_title, count(*) as target_count, count(*) filter (where coalesce(status, '') = 'changed') as changed_count,
       count(*) - count(*) filter (where coalesce(status, '') = 'changed') as unchanged_count,
       round(count(*) filter (where coalesce(status, '') = 'changed') * 100.0 / count(*), 2) as ratio
from replaced where contains(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')), 'en') group by 1
""",
    )
)
def change_report(spark, d):
    return C.change_report(replaced(spark, d), "en", ["map_title"])


@query(
    sql(
        LINES,
        body="""
select map_title, doc_id, pos, text, row_number() over (partition by map_title order by doc_id, pos) as list_no
from replaced where contains(text, 'the') and status is null and class_tokens is null
""",
    )
)
def unchanged_sentences(spark, d):
    listed = C.unchanged_sentences(
        replaced(spark, d).drop("lang", "region", "hash"),
        "the",
        ["map_title"],
        ["doc_id", "pos"],
        [*number_blocks("doc_id"), F.col("doc_id")],
    )
    return listed.select("map_title", "doc_id", "pos", "text", "list_no")


@query(sql(LINES, body="select doc_id, pos, text from replaced where class_tokens is not null"))
def excluded_sentences(spark, d):
    return C.excluded_sentences(replaced(spark, d)).select("doc_id", "pos", "text")


# -- translation -----------------------------------------------------------------------------


def wide_sheet(spark, d):
    """Every document text as a source sentence with three languages."""
    return read_texts(spark, d, "documents", "doc_id", "text", "lang", "source", "n_chars").selectExpr(
        "doc_id as row_no", "text as En", "concat('FR ', lang, ' ', n_chars) as fr", "concat(' DE  ', source) as de"
    )


SQUEEZE = "trim(regexp_replace({0}, '[ \\t\\r\\n]+', ' ', 'g'))"
HASH = "upper(sha256(regexp_replace({0}, '(\\p{{Nd}}+\\s*)–(\\s*\\p{{Nd}}+)', '\\1 ~ \\2', 'g')))"

WIDE = f"""keyed as (
  select doc_id as entry_no, {HASH.format(SQUEEZE.format('text'))} as hash, {SQUEEZE.format('text')} as en,
         'FR ' || lang || ' ' || n_chars as fr, 'DE ' || source as de from documents),
terms as (
  select hash, entry_no, 'EN' as lang, en as term, 0 as pos from keyed
  union all select hash, entry_no, 'FR', fr, 1 from keyed
  union all select hash, entry_no, 'DE', de, 2 from keyed)"""


@query(sql(WIDE, body="select * from terms"))
def dictionary_build(spark, d):
    return C.build_dictionary(wide_sheet(spark, d), "row_no", ["En", "fr", "de"])


@query(sql(WIDE, body="select hash, lang, arg_min(term, entry_no) as term from terms group by 1, 2"))
def dictionary_dedupe(spark, d):
    terms = C.build_dictionary(wide_sheet(spark, d), "row_no", ["En", "fr", "de"])
    return C.dedupe_terms(terms).select("hash", "lang", "term")


@query(
    sql(
        WIDE,
        body="""
, have as (select hash, lang, arg_min(term, entry_no) as term from terms t
           where lang <> 'DE' and entry_no in (select doc_id from documents where lang = 'en') group by 1, 2),
news as (select hash, lang, term || ' new' as term, entry_no from terms),
fresh as (select n.* from news n
          where hash in (select hash from have)
             or entry_no = (select min(entry_no) from news m where m.hash = n.hash))
select hash, lang, term from have
union all
select hash, lang, arg_min(term, entry_no) from fresh f
where not exists (select 1 from have h where h.hash = f.hash and h.lang = f.lang) group by 1, 2
""",
    )
)
def dictionary_merge(spark, d):
    terms = settle(C.build_dictionary(wide_sheet(spark, d), "row_no", ["En", "fr", "de"]))
    english = read_table(spark, d, "documents").where("lang = 'en'").selectExpr("doc_id as entry_no")
    current = terms.where("lang <> 'DE'").join(english, "entry_no", "left_semi")
    update = terms.withColumns(
        {"lang": F.concat(F.lower("lang"), F.lit(" ")), "term": F.concat("term", F.lit(" new"))}
    )
    merged = C.merge_dictionary(current, update)
    return merged.select("hash", C.lang_key(F.col("lang")).alias("lang"), "term")


@query(
    sql(
        WIDE,
        body="""
, best as (select hash, lang, arg_min(term, entry_no) as term from terms
           where lang = 'FR' and entry_no in (select doc_id from documents where lang = 'en') group by 1, 2)
select k.entry_no as doc_id, k.hash, coalesce(b.term, d.text) as text, b.term is not null as translated
from keyed k join documents d on d.doc_id = k.entry_no left join best b using (hash)
""",
    )
)
def translated_texts(spark, d):
    terms = C.build_dictionary(wide_sheet(spark, d), "row_no", ["En", "fr", "de"])
    english = read_table(spark, d, "documents").where("lang = 'en'").selectExpr("doc_id as entry_no")
    docs = read_table(spark, d, "documents").select("doc_id", "lang", "text")
    translated = C.translate(docs, terms.join(english, "entry_no", "left_semi"), " fr")
    return translated.select("doc_id", "hash", "text", "translated")




@query(
    """
select doc_id, case lang when 'en' then 'English' when 'fr' then 'French' when 'de' then 'German' else lang end as language
from documents
"""
)
def language_names(spark, d):
    mapping = read_table(spark, d, "documents").select("lang").distinct().selectExpr(
        "upper(lang) as code",
        "case lang when 'en' then 'English' when 'fr' then 'French' when 'de' then 'German' else lang end as name",
    )
    docs = read_table(spark, d, "documents").select("doc_id", "lang")
    return C.map_language(docs, "lang", mapping).select("doc_id", "language")


# -- terms and tokens ------------------------------------------------------------------------

TERMS = ["en", "on the", "the", "en der", "lich.", "of (the)", "la"]


@query(
    r"""
select doc_id, regexp_replace(text,
  '(^|\s+|\p{Ps})(of \(the\)|on the|en der|lich\.|the|en|la)(\s+|\p{P}|\p{Pe}|$)',
  '\1<term translate="no">\2</term>\3', 'g') as text
from documents
"""
)
def term_tags(spark, d):
    docs = read_texts(spark, d, "documents", "doc_id", "text")
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    hit = C.with_term_pattern(docs, "text", terms, ["doc_id"])
    return hit.select("doc_id", C.tag_terms(F.col("text"), F.col("_pattern")).alias("text"))


@query(
    r"""
with terms as (
  select distinct regexp_extract(text, '[a-z]+ [a-z]+') as term from benchmark
  union select distinct regexp_extract(text, '[A-Z][a-z]+') from benchmark),
pattern as (
  select '(^|\s+|\p{Ps})(' || string_agg(term, '|' order by length(term) desc, term) || ')(\s+|\p{P}|\p{Pe}|$)' as p
  from terms where term <> '')
select doc_id, regexp_replace(text, p, '\1<term translate="no">\2</term>\3', 'g') as text
from documents, pattern
"""
)
def dictionary_terms(spark, d):
    """Terms of a dictionary of any size, here the first two words and the first name of every benchmark item."""
    docs = read_texts(spark, d, "documents", "doc_id", "text")
    items = read_table(spark, d, "benchmark")
    terms = items.select(F.explode(F.array(
        F.regexp_extract("text", "[a-z]+ [a-z]+", 0), F.regexp_extract("text", "[A-Z][a-z]+", 0)
    )).alias("term"))
    hit = C.with_term_pattern(docs, "text", terms, ["doc_id"])
    return hit.select("doc_id", C.tag_terms(F.col("text"), F.col("_pattern")).alias("text"))


@query(
    r"""
select l_orderkey, l_partkey, l_suppkey,
       case l_returnflag when 'A' then 'body' when 'R' then null else 'note wide' end as kept,
       trim(coalesce(case l_returnflag when 'A' then 'review  body' when 'R' then 'review legal' else 'note wide' end, '')
            || ' exclude') as tokens
from (select *, null from lineitem)
""".replace("trim(coalesce", "replace(trim(coalesce").replace("' exclude')", "' exclude'), '  ', ' ')").replace(
        "(select *, null from lineitem)", "lineitem"
    )
)
def class_tokens(spark, d):
    tokens = F.expr(
        "case l_returnflag when 'A' then 'review  body' when 'R' then 'review legal' else 'note wide' end"
    )
    return read_table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        T.filter_tokens(tokens).alias("kept"),
        T.add_token(tokens, "exclude").alias("tokens"),
    )


@query(
    """
select p_partkey, p_name || '|' || p_brand || '|' || p_type as steps, cast(3 as bigint) as step_count from part
"""
)
def menu_steps(spark, d):
    path = F.expr("concat('(', p_name, ' → [', p_brand, '] →  「', p_type, '」)')")
    steps = T.menu_steps(path)
    return read_table(spark, d, "part").select(
        "p_partkey", F.array_join(steps, "|").alias("steps"), F.size(steps).cast("long").alias("step_count")
    )


# Decomposed letters and their composed form.
COMPOSED = [("ć", "ć"), ("Ć", "Ć"), ("č", "č"), ("Č", "Č")]


@query(
    "select doc_id, replace(replace(text, 'c', 'č'), 'C', 'Ć') as text from documents"
)
def composed_letters(spark, d):
    """Texts in which every c carries a separate accent, composed again."""
    accented = F.replace(
        F.replace(F.col("text"), F.lit("c"), F.lit("č")), F.lit("C"), F.lit("Ć")
    )
    return read_table(spark, d, "documents").select(
        "doc_id", T.compose(accented, COMPOSED).alias("text")
    )


# -- images, tiles, references ---------------------------------------------------------------


@query(
    """
with renames as (select replace(p_name, ' ', '_') as from_name, 'IMG_' || min(p_partkey) as to_name
                 from part where p_size < 5 group by 1)
select p_partkey, placement, case when r.to_name is not null then 'image-attr' end as modified,
       'images/sub/' || coalesce(r.to_name, stem) || '.png' as href,
       case placement when 'Inline' then 15 when 'break' then 95 else p_size end as scale
from (select p_partkey, p_size, replace(p_name, ' ', '_') as stem,
             case p_type when 'PROMO' then 'Inline' when 'LARGE' then 'break' when 'SMALL' then 'other' end as placement
      from part) left join renames r on r.from_name = stem
"""
)
def image_renames(spark, d):
    part = read_table(spark, d, "part")
    images = part.selectExpr(
        "p_partkey",
        "concat('images/sub/', replace(p_name, ' ', '_'), '.PNG') as href",
        "case p_type when 'PROMO' then 'Inline' when 'LARGE' then 'break' when 'SMALL' then 'other' end as placement",
        "p_size as scale",
    )
    renames = part.where("p_size < 5").selectExpr(
        "replace(p_name, ' ', '_') as from_name",
        "concat('IMG_', cast(p_partkey as string)) as to_name",
        "p_partkey as pos",
    )
    return C.rename_images(images, renames)


@query(
    """
with mapping as (select lower(p_name) as nav, arg_min(lower(p_brand) || '.svg', p_partkey) as svg
                 from part where p_type = 'LARGE' and p_size < 25 group by 1),
toc as (select p_partkey, 'topics/' || replace(p_name, ' ', '_') || '.dita' as href, p_name as title,
               case when p_size > 10 then './images/' || lower(p_brand) || '.svg' end as tile_href from part)
select p_partkey, href, title, m.svg is not null and (tile_href is null or tile_href <> './images/' || m.svg) as fixed,
       case when m.svg is not null and (tile_href is null or tile_href <> './images/' || m.svg)
            then './oxygen-webhelp/template/images/' || m.svg else tile_href end as tile_href
from toc left join mapping m on m.nav = title
"""
)
def tile_fixes(spark, d):
    part = read_table(spark, d, "part")
    toc = part.selectExpr(
        "p_partkey",
        "concat('topics/', replace(p_name, ' ', '_'), '.dita') as href",
        # rows without a title take it from the file name
        "case when p_size > 5 then p_name end as title",
        "case when p_size > 10 then concat('./images/', lower(p_brand), '.svg') end as tile_href",
    )
    mapping = part.where("p_type = 'LARGE' and p_size < 25").selectExpr(
        "concat('  ', upper(p_name)) as nav", "concat(lower(p_brand), '.svg') as svg", "p_partkey as pos"
    )
    return C.fix_tiles(toc, mapping)


def id_table(spark, d):
    """Orders are topics of a map per priority, their lines are elements named by part."""
    orders = read_table(spark, d, "orders").selectExpr(
        "o_orderkey", "o_orderpriority as map_id",
        "concat('o', cast(o_orderkey as string)) as topic_oid",
        "format_string('t%05d', o_orderkey) as topic_nid",
    )
    topics = orders.selectExpr(
        "map_id", "topic_oid as oid", "topic_nid as nid", "topic_oid", "topic_nid", "true as is_topic",
        "o_orderkey * 10L as pos",
    )
    lines = read_table(spark, d, "lineitem").selectExpr(
        "l_orderkey as o_orderkey", "l_partkey", "l_suppkey", "l_linenumber"
    )
    elements = lines.join(orders, "o_orderkey").selectExpr(
        "map_id",
        "concat('l', cast(l_partkey as string)) as oid",
        "format_string('e%05d', o_orderkey * 100000 + l_suppkey * 10 + l_linenumber) as nid",
        "topic_oid", "topic_nid", "false as is_topic",
        "(o_orderkey * 10000000L + l_suppkey * 10 + l_linenumber) * 10 as pos",
    )
    return topics.unionByName(elements)


def xref_table(spark, d):
    orders = read_table(spark, d, "orders").selectExpr(
        "o_orderkey", "o_orderpriority as map_id", "o_orderstatus"
    )
    lines = read_table(spark, d, "lineitem").selectExpr(
        "l_orderkey as o_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linenumber"
    )
    return lines.join(orders, "o_orderkey").selectExpr(
        "map_id", "o_orderkey", "l_partkey", "l_suppkey",
        "case when l_returnflag = 'A' then concat('#o', cast(o_orderkey + l_linenumber as string))"
        " when l_returnflag = 'R' then concat('x.dita#o', cast(o_orderkey as string), '/l', cast(l_partkey + 1 as string))"
        " when l_linenumber > 4 then concat('../other/o', cast(o_orderkey as string), '.dita')"
        " when l_linenumber > 2 then 'plain' end as href",
    )


REFERENCES = """ids as (
  select o_orderpriority as map_id, 'o' || o_orderkey as oid,
         't' || case when o_orderkey < 100000 then lpad(o_orderkey::varchar, 5, '0') else o_orderkey::varchar end as nid,
         'o' || o_orderkey as topic_oid,
         't' || case when o_orderkey < 100000 then lpad(o_orderkey::varchar, 5, '0') else o_orderkey::varchar end as topic_nid,
         true as is_topic, o_orderkey * 10 as pos from orders
  union all
  select o_orderpriority, 'l' || l_partkey,
         'e' || case when n < 100000 then lpad(n::varchar, 5, '0') else n::varchar end,
         'o' || o_orderkey,
         't' || case when o_orderkey < 100000 then lpad(o_orderkey::varchar, 5, '0') else o_orderkey::varchar end,
         false, (o_orderkey * 10000000 + l_suppkey * 10 + l_linenumber) * 10
  from (select *, l_orderkey * 100000 + l_suppkey * 10 + l_linenumber as n
        from lineitem join orders on o_orderkey = l_orderkey)),
first_ids as (select * from (select *, row_number() over (partition by map_id, oid order by pos) as rn from ids) where rn = 1),
xrefs as (
  select o_orderpriority as map_id, o_orderkey, l_partkey, l_suppkey,
         case when l_returnflag = 'A' then '#o' || (o_orderkey + l_linenumber)
              when l_returnflag = 'R' then 'x.dita#o' || o_orderkey || '/l' || (l_partkey + 1)
              when l_linenumber > 4 then '../other/o' || o_orderkey || '.dita'
              when l_linenumber > 2 then 'plain' end as href
  from lineitem join orders on o_orderkey = l_orderkey)"""


@query(
    sql(
        REFERENCES,
        body="""
, wanted as (select *, case when contains(href, '/') then split_part(href, '/', -1)
                    when contains(href, '#') then split_part(href, '#', 2) else '' end as oid from xrefs)
select w.map_id, w.o_orderkey, w.l_partkey, w.l_suppkey, cast(null as varchar) as mark,
       case when i.is_topic then i.nid || '.dita#' || i.nid
            when i.nid is not null then i.topic_nid || '.dita#' || i.topic_nid || '/' || i.nid end as href
from wanted w left join first_ids i on i.map_id = w.map_id and i.oid = w.oid
""",
    )
)
def xrefs_renumbered(spark, d):
    return C.resolve_xrefs(xref_table(spark, d), id_table(spark, d), "renumber")


@query(
    sql(
        REFERENCES,
        body="""
, wanted as (select *, case when contains(href, '../') then null when contains(href, '#')
                    then split_part(split_part(href, '#', 2), '/', -1) end as oid,
                    split_part(href, '#', 2) as fragment from xrefs)
select w.map_id, w.o_orderkey, w.l_partkey, w.l_suppkey, case when contains(w.href, '../') then '###' end as mark,
       case when i.nid is null then null
            when contains(fragment, '/') then split_part(fragment, '/', 1) || '.dita#' || fragment
            else fragment || '.dita#' || fragment end as href
from wanted w left join first_ids i on i.map_id = w.map_id and i.oid = w.oid
""",
    )
)
def xrefs_kept(spark, d):
    return C.resolve_xrefs(xref_table(spark, d), id_table(spark, d), "keep")


@query(
    """
select l_orderkey, l_partkey, l_suppkey, o_orderkey is not null as found, o_orderpriority as content
from lineitem left join orders on o_orderkey = l_orderkey + 1 and o_orderstatus = 'F'
"""
)
def topic_contents(spark, d):
    toc = read_table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "concat('t', cast(l_orderkey + 1 as string), '.dita#x') as href"
    )
    topics = read_table(spark, d, "orders").where("o_orderstatus = 'F'").selectExpr(
        "concat('t', cast(o_orderkey as string), '.dita') as href", "o_orderpriority as content"
    )
    merged = C.merge_topics(toc, topics)
    return merged.select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("content").isNotNull().alias("found"), "content"
    )
