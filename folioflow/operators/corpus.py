"""Sentences, dictionaries, images, titles and cross references of a document corpus."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..session import settle
from .ordered import first_per, number_blocks, numbered

# Marks written by the replacement and reference steps.
STATUS_CHANGED = "changed"
EXCLUDE_TOKEN = "exclude"
OUTSIDE_MARK = "###"
OUTSIDE_PATH = "../"
TILE_FOLDER = "./oxygen-webhelp/template/images/"
SCALE_BY_PLACEMENT = {"inline": 15, "break": 95}
MODIFIED_IMAGE = "image-attr"

# -- sentences -------------------------------------------------------------------------------


def sentences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line of whole texts: (id, pos, text)."""
    return docs.select(
        *[c for c in docs.columns if c != text_col],
        F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "text"),
    ).withColumn("pos", F.col("pos").cast("long"))


def hashed(sents: DataFrame) -> DataFrame:
    """Normalise the text first, then hash it: dictionaries hold hashes of normalised text."""
    clean = sents.withColumn("text", T.normalize_text(F.col("text")))
    return clean.withColumn("hash", T.content_hash(F.col("text")))


def flag_excluded(sents: DataFrame, excluded: DataFrame) -> DataFrame:
    """Add the exclude token to sentences of the exclusion dictionary."""
    listed = excluded.select("hash").distinct().withColumn("_hit", F.lit(True))
    tokens = F.when(F.col("_hit"), T.add_token(F.col("class_tokens"), EXCLUDE_TOKEN)).otherwise(
        F.col("class_tokens")
    )
    return sents.join(listed, "hash", "left").withColumn("class_tokens", tokens).drop("_hit")


def apply_replacements(sents: DataFrame, pairs: DataFrame, strict_region: bool = False) -> DataFrame:
    """Replace sentences by (region, hash); excluded ones stay, the last replacement of a pair wins."""
    newest = first_per(pairs.select("region", "hash", "new", "pos"), ["region", "hash"], ["pos"], last=True)
    free = ~T.has_token(F.col("class_tokens"), EXCLUDE_TOKEN)
    keyed = sents.withColumn("region", N.region(F.col("map_title"), strict_region))
    joined = keyed.join(newest.drop("pos"), ["region", "hash"], "left").withColumn(
        "_take", free & F.col("new").isNotNull()
    )
    return joined.select(
        *[c for c in sents.columns if c not in ("text", "status")],
        "region",
        F.when(F.col("_take"), F.col("new")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_take"), STATUS_CHANGED).otherwise(F.col("status")).alias("status"),
    )


def _targets(sents: DataFrame, phrase: str) -> DataFrame:
    said = F.contains(T.collapse(F.col("text")), F.lit(phrase))
    changed = F.coalesce(F.col("status"), F.lit("")).startswith(STATUS_CHANGED)
    return sents.where(said).withColumn("_changed", changed)


def change_report(sents: DataFrame, phrase: str, scope: Sequence[str]) -> DataFrame:
    """Counts and changed share (percent, two places, 0 without targets) of sentences with a phrase."""
    counts = _targets(sents, phrase).groupBy(*scope).agg(
        F.count(F.lit(1)).alias("target_count"), F.count_if("_changed").alias("changed_count")
    )
    ratio = F.when(
        F.col("target_count") > 0, F.col("changed_count") * 100.0 / F.col("target_count")
    ).otherwise(0.0)
    return counts.select(
        *scope,
        "target_count",
        "changed_count",
        (F.col("target_count") - F.col("changed_count")).alias("unchanged_count"),
        F.round(ratio, 2).alias("ratio"),
    )


def unchanged_sentences(
    sents: DataFrame, phrase: str, scope: Sequence[str], order: Sequence[str], blocks: Sequence[Column]
) -> DataFrame:
    """Numbered list of target sentences that neither changed nor are excluded."""
    excluded = F.contains(F.coalesce("class_tokens", F.lit("")), F.lit(EXCLUDE_TOKEN))
    left = _targets(sents, phrase).where(~F.col("_changed") & ~excluded).drop("_changed")
    # numbering reads its rows twice, so the joins before it are not repeated
    return numbered(settle(left), scope, order, blocks, out="list_no")


def excluded_sentences(sents: DataFrame) -> DataFrame:
    return sents.where(F.contains(F.coalesce("class_tokens", F.lit("")), F.lit(EXCLUDE_TOKEN)))


# -- translation dictionaries ----------------------------------------------------------------


def lang_key(col: Column) -> Column:
    return F.upper(T.collapse(col))


def build_dictionary(wide: DataFrame, order: str, languages: Sequence[str]) -> DataFrame:
    """Terms (hash, lang, term, entry_no, pos) from a wide sheet; the first language is the key."""
    keyed = wide.withColumn("hash", T.translation_hash(F.col(languages[0])))
    slot = F.array(
        *[
            F.struct(
                F.lit(lang.upper()).alias("lang"), T.collapse(F.col(lang)).alias("term"), F.lit(i).alias("pos")
            )
            for i, lang in enumerate(languages)
        ]
    )
    return keyed.select("hash", F.col(order).alias("entry_no"), F.inline(slot))


def dedupe_terms(terms: DataFrame) -> DataFrame:
    """Keep the first term per (hash, language), languages compared without case."""
    keyed = terms.withColumn("_key", lang_key(F.col("lang")))
    return first_per(keyed, ["hash", "_key"], ["entry_no", "pos"]).drop("_key").select(*terms.columns)


def merge_dictionary(current: DataFrame, update: DataFrame) -> DataFrame:
    """Existing terms win; missing languages and unknown entries are added.

    Of several updates with one unknown hash only the first entry counts.
    """
    have = dedupe_terms(current)
    first_entry = update.groupBy("hash").agg(F.min("entry_no").alias("_first"))
    known = have.select("hash").distinct().withColumn("_known", F.lit(True))
    fresh = (
        update.join(first_entry, "hash")
        .join(known, "hash", "left")
        .where(F.col("_known") | (F.col("entry_no") == F.col("_first")))
        .select(*current.columns)
    )
    key = lang_key(F.col("lang")).alias("_key")
    missing = (
        dedupe_terms(fresh)
        .select("*", key)
        .join(have.select("hash", key), ["hash", "_key"], "left_anti")
        .drop("_key")
    )
    return have.unionByName(missing.select(*have.columns))


def translate(sents: DataFrame, terms: DataFrame, target: str | None = None) -> DataFrame:
    """Replace whole sentences by their term in the target language, else keep the source.

    Without a target each sentence uses its own language.
    """
    wanted = F.lit(target) if target else F.col("lang")
    best = dedupe_terms(terms).select("hash", lang_key(F.col("lang")).alias("_lang"), "term")
    keyed = sents.withColumns({"hash": T.translation_hash(F.col("text")), "_lang": lang_key(wanted)})
    joined = keyed.join(best, ["hash", "_lang"], "left")
    return joined.select(
        *[c for c in sents.columns if c != "text"],
        "hash",
        F.coalesce("term", "text").alias("text"),
        F.col("term").isNotNull().alias("translated"),
    )


def map_language(df: DataFrame, column: str, mapping: DataFrame, out: str = "language") -> DataFrame:
    """Code to name (or back) without case; unknown values stay."""
    known = first_per(
        mapping.select(F.upper(T.strip(F.col("code"))).alias("_code"), F.col("name").alias("_name")),
        ["_code"],
        ["_name"],
    )
    joined = df.withColumn("_code", F.upper(T.strip(F.col(column)))).join(known, "_code", "left")
    return joined.withColumn(out, F.coalesce("_name", F.col(column))).drop("_code", "_name")


# -- terms -----------------------------------------------------------------------------------

# Characters that need escaping and the borders around a term.
META = "\\.^$|?*+()[]{}"
BORDER_BEFORE = "(^|\\s+|\\p{Ps})"
BORDER_AFTER = "(\\s+|\\p{P}|\\p{Pe}|$)"
TERM = '<term translate="no">{}</term>'
LETTER_RUN = "[\\p{L}\\p{N}]+"
SIGN = "[^\\p{L}\\p{N}\\s]"
#: up to this many terms are one pattern for all texts
FEW_TERMS = 64
#: longs of the bit table that tells words which may be an anchor; its size does not depend on the terms
TABLE_LONGS = 1 << 16


def usable_terms(terms: DataFrame) -> DataFrame:
    """Distinct terms that are not blank, with an anchor and their escaped form.

    The anchor is the longest run of letters and digits in the term. A term stands between borders that
    are neither, so wherever it matches, its anchor is a whole run of the text as well. The anchor of a
    term of signs alone is its first sign.
    """
    runs = F.regexp_extract_all("term", F.lit(LETTER_RUN), 0)
    longest = F.array_sort(runs, lambda a, b: F.length(b) - F.length(a))
    special = "([" + "".join("\\" + c for c in META) + "])"
    return (
        terms.select("term")
        .where(F.trim("term") != "")
        .distinct()
        .select(
            "term",
            F.coalesce(F.get(longest, F.lit(0)), F.regexp_extract("term", SIGN, 0)).alias("_anchor"),
            F.regexp_replace("term", special, "\\\\$1").alias("_escaped"),
        )
    )


def _any_of(hits: Column) -> Column:
    """One pattern of all terms, the longest first; null if there are none."""
    ordered = F.array_sort(hits, lambda a, b: F.length(b["term"]) - F.length(a["term"]))
    any_of = F.array_join(F.transform(ordered, lambda h: h["_escaped"]), "|")
    return F.when(any_of != "", F.concat(F.lit(f"{BORDER_BEFORE}("), any_of, F.lit(f"){BORDER_AFTER}")))


def _table_place(anchor: Column) -> tuple[Column, Column]:
    """Long and bit of the table that stand for an anchor."""
    hashed = F.xxhash64(anchor)
    return F.pmod(hashed, F.lit(TABLE_LONGS)).cast("int"), F.pmod(F.shiftright(hashed, 40), F.lit(64)).cast("int")


def _anchor_table(usable: DataFrame) -> Column:
    """The bits of all anchors as a constant array; the driver sees the table, not the terms."""
    place, bit = _table_place(F.col("_anchor"))
    bits = usable.select(place.alias("place"), bit.alias("bit"))
    rows = bits.groupBy("place").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).collect()
    table = dict.fromkeys(range(TABLE_LONGS), 0) | {r["place"]: r["bits"] for r in rows}
    # written as text, so that the plan holds one constant instead of an expression per number
    return F.split(F.lit(",".join(map(str, table.values()))), ",").cast("array<bigint>")


def with_term_pattern(df: DataFrame, text: str, terms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_pattern``: an alternation of the terms that occur in the row's text, longest first, or null.

    A few terms make one pattern for all texts. Of many, a bit table of their anchors tells which words
    and signs of a text may be one. Texts without any stay where they are; the others meet their terms in
    a join on anchors, and each text's own hits make its pattern. ``keys`` name the row; rows that share
    them get the same candidates, which their own text then filters. Null texts have no pattern.
    """
    keys = list(keys)
    usable = usable_terms(terms)
    few = usable.select("term", "_escaped").limit(FEW_TERMS + 1).collect()
    if len(few) <= FEW_TERMS:
        any_of = "|".join(r["_escaped"] for r in sorted(few, key=lambda r: (-len(r["term"]), r["term"])))
        pattern = F.lit(f"{BORDER_BEFORE}({any_of}){BORDER_AFTER}" if few else None).cast("string")
        return df.select(*df.columns, F.when(F.col(text).isNotNull(), pattern).alias("_pattern"))
    usable = settle(usable)
    table = _anchor_table(usable)

    def listed(word: Column) -> Column:
        place, bit = _table_place(word)
        return F.call_function("getbit", F.get(table, place), bit) == 1

    runs = F.regexp_extract_all(text, F.lit(LETTER_RUN), 0)
    signs = F.regexp_extract_all(text, F.lit(SIGN), 0)
    marked = df.withColumn("_words", F.filter(F.array_distinct(F.concat(runs, signs)), listed))
    possible = F.coalesce(F.size("_words") > 0, F.lit(False))
    apart = marked.where(possible)
    hits = (
        apart.select(*keys, F.explode("_words").alias("_anchor"))
        .join(usable, "_anchor")
        .groupBy(*keys)
        .agg(F.collect_set(F.struct("term", "_escaped")).alias("_hits"))
        .select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_hits")
    )
    same = reduce(lambda a, b: a & b, [apart[k].eqNullSafe(hits[f"_of_{k}"]) for k in keys])
    joined = apart.join(hits, same, "left")
    present = F.filter("_hits", lambda h: F.contains(F.col(text), h["term"]))
    met = joined.select(*df.columns, _any_of(present).alias("_pattern"))
    return marked.where(~possible).select(*df.columns, F.lit(None).cast("string").alias("_pattern")).unionByName(met)


def tag_terms(text: Column, pattern: Column, skip: Column | None = None) -> Column:
    """Mark terms as not to be translated; ``skip`` marks texts in places where nothing is tagged."""
    tagged = F.when(pattern.isNull(), text).otherwise(
        F.regexp_replace(text, pattern, F.lit(f"$1{TERM.format('$2')}$3"))
    )
    return tagged if skip is None else F.when(skip, text).otherwise(tagged)


# -- images and tiles ------------------------------------------------------------------------


def rename_images(images: DataFrame, renames: DataFrame) -> DataFrame:
    """New image names by dictionary, lower-case extension, scale by placement.

    ``images`` has href, placement and scale; ``renames`` maps from_name to to_name, first one wins.
    """
    one = first_per(renames.select("from_name", "to_name", "pos"), ["from_name"], ["pos"]).drop("pos")
    file = F.substring_index("href", "/", -1)
    dotted = F.contains(file, F.lit("."))
    stem = F.when(dotted, F.substring_index(file, ".", 1)).otherwise("")
    extension = F.regexp_extract(file, "^[^.]*\\.(.*)$", 1)
    folder = F.regexp_extract("href", "^(.*/)?[^/]*$", 1)
    keyed = images.withColumn("_stem", stem)
    joined = keyed.join(one.withColumnRenamed("from_name", "_stem"), "_stem", "left")
    name = F.coalesce("to_name", "_stem")
    placed = F.lower(F.coalesce("placement", F.lit("")))
    scale = N.first_rule([(placed == p, F.lit(s)) for p, s in SCALE_BY_PLACEMENT.items()], F.col("scale"))
    return joined.select(
        *[c for c in images.columns if c not in ("href", "scale")],
        F.when(dotted, F.concat(folder, name, F.lit("."), F.lower(extension)))
        .otherwise(F.col("href"))
        .alias("href"),
        scale.alias("scale"),
        F.when(name != F.col("_stem"), MODIFIED_IMAGE).alias("modified"),
    )


def fix_tiles(toc: DataFrame, mapping: DataFrame) -> DataFrame:
    """Give chapters the tile that belongs to their title.

    ``toc`` has title (null when the chapter has no title data), href and tile_href; ``mapping`` has
    nav, svg and pos. A present tile is replaced only when it is wrong; a missing title is made from
    the file name.
    """
    file = F.regexp_replace(F.substring_index("href", "/", -1), "\\.dita$", "")
    title = F.coalesce("title", F.replace(file, F.lit("_"), F.lit(" ")))
    key = F.lower(T.collapse(title))
    one = first_per(
        mapping.select(F.lower(T.collapse(F.col("nav"))).alias("_key"), "svg", "pos"), ["_key"], ["pos"]
    ).drop("pos")
    joined = toc.withColumns({"_title": title, "_key": key}).join(one, "_key", "left")
    old_file = F.substring_index(T.collapse(F.col("tile_href")), "/", -1)
    wrong = F.col("svg").isNotNull() & (F.col("tile_href").isNull() | (old_file != F.col("svg")))
    return joined.select(
        *[c for c in toc.columns if c not in ("title", "tile_href")],
        F.col("_title").alias("title"),
        F.when(wrong, F.concat(F.lit(TILE_FOLDER), F.col("svg")))
        .otherwise(F.col("tile_href"))
        .alias("tile_href"),
        F.coalesce(wrong, F.lit(False)).alias("fixed"),
    )


# -- cross references ------------------------------------------------------------------------


def resolve_xrefs(xrefs: DataFrame, ids: DataFrame, mode: str) -> DataFrame:
    """Resolve references inside a map: (map_id, href) against ids (map_id, oid, nid, topic_oid,
    topic_nid, is_topic, pos).

    ``renumber`` writes new ids, ``keep`` old ones. A reference without target loses its href; in
    keep mode one that leaves the map gets a mark as its text.
    """
    if mode not in ("renumber", "keep"):
        raise ValueError("mode is 'renumber' or 'keep'")
    first = first_per(ids, ["map_id", "oid"], ["pos"])
    href = F.coalesce("href", F.lit(""))
    after_hash = F.when(
        F.contains(href, F.lit("#")), F.expr("substring(href, instr(href, '#') + 1)")
    ).otherwise("")
    if mode == "renumber":
        wanted = F.when(F.contains(href, F.lit("/")), F.substring_index(href, "/", -1)).otherwise(after_hash)
    else:
        # a fragment without '/' names a topic, one with '/' an element
        wanted = F.when(F.contains(href, F.lit(OUTSIDE_PATH)), F.lit(None)).otherwise(
            F.substring_index(after_hash, "/", -1)
        )
    joined = xrefs.withColumns({"oid": wanted, "_fragment": after_hash}).join(
        first.drop("pos"), ["map_id", "oid"], "left"
    )
    if mode == "renumber":
        found = F.col("nid").isNotNull()
        target = F.when(
            found & F.col("is_topic"), F.concat("nid", F.lit(".dita#"), "nid")
        ).when(found, F.concat("topic_nid", F.lit(".dita#"), "topic_nid", F.lit("/"), "nid"))
        mark = F.lit(None).cast("string")
    else:
        topic = F.substring_index("_fragment", "/", 1)
        found = F.col("nid").isNotNull()
        plain = ~F.contains(F.col("_fragment"), F.lit("/"))
        target = F.when(found & plain, F.concat(topic, F.lit(".dita#"), topic)).when(
            found, F.concat(topic, F.lit(".dita#"), topic, F.lit("/"), "oid")
        )
        mark = F.when(F.contains(href, F.lit(OUTSIDE_PATH)), OUTSIDE_MARK)
    return joined.select(
        *[c for c in xrefs.columns if c != "href"], target.alias("href"), mark.alias("mark")
    )


def merge_topics(toc: DataFrame, topics: DataFrame) -> DataFrame:
    """Contents rows with their topic's content, fragment of the href ignored.

    Of several topics with one href, the least by its columns counts.
    """
    keyed = toc.withColumn("_file", F.substring_index("href", "#", 1))
    single = first_per(topics, ["href"], [c for c in topics.columns if c != "href"])
    return keyed.join(single.withColumnRenamed("href", "_file"), "_file", "left").drop("_file")
