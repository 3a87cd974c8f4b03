"""Work on node tables: pruning, attributes, languages, tables and trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import settle
from . import corpus as C
from .ordered import Running, number_blocks, numbered, running

# Elements that stand for a contents entry, and their metadata container.
ENTRY_TAGS = ("topicref", "chapter", "appendix", "topichead", "mapref")
META_TAG = "topicmeta"
INDEX_TAG = "indexterm"
NO_SPACE_BEFORE = "^[:.,?)]"
NO_SPACE_AFTER = "[(]$"
MARKED_TAGS = ("p", "term")
UNTAGGED_IN = ("menucascade", "uicontrol", "title", "indexterm")
MODE_NAME, MODE_PATTERN = "DOOR mode", "(DOOR)(\\s+mode)"
COLON_LETTER = "(^|\\s)([A-Z])\\s*:"
LETTER_LIST = "^([A-Z]\\s*,\\s*)*[A-Z]$"
BOLD_LETTER = "^[A-LR]$"
DOOR = "DOOR"
TOPICS = ("concept", "task", "reference")
SHORT_TITLE, FUSE_TITLE, BULB_TITLE = "Abbreviation", "Fuse/relay panel description", "Bulb wattage "
PLAIN_LETTERS_TITLE = "타이어 에너지 소비 효율 등급"
CELL_TEXT, FUSE_TEXT = "(^|/)entry/p(/|$)", "(^|/)sectiondiv/(.+/)?entry/p(/|$)"
FUSE_CELL = "(^|/)concept/(.+/)?sectiondiv/(.+/)?table/(.+/)?tbody/(.+/)?row/entry$"
#: letters of a text that is compared with a fixed one, at most
SHORT = 64
CELL_LETTERS = ("I", "R", "A", "B", "C", "D", "E", "F", "G", "H", "K", "L", "S", "T", "U", "V", "W", "Y", "ZR")


def inside(nodes: DataFrame, rule: Column, out: str, doc: str = "doc_id") -> DataFrame:
    """Flag nodes that match or lie below a match.

    A node lies in a matching subtree when the furthest end of the matches so far reaches it, so one
    running maximum replaces a join with all ancestors.
    """
    return inside_each(nodes, {out: rule}, doc)


def inside_each(nodes: DataFrame, rules: dict[str, Column], doc: str = "doc_id", below: bool = False) -> DataFrame:
    """Several flags of ``inside`` in one scan; with ``below`` only nodes below a match have them."""
    reach = {f"_reach_{out}": Running("max", F.when(rule, F.col("end_id")), exclusive=below) for out, rule in rules.items()}
    scanned = running(nodes, [doc], ["node_id"], number_blocks("node_id"), reach)
    flags = {out: F.coalesce(F.col(f"_reach_{out}") >= F.col("node_id"), F.lit(False)) for out in rules}
    return scanned.withColumns(flags).drop(*reach)


def owners(asked: DataFrame, elements: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``asked`` (doc, node_id, depth of an ancestor, ...) with ``owner``, that ancestor's node among ``elements``.

    An ancestor is the last node of its depth before, so a forward fill per depth finds it.
    """
    rest = [c for c in asked.columns if c not in (doc, "node_id", "depth")]
    marks = elements.select(doc, "node_id", "depth", F.struct(F.col("node_id").alias("id")).alias("_own"))
    both = asked.unionByName(marks, allowMissingColumns=True)
    filled = running(both, [doc, "depth"], ["node_id"], number_blocks("node_id"), {"_now": Running("last", F.col("_own"))})
    return filled.where("_own is null").select(doc, "node_id", "depth", *rest, F.col("_now.id").alias("owner"))


def short_values(nodes: DataFrame, tags: Sequence[str], doc: str = "doc_id") -> DataFrame:
    """(doc, node_id, value) of elements of the given tags whose whole text, descendants' too, is short.

    Texts of white space only do not count. The lengths are summed first, so no long text is gathered.
    """
    texts = nodes.where((F.col("tag") == "#text") & F.col("text").rlike("[^ \\t\\r\\n]") & (F.size("tag_path") > 0))
    path = F.col("tag_path")
    at = F.filter(F.sequence(F.lit(0), F.size(path) - 1), lambda i: F.get(path, i).isin(*tags))
    asked = texts.select(doc, "node_id", "text", F.explode(at.cast("array<bigint>")).alias("depth"))
    held = owners(asked, nodes.where(F.col("tag").isin(*tags)), doc).withColumnRenamed("owner", "_element")
    held = held.select(doc, "_element", "node_id", "text")
    sizes = held.groupBy(doc, "_element").agg(F.sum(F.length(T.collapse(F.col("text")))).alias("n"))
    short = held.join(sizes.where(F.col("n") <= SHORT).drop("n"), [doc, "_element"], "left_semi")
    parts = short.groupBy(doc, "_element").agg(F.array_sort(F.collect_list(F.struct("node_id", "text"))).alias("_t"))
    return parts.select(doc, F.col("_element").alias("node_id"), F.array_join("_t.text", "").alias("value"))


def titled(nodes: DataFrame, rules: dict[str, tuple[str, str]], doc: str = "doc_id") -> DataFrame:
    """``nodes`` with a flag per rule (topic's tag, title): the node is that topic and has that very title."""
    values = short_values(nodes, ["title"], doc)
    titles = nodes.where(F.col("tag") == "title").select(
        doc, "node_id", "parent_id", F.element_at("tag_path", -1).alias("topic")
    ).join(values, [doc, "node_id"])
    is_one = {out: (F.col("topic") == tag) & (F.col("value") == title) for out, (tag, title) in rules.items()}
    found = titles.groupBy(doc, F.col("parent_id").alias("node_id")).agg(*[F.max(r).alias(out) for out, r in is_one.items()])
    joined = nodes.join(found, [doc, "node_id"], "left")
    return joined.withColumns({out: F.coalesce(F.col(out), F.lit(False)) for out in rules})


def prune(nodes: DataFrame, rule: Column, doc: str = "doc_id") -> DataFrame:
    """Drop nodes that match, with their subtrees."""
    return inside(nodes, rule, "_gone", doc).where(~F.col("_gone")).drop("_gone")


def tag_node_terms(nodes: DataFrame, terms: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Mark terms in text nodes as not to be translated.

    Mode names and letters before a colon are marked everywhere; dictionary terms are not marked in
    menus, controls, titles, index terms, in what is already marked, in a concept of abbreviations and in
    table cells of the fuse panel and of bulb wattages. A control that holds just DOOR becomes a marked
    text in its place.
    """
    columns = nodes.columns
    untouched = F.col("tag").isin(*MARKED_TAGS) & (F.col("attrs")["translate"] == "no")
    topics = {"_short": ("concept", SHORT_TITLE), "_fuse": ("concept", FUSE_TITLE), "_bulb": ("reference", BULB_TITLE)}
    door = short_values(nodes, ["uicontrol"], doc).where(T.collapse(F.col("value")) == DOOR)
    flagged = titled(nodes, topics, doc).join(door.select(doc, "node_id", F.lit(True).alias("_door")), [doc, "node_id"], "left")
    flagged = inside_each(flagged, {"_gone": F.coalesce(F.col("_door"), F.lit(False))}, doc, below=True).where(~F.col("_gone"))
    flagged = inside_each(
        flagged, {"_marked": F.coalesce(untouched, F.lit(False)), **{f"{t}_in": F.col(t) for t in topics}}, doc
    )
    path = F.array_join("tag_path", "/")
    apart = F.col("_short_in") | (F.col("_fuse_in") & path.rlike(FUSE_TEXT)) | (F.col("_bulb_in") & path.rlike(CELL_TEXT))
    flagged = flagged.withColumn("_marked", F.col("_marked") | apart)
    flagged = C.with_term_pattern(flagged, "text", terms, [doc, "node_id"])
    text = F.col("text")
    skip = F.col("_marked") | F.arrays_overlap("tag_path", F.array(*[F.lit(t) for t in UNTAGGED_IN]))
    tagged = (
        F.when(
            F.contains(text, F.lit(MODE_NAME)),
            F.regexp_replace(text, MODE_PATTERN, C.TERM.format("$1") + "$2"),
        )
        .when(text.rlike(COLON_LETTER), F.regexp_replace(text, COLON_LETTER, "$1" + C.TERM.format("$2") + ":"))
        .otherwise(C.tag_terms(text, F.col("_pattern"), skip))
    )
    is_door = F.col("_door").isNotNull()
    text = F.when(is_door, C.TERM.format(DOOR)).when(F.col("tag") == "#text", tagged).otherwise(text)
    return flagged.withColumns({
        "text": text,
        "tag": F.when(is_door, "#text").otherwise(F.col("tag")),
        "attrs": F.when(~is_door, F.col("attrs")),
        "end_id": F.when(is_door, F.col("node_id")).otherwise(F.col("end_id")),
    }).select(*columns)


def drop_attrs(nodes: DataFrame, names: Sequence[str]) -> DataFrame:
    kept = F.map_filter("attrs", lambda k, _: ~k.isin(*names))
    return nodes.withColumn("attrs", kept)


def update_attrs(nodes: DataFrame, updates: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Set or remove attributes: updates are (doc, node_id, name, value), a null value removes.

    Of several updates of one attribute the greatest ``seq`` wins.
    """
    last = updates.groupBy(doc, "node_id", "name").agg(F.max_by(F.struct("value"), "seq").alias("_v"))
    # an element has few attributes, so they fit in one map
    change = last.groupBy(doc, "node_id").agg(
        F.map_from_entries(F.collect_list(F.struct("name", F.col("_v.value").alias("value")))).alias("_new")
    )
    joined = nodes.join(change, [doc, "node_id"], "left")
    old = F.map_filter(
        F.coalesce("attrs", F.create_map().cast("map<string,string>")),
        lambda k, _: ~F.map_contains_key(F.col("_new"), k),
    )
    fresh = F.map_filter("_new", lambda _, v: v.isNotNull())
    merged = F.when(F.col("_new").isNull(), F.col("attrs")).otherwise(F.map_concat(old, fresh))
    return joined.withColumn("attrs", merged).drop("_new").select(*nodes.columns)


def effective_lang(nodes: DataFrame, attribute: str = "xml:lang", doc: str = "doc_id") -> DataFrame:
    """Language of the nearest ancestor or self that names one.

    One running sum over the starts and ends of language elements tells every node how many of them are
    open around it. The nearest one is then the last that was opened at that nesting, a forward fill per
    nesting; a node takes part in it once, however deep it lies.
    """
    spoken = F.col("attrs")[attribute]
    named = nodes.where(spoken.isNotNull()).select(doc, "node_id", "end_id", spoken.alias("lang"))
    nothing = F.lit(None).cast("string")
    marks = named.select(
        doc,
        F.inline(
            F.array(
                F.struct(F.col("node_id").alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("step"), F.col("lang")),
                F.struct((F.col("end_id") + 1).alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("step"), nothing.alias("lang")),
            )
        ),
        F.col("node_id").alias("tie"),
    )
    asks = nodes.select(
        doc, F.col("node_id").alias("at"), F.lit(2).alias("kind"), F.lit(0).alias("step"), nothing.alias("lang"),
        F.col("node_id").alias("tie"),
    )
    nested = running(
        marks.unionByName(asks), [doc], ["at", "kind", "tie"], number_blocks("at"), {"nest": Running("sum", F.col("step"))}
    )
    opened = settle(nested.where("kind > 0 and nest > 0").select(doc, "nest", "at", "kind", "lang"))
    filled = running(
        opened, [doc, "nest"], ["at", "kind"], number_blocks("at"), {"effective_lang": Running("last", F.col("lang"))}
    )
    found = filled.where("kind = 2").select(doc, F.col("at").alias("node_id"), "effective_lang")
    # kept tables are far smaller than their rows, so their sizes must not choose a broadcast here
    return nodes.join(found.hint("merge"), [doc, "node_id"], "left")


def text_of(nodes: DataFrame, tags: Sequence[str], doc: str = "doc_id") -> DataFrame:
    """Direct text of elements, collapsed: one row per element of the given tags that has text."""
    parts = nodes.where((F.col("tag") == "#text") & (F.element_at("tag_path", -1).isin(*tags)))
    joined = parts.groupBy(doc, F.col("parent_id").alias("node_id")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_t")
    )
    return joined.select(doc, "node_id", T.collapse(F.array_join("_t.text", " ")).alias("text"))


def block_hashes(nodes: DataFrame, tags: Sequence[str], doc: str = "doc_id") -> DataFrame:
    """Content hash of mixed-content elements: (doc, node_id, tag, hash).

    A block's children count in order, texts as they are, elements as their name and all text below them;
    number ranges are spelled one way first. The parts of a child, then the children of a block, are
    gathered where they are before they meet; one gathered value is never more than one element's content.
    """
    path = F.col("tag_path")
    below = F.filter(F.sequence(F.lit(0), F.size(path) - 1), lambda i: (i > 0) & F.get(path, i - 1).isin(*tags))
    texts = nodes.where((F.col("tag") == "#text") & (F.size(path) > 0))
    asked = texts.select(doc, "node_id", "text", F.explode(below.cast("array<bigint>")).alias("depth"))
    held = owners(asked, nodes.where(F.col("tag") != "#text"), doc)
    values = held.groupBy(doc, F.col("owner").alias("node_id")).agg(
        F.array_sort(F.collect_list(F.struct("node_id", "text"))).alias("_t")
    )
    inner = values.select(doc, "node_id", F.array_join("_t.text", "").alias("_below"))
    children = nodes.where(F.try_element_at("tag_path", F.lit(-1)).isin(*tags)).select(doc, "node_id", "parent_id", "tag", "text")
    is_text = F.col("tag") == "#text"
    part = F.struct(
        "node_id",
        F.when(is_text, "").otherwise(F.col("tag")).alias("tag"),
        F.when(is_text, F.col("text")).otherwise(F.coalesce("_below", F.lit(""))).alias("text"),
    )
    parts = children.join(inner, [doc, "node_id"], "left").groupBy(doc, F.col("parent_id").alias("node_id")).agg(
        F.array_sort(F.collect_list(part)).alias("_parts")
    )
    blocks = nodes.where(F.col("tag").isin(*tags)).select(doc, "node_id", "tag").join(parts, [doc, "node_id"], "left")
    parts = F.coalesce("_parts", F.array().cast("array<struct<node_id:bigint,tag:string,text:string>>"))
    return blocks.select(doc, "node_id", "tag", T.node_hash(parts).alias("hash"))


def multi_group_tables(nodes: DataFrame, table: str, group: str, doc: str = "doc_id") -> DataFrame:
    """Tables with two or more column groups, per document."""
    groups = nodes.where(
        (F.col("tag") == group) & (F.element_at("tag_path", -1) == table)
    )
    counts = groups.groupBy(doc, F.col("parent_id").alias("table_id")).agg(
        F.count(F.lit(1)).alias("group_count")
    )
    return counts.where(F.col("group_count") >= 2)


def merge_groups(rows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rows of all column groups of a table as one body, with the first group's header.

    ``rows`` has (doc, table_id, group_pos, row_pos, header); the merged place is ``row_no``.
    """
    keys = [doc, "table_id"]
    first = rows.groupBy(*keys).agg(F.min_by("header", "group_pos").alias("_header"))
    placed = numbered(rows, keys, ["group_pos", "row_pos"], [F.col("group_pos"), *number_blocks("row_pos")])
    return placed.drop("header").join(first.withColumnRenamed("_header", "header"), keys)


def space_inline(nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Repair spacing around inline elements.

    Bold elements get a space before them unless they come first. Text gets one before it unless it
    starts with closing punctuation, and one after it unless it ends with an opening bracket; index
    terms next to it do not count. Adds ``space_before`` and ``space_after``.
    """
    inner = nodes.where(F.col("parent_id").isNotNull())
    keys, blocks = [doc, "parent_id"], number_blocks("pos")
    tag = F.col("tag")
    left = running(inner, keys, ["pos"], blocks, {"_prev": Running("last", tag, exclusive=True)})
    both = running(
        left, keys, ["pos"], blocks, {"_next": Running("last", tag, exclusive=True)}, reverse=True
    )
    text = F.col("tag") == "#text"
    before = (F.col("tag") == "b") & F.col("_prev").isNotNull()
    before = before | (
        text & ~F.col("text").rlike(NO_SPACE_BEFORE) & F.coalesce(F.col("_prev") != INDEX_TAG, F.lit(False))
    )
    after = text & ~F.col("text").rlike(NO_SPACE_AFTER) & F.coalesce(F.col("_next") != INDEX_TAG, F.lit(False))
    return both.withColumns(
        {"space_before": F.coalesce(before, F.lit(False)), "space_after": F.coalesce(after, F.lit(False))}
    ).drop("_prev", "_next")


def refine_labels(nodes: DataFrame, terms: Sequence[str], doc: str = "doc_id") -> DataFrame:
    """Decide how short labels are marked, by their own text and place; first rule wins.

    Works on elements with direct text and adds ``rule``: letters (a list of letters in a table
    cell), letter (one in a cell, but not below the topic whose letters are plain), label ('A: text'
    paragraph), unwrap (bold or control that only holds a term or letter), plain (old term or italic
    marks) and fuse (unmarked paragraph, with text or without, of the first cell of a fuse panel's row).
    """
    kinds = ("b", "uicontrol", "term", "i", "p")
    texts = text_of(nodes, kinds, doc)
    texts = texts.withColumnRenamed("text", "label")
    topics = {"_fuse": ("concept", FUSE_TITLE)}
    flagged = inside_each(titled(nodes, topics, doc), {"_fuse_in": F.col("_fuse")}, doc)
    elements = flagged.where(F.col("tag").isin(*kinds)).select(doc, "node_id", "parent_id", "tag", "tag_path", "attrs", "_fuse_in")
    cells = nodes.where((F.col("tag") == "entry") & (F.element_at("tag_path", -1) == "row"))
    firsts = cells.groupBy(doc, F.col("parent_id").alias("_row")).agg(F.min("node_id").alias("parent_id")).drop("_row")
    elements = elements.join(firsts.withColumn("_first", F.lit(True)), [doc, "parent_id"], "left")
    unmarked = ~F.coalesce(F.map_contains_key("attrs", F.lit("translate")), F.lit(False))
    fuse = (F.col("tag") == "p") & F.col("_fuse_in") & F.col("_first").isNotNull() & unmarked
    fuse = fuse & F.array_join("tag_path", "/").rlike(FUSE_CELL)
    placed = elements.withColumn("_cell", fuse).join(texts, [doc, "node_id"], "left").where("label is not null or _cell")
    placed = placed.join(_plain_letters(nodes, doc).withColumn("_plain", F.lit(True)), [doc, "node_id"], "left")
    tag, label = F.col("tag"), F.col("label")
    cell = F.array_contains("tag_path", "tbody") & (F.element_at("tag_path", -1) == "entry")
    known = label.isin(*terms)
    rule = (
        F.when((tag == "b") & label.rlike(LETTER_LIST) & F.array_contains("tag_path", "entry"), "letters")
        .when((tag == "p") & cell & label.isin(*CELL_LETTERS) & F.col("_plain").isNull(), "letter")
        .when((tag == "p") & label.rlike(T.LABEL), "label")
        .when((tag == "b") & (known | label.rlike(BOLD_LETTER)), "unwrap")
        .when((tag == "uicontrol") & known & ~F.array_contains("tag_path", "menucascade"), "unwrap")
        .when(tag.isin("term", "i"), "plain")
        .when(F.col("_cell"), "fuse")
    )
    return placed.withColumn("rule", rule).select(doc, "node_id", "tag", "tag_path", "label", "rule")


def _plain_letters(nodes: DataFrame, doc: str) -> DataFrame:
    """(doc, node_id) of paragraphs whose nearest topic has the title below which letters stay plain."""
    values = short_values(nodes, ["title"], doc).where(T.collapse(F.col("value")) == PLAIN_LETTERS_TITLE)
    titles = nodes.where((F.col("tag") == "title") & F.element_at("tag_path", -1).isin(*TOPICS)).join(
        values, [doc, "node_id"], "left_semi"
    )
    path = F.col("tag_path")
    place = F.array_max(F.filter(F.sequence(F.lit(0), F.size(path)), lambda i: F.get(path, i).isin(*TOPICS)))
    asked = nodes.where(F.col("tag") == "p").select(doc, "node_id", place.cast("long").alias("depth")).where("depth is not null")
    held = owners(asked, nodes.where(F.col("tag").isin(*TOPICS)), doc)
    topics = titles.select(doc, F.col("parent_id").alias("owner")).distinct()
    return held.join(topics, [doc, "owner"], "left_semi").select(doc, "node_id")


def flatten_tree(nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Contents entries of a map in pre-order: level = entries around it + 1.

    Wrappers that are no entries do not count; everything inside metadata is skipped.
    """
    entry = F.col("tag").isin(*ENTRY_TAGS) | F.map_contains_key(
        F.coalesce("attrs", F.create_map().cast("map<string,string>")), "href"
    )
    inside = F.array_contains("tag_path", META_TAG) | (F.col("tag") == META_TAG)
    entries = nodes.where((F.col("tag") != "#text") & entry & ~inside)
    # an entry opens at its own number and closes after its last descendant
    marks = entries.withColumn("_row", F.struct(*entries.columns)).select(
        doc,
        F.inline(
            F.array(
                F.struct(F.col("node_id").alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("step"), F.col("_row")),
                F.struct(
                    (F.col("end_id") + 1).alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("step"),
                    F.when(F.lit(False), F.col("_row")).alias("_row"),
                ),
            )
        ),
        F.col("node_id").alias("_tie"),
    )
    levels = running(
        marks, [doc], ["at", "kind", "_tie"], number_blocks("at"), {"level": Running("sum", F.col("step"))}
    )
    return levels.where("kind = 1").select("_row.*", "level")
