"""Contents lists: flat rows with levels, trees, ids, links, legal targets and ordered diffs.

A contents list is (map_id, row_no, level, title, file_name, href) in pre-order; ``row_no`` is dense
from 1 within its map. Spark has no recursive type, so a tree stays flat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..session import settle
from .hierarchy import chain_roots
from .listdiff import match_lists
from .ordered import Running, carried, first_per, number_blocks, numbered, running

# Target patterns, tags, group names and level limits.
TARGET_TOPIC = "^t\\d+\\.dita$"
TARGET_LEGAL = "^legal_(?!\\d{2}(?:_\\d{2})?\\.dita$)[\\w-]+\\.dita$"
UNCLASSIFIED = "unclassified"
NO_TITLE = "(제목 없음)"
TOPIC_TAGS = ("concept", "task", "reference")
MIN_LEVEL, MAX_LEVEL = 1, 6
MOVED, UNLINKED, MASTER_ONLY, MANUAL_ONLY = "moved", "master-unlinked", "master-only", "manual-only"


# -- tree shape ------------------------------------------------------------------------------


def depths(rows: DataFrame) -> DataFrame:
    """Depth of each row: a row is at most one deeper than the row before it.

    With n the row number, depth = n + min(0, running minimum of level - n), which equals popping a
    stack of open parents.
    """
    level = F.greatest(F.lit(MIN_LEVEL), F.col("level"))
    gap = {"_low": Running("min", level - F.col("row_no"))}
    scanned = running(rows, ["map_id"], ["row_no"], number_blocks("row_no"), gap)
    return scanned.withColumn(
        "depth", (F.col("row_no") + F.least(F.lit(0), F.col("_low"))).cast("long")
    ).drop("_low")


def parents(rows: DataFrame) -> DataFrame:
    """Add ``parent_no``: the nearest earlier row one level up (null for top rows).

    Each row speaks in the group of its own depth and asks in the group above, so any depth works.
    """
    here = F.struct(*rows.columns)
    nobody = F.lit(None).cast("long")
    says = F.struct(F.col("depth").alias("_at"), F.col("row_no").alias("_said"), F.lit(1).alias("_kind"))
    asks = F.struct((F.col("depth") - 1).alias("_at"), nobody.alias("_said"), F.lit(0).alias("_kind"))
    both = rows.select("map_id", "row_no", here.alias("_row"), F.inline(F.array(says, asks))).withColumn(
        "_row", F.when(F.col("_kind") == 0, F.col("_row"))
    )
    found = carried(
        both, ["map_id", "_at"], ["row_no", "_kind"], number_blocks("row_no"), {"parent_no": F.col("_said")}
    )
    return found.where(F.col("_kind") == 0).select("_row.*", "parent_no")


def tree_from_levels(rows: DataFrame) -> DataFrame:
    return parents(settle(depths(rows)))


def subtree_end(rows: DataFrame) -> DataFrame:
    """Add ``end_no``: the next row whose level is not deeper (one past the last row if none).

    Levels are counted from the map's least one. A row speaks in the power-of-two range of levels that
    holds its own, once for each size; it asks in the ranges that make up all levels down to its own. So
    a row costs as many copies as the levels' span has binary digits, whatever the levels are.
    """
    reach = rows.groupBy("map_id").agg(
        F.min("level").alias("_least"), F.max("level").alias("_most"), F.max("row_no").alias("_last")
    )
    placed = rows.select("map_id", "row_no", "level").join(reach, "map_id").withColumn("_spot", F.expr("level - _least"))
    sizes = "sequence(0, length(bin(_most - _least + 1)) - 1)"
    says = (
        f"transform({sizes}, b -> named_struct('_size', b, '_range', shiftright(_spot, b),"
        " '_said', row_no, '_kind', 0))"
    )
    asks = (
        f"transform(filter({sizes}, b -> shiftright(_spot + 1, b) % 2 = 1), b -> named_struct('_size', b,"
        " '_range', shiftright(_spot + 1, b) - 1, '_said', cast(null as bigint), '_kind', 1))"
    )
    both = placed.select("map_id", "row_no", "_last", F.expr(f"inline(concat({says}, {asks}))"))
    found = running(
        both,
        ["map_id", "_size", "_range"],
        ["row_no", "_kind"],
        number_blocks("row_no"),
        {"_end": Running("last", F.col("_said"))},
        reverse=True,
    )
    ends = found.where(F.col("_kind") == 1).groupBy("map_id", "row_no").agg(
        F.coalesce(F.min("_end"), F.max("_last") + 1).alias("end_no")
    )
    return rows.join(ends, ["map_id", "row_no"]).select(*rows.columns, "end_no")


# -- legal targets ---------------------------------------------------------------------------


def is_legal_target(file_name: Column) -> Column:
    name = F.lower(T.strip(F.coalesce(file_name, F.lit(""))))
    return name.rlike(TARGET_TOPIC) | name.rlike(TARGET_LEGAL)


def drop_excluded(rows: DataFrame, excluded_title: str) -> DataFrame:
    title = F.regexp_replace(T.strip(F.coalesce("title", F.lit(""))), "\\s+", " ")
    return rows.where(F.lower(title) != excluded_title.lower())


def legal_targets(rows: DataFrame) -> DataFrame:
    """Target rows at level 3 or deeper with the files of their level-1 and level-2 ancestors."""
    filled = carried(
        rows,
        ["map_id"],
        ["row_no"],
        number_blocks("row_no"),
        {
            "parent_l1_file": F.when(F.col("depth") == 1, F.col("file_name")),
            "parent_l2_file": F.when(F.col("depth") == 2, F.col("file_name")),
        },
    )
    return filled.where((F.col("depth") >= 3) & is_legal_target(F.col("file_name"))).select(
        "map_id", "row_no", "file_name", "title", "parent_l1_file", "parent_l2_file",
        F.col("depth").alias("level_no"),
    )


def file_key(col: Column) -> Column:
    return F.lower(T.strip(F.coalesce(col, F.lit(""))))


def place_targets(topics: DataFrame, targets: DataFrame, template: DataFrame) -> DataFrame:
    """Topics that are targets, with their place in the template: level-2 parent, else level-1
    parent, else the unclassified group. The first template row of a file counts."""
    wanted = first_per(
        targets.select(file_key(F.col("file_name")).alias("_key"), "parent_l1_file", "parent_l2_file"),
        ["_key"],
        ["parent_l1_file", "parent_l2_file"],
    )
    places = (
        template.select("map_id", "row_no", "level", file_key(F.col("file_name")).alias("_file"))
        .where(F.col("_file") != "")
        .groupBy("map_id", "_file")
        .agg(F.min(F.struct("row_no", "level")).alias("_place"))
    )
    checked = topics.withColumn("_key", file_key(F.col("file_name"))).join(wanted, "_key")
    for level in (2, 1):
        side = places.select(
            "map_id", F.col("_file").alias(f"_f{level}"), F.col("_place").alias(f"_p{level}")
        )
        checked = checked.withColumn(f"_f{level}", file_key(F.col(f"parent_l{level}_file"))).join(
            side, ["map_id", f"_f{level}"], "left"
        )
    place = F.coalesce("_p2", "_p1")
    return checked.select(
        *topics.columns,
        place["row_no"].alias("parent_no"),
        place["level"].alias("parent_level"),
        F.when(place.isNull(), UNCLASSIFIED).alias("group_name"),
    )


def build_legal_tree(topics: DataFrame, targets: DataFrame, template: DataFrame) -> DataFrame:
    """Template rows plus the checked topics.

    ``topics`` is a contents list with ``topic_parent``, the row number of the topic above (or null).
    A topic below another checked topic follows it one level deeper; the others go to the end of the
    subtree of their parent in the template, or under the unclassified heading. Topics already in the
    template are not added again, but hold topics below them.

    Result rows carry a sort key: place in the template, then deeper parents first, then arrival of the
    topmost added topic, then own arrival; under the heading the latest comes first.
    """
    key = file_key(F.col("file_name"))
    wanted = targets.select(file_key(F.col("file_name")).alias("_key")).distinct()
    checked = settle(topics.withColumn("_key", key).join(wanted, "_key", "left_semi"))
    rows = template.select("map_id", "row_no", "level", key.alias("_key")).where("_key <> ''")
    present = rows.groupBy("map_id", "_key").agg(F.min(F.struct("row_no", "level")).alias("_at"))
    fresh = checked.join(present, ["map_id", "_key"], "left_anti")
    chained = chain_roots(fresh, "map_id", "row_no", "topic_parent")

    # a topmost topic may hang below a checked topic that the template already has
    held = checked.join(present, ["map_id", "_key"]).select(
        "map_id", F.col("row_no").alias("topic_parent"), F.col("_at").alias("_held")
    )
    tops = chained.where("hops = 0").drop("_key", "root", "hops").join(
        held, ["map_id", "topic_parent"], "left"
    )
    placed = place_targets(tops, targets, template).withColumns(
        {
            "parent_no": F.coalesce(F.col("_held.row_no"), F.col("parent_no")),
            "parent_level": F.coalesce(F.col("_held.level"), F.col("parent_level")),
            "group_name": F.when(F.col("_held").isNull(), F.col("group_name")),
        }
    )
    ends = subtree_end(template).select("map_id", F.col("row_no").alias("parent_no"), "end_no")
    spots = placed.join(ends, ["map_id", "parent_no"], "left")
    child_level = F.greatest(
        F.lit(MIN_LEVEL), F.least(F.lit(MAX_LEVEL), F.col("parent_level") + 1)
    )
    loose_level = F.greatest(F.lit(2), F.least(F.lit(MAX_LEVEL), F.col("level")))
    loose = F.col("group_name").isNotNull()
    spots = spots.select(
        "map_id",
        F.col("row_no").alias("root"),
        F.when(loose, loose_level).otherwise(child_level).cast("long").alias("_top_level"),
        # before template row end_no, after whatever else ends there
        F.when(loose, F.lit(2**62)).otherwise(F.col("end_no") * 2 - 1).alias("key_position"),
        F.when(loose, F.lit(0)).otherwise(-F.col("parent_no")).alias("key_parent"),
        F.when(loose, -F.col("row_no")).otherwise(F.col("row_no")).alias("key_top"),
    )
    added = chained.join(spots, ["map_id", "root"]).select(
        "map_id",
        F.least(F.lit(MAX_LEVEL), F.col("_top_level") + F.col("hops")).cast("long").alias("level"),
        "file_name",
        "title",
        F.lit("manual").alias("source"),
        "key_position",
        "key_parent",
        "key_top",
        F.col("row_no").alias("key_arrival"),
    )
    nothing = F.lit(0).cast("long")
    kept = template.select(
        "map_id",
        F.col("level").cast("long").alias("level"),
        "file_name",
        "title",
        F.lit("template").alias("source"),
        (F.col("row_no") * 2).alias("key_position"),
        nothing.alias("key_parent"),
        nothing.alias("key_top"),
        nothing.alias("key_arrival"),
    )
    heading = template.select("map_id").distinct().select(
        "map_id",
        F.lit(1).cast("long").alias("level"),
        F.lit("").alias("file_name"),
        F.lit(UNCLASSIFIED).alias("title"),
        F.lit("group").alias("source"),
        F.lit(2**62 - 1).alias("key_position"),
        nothing.alias("key_parent"),
        nothing.alias("key_top"),
        nothing.alias("key_arrival"),
    )
    return kept.unionByName(added).unionByName(heading)


def export_tree(rows: DataFrame, excluded_title: str) -> DataFrame:
    """Rows to write out: excluded titles gone, levels turned into nesting, kind by href presence."""
    left = drop_excluded(rows, excluded_title)
    dense = numbered(
        left.withColumnRenamed("row_no", "source_no"), ["map_id"], ["source_no"],
        number_blocks("source_no"),
    )
    href = F.coalesce(
        T.blank_to_null(F.col("href")), T.blank_to_null(F.col("file_name")), F.lit("")
    )
    kind = F.when(N.slashes(href) == "", "topichead").otherwise("topicref")
    return tree_from_levels(dense).withColumns({"href": N.slashes(href), "kind": kind})


def expected_parents(rows: DataFrame) -> DataFrame:
    """Distinct rows that have children."""
    return rows.where(F.col("parent_no").isNotNull()).select("map_id", "parent_no").distinct()


# -- links, ids, chapters --------------------------------------------------------------------


def related_links(rows: DataFrame) -> DataFrame:
    """Child links of top topics and the parent link of deeper ones: one join, two links a row."""
    up = rows.select(
        "map_id",
        F.col("row_no").alias("parent_no"),
        F.col("topic_id").alias("_up_id"),
        F.col("title").alias("_up_title"),
    )
    joined = rows.where(F.col("parent_no").isNotNull()).join(up, ["map_id", "parent_no"])

    def link(source: str, role: str, target: str, title: str) -> Column:
        return F.struct(
            F.col(source).alias("source_id"),
            F.lit(role).alias("role"),
            F.concat(F.col(target), F.lit(".dita#"), F.col(target)).alias("href"),
            F.col(title).alias("link_text"),
            F.col("row_no").alias("link_order"),
        )

    to_parent = link("topic_id", "parent", "_up_id", "_up_title")
    to_child = link("_up_id", "child", "topic_id", "title")
    links = F.when(F.col("depth") == 2, F.array(to_parent, to_child)).otherwise(F.array(to_parent))
    return joined.select("map_id", F.explode(links).alias("_l")).select("map_id", "_l.*")


def assign_ids(nodes: DataFrame) -> DataFrame:
    """New ids in document order: topics t00000.., other elements that carry an id e00000..

    ``nodes`` has doc_id, node_id, tag and id (null when absent).
    """
    topic = F.col("tag").isin(*TOPIC_TAGS)
    named = F.col("id").isNotNull()
    counts = {
        "_topics": Running("sum", topic.cast("long"), exclusive=True),
        "_ids": Running("sum", named.cast("long"), exclusive=True),
    }
    scanned = running(nodes, ["doc_id"], ["node_id"], number_blocks("node_id"), counts)
    new_id = F.when(topic, F.format_string("t%05d", F.coalesce("_topics", F.lit(0)))).when(
        named, F.format_string("e%05d", F.coalesce("_ids", F.lit(0)))
    )
    return scanned.withColumn("nid", new_id).drop("_topics", "_ids")


def number_chapters(chapters: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Chapter numbers 00, 01, .. of top rows; the first file keeps its name, others get a prefix.

    With ``listed`` (map_id, ordinal, list_name) the chapter list is joined by place.
    """
    placed = numbered(chapters, ["map_id"], ["row_no"], number_blocks("row_no"), out="ordinal")
    number = F.format_string("%02d", F.col("ordinal") - 1)
    out = placed.withColumn("chapter", number).withColumn(
        "chapter_file",
        F.when(F.col("ordinal") == 1, F.col("file_name")).otherwise(
            F.concat("chapter", F.lit("_"), "file_name")
        ),
    )
    return out if listed is None else out.join(listed, ["map_id", "ordinal"], "left")


def split_topics(rows: DataFrame) -> DataFrame:
    """One output topic per row; a row that repeats its parent's href gives none, one without href stays."""
    up = rows.select("map_id", F.col("row_no").alias("parent_no"), F.col("href").alias("_up"))
    return rows.join(up, ["map_id", "parent_no"], "left").where(
        F.col("_up").isNull() | F.col("href").isNull() | (F.col("href") != F.col("_up"))
    ).drop("_up")


def merge_chapters(chapters: DataFrame, order: DataFrame) -> DataFrame:
    """Chapters in listed order; unlisted ones leave, one listed twice takes its first place."""
    places = order.groupBy("map_id", "file_name").agg(F.min("ordinal").alias("ordinal"))
    return chapters.join(places, ["map_id", "file_name"]).orderBy("map_id", "ordinal")


def title_of(rows: DataFrame, topics: DataFrame) -> DataFrame:
    """Shown title: attribute, title, navigation, link text, topic file title, file name, placeholder."""
    # a file with several titles shows the least
    titles = topics.groupBy("file_name").agg(F.min("title").alias("_file_title"))
    bare = F.regexp_replace("file_name", "(?i)\\.(dita|ditamap)$", "")
    chain = [
        T.blank_to_null(F.col(c)) for c in ("navtitle_attr", "title", "navtitle", "linktext", "_file_title")
    ]
    return (
        rows.join(titles, "file_name", "left")
        .withColumn("shown_title", F.coalesce(*chain, T.blank_to_null(bare), F.lit(NO_TITLE)))
        .drop("_file_title")
    )


# -- diffs -----------------------------------------------------------------------------------


def row_key(file_name: Column, title: Column) -> Column:
    file = file_key(file_name)
    return F.when(file != "", F.concat(F.lit("file:"), file)).otherwise(
        F.concat(F.lit("title:"), file_key(title))
    )


def diff_status(
    master: DataFrame, manual: DataFrame, disk: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """State a row takes when the ordered diff leaves it unmatched, for both lists."""

    def files(df: DataFrame, flag: str) -> DataFrame:
        key = file_key(F.col("file_name")).alias("_file")
        return df.select("map_id", key).where("_file <> ''").distinct().withColumn(flag, F.lit(True))

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_file", file_key(F.col("file_name")))

    left = (
        keyed(master)
        .join(files(manual, "_other"), ["map_id", "_file"], "left")
        .join(files(disk, "_disk"), ["map_id", "_file"], "left")
    )
    master_state = (
        F.when(F.col("_other"), MOVED).when(F.col("_disk"), UNLINKED).otherwise(MASTER_ONLY)
    )
    right = keyed(manual).join(files(master, "_other"), ["map_id", "_file"], "left")
    manual_state = F.when(F.col("_other"), MOVED).otherwise(MANUAL_ONLY)
    return (
        left.select(*master.columns, master_state.alias("state")),
        right.select(*manual.columns, manual_state.alias("state")),
    )


def lcs_diff(master: DataFrame, manual: DataFrame) -> DataFrame:
    """Rows of two contents lists matched in order by file, or by title where there is none.

    Returns (map_id, master_no, manual_no); see :mod:`listdiff` for lists of any length.
    """
    key = row_key(F.col("file_name"), F.col("title")).alias("key")
    return match_lists(master.select("map_id", "row_no", key), manual.select("map_id", "row_no", key))
