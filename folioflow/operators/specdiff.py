"""Comparison of two versions of a specification table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import settle
from .ordered import carried, collected, number_blocks, numbered

# Row states, in the order in which they are decided, and the highlight mark.
DELETED = "deleted"
NEW = "new"
CHANGED = "changed"
HIGHLIGHT_MARK = "#"


def fill_items(rows: DataFrame, scope: str) -> DataFrame:
    """A blank item inherits the nearest item above it in its table."""
    item = F.nullif(T.collapse(F.coalesce("item", F.lit(""))), F.lit(""))
    filled = carried(rows, [scope], ["row_no"], number_blocks("row_no"), {"_item": item})
    return filled.withColumn("item", F.coalesce("_item", F.lit(""))).drop("_item")


def collapse_rows(rows: DataFrame, scope: str, per_line: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Merge continuation rows per item.

    Input rows are (scope, row_no, item, description, cells array). Returns items (first row number,
    description, column count, highlight flag) and cells (item, col_no, line_no, value): per column
    the non-blank cells of all rows joined by spaces in row order, '' if there are none. A line joins
    ``per_line`` cells; more go on in the next lines.
    """
    filled = fill_items(rows, scope)
    marked = F.exists("cells", lambda c: F.contains(c, F.lit(HIGHLIGHT_MARK)))
    items = filled.groupBy(scope, "item").agg(
        F.min("row_no").alias("row_no"),
        F.min_by("description", "row_no").alias("description"),
        F.min_by(F.size("cells"), "row_no").cast("long").alias("column_count"),
        F.count(F.lit(1)).alias("source_rows"),
        F.max(marked).alias("highlighted"),
    )
    long = (
        filled.select(scope, "item", "row_no", F.posexplode("cells").alias("_p", "_v"))
        .select(scope, "item", "row_no", (F.col("_p") + 1).cast("long").alias("col_no"),
                T.collapse(F.col("_v")).alias("value"))
        .where(F.col("value") != "")
    )
    keys = [scope, "item", "col_no"]
    joined = collected(
        long, keys, ["row_no"], number_blocks("row_no"), {"values": F.col("value")}, per_line
    ).select(*keys, F.col("part_no").alias("line_no"), F.array_join("values", " ").alias("value"))
    # the first row's width is the item's: columns beyond it leave, blank ones within it stay
    wide = items.where("column_count > 0").select(
        scope, "item", F.explode(F.sequence(F.lit(1).cast("long"), F.col("column_count"))).alias("col_no")
    )
    cells = wide.join(joined, keys, "left").select(
        *keys, F.coalesce("line_no", F.lit(0)).alias("line_no"), F.coalesce("value", F.lit("")).alias("value")
    )
    return items, cells


def with_lookups(items: DataFrame, authors: DataFrame, important: DataFrame) -> DataFrame:
    """Add the number of editors and the important mark; every item stays one row.

    The editors' names are in :func:`item_editors`.
    """
    editors = authors.groupBy(T.collapse(F.col("item_no")).alias("_key")).agg(F.count("name").alias("editor_count"))
    marked = important.select(T.collapse(F.col("item")).alias("_key"), F.lit("V").alias("important"))
    keyed = items.withColumn("_key", T.collapse(F.col("item")))
    return (
        keyed.join(marked.distinct(), "_key", "left")
        .join(editors, "_key", "left")
        .drop("_key")
        .fillna("", ["important"])
        .fillna(0, ["editor_count"])
    )


def item_editors(authors: DataFrame) -> DataFrame:
    """Editor names per collapsed item, one row each, numbered by their place in the list."""
    named = authors.where("name is not null").select(T.collapse(F.col("item_no")).alias("item"), "name", "pos")
    placed = numbered(named, ["item"], ["pos"], number_blocks("pos"), out="position")
    return placed.select("item", "position", "name")


def merge_versions(after: DataFrame, before: DataFrame, scope: str) -> DataFrame:
    """One row per item of either version; the first row stands for duplicates.

    ``moved`` tells that a common item has another rank among the common items.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(scope, "item").agg(
            F.min("row_no").alias(f"{name}_pos"),
            F.min_by("description", "row_no").alias(f"{name}_description"),
            F.count(F.lit(1)).alias(f"{name}_count"),
        )

    merged = settle(
        side(after, "after").join(side(before, "before"), [scope, "item"], "full_outer")
    )
    common = merged.where(F.col("after_pos").isNotNull() & F.col("before_pos").isNotNull())
    ranked = common.select(scope, "item", "after_pos", "before_pos")
    for name in ("after", "before"):
        pos = f"{name}_pos"
        ranked = numbered(ranked, [scope], [pos], number_blocks(pos), out=f"{name}_rank")
    moved = ranked.select(scope, "item", (F.col("after_rank") != F.col("before_rank")).alias("moved"))
    return merged.join(moved, [scope, "item"], "left").fillna(False, ["moved"]).fillna(
        0, ["after_count", "before_count"]
    )


def diff_cells(after: DataFrame, before: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of common columns of the rows that both versions hold, with both values and a changed flag.

    Inputs are (keys, column, value), one value per key and column; the last key names the row, those
    before it the table. Columns that a table has in one version only do not take part. A cell that is
    missing or null in one version counts as blank there. Cells in lines (``line_no`` in both inputs) are
    compared line by line, a missing line being blank.
    """
    keys = list(keys)
    cell = [*keys, "column", *(["line_no"] if "line_no" in after.columns and "line_no" in before.columns else [])]
    left = after.select(*cell, F.col("value").alias("after_value"))
    right = before.select(*cell, F.col("value").alias("before_value"))

    def shared(on: list[str]) -> DataFrame:
        return after.select(*on).distinct().join(before.select(*on).distinct(), on, "left_semi")

    columns = [*keys[:-1], "column"]
    cells = left.join(right, cell, "full_outer").fillna("", ["after_value", "before_value"])
    return cells.join(shared(keys), keys, "left_semi").join(shared(columns), columns, "left_semi").withColumn(
        "changed", F.col("after_value") != F.col("before_value")
    )


def diff_rows(
    after: DataFrame, before: DataFrame, cells: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """State per key: deleted, new, changed or ''."""
    touched = cells.groupBy(*keys).agg(F.max("changed").alias("_changed"))
    sides = (
        after.select(*keys, F.lit(True).alias("_after"))
        .distinct()
        .join(before.select(*keys, F.lit(True).alias("_before")).distinct(), list(keys), "full_outer")
        .join(touched, list(keys), "left")
    )
    state = (
        F.when(F.col("_after").isNull(), DELETED)
        .when(F.col("_before").isNull(), NEW)
        .when(F.col("_changed"), CHANGED)
        .otherwise("")
    )
    return sides.select(*keys, state.alias("state"))


def side_by_side(after: DataFrame, before: DataFrame, keys: Sequence[str]) -> DataFrame:
    """After columns, then before columns; a missing side is null."""

    def prefixed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in keys])

    return prefixed(after, "after").join(prefixed(before, "before"), list(keys), "full_outer")


def mark_new_columns(cells: DataFrame, headers: DataFrame, scope: str) -> DataFrame:
    """Border class of cells in newly added columns: First, Middle or Last row of their table.

    ``headers`` lists the new columns (scope, column). The header row is the first row (row_no 0).
    """
    last = cells.groupBy(scope).agg(F.max("row_no").alias("_last"))
    fresh = cells.join(headers.select(scope, "column").distinct(), [scope, "column"], "left_semi")
    place = (
        F.when(F.col("row_no") == 0, "First")
        .when(F.col("row_no") == F.col("_last"), "Last")
        .otherwise("Middle")
    )
    return fresh.join(last, scope).withColumn("row_class", place).drop("_last")


def style_flags(cells: DataFrame) -> DataFrame:
    """Red print and yellow fill from colour codes."""
    font, fill = F.lower(F.coalesce("font_color", F.lit(""))), F.lower(F.coalesce("fill_color", F.lit("")))
    return cells.withColumns({"red": F.contains(font, F.lit("ff0000")), "yellow": fill.startswith("#ffff")})


def style_name(left: Column, red: Column, yellow: Column) -> Column:
    """Cell style from its column kind and colour flags; null for a plain value cell."""
    name = F.concat(
        F.when(left, "LeftText").otherwise(""),
        F.when(red, "Red").otherwise(""),
        F.when(yellow, "BgYellow").otherwise(""),
    )
    return F.nullif(name, F.lit(""))


def first_tokens(cells: DataFrame) -> DataFrame:
    """First word of every cell; rows without an item leave."""
    return cells.where(T.collapse(F.col("item")) != "").withColumn(
        "value", T.first_token(F.col("value"))
    )
