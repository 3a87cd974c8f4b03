"""Registry imports with audit, order sheets and label detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ordered import first_per, number_blocks, numbered

# Import outcomes, order-sheet constants and the label pattern.
RESULT_NEW = "new"
RESULT_CHANGED = "changed"
RESULT_SAME = "same"
RESULT_SKIPPED = "skipped"
NOTE_NO_NAME = "name missing"
NOTE_BAD_VALUE = "value must be V, X or blank"
NOTE_BLANK = "blank taken as X"
NOTE_SUPERSEDED = "superseded by a later row"
UNIT_PRICE = 4500
DEFAULT_CHAPTER = "도안"
LINE_KIND = "설명도"
SMALLEST_LAST_CHAPTER = 11
LABEL_PATTERN = "(?i)^(?=[A-Z0-9_]*[0-9])[A-Z][A-Z0-9_]{6,}$"
LABEL_MAX_FONT = 5.5
CHAPTER_Q_KEY = 2147483646
CHAPTER_OTHER_KEY = 2147483647


def classify_import(rows: DataFrame) -> DataFrame:
    """Rows (row_no, name, value) with ``valid``, ``applied`` and ``note``; empty rows disappear."""
    name = T.strip(F.coalesce("name", F.lit("")))
    value = F.upper(T.strip(F.coalesce("value", F.lit(""))))
    typed = rows.withColumns({"name": name, "value": value}).where(
        (F.col("name") != "") | (F.col("value") != "")
    )
    known = F.col("value").isin("V", "X", "")
    valid = (F.col("name") != "") & known
    applied = F.when(~valid, "").when(F.col("value") == "", "X").otherwise(F.col("value"))
    note = (
        F.when(F.col("name") == "", NOTE_NO_NAME)
        .when(~known, NOTE_BAD_VALUE)
        .when(F.col("value") == "", NOTE_BLANK)
        .otherwise("")
    )
    return typed.withColumns({"valid": valid, "applied": applied, "note": note}).withColumn(
        "canon", T.canon(F.col("name"))
    )


def last_valid(rows: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Mark the last valid row per name; earlier valid ones are superseded.

    The winner's row number is a grouped maximum, so no window sorts a hot name.
    """
    keys = [*scope, "canon"]
    winner = rows.where("valid").groupBy(*keys).agg(F.max("row_no").alias("_last"))
    marked = rows.join(winner, keys, "left").withColumn(
        "winner", F.col("valid") & (F.col("row_no") == F.col("_last"))
    )
    superseded = F.col("valid") & ~F.col("winner")
    return marked.withColumn(
        "note", F.when(superseded, NOTE_SUPERSEDED).otherwise(F.col("note"))
    ).drop("_last")


def unique_registry(registry: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One registry row per canonical name: the earliest registered."""
    keyed = registry.withColumn("canon", T.canon(F.col("name")))
    return first_per(keyed, [*scope, "canon"], ["reg_dt", "name"])


def import_details(registry: DataFrame, rows: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Audit rows: row, input, applied, previous value, result and note."""
    keys = [*scope, "canon"]
    judged = last_valid(classify_import(rows), scope)
    old = unique_registry(registry, scope).select(
        *keys, F.coalesce("value", F.lit("")).alias("previous"), F.lit(True).alias("_known")
    )
    joined = judged.join(old, keys, "left")
    taken = F.col("winner")
    result = (
        F.when(~taken, RESULT_SKIPPED)
        .when(F.col("_known").isNull(), RESULT_NEW)
        .when(F.upper("previous") == F.col("applied"), RESULT_SAME)
        .otherwise(RESULT_CHANGED)
    )
    return joined.select(
        *scope,
        "row_no",
        "canon",
        "name",
        "value",
        "applied",
        F.when(taken, F.coalesce("previous", F.lit(""))).otherwise("").alias("previous"),
        result.alias("result"),
        "note",
    )


def import_summary(details: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Counts per outcome; total = new + changed + same + skipped."""

    def count(result: str, name: str) -> Column:
        return F.count_if(F.col("result") == result).alias(name)

    return details.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("total_rows"),
        count(RESULT_NEW, "inserted"),
        count(RESULT_CHANGED, "updated"),
        count(RESULT_SAME, "unchanged"),
        count(RESULT_SKIPPED, "skipped"),
    )


def upsert_registry(
    registry: DataFrame, rows: DataFrame, now: Column, scope: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """New registry table and audit rows. Unchanged values are not rewritten; reg_dt is kept."""
    keys = [*scope, "canon"]
    details = import_details(registry, rows, scope)
    writes = details.where(F.col("result").isin(RESULT_NEW, RESULT_CHANGED)).select(
        *keys, F.col("name").alias("_name"), F.col("applied").alias("_value")
    )
    old = unique_registry(registry, scope)
    merged = old.join(writes, keys, "full_outer").select(
        *keys,
        F.coalesce("name", "_name").alias("name"),
        F.coalesce("_value", "value").alias("value"),
        F.coalesce(F.col("reg_dt"), now).alias("reg_dt"),
    )
    return merged, details


def with_color_check(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """Add the registered V/X per entry name; anything else shows ''."""
    value = F.upper(T.strip(F.coalesce("value", F.lit(""))))
    checks = unique_registry(registry).select(
        "canon", F.when(value.isin("V", "X"), value).otherwise("").alias("check_value")
    )
    keyed = entries.withColumn("canon", T.canon(F.col("name")))
    return keyed.join(checks, "canon", "left").fillna("", ["check_value"])


# -- order sheet -----------------------------------------------------------------------------


def chapter_no(col: Column) -> Column:
    """Q or a positive number; anything else counts under chapter 1."""
    text = F.upper(T.strip(F.coalesce(col, F.lit(""))))
    return F.when((text == "Q") | text.rlike("^[1-9][0-9]*$"), text).otherwise("1")


def chapter_key(col: Column) -> Column:
    """Sort key: numbers first, then Q, then the rest."""
    text = F.upper(T.strip(F.coalesce(col, F.lit(""))))
    return (
        F.when(text.rlike("^[1-9][0-9]*$"), text.cast("long"))
        .when(text == "Q", CHAPTER_Q_KEY)
        .otherwise(CHAPTER_OTHER_KEY)
        .cast("long")
    )


def selected_entries(reviewed: DataFrame) -> DataFrame:
    """Rows ordered for drawing: the colour value is V."""
    return reviewed.where(F.upper(T.strip(F.coalesce("color_value", F.lit("")))) == "V")


#: chapter numbers are written out in pieces of this many, so that no array grows with them
SPINE_PIECE = 1024


def chapter_spine(tops: DataFrame, scope: str) -> DataFrame:
    """(scope, position): 0 for Q and every number from 1 to ``_top``, as rows.

    The range is opened in three steps: pieces of SPINE_PIECE squared, dealt over the tasks, then pieces,
    then numbers.
    """
    far = SPINE_PIECE * SPINE_PIECE
    wide = tops.select(scope, "_top", F.explode(F.expr(f"sequence(0L, _top div {far})")).alias("_far"))
    inner = F.expr(f"explode(sequence(_far * {SPINE_PIECE}, least(_far * {SPINE_PIECE} + {SPINE_PIECE - 1}, _top div {SPINE_PIECE})))")
    near = wide.repartition(scope, "_far").select(scope, "_top", inner.alias("_near"))
    last = F.expr(f"explode(sequence(_near * {SPINE_PIECE}, least(_near * {SPINE_PIECE} + {SPINE_PIECE - 1}, _top)))")
    return near.select(scope, last.alias("position"))


def order_summary(entries: DataFrame, scope: str) -> DataFrame:
    """Count per chapter over the full list Q, 1..n (n the largest chapter, 11 at least), zeros included.

    Chapters are 32-bit numbers; a larger one has a row where it has entries and lengthens no list.
    """
    counts = (
        entries.groupBy(scope, chapter_no(F.col("chapter_no")).alias("chapter"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    number = F.expr("try_cast(chapter as int)")
    tops = counts.groupBy(scope).agg(
        F.greatest(F.lit(SMALLEST_LAST_CHAPTER), F.coalesce(F.max(number), F.lit(0))).cast("long").alias("_top")
    )
    shown = F.when(F.col("position") == 0, "Q").otherwise(F.col("position").cast("string"))
    spine = chapter_spine(tops, scope).withColumn("chapter", shown)
    return spine.join(counts, [scope, "chapter"], "full").select(
        scope,
        F.coalesce("position", F.expr("try_cast(chapter as bigint)")).alias("position"),
        "chapter",
        F.coalesce("n", F.lit(0)).alias("entry_count"),
        (F.coalesce("n", F.lit(0)) * UNIT_PRICE).alias("amount"),
    )


def order_lines(entries: DataFrame, scope: str, vehicle: Column) -> DataFrame:
    """Numbered detail lines, one drawing each at the unit price."""
    placed = numbered(entries, [scope], ["row_no"], number_blocks("row_no"), out="line_no")
    return placed.select(
        scope,
        "line_no",
        "name",
        F.coalesce(T.blank_to_null(F.col("chapter")), F.lit(DEFAULT_CHAPTER)).alias("chapter"),
        F.lit(LINE_KIND).alias("line_kind"),
        F.lit(UNIT_PRICE).alias("unit_price"),
        F.lit(1).alias("quantity"),
        F.lit(UNIT_PRICE).alias("amount"),
        vehicle.alias("vehicle"),
        F.col("chapter_no"),
    )


def order_totals(lines: DataFrame, scope: str) -> DataFrame:
    """Totals per sheet and over all sheets (scope null)."""
    return lines.rollup(scope).agg(
        F.sum("quantity").alias("quantity"), F.sum("amount").alias("amount")
    )


# -- label detection -------------------------------------------------------------------------


def is_label(text: Column, font_size: Column) -> Column:
    """A drawing id: no white space inside, small print, letters with at least one digit."""
    return ~text.rlike("\\s") & (font_size <= LABEL_MAX_FONT) & text.rlike(LABEL_PATTERN)


def drawing_lines(lines: DataFrame) -> DataFrame:
    return lines.where(is_label(F.col("text"), F.col("font_size")))


def first_occurrence(lines: DataFrame, scope: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First line per canonical name in reading order."""
    keyed = lines.withColumn("canon", T.canon(F.col("text")))
    return first_per(keyed, [*scope, "canon"], list(order))
