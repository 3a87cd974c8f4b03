"""Set-based table maintenance: old table plus changes gives the new table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from .ordered import Running, first_per, name_blocks, numbered, running


def insert_missing(
    table: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Insert-ignore: rows whose key is new, the first one per key."""
    fresh = first_per(rows, keys, order).select(*table.columns)
    return table.unionByName(fresh.join(table.select(*keys), list(keys), "left_anti"))


def delete_keys(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys.distinct(), list(keys.columns), "left_anti")


def register(table: DataFrame, items: DataFrame, external: str, id_col: str) -> DataFrame:
    """Get or create: known external ids keep their row, new ones get ids above the highest.

    New ids are dense: rows are numbered inside hash buckets of the external id and a scan over the
    buckets' counts is added, so no task sees all new rows.
    """
    others = [c for c in items.columns if c != external]
    fresh = first_per(items, [external], others) if others else items.distinct()
    new = fresh.join(table.select(external), external, "left_anti")
    bucket = F.pmod(F.xxhash64(external), F.lit(4096)).alias("_bucket")
    one = new.select("*", bucket, F.lit(0).alias("_all"))
    placed = running(
        one, ["_all"], ["_bucket", external], [F.col("_bucket")], {"_n": Running("count")}, in_blocks=True
    )
    top = table.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    made = placed.withColumn(id_col, top.scalar() + F.col("_n"))
    return table.unionByName(made.select(*table.columns))


def new_columns(after: DataFrame, before: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Headers found only in ``after``."""
    return after.join(before.select(*scope, "name").distinct(), [*scope, "name"], "left_anti")


def common_columns(after: DataFrame, before: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Headers found in both, with both positions."""
    keys = [*scope, "name"]
    first = before.groupBy(*keys).agg(F.min("pos").alias("before_pos"))
    return after.withColumnRenamed("pos", "after_pos").join(first, keys)


def filter_summary(rows: DataFrame, shown: DataFrame) -> DataFrame:
    """Total and shown row counts."""
    counts = rows.select(F.lit(1).alias("t"), F.lit(0).alias("s")).unionByName(
        shown.select(F.lit(0).alias("t"), F.lit(1).alias("s"))
    )
    return counts.agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("total_count"),
        F.coalesce(F.sum("s"), F.lit(0)).alias("shown_count"),
    )


def count_all(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def recent_logs(logs: DataFrame, wanted: int) -> DataFrame:
    """Newest log rows; the wanted number is clamped to 1..500."""
    return logs.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(
        max(1, min(wanted, 500))
    )


# -- files and folders -----------------------------------------------------------------------

# Kinds of listed items.
FOLDER, DOCUMENT, SHORTCUT = "folder", "pdf", "shortcut"


def representative_dir(files: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Folder with most files per scope; of equals the greatest path."""
    counts = files.groupBy(*scope, "dir").agg(F.count(F.lit(1)).alias("file_count"))
    best = counts.groupBy(*scope).agg(F.max(F.struct("file_count", "dir")).alias("_b"))
    return best.select(*scope, "_b.dir", "_b.file_count")


def detect_format(files: DataFrame, scope: Sequence[str]) -> DataFrame:
    """xml or dita per input; 'both' and 'none' are errors for the caller to report."""
    name = F.lower("file_name")
    seen = files.groupBy(*scope).agg(
        F.max(name.endswith(".xml")).alias("_xml"),
        F.max(name.endswith(".dita") | name.endswith(".ditamap")).alias("_dita"),
    )
    kind = (
        F.when(F.col("_xml") & F.col("_dita"), "both")
        .when(F.col("_xml"), "xml")
        .when(F.col("_dita"), "dita")
        .otherwise("none")
    )
    return seen.select(*scope, kind.alias("format"))


def order_chapters(files: DataFrame, scope: str, tie: str) -> DataFrame:
    """Number chapter files: foreword, two-digit prefix, then name without case."""
    keyed = files.withColumns(
        {
            "_group": N.chapter_group(F.col("file_name")),
            "_number": N.leading_number(F.col("file_name")),
            "_name": F.lower("file_name"),
        }
    )
    order = ["_group", "_number", "_name", tie]
    blocks = [F.col("_group"), F.col("_number"), *name_blocks("_name")]
    placed = numbered(keyed, [scope], order, blocks, out="position")
    return placed.drop("_group", "_number", "_name")


def order_declared(files: DataFrame, scope: str, tie: str) -> DataFrame:
    """Number XML files by their declared chapter number, then by name without case.

    ``declared`` is the number that a file's root element holds; where it is missing or no integer, the
    file name stands in: foreword 1, a two-digit prefix, else last.
    """
    xml = files.where(F.lower("file_name").endswith(".xml"))
    keyed = xml.withColumn("chapter", N.chapter_number(F.col("declared"), F.col("file_name"))).withColumn(
        "_name", F.lower("file_name")
    )
    blocks = [F.col("chapter"), *name_blocks("_name")]
    return numbered(keyed, [scope], ["chapter", "_name", tie], blocks, out="position").drop("_name")


def bookmap(files: DataFrame, scope: str, tie: str) -> DataFrame:
    """Chapter list made from file names: XML files and files with a two-digit prefix, in order."""
    name = F.col("file_name")
    chapters = files.where(F.lower(name).endswith(".xml") | (N.leading_number(name) >= 0))
    return order_chapters(chapters, scope, tie)


def visible_items(items: DataFrame, name: str = "name") -> DataFrame:
    """Folders and documents of a listing; a shortcut stands for its target.

    Sorted by kind and name without case.
    """
    is_link = (F.col("kind") == SHORTCUT) & F.col("target_kind").isNotNull()
    shown = items.select(
        *[c for c in items.columns if c not in ("id", "kind", "target_id", "target_kind")],
        F.when(is_link & F.col("target_id").isNotNull(), F.col("target_id")).otherwise(F.col("id")).alias(
            "visible_id"
        ),
        F.when(is_link, F.col("target_kind")).otherwise(F.col("kind")).alias("kind"),
    )
    return shown.where(F.col("kind").isin(FOLDER, DOCUMENT)).orderBy("kind", F.lower(name), name)
