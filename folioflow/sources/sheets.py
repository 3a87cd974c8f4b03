"""Sheet scans. A sheet arrives as cells (file, sheet_no, row_no, col_no, value); headers are found
at run time, because every file places them differently."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Header search depth, band anchors and the order of candidate header rows.
HEADER_SEARCH_ROWS = 20
BAND_TITLE = "사양군"
BAND_ANCHORS = ((5, 8), (3, 8))
HEADER_ROW_OFFSETS = (0, 1, -1, 2, -2)
ITEM_COLUMN = 1
DESCRIPTION_COLUMN = 3
NO_BREAK_SPACES = "  "
ZERO_WIDTH = "​"


def discover_header(
    cells: DataFrame, aliases: dict[str, Sequence[str]], max_rows: int | None = HEADER_SEARCH_ROWS
) -> DataFrame:
    """Header place per file: (file, sheet_no, header_row, one column number per role).

    ``aliases`` maps a role to its accepted header texts, white space ignored. The first sheet and
    row that show every role win; within a row the last matching column wins.
    """
    top = cells if max_rows is None else cells.where(F.col("row_no") <= max_rows)
    header = T.without_space(F.col("value"))
    places = [
        F.max(F.when(header.isin(*texts), F.col("col_no"))).alias(role)
        for role, texts in aliases.items()
    ]
    # rows without any header text leave before the shuffle
    accepted = sorted({text for texts in aliases.values() for text in texts})
    rows = top.where(header.isin(*accepted)).groupBy("file", "sheet_no", "row_no").agg(*places)
    for role in aliases:
        rows = rows.where(F.col(role).isNotNull())
    found = rows.groupBy("file").agg(
        F.min(F.struct("sheet_no", F.col("row_no").alias("header_row"), *aliases)).alias("_h")
    )
    return found.select("file", "_h.*")


def read_sheet(
    cells: DataFrame, aliases: dict[str, Sequence[str]], max_rows: int | None = HEADER_SEARCH_ROWS
) -> DataFrame:
    """Data rows below the discovered header, one column per role."""
    header = discover_header(cells, aliases, max_rows).withColumnsRenamed(
        {role: f"_at_{role}" for role in aliases}
    )
    below = cells.join(header, ["file", "sheet_no"]).where(F.col("row_no") > F.col("header_row"))
    return below.groupBy("file", "row_no").agg(
        *[
            F.coalesce(
                F.max(F.when(F.col("col_no") == F.col(f"_at_{role}"), F.col("value"))), F.lit("")
            ).alias(role)
            for role in aliases
        ]
    )


def clean_header(col):
    """Header text for comparing: special spaces become spaces, zero-width marks go, lower case."""
    spaced = F.translate(col, NO_BREAK_SPACES + ZERO_WIDTH, "  ")
    return F.lower(F.trim(spaced))


def select_spec_columns(
    cells: DataFrame, bands: DataFrame, keys: Sequence[str] | None = None
) -> DataFrame:
    """Chosen value columns per file: (file, header_row, col_no, name, pos).

    ``bands`` are merged areas (file, row_no, col_no, row_count, col_count). The band titled as the
    value band at the first anchor is taken, else the one at the second anchor. Header rows are tried
    around its lower edge; the first row with a usable header wins. With ``keys`` only those headers
    are kept, in the asked order.
    """
    (first_row, first_col), (second_row, second_col) = BAND_ANCHORS

    def covering(row: int, col: int) -> DataFrame:
        inside = F.lit(row).between(
            F.col("row_no"), F.col("row_no") + F.col("row_count") - 1
        ) & F.lit(col).between(F.col("col_no"), F.col("col_no") + F.col("col_count") - 1)
        return bands.where(inside)

    titled = (
        covering(first_row, first_col)
        .join(cells.select("file", "row_no", "col_no", "value"), ["file", "row_no", "col_no"])
        .where(F.contains(clean_header(F.col("value")), F.lit(BAND_TITLE)))
        .drop("value")
        .withColumn("choice", F.lit(0))
    )
    fallback = covering(second_row, second_col).withColumn("choice", F.lit(1))
    band = (
        titled.unionByName(fallback)
        .groupBy("file")
        .agg(F.min(F.struct("choice", "row_no", "col_no", "row_count", "col_count")).alias("_b"))
        .select(
            "file",
            (F.col("_b.row_no") + F.col("_b.row_count")).alias("edge"),
            F.col("_b.col_no").alias("from_col"),
            (F.col("_b.col_no") + F.col("_b.col_count") - 1).alias("to_col"),
        )
    )
    tried = band.select(
        "*", F.posexplode(F.array(*[F.lit(o) for o in HEADER_ROW_OFFSETS])).alias("try_no", "offset")
    ).withColumn("row_no", F.col("edge") + F.col("offset"))
    name = clean_header(F.col("value"))
    hits = (
        tried.join(cells.select("file", "row_no", "col_no", "value"), ["file", "row_no"])
        .where(F.col("col_no").between(F.col("from_col"), F.col("to_col")) & (name != ""))
        .select("file", "try_no", "row_no", "col_no", F.trim("value").alias("name"), name.alias("_key"))
    )
    if keys is not None:
        wanted = [k.strip().lower() for k in keys]
        hits = hits.where(F.col("_key").isin(*wanted))
        order = F.array_position(F.array(*[F.lit(k) for k in wanted]), F.col("_key"))
        # a repeated header counts once, at its first column
        hits = hits.groupBy("file", "try_no", "row_no", "_key").agg(
            F.min(F.struct("col_no", "name")).alias("_f")
        ).select("file", "try_no", "row_no", "_f.*", order.alias("_order"))
    else:
        hits = hits.withColumn("_order", F.col("col_no"))
    # a header row is as wide as a sheet at most, so its columns fit in one array
    rows = hits.groupBy("file", "try_no", "row_no").agg(
        F.array_sort(F.collect_list(F.struct("_order", "col_no", "name"))).alias("_cols")
    )
    chosen = rows.groupBy("file").agg(F.min_by(F.struct("row_no", "_cols"), "try_no").alias("_r"))
    return chosen.select(
        "file", F.col("_r.row_no").alias("header_row"), F.posexplode("_r._cols").alias("_p", "_c")
    ).select(
        "file",
        F.col("header_row").cast("long").alias("header_row"),
        F.col("_c.col_no").cast("long").alias("col_no"),
        F.col("_c.name").alias("name"),
        (F.col("_p") + 1).cast("long").alias("pos"),
    )


def spec_rows(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """Data rows below the chosen header: (file, row_no, item, description, cells array)."""
    header = columns.groupBy("file").agg(
        F.max("header_row").alias("header_row"), F.max("pos").alias("width")
    )
    fixed = F.when(F.col("col_no") == ITEM_COLUMN, 0).when(F.col("col_no") == DESCRIPTION_COLUMN, -1)
    below = cells.join(header, "file").where(F.col("row_no") > F.col("header_row"))
    placed = below.join(columns.select("file", "col_no", "pos"), ["file", "col_no"], "left").where(
        F.col("pos").isNotNull() | fixed.isNotNull()
    )
    text = F.coalesce("value", F.lit(""))
    return placed.groupBy("file", "row_no", "width").agg(
        F.coalesce(F.max(F.when(F.col("col_no") == ITEM_COLUMN, text)), F.lit("")).alias("item"),
        F.coalesce(F.max(F.when(F.col("col_no") == DESCRIPTION_COLUMN, text)), F.lit("")).alias(
            "description"
        ),
        F.map_from_entries(
            F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", text)))
        ).alias("_by_pos"),
    ).select(
        "file",
        "row_no",
        "item",
        "description",
        F.transform(
            F.sequence(F.lit(1).cast("long"), "width"),
            lambda p: F.coalesce(F.col("_by_pos")[p], F.lit("")),
        ).alias("cells"),
    )
