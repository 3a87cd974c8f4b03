"""File sources and sinks: key/value lines, dictionaries, inventories, splits, reports."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from ..session import settle


def read_kv(spark: SparkSession, path: str) -> DataFrame:
    """Lines key=value; lines that start with # are comments. The value may hold further '='."""
    lines = spark.read.text(path).where(
        ~F.col("value").startswith("#") & F.contains("value", F.lit("="))
    )
    return lines.select(
        F.trim(F.substring_index("value", "=", 1)).alias("key"),
        F.trim(F.regexp_replace("value", "^[^=]*=", "")).alias("value"),
    )


def write_kv(df: DataFrame, path: str, note: str = "") -> None:
    """Lines key=value from the columns ``key`` and ``value``, a comment line first in every file.

    Rows without a key or value leave; line ends in a value become blanks.
    """
    one_line = F.regexp_replace(F.concat_ws("=", "key", "value"), "[\\r\\n]+", " ")
    lines = df.where("key is not null and value is not null").select(one_line.alias("value"))
    headed = lines.select(F.explode(F.array(F.lit(f"# {note}"), "value")).alias("value")) if note else lines
    headed.write.text(path)


CORRUPT = "_corrupt_record"
#: characters that XML can't hold
NOT_XML = "[^\\x09\\x0A\\x0D\\x20-\\uD7FF\\uE000-\\uFFFD\\x{10000}-\\x{10FFFF}]"


def _dictionary_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> tuple[DataFrame, StructType]:
    """All rows with their values as they are written, and the columns asked for."""
    wanted = StructType.fromDDL(schema)
    plain = StructType([StructField(f.name, f.dataType if _nested(f) else StringType()) for f in wanted])
    reader = spark.read.format("xml").options(
        rowTag=row_tag, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, ignoreSurroundingSpaces=False
    )
    rows = reader.schema(plain.add(CORRUPT, "string")).load(path)
    fits = F.col(CORRUPT).isNull()
    for f in wanted:
        if not _nested(f):
            fits = fits & (F.col(f.name).isNull() | F.col(f.name).try_cast(f.dataType).isNotNull())
    return rows.withColumn("_fits", fits), wanted


def _nested(field: StructField) -> bool:
    return isinstance(field.dataType, (StructType, ArrayType, MapType))


def read_dictionary(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Rows of a dictionary file such as <pair>, <replace>, <item>, <term> or <entry>.

    Attributes are columns with a leading '_', element text is ``_VALUE``. Rows that don't fit the schema
    or aren't well-formed stay out; :func:`broken_rows` has them.
    """
    rows, wanted = _dictionary_rows(spark, path, row_tag, schema)
    typed = [F.col(f.name) if _nested(f) else F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted]
    return rows.where("_fits").select(*typed)


def broken_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """(file, row) of the rows that :func:`read_dictionary` leaves out: as they stand in the file, or as JSON."""
    rows, wanted = _dictionary_rows(spark, path, row_tag, schema)
    shown = F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*wanted.fieldNames())))
    return rows.where("not _fits").select(F.col("_metadata.file_path").alias("file"), shown.alias("row"))


def write_dictionary(df: DataFrame, path: str, root_tag: str, row_tag: str) -> None:
    """Dictionary files: columns with a leading '_' are attributes, the others elements, nulls are absent.

    Characters that XML can't hold become U+FFFD.
    """
    kinds = dict(df.dtypes)
    held = [
        F.regexp_replace(c, NOT_XML, "\ufffd").alias(c) if kinds[c] == "string" else F.col(c) for c in df.columns
    ]
    df.select(*held).write.format("xml").options(rootTag=root_tag, rowTag=row_tag).save(path)


def list_files(spark: SparkSession, root: str, extensions: Sequence[str]) -> DataFrame:
    """Distinct file names below a folder by extension, contents unread; Spark's scan leaves empty files out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.substring_index("path", "/", -1)
    wanted = F.lower(F.regexp_extract(name, "(\\.[^.]+)$", 1)).isin(*[e.lower() for e in extensions])
    return files.select("path").where(wanted).select(name.alias("file_name")).distinct()


#: rows of one file of a split
SPLIT_ROWS = 1 << 20


def write_split(nodes: DataFrame, path: str, by: str, order: str, rows_per_file: int | None = None) -> None:
    """One folder per chapter or topic, in files of about ``rows_per_file`` rows.

    The chapters are counted first; each is cut into as many ranges of its own as its size asks for, by a
    sample of ``order``, and a range is one task's work, sorted by ``order``. So a huge chapter is spread
    over many tasks, and many small ones share a few. Null chapters have a folder, too.
    """
    rows_per_file = rows_per_file or SPLIT_ROWS
    total = nodes.count()
    pieces = max(1, -(-total // rows_per_file))
    ranged = nodes.repartitionByRange(pieces, by, order) if total else nodes
    ranged.sortWithinPartitions(by, order).write.partitionBy(by).mode("overwrite").parquet(path)


def write_named(files: DataFrame, folder: str, name: str, text: str) -> DataFrame:
    """One file per row below ``folder``; returns (file_name, n_bytes) of the files written.

    Names must differ; a file is written anew when its task is repeated. Null names leave, null texts
    are empty files.
    """

    def write(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            raws = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for at, raw in zip(names, raws):
                system, place = FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
                system.create_dir(place, recursive=True)
                with system.open_output_stream(f"{place.rstrip('/')}/{at}") as sink:
                    sink.write(raw)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(map(len, raws), pa.int64())], names=["file_name", "n_bytes"]
            )

    rows = files.where(F.col(name).isNotNull()).select(F.col(name).cast("string"), F.col(text).cast("string"))
    return settle(rows.mapInArrow(write, "file_name string, n_bytes long"))


def write_report(df: DataFrame, path: str, order: Sequence[str], fmt: str = "csv") -> None:
    """A report in row order, as range-partitioned files whose names follow the order."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = ranged.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def placed_in_files(rows: DataFrame, files: Sequence[str], line: str) -> DataFrame:
    """Rows of files with ``place``, their number over all files by name and line.

    The lines of each file are counted where they are; the files' totals, a row each, give every file the
    number of lines before it.
    """
    files = list(files)
    inside = Window.partitionBy(*files).orderBy(line)
    counted = rows.withColumn("_in", F.row_number().over(inside))
    totals = rows.groupBy(*files).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy(*files).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*files, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = counted.join(before, files)
    return placed.withColumn("place", F.col("_before") + F.col("_in")).drop("_before", "_in")
