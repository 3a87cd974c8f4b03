"""Session settings and table access shared by all plans."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Runtime SQL settings the operators count on. Adaptive execution picks broadcast joins from
#: measured shuffle sizes and splits skewed join partitions; no operator forces a broadcast.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a markup file or a whole text can be large, so Arrow batches are limited by rows as well
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else built."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioflow")
        .config("spark.driver.memory", os.environ.get("FOLIOFLOW_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def read_table(spark: SparkSession, location: str, name: str) -> DataFrame:
    """Scan one table of fixed schema: a parquet folder, or a JDBC url when the table is live."""
    if location.startswith("jdbc:"):
        return spark.read.format("jdbc").option("url", location).option("dbtable", name).load()
    return spark.read.parquet(f"{location.rstrip('/')}/{name}.parquet")


#: inputs up to this size may come in fewer pieces than there are cores
SMALL_INPUT_BYTES = 1 << 30


#: the same for tables of short rows: a file of this size has several row groups
SMALL_ROWS_BYTES = 1 << 27


def spread(df: DataFrame, *by: str, limit: int = SMALL_INPUT_BYTES) -> DataFrame:
    """Spread a small input over all cores, by columns that tell its rows apart.

    A small file is often a single row group, which one task would read and process alone. Larger
    inputs are split by the scan and stay as they are.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > limit:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *by)


def read_texts(spark: SparkSession, location: str, name: str, key: str, *columns: str) -> DataFrame:
    """A table with whole texts, ready for work on every text; only the named columns travel."""
    return spread(read_table(spark, location, name).select(key, *columns), key)


_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors share, as the cluster names it.

    Only a local session may fall back to a folder of its own.
    """
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="folioflow-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return _own_folder


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate result that several later steps read, and read it back.

    Chained scans would otherwise repeat everything before them. The table outlives lost executors
    and later readers fetch only the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
