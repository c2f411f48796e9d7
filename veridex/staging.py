"""Staged tables: lineage ends in a table that driver and executors share, so a lost executor costs nothing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a local folder is set only in local mode, where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veridex-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session is gone; the folder goes with the cluster's own cleaning
        pass


def discard(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when the process ends."""
    atexit.register(_delete, spark, path)


def release(*staged: DataFrame) -> None:
    """Delete staged tables that no later plan reads: what came of them is staged too."""
    for df in staged:
        _delete(df.sparkSession, df._staged_at)


def stage(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to the shared folder, with further ``options`` of the writer, and read it back. The table goes with release(),
    or when the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veridex/{name}-{uuid.uuid4().hex}"
    # small row groups: a writer holds one of them in memory, and staged hashes gain nothing from dictionaries
    df.write.options(**{"compression": "zstd", "parquet.block.size": 16 << 20, "parquet.enable.dictionary": "false", **options}).parquet(path)
    discard(spark, path)
    found = spark.read.schema(df.schema).parquet(path)
    found._staged_at = path
    return found
