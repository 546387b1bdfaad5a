"""Cutting the lineage of iterative jobs, and folders that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files go as soon as their job has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local master, as in tests, gets one of our own where that is
    unset, which goes when the process ends; on a cluster no machine's folder would do, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="cellspark-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df as a table in the shared folder, written and read back.

    Lineage ends there, also for the optimizer: sizes of what follows are estimated from the files. A checkpoint would
    keep the estimate of its plan, which joins multiply from round to round."""
    spark = df.sparkSession
    path = new_path(spark, name)
    written(df, path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, path: str) -> None:
    """Write a table that no later step reads other than from its files: the job's shuffle files go with it."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN, None)
    conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEAN) if before is None else conf.set(CLEAN, before)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one that no later step reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by cut() that no later step reads."""
    for df in tables:
        files = df.inputFiles()
        if files:
            removed(df.sparkSession, files[0].rsplit("/", 1)[0])
