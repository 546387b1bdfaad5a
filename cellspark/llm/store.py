"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import new_path

#: Settings of the jobs that stored() runs: shuffle files go as soon as a job has ended, and a Python worker gets some
#: megabytes of texts at once, not tens, however long they are (a text that is longer comes alone).
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextmanager
def settings(spark: SparkSession):
    """SETTINGS for the jobs run inside."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there.

    A lost executor costs a rerun of its tasks only, as the files do not live on executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with settings(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table made by stored() that no later step reads."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes_of(docs: DataFrame) -> int:
    """Bytes of all texts: what numbers of buckets follow from."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


#: A key with more than its SHARE-th part of all rows is joined by broadcast: there are SHARE of them at most.
SHARE = 1000


def with_facts(rows: DataFrame, facts: DataFrame, key: str, spread: str, total: int) -> DataFrame:
    """rows with the columns of facts, a row for each of some keys, with n, the number of rows that have the key; a left join.

    total is the number of all rows. Rows of a hot key get its facts by broadcast and are then dealt by the column spread,
    so that no task gets them all; the other keys meet in a shuffle, each with a SHARE-th part of the rows at most."""
    spark, columns = rows.sparkSession, [c for c in facts.columns if c != key]
    hot = facts.where(F.col("n") * SHARE > total).collect()
    if not hot:
        return rows.join(facts.hint("shuffle_merge"), key, "left")
    known = spark.createDataFrame(hot, facts.schema).select(key, F.struct(*columns).alias("_hot"))
    rows = rows.join(F.broadcast(known), key, "left")
    salt = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int"))
    rest = facts.select(key, F.struct(*columns).alias("_rest"), F.lit(0).alias("_salt"))
    out = rows.withColumn("_salt", salt).join(rest.hint("shuffle_merge"), [key, "_salt"], "left")
    return out.select(*rows.columns[:-1], *[F.coalesce(F.col("_hot")[c], F.col("_rest")[c]).alias(c) for c in columns])


#: Rows of a file, and files that even a small table has.
FILE_ROWS, FILES = 50_000, 8


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, of about so many short rows, in as few partitions as they need: a small table is not written as hundreds of files."""
    return df.coalesce(FILES + rows // FILE_ROWS)
