"""Stand-ins for recordings, objects and reads, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 64
#: Channels: name and percentile range of the display scale.
CHANNELS = [(0, "TagGFP", 50.0, 99.8), (1, "MKate", 50.0, 99.8), (2, "Cy5", 50.0, 99.8), (3, "Oblique", 0.0, 100.0)]
#: Scenes of the recordings by condition.
SCENES = [(1, "control"), (7, "control"), (13, "control"), (2, "PRRX1"), (3, "PRRX1"), (14, "MYOD1"), (15, "MYOD1"), (8, "both"), (9, "both"), (11, "both")]
#: Recordings: number, time points, hour of the first one, minutes between two, whether the last one is broken.
RECORDINGS = [(1, 68, 0, 20, True), (2, 137, 24, 20, False)]


def recordings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RECORDINGS, "recording int, n_timepoints int, start_h int, step_min int, drop_last boolean")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scanlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, replicate, t, channel, y, width, pixels: 64 embeddings make a plane, shifted by channel number."""
    rows = table(spark, sf_dir, "embeddings")
    frames = rows.agg(F.floor(F.count("*") / SIDE).cast("int").alias("nf"))
    own = rows.crossJoin(F.broadcast(frames)).withColumn("bt", F.floor(F.col("vec_id") / SIDE).cast("int")).where("bt < nf")
    own = own.withColumn("channel", F.explode(F.array(*[F.lit(c[0]) for c in CHANNELS])))
    return own.select(F.lit("S").alias("sample"), F.lit(1).alias("replicate"), F.expr("cast((bt - channel + 2 * nf) % nf as int)").alias("t"), "channel", F.expr(f"cast(vec_id % {SIDE} as int)").alias("y"), F.lit(SIDE).alias("width"), F.transform("embedding", lambda v: F.floor((v.cast("double") + 1.0) * 1000.0).cast("double")).alias("pixels"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """movie, t, ID, x, y, area from events."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("movie"), F.dayofmonth("ts").alias("t"), F.col("event_id").cast("long").alias("ID"), (F.col("value") * 4.0).alias("x"), (k * 12).alias("y"), (F.col("event_id") % 100 + 50).cast("long").alias("area"))


def letters(k) -> F.Column:
    return F.translate(F.md5(k.cast("string").cast("binary")), "0123456789abcdef", "ACGT" * 4)


def few_letters(k: F.Column, n: int) -> F.Column:
    """letters(k % n), which are constants where k has no sign."""
    rest = k % n
    return F.when(rest >= 0, F.get(F.array(*[letters(F.lit(i)) for i in range(n)]), rest.cast("int"))).otherwise(letters(rest))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, gene, condition key: cell barcode, molecular tag and insert from lineitem and orders."""
    cells = table(spark, sf_dir, "orders").select("o_orderkey", F.substring(letters(F.col("o_custkey")), 1, 16).alias("cell"))
    rows = table(spark, sf_dir, "lineitem").join(cells, F.col("l_orderkey") == F.col("o_orderkey"))
    seq = F.concat("cell", F.substring(few_letters(F.col("l_suppkey"), 10), 1, 12), few_letters(F.col("l_partkey"), 20))
    return rows.select(F.when(F.col("l_linenumber") == 7, F.concat(F.lit("N"), F.substring(seq, 2, 100))).otherwise(seq).alias("seq"), (F.col("l_partkey") % 20).cast("int").alias("gene"))


def whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 10 != 0)
    return rows.select(F.substring(letters(F.col("c_custkey")), 1, 16).alias("barcode"), F.col("c_mktsegment").alias("segment"))
