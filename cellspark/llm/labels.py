"""Labelled rows to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def training_labels(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """One (doc_id, label) for each document outside the held-out fold; of contradicting rows the larger label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out))
    return known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
