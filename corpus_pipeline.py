"""A training corpus from raw documents, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellspark.llm import decontaminate, minhash, packing, secrets, toxicity
from cellspark.llm.names import columns_of, fresh, own
from cellspark.llm.store import dropped, stored


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7, with their columns as they are, whatever their names.

    A null or empty text has the score of the bias alone, far below; repeated rows score alike; an empty table gives none."""
    weights = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs.columns, "score")
    return toxicity.scored(docs, weights, score).where(own(score) < 0.7).select(*columns_of(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (similarity 0.8 or more) the document with the smallest id.

    Texts without words, null ones among them, are nobody's copies. Rows that share a doc_id are one document: all of
    them stay, or none. Rows without doc_id stay. Columns stay as they are; an empty table gives none."""
    gone = minhash.linked(docs, per_cent=80, bands=40).where("not kept").select("doc_id")
    return docs.join(gone.hint("shuffle_merge"), "doc_id", "left_anti").select(*columns_of(docs))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word in a window of a benchmark item, with their columns as they are, whatever their names.

    Null and empty texts have no words and stay; repeated rows fare alike; an empty table of either kind takes nothing away."""
    names = []
    for name in decontaminate.NAMES:
        names.append(fresh([*docs.columns, *names], name))
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=docs.columns, names=names)
    return found.where(f"octet_length({names[1]}) = 0").select(*columns_of(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [SECRET] in place of secrets and n_chars brought up to date; other columns as they are.

    Null and empty texts stay so; repeated rows fare alike; an empty table gives none."""
    return secrets.redacted(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; other columns than doc_id and text are not read.

    A null or empty text is a piece of the end token alone; rows that share a doc_id are packed each; an empty table gives none."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near duplicates", without_copies),
    ("benchmark decontamination", without_benchmark),
    ("secret scan", without_secrets),
    ("packing", sequences),
]
#: No SQL expresses the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again, and goes once the next one is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            dropped(before)
        before = docs
    return docs
