"""Toxicity by logistic regression over hashed words, word pairs and skip-grams, trained by FTRL-proximal.

Every coordinate has its own rate and an L1 threshold, so that most weights stay exactly 0 and the model is a
short list of (index, weight). Shards of the training rows are learned side by side and their weights averaged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .arrays import ALNUM, WORD_BASE, Words, mix, releasing, slices
from .labels import fold, training_labels
from .names import plain
from .store import settings

FOLDS, HELD_OUT = 3, 1
BITS = 20
#: The most labelled rows to learn from, and how many of them, or bytes of their texts, make a shard.
TRAIN_ROWS, SHARD_ROWS, SHARD_BYTES = 30_000, 15_000, 256 << 20
ALPHA, BETA, L1, L2, EPOCHS = 3.0, 1.0, 6.0, 0.0, 3


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(document, index) of each word, pair of neighbours and pair around one word; repeats included."""
    words = Words(column, ALNUM, lower=True)
    h, doc = words.hashes(), words.doc
    docs, keys = [doc], [h]
    for gap in (1, 2):
        if len(h) > gap:
            inside = doc[:-gap] == doc[gap:]
            keys.append(mix(h[:-gap] * WORD_BASE + h[gap:] + np.uint64(gap))[inside])
            docs.append(doc[:-gap][inside])
    return np.concatenate(docs), (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64), words.docs


def distinct(doc: np.ndarray, index: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's indices once, and where each document's begin."""
    both = np.unique((doc.astype(np.int64) << BITS) | index)
    return both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(docs + 1))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FTRL-proximal over one shard, in order of a hash of the id: rows (index, weight); the bias is the last index.

    Texts come batch by batch, and only their features are kept."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    parts, rows, keys = [], [], []
    for batch in batches:
        for part in slices(batch):
            index, first = distinct(*features(part.column("text")))
            rows += [(len(parts), first[k], first[k + 1]) for k in range(part.num_rows)]
            parts.append(index.astype(np.int32))
            keys += zip(*(part.column(c).to_pylist() for c in ("turn", "doc_id", "label")), strict=True)
    order = sorted(range(len(keys)), key=keys.__getitem__)
    rows, labels = [rows[k] for k in order], np.array([keys[k][2] for k in order], float)

    def weights(i):
        return np.where(np.abs(z[i]) > L1 * (i < 1 << BITS), -(z[i] - np.sign(z[i]) * L1 * (i < 1 << BITS)) / ((BETA + np.sqrt(n[i])) / ALPHA + L2), 0.0)

    for _ in range(EPOCHS):
        for (part, begin, end), y in zip(rows, labels, strict=True):
            i = np.append(parts[part][begin:end], np.int32(1 << BITS))
            w = weights(i)
            g = _sigmoid(w.sum()) - y
            more = np.sqrt(n[i] + g * g)
            z[i] += g - (more - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weights(np.arange(len(z)))
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w[at], pa.float64())], ["index", "weight"])


def trained(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights of the 2**BITS coordinates and the bias, learned from at most about train_rows labelled rows
    outside the held-out fold, chosen by a hash of their ids. Without any, all weights are 0."""
    chosen = training_labels(labels, label, FOLDS, HELD_OUT)
    total = chosen.count()
    turn = F.pmod(F.xxhash64("doc_id", F.lit("turn")), F.lit(1 << 30))
    if total > train_rows:
        chosen = chosen.where(turn < int((1 << 30) * train_rows / total))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    text_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-min(total, train_rows) // SHARD_ROWS), -(-text_bytes // SHARD_BYTES))
    rows = rows.select("doc_id", "text", "label", turn.alias("turn"), F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).alias("shard"))
    with settings(docs.sparkSession):
        model = rows.groupBy("shard").applyInArrow(releasing(_train), "index int, weight double").groupBy("index").agg((F.sum("weight") / shards).alias("weight")).toArrow()
    out = np.zeros((1 << BITS) + 1)
    out[model.column("index").to_numpy()] = model.column("weight").to_numpy()
    return out


def scored(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """docs and a last column name, which docs has not, from 0 to 1 (higher: label 1 likelier). Null and empty texts have the bias alone."""
    at = np.flatnonzero(weights)
    model = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weights[at]))

    def run(batches):
        table = np.zeros((1 << BITS) + 1)
        table[model.value[0]] = model.value[1]
        for batch in batches:
            for part in slices(batch):
                doc, index, docs = features(part.column("text"))
                used = table[index] != 0
                index, first = distinct(doc[used], index[used], docs)
                sums = np.diff(np.append(0, np.cumsum(table[index]))[first])
                yield part.append_column("of_text", pa.array(_sigmoid(sums + table[-1])))

    rows = plain(docs)
    return rows.mapInArrow(releasing(run), StructType([*rows.schema.fields, StructField("of_text", DoubleType())])).toDF(*docs.columns, name)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, a row for each row of docs; other columns are ignored.

    Rows that repeat get equal scores; a null text scores as an empty one; an empty table gives no rows."""
    out = scored(docs.select("doc_id", "text"), trained(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
