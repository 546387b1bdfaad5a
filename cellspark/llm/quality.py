"""Document quality by regularised quadratic discriminant analysis.

Both classes get a normal density over transformed statistics of the text. Their covariances are shrunk towards
the pooled one and towards its diagonal, and factored once (Cholesky); a document's score comes from the
difference of the two Mahalanobis log-densities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, NOT_SPACE, Words, packed, slices, unpacked
from .labels import fold, training_labels
from .store import dropped, stored

FOLDS, HELD_OUT = 5, 0
#: Shares of the pooled covariance and of its diagonal in each class covariance.
POOLED, DIAGONAL = 0.1, 0.1
NAMES = ("log_words", "word_length", "upper", "digits", "symbols", "distinct_words", "repeated_next", "repeated_pairs", "symbol_words", "line_length", "repeated_lines", "capitals_only", "sentence_ends")
UPPER, DIGIT, LETTER, SYMBOL = (np.zeros(256, bool) for _ in range(4))
UPPER[0x41:0x5B] = DIGIT[0x30:0x3A] = LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True
#: Signs that prose has seldom: printable ASCII but letters, digits and the marks of sentences.
SYMBOL[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,;:?'\"()-"]] = True
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".?"]] = True
NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[10] = False


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[offsets])


def _distinct(doc: np.ndarray, keys: np.ndarray, docs: int) -> np.ndarray:
    """Number of distinct keys of each document."""
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])) if len(doc) else np.zeros(0, bool)
    return np.bincount(doc[new], minlength=docs)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of transformed statistics (NAMES) for each text; shares go through an arcsine root, which steadies their variance."""
    words = Words(column, NOT_SPACE)
    data, offsets, docs = words.data, words.offsets, words.docs
    size = np.maximum(np.diff(offsets), 1)
    n = np.maximum(words.counts, 1)
    doc = words.doc
    low = Words.__new__(Words)
    low.__dict__ = words.__dict__ | {"data": np.take(LOWER, data)}
    h = low.hashes()
    same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) if len(h) else np.zeros(0, bool)
    inside = doc[1:] == doc[:-1] if len(h) else np.zeros(0, bool)
    pairs = (h[1:] * np.uint64(31) + h[:-1])[inside] if len(h) else h
    pair_doc = doc[1:][inside] if len(h) else doc
    letters = np.append(0, np.cumsum(LETTER[data], dtype=np.int64))
    uppers = np.append(0, np.cumsum(UPPER[data], dtype=np.int64))
    symbols = np.append(0, np.cumsum(SYMBOL[data], dtype=np.int64))
    word_letters = letters[words.ends] - letters[words.starts]
    word_upper = (uppers[words.ends] - uppers[words.starts]) * 2 > word_letters
    word_symbols = (symbols[words.ends] - symbols[words.starts]) > 1
    lines = Words(column, NOT_NEWLINE)
    line_n = np.maximum(lines.counts, 1)
    by_doc = lambda flags: np.bincount(doc[flags], minlength=docs)
    share = lambda a, b: np.arcsin(np.sqrt(np.clip(a / b, 0, 1)))
    lettered = np.maximum(_per_doc(LETTER[data], offsets), 1)
    return np.stack(
        [
            np.log1p(words.counts),
            np.log1p(size / n),
            share(_per_doc(UPPER[data], offsets), lettered),
            share(_per_doc(DIGIT[data], offsets), size),
            share(_per_doc(SYMBOL[data], offsets), size),
            share(_distinct(doc, h, docs), n),
            share(np.bincount(doc[1:][same], minlength=docs) if len(h) else np.zeros(docs), n),
            share(np.bincount(pair_doc, minlength=docs) - _distinct(pair_doc, pairs, docs), n),
            share(by_doc(word_symbols), n),
            np.log1p(words.counts / line_n),
            share(line_n - _distinct(lines.doc, lines.hashes(), docs), line_n) * (lines.counts > 0),
            share(by_doc(word_upper), n),
            share(_per_doc(ENDS[data], offsets), n),
        ],
        axis=1,
    ).astype(float)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row, packed as doubles."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), packed(list(statistics(part.column("text"))), np.float64)], ["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, stats binary")


class Discriminant:
    """Two normal densities with shrunk covariances."""

    def __init__(self, count: np.ndarray, sums: np.ndarray, squares: np.ndarray):
        d = sums.shape[1]
        self.prior = float(np.log((count[1] + 1) / (count[0] + 1)))
        self.mean = sums / np.maximum(count, 1)[:, None]
        spread = squares - count[:, None, None] * self.mean[:, :, None] * self.mean[:, None, :]
        pooled = spread.sum(0) / max(count.sum() - 2, 1)
        self.factors, self.logs = [], []
        for k in (0, 1):
            c = (spread[k] + POOLED * max(count[k], d) * pooled) / max(count[k] + POOLED * max(count[k], d), 1)
            c = (1 - DIAGONAL) * c + DIAGONAL * np.diag(np.diag(pooled)) + 1e-4 * np.eye(d)
            low = np.linalg.cholesky(c)
            self.factors.append(np.linalg.inv(low))
            self.logs.append(float(np.log(np.diag(low)).sum()))
        self.known = bool(count.min())

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1; without rows of both classes, the prior alone."""
        if not self.known:
            return np.full(len(x), 1 / (1 + np.exp(-self.prior)))
        logs = [-0.5 * (((x - self.mean[k]) @ self.factors[k].T) ** 2).sum(1) - self.logs[k] for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + self.prior, -35, 35)))


def trained(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Moments of each class over all labelled rows outside the held-out fold, summed by Spark."""
    d = len(NAMES)

    def moments(batches):
        count, sums, squares = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            x = unpacked(batch.column("stats"), np.float64).reshape(-1, d)
            y = batch.column("label").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = x[y == k]
                count[k] += len(own)
                sums[k] += own.sum(0)
                squares[k] += own.T @ own
        both = np.concatenate([np.concatenate([[count[k]], sums[k], squares[k].ravel()]) for k in (0, 1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both)), pa.int32()), pa.array(both)], ["place", "value"])

    rows = stats.join(training_labels(labels, label, FOLDS, HELD_OUT), "doc_id").select("stats", "label")
    sums = rows.mapInArrow(moments, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    flat = np.zeros(2 * (1 + d + d * d))
    flat[sums.column("place").to_numpy()] = sums.column("value").to_numpy()
    flat = flat.reshape(2, -1)
    return Discriminant(flat[:, 0], flat[:, 1 : d + 1], flat[:, d + 1 :].reshape(2, d, d))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, a row for each row of docs; other columns are ignored.

    Null and empty texts have statistics too (zeros) and so a score; repeated rows score alike; an empty table
    gives no rows. Labels of the held-out fold, of other values than 0 and 1, or without id are not learned from."""
    stats = stored(measured(docs), "statistics")
    model = stats.sparkSession.sparkContext.broadcast(trained(stats, labels))

    def run(batches):
        for batch in batches:
            score = model.value.score(unpacked(batch.column("stats"), np.float64).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    out = stats.mapInArrow(run, "doc_id long, score double")
    out = stored(out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")), "scores")
    dropped(stats)
    return out
