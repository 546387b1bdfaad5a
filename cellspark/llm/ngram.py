"""Language-model scores by deleted interpolation of word bigrams.

p(w | v) mixes the maximum-likelihood estimates c(v,w)/c(v) and c(w)/N with a uniform share. The weights depend on
how frequent the context v is (powers of two) and are learned by expectation-maximisation: counts without one fold
of the training documents, mixed so that this fold becomes likeliest. Every count is over all training documents, and
every distinct pair is counted. The commonest 2**19 words have short codes and their counts broadcast; all others
travel as hashes, and the buckets that hold them get their counts by a join. The scores do not depend on the number of
codes.

Pairs travel as packed arrays by a hash of the pair, with the documents that hold them, so that counting and
scoring share one exchange. Pairs of two very common words are counted beforehand and their document lists stay
spread out, so no task gets the list of a hot pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import NOT_SPACE, Words, mix, packed, slices, unpacked
from .labels import fold
from .store import dropped, stored

FOLDS, HELD_OUT, MIXING = 7, 2, 3
#: Words with a code of their own; the commonest of them, whose pairs are counted beforehand.
HEAD, HOT = 1 << 19, 512
#: Codes from here on are places in a list of hashes of words outside the head.
TAIL = 1 << 31
END = mix(np.array([0xE0D], np.uint64))[0]
#: Tokens that a task gathers before it sends them out by bucket, and training tokens for each bucket of pairs; buckets at least.
SEND, BUCKET_TOKENS, BUCKETS = 400_000, 750_000, 8
#: Steps of log10 probability in the table that the weights are learned from.
GRID = 20
NO_ID = -(1 << 63)


def tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, its row of the slice, number of tokens of each row); every text ends with END."""
    words = Words(part.column("text"), NOT_SPACE, lower=True)
    out = np.full(words.n + words.docs, END, np.uint64)
    doc = words.doc
    out[np.arange(words.n) + doc] = words.hashes()
    counts = words.counts + 1
    return out, np.repeat(np.arange(words.docs), counts), counts


def _unigrams(batches):
    for batch in batches:
        for part in slices(batch):
            h, doc, _ = tokens(part)
            folds = part.column("fold").to_numpy(zero_copy_only=False)[doc]
            known = folds > 0
            keys, at = np.unique(h[known], return_inverse=True)
            mixing = np.bincount(at, folds[known] == 2, len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(at, minlength=len(keys))), pa.array(mixing)], ["word", "n", "mixing"])


class Vocabulary:
    """Classes: the head's words from 1, commonest first; 0 stands for any word outside the head."""

    def __init__(self, table: pa.Table, total: int, total_mixing: int, types: int):
        words = table.column("word").to_numpy().view(np.uint64)
        n, m = table.column("n").to_numpy(), table.column("mixing").to_numpy()
        order = np.lexsort((words, -n))
        words, n, m = words[order], n[order], m[order]
        self.total, self.total_mixing, self.types = total, total_mixing, types
        self.n, self.mixing = np.append(0, n), np.append(0, m)
        by_hash = np.argsort(words)
        self.words, self.classes = words[by_hash], by_hash + 1

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(h), np.int64)
        keys, at = np.unique(h, return_inverse=True)
        place = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
        return np.where(self.words[place] == keys, self.classes[place], 0)[at]


def _pairs(vocabulary: Vocabulary, c: np.ndarray) -> np.ndarray:
    """The class before each token; a text begins after END."""
    return np.append(vocabulary.of(np.array([END]))[0], c[:-1])


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of the pairs of a word outside the head, as pmod() of the hash."""
    return h.view(np.int64) % np.int64(buckets)


def _facts(shared, buckets: int):
    """Rows (kind, doc_id, a, b, x). 0: counts of a pair of hot words; 1: a word outside the head; 2: sums of a row; 3: a
    word outside the head whose counts are needed in another one's bucket."""

    def rows(kind, doc_id, a, b, x):
        n = len(a)
        full = lambda v, t: pa.array(np.broadcast_to(np.asarray(v), n).astype(t))
        return pa.RecordBatch.from_arrays([full(kind, np.int32), full(doc_id, np.int64), full(a, np.int64), full(b, np.int64), full(x, np.float64)], ["kind", "doc_id", "a", "b", "x"])

    def run(batches):
        voc = shared.value
        hot = np.zeros((2, HOT * HOT), np.int64)
        logs = np.log10(voc.n + 1)
        for batch in batches:
            for part in slices(batch):
                h, doc, counts = tokens(part)
                ids, folds = part.column("doc_id").to_numpy(zero_copy_only=False), part.column("fold").to_numpy(zero_copy_only=False)
                c = voc.of(h)
                v = _pairs(voc, c)
                both = (c > 0) & (c <= HOT) & (v > 0) & (v <= HOT)
                cell, f = ((v - 1) * HOT + c - 1)[both], folds[doc[both]]
                for k in (0, 1):
                    hot[k] += np.bincount(cell[f > k], minlength=HOT * HOT)
                own = c > 0
                base = np.bincount(doc[own], logs[c[own]], len(ids))
                yield rows(2, ids, counts, np.bincount(doc[own & (voc.n[c] > 0)], minlength=len(ids)), base)
                rare = np.flatnonzero(~own)
                if len(rare):
                    order = rare[np.lexsort((h[rare], doc[rare]))]
                    new = np.flatnonzero(np.append(True, (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])))
                    yield rows(1, ids[doc[order][new]], h[order][new].view(np.int64), np.diff(np.append(new, len(order))), 0)
                    after = rare[v[rare] == 0]
                    word, bucket = np.append(END, h[:-1])[after], _bucket(h[after], buckets)
                    order = np.lexsort((bucket, word))
                    word, bucket = word[order], bucket[order]
                    new = np.append(True, (word[1:] != word[:-1]) | (bucket[1:] != bucket[:-1]))[: len(word)]
                    yield rows(3, 0, word[new].view(np.int64), bucket[new], 0)
        cells = np.flatnonzero(hot[0])
        if len(cells):
            yield rows(0, hot[1][cells], cells, hot[0][cells], 0)

    return run


def _squeezed(values: list[np.ndarray], dtype) -> pa.Array:
    """A binary column of number arrays, compressed."""
    press = zstandard.ZstdCompressor(level=1)
    return pa.array([press.compress(np.ascontiguousarray(v, dtype).tobytes()) for v in values], pa.binary())


def _plain(value: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(value), dtype)


def _rows(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _postings(shared, buckets: int):
    """Rows (bucket, slice, v, w, n, doc, times, ids, folds, tail): pairs of a slice of documents, who has them how often, and
    the words outside the head. A row names only the documents that it has pairs of. Pairs with such a word go to its bucket (the second one's, if both are), others by their codes."""

    def send(parts) -> pa.RecordBatch:
        voc = shared.value
        ids, folds = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
        offsets = np.cumsum([0, *(len(p[2]) for p in parts[:-1])])
        doc = np.concatenate([p[1] + o for p, o in zip(parts, offsets, strict=True)])
        words, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        codes = voc.of(words)
        order = np.argsort(np.where(codes > 0, codes, TAIL), kind="stable")
        words, codes, place = words[order], codes[order].astype(np.uint32), np.empty(len(order), np.uint64)
        place[order] = np.arange(len(order), dtype=np.uint64)
        after = place[at]  # texts end with END, so that the last word of the slice is the one before the first
        pairs, pair = np.unique((np.roll(after, 1) << np.uint64(32)) | after, return_inverse=True)
        both, times = np.unique((pair.astype(np.uint64) << np.uint64(32)) | doc.astype(np.uint64), return_counts=True)
        pair, doc = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64((1 << 32) - 1)).astype(np.uint32)
        v, w = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64((1 << 32) - 1)).astype(np.int64)
        cv, cw = codes[v], codes[w]
        hot = (cv > 0) & (cv <= HOT) & (cw > 0) & (cw <= HOT)
        bucket = (mix((cv.astype(np.uint64) << np.uint64(32)) | cw) % np.uint64(buckets)).astype(np.int64)
        rare = (cv == 0) | (cw == 0)
        bucket[rare] = _bucket(words[np.where(cw == 0, w, v)[rare]], buckets)
        bucket[hot] = -1 - int(mix(ids[:1].astype(np.int64).view(np.uint64))[0] % np.uint64(buckets))
        bucket = bucket[pair]
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
        columns: list[list] = [[] for _ in range(9)]
        first_rare = int(np.searchsorted(codes == 0, True))
        for own in np.split(order, edges[1:]):
            new = np.flatnonzero(np.append(True, pair[own][1:] != pair[own][:-1]))
            x, y = v[pair[own[new]]], w[pair[own[new]]]
            tail = np.unique(np.concatenate([x[x >= first_rare], y[y >= first_rare]]))
            x, y = (np.where(k < first_rare, codes[k], TAIL + np.searchsorted(tail, k)).astype(np.uint32) for k in (x, y))
            here, of = np.unique(doc[own], return_inverse=True)
            values = (bucket[own[0]], np.diff(x, prepend=np.uint32(0)), y, np.diff(np.append(new, len(own))), of, times[own], np.diff(ids[here], prepend=0), folds[here], words[tail])
            for c, column in zip(columns, values, strict=True):
                c.append(column)
        kinds = (np.uint32,) * 5 + (np.int64, np.uint8, np.uint64)
        key = np.bitwise_xor.reduce(mix(ids.view(np.uint64) + np.arange(len(ids), dtype=np.uint64))).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array([key] * len(edges), pa.int64()), *(_squeezed(c, k) for c, k in zip(columns[1:], kinds, strict=True))], ["bucket", "slice", "v", "w", "n", "doc", "times", "ids", "folds", "tail"])

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for part in slices(batch):
                h, doc, _ = tokens(part)
                parts.append((h, doc, part.column("doc_id").to_numpy(zero_copy_only=False), part.column("fold").to_numpy(zero_copy_only=False)))
                size += len(h)
                if size >= SEND:
                    yield send(parts)
                    parts, size = [], 0
        if parts:
            yield send(parts)

    return run


POSTINGS = "bucket int, slice long, v binary, w binary, n binary, doc binary, times binary, ids binary, folds binary, tail binary"
COUNTED = f"{POSTINGS}, c binary, m binary, tail_n binary, tail_m binary"


def _row(row: dict) -> dict:
    """The arrays of a row of postings."""
    out = {k: _plain(row[k], np.uint32) for k in ("v", "w", "n", "doc", "times")} | {"folds": _plain(row["folds"], np.uint8)}
    out["v"] = np.cumsum(out["v"], dtype=np.uint32)
    out["ids"] = np.cumsum(_plain(row["ids"], np.int64))
    out["of"] = np.repeat(np.arange(len(out["v"])), out["n"])
    return out


def _local(x: dict, least: int) -> np.ndarray:
    """How often each pair of a row occurs in its documents of a fold number of at least least."""
    known = x["folds"][x["doc"]] >= least
    return np.bincount(x["of"][known], x["times"][known], len(x["v"])).astype(np.int64)


def _counted(table: pa.Table, counts: pa.Table) -> pa.Table:
    """Adds each pair's counts over the whole bucket, c (all training documents) and m (those of the mixing fold), and
    those of the words outside the head, from counts (bucket, word, n, mixing)."""
    if not len(table) or table.column("bucket")[0].as_py() < 0:
        for name in ("c", "m", "tail_n", "tail_m"):
            table = table.append_column(name, pa.array([b""] * len(table), pa.binary()))
        return table
    xs = [_row(r) for r in _rows(table.to_batches())]
    tails = [_plain(t, np.uint64) for t in table.column("tail").to_pylist()]
    words, place = np.unique(np.concatenate(tails), return_inverse=True)
    place = np.split(place, np.cumsum([len(t) for t in tails])[:-1])

    def codes(x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Codes with places among the bucket's words."""
        out, rare = x.astype(np.uint64), x >= TAIL
        out[rare] = TAIL + own[x[rare] - np.uint32(TAIL)]
        return out

    keys = np.concatenate([(codes(x["v"], p) << np.uint64(32)) | codes(x["w"], p) for x, p in zip(xs, place, strict=True)])
    _, at = np.unique(keys, return_inverse=True)
    c, m = (np.bincount(at, np.concatenate([_local(x, k) for x in xs])).astype(np.int64)[at] for k in (1, 2))
    edges = np.cumsum([len(x["v"]) for x in xs])[:-1]
    own = np.zeros((2, len(words)), np.int64)
    if len(words) and len(counts):
        known, first = np.unique(counts.column("word").to_numpy().view(np.uint64), return_index=True)
        where = np.minimum(np.searchsorted(known, words), len(known) - 1)
        for k, name in enumerate(("n", "mixing")):
            own[k] = np.where(known[where] == words, counts.column(name).to_numpy()[first][where], 0)
    for name, values in (("c", np.split(c, edges)), ("m", np.split(m, edges)), ("tail_n", [own[0][p] for p in place]), ("tail_m", [own[1][p] for p in place])):
        table = table.append_column(name, _squeezed(values, np.int64))
    return table


def _with_counts(row: dict, voc: Vocabulary, hot: np.ndarray) -> dict:
    """The arrays of a row, with counts of its pairs (c, m), first words (cv, mv) and second words (cw, mw)."""
    x = _row(row)
    if row["bucket"] < 0:
        cell = (x["v"].astype(np.int64) - 1) * HOT + x["w"] - 1
        x["c"], x["m"] = hot[0][cell], hot[1][cell]
    else:
        x["c"], x["m"] = _plain(row["c"], np.int64), _plain(row["m"], np.int64)
    for side in ("v", "w"):
        rare = x[side] >= TAIL
        for name, head, tail in (("c", voc.n, "tail_n"), ("m", voc.mixing, "tail_m")):
            counts = head[np.where(rare, 0, x[side])]
            if rare.any():
                counts[rare] = _plain(row[tail], np.int64)[x[side][rare] - np.uint32(TAIL)]
            x[name + side] = counts
    return x


def _level(n: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency: 0 for none, else one more than the power of two."""
    return np.where(n > 0, np.floor(np.log2(np.maximum(n, 1))).astype(np.int64) + 1, 0)


def _ratio(a, b):
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


STEPS = 400


def _step(p: np.ndarray) -> np.ndarray:
    """log10 probability in steps; STEPS stands for none."""
    return np.where(p > 0, np.clip(np.round(-GRID * np.log10(np.maximum(p, 1e-300))), 0, STEPS - 1), STEPS).astype(np.int64)


def _held_out_table(shared, hot_counts):
    """Rows (cell, n): the mixing fold's pairs by context level and the steps of both estimates without that fold."""

    def run(batches):
        voc, hot = shared.value, hot_counts.value
        for row in _rows(batches):
            x = _with_counts(row, voc, hot)
            local = _local(x, 2)
            some = local > 0
            context = (x["cv"] - x["mv"])[some]
            p2 = _ratio((x["c"] - x["m"])[some], context)
            p1 = (x["cw"] - x["mw"])[some] / max(voc.total - voc.total_mixing, 1)
            cell = (_level(context) * (STEPS + 1) + _step(p2)) * (STEPS + 1) + _step(p1)
            keys, at = np.unique(cell, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(at, local[some], len(keys)).astype(np.int64))], ["cell", "n"])

    return run


def mixed(cells: np.ndarray, n: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each context level, by expectation-maximisation."""
    weights = np.tile([0.4, 0.5, 0.1], (64, 1))
    weights[0] = [0, 0.9, 0.1]
    steps = lambda s: np.where(s == STEPS, 0, 10.0 ** (-s / GRID))
    level = cells // (STEPS + 1) ** 2
    p = np.stack([steps(cells // (STEPS + 1) % (STEPS + 1)), steps(cells % (STEPS + 1)), np.full(len(cells), uniform)], 1)
    for _ in range(rounds if len(cells) else 0):
        share = weights[level] * p
        share *= (n / np.maximum(share.sum(1), 1e-300))[:, None]
        sums = np.stack([np.bincount(level, share[:, k], 64) for k in range(3)], 1) + [1e-9, 1e-6, 1e-3]
        seen = np.bincount(level, n, 64) > 0
        weights[seen] = (sums / sums.sum(1, keepdims=True))[seen]
    return weights


def _scores(shared, hot_counts, weights: np.ndarray):
    """Rows (slice, ids, logs): sums of a slice's documents over the pairs of a row."""

    def run(batches):
        voc, hot = shared.value, hot_counts.value
        uniform = 1 / (voc.types + 1)
        for row in _rows(batches):
            x = _with_counts(row, voc, hot)
            mix_ = weights[_level(x["cv"])]
            p = mix_[:, 0] * _ratio(x["c"], x["cv"]) + mix_[:, 1] * x["cw"] / max(voc.total, 1) + mix_[:, 2] * uniform
            logs = np.bincount(x["doc"], np.log10(p)[x["of"]] * x["times"], len(x["ids"]))
            yield pa.RecordBatch.from_arrays([pa.array([row["slice"]], pa.int64()), pa.array([row["ids"]], pa.binary()), packed([logs], np.float64)], ["slice", "ids", "logs"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    """(doc_id, score) of one slice of documents."""
    ids = np.concatenate([np.cumsum(_plain(x, np.int64)) for x in table.column("ids").to_pylist()])
    keys, at = np.unique(ids, return_inverse=True)
    return pa.table([pa.array(keys), pa.array(np.bincount(at, unpacked(table.column("logs"), np.float64), len(keys)))], ["doc_id", "score"])


def scored(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, a row for each row of docs.

    A null or empty text is one end token. Rows that share a doc_id get the means of their figures (their own, where
    the texts are equal); rows without doc_id count as such. Without training rows all counts are 0 and the model is
    uniform. Other columns are ignored; an empty table gives no rows."""
    spark = docs.sparkSession
    part = fold(F.col("doc_id"), FOLDS)
    folds = F.when(part == HELD_OUT, 0).when(part == MIXING, 2).otherwise(1)
    docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", folds.cast("byte").alias("fold"))

    words = docs.select("text", "fold").mapInArrow(_unigrams, "word long, n long, mixing long")
    words = stored(words.groupBy("word").agg(F.sum("n").alias("n"), F.sum("mixing").alias("mixing")), "words")
    total, total_mixing, types = (x or 0 for x in words.agg(F.sum("n"), F.sum("mixing"), F.count("*")).first())
    # how many words have each count, by its first four digits: the head takes the commonest counts that fit whole
    digits = F.expr("n - n % cast(pow(10, greatest(length(cast(n as string)) - 4, 0)) as bigint)")
    counts = sorted(((r["k"], r["words"]) for r in words.groupBy(digits.alias("k")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, size = 1 << 62, 0
    for k, n in counts:
        if size + n > head:
            break
        least, size = k, size + n
    voc = Vocabulary(words.where(F.col("n") >= least).select("word", "n", "mixing").toArrow(), total, total_mixing, types)
    shared = spark.sparkContext.broadcast(voc)

    buckets = max(BUCKETS, -(-total // BUCKET_TOKENS))
    facts = stored(docs.mapInArrow(_facts(shared, buckets), "kind int, doc_id long, a long, b long, x double"), "facts")
    hot = np.zeros((2, HOT * HOT), np.int64)
    table = facts.where("kind = 0").groupBy("a").agg(F.sum("b").alias("n"), F.sum("doc_id").alias("mixing")).toArrow()
    for k, c in enumerate(("n", "mixing")):
        hot[k][table.column("a").to_numpy()] = table.column(c).to_numpy()

    tail = words.where(F.col("n") < least).select("word", "n", "mixing")
    needed = facts.where("kind = 3").select(F.col("b").cast("int").alias("bucket"), F.col("a").alias("word")).distinct()
    needed = needed.join(tail.hint("shuffle_merge"), "word").select("bucket", "word", "n", "mixing")
    counts = tail.select(F.pmod("word", F.lit(buckets)).cast("int").alias("bucket"), "word", "n", "mixing").union(needed)
    postings = docs.mapInArrow(_postings(shared, buckets), POSTINGS)
    postings = stored(postings.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(_counted, COUNTED), "postings")
    hot = spark.sparkContext.broadcast(hot)
    cells = postings.mapInArrow(_held_out_table(shared, hot), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    weights = mixed(cells.column("cell").to_numpy(), cells.column("n").to_numpy(), 1 / (types + 1))

    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    names = ("rows", "n_tokens", "n_known", "base", "score")
    row = lambda df, *c: df.select("doc_id", *[x.alias(n) for x, n in zip(c, names, strict=True)])
    own = row(facts.where("kind = 2"), F.lit(1).cast("long"), F.col("a"), F.col("b"), F.col("x"), none)
    rare = facts.where("kind = 1").join(words.select(F.col("word").alias("a"), F.col("n").alias("c")).hint("shuffle_merge"), "a", "left").withColumn("c", F.coalesce("c", zero))
    logs = F.col("b") * F.log10(F.col("c") + 1)
    rare = row(rare, zero, zero, F.when(F.col("c") > 0, F.col("b")).otherwise(zero), logs, none)
    pairs = postings.mapInArrow(_scores(shared, hot, weights), "slice long, ids binary, logs binary")
    pairs = pairs.groupBy("slice").applyInArrow(_summed, "doc_id long, score double")
    pairs = row(pairs, zero, zero, zero, none, F.col("score"))
    sums = own.union(rare).union(pairs).groupBy("doc_id").agg(*[F.sum(n).alias(n) for n in names])
    each = lambda c: (F.col(c) / F.col("rows"))
    # as many rows as there were, a few thousand at once: very many may have no doc_id
    some = F.expr("explode(sequence(0, (rows - 1) div 4096))")
    out = sums.withColumn("thousand", some).withColumn("copy", F.expr("explode(sequence(1, least(4096, rows - thousand * 4096)))"))
    id_ = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    out = out.select(
        id_.alias("doc_id"),
        (fold(id_, FOLDS) == HELD_OUT).alias("held_out"),
        each("n_tokens").cast("long").alias("n_tokens"),
        each("n_known").cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (each("base") - each("n_tokens") * float(np.log10(total + types + 1))).alias("base_score"),
        each("score").alias("score"),
    )
    out = stored(out, "scores")
    for table in (words, facts, postings):
        dropped(table)
    for value in (shared, hot):
        value.unpersist()
    return out


def brute_base(rows: list[tuple[int, str | None]]) -> list[tuple[int, bool, int, int, int, float]]:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score with dictionaries."""
    import math
    import re
    import zlib
    from collections import Counter

    cut = [(i, zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT, [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]) for i, t in rows]
    c = Counter(w for _, held, ws in cut if not held for w in ws)
    total = sum(c.values())
    return [(i, held, len(ws), sum(c[w] > 0 for w in ws), total, sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in ws)) for i, held, ws in cut]


def brute_scores(rows: list[tuple[int, str | None]]) -> list[float]:
    """The score of each row with dictionaries of all counts."""
    import math
    import re
    import zlib
    from collections import Counter

    cut = []
    for i, t in rows:
        words = [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
        cut.append((zlib.crc32(str(i).encode()) % FOLDS, list(zip([None, *words[:-1]], words, strict=True))))
    known = lambda folds: Counter(p for part, ps in cut if part in folds for p in ps)
    training = set(range(FOLDS)) - {HELD_OUT}
    every, mixing, rest = known(training), known({MIXING}), known(training - {MIXING})
    single = lambda pairs: Counter(dict_sum((w, n) for (_, w), n in pairs.items()))
    one, rest_one = single(every), single(rest)
    total, rest_total = sum(one.values()), sum(rest_one.values())
    level = lambda n: int(math.log2(n)) + 1 if n else 0
    step = lambda p: int(_step(np.array([p]))[0])
    cells = Counter(dict_sum(((((level(rest_one[v]) * (STEPS + 1)) + step(rest[v, w] / rest_one[v] if rest_one[v] else 0)) * (STEPS + 1) + step(rest_one[w] / max(rest_total, 1))), n) for (v, w), n in mixing.items()))
    uniform = 1 / (len(one) + 1)
    keys = sorted(cells)
    weights = mixed(np.array(keys, np.int64), np.array([cells[k] for k in keys], np.int64), uniform)
    out = []
    for _, pairs in cut:
        score = 0.0
        for v, w in pairs:
            a, b, c = weights[level(one[v])]
            score += math.log10(a * (every[v, w] / one[v] if one[v] else 0) + b * one[w] / max(total, 1) + c * uniform)
        out.append(score)
    return out


def dict_sum(pairs) -> dict:
    out: dict = {}
    for k, n in pairs:
        out[k] = out.get(k, 0) + n
    return out
