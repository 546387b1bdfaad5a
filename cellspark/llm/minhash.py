"""Near duplicates by b-bit MinHash.

Every document's set of 5-word shingles gets 125 minima. Full minima, five at a time, make 25 band keys for
candidates; of each minimum only the low 4 bits are kept, packed, to estimate the similarity of a candidate pair
from bit counts, corrected for chance collisions. What may reach the threshold is confirmed on the full sets.

Equal sets are one node from the start. In each bucket, nodes whose estimates reach the threshold are first joined
by as few pairs as it takes; the confirmed ones give components. A large bucket is cut into blocks for that, which share
some nodes, so that its rows grow with its nodes and not with their square. Then, in buckets that still hold several
components, all nodes of different components that may be linked are compared on their full sets within the bucket,
each pair in the first bucket that it shares; what comes out are only as many links as join them. The nodes of a
bucket's largest component are compared with the others alone, not among themselves. So neither copies nor candidates
are expanded into rows of pairs, and no link between different texts is lost. "Full sets" are those of 64-bit hashes of
the shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import NOT_SPACE, Words, isin_sorted, mix, ngrams, packed, releasing, slices, within
from .components import components
from .store import dropped, few, stored, with_facts

WORDS, BANDS, ROWS, BITS = 5, 25, 5, 4
HASHES = BANDS * ROWS
#: A pair is confirmed on full sets if its estimate is within 4.5 standard deviations of the threshold.
MARGIN = 0.15
#: Nodes of a bucket that are compared at once, and their shingles; larger buckets are cut into blocks.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: Nodes of a large bucket that all its blocks share, about.
PIVOTS = 16
#: Full sets that one is compared with at once.
AT_ONCE = 64
#: Jaccard threshold as the contract states it: 100 * intersection >= 85 * union.
PER_CENT = 85


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and where each one's begin."""
    words = Words(column, NOT_SPACE, lower=True)
    h, doc = words.hashes(), words.doc
    inside = within(doc, WORDS)
    keys, docs = [ngrams(h, WORDS)[inside]], [doc[: len(inside)][inside]]
    for n in range(1, WORDS):  # fewer words: the whole sequence
        own = np.flatnonzero(words.counts == n)
        if len(own):
            keys.append(ngrams(h, n)[words.first[own]])
            docs.append(own)
    keys, docs = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((keys, docs))
    keys, docs = keys[order], docs[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1]))[: len(keys)]
    keys, docs = keys[new], docs[new]
    return keys, np.searchsorted(docs, np.arange(words.docs + 1))


def _factors(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * hashes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:hashes] | np.uint64(1), seeds[hashes:]


def minima(keys: np.ndarray, first: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """So many minima of each set that is not empty."""
    full = first[:-1][np.diff(first) > 0]
    out = np.empty((len(full), hashes), np.uint64)
    if len(full):
        for k, (a, b) in enumerate(zip(*_factors(hashes), strict=True)):
            x = keys * a + b
            x ^= x >> np.uint64(32)
            out[:, k] = np.minimum.reduceat(x, full)
    return out


def low_bits(mins: np.ndarray) -> np.ndarray:
    """Rows of packed low BITS of the minima."""
    bits = (mins[:, :, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).reshape(len(mins), -1), axis=1)


def estimate(a: np.ndarray, b: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """Similarity from packed signatures: share of equal values, less what chance makes equal."""
    x = a ^ b
    shift = BITS // 2
    while shift:
        x = x | (x >> np.uint8(shift))
        shift //= 2
    ones = np.uint8(sum(1 << k for k in range(0, 8, BITS)))
    share = 1 - np.bitwise_count(x & ones).sum(-1) / hashes
    chance = 2.0**-BITS
    return (share - chance) / (1 - chance)


def signatures(docs: DataFrame, n_bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, digest (of the set), bands (longs), bits (packed low bits); null digest, bands and bits for empty sets."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                keys, first = shingles(part.column("text"))
                n = np.diff(first)
                full = np.flatnonzero(n)
                mins = minima(keys, first, n_bands * ROWS)
                bands = np.zeros((len(mins), n_bands), np.uint64)
                for k in range(ROWS):
                    bands = bands * np.uint64(0xD6E8FEB86659FD93) + mins[:, k::ROWS]
                bands = mix(bands + np.arange(n_bands, dtype=np.uint64)).view(np.int64)
                sums = [np.add.reduceat(mix(keys + np.uint64(s)), first[:-1][full]) for s in (1, 2)] if len(full) else [np.zeros(0, np.uint64)] * 2
                digest, bits = np.stack(sums, 1), low_bits(mins)
                columns: list[list] = [[None] * part.num_rows for _ in range(3)]
                for at, k in enumerate(full):
                    columns[0][k], columns[1][k], columns[2][k] = digest[at].tobytes(), bands[at].tolist(), bits[at].tobytes()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.list_(pa.int64())), pa.array(columns[2], pa.binary())], ["doc_id", "n_shingles", "digest", "bands", "bits"])

    return docs.select("doc_id", "text").mapInArrow(releasing(run), "doc_id long, n_shingles long, digest binary, bands array<long>, bits binary")


def _matrix(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _confirmed(per_cent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a_set").to_pylist(), batch.column("b_set").to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= per_cent * (len(x) + len(y) - both))
            out = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([out.column("a"), out.column("b")], ["a", "b"])

    return run


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The full shingle sets of the documents with the wanted doc_id."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                keys, first = shingles(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), packed(np.split(keys, first[1:-1]), np.uint64)], ["doc_id", "set"])

    return docs.select("doc_id", "text").join(wanted.distinct().hint("shuffle_merge"), "doc_id", "left_semi").mapInArrow(releasing(run), "doc_id long, set binary")


def _links(docs: DataFrame, near: DataFrame, per_cent: int) -> DataFrame:
    """Those of the candidate pairs (a < b) that are links, confirmed on full sets."""
    sets = stored(_sets(docs, near.select(F.explode(F.array("a", "b")).alias("doc_id"))), "sets")
    full = near.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("a_set")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("b_set")), "b")
    links = stored(full.select("a", "b", "a_set", "b_set").mapInArrow(_confirmed(per_cent), "a long, b long"), "links")
    dropped(sets)
    return links


class Blocks:
    """Two blocks of a bucket's nodes, or one: which pairs of different components may be links."""

    def __init__(self, table: pa.Table, least: float, per_cent: int):
        self.id, component, block, self.n = (table.column(c).to_numpy() for c in ("doc_id", "component", "block", "n_shingles"))
        self.bits, self.bands = _matrix(table.column("bits")), np.array(table.column("bands").to_pylist(), np.int64)
        self.key, i, j = (table.column(c)[0].as_py() for c in ("key", "i", "j"))
        self.left, self.right, self.same = np.flatnonzero(block == i), np.flatnonzero(block == j), i == j
        self.component = np.unique(component, return_inverse=True)[1]
        self.least, self.per_cent = least, per_cent

    def partners(self, x: int, once: bool) -> np.ndarray:
        """Nodes of other components whose size and estimate allow a link with x, the likeliest first. With once,
        only those that share no earlier band with x, so that all buckets together have each pair one time."""
        right = self.right
        sizes = np.minimum(self.n[right], self.n[x]) * 100 >= self.per_cent * np.maximum(self.n[right], self.n[x])
        right = right[(self.component[right] != self.component[x]) & sizes & (self.id[right] > self.id[x] if self.same else self.id[right] != self.id[x])]
        likely = estimate(self.bits[x], self.bits[right], self.bands.shape[1] * ROWS)
        order = np.argsort(-likely, kind="stable")
        right = right[order[likely[order] >= self.least]]
        if once and len(right):
            right = right[self.bands[x][(self.bands[right] == self.bands[x]).argmax(1)] == self.key]
        return right

    def join(self, x: int, others: np.ndarray) -> np.ndarray:
        """Those of others, one of each component, that tie x to components that it wasn't in; they are one from now on."""
        others = others[np.unique(self.component[others], return_index=True)[1]]
        self.component[np.isin(self.component, self.component[others])] = self.component[x]
        return others


def _pairs(id_: np.ndarray, found: list[tuple[int, np.ndarray]]) -> pa.Table:
    a = np.concatenate([np.zeros(0, np.int64), *(np.minimum(id_[x], id_[others]) for x, others in found)])
    b = np.concatenate([np.zeros(0, np.int64), *(np.maximum(id_[x], id_[others]) for x, others in found)])
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _forest(per_cent: int):
    """As few pairs as join the nodes whose estimates reach the threshold."""

    def run(table: pa.Table) -> pa.Table:
        blocks, found = Blocks(table, per_cent / 100, per_cent), []
        for x in blocks.left:
            if len(others := blocks.partners(x, False)):
                found.append((x, blocks.join(x, others)))
        return _pairs(blocks.id, found)

    return run


def _active(least: float, per_cent: int):
    """The rows of nodes that have a partner to be compared with in full."""

    def run(table: pa.Table) -> pa.Table:
        blocks = Blocks(table, least, per_cent)
        active = np.zeros(table.num_rows, bool)
        for x in blocks.left:
            others = blocks.partners(x, True)
            active[others] = True
            active[x] |= len(others) > 0
        return table.filter(pa.array(active))

    return run


def _compared(least: float, per_cent: int):
    """As few links, confirmed on full sets, as join what is linked."""

    def run(table: pa.Table) -> pa.Table:
        blocks, found = Blocks(table, least, per_cent), []
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        for x in blocks.left:
            others = blocks.partners(x, True)
            for at in range(0, len(others), AT_ONCE):
                some = others[at : at + AT_ONCE]
                some = some[blocks.component[some] != blocks.component[x]]
                if not len(some):
                    continue
                size = np.array([len(sets[k]) for k in some])
                shared = isin_sorted(np.concatenate([sets[k] for k in some]), sets[x])[0]
                both = np.add.reduceat(shared.astype(np.int64), np.cumsum(size) - size)
                some = some[100 * both >= per_cent * (len(sets[x]) + size - both)]
                if len(some):
                    found.append((x, blocks.join(x, some)))
        return _pairs(blocks.id, found)

    return run


def _size(n: Column, total: Column) -> Column:
    """Blocks of n nodes with total shingles."""
    return F.greatest(F.ceil(n / BLOCK), F.ceil(total / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _shared(nodes: DataFrame, total: int) -> DataFrame:
    """The buckets of two nodes or more: a row (key, doc_id, n_shingles, n, total) for each of their nodes, with the bucket's nodes and shingles. Stored."""
    members = nodes.select(F.explode("bands").alias("key"), "doc_id", "n_shingles")
    facts = stored(few(members.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total")).where("n > 1"), total), "buckets")
    out = stored(few(with_facts(members, facts, "key", "doc_id", total).where("n is not null"), total), "members")
    dropped(facts)
    return out


def _with_signatures(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    return rows.join(nodes.select("doc_id", "bits", "bands", "n_shingles").hint("shuffle_merge"), "doc_id")


def _first_blocks(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes of each block (key, i, j = i) of the buckets. About PIVOTS nodes of a large bucket are in all its blocks."""
    own = shared.withColumn("blocks", _size(F.col("n"), F.col("total")))
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    pivot = F.pmod(F.xxhash64("doc_id", F.lit("pivot")), F.ceil(F.col("n") / PIVOTS)) == 0
    own = own.withColumn("i", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))))
    return _with_signatures(own.select("key", "i", F.col("i").alias("j"), "doc_id", F.col("doc_id").alias("component"), F.col("i").alias("block")), nodes)


def _blocks(shared: DataFrame, stars: DataFrame, nodes: DataFrame, total: int) -> tuple[DataFrame, list[DataFrame]]:
    """The nodes of each two blocks (key, i, j) of the buckets whose nodes are of several components, by stars (node,
    component). Blocks from 0 on hold what is not in the bucket's largest component, those from -1 down that one's nodes; two
    of the latter are never paired. Also the stored tables behind it."""
    labelled = shared.select("key", "doc_id", "n_shingles").join(stars.withColumnRenamed("node", "doc_id").hint("shuffle_merge"), "doc_id", "left")
    members = stored(few(labelled.select("key", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component")), total), "labelled")
    each = members.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    facts = each.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", F.col("component").alias("big"), "total")).alias("largest"), F.sum("total").alias("total"), F.count("*").alias("components")).where("components > 1")
    facts = facts.select("key", "n", "largest.big", _size(F.col("largest.n"), F.col("largest.total")).alias("large"), _size(F.col("n") - F.col("largest.n"), F.col("total") - F.col("largest.total")).alias("small"))
    facts = stored(few(facts, total), "buckets")
    own = with_facts(members, facts, "key", "doc_id", total).where("n is not null")
    hash_ = F.xxhash64("doc_id")
    own = own.withColumn("block", F.when(F.col("component") == F.col("big"), -1 - F.pmod(hash_, F.col("large"))).otherwise(F.pmod(hash_, F.col("small"))).cast("int"))
    others = F.when(F.col("block") < 0, F.sequence(F.lit(0), F.col("small") - 1)).otherwise(F.sequence(-F.col("large"), F.col("small") - 1))
    own = own.withColumn("other", F.explode(others))
    return _with_signatures(own.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "component", "block"), nodes), [members, facts]


def linked(docs: DataFrame, per_cent: int = PER_CENT, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, a row for each row of docs.

    Texts without words have an empty set and are linked with nothing; texts of fewer than five words are one shingle.
    Rows that share a doc_id are one node. A row without doc_id is linked with nothing and kept. Other columns are
    ignored; an empty table gives no rows. A lower threshold takes more bands to miss as few links."""
    spark = docs.sparkSession
    found = stored(signatures(docs, bands), "signatures")
    rows = found.count()
    full = found.where("digest is not null and doc_id is not null")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.first("n_shingles").alias("n_shingles"))
    nodes = stored(few(classes, rows), "nodes")

    total = bands * nodes.count()
    shared = _shared(nodes, total)
    pairs = stored(_first_blocks(shared, nodes).groupBy("key", "i", "j").applyInArrow(_forest(per_cent), "a long, b long").distinct().transform(few, total), "pairs")
    first = _links(docs, pairs, per_cent)
    stars = components(first) if first.head(1) else spark.createDataFrame([], "node long, component long")

    least, (rest, tables) = per_cent / 100 - MARGIN, _blocks(shared, stars, nodes, total)
    active = stored(rest.groupBy("key", "i", "j").applyInArrow(_active(least, per_cent), rest.schema), "active")
    for table in (shared, *tables):
        dropped(table)
    sets = stored(_sets(docs, active.select("doc_id")), "sets")
    compared = active.join(sets.hint("shuffle_merge"), "doc_id").groupBy("key", "i", "j").applyInArrow(_compared(least, per_cent), "a long, b long")
    more = stored(few(compared.distinct(), total), "links")
    for table in (active, sets, pairs):
        dropped(table)

    whole = stars
    if more.head(1):
        dropped(stars)
        whole = components(first.union(more))
    # a class has its least document as node: the class's component holds for all its documents
    classes = nodes.select("digest", F.col("doc_id").alias("node")).join(whole.hint("shuffle_merge"), "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = found.select("doc_id", "n_shingles", "digest").join(classes.hint("shuffle_merge"), "digest", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
    out = stored(few(out, rows), "classes")
    for table in (found, nodes, first, more, whole):
        dropped(table)
    return out


def brute_force(rows: list[tuple[int, str | None]], per_cent: int = PER_CENT) -> list[tuple[int, int, int, bool]]:
    """linked() over all pairs of documents."""
    import re

    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k : k + WORDS]) for k in range(max(1, len(w) - WORDS + 1))} if w else set()))
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= per_cent * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return [(i, len(s), find(i), find(i) == i) for i, s in sets]
