"""Benchmark decontamination by winnowing.

Of every document and benchmark item the least 5-gram hash of each 6 consecutive ones is kept. Spans of 10
shared words hold 6 consecutive 5-grams, so both sides keep the same one of them: joining the fingerprints
and extending each hit finds every shared span of at least 10 words, and nothing but windows whose 64-bit hashes are
equal over all 10 words. Items shorter than that guarantee are looked up whole, at every place, likewise."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, Words, isin_sorted, mix, ngrams, releasing, slices, unpacked, within
from .names import own, plain
from .store import dropped, stored

SPAN, GRAM = 10, 5
WINDOW = SPAN - GRAM + 1
#: Benchmark text that is broadcast at once; more goes over the documents in further blocks.
BLOCK_BYTES = 32 << 20
#: What an item's id counts for in a block.
ID_BYTES = 32
#: (document, text) pairs that are put together at once.
AT_ONCE = 1 << 20


def winnowed(grams: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of the last least gram of every window of WINDOW grams that lies in one document."""
    size = len(grams) - WINDOW + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    least, at = grams[:size].copy(), np.arange(size)
    for k in range(1, WINDOW):
        nearer = grams[k : k + size] <= least
        at[nearer] = np.arange(size)[nearer] + k
        least[nearer] = grams[k : k + size][nearer]
    return np.unique(at[doc[:size] == doc[SPAN - 1 : SPAN - 1 + size]])


def _texts_of(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different keys in order, the set of texts of each, and the sets: where each begins and their texts.

    Keys with the same texts have the same set; sets are told apart by 64-bit sums of hashes."""
    order = np.lexsort((text, keys))
    keys, text = keys[order], text[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])) if len(keys) else np.zeros(0, bool)
    keys, text = keys[new], text[new]
    different, first, size = np.unique(keys, return_index=True, return_counts=True)
    sums = np.add.reduceat(mix(text.astype(np.uint64) + np.uint64(1)), first) if len(first) else np.zeros(0, np.uint64)
    _, one, which = np.unique(sums, return_index=True, return_inverse=True)
    begin = np.append(0, np.cumsum(size[one]))
    return different, which, begin, text[_ranges(first[one], size[one])]


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of ranges, one after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Index:
    """Fingerprints and windows of a block of different benchmark texts, and the texts that each window is in.

    A window that occurs a thousand times in a text, or in a thousand texts, is there once, with the set of its texts."""

    def __init__(self, items: pa.Table):
        column = items.column("text").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        self.ids = items.column("ids").to_pylist()
        words = Words(column, ALNUM, lower=True)
        hashes, doc = words.hashes(), words.doc
        self.prints = np.unique((grams := ngrams(hashes, GRAM))[winnowed(grams, doc)])
        whole = within(doc, SPAN)
        #: By length of window: different windows, their sets, and the sets' texts.
        self.windows = {SPAN: _texts_of(ngrams(hashes, SPAN)[whole], doc[: len(whole)][whole])}
        for n in np.unique(words.counts[(words.counts > 0) & (words.counts < SPAN)]).tolist():
            own = np.flatnonzero(words.counts == n)
            self.windows[n] = _texts_of(ngrams(hashes, n)[words.first[own]], own)

    def hits(self, words: Words) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(places, length, sets): windows of documents that are windows of items, each place once."""
        hashes, doc = words.hashes(), words.doc
        for n, (windows, which, _, _) in self.windows.items():
            inside = within(doc, n)
            if n == SPAN:  # a fingerprint that both sides keep is extended to every window that it lies in
                grams = ngrams(hashes, GRAM)
                at = winnowed(grams, doc)
                at = at[isin_sorted(grams[at], self.prints)[0]]
                places = np.unique((at[:, None] - np.arange(WINDOW)).ravel())
                places = places[(places >= 0) & (places < len(inside))]
                places = places[inside[places]]
            else:
                places = np.flatnonzero(inside)
            found, k = isin_sorted(ngrams(hashes, n)[places], windows)
            yield places[found], n, which[k[found]]

    def texts(self, n: int, doc: np.ndarray, sets: np.ndarray) -> np.ndarray:
        """Different (document, text) of documents and the sets found in them, put together in pieces of bounded size."""
        _, _, begin, text = self.windows[n]
        pairs = np.unique(np.stack([doc, sets], 1), axis=0)
        size = begin[pairs[:, 1] + 1] - begin[pairs[:, 1]]
        done, at, total = np.zeros((0, 2), np.int64), 0, np.append(0, np.cumsum(size))
        while at < len(pairs):
            to = max(at + 1, int(np.searchsorted(total, total[at] + AT_ONCE, "right")) - 1)
            new = np.stack([np.repeat(pairs[at:to, 0], size[at:to]), text[_ranges(begin[pairs[at:to, 1]], size[at:to])]], 1)
            done, at = np.unique(np.concatenate([done, new]), axis=0), to
        return done


def _block(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), ALNUM, lower=True)
                doc, hit = words.doc, np.zeros(words.n + 1, np.int64)
                pairs = [np.zeros((0, 2), np.int64)]
                for places, n, sets in index.hits(words):
                    np.add.at(hit, places, 1)
                    np.subtract.at(hit, places + n, 1)
                    pairs.append(index.texts(n, doc[places], sets))
                hit = np.cumsum(hit)[:-1] > 0
                pairs = np.unique(np.concatenate(pairs), axis=0)
                edges = np.searchsorted(pairs[:, 0], np.arange(words.docs + 1))
                before_hits, before_items = (c.to_pylist() for c in part.columns[-2:])
                hits, items = [], []
                for k in range(words.docs):
                    here = np.flatnonzero(hit[words.first[k] : words.first[k + 1]]).astype(np.int32)
                    got = {i for text in pairs[edges[k] : edges[k + 1], 1] for i in index.ids[text]}
                    if before_hits[k]:
                        here = np.union1d(here, np.frombuffer(before_hits[k], np.int32))
                    hits.append(here.astype(np.int32).tobytes())
                    items.append(sorted(got | set(before_items[k] or ())))
                found = [pa.array(words.counts, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-3], *found], part.schema.names)

    return run


NAMES = ("n_words", "hits", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, keep: Sequence[str] = ("doc_id", "text"), names: Sequence[str] = NAMES) -> DataFrame:
    """Words of each document that lie in a 10-word window of a benchmark item (or in a whole shorter one).

    Returns the columns keep (text among them) and then, under names that keep has not, n_words, hits (packed int32
    places of hit words) and items (ids as sorted strings), a row for each row of docs. Null and empty texts have no words
    and no hits; empty items match nothing; items of equal text are indexed once and all count; items of equal id are one;
    an item without id hits but is not listed; other columns of either table are ignored. No benchmark: no hits.
    Blocks of about block_bytes of different benchmark texts and ids are broadcast, one after the other; a single text
    may be larger. What one block finds is a table that the next one reads, so that one index at a time is held."""
    spark = docs.sparkSession
    pairs = stored(benchmark.where("text <> ''").select(F.col("item_id").cast("string").alias("id"), "text").distinct(), "benchmark")
    total = ID_BYTES * pairs.count() + (pairs.select("text").distinct().agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    blocks = 1 if total <= block_bytes else int(2 * total // block_bytes + 1)  # half full, as a hash deals them
    # the ids of a text that very many items share go into several blocks
    part = F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(blocks)).alias("part")
    items = stored(pairs.groupBy("text", part).agg(F.collect_set("id").alias("ids")), "items")
    out = plain(docs.select(*map(own, keep))).select("*", *(F.lit(None).cast(t).alias(n) for n, t in zip(NAMES, ("long", "binary", "array<string>"), strict=True)))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("text", "part"), F.lit(blocks)) == k) if blocks > 1 else items
        shared = spark.sparkContext.broadcast(Index(block.toArrow()))
        found = out.mapInArrow(releasing(_block(shared)), out.schema)
        if blocks > 1:
            before, found = out, stored(found, "hits")
            shared.destroy()
            if k:
                dropped(before)
        out = found
    for table in (pairs, items):
        dropped(table)
    return out.toDF(*keep, *names)


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of contamination()."""
    return found.select(
        "doc_id",
        "n_words",
        (F.octet_length("hits") / 4).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.octet_length("hits") > 0).alias("contaminated"),
    )


def hit_places(hits: bytes) -> np.ndarray:
    return unpacked(pa.array([hits], pa.binary()), np.int32)


def brute_force(text: str | None, items: list[tuple[object, str | None]]) -> tuple[int, int, int, str, bool]:
    """n_words, n_hit, n_items, items_sha256, contaminated of one document, by trying every window."""
    import re

    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    words, hit, ids = cut(text), set(), set()
    for item, t in items:
        own = cut(t)
        n = min(SPAN, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                ids.add(str(item))
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)
