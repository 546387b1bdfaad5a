"""Alignment of two tokenizers' ids over the same bytes.

A text with a space before it is encoded by both. Byte offsets where tokens of both end cut the two id lists into groups,
found by intersecting the offsets of the ends; within a group, tokens whose bytes overlap are linked. How often
two ids are linked in all texts is counted, and each text is told how its links stand in these counts."""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import accumulate, chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import isin_sorted, packed, slices, unpacked
from .store import dropped, stored
from .token_count import byte_letters

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Segments, and bytes of them, that a worker remembers.
REMEMBERED, REMEMBERED_BYTES = 500_000, 32 << 20
#: Segments that the first tokenizer encodes at once.
JOINED = 1 << 13
#: Id pairs whose counts are broadcast, those that occur most; links that are counted at once.
HOT, AT_ONCE = 1 << 19, 1 << 21
#: Where a text is cut: before a single space that something else than white space follows. Neither tokenizer has a token
#: across such a place, whatever stands around it (Pieces checks this of its vocabulary), so the ids of a text are those of its segments.
CUT = re.compile(r"(?<! ) (?=\S)")
UNEVEN = re.compile(r" (?:\s|$)")


class Letters:
    """Ids by the tokenizers library; special strings inside texts are plain text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs as many workers as there are cores
        self.own = tokenizers.Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        self.size = self.own.get_vocab_size()
        #: Bytes of each id; an id spelled in other letters has none.
        self.bytes = [b""] * self.size
        for token, k in self.own.get_vocab().items():
            self.bytes[k] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else b""

        self.sizes = np.array([len(x) for x in self.bytes], np.int64)

    def ids(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of segments, one segment after the other, and the number of each one's.

        Segments that go on from a space with something else than white space are joined and encoded together, as a cut
        before each of them changes nothing; the ids' bytes tell whose they are. Others go alone."""
        alone = [k for k, s in enumerate(segments) if len(s) < 2 or s[1].isspace()]
        n = np.zeros(len(segments), np.int64)
        single = [np.array(e.ids, np.int64) for e in self.own.encode_batch_fast([segments[k] for k in alone], add_special_tokens=False)]
        n[alone] = [len(x) for x in single]
        regular = np.ones(len(segments), bool)
        regular[alone] = False
        rest = list(compress(segments, regular.tolist())) if alone else segments
        flat, sizes = [np.zeros(0, np.int64)], []
        for at in range(0, len(rest), JOINED):
            part = rest[at : at + JOINED]
            ids = np.array(self.own.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.int64)
            edges = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(s.encode()) for s in part])) + 1
            flat.append(ids)
            sizes.append(np.diff(edges, prepend=0))
        n[regular] = np.concatenate([np.zeros(0, np.int64), *sizes])
        if not alone:
            return np.concatenate(flat), n
        out, theirs = np.empty(n.sum(), np.int64), np.repeat(regular, n)
        out[theirs], out[~theirs] = np.concatenate(flat), np.concatenate(single)
        return out, n


class Pieces:
    """Ids by the sentencepiece library, which puts a space before a text itself."""

    def __init__(self, path: str):
        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.own.get_piece_size()
        self.bytes = []
        for k in range(self.size):
            piece = self.own.id_to_piece(k)
            if "▁" in piece.lstrip("▁") or (piece.startswith("▁▁") and piece.strip("▁")):
                raise ValueError(f"{path}: a piece goes on after a space, so texts cannot be cut there")
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.own.is_byte(k) else piece.replace("▁", " ").encode())

        self.sizes = np.array([len(x) for x in self.bytes], np.int64)

    def ids(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of segments, one segment after the other, and the number of each one's."""
        found = self.own.encode([s[1:] for s in segments], num_threads=1)
        return np.fromiter(chain.from_iterable(found), np.int64), np.array([len(x) for x in found], np.int64)


def groups_of(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each group the number of tokens of either list up to its end: the byte offsets where both lists have an end, looked
    up in a dictionary from end to number."""
    a_at, b_at = (dict(zip(accumulate(sizes.tolist()), range(1, len(sizes) + 1), strict=True)) for sizes in (a_sizes, b_sizes))
    common = sorted(a_at.keys() & b_at.keys())
    return tuple(np.fromiter(map(at.__getitem__, common), np.int64, len(common)) for at in (a_at, b_at))


def group_links(a_sizes: np.ndarray, b_sizes: np.ndarray, a_to: np.ndarray, b_to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, place, place) of the linked tokens of all groups, group by group.

    Where a group has one token of either list, this one is linked with all of the other's; the rest are gone through side by side."""
    a_from, b_from = np.append(0, a_to[:-1]), np.append(0, b_to[:-1])
    n_a, n_b = a_to - a_from, b_to - b_from
    plain = np.flatnonzero((n_a == 1) | (n_b == 1))
    size = np.maximum(n_a, n_b)[plain]
    group = np.repeat(plain, size)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    p, q = a_from[group] + np.where(n_a[group] > 1, step, 0), b_from[group] + np.where(n_b[group] > 1, step, 0)
    rest = [(g, i, j) for g in np.flatnonzero((n_a > 1) & (n_b > 1)).tolist() for i, j in links_of(a_sizes, b_sizes, (int(a_from[g]), int(a_to[g]), int(b_from[g]), int(b_to[g])))]
    if rest:
        group, p, q = (np.concatenate([x, y]) for x, y in zip((group, p, q), np.array(rest, np.int64).T, strict=True))
        order = np.argsort(group, kind="stable")
        group, p, q = group[order], p[order], q[order]
    return group, p, q


def links_of(a_sizes: np.ndarray, b_sizes: np.ndarray, group: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """Places of the tokens of a group (first, end, first, end) whose bytes overlap."""
    i, i_end, j, j_end = group
    out, a_left, b_left = [], int(a_sizes[i]), int(b_sizes[j])
    while True:
        out.append((i, j))
        step = min(a_left, b_left)
        a_left, b_left = a_left - step, b_left - step
        if not a_left:
            i += 1
            if i == i_end:
                return out
            a_left = int(a_sizes[i])
        if not b_left:
            j += 1
            b_left = int(b_sizes[j])


class Aligner:
    """Alignments of segments, each different one made once."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Letters(a_path), Pieces(b_path)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.bytes = 0
        self.texts: list[str] = []
        #: Of each segment: tokens of both kinds, groups, and whether both spell the segment; where its links begin.
        self.facts, self.begin = np.zeros((0, 4), np.int64), np.zeros(1, np.int64)
        self.links = np.zeros(0, np.int64)

    def _spelled(self, segments: list[str]) -> tuple[list[str], tuple[np.ndarray, ...]]:
        """Those segments that both tokenizers spell byte by byte, with the ids of either and their numbers."""
        a, b = self.a.ids(segments), self.b.ids(segments)
        joined = "".join(segments).encode()
        if all(b"".join([t.bytes[k] for k in flat.tolist()]) == joined for t, (flat, _) in ((self.a, a), (self.b, b))):
            return segments, (*a, *b)
        parts = [np.split(flat, np.cumsum(n)[:-1]) for flat, n in (a, b)]
        good = [s for s, *ids in zip(segments, *parts, strict=True) if all(b"".join([t.bytes[k] for k in x.tolist()]) == s.encode() for t, x in zip((self.a, self.b), ids, strict=True))]
        return good, (*self.a.ids(good), *self.b.ids(good))

    def _learn(self, segments: list[str]) -> None:
        good, (a, n_a, b, n_b) = self._spelled(segments)
        a_sizes, b_sizes = self.a.sizes[a], self.b.sizes[b]
        a_to, b_to = groups_of(a_sizes, b_sizes)  # both lists have an end at the end of every segment
        group, p, q = group_links(a_sizes, b_sizes, a_to, b_to)
        owner = np.searchsorted(np.cumsum(n_a), a_to)  # of each group: its segment
        n = len(good)
        n_groups = np.bincount(owner, minlength=n)
        n_links = np.bincount(owner[group], minlength=n)
        texts = self._texts(a, a_to, b, b_to, n_groups)
        facts = np.stack([n_a, n_b, n_groups, np.ones(n, np.int64)], 1) if n else np.zeros((0, 4), np.int64)
        if n < len(segments):  # the others come last, and have nothing
            known = set(good)
            good = [*good, *(s for s in segments if s not in known)]
            more = len(segments) - n
            facts, n_links, texts = np.concatenate([facts, np.zeros((more, 4), np.int64)]), np.append(n_links, np.zeros(more, np.int64)), [*texts, *[""] * more]
        self.place.update(zip(good, range(len(self.place), len(self.place) + len(good)), strict=True))
        self.bytes += sum(map(len, good))
        self.texts += texts
        self.facts = np.concatenate([self.facts, facts])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(n_links)])
        self.links = np.concatenate([self.links, a[p] * self.b.size + b[q]])

    @staticmethod
    def _texts(a: np.ndarray, a_to: np.ndarray, b: np.ndarray, b_to: np.ndarray, n_groups: np.ndarray) -> list[str]:
        """The groups of each segment, written out."""
        x, y, out, i, j = list(map(str, a.tolist())), list(map(str, b.tolist())), [], 0, 0
        for p, q in zip(a_to.tolist(), b_to.tolist(), strict=True):
            out.append(f"{x[i]}|{y[j]}" if p - i == 1 and q - j == 1 else f"{','.join(x[i:p])}|{','.join(y[j:q])}")
            i, j = p, q
        at, texts = 0, []
        for n in n_groups.tolist():
            texts.append(";".join(out[at : at + n]))
            at += n
        return texts

    @staticmethod
    def segments(text: str) -> list[str]:
        """The segments of a text with a space before it."""
        text = f" {text}"
        if not UNEVEN.search(text):
            return [f" {w}" for w in text.split(" ")[1:]]
        first, *rest = CUT.split(text)
        return [*([first] if first else []), *(f" {w}" for w in rest)]

    def places(self, texts: list[str]) -> list[np.ndarray]:
        """The places of each text's segments; new ones are aligned first."""
        if len(self.place) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self.forget()
        parts = [self.segments(t) if t else [] for t in texts]
        new = list(dict.fromkeys(s for p in parts for s in p if s not in self.place))
        if new:
            self._learn(new)
        return [np.fromiter(map(self.place.__getitem__, p), np.int64, len(p)) for p in parts]

    def linked(self, at: np.ndarray) -> np.ndarray:
        """The links of segments, one after the other."""
        begin, size = self.begin[at], self.begin[at + 1] - self.begin[at]
        return self.links[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]


@functools.cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """A worker's memory of segments, over all its tasks."""
    return Aligner(a_path, b_path)


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)


def groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(doc_id, groups) of every row; groups is `a1,a2|b1;a3|b2,b3`: the ids of both tokenizers in order, group by group.

    Texts null, empty, or that not both tokenizers spell byte by byte have none: an empty string. Rows that share a doc_id,
    or have none, have a row each; an empty table gives none."""
    paths = _paths(a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*paths)
        for batch in batches:
            for rows in slices(batch):
                found = own.places(rows.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([";".join(own.texts[k] for k in at) if len(at) and own.facts[at, 3].all() else "" for at in found], pa.string())], ["doc_id", "groups"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, groups string")


def _documents(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """A row a document: its numbers, the hash of its groups, and its different links with how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*paths)
        for batch in batches:
            for rows in slices(batch):
                facts, hashes, links, times = [], [], [], []
                for at in own.places(rows.column("text").to_pylist()):
                    if not len(at) or not own.facts[at, 3].all():
                        at = at[:0]
                    codes, n = np.unique(own.linked(at), return_counts=True)
                    facts.append([*own.facts[at, :3].sum(0).tolist(), int(n.sum())])
                    hashes.append(hashlib.sha256(";".join([own.texts[k] for k in at]).encode()).hexdigest() if len(at) else "")
                    links.append(codes)
                    times.append(n)
                numbers = np.array(facts, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([rows.column("row"), rows.column("doc_id"), *(pa.array(c) for c in numbers.T), pa.array(hashes, pa.string()), packed(links, "<u4" if small else "<u8"), packed(times, "<u4")], names)

    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "times"]
    small = np.prod([x.size for x in (Letters(paths[0]), Pieces(paths[1]))]) < 1 << 32
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(run, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, times binary").withColumn("small", F.lit(bool(small)))


def _links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the batch, link, times) of all links of a batch."""
    small = batch.num_rows and batch.column("small")[0].as_py()
    links, times = unpacked(batch.column("links"), "<u4" if small else "<u8").astype(np.int64), unpacked(batch.column("times"), "<u4").astype(np.int64)
    lengths = pc.binary_length(batch.column("times")).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    return np.repeat(np.arange(batch.num_rows), lengths), links, times


def _pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n): how often each pair is linked in all documents. Tasks add up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            codes, which = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            n = np.bincount(which, np.concatenate([n for _, n in held]), len(codes)).astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["pair", "n"])

        for batch in batches:
            _, links, times = _links(batch)
            held.append((links, times))
            if sum(len(c) for c, _ in held) > AT_ONCE:
                yield out()
        if held:
            yield out()

    return found.select("links", "times", "small").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, hot: int = HOT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    n_best counts links whose id pair occurs as often as any with the same second id, count_sum adds up how often
    the pairs of all links occur. A text that is null, empty, or that not both tokenizers spell byte by byte, has zeros and an empty
    string. Rows that share a doc_id, or have none, have a row each; an empty table gives none; other columns are not read.

    At most hot pairs, those that occur from some power of two on, are broadcast with their counts; the links of rarer pairs meet
    their counts in a shuffle, where no pair has more than a small share of all links. Of each second id the highest count is
    broadcast: a number for each piece of the vocabulary. The number of hot pairs does not change the result."""
    spark = docs.sparkSession
    found = stored(_documents(docs, _paths(a_path, b_path)), "aligned")
    pairs = stored(_pair_counts(found), "pairs")
    n_b = Pieces(_paths(a_path, b_path)[1]).size
    best = np.zeros(n_b, np.int64)
    for r in pairs.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("n").alias("n")).collect():  # a row a piece of the vocabulary
        best[r["b"]] = r["n"]
    # pairs by the number of bits of their counts; hot ones have as many bits as leave no more than hot of them
    bits = {r["bits"]: r["count"] for r in pairs.groupBy(F.length(F.bin("n")).alias("bits")).count().collect()}
    least, taken = 64, 0
    while least > 1 and taken + bits.get(least - 1, 0) <= hot:
        least -= 1
        taken += bits.get(least, 0)
    common = pairs.where(F.col("n") >= F.lit(2 ** (least - 1))) if least < 64 else pairs.where("false")
    table = common.toArrow()
    codes, counts = (table.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(codes)
    shared = spark.sparkContext.broadcast((codes[order], counts[order], best))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = shared.value
        for batch in batches:
            row, links, times = _links(batch)
            hit, at = isin_sorted(links, codes)
            row, links, times, at = row[hit], links[hit], times[hit], at[hit]
            n = counts[at] if len(counts) else np.zeros(0, np.int64)
            sums = []
            for values in (times * (n == best[links % n_b]), times * n):
                total = np.append(0, np.cumsum(values))
                edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
                sums.append(pa.array(total[edge[1:]] - total[edge[:-1]]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *sums], [*kept, "n_best", "count_sum"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, _, _ = shared.value
        for batch in batches:
            row, links, times = _links(batch)
            rest = ~isin_sorted(links, codes)[0]
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("row").to_numpy()[row[rest]]), pa.array(links[rest]), pa.array(times[rest])], ["row", "pair", "times"])

    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kinds = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in kept)
    out = found.mapInArrow(known, f"{kinds}, n_best long, count_sum long")
    if least > 1:  # some pairs are not among the hot ones
        highest = spark.createDataFrame(pa.table({"b": np.arange(n_b), "highest": best}))
        others = pairs.where(F.col("n") < F.lit(2 ** (least - 1))) if least < 64 else pairs
        others = others.withColumn("b", F.col("pair") % n_b).join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("top"))
        links = found.select("row", "links", "times", "small").mapInArrow(rare, "row long, pair long, times long")
        more = links.join(others, "pair").groupBy("row").agg(F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        out = out.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    out = stored(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), "alignment")
    shared.destroy()
    dropped(found)
    dropped(pairs)
    return out
