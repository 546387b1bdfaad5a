"""Sequence packing by hierarchical best fit.

Groups of pieces are packed side by side, longest first, each piece into the fullest bin that holds it. Nearly
full bins are done; the others are items of the next round, in fewer groups, until a round joins nothing more.
What travels are lengths and bin numbers, never token ids."""

from __future__ import annotations

import functools
import os
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import isin_sorted, range_hashes, releasing, slices, text_bytes
from .store import dropped, stored

CAPACITY, END_ID = 1024, 2
#: A bin is done when so full; groups have about so many items.
NEARLY_FULL, GROUP_ITEMS = 0.995, 30_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Bytes that may follow a space where a text is cut: printable ASCII, and first bytes of characters none of which is white space.
AFTER_SPACE = np.zeros(256, bool)
AFTER_SPACE[0x21:0x7F] = AFTER_SPACE[0xC3:] = True
AFTER_SPACE[0xE1:0xE4] = False
#: Bytes of text that are split and encoded at once, and segments whose ids a worker remembers.
AT_ONCE, REMEMBERED = 2 << 20, 1_000_000


@functools.cache
def tokenizer(path: str) -> tuple[tokenizers.Tokenizer, np.ndarray]:
    """The tokenizer of a JSON file and the number of bytes of each id, read once by each Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs as many workers as there are cores
    out = tokenizers.Tokenizer.from_file(path)
    sizes = np.zeros(out.get_vocab_size(), np.int64)
    for token, k in out.get_vocab().items():
        sizes[k] = len(token)  # a character stands for a byte
    return out, sizes


def _gathered(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of ranges, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Ids:
    """Ids of many texts at once, each different segment going through the tokenizer one time.

    A text is cut before each space that something else than white space follows. There the tokenizer's own split into
    words always begins a new one, whatever stands before, so that the ids of a text are those of its segments. The
    different segments are joined and encoded once; the bytes of the ids tell which are whose. Segments are told apart by
    64-bit hashes and their lengths."""

    def __init__(self, path: str):
        self.exact, self.id_bytes = tokenizer(path)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.begin, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _encoded(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.exact.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, length: np.ndarray, spaced: np.ndarray) -> None:
        """Remember the ids of segments that are new; those without a space, at the start of a text, go alone."""
        joined, alone = np.flatnonzero(spaced), np.flatnonzero(~spaced)
        flat = self._encoded([data[_gathered(starts[joined], length[joined])].tobytes()])[0]
        edges = np.searchsorted(np.cumsum(self.id_bytes[flat]), np.cumsum(length[joined]))
        rest = self._encoded([data[starts[k] : starts[k] + length[k]].tobytes() for k in alone])
        size = np.empty(len(keys), np.int64)
        size[joined], size[alone] = np.diff(np.append(-1, edges)), [len(x) for x in rest]
        order = np.append(joined, alone)
        begin = np.empty(len(keys), np.int64)
        begin[order] = len(self.ids) + np.cumsum(size[order]) - size[order]
        self.ids = np.concatenate([self.ids, flat, *rest])
        keys, begin, size = np.append(self.keys, keys), np.append(self.begin, begin), np.append(self.size, size)
        order = np.argsort(keys, kind="stable")
        self.keys, self.begin, self.size = keys[order], begin[order], size[order]

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and the number of each; a null text is empty."""
        data, offsets = text_bytes(column)
        cuts = np.zeros(len(data), bool)
        cuts[:-1] = (data[:-1] == 0x20) & AFTER_SPACE[data[1:]]
        cuts[offsets[1:-1][offsets[1:-1] > 0] - 1] = False  # a last space stays with its text
        spaced = cuts.copy()
        cuts[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cuts)
        doc = np.searchsorted(offsets, starts, "right") - 1
        length = np.diff(np.append(starts, len(data)))
        keys, first, which = np.unique(range_hashes(data, starts, starts + length) + length.astype(np.uint64), return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self._forget()
        new = np.flatnonzero(~isin_sorted(keys, self.keys)[0])
        if len(new):
            at = first[new]
            self._learn(keys[new], data, starts[at], length[at], spaced[starts[at]])
        at = np.searchsorted(self.keys, keys)[which]
        size = self.size[at]
        return self.ids[_gathered(self.begin[at], size)], np.bincount(doc, size, len(offsets) - 1).astype(np.int64)


@functools.cache
def ids(path: str) -> Ids:
    """A worker's memory of segments, over all its tasks."""
    return Ids(path)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; all but the first are full."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * bool(first) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces (PIECES) of every document's ids and end_id."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, limit=AT_ONCE):
                flat, n = ids(vocabulary).of(part.column("text"))
                raw = memoryview(np.insert(flat, np.cumsum(n), np.uint32(end_id)).astype("<u4").tobytes())
                n += 1
                begin = np.cumsum(n) - n
                cuts = [cut(k, capacity) for k in n.tolist()]
                number = np.array([len(c) for c in cuts])
                start, length = np.array([c for own in cuts for c in own], np.int64).reshape(-1, 2).T
                doc = np.repeat(np.arange(len(n)), number)
                here = begin[doc] + start
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(here.tolist(), (here + length).tolist(), strict=True)]
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(releasing(run), PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length, longest first into the fullest bin that holds it; and each bin's fill."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin with r tokens left
    fill: list[int] = []
    for at in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[at])
        fits = some >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                some ^= 1 << left
        else:
            b, left = len(fill), capacity
            fill.append(0)
        bins[at], offsets[at] = b, fill[b]
        fill[b] += n
        left -= n
        free[left].append(b)
        some |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def _round(first: bool, capacity: int):
    """Packs a group. In the first round bins are numbered by group; later ones take the number of their first item, a bin itself."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in table.column_names if c not in ("group", "ids_crc32")])
        bins, offsets, fill = best_fit(table.column("length").to_numpy(), capacity)
        number = (table.column("group")[0].as_py() << 34) + np.arange(len(fill))
        if not first:
            number[bins[offsets == 0]] = table.column("item").to_numpy()[offsets == 0]
        out = table.drop_columns(["group"])
        for name, values in (("sequence_id", number[bins]), ("offset", offsets), ("fill", fill[bins])):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    return run


def _packed(items: DataFrame, number: int, total: int, capacity: int, group_items: int) -> DataFrame:
    """items, a stored table, with sequence_id, offset and fill (of the bin). Every round deals anew, by a row's place in
    the table's files, so that equal rows spread too."""
    groups = max(1, -(-total // group_items))
    dealt = items.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(number)), F.lit(groups)))
    schema = ", ".join(f"`{n}` {t}" for n, t in items.dtypes) + ", sequence_id long, offset long, fill long"
    return stored(dealt.groupBy("group").applyInArrow(_round(number == 1, capacity), schema), f"round{number}")


def packed(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of docs.

    A null or empty text is a piece of the end token alone; rows that share a doc_id, or have none, are packed each; only
    the length counts, so ties are broken by id; other columns are ignored; an empty table gives no rows. Rounds end when
    one leaves more than 99 of 100 underfull bins as they were."""
    cuts = stored(pieces(docs, vocabulary or public_tokenizers.path("byte_bpe_50k.json"), capacity), "pieces")
    out = _packed(cuts, 1, cuts.count(), capacity, group_items)
    dropped(cuts)
    least, before, number, maps = int(nearly_full * capacity), None, 1, []
    bins = out.where(F.col("fill") < least).groupBy("sequence_id").agg(F.max("fill").alias("length"))
    while True:
        open_bins = stored(bins.select(F.col("sequence_id").alias("item"), "length"), "bins")
        total = open_bins.count()
        if total < 2 or before is not None and total > 0.99 * before:
            break
        before, number = total, number + 1
        merged = _packed(open_bins, number, total, capacity, group_items)
        dropped(open_bins)
        maps.append(merged)
        bins = merged.where(F.col("fill") < least).groupBy("sequence_id").agg(F.max("fill").alias("length"))
    rounds = [out, *maps]
    for merged in maps:
        to = merged.select(F.col("item").alias("sequence_id"), F.col("sequence_id").alias("into"), F.col("offset").alias("shift"))
        out = out.join(to, "sequence_id", "left").withColumns({"sequence_id": F.coalesce("into", "sequence_id"), "offset": F.col("offset") + F.coalesce("shift", F.lit(0))}).drop("into", "shift")
    out = stored(out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"), "packed")
    for table in (open_bins, *rounds):
        dropped(table)
    return out


def brute_pieces(rows: list[tuple], capacity: int = CAPACITY) -> list[tuple]:
    """doc_id, piece, start, length, ids_crc32 of all pieces, a text at a time."""
    exact = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for doc_id, text in rows:
        ids = [*exact.encode(text or "", add_special_tokens=False).ids, END_ID]
        edges = [k for k in range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [len(ids)]
        for piece, (start, end) in enumerate(zip([0, *edges[:-1]], edges, strict=True)):
            out.append((doc_id, piece, start, end - start, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[start:end]))))
    return out
