"""Token counts by finite-state transducers compiled from a tokenizer's file.

Two deterministic transducers read a text. The first reads character classes and marks where a word begins. The second
reads a word's bytes, the last one as a symbol of its own, and its transitions carry the number of tokens that they add.
Texts are cut into chunks that are read side by side; what a chunk does is a map from the state that it begins in to
the state that it ends in, and these maps are composed by a prefix scan. No token is made; only counts come out."""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices

LIMIT = 2048
#: The split into words that the first transducer is for: fixed text of the tokenizer's file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Code points that no neighbour changes in normalisation form C, and that stay one when put in lower case; others go
#: through the tokenizer's own normaliser, word by word. First and last of each range.
STEADY = [(0x00, 0x12F), (0x131, 0x2FF), (0x400, 0x482), (0x2010, 0x2027), (0x2030, 0x205E), (0x4E00, 0x9FFF), (0x1F300, 0x1F9FF)]
#: Characters of a piece of a long text, which is cut at white space; chunks of a piece that are read side by side.
PIECE, LANES, CHUNK = 1 << 20, 4096, 64

# Classes of characters as the first transducer reads them. A quote that begins 's or its like, or 're or its like,
# has a class of its own, found by looking ahead; inside other signs it is one of them.
LETTER, NUMBER, SPACE, OTHER, SHORT, LONG = range(6)
# States: no word is open, in letters, in other signs, the last letter of a contraction comes, the last two come.
OPEN, LETTERS, OTHERS, ONE_MORE, TWO_MORE = range(5)


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """The first transducer: next state and whether a word begins, by state * 8 + class."""
    to, begins = np.zeros((5, 8), np.uint8), np.zeros((5, 8), bool)
    for state in range(5):
        for kind, (then, inside) in {LETTER: (LETTERS, LETTERS), NUMBER: (OPEN, -1), OTHER: (OTHERS, OTHERS), SHORT: (ONE_MORE, OTHERS), LONG: (TWO_MORE, OTHERS)}.items():
            goes_on = state == inside
            to[state, kind], begins[state, kind] = (state if goes_on else then), not goes_on
    to[ONE_MORE, LETTER], begins[ONE_MORE, LETTER] = OPEN, False
    to[TWO_MORE, LETTER], begins[TWO_MORE, LETTER] = ONE_MORE, False
    return to.ravel(), begins.ravel()


TO, BEGINS = _splitter()


def _in_chunks(symbols: np.ndarray, filler: int) -> tuple[np.ndarray, int]:
    """Symbols as an array (place in the chunk, chunk), and the chunks' length."""
    length = max(CHUNK, -(-len(symbols) // LANES))
    lanes = -(-len(symbols) // length)
    padded = np.full(lanes * length, filler, symbols.dtype)
    padded[: len(symbols)] = symbols
    return np.ascontiguousarray(padded.reshape(lanes, length).T), length


def word_starts(kinds: np.ndarray) -> np.ndarray:
    """Where words begin among characters of these classes. Each chunk is read from all five states at once; its map
    from state to state is composed with those before it, by doubling, and gives the state that it really begins in."""
    if not len(kinds):
        return np.zeros(0, bool)
    rows, length = _in_chunks(kinds, SPACE)
    now = np.repeat(np.arange(5, dtype=np.uint8)[:, None], rows.shape[1], axis=1)
    for row in rows:
        now = TO[now * 8 + row]
    maps = now.T.copy()  # (chunk, state) to state
    step = 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    state = np.append(np.uint8(OPEN), maps[:-1, OPEN])
    out = np.empty(rows.shape, bool)
    for k, row in enumerate(rows):
        at = state * 8 + row
        out[k], state = BEGINS[at], TO[at]
    return out.T.ravel()[: len(kinds)]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """The second transducer, its states made when first met.

    After each byte of a word the encoding of what has been read has one last token; a longer prefix's last token is the one
    that ends there and may stand after the last token of what is before it. Two tokens may stand side by side if no merge
    across their boundary comes earlier than those that made them. So all that the rest of a word depends on is, for each
    place from which some token may still be under way, the token that ends there and how many tokens there are up to it,
    less those up to here: this is the state. Symbols are bytes, and bytes that end a word (256 more)."""

    #: Transitions hold next * 64 + tokens added + 40 (they may be taken back by a longer token), or -1 if not made yet.
    ADDED = 40
    #: States from which on all are forgotten and made anew.
    STATES = 120_000

    def __init__(self, model: dict):
        vocab, pairs = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        suffix = model.get("end_of_word_suffix") or ""
        if model.get("type") != "BPE" or not suffix or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("only merges of whole words with an end-of-word suffix can be compiled")
        letters = byte_letters()
        symbols = [vocab[c] for c in letters] + [vocab[c + suffix] for c in letters]
        #: Of each token: rank of its merge (-1 for a symbol), its two parts, its symbols.
        self.rank, self.parts, spelled = {t: -1 for t in symbols}, {}, {t: (k,) for k, t in enumerate(symbols)}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(pairs):
            left, right = vocab[a], vocab[b]
            whole = vocab[a + (b.removesuffix(suffix) + suffix if b.endswith(suffix) else b)]
            if left not in self.rank or right not in self.rank or whole in self.rank:
                raise ValueError("merges are not in the order in which their parts are made")
            self.rank[whole], self.parts[whole] = rank, (left, right)
            self.merged[left, right] = rank
            spelled[whole] = spelled[left] + spelled[right]
        # the right edge of a token, from itself to its last symbol, each with the rank of the merge that uses it up; and the left edge
        never = len(pairs)
        self.right, self.left = ({t: [(t, never)] for t in symbols} for _ in range(2))
        for t, (a, b) in self.parts.items():
            self.right[t] = [(t, never), (b, self.rank[t]), *self.right[b][1:]]
            self.left[t] = [(t, never), (a, self.rank[t]), *self.left[a][1:]]
        self.known: dict[tuple[int, int], bool] = {}
        self.kids: list[dict[int, int]] = [{}]
        self.token = [-1]
        for t, s in spelled.items():
            if t in self.parts and self._first(*self.parts[t]) < self.rank[t]:
                continue  # its own spelling is encoded in another way: it never occurs
            node = 0
            for k in s:
                if k not in self.kids[node]:
                    self.kids[node][k] = len(self.kids)
                    self.kids.append({})
                    self.token.append(-1)
                node = self.kids[node][k]
            self.token[node] = t
        self.forget()

    def _first(self, a: int, b: int) -> int:
        """Rank of the first merge across the boundary of two tokens, where both sides are there in time; of equal pairs the left one goes first."""
        return min((r for x, x_used in self.right[a] for y, y_used in self.left[b] if (r := self.merged.get((x, y), 1 << 30)) < x_used and r <= y_used), default=1 << 30)

    def beside(self, a: int, b: int) -> bool:
        """Whether b may stand right after a."""
        if (out := self.known.get((a, b))) is None:
            out = self.known[a, b] = self._first(a, b) == 1 << 30
        return out

    def forget(self) -> None:
        self.known.clear()
        self.states = [((0, -1, 0),)]
        self.index = {self.states[0]: 0}
        self.column = np.full(513, -1, np.int64)
        self.column[512] = 0  # the filler: back to the first state
        self.symbols = [512]
        self.table = np.full((1024, 16), -1, np.int32)
        self.table[:, 0] = self.ADDED

    def _make(self, state: int, symbol: int) -> int:
        last, under_way = None, []
        for node, before, less in self.states[state]:
            if (kid := self.kids[node].get(symbol)) is None:
                continue
            if last is None and (t := self.token[kid]) >= 0 and (before < 0 or self.beside(before, t)):
                last, added = t, less + 1
            if self.kids[kid]:
                under_way.append((kid, before, less))
        if symbol >= 256:
            return self.ADDED + added
        key = (*((node, before, less - added) for node, before, less in under_way), (0, last, 0))
        to = self.index.setdefault(key, len(self.states))
        if to == len(self.states):
            self.states.append(key)
        return to * 64 + self.ADDED + added

    def _look(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Transitions of states by symbols; those not met before are made."""
        column = self.column[symbols]
        if (column < 0).any():
            for k in np.unique(symbols[column < 0]).tolist():
                self.column[k] = len(self.symbols)
                self.symbols.append(k)
            if len(self.symbols) > self.table.shape[1]:
                self.table = np.pad(self.table, ((0, 0), (0, max(16, len(self.symbols) - self.table.shape[1]))), constant_values=-1)
            column = self.column[symbols]
        at = state * self.table.shape[1] + column
        out = self.table.ravel()[at]
        if (out < 0).any():
            width = self.table.shape[1]
            for k in np.unique(at[out < 0]).tolist():
                s, c = divmod(k, width)
                value = self._make(s, self.symbols[c])
                if len(self.states) > len(self.table):
                    self.table = np.pad(self.table, ((0, len(self.table)), (0, 0)), constant_values=-1)
                    self.table[:, 0] = self.ADDED
                self.table[s, c] = value
            out = self.table.ravel()[at]
        return out

    def added(self, symbols: np.ndarray) -> np.ndarray:
        """Tokens that each symbol adds; the symbols begin with a word.

        A chunk that begins within CHUNK symbols of a word's beginning is entered in the state that the word gives; in a longer word
        its state is first guessed by reading the CHUNK symbols before it. Each chunk's entry is then held
        against the end of the chunk before, and the chunks whose guess was wrong are read again, until all maps fit."""
        if len(self.states) > self.STATES:
            self.forget()
        rows, length = _in_chunks(symbols, 512)
        lanes = rows.shape[1]
        begin = np.arange(lanes) * length
        first = np.flatnonzero(np.append(True, symbols[:-1] >= 256))
        at = np.maximum(first[np.searchsorted(first, begin, "right") - 1], begin - CHUNK)
        state = np.zeros(lanes, np.int64)
        while len(behind := np.flatnonzero(at < begin)):
            state[behind] = self._look(state[behind], symbols[at[behind]]) >> 6
            at[behind] += 1
        out = np.empty(rows.shape, np.int8)
        entry, end, todo = state, np.zeros(lanes, np.int64), np.arange(lanes)
        while len(todo):
            now = entry[todo]
            for k in range(length):
                value = self._look(now, rows[k] if len(todo) == lanes else rows[k, todo])
                now = value >> 6
                out[k, todo] = (value & 63) - self.ADDED
            end[todo] = now
            todo = np.flatnonzero(entry[1:] != end[:-1]) + 1
            entry[todo] = end[todo - 1]
        return out.T.ravel()[: len(symbols)]


class Counter:
    """Token counts of texts by a tokenizer's JSON file, read once by each Python worker."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs as many workers as there are cores
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        steps = [p.get("pattern", {}).get("Regex") for p in (file["pre_tokenizer"] or {}).get("pretokenizers", [])]
        kinds = [p["type"] for p in (file["normalizer"] or {}).get("normalizers", [])]
        if PATTERN not in steps or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: its split into words is not the one that can be compiled")
        own = tokenizers.Tokenizer.from_file(path)
        self.normalize, self.split = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(file["added_tokens"], key=lambda t: -len(t["content"]))) or r"(?!)")
        self.merges = Merges(file["model"])
        self.low, self.steady = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
        for first, last in STEADY:
            for c in range(first, last + 1):
                low = self.normalize(chr(c))
                self.steady[c] = len(low) == 1
                self.low[c] = ord(low) if len(low) == 1 else c
        self.kind = np.full(0x110000, 255, np.uint8)
        self.words: dict[str, str] = {}

    def _normal(self, text: str) -> str:
        """text with the words that hold characters that are not steady as the tokenizer normalises them."""
        words = text.split(" ")
        for k, w in enumerate(words):
            if not w.isascii() and not self.steady[np.frombuffer(w.encode("utf-32-le"), np.uint32)].all():
                if len(self.words) > 200_000:
                    self.words.clear()
                if w not in self.words:
                    self.words[w] = self.normalize(w)
                words[k] = self.words[w]
        return " ".join(words)

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        """Classes of characters; one that is new is tried with the tokenizer's own split."""
        out = self.kind[points]
        if (out == 255).any():
            for c in np.unique(points[out == 255]).tolist():
                found = self.split(chr(c) * 2 + "a")
                self.kind[c] = {3: NUMBER, 2: OTHER}.get(len(found), LETTER if found[0][1][0] == 0 else SPACE)
            out = self.kind[points]
        quotes = np.flatnonzero(points == ord("'"))
        ahead = np.append(points, np.zeros(2, points.dtype))
        one, two = ahead[quotes + 1], ahead[quotes + 2]
        out[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        out[quotes[np.any([(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")], axis=0)]] = LONG
        return out

    def _added(self, texts: list[str]) -> np.ndarray:
        """Tokens of texts, special strings aside."""
        joined = "\n".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        if not self.steady[points].all():
            texts = [t if t.isascii() else self._normal(t) for t in texts]
            points = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts])
        points = self.low[points]
        kinds = self._kinds(points)
        starts = word_starts(kinds)
        kept = np.flatnonzero(kinds != SPACE)
        points, starts = points[kept], starts[kept]
        # bytes of the words' characters, each with the number of those before it
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        over = np.append(0, np.cumsum(width))
        symbols = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8).astype(np.int64)
        if not len(symbols):
            return np.zeros(len(texts), np.int64)
        symbols[over[1:][np.append(starts[1:], True)] - 1] += 256
        total = np.append(0, np.cumsum(self.merges.added(symbols), dtype=np.int64))[over[np.searchsorted(kept, ends)]]
        return np.diff(total, prepend=0)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text; a null text has none. Special strings count one each. Long texts are read in pieces."""
        out = np.zeros(len(texts), np.int64)
        pieces: list[str] = []
        owner: list[int] = []
        for k, text in enumerate(texts):
            parts = [text or ""]
            if text and "<|" in text:
                parts = self.special.split(text)
                out[k] += len(parts) - 1
            for part in parts:
                at = 0
                while at < len(part):
                    end = at + PIECE
                    if end < len(part):
                        found = SPACES.search(part, end)
                        end = found.start() if found else len(part)
                    pieces.append(part[at:end])
                    owner.append(k)
                    at = end
        at = 0
        while at < len(pieces):
            to, size = at, 0
            while to < len(pieces) and (to == at or size + len(pieces[to]) <= PIECE):
                size += len(pieces[to])
                to += 1
            np.add.at(out, owner[at:to], self._added(pieces[at:to]))
            at = to
        return out


SPACES = re.compile("[ \n\t\r]")


@functools.cache
def counter(path: str) -> Counter:
    """A worker's transducers, over all its tasks."""
    return Counter(path)


def counted(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, by the tokenizer of a JSON file that all executors have.

    Counts are those of the tokenizer's own library, without added special tokens; special strings inside texts are one token each.
    A null or empty text has 0 bytes and 0 tokens; rows that share a doc_id, or have none, have a row each; an empty table
    gives none. Other columns are not read. Nothing is shuffled; a text of any length is read in pieces."""
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for rows in slices(batch):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("n_bytes"), pa.array(own.counts(rows.column("text").to_pylist()))], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
