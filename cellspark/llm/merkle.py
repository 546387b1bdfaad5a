"""Document fingerprints: Merkle trees over sections, paragraphs and leaves.

A leaf is some sentences, or a stretch of a long one: short ones at the start of a text, so that small texts can be
compared too, and longer ones further on. A paragraph is a line, a section what blank lines part (16 lines at most).
Leaves tile the text. A node's hash is that of its children's hashes, 128 bits wide on the way up to the root, so equal
roots mean equal texts, and an edit shows as the path of nodes that differ. A fingerprint is text: the root, then
`/section`, each with its `;paragraphs`, each with its `,leaves`; a node is shown by the first 64 bits of its hash (11
letters), a leaf followed by its length. A paragraph of one leaf is shown as that leaf."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrays import slices
from .store import text_bytes_of

#: Sentences, and what is cut from long ones: in the first FINE characters of a text, and after them.
FINE, SHORT, LONG = 512, re.compile(r"[^.!?]{1,40}[.!?]*[ ]*|[.!?]+[ ]*"), re.compile(r"[^.!?]{1,240}[.!?]*[ ]*|[.!?]+[ ]*")
#: Beyond FINE a leaf takes sentences until it has so many characters.
LEAF_CHARS = 96
SECTION_LINES = 16
#: Letters of a hash as it is shown.
SHOWN = 11
#: Bytes of text that a range of documents has, about.
RANGE_BYTES = 128 << 20


def _hash(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _shown(digest: bytes) -> str:
    return base64.urlsafe_b64encode(digest[:8])[:SHOWN].decode()


def _leaf_texts(line: str, at: int) -> list[str]:
    """The leaves of a line that starts at a place of the text."""
    fine = max(0, FINE - at)
    out, held = SHORT.findall(line[:fine]), ""
    for sentence in LONG.findall(line[fine:]):
        held += sentence
        if len(held) >= LEAF_CHARS:
            out.append(held)
            held = ""
    return [*out, held] if held else out


def fingerprint(text: str) -> str:
    """The tree of a text; the empty text has a root and no section."""
    sections: list[list[tuple[bytes, str]]] = [[]]
    at = 0
    for line in text.splitlines(keepends=True):
        leaves = [(_hash(x.encode("utf-8", "surrogatepass")), len(x)) for x in _leaf_texts(line, at)]
        digest = _hash(b"".join(h for h, _ in leaves))
        shown = ",".join(_shown(h) + str(n) for h, n in leaves)
        sections[-1].append((digest, shown if len(leaves) == 1 else f"{_shown(digest)}:{shown}"))
        at += len(line)
        if not line.strip() or len(sections[-1]) == SECTION_LINES:
            sections.append([])
    digests, parts = [], []
    for section in filter(None, sections):
        digests.append(_hash(b"".join(h for h, _ in section)))
        parts.append(";".join([_shown(digests[-1]), *(shown for _, shown in section)]))
    return "/".join([_hash(b"".join(digests)).hex(), *parts])


def _leaves(section: str) -> Counter:
    return Counter(leaf for paragraph in section.split(";")[1:] for leaf in paragraph.rsplit(":", 1)[-1].split(","))


def likeness(a: str, b: str) -> float:
    """Share of the characters of both texts that lie in equal leaves, 0 to 1; equal roots give 1."""
    a_root, *a_sections = a.split("/")
    b_root, *b_sections = b.split("/")
    if a_root == b_root:
        return 1.0
    left, right = Counter(a_sections), Counter(b_sections)
    same = left & right  # whole branches are equal: nothing to compare below
    weight = lambda leaves: sum(int(k[SHOWN:]) * n for k, n in leaves.items())
    parts = [sum((_scaled(_leaves(s), n) for s, n in side.items()), Counter()) for side in (same, left - same, right - same)]
    shared, total = weight(parts[1] & parts[2]), weight(parts[1]) + weight(parts[2])
    both = weight(parts[0])
    return (2 * both + 2 * shared) / max(2 * both + total, 1)


def _scaled(leaves: Counter, n: int) -> Counter:
    return leaves if n == 1 else Counter({k: v * n for k, v in leaves.items()})


def differing_paragraphs(a: str, b: str) -> list[int]:
    """Numbers of a's paragraphs that b has not: where an edit took place. Sections that b has too are not looked into."""
    if a.split("/", 1)[0] == b.split("/", 1)[0]:
        return []
    sections = [s.split(";") for s in a.split("/")[1:]], [s.split(";") for s in b.split("/")[1:]]
    there = Counter(p for s in sections[1] for p in s[1:])
    out, k = [], 0
    for section in sections[0]:
        for p in section[1:]:
            if there[p]:
                there[p] -= 1
            else:
                out.append(k)
            k += 1
    return out


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as many first code points of the following text, or all it has."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _place(doc_id: Column, bounds: list[int]) -> Column:
    """Number of bounds above the id: ranges in descending order of id. First among every so many bounds, then among those between."""
    if not bounds:
        return F.lit(0)
    falling, step = bounds[::-1], max(1, int(len(bounds) ** 0.5))
    listed = lambda some: F.split(F.lit(",".join(map(str, some))), ",").cast("array<long>")
    above = lambda some: F.size(F.filter(some, lambda b: b > doc_id))
    coarse = above(listed(falling[step - 1 :: step])) * step
    return coarse + above(F.slice(listed(falling), coarse + 1, F.lit(step)))


def with_following(docs: DataFrame, run, schema: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """run(document, following document) over neighbours in descending order of doc_id; the first follows the last.

    Ids are cut into ranges of about range_bytes of text, each of which is sorted and streamed by one task; all rows of one
    id are in one range. The first rows of a range are also given to the range before it, as the document that follows
    its last."""
    spark = docs.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), text_bytes_of(docs) // range_bytes + 1)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 20 * n))).first()[0] or []
    bounds = sorted(set(cuts))
    ids = docs.groupBy(_place(F.col("doc_id"), bounds).alias("range")).agg(F.max("doc_id").alias("first"))
    # as many rows as ranges: which range's first document ends the range before it
    order = Window.orderBy("range")
    firsts = [tuple(r) for r in ids.select("first", F.coalesce(F.lag("range").over(order), F.max("range").over(Window.partitionBy())).alias("before")).collect()]
    rows = docs.select("doc_id", "text", _place(F.col("doc_id"), bounds).alias("range"), F.lit(0).alias("guest"))
    if firsts:
        guests = spark.createDataFrame(firsts, "doc_id long, range int")
        rows = rows.union(docs.join(F.broadcast(guests), "doc_id").select("doc_id", "text", "range", F.lit(1).alias("guest")))
    rows = rows.repartitionByRange(n, "range").sortWithinPartitions("range", "guest", F.desc("doc_id"), "text")

    def pairs(batches):
        held = None
        for batch in batches:
            for part in slices(batch):
                out = []
                for row in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "range", "guest")), strict=True):
                    if held and held[2] == row[2]:
                        out.append((held[0], held[1] or "", row[1] or ""))
                    held = row if not row[3] else None
                if out:
                    yield run(out)

    return rows.mapInArrow(pairs, schema)


REPORT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _report(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of REPORT from (doc_id, text, following text)."""
    cols: list[list] = [[] for _ in range(7)]
    before, then = None, None  # the document that follows is the next one
    for doc_id, text, following in rows:
        new = edited(text, following)
        own = then if before == text else fingerprint(text)
        after, before, then = fingerprint(new), following, fingerprint(following)
        for c, v in zip(cols, (doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own, after, likeness(own, after), likeness(own, then)), strict=True):
            c.append(v)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [c.split()[0] for c in REPORT.split(", ")])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    A null text reads as empty; a single document follows itself; rows that share a doc_id follow one another in order
    of text; rows without doc_id have no place in the order: an empty text follows each of them. Other columns are ignored."""
    docs = docs.select("doc_id", "text")

    def alone(batches):
        for batch in batches:
            for part in slices(batch):
                yield _report([(None, text or "", "") for text in part.column("text").to_pylist()])

    without = docs.where("doc_id is null").select("text").mapInArrow(alone, REPORT)
    return with_following(docs.where("doc_id is not null"), _report, REPORT).union(without)
