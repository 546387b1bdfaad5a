"""Removal of repeated passages by fixed-block anchors.

Reference blocks are the non-overlapping runs of 7 words of every document; every rolling run of 7 words
probes them. A shared run of 13 words holds a whole reference block wherever it lies, so each one has an
anchor. Around the anchors the 13-word windows are compared, by 64-bit hashes of all 13 words; their union are the
maximal repeats.

Hashes travel as packed arrays, a row for each slice of documents and bucket of hashes. A slice sends each
hash once, with its least document, so that a passage of very many documents costs a row's share per slice."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import NOT_SPACE, Words, mix, ngrams, packed, slices, spans_flagged, unpacked, within
from .store import dropped, stored, text_bytes_of

SPAN = 13
#: The longest block of which one lies whole in every run of SPAN words.
BLOCK = (SPAN + 1) // 2
#: Entries that a task gathers before it sends them out by bucket, and bytes of text for each bucket: about a million entries.
SEND, BUCKET_BYTES, BUCKETS = 600_000, 6 << 20, 8


def _by_bucket(which: np.ndarray, doc: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """(bucket, documents, number of entries of each, columns) of entries in order of document. All is put in order once, so
    that a bucket more costs some slices, not a pass over the entries."""
    if not len(which):
        return
    order = np.argsort(which, kind="stable")
    which, doc, columns = which[order], doc[order], {k: v[order] for k, v in columns.items()}
    change = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (doc[1:] != doc[:-1])))
    counts, ids = np.diff(np.append(change, len(which))), doc[change]
    first = np.flatnonzero(np.append(True, np.diff(which[change]) != 0))
    for at, to in zip(first.tolist(), [*first[1:].tolist(), len(change)], strict=True):
        own = slice(int(change[at]), int(change[to]) if to < len(change) else len(which))
        yield int(which[own.start]), ids[at:to], counts[at:to], {k: v[own] for k, v in columns.items()}


def _probes(buckets: int):
    """Rows (bucket, ids, counts, prints, anchors): the 7-word hashes of a slice. Those that two documents of
    the slice share are known to repeat; they go into a bucket of the slice's own, below 0."""

    def send(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        doc, grams, anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((doc, grams))
        doc, grams, anchor = doc[order], grams[order], anchor[order]
        new = np.append(True, (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1]))
        at = np.flatnonzero(new)
        anchor = np.logical_or.reduceat(anchor, at)
        doc, grams = doc[at], grams[at]  # a row for each hash and document
        head = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
        times = np.diff(np.append(head, len(grams)))
        shared = np.repeat(times > 1, times)
        rows = []
        one = np.logical_or.reduceat(anchor, head)
        for here, names in ((head, 0), (np.flatnonzero(shared), 1)):
            order = np.argsort(doc[here], kind="stable")
            here = here[order]
            g = grams[here]
            flags = one[order] if not names else anchor[here]
            which = (g % np.uint64(buckets)).astype(np.int64)
            for b, ids, counts, c in _by_bucket(which, doc[here], {"g": g // np.uint64(buckets), "a": flags}):
                # what a slice knows already goes through a bucket that does not depend on the hash
                key = -1 - (b + int(doc[0])) % buckets if names else b
                rows.append((key, b, ids, counts, c["g"].astype(np.uint32), np.packbits(c["a"])))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), packed([r[2] for r in rows], np.int64), packed([r[3] for r in rows], np.int32), packed([r[4] for r in rows], np.uint32), packed([r[5] for r in rows], np.uint8)],
            ["bucket", "part", "ids", "counts", "prints", "anchors"],
        )

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), NOT_SPACE)
                inside = within(doc := words.doc, BLOCK)
                if not inside.any():
                    continue
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                parts.append((ids[doc[: len(inside)][inside]], ngrams(words.hashes(), BLOCK)[inside], (words.place[: len(inside)] % BLOCK == 0)[inside]))
                size += len(parts[-1][0])
                if size >= SEND:
                    yield send(parts)
                    parts, size = [], 0
        if parts:
            yield send(parts)

    return run


PROBES = "bucket int, part int, ids binary, counts binary, prints binary, anchors binary"


def _grouped(groups: int, doc: np.ndarray, values: np.ndarray) -> Iterator[tuple]:
    """(group of documents, ids, counts, values): what goes back to the documents, packed."""
    order = np.argsort(doc, kind="stable")
    doc, values = doc[order], values[order]
    which = (mix(doc.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
    for b, ids, counts, c in _by_bucket(which, doc, {"v": values}):
        yield b, ids, counts, c["v"]


def _answers(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), packed([r[1] for r in rows], np.int64), packed([r[2] for r in rows], np.int32), packed([r[3] for r in rows], np.uint64)], ["group", "ids", "counts", "found"])


ANSWERS = "group int, ids binary, counts binary, found binary"


def _gathered(table: pa.Table) -> pa.Table:
    """Of one group of documents, a row (doc_id, found) each; found as 64-bit hashes."""
    doc = np.repeat(unpacked(table.column("ids"), np.int64), unpacked(table.column("counts"), np.int32))
    found = unpacked(table.column("found"), np.uint64)
    order = np.lexsort((found, doc))
    doc, found = doc[order], found[order]
    edges = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, int)
    return pa.table([pa.array(doc[edges], pa.int64()), packed(np.split(found, edges[1:]) if len(edges) else [], np.uint64)], ["doc_id", "found"])


def _anchored(groups: int):
    """Of one bucket, the hashes that hit a block of another document."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:  # known to repeat; hashes of all buckets
            part = np.repeat(table.column("part").to_numpy(), [len(x) // 4 for x in table.column("prints").to_pylist()])
            doc = np.repeat(unpacked(table.column("ids"), np.int64), unpacked(table.column("counts"), np.int32))
            whole = unpacked(table.column("prints"), np.uint32).astype(np.uint64) * np.uint64(groups) + part.astype(np.uint64)
            return _answers(list(_grouped(groups, doc, whole)))
        doc = np.repeat(unpacked(table.column("ids"), np.int64), unpacked(table.column("counts"), np.int32))
        prints = unpacked(table.column("prints"), np.uint32)
        anchor = np.concatenate([np.unpackbits(np.frombuffer(a, np.uint8), count=len(p) // 4).astype(bool) for a, p in zip(table.column("anchors").to_pylist(), table.column("prints").to_pylist(), strict=True)])
        order = np.argsort(prints, kind="stable")
        doc, prints, anchor = doc[order], prints[order], anchor[order]
        head = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
        times = np.diff(np.append(head, len(prints)))
        hit = np.repeat((np.maximum.reduceat(doc, head) > np.minimum.reduceat(doc, head)) & np.logical_or.reduceat(anchor, head), times)
        return _answers(list(_grouped(groups, doc[hit], prints[hit].astype(np.uint64) * np.uint64(groups) + np.uint64(bucket))))

    return run


def _windows(buckets: int):
    """Rows (bucket, ids, counts, windows): hashes of the 13-word windows around the anchors, gathered over SEND of them."""

    def send(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        ids, g = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, g))
        ids, g = ids[order], g[order]
        new = np.append(True, (g[1:] != g[:-1]) | (ids[1:] != ids[:-1]))
        ids, g = ids[new], g[new]
        # a window of several documents that are sent together: all but the least are repeats, the least one asks
        least = np.append(True, g[1:] != g[:-1])
        rows = []
        for here, known in ((least, 0), (~least, 1)):
            i, h = ids[here], g[here]
            order = np.argsort(i, kind="stable")
            i, h = i[order], h[order]
            for b, who, counts, c in _by_bucket((mix(h) % np.uint64(buckets)).astype(np.int64), i, {"g": h}):
                rows.append((-1 - (b + int(ids[0])) % buckets if known else b, who, counts, c["g"]))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), packed([r[1] for r in rows], np.int64), packed([r[2] for r in rows], np.int32), packed([r[3] for r in rows], np.uint64)], ["bucket", "ids", "counts", "windows"])

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), NOT_SPACE)
                inside = within(words.doc, BLOCK)
                if not inside.any():
                    continue
                hashes, doc = words.hashes(), words.doc
                grams = ngrams(hashes, BLOCK)
                found = np.zeros(len(grams), bool)
                for k, keys in enumerate(part.column("found").to_pylist()):
                    own = slice(words.first[k], max(words.first[k], min(words.first[k + 1] - BLOCK + 1, len(grams))))
                    if keys:
                        g = grams[own]
                        bits = (g // np.uint64(buckets)).astype(np.uint32).astype(np.uint64) * np.uint64(buckets) + g % np.uint64(buckets)
                        found[own] = np.isin(bits, np.frombuffer(keys, np.uint64))
                spans, whole = ngrams(hashes, SPAN), within(doc, SPAN)
                near = np.zeros(len(spans), bool)
                for back in range(SPAN - BLOCK + 1):
                    near |= found[back : back + len(spans)]
                at = np.flatnonzero(near & whole)
                if not len(at):
                    continue
                parts.append((part.column("doc_id").to_numpy(zero_copy_only=False)[doc[at]], spans[at]))
                size += len(at)
                if size >= SEND:
                    yield send(parts)
                    parts, size = [], 0
        if parts:
            yield send(parts)

    return run


WINDOWS = "bucket int, ids binary, counts binary, windows binary"


def _repeats(groups: int):
    """Of one bucket, the windows of each document that a document with a smaller id has too."""

    def run(table: pa.Table) -> pa.Table:
        doc = np.repeat(unpacked(table.column("ids"), np.int64), unpacked(table.column("counts"), np.int32))
        g = unpacked(table.column("windows"), np.uint64)
        if table.column("bucket")[0].as_py() >= 0:
            order = np.argsort(g, kind="stable")
            doc, g = doc[order], g[order]
            head = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            later = doc > np.repeat(np.minimum.reduceat(doc, head), np.diff(np.append(head, len(g))))
            doc, g = doc[later], g[later]
        return _answers(list(_grouped(groups, doc, g)))

    return run


def _kept(batches):
    for batch in batches:
        for part in slices(batch):
            words = Words(part.column("text"), NOT_SPACE)
            gone = np.zeros(words.n, bool)
            spans = None
            for k, known in enumerate(part.column("found").to_pylist()):
                if known and words.counts[k] >= SPAN:
                    spans = ngrams(words.hashes(), SPAN) if spans is None else spans
                    own = slice(words.first[k], words.first[k + 1])
                    at = np.flatnonzero(np.isin(spans[own.start : own.stop - SPAN + 1], np.frombuffer(known, np.uint64)))
                    gone[own] = spans_flagged(at, SPAN, own.stop - own.start)
            texts = []
            for k in range(words.docs):
                raw = words.data[words.offsets[k] : words.offsets[k + 1]].tobytes().split()
                own = gone[words.first[k] : words.first[k + 1]]
                texts.append(b" ".join(w for w, x in zip(raw, own, strict=True) if not x) if own.any() else b" ".join(raw))
            removed = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(words.first[:-1], words.n)) * (words.counts > 0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """Each document without the words of 13-word windows that also start in a document with a smaller id.

    Returns doc_id, n_words, n_removed, kept (the other words, joined by one space), a row for each row of docs.
    Windows are judged on the input. Null and empty texts have no words; texts of under 13 words lose nothing.
    Rows that share a doc_id are one document as to what is smaller, and don't remove each other's words;
    a row without doc_id neither removes nor loses words. Other columns are ignored; an empty table gives no rows."""
    docs = docs.select("doc_id", "text")
    named = docs.where(F.col("doc_id").isNotNull())
    buckets = max(BUCKETS, text_bytes_of(named) // BUCKET_BYTES)
    gathered = lambda answers: answers.groupBy("group").applyInArrow(_gathered, "doc_id long, found binary")
    anchors = stored(named.mapInArrow(_probes(buckets), PROBES).groupBy("bucket").applyInArrow(_anchored(buckets), ANSWERS), "anchors")
    found = named.join(gathered(anchors).hint("shuffle_merge"), "doc_id").select("doc_id", "text", "found").mapInArrow(_windows(buckets), WINDOWS)
    repeats = stored(found.groupBy("bucket").applyInArrow(_repeats(buckets), ANSWERS), "repeats")
    dropped(anchors)
    lists = gathered(repeats)
    return docs.join(lists.hint("shuffle_merge"), "doc_id", "left").select("doc_id", "text", "found").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")


def report(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple[int, int, int, str]]:
    """The report, by looking every window up in a dictionary of least ids."""
    import re

    cut = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least: dict = {}
    for i, w in cut:
        for p in range(len(w) - SPAN + 1):
            key = tuple(w[p : p + SPAN])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in cut:
        gone = {q for p in range(len(w) - SPAN + 1) if least[tuple(w[p : p + SPAN])] < i for q in range(p, p + SPAN)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for q, x in enumerate(w) if q not in gone).encode()).hexdigest()))
    return out
