"""Statistics, discriminant and FTRL training against plain Python; rows that repeat, ties, nulls and long texts."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cellspark.llm import quality, toxicity

TEXTS = [None, "", " \n\t", "The THE the. Then? 12% of | x|y\nline\nline\n\n##$ A<b>c", "Été à l'école – naïve 日本。", "a " * 50, "x", "WORDS IN CAPITALS AND 3 more!\r\nnext\tline", "same line.\n" * 9, "e" * 5000, "a b " * 6000 + "$$ ##"]


def brute_statistics(text):
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    low = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in words]
    lines = re.findall(rb"[^\n]+", raw)
    n, size = max(len(words), 1), max(len(raw), 1)
    letters, upper, symbols = ([c for c in raw if flags[c]] for flags in (quality.LETTER, quality.UPPER, quality.SYMBOL))
    pairs = list(zip(low, low[1:], strict=False))
    share = lambda a, b: math.asin(math.sqrt(min(max(a / b, 0), 1)))
    count = lambda w, flags: sum(bool(flags[c]) for c in w)
    return [
        math.log1p(len(words)),
        math.log1p(size / n) if text else math.log1p(1 / n),
        share(len(upper), max(len(letters), 1)),
        share(sum(48 <= c < 58 for c in raw), size),
        share(len(symbols), size),
        share(len(set(low)), n),
        share(sum(a == b for a, b in pairs), n),
        share(len(pairs) - len(set(pairs)), n),
        share(sum(count(w, quality.SYMBOL) > 1 for w in words), n),
        math.log1p(len(words) / max(len(lines), 1)),
        share(len(lines) - len(set(lines)), max(len(lines), 1)) if lines else 0.0,
        share(sum(2 * count(w, quality.UPPER) > count(w, quality.LETTER) for w in words), n),
        share(sum(c in b".?" for c in raw), n),
    ]


def test_statistics_by_plain_python():
    got = quality.statistics(pa.array(TEXTS))
    assert got.shape == (len(TEXTS), len(quality.NAMES))
    assert np.allclose(got, [brute_statistics(t) for t in TEXTS], atol=1e-9)


def quality_rows(n=300):
    rng = random.Random(7)
    make = lambda k: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(k))
    rows = [(i, "### " + " ".join("$$$" for _ in range(i % 30)) + " Buy NOW " + make(i % 7) if i % 3 == 0 else make(30 + i % 50).capitalize() + ". " + make(9) + ".") for i in range(n)]
    return rows + [(1000 + k, t) for k, t in enumerate(TEXTS)] + [(4, rows[4][1]), (4, rows[4][1]), (None, rows[5][1]), (2000, rows[5][1])]


def held(i, folds, out):
    return zlib.crc32(("" if i is None else str(i)).encode()) % folds == out


def test_quality_by_brute_force(spark):
    rows = quality_rows()
    labels = [(i, int(i % 3 != 0)) for i in range(300)] + [(1003, 0), (1004, None), (1005, 7), (None, 1), (8, 1), (8, 0)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, stats string, label double").repartition(3)
    got = quality.quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    known = {}
    for i, y in labels:
        if i is not None and y in (0, 1) and not held(i, 5, 0):
            known[i] = max(known.get(i, 0), y)
    x = [(i, np.array(brute_statistics(t))) for i, t in rows]
    own = {k: np.array([v for i, v in x if i in known and known[i] == k]) for k in (0, 1)}
    d = len(quality.NAMES)
    spread = {k: (own[k] - own[k].mean(0)).T @ (own[k] - own[k].mean(0)) for k in (0, 1)}
    n = {k: len(own[k]) for k in (0, 1)}
    pooled = (spread[0] + spread[1]) / (n[0] + n[1] - 2)
    want = []
    for i, v in x:
        log = {}
        for k in (0, 1):
            weight = quality.POOLED * max(n[k], d)
            c = (spread[k] + weight * pooled) / (n[k] + weight)
            c = (1 - quality.DIAGONAL) * c + quality.DIAGONAL * np.diag(np.diag(pooled)) + 1e-4 * np.eye(d)
            off = v - own[k].mean(0)
            log[k] = -0.5 * off @ np.linalg.solve(c, off) - 0.5 * np.linalg.slogdet(c)[1] + math.log(n[k] + 1)
        score = 1 / (1 + math.exp(-max(-35.0, min(35.0, log[1] - log[0]))))
        want.append((i, held(i, 5, 0), score, int(score >= 0.3)))
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=repr), sorted(want, key=repr), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-6) and (g[3] == w[3] or abs(w[2] - 0.3) < 1e-6)
    assert len({r["score"] for r in got if r["doc_id"] == 4}) == 1 and len([r for r in got if r["doc_id"] == 4]) == 3


U = np.uint64


def brute_features(text):
    """Different indices of a text's words, pairs and skip-grams, a word at a time."""
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode())
    base, mask = int(toxicity.WORD_BASE), (1 << 64) - 1
    h = [int(toxicity.Words(pa.array([w], pa.binary()), toxicity.ALNUM).hashes()[0]) for w in words]
    keys = list(h)
    for gap in (1, 2):
        keys += [int(toxicity.mix(np.array([(a * base + b + gap) & mask], U))[0]) for a, b in zip(h, h[gap:], strict=False)]
    return sorted({k >> (64 - toxicity.BITS) for k in keys})


def test_toxicity_by_brute_force(spark):
    rng = random.Random(3)
    make = lambda k: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(k))
    rows = [(i, make(i % 9 + 2) + (" You idiot! " if i % 3 == 0 else " you friend ") + make(i % 5)) for i in range(150)]
    rows += [(1000 + k, t) for k, t in enumerate(TEXTS[:9])] + [(4, rows[4][1]), (None, rows[3][1]), (2000, rows[3][1])]
    labels = [(i, int(i % 3 == 0)) for i in range(150)] + [(1002, None), (1003, 5), (None, 1), (8, 1), (8, 0)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string").repartition(3)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    known = {}
    for i, y in labels:
        if i is not None and y in (0, 1) and not held(i, 3, 1):
            known[i] = max(known.get(i, 0), y)
    turn = {r["doc_id"]: r["turn"] for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id, 'turn'), 1 << 30) turn").collect()}
    train = sorted((turn[i], i, known[i], t) for i, t in rows if i in known and t is not None)
    z, n = {}, {}
    bias = 1 << toxicity.BITS

    def weight(k):
        own = 0.0 if k == bias else toxicity.L1
        if abs(z.get(k, 0.0)) <= own:
            return 0.0
        return -(z[k] - math.copysign(own, z[k])) / ((toxicity.BETA + math.sqrt(n[k])) / toxicity.ALPHA + toxicity.L2)

    sigmoid = lambda v: 1 / (1 + math.exp(-max(-35.0, min(35.0, v))))
    for _ in range(toxicity.EPOCHS):
        for _, _, y, t in train:
            at = [*brute_features(t), bias]
            w = {k: weight(k) for k in at}
            g = sigmoid(sum(w.values())) - y
            for k in at:
                before = n.get(k, 0.0)
                n[k] = before + g * g
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n[k]) - math.sqrt(before)) / toxicity.ALPHA * w[k]
    want = []
    for i, t in rows:
        score = sigmoid(sum(weight(k) for k in [*brute_features(t), bias]))
        want.append((i, held(i, 3, 1), score, int(score >= 0.7)))
    got = toxicity.toxicity(docs, table).collect()
    for g, w in zip(sorted(map(tuple, got), key=repr), sorted(want, key=repr), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-9) and g[3] == w[3]
    assert sum(weight(k) != 0 for k in z) < len(z) / 2  # L1 leaves most weights at 0


def test_toxicity_of_several_shards_and_of_none(spark, monkeypatch):
    rows = [(i, "good words here" if i % 2 else "bad idiot here") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(200)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 30)
    out = toxicity.toxicity(docs, labels).collect()
    assert all(r["predicted"] == (r["doc_id"] % 2 == 0) for r in out)
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}
