"""Token counts, clustering and alignment against the libraries and brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from cellspark.llm import alignment, shallot, token_count

DOCS = "doc_id long, text string, n_tokens string, `row` string, `a.b` string"


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOCS).repartition(3)


def mixed(seed, n, letters):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(n)]


SIGNS = ["a", "b", "th", "e", "ing", " ", "  ", "'", "s", "re", "'ll", "é", "1", "9", "!", "?", "\n", "\t", "ß", "İ", "́", "the", "in", "Σ", "Q", "<|endoftext|>", "<|startoftext|>", "<|", "<s>", "ſ", "ǅ", "ﬁ", "ا", "๓", "Ⅷ", "　", "\x1c", "\x00", "日本", "한", "▁", "😀", "}\r"]
PLACES = [(1, None), (2, ""), (3, " "), (None, "a word"), (None, "a word"), (4, "don't WE'LL 'tis ''s !'s 're' x'r"), (4, "other text"), (5, "x" * 5000), (6, "ab'" * 3000), (7, "\n\n  two  \n three ")]


@pytest.fixture(scope="module")
def rows():
    return PLACES + list(enumerate(mixed(3, 600, SIGNS), 100)) + list(enumerate(mixed(4, 100, "abcdefghij"), 1000))


@pytest.fixture(scope="module")
def word_tokenizer():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_token_counts_are_the_librarys(spark, rows, word_tokenizer):
    want = []
    for i, t in rows:
        n = len(word_tokenizer.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 40))
    assert plain(token_count.counted(docs_of(spark, rows), limit=40)) == sorted(want, key=repr)
    assert token_count.counted(docs_of(spark, rows[:1]).limit(0)).count() == 0


@pytest.mark.parametrize("lanes, chunk, piece", [(4096, 64, 1 << 20), (3, 2, 50), (7, 5, 1000)])
def test_chunks_and_pieces_do_not_change_counts(monkeypatch, rows, word_tokenizer, lanes, chunk, piece):
    for name, value in (("LANES", lanes), ("CHUNK", chunk), ("PIECE", piece)):
        monkeypatch.setattr(token_count, name, value)
    texts = [t for _, t in rows] + ["ab" * 4000, "".join(mixed(5, 40, "abcdefghijklmnopqrstuvwxyz"))]
    want = [len(e.ids) for e in word_tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    counter = token_count.counter(public_tokenizers.path("word_bpe_49k.json"))
    assert counter.counts(texts).tolist() == want


def test_states_are_made_anew(monkeypatch, word_tokenizer):
    counter = token_count.counter(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(counter.merges, "STATES", 10)
    for seed in range(3):
        texts = mixed(seed, 30, "abcdefghijklmnopqrstuvwxyz")
        assert counter.counts(texts).tolist() == [len(word_tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    counter.merges.forget()


def test_other_tokenizers_are_not_compiled():
    with pytest.raises(ValueError, match="split into words"):
        token_count.Counter(public_tokenizers.path("byte_bpe_50k.json"))


def word_starts_one_by_one(kinds):
    state, out = token_count.OPEN, []
    for k in kinds:
        out.append(bool(token_count.BEGINS[state * 8 + k]))
        state = int(token_count.TO[state * 8 + k])
    return out


def test_maps_of_chunks_compose(monkeypatch):
    monkeypatch.setattr(token_count, "CHUNK", 3)
    monkeypatch.setattr(token_count, "LANES", 50)
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 100, 1000):
        kinds = rng.integers(0, 6, n).astype(np.uint8)
        assert token_count.word_starts(kinds).tolist() == word_starts_one_by_one(kinds.tolist())


def brute_clusters(vectors, k, rounds):
    kept = [(i, [int(np.floor(256 * float(v))) for v in x]) for i, x in vectors if x is not None and len(x) == 64 and all(v is not None and np.isfinite(v) for v in x)]
    c = [x for _, x in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda x: min((sum((p - q) ** 2 for p, q in zip(x, y, strict=True)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for j in range(len(c)):
            members = [x for (_, x), o in zip(kept, own, strict=True) if o == j]
            if members:
                c[j] = [sum(v) // len(members) for v in zip(*members, strict=True)]
    found = [near(x) for _, x in kept]
    inertia = Counter()
    for d, j in found:
        inertia[j] += d
    return [(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, found, strict=True)]


@pytest.mark.parametrize("kind", ["blobs", "ties", "few"])
def test_clusters(spark, kind):
    rng = np.random.default_rng(1)
    if kind == "blobs":
        middle = rng.normal(0, 1, (9, 64))
        x = (middle[rng.integers(0, 9, 250)] + rng.normal(0, 0.1, (250, 64))).tolist()
    else:  # many equal vectors and equal distances
        x = (rng.integers(0, 2, (160 if kind == "ties" else 3, 64)) * (np.arange(64) < 5) / 2).tolist()
    rows = list(enumerate(x)) + [(None, x[0]), (3, x[1]), (1000, None), (1001, [0.5] * 63), (1002, [float("nan")] * 64), (1003, [float("inf")] + [0.0] * 63), (1004, [None] + [0.0] * 63), (1005, [])]
    df = spark.createDataFrame([(i, v, 7, "c") for i, v in rows], "vec_id long, embedding array<double>, label int, cluster string").repartition(3)
    k = 8
    assert plain(shallot.clusters(df, k=k, rounds=4)) == sorted(brute_clusters(rows, k, 4), key=repr)
    assert shallot.clusters(df.limit(0)).count() == 0


def test_bounds_save_distances():
    """Far groups: after the first look, the bounds alone decide."""
    rng = np.random.default_rng(3)
    c = rng.integers(-1000, 1000, (40, 64)) * 100
    a = rng.integers(0, 40, 500)
    x = c[a] + rng.integers(-5, 5, (500, 64))
    search, state = shallot.Search(c), (np.zeros(500, np.int32), np.full(500, 39, np.int32), np.full(500, np.inf), np.zeros(500))
    search.nearest(x, *state)
    assert state[0].tolist() == a.tolist() and (state[2] < np.maximum(search.half[state[0]], state[3])).all()
    exact = np.array([np.sort(np.sqrt(((v - c) ** 2).sum(1)))[:2] for v in x])
    assert (state[2] >= exact[:, 0]).all() and (state[3] <= exact[:, 1]).all()


def brute_alignment(rows):
    a_own = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_own.encode_special_tokens = True
    b_own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    to_byte = {c: b for b, c in enumerate(token_count.byte_letters())}
    out, counts = [], Counter()
    for i, t in rows:
        whole = f" {t or ''}"
        a = a_own.encode(whole, add_special_tokens=False).ids if t else []
        b = b_own.encode(t) if t else []
        a_bytes = [bytes(to_byte[c] for c in a_own.id_to_token(k)) for k in a]
        b_bytes = [bytes([int(b_own.id_to_piece(k)[3:5], 16)]) if b_own.is_byte(k) else b_own.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if not t or b"".join(a_bytes) != whole.encode() or b"".join(b_bytes) != whole.encode():
            out.append((i, [], [], [], []))
            continue
        owner = [[k for k, x in enumerate(parts) for _ in x] for parts in (a_bytes, b_bytes)]
        links = sorted(set(zip(*owner, strict=True)))
        ends = [set(np.cumsum([len(x) for x in parts]).tolist()) for parts in (a_bytes, b_bytes)]
        groups, at = [], 0
        for end in sorted(ends[0] & ends[1]):
            groups.append("|".join(",".join(str(ids[k]) for k in sorted(set(own[at:end]))) for ids, own in ((a, owner[0]), (b, owner[1]))))
            at = end
        links = [(a[p], b[q]) for p, q in links]
        counts.update(links)
        out.append((i, a, b, groups, links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(i, len(a), len(b), len(g), len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "", ";".join(g)) for i, a, b, g, ls in out]


@pytest.mark.parametrize("hot", [1 << 19, 200, 0])
def test_alignment(spark, rows, hot):
    want = brute_alignment(rows)
    assert plain(alignment.aligned(docs_of(spark, rows), hot=hot)) == sorted((r[:-1] for r in want), key=repr)
    if not hot:
        assert plain(alignment.groups(docs_of(spark, rows))) == sorted(((r[0], r[-1]) for r in want), key=repr)
        assert alignment.aligned(docs_of(spark, rows[:1]).limit(0)).count() == 0


def test_alignment_forgets(monkeypatch, rows):
    own = alignment.Aligner(*alignment._paths(None, None))
    texts = [t for _, t in rows]
    want = [[own.texts[k] for k in at] for at in own.places(texts)]
    monkeypatch.setattr(alignment, "REMEMBERED", 5)
    got = []
    for t in texts:
        got.append([own.texts[k] for k in own.places([t])[0]])
    assert got == want
