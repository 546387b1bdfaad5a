"""Very long and repetitive texts: time and memory in proportion to the text."""

import random
import resource

import pyarrow as pa
from pyspark.sql import functions as F

from cellspark.llm import decontaminate, secrets
from cellspark.llm.arrays import ALNUM, Words, releasing
from cellspark.llm.store import stored


def test_one_word_against_one_word(spark):
    """A megabyte of one word in a document and in an item: no product of their places."""
    n = 200_000
    text = "word " * n
    index = decontaminate.Index(pa.table({"text": [text, "word other"], "ids": [["7"], ["8"]]}))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = {size: (len(places), index.texts(size, places * 0, sets).tolist()) for places, size, sets in index.hits(Words(pa.array([text]), ALNUM, lower=True))}
    assert found[10] == (n - 9, [[0, 0]]) and found[2] == (0, [])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # kilobytes
    docs = spark.createDataFrame([(1, text), (2, "word other word")], "doc_id long, text string")
    items = spark.createDataFrame([(7, text), (8, "word other")], "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.report(decontaminate.contamination(docs, items)).collect()}
    assert (rows[1]["n_hit"], rows[1]["n_items"], rows[2]["n_hit"], rows[2]["n_items"]) == (n, 1, 2, 1)


def test_many_items_with_one_passage():
    passage = " ".join(f"p{k}" for k in range(300))
    index = decontaminate.Index(pa.table({"text": [f"{passage} t{k}" for k in range(400)], "ids": [[str(k)] for k in range(400)]}))
    _, which, begin, text = index.windows[10]
    assert len(begin) - 1 == 401 and len(text) == 800  # the windows of the passage have one set
    words = Words(pa.array([passage, "x", passage]), ALNUM, lower=True)
    for places, size, sets in index.hits(words):
        pairs = index.texts(size, words.doc[places], sets)
        assert len(pairs) == 800 and set(pairs[:, 0].tolist()) == {0, 2}


def redacted_one_by_one(text, spans, mark):
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out.append(text[at:a] + mark)
        at = max(at, b)
    return "".join(out) + text[at:]


def test_spans_cut_out_in_blocks(spark):
    rng, rows = random.Random(1), []
    for _ in range(200):
        text = "".join(rng.choice("abéZ 😀x") for _ in range(rng.randint(1, 300)))
        spans = sorted((a, min(a + rng.randint(1, 20), len(text))) for a in (rng.randrange(len(text)) for _ in range(rng.randint(1, 40))))
        rows.append((text, spans, redacted_one_by_one(text, spans, "[S]")))
    df = spark.createDataFrame(rows, "text string, spans array<struct<start:int,end:int>>, want string")
    assert df.where(secrets._without(F.col("text"), F.col("spans"), "[S]") != F.col("want")).count() == 0


def test_a_token_of_a_megabyte(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefABCDEFghijGHIJ0123456789+/") for _ in range(1_000_000))
    df = spark.createDataFrame([(1, text), (2, "deadbeef0123456789 " * 2000)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in secrets.secrets(df).collect()}
    assert "markov:0:1000000" in rows[1]["spans"].split(",") and rows[2]["n_hex"] == 2000
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(df).collect()}
    assert clean[1] == "[SECRET]" and clean[2] == "[SECRET] " * 2000


def test_stored_hands_over_long_texts_a_few_megabytes_at_once(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    docs = spark.range(0, 60, 1, 1).select("id", F.repeat(F.lit("x"), 1 << 20).alias("text"))
    rows = stored(docs.mapInArrow(releasing(sizes), "n long, bytes long"), "sizes").collect()
    assert sum(r["n"] for r in rows) == 60
    assert max(r["bytes"] for r in rows) < 12 << 20
    assert stored(docs.where("id < 0").mapInArrow(releasing(sizes), "n long, bytes long"), "sizes").count() == 0
