"""Components and lineage cuts."""

import os

import pytest
from pyspark.sql import functions as F

from cellspark.operators import graph
from cellspark.plans import lineage


def size_bits(df):
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length()


def test_size_estimates_do_not_grow(spark):
    now = spark.range(20).select("id", F.col("id").alias("low"))
    for _ in range(40):
        last = now
        now = lineage.cut(now.join(now.select(F.col("id").alias("low"), F.col("low").alias("up")), "low").select("id", F.least("low", "up").alias("low")))
        assert size_bits(now) < 64
        if "cut" in str(last.inputFiles()):
            lineage.dropped(last)
            assert not os.path.exists(last.inputFiles()[0].removeprefix("file:"))
    assert now.count() == 20


@pytest.mark.parametrize("kind, many", [("chain", 1 << 20), ("grid", 1 << 20), ("shuffled", 1 << 20), ("shuffled", 0)])
def test_rounds_grow_with_the_logarithm(spark, monkeypatch, kind, many):
    n = 256
    monkeypatch.setattr(graph, "MANY", many)
    if kind == "grid":
        pairs = [(16 * y + x, 16 * y + x + d) for y in range(16) for x in range(16) for d, ok in ((1, x < 15), (16, y < 15)) if ok]
    else:
        pairs = [(k, k + 1) for k in range(n - 1)]
    if kind == "shuffled":
        pairs = [(a * 97 % n, b * 97 % n) for a, b in pairs]
    rounds = []
    monkeypatch.setattr(graph, "cut", lambda df, name: (rounds.append(name), lineage.cut(df, name))[1])
    rows = graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(rows) == n and {r["component"] for r in rows} == {0}
    assert rounds.count("edges") - 1 <= 2 * n.bit_length() and rounds.count("large") == (0 if many else rounds.count("edges") - 1)


def test_components_of_any_type(spark):
    names = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "x"), ("y", None), ("z", "y"), ("y", "z")], "a string, b string")
    assert {(r["node"], r["component"]) for r in graph.components(names).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "y"), ("z", "y")}
    pairs = names.select(F.struct(F.lit(1).alias("k"), F.col("a").alias("n")).alias("a"), F.struct(F.lit(0).alias("k"), F.col("b").alias("n")).alias("b"))
    rows = graph.components(pairs).collect()
    assert all(tuple(r["component"]) <= tuple(r["node"]) for r in rows if None not in (*r["component"], *r["node"]))
    assert graph.components(names.where("false")).count() == 0
