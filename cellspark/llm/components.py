"""Connected components by alternating large and small stars (Kiveris et al., 2014), on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import dropped, few, stored, with_facts

#: From so many edges on, a hub that has many of them is joined by broadcast; fewer edges are no task's burden.
MANY = 1 << 20


def _least(edges: DataFrame, key: str, other: str, total: int) -> DataFrame:
    """edges with m, the least of a node's others."""
    facts = edges.groupBy(key).agg(F.min(other).alias("m"), F.count("*").alias("n"))
    if total < MANY:
        return edges.join(facts.drop("n"), key)
    facts = stored(facts, "hubs")
    return with_facts(edges, facts, key, other, total)


def _large(edges: DataFrame, total: int) -> DataFrame:
    """Each larger neighbour of a node is tied to the least of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _least(both, "a", "b", 2 * total).where("b > a").select(F.least("m", "a").alias("a"), "b").where("a <> b").distinct()


def _small(edges: DataFrame, total: int) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them; edges hold a < b."""
    tied = _least(edges, "b", "a", total).select("a", "b", "m")
    # the edge of the least neighbour gives that of the node itself
    return tied.select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a < b) but the least of each component, which is the component of the others."""
    now = stored(edges.select("a", "b").distinct(), "edges")
    mark, total = None, now.count()
    while True:
        after = stored(few(_small(_large(now, total), total), total), "edges")
        dropped(now)
        now, before = after, mark
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component"))
