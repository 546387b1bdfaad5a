"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, dropped


#: From so many edges on, what a round needs twice or joins by a hub's key is a table, whose size Spark knows and whose skewed
#: partitions it can split; fewer edges are no task's burden, and a round is one job.
MANY = 1 << 20


def _held(df: DataFrame, name: str, total: int, tables: list[DataFrame]) -> DataFrame:
    if total < MANY:
        return df
    tables.append(cut(df, name))
    return tables[-1]


def _wide(df: DataFrame, total: int) -> DataFrame:
    """df, not to be broadcast where there are many edges: names pack so well in files that their size tells little of what the driver would hold."""
    return df.hint("merge") if total >= MANY // 8 else df


def _least(edges: DataFrame) -> DataFrame:
    """(b, m): the least smaller neighbour of each node that has one."""
    return edges.groupBy("b").agg(F.min("a").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the least node that it reaches.

    Alternating stars (Kiveris et al., 2014), in about as many rounds as the number of nodes has bits. Edges point from the smaller
    node to the larger one. The large star ties a node's larger neighbours to the least node that it knows, the small star a node
    and its smaller neighbours to the least of these, until all edges are those of stars. A node without smaller neighbours,
    as the middle of a grown star is, changes nothing in the large star: its edges stay as they are. Nodes may be of any
    type that has an order, structs included; edges with a null end are no edges."""
    known = edges.select("a", "b").where("a is not null and b is not null")
    every = cut(known.select(F.col("a").alias("node")).union(known.select("b")).distinct(), "nodes")
    now = cut(known.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark, total = None, now.count()
    while True:
        tables = [now]
        above = _wide(_held(_least(now), "least", total, tables), total)
        large = now.join(above.select(F.col("b").alias("a"), "m"), "a", "left").select(F.coalesce("m", "a").alias("a"), "b").distinct()
        large = _held(large, "large", total, tables)
        tied = large.join(_wide(_held(_least(large), "least", total, tables), total), "b")
        # the edge of the least neighbour gives that of the node itself
        small = tied.select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b")).distinct()
        now = cut(small, "edges")
        dropped(*tables)
        before, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == before:
            return every.join(_wide(now.select(F.col("b").alias("node"), F.col("a").alias("component")), total), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
