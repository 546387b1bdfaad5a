"""Reads to expression table, phases and pseudotime."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import cut, dropped

#: Lengths of cell barcode and molecular tag by kit.
KITS = {"3prime:v3": (16, 12), "3prime:v2": (16, 10), "5prime:v1": (16, 10)}


def extract_barcodes(reads: DataFrame, kit: str = "3prime:v3") -> DataFrame:
    a, b = KITS[kit]
    return reads.withColumns({"barcode": F.substring("seq", 1, a), "umi": F.substring("seq", a + 1, b), "insert": F.substring("seq", a + b + 1, 1 << 30)})


def tag_sample_barcode(reads: DataFrame, conditions: DataFrame) -> DataFrame:
    """Reads with the condition that their barcode stands for (conditions: barcode, condition); others go. Spark broadcasts
    conditions where their size is known to be small, and shuffles otherwise."""
    return reads.join(conditions.select("barcode", "condition"), "barcode")


def with_cells(expression: DataFrame, cells: DataFrame) -> DataFrame:
    """Expression rows with the attributes of their cell; rows of cells without attributes keep nulls."""
    return expression.join(cells, "cell", "left")


def filter_barcodes(reads: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Reads with a known barcode."""
    return reads.join(whitelist.select("barcode"), "barcode", "left_semi")


def correct_barcodes(reads: DataFrame, whitelist: DataFrame) -> DataFrame:
    """(barcode, corrected): unknown barcodes that differ in one place from exactly one known one.

    A known barcode has as many rows as places here, which Spark's estimate of its size does not know of: it is never broadcast."""
    unknown = reads.select("barcode").distinct().join(whitelist.select("barcode").hint("merge"), "barcode", "left_anti")
    place = F.sequence(F.lit(1), F.length("code"))
    wild = lambda df, name: df.select(F.col("barcode").alias("code")).select(F.col("code").alias(name), F.explode(F.transform(place, lambda i: F.concat(F.substring("code", F.lit(1), i - 1), F.lit("*"), F.substring("code", i + 1, F.length("code"))))).alias("key"))
    hits = wild(unknown, "barcode").join(wild(whitelist, "known").hint("merge"), "key").select("barcode", "known").distinct()
    return hits.groupBy("barcode").agg(F.count("*").alias("n"), F.min("known").alias("corrected")).where("n = 1").select("barcode", "corrected")


def count_matrix(reads: DataFrame) -> DataFrame:
    """Distinct molecules of each cell and gene; duplicates go first, on a key that spreads hot genes and cells."""
    return reads.select("barcode", "gene", "umi").distinct().groupBy(F.col("barcode").alias("cell"), "gene").agg(F.count("*").alias("n"))


def call_cells(counts: DataFrame, expected: int = 100) -> DataFrame:
    """The expected number of cells, those with most molecules."""
    return counts.groupBy("cell").agg(F.sum("n").alias("molecules")).orderBy(F.desc("molecules"), "cell").limit(expected)


def genes_per_cell(counts: DataFrame) -> DataFrame:
    return counts.groupBy("cell").agg(F.count_distinct("gene").alias("n_genes"))


def genes_expressed(counts: DataFrame, conditions: DataFrame) -> DataFrame:
    """Genes expressed by condition, and in all (null condition)."""
    return counts.join(conditions, "cell").rollup("condition").agg(F.count_distinct("gene").alias("n_genes"))


def log_normalize(counts: DataFrame, target: float = 10_000.0) -> DataFrame:
    total = counts.groupBy("cell").agg(F.sum("n").alias("total"))
    return counts.join(total, "cell").select("cell", "gene", F.log1p(F.col("n") * target / F.col("total")).alias("value"))


def cell_cycle_phase(values: DataFrame, markers: list[tuple[int, str]], n_genes: int) -> DataFrame:
    """Phase whose markers exceed the cell's other genes most; G1 where S and G2M both fall short."""
    sums = {p: [g for g, q in markers if q == p] for p in ("S", "G2M")}
    total = F.sum("value")
    score = {}
    for p, genes in sums.items():
        own = F.sum(F.when(F.col("gene").isin(genes), F.col("value")).otherwise(0.0))
        score[p] = F.round(own / len(genes) - (total - own) / (n_genes - len(genes)), 9)  # equal scores stay equal in any order of sums
    out = values.groupBy("cell").agg(score["S"].alias("s_score"), score["G2M"].alias("g2m_score"))
    phase = F.when((F.col("s_score") < 0) & (F.col("g2m_score") < 0), "G1").when(F.col("s_score") >= F.col("g2m_score"), "S").otherwise("G2M")
    return out.withColumn("phase", phase)


#: Cells of a block, and rows of it whose distances are computed at once.
BLOCK, AT_ONCE = 16384, 128


def _nearest(a: np.ndarray, b: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in a, place in b, squared distance) of the k nearest of each a, ties to the smaller id. A matrix product finds
    those that may be among them, whose distances are then computed exactly."""
    rough = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    rough[a_ids[:, None] == b_ids[None, :]] = np.inf
    slack = 1e-9 * (1 + (a * a).sum(1) + (b * b).sum(1).max(initial=0))
    limit = np.partition(rough, k - 1, axis=1)[:, k - 1] if k < rough.shape[1] else np.full(len(a), np.finfo(float).max)
    i, j = np.nonzero(rough <= (limit + slack)[:, None])
    d = ((a[i] - b[j]) ** 2).sum(1)
    order = np.lexsort((b_ids[j], d, i))
    i, j, d = i[order], j[order], d[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[kept], d[kept]


#: Pivots at most: cells are dealt by the nearest one.
PIVOTS = 1024
NEAR = "near array<struct<neighbour: long, d2: double>>"


def _matrix(table: pa.Table | pa.RecordBatch, column: str = "vector") -> np.ndarray:
    values = table.column(column)
    flat = (values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values).flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(values), len(flat) // max(len(values), 1))


def _from_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows from pivots, up to rounding (see SLACK)."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * (x @ pivots.T), 0))


#: What rounding may take from a distance, as a share of the vectors' lengths: the product above loses half the digits of a small one.
SLACK = 1e-6


def _k_nearest(a: np.ndarray, b: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, k: int):
    """_nearest() for so many rows of a at once."""
    parts = [(at, *_nearest(a[at : at + AT_ONCE], b, a_ids[at : at + AT_ONCE], b_ids, k)) for at in range(0, len(a) if len(b) else 0, AT_ONCE)]
    whole = [(at + i, j, d) for at, i, j, d in parts] or [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    return (np.concatenate(c) for c in zip(*whole, strict=True))


def knn_graph(cells: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(id, neighbour, d2): the k nearest of every cell, ties to the smaller id. Exact.

    Cells of equal vectors are compared once, under their least id: the k nearest of a vector stand for themselves and their
    equals, of which k + 1 at most can be among the nearest of a cell."""
    own = Window.partitionBy("vector")
    named = cells.select("id", "vector", F.min("id").over(own).alias("class"), F.row_number().over(own.orderBy("id")).alias("number"))
    known = cut(named, "cells")
    near = _knn_distinct(known.where("number = 1"), k, block)
    members = known.where(F.col("number") <= k + 1).select(F.col("class").alias("neighbour"), F.col("id").alias("member"))
    if not known.where("number > 1").head(1):
        return near
    found = cut(near.union(known.where("number = 1").select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("d2"))), "near")
    first = F.row_number().over(Window.partitionBy("id").orderBy("d2", "member"))
    each = found.join(members.hint("merge"), "neighbour").withColumn("rank", first).where(F.col("rank") <= k + 1)
    lists = each.groupBy(F.col("id").alias("class")).agg(F.array_sort(F.collect_list(F.struct("d2", "member"))).alias("near"))
    others = F.slice(F.filter("near", lambda n: n["member"] != F.col("id")), 1, k)
    return known.select("id", "class").join(lists.hint("merge"), "class").select("id", F.explode(others).alias("n")).select("id", F.col("n.member").alias("neighbour"), "n.d2")


def _knn_distinct(cells: DataFrame, k: int, block: int) -> DataFrame:
    """knn_graph() of cells whose vectors differ.

    Cells are dealt to the nearest of some pivots (cells themselves, PIVOTS at most), and a pivot's cells to blocks of about so many.
    The k nearest of its own block bound how far a cell has to look: by the triangle inequality no cell of a pivot is nearer
    than the distance to the pivot less the distance of the pivot's farthest cell. A cell is sent to the blocks of those pivots
    only that this does not rule out, and compared there by matrix products; a group is a pair of blocks."""
    spark = cells.sparkSession
    own = cells.select("id", "vector")
    blocks = max(1, -(-own.count() // block))
    def at_home(table: pa.Table) -> pa.Table:
        x, ids = _matrix(table), table.column("id").to_numpy()
        i, j, d = _k_nearest(x, x, ids, ids, k)
        n = np.bincount(i, minlength=len(x))
        edges = np.append(0, np.cumsum(n)).astype(np.int32)
        far = np.full(len(x), np.inf)
        far[n == k] = d[edges[1:][n == k] - 1]
        near = pa.StructArray.from_arrays([pa.array(ids[j]), pa.array(d)], ["neighbour", "d2"])
        return pa.table([table.column("id"), table.column("vector"), table.column("block"), pa.array(far), pa.ListArray.from_arrays(pa.array(edges), near)], ["id", "vector", "block", "far", "near"])

    schema = f"id long, vector array<double>, block int, far double, {NEAR}"
    nearest = lambda home: home.select("id", F.explode("near").alias("n")).select("id", "n.neighbour", "n.d2")
    if blocks == 1:
        return nearest(own.withColumn("block", F.lit(0)).groupBy("block").applyInArrow(at_home, schema))
    chosen = own.orderBy(F.xxhash64("id"), "id").limit(min(blocks, PIVOTS)).collect()
    pivots = np.array([r["vector"] for r in chosen], float)

    def deal(batches):
        for batch in batches:
            d = _from_pivots(_matrix(batch), pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))], ["id", "vector", "pivot", "off"])

    dealt = cut(own.mapInArrow(deal, "id long, vector array<double>, pivot int, off double"), "dealt")
    facts = {r["pivot"]: r for r in dealt.groupBy("pivot").agg(F.count("*").alias("n"), F.max("off").alias("radius")).collect()}  # a row a pivot
    parts = np.array([-(-facts[p]["n"] // block) if p in facts else 0 for p in range(len(pivots))], np.int64)
    first, radius = np.cumsum(parts) - parts, np.array([facts[p]["radius"] if p in facts else 0.0 for p in range(len(pivots))])
    place = spark.createDataFrame([(p, int(first[p]), int(parts[p])) for p in sorted(facts)], "pivot int, first int, parts int")
    blocked = cut(dealt.join(F.broadcast(place), "pivot").select("id", "vector", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("block")), "blocks")
    dropped(dealt)

    home = cut(blocked.groupBy("block").applyInArrow(at_home, schema), "home")
    near = nearest(home)
    if parts.sum() > 1:

        def sent(batches):
            """A row for each further block in which a cell's nearest may lie."""
            for batch in batches:
                x, far = _matrix(batch), np.sqrt(batch.column("far").to_numpy())
                slack = SLACK * (1 + np.sqrt((x * x).sum(1)) + np.sqrt((pivots * pivots).sum(1)).max())
                row, p = np.nonzero(_from_pivots(x, pivots) - radius <= (far + slack)[:, None])
                n = parts[p]
                to = np.repeat(first[p], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row = np.repeat(row, n)
                kept = to != batch.column("block").to_numpy()[row]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row[kept])) for c in ("id", "vector", "block")), pa.array(to[kept].astype(np.int32))], ["id", "vector", "i", "j"])

        asked = cut(home.select("id", "vector", "block", "far").mapInArrow(sent, "id long, vector array<double>, i int, j int"), "asked")
        pairs = cut(asked.select("i", "j").distinct(), "pairs")
        there = blocked.withColumnRenamed("block", "j").join(pairs, "j").select("id", "vector", "i", "j")

        def compared(p: pa.Table, q: pa.Table) -> pa.Table:
            a_ids, b_ids = p.column("id").to_numpy(), q.column("id").to_numpy()
            i, j, d = _k_nearest(_matrix(p), _matrix(q), a_ids, b_ids, k)
            return pa.table([pa.array(a_ids[i]), pa.array(b_ids[j]), pa.array(d)], ["id", "neighbour", "d2"])

        near = near.union(asked.groupBy("i", "j").cogroup(there.groupBy("i", "j")).applyInArrow(compared, "id long, neighbour long, d2 double"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d2", "neighbour"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def pseudotime(graph: DataFrame, root: int, cells: DataFrame | None = None, rounds: int = 3) -> DataFrame:
    """(id, pseudotime): shortest-path length from the root over the neighbour graph (both ways), scaled to 0..1.

    Every id of cells (of the graph, if not given) has a row; what the root does not reach has null. Paths grow by so many
    steps between two tables, until none gets shorter."""
    edges = graph.select(F.col("id").alias("a"), F.col("neighbour").alias("b"), F.sqrt("d2").alias("d"))
    edges = cut(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).groupBy("a", "b").agg(F.min("d").alias("d")))
    every = cells.select("id").distinct() if cells is not None else edges.select(F.col("a").alias("id")).distinct()
    now = every.where(F.col("id") == root).withColumn("dist", F.lit(0.0))
    mark = last = None
    while True:
        for _ in range(rounds):
            step = now.join(edges, now["id"] == edges["a"]).select(F.col("b").alias("id"), (F.col("dist") + F.col("d")).alias("dist"))
            now = now.union(step).groupBy("id").agg(F.min("dist").alias("dist"))
        before, now = last, cut(now)
        if before is not None:
            dropped(before)
        last = now
        after = now.agg(F.count("*"), F.sum(F.xxhash64("id", "dist").cast("decimal(20,0)"))).first()
        if after == mark:
            break
        mark = after
    top = now.agg(F.max("dist").alias("top"))
    scaled = now.crossJoin(F.broadcast(top)).select("id", F.coalesce(F.try_divide("dist", "top"), F.lit(0.0)).alias("pseudotime"))
    return every.join(scaled, "id", "left")
