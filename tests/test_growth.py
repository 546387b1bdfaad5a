"""Work that grows no faster than the input."""

import time

import numpy as np


def test_many_buckets_cost_slices_not_passes():
    """what a slice sends out is put in order once, not once for each bucket."""
    from cellspark.llm import substring

    rng = np.random.default_rng(1)
    doc, values = np.sort(rng.integers(0, 3000, 300_000)), rng.integers(0, 1 << 60, 300_000).astype(np.uint64)
    began = time.time()
    rows = list(substring._grouped(2000, doc, values))
    assert time.time() - began < 2  # 7 s before
    assert sorted((d, int(v)) for _, ids, counts, own in rows for d, v in zip(np.repeat(ids, counts).tolist(), own, strict=True)) == sorted(zip(doc.tolist(), values.tolist(), strict=True))
    assert len({b for b, *_ in rows}) == len(rows)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_known_barcodes_are_not_broadcast(spark):
    """a row a place of every known barcode, which Spark's estimate of their size does not know of."""
    from cellspark.operators import expression as ex

    known = spark.createDataFrame([("ACGT",), ("ACGA",), ("TTTT",)], "barcode string")
    reads = spark.createDataFrame([("ACGG",), ("TTTG",), ("TTTT",), ("GGGG",)], "barcode string")
    out = ex.correct_barcodes(reads, known)
    assert "Broadcast" not in plan(out) and [tuple(r) for r in out.collect()] == [("TTTG", "TTTT")]


def copies_of_places(spark, frames=3, places=12, copies=9):
    rng = np.random.default_rng(2)
    rows = [("m", t, 1000 * t + 50 * k + places * c, float(x), float(y), 60) for t in range(frames) for k, (x, y) in enumerate(rng.random((places, 2)) * 80) for c in range(copies)]
    return spark.createDataFrame(rows, "movie string, t int, ID long, x double, y double, area long")


def test_copies_make_no_product_of_links(spark):
    """mutual links come from the least id of each place, and from nearest pairs only."""
    from cellspark.operators import tracking as tr

    objects = copies_of_places(spark)
    near = tr.nearest_candidates(objects)
    want = sorted(map(tuple, tr.link_mutual(tr.link_candidates(objects)).collect()))
    assert sorted(map(tuple, tr.link_mutual(near).collect())) == want != []
    assert near.count() <= 2 * 3 * 12 < tr.link_candidates(objects).count() / 50


def test_copies_make_no_product_of_parents(spark):
    """the nearest parent of each track, by a row a place."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from cellspark.operators import tracking as tr

    objects = copies_of_places(spark)
    tracks = objects.select("movie", F.concat_ws(":", "t", "ID").alias("track_id"), "t", "x", "y", "area")
    first = F.row_number().over(Window.partitionBy("movie", "track_id").orderBy(F.round("d2", 6), "parent"))
    want = tr.stitch_candidates(tracks).withColumn("rank", first).where("rank = 1").select("movie", "track_id", "parent")
    assert sorted(map(tuple, tr.stitch_nearest(tracks).collect())) == sorted(map(tuple, want.collect())) != []


def test_transport_costs_as_the_assignment_of_copies():
    """A row and a column for all copies, at the cost of the assignment copy by copy."""
    from cellspark.functions import kernels

    rng = np.random.default_rng(3)
    for _ in range(200):
        n, m = rng.integers(1, 6, 2)
        row, column = np.nonzero(rng.random((n, m)) < 0.7)
        cost, alone = np.round(rng.normal(0, 2, len(row)), rng.integers(0, 3)), rng.random(n) * 3
        supply, capacity = rng.integers(1, 4, n), rng.integers(1, 4, m)
        found = kernels.transport(row, column, cost, alone, supply, capacity)
        got, out, into = 0.0, np.zeros(n), np.zeros(m)
        for e, k in found:
            got, out[row[e]], into[column[e]] = got + k * cost[e], out[row[e]] + k, into[column[e]] + k
        assert (out <= supply).all() and (into <= capacity).all()
        first, at = np.cumsum(supply) - supply, np.cumsum(capacity) - capacity
        pairs = [(first[r] + i, at[c] + j, x) for r, c, x in zip(row, column, cost, strict=True) for i in range(supply[r]) for j in range(capacity[c])]
        rows, columns, costs = (np.array(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int),) * 3
        each = np.repeat(alone, supply)
        used = kernels.sparse_assignment(rows, columns, costs.astype(float), each)
        assert abs(got + ((supply - out) * alone).sum() - sum(costs[e] if e >= 0 else each[r] for r, e in enumerate(used))) < 1e-9


def test_copies_and_stretches_give_the_tracks_one_by_one(spark):
    """what stands at one place is a row of the tracker's assignments, and many frames are one job."""
    from test_tracking import OBJECT, tracks_one_by_one

    from cellspark.operators import tracking as tr

    rng, copies = np.random.default_rng(5), 4
    at, rows = rng.random((8, 2)) * 90, []
    for t in (1, 2, 3, 4, 6, 7):
        at = at + rng.normal(0, 5, at.shape)
        for k, (x, y) in enumerate(at):
            rows += [("m", t, 1000 * t + 10 * k + c, float(x), float(y), 40 + k, 14.0, 7.0, 0.1 * k, 0.9) for c in range(copies - (t + k) % 3)]
    objects = spark.createDataFrame(rows, OBJECT)
    want = tracks_one_by_one(rows, 50.0)
    place = {(r[1], r[2]): r[3:5] for r in rows}
    paths = lambda found: sorted(sorted((place[key], p) for key, (name, p) in found.items() if name == track) for track in {name for name, _ in found.values()})
    for stretch in (1, 1 << 18):
        got = {(r["t"], r["ID"]): (r["track_id"], round(r["probability"], 9)) for r in tr.track_bayes(objects, stretch=stretch).collect()}
        assert got.keys() == want.keys() and all(name == f"{min(key for key in got if got[key][0] == name)[0]:06d}:{min(key for key in got if got[key][0] == name)[1]}" for name in {n for n, _ in got.values()})
        assert paths(got) == paths(want)
    places = objects.groupBy("movie", "t", "x", "y").agg({"ID": "min"}).withColumnRenamed("min(ID)", "ID")
    assert {n: tr._reach(places, 50.0, n).select("stretch").distinct().count() for n in (1, 1 << 18)} == {1: 4, 1 << 18: 1}
    assert tr._reach(places, 50.0, 1 << 18).count() < tr.link_candidates(objects).count() / 4


def test_a_time_point_is_one_file(spark, tmp_path):
    """files of masks grow with the time points, not with the tasks beside."""
    from cellspark.sources import files

    rows = [("S", 1, t, c, y, 0, 3) for t in range(3) for c in range(4) for y in range(20)]
    runs = spark.createDataFrame(rows, "sample string, replicate int, t int, channel int, y int, x0 int, x1 int").repartition(6)
    lines = runs.selectExpr("sample", "replicate", "t", "channel", "y", "8 as width", "array_repeat(1.0D, 8) as pixels")
    files.write_masks(runs, str(tmp_path / "a"))
    files.write_mask_planes(runs, lines, str(tmp_path / "b"))
    assert [len(list((tmp_path / k).rglob("*.parquet"))) for k in "ab"] == [3, 3]
    assert [spark.read.parquet(str(tmp_path / k)).count() for k in "ab"] == [len(rows)] * 2


def test_components_of_many_runs():
    """runs are joined by arrays, not one by one."""
    from cellspark.functions import kernels

    mask = np.random.default_rng(6).random((1500, 1500)) < 0.5
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (y, x0), x1 = np.nonzero(edge == 1), np.nonzero(edge == -1)[1] - 1
    began = time.time()
    root = kernels.runs_components(y, x0, x1, 8)
    assert time.time() - began < 2  # 6 s before
    spread = np.zeros(mask.shape, int)
    spread[mask] = np.repeat(root, x1 - x0 + 1) + 1
    for a, b in ((spread[1:], spread[:-1]), (spread[1:, 1:], spread[:-1, :-1]), (spread[1:, :-1], spread[:-1, 1:])):
        assert (a == b)[(a > 0) & (b > 0)].all()


def test_equal_cells_are_compared_once(spark, monkeypatch):
    """copies of a vector make no pairs of blocks, and the neighbours are those of all pairs."""
    from cellspark.operators import expression as ex

    rng = np.random.default_rng(7)
    vectors = rng.integers(0, 3, (30, 3)).astype(float)[np.concatenate([np.arange(30), rng.integers(0, 12, 60)])]
    asked = []
    monkeypatch.setattr(ex, "_knn_distinct", lambda cells, *more, run=ex._knn_distinct: asked.append(cells.count()) or run(cells, *more))
    for block in (8, 1000):
        got = ex.knn_graph(spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<double>"), 4, block)
        d = ((vectors[:, None] - vectors[None]) ** 2).sum(2)
        want = [(i, j, d[i, j]) for i in range(len(d)) for j in sorted((j for j in range(len(d)) if j != i), key=lambda j: (d[i, j], j))[:4]]
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert asked == [len(np.unique(vectors, axis=0))] * 2


def test_letters_of_few_keys(spark):
    """what has few values is no digest a row, and reads as before."""
    from pyspark.sql import functions as F

    from cellspark.sources import standins as st

    keys = spark.range(-25, 45).withColumn("k", F.when(F.col("id") != 7, F.col("id")))
    assert keys.where(~st.few_letters(F.col("k"), 10).eqNullSafe(st.letters(F.col("k") % 10))).count() == 0
    assert st.reads(spark, "/root/testdata/sf0.001").schema.simpleString() == "struct<seq:string,gene:int>"


def test_all_links_are_spelled_out_after_the_join(spark):
    """a distance to what stands at one place is taken once, and every pair is still there, those of null IDs too."""
    from cellspark.operators import tracking as tr

    def joined(df):
        node = df._jdf.queryExecution().executedPlan()
        while "SortMergeJoin" not in node.nodeName():
            kind = node.nodeName()
            node = node.executedPlan() if kind == "AdaptiveSparkPlan" else node.plan() if kind.endswith("QueryStage") else node.children().head()
        return node.metrics().apply("numOutputRows").value()

    objects = copies_of_places(spark)
    objects = objects.union(objects.where("ID % 7 = 0")).union(objects.where("ID % 50 = 3").selectExpr("movie", "t", "null", "x", "y", "area"))
    rows = [(r["t"], r["ID"], r["x"], r["y"]) for r in objects.collect()]
    d2 = lambda p, q: (p[2] - q[2]) * (p[2] - q[2]) + (p[3] - q[3]) * (p[3] - q[3])
    want = sorted((("m", p[0], p[1], q[1], d2(p, q)) for p in rows for q in rows if q[0] == p[0] + 1 and d2(p, q) <= 2500), key=repr)
    got = tr.link_candidates(objects)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert joined(got) < len(want) / 8
    assert sorted(map(tuple, tr.link_candidates(objects, members=2).collect()), key=repr) == want


def test_rounded_as_spark_rounds(spark):
    """the quick way of rounding gives the very numbers of the slow one, next to ties too."""
    from pyspark.sql import functions as F

    from cellspark.operators import tracking as tr

    rng = np.random.default_rng(8)
    ties = (rng.integers(0, 25_000_000, 20_000) + 0.5) / 1e4
    values = np.concatenate([[0.0, 2500.0, 5e-5, 0.99995], rng.random(40_000) * 2500, rng.integers(0, 25_000_000, 20_000) / 1e4, ties, np.nextafter(ties, 0), np.nextafter(ties, 9e9), ties + 9e-8, ties - 1.1e-7])
    numbers = spark.createDataFrame([(v,) for v in values.tolist()] + [(None,)], "v double")
    assert numbers.where(~tr._rounded(F.col("v"), 4).eqNullSafe(F.round("v", 4))).count() == 0
