"""Operators on small fixtures against brute force, at other plane sizes than the stand-ins'."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspark.operators import expression as ex
from cellspark.operators import graph
from cellspark.operators import intensity as im
from cellspark.operators import segment as sg
from cellspark.operators import tracking as tr

LINE = "sample string, replicate int, t int, channel int, y int, width int, pixels array<double>"
SIZES = [(48, 100), (100, 48), (64, 64), (7, 130)]


def lines_of(spark, planes):
    rows = [("s", 1, t, 0, y, p.shape[1], [float(v) for v in line]) for t, p in enumerate(planes) for y, line in enumerate(p)]
    return spark.createDataFrame(rows, LINE)


def masks_of(spark, masks):
    return lines_of(spark, masks).withColumn("mask", F.transform("pixels", lambda v: v > 0)).drop("pixels")


def planes_of(df, shape):
    out = {}
    for r in df.collect():
        out.setdefault(r["t"], np.full(shape, np.nan))[r["y"]] = r["pixels"]
    return out


@pytest.mark.parametrize("strip", [5, 16, 256])
def test_blur_in_strips(spark, strip):
    rng = np.random.default_rng(1)
    planes = [rng.random((43, 30)) for _ in range(2)]
    got = planes_of(im.gaussian_blur(lines_of(spark, planes), strip=max(strip, 9)), (43, 30))
    w = im.gaussian_weights()
    for t, p in enumerate(planes):
        for axis in (1, 0):
            p = sum(w[k] * np.take(p, np.clip(np.arange(p.shape[axis]) + k - 8, 0, p.shape[axis] - 1), axis) for k in range(17))
        assert np.allclose(got[t], p, atol=1e-12)


def test_percentiles_and_flat_planes(spark):
    rng = np.random.default_rng(2)
    planes = [rng.integers(0, 9, (11, 13)).astype(float), np.full((11, 13), 4.0)]
    got = {r["t"]: (r["p_lo"], r["p_hi"]) for r in im.plane_percentiles(lines_of(spark, planes), {None: (50.0, 99.8)}).collect()}
    assert all(np.allclose(got[t], np.percentile(p, [50, 99.8])) for t, p in enumerate(planes))
    assert (planes_of(im.norm_by(lines_of(spark, planes), {0: (50.0, 99.8)}), (11, 13))[1] == 0).all()


def flood(mask, connectivity):
    label, count = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if not label[start]:
            count += 1
            label[start], todo = count, [start]
            while todo:
                y, x = todo.pop()
                for i, j in itertools.product((-1, 0, 1), repeat=2):
                    p = (y + i, x + j)
                    if (connectivity == 8 or not i or not j) and 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not label[p]:
                        label[p] = count
                        todo.append(p)
    return label


def brute_watershed(level, markers, mask):
    """As the kernel, with a list in place of a heap."""
    out = np.where(mask, markers, 0)
    todo = [(level[y, x], 0, y * mask.shape[1] + x) for y, x in np.argwhere(out)]
    age = 0
    while todo:
        first = min(todo)
        todo.remove(first)
        y, x = divmod(first[2], mask.shape[1])
        for p, q in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
            if 0 <= p < mask.shape[0] and 0 <= q < mask.shape[1] and mask[p, q] and not out[p, q]:
                out[p, q] = out[y, x]
                age += 1
                todo.append((level[p, q], age, p * mask.shape[1] + q))
    return out


@pytest.mark.parametrize("shape", SIZES)
def test_segmentation_of_any_plane(spark, shape):
    rng = np.random.default_rng(3)
    mask = np.zeros(shape, bool)
    for _ in range(14):
        y, x, r = rng.integers(shape[0]), rng.integers(shape[1]), rng.integers(2, 8)
        mask |= (np.arange(shape[0])[:, None] - y) ** 2 + (np.arange(shape[1])[None, :] - x) ** 2 <= r * r
    mask[-1, -2:] = True
    h, w = shape
    back = np.argwhere(~mask)
    d = np.zeros(shape)
    for y, x in np.argwhere(mask):
        d[y, x] = np.sqrt(((back - (y, x)) ** 2).sum(1).min())
    pad = np.pad(d, 1)
    around = np.max([pad[i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)
    inner = np.zeros(shape, bool)
    inner[1:-1, 1:-1] = True
    peak = mask & (d == around) & inner
    island, markers = flood(mask, 8), flood(peak, 8)
    label = brute_watershed(-d, markers, mask)
    pixels = sg.flooded(sg.mask_runs(masks_of(spark, [mask])), h, w).cache()
    got = {(r["y"], r["x"]): r for r in pixels.collect()}
    assert got.keys() == {tuple(p) for p in np.argwhere(mask).tolist()}
    first = {k: int(np.flatnonzero(island.ravel() == k)[0]) for k in range(1, island.max() + 1)}
    names = {}
    for (y, x), r in got.items():
        assert r["distance"] == pytest.approx(d[y, x]) and r["peak"] == peak[y, x] and r["component"] == first[island[y, x]]
        assert (r["marker"] > 0) == (markers[y, x] > 0) and (r["label"] > 0) == (label[y, x] > 0)
        if label[y, x]:
            assert names.setdefault((r["component"], r["label"]), label[y, x]) == label[y, x]
    assert len(set(names.values())) == len(names)
    edges = set()
    for y, x in np.argwhere(mask).tolist():
        for p, q in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= p < h and 0 <= q < w and (not mask[p, q] or island[p, q] != island[y, x] or label[p, q] != label[y, x]):
                edges.add((y, x))
    assert {(r["y"], r["x"]) for r in sg.label_boundaries(pixels, h, w).collect()} == edges
    assert sg.watershed_count(pixels).collect()[0]["watershed_count"] == len(names) == sg.labels(pixels).count()


def test_touching_discs_are_two_labels_and_one_cell(spark):
    ys, xs = np.mgrid[0:30, 0:40]
    mask = ((ys - 12) ** 2 + (xs - 12) ** 2 <= 64) | ((ys - 12) ** 2 + (xs - 24) ** 2 <= 64)
    runs = sg.mask_runs(masks_of(spark, [mask]))
    assert sg.watershed_count(sg.flooded(runs, 30, 40)).collect()[0]["watershed_count"] == 2
    assert sg.binary_counts(sg.connected_components(runs, 4, 40), masks_of(spark, [mask]), 40).collect()[0]["cell_count"] == 1


def test_shape_features_by_pixels(spark):
    rng = np.random.default_rng(4)
    mask = rng.random((20, 33)) < 0.6
    got = sg.shape_features(sg.connected_components(sg.mask_runs(masks_of(spark, [mask])), 4, 33)).collect()
    label = flood(mask, 4)
    first = {int(np.flatnonzero(label.ravel() == k)[0]): np.argwhere(label == k) for k in range(1, label.max() + 1)}
    assert {r["component"] for r in got} == set(first)
    for r in got:
        p = first[r["component"]]
        a, c, b = p[:, 0].var(), p[:, 1].var(), ((p[:, 0] - p[:, 0].mean()) * (p[:, 1] - p[:, 1].mean())).mean()
        low, high = np.linalg.eigvalsh([[a, b], [b, c]])
        assert r["area"] == len(p) and np.allclose([r["minor_axis_length"], r["major_axis_length"]], [4 * np.sqrt(max(low, 0)), 4 * np.sqrt(high)], atol=1e-5)


def test_dims_of_a_mosaic(spark):
    df = lines_of(spark, [np.zeros((3, 4))] * 2).withColumn("m", F.col("t")).withColumn("scene", F.lit(5))
    got = {r["dim"]: tuple(r)[1:] for r in im.dims_shape(df).collect()}
    assert got == {"S": (5, 1, True), "T": (0, 2, True), "C": (0, 1, True), "Z": (0, 1, True), "M": (0, 2, True), "Y": (0, 3, True), "X": (0, 4, True)}


def test_stacked_planes_must_have_one_shape(spark):
    a, b = lines_of(spark, [np.zeros((2, 4))]), lines_of(spark, [np.zeros((2, 5))])
    assert im.stacked(a, a).count() == 4
    for other in (b, lines_of(spark, [np.zeros((3, 4))])):
        with pytest.raises(Exception, match="differ in shape"):
            im.stacked(a, other.withColumn("replicate", F.lit(2))).collect()


def test_plane_files_round_trip(spark, tmp_path):
    from cellspark.sources import files

    rng = np.random.default_rng(5)
    df = lines_of(spark, [rng.random((6, 9)) for _ in range(3)])
    df = df.union(df.withColumn("channel", F.lit(1)))
    assert files.write_plane_files(df, f"file://{tmp_path}/p") == 3
    (tmp_path / "p" / "s" / "1" / "note.txt").write_text("no plane")
    assert sorted(map(repr, files.plane_files(spark, f"{tmp_path}/p").collect())) == sorted(map(repr, df.collect()))
    files.write_planes(df, f"{tmp_path}/q")
    read = files.read_planes(spark, f"{tmp_path}/q", "s", 1, 1, 3)
    assert {(r["t"], r["file_number"]) for r in read.collect()} == {(1, 2), (2, 3)}
    assert "PartitionFilters: [isnotnull(sample" in read._jdf.queryExecution().toString()


def test_components_of_edges(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2)) if a != b] + [(k, k + 1) for k in range(100, 160)]
    root = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()} == root


def test_link_optimal_by_all_assignments(spark):
    rng = np.random.default_rng(7)
    rows = [("m", t, 100 * t + k, float(x), float(y), 60) for t in (1, 2) for k, (x, y) in enumerate(rng.random((5, 2)) * 90)]
    objects = spark.createDataFrame(rows, "movie string, t int, ID long, x double, y double, area long")
    candidates = tr.link_candidates(objects)
    cost = {(r["a"], r["b"]): r["d2"] for r in candidates.collect()}
    best = 1e18
    a, b = [100 + k for k in range(5)], [200 + k for k in range(5)]
    for choice in itertools.product([None, *b], repeat=5):
        used = [c for c in choice if c]
        if len(set(used)) == len(used) and all((x, c) in cost for x, c in zip(a, choice, strict=True) if c):
            best = min(best, sum(cost[x, c] if c else 2500 for x, c in zip(a, choice, strict=True)))
    got = tr.link_optimal(candidates).collect()
    assert len({r["a"] for r in got}) == len({r["b"] for r in got}) == len(got)
    assert sum(r["d2"] for r in got) + 2500 * (5 - len(got)) == pytest.approx(best)


def test_stitch_by_all_assignments(spark):
    rng = np.random.default_rng(8)
    tracks, names = [], []
    for k in range(3):
        tracks += [("m", f"a{k}", t, float(10 * k), 0.0, 50) for t in (1, 2)]
    for k, (x, y) in enumerate(rng.random((5, 2)) * 30):
        names.append(f"b{k}")
        tracks += [("m", f"b{k}", t, float(x), float(y), 50) for t in (4, 5)]
    df = spark.createDataFrame(tracks, "movie string, track_id string, t int, x double, y double, area long")
    cost = {(r["track_id"], r["parent"]): r["d2"] for r in tr.stitch_candidates(df).collect()}
    best = 1e18
    for choice in itertools.product([None, "a0", "a1", "a2"], repeat=5):
        if all((n, c) in cost for n, c in zip(names, choice, strict=True) if c) and all(choice.count(p) <= 2 for p in ("a0", "a1", "a2")):
            best = min(best, sum(cost[n, c] if c else 2500 for n, c in zip(names, choice, strict=True)) + 625 * sum(choice.count(p) == 2 for p in ("a0", "a1", "a2")))
    got = tr.stitch(df).collect()
    parents = [r["parent"] for r in got]
    assert len({r["track_id"] for r in got}) == len(got) and max(map(parents.count, parents)) <= 2
    assert sum(r["d2"] for r in got) + 625 * sum(parents.count(p) == 2 for p in set(parents)) + 2500 * (5 - len(got)) == pytest.approx(best)


def test_track_bayes_keeps_crossing_objects_apart(spark):
    rows = []
    for t in range(1, 12):
        rows.append(("m", t, 2 * t, 10.0 * t, 5.0 * t, 80))
        rows.append(("m", t, 2 * t + 1, 120.0 - 10.0 * t, 5.0 * t, 80))
    rows += [("m", t, 500 + t, 900.0, 900.0 + t, 60 if t != 5 else 61) for t in (1, 2, 3, 5, 6)] + [("n", 1, 1, 0.0, 0.0, 50)]
    out = tr.track_bayes(spark.createDataFrame(rows, "movie string, t int, ID long, x double, y double, area long")).collect()
    assert len(out) == len(rows) and all(0 < r["probability"] <= 1 for r in out)
    track = {(r["movie"], r["t"], r["ID"]): r["track_id"] for r in out}
    assert {track["m", t, 2 * t] for t in range(1, 12)} == {"000001:2"} and {track["m", t, 2 * t + 1] for t in range(1, 12)} == {"000001:3"}
    assert track["m", 3, 503] == track["m", 1, 501] != track["m", 5, 505] == track["m", 6, 506] and track["n", 1, 1] == "000001:1"


def test_track_bayes_tells_by_appearance(spark):
    rows = [("m", 1, 1, 0.0, 0.0, 100), ("m", 2, 2, 6.0, 0.0, 30), ("m", 2, 3, 6.0, 0.0, 100)]
    out = {r["ID"]: r for r in tr.track_bayes(spark.createDataFrame(rows, "movie string, t int, ID long, x double, y double, area long")).collect()}
    assert out[3]["track_id"] == "000001:1" != out[2]["track_id"] and out[3]["probability"] > 0.9


@pytest.mark.parametrize("block", [7, 4096])
def test_knn_in_blocks(spark, block):
    rng = np.random.default_rng(9)
    v = rng.integers(0, 4, (60, 5)).astype(float)  # many ties
    got = ex.knn_graph(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vector array<double>"), 4, block).collect()
    want = set()
    for k in range(60):
        d = ((v - v[k]) ** 2).sum(1)
        want |= {(k, j, float(d[j])) for j in sorted((j for j in range(60) if j != k), key=lambda j: (d[j], j))[:4]}
    assert {tuple(r) for r in got} == want and len(got) == 240


def test_pseudotime_of_cells_out_of_reach(spark):
    g = spark.createDataFrame([(0, 1, 4.0), (1, 2, 1.0), (8, 9, 1.0)], "id long, neighbour long, d2 double")
    cells = spark.createDataFrame([(k,) for k in (0, 1, 2, 8, 9, 10)], "id long")
    assert {r["id"]: r["pseudotime"] for r in ex.pseudotime(g, 0, cells).collect()} == {0: 0.0, 1: pytest.approx(2 / 3), 2: 1.0, 8: None, 9: None, 10: None}


def test_shared_folder_is_never_local_to_a_cluster():
    from cellspark.plans import lineage

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="share"):
        lineage.shared_folder(Session())
