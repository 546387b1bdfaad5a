"""Planes in strips, bundles and tiles give what whole planes give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspark.functions import kernels
from cellspark.operators import intensity as im
from cellspark.operators import segment as sg

PLANE = "sample string, replicate int, t int, channel int, "


def runs_of(spark, masks):
    rows = []
    for t, mask in enumerate(masks):
        for y, line in enumerate(mask):
            edge = np.diff(np.concatenate([[0], line.astype(int), [0]]))
            rows += [("s", 1, t, 0, y, int(a), int(b) - 1) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
    return spark.createDataFrame(rows, sg.RUN)


def spiral(h, w):
    """One island through all strips, many times up and down."""
    mask = np.zeros((h, w), bool)
    mask[:, ::4] = True
    mask[0, 2::8] = mask[0, 1::8] = mask[0, 3::8] = True
    mask[-1, 5::8] = mask[-1, 6::8] = mask[-1, 7::8] = True
    return mask


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_over_seams(spark, connectivity):
    rng = np.random.default_rng(1)
    masks = [rng.random((50, 23)) < 0.55, spiral(50, 23), rng.random((50, 23)) < 0.3, np.eye(50, 23, dtype=bool)]
    runs = runs_of(spark, masks)
    want = {tuple(r) for r in sg.connected_components(runs, connectivity, 23).collect()}
    assert len({(r[2], r[7]) for r in want if r[2] == 1}) == 1
    for strip in (1, 7, 25):
        assert {tuple(r) for r in sg.connected_components(runs, connectivity, 23, strip).collect()} == want


def test_a_tall_plane_is_no_single_group(spark):
    """20,000 lines: no group has more than a strip's."""
    mask = np.ones((20_000, 1), bool)
    mask[7777] = False
    rows = [("s", 1, 0, 0, y, 0, 0) for y in np.flatnonzero(mask[:, 0]).tolist()]
    out = sg.connected_components(spark.createDataFrame(rows, sg.RUN), 4, 1)
    assert {(r["component"], r["n"]) for r in out.groupBy("component").agg(F.count("*").alias("n")).collect()} == {(0, 7777), (7778, 12_222)}


@pytest.mark.parametrize("bundle, lines", [(128, 32), (5, 3)])
def test_distances_by_columns_and_lines(spark, monkeypatch, bundle, lines):
    monkeypatch.setattr(sg, "COLUMNS", bundle)
    monkeypatch.setattr(sg, "LINES", lines)
    rng = np.random.default_rng(2)
    whole = np.ones((30, 41), bool)
    whole[[3, 20], [5, 33]] = False  # one island over all tiles
    masks = [whole, rng.random((30, 41)) < 0.7, spiral(30, 41), np.ones((30, 41), bool)]
    got = {(r["t"], r["y"]): r["distance"] for r in sg.distance_lines(runs_of(spark, masks), 30, 41).collect()}
    for t, mask in enumerate(masks):
        want = np.where(mask, kernels.distances(mask), 0)
        want[~np.isfinite(want)] = 0
        assert {y for k, y in got if k == t} == set(np.flatnonzero(mask.any(1)).tolist())
        assert all(np.allclose(got[t, y], want[y]) for y in np.flatnonzero(mask.any(1)))
    assert sg.distance_lines(runs_of(spark, masks).where("false"), 30, 41).count() == 0


def hull_by_pairs(points):
    """Area of the convex hull: of all point pairs those that have no point on their left are its sides."""
    points, area = sorted(points), 0.0
    for a in points:
        for b in points:
            if a != b:
                turns = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for p in points]
                if max(turns) <= 0 and not any(t == 0 and not min(a, b) <= p <= max(a, b) for t, p in zip(turns, points, strict=True)):
                    area += a[0] * b[1] - a[1] * b[0]
    return abs(area) / 2


def test_solidity_by_brute_force(spark):
    rng = np.random.default_rng(3)
    mask = rng.random((17, 15)) < 0.6
    components = sg.connected_components(runs_of(spark, [mask]), 4, 15)
    pixels = {}
    for r in sg.component_pixels(components).collect():
        pixels.setdefault(r["component"], []).append((r["y"], r["x"]))
    want = {c: len(ps) / hull_by_pairs({(y + i, x + j) for y, x in ps for i in (0, 1) for j in (0, 1)}) for c, ps in pixels.items()}
    for strip in (512, 3, 1):
        got = {r["component"]: r["solidity"] for r in sg.solidity(components, strip).collect()}
        assert got == pytest.approx(want)


def test_mosaic_with_odd_places_and_overlaps(spark):
    rng = np.random.default_rng(4)
    places, rows, total = [(0, 0, 0), (1, -1, 7), (2, 5, 1), (3, 4, 8)], [], {}
    for m, y0, x0 in places:
        tile = rng.integers(0, 100, (6, 9)).astype(float)
        rows += [("s", 1, 0, 0, m, y, line.tolist()) for y, line in enumerate(tile)]
        for y, x in np.ndindex(6, 9):
            total.setdefault(((y + y0) // 2, (x + x0) // 2), []).append(tile[y, x])
    rows += [("s", 1, 0, 0, 9, 0, [1.0]), ("s", 1, 0, 0, 0, 9, [])]  # a tile without place, a line without pixels
    lines = spark.createDataFrame(rows, PLANE + "m int, y int, pixels array<double>")
    got = {(r["y"], r["x"]): r["v"] for r in im.mosaic_canvas(lines, spark.createDataFrame(places, "m int, y0 int, x0 int")).collect()}
    assert got == pytest.approx({k: sum(v) / len(v) for k, v in total.items()})


def test_fastq_of_many_splits(spark, tmp_path):
    from cellspark.sources.files import read_fastq

    want = [(f"r{k}", "ACGT" * (k % 9 + 1), "@+I!" * (k % 9 + 1)) for k in range(700)]
    (tmp_path / "a.fastq").write_text("".join(f"@{i} x\n{s}\n+\n{q}\n" for i, s, q in want))
    keys = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "150", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = read_fastq(spark, [str(tmp_path / "a.fastq")])
        assert spark.read.text(str(tmp_path / "a.fastq")).rdd.getNumPartitions() > 200
        assert sorted((r["read_id"], r["seq"], r["qual"]) for r in got.collect()) == sorted(want)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
