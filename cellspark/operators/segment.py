"""Masks, components and regions. A mask is kept as runs: one row per stretch of foreground in a line."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels
from ..plans.lineage import cut
from .graph import components as joined_up
from .intensity import PLANE, above, gaussian_blur, otsu_threshold, row_l2

RUN = "sample string, replicate int, t int, channel int, y int, x0 int, x1 int"


def mask_runs(masks: DataFrame) -> DataFrame:
    """Runs (y, x0, x1 inclusive) of the lines' masks, found within each row."""
    edge = lambda x, side: F.coalesce(F.get("mask", x + side), F.lit(False))
    places = F.sequence(F.lit(0), F.size("mask") - 1)
    starts = F.filter(places, lambda x: F.get("mask", x) & ~edge(x, -1))
    ends = F.filter(places, lambda x: F.get("mask", x) & ~edge(x, 1))
    return masks.select(*PLANE, "y", F.explode(F.arrays_zip(starts.alias("x0"), ends.alias("x1"))).alias("r")).select(*PLANE, "y", "r.x0", "r.x1")


#: Lines of a plane that are labelled together.
STRIP = 512


def connected_components(runs: DataFrame, connectivity: int, width: int, strip: int = STRIP) -> DataFrame:
    """runs with component: the least raster index (y * width + x) of the island.

    Strips of so many lines are groups of their own. The lines on both sides of a seam, again a group, tell which islands
    of two strips are one; what hangs together over seams takes the least index. A plane of any height is no single group."""

    def within(table: pa.Table) -> pa.Table:
        y, x0, x1 = (table.column(c).to_numpy() for c in ("y", "x0", "x1"))
        root = kernels.runs_components(y, x0, x1, connectivity)
        least = np.full(len(y), np.iinfo(np.int64).max)
        np.minimum.at(least, root, y.astype(np.int64) * width + x0)
        return table.drop(["strip"]).append_column("component", pa.array(least[root]))

    own = runs.select(*PLANE, "y", "x0", "x1", F.floor(F.col("y") / strip).cast("int").alias("strip"))
    parts = cut(own.groupBy(*PLANE, "strip").applyInArrow(within, RUN + ", component long"), "strips")
    last = (F.col("y") + 1) % strip == 0
    # a line is the last before a seam, the first after one, or both
    number = F.explode(F.array_distinct(F.transform(F.array(F.col("y"), F.col("y") + 1), lambda y: F.when(y % strip == 0, F.floor(y / strip).cast("int")))))
    seams = parts.where(last | (F.col("y") % strip == 0)).withColumn("seam", number).where("seam > 0")
    if not seams.where(last).head(1):
        return parts

    def across(table: pa.Table) -> pa.Table:
        """Pairs of islands that touch over a seam: those of a line's runs in one component of the two lines."""
        y, x0, x1, component = (table.column(c).to_numpy() for c in ("y", "x0", "x1", "component"))
        root = kernels.runs_components(y, x0, x1, connectivity)
        order = np.lexsort((component, root))
        same = root[order][1:] == root[order][:-1]
        a, b = component[order][:-1][same], component[order][1:][same]
        key = table.slice(0, 1).select(PLANE)
        return pa.table([*(pa.array([c[0].as_py()] * len(a), c.type) for c in key.columns), pa.array(a), pa.array(b)], [*PLANE, "a", "b"])

    pairs = seams.groupBy(*PLANE, "seam").applyInArrow(across, "sample string, replicate int, t int, channel int, a long, b long")
    node = lambda c: F.struct(*PLANE, F.col(c).alias("island")).alias(c)
    whole = joined_up(pairs.select(node("a"), node("b"))).select("node.*", F.col("component.island").alias("whole"))
    named = whole.withColumnRenamed("island", "component")
    return parts.join(named, [*PLANE, "component"], "left").select(*PLANE, "y", "x0", "x1", F.coalesce("whole", "component").alias("component"))


def remove_small_objects(components: DataFrame, min_size: int = 50) -> DataFrame:
    """Runs of components of at least min_size pixels."""
    area = F.sum(F.col("x1") - F.col("x0") + 1).over(Window.partitionBy(*PLANE, "component"))
    return components.withColumn("area", area).where(F.col("area") >= min_size).drop("area")


def region_props(components: DataFrame) -> DataFrame:
    """Area, centroid and half-open bounding box of each component, from its runs in closed form."""
    n = F.col("x1") - F.col("x0") + 1
    area = F.sum(n)
    return components.groupBy(*PLANE, "component").agg(
        area.alias("area"), (F.sum(F.col("y") * n) / area).alias("centroid_0"), (F.sum((F.col("x0") + F.col("x1")) * n / 2) / area).alias("centroid_1"), F.min("y").alias("bbox_0"), F.min("x0").alias("bbox_1"), (F.max("y") + 1).alias("bbox_2"), (F.max("x1") + 1).alias("bbox_3")
    )


def shape_features(components: DataFrame) -> DataFrame:
    """Axis lengths (4 times the root of the moments' eigenvalues) and orientation of each component, from the whole-number
    sums over its runs, which need no pixels."""
    whole = lambda c: F.col(c).cast("long")
    n, y, x0, x1 = whole("x1") - whole("x0") + 1, whole("y"), whole("x0"), whole("x1")
    squares = lambda k: k * (k + 1) * (2 * k + 1)  # noqa: E731  six times the sum of squares up to k
    line = (x0 + x1) * n  # twice the sum of x
    sums = components.groupBy(*PLANE, "component").agg(F.sum(n).alias("area"), *[F.sum(v).cast("double").alias(c) for c, v in {"sy": y * n, "sx": line, "syy": y * y * n, "sxx": squares(x1) - squares(x0 - 1), "sxy": y * line}.items()])
    area = F.col("area").cast("double")
    of = lambda s, p, q: (area * s - p * q) / (area * area)
    sx = F.col("sx") / 2
    m = sums.select(*PLANE, "component", "area", of(F.col("syy"), F.col("sy"), F.col("sy")).alias("a"), of(F.col("sxx") / 6, sx, sx).alias("c"), of(F.col("sxy") / 2, F.col("sy"), sx).alias("b"))
    half, root = (F.col("a") + F.col("c")) / 2, F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, 2) + F.pow("b", 2))
    return m.select(*PLANE, "component", "area", (4 * F.sqrt(half + root)).alias("major_axis_length"), (4 * F.sqrt(F.greatest(half - root, F.lit(0.0)))).alias("minor_axis_length"), (0.5 * F.atan2(2 * F.col("b"), F.col("a") - F.col("c"))).alias("orientation"))


def solidity(components: DataFrame, strip: int = STRIP) -> DataFrame:
    """Area over convex-hull area.

    Of each line only the outermost pixels can lie on a hull. The hulls of a component's strips are groups of their own; a second
    aggregate takes the hull of their corners, so that a component of any size is no single group."""
    key = [*PLANE, "component"]
    lines = components.groupBy(*key, "y").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    schema = "sample string, replicate int, t int, channel int, component long, "

    def within(table: pa.Table) -> pa.Table:
        y, x0, x1 = (table.column(c).to_numpy() for c in ("y", "x0", "x1"))
        corners = kernels.hull(kernels.pixel_corners(np.concatenate([y, y]), np.concatenate([x0, x1])))
        area = int(table.column("area").to_numpy().sum())
        return table.slice(0, 1).select(key).append_column("corners", pa.array([[v for p in corners for v in p]], pa.list_(pa.int64()))).append_column("area", pa.array([area]))

    def over(table: pa.Table) -> pa.Table:
        flat = table.column("corners").combine_chunks().flatten().to_numpy()
        whole = kernels.polygon_area(kernels.hull(flat.reshape(-1, 2)))
        return table.slice(0, 1).select(key).append_column("solidity", pa.array([int(table.column("area").to_numpy().sum()) / whole]))

    parts = lines.groupBy(*key, F.floor(F.col("y") / strip).alias("strip")).applyInArrow(within, schema + "corners array<long>, area long")
    return parts.groupBy(*key).applyInArrow(over, schema + "solidity double")


def binary_counts(components: DataFrame, planes: DataFrame, width: int) -> DataFrame:
    """cell_count of each plane: 8-connected islands of the kept mask; planes without any have 0."""
    again = connected_components(components, 8, width).groupBy(*PLANE).agg(F.count_distinct("component").alias("cell_count"))
    return planes.select(*PLANE).distinct().join(again, PLANE, "left").withColumn("cell_count", F.coalesce("cell_count", F.lit(0).cast("long")))


def foreground(lines: DataFrame, width: int, min_size: int = 50) -> DataFrame:
    """Lines to components of the kept mask: unit rows, blur, threshold, 4-connected islands of min_size.

    The blurred planes are read three times (range, histogram, threshold), so they are written once."""
    blurred = cut(gaussian_blur(row_l2(lines)))
    return remove_small_objects(connected_components(mask_runs(above(blurred, otsu_threshold(blurred))), 4, width), min_size)


def channel_counts(lines: DataFrame, width: int, min_size: int = 50) -> DataFrame:
    """Cells per frame in each channel, and in the merged plane (4), as columns."""
    counts = binary_counts(foreground(lines, width, min_size), lines, width)
    wide = counts.groupBy("sample", "replicate", "t").pivot("channel", [0, 1, 2, 4]).agg(F.first("cell_count"))
    return wide.select("sample", "replicate", "t", *[F.coalesce(F.col(str(k)), F.lit(0).cast("long")).alias(n) for k, n in ((0, "taggfp"), (1, "mkate"), (2, "cy5"), (4, "total"))])


#: Rows of flooded(), and the columns that name its groups.
FLOODED = "sample string, replicate int, t int, channel int, component long, y int, x int, distance double, peak boolean, marker long, label long"


def flooded(runs: DataFrame, height: int, width: int) -> DataFrame:
    """Watershed of masks given as runs: rows (plane, component, y, x, distance, peak, marker, label), a row a pixel.

    component is the 8-connected island, the least raster index in it; an island is one group. It is cut out with a border
    of one pixel inside the image: its pixels' nearest background lies there, and so does every neighbour that could
    outdo a peak. Peaks are the local maxima of the distance in 3 by 3 pixels, not at the image's border; markers are the
    8-connected islands of peaks, numbered by raster order within the component; labels spread from them over
    4-neighbours inside the mask. What no marker reaches has label 0. A plane without background has distance 0."""

    def run(table: pa.Table) -> pa.Table:
        y, x0, x1 = (table.column(c).to_numpy() for c in ("y", "x0", "x1"))
        top, left, bottom, right = max(y.min() - 1, 0), max(x0.min() - 1, 0), min(y.max() + 1, height - 1), min(x1.max() + 1, width - 1)
        mask = np.zeros((bottom - top + 1, right - left + 1), bool)
        for a, b, c in zip(y, x0, x1, strict=True):
            mask[a - top, b - left : c - left + 1] = True
        d = np.where(mask, kernels.distances(mask), 0)
        d[~np.isfinite(d)] = 0
        pad = np.pad(d, 1)
        around = np.max([pad[1 + i : 1 + i + d.shape[0], 1 + j : 1 + j + d.shape[1]] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
        ys, xs = np.mgrid[top : bottom + 1, left : right + 1]
        peak = mask & (d == around) & (d > 0) & (ys > 0) & (xs > 0) & (ys < height - 1) & (xs < width - 1)
        markers = kernels.islands(peak)
        label = kernels.watershed(-d, markers, mask)
        at = np.nonzero(mask)
        n, key = len(at[0]), table.slice(0, 1).select([*PLANE, "component"]).to_pylist()[0]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        columns = [pa.array([v] * n, k) for v, k in zip(key.values(), kinds, strict=True)]
        columns += [pa.array((at[0] + top).astype(np.int32)), pa.array((at[1] + left).astype(np.int32)), pa.array(d[at]), pa.array(peak[at]), pa.array(markers[at].astype(np.int64)), pa.array(label[at].astype(np.int64))]
        return pa.table(columns, [c.split()[0] for c in FLOODED.split(", ")])

    return connected_components(runs, 8, width).groupBy(*PLANE, "component").applyInArrow(run, FLOODED)


#: Columns whose distances are found together, and lines.
COLUMNS, LINES = 128, 32


def distance_lines(runs: DataFrame, height: int, width: int) -> DataFrame:
    """(plane, y, distance): of each line with foreground the exact distance of every pixel to the nearest background pixel of the plane, 0 for background.

    Distances along the columns come first, by bundles of columns, then, by bundles of lines, the lower envelope of each line. Both
    are exchanges of their own, so that neither a plane nor an island is a single group. Outside the image is not background; a
    plane without background has distance 0."""
    at = lambda c: F.floor(F.col(c) / COLUMNS).cast("int")
    dealt = runs.select(*PLANE, "y", "x0", "x1", F.explode(F.sequence(at("x0"), at("x1"))).alias("bundle"))

    def down(table: pa.Table) -> pa.Table:
        first = table.column("bundle")[0].as_py() * COLUMNS
        mask = np.zeros((height, min(COLUMNS, width - first)), bool)
        for y, a, b in zip(*(table.column(c).to_pylist() for c in ("y", "x0", "x1")), strict=True):
            mask[y, max(a - first, 0) : b - first + 1] = True
        d = kernels.column_distances(mask)
        ys = np.flatnonzero(mask.any(1))
        key = table.slice(0, 1).select([*PLANE, "bundle"])
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ys) + 1, dtype=np.int32) * mask.shape[1]), pa.array(d[ys].ravel()))
        return pa.table([*(pa.array([c[0].as_py()] * len(ys), c.type) for c in key.columns), pa.array(ys.astype(np.int32)), flat], [*PLANE, "bundle", "y", "down"])

    def along(table: pa.Table) -> pa.Table:
        y, bundle = table.column("y").to_numpy(), table.column("bundle").to_numpy()
        parts = table.column("down").combine_chunks()
        at, flat = parts.offsets.to_numpy(), parts.values.to_numpy()
        ys, row = np.unique(y, return_inverse=True)
        g = np.zeros((len(ys), width))
        for k, (r, b) in enumerate(zip(row, bundle, strict=True)):
            g[r, b * COLUMNS : b * COLUMNS + at[k + 1] - at[k]] = flat[at[k] : at[k + 1]]
        d = kernels.line_distances(g)
        key = table.slice(0, 1).select(PLANE)
        out = pa.ListArray.from_arrays(pa.array(np.arange(len(ys) + 1, dtype=np.int32) * width), pa.array(d.ravel()))
        return pa.table([*(pa.array([c[0].as_py()] * len(ys), c.type) for c in key.columns), pa.array(ys.astype(np.int32)), out], [*PLANE, "y", "distance"])

    plane = "sample string, replicate int, t int, channel int, "
    columns = dealt.groupBy(*PLANE, "bundle").applyInArrow(down, plane + "bundle int, y int, down array<double>")
    return columns.groupBy(*PLANE, F.floor(F.col("y") / LINES).alias("lines")).applyInArrow(along, plane + "y int, distance array<double>")


def local_peaks(pixels: DataFrame) -> DataFrame:
    return pixels.where("peak").select(*PLANE, "y", "x", "distance")


def label_markers(pixels: DataFrame) -> DataFrame:
    """The peaks of flooded() with the number of their island, by raster order within the component."""
    return pixels.where("peak").select(*PLANE, "component", "y", "x", "marker")


def watershed_count(pixels: DataFrame) -> DataFrame:
    return pixels.where("label > 0").groupBy(*PLANE).agg(F.count_distinct("component", "label").alias("watershed_count"))


def labels(pixels: DataFrame) -> DataFrame:
    """The labels of each plane: (plane, component, label)."""
    return pixels.where("label > 0").select(*PLANE, "component", "label").distinct()


def centroids(regions: DataFrame) -> DataFrame:
    """Label and centroid of each region."""
    return regions.select(*PLANE, F.col("component").alias("label"), "centroid_0", "centroid_1")


def component_pixels(components: DataFrame) -> DataFrame:
    """Components as pixels: (plane, component, y, x)."""
    return components.select(*PLANE, "component", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def label_boundaries(pixels: DataFrame, height: int, width: int, *tags: str) -> DataFrame:
    """Pixels (y, x) with a 4-neighbour inside the image that has other tags, or none."""
    tag = F.struct(*(tags or ("component", "label")))
    rows, columns = Window.partitionBy(*PLANE, "y").orderBy("x"), Window.partitionBy(*PLANE, "x").orderBy("y")

    def differs(window, axis, function, step, size):
        near = F.coalesce(function(axis).over(window) == F.col(axis) + step, F.lit(False))
        same = near & F.coalesce(function(tag).over(window) == tag, F.lit(False))
        return ~same & (F.col(axis) + step >= 0) & (F.col(axis) + step < size)

    sides = [(rows, "x", F.lag, -1, width), (rows, "x", F.lead, 1, width), (columns, "y", F.lag, -1, height), (columns, "y", F.lead, 1, height)]
    out = pixels.withColumns({f"_d{k}": differs(*side) for k, side in enumerate(sides)})
    return out.where("_d0 or _d1 or _d2 or _d3").drop("_d0", "_d1", "_d2", "_d3")
