"""Intensity transforms of scan lines: a row is one line of a plane, its pixels an array.

A plane's key is (sample, replicate, t, channel). Work within a line stays in its row, without a shuffle."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PLANE = ["sample", "replicate", "t", "channel"]


def planes_between(lines: DataFrame, start: int, end: int) -> DataFrame:
    """Frames start <= t < end; file number is t + 1."""
    return lines.where((F.col("t") >= start) & (F.col("t") < end)).withColumn("file_number", F.col("t") + 1)


def select_planes(lines: DataFrame, every: int = 1, **keys) -> DataFrame:
    """Rows whose key columns (t, channel, and scene, z, m where there are such) have the given values, single or listed;
    of the time points every so many."""
    for name, value in keys.items():
        lines = lines.where(F.col(name).isin(list(value) if isinstance(value, (list, tuple, set, range)) else [value]))
    return lines.where(F.col("t") % every == 0) if every > 1 else lines


def dims_shape(lines: DataFrame) -> DataFrame:
    """First index and size of each dimension (S scene, T, C, Z, M mosaic tile, Y, X), and whether tiles make a mosaic.

    A dimension without a column has one index, 0."""
    names = {"S": "scene", "T": "t", "C": "channel", "Z": "z", "M": "m", "Y": "y"}
    dims = {d: F.col(c) if c in lines.columns else F.lit(0) for d, c in names.items()}
    row = lines.agg(*[F.struct(F.min(c).cast("long").alias("start"), F.count_distinct(c).alias("size")).alias(d) for d, c in dims.items()], F.struct(F.lit(0).cast("long").alias("start"), F.max("width").cast("long").alias("size")).alias("X"))
    out = row.select((F.col("M.size") > 1).alias("mosaic"), F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d)["start"].alias("start"), F.col(d)["size"].alias("size")) for d in [*dims, "X"]])).alias("d"))
    return out.select("d.*", "mosaic")


def stacked(*frames: DataFrame) -> DataFrame:
    """Union of recordings; rows raise an error when planes differ in height or width."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    planes = out.groupBy(*PLANE).agg(F.struct(F.max("y").alias("y"), F.min("width").alias("low"), F.max("width").alias("high")).alias("shape"))
    shapes = planes.agg(F.count_distinct("shape").alias("shapes"), F.max(F.col("shape.high") - F.col("shape.low")).alias("uneven"))
    same = (F.col("shapes") == 1) & (F.col("uneven") == 0)
    return out.crossJoin(F.broadcast(shapes)).withColumn("width", F.when(same, F.col("width")).otherwise(F.raise_error(F.lit("planes differ in shape")).cast("int"))).drop("shapes", "uneven")


def crop(lines: DataFrame, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    return lines.where((F.col("y") >= y0) & (F.col("y") < y1)).withColumns({"pixels": F.slice("pixels", x0 + 1, x1 - x0), "width": F.lit(x1 - x0)})


def tile_of(y: Column, x: Column, height: int, width: int, ny: int = 6, nx: int = 5) -> Column:
    """Number of the tile in a grid of ny by nx; the last ones take the remainder."""
    return F.least(F.floor(y / (height // ny)), F.lit(ny - 1)) * nx + F.least(F.floor(x / (width // nx)), F.lit(nx - 1))


def without_last(lines: DataFrame) -> DataFrame:
    """Drops the last time point of each recording."""
    last = lines.groupBy("sample", "replicate").agg(F.max("t").alias("last"))
    return lines.join(last, ["sample", "replicate"]).where("t < last").drop("last")


def processing_frames(lines: DataFrame, first: int = 1) -> DataFrame:
    """Skips the first loaded frame; the label of a frame is first plus its place in the order."""
    order = lines.select("sample", "replicate", "t").distinct().withColumn("place", F.row_number().over(Window.partitionBy("sample", "replicate").orderBy("t")) - 1)
    return lines.join(order, ["sample", "replicate", "t"]).where("place > 0").withColumn("label", F.col("place") + first).drop("place")


def elapsed(lines: DataFrame, recordings: DataFrame | None = None, step_min: int = 20) -> DataFrame:
    """lines with elapsed_min: step_min for each frame, from the start of its recording; recordings holds (recording,
    start_h, step_min), a row each, and lines then has a column recording."""
    if recordings is None:
        return lines.withColumn("elapsed_min", F.col("t") * step_min)
    offset = recordings.select("recording", F.col("start_h").alias("_start"), F.col("step_min").alias("_step"))
    return lines.join(F.broadcast(offset), "recording").withColumn("elapsed_min", F.col("_start") * 60 + F.col("t") * F.col("_step")).drop("_start", "_step")


def subsample(lines: DataFrame, dt: int = 20, dy: int = 10, dx: int = 10) -> DataFrame:
    return lines.where((F.col("t") % dt == 0) & (F.col("y") % dy == 0)).withColumn("pixels", F.filter("pixels", lambda v, i: i % dx == 0))


def exploded(lines: DataFrame) -> DataFrame:
    """One row per pixel: plane key, y, x, v."""
    return lines.select(*PLANE, "y", F.posexplode("pixels").alias("x", "v"))


Ranges = dict[int | None, tuple[float, float]]


def plane_percentiles(lines: DataFrame, ranges: Ranges) -> DataFrame:
    """p_lo and p_hi: exact percentiles with linear interpolation of each plane. ranges has those of each channel, or under
    None those of all. What is shuffled are counts of equal values, not pixels."""
    shares = sorted({s for pair in ranges.values() for s in pair})
    counts = lines.select(*PLANE, F.explode("pixels").alias("v")).groupBy(*PLANE, "v").count()
    all_ = counts.groupBy(*PLANE).agg(F.percentile("v", [s / 100.0 for s in shares], F.col("count")).alias("p"))

    def at(side: int) -> Column:
        places = {k: shares.index(pair[side]) for k, pair in ranges.items()}
        if None in places:
            return F.col("p")[places[None]]
        return F.col("p")[F.create_map(*[F.lit(x) for item in places.items() for x in item])[F.col("channel")]]

    return all_.select(*PLANE, at(0).alias("p_lo"), at(1).alias("p_hi"))


def norm_by(lines: DataFrame, ranges: Ranges) -> DataFrame:
    """Clipped and scaled to 0..1; on a flat plane values above the percentile give 1, others 0."""
    bounds = plane_percentiles(lines, ranges)
    share = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(v - F.col("p_lo"), F.col("p_hi") - F.col("p_lo"))))
    scale = lambda v: F.when(F.col("p_hi") > F.col("p_lo"), share(v)).when(v > F.col("p_lo"), 1.0).otherwise(0.0)
    return lines.join(bounds, PLANE).withColumn("pixels", F.transform("pixels", scale)).drop("p_lo", "p_hi")


def normalize_channel(lines: DataFrame, low: float = 50.0, high: float = 99.8) -> DataFrame:
    """Whole numbers 0..255 of each plane between its percentiles."""
    return norm_by(lines, {None: (low, high)}).withColumn("pixels", to_uint(F.col("pixels")))


def to_uint(pixels: Column, scale: float = 255.0) -> Column:
    return F.transform(pixels, lambda v: F.floor(v * scale).cast("int"))


def binarize(labels: Column) -> Column:
    """1 for every label, 0 for none."""
    return F.when(labels > 0, 1).otherwise(0)


def channel_range(channels: list[tuple]) -> Ranges:
    return {c[0]: (c[2], c[3]) for c in channels}


def normalize_frame(lines: DataFrame, channels: list[tuple], merged: int = 4) -> DataFrame:
    """All channels scaled to 0..255 by their ranges, and the mean of channels 0 and 1 as channel 4."""
    out = norm_by(lines, channel_range(channels)).withColumn("pixels", F.transform(to_uint(F.col("pixels")), lambda v: v.cast("double")))
    return out.unionByName(merge_channels(out, 0, 1).withColumn("channel", F.lit(merged)))


def normalize_mosaic_window(lines: DataFrame, channels: list[tuple], y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """normalize_frame of a window of each plane, for the given channels."""
    return normalize_frame(crop(lines.where(F.col("channel").isin([c[0] for c in channels])), y0, y1, x0, x1), channels)


def merge_channels(lines: DataFrame, a: int, b: int, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Weighted sum of two planes; an error where their shapes differ."""
    if len(weights) != 2:
        raise ValueError("two weights are needed")
    key = ["sample", "replicate", "t", "y", "width"]
    both = lines.where(F.col("channel").isin(a, b)).groupBy(*key).agg(F.first(F.when(F.col("channel") == a, F.col("pixels")), True).alias("p"), F.first(F.when(F.col("channel") == b, F.col("pixels")), True).alias("q"))
    same = F.when(F.size("p") == F.size("q"), F.zip_with("p", "q", lambda p, q: p * weights[0] + q * weights[1])).otherwise(F.raise_error(F.lit("planes differ in shape")).cast("array<double>"))
    return both.select("sample", "replicate", "t", F.lit(a).alias("channel"), "y", "width", same.alias("pixels"))


def stack_rgb(lines: DataFrame) -> DataFrame:
    """Arrays r, g, b of channels 0, 1, 2."""
    return lines.where("channel < 3").groupBy("sample", "replicate", "t", "y").agg(*[F.first(F.when(F.col("channel") == k, F.col("pixels")), True).alias(c) for k, c in enumerate("rgb")])


def recolor_cmy(rgb: DataFrame) -> DataFrame:
    add = lambda a, b: F.zip_with(a, b, lambda p, q: p + q)
    return rgb.withColumns({"c": add("r", "g"), "m": add("g", "b"), "k": add("r", "b")}).select("sample", "replicate", "t", "y", F.col("c").alias("r"), F.col("m").alias("g"), F.col("k").alias("b"))


def false_color(lines: DataFrame, color: str) -> DataFrame:
    """The plane in one of r, g, b (either case), zeros in the others."""
    zero = F.transform("pixels", lambda v: F.lit(0.0))
    return lines.select(*PLANE, "y", *[(F.col("pixels") if c == color.lower() else zero).alias(c) for c in "rgb"])


def row_l2(lines: DataFrame) -> DataFrame:
    """Each line scaled to length 1; a line of zeros stays."""
    length = F.sqrt(F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v * v))
    return lines.withColumn("norm", length).withColumn("pixels", F.transform("pixels", lambda v: F.coalesce(F.try_divide(v, F.col("norm")), F.lit(0.0)))).drop("norm")


def gaussian_weights(sigma: float = 2.0, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


#: Lines of a plane that a group blurs; the halo comes on top.
STRIP = 256


def gaussian_blur(lines: DataFrame, sigma: float = 2.0, strip: int = STRIP) -> DataFrame:
    """Separable blur, edges repeated. A group is a strip of a plane with as many lines more above and below as the kernel reaches."""
    weights = np.array(gaussian_weights(sigma))
    r = len(weights) // 2

    def blurred(table: pa.Table) -> pa.Table:
        table = table.sort_by("y")
        y, first = table.column("y").to_numpy(), table.column("_strip")[0].as_py() * strip
        rows = table.column("pixels").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(y), -1)
        side = np.pad(rows, ((0, 0), (r, r)), "edge")
        across = sum(w * side[:, k : k + rows.shape[1]] for k, w in enumerate(weights))
        up = np.pad(across, ((r, r), (0, 0)), "edge")  # a strip's outer lines are the plane's, or of its halo
        own = np.flatnonzero((y >= first) & (y < first + strip))
        out = sum(w * up[own + k] for k, w in enumerate(weights))
        kept = table.take(pa.array(own)).drop_columns(["_strip"])
        return kept.set_column(kept.column_names.index("pixels"), "pixels", pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel())))

    strips = F.transform(F.array(F.col("y") - r, F.col("y"), F.col("y") + r), lambda y: F.greatest(F.floor(y / strip), F.lit(0)).cast("int"))
    dealt = lines.withColumn("_strip", F.explode(F.array_distinct(strips)))
    return dealt.groupBy(*PLANE, "_strip").applyInArrow(blurred, ", ".join(f"`{n}` {t}" for n, t in lines.dtypes))


def downscale(lines: DataFrame) -> DataFrame:
    """Half the size: means of 2 by 2 pixels."""
    return exploded(lines).groupBy(*PLANE, F.expr("cast(y div 2 as int)").alias("y"), F.expr("cast(x div 2 as int)").alias("x")).agg(F.avg("v").alias("v"))


def mosaic_canvas(lines: DataFrame, places: DataFrame) -> DataFrame:
    """A mosaic at half scale: rows (plane, y, x, v) of one canvas.

    lines have a column m, the tile; places holds a tile's m, y0 and x0, where its first pixel lies on the canvas. A canvas pixel is the
    mean of all pixels of all tiles in its 2 by 2 block: blocks across a seam take them from both sides, and where
    tiles overlap both count. What no tile covers has no row. Each line first adds up its own blocks; tiles without place are left out."""
    half = lambda c: F.floor(F.col(c) / 2).cast("int")
    placed = lines.join(places.select("m", "y0", "x0"), "m").withColumn("y", F.col("y") + F.col("y0"))
    first = half("x0")
    # pixel 2 * k - odd is the first one of the line's block k
    odd = F.pmod("x0", F.lit(2))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("pixels") + odd - 1) / 2).cast("int")), lambda k: F.struct(*[F.filter(F.array(*[F.get("pixels", 2 * k - odd + i) for i in (0, 1)]), lambda v: v.isNotNull()).alias("px"), (first + k).alias("x")]))
    rows = placed.where(F.size("pixels") > 0).select(*PLANE, half("y").alias("y"), F.explode(blocks).alias("b"))
    total = F.aggregate("b.px", F.lit(0.0), lambda a, v: a + v)
    return rows.groupBy(*PLANE, "y", F.col("b.x").alias("x")).agg((F.sum(total) / F.sum(F.size("b.px"))).alias("v"))


def otsu_threshold(lines: DataFrame, bins: int = 256) -> DataFrame:
    """Centre of the bin after which the variance between both classes is largest, first one of equals; a flat plane has its value.

    Pixels reduce to a plane's range and its bins' counts before any shuffle."""
    low, high = F.array_min("pixels"), F.array_max("pixels")
    bounds = lines.groupBy(*PLANE).agg(F.min(low).alias("lo"), F.max(high).alias("hi"))
    px = lines.join(bounds, PLANE).select(*PLANE, "lo", "hi", F.explode("pixels").alias("v"))
    bin_ = F.coalesce(F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    counts = px.groupBy(*PLANE, "lo", "hi", bin_.alias("bin")).agg(F.count("*").cast("double").alias("n"))
    mid = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    order = Window.partitionBy(*PLANE).orderBy("bin")
    before, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*PLANE)
    s = counts.withColumn("mid", mid).select("*", F.sum("n").over(before).alias("w0"), F.sum(F.col("n") * F.col("mid")).over(before).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("mid")).over(whole).alias("s"))
    between = F.col("w0") * (F.col("w") - F.col("w0")) * F.pow(F.col("s0") / F.col("w0") - F.try_divide(F.col("s") - F.col("s0"), F.col("w") - F.col("w0")), 2)
    # empty bins repeat the variance of the bin before them, so the first of equals is never empty
    best = s.withColumn("var", F.coalesce(between, F.lit(-1.0))).withColumn("rank", F.row_number().over(Window.partitionBy(*PLANE).orderBy(F.desc("var"), "bin"))).where("rank = 1")
    return best.select(*PLANE, F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("mid")).alias("threshold"))


def above(lines: DataFrame, thresholds: DataFrame) -> DataFrame:
    """mask: array of booleans, v > threshold of the plane (a row per plane: broadcast by Spark where small)."""
    return lines.join(thresholds, PLANE).withColumn("mask", F.transform("pixels", lambda v: v > F.col("threshold"))).drop("threshold", "pixels")
