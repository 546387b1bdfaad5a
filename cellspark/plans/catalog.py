"""Queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import expression as ex
from ..operators import intensity as im
from ..operators import segment as sg
from ..operators import tracking as tr
from ..sources import files
from ..sources import standins as st
from .lineage import cut, new_path

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SIDE = st.SIDE
MIN_SIZE = 50


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def flat(lines, *keep):
    """Pixels as rows, for comparison."""
    return im.exploded(lines).select("t", "channel", "y", "x", *keep, "v")


#: Pixels of the stand-in planes.
PX = f"""f AS (SELECT CAST(FLOOR(COUNT(*)/{SIDE}) AS INT) nf FROM embeddings),
e AS (SELECT CAST(FLOOR(vec_id/{SIDE}) AS INT) bt, CAST(vec_id%{SIDE} AS INT) y, embedding FROM embeddings),
s AS (SELECT CAST((e.bt - c.channel + 2*f.nf) % f.nf AS INT) t, c.channel, e.y, e.embedding FROM e CROSS JOIN f CROSS JOIN (VALUES (0),(1),(2),(3)) c(channel) WHERE e.bt < f.nf),
u AS (SELECT t, channel, y, CAST(generate_subscripts(embedding,1)-1 AS INT) x, unnest(embedding) e FROM s),
px AS (SELECT t, channel, y, x, FLOOR((CAST(e AS DOUBLE)+1.0)*1000.0) v FROM u)"""
WITH = f"WITH {PX} "
NORM = f"""pc AS (SELECT t, channel, CASE channel WHEN 3 THEN MIN(v) ELSE quantile_cont(v, 0.5) END p_lo, CASE channel WHEN 3 THEN MAX(v) ELSE quantile_cont(v, 0.998) END p_hi FROM px GROUP BY t, channel),
nm AS (SELECT t, channel, y, x, FLOOR(255 * CASE WHEN p_hi = p_lo THEN CASE WHEN v > p_lo THEN 1.0 ELSE 0.0 END ELSE GREATEST(0.0, LEAST(1.0, (v - p_lo)/(p_hi - p_lo))) END) v FROM px JOIN pc USING (t, channel))"""


def _landed(spark, d):
    """The stand-in planes, written to the shared folder; their path."""
    path = new_path(spark, "planes")
    files.write_planes(st.scanlines(spark, d), path)
    return path


@query(WITH + "SELECT t, channel, t + 1 AS file_number, COUNT(*) n, SUM(v) total FROM px WHERE t >= 1 AND t < 4 GROUP BY t, channel")
def read_planes(spark, d):
    lines = files.read_planes(spark, _landed(spark, d), "S", 1, 1, 4)
    return lines.select("t", "channel", "file_number", F.explode("pixels").alias("v")).groupBy("t", "channel", "file_number").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query(WITH + "SELECT t, channel, y, SUM(v) total FROM px GROUP BY 1, 2, 3")
def plane_files(spark, d):
    path = new_path(spark, "plane-files")
    files.write_plane_files(st.scanlines(spark, d), path if "://" in path else f"file://{path}")
    return im.exploded(files.plane_files(spark, path)).groupBy("t", "channel", "y").agg(F.sum("v").alias("total"))


@query(WITH + "SELECT k.sample, t, channel, COUNT(*) n FROM px CROSS JOIN (VALUES ('S'), ('T')) k(sample) GROUP BY 1, 2, 3")
def stack_planes(spark, d):
    lines = st.scanlines(spark, d)
    return im.exploded(im.stacked(lines, lines.withColumn("sample", F.lit("T")))).groupBy("sample", "t", "channel").agg(F.count("*").alias("n"))


@query(WITH + "SELECT t, channel, y, SUM(v) total FROM px WHERE channel IN (0, 2) AND t % 3 = 0 GROUP BY 1, 2, 3")
def select_planes(spark, d):
    return im.exploded(im.select_planes(st.scanlines(spark, d), 3, channel=(0, 2))).groupBy("t", "channel", "y").agg(F.sum("v").alias("total"))


@query(WITH + "SELECT t, channel, SUM(v) total FROM px WHERE channel = 2 AND t >= 1 AND t < 5 GROUP BY 1, 2")
def read_plane_series(spark, d):
    names = F.create_map(*[F.lit(x) for c in st.CHANNELS for x in c[:2]])
    planes = st.scanlines(spark, d).withColumn("kind", names[F.col("channel")])
    return im.exploded(files.read_plane_series(planes, "Cy5", 5)).groupBy("t", "channel").agg(F.sum("v").alias("total"))


@query(WITH + """SELECT *, FALSE AS mosaic FROM (SELECT 'S' AS dim, CAST(0 AS BIGINT) AS start, CAST(1 AS BIGINT) AS size UNION ALL SELECT 'Z', 0, 1 UNION ALL SELECT 'M', 0, 1 UNION ALL SELECT 'T', MIN(t), COUNT(DISTINCT t) FROM px UNION ALL SELECT 'C', MIN(channel), COUNT(DISTINCT channel) FROM px
UNION ALL SELECT 'Y', MIN(y), COUNT(DISTINCT y) FROM px UNION ALL SELECT 'X', 0, MAX(x) + 1 FROM px)""")
def dims_shape(spark, d):
    return im.dims_shape(st.scanlines(spark, d))


@query(WITH + "SELECT t, channel, y, x - 5 AS x, v FROM px WHERE y >= 3 AND y < 13 AND x >= 5 AND x < 25")
def crop(spark, d):
    return flat(im.crop(st.scanlines(spark, d), 3, 13, 5, 25))


@query(WITH + "SELECT t, channel, CAST(LEAST(FLOOR(y/10), 5) * 5 + LEAST(FLOOR(x/12), 4) AS BIGINT) tile, COUNT(*) n, SUM(v) total FROM px GROUP BY 1, 2, 3")
def tile_id(spark, d):
    px = im.exploded(st.scanlines(spark, d))
    return px.groupBy("t", "channel", im.tile_of(F.col("y"), F.col("x"), SIDE, SIDE).cast("long").alias("tile")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query(WITH + "SELECT t, COUNT(*) n FROM s WHERE t < (SELECT MAX(t) FROM s) GROUP BY t")
def drop_last_timepoint(spark, d):
    return im.without_last(st.scanlines(spark, d)).groupBy("t").agg(F.count("*").alias("n"))


@query(WITH + "SELECT label, t, COUNT(*) n FROM (SELECT t, DENSE_RANK() OVER (ORDER BY t) label, y FROM s) WHERE label > 1 GROUP BY 1, 2".replace("label, y FROM s) WHERE label > 1", "lb, y FROM s) WHERE lb > 1").replace("SELECT label, t", "SELECT CAST(lb AS INT) AS label, t"))
def processing_frames(spark, d):
    return im.processing_frames(st.scanlines(spark, d)).groupBy("label", "t").agg(F.count("*").alias("n"))


@query(WITH + "SELECT CASE channel WHEN 0 THEN 'TagGFP' WHEN 1 THEN 'MKate' WHEN 2 THEN 'Cy5' ELSE 'Oblique' END AS name, COUNT(*) n FROM s GROUP BY 1")
def channel_name(spark, d):
    names = F.create_map(*[F.lit(x) for c in st.CHANNELS for x in c[:2]])
    return st.scanlines(spark, d).groupBy(names[F.col("channel")].alias("name")).agg(F.count("*").alias("n"))


@query(WITH + "SELECT t, channel, y, CAST(x/10 AS INT) x, v FROM px WHERE t % 2 = 0 AND y % 10 = 0 AND x % 10 = 0")
def subsample(spark, d):
    return flat(im.subsample(st.scanlines(spark, d), 2))


@query(WITH + "SELECT t, CAST(t * 20 AS INT) AS elapsed_min, COUNT(*) n FROM s GROUP BY 1, 2")
def elapsed(spark, d):
    return im.elapsed(st.scanlines(spark, d)).groupBy("t", "elapsed_min").agg(F.count("*").alias("n"))


@query(WITH + "SELECT 1 + t % 2 AS recording, t, t % 2 * 24 * 60 + t * 20 AS elapsed_min, COUNT(*) n FROM s GROUP BY 1, 2, 3")
def elapsed_recordings(spark, d):
    lines = st.scanlines(spark, d).withColumn("recording", F.col("t") % 2 + 1)
    return im.elapsed(lines, st.recordings(spark)).groupBy("recording", "t", "elapsed_min").agg(F.count("*").alias("n"))


@query(WITH + f", {NORM} SELECT t, channel, ROUND(p_lo, 6) p_lo, ROUND(p_hi, 6) p_hi FROM pc")
def plane_percentiles(spark, d):
    return rounded(im.plane_percentiles(st.scanlines(spark, d), im.channel_range(st.CHANNELS)), "p_lo", "p_hi").select("t", "channel", "p_lo", "p_hi")


@query(WITH + f", {NORM} SELECT t, channel, y, CAST(SUM(v) AS BIGINT) total, CAST(MAX(v) AS INT) top FROM nm WHERE channel < 3 GROUP BY 1, 2, 3")
def normalize_channel(spark, d):
    px = flat(im.normalize_channel(st.scanlines(spark, d).where("channel < 3")))
    return px.groupBy("t", "channel", "y").agg(F.sum("v").alias("total"), F.max("v").alias("top"))


@query(WITH + f", {NORM} SELECT t, channel, y, x, ROUND(CASE WHEN p_hi = p_lo THEN CASE WHEN v > p_lo THEN 1.0 ELSE 0.0 END ELSE GREATEST(0.0, LEAST(1.0, (v - p_lo)/(p_hi - p_lo))) END, 6) v FROM px JOIN pc USING (t, channel)")
def norm_by(spark, d):
    return rounded(flat(im.norm_by(st.scanlines(spark, d), im.channel_range(st.CHANNELS))), "v")


@query(WITH + "SELECT t, channel, y, CAST(SUM(FLOOR(v / 4096 * 65535)) AS BIGINT) total, CAST(MAX(FLOOR(v / 4096 * 65535)) AS INT) top FROM px GROUP BY 1, 2, 3")
def to_uint(spark, d):
    lines = st.scanlines(spark, d).withColumn("pixels", im.to_uint(F.transform("pixels", lambda v: v / 4096), 65535.0))
    return flat(lines).groupBy("t", "channel", "y").agg(F.sum("v").alias("total"), F.max("v").alias("top"))


@query(WITH + f""", wp AS (SELECT t, channel, y, x - 6 x, v FROM px WHERE channel < 3 AND y >= 4 AND y < 44 AND x >= 6 AND x < 56),
wc AS (SELECT t, channel, quantile_cont(v, 0.5) p_lo, quantile_cont(v, 0.998) p_hi FROM wp GROUP BY t, channel),
wn AS (SELECT t, channel, y, x, FLOOR(255 * CASE WHEN p_hi = p_lo THEN CASE WHEN v > p_lo THEN 1.0 ELSE 0.0 END ELSE GREATEST(0.0, LEAST(1.0, (v - p_lo)/(p_hi - p_lo))) END) v FROM wp JOIN wc USING (t, channel)),
wa AS (SELECT * FROM wn UNION ALL SELECT a.t, 4, a.y, a.x, a.v*0.5 + b.v*0.5 FROM wn a JOIN wn b USING (t, y, x) WHERE a.channel = 0 AND b.channel = 1) SELECT t, channel, y, SUM(v) total FROM wa GROUP BY 1, 2, 3""")
def normalize_mosaic_window(spark, d):
    return flat(im.normalize_mosaic_window(st.scanlines(spark, d), st.CHANNELS[:3], 4, 44, 6, 56)).groupBy("t", "channel", "y").agg(F.sum("v").alias("total"))


MERGED = "al AS (SELECT * FROM nm UNION ALL SELECT a.t, 4, a.y, a.x, a.v*0.5 + b.v*0.5 FROM nm a JOIN nm b USING (t, y, x) WHERE a.channel = 0 AND b.channel = 1)"


@query(WITH + f", {NORM}, al AS (SELECT * FROM nm UNION ALL SELECT a.t, 4, a.y, a.x, a.v*0.5 + b.v*0.5 FROM nm a JOIN nm b USING (t, y, x) WHERE a.channel = 0 AND b.channel = 1) SELECT t, channel, y, SUM(v) total FROM al GROUP BY 1, 2, 3")
def normalize_frame(spark, d):
    return flat(im.normalize_frame(st.scanlines(spark, d), st.CHANNELS)).groupBy("t", "channel", "y").agg(F.sum("v").alias("total"))


@query(WITH + "SELECT a.t, a.y, a.x, a.v*0.5 + b.v*0.5 AS v FROM px a JOIN px b USING (t, y, x) WHERE a.channel = 0 AND b.channel = 1")
def merge_channels(spark, d):
    return flat(im.merge_channels(st.scanlines(spark, d), 0, 1)).drop("channel")


def _rgb(df):
    return df.select("t", "y", F.posexplode(F.arrays_zip("r", "g", "b")).alias("x", "p")).select("t", "y", "x", "p.r", "p.g", "p.b")


RGB = "rgb AS (SELECT t, y, x, MAX(v) FILTER (channel = 0) r, MAX(v) FILTER (channel = 1) g, MAX(v) FILTER (channel = 2) b FROM px GROUP BY 1, 2, 3)"


@query(WITH + f", {RGB} SELECT t, y, x, r, g, b FROM rgb")
def stack_rgb(spark, d):
    return _rgb(im.stack_rgb(st.scanlines(spark, d)))


@query(WITH + f", {RGB} SELECT t, y, x, r + g AS r, g + b AS g, r + b AS b FROM rgb")
def recolor_cmy(spark, d):
    return _rgb(im.recolor_cmy(im.stack_rgb(st.scanlines(spark, d))))


@query(WITH + "SELECT t, channel, y, x, CAST(0 AS DOUBLE) AS r, v AS g, CAST(0 AS DOUBLE) AS b FROM px")
def false_color(spark, d):
    rgb = im.false_color(st.scanlines(spark, d), "G")
    return rgb.select("t", "channel", "y", F.posexplode(F.arrays_zip("r", "g", "b")).alias("x", "p")).select("t", "channel", "y", "x", "p.r", "p.g", "p.b")


@query(WITH + "SELECT t, channel, y, x, ROUND(v / SQRT(SUM(v*v) OVER (PARTITION BY t, channel, y)), 6) v FROM px")
def row_l2_normalize(spark, d):
    return rounded(flat(im.row_l2(st.scanlines(spark, d))), "v")


_W = ",".join(f"({k - 8},{w!r})" for k, w in enumerate(im.gaussian_weights()))



def _blur(src: str) -> str:
    return f"""l2 AS (SELECT t, channel, y, x, COALESCE(v / NULLIF(SQRT(SUM(v*v) OVER (PARTITION BY t, channel, y)), 0), 0) v FROM {src}), w(k, w) AS (VALUES {_W}),
h AS (SELECT i.t, i.channel, i.y, i.x, SUM(j.v * w) v FROM l2 i CROSS JOIN w JOIN l2 j ON j.t = i.t AND j.channel = i.channel AND j.y = i.y AND j.x = GREATEST(0, LEAST({SIDE - 1}, i.x + k)) GROUP BY 1, 2, 3, 4),
bl AS (SELECT i.t, i.channel, i.y, i.x, SUM(j.v * w) v FROM h i CROSS JOIN w JOIN h j ON j.t = i.t AND j.channel = i.channel AND j.x = i.x AND j.y = GREATEST(0, LEAST({SIDE - 1}, i.y + k)) GROUP BY 1, 2, 3, 4)"""


@query(WITH + f", {_blur('px')} SELECT t, channel, y, ROUND(SUM(v), 5) total, ROUND(MAX(v), 6) top FROM bl GROUP BY 1, 2, 3")
def gaussian_blur(spark, d):
    px = flat(im.gaussian_blur(im.row_l2(st.scanlines(spark, d))))
    return rounded(rounded(px.groupBy("t", "channel", "y").agg(F.sum("v").alias("total"), F.max("v").alias("top")), "top"), "total", digits=5)


@query(WITH + "SELECT t, channel, CAST(FLOOR(y/2) AS INT) y, CAST(FLOOR(x/2) AS INT) x, AVG(v) v FROM px GROUP BY 1, 2, 3, 4")
def downscale_mosaic(spark, d):
    return im.downscale(st.scanlines(spark, d)).select("t", "channel", "y", "x", "v")


#: Where the tiles of a stand-in mosaic lie: each channel's plane is a tile, with odd places and overlaps.
PLACES = [(0, 0, 0), (1, 0, 61), (2, 63, 0), (3, 61, 63)]


@query(WITH + f", pl(channel, y0, x0) AS (VALUES {str(PLACES)[1:-1]}) SELECT t, CAST(FLOOR((y + y0)/2) AS INT) y, CAST(FLOOR((x + x0)/2) AS INT) x, ROUND(AVG(v), 6) v FROM px JOIN pl USING (channel) GROUP BY ALL")
def mosaic_canvas(spark, d):
    tiles = st.scanlines(spark, d).withColumn("m", F.col("channel")).withColumn("channel", F.lit(0))
    return rounded(im.mosaic_canvas(tiles, spark.createDataFrame(PLACES, "m int, y0 int, x0 int")), "v").select("t", "y", "x", "v")


def _otsu(src: str) -> str:
    return f"""mm AS (SELECT t, channel, MIN(v) lo, MAX(v) hi FROM {src} GROUP BY 1, 2),
hb AS (SELECT t, channel, lo, hi, CAST(LEAST(FLOOR((v - lo)/(hi - lo)*256), 255) AS INT) bin, COUNT(*) n FROM {src} JOIN mm USING (t, channel) GROUP BY ALL),
hm AS (SELECT *, lo + (bin + 0.5)*(hi - lo)/256 AS mid FROM hb),
hs AS (SELECT *, SUM(n) OVER k w0, SUM(n*mid) OVER k s0, SUM(n) OVER p w, SUM(n*mid) OVER p s FROM hm WINDOW k AS (PARTITION BY t, channel ORDER BY bin), p AS (PARTITION BY t, channel)),
ov AS (SELECT *, CASE WHEN w > w0 THEN w0*(w - w0)*POWER(s0/w0 - (s - s0)/(w - w0), 2) ELSE -1 END var FROM hs),
ot AS (SELECT t, channel, mid AS threshold FROM ov QUALIFY ROW_NUMBER() OVER (PARTITION BY t, channel ORDER BY var DESC, bin) = 1)"""


@query(WITH + f", {_otsu('px')} SELECT t, channel, ROUND(threshold, 6) threshold FROM ot")
def otsu_threshold(spark, d):
    return rounded(im.otsu_threshold(st.scanlines(spark, d)).select("t", "channel", "threshold"), "threshold")


@query(WITH + f", {_otsu('px')} SELECT t, channel, y, COUNT(*) n FROM px JOIN ot USING (t, channel) WHERE v > threshold GROUP BY 1, 2, 3")
def apply_threshold(spark, d):
    lines = st.scanlines(spark, d)
    masks = im.above(lines, im.otsu_threshold(lines))
    return masks.select("t", "channel", "y", F.size(F.filter("mask", lambda m: m)).cast("long").alias("n")).where("n > 0")


def _mask(spark, d):
    """All planes above a fixed value: many small islands."""
    return st.scanlines(spark, d).withColumn("mask", F.transform("pixels", lambda v: v > 1048)).drop("pixels")


#: Pixels of a plane, and the place of a plane among raster indices.
AREA = SIDE * SIDE
AT = f"(t*8 + channel)*{AREA}"


def _runs(src: str, n: str = "") -> str:
    """Runs rn of the pixels (t, channel, y, x) of src; id is the first pixel's raster index."""
    return f"""fg{n} AS (SELECT t, channel, y, x, x - ROW_NUMBER() OVER (PARTITION BY t, channel, y ORDER BY x) g FROM {src}),
rn{n} AS (SELECT t, channel, y, CAST(MIN(x) AS INT) x0, CAST(MAX(x) AS INT) x1, {AT} + y*{SIDE} + MIN(x) AS id FROM fg{n} GROUP BY t, channel, y, g)"""


def _islands(k: int, n: str = "") -> str:
    """Islands co of runs rn by transitive closure; component is the least raster index."""
    return f"""ed{n} AS (SELECT a.id a, b.id b FROM rn{n} a JOIN rn{n} b ON a.t = b.t AND a.channel = b.channel AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 + {k} AND b.x0 <= a.x1 + {k}),
reach{n}(a, b) AS (SELECT id, id FROM rn{n} UNION SELECT r.a, ed{n}.b FROM reach{n} r JOIN ed{n} ON r.b = ed{n}.a),
co{n} AS (SELECT rn{n}.*, c - {AT} AS component FROM rn{n} JOIN (SELECT a, MIN(b) c FROM reach{n} GROUP BY a) ON a = id)"""


def _pixels(co: str) -> str:
    return f"(SELECT t, channel, component, y, CAST(UNNEST(generate_series(x0, x1)) AS INT) x FROM {co})"


BRIGHT = f"br AS (SELECT t, channel, y, x FROM px WHERE v > 1048), {_runs('br')}"
MASK = f"WITH RECURSIVE {PX}, {BRIGHT}, "


@query(WITH + f", {BRIGHT} SELECT t, channel, y, x0, x1 FROM rn")
def mask_runs(spark, d):
    return sg.mask_runs(_mask(spark, d)).select("t", "channel", "y", "x0", "x1")


def _components(spark, d, k):
    return sg.connected_components(sg.mask_runs(_mask(spark, d)), k, SIDE)


@query(MASK + _islands(0) + " SELECT t, channel, y, x0, x1, CAST(component AS BIGINT) component FROM co")
def connected_components_4(spark, d):
    return _components(spark, d, 4).select("t", "channel", "y", "x0", "x1", "component")


@query(MASK + _islands(1) + " SELECT t, channel, y, x0, x1, CAST(component AS BIGINT) component FROM co")
def connected_components_8(spark, d):
    return _components(spark, d, 8).select("t", "channel", "y", "x0", "x1", "component")


@query(MASK + _islands(0) + " SELECT t, channel, CAST(component AS BIGINT) component, CAST(SUM(x1 - x0 + 1) AS BIGINT) area FROM co GROUP BY 1, 2, 3 HAVING SUM(x1 - x0 + 1) >= 5")
def remove_small_objects(spark, d):
    return sg.remove_small_objects(_components(spark, d, 4), 5).groupBy("t", "channel", "component").agg(F.sum(F.expr("x1 - x0 + 1")).alias("area"))


@query(MASK + _islands(0) + " SELECT t, channel, CAST(SUM(x1 - x0 + 1) AS BIGINT) n FROM co GROUP BY 1, 2")
def binarize(spark, d):
    labels = sg.component_pixels(_components(spark, d, 4)).withColumn("one", im.binarize(F.col("component") + 1))
    return labels.groupBy("t", "channel").agg(F.sum("one").alias("n"))


PROPS = f"rp AS (SELECT t, channel, CAST(component AS BIGINT) component, COUNT(*) area, AVG(y) centroid_0, AVG(x) centroid_1, MIN(y) bbox_0, CAST(MIN(x) AS INT) bbox_1, MAX(y) + 1 bbox_2, CAST(MAX(x) + 1 AS INT) bbox_3 FROM {_pixels('co')} GROUP BY 1, 2, 3)"


@query(MASK + f"{_islands(0)}, {PROPS} SELECT t, channel, component, area, ROUND(centroid_0, 6) centroid_0, ROUND(centroid_1, 6) centroid_1, bbox_0, bbox_1, bbox_2, bbox_3 FROM rp")
def region_props(spark, d):
    return rounded(sg.region_props(_components(spark, d, 4)).drop("sample", "replicate"), "centroid_0", "centroid_1")


@query(MASK + f"{_islands(0)}, {PROPS} SELECT t, channel, component AS label, ROUND(centroid_0, 6) centroid_0, ROUND(centroid_1, 6) centroid_1 FROM rp")
def centroids(spark, d):
    return rounded(sg.centroids(sg.region_props(_components(spark, d, 4))).drop("sample", "replicate"), "centroid_0", "centroid_1")


@query(MASK + f"{_islands(0)}, {PROPS} SELECT 'S/1/' || channel AS movie, component AS \"ID\", t, ROUND(centroid_0, 6) x, ROUND(centroid_1, 6) y, CAST(0 AS DOUBLE) AS z, CAST(1 AS DOUBLE) AS prob, 0 AS states, area FROM rp")
def objects_from_masks(spark, d):
    return rounded(tr.objects_from_regions(sg.region_props(_components(spark, d, 4))), "x", "y")


@query(MASK + _islands(0) + f""", mo AS (SELECT t, channel, component, COUNT(*) area, CAST(SUM(y) AS DOUBLE) sy, CAST(SUM(x) AS DOUBLE) sx, CAST(SUM(y*y) AS DOUBLE) syy, CAST(SUM(x*x) AS DOUBLE) sxx, CAST(SUM(y*x) AS DOUBLE) sxy FROM {_pixels('co')} GROUP BY 1, 2, 3 HAVING COUNT(*) >= 5),
m2 AS (SELECT t, channel, component, area, (area*syy - sy*sy)/(area*area) a, (area*sxx - sx*sx)/(area*area) c, (area*sxy - sy*sx)/(area*area) b FROM mo)
SELECT t, channel, CAST(component AS BIGINT) component, area, ROUND(4*SQRT((a + c)/2 + SQRT(POWER((a - c)/2, 2) + b*b)), 4) major, ROUND(4*SQRT(GREATEST((a + c)/2 - SQRT(POWER((a - c)/2, 2) + b*b), 0)), 4) minor, ROUND(0.5*ATAN2(2*b, a - c), 6) orientation FROM m2""")
def shape_features(spark, d):
    out = sg.shape_features(sg.remove_small_objects(_components(spark, d, 4), 5))
    return out.select("t", "channel", "component", "area", F.round("major_axis_length", 4).alias("major"), F.round("minor_axis_length", 4).alias("minor"), F.round("orientation", 6).alias("orientation"))


@query(MASK + _islands(1) + " SELECT t, channel, COUNT(DISTINCT component) cell_count FROM co GROUP BY 1, 2")
def cell_count(spark, d):
    return sg.binary_counts(_components(spark, d, 4), _mask(spark, d), SIDE).select("t", "channel", "cell_count")


DISTANCE = """ SELECT a.t, a.channel, a.y, a.x, ROUND(SQRT(MIN((a.y - b.y)*(a.y - b.y) + (a.x - b.x)*(a.x - b.x))), 6) distance
FROM px a JOIN px b ON a.t = b.t AND a.channel = b.channel AND a.v > 1048 AND b.v <= 1048 GROUP BY 1, 2, 3, 4"""


@query(WITH + DISTANCE)
def distance_transform(spark, d):
    lines = sg.distance_lines(sg.mask_runs(_mask(spark, d)), SIDE, SIDE)
    return rounded(lines.select("t", "channel", "y", F.posexplode("distance").alias("x", "distance")).where("distance > 0"), "distance")


@query(WITH + DISTANCE)
def distance_transform_planes(spark, d):
    """distance_transform, every frame and channel."""
    return distance_transform(spark, d)


@query(MASK + _islands(0) + f""", pp AS {_pixels('co')}, sides(dy, dx) AS (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)),
nb AS (SELECT p.*, p.y + dy ny, p.x + dx nx FROM pp p CROSS JOIN sides WHERE p.y + dy BETWEEN 0 AND {SIDE - 1} AND p.x + dx BETWEEN 0 AND {SIDE - 1})
SELECT DISTINCT n.t, n.channel, n.y, n.x, CAST(n.component AS BIGINT) AS label FROM nb n LEFT JOIN pp q ON q.t = n.t AND q.channel = n.channel AND q.y = n.ny AND q.x = n.nx WHERE q.component IS DISTINCT FROM n.component""")
def component_boundaries(spark, d):
    """Boundaries of labels that are components."""
    pixels = sg.component_pixels(_components(spark, d, 4))
    return sg.label_boundaries(pixels, SIDE, SIDE, "component").select("t", "channel", "y", "x", F.col("component").alias("label"))


def _kept(spark, d):
    return sg.foreground(st.scanlines(spark, d), SIDE, MIN_SIZE)


def _kept_sql(src: str) -> str:
    """Runs co4 of the kept mask of the planes src: blurred unit rows above their threshold, islands of MIN_SIZE."""
    return f"""{_blur(src)}, {_otsu('bl')}, ab AS (SELECT bl.t, bl.channel, y, x FROM bl JOIN ot USING (t, channel) WHERE v > threshold), {_runs('ab')}, {_islands(0)},
co4 AS (SELECT * FROM co QUALIFY SUM(x1 - x0 + 1) OVER (PARTITION BY t, channel, component) >= {MIN_SIZE}), kp AS {_pixels('co4')}, {_runs('kp', '8')}, {_islands(1, '8')}"""


COUNTS = f"""WITH RECURSIVE {PX}, {NORM}, {MERGED}, ac AS (SELECT * FROM al WHERE channel <> 3), {_kept_sql('ac')},
cn AS (SELECT t, channel, COUNT(DISTINCT component) n FROM co8 GROUP BY 1, 2),
cc AS (SELECT f.t, CAST(COALESCE(SUM(n) FILTER (channel = 0), 0) AS BIGINT) taggfp, CAST(COALESCE(SUM(n) FILTER (channel = 1), 0) AS BIGINT) mkate, CAST(COALESCE(SUM(n) FILTER (channel = 2), 0) AS BIGINT) cy5, CAST(COALESCE(SUM(n) FILTER (channel = 4), 0) AS BIGINT) total FROM (SELECT DISTINCT t FROM s) f LEFT JOIN cn USING (t) GROUP BY 1) """


@query(COUNTS + "SELECT 'S' AS sample, 1 AS replicate, t, taggfp, mkate, cy5, total FROM cc")
def channel_counts(spark, d):
    lines = im.normalize_frame(st.scanlines(spark, d), st.CHANNELS).where("channel <> 3")
    return sg.channel_counts(lines, SIDE, MIN_SIZE)


@query(COUNTS + "SELECT '(' || taggfp || ', ' || mkate || ', ' || cy5 || ', ' || total || ')' AS line FROM cc")
def write_counts(spark, d):
    path = new_path(spark, "counts")
    files.write_counts(channel_counts(spark, d), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(MASK + _islands(0) + " SELECT t, channel, y, x0, x1, 'S_1_mask_t' || t AS stem FROM co QUALIFY SUM(x1 - x0 + 1) OVER (PARTITION BY t, channel, component) >= 5")
def write_masks(spark, d):
    path = new_path(spark, "masks")
    files.write_masks(sg.remove_small_objects(_components(spark, d, 4), 5), path)
    return spark.read.parquet(path).select("t", "channel", "y", "x0", "x1", "stem")


@query(MASK + _islands(0) + ", kp AS (SELECT t, channel, component, SUM(x1 - x0 + 1) n FROM co GROUP BY 1, 2, 3 HAVING SUM(x1 - x0 + 1) >= 5), mk AS (SELECT co.t, co.channel, y, SUM(x1 - x0 + 1) n FROM co JOIN kp USING (t, channel, component) GROUP BY 1, 2, 3), sm AS (SELECT t, channel, y, CAST(SUM(v) AS BIGINT) total FROM px GROUP BY 1, 2, 3) SELECT t, channel, y, CAST(COALESCE(n, 0) AS BIGINT) mask_pixels, total, 'S_1_t' || t AS stem FROM sm LEFT JOIN mk USING (t, channel, y)")
def write_mask_planes(spark, d):
    """Masks and their planes as whole numbers, written line by line and read back."""
    path = new_path(spark, "mask-planes")
    files.write_mask_planes(sg.remove_small_objects(_components(spark, d, 4), 5), st.scanlines(spark, d), path)
    whole = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)
    return spark.read.parquet(path).select("t", "channel", "y", whole("mask").alias("mask_pixels"), whole("plane").alias("total"), "stem")


@query()
def segment(spark, d):
    return sg.flooded(_kept(spark, d), SIDE, SIDE)


PEAKS = f"""WITH RECURSIVE {PX}, {_kept_sql('px')},
bg AS (SELECT t, channel, y, x FROM px ANTI JOIN kp USING (t, channel, y, x)),
dt AS (SELECT a.t, a.channel, a.y, a.x, MIN((a.y - b.y)*(a.y - b.y) + (a.x - b.x)*(a.x - b.x)) d2 FROM kp a JOIN bg b ON a.t = b.t AND a.channel = b.channel GROUP BY 1, 2, 3, 4),
pk AS (SELECT a.t, a.channel, a.y, a.x, a.d2 FROM dt a JOIN dt b ON a.t = b.t AND a.channel = b.channel AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 WHERE a.y BETWEEN 1 AND {SIDE - 2} AND a.x BETWEEN 1 AND {SIDE - 2} GROUP BY ALL HAVING MAX(b.d2) = a.d2)"""


@query(PEAKS + " SELECT t, channel, y, x, ROUND(SQRT(d2), 6) distance FROM pk")
def local_peaks(spark, d):
    return rounded(sg.local_peaks(segment(spark, d)).drop("sample", "replicate"), "distance")


@query(PEAKS + f""", {_runs('pk', 'p')}, {_islands(1, 'p')}, p8 AS {_pixels('co8')}, pi AS {_pixels('cop')}
SELECT t, channel, CAST(p8.component AS BIGINT) component, y, x, DENSE_RANK() OVER (PARTITION BY t, channel, p8.component ORDER BY pi.component) AS marker FROM pi JOIN p8 USING (t, channel, y, x)""")
def label_markers(spark, d):
    return sg.label_markers(segment(spark, d)).drop("sample", "replicate")


@query()
def watershed(spark, d):
    """The labels of the watershed, a row a pixel."""
    return segment(spark, d).select("t", "channel", "y", "x", "component", "label")


@query()
def labels(spark, d):
    return sg.labels(segment(spark, d)).drop("sample", "replicate")


@query()
def watershed_count(spark, d):
    return sg.watershed_count(segment(spark, d))


@query()
def label_boundaries(spark, d):
    return sg.label_boundaries(segment(spark, d), SIDE, SIDE).select("t", "channel", "y", "x", "label")


@query()
def solidity(spark, d):
    return rounded(sg.solidity(_kept(spark, d)), "solidity")


@query("SELECT event_id % 16 AS scene, c.condition, COUNT(*) n FROM events JOIN (VALUES (1,'control'),(7,'control'),(13,'control'),(2,'PRRX1'),(3,'PRRX1'),(14,'MYOD1'),(15,'MYOD1'),(8,'both'),(9,'both'),(11,'both')) c(scene, condition) ON event_id % 16 = c.scene GROUP BY 1, 2")
def tag_condition(spark, d):
    scenes = spark.createDataFrame(st.SCENES, "scene long, condition string")
    rows = st.table(spark, d, "events").withColumn("scene", F.col("event_id") % 16)
    return rows.join(F.broadcast(scenes), "scene").groupBy("scene", "condition").agg(F.count("*").alias("n"))


OBJ = "ob AS (SELECT event_type movie, CAST(EXTRACT(day FROM ts) AS INT) t, CAST(event_id AS BIGINT) id, value*4.0 x, CAST(json_extract_string(props, '$.k') AS DOUBLE)*12 y, CAST(50 + event_id % 100 AS BIGINT) area FROM events)"
CAND = f"{OBJ}, ca AS (SELECT a.movie, a.t, a.id a, b.id b, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) d2 FROM ob a JOIN ob b ON a.movie = b.movie AND b.t = a.t + 1 WHERE (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 2500)"
MUTUAL = f"{CAND}, mu AS (SELECT * FROM ca QUALIFY ROW_NUMBER() OVER (PARTITION BY movie, t, a ORDER BY d2, b) = 1 AND ROW_NUMBER() OVER (PARTITION BY movie, t, b ORDER BY d2, a) = 1)"


@query(f"WITH {OBJ} SELECT movie, t, id AS \"ID\", ROUND(x, 6) x, ROUND(y, 6) y, area, ROUND(LEAST(x, 1600 - x, y, 1200 - y), 6) dist_to_border FROM ob WHERE x >= 0 AND x < 1600 AND y >= 0 AND y < 1200")
def within_volume(spark, d):
    return rounded(tr.within_volume(st.objects(spark, d)), "x", "y", "dist_to_border")


@query(f"WITH {CAND} SELECT movie, t, a, b, ROUND(d2, 4) d2 FROM ca")
def link_candidates(spark, d):
    return tr.link_candidates(st.objects(spark, d), digits=4)


@query(f"WITH {MUTUAL} SELECT movie, t, a, b FROM mu")
def link_mutual(spark, d):
    return tr.link_mutual(tr.nearest_candidates(st.objects(spark, d))).drop("d2")


CHAINS = f"""WITH RECURSIVE {MUTUAL}, ch(movie, t, id, rt, ri) AS (SELECT o.movie, o.t, o.id, o.t, o.id FROM ob o WHERE NOT EXISTS (SELECT 1 FROM mu WHERE mu.movie = o.movie AND mu.t = o.t - 1 AND mu.b = o.id)
UNION ALL SELECT ch.movie, ch.t + 1, mu.b, rt, ri FROM ch JOIN mu ON mu.movie = ch.movie AND mu.t = ch.t AND mu.a = ch.id),
tk AS (SELECT movie, t, id, LPAD(CAST(rt AS VARCHAR), 6, '0') || ':' || CAST(ri AS VARCHAR) track_id FROM ch)"""


@query(CHAINS + """ SELECT movie, t, id AS "ID", track_id FROM tk""")
def assign_track_ids(spark, d):
    return _tracks(spark, d)[1]


def _tracks(spark, d):
    objects = st.objects(spark, d)
    return objects, tr.assign_track_ids(objects, tr.link_mutual(tr.nearest_candidates(objects)))


def _stored_tracks(spark, d):
    """tracks_long() as a table, for what reads it more than once."""
    return cut(tr.tracks_long(*_tracks(spark, d)), "tracks")


@query()
def link_optimal(spark, d):
    return rounded(tr.link_optimal_objects(st.objects(spark, d)), "d2")


@query(CHAINS + " SELECT movie, track_id, t, ROUND(x, 6) x, ROUND(y, 6) y, area FROM tk JOIN ob USING (movie, t, id)")
def tracks_long(spark, d):
    return rounded(tr.tracks_long(*_tracks(spark, d)), "x", "y")


@query()
def track_bayes(spark, d):
    return rounded(tr.track_bayes(st.objects(spark, d)), "probability")


@query()
def track_regions(spark, d):
    """Tracks of the regions of the kept masks, told by their place and all five features."""
    kept = _kept(spark, d)
    objects = tr.featured(tr.objects_from_regions(sg.region_props(kept)), sg.shape_features(kept), sg.solidity(kept))
    return rounded(tr.track_bayes(objects), "probability")


#: Hypotheses of tracks that follow on others, as the operator's grid join finds them.
STITCH = CHAINS + """, en AS (SELECT movie, track_id, MIN(t) t0, MAX(t) t1, ARG_MIN(x, t) x0, ARG_MIN(y, t) y0, ARG_MAX(x, t) x1, ARG_MAX(y, t) y1 FROM tk JOIN ob USING (movie, t, id) GROUP BY 1, 2),
hy AS (SELECT c.movie, c.track_id, p.track_id AS parent, POWER(p.x1 - c.x0, 2) + POWER(p.y1 - c.y0, 2) d2 FROM en c JOIN en p ON c.movie = p.movie AND c.t0 - p.t1 BETWEEN 1 AND 3 AND POWER(p.x1 - c.x0, 2) + POWER(p.y1 - c.y0, 2) <= 2500)"""


@query(STITCH + " SELECT movie, track_id, parent, ROUND(d2, 4) d2 FROM hy")
def stitch_candidates(spark, d):
    return rounded(tr.stitch_candidates(tr.tracks_long(*_tracks(spark, d))), "d2", digits=4)


@query()
def stitch_hypotheses(spark, d):
    return rounded(tr.stitch(_stored_tracks(spark, d)), "d2", digits=4)


def _lineage(spark, d):
    tracks = _stored_tracks(spark, d)
    return tracks, tr.lineage(tracks, tr.stitch(tracks).select("movie", "track_id", "parent"))


@query()
def lineage(spark, d):
    return _lineage(spark, d)[1]


#: The costs of starts, ends and families of tracks.
FAMILIES = CHAINS + """, fr AS (SELECT movie, MIN(t) f, MAX(t) l FROM ob GROUP BY 1),
en AS (SELECT movie, track_id, MIN(t) t0, MAX(t) t1, ARG_MIN(x, t) x0, ARG_MIN(y, t) y0, ARG_MAX(x, t) x1, ARG_MAX(y, t) y1, ARG_MIN(area, t) a0, ARG_MAX(area, t) a1 FROM tk JOIN ob USING (movie, t, id) GROUP BY 1, 2),
ec AS (SELECT en.*, f, l, 1 + GREATEST(LEAST(x0, 1600 - x0, y0, 1200 - y0), 0)/10 b0, 1 + GREATEST(LEAST(x1, 1600 - x1, y1, 1200 - y1), 0)/10 b1 FROM en JOIN fr USING (movie)),
ed AS (SELECT *, CASE WHEN t0 = f THEN 0 WHEN b0 < 8 THEN b0 ELSE 8 END s, CASE WHEN t1 = l THEN 0 WHEN b1 < 8 THEN b1 ELSE 8 END e FROM ec),
fm AS (SELECT c.movie, c.track_id, p.track_id AS parent, c.t0 - p.t1 g, POWER(p.x1 - c.x0, 2) + POWER(p.y1 - c.y0, 2) d2, LN(c.a0/p.a1) z, c.s, p.e FROM ed c JOIN ed p ON c.movie = p.movie AND c.t0 - p.t1 BETWEEN 1 AND 3 AND POWER(p.x1 - c.x0, 2) + POWER(p.y1 - c.y0, 2) <= 2500)"""


@query(FAMILIES + " SELECT movie, track_id, t0, t1, CASE WHEN t0 <> f AND b0 < 8 THEN 'border' ELSE 'start' END start_kind, ROUND(s, 6) AS start, CASE WHEN t1 <> l AND b1 < 8 THEN 'border' ELSE 'end' END end_kind, ROUND(e, 6) AS \"end\" FROM ed")
def track_ends(spark, d):
    return rounded(tr.track_ends(_stored_tracks(spark, d)), "start", "end").select("movie", "track_id", "t0", "t1", "start_kind", "start", "end_kind", "end")


@query(FAMILIES + " SELECT movie, track_id, parent, ROUND(d2/(200*g) + 2*(g - 1) + POWER(GREATEST(z, -LN(2) - z, 0)/0.3, 2)/2, 4) AS cost FROM fm")
def family_costs(spark, d):
    return rounded(tr.family_costs(tr.track_ends(_stored_tracks(spark, d))), "cost", digits=4).select("movie", "track_id", "parent", "cost")


@query()
def optimise_hypotheses(spark, d):
    return rounded(tr.optimise(_stored_tracks(spark, d)), "cost")


@query()
def lineage_optimised(spark, d):
    """Lineage by the best set of hypotheses of starts, ends, losses, links and divisions."""
    tracks = _stored_tracks(spark, d)
    return tr.lineage(tracks, tr.optimise(tracks).where("parent is not null").select("movie", "track_id", "parent"))


#: Of each track the nearest hypothesis, ties to the smaller name, and the chain above it.
NEAREST = STITCH + """, np AS (SELECT * FROM hy QUALIFY ROW_NUMBER() OVER (PARTITION BY movie, track_id ORDER BY ROUND(d2, 6), parent) = 1),
up(movie, track_id, root) AS (SELECT e.movie, e.track_id, e.track_id FROM en e ANTI JOIN np USING (movie, track_id) UNION ALL SELECT np.movie, np.track_id, up.root FROM up JOIN np ON np.movie = up.movie AND np.parent = up.track_id)"""


@query(NEAREST + " SELECT up.movie, up.track_id, COALESCE(np.parent, up.track_id) parent, root FROM up LEFT JOIN np USING (movie, track_id)")
def lineage_nearest(spark, d):
    """Lineage where every track follows on the nearest one that it can."""
    tracks = _stored_tracks(spark, d)
    return tr.lineage(tracks, tr.stitch_nearest(tracks))


@query()
def write_tracks(spark, d):
    path = new_path(spark, "tracks")
    files.write_tracks(*_lineage(spark, d), path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


ACGT = "TRANSLATE(md5(CAST({} AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
READS = f"""sq AS (SELECT l_linenumber, CAST(l_partkey % 20 AS INT) gene, SUBSTR({ACGT.format('o_custkey')}, 1, 16) || SUBSTR({ACGT.format('l_suppkey % 10')}, 1, 12) || {ACGT.format('l_partkey % 20')} s0 FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
rd AS (SELECT CASE WHEN l_linenumber = 7 THEN 'N' || SUBSTR(s0, 2) ELSE s0 END seq, gene FROM sq),
bc AS (SELECT SUBSTR(seq, 1, 16) barcode, SUBSTR(seq, 17, 12) umi, SUBSTR(seq, 29) insert_, gene FROM rd),
wl AS (SELECT SUBSTR({ACGT.format('c_custkey')}, 1, 16) barcode, c_mktsegment segment FROM customer WHERE c_custkey % 10 <> 0),
ok AS (SELECT * FROM bc WHERE barcode IN (SELECT barcode FROM wl)),
cm AS (SELECT barcode cell, gene, COUNT(DISTINCT umi) n FROM ok GROUP BY 1, 2)"""


def _reads(spark, d):
    return ex.extract_barcodes(st.reads(spark, d))


def _matrix(spark, d):
    return ex.count_matrix(ex.filter_barcodes(_reads(spark, d), st.whitelist(spark, d)))


@query(f"WITH {READS} SELECT barcode, umi, COUNT(*) n, COUNT(DISTINCT insert_) inserts FROM bc GROUP BY 1, 2")
def extract_barcodes(spark, d):
    return _reads(spark, d).groupBy("barcode", "umi").agg(F.count("*").alias("n"), F.count_distinct("insert").alias("inserts"))


@query(f"WITH {READS} SELECT barcode, COUNT(*) n FROM ok GROUP BY 1")
def filter_barcodes(spark, d):
    return ex.filter_barcodes(_reads(spark, d), st.whitelist(spark, d)).groupBy("barcode").agg(F.count("*").alias("n"))


@query(f"""WITH {READS}, un AS (SELECT DISTINCT barcode FROM bc WHERE barcode NOT IN (SELECT barcode FROM wl)), hit AS (SELECT un.barcode, wl.barcode known FROM un JOIN (SELECT DISTINCT barcode FROM wl) wl ON hamming(un.barcode, wl.barcode) = 1)
SELECT barcode, MIN(known) corrected FROM hit GROUP BY 1 HAVING COUNT(*) = 1""")
def correct_barcodes(spark, d):
    return ex.correct_barcodes(_reads(spark, d), st.whitelist(spark, d))


@query(f"WITH {READS} SELECT cell, gene, n FROM cm")
def count_matrix(spark, d):
    return _matrix(spark, d)


@query(f"WITH {READS} SELECT cell, CAST(SUM(n) AS BIGINT) molecules FROM cm GROUP BY 1 ORDER BY molecules DESC, cell LIMIT 100")
def call_cells(spark, d):
    return ex.call_cells(_matrix(spark, d))


@query(f"WITH {READS} SELECT cell, COUNT(DISTINCT gene) n_genes FROM cm GROUP BY 1")
def genes_per_cell(spark, d):
    return ex.genes_per_cell(_matrix(spark, d))


COND = "CASE segment WHEN 'AUTOMOBILE' THEN 'MYOD1' WHEN 'BUILDING' THEN 'PRRX1' WHEN 'FURNITURE' THEN 'MYOD1+PRRX1' ELSE 'control' END"


@query(f"WITH {READS} SELECT SUBSTR(seq, 1, 16) barcode, COUNT(*) n, MIN(seq) first, MAX(seq) last, CAST(SUM(LENGTH(seq)) AS BIGINT) bases FROM rd GROUP BY 1")
def read_fastq(spark, d):
    """The reads, written as FASTQ files and read back."""
    path = new_path(spark, "fastq")
    reads = st.reads(spark, d)
    reads.select(F.concat_ws("\n", F.lit("@r x"), "seq", F.lit("+"), F.expr("repeat('@', length(seq))"))).write.text(path)
    right = F.when(F.length("seq") == F.length("qual"), F.length("seq"))
    return files.read_fastq(spark, [path]).groupBy(F.substring("seq", 1, 16).alias("barcode")).agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.sum(right).alias("bases"))


@query(f"WITH {READS} SELECT barcode, {COND} AS condition, COUNT(*) n FROM bc JOIN wl USING (barcode) GROUP BY 1, 2")
def tag_sample_barcode(spark, d):
    conditions = st.whitelist(spark, d).select("barcode", F.expr(COND).alias("condition"))
    return ex.tag_sample_barcode(_reads(spark, d), conditions).groupBy("barcode", "condition").agg(F.count("*").alias("n"))


def _stored_expression(spark, d):
    path = new_path(spark, "expression")
    files.write_expression(_matrix(spark, d), st.whitelist(spark, d).select(F.col("barcode").alias("cell"), F.expr(COND).alias("condition")), path)
    return files.read_expression(spark, path)


@query(f"WITH {READS} SELECT cell, gene, n FROM cm")
def read_expression(spark, d):
    return _stored_expression(spark, d)[0]


@query(f"WITH {READS}, cd AS (SELECT barcode cell, {COND} AS condition FROM wl) SELECT cell, gene, n, condition FROM cm LEFT JOIN cd USING (cell)")
def expression_with_cells(spark, d):
    return ex.with_cells(*_stored_expression(spark, d))


@query(f"WITH {READS}, cd AS (SELECT barcode cell, {COND} AS condition FROM wl) SELECT condition, COUNT(DISTINCT gene) n_genes FROM cm JOIN cd USING (cell) GROUP BY ROLLUP (condition)")
def genes_expressed(spark, d):
    conditions = st.whitelist(spark, d).select(F.col("barcode").alias("cell"), F.expr(COND).alias("condition"))
    return ex.genes_expressed(_matrix(spark, d), conditions)


@query(f"WITH {READS} SELECT cell, gene, ROUND(LN(1 + n*10000.0/SUM(n) OVER (PARTITION BY cell)), 6) AS value FROM cm")
def log_normalize(spark, d):
    return rounded(ex.log_normalize(_matrix(spark, d)), "value")


MARKERS = [(g, "G1") for g in range(3)] + [(g, "S") for g in range(3, 7)] + [(g, "G2M") for g in range(7, 11)]


@query(f"""WITH {READS}, ln AS (SELECT cell, gene, LN(1 + n*10000.0/SUM(n) OVER (PARTITION BY cell)) v FROM cm),
sc AS (SELECT cell, SUM(CASE WHEN gene BETWEEN 3 AND 6 THEN v ELSE 0 END) s, SUM(CASE WHEN gene BETWEEN 7 AND 10 THEN v ELSE 0 END) g, SUM(v) w FROM ln GROUP BY 1), s2 AS (SELECT cell, ROUND(s/4 - (w - s)/16, 9) s, ROUND(g/4 - (w - g)/16, 9) g FROM sc)
SELECT cell, ROUND(s, 6) s_score, ROUND(g, 6) g2m_score, CASE WHEN s < 0 AND g < 0 THEN 'G1' WHEN s >= g THEN 'S' ELSE 'G2M' END phase FROM s2""")
def cell_cycle_phase(spark, d):
    return rounded(ex.cell_cycle_phase(ex.log_normalize(_matrix(spark, d)), MARKERS, 20), "s_score", "g2m_score")


def _cells(spark, d):
    return st.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


KNN = """u AS (SELECT vec_id, generate_subscripts(embedding, 1) k, CAST(unnest(embedding) AS DOUBLE) v FROM embeddings), dd AS (SELECT a.vec_id id, b.vec_id neighbour, SUM((a.v - b.v)*(a.v - b.v)) d2 FROM u a JOIN u b ON a.k = b.k AND a.vec_id <> b.vec_id GROUP BY 1, 2),
kn AS (SELECT * FROM dd QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY d2, neighbour) <= 10)"""


@query(f"WITH {KNN} SELECT id, neighbour, ROUND(d2, 6) d2 FROM kn")
def knn_graph(spark, d):
    return rounded(ex.knn_graph(_cells(spark, d)), "d2")


@query(f"""WITH RECURSIVE {KNN}, eg AS (SELECT a, b, MIN(d) d FROM (SELECT id a, neighbour b, SQRT(d2) d FROM kn UNION ALL SELECT neighbour, id, SQRT(d2) FROM kn) GROUP BY 1, 2),
sp(id, dist) USING KEY (id) AS (SELECT CAST(0 AS BIGINT), CAST(0.0 AS DOUBLE) UNION SELECT eg.b, MIN(sp.dist + eg.d) FROM sp JOIN eg ON sp.id = eg.a LEFT JOIN recurring.sp o ON o.id = eg.b WHERE o.dist IS NULL OR sp.dist + eg.d < o.dist GROUP BY eg.b)
SELECT vec_id AS id, ROUND(dist / (SELECT MAX(dist) FROM sp), 6) pseudotime FROM embeddings LEFT JOIN sp ON sp.id = vec_id""")
def pseudotime(spark, d):
    cells = _cells(spark, d)
    return rounded(ex.pseudotime(ex.knn_graph(cells), 0, cells), "pseudotime")
