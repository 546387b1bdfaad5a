"""Objects of movies linked over time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels
from ..plans.lineage import cut, dropped, new_path, removed
from .graph import components


def objects_from_regions(regions: DataFrame) -> DataFrame:
    """Regions as objects, with the frame's real label as t."""
    movie = F.concat_ws("/", "sample", F.col("replicate").cast("string"), F.col("channel").cast("string"))
    return regions.select(movie.alias("movie"), F.col("component").alias("ID"), "t", F.col("centroid_0").alias("x"), F.col("centroid_1").alias("y"), F.lit(0.0).alias("z"), F.lit(1.0).alias("prob"), F.lit(0).alias("states"), "area")


def featured(objects: DataFrame, shapes: DataFrame, solid: DataFrame) -> DataFrame:
    """objects_from_regions() with the features of their regions, as segment.shape_features() and segment.solidity() give them.

    A region without one of them has null there."""
    movie = F.concat_ws("/", "sample", F.col("replicate").cast("string"), F.col("channel").cast("string"))
    named = lambda df, *c: df.select(movie.alias("movie"), F.col("component").alias("ID"), "t", *c)
    out = objects.join(named(shapes, "major_axis_length", "minor_axis_length", "orientation"), ["movie", "ID", "t"], "left")
    return out.join(named(solid, "solidity"), ["movie", "ID", "t"], "left")


def within_volume(objects: DataFrame, width: float = 1600, height: float = 1200) -> DataFrame:
    inside = objects.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))
    return inside.withColumn("dist_to_border", F.least("x", F.lit(width) - F.col("x"), "y", F.lit(height) - F.col("y")))


def link_places(objects: DataFrame, radius: float = 50.0, more: tuple[str, ...] = (), later: DataFrame | None = None) -> DataFrame:
    """(movie, t, a, b, d2): objects of t and t + 1 (of later, if given) within the radius, by a grid of its size: an equi-join on the cell.

    More may name two further columns, that of a and that of b. A later object has nine rows there, of which Spark's estimate
    knows nothing: neither side is broadcast."""
    cell = lambda c: F.floor(F.col(c) / radius)
    here = objects.select("movie", "t", F.col("ID").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), *more[:1], cell("x").alias("gx"), cell("y").alias("gy"))
    there = (objects if later is None else later).select("movie", (F.col("t") - 1).alias("t"), F.col("ID").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), *more[1:], cell("x").alias("gx"), cell("y").alias("gy"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    there = there.withColumn("d", around).select("movie", "t", "b", "bx", "by", *more[1:], (F.col("gx") + F.col("d.i")).alias("gx"), (F.col("gy") + F.col("d.j")).alias("gy"))
    x, y = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return here.join(there.hint("merge"), ["movie", "t", "gx", "gy"]).withColumn("d2", x * x + y * y).where(F.col("d2") <= radius * radius).select("movie", "t", "a", "b", "d2", *more)


def link_candidates(objects: DataFrame, radius: float = 50.0, digits: int | None = None, members: int = 1024) -> DataFrame:
    """link_places() of all objects, with d2 rounded if digits are given.

    What stands at one place later is one row of the join for each so many members: a distance to it is taken and rounded
    once, and the members are spelled out after the join."""
    number = F.row_number().over(Window.partitionBy("movie", "t", "x", "y").orderBy("ID")) - 1
    parts = objects.select("movie", "t", "x", "y", "ID", F.floor(number / members).alias("part"))
    # of structs, as a list of the bare IDs would lose null ones
    places = parts.groupBy("movie", "t", "x", "y", "part").agg(F.collect_list(F.struct("ID")).getField("ID").alias("ID"))
    pairs = link_places(objects, radius, later=places)
    d2 = F.col("d2") if digits is None else _rounded(F.col("d2"), digits)
    return pairs.withColumn("d2", d2).select("movie", "t", "a", F.explode("b").alias("b"), "d2")


def _rounded(v: Column, digits: int) -> Column:
    """F.round() of numbers from 0 to about 1e6, which writes out the decimals of those next to a tie only: the same values."""
    up = v * 10.0**digits + 0.5
    return F.when((up - F.floor(up)).between(1e-3, 1 - 1e-3), F.floor(up) / 10.0**digits).otherwise(F.round(v, digits))


def link_mutual(candidates: DataFrame) -> DataFrame:
    """Pairs that are each other's nearest; ties go to the smaller id."""
    first = lambda own, other: F.row_number().over(Window.partitionBy("movie", "t", own).orderBy("d2", other))
    return candidates.withColumns({"ra": first("a", "b"), "rb": first("b", "a")}).where("ra = 1 and rb = 1").drop("ra", "rb")


#: Tiles of so many radii to a side, and stretches of so many frames, are searched for neighbours in one group.
TILE, FRAMES = 8, 4


def _nearest(parents: DataFrame, children: DataFrame, gap: int, radius: float, slack: float = 0.0, both: bool = False) -> DataFrame:
    """(movie, pt, parent, t0, x0, y0, child, d2): of each child the parents up to gap frames before it, within the radius, at the least
    squared distance, or one larger by the slack at most; if both, of each parent the children too (then gap is 1).

    Either side holds movie, t, x, y and name. A tile of some frames is a group, with what lies around it within the radius: a point
    is sent to few tiles, and the pairs that are looked at follow from the density (kernels.nearest())."""
    if both and gap != 1:
        raise ValueError("children of parents are searched in the next frame alone")
    kind, side = dict(parents.dtypes)["name"], TILE * radius
    tile = lambda c, off=0.0: F.floor((F.col(c) + off) / side)
    around = lambda c: F.explode(F.sequence(tile(c, -1.0001 * radius), tile(c, 1.0001 * radius)))
    block = lambda off: F.floor((F.col("t") + off) / FRAMES)

    def dealt(points: DataFrame, child: bool, wide: bool, blocks: Column) -> DataFrame:
        # a place that is no number has no neighbours
        own = points.where("movie is not null and x - x = 0 and y - y = 0").select("movie", F.col("t").cast("int").alias("t"), *[F.col(c).cast("double").alias(c) for c in "xy"], "name", F.lit(child).alias("child"), blocks.alias("block"))
        own = own.withColumn("gx", around("x") if wide else tile("x")).withColumn("gy", around("y") if wide else tile("y"))
        return own.withColumn("own", (F.col("gx") == tile("x")) & (F.col("gy") == tile("y")))

    rows = dealt(parents, False, True, F.explode(F.sequence(block(1), block(gap)))).union(dealt(children, True, both, block(0)))

    def run(table: pa.Table) -> pa.Table:
        t, x, y, child, own = (table.column(c).to_numpy(zero_copy_only=False) for c in ("t", "x", "y", "child", "own"))
        out = []
        for now in np.unique(t[child]).tolist():
            to, from_ = np.flatnonzero(child & (t == now)), np.flatnonzero(~child & (t < now) & (t >= now - gap))
            mine = to[own[to]]
            i, j, d2 = kernels.nearest(x[mine], y[mine], x[from_], y[from_], radius, slack)
            out.append((from_[j], mine[i], d2))
            if both:
                mine = from_[own[from_]]
                i, j, d2 = kernels.nearest(x[mine], y[mine], x[to], y[to], radius, slack)
                out.append((mine[i], to[j], d2))
        p, c, d2 = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        of, to = table.take(pa.array(p)), table.take(pa.array(c))
        return pa.table([of.column("movie"), of.column("t"), of.column("name"), *(to.column(k) for k in ("t", "x", "y", "name")), pa.array(d2)], ["movie", "pt", "parent", "t0", "x0", "y0", "child", "d2"])

    return rows.groupBy("movie", "block", "gx", "gy").applyInArrow(run, f"movie string, pt int, parent {kind}, t0 int, x0 double, y0 double, child {kind}, d2 double")


def nearest_candidates(objects: DataFrame, radius: float = 50.0) -> DataFrame:
    """Of link_candidates() those that link_mutual() may take: of each object the nearest ones, and only the least id of each place.

    What stands at one place has the same distances, so that its least id is what is linked."""
    places = objects.groupBy("movie", "t", "x", "y").agg(F.min("ID").alias("name"))
    return _nearest(places, places, 1, radius, both=True).select("movie", F.col("pt").alias("t"), F.col("parent").alias("a"), F.col("child").alias("b"), "d2")


def _island_of(nodes: DataFrame, a: list[str], b: list[str], kinds: tuple[int, int] = (0, 1)) -> DataFrame:
    """nodes (pairs of two kinds of things, or of one, named by the columns a and b) with their island: what is tied by pairs, the least of it."""
    name = lambda kind, cs: F.struct(F.lit(kind).alias("kind"), *[F.col(c).alias(f"k{n}") for n, c in enumerate(cs)])
    named = nodes.withColumns({"_a": name(kinds[0], a), "_b": name(kinds[1], b)})
    found = components(named.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    return named.join(found.select(F.col("node").alias("_a"), F.col("component").alias("island")).hint("merge"), "_a").drop("_a", "_b")


def _best(a: np.ndarray, b: np.ndarray, cost: np.ndarray, alone: float, slots: tuple[float, ...] = (0.0,)) -> list[int]:
    """The pairs (by number) of least total cost. Each a has one b at most, or none at the cost alone; a b has as many a's as
    there are slots, each at an additional cost."""
    x, at_a = np.unique(a, return_inverse=True)
    y, at_b = np.unique(b, return_inverse=True)
    n = len(a)
    used = kernels.sparse_assignment(np.tile(at_a, len(slots)), np.concatenate([at_b + k * len(y) for k in range(len(slots))]), np.concatenate([cost + more for more in slots]), np.full(len(x), alone))
    return [int(e) % n for e in used if e >= 0]


def _equals(things: DataFrame, key: list[str], name: str) -> DataFrame:
    """things with their class, the least name of those with an equal key, their number in it from 0 on, and its size n."""
    own = Window.partitionBy(*key)
    return things.withColumns({"class": F.min(name).over(own), "number": F.row_number().over(own.orderBy(name)) - 1, "n": F.count("*").over(own)})


def _tied(children: DataFrame, parents: DataFrame, gap: int, radius: float) -> tuple[DataFrame, DataFrame]:
    """children and parents (movie, t, x, y and more) with their island: what pairs of a child and a parent up to gap frames before it, within the
    radius, may tie, and more than these: cells of two radii are tied to those around them, so that no pair is made for it.

    Children that no parent is near are left out, and parents without children."""
    key = ["movie", "t", "gx", "gy"]
    cell = lambda df: df.where("movie is not null and x - x = 0 and y - y = 0").withColumns({f"g{c}": F.floor(F.col(c) / (2 * radius)) for c in "xy"})
    children, parents = cell(children), cell(parents)
    around = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.lit(i).alias("i"), F.lit(j).alias("j")) for g in range(1, gap + 1) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    from_ = parents.select(*key).distinct().withColumn("parent", F.struct(F.lit(0).alias("kind"), *key))
    to = children.select(*key).distinct().withColumn("child", F.struct(F.lit(1).alias("kind"), *key)).withColumn("d", around)
    to = to.select("movie", (F.col("t") - F.col("d.g")).alias("t"), (F.col("gx") + F.col("d.i")).alias("gx"), (F.col("gy") + F.col("d.j")).alias("gy"), "child")
    found = components(cut(from_.join(to, key).select(F.col("parent").alias("a"), F.col("child").alias("b")), "cells"))
    found = cut(found.select("node.*", F.xxhash64("component").alias("island")), "islands")
    # columns of their own, as both may come from one table
    own = lambda df, kind: (out := df.join(found.where(F.col("kind") == kind).drop("kind").hint("merge"), key).drop("gx", "gy")).toDF(*out.columns)
    return own(children, 1), own(parents, 0)


def _assigned(children: DataFrame, parents: DataFrame, gap: int, radius: float, adds: Column, cost=None) -> DataFrame:
    """(movie, a, a_number, b, b_number, k): the assignment of least total cost of the classes of children to those of parents up to gap
    frames before, within the radius, member by member.

    children hold movie, t, x, y, their class a of na members, size, and alone, what a member without parent costs; parents b and nb likewise. A member of b has a
    place for each of adds (an array of numbers, of the parents' columns), at that much more than the pair's cost, which grows from place to place; k is the place. A pair costs its squared
    distance, or what the pair of functions cost says: what a pair costs by squared distance, frames between and the sizes of child and parent, and how far off one of less than a cost may be.

    What pairs may tie is an island; an island is a group, and solved by itself. Its task holds the places and few pairs of each (kernels.transport_in_reach())."""
    costs, within = cost or (lambda d2, steps, child, parent: d2, lambda bound, steps: bound)
    kind = dict(parents.dtypes)["b"]

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        (t, x, y, size), (pt, px, py, psize) = ([table.column(c).to_numpy().astype(float) for c in ("t", "x", "y", "size")] for table in (one, two))
        more = two.column("adds").combine_chunks().flatten().to_numpy().reshape(len(two), -1)
        mine, theirs = ({v: np.flatnonzero(times == v) for v in np.unique(times).tolist()} for times in (t, pt))

        def near(pays, least):
            for now, i in mine.items():
                for steps in range(1, gap + 1):
                    j = theirs.get(now - steps)
                    if j is None:
                        continue
                    if pays is None:
                        chunks = [kernels.few_nearest(x[i], y[i], px[j], py[j], radius, 2 + 8 // gap)]
                    else:
                        bound = np.clip(within(pays[i] - least[j].min(), steps) * (1 + 1e-9), 0, radius * radius)
                        reach = np.where(bound < radius * radius, np.sqrt(bound), radius)
                        chunks = kernels.pairs_in_reach(x[i], y[i], reach, px[j], py[j])
                    for p, q, d2 in chunks:
                        p, q = i[p], j[q]
                        c = costs(d2, steps, size[p], psize[q])
                        some = slice(None) if pays is None else c + least[q] < pays[p]
                        yield p[some], q[some], c[some]

        found = kernels.transport_in_reach(near, one.column("alone").to_numpy().astype(float), *(table.column(n).to_numpy() for table, n in ((one, "na"), (two, "nb"))), more)
        i, j, k, amount = np.array(found, np.int64).reshape(-1, 4).T
        a_from, b_from = _before(i, amount), _before(j * more.shape[1] + k, amount)
        some = [one.take(pa.array(i)).column(c) for c in ("movie", "a")] + [two.take(pa.array(j)).column("b")]
        return pa.table([*some, *(pa.array(v.astype(np.int32)) for v in (a_from, b_from, amount, k))], ["movie", "a", "b", "a_from", "b_from", "amount", "k"])

    one, two = _tied(children.select("movie", "t", "x", "y", "a", "na", "size", "alone"), parents.select("movie", "t", "x", "y", "b", "nb", "size", adds.cast("array<double>").alias("adds")), gap, radius)
    found = one.groupBy("movie", "island").cogroup(two.groupBy("movie", "island")).applyInArrow(run, f"movie string, a {kind}, b {kind}, a_from int, b_from int, amount int, k int")
    each = found.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("amount") - 1)))
    return each.select("movie", "a", (F.col("a_from") + F.col("i")).alias("a_number"), "b", (F.col("b_from") + F.col("i")).alias("b_number"), "k")


def link_optimal_objects(objects: DataFrame, radius: float = 50.0) -> DataFrame:
    """link_optimal() of the objects' candidates, where what stands at one place is one row of the assignment: the same cost."""
    known = cut(_equals(objects.select("movie", "t", "ID", "x", "y"), ["movie", "t", "x", "y"], "ID"), "places")
    places = known.where("number = 0").withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double"), "size": F.lit(0.0), "alone": F.lit(radius * radius)})
    # a link saves the same from either side
    found = cut(_assigned(places.withColumnsRenamed({"ID": "a", "n": "na"}), places.withColumnsRenamed({"ID": "b", "n": "nb"}), 1, radius, F.array(F.lit(0.0))), "found")
    member = lambda c: known.select("movie", F.col("class").alias(c), F.col("number").alias(f"{c}_number"), F.col("t").alias(f"t{c}"), F.col("ID").alias(f"{c}_id"), F.col("x").alias(f"x{c}"), F.col("y").alias(f"y{c}")).hint("merge")
    x, y = F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")
    out = found.join(member("a"), ["movie", "a", "a_number"]).join(member("b"), ["movie", "b", "b_number"])
    return out.select("movie", F.col("tb").alias("t"), F.col("b_id").alias("a"), F.col("a_id").alias("b"), (x * x + y * y).alias("d2"))


def link_optimal(candidates: DataFrame, radius: float = 50.0) -> DataFrame:
    """Links of least total squared distance, where leaving an object unlinked costs the squared radius.

    Candidates of two frames fall into islands that share no object; an island is a group, and solved by itself."""

    def run(table: pa.Table) -> pa.Table:
        a, b, d2 = (table.column(c).to_numpy() for c in ("a", "b", "d2"))
        return table.take(pa.array(_best(a, b, d2, radius * radius), pa.int64())).select(["movie", "t", "a", "b", "d2"])

    islands = _island_of(candidates, ["movie", "t", "a"], ["movie", "t", "b"])
    return islands.groupBy("movie", "t", "island").applyInArrow(run, "movie string, t int, a long, b long, d2 double")


def track_key(t, i):
    """The name of a track whose first object is i at t; in order of t."""
    return F.concat_ws(":", F.lpad(t.cast("string"), 6, "0"), i.cast("string"))


def assign_track_ids(objects: DataFrame, links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(movie, t, ID, track_id): the track is its first object's (t, ID), found by pointer doubling over
    the links, in as many rounds as the number of frames has bits; each round is a table."""
    key = track_key
    now = links.select("movie", key(F.col("t") + 1, F.col("b")).alias("k"), key(F.col("t"), F.col("a")).alias("p"))
    if rounds is None:
        first, last = objects.agg(F.min("t"), F.max("t")).first()
        rounds = max(1, ((last or 0) - (first or 0)).bit_length())
    before = None
    for _ in range(rounds):
        now = cut(now)
        if before is not None:
            dropped(before)
        before = now
        up = now.select("movie", F.col("k").alias("p"), F.col("p").alias("pp"))
        now = now.join(up.hint("merge"), ["movie", "p"], "left").select("movie", "k", F.coalesce("pp", "p").alias("p"))
    own = objects.select("movie", "t", "ID", key(F.col("t"), F.col("ID")).alias("k"))
    return own.join(now.hint("merge"), ["movie", "k"], "left").select("movie", "t", "ID", F.coalesce("p", "k").alias("track_id"))


def tracks_long(objects: DataFrame, ids: DataFrame) -> DataFrame:
    return objects.join(ids.hint("merge"), ["movie", "t", "ID"]).select("movie", "track_id", "t", "x", "y", "area")


#: Features of an object that a track is told by, beside its place.
FEATURES = ("area", "major_axis_length", "minor_axis_length", "orientation", "solidity")
#: Standard deviations of the features before a track has shown its own: of the logarithms of area and axes, of the parts
#: of the orientation, and of the solidity.
LOG_SIZE, TURN, SOLID = 0.2, 0.3, 0.1
#: So many objects the deviations above count for in a track's own covariance.
PRIOR = 4.0
#: Variances of a track's first state, of a frame's motion, and of a place.
SPREAD, MOTION, PLACE = 100.0, 25.0, 9.0
#: The likelihood of no object, as that of one so many standard deviations away in motion and one feature; a further feature adds one variance.
LOST = 3.0
STEP = np.array([[1, 0, 1, 0], [0, 1, 0, 1], [0, 0, 1, 0], [0, 0, 0, 1]], float)
SEEN = np.eye(2, 4)


def feature_vector(objects: DataFrame, features: tuple[str, ...] = FEATURES):
    """Of the features that objects have, an array of numbers, each divided by its standard deviation, and its length.

    An orientation is an angle that half a turn does not change, and says the more the longer an object is: it becomes the
    cosine and sine of twice the angle, times one less the ratio of the axes. A null feature counts as 0."""
    has = [f for f in features if f in objects.columns]
    size = lambda c: F.log(F.greatest(F.col(c).cast("double"), F.lit(1.0))) / LOG_SIZE
    out = [size(c) for c in has if c not in ("orientation", "solidity")]
    if "orientation" in has:
        axes = {"major_axis_length", "minor_axis_length"} <= set(has)
        long_ = 1 - F.coalesce(F.try_divide("minor_axis_length", "major_axis_length"), F.lit(1.0)) if axes else F.lit(1.0)
        out += [f(2 * F.col("orientation")) * long_ / TURN for f in (F.cos, F.sin)]
    if "solidity" in has:
        out.append(F.col("solidity") / SOLID)
    return F.transform(F.array(*out) if out else F.array().cast("array<double>"), lambda v: F.coalesce(v, F.lit(0.0))), len(out)


def predicted(state: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Constant-velocity states (x, y and their speeds) and their covariances one frame on."""
    return state @ STEP.T, STEP @ spread @ STEP.T + np.diag([MOTION / 4, MOTION / 4, MOTION, MOTION])


def updated(state: np.ndarray, spread: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Predicted states and covariances after objects at places."""
    gain = spread @ SEEN.T @ np.linalg.inv(SEEN @ spread @ SEEN.T + PLACE * np.eye(2))
    return state + np.einsum("nij,nj->ni", gain, place - state @ SEEN.T), (np.eye(4) - gain @ SEEN) @ spread


def looks_updated(n: np.ndarray, mean: np.ndarray, scatter: np.ndarray, looks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running means and sums of squares of feature vectors of n objects so far, after one more."""
    off = looks - mean
    after = mean + off / (n + 1)[:, None]
    return after, scatter + off[:, :, None] * (looks - after)[:, None, :]


def pair_logs(state: np.ndarray, spread: np.ndarray, n: np.ndarray, mean: np.ndarray, scatter: np.ndarray, place: np.ndarray, looks: np.ndarray) -> np.ndarray:
    """Log-likelihoods of objects as the next ones of predicted tracks, row by row: motion and appearance, without the constants of a track.

    The covariance of a track's features is its own as far as it has shown it, and that of PRIOR objects of unit variance."""
    off = place - state @ SEEN.T
    motion = np.einsum("ni,nij,nj->n", off, np.linalg.inv(SEEN @ spread @ SEEN.T + PLACE * np.eye(2)), off)
    k = looks.shape[1]
    if not k:
        return -0.5 * motion
    own = (scatter + PRIOR * np.eye(k)) / (PRIOR + n - 1)[:, None, None]
    off = looks - mean
    return -0.5 * (motion + np.einsum("ni,nij,nj->n", off, np.linalg.inv(own), off))


def none_log(features: int) -> float:
    """Log-likelihood of no object."""
    return -0.5 * (LOST**2 + max(features - 1, 0))


#: Equal tracks that went on with equal objects: their places among these (from_ on, amount of them), where they began (likewise, root_from on),
#: and their state, which only a stretch's last frame gives.
STATE = "movie string, t int, ID long, from_ int, amount int, probability double, root_t int, root long, root_from int, state array<double>, spread array<double>, n int, mean array<double>, scatter array<double>"
#: Pairs of a frame and the next that are weighed at once, and those of a stretch of frames that is tracked in one job.
AT_ONCE, STRETCH = 1 << 15, 1 << 18


def _values(table: pa.Table, shapes: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """Columns of lists as arrays."""
    return {c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(table), *d) for c, d in shapes.items()}


def _tracked(pairs: pa.Table, before: pa.Table, last: int, k: int) -> pa.Table:
    """Rows of STATE of the objects of one island of a stretch that go on with a track, frame after frame. pairs are those within reach, of classes of
    equal objects; before are the tracks that went on into the stretch's first frame. Rows of the frame last have a state."""
    shape = {"state": (4,), "spread": (4, 4), "mean": (k,), "scatter": (k, k)}
    whole = ("ID", "from_", "amount", "root_t", "root", "root_from", "n")
    pairs = pairs.sort_by([("t", "ascending"), ("a", "ascending"), ("b", "ascending")])
    frame, out = pairs.column("t").to_numpy(), []
    now, at = {c: before.column(c).to_numpy() for c in whole} | _values(before, shape), frame[0] if len(pairs) else 0
    for t in np.unique(frame).tolist():
        own = pairs.slice(*(lambda a, b: (a, b - a))(*np.searchsorted(frame, [t, t + 1])))
        if t != at:  # no frame between
            now = {c: v[:0] for c, v in now.items()}
        a, first, pairs_of = np.unique(own.column("a").to_numpy(), return_index=True, return_counts=True)
        b, b_first, at_b = np.unique(own.column("b").to_numpy(), return_index=True, return_inverse=True)
        value = _values(own, {"first": (4,), "first_looks": (k,), "place": (2,), "looks": (k,)})
        na, nb = own.column("na").to_numpy()[first], own.column("nb").to_numpy()[b_first]
        # tracks that begin here are the members of a class that no track went on into
        known = np.isin(now["ID"], a)
        now = {c: v[known] for c, v in now.items()}
        taken = np.zeros(len(a), np.int64)
        np.add.at(taken, np.searchsorted(a, now["ID"]), now["amount"])
        fresh = np.flatnonzero(taken < na)
        m = len(fresh)
        new = {"ID": a[fresh], "from_": taken[fresh], "amount": na[fresh] - taken[fresh], "root_t": np.full(m, t), "root": a[fresh], "root_from": taken[fresh], "n": np.ones(m, int)}
        new |= {"state": value["first"][first[fresh]], "spread": np.tile(SPREAD * np.eye(4), (m, 1, 1)), "mean": value["first_looks"][first[fresh]], "scatter": np.zeros((m, k, k))}
        now = {c: np.concatenate([now[c], new[c]]) for c in new}
        order = np.lexsort((now["from_"], now["ID"]))
        now = {c: v[order] for c, v in now.items()}
        now["state"], now["spread"] = predicted(now["state"], now["spread"])
        # a row a track and pair
        of = np.searchsorted(a, now["ID"])
        n = pairs_of[of]
        track = np.repeat(np.arange(len(of)), n)
        row = np.repeat(first[of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        parts = [(track[i : i + AT_ONCE], row[i : i + AT_ONCE]) for i in range(0, len(row), AT_ONCE)]
        logs = np.concatenate([pair_logs(*(now[c][p] for c in ("state", "spread", "n", "mean", "scatter")), value["place"][q], value["looks"][q]) for p, q in parts])
        total = np.full(len(of), none_log(k))  # over all objects in reach and none
        np.logaddexp.at(total, track, logs + np.log(nb[at_b[row]]))
        logs, none = logs - total[track], none_log(k) - total
        found = kernels.transport(track, at_b[row], -logs, -none, now["amount"], nb)
        e, amount = np.array(found, np.int64).reshape(-1, 2).T
        won, to, row = track[e], at_b[row[e]], row[e]
        gone, come = (_before(c, amount) for c in (won, to))
        at, went = t + 1, {"ID": b[to], "from_": come, "amount": amount, "root_t": now["root_t"][won], "root": now["root"][won], "root_from": now["root_from"][won] + gone}
        mean, scatter = looks_updated(now["n"][won], now["mean"][won], now["scatter"][won], value["looks"][row])
        state, spread = updated(now["state"][won], now["spread"][won], value["place"][row])
        now = went | {"n": now["n"][won] + 1, "state": state, "spread": spread, "mean": mean, "scatter": scatter}
        out.append(_state_rows(own.column("movie").take(pa.array(row, pa.int64())), at, now, np.exp(logs[e]), t == last))
    return pa.concat_tables(out) if out else pa.table([pa.array([], f.type) for f in STATE_SCHEMA], schema=STATE_SCHEMA)


def _before(key: np.ndarray, amount: np.ndarray) -> np.ndarray:
    """The sum of the amounts of equal keys in the rows before."""
    order = np.argsort(key, kind="stable")
    sums = np.cumsum(amount[order]) - amount[order]
    out = np.empty_like(sums)
    out[order] = sums - sums[np.searchsorted(key[order], key[order])]
    return out


NUMBERS = pa.list_(pa.float64())
STATE_SCHEMA = pa.schema([("movie", pa.string()), ("t", pa.int32()), ("ID", pa.int64()), ("from_", pa.int32()), ("amount", pa.int32()), ("probability", pa.float64()), ("root_t", pa.int32()), ("root", pa.int64()), ("root_from", pa.int32()), ("state", NUMBERS), ("spread", NUMBERS), ("n", pa.int32()), ("mean", NUMBERS), ("scatter", NUMBERS)])


def _state_rows(movie: pa.ChunkedArray, t: int, tracks: dict[str, np.ndarray], probability: np.ndarray, states: bool) -> pa.Table:
    rows = tracks | {"t": np.full(len(movie), t), "probability": probability}
    lists = lambda v: pa.array(v.reshape(len(v), int(np.prod(v.shape[1:]))).tolist() if states else [None] * len(v), NUMBERS)
    return pa.table([movie.cast(f.type) if f.name == "movie" else lists(rows[f.name]) if f.type == NUMBERS else pa.array(rows[f.name].astype(f.type.to_pandas_dtype())) for f in STATE_SCHEMA], schema=STATE_SCHEMA)


def _reach(places: DataFrame, radius: float, stretch: int) -> DataFrame:
    """Pairs of places (movie, t, a, b) within the radius, with their stretch of frames and their island in it.

    A stretch ends with the frame that brings it to so many pairs or more. Within it objects that pairs tie over any number of its frames are an island."""
    pairs = cut(link_places(places, radius).drop("d2"), "pairs")
    frames = pairs.groupBy("t").agg(F.count("*").alias("n"))
    so_far = F.coalesce(F.sum("n").over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a frame
    dealt = pairs.join(F.broadcast(frames.select("t", F.floor(so_far / stretch).alias("stretch"))), "t").withColumn("next", F.col("t") + 1)
    return _island_of(dealt, ["movie", "stretch", "t", "a"], ["movie", "stretch", "next", "b"], (0, 0)).select("movie", "t", "a", "b", "stretch", "island")


def track_bayes(objects: DataFrame, radius: float = 50.0, features: tuple[str, ...] = FEATURES, stretch: int = STRETCH) -> DataFrame:
    """(movie, t, ID, track_id, probability): tracks by motion and appearance.

    Each track has a constant-velocity state with a covariance (a Kalman filter) and a running mean and covariance of its
    objects' features, those of features that objects have. The objects of a frame within the radius of a track's last
    object get a likelihood from the predicted place and from the features; these and that of no object become
    probabilities, and the frame is assigned so that their product is greatest. The first object of a track has
    probability 1; a track ends in the first frame in which it has no object. Ties go to the smaller id.

    Objects of a frame with one place and the same features are a class with members, as are the tracks that went the same way: a
    row of the assignment. Stretches of frames (see _reach()) come one after the other, a job each, all movies at once; an
    island of a stretch is a group, which goes frame by frame, from the states of the tracks that went on into the stretch. So neither
    few pairs in many frames nor many objects at one place make many jobs or pairs. To the driver comes a row a stretch."""
    spark = objects.sparkSession
    vector, k = feature_vector(objects, features)
    own = objects.select("movie", "t", "ID", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), vector.alias("looks"))
    known = cut(_equals(own, ["movie", "t", "x", "y", "looks"], "ID"), "objects")
    places = known.where("number = 0")
    before = places.select("movie", "t", F.col("ID").alias("a"), F.array("x", "y", F.lit(0.0), F.lit(0.0)).alias("first"), F.col("looks").alias("first_looks"), F.col("n").alias("na"))
    after = places.select("movie", (F.col("t") - 1).alias("t"), F.col("ID").alias("b"), F.array("x", "y").alias("place"), "looks", F.col("n").alias("nb"))
    reach = _reach(places, radius, stretch).join(before.hint("merge"), ["movie", "t", "a"]).join(after.hint("merge"), ["movie", "t", "b"])
    at = new_path(spark, "tracking")
    reach.repartition("stretch", "movie").write.partitionBy("stretch").parquet(f"{at}/reach")
    stored = lambda: spark.read.schema(reach.schema).parquet(f"{at}/reach")
    stretches = sorted(tuple(r) for r in stored().groupBy("stretch").agg(F.min("t"), F.max("t")).collect())
    run = lambda last: lambda pairs, before: _tracked(pairs, before, last, k)
    for number, first, last in stretches:
        pairs = stored().where(F.col("stretch") == number)
        entering = stored().where((F.col("stretch") == number) & (F.col("t") == first)).select("movie", F.col("a").alias("ID"), "island").distinct()
        path = f"{at}/states/last={first - 1}"
        come = spark.read.schema(STATE).parquet(path).where(F.col("t") == first) if any(e == first - 1 for _, _, e in stretches) else spark.createDataFrame([], STATE)
        groups = pairs.drop("stretch").groupBy("movie", "island").cogroup(come.join(entering, ["movie", "ID"]).groupBy("movie", "island"))
        groups.applyInArrow(run(last), STATE).write.parquet(f"{at}/states/last={last}")
    removed(spark, f"{at}/reach")
    key = ["movie", "t", "ID"]
    if not stretches:
        return known.select(*key, track_key(F.col("t"), F.col("ID")).alias("track_id"), F.lit(1.0).alias("probability"))
    went = spark.read.schema(STATE).parquet(f"{at}/states").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("amount") - 1)))
    went = went.select("movie", "t", F.col("ID").alias("class"), (F.col("from_") + F.col("i")).alias("number"), "probability", "root_t", "root", (F.col("root_from") + F.col("i")).alias("root_number"))
    roots = known.select("movie", F.col("t").alias("root_t"), F.col("class").alias("root"), F.col("number").alias("root_number"), track_key(F.col("t"), F.col("ID")).alias("track_id"))
    named = went.join(roots.hint("merge"), ["movie", "root_t", "root", "root_number"]).select("movie", "t", "class", "number", "track_id", "probability")
    out = known.select(*key, "class", "number").join(named.hint("merge"), ["movie", "t", "class", "number"], "left")
    return out.select(*key, F.coalesce("track_id", track_key(F.col("t"), F.col("ID"))).alias("track_id"), F.coalesce("probability", F.lit(1.0)).alias("probability"))


def lineage(tracks: DataFrame, splits: DataFrame) -> DataFrame:
    """(movie, track_id, parent, root); splits holds (movie, track_id, parent). A root's parent is itself.
    Chains of any length are followed, twice as far each round, until no root changes."""
    own = tracks.select("movie", "track_id").distinct().join(splits.hint("merge"), ["movie", "track_id"], "left").select("movie", "track_id", F.coalesce("parent", "track_id").alias("parent"))
    now = cut(own.withColumn("root", F.col("parent")))
    for _ in range(now.count().bit_length()):  # no chain is longer than that
        up = now.select("movie", F.col("track_id").alias("root"), F.col("root").alias("above"))
        after = cut(now.join(up.hint("merge"), ["movie", "root"]).select("movie", "track_id", "parent", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
        dropped(now)
        now = after.drop("moved")
        if not after.where("moved").head(1):
            break
    return now


def _track_spans(tracks: DataFrame) -> DataFrame:
    """(movie, track_id, s, e): first and last point of each track."""
    return tracks.groupBy("movie", "track_id").agg(F.max_by(F.struct("t", "x", "y"), "t").alias("e"), F.min_by(F.struct("t", "x", "y"), "t").alias("s"))


def _within_reach(parents: DataFrame, children: DataFrame, gap: int, radius: float) -> DataFrame:
    """Rows of parents (movie, pt, px, py and more) and of children (movie, t0, x0, y0 and more) that start up to gap frames after
    the parent's end, within the radius, with d2: an equi-join on frame and cell. A parent has a row for each cell around it,
    a child one for each frame back."""
    cell = lambda c: F.floor(F.col(c) / radius)
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    from_ = parents.withColumn("gx", around("px")).withColumn("gy", around("py"))
    to = children.withColumns({"gx": cell("x0"), "gy": cell("y0")}).withColumn("pt", F.explode(F.sequence(F.col("t0") - gap, F.col("t0") - 1)))
    d2 = F.pow(F.col("px") - F.col("x0"), 2) + F.pow(F.col("py") - F.col("y0"), 2)
    return from_.join(to.hint("merge"), ["movie", "pt", "gx", "gy"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).drop("gx", "gy")


def _as_parents(spans: DataFrame) -> DataFrame:
    return spans.select("movie", F.col("track_id").alias("parent"), F.col("e.t").alias("pt"), F.col("e.x").alias("px"), F.col("e.y").alias("py"))


def _as_children(spans: DataFrame) -> DataFrame:
    return spans.select("movie", "track_id", F.col("s.t").alias("t0"), F.col("s.x").alias("x0"), F.col("s.y").alias("y0"))


def stitch_candidates(tracks: DataFrame, gap: int = 3, radius: float = 50.0) -> DataFrame:
    """(movie, track_id, parent, d2): hypotheses that a track follows on another one that ended up to gap frames before, within the radius."""
    spans = _track_spans(tracks)
    return _within_reach(_as_parents(spans), _as_children(spans), gap, radius).select("movie", "track_id", "parent", "d2")


def stitch_nearest(tracks: DataFrame, gap: int = 3, radius: float = 50.0) -> DataFrame:
    """(movie, track_id, parent): of stitch_candidates() the nearest one of each track, ties (to six digits) to the smaller name.

    Tracks that start at one place have the same parent, and of those that end at one the least name: a row a place is compared."""
    spans = cut(_track_spans(tracks), "spans")
    children, place = _as_children(spans), ["movie", "t0", "x0", "y0"]
    parents = spans.groupBy("movie", F.col("e.t").alias("t"), F.col("e.x").alias("x"), F.col("e.y").alias("y")).agg(F.min("track_id").alias("name"))
    places = children.select("movie", F.col("t0").alias("t"), F.col("x0").alias("x"), F.col("y0").alias("y"), F.lit(None).cast(dict(spans.dtypes)["track_id"]).alias("name")).distinct()
    # those that may be the same to six digits
    pairs = _nearest(parents, places, gap, radius, 2e-6)
    first = F.row_number().over(Window.partitionBy(place).orderBy(F.round("d2", 6), "parent"))
    return children.join(pairs.withColumn("rank", first).where("rank = 1").select(*place, "parent").hint("merge"), place).select("movie", "track_id", "parent")


def stitch(tracks: DataFrame, gap: int = 3, radius: float = 50.0) -> DataFrame:
    """(movie, track_id, parent, d2): the consistent set of hypotheses of least total cost.

    A track has one parent at most, a parent two tracks at most (a division). A hypothesis costs its squared distance, the
    second one of a parent a quarter of the squared radius more; a track without parent costs the squared radius.
    Tracks that start, or end, at one place are one row of the assignment. Hypotheses that share no such row are islands; an
    island is a group, and solved by itself."""
    spans = cut(_track_spans(tracks), "spans")
    children = cut(_equals(_as_children(spans), ["movie", "t0", "x0", "y0"], "track_id"), "children")
    parents = cut(_equals(_as_parents(spans), ["movie", "pt", "px", "py"], "parent"), "parents")
    one = _classes(children, "a", "t0", "x0", "y0").withColumns({"size": F.lit(0.0), "alone": F.lit(radius * radius)})
    found = cut(_assigned(one, _classes(parents, "b", "pt", "px", "py").withColumn("size", F.lit(0.0)), gap, radius, F.array(F.lit(0.0), F.lit(radius * radius / 4))), "found")
    out = _members(found, children, parents)
    return out.select("movie", "track_id", "parent", (F.pow(F.col("px") - F.col("x0"), 2) + F.pow(F.col("py") - F.col("y0"), 2)).alias("d2"))


def _classes(things: DataFrame, name: str, t: str, x: str, y: str, *more: Column) -> DataFrame:
    """A row a class of _equals(): its name, its size (n and the name), and where and when it is."""
    place = [F.col(c).cast("double").alias(n) for c, n in ((x, "x"), (y, "y"))]
    return things.where("number = 0").select("movie", F.col(t).cast("int").alias("t"), *place, F.col("class").alias(name), F.col("n").alias(f"n{name}"), *more)


def _members(found: DataFrame, children: DataFrame, parents: DataFrame) -> DataFrame:
    """The members of children (classes a) and parents (classes b) that _assigned() has put together."""
    named = lambda df, c: df.drop("n").withColumnsRenamed({"class": c, "number": f"{c}_number"}).hint("merge")
    return found.join(named(children, "a"), ["movie", "a", "a_number"]).join(named(parents, "b"), ["movie", "b", "b_number"])


#: Variance of a place from one frame to the next, cost of a frame without object, deviation of the logarithm of a size.
LINK_SPREAD, MISSED, SIZES = 100.0, 2.0, 0.3
#: Costs of a track that starts or ends in the midst, of a division, and at the border, where so many pixels further inside cost one more.
START, END, DIVISION, BORDER, BORDER_PIXELS = 8.0, 8.0, 3.0, 1.0, 10.0


def track_ends(tracks: DataFrame, width: float = 1600, height: float = 1200) -> DataFrame:
    """A row a track: movie, track_id, its first place (t0, x0, y0, area0) and last (t1, x1, y1, area1), and what it costs to
    start and to end there (start, end), with the kind of either.

    Costs are negative log-likelihoods. In a movie's first frame a start, in its last one an end is free; at the border of
    the volume both cost BORDER, and more inside by the distance, but no more than START or END. Tracks without area have size 1."""
    area = F.col("area").cast("double") if "area" in tracks.columns else F.lit(1.0)
    point = F.struct("t", "x", "y", area.alias("area"))
    ends = tracks.groupBy("movie", "track_id").agg(F.min_by(point, "t").alias("s"), F.max_by(point, "t").alias("e"))
    frames = tracks.groupBy("movie").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    inside = lambda p: F.greatest(F.least(p["x"], F.lit(width) - p["x"], p["y"], F.lit(height) - p["y"]), F.lit(0.0))
    out = ends.join(frames, "movie").select(
        "movie",
        "track_id",
        *[F.col(f"{p}.{c}").alias(f"{c}{k}") for k, p in enumerate("se") for c in ("t", "x", "y", "area")],
        *[(F.lit(BORDER) + inside(F.col(p)) / BORDER_PIXELS).alias(f"border{k}") for k, p in enumerate("se")],
        "first",
        "last",
    )
    for k, (name, edge, most) in enumerate((("start", "first", START), ("end", "last", END))):
        free, near = F.col(f"t{k}") == F.col(edge), F.col(f"border{k}") < most
        out = out.withColumn(f"{name}_kind", F.when(~free & near, "border").otherwise(name)).withColumn(name, F.when(free, 0.0).when(near, F.col(f"border{k}")).otherwise(most))
    return out.drop("border0", "border1", "first", "last")


def family_costs(ends: DataFrame, gap: int = 3, radius: float = 50.0) -> DataFrame:
    """(movie, track_id, parent, cost, start, end): tracks that may follow on others that ended up to gap frames before, within the
    radius; an equi-join on the cells of a grid of its size.

    The cost holds the distance, of a variance that grows with the frames between, the frames without object, and how far the
    track's size lies outside what its parent's allows, from half of it (a daughter of a division) to all of it."""
    parents = ends.select("movie", F.col("track_id").alias("parent"), F.col("t1").alias("pt"), F.col("x1").alias("px"), F.col("y1").alias("py"), F.col("area1").alias("parea"), "end")
    children = ends.select("movie", "track_id", "t0", "x0", "y0", "area0", "start")
    return _within_reach(parents, children, gap, radius).select("movie", "track_id", "parent", _family_cost().alias("cost"), "start", "end")


def _family_cost() -> Column:
    size = F.log(F.greatest("area0", F.lit(1.0)) / F.greatest("parea", F.lit(1.0)))
    off = F.greatest(size, -F.log(F.lit(2.0)) - size, F.lit(0.0)) / SIZES
    steps = F.col("t0") - F.col("pt")
    return F.col("d2") / (2 * LINK_SPREAD * steps) + MISSED * (steps - 1) + off * off / 2


def _family_costs_of(d2: np.ndarray, steps: int, child: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """_family_cost() of arrays."""
    size = np.log(np.maximum(child, 1.0) / np.maximum(parent, 1.0))
    off = np.maximum(np.maximum(size, -np.log(2.0) - size), 0.0) / SIZES
    return d2 / (2 * LINK_SPREAD * steps) + MISSED * (steps - 1) + off * off / 2


def _family_reach(bound: np.ndarray, steps: int) -> np.ndarray:
    """The squared distance from which on a family costs as much as the bound."""
    return (bound - MISSED * (steps - 1)) * 2 * LINK_SPREAD * steps


def optimise(tracks: DataFrame, gap: int = 3, radius: float = 50.0, width: float = 1600, height: float = 1200) -> DataFrame:
    """(movie, track_id, side, kind, parent, cost): for the start and for the end of every track the hypothesis that explains it, so
    that all costs together are least.

    A track starts by itself (start), comes in at the border (border), or follows on another one, its parent, alone (link)
    or as one of two (division). It ends by itself (end), is lost at the border (border), or goes on (link, division).
    Costs are negative log-likelihoods; that of a link stands at the track's start, a division's further cost at the parent's end. Tracks
    that may belong to one family, directly or over others, form an island; an island is a group and solved exactly. Tracks that start,
    or end, at one place with one size are one row there."""
    ends = cut(track_ends(tracks, width, height), "ends")
    children = cut(_equals(ends.select("movie", "track_id", "t0", "x0", "y0", "area0", "start"), ["movie", "t0", "x0", "y0", "area0"], "track_id"), "children")
    parents = ends.select("movie", F.col("track_id").alias("parent"), F.col("t1").alias("pt"), F.col("x1").alias("px"), F.col("y1").alias("py"), F.col("area1").alias("parea"), "end")
    parents = cut(_equals(parents, ["movie", "pt", "px", "py", "parea"], "parent"), "parents")
    one = _classes(children, "a", "t0", "x0", "y0", F.col("area0").alias("size"), F.col("start").alias("alone"))
    two = _classes(parents, "b", "pt", "px", "py", F.col("parea").alias("size"), F.col("end"))
    # a parent that goes on saves its end; a second child makes a division, which no end is cheaper than
    found = cut(_assigned(one, two, gap, radius, F.array(-F.col("end"), F.lit(DIVISION)), (_family_costs_of, _family_reach)), "found")
    both = F.count("*").over(Window.partitionBy("movie", "parent")) > 1
    d2 = F.pow(F.col("px") - F.col("x0"), 2) + F.pow(F.col("py") - F.col("y0"), 2)
    chosen = _members(found, children, parents).withColumn("d2", d2)
    chosen = cut(chosen.select("movie", "track_id", "parent", _family_cost().alias("cost"), F.when(both, "division").otherwise("link").alias("kind")), "chosen")
    key = ["movie", "track_id"]
    starts = ends.join(chosen.hint("merge"), key, "left").select(*key, F.lit("start").alias("side"), F.coalesce("kind", "start_kind").alias("kind"), "parent", F.coalesce("cost", "start").alias("cost"))
    going = chosen.groupBy("movie", F.col("parent").alias("track_id")).agg(F.min("kind").alias("kind"))
    more = F.when(F.col("kind") == "division", DIVISION).when(F.col("kind") == "link", 0.0).otherwise(F.col("end"))
    stops = ends.join(going.hint("merge"), key, "left").select(*key, F.lit("end").alias("side"), F.coalesce("kind", "end_kind").alias("kind"), F.lit(None).cast("string").alias("parent"), more.alias("cost"))
    return starts.union(stops)
