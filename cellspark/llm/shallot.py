"""Exact k-means over whole-number vectors with Shallot's bounds (Borgelt, 2020).

A vector remembers its centroid and the one that was second, with an upper bound of its distance to the first and a
lower bound of that to all others. Where the bounds do not decide, the distances to both remembered centroids are
computed, and the closer one is the middle of a search ball: the centroids are looked at in order of their distance from
it, up to the sum of the two smallest distances found so far, which shrinks on the way. Bounds are floating-point numbers
with a margin; what they leave is compared in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import dropped, stored

DIMENSIONS, CENTROIDS, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
#: Components below this size keep squared distances of 64 components below 2^62.
LARGEST = 1 << 27
#: Share by which bounds are widened, against rounding; vectors compared at once.
MARGIN, AT_ONCE = 1e-9, 2048


def whole_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): the rows with exactly so many components, none null or not finite, each as floor(scale * component).

    Rows with a component of LARGEST or more after that are left out too, as their distances do not fit 64 bits."""
    known = embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v")).where(F.size("v") == dimensions)
    fits = F.forall("v", lambda v: F.coalesce(~F.isnan(v) & (F.abs(F.floor(F.least(F.greatest(v * scale, F.lit(-1.0 * LARGEST)), F.lit(1.0 * LARGEST)))) < LARGEST), F.lit(False)))
    return known.where(fits).select("vec_id", F.transform("v", lambda v: F.floor(v * scale).cast("int")).alias("x"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:vec_id`, in order of it; equal ids by their components. A null id is empty text."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(name.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, as whole numbers, of vectors and centroids row by row."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Search:
    """Nearest centroids by remembered bounds. order[j] and apart[j]: the other centroids by their distance from j."""

    def __init__(self, centroids: np.ndarray):
        self.c, k = centroids, len(centroids)
        squares = np.array([_squares(centroids, c) for c in centroids]).reshape(k, k)
        np.fill_diagonal(squares, -1)  # itself is first, also among equal ones
        self.order = np.argsort(squares, axis=1, kind="stable")
        squares.sort(axis=1)
        self.apart = np.sqrt(np.maximum(squares, 0)) * (1 - MARGIN)
        #: Half the distance to the nearest other centroid.
        self.half = self.apart[:, 1] / 2 if k > 1 else np.full(k, np.inf)

    def nearest(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Bring a (nearest, ties to the smaller number), b (second nearest) and the bounds up to date, in place."""
        rest = np.flatnonzero(upper >= np.maximum(self.half[a], lower))
        for at in range(0, len(rest), AT_ONCE):
            self._looked(x, a, b, upper, lower, rest[at : at + AT_ONCE])

    def _looked(self, x, a, b, upper, lower, rows) -> None:
        # the exact distance to the remembered one may decide already
        da = _squares(x[rows], self.c[a[rows]])
        upper[rows] = np.sqrt(da) * (1 + MARGIN)
        open_ = upper[rows] >= np.maximum(self.half[a[rows]], lower[rows])
        rows, da = rows[open_], da[open_]
        if not len(rows) or len(self.c) < 2:
            return
        own, first, second = x[rows], a[rows], b[rows]
        db = _squares(own, self.c[second])
        swap = (db < da) | ((db == da) & (second < first))
        middle = np.where(swap, second, first)
        near, far = np.where(swap, second, first), np.where(swap, first, second)
        d1, d2 = np.where(swap, db, da), np.where(swap, da, db)
        at_middle = np.sqrt(d1.astype(float))
        going = np.arange(len(rows))
        for step in range(1, len(self.c)):
            ball = (at_middle[going] + np.sqrt(d2[going])) * (1 + MARGIN)
            going = going[self.apart[middle[going], step] <= ball]
            if not len(going):
                break
            c = self.order[middle[going], step]
            asked = (c != first[going]) & (c != second[going])
            now, c = going[asked], c[asked]
            d = _squares(own[now], self.c[c])
            best = (d < d1[now]) | ((d == d1[now]) & (c < near[now]))
            better = ~best & (d < d2[now])
            d2[now[best]], far[now[best]] = d1[now[best]], near[now[best]]
            d1[now[best]], near[now[best]] = d[best], c[best]
            d2[now[better]], far[now[better]] = d[better], c[better]
        a[rows], b[rows] = near, far
        upper[rows], lower[rows] = np.sqrt(d1) * (1 + MARGIN), np.sqrt(d2) * (1 - MARGIN)


STATE = "x array<int>, a int, b int, upper double, lower double"


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("x").flatten().to_numpy().astype(np.int64)
    return flat.reshape(batch.num_rows, len(flat) // max(batch.num_rows, 1))


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return _vectors(batch), *(batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("a", "b", "upper", "lower"))


def _assigned(vectors: DataFrame, centroids: np.ndarray, moved: np.ndarray | None, kind: str) -> DataFrame:
    """vectors with their state for these centroids; moved: how far each one has moved since the state was made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        far = np.argsort(moved)[::-1][:2] if moved is not None and len(moved) > 1 else None
        for batch in batches:
            x, a, b, upper, lower = _columns(batch)
            if moved is not None:
                upper = (upper + moved[a]) * (1 + MARGIN)
                if far is not None:  # the others: the one that moved most, or the next if that is a
                    lower = (lower - moved[np.where(a == far[0], far[1], far[0])]) * (1 - MARGIN) - MARGIN
            search.nearest(x, a, b, upper, lower)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), *map(pa.array, (a, b, upper, lower))], ["vec_id", "x", "a", "b", "upper", "lower"])

    return vectors.mapInArrow(run, f"vec_id {kind}, {STATE}")


def _sums(vectors: DataFrame, dimensions: int) -> dict[int, tuple[int, np.ndarray]]:
    """Number of vectors and sums of components of each centroid: a row a centroid and task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x, a = _vectors(batch), batch.column("a").to_numpy()
            for k in np.unique(a).tolist():
                own = x[a == k]
                n[k], sums[k] = n.get(k, 0) + len(own), sums.get(k, 0) + own.sum(0)
        ks = sorted(n)
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array([n[k] for k in ks], pa.int64()), pa.array([sums[k].tolist() for k in ks], pa.list_(pa.int64()))], ["a", "n", "s"])

    parts = vectors.select("x", "a").mapInArrow(run, "a int, n long, s array<long>")
    total = parts.groupBy("a").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dimensions)]).alias("s"))
    return {r["a"]: (r["n"], np.array(r["s"], np.int64)) for r in total.collect()}


def clusters(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of whole_vectors().

    Each round assigns all vectors to the nearest of the k centroids (ties to the smaller number), then moves each centroid
    that has any to the floor of their mean; after the last round they are assigned once more. All results are exact. Equal vectors have
    equal results, rows that share a vec_id or have none a row each; with fewer vectors than k there are as many centroids.
    An empty table gives none. To the driver come k rows a round, of sums that every task has added up for itself."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    start = stored(whole_vectors(embeddings, dimensions, scale), "vectors")
    centroids = first_centroids(start, k, seed)
    if not len(centroids):
        return start.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}.items()])
    state = start.select("vec_id", "x", F.lit(0).alias("a"), F.lit(len(centroids) - 1).alias("b"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))
    moved, before = None, start
    for _ in range(rounds):
        now = stored(_assigned(state, centroids, moved, kind), "assigned")
        dropped(before)
        state = before = now
        after = centroids.copy()
        for j, (n, s) in _sums(now, dimensions).items():
            after[j] = s // n  # floor, also below 0
        moved = np.sqrt(_squares(after, centroids)) * (1 + MARGIN)
        centroids = after
    last = stored(_with_distance(_assigned(state, centroids, moved, kind), centroids, kind), "clusters")
    dropped(before)
    inertia = {r["cluster"]: r["s"] for r in last.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = last.sparkSession.createDataFrame([(j, inertia.get(j, 0), sum(inertia.values()), names[j]) for j in range(len(names))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _with_distance(vectors: DataFrame, centroids: np.ndarray, kind: str) -> DataFrame:
    """(vec_id, cluster, distance) of vectors with their state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column("a").to_numpy()
            x = _vectors(batch)
            d = [_squares(x[i : i + AT_ONCE], centroids[a[i : i + AT_ONCE]]) for i in range(0, len(a), AT_ONCE)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("a"), pa.array(np.concatenate([np.zeros(0, np.int64), *d]))], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")
