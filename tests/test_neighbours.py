"""Neighbours of crowded objects, all at different places, without all pairs."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cellspark.functions import kernels
from cellspark.operators import tracking as tr


def test_nearest_points_are_found_without_all_pairs(monkeypatch):
    looked, every = 0, kernels.pairs_in_reach

    def counted(*a, **k):
        nonlocal looked
        for chunk in every(*a, **k):
            looked += len(chunk[0])
            yield chunk

    monkeypatch.setattr(kernels, "pairs_in_reach", counted)
    random = np.random.default_rng(4)
    for n in (500, 2000):  # all places are different, skewed as the stand-in's
        (ax, bx), (ay, by) = random.exponential(60, (2, n)), random.uniform(0, 60, (2, n))
        looked = 0
        i, j, d2 = kernels.nearest(ax, ay, bx, by, 50.0)
        full = (ax[:, None] - bx) ** 2 + (ay[:, None] - by) ** 2
        least = full.min(1)
        assert sorted(i.tolist()) == np.flatnonzero(least <= 2500).tolist() and (full[i, j] == least[i]).all() and (d2 == least[i]).all()
        assert looked < 30 * n


@pytest.fixture
def crowd(spark):
    """Objects at different places, many within the radius of each other, in tiles and frames next to each other."""
    random = np.random.default_rng(8)
    rows = [(m, t, 1000 * t + i, float(x), float(y), 50 + i % 7) for m in "ab" for t in (2, 3, 4, 6) for i, (x, y) in enumerate(random.uniform(360, 440, (60, 2)).round(2))]
    rows += [("a", 3, 9001, float("nan"), 400.0, 50), ("a", 4, 9002, None, 400.0, 50)]
    return spark.createDataFrame(rows, "movie string, t int, ID long, x double, y double, area long")


def test_mutual_links_of_a_crowd_need_no_pairs(crowd, monkeypatch):
    want = sorted(map(tuple, tr.link_mutual(tr.link_candidates(crowd)).collect()))
    monkeypatch.setattr(tr, "link_places", None)
    near = tr.nearest_candidates(crowd)
    assert sorted(map(tuple, tr.link_mutual(near).collect())) == want != []
    assert near.count() < 2 * crowd.count()


def test_nearest_parents_of_a_crowd_need_no_pairs(crowd, monkeypatch):
    tracks = crowd.where("x = x").select("movie", tr.track_key(F.col("t"), F.col("ID")).alias("track_id"), "t", "x", "y", "area")
    first = F.row_number().over(Window.partitionBy("movie", "track_id").orderBy(F.round("d2", 6), "parent"))
    want = sorted(map(tuple, tr.stitch_candidates(tracks).withColumn("rank", first).where("rank = 1").select("movie", "track_id", "parent").collect()))
    monkeypatch.setattr(tr, "_within_reach", None)
    assert sorted(map(tuple, tr.stitch_nearest(tracks).collect())) == want != []


def tracks_of(objects):
    return objects.where("x = x").select("movie", tr.track_key(F.col("t"), F.col("ID")).alias("track_id"), "t", "x", "y", "area")


def test_transport_in_reach_costs_as_that_of_all_pairs(monkeypatch):
    random, held, solve = np.random.default_rng(6), [], kernels.priced_transport
    monkeypatch.setattr(kernels, "priced_transport", lambda row, *a: held.append(len(row)) or solve(row, *a))
    for n in (1, 7, 60, 300):
        ax, ay, bx, by = random.exponential(30, (4, n))
        full = (ax[:, None] - bx) ** 2 + (ay[:, None] - by) ** 2
        row, column = np.nonzero(full <= 2500)
        cost, alone, adds = full[row, column], np.full(n, 2500.0), np.stack([-random.random(n) * 9, np.full(n, 625.0)], 1)
        supply, capacity = random.integers(1, 4, (2, n))

        def near(pays, least):
            if pays is None:
                yield kernels.few_nearest(ax, ay, bx, by, 50.0, 4)
            else:
                for i, j, d2 in kernels.pairs_in_reach(ax, ay, np.full(n, 50.0), bx, by):
                    some = d2 + least[j] < pays[i]
                    yield i[some], j[some], d2[some]

        held.clear()
        found = kernels.transport_in_reach(near, alone, supply, capacity, adds)
        most, out, into = max(held), np.zeros(n), np.zeros((n, 2))
        for i, j, k, amount in found:
            out[i], into[j, k] = out[i] + amount, into[j, k] + amount
        assert (out <= supply).all() and (into <= capacity[:, None]).all()
        got = sum((full[i, j] + adds[j, k] - 2500) * amount for i, j, k, amount in found)
        costs = np.concatenate([cost + adds[column, k] for k in range(2)])
        want = kernels.transport(np.tile(row, 2), np.concatenate([column, column + n]), costs, alone, supply, np.tile(capacity, 2))
        assert got == pytest.approx(sum((costs[e] - 2500) * amount for e, amount in want))
        assert n < 300 or most < len(costs) / 3


def test_assignments_of_a_crowd_hold_no_pairs(crowd, monkeypatch):
    tracks = tracks_of(crowd)
    pairs = tr.stitch_candidates(tracks).collect()
    a, b = (np.unique([f"{r['movie']} {r[c]}" for r in pairs], return_inverse=True)[1] for c in ("track_id", "parent"))
    cost, n, m = np.array([r["d2"] for r in pairs]), a.max() + 1, b.max() + 1
    costs = np.concatenate([cost, cost + 625])
    best = kernels.transport(np.tile(a, 2), np.concatenate([b, b + m]), costs, np.full(n, 2500.0), np.ones(n, int), np.ones(2 * m, int))
    want_links = sum(r["d2"] - 2500 for r in tr.link_optimal(tr.link_candidates(crowd)).collect())
    families = tr.family_costs(tr.track_ends(tracks)).collect()
    ends = {(r["movie"], r["track_id"]): r for r in tr.track_ends(tracks).collect()}
    of = {key: i for i, key in enumerate(ends)}
    child, parent = (np.array([of[r["movie"], r[c]] for r in families]) for c in ("track_id", "parent"))
    link = np.array([r["cost"] for r in families])
    start, end = (np.array([r[c] for r in ends.values()]) for c in ("start", "end"))
    want_families = kernels.best_families(parent, child, link, link, start, end, tr.DIVISION)[1]
    monkeypatch.setattr(tr, "_within_reach", None)
    monkeypatch.setattr(tr, "link_places", None)
    got = tr.stitch(tracks).collect()
    twice = len(got) - len({(r["movie"], r["parent"]) for r in got})
    assert sum(r["d2"] - 2500 for r in got) + 625 * twice == pytest.approx(sum((costs[e] - 2500) * amount for e, amount in best))
    assert sum(r["d2"] - 2500 for r in tr.link_optimal_objects(crowd).collect()) == pytest.approx(want_links)
    assert sum(r["cost"] for r in tr.optimise(tracks).collect()) == pytest.approx(want_families)


def test_tracks_and_ends_of_a_crowd_need_no_pairs(crowd, monkeypatch):
    objects = crowd.where("x = x")

    def found(links):
        ids = tr.assign_track_ids(objects, links)
        return [sorted(map(str, df.collect())) for df in (ids, tr.tracks_long(objects, ids), tr.track_ends(tr.tracks_long(objects, ids)))]

    want = found(tr.link_mutual(tr.link_candidates(objects)))
    monkeypatch.setattr(tr, "link_places", None)
    assert found(tr.link_mutual(tr.nearest_candidates(objects))) == want
