"""The tracker, sparse assignment and global hypotheses against brute force."""

import itertools
import math

import numpy as np
import pytest

from cellspark.functions import kernels
from cellspark.operators import tracking as tr

OBJECT = "movie string, t int, ID long, x double, y double, area long, major_axis_length double, minor_axis_length double, orientation double, solidity double"


def test_sparse_assignment_costs_as_the_dense_one():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, m = rng.integers(1, 7, 2)
        row, column = np.nonzero(rng.random((n, m)) < 0.6)
        cost, alone = np.round(rng.normal(0, 1, len(row)), rng.integers(0, 3)), np.round(rng.normal(0, 1, n), 1)
        used = kernels.sparse_assignment(row, column, cost, alone)
        taken = [column[e] for e in used if e >= 0]
        assert len(set(taken)) == len(taken) and all(row[e] == r for r, e in enumerate(used) if e >= 0)
        dense = np.full((n, m + n), 1e6)
        dense[row, column] = cost
        dense[np.arange(n), m + np.arange(n)] = alone
        assert sum(cost[e] if e >= 0 else alone[r] for r, e in enumerate(used)) == pytest.approx(sum(dense[p] for p in kernels.assignment(dense)))


def test_sparse_assignment_of_thousands():
    """5,000 by 5,000 with 5 candidates each: memory as that of the pairs."""
    import tracemalloc

    rng, n = np.random.default_rng(2), 5000
    place = rng.random((n, 2)) * 1000
    row = np.repeat(np.arange(n), 5)
    column = np.concatenate([(k + np.array([0, 1, 2, 3, 4])) % n for k in range(n)])
    cost = ((place[row] - place[column] - 3) ** 2).sum(1)
    tracemalloc.start()
    used = kernels.sparse_assignment(row, column, cost, np.full(n, 2500.0))
    assert tracemalloc.get_traced_memory()[1] < 50e6 and (used >= 0).sum() > 0.9 * n
    tracemalloc.stop()


def families_one_by_one(parent, child, link, divide, start, end, division):
    cost, best = {(p, c): (a, b) for p, c, a, b in zip(parent, child, link, divide, strict=True)}, math.inf
    for choice in itertools.product(range(-1, len(end)), repeat=len(start)):
        total = 0.0
        for p in range(len(end)):
            kids = [c for c, q in enumerate(choice) if q == p]
            own = [cost.get((p, c), (math.inf, math.inf)) for c in kids]
            total += end[p] if not kids else own[0][0] if len(kids) == 1 else division + own[0][1] + own[1][1] if len(kids) == 2 else math.inf
        best = min(best, total + sum(start[c] for c, q in enumerate(choice) if q < 0))
    return best


@pytest.mark.parametrize("same", [True, False])
def test_families_by_exhaustive_search(same):
    rng = np.random.default_rng(3)
    for _ in range(150):
        n, m = rng.integers(1, 6), rng.integers(1, 4)
        parent, child = np.nonzero(rng.random((m, n)) < 0.8)
        link, divide = rng.random((2, len(parent))) * 10
        divide = link if same else divide
        if not same:
            link[rng.random(len(parent)) < 0.2] = np.inf
        start, end, division = rng.random(n) * 8, rng.random(m) * 8, rng.random() * 4 - 1
        found, cost = kernels.best_families(parent, child, link, divide, start, end, division)
        assert cost == pytest.approx(families_one_by_one(parent, child, link, divide, start, end, division))
        total, kids = start.sum() + end.sum(), {}
        for e, two in found:
            kids.setdefault(parent[e], []).append(two)
            total += (divide if two else link)[e] - start[child[e]]
        assert all(k in ([False], [True, True]) for k in kids.values()) and len({child[e] for e, _ in found}) == len(found)
        assert total + sum((division if len(k) == 2 else 0) - end[p] for p, k in kids.items()) == pytest.approx(cost)


def tracks_one_by_one(rows, radius):
    """Frame after frame over all objects of a movie, with dense assignments."""
    live, out = {}, {}
    for t in sorted({r[1] for r in rows}):
        now = [r for r in rows if r[1] == t]
        looks = [features(r) for r in now]
        k, names = len(looks[0]), sorted(n for n, s in live.items() if s["t"] == t - 1)
        won = {}
        if names:
            cost = np.full((len(names), len(now) + len(names)), 1e9)
            for i, name in enumerate(names):
                s = live[name]
                state, spread = tr.predicted(s["state"][None], s["spread"][None])
                logs = np.full(len(now) + 1, -np.inf)
                for j, r in enumerate(now):
                    if (r[3] - s["x"]) ** 2 + (r[4] - s["y"]) ** 2 <= radius**2:
                        logs[j] = tr.pair_logs(state, spread, np.array([s["n"]]), s["mean"][None], s["scatter"][None], np.array([[r[3], r[4]]]), looks[j][None])[0]
                logs[-1] = tr.none_log(k)
                logs -= np.logaddexp.reduce(logs)
                cost[i, : len(now)], cost[i, len(now) + i] = np.where(np.isfinite(logs[:-1]), -logs[:-1], 1e9), -logs[-1]
            won = {j: (names[i], math.exp(-cost[i, j])) for i, j in kernels.assignment(cost) if j < len(now)}
        for j, r in enumerate(now):
            place = np.array([r[3], r[4]])
            if j in won:
                name, chance = won[j]
                s = live[name]
                state, spread = tr.predicted(s["state"][None], s["spread"][None])
                state, spread = tr.updated(state, spread, place[None])
                mean, scatter = tr.looks_updated(np.array([s["n"]]), s["mean"][None], s["scatter"][None], looks[j][None])
                live[name] = {"t": t, "x": r[3], "y": r[4], "state": state[0], "spread": spread[0], "n": s["n"] + 1, "mean": mean[0], "scatter": scatter[0]}
            else:
                name, chance = f"{t:06d}:{r[2]}", 1.0
                live[name] = {"t": t, "x": r[3], "y": r[4], "state": np.append(place, [0, 0]), "spread": tr.SPREAD * np.eye(4), "n": 1, "mean": looks[j], "scatter": np.zeros((k, k))}
            out[t, r[2]] = (name, round(chance, 9))
    return out


def features(r):
    _, _, _, _, _, area, major, minor, turn, solid = r
    size = [math.log(max(v, 1)) / tr.LOG_SIZE for v in (area, major, minor)]
    return np.array([*size, *(f(2 * turn) * (1 - minor / major) / tr.TURN for f in (math.cos, math.sin)), solid / tr.SOLID])


def test_a_crowded_movie_as_one_by_one(spark):
    """All objects of a frame are within reach of one another, over others: one island a frame, none over frames."""
    rng = np.random.default_rng(4)
    at = np.stack(np.meshgrid(np.arange(6), np.arange(5)), -1).reshape(-1, 2) * 30.0
    shape = [(int(a), float(10 + 8 * u), float(6 + 4 * v), float(w), float(0.8 + 0.2 * s)) for a, u, v, w, s in zip(rng.integers(40, 90, 30), *rng.random((3, 30)), rng.random(30), strict=True)]
    rows = []
    for t in (1, 2, 3, 4, 6, 7):
        at = at + rng.normal(0, 4, at.shape)
        for k, (x, y) in enumerate(at):
            if rng.random() < 0.9:
                a, p, q, w, s = shape[k]
                rows.append(("m", t, 1000 * t + k, float(x), float(y), a, p, q, w + float(rng.normal(0, 0.1)), s))
    got = tr.track_bayes(spark.createDataFrame(rows, OBJECT)).collect()
    assert {(r["t"], r["ID"]): (r["track_id"], round(r["probability"], 9)) for r in got} == tracks_one_by_one(rows, 50.0) and len(got) == len(rows)
    islands = tr._island_of(tr.link_candidates(spark.createDataFrame(rows, OBJECT)), ["movie", "t", "a"], ["movie", "t", "b"])
    assert sorted(r["t"] for r in islands.select("t", "island").distinct().collect()) == [1, 2, 3, 6]


def test_only_the_orientation_tells(spark):
    rows = [("m", t, 10 * t + k, 20.0 * k, 0.0, 60, 14.0, 5.0, turn, 0.9) for t in (1, 2, 3) for k, turn in ((0, 0.1), (1, 1.6))]
    # both then lie in the middle, the one that belongs to the first track with the larger id
    rows += [("m", 4, 41, 10.0, 0.0, 60, 14.0, 5.0, 1.6, 0.9), ("m", 4, 42, 10.0, 0.0, 60, 14.0, 5.0, 0.1 - math.pi, 0.9)]
    got = {r["ID"]: r for r in tr.track_bayes(spark.createDataFrame(rows, OBJECT)).collect()}
    assert got[42]["track_id"] == "000001:10" and got[41]["track_id"] == "000001:11" and got[41]["probability"] > 0.9
    without = {r["ID"]: r for r in tr.track_bayes(spark.createDataFrame(rows, OBJECT), features=("area",)).collect()}
    assert without[41]["probability"] < 0.6
    assert tr.track_bayes(spark.createDataFrame([], OBJECT)).count() == 0


def test_hypotheses_of_a_movie(spark):
    track = lambda name, ts, x, y, area=100: [("m", name, t, float(x), float(y), area) for t in ts]
    rows = track("a", range(0, 4), 400, 400) + track("a2", range(5, 10), 405, 400)  # a gap of one frame
    rows += track("b", range(0, 5), 800, 600) + track("b1", range(5, 10), 790, 600, 50) + track("b2", range(5, 10), 810, 600, 52)  # a division
    rows += track("c", range(0, 6), 800, 4) + track("d", range(3, 10), 3, 700) + track("e", range(2, 7), 900, 900)  # lost and found at the border, and neither
    df = spark.createDataFrame(rows, "movie string, track_id string, t int, x double, y double, area long")
    got = {(r["track_id"], r["side"]): (r["kind"], r["parent"], r["cost"]) for r in tr.optimise(df).collect()}
    assert len(got) == 2 * 8
    kinds = {k: v[0] for k, v in got.items()}
    assert kinds["a", "start"] == "start" and got["a", "start"][2] == 0 and kinds["a", "end"] == "link" and got["a2", "start"][:2] == ("link", "a") and got["a2", "end"][2] == 0
    assert kinds["b", "end"] == "division" and got["b1", "start"][:2] == got["b2", "start"][:2] == ("division", "b") and got["b", "end"][2] == tr.DIVISION
    assert kinds["c", "end"] == "border" and got["c", "end"][2] == pytest.approx(1.4) and kinds["d", "start"] == "border" and got["d", "start"][2] == pytest.approx(1.3)
    assert kinds["e", "start"] == "start" and kinds["e", "end"] == "end" and got["e", "start"][2] == tr.START


def test_hypotheses_by_exhaustive_search(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k, (x, y, t) in enumerate(zip(*(rng.random((2, 3)) * 40 + 500), rng.integers(3, 5, 3), strict=True)):
        rows += [("m", f"a{k}", s, float(x), float(y), int(rng.integers(80, 120))) for s in range(t)]
    for k, (x, y, t) in enumerate(zip(*(rng.random((2, 5)) * 40 + 500), rng.integers(4, 6, 5), strict=True)):
        rows += [("m", f"b{k}", s, float(x), float(y), int(rng.integers(30, 120))) for s in range(t, 8)]
    df = spark.createDataFrame(rows, "movie string, track_id string, t int, x double, y double, area long")
    ends = {r["track_id"]: r for r in tr.track_ends(df).collect()}
    pairs = tr.family_costs(tr.track_ends(df)).collect()
    parents, children = sorted(ends), sorted(ends)
    p, c = [parents.index(r["parent"]) for r in pairs], [children.index(r["track_id"]) for r in pairs]
    cost = [r["cost"] for r in pairs]
    # tracks a have no parent and tracks b no child here, so that the search is small
    assert {x[0] for x in (r["parent"] for r in pairs)} == {"a"} and {r["track_id"][0] for r in pairs} == {"b"}
    want = families_one_by_one(p, [k - 3 for k in c], cost, cost, [ends[f"b{k}"]["start"] for k in range(5)], [ends[f"a{k}"]["end"] for k in range(3)], tr.DIVISION)
    want += sum(ends[f"a{k}"]["start"] for k in range(3)) + sum(ends[f"b{k}"]["end"] for k in range(5))
    assert sum(r["cost"] for r in tr.optimise(df).collect()) == pytest.approx(want)
