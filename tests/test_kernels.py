import itertools

import numpy as np

from cellspark.functions import kernels


def flood(mask, connectivity):
    label, count = np.zeros(mask.shape, int), 0
    near = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (connectivity == 8 or not i or not j)]
    for start in zip(*np.nonzero(mask), strict=True):
        if label[start]:
            continue
        count += 1
        label[start], todo = count, [start]
        while todo:
            y, x = todo.pop()
            for i, j in near:
                p = (y + i, x + j)
                if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not label[p]:
                    label[p] = count
                    todo.append(p)
    return label, count


def runs(mask):
    out = []
    for y, row in enumerate(mask):
        edge = np.diff(np.concatenate([[0], row.astype(int), [0]]))
        out += [(y, a, b - 1) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
    return np.array(out, int).reshape(-1, 3).T


def test_components_as_flood_fill():
    rng = np.random.default_rng(1)
    for k in range(60):
        mask = rng.random((12, 14)) < 0.25 + k / 150
        y, x0, x1 = runs(mask)
        for connectivity in (4, 8):
            root = kernels.runs_components(y, x0, x1, connectivity)
            label, count = flood(mask, connectivity)
            assert len(set(root)) == count
            for i, j in itertools.combinations(range(len(y)), 2):
                assert (root[i] == root[j]) == (label[y[i], x0[i]] == label[y[j], x0[j]])


def test_distances_by_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        mask = rng.random((9, 11)) < 0.7
        back = np.argwhere(~mask)
        if len(back):
            want = np.array([[np.sqrt(((back - (y, x)) ** 2).sum(1).min()) for x in range(11)] for y in range(9)])
            assert np.allclose(kernels.distances(mask), want)


def test_watershed_splits_touching_discs():
    ys, xs = np.mgrid[0:24, 0:40]
    mask = ((ys - 11) ** 2 + (xs - 12) ** 2 <= 64) | ((ys - 11) ** 2 + (xs - 24) ** 2 <= 64)
    d = np.where(mask, kernels.distances(mask), 0)
    markers = np.zeros(mask.shape, int)
    markers[11, 12], markers[11, 24] = 1, 2
    label = kernels.watershed(-d, markers, mask)
    assert set(np.unique(label[mask])) == {1, 2} and (label[~mask] == 0).all()
    assert label[11, 5] == 1 and label[11, 30] == 2


def test_hull_and_assignment():
    assert kernels.hull_area(np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])) == 4
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (3, 3), (4, 6), (5, 5)):
        cost = rng.random((n, m))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        pairs = kernels.assignment(cost)
        assert len(pairs) == n and np.isclose(sum(cost[i, j] for i, j in pairs), best)
