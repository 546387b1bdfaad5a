"""Array kernels of one plane, region or movie; pure numpy, called by Spark for its groups."""

from __future__ import annotations

import heapq
from array import array

import numpy as np


def runs_components(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, connectivity: int) -> np.ndarray:
    """A component number for each run: runs of neighbouring rows that touch, at corners too if connectivity is 8."""
    reach = 1 if connectivity == 8 else 0
    root = np.arange(len(y))
    if not len(y):
        return root
    order = np.lexsort((x0, y))
    first, last, width = x0[order].astype(np.int64) - x0.min() + 1, x1[order].astype(np.int64) - x0.min() + 1, int(x1.max()) - int(x0.min()) + 4
    row = (y[order].astype(np.int64) - y.min()) * width
    # the runs of the next row that end behind a run's first pixel and begin before its last one
    low, high = np.searchsorted(row + last, row + width + first - reach), np.searchsorted(row + first, row + width + last + reach, "right")
    n = np.maximum(high - low, 0)
    a, b = order[np.repeat(np.arange(len(n)), n)], order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
    while len(a):  # roots that touch a smaller one are hung below it: half of them at least
        p, q = root[a], root[b]
        open_ = p != q
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(p, q)[open_], np.minimum(p, q)[open_])
        while (root != (up := root[root])).any():
            root = up
    return root


def islands(mask: np.ndarray) -> np.ndarray:
    """8-connected islands of a mask, numbered from 1 by raster order; 0 elsewhere."""
    out = np.zeros(mask.shape, np.int64)
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(edge == 1)
    x1 = np.nonzero(edge == -1)[1] - 1
    if len(y):
        root = runs_components(y, x0, x1, 8)
        number = np.unique(root, return_inverse=True)[1] + 1  # runs are in raster order, and a root is its island's first
        for a, b, c, n in zip(y, x0, x1, number, strict=True):
            out[a, b : c + 1] = n
    return out


def _envelope(f: np.ndarray) -> np.ndarray:
    """min over q of f[q] + (p - q)^2 for each p, by the lower envelope of the parabolas (Felzenszwalb and Huttenlocher)."""
    known = np.flatnonzero(np.isfinite(f))
    if not len(known):
        return np.full(len(f), np.inf)
    at, from_ = [int(known[0])], [-np.inf]
    for q in known[1:].tolist():
        while True:
            p = at[-1]
            meet = (f[q] + q * q - f[p] - p * p) / (2 * (q - p))
            if meet > from_[-1]:
                break
            at.pop()
            from_.pop()
        at.append(q)
        from_.append(meet)
    p = np.arange(len(f))
    q = np.array(at)[np.searchsorted(from_, p, "right") - 1]
    return f[q] + (p - q) ** 2


def column_distances(mask: np.ndarray) -> np.ndarray:
    """Distance of each foreground pixel to the nearest background pixel of its column; infinite where there is none."""
    h, w = mask.shape
    d = np.where(mask, np.inf, 0.0)
    for y in range(1, h):
        d[y] = np.minimum(d[y], d[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        d[y] = np.minimum(d[y], d[y + 1] + 1)
    return d


def line_distances(d: np.ndarray) -> np.ndarray:
    """Distances from those along the columns, line by line; 0 where there is no background at all."""
    out = np.sqrt(np.stack([_envelope(row) for row in d**2])) if len(d) else d
    return np.where(np.isfinite(out), out, 0.0)


def distances(mask: np.ndarray) -> np.ndarray:
    """Exact distance of each foreground pixel to the nearest background pixel; outside the image is not background.

    Distances along the columns first, then the lower envelope of each row: time in proportion to the pixels."""
    return np.sqrt(np.stack([_envelope(row) for row in column_distances(mask) ** 2])) if len(mask) else np.zeros(mask.shape)


def watershed(level: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Floods from the markers in order of level, then age, then raster order, over 4-neighbours inside the mask."""
    out, h, w = np.where(mask, markers, 0), *mask.shape
    heap, age = [], 0
    for y, x in zip(*np.nonzero(out), strict=True):
        heap.append((level[y, x], 0, y * w + x))
    heapq.heapify(heap)
    while heap:
        _, _, at = heapq.heappop(heap)
        y, x = divmod(at, w)
        for p, q in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
            if 0 <= p < h and 0 <= q < w and mask[p, q] and not out[p, q]:
                out[p, q] = out[y, x]
                age += 1
                heapq.heappush(heap, (level[p, q], age, p * w + q))
    return out


def pixel_corners(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The four corners of each pixel, as rows (y, x)."""
    return np.concatenate([np.stack([y + i, x + j], 1) for i in (0, 1) for j in (0, 1)])


def hull(points: np.ndarray) -> list[tuple[int, int]]:
    """Corners of the convex hull of points (rows), in turning order."""
    points = sorted(set(map(tuple, points.tolist())))

    def half(points):
        out = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def polygon_area(corners: list[tuple[int, int]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(corners, corners[1:] + corners[:1], strict=True))) / 2


def hull_area(y: np.ndarray, x: np.ndarray) -> float:
    """Area of the convex hull of the pixels' corners."""
    return polygon_area(hull(pixel_corners(y, x)))


#: Pairs of points that are looked at together.
PAIRS = 1 << 20


def pairs_in_reach(ax: np.ndarray, ay: np.ndarray, reach: np.ndarray, bx: np.ndarray, by: np.ndarray, at_once: int = PAIRS):
    """Chunks (i, j, d2) of the pairs of a point i and a point j not further off than reach[i], d2 being the square of their distance.

    The pairs of a point are in one chunk, side by side, points in order; a chunk has about so many pairs, or one point. The second points lie
    in rows of the median reach's height, in order of x: a point's pairs are a stretch of each row that it reaches."""
    if not len(ax) or not len(bx):
        return
    y0, x0 = float(by.min()), float(bx.min())
    height = max(float(np.median(reach)), (float(by.max()) - y0) / (1 << 16), 1e-9)
    row = np.floor((by - y0) / height)
    slack = 1e-9 * (1.0 + reach + np.abs(ax) + np.abs(ay))  # cells and bounds are rounded; the distance decides
    low, high = np.maximum(np.floor((ay - reach - slack - y0) / height), 0), np.minimum(np.floor((ay + reach + slack - y0) / height), row.max())
    rows = np.maximum(high - low + 1, 0).astype(np.int64)
    order = np.lexsort((bx, row))
    bx_in, row_in = bx[order], row[order]
    names, start = np.unique(row_in, return_index=True)
    width = float(bx.max()) - x0 + 2.0  # a row's span, with room on either side
    key = np.searchsorted(names, row_in) * width + (bx_in - x0)
    bound = 1e-9 * width * (1 + len(names))
    for first, last in _stretches(rows, at_once):
        n = rows[first:last]
        of = np.repeat(np.arange(first, last), n)
        at = low[of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        k = np.minimum(np.searchsorted(names, at), len(names) - 1)
        known = names[k] == at
        of, k = of[known], k[known]
        wide = reach[of] + slack[of]
        lower = np.searchsorted(key, k * width + np.clip(ax[of] - wide - x0, -0.5, width - 1.5) - bound)
        upper = np.searchsorted(key, k * width + np.clip(ax[of] + wide - x0, -0.5, width - 1.5) + bound, "right")
        n = upper - lower
        each = np.bincount(of - first, n, last - first).astype(np.int64)
        parts = np.concatenate([[0], np.cumsum(np.bincount(of - first, minlength=last - first))])
        for p, q in _stretches(each, at_once):
            mine = slice(parts[p], parts[q])
            m = n[mine]
            i = np.repeat(of[mine], m)
            j = order[np.arange(m.sum()) + np.repeat(lower[mine] - np.cumsum(m) + m, m)]
            x, y = ax[i] - bx[j], ay[i] - by[j]
            d2 = x * x + y * y
            near = d2 <= (reach * reach)[i]
            yield i[near], j[near], d2[near]


def _stretches(counts: np.ndarray, at_once: int):
    """(first, last) of stretches of counts that sum up to so much at most, or have one count."""
    ends, first = np.cumsum(counts), 0
    while first < len(counts):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + at_once, "right")))
        yield first, last
        first = last


def first_reach(x: np.ndarray, y: np.ndarray, radius: float) -> float:
    """About half the distance of points from each other, if they lay evenly."""
    if not len(x):
        return radius
    area = max(float(np.ptp(x)), 1e-6) * max(float(np.ptp(y)), 1e-6)
    return min(radius, max((area / len(x)) ** 0.5 / 2, radius / 1024))


def nearest(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, radius: float, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d2): of each point i the points j within the radius whose squared distance is the least, or larger by the slack at most.

    The reach begins at what the density suggests and doubles for those points that have found none, so that pairs grow with the
    points and not with the square of their density."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    left, reach = np.arange(len(ax)), first_reach(bx, by, radius)
    while len(left) and len(bx):
        found = np.zeros(len(left), bool)
        for i, j, d2 in pairs_in_reach(ax[left], ay[left], np.full(len(left), reach), bx, by):
            if not len(i):
                continue
            first = np.flatnonzero(np.diff(i, prepend=-1))
            least = np.minimum.reduceat(d2, first)
            sure = (least + slack <= reach * reach) | (reach == radius)
            found[i[first[sure]]] = True
            n = np.diff(first, append=len(i))
            keep = np.repeat(sure, n) & (d2 <= np.repeat(least, n) + slack)
            out.append((left[i[keep]], j[keep], d2[keep]))
        if reach == radius:
            break
        left, reach = left[~found], min(radius, 2 * reach)
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost pairs (row, column) of all rows, rows <= columns, by shortest augmenting paths with potentials."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[j]:
            used[j] = True
            row = cost[match[j] - 1] - u[match[j]] - v[1:]
            better = ~used[1:] & (row < least[1:])
            least[1:][better], way[1:][better] = row[better], j
            k = int(np.argmin(np.where(used[1:], np.inf, least[1:]))) + 1
            step = least[k]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j = k
        while j:
            match[j], j = match[way[j]], way[j]
    return [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]


def sparse_assignment(row: np.ndarray, column: np.ndarray, cost: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """For each of len(alone) rows the number of its pair (row, column, cost), or -1: pairs that share no row or column, of
    least total cost, where a row without pair costs its alone. Shortest augmenting paths over the rows' lists of pairs;
    memory grows with the pairs. Each row may end in a column of its own, at the cost alone. Ties go to the smaller column."""
    n, m = len(alone), int(column.max(initial=-1)) + 1
    order = np.lexsort((column, row))
    first = np.searchsorted(row[order], np.arange(n + 1)).tolist()
    edges = order.tolist()
    to, price_of, alone = column.tolist(), cost.tolist(), alone.tolist()
    price: dict[int, float] = {}
    owner: dict[int, int] = {}  # of a column: its row
    used = [-1] * n  # of a row: its pair
    for start in range(n):
        best: dict[int, float] = {}
        came: dict[int, tuple[int, int]] = {}  # of a column: the row and pair that it was reached by
        heap: list[tuple[float, int]] = []
        done: list[int] = []
        closed: set[int] = set()
        i, base = start, 0.0  # base: what a pair's cost less its column's price is set off against
        while True:
            for e in (*edges[first[i] : first[i + 1]], -1):
                j, c = (to[e], price_of[e]) if e >= 0 else (m + i, alone[i])
                if j not in closed and (d := base + c - price.get(j, 0.0)) < best.get(j, np.inf):
                    best[j], came[j] = d, (i, e)
                    heapq.heappush(heap, (d, j))
            while True:
                d, j = heapq.heappop(heap)
                if j not in closed and d == best[j]:
                    break
            closed.add(j)
            if j not in owner:
                break
            done.append(j)
            i = owner[j]
            e = used[i]
            base = d - ((price_of[e] if e >= 0 else alone[i]) - price.get(j, 0.0))
        for k in done:
            price[k] = price.get(k, 0.0) + best[k] - d
        while True:
            i, e = came[j]
            before = (to[used[i]] if used[i] >= 0 else m + i) if i != start else None
            owner[j], used[i] = i, e
            if before is None:
                break
            j = before
    return np.array(used, np.int64)


def transport(row: np.ndarray, column: np.ndarray, cost: np.ndarray, alone: np.ndarray, supply: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int]]:
    """(number of a pair, amount): sparse_assignment() where a row stands for supply equal ones and a column for capacity equal
    ones, of least total cost; what a row does not send costs its alone. Augmenting paths carry as much as fits, so that time
    grows with the different rows and not with their copies."""
    return priced_transport(row, column, cost, alone, supply, capacity)[0]


def priced_transport(row: np.ndarray, column: np.ndarray, cost: np.ndarray, alone: np.ndarray, supply: np.ndarray, capacity: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """transport(), with what each row pays at the margin and each column's price (0 or less; 0 where it has places left): no pair costs less than both."""
    n, m = len(alone), len(capacity)
    order = np.lexsort((column, row))
    bounds = np.searchsorted(row[order], np.arange(n + 1))
    # arrays, not lists: 12 bytes a pair
    to, price_of = array("i", column[order].astype(np.int32).tobytes()), array("d", cost[order].astype(float).tobytes())
    first, alone_of, left = bounds.tolist(), alone.tolist(), capacity.tolist()
    price = [0.0] * m
    sent: list[dict[int, int]] = [{} for _ in range(n)]  # of a row: amounts by pair, -1 for those alone
    held: list[dict[int, int]] = [{} for _ in range(m)]  # of a column: its rows and their pairs
    push, pop, inf = heapq.heappush, heapq.heappop, np.inf
    for start in range(n):
        more = int(supply[start])
        while more:
            best: dict[int, float] = {}
            came: dict[int, tuple[int, int]] = {}
            via: dict[int, int] = {start: -1}  # of a row: the pair that it is reached over
            heap: list[tuple[float, int]] = []
            done: list[int] = []
            closed: set[int] = set()
            fresh = [(start, 0.0)]
            end, end_row, limit = inf, -1, inf  # the least that leaving a row alone costs; no path longer than the limit is the shortest
            while True:
                for i, base in fresh:
                    if (d := base + alone_of[i]) < end or (d == end and i < end_row):
                        end, end_row = d, i
                        limit = min(limit, d)
                    e = first[i]
                    for j, c in zip(to[e : first[i + 1]], price_of[e : first[i + 1]], strict=True):
                        d = base + c - price[j]
                        if d <= limit and d < best.get(j, inf) and j not in closed:
                            best[j], came[j] = d, (i, e)
                            push(heap, (d, j))
                            if left[j]:
                                limit = d
                        e += 1
                j = -1
                while heap and heap[0][0] <= end:
                    d, j = pop(heap)
                    if j not in closed and d == best[j]:
                        break
                    j = -1
                if j < 0:
                    d = end
                    break
                closed.add(j)
                if left[j]:
                    break
                done.append(j)
                fresh = []
                for i, e in held[j].items():
                    if i not in via:
                        via[i] = e
                        fresh.append((i, d - (price_of[e] - price[j])))
            i, e = came[j] if j >= 0 else (end_row, -1)
            amount, k = (min(more, left[j]) if j >= 0 else more), i
            while k != start:
                amount = min(amount, sent[k][via[k]])
                k = came[to[via[k]]][0]
            for k in done:
                price[k] += best[k] - d
            if j >= 0:
                left[j] -= amount
            while True:
                sent[i][e] = sent[i].get(e, 0) + amount
                if e >= 0:
                    held[j][i] = e
                if i == start:
                    break
                back = via[i]
                j = to[back]
                sent[i][back] -= amount
                if not sent[i][back]:
                    del sent[i][back], held[j][i]
                i, e = came[j]
            more -= amount
    prices, pays = np.array(price), alone.astype(float)
    np.minimum.at(pays, row, cost - prices[column])
    return sorted((int(order[e]), k) for own in sent for e, k in own.items() if e >= 0), pays, prices


def few_nearest(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, radius: float, few: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d2): of each point i the few nearest points j within the radius; the reach grows as in nearest()."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    left, reach = np.arange(len(ax)), first_reach(bx, by, radius)
    while len(left) and len(bx):
        found = np.zeros(len(left), bool)
        for i, j, d2 in pairs_in_reach(ax[left], ay[left], np.full(len(left), reach), bx, by):
            n = np.bincount(i, minlength=len(left))
            sure = (n >= few) | (reach == radius)
            keep = sure[i]
            i, j, d2 = least_of_each(i[keep], j[keep], d2[keep], few)
            found[i] = True
            out.append((left[i], j, d2))
        if reach == radius:
            break
        left, reach = left[~found], min(radius, 2 * reach)
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def least_of_each(i: np.ndarray, j: np.ndarray, value: np.ndarray, few: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each i the few rows (i, j, value) with the least values."""
    order = np.lexsort((value, i))
    i = i[order]
    keep = order[np.arange(len(i)) - np.searchsorted(i, i) < few]
    i_of = i[np.arange(len(i)) - np.searchsorted(i, i) < few]
    return i_of, j[keep], value[keep]


#: What a pair must save to be one more of transport_in_reach().
SAVES = 1e-9
#: Pairs that would cost little more than they may, by this part of what a row costs alone, come in with those that save: they often do next.
NEARLY = 0.1


def transport_in_reach(near, alone: np.ndarray, supply: np.ndarray, capacity: np.ndarray, adds: np.ndarray, few: int = 8) -> list[tuple[int, int, int, int]]:
    """(row, column, place, amount): transport() over all pairs that near knows, which are never held together.

    A column has a place for each column of adds, with that much added to a pair's cost, and its capacity in each of them.
    near(None, None) gives pairs (row, column, cost) to begin with; near(pays, adds) those with cost + adds[column] < pays[row], in chunks
    that hold a row's pairs side by side. The pairs so far are solved; those left out that cost less than their row pays and their
    column's price, the few of each row that save most, come in, until there are none: then no pair could make the total less."""
    m, places = adds.shape
    margin = NEARLY * float(np.abs(alone).max(initial=0.0))
    chunks = [least_of_each(*c, max(few, 1)) if few else c for c in near(None, None)]
    while True:
        row, column, cost = (np.concatenate([c[k] for c in chunks]) if chunks else np.zeros(0, np.int64 if k < 2 else float) for k in range(3))
        at = np.concatenate([column + k * m for k in range(places)])
        found, pays, prices = priced_transport(np.tile(row, places), at, np.concatenate([cost + adds[column, k] for k in range(places)]), alone, supply, np.tile(capacity, places))
        least = (adds - prices.reshape(places, m).T).min(1)  # what is added to a pair's cost at its column's best place
        known, more = np.sort(row * m + column), []
        saves = False
        for i, j, c in near(pays + margin, least):
            new = known[np.minimum(np.searchsorted(known, i * m + j), len(known) - 1)] != i * m + j if len(known) else np.ones(len(i), bool)
            i, j, c = i[new], j[new], c[new]
            over = c + least[j] - pays[i]
            saves = saves or bool((over < -SAVES).any())
            order = least_of_each(i, np.arange(len(i)), over, few)[1]
            more.append((i[order], j[order], c[order]))
        if not saves:
            return [(int(row[e % len(row)]), int(column[e % len(row)]), e // len(row), amount) for e, amount in found]
        chunks = [(row, column, cost), *more]


def best_families(parent: np.ndarray, child: np.ndarray, link: np.ndarray, divide: np.ndarray, start: np.ndarray, end: np.ndarray, division: float) -> tuple[list[tuple[int, bool]], float]:
    """The consistent set of hypotheses of least cost: pairs (number of the pair, whether it is one of a division), and the cost.

    A child starts by itself, at its start, or has one parent; a parent ends, at its end, or goes on in one child (link), or in
    two (the divide of both, and division). Costs may be infinite. Each parent is first given two places for children, each at no
    more than it costs in either way, which an assignment fills; where it fills them as no parent can, both ways are
    followed, the cheaper bound first, as long as the bound is below the best set so far. The result is exact. Where link and
    divide are equal the first assignment is the answer; the further they differ, the more is followed."""
    n, m = len(start), len(end)
    one, also, two = link - end[parent], divide - end[parent], divide + division
    big = 1 + 4 * (np.abs(np.concatenate([x[np.isfinite(x)] for x in (one, also, two, start)])).sum() if n else 0)

    def solved(mode: np.ndarray):
        """Lower bound for parents of modes free (0), one child or none (1), two children (2); the pairs used, by place."""
        own = mode[parent]
        first = np.select([own == 0, own == 1], [np.minimum(one, also), one], also - big)
        second = np.select([own == 0, own == 1], [two, np.full(len(two), np.inf)], two - big)
        cost = np.concatenate([first, second])
        open_ = np.flatnonzero(np.isfinite(cost))
        at = open_ % max(len(parent), 1)
        used = sparse_assignment(child[at], parent[at] + m * (open_ >= len(parent)), cost[open_], start)
        used = [int(open_[e]) for e in used if e >= 0]
        free = np.ones(n, bool)
        free[[child[e % len(parent)] for e in used]] = False
        bound = float(sum(cost[e] + (big if own[e % len(parent)] == 2 else 0) for e in used) + start[free].sum() + end.sum())
        families: dict[int, list[int]] = {}
        for e in sorted(used):
            families.setdefault(int(parent[e % len(parent)]), []).append(e % len(parent))
        return bound, families

    best, found, todo, ticket = np.inf, [], [], 0

    def add(mode: np.ndarray) -> None:
        nonlocal best, found, ticket
        bound, families = solved(mode)
        if any(len(families.get(int(p), ())) < 2 for p in np.flatnonzero(mode == 2)):
            return  # no two children for a parent that must have them
        odd, pairs, total = [], [], float(end.sum() + start.sum())
        for p, es in families.items():
            if mode[p] == 0 and (also[es[0]] < one[es[0]] if len(es) == 1 else any(also[e] > one[e] for e in es)):
                odd.append(p)
            ways = [([(e, False)], one[e] - start[child[e]]) for e in es]
            if len(es) == 2:
                ways.append(([(e, True) for e in es], also[es[0]] + two[es[1]] - start[child[es]].sum()))
            way = min(ways, key=lambda w: w[1])
            if way[1] < 0:
                pairs += way[0]
                total += way[1]
        if total < best:
            best, found = total, pairs
        if odd and bound < best - 1e-9:
            ticket += 1
            heapq.heappush(todo, (bound, ticket, mode, odd[0]))

    add(np.zeros(m, np.int8))
    while todo:
        bound, _, mode, p = heapq.heappop(todo)
        if bound >= best - 1e-9:
            break
        for way in (1, 2):
            after = mode.copy()
            after[p] = way
            add(after)
    return found, best
