"""The inner loop of distance joins: one call a tile over its queries and the features in reach of it, as numpy arrays.

A feature is dealt to the few tiles that its reach touches, so the shuffle carries hardly more than the tables. Inside a tile a finer grid,
as fine as the tile is dense, says which features a query looks at; a search for the nearest widens that grid only for the queries that have
found nothing. Every distance is the formula of functions.geo on the pair itself; the grid only leaves out what lies beyond the radius.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute

RADIUS_M = 6_371_000.0
PER_DEGREE = RADIUS_M * 3.141592653589793 / 180
#: Rows of (feature, grid row), pairs and edges that are looked at together.
ROWS, PAIRS = 200_000, 1_000_000
#: Pairs that are measured in one go, so that they stay in the cache.
BLOCK = 8192


def wrapped(d: np.ndarray) -> np.ndarray:
    """geo.wrap_lon_delta."""
    if len(d) and np.abs(d).max() > 180:
        return np.where(d > 180, d - 360 * np.ceil((d - 180) / 360), np.where(d < -180, d + 360 * np.ceil((-180 - d) / 360), d))
    return d


def haversine_m(lat1, lon1, lat2, lon2) -> np.ndarray:
    """geo.haversine_m."""
    u, v = np.sin(np.radians(lat2 - lat1) / 2), np.sin(np.radians(lon2 - lon1) / 2)
    h = u * u + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * v * v
    return 2 * RADIUS_M * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


def segment_m(lat, lon, cos, lat1, lon1, lat2, lon2) -> np.ndarray:
    """geo.segment_distance_m."""
    ax, ay = np.radians(wrapped(lon1 - lon)) * cos * RADIUS_M, np.radians(lat1 - lat) * RADIUS_M
    dx, dy = np.radians(wrapped(lon2 - lon)) * cos * RADIUS_M - ax, np.radians(lat2 - lat) * RADIUS_M - ay
    size = dx * dx + dy * dy
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(size == 0, 0.0, np.maximum(0.0, np.minimum(1.0, -(ax * dx + ay * dy) / size)))
    x, y = ax + t * dx, ay + t * dy
    return np.sqrt(x * x + y * y)


def spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row k n[k] times over: which row it is, and first[k], first[k] + 1, ..."""
    k = np.repeat(np.arange(len(n)), n)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + first[k]


def chunks(n: np.ndarray, most: int):
    """Slices of rows whose n sum up to about `most`."""
    ends, at = np.cumsum(n), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


class Tile:
    """Queries (degrees), and features as segments (lat1, lon1, lat2, lon2) or, with `boxes`, as boxes of these corners."""

    def __init__(self, lat, lon, ends, boxes: bool = False, reach_m: float = 0.0):
        self.lat, self.lon, self.cos, self.ends, self.boxes = lat, lon, np.cos(np.radians(lat)), ends, boxes
        top = np.abs(lat).max() + 1.02 * reach_m / PER_DEGREE
        #: near a pole or over a good part of the Earth all pairs are looked at
        self.whole = top > 88 or reach_m > 300_000 or not len(ends[0])
        if not self.whole:
            k, lon0 = np.cos(np.radians(top)) * PER_DEGREE, lon[0]
            self.x, self.y = wrapped(lon - lon0) * k, lat * PER_DEGREE
            x1 = wrapped(ends[1] - lon0) * k
            self.f = (x1, ends[0] * PER_DEGREE, x1 + wrapped(ends[3] - ends[1]) * k, ends[2] * PER_DEGREE)
            self.whole = np.ptp(self.x) > 5e6
            area = max(1.0, np.ptp(self.x) * np.ptp(self.y))
            long = np.hypot(self.f[2] - self.f[0], self.f[3] - self.f[1]).mean() + np.sqrt(area / len(x1))
            #: as many cells as queries, and features in nearly each
            self.fine = max(1.0, np.sqrt(area / len(lat)), 4 * area / (len(x1) * long))

    def pairs(self, of: np.ndarray, m: float):
        """Blocks (query, feature) with every pair, each once, of the queries `of` and the features within m metres of them."""
        if self.whole:
            n = len(self.ends[0])
            for s in chunks(np.full(len(of), n), PAIRS) if n else ():
                yield np.repeat(of[s], n), np.tile(np.arange(n), s.stop - s.start)
            return
        c, m = max(m, self.fine), 1.01 * m + 0.01
        x, y = self.x[of], self.y[of]
        ox, oy = x.min(), y.min()
        rows, columns = int(np.ptp(y) // c) + 1, int(np.ptp(x) // c) + 1
        if rows * columns > 4 * len(of) + 1000:  # a few queries far apart
            c *= np.sqrt(rows * columns / (4 * len(of) + 1000))
            rows, columns = int(np.ptp(y) // c) + 1, int(np.ptp(x) // c) + 1
        at = np.minimum((y - oy) // c, rows - 1).astype(np.int64) * columns + np.minimum((x - ox) // c, columns - 1).astype(np.int64)
        order = np.argsort(at, kind="stable")
        held = np.bincount(at, minlength=rows * columns)
        starts, sorted_of = np.cumsum(held) - held, of[order]
        x1, y1, x2, y2 = self.f
        first = np.clip((np.minimum(y1, y2) - m - oy) // c, 0, rows).astype(np.int64)
        last = np.clip((np.maximum(y1, y2) + m - oy) // c, -1, rows - 1).astype(np.int64)
        side = (np.maximum(x1, x2) + m >= ox) & (np.minimum(x1, x2) - m <= ox + columns * c)
        near = np.flatnonzero((last >= first) & side)
        for s in chunks((last - first + 1)[near], ROWS):
            k, row = spread(first[near[s]], (last - first + 1)[near[s]])
            k = near[s][k]
            a, b = x1[k], x2[k]
            if not self.boxes:  # the part of the segment in the row and m around it
                dy = y2[k] - y1[k]
                low = oy + row * c - m - y1[k]
                with np.errstate(divide="ignore", invalid="ignore"):
                    t, u = low / dy, (low + c + 2 * m) / dy
                flat = np.abs(dy) < 1e-6
                t, u = np.where(flat, 0.0, np.clip(t, 0, 1)), np.where(flat, 1.0, np.clip(u, 0, 1))
                a, b = x1[k] + t * (x2[k] - x1[k]), x1[k] + u * (x2[k] - x1[k])
            c0 = np.clip((np.minimum(a, b) - m - ox) // c, 0, columns).astype(np.int64)
            c1 = np.clip((np.maximum(a, b) + m - ox) // c, -1, columns - 1).astype(np.int64)
            n = np.maximum(c1 - c0 + 1, 0)
            for z in chunks(n, PAIRS):
                j, column = spread(c0[z], n[z])
                cells = row[z][j] * columns + column
                full = held[cells] > 0
                cells, f = cells[full], k[z][j[full]]
                for w in chunks(held[cells], PAIRS):
                    i, place = spread(starts[cells[w]], held[cells[w]])
                    yield sorted_of[place], f[w][i]

    def near_by(self, q, f, m: float):
        """Of pairs, those that may be within m, where that is cheaper to say than the distance."""
        return q, f

    def radii(self, most_m: float) -> list[float]:
        if self.whole:
            return [most_m]
        out, r = [], self.fine / 2
        while 2 * r < most_m:
            out.append(r)
            r *= 4
        return [*out, most_m]

    def nearest(self, measure, most_m: float, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query the feature of least measure within most_m, the first of equals (-1: none), and the measure."""
        best, which = np.full(len(self.lat), np.inf), np.full(len(self.lat), len(self.ends[0]))
        left = np.arange(len(self.lat)) if of is None else of
        for r in self.radii(most_m):
            if not len(left):
                break
            for q, f in self.pairs(left, r):
                d = measure(q, f)
                ok = d <= r
                least(best, which, q[ok], f[ok], d[ok])
            left = left[which[left] == len(self.ends[0])]
        return np.where(which == len(self.ends[0]), -1, which), best

    def within(self, measure, m: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs within m: queries, features, measures."""
        out = []
        for q, f in self.pairs(np.arange(len(self.lat)), m):
            q, f = self.near_by(q, f, m)
            d = measure(q, f)
            ok = d <= m
            out.append((q[ok], f[ok], d[ok]))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip((none, none, np.zeros(0)), *out))


def least(best: np.ndarray, which: np.ndarray, q: np.ndarray, f: np.ndarray, d: np.ndarray) -> None:
    """Take the least d of each query into best and its f into which; the least f of equals."""
    before = best[q]
    np.minimum.at(best, q, d)
    now = best[q]
    which[q[now < before]] = np.iinfo(which.dtype).max
    same = d == now
    np.minimum.at(which, q[same], f[same])


def by_path(path: np.ndarray, queries: int, most: int = 4_000_000, features: int = 20_000):
    """Slices of features sorted by path, whole paths each, so that paths times queries stays bounded where a path alone allows it."""
    starts = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
    ends = np.r_[starts[1:], len(path)]
    step, at = max(1, min(features, most // max(1, queries))), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + step, "right")))
        yield slice(starts[at], ends[to - 1])
        at = to


def may_stop(path, along, power, usable, ahead_m: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the candidates that ev.choose_stops can pick on their paths, in any order; others may be among them. A pick has the
    greatest power of those between usable / 2 (or ahead_m) and usable metres ahead, so it is none that has greater ones before and after
    it closer together than that window; or it is the last before a gap of usable / 2, and this holds for whatever part of a path is seen. Beside the positions: which of the two each may be."""
    order = np.lexsort((along, path))
    path, along, power, usable = path[order], along[order], power[order], usable[order]
    n = len(path)
    if not n:
        return order, np.zeros(0, bool), np.zeros(0, bool)
    sure = 1 - 1e-9
    # the next place farther along the path
    new = np.r_[True, (path[1:] != path[:-1]) | (along[1:] != along[:-1])]
    starts, group = np.flatnonzero(new), np.cumsum(new) - 1
    after = np.r_[starts[1:], n][group]
    ends = (after == n) | (path[np.minimum(after, n - 1)] != path)
    gap = np.where(ends, np.inf, along[np.minimum(after, n - 1)] - along)
    last = (gap >= usable / 2 * sure - 1e-6) & (along > ahead_m * sure - 1e-6)
    # greater power to the left and right, by steps of powers of two: tops[k][i] is the greatest of 2^k rows from i on
    tops = [power]
    while 2 << len(tops) - 1 <= n:
        half = 1 << len(tops) - 1
        tops.append(np.maximum(tops[-1][:-half], tops[-1][half:]))
    left, right = np.arange(n), np.arange(n) + 1  # rows left..i and i..right - 1 have no greater power
    for k in range(len(tops) - 1, -1, -1):
        step, m = 1 << k, tops[k]
        ok = (left >= step) & (m[np.maximum(left - step, 0)] <= power)
        left = np.where(ok, left - step, left)
        ok = (right + step <= n) & (m[np.minimum(right, len(m) - 1)] <= power)
        right = np.where(ok, right + step, right)
    before, behind = np.maximum(left - 1, 0), np.minimum(right, n - 1)
    open_ = (left == 0) | (right == n) | (path[before] != path) | (path[behind] != path)
    window = np.minimum(usable / 2, usable - ahead_m)
    far = (open_ | (along[behind] - along[before] >= window * sure - 1e-6)) & (along > np.maximum(usable / 2, ahead_m) * sure - 1e-6)
    kept = last | far
    return order[kept], far[kept], last[kept]


def _tops(of, rows, *keys) -> np.ndarray:
    """Of rows (by `of`), those of each `of` with the greatest first key, of these the greatest second, and so on; one of equals."""
    for key in (*keys, np.arange(len(of))):
        if len(rows):
            starts = np.flatnonzero(np.r_[True, of[rows][1:] != of[rows][:-1]])
            k = key[rows]
            rows = rows[k == np.repeat(np.maximum.reduceat(k, starts), np.diff(np.r_[starts, len(rows)]))]
    return rows


def stops(of, along, power, best, last, usable, route, ahead_m: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """ev.choose_stops for many trips at once. Candidates come by trip (whole numbers `of`), each a place: its metres along the trip, greatest
    power, the greatest id of those with that power and the greatest of all, and the usable metres and route_m of its trip. The rows of the
    stops, and whether each was chosen by power, so that the first of its ids counts."""
    out, rows = [(np.zeros(0, np.int64), np.zeros(0, bool))], np.arange(len(of))
    new = np.r_[True, of[1:] != of[:-1]] if len(of) else np.zeros(0, bool)
    trip = np.cumsum(new) - 1
    usable, route = usable[new], route[new]
    at = np.zeros(len(usable))
    for _ in range(most + 1):
        # of trips that go on, what lies far enough ahead
        t = trip[rows]
        rows = rows[(route > at + usable)[t] & (along[rows] > (at + ahead_m)[t])]
        t = trip[rows]
        ahead = rows[along[rows] <= (at + usable)[t]]
        if not len(ahead):
            break
        far = along[ahead] >= (at + usable / 2)[trip[ahead]]
        by_power = np.zeros(len(at), bool)
        by_power[trip[ahead[far]]] = True
        a = _tops(trip, ahead[far], power, along, best)
        b = _tops(trip, ahead[~by_power[trip[ahead]]], along, last)
        out += [(a, np.ones(len(a), bool)), (b, np.zeros(len(b), bool))]
        stop = np.concatenate([a, b])
        moved = np.full(len(at), np.inf)  # a trip without a place ahead ends
        moved[trip[stop]] = along[stop]
        at = moved
    return tuple(np.concatenate(x) for x in zip(*out))


def first_apart(held, other, n: int, m: int, q, p) -> np.ndarray:
    """Of pairs q (below n) and p (below m), the first area that holds q and not p (-1: none). held, other: pairs of a q and an area, a p and
    an area, by area. Areas are compared 64 at a time, as the bits of a word of each q and each p, for the pairs that have found none."""
    first, left = np.full(len(q), -1), np.flatnonzero(np.bincount(held[0], minlength=n)[q] > 0)
    areas = np.unique(held[1])
    for at in range(0, len(areas), 64):
        if not len(left):
            break
        some, words = areas[at : at + 64], []
        for (of, area), size in ((held, n), (other, m)):
            word = np.zeros(size, np.uint64)
            for b, (x, y) in enumerate(zip(np.searchsorted(area, some), np.searchsorted(area, some, "right"))):
                word[of[x:y]] |= np.uint64(1 << b)
            words.append(word)
        apart = words[0][q[left]] & ~words[1][p[left]]
        hit = apart != 0
        apart = apart[hit]
        first[left[hit]] = some[np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1))]
        left = left[~hit]
    return first


class Points(Tile):
    def __init__(self, lat, lon, p_lat, p_lon, reach_m: float):
        super().__init__(lat, lon, (p_lat, p_lon, p_lat, p_lon), reach_m=reach_m)

    def near_by(self, q, f, m: float):
        if self.whole:
            return q, f
        dx, dy = self.x[q] - self.f[0][f], self.y[q] - self.f[1][f]  # on the plane of the tile, where nothing is farther than in truth
        ok = dx * dx + dy * dy <= (1.01 * m + 0.01) ** 2
        return q[ok], f[ok]

    def measure(self, q, f):
        return haversine_m(self.lat[q], self.lon[q], self.ends[0][f], self.ends[1][f])


class Segments(Tile):
    def __init__(self, lat, lon, ends, reach_m: float):
        super().__init__(lat, lon, ends, reach_m=reach_m)

    def measure(self, q, f):
        out = np.empty(len(q))
        for at in range(0, len(q), BLOCK):
            i, j = q[at : at + BLOCK], f[at : at + BLOCK]
            out[at : at + BLOCK] = segment_m(self.lat[i], self.lon[i], self.cos[i], *(e[j] for e in self.ends))
        return out

    def along(self, q, f):
        """Metres from the start of the segment to the place on it nearest the query (geo.snap)."""
        lat, lon, cos, (lat1, lon1, lat2, lon2) = self.lat[q], self.lon[q], self.cos[q], (e[f] for e in self.ends)
        ax, ay = np.radians(wrapped(lon1 - lon)) * cos * RADIUS_M, np.radians(lat1 - lat) * RADIUS_M
        dx, dy = np.radians(wrapped(lon2 - lon)) * cos * RADIUS_M - ax, np.radians(lat2 - lat) * RADIUS_M - ay
        size = dx * dx + dy * dy
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(size == 0, 0.0, np.maximum(0.0, np.minimum(1.0, -(ax * dx + ay * dy) / size)))
        return haversine_m(lat1, lon1, lat1 + t * (lat2 - lat1), lon1 + t * (lon2 - lon1))


class Rings(Tile):
    """Areas by their rings: a column ARRAY<STRUCT<lon, lat>>."""

    def __init__(self, lat, lon, coords: pa.ListArray, corners, reach_m: float):
        super().__init__(lat, lon, corners, boxes=True, reach_m=reach_m)
        flat, offsets = coords.values, coords.offsets.to_numpy()
        self.r_lon, self.r_lat = (flat.field(n).to_numpy(zero_copy_only=False).astype(float) for n in ("lon", "lat"))
        self.first, self.n = offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)

    def _edges(self, q, f):
        """Blocks of pairs with their edges, closing ones too: the slice of pairs, where each begins, and both ends."""
        for s in chunks(self.n[f], PAIRS):
            n = self.n[f[s]]
            k, at = spread(self.first[f[s]], n)
            last = self.first[f[s]][k] + n[k] - 1
            to = np.where(at == last, self.first[f[s]][k], at + 1)
            yield s, np.cumsum(n) - n, q[s][k], self.r_lat[at], self.r_lon[at], self.r_lat[to], self.r_lon[to]

    def inside(self, q, f):
        """Whether the areas hold the queries."""
        out = np.zeros(len(q), bool)
        for s, begins, i, a_lat, a_lon, b_lat, b_lon in self._edges(q, f):
            lat, lon = self.lat[i], self.lon[i]
            spans = (a_lat > lat) != (b_lat > lat)
            with np.errstate(divide="ignore", invalid="ignore"):
                hits = spans & (lon < (b_lon - a_lon) * (lat - a_lat) / np.where(spans, b_lat - a_lat, 1.0) + a_lon)
            out[s] = (np.add.reduceat(hits, begins, dtype=np.int64) % 2 == 1) & (self.n[f[s]] >= 3)
        return out

    def measure(self, q, f):
        """To the border."""
        out = np.full(len(q), np.inf)
        for s, begins, i, *ends in self._edges(q, f):
            d = segment_m(self.lat[i], self.lon[i], self.cos[i], *ends)
            out[s] = np.minimum.reduceat(np.where(np.isfinite(d), d, np.inf), begins)
        return out

    def edges(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """All edges that have a place, closing ones too: the area of each, and its ends."""
        f, at = spread(self.first, self.n)
        to = np.where(at == (self.first + self.n - 1)[f], self.first[f], at + 1)
        ends = [self.r_lat[at], self.r_lon[at], self.r_lat[to], self.r_lon[to]]
        real = np.isfinite(ends).all(0)
        return f[real], [e[real] for e in ends]

    def blocking(self, points: Rings, q, p, top, height, m: float) -> np.ndarray:
        """For pairs of a query and a point (a query of `points`, over the same areas) within m of it, the area that blocks the line between:
        the first that holds the query and not the point, else the first that the line crosses below its top (-1: none)."""
        first = first_apart(self.held(), points.held(), len(self.lat), len(points.lat), q, p)
        left = np.flatnonzero(first < 0)
        if len(left):
            first[left] = self.crossing(points.lat[p[left]], points.lon[p[left]], q[left], top, height, m)
        return first

    def held(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs where the area holds the query, by area."""
        none = np.zeros(0, np.int64)
        q, f = (np.concatenate(x) for x in zip((none, none), *self.holding()))
        by = np.argsort(f, kind="stable")
        return q[by], f[by]

    def crossing(self, from_lat, from_lon, q, top, height, m: float) -> np.ndarray:
        """The first area that the line to a query from a point within m of it crosses below its top (-1: none); height(t): of the line, a
        fraction t of the way (geo.crossing). Only the edges in reach of the query are looked at."""
        none = np.iinfo(np.int64).max
        cuts = np.full(len(q), none)
        area, ends = self.edges()
        to_lat, to_lon = self.lat[q], self.lon[q]
        for i, e in Segments(to_lat, to_lon, ends, m).pairs(np.arange(len(q)), m):
            a_lat, a_lon, b_lat, b_lon = (c[e] for c in ends)
            rx, ry, sx, sy = to_lon[i] - from_lon[i], to_lat[i] - from_lat[i], b_lon - a_lon, b_lat - a_lat
            px, py, det = a_lon - from_lon[i], a_lat - from_lat[i], rx * sy - ry * sx
            with np.errstate(divide="ignore", invalid="ignore"):
                t, u = (px * sy - py * sx) / det, (px * ry - py * rx) / det
                hits = (det != 0) & np.isfinite(det) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1) & (top[area[e]] > height(t))
            np.minimum.at(cuts, i[hits], area[e[hits]])
        return np.where(cuts < none, cuts, -1)

    def holding(self):
        """Blocks of all pairs where the area holds the query."""
        for q, f in self.pairs(np.arange(len(self.lat)), 0.0):
            lat, lon = self.lat[q], self.lon[q]
            ok = (lat >= self.ends[0][f]) & (lat <= self.ends[2][f])
            if not self.whole:
                ok &= (self.x[q] >= self.f[0][f] - 0.01) & (self.x[q] <= self.f[2][f] + 0.01)
            q, f = q[ok], f[ok]
            ok = self.inside(q, f)
            yield q[ok], f[ok]

    def best(self, most_m: float, deepest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query the area that holds it (the first, or the one whose border is farthest), else the one with the nearest border:
        area (-1: none), metres to its border, inside."""
        rank, which = np.full(len(self.lat), np.inf), np.full(len(self.lat), np.iinfo(np.int64).max)
        for q, f in self.holding():
            least(rank, which, q, f, -self.measure(q, f) if deepest else np.zeros(len(q)))
        held = rank < np.inf
        near, far = self.nearest(self.measure, most_m, np.flatnonzero(~held))
        which = np.where(held, which, near)
        depth = np.where(held, 0.0, far)
        at = np.flatnonzero(held)
        depth[at] = -rank[at] if deepest else self.measure(at, which[at])
        return which, depth, held

    def near(self, m: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All pairs where the area holds the query or its border is within m: queries, areas, metres to the border, inside."""
        none = np.zeros(0, np.int64)
        out = [(none, none, np.zeros(0), np.zeros(0, bool))]
        for q, f in self.pairs(np.arange(len(self.lat)), m):
            inside, d = self.inside(q, f), self.measure(q, f)
            ok = inside | (d <= m)
            out.append((q[ok], f[ok], d[ok], inside[ok]))
        return tuple(np.concatenate(x) for x in zip(*out))


def doubles(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(n).to_numpy() for n in names]


def order(t: pa.Table, *names: str) -> np.ndarray:
    """Positions in the order that breaks ties."""
    return pa.compute.sort_indices(t, [(n, "ascending") for n in names]).to_numpy().astype(np.int64)


def places(t: pa.Table, name: str) -> np.ndarray:
    """Numbers that sort as the column does."""
    return t.column(name).to_numpy() if pa.types.is_integer(t.column(name).type) else pa.compute.rank(t.column(name), tiebreaker="dense").to_numpy()
