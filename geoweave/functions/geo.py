"""Geometry on the sphere and on small planes as Column expressions: no Python code runs per row, so code generation applies.

Points are (lat, lon) degrees. Lines and rings are ARRAY<STRUCT<lon, lat>>. Distances are metres.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radius of all distances, and metres of a degree of the planar edge weights.
EARTH_RADIUS_M = 6_371_000.0
PLANAR_M_PER_DEGREE = 111_320.0
METRES_PER_DEGREE = EARTH_RADIUS_M * 3.141592653589793 / 180

COORDS = "array<struct<lon:double,lat:double>>"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x)) if isinstance(x, (int, float)) else F.col(x)


def let(value: Column, use) -> Column:
    """Evaluate value once and use it several times in an expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def is_finite(x) -> Column:
    x = _c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """G1: great-circle distance."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    u, v = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def wrap_lon_delta(d) -> Column:
    """A difference of longitudes in [-180, 180]; values that aren't finite pass through."""
    d = _c(d)
    return F.when(d > 180, d - 360 * F.ceil((d - 180) / 360)).when(d < -180, d + 360 * F.ceil((-180 - d) / 360)).otherwise(d)


def plane_x(lat0, lon0, lon) -> Column:
    """Metres east of (lat0, lon0) on the plane that touches there."""
    return F.radians(wrap_lon_delta(_c(lon) - _c(lon0))) * F.cos(F.radians(_c(lat0))) * EARTH_RADIUS_M


def plane_y(lat0, lat) -> Column:
    return F.radians(_c(lat) - _c(lat0)) * EARTH_RADIUS_M


def snap(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """The nearest point of a segment: STRUCT<distance_m, t, lat, lon>; t is 0 on a segment without length."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    ends = F.struct(plane_x(lat, lon, lon1).alias("x"), plane_y(lat, lat1).alias("y"), plane_x(lat, lon, lon2).alias("u"), plane_y(lat, lat2).alias("v"))

    def place(e):
        dx, dy = e.u - e.x, e.v - e.y
        size = dx * dx + dy * dy
        t = F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(e.x * dx + e.y * dy) / size)))
        return F.struct(e.x.alias("x"), e.y.alias("y"), dx.alias("dx"), dy.alias("dy"), t.alias("t"))

    def result(p):
        x, y = p.x + p.t * p.dx, p.y + p.t * p.dy
        return F.struct(F.sqrt(x * x + y * y).alias("distance_m"), p.t.alias("t"), (lat1 + p.t * (lat2 - lat1)).alias("lat"), (lon1 + p.t * (lon2 - lon1)).alias("lon"))

    return let(let(ends, place), result)


def segment_distance_m(lat, lon, cos_lat, lat1, lon1, lat2, lon2) -> Column:
    """The distance of G4 alone, bit for bit, for the inner loop of joins: no lambdas, and the cosine of the query's latitude is given."""
    lat, lon, cos_lat, lat1, lon1, lat2, lon2 = map(_c, (lat, lon, cos_lat, lat1, lon1, lat2, lon2))
    x_of, y_of = lambda o: F.radians(wrap_lon_delta(o - lon)) * cos_lat * EARTH_RADIUS_M, lambda a: plane_y(lat, a)
    ax, ay = x_of(lon1), y_of(lat1)
    dx, dy = x_of(lon2) - ax, y_of(lat2) - ay
    size = dx * dx + dy * dy
    t = F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / size)))
    x, y = ax + t * dx, ay + t * dy
    return F.sqrt(x * x + y * y)


def edges(coords) -> Column:
    """Consecutive pairs of a line: ARRAY<STRUCT<i, a, b>>; empty for fewer than two points."""
    coords = _c(coords)
    pairs = F.zip_with(F.slice(coords, 1, F.size(coords) - 1), F.slice(coords, 2, F.size(coords) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    whole = F.transform(pairs, lambda e, i: F.struct(i.alias("i"), e.a.alias("a"), e.b.alias("b")))
    return F.when(F.size(coords) >= 2, whole).otherwise(F.filter(F.transform(coords, lambda p: F.struct(F.lit(0).alias("i"), p.alias("a"), p.alias("b"))), lambda e: F.lit(False)))


def closed(coords) -> Column:
    """A ring with its first point again at its end."""
    coords = _c(coords)
    return F.when(F.size(coords) < 2, coords).when(F.element_at(coords, 1) == F.element_at(coords, -1), coords).otherwise(F.concat(coords, F.slice(coords, 1, 1)))


def line_snap(lat, lon, coords) -> Column:
    """Nearest point of a line: STRUCT<distance_m, segment, t, lat, lon>, the first of equals; NULL for under two points or no finite
    distance."""

    def one(e):
        s = snap(lat, lon, e.a.lat, e.a.lon, e.b.lat, e.b.lon)
        return let(s, lambda s: F.struct(s.distance_m.alias("distance_m"), e.i.alias("segment"), s.t.alias("t"), s.lat.alias("lat"), s.lon.alias("lon")))

    return F.array_min(F.filter(F.transform(edges(coords), one), lambda s: is_finite(s.distance_m)))


def ring_distance_m(lat, lon, coords) -> Column:
    """Distance to a ring's border, closing edge included."""
    return line_snap(lat, lon, closed(coords)).distance_m


def in_ring(lat, lon, coords) -> Column:
    """Even-odd containment in degrees; false for fewer than three points."""
    lat, lon, coords = _c(lat), _c(lon), _c(coords)

    def crosses(e):
        spans = (e.a.lat > lat) != (e.b.lat > lat)
        return spans & (lon < (e.b.lon - e.a.lon) * (lat - e.a.lat) / F.when(spans, e.b.lat - e.a.lat) + e.a.lon)

    hits = F.size(F.filter(edges(F.concat(coords, F.slice(coords, 1, 1))), crosses))
    return F.coalesce((F.size(coords) >= 3) & (hits % 2 == 1), F.lit(False))


def crossing(a, b, c, d) -> Column:
    """How far along a-b the segment c-d crosses it; NULL if it doesn't or they are parallel. Points are structs (lon, lat)."""
    rx, ry, sx, sy = b.lon - a.lon, b.lat - a.lat, d.lon - c.lon, d.lat - c.lat
    det = rx * sy - ry * sx
    det = F.when((det != 0) & is_finite(det), det)
    px, py = c.lon - a.lon, c.lat - a.lat
    t, u = (px * sy - py * sx) / det, (px * ry - py * rx) / det
    return F.when(t.between(0, 1) & u.between(0, 1), t)


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial great-circle bearing in [0, 360)."""
    a, b, d = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lon2) - _c(lon1))
    y, x = F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def bearing_gap(a, b) -> Column:
    """Smallest angle between bearings, 0 to 180."""
    d = F.pmod(_c(a) - _c(b), F.lit(360.0))
    return F.least(d, 360 - d)


def bearing_turn(start, end) -> Column:
    """Signed turn from one bearing to another in (-180, 180]."""
    d = F.pmod(_c(end) - _c(start), F.lit(360.0))
    return F.when(d > 180, d - 360).otherwise(d)


def centroid(coords) -> Column:
    """Mean of the vertices as STRUCT<lat, lon>; (0, 0) for none."""
    coords = _c(coords)
    mean = lambda f: F.when(F.size(coords) > 0, F.aggregate(coords, F.lit(0.0), lambda s, p: s + f(p)) / F.size(coords)).otherwise(0.0)
    return F.struct(mean(lambda p: p.lat).alias("lat"), mean(lambda p: p.lon).alias("lon"))


def cumulative_m(coords) -> Column:
    """Metres from the start at each vertex."""
    steps = F.transform(edges(coords), lambda e: haversine_m(e.a.lat, e.a.lon, e.b.lat, e.b.lon))
    return F.aggregate(steps, F.array(F.lit(0.0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))


def heading_at(lat, lon, coords) -> Column:
    """Heading of the line at the vertex nearest a point: of the edge that leaves it, or for the last vertex the one that enters."""
    coords = _c(coords)
    near = F.array_min(F.transform(coords, lambda p, i: F.struct(haversine_m(lat, lon, p.lat, p.lon).alias("d"), i.alias("i")))).i
    at = F.least(near, F.size(coords) - 2)
    return F.when(F.size(coords) >= 2, let(F.struct(F.get(coords, at).alias("a"), F.get(coords, at + 1).alias("b")), lambda e: bearing(e.a.lat, e.a.lon, e.b.lat, e.b.lon)))


def round_half_away(x) -> Column:
    """Whole numbers, halves away from zero."""
    return F.signum(_c(x)) * F.floor(F.abs(_c(x)) + 0.5)


def box_ring(lat0, lon0, lat1, lon1) -> Column:
    """A rectangle as a ring of four vertices."""
    lat0, lon0, lat1, lon1 = map(_c, (lat0, lon0, lat1, lon1))
    p = lambda lat, lon: F.struct(lon.alias("lon"), lat.alias("lat"))
    return F.array(p(lat0, lon0), p(lat0, lon1), p(lat1, lon1), p(lat1, lon0))
