import math
import random

import pytest
from pyspark.sql import functions as F

from geoweave.functions import geo, text
from geoweave.operators import knn, lookup, scoring, search, visibility


def hav(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).head()


def line(*points):
    return F.array(*(F.struct(F.lit(float(lon)).alias("lon"), F.lit(float(lat)).alias("lat")) for lon, lat in points))


def test_scalars(spark):
    r = one(spark, geo.haversine_m(36.0, -86.0, 36.1, -86.2), geo.haversine_m(36.1, -86.2, 36.0, -86.0), geo.wrap_lon_delta(359.8), geo.wrap_lon_delta(-540.0), geo.wrap_lon_delta(float("nan")), geo.bearing(0.0, 0.0, 0.0, 1.0), geo.bearing_gap(350, 10), geo.bearing_turn(350.0, 10.0), geo.bearing_turn(0.0, 180.0), geo.round_half_away(-2.5), geo.round_half_away(2.5))
    assert r.c0 == pytest.approx(hav(36, -86, 36.1, -86.2)) and r.c0 == pytest.approx(r.c1)
    assert r.c2 == pytest.approx(-0.2) and abs(r.c3) == 180 and math.isnan(r.c4)
    assert r.c5 == pytest.approx(90) and r.c6 == pytest.approx(20) and r.c7 == pytest.approx(20) and r.c8 == 180 and (r.c9, r.c10) == (-3, 3)


def test_lines_and_rings(spark):
    ring = line((0, 0), (0, 0.01), (0.01, 0.01), (0.01, 0))
    r = one(spark, geo.line_snap(F.lit(0.001), F.lit(0.005), line((0, 0), (0.01, 0))), geo.line_snap(F.lit(0.0), F.lit(0.0), line((1, 1))), geo.in_ring(F.lit(0.005), F.lit(0.005), ring), geo.in_ring(F.lit(0.02), F.lit(0.005), ring), geo.in_ring(F.lit(0.0), F.lit(0.0), line((0, 0), (1, 1))), geo.ring_distance_m(F.lit(-0.001), F.lit(0.005), ring), geo.snap(0.0, 179.999, 0.0, 179.9995, 0.0, -179.9995).distance_m, geo.crossing(F.struct(F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat")), F.struct(F.lit(2.0).alias("lon"), F.lit(0.0).alias("lat")), F.struct(F.lit(1.0).alias("lon"), F.lit(-1.0).alias("lat")), F.struct(F.lit(1.0).alias("lon"), F.lit(1.0).alias("lat"))), geo.snap(1.0, 1.0, 2.0, 2.0, 2.0, 2.0).t, geo.centroid(ring), geo.cumulative_m(line((0, 0), (0.01, 0), (0.01, 0.01))), geo.heading_at(F.lit(0.0), F.lit(0.0099), line((0, 0), (0.01, 0), (0.01, 0.01))))
    assert r.c0.distance_m == pytest.approx(111.19, abs=0.1) and r.c0.segment == 0 and r.c0.t == pytest.approx(0.5) and r.c1 is None
    assert r.c2 and not r.c3 and not r.c4 and r.c5 == pytest.approx(111.19, abs=0.1)
    assert r.c6 < 60 and r.c7 == pytest.approx(0.5) and r.c8 == 0 and r.c9.lat == pytest.approx(0.005)
    assert len(r.c10) == 3 and r.c10[2] == pytest.approx(2 * hav(0, 0, 0, 0.01)) and r.c11 == pytest.approx(0, abs=1e-6)


@pytest.mark.parametrize("centre", [(36.0, -86.8), (0.0, 179.99), (-78.0, 10.0), (89.9, 0.0), (0.0, 0.0)])
def test_radius_join_is_brute_force_everywhere(spark, centre):
    rng = random.Random(1)
    around = lambda n: [(i, max(-90.0, min(90.0, centre[0] + rng.uniform(-0.05, 0.05))), (centre[1] + rng.uniform(-0.05, 0.05) + 180) % 360 - 180) for i in range(n)]
    q, p = around(60), around(80)
    found = knn.points_within(spark.createDataFrame(q, "qid long, lat double, lon double"), spark.createDataFrame(p, "fid long, lat double, lon double"), 1500.0)
    want = {(i, j) for i, a, b in q for j, c, d in p if hav(a, b, c, d) <= 1500}
    got = [(r.qid, r.fid) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)


def plane_m(lat, lon, a, b):
    """Metres from a point to a segment on the plane that touches there."""
    k = math.radians(1) * 6_371_000.0
    wrap = lambda d: (d + 180) % 360 - 180
    x, y = wrap(a[1] - lon) * k * math.cos(math.radians(lat)), (a[0] - lat) * k
    dx, dy = wrap(b[1] - a[1]) * k * math.cos(math.radians(lat)), (b[0] - a[0]) * k
    t = max(0.0, min(1.0, -(x * dx + y * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return math.hypot(x + t * dx, y + t * dy)


def test_nearest_lines_by_rounds_are_brute_force(spark):
    """Short and long segments, near and far queries, across the 180th meridian: found in the round that settles them."""
    rng, centre = random.Random(2), (52.0, 179.99)
    at = lambda spread: (centre[0] + rng.uniform(-spread, spread), (centre[1] + rng.uniform(-spread, spread) + 180) % 360 - 180)
    ways = []
    for i in range(40):
        a, reach = at(0.03), rng.choice((0.0, 0.0005, 0.02))
        ways.append((i, a, (a[0] + rng.uniform(-reach, reach), (a[1] + rng.uniform(-reach, reach) + 180) % 360 - 180)))
    fixes = [(i, *at(0.03)) for i in range(80)]
    w = spark.createDataFrame([(i, [{"lon": p[1], "lat": p[0]} for p in (a, b)]) for i, a, b in ways], f"fid long, coords {geo.COORDS}")
    q = spark.createDataFrame(fixes, "qid long, lat double, lon double")
    got = {r.qid: (r.fid, r.distance_m) for r in knn.nearest_way(q, w, 900.0).collect()}
    want = {i: min((plane_m(lat, lon, a, b), f) for f, a, b in ways) for i, lat, lon in fixes}
    assert got == {i: (f, pytest.approx(d, rel=1e-6)) for i, (d, f) in want.items() if d <= 900.0}
    assert knn.radii(900.0) == [50.0, 200.0, 900.0] and knn.radii(60.0) == [60.0]
    pairs = {(r.qid, r.fid) for r in knn.segments_within(q, knn.segments(w), 900.0).collect()}
    assert pairs == {(i, f) for i, lat, lon in fixes for f, a, b in ways if plane_m(lat, lon, a, b) <= 900.0}


def test_areas_by_rounds_are_brute_force(spark):
    rng = random.Random(5)
    boxes = []
    for i in range(30):
        y, x, h = 36 + rng.uniform(0, 0.05), -87 + rng.uniform(0, 0.05), rng.choice((0.0003, 0.004))
        boxes.append((i, y, x, y + h, x + h))
    fixes = [(i, 36 + rng.uniform(0, 0.05), -87 + rng.uniform(0, 0.05)) for i in range(120)]
    ring = lambda y, x, v, u: [{"lon": x, "lat": y}, {"lon": u, "lat": y}, {"lon": u, "lat": v}, {"lon": x, "lat": v}]
    a = spark.createDataFrame([(i, ring(*b)) for i, *b in boxes], f"fid long, coords {geo.COORDS}")
    q = spark.createDataFrame(fixes, "qid long, lat double, lon double")
    want = {}
    for i, lat, lon in fixes:
        best = []
        for f, y, x, v, u in boxes:
            inside = y <= lat < v and x <= lon < u
            d = min(plane_m(lat, lon, p, r) for p, r in (((y, x), (y, u)), ((y, u), (v, u)), ((v, u), (v, x)), ((v, x), (y, x))))
            if inside or d <= 800:
                best.append((not inside, 0.0 if inside else d, f))
        if best:
            want[i] = min(best)
    got = {r.qid: (not r.inside, r.distance_m, r.fid) for r in knn.best_area(q, a, 800.0).collect()}
    assert got == {i: (o, pytest.approx(d, rel=1e-6), f) for i, (o, d, f) in want.items()}


def test_road_context_feeds_the_tracker(spark):
    from geoweave.streaming import kernels

    roads = spark.createDataFrame([(1, [{"lon": 0.0, "lat": 0.0}, {"lon": 0.01, "lat": 0.0}], "residential")], f"fid long, coords {geo.COORDS}, road_class string")
    q = spark.createDataFrame([(1, 0.00005, 0.002), (2, 0.1, 0.1)], "qid long, lat double, lon double")
    (row,) = lookup.road_context(q, roads).collect()
    road = row.road.asDict()
    assert row.qid == 1 and road["road_class"] == "residential" and road["distance_m"] == pytest.approx(5.56, abs=0.01) and road["bearing"] == pytest.approx(90)
    assert kernels.classify(3.0, 5.0, road) == ("driving", 0.85) and kernels.classify(3.0, 5.0, road, bearing=95.0) == ("driving", 0.95)


def test_nearest_ties_and_bad_points(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0), (2, float("nan"), 0.0), (3, None, 0.0), (4, 50.0, 50.0)], "qid long, lat double, lon double")
    p = spark.createDataFrame([(9, 0.0, 0.001), (5, 0.0, -0.001), (7, float("nan"), 0.0)], "fid long, lat double, lon double")
    assert [(r.qid, r.fid) for r in knn.nearest_point(q, p, 500.0).collect()] == [(1, 5)]
    assert lookup.for_each(q, knn.nearest_point(q, p, 500.0)).count() == 4
    far = knn.nearest_exact(q.filter("qid IN (1, 4)"), p, 500.0)
    assert {r.qid: r.fid for r in far.collect()} == {1: 5, 4: 9}


def test_lookups(spark):
    q = spark.createDataFrame([(1, 0.0005, 0.0005), (2, 0.0005, 0.0025)], "qid long, lat double, lon double")
    ring = lambda x, n: [{"lon": x, "lat": 0.0}, {"lon": x + n, "lat": 0.0}, {"lon": x + n, "lat": n}, {"lon": x, "lat": n}]
    areas = spark.createDataFrame([(1, ring(0.0, 0.002), "house", None), (2, ring(0.0, 0.001), "roof", 9.0)], f"fid long, coords {geo.COORDS}, building_type string, height_m double")
    assert {(r.qid, r.fid, r.inside) for r in lookup.park_at(q, areas).select("qid", "fid", "inside").collect()} == {(1, 1, True), (2, 1, False)}
    assert {(r.qid, r.fid, r.inside) for r in lookup.building_at(q, areas).collect()} == {(1, 1, True)}
    e = {r.qid: r for r in scoring.indoor_outdoor(q.withColumn("accuracy_m", F.lit(5.0)), areas).collect()}
    assert e[1].reason == "inside_building" and e[1].building_fid in (1, 2) and e[2].reason == "clear_of_buildings"
    assert scoring.indoor_outdoor(q.withColumn("accuracy_m", F.lit(-1.0)), areas).head().reason == "invalid_fix"


def test_folding_and_search(spark):
    names = ["Café", "CAFE", "Café Noir", "Straße", "Éclair", "9 Lives", "", None, "the café"]
    t = spark.createDataFrame(list(enumerate(names)), "fid long, name string")
    f = {r.fid: r.f for r in t.select("fid", text.fold_name(F.col("name")).alias("f")).collect()}
    assert [f[i] for i in range(9)] == ["cafe", "cafe", "cafe noir", "strasse", "eclair", "9 lives", "", None, "the cafe"]
    b = {r.fid: r.bucket for r in search.with_buckets(t).collect()}
    assert [b[i] for i in range(7)] == [2, 2, 2, 18, 4, 26, 27]
    assert [r.name for r in search.search_indexed(search.with_buckets(t), " CAFÉ ").collect()] == ["CAFE", "Café", "Café Noir"]
    assert [r.score for r in search.search_all(t, "cafe").collect()] == [2, 2, 1, 0]
    assert search.search_all(t, "  ").count() == 0 and text.probe_buckets("é") == [4, 26]


def test_sight_lines(spark):
    s = spark.createDataFrame([(1, 0.0003, 0.0)], "qid long, lat double, lon double")
    c = spark.createDataFrame([(1, 0.0, 0.0, "fixed", 0.0, None), (2, 0.0, 0.0, "fixed", 180.0, 60.0), (3, 0.0, 0.0, "dome", 180.0, 60.0), (4, 0.0, 0.0, "fixed", None, None)], "fid long, lat double, lon double, camera_type string, direction double, angle double")
    wall = [{"lon": -0.001, "lat": 0.0001}, {"lon": 0.001, "lat": 0.0001}, {"lon": 0.001, "lat": 0.0002}, {"lon": -0.001, "lat": 0.0002}]
    schema = f"fid long, coords {geo.COORDS}, building_type string, height_m double"
    free = {r.fid: r for r in visibility.cameras_seeing(s, c, spark.createDataFrame([], schema)).collect()}
    assert {k: (r.sees, r.aim_assumed) for k, r in free.items()} == {1: (True, True), 2: (False, False), 3: (True, True), 4: (True, True)}
    for height, blocked in ((10.0, True), (1.0, False), (None, True)):
        seen = visibility.cameras_seeing(s, c, spark.createDataFrame([(7, wall, "house", height)], schema)).filter("fid = 1").head()
        assert (seen.blocked_by == 7) == blocked and seen.sees != blocked


def test_viewshed_horizon(spark):
    box = lambda y, w: [{"lon": -w, "lat": y}, {"lon": w, "lat": y}, {"lon": w, "lat": y + 0.0002}, {"lon": -w, "lat": y + 0.0002}, {"lon": -w, "lat": y}]
    b = spark.createDataFrame([(1, box(0.0005, 0.0005), "house", 20.0), (2, box(0.001, 0.0003), "house", 5.0), (3, box(0.0015, 0.0003), "house", 100.0), (4, box(0.05, 0.001), "house", 100.0)], f"fid long, coords {geo.COORDS}, building_type string, height_m double")
    views = lambda eye: {r.fid: r.visible for r in visibility.viewshed(spark.createDataFrame([(1, 0.0, 0.0, eye)], "qid long, lat double, lon double, eye_m double"), b, 1000.0).collect()}
    low, high = views(1.7), views(60.0)
    assert low[1] and not low[2] and low[3] and 4 not in low
    assert all(high[k] for k in low if low[k]), "a higher eye sees at least as much"


def test_cells(spark):
    from geoweave.operators import cells

    got = cells.cells_for_bounds(spark, 36.0, -86.1, 36.05, -86.0)
    q = spark.createDataFrame([(36.0, -86.1), (36.05, -86.0), (36.02, -86.03), (90.5, 0.0), (float("nan"), 0.0)], "lat double, lon double")
    of = [r.c for r in q.select(cells.cell_of(F.col("lat"), F.col("lon")).alias("c")).collect()]
    assert set(of[:3]) <= set(got) and of[3:] == [0, 0] and len(set(got)) == len(got)
    centre = spark.createDataFrame([(c,) for c in got], "c long").select("c", cells.cell_center(F.col("c")).alias("p")).select("c", "p.*")
    assert all(r.c == r.again for r in centre.select("c", cells.cell_of(F.col("lat"), F.col("lon")).alias("again")).collect())
    boxes = spark.createDataFrame([(36.0, -86.1, 36.05, -86.0), (1.0, 0.0, 0.0, 1.0), (0.0, 0.0, 10.0, 10.0), (float("nan"), 0.0, 1.0, 1.0)], "a double, b double, c double, d double")
    rows = [r.x for r in boxes.select(cells.cells_of_bounds("a", "b", "c", "d").alias("x")).collect()]
    assert sorted(rows[0]) == sorted(got) and rows[1:] == [None] * 3
    for bad in ((1, 0, 0, 1), (0, 0, 10, 10), (float("nan"), 0, 1, 1)):
        with pytest.raises(ValueError):
            cells.cells_for_bounds(spark, *map(float, bad))
    with pytest.raises(ValueError):
        cells.candidate_cells(F.lit(0.0), F.lit(0.0), 2)
