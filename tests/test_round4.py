"""Plans and kernels of the lookups that grow with the square of the tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweave import plans
from geoweave.functions import geo
from geoweave.operators import ev, knn, tilejoin, visibility

SF = "/root/testdata/sf0.001"
#: Lookups and the tile joins that each makes.
TILES = {
    "e1_indoor_outdoor": 1,
    "j3_nearest_trail": 1,
    "j5_park_at": 1,
    "j6_water_at": 2,
    "j9_building_at": 2,
    "j8_locate": 3,
    "m8_road_context": 1,
    "j17_segment_context": 2,
    "j18_all_layers": 4,
    "g6_point_in_polygon": 1,
}


@pytest.mark.parametrize("name", TILES)
def test_lookups_join_by_tiles(spark, name):
    """Pairs are made and settled inside the tiles: a plan of this size fits the driver, and no table is multiplied by cells and ranked."""
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == TILES[name] and "Window" not in plan and len(plan) < 80_000


def test_sight_lines_stay_in_their_tile(spark):
    """v1: subject, camera and footprints meet in one tile join; the blocking footprint is that of every ring looked at one by one."""
    rng = random.Random(7)
    at = lambda: (36 + rng.random() / 300, -87 + rng.random() / 300)
    subjects, cameras, boxes = [at() for _ in range(60)], [at() for _ in range(40)], [(*at(), 0.0001 + rng.random() / 4000) for _ in range(50)]
    ring = lambda la, lo, w: [(lo, la), (lo + w, la), (lo + w, la + w), (lo, la + w), (lo, la)]
    rings = [ring(*b) for b in boxes]
    s = spark.createDataFrame([(i, *p) for i, p in enumerate(subjects)], "qid long, lat double, lon double")
    c = spark.createDataFrame([(i, *p, "dome", None, None) for i, p in enumerate(cameras)], "fid long, lat double, lon double, camera_type string, direction double, angle double")
    b = spark.createDataFrame([(k, [{"lon": x, "lat": y} for x, y in r], "house", float(k % 6)) for k, r in enumerate(rings)], f"fid long, coords {geo.COORDS}, building_type string, height_m double")
    out = visibility.cameras_seeing(s, c, b, 150.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "Join" not in plan
    got = {(r.qid, r.fid): r.blocked_by for r in out.collect()}
    inside = lambda p, k: boxes[k][0] <= p[0] < boxes[k][0] + boxes[k][2] and boxes[k][1] <= p[1] < boxes[k][1] + boxes[k][2]

    def cuts(p, q, k):
        top = float(k % 6) or 10.0
        for (ax, ay), (bx, by) in zip(rings[k], rings[k][1:]):
            rx, ry, sx, sy, px, py = q[1] - p[1], q[0] - p[0], bx - ax, by - ay, ax - p[1], ay - p[0]
            det = rx * sy - ry * sx
            if det and 0 <= (t := (px * sy - py * sx) / det) <= 1 and 0 <= (px * ry - py * rx) / det <= 1 and top > visibility.sight_line_height(t):
                return True
        return False

    assert len(got) > 300 and any(v is not None for v in got.values()) and None in got.values()
    for (i, j), by in got.items():
        p, q = cameras[j], subjects[i]
        held = [k for k in range(50) if inside(q, k) and not inside(p, k)]
        assert by == next(iter(held + [k for k in range(50) if cuts(p, q, k)]), None)


def test_chargers_of_a_place_are_projected_once(spark):
    """ev2: by brute force; what leaves a tile is settled by path and place, chargers of one place share it."""
    rng = random.Random(8)
    paths = {p: [(36 + rng.random() / 50, -87 + rng.random() / 50) for _ in range(rng.randint(1, 6))] for p in range(40)}
    places = [(36 + rng.random() / 50, -87 + rng.random() / 50) for _ in range(30)]
    chargers = [(i, *places[i % 30]) for i in range(90)]
    p = spark.createDataFrame([(k, i, *x) for k, v in paths.items() for i, x in enumerate(v)], "path_id long, i long, lat double, lon double")
    c = spark.createDataFrame(chargers, "fid long, lat double, lon double")
    out = ev.project_onto(p, c, 250.0)
    assert "min_by" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.path_id, r.fid): (r.along_m, r.detour_m) for r in out.collect()}
    want = {}
    for k, v in paths.items():
        for i, la, lo in chargers:
            best, along = None, 0.0
            for (a, b), (a2, b2) in zip(v, v[1:]):
                x = np.array([a, b, a2, b2])[:, None]
                t = tilejoin.Segments(np.array([la]), np.array([lo]), x, 250.0)
                d, at = float(t.measure([0], [0])[0]), along + float(t.along([0], [0])[0])
                best = (d, at) if best is None or d < best[0] else best
                along += float(tilejoin.haversine_m(a, b, a2, b2))
            if best and best[0] <= 250:
                want[k, i] = best[::-1]
    assert len(want) > 300 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def test_a_place_with_many_paths_takes_several_rows(spark, monkeypatch):
    monkeypatch.setattr(knn, "HITS", 7)
    segs = spark.range(100).selectExpr("id AS path_id", "0 AS segment", "0D AS along_m", "36D AS lat1", "-87D AS lon1", "36.001 + id / 1e6 AS lat2", "-87.001D AS lon2")
    found = knn.paths_by(spark.createDataFrame([(1, 36.0, -87.0)], "qid long, lat double, lon double"), segs, 50.0).collect()
    assert sorted(h.path_id for r in found for h in r.hits) == list(range(100)) and max(len(r.hits) for r in found) <= 7


@pytest.mark.parametrize("lat0", [0.0, 36.0, -84.0])
def test_few_distances_beyond_the_radius(lat0):
    """j10: all pairs within the radius, and hardly a distance more is worked out."""
    rng = np.random.default_rng(9)
    wide = 0.01 / np.cos(np.radians(lat0))
    lat, lon, p_lat, p_lon = lat0 + rng.random(800) / 100, rng.random(800) * wide, lat0 + rng.random(700) / 100, rng.random(700) * wide
    t = tilejoin.Points(lat, lon, p_lat, p_lon, 150.0)
    asked = []
    q, f, _ = t.within(lambda q, f: asked.append(len(q)) or t.measure(q, f), 150.0)
    every = np.argwhere(tilejoin.haversine_m(lat[:, None], lon[:, None], p_lat, p_lon) <= 150.0)
    assert sorted(zip(q, f)) == [tuple(x) for x in every] and sum(asked) < 1.1 * len(every)


def test_stops_of_few_places_are_those_of_all(spark):
    """ev3: the places that leave the tiles give the stops of every candidate, also where powers, places and distances tie, and are few."""
    rng = random.Random(10)
    paths = {p: [(36 + 0.004 * i + rng.random() / 300, -87 + 0.006 * i + rng.random() / 300) for i in range(rng.randint(1, 40))] for p in range(30)}
    places = [(36 + rng.random() / 6, -87 + rng.random() / 4) for _ in range(1500)]
    places = [x for x in places if abs((x[0] - 36) / 0.004 - (x[1] + 87) / 0.006) < 4]
    chargers = [(i, *places[i % len(places)], rng.choice(ev.ACCESS[:5]), rng.choice([None, 3.0, 50.0, 50.0, 150.0])) for i in range(len(places) * 3)]
    p = spark.createDataFrame([(k, i, *x) for k, v in paths.items() for i, x in enumerate(v)], "path_id long, i long, lat double, lon double")
    c = spark.createDataFrame(chargers, "fid long, lat double, lon double, access string, power_kw double")
    trips = spark.createDataFrame([(k, r) for k in paths for r in (2500.0 + k * 200, 9000.0)], "path_id long, range_m double")
    got = {(r.path_id, round(r.usable_range_m)): r for r in ev.plan_charge_stops(p, trips, c, 800.0).collect()}
    found = ev.project_onto(p, c.filter(ev.is_public(F.col("access"))).select("fid", "lat", "lon"), 800.0).join(c.select("fid", F.coalesce("power_kw", F.lit(0.0)).alias("w")), "fid")
    listed = {}
    for r in found.collect():
        listed.setdefault(r.path_id, []).append((r.along_m, r.fid, r.detour_m, r.w))
    assert len(got) == 60 and sum(map(len, listed.values())) > 5000 and sum(len(r.stops) for r in got.values()) > 50
    for (k, _), r in got.items():
        x = sorted(listed.get(k, []))
        picks, ok, short = ev.choose_stops(r.route_m, r.usable_range_m / (1 - ev.RESERVE), [a[0] for a in x], [a[3] for a in x]) if len(paths[k]) > 1 else ([], False, r.route_m)
        assert [s.fid for s in r.stops] == [x[i][1] for i in picks] and r.reachable == ok and r.shortfall_m == pytest.approx(short, abs=1e-6)
    along = np.sort(np.random.default_rng(1).random(3000)) * 9000
    kept = tilejoin.may_stop(np.zeros(3000, int), along, np.arange(3000) % 97 * 1.0, np.full(3000, 4000.0), 1000.0)[0]
    assert len(kept) < 200
