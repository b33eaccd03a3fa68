import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoweave.functions import stats
from geoweave.operators import ev, motion, nav, route, segments
from geoweave.streaming import kernels as K
from geoweave.streaming import stateful


def test_t_table():
    t = pd.Series([12.706, 2.228, 2.086, 1.96, 0.0, 63.657])
    df = pd.Series([1.0, 10.0, 20.0, 1e6, 5.0, 1.0])
    assert stats.t_two_sided(t, df).tolist() == pytest.approx([0.05, 0.05, 0.05, 0.05, 1.0, 0.01], abs=2e-4)


def test_cadence():
    import numpy as np

    i = np.arange(100)
    assert stats.cadence(1 + np.sin(i / 50 * 2 * np.pi * 2), 50.0) == (4, 2.0)
    assert stats.cadence(np.ones(100), 50.0) == (0, 0.0) and stats.cadence(np.ones(3), 50.0) == (0, 0.0)


def walk(speeds, step=5000, **more):
    return [dict(t_ms=i * step, lat=36.0, lon=-87.0, speed_mps=v, accuracy_m=5.0, **more) for i, v in enumerate(speeds)]


def test_speed_dwell_and_gaps():
    s = K.new_speed()
    assert [K.push_speed(s, t, 0, 0, 5, v) for t, v in ((0, 1.0), (1000, 1.0), (2000, 9.0), (3000, 9.0), (4000, 9.0))] == ["unknown", "walking", "walking", "walking", "driving"]
    assert K.push_speed(s, 5000, 0, 0, 60, 0.0) == "driving" and K.push_speed(s, 5001, 0, 0, float("nan"), 0.0) == "driving"
    K.push_speed(s, 100_000, 0, 0, 5, 0.2)
    assert s["speeds"] == [0.2] and K.smoothed(s) == 0.2
    d = K.new_speed()
    K.push_speed(d, 0, 0.0, 0.0, 5, None)
    K.push_speed(d, 1000, 0.0, 0.0001, 5, -1.0)
    assert K.smoothed(d) == pytest.approx(11.12, abs=0.01)
    K.push_speed(d, 1000, 0.0, 0.1, 5, None)
    assert len(d["speeds"]) == 1


def test_votes():
    road = lambda c, d, b=None: {"road_class": c, "distance_m": d, "bearing": b}
    assert K.classify(10.0, 50.0) == ("driving", 0.85) and K.classify(1.0, 50.0)[0] == "stationary"
    assert K.classify(3.0, 5.0, road("motorway", 5)) == ("driving", 0.95) and K.classify(1.5, 5.0, road("footway", 3)) == ("walking", 0.9)
    assert K.classify(3.0, 5.0, road("residential", 5, 10.0), None, 190.0) == ("driving", 0.95)
    assert K.classify(1.0, 5.0, road("residential", 60)) == ("walking", 0.9) and K.classify(9.0, 5.0) == ("driving", 0.9) and K.classify(3.0, 5.0) == ("walking", 0.85)
    assert K.classify(0.4, 5.0, road("service", 12), None, None, "driving") == ("driving", 0.75) and K.classify(1.0, 5.0, None, None, None, "walking") == ("walking", 0.75)
    assert K.accel_vote({"dominant_frequency": 2.8, "variance": 0.5}) == ("running", 0.5)


def test_vote_expression_equals_the_kernel(spark):
    rng = random.Random(4)
    pick = lambda *x: rng.choice((None, *x))
    rows = []
    for i in range(3000):
        cls = pick("motorway", "residential", "footway", "primary_link", "primary")
        rows.append((i, pick(0.2, 0.6, 1.5, 2.1, 2.5, 5.5, 9.5), pick(5.0, 29.0, 45.0), cls, None if cls is None else rng.choice((1.0, 4.0, 7.0, 12.0, 60.0)), None if cls is None else pick(0.0, 45.0, 90.0, 200.0), pick(10.0, 95.0, 180.0), pick(0.5, 1.5, 2.8), pick(0.005, 0.4, 2.0, 6.0), pick(0, 2, 5), pick(0.0, 4.0), rng.choice(("driving", "walking", "unknown"))))
    df = spark.createDataFrame(rows, "i int, s double, a double, c string, d double, rb double, b double, f double, v double, n int, w double, p string")
    got = {r.i: (r.o.movement, r.o.confidence) for r in df.select("i", motion.vote(*map(F.col, ("s", "a", "c", "d", "rb", "b", "f", "v", "n", "w", "p"))).alias("o")).collect()}
    for i, s, a, c, d, rb, b, f, v, n, w, p in rows:
        accel = {"dominant_frequency": f, "variance": v, "step_count": n, "window_duration_s": w}
        assert got[i] == K.classify(s, a, {"road_class": c, "distance_m": d, "bearing": rb} if c else None, accel, b, p), rows[i]


def test_debounce():
    s = K.new_debounce()
    held = [K.debounce(s, "driving", t) for t in range(0, 40_000, 5_000)]
    assert held[3] == "driving" and held[2] == "unknown"
    later = [K.debounce(s, "stationary", t) for t in range(40_000, 400_000, 5_000)]
    assert later[20] == "driving" and later[-1] == "stationary"
    c = {"intersection_type": 1, "distance_m": 10.0}
    s2 = K.new_debounce()
    for t in range(0, 40_000, 5_000):
        K.debounce(s2, "driving", t)
    assert [K.debounce(s2, "stationary", t, c) for t in range(40_000, 300_000, 5_000)][-1] == "driving"
    assert not K.holds_traffic({"intersection_type": 4, "distance_m": 1}) and not K.holds_traffic(None)


def test_session_advice():
    s = K.new_session()
    assert s["sampler"]["advice"]["accel_level"] == "burst" and s["sampler"]["advice"]["generation"] == 1
    out = [K.observe(s, {"t_ms": t, "location": {"lat": 1.0, "lon": 1.0, "accuracy_m": 5.0, "speed_mps": 12.0}, "accel": {"variance": 0.0}}) for t in range(0, 60_000, 5_000)]
    assert out[0]["reason"] == "initializing" and out[-1]["movement"] == "driving" and out[-1]["reason"] == "stable_driving" and out[-1]["accel_level"] == "low"
    assert [o["generation"] for o in out] == sorted(o["generation"] for o in out)
    assert K.observe(K.new_session(), {"t_ms": 0})["vote"] == "unknown"
    limited = K.new_sampler(K.Capabilities(location=False, most_hz=10))
    assert limited["advice"]["location_level"] == "off" and limited["advice"]["accel_hz"] == 10 and limited["advice"]["reason"] == "capability_limited"


def frame(spark, n=3):
    rng = random.Random(9)
    rows = [(d, i, i * 5000 + (i // 30) * 60000, 36.0 + i * 1e-4 * d, -87.0, None if rng.random() < 0.2 else rng.uniform(0, 12), rng.choice((5.0, 20.0, 70.0))) for d in range(n) for i in range(80)]
    return spark.createDataFrame(rows, "device long, seq long, t_ms long, lat double, lon double, speed_mps double, accuracy_m double")


def test_batch_speed_equals_windows(spark):
    df = frame(spark)
    a = {(r.device, r.seq): r.smoothed_mps for r in motion.smoothed_speeds(df).collect()}
    b = {(r.device, r.seq): r.smoothed_mps for r in stateful.batch(df, "speed").collect()}
    assert len(a) > 100 and all(b[k] == pytest.approx(v) for k, v in a.items())


@pytest.mark.parametrize("machine", ["track", "session"])
def test_stream_equals_batch(spark, tmp_path, machine):
    df = frame(spark)
    for i in range(4):
        df.filter(f"seq div 20 = {i}").repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    # files of one slice of time arrive together and in order
    q = stateful.stream(source, machine).writeStream.format("memory").queryName(f"out_{machine}").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    want = {(r.device, r.seq): (r.movement, r.vote) for r in stateful.batch(df, machine).collect()}
    got = {(r.device, r.seq): (r.movement, r.vote) for r in spark.table(f"out_{machine}").collect()}
    assert set(got) == set(want)


def test_segments(spark):
    kinds = "wwwwwdwwwwwwsssssddddddwd"
    names = {"w": "walking", "d": "driving", "s": "stationary"}
    pts = spark.createDataFrame([(1, i, i * 1000, names[k], names[k], 0.5, 1.0, i == 13) for i, k in enumerate(kinds)], "device long, idx long, t_ms long, movement string, vote string, confidence double, smoothed_mps double, at_control boolean")
    s = segments.coalesce(pts)
    rows = lambda d: sorted((r.start, r.end, r.type, r.edited) for r in d.collect())
    assert rows(s) == [(0, 11, "walking", False), (12, 16, "stationary", False), (17, 24, "driving", False)]
    a = {r.start: r for r in segments.annotate(s, pts).collect()}
    assert a[0].vote == "walking" and a[0].points == 12 and a[12].at_control and not a[0].at_control and a[17].t1 == 24000
    edit = lambda *e: spark.createDataFrame(list(e), "device long, lo long, hi long, type string")
    assert rows(segments.overlay(s, edit((1, 5, 14, "running")))) == [(0, 4, "walking", False), (5, 14, "running", True), (15, 16, "stationary", False), (17, 24, "driving", False)]
    assert rows(segments.split(s, spark.createDataFrame([(1, 5), (1, 12), (1, 99)], "device long, at long"))) == [(0, 4, "walking", False), (5, 11, "walking", False), (12, 16, "stationary", False), (17, 24, "driving", False)]
    at = lambda *x: spark.createDataFrame(list(x), "device long, start long")
    assert rows(segments.merge_with_previous(s, at((1, 12)))) == [(0, 16, "walking", True), (17, 24, "driving", False)]
    moved = segments.move_boundary(s, spark.createDataFrame([(1, 12, 100)], "device long, start long, to long"))
    assert rows(moved) == [(0, 15, "walking", True), (16, 16, "stationary", True), (17, 24, "driving", False)]
    bands = [("stationary", 0.0, 0.5), ("walking", 0.5, 5.0), ("driving", 5.0, 99.0)]
    b = spark.range(1).select(segments.band_by_height(F.lit(4.0), F.lit(7.0), bands).alias("a"), segments.band_by_height(F.lit(2.0), F.lit(2.0), bands).alias("b"), segments.band_by_height(F.lit(-3.0), F.lit(-2.0), bands).alias("c")).head()
    assert (b.a.type, round(b.a.share, 3), b.b.type, b.b.share, b.c.type, b.c.share) == ("driving", 0.667, "walking", 1.0, None, 0.0)


def test_shifts(spark):
    rng = random.Random(2)
    v = [rng.gauss(1, 0.1) for _ in range(40)] + [rng.gauss(6, 0.1) for _ in range(40)]
    df = spark.createDataFrame([(1, i, i * 1000, x) for i, x in enumerate(v)] + [(2, i, i * 1000, 1.0) for i in range(60)], "device long, seq long, t_ms long, speed_mps double")
    got = motion.significant_shifts(df).collect()
    assert [(r.device, r.idx) for r in got] == [(1, 40)] and got[0].p_value < 1e-6


def test_charging():
    assert ev.choose_stops(100_000, 200_000, [], []) == ([], True, 0.0)
    assert ev.choose_stops(100_000, 50_000, [], [])[1:] == (False, 60_000)
    stops, ok, short = ev.choose_stops(100_000, 50_000, [10_000.0, 25_000.0, 35_000.0, 60_000.0, 70_000.0], [350, 50, 150, 50, 50])
    assert ok and short == 0 and stops[0] == 2
    assert ev.choose_stops(10.0, 0.0, [], []) == ([], False, 10.0)


def test_turns_and_following(spark):
    m = 1 / 111194.93
    pts = [(0, 0), (100, 0), (200, 0), (200, 100), (200, 200), (300, 200)]
    path = [(y * m, x * m) for x, y in pts]
    df = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(path)], "path_id long, i long, lat double, lon double")
    t = nav.turn_queue(df).orderBy("nth").collect()
    assert [r.maneuver for r in t] == ["depart", "left", "right", "arrive"] and t[1].along_m == pytest.approx(200, abs=0.1)
    r = nav.Route(path, [(x.along_m, x.maneuver) for x in t])
    s = r.follow(3 * m, 150 * m, 5.0, 0)
    assert s["idx"] == 1 and s["offset_m"] == pytest.approx(3, abs=0.01) and s["along_m"] == pytest.approx(150, abs=0.1) and s["next_turn"] == 1 and not s["off_route"]
    assert r.follow(500 * m, 0.0, 5.0, 0)["off_route"] and nav.Route(path[:1]).follow(0, 0, 5, 0) is None
    state = {}
    assert [nav.follow_policy(state, True, t) for t in range(0, 10_000, 1000)] == [False, False, True] + [False] * 7


def test_routes_are_shortest(spark):
    rng = random.Random(3)
    p = lambda i: {"lon": (i % 6) * 0.01, "lat": (i // 6) * 0.01}
    roads = [(k, "residential", [p(a), p(b)], rng.choice((None, "yes", "reverse")), None) for k, (a, b) in enumerate((i, j) for i in range(36) for j in (i + 1, i + 6) if j < 36 and (j != i + 1 or i % 6 < 5))]
    df = spark.createDataFrame(roads, "fid long, road_class string, coords array<struct<lon:double,lat:double>>, oneway string, speed_limit_kmh double")
    h = route.hops(df)
    g = route.graph(h, route.merged_nodes(h))
    edges = {(r.f, r.t): r.weight for r in g.collect()}
    nodes = sorted({n for e in edges for n in e})
    best = {(a, b): 0 if a == b else edges.get((a, b), 1 << 60) for a in nodes for b in nodes}
    for k in nodes:
        for a in nodes:
            for b in nodes:
                best[a, b] = min(best[a, b], best[a, k] + best[k, b])
    q = [(0, i, p(a)["lat"], p(a)["lon"], p(b)["lat"], p(b)["lon"]) for i, (a, b) in enumerate((rng.randrange(36), rng.randrange(36)) for _ in range(20))] + [(0, 99, 50.0, 50.0, 0.0, 0.0)]
    out = {r.qid: r for r in route.routes(spark.createDataFrame(q, "region int, qid long, lat1 double, lon1 double, lat2 double, lon2 double"), g.withColumn("region", F.lit(0))).collect()}
    assert out[99].failure == "start_not_snapped"
    for _, i, *_ in q[:-1]:
        if out[i].failure is None:
            assert out[i].duration_s * 100 == best[out[i].nodes[0], out[i].nodes[-1]]
        else:
            assert out[i].failure == "disconnected"


def test_close_nodes_merge(spark):
    u = 1 / 50_000
    roads = [(1, "residential", [{"lon": 0.0, "lat": 0.0}, {"lon": 0.01, "lat": 0.0}], None, None), (2, "residential", [{"lon": 0.01 + 2 * u, "lat": 2 * u}, {"lon": 0.02, "lat": 0.0}], None, None), (3, "footway", [{"lon": 0.0, "lat": 0.0}, {"lon": 0.0, "lat": 0.01}], None, None)]
    df = spark.createDataFrame(roads, "fid long, road_class string, coords array<struct<lon:double,lat:double>>, oneway string, speed_limit_kmh double")
    h = route.hops(df)
    assert h.count() == 4 and route.hops(df, "foot").count() == 6
    roots = route.merged_nodes(h)
    g = route.graph(h, roots)
    assert len({r.f for r in g.collect()}) == 3
    assert route.edge_geometry(df, roots).count() == 4
