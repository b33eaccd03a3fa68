"""Cases that larger tables brought up."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from geoweave import plans
from geoweave.functions import geo
from geoweave.operators import knn, nav, scoring, tilejoin
from geoweave.streaming import kernels as K

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, name, folder, *tables):
    """The query over the parquet files of a folder, against its SQL in DuckDB over the same files."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(plans.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(tuple(r) for r in plans.QUERIES[name](spark, str(folder)).select(*columns).collect()) == sorted(want.fetchall())


def test_smoothed_speed_adds_up_in_order():
    speeds = [0.44, 0.7033333333333334, 0.51, 0.78, 0.06666666666666667]  # a hair over the limit in order, on it if rounding is carried along
    assert K.smoothed(K.new_speed() | {"speeds": speeds}) == 0.5000000000000001 and K.band(K.smoothed(K.new_speed() | {"speeds": speeds})) == "walking"


def test_states_of_fixes_between_centres(spark, tmp_path):
    """c8: fixes as far from one centre as from another, or on a border: the last bit of the boxes decides."""
    ids = [2495549, 2781557, 2807148, 4359012, 7]
    pq.write_table(pa.table({"event_id": ids, "user_id": [1] * 5, "value": [1.0] * 5}), tmp_path / "events.parquet")
    pq.write_table(pq.read_table(f"{SF}/nation.parquet"), tmp_path / "nation.parquet")
    same_as_sql(spark, "c8_state_of", tmp_path, "events", "nation")


def _dense(n, seed):
    """Segments of 100 m in a square kilometre and queries among them."""
    rng = np.random.default_rng(seed)
    a, turn = rng.uniform(0, 0.009, (2, n)), rng.uniform(0, 6.3, n)
    ends = (36 + a[0], a[1] - 87, 36 + a[0] + 0.0009 * np.sin(turn), a[1] - 87 + 0.0009 * np.cos(turn))
    q = rng.uniform(0, 0.009, (2, n))
    return 36 + q[0], q[1] - 87, ends


def test_nearest_segment_looks_at_few_where_they_are_dense():
    """Fifty metres around a query hold hundreds of segments: the search begins with what the density says."""
    lat, lon, ends = _dense(4000, 1)
    t = tilejoin.Segments(lat, lon, ends, 50.0)
    looked = []
    best, d = t.nearest(lambda q, f: looked.append(len(q)) or t.measure(q, f), 50.0)
    every = np.array([t.measure(np.full(4000, i), np.arange(4000)) for i in range(0, 4000, 40)])
    assert (best[::40] == every.argmin(1)).all() and (d[::40] == every.min(1)).all()
    assert sum(looked) < 100 * len(lat)


def test_pairs_of_a_tile_are_brute_force():
    lat, lon, ends = _dense(300, 2)
    every = np.array([tilejoin.segment_m(lat[i], lon[i], np.cos(np.radians(lat[i])), *ends) for i in range(300)])
    t = tilejoin.Segments(lat, lon, ends, 80.0)
    for m in (3.0, 80.0):
        q, f, _ = t.within(t.measure, m)
        assert sorted(zip(q, f)) == [tuple(x) for x in np.argwhere(every <= m)]


def test_a_segment_is_dealt_to_few_tiles(spark):
    s = spark.range(2000).selectExpr("36 + id / 2e4 AS lat1", "-87 + id / 2e4 AS lon1").withColumns({"lat2": F.col("lat1") + 0.001, "lon2": F.col("lon1") + 0.001})
    assert s.select(F.explode(knn.tiles_reached("lat1", "lon1", "lat2", "lon2", 50.0, knn.TILE_M))).count() < 3 * 2000


def _ways(spark, ends, *more):
    rows = [(i, [{"lon": float(ends[1][i]), "lat": float(ends[0][i])}, {"lon": float(ends[3][i]), "lat": float(ends[2][i])}], *(f(i) for f, _ in more)) for i in range(len(ends[0]))]
    return spark.createDataFrame(rows, ", ".join(["fid long", f"coords {geo.COORDS}", *(kind for _, kind in more)]))


def test_named_roads_come_before_nearer_ones_without_a_name(spark):
    """n2: by the two nearest searches as by the score of every pair."""
    lat, lon, ends = _dense(150, 3)
    roads = _ways(spark, ends, (lambda i: f"road {i}" if i % 3 == 0 else None, "name string"), (lambda i: None, "ref_tag string"), (lambda i: f"class {i}", "road_class string"))
    turns = spark.createDataFrame([(i, 0, float(lat[i]), float(lon[i])) for i in range(150)], "path_id long, nth int, probe_lat double, probe_lon double")
    got = {r.path_id: r.road_class for r in nav.name_turns(turns, roads, 60.0).collect()}
    for i in range(150):
        d = tilejoin.segment_m(lat[i], lon[i], np.cos(np.radians(lat[i])), *ends)
        best = min(((d[k] + (60.0 if k % 3 else 0.0), k) for k in np.flatnonzero(d <= 60.0)), default=None)
        assert got[i] == (f"class {best[1]}" if best else None)


def test_candidates_are_ranked_in_their_tile(spark):
    """p1: a road of several segments counts once, the first rank alone is that of all, and no window ranks them again."""
    lat, lon, ends = _dense(60, 4)
    roads = _ways(spark, ends).withColumn("coords", F.concat("coords", F.reverse("coords")))
    none = spark.createDataFrame([], f"fid long, coords {geo.COORDS}")
    points = spark.createDataFrame([(i, float(ends[0][i]), float(ends[1][i])) for i in range(0, 60, 7)], "fid long, lat double, lon double")
    fixes = spark.createDataFrame([(i, float(lat[i]), float(lon[i]), 9.0 * (i % 2), 30.0) for i in range(60)], "qid long, lat double, lon double, speed_mps double, accuracy_m double")
    every = {(r.qid, r["rank"]): (r.kind, r.fid) for r in scoring.score_candidates(fixes, roads, none, points, 100.0).collect()}
    assert len(set((q, *x) for (q, _), x in every.items())) == len(every)
    found = scoring.score_candidates(fixes, roads, none, points, 100.0, first=1)
    assert {(r.qid, r["rank"]): (r.kind, r.fid) for r in found.collect()} == {k: x for k, x in every.items() if k[1] == 1}
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
