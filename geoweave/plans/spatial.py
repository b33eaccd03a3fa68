"""Queries of the geometry functions and of the point lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoweave.functions import geo
from geoweave.operators import cells, knn, lookup

from .base import query
from .views import ctes, hav, seg_dist, view

R = 500.0
#: DuckDB's nested loops get a cheap box around the radius first; a degree is longer than 111 km nowhere in the box of the data.
NEAR = "abs(a.lat - b.lat) < {d} AND abs(a.lon - b.lon) < {d}"


def _ring(df):
    return df.withColumn("coords", geo.box_ring("lat0", "lon0", "lat1", "lon1"))


def _lines(df):
    p = lambda i: F.struct(F.col(f"lon{i}").alias("lon"), F.col(f"lat{i}").alias("lat"))
    return df.withColumn("coords", F.array(p(1), p(2)))


def _round(frame, /, **digits):
    return frame.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("j1_nearest_poi", ctes("poi", "fix") + f"""
SELECT qid, arg_min(b.fid, (d, b.fid)) AS fid, round(min(d), 3) AS distance_m FROM
 (SELECT a.qid, b.fid, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d FROM fix a JOIN poi b ON {NEAR.format(d=0.006)}) b WHERE d <= {R} GROUP BY qid""")
def j1_nearest_poi(spark, sf):
    return _round(knn.nearest_point(view(spark, sf, "fix"), view(spark, sf, "poi"), R), distance_m=3)


_SEGS = f"""s AS (SELECT a.qid, b.fid, b.cls, {seg_dist('a.lat', 'a.lon', 'lat1', 'lon1', 'lat2', 'lon2')} AS d FROM fix a JOIN seg b
 ON a.lat BETWEEN lat1 - {{m}} AND lat2 + {{m}} AND a.lon BETWEEN lon1 - {{m}} AND lon2 + {{m}})"""


@query("j1_nearest_road", ctes("fix", "seg") + ", " + _SEGS.format(m=0.001) + """
SELECT qid, arg_min(fid, (d, fid)) AS fid, round(min(d), 3) AS distance_m FROM s WHERE d <= 50 GROUP BY qid""")
def j1_nearest_road(spark, sf):
    out = lookup.nearest_road(view(spark, sf, "fix"), _lines(view(spark, sf, "seg")))
    return _round(out.select("qid", "fid", "distance_m"), distance_m=3)


@query("j2_nearest_intersection", ctes("fix", "seg") + f""", x AS (SELECT fid, lat1 AS lat, lon1 AS lon, 1 + fid % 5 AS kind FROM seg)
SELECT qid, arg_min(fid, (d, fid)) AS fid, round(min(d), 3) AS distance_m, arg_min(kind, (d, fid)) AS intersection_type FROM
 (SELECT a.qid, b.fid, b.kind, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d FROM fix a JOIN x b ON {NEAR.format(d=0.001)}) WHERE d <= 50 GROUP BY qid""")
def j2_nearest_intersection(spark, sf):
    x = view(spark, sf, "seg").selectExpr("fid", "lat1 AS lat", "lon1 AS lon", "1 + fid % 5 AS intersection_type")
    return _round(lookup.nearest_intersection(view(spark, sf, "fix"), x), distance_m=3).select("qid", "fid", "distance_m", "intersection_type")


@query("j3_nearest_trail", ctes("fix", "seg") + ", " + _SEGS.format(m=0.007) + """
SELECT qid, arg_min(fid, (d, fid)) AS fid, round(min(d), 3) AS distance_m, min(d) <= 25 AS on_it FROM s WHERE d <= 500 AND cls = 0 GROUP BY qid""")
def j3_nearest_trail(spark, sf):
    trails = _lines(view(spark, sf, "seg").withColumn("geom_type", F.col("cls").cast("int")))
    return _round(lookup.nearest_line(view(spark, sf, "fix"), trails, R).select("qid", "fid", "distance_m", "on_it"), distance_m=3)


@query("j4_nearest_station", ctes("fix", "seg") + f"""
SELECT qid, arg_min(fid, (d, fid)) AS fid, round(min(d), 3) AS distance_m FROM
 (SELECT a.qid, b.fid, {hav('a.lat', 'a.lon', 'b.lat1', 'b.lon1')} AS d FROM fix a JOIN seg b ON b.cls = 1 AND abs(a.lat - b.lat1) < 0.007 AND abs(a.lon - b.lon1) < 0.007)
 WHERE d <= 500 GROUP BY qid""")
def j4_nearest_station(spark, sf):
    stops = _lines(view(spark, sf, "seg").withColumn("geom_type", F.col("cls").cast("int")))
    return _round(lookup.nearest_stop(view(spark, sf, "fix"), stops, R), distance_m=3)


def _border(lat, lon):
    sides = [("lat0", "lon0", "lat0", "lon1"), ("lat0", "lon1", "lat1", "lon1"), ("lat1", "lon1", "lat1", "lon0"), ("lat1", "lon0", "lat0", "lon0")]
    return "least(" + ", ".join(seg_dist(lat, lon, *s) for s in sides) + ")"


_AREAS = f"""r AS (SELECT a.qid, b.fid, b.kind, a.lat >= lat0 AND a.lat < lat1 AND a.lon >= lon0 AND a.lon < lon1 AS inside,
   a.accuracy_m, {_border('a.lat', 'a.lon')} AS depth FROM fix a JOIN box b ON a.lat BETWEEN lat0 - 0.007 AND lat1 + 0.007 AND a.lon BETWEEN lon0 - 0.007 AND lon1 + 0.007),
 p AS (SELECT *, CASE WHEN inside THEN 0 ELSE depth END AS d FROM r WHERE inside OR depth <= 500)"""


@query("j5_park_at", ctes("fix", "box") + ", " + _AREAS + """
SELECT qid, arg_min(fid, (NOT inside, d, fid)) AS fid, round(arg_min(d, (NOT inside, d, fid)), 3) AS distance_m, bool_or(inside) AS inside FROM p GROUP BY qid""")
def j5_park_at(spark, sf):
    return _round(lookup.park_at(view(spark, sf, "fix"), _ring(view(spark, sf, "box")), R), distance_m=3)


@query("j6_water_at", ctes("fix", "box", "seg") + ", " + _AREAS + ", " + _SEGS.format(m=0.007) + """,
 u AS (SELECT qid, fid, d, inside FROM p UNION ALL SELECT qid, fid + 1000000, d, false FROM s WHERE cls = 2 AND d <= 500)
SELECT qid, arg_min(fid, (NOT inside, d, fid)) AS fid, round(arg_min(d, (NOT inside, d, fid)), 3) AS distance_m, bool_or(inside) AS inside FROM u GROUP BY qid""")
def j6_water_at(spark, sf):
    areas = _ring(view(spark, sf, "box")).select("fid", "coords", F.lit(0).alias("geom_type"))
    lines = _lines(view(spark, sf, "seg").filter("cls = 2")).select((F.col("fid") + 1000000).alias("fid"), "coords", F.lit(1).alias("geom_type"))
    return _round(lookup.water_at(view(spark, sf, "fix"), areas.unionByName(lines), R), distance_m=3)


@query("j7_nearest_address", ctes("fix", "address") + f"""
SELECT qid, arg_min(fid, (d, fid)) AS fid, round(min(d), 3) AS distance_m FROM
 (SELECT a.qid, b.fid, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d FROM fix a JOIN address b ON {NEAR.format(d=0.002)}) WHERE d <= 150 GROUP BY qid""")
def j7_nearest_address(spark, sf):
    return _round(lookup.nearest_address(view(spark, sf, "fix"), view(spark, sf, "address")), distance_m=3)


@query("j8_locate", ctes("fix", "seg", "address") + ", " + _SEGS.format(m=0.007) + f""",
 w AS (SELECT qid, min(d) FILTER (cls <> 0) AS rd, min(d) FILTER (cls = 0) AS td, arg_min(fid, (d, fid)) FILTER (cls <> 0) AS r,
         arg_min(fid, (d, fid)) FILTER (cls = 0) AS t FROM s WHERE d <= 500 GROUP BY qid),
 x AS (SELECT qid, arg_min(fid, (d, fid)) AS fid, min(d) AS d FROM
   (SELECT a.qid, b.fid, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d FROM fix a JOIN address b ON {NEAR.format(d=0.002)}) WHERE d <= 150 GROUP BY qid),
 j AS (SELECT fix.qid, w.*, x.fid AS afid, x.d AS ad, td IS NOT NULL AND (rd IS NULL OR td < rd) AS tw FROM fix LEFT JOIN w ON w.qid = fix.qid LEFT JOIN x ON x.qid = fix.qid)
SELECT qid, CASE WHEN tw THEN 'trail' WHEN r IS NOT NULL THEN 'road' END AS way_kind, CASE WHEN tw THEN t ELSE r END AS way_fid,
  round(CASE WHEN tw THEN td ELSE rd END, 3) AS way_m, coalesce(CASE WHEN tw THEN td ELSE rd END <= 25, false) AS on_way, afid AS address_fid, round(ad, 3) AS address_m FROM j""")
def j8_locate(spark, sf):
    s = _lines(view(spark, sf, "seg"))
    out = lookup.locate(view(spark, sf, "fix"), s.filter("cls <> 0"), s.filter("cls = 0"), view(spark, sf, "address"), R)
    return _round(out, way_m=3, address_m=3)


@query("j9_building_at", ctes("fix", "box") + f""",
 i AS (SELECT a.qid, min(b.fid) AS fid FROM fix a JOIN box b ON a.lat >= lat0 AND a.lat < lat1 AND a.lon >= lon0 AND a.lon < lon1 GROUP BY a.qid),
 c AS (SELECT a.qid, b.fid, {hav('a.lat', 'a.lon', '(b.lat0 + b.lat1) / 2', '(b.lon0 + b.lon1) / 2')} AS d FROM fix a JOIN box b ON a.lat BETWEEN lat0 - 0.001 AND lat1 + 0.001 AND a.lon BETWEEN lon0 - 0.001 AND lon1 + 0.001),
 n AS (SELECT qid, arg_min(fid, (d, fid)) AS fid FROM c WHERE d <= 50 GROUP BY qid)
SELECT coalesce(i.qid, n.qid) AS qid, coalesce(i.fid, n.fid) AS fid, i.fid IS NOT NULL AS inside FROM i FULL JOIN n ON i.qid = n.qid""")
def j9_building_at(spark, sf):
    return lookup.building_at(view(spark, sf, "fix"), _ring(view(spark, sf, "box")))


@query("j10_radius_join", ctes("fix", "poi") + f"""
SELECT qid, fid, round(d, 3) AS distance_m FROM (SELECT a.qid, b.fid, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d FROM fix a JOIN poi b ON {NEAR.format(d=0.003)}) WHERE d <= 200""")
def j10_radius_join(spark, sf):
    # as the SQL rounds: F.round makes a decimal of each, which takes longer than the join
    near = lookup.businesses_near(view(spark, sf, "fix"), view(spark, sf, "poi"))
    return near.withColumn("distance_m", F.floor(F.col("distance_m") * 1000 + 0.5) / 1000)


@query("j11_batch_nearest", ctes("fix", "poi") + f""", n AS (SELECT qid, arg_min(fid, (d, fid)) AS fid, min(d) AS d FROM
 (SELECT a.qid, b.fid, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d FROM fix a JOIN poi b ON {NEAR.format(d=0.003)}) WHERE d <= 200 GROUP BY qid)
SELECT fix.qid, n.fid, round(n.d, 3) AS distance_m FROM fix LEFT JOIN n ON n.qid = fix.qid""")
def j11_batch_nearest(spark, sf):
    q = view(spark, sf, "fix")
    return _round(lookup.for_each(q, knn.nearest_point(q, view(spark, sf, "poi"), 200.0)), distance_m=3)


@query("j12_features_in_cells", ctes("fix", "poi") + """
SELECT fid, name FROM poi WHERE (floor(lat * 20)::BIGINT, floor(lon * 20)::BIGINT) IN (SELECT (floor(lat * 20)::BIGINT, floor(lon * 20)::BIGINT) FROM fix WHERE speed_mps > 30)""")
def j12_features_in_cells(spark, sf):
    c = F.struct(F.floor(F.col("lat") * 20), F.floor(F.col("lon") * 20)).alias("cell")
    return lookup.features_in(view(spark, sf, "poi").withColumn("cell", c), view(spark, sf, "fix").filter("speed_mps > 30").select(c)).select("fid", "name")


@query("j13_admin_at", """SELECT c_custkey AS qid, n_name AS nation_name, r_name AS region_name FROM customer
 LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def j13_admin_at(spark, sf):
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    q = read("customer").select(F.col("c_custkey").alias("qid"), F.col("c_nationkey").alias("cell"))
    grid = read("nation").select(F.col("n_nationkey").alias("cell"), F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    dims = {"nation": read("nation").selectExpr("n_nationkey AS idx", "n_name AS name"), "region": read("region").selectExpr("r_regionkey AS idx", "r_name AS name")}
    return lookup.admin_at(q, grid, dims).select("qid", "nation_name", "region_name")


@query("j15_cameras_near_road", ctes("poi", "seg") + f"""
SELECT DISTINCT a.fid, a.name FROM poi a JOIN seg b ON a.lat BETWEEN lat1 - 0.002 AND lat2 + 0.002 AND a.lon BETWEEN lon1 - 0.002 AND lon2 + 0.002
WHERE b.cls = 3 AND {seg_dist('a.lat', 'a.lon', 'lat1', 'lon1', 'lat2', 'lon2')} <= 100""")
def j15_cameras_near_road(spark, sf):
    return lookup.cameras_near_road(view(spark, sf, "poi"), _lines(view(spark, sf, "seg").filter("cls = 3")), 100.0).select("fid", "name")


@query("j17_segment_context", ctes("fix", "seg") + ", " + _SEGS.format(m=0.001) + f""",
 n AS (SELECT qid, arg_min(cls, (d, fid)) AS cls, arg_min(fid, (d, fid)) AS fid, min(d) AS d FROM s WHERE d <= 50 GROUP BY qid),
 g AS (SELECT user_id AS gid, cls, count(*) AS n, min(n.qid) AS met, arg_min(fid, (d, n.qid)) AS fid, min(d) AS d FROM n JOIN fix ON fix.qid = n.qid GROUP BY ALL),
 m AS (SELECT gid, arg_min(cls, (-n, met)) AS cls, arg_min(n, (-n, met)) AS n, arg_min(fid, (-n, met)) AS fid, arg_min(d, (-n, met)) AS d FROM g GROUP BY gid),
 c AS (SELECT a.user_id AS gid, a.qid, b.fid, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d FROM fix a JOIN (SELECT fid, lat1 AS lat, lon1 AS lon FROM seg WHERE cls = 1) b ON {NEAR.format(d=0.001)}),
 k AS (SELECT gid, arg_min(fid, (d, qid)) AS fid, min(d) AS d FROM c WHERE d <= 50 GROUP BY gid)
SELECT u.gid, 'class' || m.cls AS road_class, m.n AS n_points, m.fid AS road_fid, round(m.d, 3) AS road_m, k.fid AS control_fid, round(k.d, 3) AS control_m
FROM (SELECT DISTINCT user_id AS gid FROM fix) u LEFT JOIN m ON m.gid = u.gid LEFT JOIN k ON k.gid = u.gid""")
def j17_segment_context(spark, sf):
    pts = view(spark, sf, "fix").select(F.col("user_id").alias("gid"), F.col("qid").alias("seq"), "qid", "lat", "lon")
    s = view(spark, sf, "seg")
    roads = _lines(s).withColumn("road_class", F.concat(F.lit("class"), F.col("cls").cast("string")))
    x = s.filter("cls = 1").selectExpr("fid", "lat1 AS lat", "lon1 AS lon")
    return _round(lookup.segment_context(pts, roads, x), road_m=3, control_m=3)


@query("j18_all_layers", ctes("fix", "seg", "box", "poi") + ", " + _SEGS.format(m=0.002) + f""",
 n AS (SELECT qid, arg_min(fid, (d, fid)) AS fid, min(d) AS d FROM s WHERE d <= 100 GROUP BY qid),
 i AS (SELECT a.qid, min(b.fid) AS fid FROM fix a JOIN box b ON a.lat >= lat0 AND a.lat < lat1 AND a.lon >= lon0 AND a.lon < lon1 GROUP BY a.qid),
 z AS (SELECT a.qid, b.fid, {hav('a.lat', 'a.lon', '(b.lat0 + b.lat1) / 2', '(b.lon0 + b.lon1) / 2')} AS d FROM fix a JOIN box b ON a.lat BETWEEN lat0 - 0.001 AND lat1 + 0.001 AND a.lon BETWEEN lon0 - 0.001 AND lon1 + 0.001),
 y AS (SELECT qid, arg_min(fid, (d, fid)) AS fid FROM z WHERE d <= 50 GROUP BY qid),
 b AS (SELECT qid, count(*) AS k FROM (SELECT a.qid, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d FROM fix a JOIN poi b ON {NEAR.format(d=0.003)}) WHERE d <= 200 GROUP BY qid)
SELECT f.qid, n.fid AS road_fid, round(n.d, 3) AS road_m, coalesce(i.fid, y.fid) AS building_fid,
  CASE WHEN i.fid IS NOT NULL THEN true WHEN y.fid IS NOT NULL THEN false END AS in_building, coalesce(b.k, 0) AS n_businesses
FROM fix f LEFT JOIN n ON n.qid = f.qid LEFT JOIN i ON i.qid = f.qid LEFT JOIN y ON y.qid = f.qid LEFT JOIN b ON b.qid = f.qid""")
def j18_all_layers(spark, sf):
    out = lookup.all_layers(view(spark, sf, "fix"), _lines(view(spark, sf, "seg")), _ring(view(spark, sf, "box")), view(spark, sf, "poi"))
    return _round(out, road_m=3)


@query("c7_group_by_cell", ctes("fix") + """
SELECT floor(lat * 20)::BIGINT AS row, floor(lon * 20)::BIGINT AS col, count(*) AS n, min(qid) AS first_qid FROM fix GROUP BY ALL""")
def c7_group_by_cell(spark, sf):
    c = view(spark, sf, "fix").groupBy(F.floor(F.col("lat") * 20).alias("row"), F.floor(F.col("lon") * 20).alias("col"))
    return c.agg(F.count("*").alias("n"), F.min("qid").alias("first_qid"))


#: The boxes of the nations, a table of a few dozen rows by its nature: neighbours overlap, and there are gaps and a rim outside.
_STATES = "SELECT n_nationkey AS fid, 36.0 + (n_nationkey % 5) * 0.04 AS lat0, -87.0 + floor(n_nationkey / 5) * 0.06 AS lon0, 36.038 + (n_nationkey % 5) * 0.04 + (n_nationkey % 3) * 0.004 AS lat1, -86.943 + floor(n_nationkey / 5) * 0.06 + (n_nationkey % 2) * 0.005 AS lon1 FROM {nation}"
#: The same boxes to the last bit: DuckDB's floor() makes the longitudes doubles from the start, while its latitudes and their sum are
#: decimals until they meet a double. Fixes lie on borders, and as far from one centre as from another.
_STATE_BOXES = """SELECT fid, CAST(a AS DOUBLE) AS lat0, c AS lon0, CAST(b AS DOUBLE) AS lat1, d AS lon1, CAST(a + b AS DOUBLE) / 2 AS mid_lat, (c + d) / 2 AS mid_lon FROM
 (SELECT n_nationkey AS fid, 36.0 + (n_nationkey % 5) * 0.04 AS a, -87.0D + CAST(floor(n_nationkey / 5) AS DOUBLE) * 0.06D AS c, 36.038 + (n_nationkey % 5) * 0.04 + (n_nationkey % 3) * 0.004 AS b,
   -86.943D + CAST(floor(n_nationkey / 5) AS DOUBLE) * 0.06D + CAST((n_nationkey % 2) * 0.005 AS DOUBLE) AS d FROM {nation})"""


@query("c8_state_of", ctes("fix") + ", st AS (" + _STATES.format(nation="nation") + """),
 x AS (SELECT a.qid, b.fid, a.lat BETWEEN lat0 AND lat1 AND a.lon BETWEEN lon0 AND lon1 AS hit, pow(a.lat - (lat0 + lat1) / 2, 2) + pow(a.lon - (lon0 + lon1) / 2, 2) AS d FROM fix a, st b)
SELECT qid, arg_min(fid, (NOT hit, d, fid)) AS fid, bool_or(hit) AS inside FROM x GROUP BY qid""")
def c8_state_of(spark, sf):
    states = spark.sql(_STATE_BOXES, nation=spark.read.parquet(f"{sf}/nation.parquet"))
    return cells.state_of(view(spark, sf, "fix"), states)


@query("g1_haversine", ctes("seg") + f"""SELECT fid, round({hav('lat1', 'lon1', 'lat2', 'lon2')}, 3) AS length_m FROM seg""")
def g1_haversine(spark, sf):
    return view(spark, sf, "seg").select("fid", F.round(geo.haversine_m("lat1", "lon1", "lat2", "lon2"), 3).alias("length_m"))


@query("g2_wrap_lon_delta", ctes("seg") + """SELECT fid, round(d - 360 * round(d / 360), 6) AS delta FROM (SELECT fid, (fid * 37) % 1441 + 0.25 AS d FROM seg)""")
def g2_wrap_lon_delta(spark, sf):
    return view(spark, sf, "seg").select("fid", F.round(geo.wrap_lon_delta((F.col("fid") * 37) % 1441 + F.lit(0.25)), 6).alias("delta"))


@query("g4_segment_snap", ctes("seg", "poi") + f"""SELECT s.fid, round({seg_dist('p.lat', 'p.lon', 'lat1', 'lon1', 'lat2', 'lon2')}, 2) AS distance_m FROM seg s JOIN poi p ON p.fid = s.path_id""")
def g4_segment_snap(spark, sf):
    s, p = view(spark, sf, "seg"), view(spark, sf, "poi").selectExpr("fid AS path_id", "lat", "lon")
    return s.join(p, "path_id").select("fid", F.round(geo.snap("lat", "lon", "lat1", "lon1", "lat2", "lon2").distance_m, 2).alias("distance_m"))


@query("g5_line_distance", ctes("box", "poi") + f"""SELECT b.fid, round(least({', '.join(seg_dist('p.lat', 'p.lon', *s) for s in [('lat0', 'lon0', 'lat0', 'lon1'), ('lat0', 'lon1', 'lat1', 'lon1'), ('lat1', 'lon1', 'lat1', 'lon0')])}), 2) AS distance_m
FROM box b JOIN poi p ON p.fid = b.fid * 3""")
def g5_line_distance(spark, sf):
    b, p = _ring(view(spark, sf, "box")), view(spark, sf, "poi").selectExpr("fid AS pid", "lat", "lon")
    return b.join(p, F.col("pid") == b["fid"] * 3).select(b["fid"], F.round(geo.line_snap("lat", "lon", "coords").distance_m, 2).alias("distance_m"))


@query("g6_point_in_polygon", ctes("box", "fix") + """SELECT b.fid, count(*) AS n FROM box b JOIN fix a ON a.lat >= lat0 AND a.lat < lat1 AND a.lon >= lon0 AND a.lon < lon1 GROUP BY b.fid""")
def g6_point_in_polygon(spark, sf):
    return knn.areas_holding(view(spark, sf, "fix"), _ring(view(spark, sf, "box"))).groupBy("fid").agg(F.count("*").alias("n"))


@query("g7_segment_crossing", ctes("seg") + """, x AS (SELECT a.fid, b.fid AS other, a.lon2 - a.lon1 AS rx, a.lat2 - a.lat1 AS ry, b.lon2 - b.lon1 AS sx, b.lat2 - b.lat1 AS sy,
  b.lon1 - a.lon1 AS px, b.lat1 - a.lat1 AS py FROM seg a JOIN seg b ON a.path_id = b.path_id AND a.fid < b.fid),
 y AS (SELECT fid, other, (px * sy - py * sx) / (rx * sy - ry * sx) AS t, (px * ry - py * rx) / (rx * sy - ry * sx) AS u FROM x WHERE rx * sy - ry * sx <> 0)
SELECT fid, other, round(t, 6) AS at FROM y WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1""")
def g7_segment_crossing(spark, sf):
    s = view(spark, sf, "seg").select("path_id", "fid", *(F.struct(F.col(f"lon{i}").alias("lon"), F.col(f"lat{i}").alias("lat")).alias(f"p{i}") for i in (1, 2)))
    pairs = s.alias("a").join(s.alias("b"), F.expr("a.path_id = b.path_id AND a.fid < b.fid"))
    t = geo.crossing(F.col("a.p1"), F.col("a.p2"), F.col("b.p1"), F.col("b.p2"))
    return pairs.select(F.col("a.fid").alias("fid"), F.col("b.fid").alias("other"), F.round(t, 6).alias("at")).filter("at IS NOT NULL")


@query("g9_bearing", ctes("seg") + """, r AS (SELECT fid, radians(lat1) AS a, radians(lat2) AS b, radians(lon2 - lon1) AS d FROM seg),
 t AS (SELECT fid, degrees(atan2(sin(d) * cos(b), cos(a) * sin(b) - sin(a) * cos(b) * cos(d))) AS z FROM r)
SELECT fid, round(CASE WHEN z < 0 THEN z + 360 ELSE z END, 5) AS bearing, round(least(abs(CASE WHEN z < 0 THEN z + 360 ELSE z END - 200), 360 - abs(CASE WHEN z < 0 THEN z + 360 ELSE z END - 200)), 5) AS gap FROM t""")
def g9_bearing(spark, sf):
    b = geo.bearing("lat1", "lon1", "lat2", "lon2")
    return view(spark, sf, "seg").select("fid", F.round(b, 5).alias("bearing"), F.round(geo.bearing_gap(b, 200), 5).alias("gap"))


@query("g11_centroid", ctes("box") + """SELECT fid, round((lat0 + lat1) / 2, 6) AS lat, round((lon0 + lon1) / 2, 6) AS lon FROM box""")
def g11_centroid(spark, sf):
    c = geo.centroid("coords")
    return _ring(view(spark, sf, "box")).select("fid", F.round(c.lat, 6).alias("lat"), F.round(c.lon, 6).alias("lon"))


@query("g14_cumulative_m", ctes("seg") + f""", l AS (SELECT path_id, fid, lat1, lon1, lag(lat1) OVER w AS la, lag(lon1) OVER w AS lo FROM seg WINDOW w AS (PARTITION BY path_id ORDER BY fid))
SELECT path_id, round(sum(coalesce({hav('la', 'lo', 'lat1', 'lon1')}, 0)), 2) AS total_m, count(*) AS n FROM l GROUP BY path_id""")
def g14_cumulative_m(spark, sf):
    paths = view(spark, sf, "seg").groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("fid", "lon1", "lat1"))).alias("p"))
    paths = paths.select("path_id", F.transform("p", lambda x: F.struct(x.lon1.alias("lon"), x.lat1.alias("lat"))).alias("coords"))
    return paths.select("path_id", F.round(F.element_at(geo.cumulative_m("coords"), -1), 2).alias("total_m"), F.size("coords").cast("long").alias("n"))


_H = 1.01 * 1200.0 / (6371000.0 * 3.141592653589793 / 180)
_N = "greatest(1, floor(360 * cos(radians(least(90, greatest(abs({r} * {h} - 90 - {h}), abs(({r} + 2) * {h} - 90))))) / {h}))::BIGINT"
_GRID = f"""g AS (SELECT qid, lat, lon, floor((lat + 90) / {_H})::BIGINT AS r FROM fix),
 k AS (SELECT *, {_N.format(r="r", h=_H)} AS n FROM g), c AS (SELECT *, floor((lon + 180) / 360 * n)::BIGINT AS x FROM k)"""


@query("c1_cell_of", ctes("fix") + ", " + _GRID + "SELECT qid, r * 4294967296 + x AS cell FROM c")
def c1_cell_of(spark, sf):
    return view(spark, sf, "fix").select("qid", cells.cell_of(F.col("lat"), F.col("lon")).alias("cell"))


@query("c2_cell_center", ctes("fix") + ", " + _GRID + f"SELECT qid, round((r + 0.5::DOUBLE) * {_H}::DOUBLE - 90, 6) AS lat, round((x + 0.5::DOUBLE) * 360 / n - 180, 6) AS lon FROM c")
def c2_cell_center(spark, sf):
    c = cells.cell_center(cells.cell_of(F.col("lat"), F.col("lon")))
    return view(spark, sf, "fix").select("qid", F.round(c.lat, 6).alias("lat"), F.round(c.lon, 6).alias("lon"))


@query("c3_neighbor_cells", ctes("fix") + ", " + _GRID + f""", o AS (SELECT *, (x + 0.5) * 360 / n - 180 AS mid FROM c), d AS (SELECT qid, r, x, r + dr AS r2, mid, {_N.format(r="(r + dr)", h=_H)} AS n2 FROM o, (VALUES (-1), (0), (1)) v(dr)),
 e AS (SELECT DISTINCT qid, r, x, r2, floor((mid + 180) / 360 * n2)::BIGINT + dc AS x2 FROM d, (VALUES (-1), (0), (1)) w(dc))
SELECT qid, count(*) AS n, sum((r2 * 4294967296 + x2) % 1000003)::BIGINT AS checksum FROM e WHERE NOT (r2 = r AND x2 = x) GROUP BY qid""")
def c3_neighbor_cells(spark, sf):
    n = view(spark, sf, "fix").select("qid", F.explode(cells.neighbor_cells(cells.cell_of(F.col("lat"), F.col("lon")))).alias("c"))
    return n.groupBy("qid").agg(F.count("*").alias("n"), F.sum(F.col("c") % 1000003).alias("checksum"))


@query("c5_normalize_cell", "SELECT event_id, (event_id * 104729 + 608659748576821247) & ~2097151::BIGINT AS cell FROM events")
def c5_normalize_cell(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", cells.normalize_cell(F.col("event_id") * 104729 + F.lit(608659748576821247)).alias("cell"))


@query("c6_candidate_cells", ctes("fix") + ", " + _GRID + "SELECT qid, r * 4294967296 + x AS own, 9 AS n FROM c")
def c6_candidate_cells(spark, sf):
    k = cells.candidate_cells(F.col("lat"), F.col("lon"), 1)
    return view(spark, sf, "fix").select("qid", F.element_at(k, 1).alias("own"), F.size(k).alias("n"))


@query("s22_layer_coverage", ctes("poi") + "SELECT count(*) AS n, min(lat) AS min_lat, min(lon) AS min_lon, max(lat) AS max_lat, max(lon) AS max_lon FROM poi")
def s22_layer_coverage(spark, sf):
    from geoweave.sources import layers

    return layers.coverage(view(spark, sf, "poi"))


@query("d17_merge_layers", ctes("poi") + "SELECT CASE WHEN nationkey < 12 THEN 'AA' ELSE 'BB' END AS state, count(*) AS n, min(fid) AS first_fid FROM poi GROUP BY 1")
def d17_merge_layers(spark, sf):
    from geoweave.sources import layers

    p = view(spark, sf, "poi").withColumn("cell", cells.cell_of(F.col("lat"), F.col("lon")))
    both = layers.merge_states({"AA": p.filter("nationkey < 12"), "BB": p.filter("nationkey >= 12")})
    return both.groupBy("state").agg(F.count("*").alias("n"), F.min("fid").alias("first_fid"))


@query("g3_project_m", ctes("seg") + """SELECT fid, round(radians(lon2 - lon1) * cos(radians(lat1)) * 6371000.0::DOUBLE, 4) AS x, round(radians(lat2 - lat1) * 6371000.0::DOUBLE, 4) AS y FROM seg""")
def g3_project_m(spark, sf):
    return view(spark, sf, "seg").select("fid", F.round(geo.plane_x("lat1", "lon1", "lon2"), 4).alias("x"), F.round(geo.plane_y("lat1", "lat2"), 4).alias("y"))


@query("g8_ring_distance", ctes("box", "poi") + f"""SELECT b.fid, round({_border('p.lat', 'p.lon')}, 2) AS distance_m FROM box b JOIN poi p ON p.fid = b.fid * 3""")
def g8_ring_distance(spark, sf):
    b, p = _ring(view(spark, sf, "box")), view(spark, sf, "poi").selectExpr("fid AS pid", "lat", "lon")
    return b.join(p, F.col("pid") == b["fid"] * 3).select(b["fid"], F.round(geo.ring_distance_m("lat", "lon", "coords"), 2).alias("distance_m"))


_HEADING = "degrees(atan2(sin(radians({o2} - {o1})) * cos(radians({a2})), cos(radians({a1})) * sin(radians({a2})) - sin(radians({a1})) * cos(radians({a2})) * cos(radians({o2} - {o1}))))"
_OUT, _BACK = _HEADING.format(a1="lat1", o1="lon1", a2="lat2", o2="lon2"), _HEADING.format(a1="lat2", o1="lon2", a2="lat1", o2="lon1 + 0.0005")


@query("g15_heading_at", ctes("seg", "poi") + f""", x AS (SELECT s.fid, {hav('p.lat', 'p.lon', 'lat1', 'lon1')} AS d1, {hav('p.lat', 'p.lon', 'lat2', 'lon2')} AS d2, {hav('p.lat', 'p.lon', 'lat1', 'lon1 + 0.0005')} AS d3,
 {_OUT} AS h1, {_BACK} AS h2 FROM seg s JOIN poi p ON p.fid = s.path_id)
SELECT fid, round(CASE WHEN z < 0 THEN z + 360 ELSE z END, 5) AS heading FROM (SELECT fid, CASE WHEN d1 <= d2 AND d1 <= d3 THEN h1 ELSE h2 END AS z FROM x)""")
def g15_heading_at(spark, sf):
    p = lambda lat, lon: F.struct(lon.alias("lon"), F.col(lat).alias("lat"))
    s = view(spark, sf, "seg").withColumn("coords", F.array(p("lat1", F.col("lon1")), p("lat2", F.col("lon2")), p("lat1", F.col("lon1") + 0.0005)))
    both = s.join(view(spark, sf, "poi").selectExpr("fid AS path_id", "lat", "lon"), "path_id")
    return both.select("fid", F.round(geo.heading_at("lat", "lon", "coords"), 5).alias("heading"))


@query("m8_road_context", ctes("fix", "seg") + ", " + _SEGS.format(m=0.001) + f""", n AS (SELECT qid, arg_min(fid, (d, fid)) AS fid, min(d) AS d FROM s WHERE d <= 50 GROUP BY qid)
SELECT qid, 'class' || cls AS road_class, round(d, 3) AS distance_m, round(CASE WHEN z < 0 THEN z + 360 ELSE z END, 5) AS bearing FROM (SELECT n.*, seg.cls, {_OUT} AS z FROM n JOIN seg ON seg.fid = n.fid)""")
def m8_road_context(spark, sf):
    roads = _lines(view(spark, sf, "seg")).withColumn("road_class", F.concat(F.lit("class"), F.col("cls").cast("string")))
    out = lookup.road_context(view(spark, sf, "fix"), roads).select("qid", "road.*")
    return _round(out, distance_m=3, bearing=5)


@query("m7_holds_traffic", """SELECT event_id, (event_id % 6) IN (1, 2, 3) AND value <= 25 AS holds FROM events""")
def m7_holds_traffic(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", lookup.holds_traffic(F.col("event_id") % 6, F.col("value")).alias("holds"))


_CENTRES = f"SELECT r, x, n, (r + 0.5::DOUBLE) * {_H}::DOUBLE - 90 AS lat, (x + 0.5::DOUBLE) * 360 / n - 180 AS lon FROM c GROUP BY ALL"


@query("c9_viewport", ctes("fix") + ", " + _GRID + f", u AS ({_CENTRES})" + f"""
SELECT r * 4294967296 + x AS cell, round({hav('36.1', '-86.85', 'lat', 'lon')}, 2) AS distance_m FROM u ORDER BY {hav('36.1', '-86.85', 'lat', 'lon')}, cell LIMIT 300""")
def c9_viewport(spark, sf):
    seen = view(spark, sf, "fix").select(cells.cell_of(F.col("lat"), F.col("lon")).alias("cell")).distinct()
    c = cells.cell_center(F.col("cell"))
    return _round(cells.viewport(seen.withColumn("distance_m", geo.haversine_m(36.1, -86.85, c.lat, c.lon))), distance_m=2)


@query("c4_cells_for_bounds", f"""WITH b AS (SELECT n_nationkey AS nation, 36.0 + n_nationkey / 100 AS lat0, -87.0 + n_nationkey / 50 AS lon0, 36.05 + n_nationkey / 100 AS lat1, -86.93 + n_nationkey / 50 AS lon1 FROM nation),
 g AS (SELECT *, unnest(range(floor((lat0 + 90) / {_H})::BIGINT, floor((lat1 + 90) / {_H})::BIGINT + 1)) AS r FROM b), k AS (SELECT *, {_N.format(r="r", h=_H)} AS n FROM g)
SELECT nation, r * 4294967296 + unnest(range(floor((lon0 + 180) / 360 * n)::BIGINT, floor((lon1 + 180) / 360 * n)::BIGINT + 1)) AS cell FROM k""")
def c4_cells_for_bounds(spark, sf):
    b = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("nation"), *(F.lit(o) + F.col("n_nationkey") / d for o, d in ((36.0, 100), (-87.0, 50), (36.05, 100), (-86.93, 50))))
    b = b.toDF("nation", "lat0", "lon0", "lat1", "lon1")
    return b.select("nation", F.explode(cells.cells_of_bounds("lat0", "lon0", "lat1", "lon1")).alias("cell"))


@query("j14_addresses_in_cells", ctes("fix", "address") + f""", g AS (SELECT qid, floor((lat + 90) / {_H})::BIGINT AS r, lon FROM fix WHERE speed_mps > 48), k AS (SELECT *, {_N.format(r="r", h=_H)} AS n FROM g),
 o AS (SELECT r, floor((lon + 180) / 360 * n)::BIGINT AS x, n FROM k), d AS (SELECT r + dr AS r2, (x + 0.5) * 360 / n - 180 AS mid, {_N.format(r="(r + dr)", h=_H)} AS n2 FROM o, (VALUES (-1), (0), (1)) v(dr)),
 e AS (SELECT DISTINCT r2, floor((mid + 180) / 360 * n2)::BIGINT + dc AS x2 FROM d, (VALUES (-1), (0), (1)) w(dc)),
 a AS (SELECT *, floor((lat + 90) / {_H})::BIGINT AS r FROM address WHERE lat IS NOT NULL), b AS (SELECT *, {_N.format(r="r", h=_H)} AS n FROM a)
SELECT fid, housenumber, street FROM b WHERE (r, floor((lon + 180) / 360 * n)::BIGINT) IN (SELECT (r2, x2) FROM e)""")
def j14_addresses_in_cells(spark, sf):
    a = view(spark, sf, "address").filter("lat IS NOT NULL").withColumn("cell", cells.cell_of(F.col("lat"), F.col("lon")))
    wanted = view(spark, sf, "fix").filter("speed_mps > 48").select(F.explode(cells.candidate_cells(F.col("lat"), F.col("lon"), 1)).alias("cell"))
    return lookup.features_in(a, wanted).select("fid", "housenumber", "street")
