"""Queries of motion, segments, navigation, charging and routing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geoweave.functions import geo, stats
from geoweave.operators import ev, motion, nav, route, segments
from geoweave.streaming import stateful

from .base import query
from .spatial import _lines, _round
from .views import ctes, hav, seg_dist, view


def _trace(spark, sf):
    t = view(spark, sf, "trace").withColumnRenamed("user_id", "device")
    return t.withColumns({"lat": 36 + F.col("seq") / 1e5, "lon": -87 + F.col("device") / 1e3}).withColumn("speed_mps", F.col("speed_mps") / 6)


_SMOOTH = """ok AS (SELECT user_id, seq, t_ms, speed_mps / 6 AS v, lag(t_ms) OVER (PARTITION BY user_id ORDER BY seq) AS p FROM trace WHERE accuracy_m <= 50),
 il AS (SELECT *, sum(CASE WHEN t_ms - p > 30000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS island FROM ok),
 sm AS (SELECT *, avg(v) OVER (PARTITION BY user_id, island ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s FROM il),
 bd AS (SELECT *, CASE WHEN s <= 0.5 THEN 'stationary' WHEN s >= 5 THEN 'driving' ELSE 'walking' END AS band FROM sm)"""


@query("m1_speed_bands", ctes("trace") + ", " + _SMOOTH + "SELECT user_id AS device, seq, round(s, 6) AS smoothed_mps, band FROM bd")
def m1_speed_bands(spark, sf):
    return _round(motion.smoothed_speeds(_trace(spark, sf)).select("device", "seq", "smoothed_mps", "band"), smoothed_mps=6)


#: The same walk over a device's rows as a recursion: the n-th accepted fix of every device in the n-th round.
_STATES = """nb AS (SELECT user_id, seq, t_ms, s, band, coalesce(t_ms - p > 30000, false) AS gap, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn FROM bd),
 st(user_id, rn, state, pend, n) AS (SELECT DISTINCT user_id, 0::BIGINT, 'unknown', NULL::VARCHAR, 0 FROM trace
  UNION ALL SELECT user_id, rn, CASE WHEN band = state OR k >= 2 THEN band ELSE state END, CASE WHEN band <> state AND k < 2 THEN band END, k
  FROM (SELECT b.user_id, b.rn, b.band, st.state, CASE WHEN NOT b.gap AND pend IS NOT DISTINCT FROM b.band THEN n + 1 ELSE 1 END AS k FROM st JOIN nb b ON b.user_id = st.user_id AND b.rn = st.rn + 1) x)"""


@query("m1_motion_states", ctes("trace").replace("WITH", "WITH RECURSIVE", 1) + ", " + _SMOOTH + ", " + _STATES + """,
 al AS (SELECT user_id, seq, t_ms, count(*) FILTER (accuracy_m <= 50) OVER (PARTITION BY user_id ORDER BY seq) AS k FROM trace)
SELECT al.user_id AS device, al.seq, al.t_ms, st.state, round(nb.s, 6) AS smoothed_mps FROM al JOIN st ON st.user_id = al.user_id AND st.rn = k LEFT JOIN nb ON nb.user_id = al.user_id AND nb.rn = k""")
def m1_motion_states(spark, sf):
    return _round(stateful.batch(_trace(spark, sf), "speed"), smoothed_mps=6)


_AXES = "list_transform(range(12), lambda i: ((event_id * (i + {k})) % 17) / 8.0)"


@query("m2_accel_stats", f"""WITH a AS (SELECT event_id, list_transform(range(12), lambda i: sqrt(pow(((event_id * (i + 1)) % 17) / 8.0, 2) + pow(((event_id * (i + 2)) % 17) / 8.0, 2) + pow(((event_id * (i + 3)) % 17) / 8.0, 2))) AS m FROM events)
SELECT event_id, round(list_avg(m), 6) AS mean_magnitude, round(list_var_pop(m), 6) AS variance FROM a""")
def m2_accel_stats(spark, sf):
    axis = lambda k: F.transform(F.sequence(F.lit(0), F.lit(11 + k)), lambda i: (F.col("event_id") * (i + k)) % 17 / 8.0)
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", motion.accel_stats(axis(1), axis(2), F.slice(axis(3), 1, 12)).alias("s"))
    return e.select("event_id", F.round("s.mean_magnitude", 6).alias("mean_magnitude"), F.round("s.variance", 6).alias("variance"))


@query("m3_step_cadence", """WITH w AS (SELECT k, j, sin(j / 50.0::DOUBLE * 6.283185307179586 * (0.5 + k / 2.0)) AS y FROM range(8) a(k), range(100) b(j)),
 x AS (SELECT k, j, y - avg(y) OVER (PARTITION BY k) AS x FROM w),
 e AS (SELECT k, sum(x * x) AS e FROM x GROUP BY k),
 r AS (SELECT a.k, l, sum(a.x * b.x) AS r FROM range(13, 100) c(l), x a, x b WHERE a.k = b.k AND b.j = a.j + l GROUP BY a.k, l),
 m AS (SELECT r.k, arg_max(l, (round(r / e, 12), -l)) AS l, max(r / e) AS c, any_value(e) AS e FROM r JOIN e ON e.k = r.k GROUP BY r.k)
SELECT event_id, CASE WHEN e < 1e-4 OR c < 0.4 THEN 0 ELSE floor(100.0 / l + 0.5)::INT END AS steps, round(CASE WHEN e < 1e-4 OR c < 0.4 THEN 0 ELSE 50.0 / l END, 6) AS cadence_hz
FROM events JOIN m ON m.k = event_id % 8""")
def m3_step_cadence(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    wave = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: 1 + F.sin(i / 50.0 * 6.283185307179586 * (0.5 + F.col("event_id") % 8 / 2.0)))
    return motion.step_cadence(e.select("event_id", wave.alias("magnitudes")), 50.0).select("event_id", "steps", F.round("cadence_hz", 6).alias("cadence_hz"))


_CLASSES = ("motorway", "residential", "footway", "primary_link", "primary")


@query("m4_classify", """WITH e AS (SELECT event_id, value / 30 AS s, CASE WHEN event_id % 5 <> 0 THEN (event_id % 45)::DOUBLE END AS acc,
   CASE WHEN event_id % 3 <> 0 THEN ['motorway', 'residential', 'footway', 'primary_link', 'primary'][1 + event_id % 5] END AS cls, ((event_id * 7) % 80)::DOUBLE AS d,
   (event_id % 9) / 2.0 AS f, (event_id % 31) / 10.0 AS v, event_id % 7 AS n, CASE WHEN event_id % 2 = 0 THEN 'driving' ELSE 'walking' END AS prev FROM events),
 k AS (SELECT *, coalesce(cls = 'motorway' OR cls = 'primary_link', false) AS hw, coalesce(cls = 'residential', false) AS st, coalesce(cls = 'footway', false) AS ft, f BETWEEN 1 AND 3 AND n > 3 AND v > 0.01 AS step FROM e),
 c AS (SELECT *, hw AND d < 10 AND s > 2.2 AS onhw, CASE WHEN f > 2.5 AND v > 0.3 THEN 'running' WHEN f > 1 AND v > 0.01 THEN 'walking' WHEN n > 0 AND v > 0.02 THEN 'walking' WHEN f < 1 AND v < 1 THEN 'stationary' WHEN f < 1 AND v < 5 THEN 'driving' ELSE 'stationary' END AS am FROM k)
SELECT event_id, CASE WHEN acc > 30 THEN CASE WHEN s > 8.9 THEN 'driving' ELSE am END
  WHEN onhw AND NOT (d > 5 AND f BETWEEN 1 AND 3 AND n > 4) THEN 'driving' WHEN NOT onhw AND ft AND d < 5 AND s > 1.1 THEN 'walking'
  WHEN NOT onhw AND st AND d < 10 AND s > 2.2 THEN 'driving' WHEN NOT onhw AND cls IS NOT NULL AND d > 50 AND s BETWEEN 0.5 AND 2.2 THEN 'walking'
  WHEN prev = 'driving' AND s > 0.3 AND NOT step AND d < 15 AND (hw OR st) THEN 'driving'
  WHEN prev = 'walking' AND f = 0 AND v = 0 AND n = 0 AND s > 0.5 AND s <= 2.2 THEN 'walking'
  WHEN s > 8.9 THEN 'driving' WHEN s > 5 AND NOT step THEN 'driving' WHEN s > 2.2 THEN 'walking' ELSE am END AS movement FROM c""")
def m4_classify(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    i = F.col("event_id")
    road = F.when(i % 3 != 0, F.element_at(F.lit(list(_CLASSES)), (i % 5 + 1).cast("int")))
    none = F.lit(None).cast("double")
    far = F.when(road.isNotNull(), ((i * 7) % 80).cast("double"))
    v = motion.vote(F.col("value") / 30, F.when(i % 5 != 0, (i % 45).cast("double")), road, far, none, none, (i % 9) / 2.0, (i % 31) / 10.0, i % 7, F.lit(4.0), F.when(i % 2 == 0, "driving").otherwise("walking"))
    return e.select("event_id", v.movement.alias("movement"))


@query("m5_accel_vote", """SELECT event_id, CASE WHEN f > 2.5 AND v > 0.3 THEN 0.5 WHEN f > 1 AND v > 0.01 THEN 0.6 WHEN n > 0 AND v > 0.02 THEN 0.4 WHEN f < 1 AND v < 1 THEN 0.7 WHEN f < 1 AND v < 5 THEN 0.4 ELSE 0.85 END::DOUBLE AS confidence
FROM (SELECT event_id, (event_id % 9) / 3.0 AS f, (event_id % 31) / 5.0 AS v, event_id % 3 AS n FROM events)""")
def m5_accel_vote(spark, sf):
    i = F.col("event_id")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", motion.vote_by_accel((i % 9) / 3.0, (i % 31) / 5.0, i % 3).confidence.alias("confidence"))


_HELD = """v AS (SELECT user_id, seq, t_ms, band, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn FROM bd),
 h(user_id, rn, votes, cur, pend, n, since, drove) AS (SELECT DISTINCT user_id, 0::BIGINT, []::VARCHAR[], 'unknown', NULL::VARCHAR, 0, 0::BIGINT, NULL::BIGINT FROM v
  UNION ALL SELECT user_id, rn, votes, CASE WHEN go THEN major ELSE cur END, CASE WHEN major IS NULL THEN pend WHEN major = cur OR go THEN NULL ELSE major END, n2, since2, drove FROM
   (SELECT *, major IS NOT NULL AND major <> cur AND NOT (cur = 'driving' AND major = 'stationary' AND drove IS NOT NULL AND greatest(0, t_ms - drove) < 150000)
      AND n2 >= 3 AND greatest(0, t_ms - since2) >= CASE WHEN major = 'driving' THEN 15000 ELSE 60000 END AS go FROM
    (SELECT *, CASE WHEN major IS NULL OR major = cur THEN n WHEN pend IS NOT DISTINCT FROM major THEN n + 1 ELSE 1 END AS n2,
        CASE WHEN major IS NULL OR major = cur OR pend IS NOT DISTINCT FROM major THEN since ELSE t_ms END AS since2 FROM
     (SELECT *, CASE WHEN 2 * len(list_filter(votes, lambda x: x = 'driving')) > len(votes) THEN 'driving' WHEN 2 * len(list_filter(votes, lambda x: x = 'walking')) > len(votes) THEN 'walking'
         WHEN 2 * len(list_filter(votes, lambda x: x = 'stationary')) > len(votes) THEN 'stationary' END AS major FROM
      (SELECT v.user_id, v.rn, v.t_ms, list_append(h.votes, v.band)[-5:] AS votes, cur, pend, n, since, CASE WHEN v.band = 'driving' THEN v.t_ms ELSE drove END AS drove
       FROM h JOIN v ON v.user_id = h.user_id AND v.rn = h.rn + 1) a) b) c) d)"""


@query("m6_debounced", ctes("trace").replace("WITH", "WITH RECURSIVE", 1) + ", " + _SMOOTH + ", " + _HELD + "SELECT v.user_id AS device, v.seq, v.t_ms, h.cur AS movement FROM v JOIN h ON h.user_id = v.user_id AND h.rn = v.rn")
def m6_debounced(spark, sf):
    votes = motion.smoothed_speeds(_trace(spark, sf)).select("device", "seq", "t_ms", F.col("band").alias("vote"))
    return stateful.batch(votes, "hold")


@query("m9_movement_tracker", None)
def m9_movement_tracker(spark, sf):
    return _round(stateful.batch(_trace(spark, sf), "track_responsive"), smoothed_mps=6)


@query("m11_adaptive_session", None)
def m11_adaptive_session(spark, sf):
    return _round(stateful.batch(_trace(spark, sf), "session"), smoothed_mps=6)


_SHIFT = """x AS (SELECT user_id, seq, speed_mps AS v, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n, avg(speed_mps) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS m1,
   avg(speed_mps) OVER (w ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS m2, var_samp(speed_mps) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) / 12 AS a,
   var_samp(speed_mps) OVER (w ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) / 12 AS b FROM trace WINDOW w AS (PARTITION BY user_id ORDER BY seq))"""


@query("m12_shift_tests", ctes("trace") + ", " + _SHIFT + """
SELECT user_id AS device, idx, round((m2 - m1) / sqrt(a + b), 5) AS t_stat, round((a + b) * (a + b) / ((a * a + b * b) / 11), 4) AS df FROM x
WHERE n >= 25 AND idx >= 12 AND idx < n - 12 AND a + b > 0 AND abs(m2 - m1) >= 0.4""")
def m12_shift_tests(spark, sf):
    t = view(spark, sf, "trace").withColumnRenamed("user_id", "device")
    return _round(motion.shift_tests(t).select("device", F.col("idx").cast("long").alias("idx"), "t_stat", "df"), t_stat=5, df=4)


@query("m12_significant_shifts", None)
def m12_significant_shifts(spark, sf):
    t = view(spark, sf, "trace").withColumnRenamed("user_id", "device")
    return _round(motion.significant_shifts(t, alpha=0.5).select("device", "idx", "t_stat", "p_value"), t_stat=5, p_value=8)


@query("m14_speed_band", "SELECT event_id, CASE WHEN value / 60 <= 0.5 THEN 'stationary' WHEN value / 60 >= 5 THEN 'driving' ELSE 'walking' END AS band FROM events")
def m14_speed_band(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", motion.speed_band(F.col("value") / 60).alias("band"))


def _points(spark, sf):
    kinds = F.create_map(*(F.lit(x) for k, v in (("click", "walking"), ("error", "stationary"), ("purchase", "driving"), ("signup", "driving"), ("view", "driving")) for x in (k, v)))
    t = view(spark, sf, "trace")
    return t.select(F.col("user_id").alias("device"), F.col("seq").alias("idx"), "t_ms", F.element_at(kinds, F.col("event_type")).alias("movement"), F.col("event_type").alias("vote"), F.col("speed_mps").alias("smoothed_mps"), (F.col("speed_mps") / 50).alias("confidence"), (F.col("accuracy_m") == 0).alias("at_control"))


_RUNS = """pt AS (SELECT user_id, seq, t_ms, speed_mps, accuracy_m, event_type AS vote, CASE event_type WHEN 'click' THEN 'walking' WHEN 'error' THEN 'stationary' ELSE 'driving' END AS mv FROM trace),
 ch AS (SELECT *, CASE WHEN mv IS DISTINCT FROM lag(mv) OVER (PARTITION BY user_id ORDER BY seq) THEN 1 ELSE 0 END AS c FROM pt),
 isl AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY seq) AS g FROM ch),
 rn AS (SELECT user_id, g, min(seq) AS s, max(seq) AS e, any_value(mv) AS ty FROM isl GROUP BY user_id, g),
 kp AS (SELECT *, sum(CASE WHEN e - s + 1 >= 3 OR g = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s) AS k FROM rn),
 ab AS (SELECT user_id, k, min(s) AS s, max(e) AS e, arg_min(ty, s) AS ty FROM kp GROUP BY user_id, k),
 c2 AS (SELECT *, CASE WHEN ty IS DISTINCT FROM lag(ty) OVER (PARTITION BY user_id ORDER BY s) THEN 1 ELSE 0 END AS c FROM ab),
 i2 AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY s) AS g FROM c2),
 sg AS (SELECT user_id, min(s) AS s, max(e) AS e, any_value(ty) AS ty FROM i2 GROUP BY user_id, g)"""


@query("l2_coalesce", ctes("trace") + ", " + _RUNS + 'SELECT user_id AS device, s AS "start", e AS "end", ty AS "type" FROM sg')
def l2_coalesce(spark, sf):
    return segments.coalesce(_points(spark, sf)).select("device", "start", "end", "type")


_LABELLED = """lb AS (SELECT sg.s, sg.e, sg.ty, pt.* FROM sg JOIN pt ON pt.user_id = sg.user_id AND pt.seq BETWEEN sg.s AND sg.e),
 vt AS (SELECT user_id, s, vote, count(*) AS n, min(seq) AS met FROM lb GROUP BY ALL),
 tp AS (SELECT user_id, s, arg_min(vote, (-n, met)) AS vote FROM vt GROUP BY ALL),
 an AS (SELECT user_id, s, any_value(ty) AS ty, avg(speed_mps / 50) AS cf, count(*) AS n, min(t_ms) AS t0, max(t_ms) AS t1, bool_or(accuracy_m = 0) AS ac FROM lb GROUP BY user_id, s)"""


@query("l3_annotate", ctes("trace") + ", " + _RUNS + ", " + _LABELLED + """
SELECT an.user_id AS device, an.s AS "start", round(cf, 6) AS confidence, n AS points, t0, t1, ac AS at_control, tp.vote FROM an JOIN tp ON tp.user_id = an.user_id AND tp.s = an.s""")
def l3_annotate(spark, sf):
    p = _points(spark, sf)
    return _round(segments.annotate(segments.coalesce(p), p).select("device", "start", "confidence", "points", "t0", "t1", "at_control", "vote"), confidence=6)


@query("l5_slice_range", ctes("trace") + ", " + _RUNS + """, mx AS (SELECT user_id, max(seq) AS n FROM trace GROUP BY user_id),
 pl AS (SELECT pt.user_id, pt.seq, seq BETWEEN n // 3 AND n // 2 AS ed, CASE WHEN seq BETWEEN n // 3 AND n // 2 THEN 'running' ELSE ty END AS ty
   FROM pt JOIN sg ON sg.user_id = pt.user_id AND pt.seq BETWEEN s AND e JOIN mx ON mx.user_id = pt.user_id),
 pc AS (SELECT *, CASE WHEN (ty, ed) IS DISTINCT FROM lag((ty, ed)) OVER (PARTITION BY user_id ORDER BY seq) THEN 1 ELSE 0 END AS c FROM pl),
 pi AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY seq) AS g FROM pc)
SELECT user_id AS device, min(seq) AS "start", max(seq) AS "end", any_value(ty) AS "type", any_value(ed) AS edited FROM pi GROUP BY user_id, g""")
def l5_slice_range(spark, sf):
    p = _points(spark, sf)
    edits = p.groupBy("device").agg(F.max("idx").alias("n")).select("device", F.expr("n div 3").alias("lo"), F.expr("n div 2").alias("hi"), F.lit("running").alias("type"))
    return segments.overlay(segments.coalesce(p), edits)


@query("l6_dominant_band", ctes("trace") + """, q AS (SELECT user_id, CASE WHEN speed_mps <= 0.5 THEN 'stationary' WHEN speed_mps >= 5 THEN 'driving' ELSE 'walking' END AS b, seq FROM trace
   WHERE t_ms BETWEEN 0 AND 200000 AND speed_mps BETWEEN 1 AND 6),
 n AS (SELECT user_id, b, count(*) AS n, min(seq) AS met FROM q GROUP BY ALL)
SELECT user_id AS device, arg_min(b, (-n, met)) AS "type", round(max(n) / sum(n), 6) AS share, sum(n)::BIGINT AS counted FROM n GROUP BY user_id""")
def l6_dominant_band(spark, sf):
    p = _points(spark, sf)
    rects = p.select("device").distinct().select("device", F.lit(0).alias("rect"), F.lit(0).alias("t0"), F.lit(200000).alias("t1"), F.lit(1.0).alias("v_min"), F.lit(6.0).alias("v_max"))
    return _round(segments.dominant_band(p, rects, motion.speed_band(F.col("smoothed_mps"))).select("device", "type", "share", "counted"), share=6)


@query("l7_sample_indices", """WITH s AS (SELECT o_orderkey AS fid, o_orderkey % 50 AS a, o_orderkey % 50 + o_orderkey % 23 AS b FROM orders)
SELECT fid, CASE WHEN b - a + 1 <= 5 THEN range(a, b + 1) ELSE list_transform(range(5), lambda k: a + floor(k * (b - a) / 4 + 0.5)::BIGINT) END AS idx FROM s""")
def l7_sample_indices(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS fid", "o_orderkey % 50 AS a", "o_orderkey % 50 + o_orderkey % 23 AS b")
    return o.select("fid", segments.sample_indices(F.col("a"), F.col("b")).alias("idx"))


@query("l8_time_per_label", ctes("trace") + ", " + _RUNS + ", " + _LABELLED + 'SELECT user_id AS device, ty AS "type", sum(t1 - t0)::BIGINT AS ms FROM an GROUP BY user_id, ty')
def l8_time_per_label(spark, sf):
    p = _points(spark, sf)
    return segments.time_per_label(segments.annotate(segments.coalesce(p), p), "device")


def _paths(spark, sf):
    """A walk a customer: steps of their orders, about 1 km each."""
    s = view(spark, sf, "seg")
    w = Window.partitionBy("path_id").orderBy("fid")
    steps = s.select("path_id", "fid", (F.row_number().over(w) - 1).cast("long").alias("i"), ((F.col("fid") * 31 % 21 - 6.5) / 1000).alias("dy"), ((F.col("fid") * 17 % 21 - 6.5) / 1000).alias("dx"))
    return steps.select("path_id", "i", (36 + F.sum("dy").over(w)).alias("lat"), (F.lit(-87.0) + F.sum("dx").over(w)).alias("lon"))


_PATHS = """st AS (SELECT path_id, row_number() OVER w - 1 AS i, 36 + sum((fid * 31 % 21 - 6.5::DOUBLE) / 1000) OVER w AS lat, -87.0 + sum((fid * 17 % 21 - 6.5::DOUBLE) / 1000) OVER w AS lon FROM seg WINDOW w AS (PARTITION BY path_id ORDER BY fid)),
 nx AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM st WINDOW w AS (PARTITION BY path_id ORDER BY i))"""


@query("n1_turn_angles", ctes("seg") + ", " + _PATHS + """,
 b AS (SELECT *, degrees(atan2(sin(radians(lon2 - lon)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon)))) AS out FROM nx),
 c AS (SELECT *, lag(out) OVER (PARTITION BY path_id ORDER BY i) AS inn, lat2 IS NOT NULL AS mid FROM b),
 d AS (SELECT *, (out - inn) - 360 * ceil((out - inn - 180) / 360) AS dl FROM c WHERE mid AND inn IS NOT NULL)
SELECT path_id, i AS idx, round(dl, 4) AS delta_deg, CASE WHEN abs(dl) >= 150 THEN 'u_turn' WHEN abs(dl) >= 100 THEN 'sharp_' || side WHEN abs(dl) >= 60 THEN side ELSE 'slight_' || side END AS maneuver,
 round(lat, 7) AS lat, round(lon, 7) AS lon FROM (SELECT *, CASE WHEN dl > 0 THEN 'right' ELSE 'left' END AS side FROM d) WHERE abs(dl) >= 25""")
def n1_turn_angles(spark, sf):
    t = nav.turn_queue(_paths(spark, sf)).filter("maneuver NOT IN ('depart', 'arrive')")
    return _round(t.select("path_id", "idx", "delta_deg", "maneuver", "lat", "lon"), delta_deg=4, lat=7, lon=7)


@query("n2_named_turns", None)
def n2_named_turns(spark, sf):
    roads = _lines(view(spark, sf, "seg")).select("fid", "coords", F.when(F.col("fid") % 3 != 0, F.concat(F.lit("road "), F.col("fid").cast("string"))).alias("name"), F.lit(None).cast("string").alias("ref_tag"), F.lit("residential").alias("road_class"))
    return _round(nav.name_turns(nav.turn_queue(_paths(spark, sf)), roads, 300.0), delta_deg=4, along_m=3, lat=7, lon=7, probe_lat=7, probe_lon=7)


@query("n3_navigate", None)
def n3_navigate(spark, sf):
    p = _paths(spark, sf)
    fixes = p.select(F.col("path_id").alias("trip"), F.col("i").alias("seq"), (F.col("i") * 60000).alias("t_ms"), (F.col("lat") + (F.col("path_id") % 7) / 1e4).alias("lat"), "lon", F.lit(5.0).alias("accuracy_m"))
    out = nav.navigate(fixes, p, nav.turn_queue(p))
    return _round(out, lat=6, lon=6, offset_m=2, along_m=2, remaining_m=2, bearing_deg=2, distance_to_turn_m=2)


def _chargers(spark, sf):
    poi = view(spark, sf, "poi")
    access = F.element_at(F.lit(list(ev.ACCESS)), (F.col("fid") % 6 + 1).cast("int"))
    return poi.select("fid", (36 + F.col("fid") % 97 / 1000 - 0.02).alias("lat"), (F.lit(-87.0) + F.col("fid") % 89 / 1000 - 0.02).alias("lon"), access.alias("access"), F.when(F.col("fid") % 4 != 0, (F.col("fid") % 150).cast("double")).alias("power_kw"), (F.col("fid") * 37 % 8192).alias("bits"))


@query("ev1_charger_kinds", """SELECT c_custkey AS fid, c_custkey % 6 NOT IN (4, 5) AS public, bit_count(c_custkey * 37 % 8192)::INT AS n_kinds,
 (c_custkey * 37 % 8192) & (2 + 8 + 32 + 64 + 256) <> 0 AS fast FROM customer""")
def ev1_charger_kinds(spark, sf):
    k = ev.connectors(F.col("bits"))
    return _chargers(spark, sf).select("fid", ev.is_public(F.col("access")).alias("public"), F.size(k).alias("n_kinds"), ev.has_fast(k).alias("fast"))


@query("ev2_project_onto", ctes("seg", "poi") + ", " + _PATHS + f""",
 ln AS (SELECT *, coalesce(sum({hav('lat', 'lon', 'lat2', 'lon2')}) OVER (PARTITION BY path_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS al FROM nx),
 ch AS (SELECT fid, 36 + fid % 97 / 1000 - 0.02 AS clat, -87.0 + fid % 89 / 1000 - 0.02 AS clon FROM poi),
 pr AS (SELECT path_id, fid, i, {seg_dist('clat', 'clon', 'lat', 'lon', 'lat2', 'lon2')} AS d FROM ln JOIN ch ON lat2 IS NOT NULL
    AND clat BETWEEN least(lat, lat2) - 0.004 AND greatest(lat, lat2) + 0.004 AND clon BETWEEN least(lon, lon2) - 0.004 AND greatest(lon, lon2) + 0.004)
SELECT path_id, fid, round(min(d), 2) AS detour_m FROM pr WHERE d <= 300 GROUP BY path_id, fid""")
def ev2_project_onto(spark, sf):
    return ev.project_onto(_paths(spark, sf), _chargers(spark, sf).select("fid", "lat", "lon"), 300.0, digits=2).select("path_id", "fid", "detour_m")


@query("ev3_plan_charge_stops", None)
def ev3_plan_charge_stops(spark, sf):
    p = _paths(spark, sf)
    trips = p.select("path_id").distinct().withColumn("range_m", 4000.0 + F.col("path_id") % 5 * 1000)
    out = ev.plan_charge_stops(p, trips, _chargers(spark, sf), 1000.0)
    return out.select("path_id", F.round("route_m", 2).alias("route_m"), "usable_range_m", "reachable", F.round("shortfall_m", 2).alias("shortfall_m"), F.transform("stops", lambda s: s.fid).alias("stop_fids"))


def _roads(spark, sf):
    """Streets of a lattice: each order joins two neighbouring crossings, 200 m apart."""
    classes = F.element_at(F.lit(["residential", "primary", "motorway", "footway", "service"]), (F.expr("fid div 7 % 5") + 1).cast("int"))
    s = view(spark, sf, "seg")
    y, x, end = F.col("fid") % 20, F.expr("fid div 20 % 30"), F.expr("fid div 600 % 2")
    p = lambda a, b: F.struct((F.lit(-87.0) + b * 0.002).alias("lon"), (36 + a * 0.002).alias("lat"))
    coords = F.array(p(y, x), p(y + end, x + 1 - end))
    oneway = F.when(F.col("fid") % 11 == 0, "yes").when(F.col("fid") % 13 == 0, "reverse")
    return s.select("fid", classes.alias("road_class"), coords.alias("coords"), oneway.alias("oneway"), F.when(F.col("fid") % 4 == 0, F.lit(50.0)).alias("speed_limit_kmh"))


_HOPS = """rd AS (SELECT fid, fid // 7 % 5 AS c, fid % 20 AS y, fid // 20 % 30 AS x, fid // 600 % 2 AS e, CASE WHEN fid % 4 = 0 THEN 50.0 ELSE [20, 65, 90, 0, 10][1 + fid // 7 % 5] END AS kmh FROM seg WHERE fid // 7 % 5 <> 3),
 sc AS (SELECT cos(radians(36 + arg_min(fid % 20, fid) * 0.002)) AS k FROM seg),
 hp AS (SELECT fid, y * 100 + x AS f, (y + e) * 100 + x + 1 - e AS t, round(sqrt(pow((1 - e) * 0.002 * k * 111320, 2) + pow(e * 0.002 * 111320, 2)) / (kmh * 0.85 / 3.6) * 100)::BIGINT AS w FROM rd, sc),
 dr AS (SELECT f, t, w FROM hp WHERE NOT (fid % 11 <> 0 AND fid % 13 = 0) UNION ALL SELECT t, f, w FROM hp WHERE fid % 11 <> 0),
 ed AS (SELECT f, t, min(w) AS w FROM dr GROUP BY f, t)"""


@query("r6_hop_weights", ctes("seg") + ", " + _HOPS + "SELECT w AS weight, count(*) AS n FROM dr GROUP BY w")
def r6_hop_weights(spark, sf):
    return route.hops(_roads(spark, sf)).groupBy("weight").agg(F.count("*").alias("n"))


def _graph(spark, sf, **kw):
    h = route.hops(_roads(spark, sf))
    return route.graph(h, route.merged_nodes(h), **kw)


def _crossing(key):
    x, y = route._units(key)
    return F.round((y / route.NODE_UNITS - 36) / 0.002).cast("long") * 100 + F.round((x / route.NODE_UNITS + 87) / 0.002).cast("long")


@query("r7_edge_dedupe", ctes("seg") + ", " + _HOPS + "SELECT f, t, w AS weight FROM ed")
def r7_edge_dedupe(spark, sf):
    return _graph(spark, sf).select(_crossing(F.col("f")).alias("f"), _crossing(F.col("t")).alias("t"), "weight")


@query("r8_junction_penalty", ctes("seg") + ", " + _HOPS + """, ar AS (SELECT t, count(DISTINCT f) AS arms FROM (SELECT f, t FROM ed UNION ALL SELECT t, f FROM ed) GROUP BY t)
SELECT f, ed.t, w + CASE WHEN arms > 2 THEN (arms - 2) * 1200 ELSE 0 END AS weight FROM ed JOIN ar ON ar.t = ed.t""")
def r8_junction_penalty(spark, sf):
    return _graph(spark, sf, avoid_intersections=True).select(_crossing(F.col("f")).alias("f"), _crossing(F.col("t")).alias("t"), "weight")


@query("r13_routes", None)
def r13_routes(spark, sf):
    q = view(spark, sf, "poi").select(F.lit(0).alias("region"), F.col("fid").alias("qid"), (36 + F.col("fid") % 20 * 0.002).alias("lat1"), (F.lit(-87.0) + F.col("fid") % 29 * 0.002).alias("lon1"), (36 + F.col("fid") * 7 % 20 * 0.002).alias("lat2"), (F.lit(-87.0) + F.col("fid") * 11 % 29 * 0.002).alias("lon2"))
    out = route.routes(q, _graph(spark, sf).withColumn("region", F.lit(0)))
    return out.select("qid", "failure", F.round("distance_m", 2).alias("distance_m"), "duration_s", F.size("nodes").alias("n_nodes"))


@query("m13_t_two_sided", """WITH x AS (SELECT event_id, (event_id % 97) / 10 AS t, [1, 2, 4][1 + event_id % 3] AS df FROM events)
SELECT event_id, round(CASE df WHEN 1 THEN 1 - 2 / pi() * atan(t) WHEN 2 THEN 1 - t / sqrt(t * t + 2) ELSE 1 - 0.75 * t / sqrt(1 + t * t / 4) * (1 - t * t / (1 + t * t / 4) / 12) END, 9) AS p_value FROM x""")
def m13_t_two_sided(spark, sf):
    p = F.pandas_udf(stats.t_two_sided, "double")
    t, df = F.col("event_id") % 97 / 10.0, F.element_at(F.lit([1.0, 2.0, 4.0]), (F.col("event_id") % 3 + 1).cast("int"))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.round(p(t, df), 9).alias("p_value"))


@query("l4_auto_merge", ctes("trace") + ", " + _RUNS.split(",\n kp AS")[0] + """,
 sm AS (SELECT *, CASE WHEN ty = 'driving' THEN 'driving' ELSE 'on foot' END AS kind, s % 4 = 0 AS ed FROM rn),
 mc AS (SELECT *, CASE WHEN (kind, ed) IS DISTINCT FROM lag((kind, ed)) OVER (PARTITION BY user_id ORDER BY s) THEN 1 ELSE 0 END AS c FROM sm),
 mi AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY s) AS k FROM mc)
SELECT user_id AS device, min(s) AS "start", max(e) AS "end", any_value(kind) AS "type", any_value(ed) AS edited FROM mi GROUP BY user_id, k""")
def l4_auto_merge(spark, sf):
    r = segments.runs(_points(spark, sf))
    r = r.withColumn("type", F.when(F.col("type") == "driving", "driving").otherwise("on foot")).withColumn("edited", F.col("start") % 4 == 0)
    return segments.auto_merge(r).select("device", "start", "end", "type", "edited")


@query("r3_trail_roads", """SELECT o_orderkey AS fid, ['path', 'footway', 'steps'][1 + o_orderkey % 3] AS road_class, 2 AS n FROM orders WHERE o_orderkey % 4 = 0""")
def r3_trail_roads(spark, sf):
    t = _lines(view(spark, sf, "seg")).withColumn("geom_type", F.col("cls").cast("int")).withColumn("trail_type", F.element_at(F.lit(["path", "footway", "steps"]), (F.col("fid") % 3 + 1).cast("int")))
    return route.trail_roads(t).select("fid", "road_class", F.size("coords").alias("n"))


def _frayed(spark, sf):
    """The lattice with ends that miss the crossings by a unit or two."""
    by = lambda k: ((F.col("fid") * k) % 3 - 1) * 0.00002
    near = F.transform("coords", lambda p, i: F.struct((p.lon + by(7)).alias("lon"), (p.lat + by(5)).alias("lat")))
    return _roads(spark, sf).withColumn("coords", near)


_FRAYED = """nd AS (SELECT DISTINCT cy, cx, jy, jx FROM (SELECT unnest([y, y + e]) AS cy, unnest([x, x + 1 - e]) AS cx, (fid * 5) % 3 - 1 AS jy, (fid * 7) % 3 - 1 AS jx FROM rd))"""


@query("r5_merged_nodes", ctes("seg") + ", " + _HOPS + ", " + _FRAYED + """
SELECT cy * 100 + cx AS crossing, count(*) AS nodes, arg_min(jx, jx * 10 + jy) AS root_dx, arg_min(jy, jx * 10 + jy) AS root_dy FROM nd GROUP BY cy, cx HAVING count(*) > 1""")
def r5_merged_nodes(spark, sf):
    m = route.merged_nodes(route.hops(_frayed(spark, sf))).groupBy("root").agg(F.count_distinct("node").alias("nodes"))
    x, y = route._units(F.col("root"))
    off = lambda v, first: F.pmod(v - first + 2, F.lit(100)) - 2  # noqa: E731  crossings are 100 units apart
    return m.select(_crossing(F.col("root")).alias("crossing"), "nodes", off(x, -87 * route.NODE_UNITS).alias("root_dx"), off(y, 36 * route.NODE_UNITS).alias("root_dy"))


@query("r9_edge_geometry", ctes("seg") + ", " + _HOPS + """, bo AS (SELECT f, t FROM hp UNION SELECT t, f FROM hp)
SELECT f, t, 2 AS n, f AS first, t AS last FROM bo""")
def r9_edge_geometry(spark, sf):
    roads = _roads(spark, sf)
    g = route.edge_geometry(roads, route.merged_nodes(route.hops(roads)))
    at = lambda p: _crossing(route.node_key(p.lat, p.lon))
    return g.select(_crossing(F.col("f")).alias("f"), _crossing(F.col("t")).alias("t"), F.size("coords").alias("n"), at(F.element_at("coords", 1)).alias("first"), at(F.element_at("coords", -1)).alias("last"))
