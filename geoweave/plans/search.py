"""Queries of name search, geocoding, scoring, indoor estimates and visibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoweave.functions import geo, text
from geoweave.operators import scoring, search, visibility

from .base import query
from .spatial import _AREAS, _SEGS, NEAR, _lines, _ring, _round
from .views import ctes, hav, view

_FOLD = "replace(lower(strip_accents({c})), 'ß', 'ss')"
_TEXTS = "texts AS (SELECT doc_id AS fid, text AS name FROM documents)"


def _doc_texts(spark, sf):
    """The whole text of every document; null stays null."""
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("fid"), F.col("text").alias("name"))


@query("t1_fold_name", f"WITH {_TEXTS} SELECT fid, {_FOLD.format(c='name')} AS folded FROM texts")
def t1_fold_name(spark, sf):
    return _doc_texts(spark, sf).select("fid", text.fold_name(F.col("name")).alias("folded"))


_SCORE = "CASE WHEN f = '{q}' THEN 2 WHEN starts_with(f, '{q}') THEN 1 WHEN contains(f, '{q}') THEN 0 END"


@query("t2_score_match", f"WITH {_TEXTS}, x AS (SELECT fid, {_FOLD.format(c='name')} AS f FROM texts) SELECT fid, {_SCORE.format(q='en')} AS score FROM x")
def t2_score_match(spark, sf):
    return _doc_texts(spark, sf).select("fid", text.match_score(text.fold_name(F.col("name")), F.lit("en")).alias("score"))


@query("t3_name_bucket", f"""WITH {_TEXTS}, x AS (SELECT fid, substr(trim({_FOLD.format(c='name')}), 1, 1) AS c FROM texts)
SELECT fid, CASE WHEN c IS NULL THEN NULL WHEN c = '' THEN 27 WHEN c BETWEEN 'a' AND 'z' AND strlen(c) = 1 THEN ascii(c) - 97 ELSE 26 END AS bucket FROM x""")
def t3_name_bucket(spark, sf):
    return _doc_texts(spark, sf).select("fid", text.bucket(text.fold_name(F.col("name"))).cast("int").alias("bucket"))


_PART_SCORE = _SCORE.replace("starts_with(f,", "starts_with(lower(p_name),").replace("contains(f,", "contains(lower(p_name),").replace("WHEN f =", "WHEN lower(p_name) =")


def _part_index(spark, sf):
    return search.with_buckets(spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey AS fid", "p_name AS name"))


@query("t5_search_indexed", f"""SELECT p_partkey AS fid, p_name AS name, {_PART_SCORE.format(q='red')} AS score FROM part
WHERE contains(lower(p_name), 'red') AND substr(lower(p_name), 1, 1) = 'r' ORDER BY score DESC, name, fid LIMIT 50""")
def t5_search_indexed(spark, sf):
    return search.search_indexed(_part_index(spark, sf), " Red").select("fid", "name", "score")


@query("t6_search_sidecar", f"""SELECT p_partkey AS fid, p_name AS name, {_PART_SCORE.format(q='blue w')} AS score FROM part
WHERE contains(lower(p_name), 'blue w') AND substr(lower(p_name), 1, 1) = 'b' ORDER BY score DESC, name, fid LIMIT 7""")
def t6_search_sidecar(spark, sf):
    return search.search_indexed(_part_index(spark, sf), "Blue W", 7).select("fid", "name", "score")


@query("t7_search_scanned", """SELECT fid, name, score FROM (SELECT c_custkey AS fid, c_name AS name, CASE WHEN lower(c_name) = '7' THEN 2 WHEN starts_with(lower(c_name), '7') THEN 1 ELSE 0 END AS score
FROM customer WHERE contains(lower(c_name), '7') ORDER BY c_custkey DESC LIMIT 20) ORDER BY score DESC, name""")
def t7_search_scanned(spark, sf):
    names = view(spark, sf, "poi").select("fid", "name", (-F.col("fid")).alias("place"))
    return search.search_all(names, "7", 20, ("place",)).select("fid", "name", "score")


@query("t7_search_all", """SELECT c_custkey AS fid, c_name AS name, CASE WHEN lower(c_name) = '99' THEN 2 WHEN starts_with(lower(c_name), '99') THEN 1 ELSE 0 END AS score
FROM customer WHERE contains(lower(c_name), '99') ORDER BY score DESC, name LIMIT 50""")
def t7_search_all(spark, sf):
    return search.search_all(view(spark, sf, "poi").select("fid", "name"), "99")


@query("t8_search_national", """SELECT state, name, fid, rank FROM (SELECT c_nationkey AS state, c_name AS name, c_custkey AS fid,
 CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS INT) AS rank FROM customer WHERE starts_with(lower(c_name), 'cust')) WHERE rank <= 10""")
def t8_search_national(spark, sf):
    index = search.with_buckets(view(spark, sf, "poi").selectExpr("fid", "name", "nationkey AS state"))
    return search.search_national(index, "Cust", 10).select("state", "name", "fid", "rank")


@query("t10_match_addresses", ctes("address") + """SELECT fid, housenumber, street FROM address WHERE lat IS NOT NULL AND contains(lower(street), 'widget')
ORDER BY starts_with(lower(street), 'widget') DESC, strlen(street), fid LIMIT 25""")
def t10_match_addresses(spark, sf):
    return search.match_addresses(view(spark, sf, "address"), " Widget").select("fid", "housenumber", "street")


@query("t11_find_address", ctes("address") + "SELECT fid, housenumber, street FROM address WHERE housenumber = '42' AND contains(lower(street), 'blue')")
def t11_find_address(spark, sf):
    return search.find_address(view(spark, sf, "address"), "42", "Blue").select("fid", "housenumber", "street")


@query("t12_category_label", """SELECT p_partkey AS fid, replace(trim(list_extract(string_split(p_type || ' > ' || replace(p_name, ' ', '_'), '>'), -1)), '_', ' ') AS label FROM part""")
def t12_category_label(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    cats = F.array(F.lit("none"), F.concat("p_type", F.lit(" > "), F.translate("p_name", " ", "_")))
    return p.select(F.col("p_partkey").alias("fid"), text.category_label(F.lit(2), cats).alias("label"))


@query("p1_score_candidates", ctes("fix", "seg", "box", "poi") + ", " + _SEGS.format(m=0.002) + ", " + _AREAS + f""",
 b AS (SELECT * FROM (SELECT a.qid, b.fid, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d FROM fix a JOIN poi b ON {NEAR.format(d=0.002)}) WHERE d <= 100),
 u AS (SELECT qid, 'road' AS kind, 0 AS o, fid, d, 1.0 AS mw, 0.3 AS sw FROM s WHERE d <= 100
       UNION ALL SELECT qid, 'building', 1, fid, d, 0.3, 1.0 FROM p WHERE d <= 100 UNION ALL SELECT qid, 'business', 2, fid, d, 0.3, 0.8 FROM b),
 c AS (SELECT u.*, exp(-0.5 * pow(d / greatest(accuracy_m, 3.0), 2)) * CASE WHEN speed_mps > 3 THEN mw ELSE sw END AS score FROM u JOIN fix ON fix.qid = u.qid)
SELECT qid, kind, fid, round(d, 3) AS distance_m, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, d, o, fid)::INT AS rank FROM c""")
def p1_score_candidates(spark, sf):
    out = scoring.score_candidates(view(spark, sf, "fix"), _lines(view(spark, sf, "seg")), _ring(view(spark, sf, "box")), view(spark, sf, "poi"), 100.0)
    return _round(out, distance_m=3, score=6)


@query("p1_best_candidate", ctes("fix", "seg", "box", "poi") + ", " + _SEGS.format(m=0.002) + ", " + _AREAS + f""",
 b AS (SELECT * FROM (SELECT a.qid, b.fid, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d FROM fix a JOIN poi b ON {NEAR.format(d=0.002)}) WHERE d <= 100),
 u AS (SELECT qid, 'road' AS kind, 0 AS o, fid, d, 1.0 AS mw, 0.3 AS sw FROM s WHERE d <= 100
       UNION ALL SELECT qid, 'building', 1, fid, d, 0.3, 1.0 FROM p WHERE d <= 100 UNION ALL SELECT qid, 'business', 2, fid, d, 0.3, 0.8 FROM b),
 c AS (SELECT u.*, exp(-0.5 * pow(d / greatest(accuracy_m, 3.0), 2)) * CASE WHEN speed_mps > 3 THEN mw ELSE sw END AS score FROM u JOIN fix ON fix.qid = u.qid)
SELECT qid, kind, fid FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, d, o, fid) AS r FROM c) WHERE r = 1""")
def p1_best_candidate(spark, sf):
    out = scoring.score_candidates(view(spark, sf, "fix"), _lines(view(spark, sf, "seg")), _ring(view(spark, sf, "box")), view(spark, sf, "poi"), 100.0, first=1)
    return out.select("qid", "kind", "fid")


@query("e1_indoor_outdoor", ctes("fix", "box") + ", " + _AREAS.replace("a.accuracy_m,", "a.accuracy_m * 1.5 AS acc,") + """,
 g AS (SELECT qid, arg_min(fid, (-depth, fid)) FILTER (inside) AS i, max(depth) FILTER (inside) AS id, arg_min(kind, (-depth, fid)) FILTER (inside) AS ik,
        arg_min(fid, (depth, fid)) FILTER (NOT inside) AS n, min(depth) FILTER (NOT inside) AS nd FROM p GROUP BY qid),
 j AS (SELECT f.qid, f.accuracy_m * 1.5 AS a, g.i, g.n, coalesce(id, nd) AS d, ik FROM fix f LEFT JOIN g ON g.qid = f.qid),
 x AS (SELECT *, CASE WHEN a > 50 THEN 'poor_accuracy' WHEN i IS NOT NULL AND ik = 0 THEN 'inside_open_structure' WHEN i IS NOT NULL THEN 'inside_building'
        WHEN n IS NULL THEN 'no_buildings_nearby' WHEN d >= a + 3 THEN 'clear_of_buildings' ELSE 'accuracy_overlaps_building' END AS reason FROM j)
SELECT qid, reason, coalesce(i, n) AS building_fid, round(d, 3) AS boundary_m,
  CASE WHEN reason = 'inside_building' THEN 'indoor' WHEN reason IN ('no_buildings_nearby', 'clear_of_buildings') THEN 'outdoor' ELSE 'uncertain' END AS classification,
  round(CASE reason WHEN 'poor_accuracy' THEN 0.1 WHEN 'inside_open_structure' THEN least(0.5, 0.5 + 0.45 * d / (d + greatest(a, 1))) WHEN 'inside_building' THEN least(0.95, 0.5 + 0.45 * d / (d + greatest(a, 1)))
    WHEN 'no_buildings_nearby' THEN 0.8 WHEN 'clear_of_buildings' THEN least(0.95, 0.55 + 0.4 * (d - a - 3) / (d + a + 4)) ELSE greatest(0, least(0.5, 0.5 * (1 - (a + 3 - d) / greatest(a + 3, 1)))) END, 5) AS confidence FROM x""")
def e1_indoor_outdoor(spark, sf):
    b = _ring(view(spark, sf, "box")).withColumn("building_type", F.when(F.col("kind") == 0, "roof").otherwise("house"))
    q = view(spark, sf, "fix").withColumn("accuracy_m", F.col("accuracy_m") * 1.5)
    return _round(scoring.indoor_outdoor(q, b), confidence=5, boundary_m=3)


def _cameras(spark, sf):
    p = view(spark, sf, "poi")
    return p.select("fid", "lat", "lon", F.when(F.col("fid") % 5 == 0, "dome").otherwise("fixed").alias("camera_type"), F.when(F.col("fid") % 7 != 0, ((F.col("fid") * 37) % 360).cast("double")).alias("direction"), F.when(F.col("fid") % 3 != 0, F.lit(120.0)).alias("angle"))


@query("v1_camera_aim", ctes("fix", "poi") + f""", n AS (SELECT a.qid, b.fid, {hav('b.lat', 'b.lon', 'a.lat', 'a.lon')} AS d,
   degrees(atan2(sin(radians(a.lon - b.lon)) * cos(radians(a.lat)), cos(radians(b.lat)) * sin(radians(a.lat)) - sin(radians(b.lat)) * cos(radians(a.lat)) * cos(radians(a.lon - b.lon)))) AS z
   FROM fix a JOIN poi b ON {NEAR.format(d=0.002)}),
 m AS (SELECT qid, fid, d, CASE WHEN z < 0 THEN z + 360 ELSE z END AS z, (fid * 37) % 360 AS dir FROM n WHERE d <= 100),
 k AS (SELECT *, abs(z - dir) AS g FROM m)
SELECT qid, fid, round(d, 3) AS distance_m, fid % 5 = 0 OR fid % 7 = 0 OR least(g, 360 - g) <= CASE WHEN fid % 3 <> 0 THEN 60 ELSE 45 END AS aimed_at_you,
  fid % 5 = 0 OR fid % 7 = 0 OR fid % 3 = 0 AS aim_assumed FROM k""")
def v1_camera_aim(spark, sf):
    out = visibility.cameras_seeing(view(spark, sf, "fix"), _cameras(spark, sf), _houses(spark, sf), 100.0)
    return _round(out.select("qid", "fid", "distance_m", "aimed_at_you", "aim_assumed"), distance_m=3)


def _houses(spark, sf):
    types = F.element_at(F.lit(["house", "garage", "office", "retail", "yes"]), (F.col("kind") + 1).cast("int"))
    b = _ring(view(spark, sf, "box")).withColumn("coords", geo.closed("coords"))
    return b.select("fid", "coords", types.alias("building_type"), F.when(F.col("fid") % 3 == 0, (F.col("fid") % 40).cast("double")).alias("height_m"))


@query("v1_cameras_seeing", ctes("fix", "poi", "box") + f""", n AS (SELECT a.qid, b.fid, a.lat AS sy, a.lon AS sx, b.lat AS cy, b.lon AS cx, {hav('b.lat', 'b.lon', 'a.lat', 'a.lon')} AS d,
   degrees(atan2(sin(radians(a.lon - b.lon)) * cos(radians(a.lat)), cos(radians(b.lat)) * sin(radians(a.lat)) - sin(radians(b.lat)) * cos(radians(a.lat)) * cos(radians(a.lon - b.lon)))) AS z
   FROM fix a JOIN poi b ON {NEAR.format(d=0.002)}),
 m AS (SELECT *, CASE WHEN z < 0 THEN z + 360 ELSE z END AS az, (fid * 37) % 360 AS dir FROM n WHERE d <= 100),
 k AS (SELECT *, abs(az - dir) AS g FROM m),
 hs AS (SELECT fid AS b, lat0, lon0, lat1, lon1, CASE WHEN fid % 3 = 0 AND fid % 40 > 0 THEN fid % 40 ELSE CASE kind WHEN 0 THEN 10.0 WHEN 1 THEN 2.5 WHEN 2 THEN 13.0 WHEN 3 THEN 6.5 ELSE 10.0 END END::DOUBLE AS top FROM box),
 ov AS (SELECT qid, fid, sx, sy, cx, cy, hs.* FROM k JOIN hs ON least(sy, cy) <= lat1 AND greatest(sy, cy) >= lat0 AND least(sx, cx) <= lon1 AND greatest(sx, cx) >= lon0),
 eg AS (SELECT *, sx - cx AS rx, sy - cy AS ry, ux - wx AS ex, uy - wy AS ey, wx - cx AS px, wy - cy AS py FROM (SELECT *, unnest([lon0, lon1, lon1, lon0]) AS wx, unnest([lat0, lat0, lat1, lat1]) AS wy, unnest([lon1, lon1, lon0, lon0]) AS ux, unnest([lat0, lat1, lat1, lat0]) AS uy FROM ov)),
 cr AS (SELECT *, CASE WHEN rx * ey - ry * ex <> 0 THEN (px * ey - py * ex) / (rx * ey - ry * ex) END AS t, CASE WHEN rx * ey - ry * ex <> 0 THEN (px * ry - py * rx) / (rx * ey - ry * ex) END AS u FROM eg),
 ht AS (SELECT qid, fid, b, (sy >= lat0 AND sy < lat1 AND sx >= lon0 AND sx < lon1) AND NOT (cy >= lat0 AND cy < lat1 AND cx >= lon0 AND cx < lon1) AS ind,
   bool_or(coalesce(t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 AND top > 4.0 + (1.7 - 4.0) * t, false)) AS crs FROM cr GROUP BY ALL),
 bl AS (SELECT qid, fid, coalesce(min(b) FILTER (ind), min(b)) AS blocked_by FROM ht WHERE ind OR crs GROUP BY ALL),
 aim AS (SELECT *, fid % 5 = 0 OR fid % 7 = 0 OR least(g, 360 - g) <= CASE WHEN fid % 3 <> 0 THEN 60 ELSE 45 END AS aimed FROM k)
SELECT aim.qid, aim.fid, round(d, 3) AS distance_m, round(az, 4) AS bearing_deg, aimed AS aimed_at_you, aim.fid % 5 = 0 OR aim.fid % 7 = 0 OR aim.fid % 3 = 0 AS aim_assumed,
  blocked_by IS NULL AS line_of_sight, blocked_by, aimed AND blocked_by IS NULL AS sees FROM aim LEFT JOIN bl ON bl.qid = aim.qid AND bl.fid = aim.fid""")
def v1_cameras_seeing(spark, sf):
    return _round(visibility.cameras_seeing(view(spark, sf, "fix"), _cameras(spark, sf), _houses(spark, sf), 100.0), distance_m=3, bearing_deg=4)


@query("v2_height_guess", ctes("box") + """SELECT fid, CASE WHEN fid % 3 = 0 THEN fid % 40 ELSE CASE kind WHEN 0 THEN 10.5 WHEN 1 THEN 3.0 WHEN 2 THEN 32.5 WHEN 3 THEN 8.5 ELSE 12.0 END END::DOUBLE AS height_m,
 fid % 3 <> 0 AS estimated FROM box""")
def v2_height_guess(spark, sf):
    return _houses(spark, sf).select("fid", visibility.height_or_estimate(F.col("height_m"), F.col("building_type")).alias("h")).select("fid", "h.height_m", "h.estimated")


def _observers(spark, sf):
    return view(spark, sf, "fix").select("qid", "user_id", "lat", "lon", F.lit(1.7).alias("eye_m"))


@query("v3_viewshed", None)
def v3_viewshed(spark, sf):
    return _round(visibility.viewshed(_observers(spark, sf), _houses(spark, sf), R_VIEW), distance_m=3)


R_VIEW = 800.0


@query("v4_viewshed_union", None)
def v4_viewshed_union(spark, sf):
    return _round(visibility.viewshed_of_groups(_observers(spark, sf), _houses(spark, sf), R_VIEW, "user_id"), distance_m=3)
