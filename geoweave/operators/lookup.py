"""Point lookups: what is at, on or near each query point. Batch first: queries are a DataFrame (qid, lat, lon), results keyed by qid.

Candidates come from within `within_m` of a query. Features carry `fid`, their input order, which breaks ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.functions import geo

from . import knn

#: Default thresholds in metres.
ROAD_M, INTERSECTION_M, ON_WAY_M, ADDRESS_M, BUSINESS_M, CENTROID_M, SCOPE_M = 50.0, 50.0, 25.0, 150.0, 200.0, 50.0, 2000.0
HOLDS_TRAFFIC = (1, 2, 3)


def nearest_road(queries: DataFrame, roads: DataFrame, threshold_m: float = ROAD_M) -> DataFrame:
    """J1."""
    return knn.nearest_way(queries, roads, threshold_m)


def nearest_intersection(queries: DataFrame, intersections: DataFrame, threshold_m: float = INTERSECTION_M) -> DataFrame:
    """With the intersection's type."""
    return knn.nearest_point(queries, intersections, threshold_m).join(intersections.select("fid", "intersection_type"), "fid")


def nearest_line(queries: DataFrame, ways: DataFrame, within_m: float = SCOPE_M) -> DataFrame:
    """The nearest way without a threshold but the scope, and whether one is on it. Features with a geom_type count as lines if it
    is 0."""
    lines = ways.filter("geom_type = 0") if "geom_type" in ways.columns else ways
    return knn.nearest_way(queries, lines.filter(F.size("coords") >= 2), within_m).withColumn("on_it", F.col("distance_m") <= ON_WAY_M)


def nearest_stop(queries: DataFrame, features: DataFrame, within_m: float = SCOPE_M) -> DataFrame:
    """The nearest trailhead or station: features of geom_type 1, by their first coordinate."""
    points = features.filter("geom_type = 1 AND size(coords) > 0").select("fid", F.col("coords")[0].lat.alias("lat"), F.col("coords")[0].lon.alias("lon"))
    return knn.nearest_point(queries, points, within_m)


def park_at(queries: DataFrame, parks: DataFrame, within_m: float = SCOPE_M) -> DataFrame:
    """J5."""
    return knn.best_area(queries, parks, within_m).drop("depth_m")


def water_at(queries: DataFrame, water: DataFrame, within_m: float = SCOPE_M) -> DataFrame:
    """Polygons (geom_type 0) as J5; lines (1) are never inside; references (2) don't count."""
    areas = knn.best_area(queries, water.filter("geom_type = 0"), within_m).select("qid", "fid", "distance_m", "inside")
    lines = knn.nearest_way(queries, water.filter("geom_type = 1"), within_m).select("qid", "fid", "distance_m", F.lit(False).alias("inside"))
    return knn.best_of(areas.unionByName(lines))


def nearest_address(queries: DataFrame, addresses: DataFrame, threshold_m: float = ADDRESS_M) -> DataFrame:
    """Records without a position don't count."""
    return knn.nearest_point(queries, addresses.filter("lat IS NOT NULL AND lon IS NOT NULL"), threshold_m)


def building_at(queries: DataFrame, buildings: DataFrame, near_m: float = CENTROID_M) -> DataFrame:
    """The first footprint in input order that contains the point, else the nearest centroid within near_m: qid, fid, inside."""
    inside = knn.areas_holding(queries, buildings).groupBy("qid").agg(F.min("fid").alias("in_fid"))
    mid = buildings.select("fid", geo.centroid("coords").alias("c")).select("fid", "c.lat", "c.lon")
    near = knn.nearest_point(queries, mid, near_m).select("qid", F.col("fid").alias("near_fid"))
    both = inside.join(near, "qid", "full_outer")
    return both.select("qid", F.coalesce("in_fid", "near_fid").alias("fid"), F.col("in_fid").isNotNull().alias("inside"))


def businesses_near(queries: DataFrame, businesses: DataFrame, radius_m: float = BUSINESS_M) -> DataFrame:
    """J10."""
    return knn.points_within(queries, businesses, radius_m)


def for_each(queries: DataFrame, found: DataFrame) -> DataFrame:
    """A row for every query, NULLs where nothing was found."""
    return queries.select("qid").join(found, "qid", "left")


def features_in(features: DataFrame, cells: DataFrame, key: str = "cell") -> DataFrame:
    """The features of the given cells (and their neighbours, if those are listed)."""
    return features.join(cells.select(key).distinct(), key, "left_semi")


def locate(queries: DataFrame, roads: DataFrame, trails: DataFrame, addresses: DataFrame, within_m: float = SCOPE_M) -> DataFrame:
    """The nearest way (a trail only if strictly nearer than any road), whether one is on it, and the nearest address."""
    road = nearest_line(queries, roads, within_m).select("qid", F.col("fid").alias("r"), F.col("distance_m").alias("rd"))
    trail = nearest_line(queries, trails, within_m).select("qid", F.col("fid").alias("t"), F.col("distance_m").alias("td"))
    address = nearest_address(queries, addresses).select("qid", F.col("fid").alias("address_fid"), F.col("distance_m").alias("address_m"))
    both = queries.select("qid").join(road, "qid", "left").join(trail, "qid", "left").join(address, "qid", "left")
    trail_wins = F.col("td").isNotNull() & (F.col("rd").isNull() | (F.col("td") < F.col("rd")))
    d = F.when(trail_wins, F.col("td")).otherwise(F.col("rd"))
    return both.select("qid", F.when(trail_wins, "trail").when(F.col("r").isNotNull(), "road").alias("way_kind"), F.when(trail_wins, F.col("t")).otherwise(F.col("r")).alias("way_fid"), d.alias("way_m"), F.coalesce(d <= ON_WAY_M, F.lit(False)).alias("on_way"), "address_fid", "address_m")


def admin_at(queries: DataFrame, grid: DataFrame, dims: dict[str, DataFrame], key: str = "cell") -> DataFrame:
    """Queries (qid, cell) joined to the grid row of their cell and, for each column name -> (idx, name) table, to its name; an index
    without a name gives ''. The tables are dictionaries; Spark broadcasts those under its threshold."""
    out = queries.join(grid, key)
    for column, names in dims.items():
        n = names.select(F.col("idx").alias(f"_{column}"), F.col("name").alias(f"{column}_name"))
        out = out.join(n, out[column] == n[f"_{column}"], "left").drop(f"_{column}").withColumn(f"{column}_name", F.coalesce(f"{column}_name", F.lit("")))
    return out


def cameras_near_road(cameras: DataFrame, roads: DataFrame, radius_m: float) -> DataFrame:
    """The cameras (fid, lat, lon) with any segment of the roads within the radius: those with a nearest one."""
    near = knn.nearest_way(cameras.withColumnRenamed("fid", "qid"), roads, radius_m).select(F.col("qid").alias("fid"))
    return cameras.join(near, "fid", "left_semi")


def segment_context(points: DataFrame, roads: DataFrame, intersections: DataFrame, road_m: float = ROAD_M, control_m: float = INTERSECTION_M) -> DataFrame:
    """Of each group (gid) of points (gid, seq, qid, lat, lon): the road class most of them snap to (the one met first among
    equals), the nearest snap of that class, and the nearest intersection."""
    snapped = points.join(nearest_road(points, roads, road_m), "qid").join(roads.select("fid", "road_class"), "fid")
    counted = snapped.groupBy("gid", "road_class").agg(F.count("*").alias("n"), F.min("seq").alias("met"), F.min_by(F.struct("fid", "distance_m"), F.struct("distance_m", "seq")).alias("best"))
    modal = counted.groupBy("gid").agg(F.min_by(F.struct("road_class", "n", "best"), F.struct(-F.col("n"), F.col("met"))).alias("m"))
    control = points.join(knn.nearest_point(points, intersections, control_m), "qid").groupBy("gid").agg(F.min_by(F.struct("fid", "distance_m"), F.struct("distance_m", "seq")).alias("c"))
    every = points.select("gid").distinct().join(modal, "gid", "left").join(control, "gid", "left")
    return every.select("gid", F.col("m.road_class").alias("road_class"), F.col("m.n").alias("n_points"), F.col("m.best.fid").alias("road_fid"), F.col("m.best.distance_m").alias("road_m"), F.col("c.fid").alias("control_fid"), F.col("c.distance_m").alias("control_m"))


def all_layers(queries: DataFrame, roads: DataFrame, buildings: DataFrame, businesses: DataFrame) -> DataFrame:
    """Building, nearest road and number of candidates (roads, buildings, businesses in reach) of each query."""
    road = nearest_road(queries, roads, 100.0).select("qid", F.col("fid").alias("road_fid"), F.col("distance_m").alias("road_m"))
    b = building_at(queries, buildings).select("qid", F.col("fid").alias("building_fid"), F.col("inside").alias("in_building"))
    n = businesses_near(queries, businesses).groupBy("qid").agg(F.count("*").alias("n_businesses"))
    out = queries.select("qid").join(road, "qid", "left").join(b, "qid", "left").join(n, "qid", "left")
    return out.withColumn("n_businesses", F.coalesce("n_businesses", F.lit(0)).cast("long"))


def road_context(points: DataFrame, roads: DataFrame, threshold_m: float = ROAD_M) -> DataFrame:
    """M8: the road evidence of each point for the movement tracker: qid, road (struct of road_class, distance_m and the bearing at the
    vertex nearest the snap); points without a road near have no row."""
    found = nearest_road(points, roads, threshold_m).join(roads.select("fid", "road_class", "coords"), "fid")
    bearing = geo.heading_at("snapped_lat", "snapped_lon", "coords")
    return found.select("qid", F.struct("road_class", "distance_m", bearing.alias("bearing")).alias("road"))


def holds_traffic(intersection_type, distance_m, radius_m: float = 25.0):
    """M7: a signal, stop or give-way within the radius."""
    return intersection_type.isin(*HOLDS_TRAFFIC) & (distance_m <= radius_m)
