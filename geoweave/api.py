"""Batch-first facade: a Stack holds layers as DataFrames and answers every lookup for a DataFrame of queries.

Queries are rows (qid, lat, lon, ...); every method returns a DataFrame. Layers that are missing give empty results, not errors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import lookup, scoring, visibility
from .operators import search as names
from .sources import layers, tiles

#: The columns a layer needs: what empty layers are made of.
SCHEMAS = {
    "roads": "fid long, road_class string, name string, ref_tag string, oneway string, speed_limit_kmh double, coords array<struct<lon:double,lat:double>>",
    "intersections": "fid long, lat double, lon double, intersection_type int",
    "trails": "fid long, geom_type int, trail_type string, name string, coords array<struct<lon:double,lat:double>>",
    "rail": "fid long, geom_type int, rail_type string, name string, coords array<struct<lon:double,lat:double>>",
    "parks": "fid long, park_type string, name string, coords array<struct<lon:double,lat:double>>",
    "water": "fid long, geom_type int, water_type string, name string, coords array<struct<lon:double,lat:double>>",
    "buildings": "fid long, building_type string, height_m double, name string, coords array<struct<lon:double,lat:double>>",
    "businesses": "fid long, lat double, lon double, name string",
    "addresses": "fid long, lat double, lon double, housenumber string, street string",
    "cameras": "fid long, lat double, lon double, camera_type string, direction double, angle double",
    "chargers": "fid long, lat double, lon double, access string, power_kw double",
}
#: Query names of requests, with the method that answers them.
KINDS = ("road", "intersection", "trail", "trailhead", "rail", "station", "park", "water", "building", "business", "address", "camera", "locate", "all")


@dataclass
class Stack:
    spark: SparkSession
    layers: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str) -> Stack:
        """Parquet layers of a folder: <folder>/<layer>.parquet; layers without a folder stay empty."""
        out = cls(spark)
        for name in SCHEMAS:
            try:
                out.layers[name] = spark.read.parquet(f"{folder}/{name}.parquet")
            except Exception as e:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        return out

    @classmethod
    def from_tiles(cls, spark: SparkSession, files: dict[str, str]) -> Stack:
        """Layers read from binary tile files: layer name -> path."""
        tiles.register(spark)
        out = cls(spark)
        for name, path in files.items():
            out.layers[name] = spark.read.format("celltiles").option("path", path).load().withColumnRenamed("osm_id", "fid")
        return out

    def layer(self, name: str) -> DataFrame:
        return self.layers[name] if name in self.layers else self.spark.createDataFrame([], SCHEMAS[name])

    def coverage(self, name: str) -> DataFrame:
        return layers.coverage(self.layer(name))

    def answer(self, queries: DataFrame, kind: str) -> DataFrame:
        """One of KINDS for every query."""
        of = self.layer
        table = {
            "road": lambda: lookup.nearest_road(queries, of("roads")),
            "intersection": lambda: lookup.nearest_intersection(queries, of("intersections")),
            "trail": lambda: lookup.nearest_line(queries, of("trails")),
            "trailhead": lambda: lookup.nearest_stop(queries, of("trails")),
            "rail": lambda: lookup.nearest_line(queries, of("rail")),
            "station": lambda: lookup.nearest_stop(queries, of("rail")),
            "park": lambda: lookup.park_at(queries, of("parks")),
            "water": lambda: lookup.water_at(queries, of("water")),
            "building": lambda: lookup.building_at(queries, of("buildings")),
            "business": lambda: lookup.businesses_near(queries, of("businesses")),
            "address": lambda: lookup.nearest_address(queries, of("addresses")),
            "camera": lambda: visibility.cameras_seeing(queries, of("cameras"), of("buildings")),
            "locate": lambda: lookup.locate(queries, of("roads"), of("trails"), of("addresses")),
            "all": lambda: lookup.all_layers(queries, of("roads"), of("buildings"), of("businesses")),
        }
        if kind not in table:
            raise ValueError(f"unknown query {kind!r}; known: {', '.join(KINDS)}")
        return table[kind]()

    def serve(self, requests: DataFrame) -> DataFrame:
        """Requests (request_id, lat, lon, query) -> request_id, query, response (JSON array of hits), candidate_count, error. Errors are rows: a
        bad request never stops the others."""
        good = F.col("query").isin(*KINDS) & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
        checked = requests.withColumn("ok", F.coalesce(good, F.lit(False)))
        why = F.when(~F.coalesce(F.col("query").isin(*KINDS), F.lit(False)), F.concat(F.lit("unknown query "), F.coalesce("query", F.lit("null")))).otherwise("coordinates missing or off the globe")
        out = checked.filter("NOT ok").select("request_id", "query", F.lit("[]").alias("response"), F.lit(0).cast("long").alias("candidate_count"), why.alias("error"))
        for kind in KINDS:
            q = checked.filter(F.col("ok") & (F.col("query") == kind)).select(F.col("request_id").alias("qid"), "lat", "lon")
            hits = self.answer(q, kind)
            rows = hits.groupBy("qid").agg(F.collect_list(F.to_json(F.struct(*[c for c in hits.columns if c != "qid"]))).alias("h"))
            found = q.select("qid").join(rows, "qid", "left")
            text = F.concat(F.lit("["), F.array_join(F.coalesce("h", F.array().cast("array<string>")), ","), F.lit("]"))
            out = out.unionByName(found.select(F.col("qid").alias("request_id"), F.lit(kind).alias("query"), text.alias("response"), F.size(F.coalesce("h", F.array().cast("array<string>"))).cast("long").alias("candidate_count"), F.lit(None).cast("string").alias("error")))
        return out

    def score(self, fixes: DataFrame, within_m: float = 100.0) -> DataFrame:
        return scoring.score_candidates(fixes, self.layer("roads"), self.layer("buildings"), self.layer("businesses"), within_m)

    def indoor_outdoor(self, fixes: DataFrame) -> DataFrame:
        return scoring.indoor_outdoor(fixes, self.layer("buildings"))

    def viewshed(self, observers: DataFrame, radius_m: float) -> DataFrame:
        return visibility.viewshed(observers, self.layer("buildings"), radius_m)

    def search(self, query: str, limit: int = names.LIMIT) -> DataFrame:
        return names.search_all(self.layer("businesses"), query, limit)

    def geocode(self, query: str, limit: int = names.GEOCODE_LIMIT) -> DataFrame:
        return names.match_addresses(self.layer("addresses"), query, limit)
