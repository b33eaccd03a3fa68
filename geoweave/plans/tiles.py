"""Queries of the tile format: each layer is encoded into files, one a state, and decoded from them; the SQL is the features themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoweave.sources import tiles

from .base import query
from .views import VIEWS, ctes, view


def _enum(name: str, by: str) -> str:
    names = tiles.ENUMS[name]
    return f"CASE {by} % {len(names)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(names)) + f" END AS {name}"


_OPTIONAL = "CASE WHEN fid % 3 <> 0 THEN {} END AS {}"
_ENDS = ("coords", "lat1", "lon1", "lat2", "lon2")
#: layer -> (view, state and cell of a feature, columns in SQL that both engines run, cells a block). Lines are lat1, lon1, lat2, lon2.
LAYERS = {
    "signals": ("poi", "nationkey", f"fid AS osm_id, lat, lon, {_enum('signal_type', 'fid')}, {_OPTIONAL.format('CAST(fid % 360 AS INT)', 'direction')}", 0),
    "camera": ("poi", "nationkey", f"fid AS osm_id, lat, lon, {_enum('device_type', 'fid')}, {_enum('placement', 'nationkey')}, {_enum('camera_type', 'fid')}, {_OPTIONAL.format('CAST(fid % 360 AS INT)', 'direction')}, {_OPTIONAL.format('name', 'operator')}, {_OPTIONAL.format('CAST(fid % 120 AS INT)', 'angle')}", 3),
    "ev": ("poi", "nationkey", f"fid AS osm_id, lat, lon, {_enum('access', 'fid')}, CAST(fid * 7 % 3500 AS INT) AS power_dkw, CAST(fid % 20 AS INT) AS capacity, CAST(fid * 37 % 8192 AS INT) AS connector_bits, name, {_OPTIONAL.format('name', 'network')}", 5),
    "address": ("address", "fid % 5", "fid AS osm_id, housenumber, street", 4),
    "name_index": ("poi", "nationkey", "name, lat, lon, fid AS uid, CAST(fid % 200 AS INT) AS category_idx", 0),
    "roads": ("seg", "path_id % 7", f"fid AS osm_id, lat1, lon1, lat2, lon2, {_enum('road_class', 'fid')}, {_OPTIONAL.format('CAST(path_id AS STRING)', 'name')}, {_OPTIONAL.format('CAST(fid AS STRING)', 'ref_tag')}, {_enum('oneway', 'path_id')}, {_OPTIONAL.format('CAST(fid % 130 AS INT)', 'speed_limit_kmh')}, {_enum('road_surface', 'path_id')}", 2),
    "water": ("seg", "path_id % 7", f"fid AS osm_id, CAST(1 AS INT) AS geom_type, lat1, lon1, lat2, lon2, {_enum('water_type', 'fid')}, {_OPTIONAL.format('CAST(path_id AS STRING)', 'name')}, {_OPTIONAL.format('CAST(fid % 900 AS INT)', 'width')}", 0),
    "rail": ("seg", "path_id % 7", f"fid AS osm_id, CAST(0 AS INT) AS geom_type, lat1, lon1, lat2, lon2, {_enum('rail_type', 'fid')}, {_OPTIONAL.format('CAST(path_id AS STRING)', 'name')}", 6),
    "trails": ("seg", "path_id % 7", f"fid AS osm_id, CAST(0 AS INT) AS geom_type, lat1, lon1, lat2, lon2, {_enum('trail_type', 'fid')}, {_enum('trail_surface', 'path_id')}, {_enum('sac_scale', 'fid')}", 3),
    "parks": ("box", "kind", "fid AS osm_id, lat0 AS lat1, lon0 AS lon1, lat1 AS lat2, lon1 AS lon2, name AS park_type", 0),
}


def _files(spark, sf, layer: str):
    """The layer's files as rows (file, content)."""
    source, state, columns, merged = LAYERS[layer]
    f = spark.sql(f"SELECT {state} AS file, fid % 40 AS cell, {columns} FROM {{v}}", v=view(spark, sf, source))
    if "lat1" in f.columns:
        p = lambda i: F.struct(F.col(f"lon{i}").alias("lon"), F.col(f"lat{i}").alias("lat"))
        f = f.withColumn("coords", F.array(p(1), p(2))).drop("lat1", "lon1", "lat2", "lon2")
    return tiles.encode_files(f, layer, merged=merged)


def _shown(decoded, layer: str):
    names = ["cell", *(c.rsplit(" AS ", 1)[-1].strip() for c in _split(LAYERS[layer][2]))]
    ends = {f"{c}{i}": F.element_at("coords", 1 if i == 1 else -1)[c] for c in ("lat", "lon") for i in (1, 2)}
    return decoded.select(*(ends[n].alias(n) if n in ends else F.col(n) for n in names))


def _split(columns: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


def _register(layer: str) -> None:
    source, _, columns, _ = LAYERS[layer]
    sql = ctes(source) + f"SELECT fid % 40 AS cell, {columns.replace('AS STRING', 'AS VARCHAR')} FROM {source}"

    @query(f"d_tiles_{layer}", sql)
    def decoded(spark, sf):
        return _shown(tiles.decode_files(_files(spark, sf, layer), layer), layer)


for _layer in LAYERS:
    _register(_layer)

assert {x[0] for x in LAYERS.values()} <= set(VIEWS)
