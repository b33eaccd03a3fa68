"""Road graphs from line features, and routes over them.

The graph is built with joins and aggregations: vertices become nodes by rounding, close nodes are merged as connected components of a
grid self-join, parallel edges keep the least weight. Searching is sequential: a task holds the edges of one region (`region`, which a
caller sets to a corridor or state) and answers a share of its requests, those from one start in one search.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweave.functions import geo

from . import knn
from .components import components

#: Road classes by profile, those of a corridor's middle, and those avoid_highways makes dear.
HIGHWAYS = ("motorway", "motorway_link", "trunk", "trunk_link")
ARTERIALS = (*HIGHWAYS, "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link")
DRIVING = (*ARTERIALS, "unclassified", "residential", "living_street", "service")
FOOT = ("path", "footway", "steps", "bridleway", "cycleway", "track", "pedestrian", "living_street", "residential", "unclassified", "service", "tertiary", "tertiary_link", "secondary", "secondary_link")
#: km/h by class where no limit is posted, and on foot.
SPEEDS = {"motorway": 90, "motorway_link": 45, "trunk": 85, "trunk_link": 40, "primary": 65, "primary_link": 30, "secondary": 55, "secondary_link": 25, "tertiary": 40, "tertiary_link": 20, "unclassified": 20, "residential": 20, "living_street": 8, "service": 10}
FOOT_SPEEDS = {"steps": 1.5, "path": 4.5, "bridleway": 4.5, "track": 4.5}
OTHER_SPEED, OTHER_FOOT_SPEED = 15, 5.0
#: Share of the limit driven, factor on highways, seconds per extra arm, node units per degree, merge distance, node budget.
SPEED_FACTOR, HIGHWAY_FACTOR, ARM_S, NODE_UNITS, MERGE_UNITS, NODE_CAP = 0.85, 4.0, 12.0, 50_000, 5, 400_000
SNAP_M = 100.0
#: Tasks that share the requests of a region.
SPLITS = 8


def allowed(road_class: Column, profile: str = "driving", middle: Column | None = None) -> Column:
    """R1."""
    if profile == "foot":
        return road_class.isin(*FOOT)
    ok = road_class.isin(*DRIVING)
    return ok if middle is None else ok & (~F.coalesce(middle, F.lit(False)) | road_class.isin(*ARTERIALS))


def speed_kmh(road_class: Column, posted: Column | None = None, profile: str = "driving") -> Column:
    """R2."""
    table, other = (FOOT_SPEEDS, OTHER_FOOT_SPEED) if profile == "foot" else (SPEEDS, OTHER_SPEED)
    known = F.element_at(F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, float(v)))), road_class)
    default = F.coalesce(known, F.lit(float(other)))
    return default if posted is None or profile == "foot" else F.coalesce(posted.cast("double"), default)


def trail_roads(trails: DataFrame) -> DataFrame:
    """Trails that are lines, as roads."""
    return trails.filter("geom_type = 0 AND size(coords) >= 2").select("fid", F.col("trail_type").alias("road_class"), "coords", F.lit(None).cast("string").alias("oneway"), F.lit(None).cast("double").alias("speed_limit_kmh"))


def node_key(lat: Column, lon: Column) -> Column:
    """One long for the rounded coordinates."""
    x, y = geo.round_half_away(lon * NODE_UNITS).cast("long"), geo.round_half_away(lat * NODE_UNITS).cast("long")
    return (x + F.lit(1 << 30)) * F.lit(1 << 32) + (y + F.lit(1 << 30))


def _units(key: Column) -> tuple[Column, Column]:
    return F.shiftright(key, 32) - F.lit(1 << 30), key.bitwiseAND(F.lit((1 << 32) - 1)) - F.lit(1 << 30)


def hops(roads: DataFrame, profile: str = "driving", avoid_highways: bool = False) -> DataFrame:
    """Directed edges between raw nodes: f, t, weight (hundredths of a second), with both coordinates.

    One scale of longitude holds for the whole graph, taken at the first vertex of the first road."""
    middle = F.col("middle") if "middle" in roads.columns else None
    kept = roads.filter(allowed(F.col("road_class"), profile, middle) & (F.size("coords") >= 2))
    first = roads.filter(F.size("coords") > 0).agg(F.cos(F.radians(F.min_by(F.col("coords")[0].lat, F.col("fid")))).alias("scale"))
    e = kept.select("fid", "road_class", "oneway", "speed_limit_kmh", F.explode(geo.edges("coords")).alias("e")).crossJoin(F.broadcast(first))  # one row
    e = e.withColumn("f", node_key(F.col("e.a.lat"), F.col("e.a.lon"))).withColumn("t", node_key(F.col("e.b.lat"), F.col("e.b.lon"))).filter("f <> t")
    dx, dy = (F.col("e.b.lon") - F.col("e.a.lon")) * F.col("scale") * geo.PLANAR_M_PER_DEGREE, (F.col("e.b.lat") - F.col("e.a.lat")) * geo.PLANAR_M_PER_DEGREE
    seconds = F.sqrt(dx * dx + dy * dy) / (speed_kmh(F.col("road_class"), F.col("speed_limit_kmh"), profile) * SPEED_FACTOR / 3.6)
    if avoid_highways:
        seconds = seconds * F.when(F.col("road_class").isin(*HIGHWAYS), HIGHWAY_FACTOR).otherwise(1.0)
    e = e.withColumn("w", geo.round_half_away(seconds * 100).cast("long"))
    ways = F.lit("both") if profile == "foot" else F.coalesce("oneway", F.lit("both"))
    there, back = F.struct("f", "t", "w"), F.struct(F.col("t").alias("f"), F.col("f").alias("t"), "w")
    both = F.when(ways == "reverse", F.array(back)).when(ways.isin("forward", "yes"), F.array(there)).otherwise(F.array(there, back))
    return e.select("fid", F.explode(both).alias("d")).select("fid", "d.f", "d.t", F.col("d.w").alias("weight"))


def merged_nodes(edges: DataFrame) -> DataFrame:
    """Node -> root for nodes that lie within MERGE_UNITS (in x plus y) of another, transitively. The least node is the root."""
    nodes = edges.select(F.col("f").alias("node")).unionAll(edges.select(F.col("t").alias("node"))).distinct()
    x, y = _units(F.col("node"))
    nodes = nodes.withColumn("x", x).withColumn("y", y)
    bucket = lambda dx, dy: F.struct(F.floor(F.col("x") / MERGE_UNITS) + dx, F.floor(F.col("y") / MERGE_UNITS) + dy)
    around = F.array(*(bucket(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)))
    near = nodes.select("node", "x", "y", F.explode(around).alias("b")).join(nodes.select(F.col("node").alias("n2"), F.col("x").alias("x2"), F.col("y").alias("y2"), bucket(0, 0).alias("b")), "b")
    close = near.filter((F.col("node") < F.col("n2")) & (F.abs(F.col("x") - F.col("x2")) + F.abs(F.col("y") - F.col("y2")) <= MERGE_UNITS))
    return components(close.select(F.col("node").alias("u"), F.col("n2").alias("v")))


def graph(edges: DataFrame, roots: DataFrame, avoid_intersections: bool = False) -> DataFrame:
    """Edges between merged nodes, the least weight of each pair, loops removed; with avoid_intersections, seconds for each arm
    beyond two of the node arrived at."""
    to = lambda df, c: df.join(roots.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
    out = to(to(edges.select("f", "t", "weight"), "f"), "t").filter("f <> t").groupBy("f", "t").agg(F.min("weight").alias("weight"))
    if avoid_intersections:
        arms = out.select("f", "t").unionAll(out.select(F.col("t").alias("f"), F.col("f").alias("t"))).groupBy(F.col("f").alias("t")).agg(F.count_distinct("t").alias("arms"))
        extra = F.when(F.col("arms") > 2, (F.col("arms") - 2) * F.lit(round(ARM_S * 100))).otherwise(0)
        out = out.join(arms, "t").select("f", "t", (F.col("weight") + extra).alias("weight"))
    return out


def edge_geometry(roads: DataFrame, roots: DataFrame, profile: str = "driving") -> DataFrame:
    """For each directed pair of merged nodes the line with the most vertices between them, in input order among equals."""
    kept = roads.filter(allowed(F.col("road_class"), profile) & (F.size("coords") >= 2))
    v = kept.select("fid", F.posexplode("coords").alias("i", "p")).withColumn("node", node_key(F.col("p.lat"), F.col("p.lon")))
    v = v.join(roots, "node", "left").withColumn("r", F.coalesce("root", "node")).select("fid", "i", "p", "r")
    w = Window.partitionBy("fid").orderBy("i")
    v = v.withColumn("change", (F.col("r") != F.lag("r").over(w)).cast("int")).withColumn("leg", F.coalesce(F.sum("change").over(w), F.lit(0)))
    # a leg ends with the vertex that changes the node, which also begins the next leg
    both = v.select("fid", "i", "p", "r", F.explode(F.when(F.col("change") == 1, F.array(F.col("leg") - 1, F.col("leg"))).otherwise(F.array("leg"))).alias("leg"))
    legs = both.groupBy("fid", "leg").agg(F.sort_array(F.collect_list(F.struct("i", "p", "r"))).alias("x"))
    legs = legs.select("fid", "leg", F.element_at("x", 1).r.alias("f"), F.element_at("x", -1).r.alias("t"), F.transform("x", lambda y: y.p).alias("coords")).filter("f <> t")
    twice = legs.unionByName(legs.select("fid", "leg", F.col("t").alias("f"), F.col("f").alias("t"), F.reverse("coords").alias("coords")))
    return twice.groupBy("f", "t").agg(F.min_by("coords", F.struct(-F.size("coords"), "fid", "leg")).alias("coords"))


def key_lat(key):
    return ((key & ((1 << 32) - 1)) - (1 << 30)) / NODE_UNITS


def key_lon(key):
    return ((key >> 32) - (1 << 30)) / NODE_UNITS


class Adjacency:
    """Edges by the node they leave, built once for all searches of a graph."""

    def __init__(self, f: np.ndarray, t: np.ndarray, w: np.ndarray):
        order = np.argsort(f, kind="stable")
        nodes, first = np.unique(f[order], return_index=True)
        self.t, self.w = t[order].tolist(), w[order].tolist()
        self.span = dict(zip(nodes.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(f)])))

    def search(self, source: int, targets: set[int]) -> dict[int, tuple[list[int], int]]:
        """Nodes and weight of the least path to each target that can be reached (Dijkstra until the last one is settled)."""
        best, back, heap, done, found, left = {source: 0}, {}, [(0, source)], set(), {}, set(targets)
        t, w = self.t, self.w
        while heap and left:
            d, n = heapq.heappop(heap)
            if n in done:
                continue
            done.add(n)
            if n in left:
                left.discard(n)
                path = [n]
                while path[-1] != source:
                    path.append(back[path[-1]])
                found[n] = path[::-1], d
            a, b = self.span.get(n, (0, 0))
            for k in range(a, b):
                if d + w[k] < best.get(t[k], 1 << 62):
                    best[t[k]] = d + w[k]
                    back[t[k]] = n
                    heapq.heappush(heap, (d + w[k], t[k]))
        return found


def shortest_path(f: np.ndarray, t: np.ndarray, w: np.ndarray, source: int, target: int) -> tuple[list[int], int] | None:
    """Nodes and weight of the least path."""
    return Adjacency(f, t, w).search(source, {target}).get(target)


def _haversine(lat1, lon1, lat2, lon2):
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


class Snapper:
    """The nearest node within snap_m, the last of equals; only nodes of nearly the same latitude are measured."""

    def __init__(self, nodes: np.ndarray, snap_m: float):
        lat = key_lat(nodes)
        order = np.argsort(lat, kind="stable")
        self.nodes, self.lat, self.lon, self.place = nodes[order], lat[order], key_lon(nodes)[order], order
        self.snap_m, self.reach = snap_m, 1.01 * snap_m / geo.METRES_PER_DEGREE

    def __call__(self, lat: float, lon: float) -> int | None:
        i, j = np.searchsorted(self.lat, [lat - self.reach, lat + self.reach])
        if i == j:
            return None
        d = _haversine(lat, lon, self.lat[i:j], self.lon[i:j])
        k = max(np.flatnonzero(d == d.min()), key=lambda x: self.place[i + x])
        return int(self.nodes[i + k]) if d[k] <= self.snap_m else None


def solve(requests: pd.DataFrame, edges: pd.DataFrame, snap_m: float = SNAP_M) -> pd.DataFrame:
    """R10-R13 over one region: a row a request, with distance, duration, nodes or the reason why there is none. Requests that start at
    one node share a search."""
    f, t, w = (edges[c].to_numpy(np.int64) for c in ("f", "t", "weight"))
    nodes = np.unique(np.concatenate((f, t)))
    rows, starts = [], {}
    usable = "empty_graph" if len(nodes) == 0 else "node_budget_exceeded" if len(nodes) > NODE_CAP else None
    snap = Snapper(nodes, snap_m)
    for r in requests.itertuples():
        ends = (None, None) if usable else (snap(r.lat1, r.lon1), snap(r.lat2, r.lon2))
        if usable or None in ends:
            rows.append((r.qid, usable or ("start_not_snapped" if ends[0] is None else "end_not_snapped"), None, None, []))
        else:
            starts.setdefault(ends[0], []).append((r.qid, ends[1]))
    graph = Adjacency(f, t, w) if starts else None
    for source, asked in starts.items():
        found = graph.search(source, {target for _, target in asked})
        for qid, target in asked:
            path, weight = found.get(target, ([], None))
            p = np.array(path, np.int64)
            metres = None if weight is None else float(_haversine(key_lat(p[:-1]), key_lon(p[:-1]), key_lat(p[1:]), key_lon(p[1:])).sum())
            rows.append((qid, "disconnected" if weight is None else None, metres, None if weight is None else weight / 100, path))
    return pd.DataFrame(rows, columns=["qid", "failure", "distance_m", "duration_s", "nodes"])


def routes(requests: DataFrame, edges: DataFrame, snap_m: float = SNAP_M, splits: int = SPLITS) -> DataFrame:
    """Requests (region, qid, lat1, lon1, lat2, lon2) over edges (region, f, t, weight). Exact least weights. A region's requests
    are dealt by their start over `splits` tasks, each with the region's edges, so that no region waits for one task."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return solve(a, b, snap_m)

    asked = requests.withColumn("_split", F.pmod(F.xxhash64("lat1", "lon1"), F.lit(splits)).cast("int"))
    held = edges.withColumn("_split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    return asked.groupBy("region", "_split").cogroup(held.groupBy("region", "_split")).applyInPandas(run, "qid long, failure string, distance_m double, duration_s double, nodes array<long>")


def with_geometry(found: DataFrame, geometry: DataFrame) -> DataFrame:
    """The lines of each route's hops stitched: qid, path (lat, lon), distance_m along it."""
    hop = found.select("qid", F.posexplode(geo.edges("nodes")).alias("i", "e")).select("qid", "i", F.col("e.a").alias("f"), F.col("e.b").alias("t"))
    lined = hop.join(geometry, ["f", "t"], "left")
    parts = lined.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("i", "coords"))).alias("x"))
    path = F.flatten(F.transform("x", lambda h, k: F.when(k == 0, h.coords).otherwise(F.slice(h.coords, 2, F.size(h.coords)))))
    return parts.select("qid", path.alias("coords")).withColumn("distance_m", F.element_at(geo.cumulative_m("coords"), -1)).withColumn("path", F.transform("coords", lambda p: F.struct(p.lat.alias("lat"), p.lon.alias("lon")))).drop("coords")


def corridor(requests: DataFrame, cells: DataFrame, width_m: float) -> DataFrame:
    """For each request the cells (cell, lat, lon) whose centre is within width_m of the straight line between its ends."""
    segs = requests.select(F.col("qid").alias("fid"), F.lit(0).alias("segment"), "lat1", "lon1", "lat2", "lon2")
    found = knn.segments_within(cells.select(F.col("cell").alias("qid"), "lat", "lon"), segs, width_m)
    return found.select(F.col("fid").alias("qid"), F.col("qid").alias("cell")).distinct()
