"""Geographic and motion tables derived from the generic test tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (source tables, SQL). {div} is the integer division of the dialect.
VIEWS = {
    "poi": (("customer",), """SELECT c_custkey AS fid, c_name AS name, c_nationkey AS nationkey,
        (3600000 + (c_custkey * 7919) % 20011) / 1e5 AS lat, (-8700000 + (c_custkey * 104729) % 30011) / 1e5 AS lon FROM {customer}"""),
    "fix": (("events",), """SELECT event_id AS qid, user_id, (3600000 + (event_id * 6151) % 20011) / 1e5 AS lat,
        (-8700000 + (event_id * 98317) % 30011) / 1e5 AS lon, value / 10 AS speed_mps, CAST(event_id % 40 AS DOUBLE) AS accuracy_m FROM {events}"""),
    "seg": (("orders",), """SELECT o_orderkey AS fid, o_custkey AS path_id, o_orderkey % 4 AS cls,
        (3600000 + (o_orderkey * 7919) % 20011) / 1e5 AS lat1, (-8700000 + (o_orderkey * 104729) % 30011) / 1e5 AS lon1,
        (3600000 + (o_orderkey * 7919) % 20011 + 50 + o_orderkey % 200) / 1e5 AS lat2,
        (-8700000 + (o_orderkey * 104729) % 30011 + 50 + o_orderkey % 150) / 1e5 AS lon2 FROM {orders}"""),
    "box": (("supplier",), """SELECT s_suppkey AS fid, s_name AS name, s_suppkey % 5 AS kind,
        (3600000 + (s_suppkey * 7919) % 20011) / 1e5 AS lat0, (-8700000 + (s_suppkey * 104729) % 30011) / 1e5 AS lon0,
        (3600000 + (s_suppkey * 7919) % 20011 + 400 + s_suppkey % 300) / 1e5 AS lat1,
        (-8700000 + (s_suppkey * 104729) % 30011 + 400 + s_suppkey % 350) / 1e5 AS lon1 FROM {supplier}"""),
    "address": (("part",), """SELECT p_partkey AS fid, CAST(p_partkey % 200 AS STRING) AS housenumber, p_name AS street,
        CASE WHEN p_partkey % 7 <> 0 THEN (3600000 + (p_partkey * 7919) % 20011) / 1e5 END AS lat,
        CASE WHEN p_partkey % 7 <> 0 THEN (-8700000 + (p_partkey * 104729) % 30011) / 1e5 END AS lon FROM {part}"""),
    "trace": (("events",), """SELECT user_id, seq, seq * 5000 + (seq {div} 40) * 60000 AS t_ms, speed_mps, accuracy_m, event_type FROM
        (SELECT user_id, value / 10 AS speed_mps, CAST(event_id % 60 AS DOUBLE) AS accuracy_m, event_type,
                CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS seq FROM {events})"""),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, sql = VIEWS[name]
    return spark.sql(sql.replace("{div}", "div"), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def ctes(*names: str) -> str:
    """WITH ... of the named views for DuckDB."""
    out = []
    for n in names:
        tables, sql = VIEWS[n]
        sql = sql.replace("{div}", "//").replace("AS STRING", "AS VARCHAR")
        for t in tables:
            sql = sql.replace("{" + t + "}", t)
        out.append(f"{n} AS ({sql})")
    return "WITH " + ",\n".join(out) + ("\n" if out else "")


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(2 * 6371000.0::DOUBLE * atan2(sqrt({h}), sqrt(1 - {h})))"


def seg_dist(lat: str, lon: str, lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Distance to a segment on the plane at the point, as a scalar subquery-free expression."""
    x = lambda o: f"(radians({o} - {lon}) * cos(radians({lat})) * 6371000.0::DOUBLE)"
    y = lambda a: f"(radians({a} - {lat}) * 6371000.0::DOUBLE)"
    ax, ay, dx, dy = x(lon1), y(lat1), f"({x(lon2)} - {x(lon1)})", f"({y(lat2)} - {y(lat1)})"
    size = f"({dx} * {dx} + {dy} * {dy})"
    t = f"(CASE WHEN {size} = 0 THEN 0 ELSE greatest(0, least(1, -({ax} * {dx} + {ay} * {dy}) / {size})) END)"
    return f"sqrt(pow({ax} + {t} * {dx}, 2) + pow({ay} + {t} * {dy}, 2))"
