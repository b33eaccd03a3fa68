"""Feature layers as tables: clustered by cell for pruning, found by file name, merged over states."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tiles import LAYERS

NAME = re.compile(r"^(?P<state>[A-Z]{2})\.(?P<layer>[a-z_]+?)(?:_v\d+)?\.[a-z]+$")


def parse_name(name: str) -> tuple[str, str] | None:
    """(state, layer) of a file name like TN.roads_v2.ext; None for other names."""
    m = NAME.match(name)
    return (m["state"], m["layer"]) if m else None


def registry(spark: SparkSession) -> DataFrame:
    """The supported kinds and versions."""
    return spark.createDataFrame([(k, layer, list(versions)) for k, (layer, versions) in sorted(LAYERS.items())], "letter string, layer string, versions array<int>")


def write_layer(features: DataFrame, path: str, key: str = "cell", files: int = 64) -> None:
    """Parquet clustered by cell, so that row-group statistics prune point lookups."""
    features.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def merge_states(states: dict[str, DataFrame], key: str = "cell", order: str = "fid") -> DataFrame:
    """Several states' layers as one, regrouped by cell and sorted by id."""
    out = None
    for state, df in states.items():
        part = df.withColumn("state", F.lit(state))
        out = part if out is None else out.unionByName(part)
    return out.repartitionByRange(key).sortWithinPartitions(key, order)


def coverage(features: DataFrame) -> DataFrame:
    """Counts and bounding box of a layer of points."""
    return features.agg(F.count("*").alias("n"), F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"), F.max("lon").alias("max_lon"))


def covers(queries: DataFrame, box: DataFrame, radius_deg: float = 0.0) -> DataFrame:
    """Whether a layer's box (one row) holds each query point, or the box around it."""
    q = queries.crossJoin(F.broadcast(box))  # one row
    return q.select("qid", ((F.col("lat") - radius_deg >= F.col("min_lat")) & (F.col("lat") + radius_deg <= F.col("max_lat")) & (F.col("lon") - radius_deg >= F.col("min_lon")) & (F.col("lon") + radius_deg <= F.col("max_lon"))).alias("covered"))


def bracket(samples: DataFrame, cells: DataFrame, entries: int) -> DataFrame:
    """For each cell the run of index entries that may hold it: from the last sample at or below it to the next (samples: cell, entry)."""
    both = samples.select("cell", F.col("entry").alias("e"), F.lit(0).alias("q")).unionByName(cells.select("cell", F.lit(None).cast("long").alias("e"), F.lit(1).alias("q")))
    w = Window.partitionBy(F.lit(0)).orderBy("cell", "q")
    run = both.withColumn("start", F.last("e", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("end", F.first("e", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return run.filter("q = 1 AND start IS NOT NULL").select("cell", "start", F.coalesce("end", F.lit(entries - 1).cast("long")).alias("end"))


def warm(features: DataFrame, cells: list[int], key: str = "cell") -> tuple[DataFrame, int]:
    """The features of some cells, cached, and their number; unpersist() clears them."""
    kept = features.filter(F.col(key).isin(cells)).cache()
    return kept, kept.count()
