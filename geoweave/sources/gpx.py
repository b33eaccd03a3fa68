"""GPX traces: read with Spark's XML source, written as GPX files of one track a segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_EXT = "struct<speed:double,accuracy:double,accel_variance:double,accel_freq:double,accel_steps:double,accel_mean:double,accel_window_s:double>"
_POINT = f"_lat double, _lon double, ele double, time string, extensions {_EXT}"


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """The track points of GPX files: file, seq, lat, lon, ele, t_ms, speed_mps, accuracy_m, accel (NULL unless a reading is there).

    seq is the order in the file. Points without position or time keep t_ms NULL: see usable() and dropped()."""
    p = spark.read.format("xml").option("rowTag", "trkpt").option("ignoreNamespace", "true").schema(_POINT).load(path)
    p = p.withColumn("file", F.col("_metadata.file_path")).withColumn("seq", F.monotonically_increasing_id())
    x = F.col("extensions")
    any_accel = x.accel_variance.isNotNull() | x.accel_freq.isNotNull() | x.accel_steps.isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    accel = F.when(any_accel, F.struct(zero(x.accel_variance).alias("variance"), zero(x.accel_freq).alias("dominant_frequency"), zero(x.accel_steps).cast("int").alias("step_count"), x.accel_mean.alias("mean_magnitude"), x.accel_window_s.alias("window_duration_s")))
    return p.select("file", "seq", F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), "ele", F.unix_millis(F.try_to_timestamp("time")).alias("t_ms"), x.speed.alias("speed_mps"), x.accuracy.alias("accuracy_m"), accel.alias("accel"))


def usable(points: DataFrame) -> DataFrame:
    return points.filter("lat IS NOT NULL AND lon IS NOT NULL AND t_ms IS NOT NULL")


def summary(points: DataFrame) -> DataFrame:
    """Of each file: usable points, dropped points, and whether it has sensor readings ("sensors") or not ("plain")."""
    ok = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("t_ms").isNotNull()
    sensors = ok & (F.col("speed_mps").isNotNull() | F.col("accuracy_m").isNotNull() | F.col("accel").isNotNull())
    return points.groupBy("file").agg(F.count_if(ok).alias("points"), F.count_if(~ok).alias("dropped"), F.when(F.bool_or(sensors), "sensors").otherwise("plain").alias("flavour"))


def track_points(points: DataFrame) -> DataFrame:
    """The XML of each point (device, idx, t_ms, lat, lon, ele): device, idx, xml."""
    time = F.date_format(F.timestamp_millis("t_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    ele = F.when(F.col("ele").isNotNull(), F.format_string("<ele>%s</ele>", "ele")).otherwise("")
    return points.select("device", "idx", F.format_string('<trkpt lat="%s" lon="%s">%s<time>%s</time></trkpt>', "lat", "lon", ele, time).alias("xml"))


def gpx_documents(points: DataFrame, segments: DataFrame) -> DataFrame:
    """One GPX document a device, a track per segment (device, start, end, type, edited): device, value. Write with .write.text()."""
    begin = segments.select("device", F.col("start").alias("idx"), F.struct("start", "type", "edited").alias("_s"))
    w = Window.partitionBy("device").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    p = track_points(points).join(begin, ["device", "idx"], "left").withColumn("_s", F.last("_s", ignorenulls=True).over(w))
    tracks = p.groupBy("device", "_s").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "xml"))), lambda x: x.xml), "").alias("pts"))
    trk = F.format_string("<trk><name>%s</name><extensions><segment type=\"%s\" source=\"%s\"/></extensions><trkseg>%s</trkseg></trk>", "_s.type", "_s.type", F.when(F.col("_s.edited"), "edited").otherwise("derived"), "pts")
    docs = tracks.groupBy("device").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("_s.start").alias("s"), trk.alias("x")))), lambda t: t.x), "").alias("body"))
    return docs.select("device", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="geoweave" xmlns="http://www.topografix.com/GPX/1/1">'), "body", F.lit("</gpx>")).alias("value"))
