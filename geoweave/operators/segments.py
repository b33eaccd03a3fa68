"""Labelled segments of traces: gaps and islands, edits as overlays, and summaries.

A labelled trace is rows (device, idx, t_ms, movement, vote, confidence, smoothed_mps, at_control); segments are rows
(device, start, end, type, edited, ...) that cover it without gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELS = ("unknown", "stationary", "walking", "running", "driving")
LEAST_POINTS, SAMPLES = 3, 5


def _islands(df: DataFrame, key: str, order: str, *same: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    changed = None
    for c in same:
        one = ~F.col(c).eqNullSafe(F.lag(c).over(w))
        changed = one if changed is None else changed | one
    return df.withColumn("_new", (changed | (F.row_number().over(w) == 1)).cast("int")).withColumn("_island", F.sum("_new").over(w))


def runs(points: DataFrame, key: str = "device") -> DataFrame:
    """L2, first step: runs of one movement: start, end, type, edited."""
    return _islands(points, key, "idx", "movement").groupBy(key, "_island").agg(F.min("idx").alias("start"), F.max("idx").alias("end"), F.first("movement").alias("type")).withColumn("edited", F.lit(False)).drop("_island")


def auto_merge(segments: DataFrame, key: str = "device") -> DataFrame:
    """L4: neighbours of one type and provenance become one."""
    return _islands(segments, key, "start", "type", "edited").groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("type").alias("type"), F.first("edited").alias("edited")).drop("_island")


def coalesce(points: DataFrame, least: int = LEAST_POINTS, key: str = "device") -> DataFrame:
    """L2: runs, those of under `least` points taken into the one before (but for the first), equal neighbours merged."""
    r = runs(points, key)
    w = Window.partitionBy(key).orderBy("start")
    keeps = (F.col("end") - F.col("start") + 1 >= least) | (F.row_number().over(w) == 1)
    grouped = r.withColumn("_keep", keeps.cast("int")).withColumn("_to", F.sum("_keep").over(w))
    kept = grouped.groupBy(key, "_to").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("type", "start").alias("type"), F.lit(False).alias("edited")).drop("_to")
    return auto_merge(kept, key)


def annotate(segments: DataFrame, points: DataFrame, key: str = "device") -> DataFrame:
    """L3: mean confidence, the commonest vote (the first met among equals), times, and whether a traffic control was near."""
    within = _label(points, segments, key)
    votes = within.groupBy(key, "start", "vote").agg(F.count("*").alias("n"), F.min("idx").alias("met"))
    top = votes.groupBy(key, "start").agg(F.min_by("vote", F.struct(-F.col("n"), "met")).alias("vote"))
    sums = within.groupBy(key, "start").agg(F.first("end").alias("end"), F.first("type").alias("type"), F.first("edited").alias("edited"), F.avg(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.count("*").alias("points"), F.min_by("t_ms", "idx").alias("t0"), F.max_by("t_ms", "idx").alias("t1"), F.bool_or("at_control").alias("at_control"))
    return sums.join(top, [key, "start"])


def _label(points: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """Each point with its segment: segments begin at points, so the last start at or before a point is an as-of window, not a range join."""
    s = F.struct("start", "end", "type", "edited").alias("_s")
    begin = segments.select(key, F.col("start").alias("idx"), s)
    w = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    joined = points.join(begin, [key, "idx"], "left").withColumn("_s", F.last("_s", ignorenulls=True).over(w))
    return joined.select(*[points[c] if c not in (key, "idx") else F.col(c) for c in points.columns], "_s.start", "_s.end", "_s.type", "_s.edited")


def overlay(segments: DataFrame, edits: DataFrame, key: str = "device") -> DataFrame:
    """Slice ranges (device, lo, hi, type) relabelled, as edited, whatever segments they cut: boundaries are split, then merged. An
    edit of a whole segment is a relabelling; ranges must not overlap each other."""
    s = segments.select(key, F.posexplode(F.array(F.col("start"), F.col("end") + 1)).alias("p", "at"), "start", "end", "type", "edited")
    cuts = s.select(key, "at").unionAll(edits.select(key, F.col("lo").alias("at"))).unionAll(edits.select(key, (F.col("hi") + 1).alias("at"))).distinct()
    w = Window.partitionBy(key).orderBy("at")
    pieces = cuts.withColumn("end", F.lead("at").over(w) - 1).filter("end IS NOT NULL").withColumnRenamed("at", "start")
    began = segments.select(key, F.col("start"), F.struct("type", "edited", "end").alias("_old"))
    edited = edits.select(key, F.col("lo").alias("start"), F.struct("type", "hi").alias("_edit"))
    upto = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    x = pieces.join(began, [key, "start"], "left").join(edited, [key, "start"], "left")
    x = x.withColumn("_old", F.last("_old", ignorenulls=True).over(upto)).withColumn("_edit", F.last("_edit", ignorenulls=True).over(upto))
    x = x.filter(F.col("_old").isNotNull() & (F.col("start") <= F.col("_old.end")))
    hit = F.coalesce(F.col("end") <= F.col("_edit.hi"), F.lit(False))
    return auto_merge(x.select(key, "start", "end", F.when(hit, F.col("_edit.type")).otherwise(F.col("_old.type")).alias("type"), (hit | F.col("_old.edited")).alias("edited")), key)


def split(segments: DataFrame, at: DataFrame, key: str = "device") -> DataFrame:
    """Segments cut before the points (device, at); cuts at a start or outside change nothing."""
    inside = segments.join(at.groupBy(key).agg(F.sort_array(F.collect_set("at")).alias("_at")), key, "left")
    cuts = F.filter(F.coalesce("_at", F.array().cast("array<bigint>")), lambda a: (a > F.col("start")) & (a <= F.col("end")))
    starts = F.concat(F.array(F.col("start").cast("bigint")), cuts)
    parts = inside.withColumn("_s", starts).withColumn("_p", F.explode(F.arrays_zip(F.col("_s").alias("s"), F.transform(F.concat(F.slice("_s", 2, 1 << 30), F.array((F.col("end") + 1).cast("bigint"))), lambda e: e - 1).alias("e"))))
    return parts.select(key, F.col("_p.s").alias("start"), F.col("_p.e").alias("end"), "type", "edited")


def merge_with_previous(segments: DataFrame, which: DataFrame, key: str = "device") -> DataFrame:
    """The segments that begin at (device, start) are taken into the ones before, which become edited."""
    w = Window.partitionBy(key).orderBy("start")
    x = segments.join(which.select(key, "start", F.lit(1).alias("_gone")), [key, "start"], "left").withColumn("_gone", F.when(F.row_number().over(w) > 1, F.col("_gone")))
    x = x.withColumn("_to", F.sum(F.when(F.col("_gone").isNull(), 1).otherwise(0)).over(w))
    return x.groupBy(key, "_to").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("type", "start").alias("type"), (F.bool_or(F.coalesce("_gone", F.lit(0)) == 1) | F.min_by("edited", "start")).alias("edited")).drop("_to")


def move_boundary(segments: DataFrame, moves: DataFrame, key: str = "device") -> DataFrame:
    """The boundary before the segment that begins at (device, start) goes to `to`, within its two segments; both become edited."""
    w = Window.partitionBy(key).orderBy("start")
    x = segments.withColumn("_first", F.lag("start").over(w)).join(moves.select(key, "start", "to"), [key, "start"], "left")
    at = F.greatest(F.col("_first") + 1, F.least(F.col("end"), F.col("to")))
    x = x.withColumn("_at", F.when(F.col("_first").isNotNull() & F.col("to").isNotNull() & (at != F.col("start")), at)).withColumn("_next", F.lead("_at").over(w))
    moved = x.select(key, F.coalesce("_at", "start").alias("start"), F.coalesce(F.col("_next") - 1, F.col("end")).alias("end"), "type", (F.col("edited") | F.col("_at").isNotNull() | F.col("_next").isNotNull()).alias("edited"))
    return auto_merge(moved, key)


def band_by_height(lo: Column, hi: Column, bands: list[tuple[str, float, float]]) -> Column:
    """STRUCT<type, share> of the band (label, lo, hi) that a value range overlaps most, the first of equals; for a range without
    height or overlap, the band that holds its foot."""
    low, high = F.least(lo, hi), F.greatest(lo, hi)
    over = F.array(*(F.struct((F.least(high, F.lit(float(h))) - F.greatest(low, F.lit(float(b)))).alias("o"), F.lit(-i).alias("i"), F.lit(t).alias("t")) for i, (t, b, h) in enumerate(bands)))
    best = F.array_max(F.filter(over, lambda x: x.o > 0))
    foot = None
    for t, b, h in bands:
        test = (low >= b) & (low < h)
        foot = F.when(test, t) if foot is None else foot.when(test, t)
    return F.when(best.isNotNull(), F.struct(best.t.alias("type"), F.when(high > low, best.o / (high - low)).otherwise(1.0).alias("share"))).otherwise(F.struct(foot.alias("type"), F.when(foot.isNotNull(), 1.0).otherwise(0.0).alias("share")))


def dominant_band(points: DataFrame, rects: DataFrame, band: Column, key: str = "device") -> DataFrame:
    """Of the points inside each rectangle (device, rect, t0, t1, v_min, v_max): the commonest band, its share and their number."""
    inside = points.join(rects, key).filter(F.col("t_ms").between(F.col("t0"), F.col("t1")) & F.col("smoothed_mps").between(F.col("v_min"), F.col("v_max")) & ~F.isnan("smoothed_mps"))
    n = inside.withColumn("_b", band).groupBy(key, "rect", "_b").agg(F.count("*").alias("n"), F.min("idx").alias("met"))
    top = n.groupBy(key, "rect").agg(F.min_by("_b", F.struct(-F.col("n"), "met")).alias("type"), F.max("n").alias("most"), F.sum("n").alias("counted"))
    return top.select(key, "rect", "type", (F.col("most") / F.col("counted")).alias("share"), "counted")


def sample_indices(start: Column, end: Column, n: int = SAMPLES) -> Column:
    """At most n indices spread evenly from start to end."""
    size = end - start + 1
    spread = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: start + F.floor(k * (size - 1) / F.lit(max(1, n - 1)) + 0.5))
    return F.when(size <= n, F.sequence(start, end)).otherwise(spread)


def time_per_label(segments: DataFrame, *keys: str) -> DataFrame:
    """Milliseconds of each type."""
    return segments.groupBy(*keys, "type").agg(F.sum(F.col("t1") - F.col("t0")).alias("ms"))
