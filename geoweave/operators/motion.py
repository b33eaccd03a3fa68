"""Motion over whole traces in batch: speeds, bands, votes and shifts, as windows and expressions.

Traces are rows (device, seq, t_ms, lat, lon, speed_mps, accuracy_m); seq is the order of arrival, which is the order that counts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweave.functions import geo, stats

#: Speed bands and gates (m/s, m, ms).
STATIONARY_MPS, DRIVING_MPS, WALKING_CEILING_MPS, DRIVING_FLOOR_MPS, RUNNING_HINT_MPS = 0.5, 5.0, 2.2, 8.9, 2.6
ACCURACY_GATE_M, GPS_GATE_M, GAP_MS, SMOOTHING = 50.0, 30.0, 30_000, 5
#: Fixed values of the shift test.
SHIFT_WINDOW, SHIFT_ALPHA, SHIFT_APART, SHIFT_MPS = 12, 0.01, 8, 0.4
#: Road classes that speak for driving or walking.
HIGHWAY, VEHICULAR, FOOTPATH = ("motorway", "trunk"), ("residential", "unclassified", "service"), ("footway", "path", "pedestrian", "steps")


def speed_band(speed: Column) -> Column:
    """Stationary, walking or driving by smoothed speed."""
    return F.when(speed <= STATIONARY_MPS, "stationary").when(speed >= DRIVING_MPS, "driving").otherwise("walking")


def smoothed_speeds(trace: DataFrame, key: str = "device") -> DataFrame:
    """M1 without its dwell rule: for each accepted fix the effective speed, its mean over the last five since a gap, and its band.

    A fix counts if its accuracy is within the gate. Its speed is the platform's if that is finite and not negative, else distance over
    time since the last accepted fix. A gap of over 30 s starts the mean anew (and leaves only the platform's speed)."""
    ok = trace.filter(geo.is_finite("accuracy_m") & (F.col("accuracy_m") <= ACCURACY_GATE_M))
    w = Window.partitionBy(key).orderBy("seq")
    ok = ok.withColumns({f"_{c}": F.lag(c).over(w) for c in ("t_ms", "lat", "lon")}).withColumn("_dt", F.col("t_ms") - F.col("_t_ms"))
    gap = F.coalesce(F.col("_dt") > GAP_MS, F.lit(False))
    platform = F.when(geo.is_finite("speed_mps") & (F.col("speed_mps") >= 0), F.col("speed_mps"))
    derived = F.when(~gap & (F.col("_dt") > 0), geo.haversine_m("_lat", "_lon", "lat", "lon") / (F.col("_dt") / 1000))
    ok = ok.withColumn("effective_mps", F.coalesce(platform, F.when(geo.is_finite(derived), derived))).withColumn("island", F.sum(gap.cast("int")).over(w))
    timed = ok.filter("effective_mps IS NOT NULL")
    recent = Window.partitionBy(key, "island").orderBy("seq").rowsBetween(1 - SMOOTHING, 0)
    timed = timed.withColumn("smoothed_mps", F.avg("effective_mps").over(recent))
    return timed.withColumn("band", speed_band(F.col("smoothed_mps"))).drop("_t_ms", "_lat", "_lon", "_dt")


def accel_stats(x: Column, y: Column, z: Column) -> Column:
    """M2: STRUCT<mean_magnitude, variance> (population) of three axes, over the shortest of them."""
    n = F.least(F.size(x), F.size(y), F.size(z))
    sizes = F.zip_with(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda a, b: a * a + b * b), F.slice(z, 1, n), lambda s, c: F.sqrt(s + c * c))
    mean = F.aggregate(sizes, F.lit(0.0), lambda s, m: s + m) / n
    return geo.let(F.struct(sizes.alias("m"), mean.alias("mean")), lambda v: F.struct(v["mean"].alias("mean_magnitude"), (F.aggregate(v.m, F.lit(0.0), lambda s, m: s + (m - v["mean"]) * (m - v["mean"])) / F.size(v.m)).alias("variance")))


def step_cadence(df: DataFrame, rate_hz: float, column: str = "magnitudes") -> DataFrame:
    """M3: adds steps and cadence_hz of a column of magnitude arrays."""

    def run(s: pd.Series) -> pd.DataFrame:
        import numpy as np

        return pd.DataFrame([stats.cadence(np.asarray(m, float), rate_hz) for m in s], columns=["steps", "cadence_hz"])

    udf = F.pandas_udf(run, "steps int, cadence_hz double")
    return df.withColumn("_c", udf(F.col(column))).select("*", "_c.steps", "_c.cadence_hz").drop("_c")


def _vote(*rules: tuple[Column, str, float]) -> Column:
    out = None
    for test, movement, confidence in rules:
        vote = F.struct(F.lit(movement).alias("movement"), F.lit(confidence).alias("confidence"))
        out = F.when(test, vote) if out is None else out.when(test, vote)
    return out


def vote_by_accel(frequency: Column, variance: Column, steps: Column) -> Column:
    """M5: STRUCT<movement, confidence> from acceleration alone; missing values count as 0."""
    f, v, n = (F.coalesce(c, F.lit(0)) for c in (frequency, variance, steps))
    return _vote(((f > 2.5) & (v > 0.3), "running", 0.5), ((f > 1) & (v > 0.01), "walking", 0.6), ((n > 0) & (v > 0.02), "walking", 0.4), ((f < 1) & (v < 1), "stationary", 0.7), ((f < 1) & (v >= 1) & (v < 5), "driving", 0.4), (F.lit(True), "stationary", 0.85))


def vote(speed: Column, accuracy: Column, road_class: Column, road_m: Column, road_bearing: Column, bearing: Column, frequency: Column, variance: Column, steps: Column, window_s: Column, previous: Column) -> Column:
    """M4: STRUCT<movement, confidence> of one fix, given what the debouncer held before; absent evidence is NULL."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    f, v, n = (F.coalesce(c, F.lit(0)) for c in (frequency, variance, steps))
    highway = yes(road_class.isin(*HIGHWAY) | road_class.endswith("_link"))
    street, foot = yes(road_class.isin(*VEHICULAR)), yes(road_class.isin(*FOOTPATH))
    poor = yes(F.isnan(accuracy) | (accuracy > GPS_GATE_M))
    accel = vote_by_accel(frequency, variance, steps)
    gap = F.pmod(F.abs(road_bearing - bearing), F.lit(180.0))
    close = yes((speed > 2) & (road_m < 15) & gap.isNotNull()) & (highway | street)
    gait = (f >= 1) & (f <= 3)
    stepping = gait & (n > 3) & (v > 0.01)
    in_lane = yes(geo.is_finite(bearing)) | (yes(road_m < 15) & (highway | street))
    on_highway = highway & yes((road_m < 10) & (speed > 2.2))
    by_rules = _vote(
        (close & yes((gap < 25) | (gap > 155)), "driving", 0.95),
        (close & yes(gap.between(70, 110) & (speed > 5)), "driving", 0.9),
        (on_highway & ~(yes(road_m > 5) & gait & (n > 4)), "driving", 0.95),
        (~on_highway & foot & yes((road_m < 5) & (speed > 1.1)), "walking", 0.9),
        (~on_highway & street & yes((road_m < 10) & (speed > 2.2)), "driving", 0.85),
        (~on_highway & yes((road_m > 50) & speed.between(0.5, 2.2)), "walking", 0.9),
        (yes((previous == "driving") & (speed > 0.3)) & ~stepping & in_lane, "driving", 0.75),
        (yes((previous == "walking") & (speed > STATIONARY_MPS) & (speed <= WALKING_CEILING_MPS)) & (f == 0) & (v == 0) & (n == 0), "walking", 0.75),
        (yes(speed > DRIVING_FLOOR_MPS), "driving", 0.9),
        (yes((speed > 5) & (window_s > 0)) & ~stepping, "driving", 0.8),
        (yes(speed > WALKING_CEILING_MPS), "walking", 0.85),
    )
    blind = F.when(yes(geo.is_finite(speed) & (speed > DRIVING_FLOOR_MPS)), F.struct(F.lit("driving").alias("movement"), F.lit(0.85).alias("confidence"))).otherwise(accel)
    return F.when(poor, blind).otherwise(F.coalesce(by_rules, accel))


def shift_tests(speeds: DataFrame, key: str = "device", window: int = SHIFT_WINDOW, alpha: float = SHIFT_ALPHA, least_mps: float = SHIFT_MPS) -> DataFrame:
    """M12 before thinning: Welch tests of the `window` samples from each one on against those before it: idx, before_mps, after_mps,
    t_stat, df, p_value and the corrected level. Samples (key, seq, t_ms, speed_mps)."""
    w = Window.partitionBy(key).orderBy("seq")
    finite = F.when(geo.is_finite("speed_mps"), F.col("speed_mps"))
    x = speeds.withColumn("_x", finite).withColumn("idx", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    before, after = w.rowsBetween(-window, -1), w.rowsBetween(0, window - 1)
    spread = lambda f: F.when(F.count("_x").over(f) >= 2, F.var_samp("_x").over(f)).otherwise(F.when(F.count("_x").over(f) == 1, 0.0))
    x = x.withColumns({"before_mps": F.avg("_x").over(before), "after_mps": F.avg("_x").over(after), "_v1": spread(before) / window, "_v2": spread(after) / window})
    inside = x.filter((F.col("_n") >= 2 * window + 1) & (F.col("idx") >= window) & (F.col("idx") < F.col("_n") - window))
    se = F.col("_v1") + F.col("_v2")
    down = (F.col("_v1") * F.col("_v1") + F.col("_v2") * F.col("_v2")) / (window - 1)
    tested = inside.filter(se > 0).filter(down > 0).withColumn("t_stat", (F.col("after_mps") - F.col("before_mps")) / F.sqrt(se)).withColumn("df", se * se / down)
    tested = tested.filter(F.abs(F.col("after_mps") - F.col("before_mps")) >= least_mps)
    p = F.pandas_udf(stats.t_two_sided, "double")
    tested = tested.withColumn("p_value", p("t_stat", "df")).withColumn("alpha_corrected", F.lit(alpha) / (F.col("_n") - 2 * window))
    return tested.select(key, "idx", "t_ms", "t_stat", "df", "p_value", "alpha_corrected", "before_mps", "after_mps")


def significant_shifts(speeds: DataFrame, key: str = "device", apart: int = SHIFT_APART, **test) -> DataFrame:
    """The significant shifts, thinned to the strongest within `apart` samples. Thinning is greedy, so it runs once per device over
    its significant tests only."""
    found = shift_tests(speeds, key, **test).filter("p_value <= alpha_corrected")

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        order = pdf.assign(a=-pdf["t_stat"].abs()).sort_values(["a", "idx"]).index
        for i in order:
            if all(abs(pdf.at[i, "idx"] - pdf.at[j, "idx"]) >= max(1, apart) for j in kept):
                kept.append(i)
        return pdf.loc[kept].sort_values("idx")

    return found.groupBy(key).applyInPandas(thin, found.schema)
