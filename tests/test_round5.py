"""Viewsheds: the sweep of many observers against one that goes observer by observer and edge by edge, and the plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweave import plans
from geoweave.functions import geo
from geoweave.operators import horizon, visibility
from geoweave.operators.horizon import BINS, M_PER_DEGREE, NEAREST_M, PAVEMENT_M

SF = "/root/testdata/sf0.001"


def _outside(rings: list[np.ndarray]) -> list[np.ndarray]:
    """The rings, moved so that the observer at the origin stands on the pavement of whatever footprint holds it."""
    for _ in range(3):
        move = None
        for r in rings:
            if len(r) < 3:
                continue
            a, b = r, np.roll(r, 1, axis=0)
            straddles = (a[:, 1] > 0) != (b[:, 1] > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                x = a[:, 0] - (b[:, 0] - a[:, 0]) * a[:, 1] / (b[:, 1] - a[:, 1])
            if (straddles & (x > 0)).sum() % 2:
                p, q = r[:-1], r[1:]
                d = q - p
                size = (d * d).sum(1)
                t = np.where(size > 0, np.clip(-(p * d).sum(1) / np.where(size > 0, size, 1), 0, 1), 0.0)
                at = p + d * t[:, None]
                far = np.hypot(at[:, 0], at[:, 1])
                k = int(far.argmin())
                if far[k] > 1e-6:
                    move = at[k] * (far[k] + PAVEMENT_M) / far[k]
                    break
        if move is None:
            break
        rings = [r - move for r in rings]
    return rings


def _skyline(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Horizon bins that an edge covers, and how far it is in each direction sampled."""
    start, end = np.arctan2(p[0], p[1]), np.arctan2(q[0], q[1])
    turn = (end - start + np.pi) % (2 * np.pi) - np.pi
    steps = int(np.ceil(abs(turn) * BINS / (2 * np.pi))) + 1
    theta = start + turn * np.arange(steps + 1) / steps
    d, e = np.stack([np.sin(theta), np.cos(theta)], 1), q - p
    det = d[:, 0] * e[1] - d[:, 1] * e[0]
    ok = np.abs(det) >= 1e-12
    det = np.where(ok, det, 1.0)
    far = (p[0] * e[1] - p[1] * e[0]) / det
    along = (p[0] * d[:, 1] - p[1] * d[:, 0]) / det
    ok &= (far > 0) & (along >= 0) & (along <= 1)
    bins = np.minimum((theta % (2 * np.pi)) * BINS / (2 * np.pi), BINS - 1).astype(int)
    return bins[ok], np.maximum(far[ok], NEAREST_M)


def slow_sweep(lat, lon, eye_m, radius_m, ring_list, target, occluder):
    """One observer's view of buildings in input order, edge by edge: visible and distance_m of each."""
    east = M_PER_DEGREE * np.cos(np.radians(lat))
    rings = _outside([(np.array(r, float).reshape(-1, 2) - (lon, lat)) * (east, M_PER_DEGREE) for r in ring_list])
    far = np.array([np.hypot(r[:, 0], r[:, 1]).min() if len(r) else np.inf for r in rings])
    visible, horizon = np.zeros(len(rings), bool), np.full(BINS, -np.inf)
    for i in np.argsort(far, kind="stable"):
        if far[i] > radius_m:
            break
        if len(rings[i]) < 2:
            continue
        if far[i] < NEAREST_M:
            visible[i] = True
            continue
        parts = [_skyline(p, q) for p, q in zip(rings[i][:-1], rings[i][1:])]
        bins, d = np.concatenate([b for b, _ in parts]), np.concatenate([d for _, d in parts])
        if len(bins):
            visible[i] = ((target[i] - eye_m) / d > horizon[bins]).any()
            np.maximum.at(horizon, bins, (occluder[i] - eye_m) / d)
    return visible, far


def _town(seed, n=90, observers=150):
    """Overlapping blocks, some twice, some lines and points; observers in them, between them and at their corners."""
    rng = np.random.default_rng(seed)
    la, lo = 36 + rng.random(n) * 0.02, -87 + rng.random(n) * 0.02
    a, b = 0.0005 + rng.random(n) * 0.005, 0.0005 + rng.random(n) * 0.005
    rings = [np.array([(x, y), (x + v, y), (x + v * rng.random(), y + u), (x, y + u), (x, y)]) for y, x, u, v in zip(la, lo, a, b)]
    rings[5], rings[7], rings[9] = rings[4].copy(), rings[7][:2], np.repeat(rings[9][:1], 4, 0)
    target = np.where(rng.random(n) < 0.3, 3 + np.floor(rng.random(n) * 37), rng.choice([3.0, 6.5, 10.0, 13.0], n))
    occluder = np.where(rng.random(n) < 0.3, target, target + rng.choice([1.5, 5.0, 42.0], n))
    lat, lon, eye = 36 + rng.random(observers) * 0.02, -87 + rng.random(observers) * 0.02, rng.choice([1.7, 1.7, 12.0, 60.0], observers)
    lat[0], lon[0] = rings[0][0][::-1]
    return rings, target, occluder, lat, lon, eye


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_the_sweep_of_many_observers_is_that_of_each(seed, monkeypatch):
    monkeypatch.setattr(horizon, "PAIRS", 2000)
    rings, target, occluder, lat, lon, eye = _town(seed)
    n = np.array([len(r) for r in rings])
    vertices = np.concatenate(rings)
    pairs = np.random.default_rng(seed).random((len(lat), len(rings))) < 0.7
    q, f = np.nonzero(pairs)
    visible, far = horizon.sweep(lat, lon, eye, (vertices[:, 0], vertices[:, 1], np.cumsum(n) - n, n), target, occluder, q, f, 800.0)
    assert 0.05 < visible.mean() < 0.5
    for i in range(len(lat)):
        g = f[q == i]
        want = slow_sweep(lat[i], lon[i], eye[i], 800.0, [rings[k] for k in g], target[g], occluder[g])
        assert (visible[q == i] == want[0]).all() and (far[q == i] == want[1]).all()


def test_viewsheds_stay_in_their_tile(spark):
    """v3: observers and buildings meet in one tile join. v4: so do they, and a group's lists are put together after it."""
    for name, gathered in (("v3_viewshed", 0), ("v4_viewshed_union", 1)):
        plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FlatMapCoGroupsInArrow") == 1 and plan.count("FlatMapGroupsInArrow") == gathered and "Join" not in plan and "Pandas" not in plan


def test_groups_see_what_their_observers_see(spark):
    """v4: the union of the viewsheds, over several tiles and with names, ties and nobody as groups."""
    rings, _, _, lat, lon, eye = _town(4, 60, 80)
    lat[40:], lon[40:] = lat[:40], lon[:40]
    east = np.arange(80) % 4 * 0.1
    b = [(k + 1000 * j, [{"lon": float(x + j * 0.1), "lat": float(y)} for x, y in r], ["house", "garage", "office"][k % 3], None if k % 4 else 20.0) for j in range(4) for k, r in enumerate(rings)]
    buildings = spark.createDataFrame(b, f"fid long, coords {geo.COORDS}, building_type string, height_m double")
    rows = [(i, None if i % 9 == 8 else f"g{i % 9}", float(lat[i]), float(lon[i] + east[i]), 1.7) for i in range(80)]
    o = spark.createDataFrame(rows, "qid long, name string, lat double, lon double, eye_m double")
    views = visibility.viewshed(o, buildings, 800.0).join(o.select("qid", "name"), "qid")
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    want = order(visibility.viewshed_union(views, "name"))
    assert order(visibility.viewshed_of_groups(o, buildings, 800.0, "name")) == want
    assert len(want) > 500 and {r[0] for r in want} >= {None, "g1"} and any(r[3] > 1 for r in want) and any(r[4] is None for r in want)
    far = o.withColumn("lat", F.lit(-40.0))
    assert visibility.viewshed_of_groups(far, buildings, 800.0, "name").count() == visibility.viewshed(far, buildings, 800.0).count() == 0
