"""Per-device logic that needs memory, as step functions over a plain dict of state.

The same functions run in batch (a device's rows in order of arrival) and in Structured Streaming (state kept between batches).
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field, replace

from geoweave.operators import motion as M

EARTH_RADIUS_M = 6_371_000.0
UNKNOWN, STATIONARY, WALKING, RUNNING, DRIVING = "unknown", "stationary", "walking", "running", "driving"
LEVELS = ("off", "passive", "low", "balanced", "high", "burst")


def finite(x) -> bool:
    return x is not None and math.isfinite(x)


def haversine(lat1, lon1, lat2, lon2) -> float:
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.atan2(math.sqrt(a), math.sqrt(1 - a))


@dataclass(frozen=True)
class SpeedRules:
    """M1's fixed values."""

    stationary_max_mps: float = M.STATIONARY_MPS
    driving_min_mps: float = M.DRIVING_MPS
    smoothing: int = M.SMOOTHING
    dwell: int = 2
    accuracy_gate_m: float = M.ACCURACY_GATE_M
    gap_ms: int = M.GAP_MS


def new_speed() -> dict:
    return {"speeds": [], "last": None, "state": UNKNOWN, "pending": None}


def smoothed(s: dict) -> float | None:
    """The mean as a window of SQL takes it: added up in order. sum() carries the rounding along since Python 3.12, which moves speeds that
    lie on the limit of a band."""
    total = 0.0
    for v in s["speeds"]:
        total += v
    return total / len(s["speeds"]) if s["speeds"] else None


def band(v: float, rules: SpeedRules = SpeedRules()) -> str:
    return STATIONARY if v <= rules.stationary_max_mps else DRIVING if v >= rules.driving_min_mps else WALKING


def push_speed(s: dict, t_ms: int, lat: float, lon: float, accuracy_m: float, speed_mps: float | None, rules: SpeedRules = SpeedRules()) -> str:
    """M1: take one fix; the state afterwards."""
    if not finite(accuracy_m) or accuracy_m > rules.accuracy_gate_m:
        return s["state"]
    last, s["last"] = s["last"], [t_ms, lat, lon]
    dt = t_ms - last[0] if last and t_ms >= last[0] else None
    speed = speed_mps if finite(speed_mps) and speed_mps >= 0 else None
    if dt is not None and dt > rules.gap_ms:
        s["speeds"], s["pending"] = [], None
    elif speed is None and dt:
        metres = haversine(last[1], last[2], lat, lon)
        speed = metres / (dt / 1000) if finite(metres) else None
    if speed is None:
        return s["state"]
    s["speeds"] = [*s["speeds"], speed][-max(1, rules.smoothing) :]
    target = band(smoothed(s), rules)
    if target == s["state"]:
        s["pending"] = None
    else:
        n = s["pending"][1] + 1 if s["pending"] and s["pending"][0] == target else 1
        if n >= max(1, rules.dwell):
            s["state"], s["pending"] = target, None
        else:
            s["pending"] = [target, n]
    return s["state"]


def accel_vote(accel: dict | None) -> tuple[str, float]:
    """M5."""
    a = accel or {}
    f, v, n = a.get("dominant_frequency") or 0.0, a.get("variance") or 0.0, a.get("step_count") or 0
    table = ((f > 2.5 and v > 0.3, RUNNING, 0.5), (f > 1 and v > 0.01, WALKING, 0.6), (n > 0 and v > 0.02, WALKING, 0.4), (f < 1 and v < 1, STATIONARY, 0.7), (f < 1 and 1 <= v < 5, DRIVING, 0.4))
    return next(((m, c) for test, m, c in table if test), (STATIONARY, 0.85))


def classify(speed: float | None, accuracy_m: float | None, road: dict | None = None, accel: dict | None = None, bearing: float | None = None, previous: str = UNKNOWN) -> tuple[str, float]:
    """M4: the vote of one fix. road: road_class, distance_m, bearing. accel: variance, dominant_frequency, step_count, window_duration_s."""
    a, moving = accel or {}, speed if speed is not None and not math.isnan(speed) else -math.inf
    f, v, n = a.get("dominant_frequency") or 0.0, a.get("variance") or 0.0, a.get("step_count") or 0
    if accuracy_m is not None and (not finite(accuracy_m) or accuracy_m > M.GPS_GATE_M):
        return (DRIVING, 0.85) if finite(speed) and speed > M.DRIVING_FLOOR_MPS else accel_vote(accel)
    cls, far = (road["road_class"], road["distance_m"]) if road else ("", math.inf)
    highway, street, foot = cls in M.HIGHWAY or cls.endswith("_link"), cls in M.VEHICULAR, cls in M.FOOTPATH
    stepping = 1 <= f <= 3 and n > 3 and v > 0.01
    rules = []
    if road and speed is not None:
        if road.get("bearing") is not None and bearing is not None and moving > 2 and far < 15 and (highway or street):
            gap = math.fmod(abs(road["bearing"] - bearing), 180.0)
            rules += [(gap < 25 or gap > 155, DRIVING, 0.95), (70 <= gap <= 110 and moving > 5, DRIVING, 0.9)]
        if highway and far < 10 and moving > 2.2:
            rules.append((not (far > 5 and 1 <= f <= 3 and n > 4), DRIVING, 0.95))
        else:
            rules += [(foot and far < 5 and moving > 1.1, WALKING, 0.9), (street and far < 10 and moving > 2.2, DRIVING, 0.85), (far > 50 and 0.5 <= moving <= 2.2, WALKING, 0.9)]
    lane = finite(bearing) or (far < 15 and (highway or street))
    silent = not (f or v or n)
    rules += [
        (previous == DRIVING and moving > 0.3 and not stepping and lane, DRIVING, 0.75),
        (previous == WALKING and silent and finite(speed) and M.STATIONARY_MPS < speed <= M.WALKING_CEILING_MPS, WALKING, 0.75),
        (moving > M.DRIVING_FLOOR_MPS, DRIVING, 0.9),
        (moving > 5 and (a.get("window_duration_s") or 0) > 0 and not stepping, DRIVING, 0.8),
        (moving > M.WALKING_CEILING_MPS, WALKING, 0.85),
    ]
    return next(((m, c) for test, m, c in rules if test), None) or accel_vote(accel)


@dataclass(frozen=True)
class DebounceRules:
    """M6's fixed values."""

    majority: int = 5
    rapid_ms: int = 15_000
    default_ms: int = 60_000
    vehicle_sticky_ms: int = 150_000
    signal_sticky_ms: int = 300_000
    signal_radius_m: float = 25.0
    continuous: int = 3


RESPONSIVE = DebounceRules(majority=3, rapid_ms=3_000, default_ms=3_000, vehicle_sticky_ms=90_000)


def new_debounce() -> dict:
    return {"votes": [], "current": UNKNOWN, "pending": None, "since": 0, "last_driving": None}


def holds_traffic(control: dict | None, radius_m: float = 25.0) -> bool:
    """M7."""
    return bool(control) and control["intersection_type"] in (1, 2, 3) and control["distance_m"] <= radius_m


def debounce(s: dict, movement: str, now_ms: int, control: dict | None = None, rules: DebounceRules = DebounceRules()) -> str:
    """M6: take one vote; the movement held afterwards."""
    s["votes"] = [*s["votes"], movement][-max(1, rules.majority) :]
    if movement == DRIVING:
        s["last_driving"] = now_ms
    major = next((v for v in s["votes"] if 2 * s["votes"].count(v) > len(s["votes"])), None)
    if major is None:
        return s["current"]
    if major == s["current"]:
        s["pending"] = None
        return major
    if s["pending"] and s["pending"][0] == major:
        s["pending"] = [major, s["pending"][1] + 1]
    else:
        s["pending"], s["since"] = [major, 1], now_ms
    if s["current"] == DRIVING and major == STATIONARY and s["last_driving"] is not None:
        hold = max(rules.signal_sticky_ms, rules.vehicle_sticky_ms) if holds_traffic(control, rules.signal_radius_m) else rules.vehicle_sticky_ms
        if max(0, now_ms - s["last_driving"]) < hold:
            return s["current"]
    wait = rules.rapid_ms if major == DRIVING else rules.default_ms
    if s["pending"][1] >= max(1, rules.continuous) and max(0, now_ms - s["since"]) >= wait:
        s["current"], s["pending"] = major, None
    return s["current"]


def new_tracker() -> dict:
    return {"speed": new_speed(), "debounce": new_debounce()}


def track(s: dict, fix: dict, rules: SpeedRules = SpeedRules(), hold: DebounceRules = DebounceRules()) -> dict:
    """M9: one fix (t_ms, lat, lon, speed_mps, accuracy_m, road, accel, control) through speed, vote and debouncer. Missing accuracy counts
    as perfect; a negative platform speed as none."""
    platform = fix.get("speed_mps")
    platform = platform if finite(platform) and platform >= 0 else None
    accuracy = fix.get("accuracy_m")
    push_speed(s["speed"], fix["t_ms"], fix["lat"], fix["lon"], 0.0 if accuracy is None else accuracy, platform, rules)
    speed = platform if platform is not None else smoothed(s["speed"])
    movement, confidence = classify(speed, accuracy, fix.get("road"), fix.get("accel"), None, s["debounce"]["current"])
    held = debounce(s["debounce"], movement, fix["t_ms"], fix.get("control"), hold)
    return {"movement": held, "vote": movement, "confidence": confidence, "smoothed_mps": smoothed(s["speed"]), "at_control": holds_traffic(fix.get("control"), hold.signal_radius_m)}


@dataclass(frozen=True)
class SamplingRules:
    """M10's fixed values: (location interval ms, least distance m, accelerometer Hz) by movement, and times in ms."""

    location_ms: dict = field(default_factory=lambda: {UNKNOWN: 1_000, STATIONARY: 60_000, WALKING: 5_000, RUNNING: 2_000, DRIVING: 2_000})
    distance_m: dict = field(default_factory=lambda: {UNKNOWN: 0.0, STATIONARY: 25.0, WALKING: 5.0, RUNNING: 3.0, DRIVING: 8.0})
    accel_hz: dict = field(default_factory=lambda: {UNKNOWN: 50, STATIONARY: 5, WALKING: 20, RUNNING: 25, DRIVING: 10})
    location_level: dict = field(default_factory=lambda: {UNKNOWN: "high", STATIONARY: "passive", WALKING: "balanced", RUNNING: "high", DRIVING: "high"})
    accel_level: dict = field(default_factory=lambda: {UNKNOWN: "burst", STATIONARY: "passive", WALKING: "balanced", RUNNING: "high", DRIVING: "low"})
    window_ms: int = 4_000
    burst_ms: int = 10_000
    hold_ms: int = 15_000
    ttl_ms: int = 10_000
    confidence: float = 0.6


@dataclass(frozen=True)
class Capabilities:
    location: bool = True
    accelerometer: bool = True
    passive_location: bool = True
    motion_wakeup: bool = True
    least_interval_ms: int | None = None
    most_hz: int | None = None


@dataclass(frozen=True)
class Advice:
    location_level: str
    location_ms: int | None
    distance_m: float | None
    accel_level: str
    accel_hz: int | None
    window_ms: int | None
    burst_ms: int | None
    reevaluate_ms: int
    reason: str
    generation: int = 1
    limited: bool = False

    def hardware(self) -> tuple:
        return (self.location_level, self.location_ms, self.distance_m, self.accel_level, self.accel_hz, self.window_ms, self.burst_ms)

    def strength(self) -> int:
        return max(LEVELS.index(self.location_level), LEVELS.index(self.accel_level))


def _profile(movement: str, reason: str, rules: SamplingRules, can: Capabilities) -> Advice:
    accel = "low" if movement == STATIONARY and not can.motion_wakeup else rules.accel_level[movement]
    burst = rules.burst_ms if accel == "burst" else None
    again = max(1, min(rules.ttl_ms if burst is None else burst, max(1, rules.ttl_ms)))
    return Advice(rules.location_level[movement], max(1, rules.location_ms[movement]), rules.distance_m[movement], accel, max(1, rules.accel_hz[movement]), max(1, rules.window_ms), burst, again, reason)


def _for_intent(a: Advice, intent: str) -> Advice:
    most = lambda x, y: max(x, y, key=LEVELS.index)
    if intent == "tracking":
        return replace(a, location_level=most(a.location_level, "balanced"), location_ms=min(a.location_ms or 5_000, 5_000), accel_level=most(a.accel_level, "low"))
    if intent == "navigation":
        return replace(a, location_level=most(a.location_level, "high"), location_ms=min(a.location_ms or 2_000, 2_000), distance_m=min(5.0 if a.distance_m is None else a.distance_m, 5.0))
    return a


def _within(a: Advice, can: Capabilities) -> Advice:
    """The advice cut down to what the device can do."""
    cut = a
    if not can.location:
        cut = replace(cut, location_level="off", location_ms=None, distance_m=None)
    else:
        if cut.location_level == "passive" and not can.passive_location:
            cut = replace(cut, location_level="low")
        if can.least_interval_ms is not None and cut.location_ms is not None:
            cut = replace(cut, location_ms=max(cut.location_ms, can.least_interval_ms))
    if not can.accelerometer:
        cut = replace(cut, accel_level="off", accel_hz=None, window_ms=None, burst_ms=None)
    elif can.most_hz is not None and cut.accel_hz is not None:
        cut = replace(cut, accel_hz=min(cut.accel_hz, can.most_hz))
    asked = (a.location_level, a.location_ms if can.location else None, a.accel_level, a.accel_hz if can.accelerometer else None)
    got = (cut.location_level, cut.location_ms, cut.accel_level, cut.accel_hz)
    return cut if asked == got else replace(cut, limited=True, reason="capability_limited")


def new_sampler(can: Capabilities = Capabilities(), rules: SamplingRules = SamplingRules()) -> dict:
    return {"intent": "background", "advice": asdict(_within(_profile(UNKNOWN, "initializing", rules, can), can)), "raised": 0, "burst_start": None, "burst_done": False}


def _reason(movement: str, vote: tuple[str, float], evidence: dict, rules: SamplingRules) -> str:
    location, accel = evidence["location"], evidence["accelerometer"]
    table = (
        (not location and not accel, "initializing"),
        (evidence["poor"] and not accel, "poor_location_accuracy"),
        (movement == UNKNOWN, "initializing"),
        (vote[0] != movement, "pending_transition"),
        (vote[1] < rules.confidence, "low_confidence"),
        (not location, "missing_location"),
        (not accel and movement in (WALKING, RUNNING), "missing_accelerometer"),
    )
    return next((r for test, r in table if test), f"stable_{movement}")


def advise(s: dict, movement: str, vote: tuple[str, float], evidence: dict, now_ms: int, can: Capabilities = Capabilities(), rules: SamplingRules = SamplingRules()) -> bool:
    """New advice into s["advice"]; whether the hardware request changed."""
    reason = _reason(movement, vote, evidence, rules)
    want = _for_intent(_profile(movement if reason.startswith("stable_") else UNKNOWN, reason, rules, can), s["intent"])
    expired = False
    if want.accel_level != "burst":
        s["burst_start"], s["burst_done"] = None, False
    else:
        if not s["burst_done"] and s["burst_start"] is None:
            s["burst_start"] = now_ms
        expired = not s["burst_done"] and max(0, now_ms - s["burst_start"]) >= rules.burst_ms
        s["burst_done"] |= expired
        if s["burst_done"]:
            want = replace(want, accel_level="high", burst_ms=None, reevaluate_ms=max(1, rules.ttl_ms))
    want, have = _within(want, can), Advice(**s["advice"])
    waited = max(0, now_ms - s["raised"])
    if want.strength() < have.strength() and not expired and waited < rules.hold_ms:
        s["advice"] = asdict(replace(have, reevaluate_ms=rules.hold_ms - waited, reason=want.reason))
        return False
    if want.strength() > have.strength():
        s["raised"] = now_ms
    if want.accel_level != "burst":
        s["burst_start"] = None
    elif have.accel_level != "burst":
        s["burst_start"] = now_ms
    changed = want.hardware() != have.hardware()
    s["advice"] = asdict(replace(want, generation=have.generation + changed))
    return changed


def new_session(can: Capabilities = Capabilities(), rules: SamplingRules = SamplingRules()) -> dict:
    return new_tracker() | {"sampler": new_sampler(can, rules), "vote": [UNKNOWN, 0.0], "evidence": {"location": False, "accelerometer": False, "poor": False}, "at_control": False}


def observe(s: dict, o: dict, speed_rules: SpeedRules = SpeedRules(), hold: DebounceRules = DebounceRules(), can: Capabilities = Capabilities(), rules: SamplingRules = SamplingRules()) -> dict:
    """One observation (t_ms, and location, accel, road, control where known). A location without accuracy doesn't move the speed."""
    at, accel, road, control = (o.get(k) for k in ("location", "accel", "road", "control"))
    if at and finite(at["lat"]) and finite(at["lon"]) and abs(at["lat"]) <= 90 and abs(at["lon"]) <= 180:
        accuracy = at.get("accuracy_m")
        push_speed(s["speed"], o["t_ms"], at["lat"], at["lon"], math.inf if accuracy is None else accuracy, at.get("speed_mps"), speed_rules)
    platform = (at or {}).get("speed_mps")
    speed = platform if finite(platform) and platform >= 0 else smoothed(s["speed"])
    accuracy = (at or {}).get("accuracy_m")
    nothing = at is None and accel is None and road is None
    s["vote"] = [UNKNOWN, 0.0] if nothing else list(classify(speed, accuracy, road, accel, (at or {}).get("bearing"), s["debounce"]["current"]))
    debounce(s["debounce"], s["vote"][0], o["t_ms"], control, hold)
    s["at_control"] = holds_traffic(control, hold.signal_radius_m)
    s["evidence"] = {"location": at is not None, "accelerometer": accel is not None, "poor": accuracy is not None and (not finite(accuracy) or accuracy > speed_rules.accuracy_gate_m)}
    return tick(s, o["t_ms"], can, rules)


def tick(s: dict, now_ms: int, can: Capabilities = Capabilities(), rules: SamplingRules = SamplingRules()) -> dict:
    """The timer: advice again, without new data."""
    changed = advise(s["sampler"], s["debounce"]["current"], tuple(s["vote"]), s["evidence"], now_ms, can, rules)
    return {"movement": s["debounce"]["current"], "vote": s["vote"][0], "confidence": s["vote"][1], "smoothed_mps": smoothed(s["speed"]), "at_control": s["at_control"], "changed": changed} | s["sampler"]["advice"]
