import random

import pytest
import zstandard

from geoweave.operators import segments
from geoweave.sources import gpx, layers, tiles

RNG = random.Random(7)


def line(n):
    x, y = RNG.randrange(-8700000, 8700000), RNG.randrange(-8000000, 8000000)
    out = []
    for _ in range(n):
        out.append({"lon": x / 100000, "lat": y / 100000})
        x, y = x + RNG.randrange(-500, 500), y + RNG.randrange(-500, 500)
    return out


def sample(layer, i):
    base = {"osm_id": 10**10 + i * RNG.randrange(1, 999)}
    at = {"lat": RNG.randrange(-9000000, 9000000) / 100000, "lon": RNG.randrange(-18000000, 18000000) / 100000}
    name = RNG.choice((None, "Main Street", "Rue de l'Été", ""))
    of = {
        "signals": {**base, **at, "signal_type": "stop", "direction": RNG.choice((None, 90))},
        "camera": {**base, **at, "device_type": "ALPR", "placement": "public", "camera_type": "dome", "direction": RNG.choice((None, 359)), "operator": name, "name": name, "ref_tag": None, "angle": RNG.choice((None, 60))},
        "ev": {**base, **at, "access": "yes", "power_dkw": 1500, "capacity": 4, "connector_bits": 34, "name": name, "network": name, "ref_tag": None},
        "parks": {**base, "coords": line(RNG.choice((0, 5, 300))), "park_type": "park", "name": name},
        "water": {**base, "geom_type": 1, "coords": line(7), "ref_feature_id": None, "water_type": "river", "name": name, "width": RNG.choice((None, 12)), "depth": None},
        "rail": {**base, "geom_type": i % 2, "coords": line(1 if i % 2 else 6), "rail_type": "tram", "name": name},
        "trails": {**base, "geom_type": i % 2, "coords": line(1 if i % 2 else 6), "trail_type": "path", "trail_surface": "gravel", "sac_scale": "", "name": name},
        "roads": {**base, "osm_id": 10**10 + i * 5, "coords": line(4), "road_class": RNG.choice(("motorway", "busway")), "name": name, "ref_tag": None, "oneway": RNG.choice((None, "forward")), "speed_limit_kmh": RNG.choice((None, 50)), "lanes": None, "road_surface": None, "bridge_tunnel": RNG.choice((None, "tunnel"))},
        "name_index": {"name": name or "x", **at, "uid": i, "category_idx": 3},
        "address": {**base, "housenumber": "12b", "street": "Main"},
    }
    return of[layer]


@pytest.mark.parametrize("layer", sorted(set(tiles.RECORDS) - {"address_at"}))
def test_records_round_trip_and_survive_every_prefix(layer):
    rows = [sample(layer, i) for i in range(12)]
    data = tiles.encode(layer, rows)
    shown = [{k: v for k, v in r.items() if k in dict(tiles._columns(tiles.RECORDS[layer]))} for r in tiles.decode(layer, data)]
    assert shown == [{k: r.get(k) for k, _ in tiles._columns(tiles.RECORDS[layer])} for r in rows]
    for cut in range(0, len(data), 7):
        try:
            assert len(list(tiles.decode(layer, data[:cut]))) <= 12
        except tiles.TileError:
            pass


def test_positions_relative_to_a_centre():
    rows = [{"osm_id": 5, "lat": 36.00012, "lon": -86.5, "housenumber": "1", "street": "a"}]
    assert list(tiles.decode("address_at", tiles.encode("address_at", rows, (-8650000, 3600000)), (-8650000, 3600000))) == rows


@pytest.mark.parametrize("merged", [0, 3])
@pytest.mark.parametrize("base", ["absolute", "relative"])
def test_data_source(spark, tmp_path, merged, base):
    tiles.register(spark)
    words = [f"training sample number {i} of the dictionary".encode() for i in range(200)]
    dictionary = zstandard.train_dictionary(1024, words * 5).as_bytes() if merged else b""
    cells = {1000 + i: tiles.encode("signals", [sample("signals", k) for k in range(i % 4 + 1)]) for i in range(10)}
    path = str(tmp_path / "TN.signals.bin")
    tiles.write_file(path, "S", 1, cells, merged, dictionary, base=base)
    plan = tiles.plan_file(path)
    assert plan.layer == "signals" and plan.merged == bool(merged) and len(plan.entries) == 10 and plan.entry_source == "declared" and plan.offset_base == base
    df = spark.read.format("celltiles").option("path", path).load()
    got = {r.cell: r["count"] for r in df.groupBy("cell").count().collect()}
    assert got == {1000 + i: i % 4 + 1 for i in range(10)}
    assert df.filter("cell = 1003").count() == 4 and df.filter("cell IN (1001, 1002)").count() == 5 and df.filter("cell = 7").count() == 0


def test_bad_files(tmp_path):
    p = str(tmp_path / "x")
    tiles.write_file(p, "S", 7, {1: b""})
    with pytest.raises(tiles.TileError):
        tiles.plan_file(p)
    open(p, "wb").write(b"short")
    with pytest.raises(tiles.TileError):
        tiles.plan_file(p)
    tiles.write_file(p, "S", 1, {1: tiles.encode("signals", [sample("signals", 1)])})
    data = open(p, "rb").read()
    open(p, "wb").write(data[:-3])
    plan = tiles.plan_file(p)
    with pytest.raises(tiles.TileError):
        tiles.read_at(p, plan.entries[0].offset, plan.entries[0].length)


GPX = """<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><name>t</name><trkseg>
<trkpt lat="35.96" lon="-83.92"><ele>264.0</ele><time>2026-08-08T09:00:07Z</time><extensions><speed>0.1</speed><accuracy>8.0</accuracy><accel_variance>0.02</accel_variance></extensions></trkpt>
<trkpt lat="35.97" lon="-83.92"><time>2026-08-08T09:00:12.500Z</time></trkpt><trkpt lat="35.98" lon="-83.92"></trkpt></trkseg></trk></gpx>"""


def test_gpx(spark, tmp_path):
    (tmp_path / "a.gpx").write_text(GPX)
    p = gpx.read_gpx(spark, str(tmp_path / "a.gpx"))
    rows = gpx.usable(p).orderBy("seq").collect()
    assert [r.t_ms for r in rows] == [1786179607000, 1786179612500] and rows[0].accel.variance == 0.02 and rows[0].accel.mean_magnitude is None and rows[1].accel is None and rows[1].speed_mps is None
    s = gpx.summary(p).head()
    assert (s.points, s.dropped, s.flavour) == (2, 1, "sensors")
    pts = gpx.usable(p).selectExpr("1L AS device", "seq AS idx", "t_ms", "lat", "lon", "ele")
    seg = spark.createDataFrame([(1, rows[0].seq, rows[1].seq, "walking", False)], "device long, start long, end long, type string, edited boolean")
    doc = gpx.gpx_documents(pts, seg).head().value
    (tmp_path / "b.gpx").write_text(doc)
    assert [(r.lat, r.t_ms) for r in gpx.usable(gpx.read_gpx(spark, str(tmp_path / "b.gpx"))).orderBy("seq").collect()] == [(r.lat, r.t_ms) for r in rows]
    assert segments.LABELS


def test_layers(spark, tmp_path):
    assert layers.parse_name("TN.roads_v2.bin") == ("TN", "roads") and layers.parse_name("readme.md") is None
    assert layers.registry(spark).count() == len(tiles.LAYERS)
    a = spark.createDataFrame([(i, 100 + i % 5, 36.0 + i / 100, -86.0) for i in range(50)], "fid long, cell long, lat double, lon double")
    layers.write_layer(a, str(tmp_path / "t"), files=4)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.filter("cell = 102").count() == 10 and layers.warm(back, [101, 103])[1] == 20
    assert layers.merge_states({"TN": a, "KY": a}).count() == 100
    box = layers.coverage(a)
    q = spark.createDataFrame([(1, 36.1, -86.0), (2, 40.0, -86.0)], "qid long, lat double, lon double")
    assert {r.qid: r.covered for r in layers.covers(q, box).collect()} == {1: True, 2: False}
    s = spark.createDataFrame([(10, 0), (20, 5), (30, 9)], "cell long, entry long")
    c = spark.createDataFrame([(5,), (10,), (25,), (99,)], "cell long")
    assert {r.cell: (r.start, r.end) for r in layers.bracket(s, c, 12).collect()} == {10: (0, 5), 25: (5, 9), 99: (9, 11)}


def test_buildings_and_admin_tables():
    def building(step, vertices, kind, more, extra):
        b = tiles.Builder()
        b.zigzag(step)
        b.number("B", (len(vertices) - 4) << 4 if len(vertices) < 19 else 15 << 4)
        if len(vertices) >= 19:
            b.number("B", len(vertices))
        for k, (x, y) in enumerate(vertices):
            for v in (x, y):
                b.number("h", v) if k == 0 else b.zigzag(v)
        b.number("B", kind)
        b.number("B", more)
        return len(b.out + extra).to_bytes(4, "little") + bytes(b.out) + extra

    head = tiles.Builder()
    head.number("B", 2)
    head.text("B", "house")
    head.text("B", "Café")
    data = bytes(head.out) + building(5, [(1, 2), (3, 0), (0, 3), (-3, 0)], 0, 0x11, bytes([1, 21])) + (3).to_bytes(4, "little") + b"\xff\xff\xff" + building(7, [(0, 0)] + [(1, 1)] * 20, 9, 0, b"later fields")
    a, b = tiles.buildings(data, (-8650000, 3600000))
    assert a == {"osm_id": 5, "coords": [{"lon": -86.49999, "lat": 36.00002}, {"lon": -86.49996, "lat": 36.00002}, {"lon": -86.49996, "lat": 36.00005}, {"lon": -86.49999, "lat": 36.00005}], "building_type": "house", "name": "Café", "category": None, "name_source": None, "poi_osm_id": None, "height_m": 10.5}
    assert b["osm_id"] == 12 and b["building_type"] == "yes" and len(b["coords"]) == 21 and b["height_m"] is None

    t = tiles.Builder()
    for names in (["US"], ["TN", "KY"], [], ["37201"], ["America/Chicago"]):
        t.number("I", len(names))
        for n in names:
            t.text("H", n)
    assert tiles.admin_tables(bytes(t.out))["state"] == ["TN", "KY"]
    g = (1).to_bytes(4, "little") + (77).to_bytes(8, "little") + bytes([0, 1, 0, 0, 0, 0, 0, 5])
    assert tiles.admin_grid(g) == [{"cell": 77, "country": 0, "state": 1, "county": 0, "zip": 0, "timezone": 0, "boundary_flags": 5}]
    p = (1).to_bytes(4, "little") + b"\x01" + (2).to_bytes(2, "little") + b"TN" + (1).to_bytes(4, "little") + (100000).to_bytes(4, "little") * 2
    assert tiles.polygons(p) == [{"name": "TN", "admin_level": 4, "coords": [{"lon": 1.0, "lat": 1.0}]}]
    roads = tiles.encode("roads", [sample("roads", 1)]) + (0).to_bytes(4, "little") + (1).to_bytes(2, "little") + (100000).to_bytes(4, "little") * 2 + b"\x02"
    assert [x["kind"] for x in tiles.intersections(roads)] == ["stop"]


def test_businesses():
    def record(framed, bits, texts, more=b"\0\0"):
        b = tiles.Builder()
        b.zigzag(42)
        for v in (-8650000, 3600000) if framed else (10, -20):
            b.number("i" if framed else "h", v)
        b.text("H", "Café")
        b.number("B", 3)
        b.number("B", bits)
        for size, x in texts:
            b.text(size, x)
        return (len(b.out + more).to_bytes(4, "little") if framed else b"") + bytes(b.out) + more

    v3 = record(True, 1 | 16 | 32, [("B", "555"), ("B", "a@b; ;c@d")], bytes([7, 0, 2, 1, 0]) + b"x" + bytes([90])) + (2).to_bytes(4, "little") + b"\xff\xff" + record(True, 2 | 16, [("B", "web")], b"")
    a, b = tiles.businesses(v3, 3)
    assert a["phone"] == "555" and a["emails"] == ["a@b", "c@d"] and a["operating_status"] == "closed" and (a["source_type"], a["source_id"], a["confidence"]) == (2, "x", 90) and a["lon"] == -86.5
    assert b["operating_status"] == "temporarily_closed" and b["confidence"] is None
    v4 = record(False, 4, [("H", "1 Main")]) + record(False, 0, [])
    x, y = tiles.businesses(v4, 4, (-8650000, 3600000))
    assert x["address"] == "1 Main" and x["operating_status"] == "open" and (x["lon"], x["lat"]) == (-86.4999, 35.9998) and y["osm_id"] == 42
    with pytest.raises(tiles.TileError):
        list(tiles.businesses(v4, 4))
    with pytest.raises(tiles.TileError):
        list(tiles.businesses(v4[:-3], 4, (0, 0)))


@pytest.mark.parametrize("merged", [0, 3])
def test_files_in_a_binary_column(spark, tmp_path, merged):
    """Files encoded in parallel, stored where only Spark reads them, and decoded from the bytes; a null is no file."""
    rows = [(k % 2, k % 5, 10**10 + k, 36 + k / 1000, -87 + k / 1000, "stop", None if k % 3 else k) for k in range(40)]
    t = spark.createDataFrame(rows, "file int, cell long, osm_id long, lat double, lon double, signal_type string, direction int")
    files = tiles.encode_files(t, "signals", merged=merged).cache()
    assert files.count() == 2
    read = lambda f: sorted((r.cell, r.osm_id, r.lat, r.lon, r.signal_type, r.direction is None, r.direction or 0) for r in tiles.decode_files(f, "signals").collect())
    want = sorted((c, o, pytest.approx(a), pytest.approx(b), s, d is None, d or 0) for _, c, o, a, b, s, d in rows)
    assert read(files) == want and read(files.unionByName(spark.createDataFrame([(9, None)], "file int, content binary"))) == want
    for r in files.collect():
        (tmp_path / f"S{r.file}.bin").write_bytes(bytes(r.content))
    assert read(spark.read.format("binaryFile").load(str(tmp_path)).select("content")) == want
    with pytest.raises(tiles.TileError):
        tiles.plan_file(b"no tile file" * 40)
    with pytest.raises(tiles.TileError):
        tiles.schema_of("buildings")
