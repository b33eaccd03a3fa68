"""Binary cell-tile layers as a Spark data source: `spark.read.format("celltiles").option("path", p).load()`.

A file has a 256-byte header (magic of seven letters, the last of which names the layer), a Zstandard dictionary, an index of cells and
blocks of records. Each record layout is declared as a list of fields below; one reader and one writer interpret the lists. Planning reads
header and index only, prunes blocks by the pushed cell filter, and makes one input partition per run of blocks.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Fixed values of the format.
HEADER, HEADER_SIZE, V1_ENTRY, V2_ENTRY, DEGREE = "<7sxB3x4fQIQIQIQQI", 256, 19, 38, 100_000
LAYERS = {"R": ("roads", (2,)), "F": ("buildings", (8, 9)), "B": ("business", (3, 4)), "W": ("water", (1,)), "P": ("places", (1,)), "N": ("parks", (1,)), "T": ("rail", (1,)), "H": ("trails", (1,)), "A": ("admin_or_address", (1,)), "X": ("name_index", (1,)), "S": ("signals", (1,)), "C": ("camera", (1,)), "E": ("ev", (1,))}
ENUMS = {
    "road_class": "motorway motorway_link trunk trunk_link primary primary_link secondary tertiary residential service track footway cycleway path pedestrian tertiary_link".split(),
    "road_surface": "paved asphalt concrete unpaved gravel dirt sand grass".split(),
    "water_type": "lake reservoir pond river stream creek canal drain bay ocean wetland marsh swamp estuary".split(),
    "trail_type": "path track bridleway cycleway footway steps trailhead".split(),
    "trail_surface": ["", *"paved asphalt concrete gravel compacted fine_gravel dirt ground grass sand wood boardwalk".split()],
    "sac_scale": ["", *"hiking mountain_hiking demanding_mountain_hiking alpine_hiking demanding_alpine_hiking difficult_alpine_hiking".split()],
    "rail_type": "rail subway light_rail tram monorail narrow_gauge funicular station halt tram_stop subway_entrance".split(),
    "signal_type": "traffic_signals crossing_signals stop give_way railway_signals".split(),
    "device_type": "camera ALPR guard unknown".split(),
    "placement": "public outdoor indoor unknown".split(),
    "camera_type": "fixed panning dome unknown".split(),
    "access": "unknown yes customers permissive private no".split(),
    "oneway": "no forward reverse".split(),
    "bridge_tunnel": ["", "bridge", "tunnel"],
}

#: Record layouts: (column, kind). "flags" is a byte whose set bits announce the optional fields listed after it, in order.
RECORDS = {
    "signals": [("osm_id", "delta"), ("at", "point"), ("signal_type", "enum"), ("flags", [(0x01, "direction", "u16")])],
    "camera": [("osm_id", "delta"), ("at", "point"), ("device_type", "enum"), ("placement", "enum"), ("camera_type", "enum"), ("flags", [(0x01, "direction", "u16"), (0x02, "operator", "str8"), (0x04, "name", "str16"), (0x08, "ref_tag", "str8"), (0x10, "angle", "u8")])],
    "ev": [("osm_id", "delta"), ("at", "point"), ("access", "enum"), ("power_dkw", "u16"), ("capacity", "u8"), ("connector_bits", "u16"), ("flags", [(0x01, "name", "str16"), (0x02, "network", "str8"), (0x04, "ref_tag", "str8")])],
    "parks": [("osm_id", "delta"), ("coords", "line8"), ("park_type", "str8"), ("flags", [(0x01, "name", "str16")])],
    "water": [("osm_id", "delta"), ("geom_type", "u8"), ("coords", "geometry_or_ref"), ("flags", [(0x01, "name", "str16"), (0x02, "width", "u16"), (0x04, "depth", "u16")], ("water_type", "enum"))],
    "rail": [("osm_id", "delta"), ("geom_type", "u8"), ("coords", "geometry"), ("rail_type", "enum"), ("flags", [(0x01, "name", "str16")])],
    "trails": [("osm_id", "delta"), ("geom_type", "u8"), ("coords", "geometry"), ("trail_type", "enum"), ("trail_surface", "enum"), ("sac_scale", "enum"), ("flags", [(0x01, "name", "str16")])],
    "roads": [("osm_id", "step"), ("coords", "line16"), ("flags", [(0x01, "name", "str16"), (0x02, "ref_tag", "str8"), (0x04, "oneway", "enum"), (0x08, "speed_limit_kmh", "u8"), (0x10, "lanes", "u8"), (0x20, "road_surface", "custom"), (0x40, "bridge_tunnel", "enum")], ("road_class", "custom"))],
    "name_index": [("name", "str16"), ("lat_lon", "swapped"), ("uid", "u32"), ("category_idx", "u8"), ("flags", [(0x01, "skip1", "str8"), (0x02, "skip2", "str8"), (0x08, "skip3", "str8")])],
    "address": [("osm_id", "delta"), ("housenumber", "str16"), ("street", "str16")],
    "address_at": [("osm_id", "delta"), ("near", "offset"), ("housenumber", "str16"), ("street", "str16")],
}
#: Layers whose records are preceded by their length: a bad record is skipped; in the others it ends the block.
FRAMED = {"roads", "name_index"}
_INTS = {"u8": "B", "u16": "H", "u32": "I"}
_KINDS = {"delta": "bigint", "step": "bigint", "u8": "int", "u16": "int", "u32": "bigint", "str8": "string", "str16": "string", "enum": "string", "custom": "string"}
_COORDS = "array<struct<lon:double,lat:double>>"


class TileError(ValueError):
    """A file or record that can't be read."""


def _columns(record: list) -> list[tuple[str, str]]:
    out = []
    for name, kind, *then in record:
        if name == "flags":
            out += [(n, _KINDS[k]) for n, k in then] + [(n, _KINDS[k]) for _, n, k in kind if not n.startswith("skip")]
        elif kind in ("point", "swapped", "offset"):
            out += [("lat", "double"), ("lon", "double")]
        elif kind.startswith(("line", "geometry")):
            out += [(name, _COORDS)] + [("ref_feature_id", "bigint")] * (kind == "geometry_or_ref")
        else:
            out.append((name, _KINDS[kind]))
    return out


def schema_of(layer: str) -> str:
    if layer not in RECORDS:
        raise TileError(f"layer {layer!r} has no table of its own; its decoders take a cell's centre")
    return "cell bigint, " + ", ".join(f"{n} {t}" for n, t in _columns(RECORDS[layer]))


class Cursor:
    """Checked reads from a block."""

    def __init__(self, data: bytes, centre: tuple[int, int] = (0, 0)):
        self.data, self.pos, self.centre = data, 0, centre

    def take(self, n: int) -> bytes:
        if self.pos + n > len(self.data):
            raise TileError(f"record cut short at byte {self.pos}")
        self.pos += n
        return self.data[self.pos - n : self.pos]

    def number(self, form: str):
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))[0]

    def varint(self) -> int:
        value = shift = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 127) << shift
            if b < 128:
                return value & (1 << 64) - 1
            shift += 7
            if shift >= 70:
                raise TileError("varint of over ten bytes")

    def zigzag(self) -> int:
        n = self.varint()
        return n >> 1 ^ -(n & 1)

    def text(self, size: str) -> str:
        return self.take(self.number(size)).decode("utf-8", "replace")

    def line(self, n: int) -> list[dict]:
        if not n:
            return []
        x, y = self.number("i"), self.number("i")
        out = [(x, y)]
        for _ in range(n - 1):
            x, y = x + self.zigzag(), y + self.zigzag()
            out.append((x, y))
        return [{"lon": a / DEGREE, "lat": b / DEGREE} for a, b in out]

    def enum(self, name: str, custom: bool = False) -> str:
        i, names = self.number("B"), ENUMS[name]
        if custom and i == 255:
            return self.text("B")
        return names[i] if i < len(names) else "unknown" if custom else f"unknown({i})"

    def field(self, row: dict, name: str, kind: str, last_id: int) -> None:
        if kind in _INTS:
            row[name] = self.number(_INTS[kind])
        elif kind in ("str8", "str16"):
            row[name] = self.text("B" if kind == "str8" else "H")
        elif kind in ("enum", "custom"):
            row[name] = self.enum(name, kind == "custom")
        elif kind in ("delta", "step"):
            value = last_id + (self.zigzag() if kind == "delta" else self.varint()) & (1 << 64) - 1
            row[name] = value - (1 << 64) if value >> 63 else value
        elif kind in ("point", "swapped", "offset"):
            a, b = (self.number("h"), self.number("h")) if kind == "offset" else (self.number("i"), self.number("i"))
            lon, lat = (b, a) if kind == "swapped" else (a + self.centre[0], b + self.centre[1]) if kind == "offset" else (a, b)
            if kind == "point" and not (abs(lat) <= 90 * DEGREE and abs(lon) <= 180 * DEGREE):
                raise TileError("a coordinate off the globe")
            row["lat"], row["lon"] = lat / DEGREE, lon / DEGREE
        else:
            self.geometry(row, name, kind)

    def geometry(self, row: dict, name: str, kind: str) -> None:
        if kind == "geometry_or_ref":
            row["ref_feature_id"] = None
            if row["geom_type"] == 2:
                row[name], row["ref_feature_id"] = [], self.number("I")
                return
        if kind == "geometry" and row["geom_type"] == 1:
            row[name] = self.line(1)
            return
        n = self.number("B") if kind == "line8" else self.number("H")
        row[name] = self.line(self.number("H") if kind == "line8" and n == 255 else n)


def _record(c: Cursor, record: list, last_id: int) -> dict:
    row: dict = {}
    for name, kind, *then in record:
        if name != "flags":
            c.field(row, name, kind, last_id)
            continue
        bits = c.number("B")
        for n, k in then:
            c.field(row, n, k, last_id)
        for bit, n, k in kind:
            row[n] = None
            if bits & bit:
                c.field(row, n, k, last_id)
    return row


def decode(layer: str, data: bytes, centre: tuple[int, int] = (0, 0)) -> Iterator[dict]:
    """The records of one cell."""
    record, last, c = RECORDS[layer], 0, Cursor(data, centre)
    while c.pos < len(data):
        inner = c
        if layer in FRAMED:
            if c.pos + 4 > len(data) or (n := c.number("I")) == 0:
                return
            inner = Cursor(c.take(n))
        try:
            row = _record(inner, record, last)
        except TileError:
            if layer in FRAMED:
                continue
            return
        last = row.get("osm_id", 0)
        yield row


def buildings(data: bytes, centre: tuple[int, int]) -> Iterator[dict]:
    """Building records of one cell, given its centre (lon, lat in hundred-thousandths of a degree), from which the first vertex counts.

    A table of strings comes first; a record's type, name, category and source refer to it, or spell themselves out after 255. Heights are
    half metres in a byte. Fields of later versions behind them are skipped with the record."""
    c = Cursor(data)
    table = [c.text("B") for _ in range(c.number("B"))]

    def name(r: Cursor, missing: str) -> str:
        i = r.number("B")
        return r.text("B") if i == 255 else table[i] if i < len(table) else missing

    last = 0
    while c.pos + 4 <= len(data) and (n := c.number("I")):
        r = Cursor(c.take(n))
        try:
            row = {"osm_id": last + r.zigzag()}
            packed = r.number("B") >> 4
            count = r.number("B") if packed == 15 else packed + 4
            coords, x, y = [], centre[0], centre[1]
            for k in range(count):
                dx, dy = (r.number("h"), r.number("h")) if k == 0 else (r.zigzag(), r.zigzag())
                x, y = x + dx, y + dy
                coords.append({"lon": x / DEGREE, "lat": y / DEGREE})
            row |= {"coords": coords, "building_type": name(r, "yes")}
            more = r.number("B")
            for bit, field in ((1, "name"), (2, "category"), (4, "name_source")):
                row[field] = (name(r, "") or None) if more & bit else None
            row["poi_osm_id"] = r.number("Q") if more & 8 else None
            row["height_m"] = r.number("B") / 2 if more & 16 and r.pos < n else None
        except TileError:
            continue
        last = row["osm_id"]
        yield row


def _business(r: Cursor, framed: bool) -> dict:
    row = {"osm_id": r.zigzag()}
    r.field(row, "at", "point" if framed else "offset", 0)
    row |= {"name": r.text("H"), "category_idx": r.number("B")}
    bits = r.number("B")
    listed = {"emails": 32, "socials": 64} if framed else {}
    for bit, field, size in ((1, "phone", "B"), (2, "website", "B"), (4, "address", "H"), (8, "brand", "B"), *((b, f, "B") for f, b in listed.items())):
        row[field] = r.text(size) if bits & bit else None
    for field in ("emails", "socials"):
        row[field] = [x.strip() for x in (row.get(field) or "").split(";") if x.strip()]
    if bits & 128:
        r.take(1)
    closed = framed and bits & 16
    row["operating_status"] = ("temporarily_closed" if bits & 2 else "closed") if closed else "open"
    more = r.number("H") if r.pos + 2 <= len(r.data) else 0
    row["source_type"] = r.number("B") if more & 1 else None
    row["source_id"] = r.text("H") if more & 2 else None
    row["confidence"] = r.number("B") if more & 4 else None
    return row


def businesses(data: bytes, version: int, centre: tuple[int, int] | None = None) -> Iterator[dict]:
    """Business records of one cell: version 3 with framed records and own coordinates, version 4 without frames and relative to the
    centre of the cell (lon, lat in hundred-thousandths of a degree), which is needed then."""
    if version >= 4:
        if centre is None:
            raise TileError("version 4 needs the cell's centre")
        c = Cursor(data, centre)
        while c.pos < len(data):
            yield _business(c, False)
        return
    c = Cursor(data)
    while c.pos + 4 <= len(data) and (n := c.number("I")):
        record = Cursor(c.take(n))
        try:
            yield _business(record, True)
        except TileError:  # a bad record is skipped
            continue


def intersections(data: bytes) -> Iterator[dict]:
    """The table after the road records of a block: lon, lat, type."""
    c = Cursor(data)
    while c.pos + 4 <= len(data) and (n := c.number("I")):
        c.take(n)
    if c.pos + 2 <= len(data):
        for _ in range(c.number("H")):
            if c.pos + 9 > len(data):
                return
            x, y, kind = struct.unpack("<iiB", c.take(9))
            yield {"lon": x / DEGREE, "lat": y / DEGREE, "intersection_type": kind, "kind": {1: "traffic_signals", 2: "stop", 3: "give_way", 4: "roundabout"}.get(kind, "junction")}


def admin_tables(data: bytes) -> dict[str, list[str]]:
    """Five dictionaries of names: country, state, county, zip, timezone."""
    c = Cursor(data)
    return {t: [c.text("H") for _ in range(c.number("I"))] for t in ("country", "state", "county", "zip", "timezone")}


def admin_grid(data: bytes) -> list[dict]:
    """Cells with an index into each dictionary and the bits of the borders that cross them."""
    c = Cursor(data)
    names = ("cell", "country", "state", "county", "zip", "timezone", "boundary_flags")
    return [dict(zip(names, struct.unpack("<QBBHHBB", c.take(16)))) for _ in range(c.number("I"))]


@dataclass(frozen=True)
class Entry:
    cell: int
    offset: int
    length: int
    count: int


@dataclass(frozen=True)
class Layout:
    """What planning knows of a file: header fields, entries in cell order with absolute offsets, dictionary."""

    path: str
    layer: str
    version: int
    bbox: tuple[float, float, float, float]
    features: int
    merged: bool
    entries: tuple[Entry, ...]
    dictionary: bytes
    entry_source: str
    offset_base: str


def entries_of(data: bytes, size: int) -> list[Entry]:
    out = []
    for k in range(int.from_bytes(data[:4], "little")):
        e = data[4 + k * size : 4 + (k + 1) * size]
        n = lambda a, b: int.from_bytes(e[a:b], "little")  # noqa: B023, E731
        out.append(Entry(n(0, 8), n(8, 14), n(14, 17), n(17, 19)) if size == V1_ENTRY else Entry(n(0, 8), n(24, 30) | e[32] << 48, n(30, 32) | e[33] << 16, n(34, 36)))
    return out


def index_width(data: bytes, declared: int) -> tuple[int, str]:
    """The width of index entries: what the header's length says if the entries look sound so, else the first known width that does."""
    count = int.from_bytes(data[:4], "little")
    if not count:
        return V1_ENTRY, "declared"

    def sound(size: int) -> bool:
        if len(data) < 4 + count * size:
            return False
        e = entries_of(data, size)
        return e[0].length > 0 and 4 * sum(b.cell < a.cell for a, b in zip(e, e[1:])) <= count

    stride, odd = divmod(max(0, declared - 4), count)
    if not odd and stride in (V1_ENTRY, V2_ENTRY) and sound(stride):
        return stride, "declared"
    for size in (V1_ENTRY, V2_ENTRY):
        if sound(size):
            return size, "probed"
    raise TileError("no known index width fits")


def read_at(source: str | bytes, offset: int, size: int) -> bytes:
    """A region of a file, by its path or its bytes."""
    if isinstance(source, bytes):
        if offset + size > len(source):
            raise TileError("a region reaches beyond the file")
        return source[offset : offset + size]
    with open(source, "rb") as f:
        if offset + size > os.fstat(f.fileno()).st_size:
            raise TileError("a region reaches beyond the file")
        f.seek(offset)
        return f.read(size)


def plan_file(source: str | bytes) -> Layout:
    total = len(source) if isinstance(source, bytes) else os.path.getsize(source)
    head = read_at(source, 0, HEADER_SIZE)
    magic, version, a, b, c, d, features, _, dict_at, dict_len, index_at, index_len, blocks_at, _, _ = struct.unpack(HEADER, head[: struct.calcsize(HEADER)])
    letter = magic[-1:].decode("latin-1")
    if letter not in LAYERS or not magic.isalpha() or version not in LAYERS[letter][1]:
        raise TileError(f"unsupported file kind {magic!r} version {version}")
    layer = LAYERS[letter][0]
    count = int.from_bytes(read_at(source, index_at, 4), "little")
    data = read_at(source, index_at, min(total - index_at, 4 + count * V2_ENTRY))
    size, found = index_width(data, index_len)
    raw, real = entries_of(data, size), index_at + 4 + count * size
    shift, base = 0, "absolute"
    if raw and raw[0].offset < blocks_at:
        shift, base = blocks_at, "relative"
    elif blocks_at > real:
        shift, base = real - blocks_at, "absolute_corrected"
    entries = tuple(sorted((Entry(e.cell, e.offset + shift, e.length, e.count) for e in raw), key=lambda e: e.cell))
    if layer == "admin_or_address":
        layer = "address"
    path = "" if isinstance(source, bytes) else source
    return Layout(path, layer, version, (a, b, c, d), features, size == V2_ENTRY, entries, read_at(source, dict_at, dict_len) if dict_len else b"", found, base)


def unpack_block(raw: bytes, dictionary: bytes) -> bytes:
    """One Zstandard frame, with the layer's dictionary or, failing that, without."""
    if dictionary:
        try:
            return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompressobj().decompress(raw)
        except zstandard.ZstdError:
            pass
    try:
        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    except zstandard.ZstdError as e:
        raise TileError(f"damaged block: {e}") from e


def polygons(data: bytes) -> list[dict]:
    """State outlines: name, admin_level (4), coords."""
    c, out = Cursor(data), []
    for _ in range(c.number("I")):
        c.take(1)
        name = c.text("H")
        points = [struct.unpack("<ii", c.take(8)) for _ in range(c.number("I"))]
        out.append({"name": name, "admin_level": 4, "coords": [{"lon": x / DEGREE, "lat": y / DEGREE} for x, y in points]})
    return out


def cell_slices(block: bytes) -> Iterator[tuple[int, bytes]]:
    """The cells of a merged block and their records."""
    n = struct.unpack_from("<I", block, 8)[0]
    start = 12 + 12 * n
    if len(block) < start:
        raise TileError("cell table cut short")
    table = [struct.unpack_from("<QI", block, 12 + 12 * k) for k in range(n)]
    for (cell, a), b in zip(table, [*(x for _, x in table[1:]), len(block) - start]):
        if not a <= b <= len(block) - start:
            raise TileError("cell table points outside its block")
        yield cell, block[start + a : start + b]


def block_rows(source: str | bytes, plan: Layout, entry: Entry, layer: str | None = None) -> Iterator[tuple[int, dict]]:
    """(cell, record) of one block."""
    block = unpack_block(read_at(source, entry.offset, entry.length), plan.dictionary)
    centre = struct.unpack_from("<ii", block) if plan.merged else (0, 0)
    for cell, data in cell_slices(block) if plan.merged else ((entry.cell, block),):
        for row in decode(layer or plan.layer, data, centre):
            yield cell, row


def decode_files(files: DataFrame, layer: str, content: str = "content") -> DataFrame:
    """The records of whole files in a BINARY column, each file by its own header: with Spark's `binaryFile` reader, files of any store
    that Spark reaches. A null is no file."""
    schema = schema_of(layer)
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    names = arrow.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                if data is None:
                    continue
                plan = plan_file(bytes(data))
                rows = [{"cell": cell} | row for e in {e.offset: e for e in plan.entries}.values() for cell, row in block_rows(bytes(data), plan, e, layer)]
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=arrow)

    return files.select(content).mapInArrow(run, schema)


class TilePartition(InputPartition):
    def __init__(self, plan: Layout, entries: tuple[Entry, ...]):
        self.plan, self.entries = plan, entries


class TileReader(DataSourceReader):
    """Reads blocks of one layer. Equality and IN filters on the cell prune blocks at planning."""

    def __init__(self, options: dict, names: list[str]):
        self.paths = sorted(p for part in options["path"].split(",") for p in glob.glob(part))
        self.layer, self.names, self.cells = options.get("layer"), names, None
        self.blocks = int(options.get("blocksperpartition", 256))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) and f.attribute == ("cell",) else set(f.value) if isinstance(f, In) and f.attribute == ("cell",) else None
            if wanted is not None:
                self.cells = wanted if self.cells is None else self.cells & wanted
            yield f  # a merged block holds other cells too, so Spark filters again

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            plan = plan_file(path)
            keep = tuple(e for e in plan.entries if self.cells is None or e.cell in self.cells)
            seen: dict[int, Entry] = {e.offset: e for e in keep}  # cells of a merged block share it
            blocks = tuple(seen.values())
            light = Layout(**{**plan.__dict__, "entries": ()})
            out += [TilePartition(light, blocks[k : k + self.blocks]) for k in range(0, len(blocks), self.blocks)]
        return out

    def read(self, part: TilePartition | None) -> Iterator[tuple]:
        if part is None:  # every block was pruned
            return
        plan = part.plan
        for e in part.entries:
            for cell, row in block_rows(plan.path, plan, e, self.layer):
                yield tuple(cell if n == "cell" else row.get(n) for n in self.names)


class TileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "celltiles"

    def _layer(self) -> str:
        if "layer" in self.options:
            return self.options["layer"]
        first = sorted(p for part in self.options["path"].split(",") for p in glob.glob(part))
        if not first:
            raise TileError("no file matches the path")
        return plan_file(first[0]).layer

    def schema(self) -> str:
        return schema_of(self._layer())

    def reader(self, schema) -> DataSourceReader:
        return TileReader(dict(self.options), schema.fieldNames())


def register(spark) -> None:
    """Make the format known to a session, and let Spark push cell filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TileSource)


# Writing, for round trips.


class Builder:
    def __init__(self):
        self.out = bytearray()

    def number(self, form: str, x) -> None:
        self.out += struct.pack("<" + form, x)

    def varint(self, n: int) -> None:
        n &= (1 << 64) - 1
        while n > 127:
            self.out.append(n & 127 | 128)
            n >>= 7
        self.out.append(n)

    def zigzag(self, n: int) -> None:
        self.varint(n << 1 ^ n >> 63)

    def text(self, form: str, s: str) -> None:
        self.number(form, len(s.encode()))
        self.out += s.encode()

    def line(self, coords: list[dict]) -> None:
        points = [(round(p["lon"] * DEGREE), round(p["lat"] * DEGREE)) for p in coords]
        if points:
            self.number("i", points[0][0])
            self.number("i", points[0][1])
        for (a, b), (x, y) in zip(points, points[1:]):
            self.zigzag(x - a)
            self.zigzag(y - b)

    def field(self, row: dict, name: str, kind: str, last_id: int, centre=(0, 0)) -> None:
        v = row.get(name)
        if kind in _INTS:
            self.number(_INTS[kind], v)
        elif kind in ("str8", "str16"):
            self.text("B" if kind == "str8" else "H", v)
        elif kind in ("enum", "custom"):
            if v in ENUMS[name]:
                self.number("B", ENUMS[name].index(v))
            else:
                self.number("B", 255)
                self.text("B", v)
        elif kind == "delta":
            self.zigzag(v - last_id)
        elif kind == "step":
            self.varint(v - last_id)
        elif kind in ("point", "swapped", "offset"):
            x, y = round(row["lon"] * DEGREE) - (centre[0] if kind == "offset" else 0), round(row["lat"] * DEGREE) - (centre[1] if kind == "offset" else 0)
            for n in (y, x) if kind == "swapped" else (x, y):
                self.number("h" if kind == "offset" else "i", n)
        elif kind == "geometry_or_ref" and row["geom_type"] == 2:
            self.number("I", row["ref_feature_id"])
        else:
            if kind == "line8" and len(v) < 255:
                self.number("B", len(v))
            elif not (kind == "geometry" and row["geom_type"] == 1):
                if kind == "line8":
                    self.number("B", 255)
                self.number("H", len(v))
            self.line(v)


def encode(layer: str, rows: list[dict], centre: tuple[int, int] = (0, 0)) -> bytes:
    """Records of one cell, the inverse of decode()."""
    out, last = bytearray(), 0
    for row in rows:
        b = Builder()
        for name, kind, *then in RECORDS[layer]:
            if name != "flags":
                b.field(row, name, kind, last, centre)
                continue
            b.number("B", sum(bit for bit, n, _ in kind if row.get(n) is not None))
            for n, k in then:
                b.field(row, n, k, last)
            for _, n, k in kind:
                if row.get(n) is not None:
                    b.field(row, n, k, last)
        if layer in FRAMED:
            out += struct.pack("<I", len(b.out))
        out += b.out
        last = row.get("osm_id", 0)
    return bytes(out)


def file_bytes(letter: str, version: int, cells: dict[int, bytes], merged: int = 0, dictionary: bytes = b"", prefix: bytes = b"CELLTL", base: str = "absolute") -> bytes:
    """A file of one layer. merged: cells a block (0: one block a cell, narrow index)."""
    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).compress if dictionary else zstandard.ZstdCompressor().compress
    ids = sorted(cells)
    blocks = []
    for group in [ids[k : k + merged] for k in range(0, len(ids), merged)] if merged else [[i] for i in ids]:
        at, table = 0, b""
        for i in group:
            table += struct.pack("<QI", i, at)
            at += len(cells[i])
        body = b"".join(cells[i] for i in group)
        blocks.append((group, pack(struct.pack("<iiI", 0, 0, len(group)) + table + body if merged else body)))
    width = V2_ENTRY if merged else V1_ENTRY
    index_at = HEADER_SIZE + len(dictionary)
    blocks_at = index_at + 4 + len(ids) * width
    index, at = struct.pack("<I", len(ids)), 0 if base == "relative" else blocks_at
    for group, blob in blocks:
        for i in group:
            off, n = at.to_bytes(8, "little"), len(blob).to_bytes(4, "little")
            index += struct.pack("<Q", i) + (bytes(16) + off[:6] + n[:2] + off[6:7] + n[2:3] + struct.pack("<HH", 1, 0) if merged else off[:6] + n[:3] + struct.pack("<H", 1))
        at += len(blob)
    head = struct.pack(HEADER, prefix + letter.encode(), version, -90, -180, 90, 180, 0, len(blocks), HEADER_SIZE, len(dictionary), index_at, len(index), blocks_at, 0, 0)
    return head.ljust(HEADER_SIZE, b"\0") + dictionary + index + b"".join(b for _, b in blocks)


def write_file(path: str, letter: str, version: int, cells: dict[int, bytes], merged: int = 0, dictionary: bytes = b"", **more) -> None:
    with open(path, "wb") as f:
        f.write(file_bytes(letter, version, cells, merged, dictionary, **more))


def encode_files(features: DataFrame, layer: str, by: str = "file", merged: int = 0) -> DataFrame:
    """Features with the layer's columns, `cell` and `by` -> one file a value of `by`, as rows (by, content)."""
    letter, version = next((k, v[0]) for k, (name, v) in LAYERS.items() if name == layer or name == "admin_or_address" and layer == "address")

    def run(table: pa.Table) -> pa.Table:
        cells: dict[int, list[dict]] = {}
        for row in table.to_pylist():
            cells.setdefault(row["cell"], []).append(row)
        ordered = {c: encode(layer, sorted(rows, key=lambda r: r.get("osm_id") or 0)) for c, rows in cells.items()}
        return pa.table({by: table.column(by)[:1], "content": pa.array([file_bytes(letter, version, ordered, merged)], pa.binary())})

    kind = dict(features.dtypes)[by]
    return features.groupBy(by).applyInArrow(run, f"{by} {kind}, content binary")
