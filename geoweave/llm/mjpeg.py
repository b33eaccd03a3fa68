r"""Media columns: AVI motion-JPEG written, read back and cut into shots (op1).

Stored form: a RIFF AVI with one 00dc chunk a frame and an idx1 index. A frame is a baseline JPEG of 24 x 24 grey blocks. Each 8 x 8 block
is flat: one 8-bit sample, held as a DC coefficient (quantiser 8 of a transform whose DC is 8 times the mean), so any decoder gives the
sample back exactly, and a payload of 576 bytes a frame is stored losslessly. Every block row is a restart interval: rows are coded
apart, begin at byte borders after RSTn markers, and are encoded and decoded all at once as arrays, sample column by sample column.

Other motion-JPEG files are read too: baseline frames with AC coefficients, colour, subsampling, any restart interval and the standard
Huffman tables where a frame has none, block by block (`decode_image`); `file_clips` makes timed clip rows of a column of AVI files.

Shots: the 16-bin histogram of each decoded frame is compared with the one before; a cut is where the difference exceeds the mean plus
DEVIATIONS standard deviations of the WINDOW differences before it (and FLOOR), so the threshold adapts to the stream.

Edge cases: null text is an empty payload, padded to one frame of bytes 255; texts with bytes 255 at their end are distinguished by
n_bytes; equal texts give equal values; a null doc_id and repeated rows give a row each; an empty table gives no rows; a damaged file
raises ValueError in read_avi; a null or damaged file gives no clips but one row that says why; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, table, texts

SIDE, FRAME, FPS = 24, 576, 25
WINDOW, DEVIATIONS, FLOOR, BINS = 8, 3.0, 0.35, 16
CHUNK_FRAMES = 2048
#: Code lengths of the DC categories 0..11 (luminance table of the JPEG standard, Annex K) and its canonical codes.
DC_BITS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_CATEGORIES = tuple(range(12))


def _canonical(counts) -> list[tuple[int, int]]:
    out, code = [], 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, length))
            code += 1
        code <<= 1
    return out


_CODES = _canonical(DC_BITS)
_CATEGORY = np.array([abs(d).bit_length() for d in range(-255, 256)])
#: For each difference -255..255: the bits of its code, its value and the end-of-block code (one bit, 0), and their number.
_BITS = np.array([((_CODES[c][0] << c | (d if d > 0 else d + (1 << c) - 1)) << 1) if c else _CODES[0][0] << 1 for d, c in zip(range(-255, 256), _CATEGORY.tolist())], np.uint32)
_LENGTHS = np.array([_CODES[c][1] + c + 1 for c in _CATEGORY.tolist()], np.int64)


#: The other tables of Annex K, for frames without tables of their own: code lengths, then values.
DC_CHROMA = (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0)
AC_LUMA = (
    (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125),
    "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a 16 17 18 19 1a 25 26 27 28 29 2a"
    " 34 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a 83 84 85 86 87 88 89 8a"
    " 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da"
    " e1 e2 e3 e4 e5 e6 e7 e8 e9 ea f1 f2 f3 f4 f5 f6 f7 f8 f9 fa",
)
AC_CHROMA = (
    (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119),
    "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1 17 18 19 1a 26 27 28 29 2a"
    " 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a 82 83 84 85 86 87 88 89 8a"
    " 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da"
    " e2 e3 e4 e5 e6 e7 e8 e9 ea f2 f3 f4 f5 f6 f7 f8 f9 fa",
)


def _lookup(codes: list[tuple[int, int]], values) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit prefix: the value coded first, and its code length (0: none)."""
    value, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for (c, n), v in zip(codes, values):
        value[c << 16 - n : (c + 1) << 16 - n], length[c << 16 - n : (c + 1) << 16 - n] = v, n
    return value, length


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_SCAN = _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0]) + bytes([8] * 64))
    + _segment(0xC0, struct.pack(">BHHB", 8, SIDE * 8, SIDE * 8, 1) + bytes([1, 0x11, 0]))
    + _segment(0xC4, bytes([0x00, *DC_BITS, *DC_CATEGORIES]))
    + _segment(0xC4, bytes([0x10, 1, *[0] * 15, 0x00]))
    + _segment(0xDD, struct.pack(">H", SIDE))
    + _SCAN
)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """uint8 (frames, 576) -> one JPEG each."""
    rows = samples.reshape(-1, SIDE).astype(np.int16)
    first = np.diff(rows, axis=1, prepend=np.int16(128)) + 255
    lens, bits = _LENGTHS[first], _BITS[first]
    used = lens.sum(1)
    size = (used + 7) // 8
    base = np.cumsum(size) - size
    # each symbol has at most 18 bits: it lies in four bytes from the one it starts in
    at = np.cumsum(lens, 1) - lens + base[:, None] * 8
    word = bits.astype(np.uint64) << (32 - lens - (at & 7)).astype(np.uint64)
    raw = np.zeros(int(size.sum()) + 8, np.uint8)
    where = at >> 3
    for col in range(SIDE):  # symbols of one column never share a byte, so plain indexed "or" is safe
        w, p = word[:, col], where[:, col]
        for k in range(4):
            raw[p + k] |= ((w >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.uint8)
    pad = (-used) & 7
    raw[base + size - 1] |= ((1 << pad) - 1).astype(np.uint8)
    raw = raw[: int(size.sum())]
    # stuff a zero after each 255, and put a marker after each row: RST0..7 in turn, EOI after a frame's last
    full = np.flatnonzero(raw == 255)
    row_end = base + size
    stuffed_before = np.searchsorted(full, row_end)
    shift = np.zeros(len(raw), np.int64)
    shift[full[full + 1 < len(raw)] + 1] += 1
    inner = row_end[:-1]
    shift[inner] += 2
    place = np.arange(len(raw)) + np.cumsum(shift)
    out = np.zeros(len(raw) + len(full) + 2 * len(size), np.uint8)
    out[place] = raw
    end = row_end + stuffed_before + 2 * np.arange(len(size))
    nth = np.arange(len(size)) % SIDE
    out[end] = 0xFF
    out[end + 1] = np.where(nth == SIDE - 1, 0xD9, 0xD0 + nth % 8)
    data, stops = out.tobytes(), (end[SIDE - 1 :: SIDE] + 2).tolist()
    return [_HEAD + data[a:b] for a, b in zip([0, *stops[:-1]], stops)]


def _tables(head: bytes) -> dict:
    """Parse the markers of one frame up to its scan data."""
    pos, out = 2, {"dc": None, "ac": None}
    if head[:2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    while True:
        if pos + 4 > len(head) or head[pos] != 0xFF:
            raise ValueError("damaged JPEG header")
        marker, size = head[pos + 1], int.from_bytes(head[pos + 2 : pos + 4], "big")
        body = head[pos + 4 : pos + 2 + size]
        pos += 2 + size
        if marker == 0xC0:
            out["shape"] = struct.unpack(">BHHB", body[:6])
        elif marker == 0xDB:
            out["quant"] = body[1]
        elif marker == 0xC4:
            out["ac" if body[0] >> 4 else "dc"] = _lookup(_canonical(body[1:17]), body[17:])
        elif marker == 0xDD:
            out["restart"] = int.from_bytes(body, "big")
        elif marker == 0xDA:
            break
    if out.get("shape", ())[:1] != (8,) or out.get("restart") != (out["shape"][2] + 7) // 8 or out["dc"] is None or out["ac"] is None:
        raise ValueError("not a row-restarted baseline grey frame")
    return out | {"data": pos, "blocks": out["restart"], "rows": (out["shape"][1] + 7) // 8}


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """JPEGs of one kind -> uint8 (frames, samples): all restart intervals of all frames side by side."""
    t = _tables(frames[0])
    head = frames[0][: t["data"]]
    if any(f[: t["data"]] != head or f[-2:] != b"\xff\xd9" for f in frames):
        raise ValueError("frames of different kinds, or cut short")
    data = np.frombuffer(b"".join(f[t["data"] :] for f in frames), np.uint8)
    mark = np.flatnonzero(data[:-1] == 255)
    after = data[mark + 1]
    stops = mark[after != 0]
    if len(stops) != t["rows"] * len(frames):
        raise ValueError("wrong number of restart intervals")
    drop = np.zeros(len(data), bool)
    drop[mark[after == 0] + 1] = True
    drop[stops] = drop[stops + 1] = True
    lost = np.cumsum(drop)
    raw = np.concatenate((data[~drop], np.zeros(8, np.uint8)))
    start = np.concatenate(([0], stops[:-1] + 2))
    begin = start - np.where(start > 0, lost[np.maximum(start - 1, 0)], 0)
    finish = stops - np.where(stops > 0, lost[np.maximum(stops - 1, 0)], 0)
    word = raw[:-7].astype(np.uint64)
    for k in range(1, 5):
        word = word << np.uint64(8) | raw[k : len(raw) - 7 + k]
    at, level = begin * 8, np.full(len(begin), 128, np.int64)
    (dc, dc_len), (ac, ac_len) = t["dc"], t["ac"]
    out = np.empty((len(begin), t["blocks"]), np.uint8)
    scale = t["quant"]
    for col in range(t["blocks"]):
        w = (word[at >> 3] << (at & 7).astype(np.uint64)) & np.uint64((1 << 40) - 1)
        top = (w >> np.uint64(24)).astype(np.int64)
        n, c = dc_len[top], dc[top]
        rest = w.astype(np.int64) & ((np.int64(1) << 40 - n) - 1)
        v = rest >> (40 - n - c)
        v = np.where((c > 0) & (v < (np.int64(1) << np.maximum(c - 1, 0))), v - (np.int64(1) << c) + 1, v)
        level = level + v * scale // 8
        end = (rest & ((np.int64(1) << 40 - n - c) - 1)) >> np.maximum(24 - n - c, 0)
        if (n == 0).any() or (ac_len[end] == 0).any() or (ac[end] != 0).any() or ((level < 0) | (level > 255)).any():
            raise ValueError("damaged scan, or blocks that aren't flat")
        out[:, col] = level
        at = at + n + c + ac_len[end]
    if ((at + 7) // 8 != finish).any():
        raise ValueError("restart interval of a wrong length")
    return out.reshape(len(frames), -1)


#: Places of the 64 coefficients in a block, by the diagonals that alternate in direction.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
_COS = np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _standard_tables() -> dict[int, tuple]:
    of = lambda counts, values: _lookup(_canonical(counts), values)
    return {0x00: of(DC_BITS, DC_CATEGORIES), 0x01: of(DC_CHROMA, DC_CATEGORIES), 0x10: of(AC_LUMA[0], bytes.fromhex(AC_LUMA[1])), 0x11: of(AC_CHROMA[0], bytes.fromhex(AC_CHROMA[1]))}


def decode_image(frame: bytes) -> np.ndarray:
    """A baseline JPEG -> uint8 (height, width, components as stored: Y or Y, Cb, Cr), chroma repeated to full size."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    pos, quant, huff, restart, shape, parts = 2, {}, _standard_tables(), 0, None, []
    while True:
        if pos + 4 > len(frame) or frame[pos] != 0xFF:
            raise ValueError("damaged JPEG header")
        marker, size = frame[pos + 1], int.from_bytes(frame[pos + 2 : pos + 4], "big")
        body = frame[pos + 4 : pos + 2 + size]
        pos += 2 + size
        if marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.float64)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = _lookup(_canonical(body[1:17]), body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            depth, high, wide, n = struct.unpack(">BHHB", body[:6])
            shape, parts = (high, wide), [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if depth != 8:
                raise ValueError("not 8 bits a sample")
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("not a baseline frame")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            if shape is None or body[0] != len(parts):
                raise ValueError("not one scan of all components")
            tables = {body[1 + 2 * i]: (huff[body[2 + 2 * i] >> 4], huff[0x10 | body[2 + 2 * i] & 15]) for i in range(body[0])}
            break
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:  # one component is not interleaved: its units are single blocks
        parts = [(parts[0][0], 1, 1, parts[0][3])]
        most_h = most_v = 1
    across, down = -(-shape[1] // (8 * most_h)), -(-shape[0] // (8 * most_v))
    blocks = [np.zeros((down * v, across * h, 64)) for _, h, v, _ in parts]
    last, unit, total = [0] * len(parts), 0, across * down
    data = np.frombuffer(frame, np.uint8)[pos:]
    mark = np.flatnonzero(data[:-1] == 255)
    stops = mark[data[mark + 1] != 0]
    begin = 0
    for stop in stops.tolist():
        raw = frame[pos + begin : pos + stop].replace(b"\xff\x00", b"\xff") + bytes(8)
        at, end = 0, 8 * (len(raw) - 8)
        until = min(total, unit + (restart or total))
        last = [0] * len(parts)

        def code(table):
            nonlocal at
            w = int.from_bytes(raw[at >> 3 : (at >> 3) + 3], "big") >> (8 - (at & 7)) & 0xFFFF
            n = int(table[1][w])
            if not n or at + n > end:
                raise ValueError("damaged scan")
            at += n
            return int(table[0][w])

        def value(n):
            nonlocal at
            v = int.from_bytes(raw[at >> 3 : (at >> 3) + 4], "big") >> (32 - n - (at & 7)) & (1 << n) - 1 if n else 0
            at += n
            return v if not n or v >> n - 1 else v - (1 << n) + 1

        while unit < until:
            for c, (name, h, v, _) in enumerate(parts):
                dc, ac = tables[name]
                for y in range(v):
                    for x in range(h):
                        block = blocks[c][unit // across * v + y, unit % across * h + x]
                        last[c] += value(code(dc))
                        block[0], k = last[c], 1
                        while k < 64:
                            s = code(ac)
                            if not s & 15:
                                if s != 0xF0:
                                    break
                                k += 16
                                continue
                            k += s >> 4
                            if k > 63:
                                raise ValueError("damaged scan")
                            block[ZIGZAG[k]] = value(s & 15)
                            k += 1
            unit += 1
        begin = stop + 2
        if unit >= total:
            break
    if unit < total:
        raise ValueError("frame cut short")
    planes = []
    for (_, h, v, q), b in zip(parts, blocks):
        table = np.empty(64)
        table[ZIGZAG] = quant[q]
        flat = _COS.T @ (b * table).reshape(*b.shape[:2], 8, 8) @ _COS + 128
        plane = np.clip(np.rint(flat), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(b.shape[0] * 8, b.shape[1] * 8)
        planes.append(plane.repeat(most_v // v, 0).repeat(most_h // h, 1)[: shape[0], : shape[1]])
    return np.stack(planes, axis=2)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    """A payload of whole frames -> an AVI file."""
    n = len(payload) // FRAME
    frames: list[bytes] = []
    for k in range(0, n, CHUNK_FRAMES):
        frames += encode_frames(np.frombuffer(payload[k * FRAME : (k + CHUNK_FRAMES) * FRAME], np.uint8).reshape(-1, FRAME))
    return mux(frames)


def mux(frames: list[bytes]) -> bytes:
    n, side = len(frames), SIDE * 8
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, side, side, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", side * side * 3, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    sizes = np.fromiter(map(len, frames), np.int64, n)
    spans = sizes + (sizes & 1) + 8
    index = np.zeros((n, 4), "<u4")
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1], index[:, 2], index[:, 3] = 0x10, 4 + np.cumsum(spans) - spans, sizes
    movi = b"movi" + b"".join(_chunk(b"00dc", f) for f in frames)
    body = b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", movi) + _chunk(b"idx1", index.tobytes())
    return _chunk(b"RIFF", body)


def read_avi(data: bytes) -> list[bytes]:
    """The frames of an AVI file, by its RIFF index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI " or struct.unpack("<I", data[4:8])[0] + 8 > len(data) + 1:
        raise ValueError("not a whole RIFF AVI file")
    pos, movi, index = 12, None, None
    while pos + 8 <= len(data):
        kind, size = data[pos : pos + 4], struct.unpack("<I", data[pos + 4 : pos + 8])[0]
        if kind == b"LIST" and data[pos + 8 : pos + 12] == b"movi":
            movi = pos + 8
        elif kind == b"idx1":
            index = np.frombuffer(data[pos + 8 : pos + 8 + size], "<u4").reshape(-1, 4)
        pos += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("no movi list or no index")
    frames, base = [], movi
    for kind, _, at, size in index.tolist():
        if struct.pack("<I", kind)[2:] not in (b"dc", b"db"):
            continue  # sound, palettes
        head = struct.pack("<II", kind, size)
        if not frames and data[movi + at : movi + at + 8] != head:
            base = 0  # some writers count from the file's start
        start = base + at
        if data[start : start + 8] != head:
            raise ValueError("the index points to no chunk")
        frames.append(data[start + 8 : start + 8 + size])
    return frames


def frame_seconds(data: bytes) -> float:
    """Seconds a frame, by the main header."""
    at = data.find(b"avih", 0, 4096)
    if at < 0:
        raise ValueError("no main header")
    return struct.unpack("<I", data[at + 8 : at + 12])[0] / 1e6


def samples(frames: list[bytes]) -> np.ndarray:
    return np.concatenate([decode_frames(frames[k : k + CHUNK_FRAMES]) for k in range(0, len(frames), CHUNK_FRAMES)])


def shot_starts(frames: np.ndarray) -> list[int]:
    """The frames at which shots begin, 0 first, by adaptive histogram differences."""
    n = len(frames)
    return _cuts(np.bincount((np.arange(n)[:, None] * BINS + (frames >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS) / max(1, frames.shape[1]))


def _cuts(hist: np.ndarray) -> list[int]:
    n = len(hist)
    if n < 2:
        return [0] * (n > 0)
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    sums, squares = np.concatenate(([0], np.cumsum(diff))), np.concatenate(([0], np.cumsum(diff * diff)))
    i = np.arange(len(diff))
    lo = np.maximum(i - WINDOW, 0)
    count = np.maximum(i - lo, 1)
    mean = (sums[i] - sums[lo]) / count
    spread = np.sqrt(np.maximum((squares[i] - squares[lo]) / count - mean * mean, 0))
    return [0, *(np.flatnonzero((diff > mean + DEVIATIONS * spread) & (diff > FLOOR)) + 1).tolist()]


def clips(docs: DataFrame) -> DataFrame:
    """Timed clip rows of every text's stream: doc_id, clip, start_s, end_s, n_frames."""

    def make():
        def rows(x):
            out = {k: [] for k in ("doc_id", "clip", "start_s", "end_s", "n_frames")}
            for doc, (_, media) in zip(x["doc_id"], stored_forms(x["text"])):
                frames = samples(read_avi(media))
                starts = shot_starts(frames)
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(frames)])):
                    for name, v in zip(out, (doc, k, a / FPS, b / FPS, b - a)):
                        out[name].append(v)
            return out

        return rows

    return map_rows(texts(docs), make, "doc_id long, clip int, start_s double, end_s double, n_frames long")


def file_clips(files: DataFrame, key: str, media: str) -> DataFrame:
    """Timed clip rows of a column of AVI files: the key (as it is), clip, start_s, end_s, n_frames, error. A frame is decoded at a time; its
    luminance is kept as a histogram."""
    kind = dict(files.dtypes)[key]

    def make():
        def rows(x):
            out = {k: [] for k in (key, "clip", "start_s", "end_s", "n_frames", "error")}
            for name, data in zip(x[key], x[media]):
                try:
                    if data is None:
                        raise ValueError("no file")
                    data, hist = bytes(data), []
                    for frame in read_avi(data):
                        luma = decode_image(frame)[:, :, 0]
                        hist.append(np.bincount((luma >> 4).ravel(), minlength=BINS) / luma.size)
                    starts, step = _cuts(np.array(hist)), frame_seconds(data)
                    found = [(name, k, a * step, b * step, b - a, None) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(hist)]))]
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    found = [(name, None, None, None, None, f"{type(e).__name__}: {e}")]
                for row in found:
                    for c, v in zip(out, row):
                        out[c].append(v)
            return out

        return rows

    return map_rows(files.select(key, files[media].cast("binary").alias(media)), make, f"`{key}` {kind}, clip int, start_s double, end_s double, n_frames long, error string")


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + b"\xff" * (FRAME * max(1, -(-len(data) // FRAME)) - len(data))


def stored_forms(many: list[str]) -> list[tuple[int, bytes]]:
    """(bytes of the text, AVI file) of each; frames of many texts are encoded together."""
    pads = [padded(t) for t in many]
    counts = [len(p) // FRAME for _, p in pads]
    joined = b"".join(p for _, p in pads)
    frames: list[bytes] = []
    for k in range(0, sum(counts), CHUNK_FRAMES):
        frames += encode_frames(np.frombuffer(joined[k * FRAME : (k + CHUNK_FRAMES) * FRAME], np.uint8).reshape(-1, FRAME))
    ends = np.cumsum(counts).tolist()
    return [(n, mux(frames[e - c : e])) for (n, _), c, e in zip(pads, counts, ends)]


def media_rows(docs: DataFrame) -> DataFrame:
    """Store each text as AVI, read the stored bytes back, and describe both."""

    def make():
        def rows(x):
            stored = stored_forms(x["text"])
            read = [read_avi(m) for _, m in stored]  # from the stored bytes alone
            counts = [len(f) for f in read]
            every = samples([f for fs in read for f in fs])
            out = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for (n, media), c, e in zip(stored, counts, np.cumsum(counts).tolist()):
                frames = every[e - c : e]
                payload = frames.tobytes()
                starts = shot_starts(frames)
                values = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{c} frames, {len(starts)} shots at {','.join(map(str, starts))}")
                for name, v in zip(out, values):
                    out[name].append(v)
            return out | {"doc_id": x["doc_id"]}

        return rows

    return map_rows(texts(docs), make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_rows(table(spark, sf_dir, "documents"))


QUERIES = {"op1_media": op1_media}
ORACLE: dict[str, str] = {}
