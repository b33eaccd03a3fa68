import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoweave.llm import bpe, extract, license_scan, mixing, mjpeg, registry, toxicity, warc


def key(r):
    return tuple((x is None, x) for x in r)


# op1


@pytest.mark.parametrize("payload", [b"\xff" * 576, bytes(576), bytes(range(256)) * 9, b"\x00\xff" * 576, os.urandom(576 * 70)])
def test_avi_round_trip(payload):
    media = mjpeg.write_avi(payload)
    frames = mjpeg.read_avi(media)
    assert len(frames) == len(payload) // 576 and mjpeg.samples(frames).tobytes() == payload


def test_avi_damage_is_seen():
    media = bytearray(mjpeg.write_avi(os.urandom(576 * 3)))
    with pytest.raises(ValueError):
        mjpeg.samples(mjpeg.read_avi(bytes(media[:-40])))
    at = media.index(b"\xff\xd9")
    media[at - 3] ^= 0x55
    with pytest.raises(ValueError):
        got = mjpeg.samples(mjpeg.read_avi(bytes(media)))
        if got.tobytes() != b"":
            raise ValueError("decoded to other samples")


def test_jpeg_frame_is_flat_blocks_by_slow_decoding():
    """Decode one frame bit by bit, as the standard says."""
    payload = bytes((i * 37) % 256 for i in range(576))
    frame = mjpeg.encode_frames(np.frombuffer(payload, np.uint8).reshape(1, -1))[0]
    data = frame[len(mjpeg._HEAD) :]
    codes = {(n, c): v for (c, n), v in zip(mjpeg._canonical(mjpeg.DC_BITS), mjpeg.DC_CATEGORIES)}
    out = []
    for row in re.split(rb"\xff[\xd0-\xd7\xd9]", data)[:-1]:
        bits = "".join(f"{b:08b}" for b in row.replace(b"\xff\x00", b"\xff"))
        pos, level = 0, 128
        for _ in range(24):
            n = next(n for n in range(1, 17) if (n, int(bits[pos : pos + n], 2)) in codes)
            c = codes[n, int(bits[pos : pos + n], 2)]
            pos += n
            v = int(bits[pos : pos + c] or "0", 2)
            level += (v if not c or v >= 1 << (c - 1) else v - (1 << c) + 1)
            pos += c
            assert bits[pos] == "0"
            pos += 1
            out.append(level)
        assert set(bits[pos:]) <= {"1"} and len(bits) - pos < 8
    assert bytes(out) == payload


class SlowJpeg:
    """A plain baseline encoder: colour, subsampling, AC coefficients, optional restarts, tables of the standard."""

    def __init__(self, planes, factors, restart=0, tables=True):
        dct = np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
        zigzag = [y * 8 + x for s in range(15) for y, x in sorted(((y, s - y) for y in range(8) if 0 <= s - y < 8), reverse=s % 2 == 0)]
        kinds = [(mjpeg.DC_BITS, bytes(range(12)), *mjpeg.AC_LUMA), (mjpeg.DC_CHROMA, bytes(range(12)), *mjpeg.AC_CHROMA)]
        codes = [[{v: f"{c:0{n}b}" for (c, n), v in zip(mjpeg._canonical(bits), vals if isinstance(vals, bytes) else bytes.fromhex(vals))} for bits, vals in ((k[0], k[1]), (k[2], k[3]))] for k in kinds]
        high, wide = planes[0].shape
        mh, mv = max(f[0] for f in factors), max(f[1] for f in factors)
        across, down = -(-wide // (8 * mh)), -(-high // (8 * mv))
        small = [p[:: mv // v, :: mh // h] for p, (h, v) in zip(planes, factors)]
        small = [np.pad(p, ((0, down * v * 8 - p.shape[0]), (0, across * h * 8 - p.shape[1])), mode="edge").astype(float) for p, (h, v) in zip(small, factors)]
        number = lambda v: "" if v == 0 else f"{v if v > 0 else v + (1 << abs(v).bit_length()) - 1:0{abs(v).bit_length()}b}"
        self.seen = [np.zeros_like(p) for p in small]  # what a decoder should get
        out, bits, last, nth = b"", "", [0] * len(planes), 0

        def flush(bits):
            bits += "1" * (-len(bits) % 8)
            return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

        for unit in range(across * down):
            if restart and unit and unit % restart == 0:
                out, bits, last, nth = out + flush(bits) + bytes([0xFF, 0xD0 + nth % 8]), "", [0] * len(planes), nth + 1
            for c, (h, v) in enumerate(factors):
                for y in range(v):
                    for x in range(h):
                        r, q = (unit // across * v + y) * 8, (unit % across * h + x) * 8
                        block = small[c][r : r + 8, q : q + 8] - 128
                        coef = np.rint(dct @ block @ dct.T / 6).astype(int)
                        self.seen[c][r : r + 8, q : q + 8] = np.clip(np.rint(dct.T @ (coef * 6.0) @ dct + 128), 0, 255)
                        z = coef.ravel()[zigzag].tolist()
                        dc, ac = codes[min(c, 1)]
                        d = z[0] - last[c]
                        last[c] = z[0]
                        bits += dc[abs(d).bit_length()] + number(d)
                        run = 0
                        end = max((i for i in range(1, 64) if z[i]), default=0)
                        for value in z[1 : end + 1]:
                            if value == 0:
                                run += 1
                                continue
                            while run > 15:
                                bits, run = bits + ac[0xF0], run - 16
                            bits += ac[run << 4 | abs(value).bit_length()] + number(value)
                            run = 0
                        if end < 63:
                            bits += ac[0]
        head = b"\xff\xd8" + mjpeg._segment(0xDB, bytes([0]) + bytes([6] * 64))
        n = len(planes)
        head += mjpeg._segment(0xC0, bytes([8]) + high.to_bytes(2, "big") + wide.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(factors)))
        if tables:
            for i, k in enumerate(kinds[: min(n, 2)]):
                head += mjpeg._segment(0xC4, bytes([i, *k[0]]) + k[1]) + mjpeg._segment(0xC4, bytes([0x10 | i, *k[2]]) + bytes.fromhex(k[3]))
        if restart:
            head += mjpeg._segment(0xDD, restart.to_bytes(2, "big"))
        self.data = head + mjpeg._segment(0xDA, bytes([n]) + b"".join(bytes([c + 1, 0x11 * min(c, 1)]) for c in range(n)) + bytes([0, 63, 0])) + out + flush(bits) + b"\xff\xd9"
        self.seen = [p.repeat(mv // v, 0).repeat(mh // h, 1)[:high, :wide] for p, (h, v) in zip(self.seen, factors)]


@pytest.mark.parametrize("factors, restart, tables", [([(1, 1)], 0, True), ([(1, 1)], 3, False), ([(2, 2), (1, 1), (1, 1)], 0, False), ([(2, 1), (1, 1), (1, 1)], 2, True), ([(1, 1)] * 3, 0, True)])
def test_ordinary_baseline_frames(factors, restart, tables):
    rng = np.random.default_rng(len(factors) + restart)
    planes = [np.clip(np.add.outer(np.arange(37) * 3, np.arange(51) * 2) % 256 + rng.normal(0, 25, (37, 51)), 0, 255) for _ in factors]
    made = SlowJpeg(planes, factors, restart, tables)
    got = mjpeg.decode_image(made.data)
    assert got.shape == (37, 51, len(factors))
    for c, want in enumerate(made.seen):
        assert np.abs(got[:, :, c].astype(int) - want).max() <= 1
    with pytest.raises(ValueError):
        mjpeg.decode_image(made.data[: len(made.data) // 2])
    with pytest.raises(ValueError):
        mjpeg.decode_image(made.data.replace(b"\xff\xc0", b"\xff\xc2", 1))


def test_clips_of_ordinary_files(spark):
    frames = []
    for level in [60] * 12 + [190] * 9:
        frames.append(SlowJpeg([np.add.outer(np.arange(16), np.arange(24)) + level, np.full((16, 24), 90), np.full((16, 24), 140)], [(2, 2), (1, 1), (1, 1)]).data)
    t = spark.createDataFrame([("a", bytearray(mjpeg.mux(frames)), 1), ("b", None, 2), ("c", bytearray(b"RIFF"), 3)], "name string, media binary, clip int")
    got = sorted(((r.name, r.clip, r.start_s, r.end_s, r.n_frames, r.error is None) for r in mjpeg.file_clips(t, "name", "media").collect()), key=key)
    assert got == [("a", 0, 0.0, pytest.approx(0.48), 12, True), ("a", 1, pytest.approx(0.48), pytest.approx(0.84), 9, True), ("b", None, None, None, None, False), ("c", None, None, None, None, False)]


def slow_shots(frames):
    hists = [Counter((f >> 4).tolist()) for f in frames]
    diff = [sum(abs(a[k] - b[k]) for k in range(16)) / (2 * len(frames[0])) for a, b in zip(hists, hists[1:])]
    out = [0] if len(frames) else []
    for i, d in enumerate(diff):
        past = diff[max(0, i - 8) : i] or [0.0]
        mean = sum(past) / len(past)
        if d > mean + 3 * max(0.0, sum(x * x for x in past) / len(past) - mean * mean) ** 0.5 + 1e-9 and d > 0.35:
            out.append(i + 1)
    return out


def test_shots_match_slow_detection():
    rng = np.random.default_rng(9)
    frames = np.concatenate([np.clip(rng.normal(m, 12, (n, 576)), 0, 255).astype(np.uint8) for m, n in ((30, 20), (120, 1), (125, 15), (220, 9), (90, 30), (100, 30))])
    assert mjpeg.shot_starts(frames) == slow_shots(frames) and len(slow_shots(frames)) >= 4


def test_media_rows(docs, empty, edge_texts):
    got = sorted((tuple(r) for r in mjpeg.media_rows(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256").collect()), key=key)
    want = []
    for i, t in edge_texts:
        n, p = mjpeg.padded(t)
        m = mjpeg.write_avi(p)
        want.append((i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest()))
    assert got == sorted(want, key=key)
    assert mjpeg.media_rows(empty).count() == 0


def test_clips(docs):
    rows = mjpeg.clips(docs).filter("doc_id = 11").orderBy("clip").collect()
    assert rows[0].start_s == 0 and sum(r.n_frames for r in rows) == -(-70000 // 576)
    assert all(a.end_s == b.start_s for a, b in zip(rows, rows[1:]))


def test_shots_at_a_hard_cut():
    frames = np.concatenate((np.full((40, 576), 10, np.uint8), np.full((40, 576), 200, np.uint8)))
    assert mjpeg.shot_starts(frames) == [0, 40]
    assert mjpeg.shot_starts(frames[:0]) == [] and mjpeg.shot_starts(frames[:1]) == [0]


# op2


def slow_scan(text, idf):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    stands = lambda at, phrase: at >= 0 and words[at : at + len(phrase)] == phrase
    hits = []
    for t, (label, notice, keys) in enumerate(license_scan.TEMPLATES):
        n, offs = notice.split(), license_scan.key_places(notice, keys)
        for s in range(len(words)):
            if all(stands(s - offs[0] + o, k.split()) for o, k in zip(offs, keys)):
                share = sum(idf[w] for j, w in enumerate(n) if 0 <= s - offs[0] + j < len(words) and words[s - offs[0] + j] == w) / sum(idf[w] for w in n)
                hits.append((s, label, t, share))
    base = [s for s, _, t, _ in hits if t < 3]
    return len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted({x for _, x, t, _ in hits if t < 3})), ",".join(sorted({x for _, x, _, _ in hits})), max((h[3] for h in hits), default=0.0)


def test_license_scan(docs, empty, make, edge_texts):
    mit = license_scan.TEMPLATES[10][1]
    more = [(50, "mit mit license license MIT LICENSE, Apache-License version 2.0"), (51, "the GNU General Public License, version 3; gnu lesser general public license"), (52, "committed licenses apache licenses"), (53, "Redistribution and use in source and binary forms"), (54, "éMIT license mit licenseé mitKicense")]
    more += [(55, "The MIT License\n\nCopyright (c) somebody\n\n" + mit.upper() + "."), (56, mit.replace("without restriction", "with restriction")), (57, " ".join(mit.split()[3:])), (58, mit.replace("furnished", "").replace("associated", "other")), (59, "license " * 300 + "mit " * 300 + "license")]
    more += [(60 + t, text) for t, (_, text, _) in enumerate(license_scan.TEMPLATES)] + [(90, "Released under the MIT License. Licensed under the Apache License, Version 2.0.")]
    for table, texts in ((docs, edge_texts), (make(more), more)):
        got = sorted((tuple(r) for r in license_scan.scan(table).collect()), key=key)
        idf = license_scan.word_idf(table)
        want = sorted(((i, *slow_scan(t, idf)) for i, t in texts), key=key)
        assert [r[:7] for r in got] == [r[:7] for r in want]
        assert [r[7] for r in got] == pytest.approx([r[7] for r in want], abs=2e-6)
    scores = {r[0]: r[7] for r in got}
    assert scores[53] == scores[57] == 0 and 0 < scores[50] < 1 and 0 < scores[58] < 1 and scores[70] == 1
    assert license_scan.scan(empty).count() == 0


def test_sql_twins_give_the_same_rows(spark):
    """The SQL of every operator that has one, on whole tables, in DuckDB."""
    import duckdb

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in registry.ORACLE.items():
        frame = registry.QUERIES[name](spark, sf)
        columns = sorted(frame.columns)
        got = sorted((tuple(r) for r in frame.select(*columns).collect()), key=key)
        want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), key=key)
        assert got == [pytest.approx(w) if any(isinstance(x, float) for x in w) else w for w in want], name


# op5

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/b">News today and more</a></li></ul></nav><div class="ad">Buy this now it is very cheap indeed</div>
<article><h1>Head &lt;line&gt;</h1><p>First  <b>bold</b>\n text with a number of words in it.<br>After break<p>Second paragraph &eacute;t&eacute; &#x1F600; goes on and on for a while.</p>
<aside>Not this side note at all</aside><form><p>Sign up here please</p></form><div class="comments"><p>I like this very much, said a reader.</p></div></article>
<footer>&copy; somebody and others</footer></body></html>"""
MAIN = "Head <line>\n\nFirst bold text with a number of words in it. After break\n\nSecond paragraph été \U0001f600 goes on and on for a while."


def test_extract(spark, empty):
    rows = [(k, f"u{k}", PAGE) for k in range(20)] + [(50, None, None), (51, "u", ""), (52, "u", "<html><body></body></html>"), (53, "u", "plain words only, no tags"), (54, "u", PAGE[: PAGE.index("Second")]), (None, "u", "<p>a &lt b</p>")]
    t = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r for r in extract.extract(t).collect()}
    assert all(got[k].text == MAIN and got[k].n_chars == len(MAIN) for k in range(20))
    assert got[50].text == got[51].text == got[52].text == "" and got[53].text == "plain words only, no tags"
    assert got[54].text == MAIN[: MAIN.index("\n\nSecond")] and got[None].text == "a < b"
    assert extract.extract(t.limit(0)).count() == 0


def test_extract_keeps_lists_links_and_asides_anywhere_in_an_article():
    para = "<p>" + "some words of a plain paragraph here " * 3 + "</p>"
    menu = "<nav><ul>" + '<li><a href="/">Menu item</a></li>' * 6 + "</ul></nav>"
    page = lambda body: f"<html><head><title>t</title></head><body>{menu}<div><p>Shop</p></div><article>{body}</article><div><p>Terms</p></div></body></html>"
    counts = [extract.count_kinds(page(para * 5)) for _ in range(50)]
    weights = extract.learn(sum((c[0] for c in counts), Counter()), sum((c[1] for c in counts), Counter()))
    inside = " ".join(para[3:-4].split())
    items = "<ul>" + "".join(f"<li>point {k} of the <a href='/x'>list</a></li>" for k in range(3)) + "</ul>"
    points = [f"point {k} of the list" for k in range(3)]
    title, more = "<h1><a href='/'>A linked title</a></h1>", "<p>Read more at <a href='/y'>our site</a>.</p>"
    aside = "<aside><ul>" + '<li><a href="/">Other story</a></li>' * 6 + "</ul></aside>"
    for body, want in (
        (items + para * 2, [*points, inside, inside]),
        (para + items + para, [inside, *points, inside]),
        (para * 2 + items, [inside, inside, *points]),
        (title + para + more, ["A linked title", inside, "Read more at our site."]),
        (para + aside + para * 4, [inside] * 5),
        (aside + para + items + aside, [inside, *points]),
    ):
        assert extract.main_text(page(body), weights) == "\n\n".join(want)


PARA = "some words of a plain paragraph that tells of many things " * 6


@pytest.mark.parametrize("attrs", ['class="content with-sidebar"', 'class="main has-sidebar"', 'class="post no-comments"', 'class="col-side article"', 'id="search-results"', 'class="sidebar"', 'id="header"'])
def test_extract_keeps_what_holds_most_words(attrs):
    ad = '<div class="ad-banner">buy this now</div>'
    assert extract.main_text(f"<body><div {attrs}>{ad}<p>{PARA}</p></div><footer>by us</footer></body>", {}) == PARA.strip()


def test_a_long_advert_beside_a_short_article():
    assert extract.main_text(f"<body><div class='ad'>{PARA}</div><article><p>Two words.</p></article><footer>x</footer></body>", {}) == "Two words."


def test_extract_of_odd_pages():
    whole = PARA.strip()
    form = f"<body><form action='/'><p>{PARA}</p><label>Name <input></label><select><option>one<option>two</select><button>Go on</button></form></body>"
    assert extract.main_text(form, {}) == whole
    for odd in ("<svg>", "<svg/>", "<svg viewBox='0 0 1 1'/>", "<object>", "<template>", "<noscript>", "<select>", "<script>var x = 1;"):
        assert extract.main_text(f"<body><article><p>{PARA}</p>{odd}<p>{PARA}</p><p>{PARA}</p></article></body>", {}) == "\n\n".join([whole] * 3), odd
    assert extract.main_text(f"<article><p>{PARA} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds here as well.</p></article>", {}).endswith("things x=2 holds here as well.")
    assert extract.main_text(f"<article><p>{PARA}</p></article><ul>" + "<li><a href='/'>an item</a></li>" * 20 + f"</ul><article><p>{PARA}</p></article>", {}).count("plain") == 12
    long = "<article>" + f"<p>{PARA}</p>" * 3000 + "</article>"
    assert extract.main_text(long, {}) == "\n\n".join([whole] * 3000)


def test_maximum_scoring_run_matches_brute_force():
    """The region itself: of all runs with the highest score, the first to end, begun as late as its score allows."""
    rng = random.Random(4)
    weights = {"w:p": 1.0, "w:li": 0.25, "t:p": -0.5, "t:li": -3.0, "t:ul": -4.0, "w:": 0.5}
    for _ in range(200):
        page = "".join(rng.choice(["<p>", "</p>", "<li>", "<ul>", "one two ", f"w{rng.randrange(99)} ", "<aside>no no</aside>"]) for _ in range(12))
        seq = extract.tokens(page)
        score = [0.0 if out else len(t.split()) * weights.get(k, 1.0) if k[0] == "w" else weights.get(k, extract.tag_floor(k[2:])) for k, t, _, out in seq]
        best, region = 0.0, (0, 0)
        for j in range(1, len(seq) + 1):
            for i in range(j - 1, -1, -1):
                if sum(score[i:j]) > best:
                    best, region = sum(score[i:j]), (i, j)
        words = [w for k, t, _, out in seq[slice(*region)] if not out for w in t.split()]
        assert extract.main_text(page, weights).split() == words


# op6


def test_warc(spark):
    rows = [(5, "http://a/é b\r\nX: y", "<p>same</p>"), (3, None, "<p>same</p>"), (9, "http://b", "<p>same</p>"), (1, "u", None), (2, "u", ""), (4, "u", "only" * 3000), (None, "u", "<p>same</p>"), (None, "u", "lone")]
    rows += [(100 + i, f"http://host/{i}", f"<html><body><p>page number {i} of many</p></body></html>") for i in range(60)]
    t = spark.createDataFrame([(*r, "clash", 0) for r in rows], "page_id long, url string, html string, digest string, size int").repartition(2)
    archives = warc.write_archives(t)
    got = sorted((tuple(r) for r in warc.read_archives(archives).collect()), key=key)
    least = defaultdict(lambda: None)
    for i, _, h in rows:
        if i is not None and (least[h or ""] is None or i < least[h or ""]):
            least[h or ""] = i
    want = []
    for i, _, h in rows:
        f = least[h or ""]
        revisit = f is not None and i != f
        want.append((i, len((h or "").encode()), warc.digest32((h or "").encode()), "revisit" if revisit else "response", f if revisit else None))
    assert got == sorted(want, key=key)
    back = {r.page_id: bytes(r.payload) for r in warc.read_archives(archives, payloads=True).collect() if r.record_type == "response"}
    assert back[4] == b"only" * 3000
    assert warc.read_archives(warc.write_archives(t.limit(0))).count() == 0
    assert {r.record_type for r in warc.read_archives(warc.write_archives(t, least=20)).filter("payload_bytes < 20").collect()} == {"response"}


def test_archive_form_and_damage(tmp_path, spark):
    records = [warc.record(i, f"http://x/{i}", f"<p>payload of page {i}</p>".encode() * 20, None) for i in range(50)]
    blob = warc.pack(records)
    assert int.from_bytes(blob[:4], "little") == warc.SKIPPABLE and list(warc.unpack(blob)) == records
    with pytest.raises(ValueError):
        list(warc.unpack(blob[:-5]))
    with pytest.raises(ValueError):
        warc.parse(records[0].replace(b"payload of page 0", b"payload of page 1", 1))
    with pytest.raises(ValueError):
        warc.parse(records[0][:-6])
    assert warc.page_of(warc.record_id(-7)) == -7 and warc.page_of(warc.record_id(None)) is None
    t = spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id long, url string, html string")
    (path,) = warc.export_archives(warc.write_archives(t), str(tmp_path))
    assert warc.parse(next(warc.unpack(open(path, "rb").read())))["page_id"] == 1


# op7


def toxic_corpus(n=900, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    stems = ["zorgak", "vlekwup", "xymbrok"]
    out = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(max(2, len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice(stems) + rng.choice(["", "s", "er", rng.choice(plain)])
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_toxicity_held_out(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1.0) for i, t, _ in rows] + [(5000, None, "en", "s", 0, 1.0), (5001, "", "en", "s", 0, 1.0), (None, "x", "en", "s", 0, 1.0)], "doc_id long, text string, lang string, source string, n_chars long, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(7, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    assert got[5000].score == got[5001].score
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    kept = {r.doc_id for r in toxicity.keep_clean(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r.predicted == 0}
    assert toxicity.scored(docs.limit(0), labels).count() == 0


def test_unseen_misspelling_shares_ngrams():
    rows = toxic_corpus()
    m = toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows], (5 / 6, 1 / 6))
    assert m.score([t for _, t, _ in rows[:9]]).tolist() == [m.score([t])[0] for _, t, _ in rows[:9]]
    assert m.word("zorgaak") > m.word("lirenast") and m.word("xymbrokk") > 5 * abs(m.word("tostino"))


def slow_subwords(word):
    """Hashes of a word and of its n-grams, letter by letter."""
    low = (1 << 64) - 1

    def mix(h):
        h = (h ^ h >> 32) * int(toxicity._M) & low
        return h ^ h >> 29

    marked = [mix((ord(c) + 1) * int(toxicity._A) & low) for c in f"<{word}>"]
    poly = lambda cs: sum(c * pow(int(toxicity._R), i, 1 << 64) for i, c in enumerate(cs)) & low
    grams = [mix(poly(marked[i : i + k]) + k & low) for k in (3, 4, 5) if k < len(marked) for i in range(len(marked) - k + 1)]
    return [mix(poly(marked) + 1 & low), *grams]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30) | st.sampled_from(["Plain words, 'quoted' and...", "x\u3000y", "ab", "a", "!? ..."]), min_size=1, max_size=5))
def test_scores_match_slow_scoring(texts):
    """Documents word by word and n-gram by n-gram."""
    scalars = np.random.default_rng(3).normal(size=1 << 12)
    want = []
    for t in texts:
        total, tokens = 0.0, t.lower().split()
        for token in tokens:
            if w := token.strip(toxicity.EDGE):
                parts = [scalars[(h >> 20) % len(scalars)] for h in slow_subwords(w)]
                total += sum(parts) / len(parts)
        want.append(1 / (1 + np.exp(-(0.3 + (total / len(tokens) if tokens else 0.0)))))
    assert toxicity.Model(scalars, 0.3).score(texts) == pytest.approx(want)


def test_words_longer_than_a_chunk(monkeypatch):
    texts = ["short " + "z" * 5000 + " words", "a b c " * 300]
    whole = toxicity.Model(np.arange(64.0), 0.0).score(texts)
    monkeypatch.setattr(toxicity, "CHUNK", 100)
    assert toxicity.Model(np.arange(64.0), 0.0).score(texts) == pytest.approx(whole)


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = toxic_corpus(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    score = lambda flip: {r.doc_id: r.score for r in toxicity.scored(docs, spark.createDataFrame([(i, 0, 1 - y if flip and zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows], "doc_id long, quality int, toxic int")).collect()}
    assert score(False) == score(True)


def test_no_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.scored(docs, none).collect()} == {0}


# op9


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_documents(docs, empty, library, edge_texts):
    got = sorted((tuple(r) for r in bpe.token_digests(docs).collect()), key=key)
    want = []
    for i, t in edge_texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=key)
    assert bpe.token_digests(empty).count() == 0 and bpe.encode_documents(docs).filter("doc_id = 1").head().ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.sampled_from(["<|endoftext|>", "it's I'LL x<|startoftext|><|endoftext|>y", "ΑΣ ΟΔΟΣ", "İstanbul ǅ ﬁ", "ﷺ", "á̧", "\x1c\x1d\x85\xa0", "x" * 3000]))
def test_bpe_equals_the_library(text):
    from tokenizers import Tokenizer

    global _library
    _library = globals().get("_library") or Tokenizer.from_file(bpe.default_path())
    ids = bpe.load(bpe.default_path()).encode(text).tolist()
    assert ids == _library.encode(text, add_special_tokens=False).ids


def test_bpe_of_newer_letters_equals_the_library(library):
    every = [chr(c) for a, b in (*bpe.UNICODE_16, *((x, y) for x, y, _ in bpe.LOWER_NEW), (0x88F, 0x88F), (0xA7CE, 0xA7CF), (0x16EA0, 0x16EB8), (0x33450, 0x33460)) for c in range(a, b + 1)]
    for c in every[::3]:
        text = f"a{c}B 1{c}2{c}{c} it's"
        assert bpe.load(bpe.default_path()).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_bpe_of_long_words(library):
    rng, b = random.Random(1), bpe.load(bpe.default_path())
    for n in (bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 5000):
        for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "etaoin", "日本語éa"):
            word = "".join(rng.choice(letters) for _ in range(n))
            assert b.encode(word).tolist() == library.encode(word, add_special_tokens=False).ids
            assert b.merge(word.encode()) == b.merge_long(word.encode())
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    assert b.encode(word).tolist() == library.encode(word, add_special_tokens=False).ids


# op10


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= 2 * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def test_mixing(make):
    rng = random.Random(6)
    texts = [(i, " ".join("w" for _ in range(int(rng.paretovariate(1.1) * 5)))) for i in range(700)] + [(None, "a b"), (1000, None), (1001, "")]
    docs = make(texts, sources=("src2", "src10", "é", "Z", None, "a", "src2", "src2"))
    rows = mixing.mix(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in rows) == sorted((i is None, i or 0, len((t or "").split())) for i, t in texts)
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
        assert r.taken == r.copies * r.size <= 2 * r.size
    want = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        # two thirds of src2's words are one document, which the others can balance on one side only
        assert abs(taken[s] - want[s]) <= max(6, 0.02 * want[s]), s
    again = {(r.doc_id, r.size): r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.size): r.taken for r in rows}


def test_mixing_edge_cases(docs, empty, make):
    assert mixing.mix(docs).count() == 12 and mixing.mix(empty).count() == 0
    assert {r.taken for r in mixing.mix(make([(1, None), (2, " ")])).collect()} == {0}
    (one,) = mixing.mix(make([(1, "a b c d")])).collect()
    assert one.taken in (4, 8) and one.target == 6.0


def test_mixing_keeps_inclusion_probabilities(make):
    docs = make([(i, "w " * (3 + i % 5)) for i in range(60)], sources=("a", "b"))
    total, runs = defaultdict(int), 4
    for seed in range(runs):
        for r in mixing.mix(docs, seed=seed * 1000).collect():
            total[r.doc_id] += r.copies
            rate = {r.source: r.target / r.source_size}
    mean = sum(total.values()) / len(total) / runs
    assert abs(mean - 1.5) < 0.15 and max(total.values()) <= 2 * runs and rate
