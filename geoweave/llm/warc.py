r"""WARC archives compressed with Zstandard and a dictionary, written and read back (op6).

An archive is: a skippable frame (magic 0x184D2A5D) that holds the Zstandard dictionary, then one frame per record. The dictionary is
trained on the first records of the archive (DICT_RECORDS and DICT_BYTES at most) and left out when there is too little to train on.
Archives are at most about ARCHIVE_BYTES of records and are rows of a Parquet table in the shared folder (archive, blob), so they are
written and read through Spark on any file system; export_archives puts them into .warc.zst files.

Of records with equal payloads of at least `least` bytes, the one with the smallest page_id is a response and the others are revisits of
it. Payload digests are grouped before the shuffle; pages that a Bloom filter of the repeated ones passes are joined with those, and no
other page moves.

Reading checks the frames, WARC version lines, header fields, Content-Length against the block, HTTP head, and payload digests.

Edge cases: null html is an empty payload; a null page_id never is referred to unless all copies have none, and then all are responses;
rows that repeat the response's page_id are responses too; null urls have no target; an empty table gives no archives and no rows; extra
columns are not read; a damaged archive raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, slices, stored, table
from .exact_dedup import bloom, bloom_bits, may_hold

SKIPPABLE, ZSTD_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
ARCHIVE_BYTES, DICT_RECORDS, DICT_BYTES, DICT_SIZE, LEVEL = 16_000_000, 400, 4_000_000, 32_768, 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_URN = 0x6765_6F77_6561_5000_8000_0000_0000_0000 << 64


def record_id(page: int | None) -> str:
    n = _URN | (page & (1 << 64) - 1) if page is not None else _URN >> 1
    h = f"{n:032x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def page_of(uri: str) -> int | None:
    if not (uri.startswith("<urn:uuid:") and uri.endswith(">")):
        raise ValueError("not a record id of ours")
    n = int(uri[10:-1].replace("-", ""), 16)
    if n == _URN >> 1:
        return None
    low = n & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers: int | None) -> bytes:
    """One WARC/1.1 record: a response with the payload, or a revisit with the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~"))
    head.append("WARC-Payload-Digest: sha1:" + digest32(payload))
    if refers is not None:
        head += [f"WARC-Refers-To: {record_id(refers)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    """Records -> an archive."""
    sample, held = [], 0
    for r in records[:DICT_RECORDS]:
        if held + len(r) > DICT_BYTES:
            break
        sample.append(r)
        held += len(r)
    try:
        trained = zstandard.train_dictionary(DICT_SIZE, sample) if len(sample) >= 16 else None
    except zstandard.ZstdError:
        trained = None
    ctx = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True)
    lead = b""
    if trained is not None:
        body = trained.as_bytes()
        lead = struct.pack("<II", SKIPPABLE, len(body)) + body
    return lead + b"".join(map(ctx.compress, records))


def unpack(archive: bytes) -> Iterator[bytes]:
    """An archive -> its records: the dictionary of the leading skippable frame, then a frame at a time."""
    view, pos, known = memoryview(archive), 0, None
    if len(archive) >= 8 and struct.unpack("<I", archive[:4])[0] == SKIPPABLE:
        size = struct.unpack("<I", archive[4:8])[0]
        body = bytes(view[8 : 8 + size])
        if len(body) != size:
            raise ValueError("dictionary frame cut short")
        if body[:4] == ZSTD_MAGIC:
            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        known, pos = zstandard.ZstdCompressionDict(body), 8 + size
    ctx = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while pos < len(archive):
        if bytes(view[pos : pos + 4]) != ZSTD_MAGIC:
            raise ValueError("no frame where one should begin")
        obj, parts, step = ctx.decompressobj(), [], 16384
        try:
            while not obj.eof:
                chunk = view[pos : pos + step]
                if not len(chunk):
                    raise ValueError("frame cut short")
                parts.append(obj.decompress(chunk))
                pos += len(chunk)
                step = min(step * 2, 1 << 20)
        except zstandard.ZstdError as e:
            raise ValueError(f"damaged frame: {e}") from e
        pos -= len(obj.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """A record's fields, checked."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("damaged header line")
        fields[name.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} - fields.keys()
    if missing or not fields["content-length"].isdigit():
        raise ValueError(f"missing or bad header fields {sorted(missing)}")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("Content-Length differs from the block")
    http, mark, payload = rest[:n].partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    kind = fields["warc-type"]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if not mark or length is None or kind not in ("response", "revisit"):
        raise ValueError("no HTTP response in the block")
    if kind == "response" and (len(payload) != length or digest32(payload) != digest):
        raise ValueError("payload differs from its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("a revisit with a payload or without a reference")
    return {"page_id": page_of(fields["warc-record-id"]), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": page_of(fields["warc-refers-to"]) if kind == "revisit" else None, "payload": payload}


_ARCHIVE = "archive string, n_records long, blob binary"


def write_archives(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, html) -> the stored archives (archive, n_records, blob)."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    groups = rows.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = stored(groups.filter("n > 1").drop("n"), "warc-repeated")  # plain exchanges on both sides of the join: Spark splits hot digests
    held = pages.sparkSession.sparkContext.broadcast(bloom(first.select(F.xxhash64("digest").alias("fp")), bloom_bits(first.count())))
    schema = pa.schema([("archive", pa.string()), ("n_records", pa.int64()), ("blob", pa.binary())])

    def close(records: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"archive": [hashlib.sha1(records[0]).hexdigest()[:16]], "n_records": [len(records)], "blob": [pack(records)]}, schema=schema)

    def may_repeat(batch: pa.RecordBatch) -> np.ndarray:
        return may_hold(np.frombuffer(held.value, np.uint8), batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))

    def write(batches: Iterator[pa.RecordBatch], joined: bool) -> Iterator[pa.RecordBatch]:
        records, size = [], 0
        for batch in batches:
            for part in slices(batch if joined else batch.filter(pa.array(~may_repeat(batch)))):
                firsts = part.column("first").to_pylist() if joined else [None] * len(part)
                for page, url, html, of in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")), firsts):
                    r = record(page, url, html.encode(), of if of is not None and of != page else None)
                    if records and size + len(r) > ARCHIVE_BYTES:
                        yield close(records)
                        records, size = [], 0
                    records.append(r)
                    size += len(r)
        if records:
            yield close(records)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(may_repeat(batch)))
            if len(kept):
                yield kept.drop_columns(["fp"])

    hashed = rows.select("page_id", "url", "html", "digest", "size", F.xxhash64("digest").alias("fp"))
    lone = hashed.drop("digest", "size").mapInArrow(lambda b: write(b, False), _ARCHIVE)
    again = hashed.mapInArrow(sift, "page_id long, url string, html string, digest string, size int").join(first, ["digest", "size"], "left")
    return stored(lone.unionAll(again.select("page_id", "url", "html", "first").mapInArrow(lambda b: write(b, True), _ARCHIVE)), "warc")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Archives -> a row a record: page_id, payload_bytes, payload_digest, record_type, refers_to (and the payload of responses)."""
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(fields + [("payload", pa.binary())] * payloads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for count, blob in zip(batch.column("n_records").to_pylist(), batch.column("blob")):
                seen, rows = 0, []
                for raw in unpack(blob.as_buffer().to_pybytes()):
                    rows.append(parse(raw))
                    seen += 1
                    if len(rows) >= (64 if payloads else SLICE_ROWS):
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if seen != count:
                    raise ValueError("an archive has more or fewer records than were written")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives.select("n_records", "blob").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)


def export_archives(archives: DataFrame, folder: str) -> list[str]:
    """Write each archive as a .warc.zst file into a folder that all executors share; their names."""
    import os

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for name, blob in zip(b.column("archive").to_pylist(), b.column("blob").to_pylist()):
                path = f"{folder}/{name}.warc.zst"
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    f.write(blob)
                os.replace(f.name, path)
                yield pa.RecordBatch.from_pydict({"path": [path]})

    return [r.path for r in archives.select("archive", "blob").mapInArrow(run, "path string").collect()]


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages")))


QUERIES = {"op6_warc": op6_warc}
ORACLE = {
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
     d AS (SELECT page_id, strlen(html) AS payload_bytes, h, min(page_id) OVER (PARTITION BY h) AS first FROM p),
     b AS (SELECT *, array_to_string(list_transform(range(32), lambda i:
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || h[1 + (i // 8) * 10:10 + (i // 8) * 10])::UBIGINT >> (35 - 5 * (i % 8))) & 31)::INT]), '') AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM b"""
}
