r"""Exact deduplication by a Golomb-coded fingerprint exchange (op3).

Texts are equal when identical after deleting `[\x20\x09-\x0D]`. Of equal texts the row with the most code points in its original
text stays, then the smallest doc_id.

1. Every row gets a 64-bit fingerprint and the SHA-256 of its normalised text (JVM expressions; one scan). The small rows are stored.
2. Each sender (a partition of that table) sorts its distinct fingerprints, and for each owner (a range of the fingerprint space)
   sends one Golomb-Rice-coded blob of the gaps, with the distinct fingerprints it holds more than once marked.
3. An owner merges its blobs and returns to each sender a bitmap over that sender's sorted list: 1 where the fingerprint is held twice
   or more anywhere; the bitmap and the blob are shuffled back to the sender. Rows whose bit is 0 are unique and done; no text of theirs ever moves.
4. Suspects are byte-verified: the texts are scanned again, a Bloom filter of checked size (built in segments from the suspects)
   drops nearly all rows that are no suspects, and the rest are grouped by the normalised bytes themselves. The grouping
   aggregates before the shuffle, so a group with a third of all rows sends one row a partition.
Owners are bounded: OWNER_ROWS fingerprints each on average (they are uniform, and each sender sends each fingerprint once).

Edge cases: null text is empty; blank texts are equal to each other; repeated rows count as group members, and all that
carry the keep_id are marked kept; a null doc_id loses ties; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, stored, table, texts

OWNER_ROWS, BLOOM_HASHES, SEGMENTS = 1_000_000, 4, 256


def rice_encode(gaps: np.ndarray, k: int) -> bytes:
    """Golomb code with parameter 2**k of non-negative integers: first the k low bits of each, then the unary quotients."""
    gaps = gaps.astype(np.uint64)
    low = np.zeros((len(gaps), k), np.uint8)
    for j in range(k):
        low[:, j] = (gaps >> np.uint64(k - 1 - j)) & np.uint64(1)
    q = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(q + 1)
    unary = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 1  # q zeros, then a one
    return np.packbits(low).tobytes() + np.packbits(unary).tobytes()


def rice_decode(blob: bytes, n: int, k: int, step: int = 1 << 16) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)
    cut = -(-n * k // 8)
    stops = np.flatnonzero(np.unpackbits(raw[cut:]))
    if len(raw) < cut or len(stops) < n:
        raise ValueError("truncated Golomb blob")
    gaps = np.diff(stops[:n], prepend=-1).astype(np.uint64) - np.uint64(1) << np.uint64(k)
    for i in range(0, n if k else 0, step):  # step is a multiple of 8, so each slice begins at a byte
        m = min(step, n - i)
        bits = np.unpackbits(raw[i * k // 8 : -(-(i + m) * k // 8)], count=m * k).reshape(m, k)
        for j in range(k):
            gaps[i : i + m] |= bits[:, j].astype(np.uint64) << np.uint64(k - 1 - j)
    return gaps


def send(fps: np.ndarray) -> tuple[int, bytes, np.ndarray, np.ndarray]:
    """Of one owner's fingerprints (uint64): k, blob, the sorted distinct ones, and which of them occur more than once."""
    values, times = np.unique(fps, return_counts=True)
    gaps = np.diff(np.concatenate((values[:1], values))) if len(values) else values
    k = max(0, int(np.log2(max(1.0, float(gaps.mean()) * 0.69)))) if len(gaps) else 0
    return k, rice_encode(gaps, k), values, times > 1


def receive(k: int, first: int, n: int, blob: bytes) -> np.ndarray:
    return np.uint64(first) + np.cumsum(rice_decode(blob, n, k), dtype=np.uint64)


def owner_bitmaps(blobs: list[tuple[int, int, int, bytes, bytes]]) -> list[bytes]:
    """(k, first, n, blob, repeats bitmap) of each sender -> the duplicate bitmap for each sender."""
    lists = [receive(*b[:4]) for b in blobs]
    values, times = np.unique(np.concatenate(lists), return_counts=True)
    out = []
    for (_, _, n, _, again), x in zip(blobs, lists):
        dup = times[np.searchsorted(values, x)] > 1
        dup |= np.unpackbits(np.frombuffer(again, np.uint8), count=n).astype(bool)
        out.append(np.packbits(dup).tobytes())
    # a fingerprint that one sender alone holds twice is known to that sender; others hold it only if times > 1
    return out


def _owner_of(fps: np.ndarray, owners: int) -> np.ndarray:
    return ((fps >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def normalised(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, norm, fp (XXH64 of norm), sha, n_cp (code points of the original), and the named columns."""
    t = texts(docs, *more).withColumn("norm", F.translate("text", SPACE_CHARS, ""))
    return t.select("doc_id", "norm", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("text_sha256"), F.char_length("text").cast("long").alias("n_cp"), *more)


def suspects(marks: DataFrame, owners: int) -> DataFrame:
    """marks (sender, fp) -> the fingerprints that occur more than once, by the exchange."""

    def sends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            s, f = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for x in np.unique(s):
                held.setdefault(int(x), []).append(f[s == x])
        for x, parts in held.items():
            f = np.concatenate(parts)
            own = _owner_of(f, owners)
            order = np.argsort(own, kind="stable")
            f, own = f[order], own[order]
            cuts = np.flatnonzero(np.diff(own)) + 1
            for part, o in zip(np.split(f, cuts), own[np.concatenate(([0], cuts))].tolist()):
                k, blob, values, again = send(part)
                yield pa.RecordBatch.from_pydict({"sender": [x], "owner": [int(o)], "k": [k], "first": [int(values[:1].view(np.int64)[0])], "n": [len(values)], "blob": [blob], "again": [np.packbits(again).tobytes()]}, schema=_sent)

    _sent = pa.schema([("sender", pa.int64()), ("owner", pa.int64()), ("k", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("blob", pa.binary()), ("again", pa.binary())])
    sent = marks.select("sender", "fp").mapInArrow(sends, "sender long, owner long, k int, first long, n long, blob binary, again binary")

    def own(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        maps = owner_bitmaps([(r["k"], r["first"] & (2**64 - 1), r["n"], r["blob"], r["again"]) for r in rows])
        keep = [{**{c: r[c] for c in ("sender", "owner", "k", "first", "n", "blob")}, "bitmap": m} for r, m in zip(rows, maps)]
        return pa.Table.from_pylist(keep, schema=_owned)

    _owned = pa.schema([f for f in _sent if f.name != "again"] + [("bitmap", pa.binary())])
    returned = sent.groupBy("owner").applyInArrow(own, "sender long, owner long, k int, first long, n long, blob binary, bitmap binary")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sender's side: its sorted list again (the blob came back with the bitmap), and what the bitmap marks in it."""
        for b in batches:
            for r in b.to_pylist():
                x = receive(r["k"], r["first"] & (2**64 - 1), r["n"], r["blob"])
                dup = x[np.unpackbits(np.frombuffer(r["bitmap"], np.uint8), count=r["n"]).astype(bool)]
                if len(dup):
                    yield pa.RecordBatch.from_pydict({"fp": dup.view(np.int64)}, schema=pa.schema([("fp", pa.int64())]))

    return returned.repartition("sender").mapInArrow(read, "fp long").distinct()


def _slots(fp: np.ndarray, bits: int) -> np.ndarray:
    """BLOOM_HASHES slots in each of which a fingerprint sets a bit: double hashing of its halves."""
    a, b = fp & np.uint64(0xFFFFFFFF), (fp >> np.uint64(32)) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) & np.uint64(bits - 1)


def bloom_bits(n: int, most: int = 1 << 28) -> int:
    """About 12 bits a key, in 2**20 .. 2**28 (32 MB); beyond that, more rows pass and what follows drops them."""
    return min(most, 1 << max(20, (12 * n).bit_length()))


def _set(packed: np.ndarray, fp: np.ndarray) -> None:
    slots = _slots(fp, len(packed) * 8).ravel()
    np.bitwise_or.at(packed, slots >> np.uint64(3), (np.uint8(1) << (slots & np.uint64(7)).astype(np.uint8)))


def may_hold(packed: np.ndarray, fp: np.ndarray) -> np.ndarray:
    slots = _slots(fp, len(packed) * 8)
    return (packed[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8) & np.uint8(1)).all(1)


def bloom(fps: DataFrame, bits: int) -> bytes:
    """A Bloom filter of `bits` bits; its segments are built apart and sent to the driver."""
    seg = bits // 8 // SEGMENTS

    def bits_of(batches):
        full = np.zeros(bits // 8, np.uint8)
        for b in batches:
            _set(full, b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        out = [(i, full[i * seg : (i + 1) * seg].tobytes()) for i in range(SEGMENTS) if full[i * seg : (i + 1) * seg].any()]
        if out:
            yield pa.RecordBatch.from_pydict({"i": [i for i, _ in out], "b": [b for _, b in out]}, schema=pa.schema([("i", pa.int32()), ("b", pa.binary())]))

    def merge(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint8) for x in t.column("b").to_pylist()]
        return pa.Table.from_pydict({"i": t.column("i").to_pylist()[:1], "b": [np.bitwise_or.reduce(parts).tobytes()]}, schema=pa.schema([("i", pa.int32()), ("b", pa.binary())]))

    out = bytearray(bits // 8)
    for r in fps.mapInArrow(bits_of, "i int, b binary").groupBy("i").applyInArrow(merge, "i int, b binary").collect():
        out[r.i * seg : (r.i + 1) * seg] = r.b
    return bytes(out)


def exact_duplicates(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; given a column that is a key of the rows (long), also that, and of
    each group exactly one row is kept, whatever its doc_id."""
    more = [key] if key else []
    spark = docs.sparkSession
    rows = normalised(docs, *more)
    marks = stored(rows.select(F.spark_partition_id().cast("long").alias("sender"), "doc_id", "fp", "text_sha256", "n_cp", *more), "exact-marks")
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), marks.count() // OWNER_ROWS)
    dup = stored(suspects(marks, owners), "exact-suspects")
    sieve = spark.sparkContext.broadcast(bloom(dup, bloom_bits(dup.count())))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(sieve.value, np.uint8)
        for b in batches:
            ok = may_hold(packed, b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            if ok.any():
                yield b.filter(pa.array(ok))

    best = F.max_by(F.struct("doc_id", "n_cp", *more), F.struct("n_cp", (-F.col("doc_id")).alias("d"), *((-F.col(c)).alias(c) for c in more)))
    groups = rows.select("doc_id", "norm", "fp", "n_cp", *more).mapInArrow(sift, "doc_id long, norm string, fp long, n_cp long" + "".join(f", {c} long" for c in more))
    # the key holds the bytes themselves: equal digests alone never make two texts equal
    verified = groups.groupBy("fp", "norm").agg(best.alias("best"), F.count("*").alias("group_size")).filter("group_size > 1").select(F.sha2("norm", 256).alias("sha"), F.col("best.doc_id").alias("keep_id"), "group_size", F.col(f"best.{key or 'doc_id'}").alias("keep_key"))
    verified = stored(verified, "exact-groups")  # both sides of the join are then plain exchanges, of which Spark splits skewed partitions
    out = marks.join(verified, marks["text_sha256"] == verified["sha"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce(F.col("group_size").isNull() | (F.col(key or "doc_id") == F.col("keep_key")), F.lit(False)).alias("kept"), "text_sha256", *more)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_exact_dedup": op3_exact_dedup}
ORACLE = {
    "op3_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n_cp,
             regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]', '', 'g') AS norm FROM documents),
     g AS (SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
             first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g"""
}
