r"""SimHash near-duplicates by pigeonhole blocks (op4).

Fingerprints: words `[^\x20\x09-\x0D]+` of the A-Z-lower-cased text, shingles of three words (repeats count), XXH64 seed 42 of each,
and the majority of their bits. Links: Hamming distance of at most MAX_BITS.

The 64 bits are split into BLOCKS blocks. Two fingerprints that differ in at most d bits agree on BLOCKS - d blocks at least, so each
fingerprint is dealt once for every choice of BLOCKS - d blocks, keyed by their bits (38 bits of key: at 10^11 fingerprints a key
still holds a few by chance). Keys with one fingerprint go. Inside the others no pairs are listed: each fingerprint is sent once to itself
and to the points one flip away, over the bits that are free in any block choice it shares. Two fingerprints meet at a point exactly if
they are within two bits, so a member of a group of any size costs 65 rows at most, and a hot key is spread over its points. Each link is
verified by XOR. Equal fingerprints collapse before anything is dealt.

Edge cases: null or blank text has fingerprint zero and links like any other; repeated rows (same doc_id) each give a row; a null
doc_id gets a fingerprint and its component's id, but never names a component unless all its members are null; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.operators.components import components

from .common import map_rows, stored, table, texts

SHINGLE, SEED, MAX_BITS, BLOCKS = 3, 42, 2, 5
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes."""
    sep = _SEP[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], sep, [True])).view(np.int8)))
    return edge[::2], edge[1::2]


def fingerprint(text: str, size: int = SHINGLE) -> int:
    data = text.encode().lower()  # bytes.lower() touches A-Z only
    words = data.split()  # bytes.split() splits at exactly [\x20\x09-\x0D]
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: 1 - size].tolist()
    h, seed = xxhash.xxh64_intdigest, SEED
    n = len(starts)
    hashes = np.fromiter((h(data[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist())), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        counts += np.unpackbits(hashes[k : k + 65536].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE, *more: str) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long), and the named columns (longs)."""

    def make():
        def rows(x):
            fps = np.array([fingerprint(t, size) for t in x["text"]], np.uint64).view(np.int64)
            return {"doc_id": x["doc_id"], "fp": fps, **{c: x[c] for c in more}}

        return rows

    return map_rows(texts(docs, *more), make, "doc_id long, fp long" + "".join(f", {c} long" for c in more))


def _masks(blocks: int, bits: int) -> list[int]:
    """For each choice of blocks - bits blocks, the 64-bit mask of their bits."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(each, blocks - bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(nodes: DataFrame, blocks: int = BLOCKS, bits: int = MAX_BITS) -> DataFrame:
    """fp (distinct longs) -> verified star links (u, v), v < u, that connect exactly what pairs within `bits` bits connect."""
    if bits != 2:
        raise ValueError("meeting points are one flip away: bits must be 2")
    masks = _masks(blocks, bits)
    dealt = nodes.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)))).alias("b")).select("fp", "b.c", "b.k")
    # stored, so that both sides of the join are plain exchanges, of which Spark splits skewed partitions
    shared = stored(dealt.groupBy("c", "k").agg(F.count("*").alias("n")).filter("n > 1").select("c", "k"), "simhash-shared")
    free = F.element_at(F.lit([_signed(~m & (1 << 64) - 1) for m in masks]), F.col("c") + 1)
    held = stored(dealt.join(shared, ["c", "k"]).groupBy("fp").agg(F.bit_or(free).alias("free")), "simhash-held")
    flips = F.filter(F.lit([_signed(1 << b) for b in range(64)]), lambda f: F.col("free").bitwiseAND(f) != 0)
    points = held.select("fp", F.explode(F.concat(F.array(F.lit(0).cast("long")), flips)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    least = stored(points.groupBy("z").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1").select("z", "v"), "simhash-points")
    met = points.join(least, "z").filter("fp <> v")
    return met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= bits).select(F.col("fp").alias("u"), "v").distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, blocks: int = BLOCKS, key: str | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable); given a column that is a key of the rows (long), also
    that, and kept: true for one row of each component, one with the component's id."""
    fps = stored(fingerprints(docs, size, *([key] if key else [])), "simhash")
    member = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key) if key else F.col("doc_id")
    nodes = fps.groupBy("fp").agg(F.min(member).alias("least_id"), F.count("*").alias("n"))
    roots = components(links(nodes.select("fp"), blocks))
    linked = stored(roots.join(nodes, roots["node"] == nodes["fp"]).select("fp", "root", "least_id"), "simhash-linked")
    named = stored(linked.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-named")
    of = linked.join(named, "root").select(F.col("fp").alias("of"), "component_id")
    # only fingerprints with company: the others' rows name themselves
    owner = nodes.join(of, nodes["fp"] == of["of"], "left").filter("n > 1 OR of IS NOT NULL")
    owner = stored(owner.select("fp", F.coalesce("component_id", "least_id").alias("component_id")), "simhash-owner")
    out = fps.join(owner, "fp", "left").withColumn("component_id", F.coalesce("component_id", member)).withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))
    if not key:
        return out.select("doc_id", "fingerprint", "component_id")
    return out.select("doc_id", "fingerprint", "component_id.doc_id", (F.col(key) == F.col(f"component_id.{key}")).alias("kept"), key).toDF("doc_id", "fingerprint", "component_id", "kept", key)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op4_simhash": op4_simhash}
ORACLE: dict[str, str] = {}
