r"""Substring deduplication on a log-structured fingerprint index (op8).

A window is WINDOW consecutive words `[^\x20\x09-\x0D]+` of one document. A word goes if a window covers it whose word sequence also
starts in a document with a smaller doc_id; windows are judged on the input.

1. One scan gives each document its word count, the SHA-256 of its words, and its anchors: the least hash of the GRAM-word runs inside
   each window. Equal windows have equal anchors, and about one word in thirteen starts one, so the index is a small part of the text.
   Documents with equal word sequences are settled by that digest; only the first of them goes on.
2. The index holds sorted immutable runs of (anchor hash, least doc_id), bucketed by hash, and a manifest of them. Each batch of
   documents, in order of doc_id, is merge-joined with the runs and with itself; anchors that another document holds are suspects. The
   batch becomes a run; when there are over FANOUT runs, they are compacted into one. A later session can open the folder and add to it.
3. Only documents with a suspect anchor have their text read again (a Bloom filter of checked size, then a join). They give a 128-bit
   digest of the words themselves for each window whose anchor is a suspect; a window is verified as repeated when its digest has a
   smaller doc_id. Digests are grouped with partial aggregation, then joined, so a passage that very many documents share is split.

Edge cases: null text has no words; texts of under WINDOW words keep all; a null doc_id is compared as smaller than none and keeps all;
a doc_id names one text: rows that
repeat it get the same result; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.session import checkpoint_dir

from .common import map_rows, stored, table, texts
from .exact_dedup import bloom, bloom_bits, may_hold

WINDOW, GRAM, BATCHES, FANOUT = 50, 25, 3, 2
_R = np.uint64(0x9E3779B97F4A7C15)
_POW = np.cumprod(np.full(4096, 0xD6E8FEB86659FD93, np.uint64), dtype=np.uint64)
_CODE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xFF51AFD7ED558CCD)) ^ np.uint64(0x5851F42D4C957F2D)
_CODE[0x20] = 0  # a word's hash is the same with and without the space behind it: none follows a text's or a step's last word


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def normal_words(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space, and where each starts and ends in that."""
    words = (text or "").encode().split()
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    return data, np.concatenate(([0], ends[:-1] + 1)) if len(words) else ends, ends


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, step: int = 500_000) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    raw = np.frombuffer(data, np.uint8)
    for k in range(0, len(starts), step):
        s, e = starts[k : k + step], ends[k : k + step]
        part = raw[s[0] : e[-1]]
        lens = np.diff(np.concatenate((s, [e[-1] + 1])))
        lens[-1] -= 1
        pos = np.arange(len(part)) - np.repeat(s - s[0], lens)
        out[k : k + step] = np.add.reduceat(_CODE[part] * _POW[pos & 4095], s - s[0])
    return _mix(out)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words, by doubling."""
    total, acc, have, block, width, power = len(words) - size + 1, None, 0, words, 1, _R
    if total <= 0:
        return np.empty(0, np.uint64)
    while width <= size:
        if size & width:
            part = block[have : have + total]
            acc = part.copy() if acc is None else acc * power + part
            have += width
        if width * 2 <= size:
            block = block[:-width] * power + block[width:]
        power = power * power
        width *= 2
    return _mix(acc)


def window_minima(grams: np.ndarray, span: int) -> np.ndarray:
    """The least of each `span` consecutive values, by doubling."""
    width, low = 1, grams
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = span - width
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def window_anchors(text: str | None, window: int = WINDOW, gram: int = GRAM):
    data, starts, ends = normal_words(text)
    if len(starts) < window:
        return data, starts, ends, np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        return data, starts, ends, window_minima(gram_hashes(word_hashes(data, starts, ends), gram), window - gram + 1)


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, sha (of all words), anchors (distinct, sorted)."""

    def make():
        def rows(x):
            out = {"doc_id": x["doc_id"], "n_words": [], "sha": [], "anchors": []}
            for t in x["text"]:
                data, starts, _, low = window_anchors(t)
                out["n_words"].append(len(starts))
                out["sha"].append(hashlib.sha256(data).hexdigest())
                out["anchors"].append(np.unique(low).view(np.int64))
            return out

        return rows

    return map_rows(texts(docs), make, "doc_id long, n_words long, sha string, anchors array<long>")


class FingerprintIndex:
    """Sorted immutable runs of (hash, least doc_id, greatest doc_id) in a shared folder, bucketed by hash, so that runs merge-join bucket
    by bucket without a shuffle. A manifest in the folder lists the runs after each add() or compact(); opening a folder that has one goes
    on from there, in any later session."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.path = path or f"{checkpoint_dir(spark).rstrip('/')}/window-index-{uuid.uuid4().hex}"
        self.runs: list[str] = []
        self.version, self.buckets = 0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            last = spark.read.schema(self._MANIFEST).parquet(f"{self.path}/manifest").orderBy(F.desc("version")).head()
            self.version, self.buckets, self.runs = last.version, last.buckets, list(last.runs)

    _MANIFEST = "version int, buckets int, runs array<string>"

    def _commit(self, runs: list[str]) -> None:
        self.runs, self.version = runs, self.version + 1
        self.spark.createDataFrame([(self.version, self.buckets, runs)], self._MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _write(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def run(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):  # another session wrote it
            self.spark.sql(f"CREATE TABLE {name} (hash BIGINT, doc_id BIGINT, last BIGINT) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(name)

    def add(self, batch: DataFrame) -> DataFrame:
        """batch (hash, doc_id), distinct -> the hashes of the batch that another document, of it or of the runs, has too."""
        name = self._write(batch.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")))
        own = self.run(name)
        found, held = own, F.col("doc_id") < F.col("last")
        for k, run in enumerate(self.runs):
            found = found.join(self.run(run).select("hash", F.lit(True).alias(f"_{k}")).hint("merge"), "hash", "left")
            held |= F.col(f"_{k}").isNotNull()
        hits = stored(found.filter(held).select("hash"), "lsm-hits")
        self._commit([*self.runs, name])
        if len(self.runs) > self.fanout:
            self.compact()
        return hits

    def compact(self) -> None:
        """Merge all runs into one. The old ones stay as they are: a reader may hold them."""
        merged = self.run(self.runs[0])
        for run in self.runs[1:]:  # full outer merge joins, bucket by bucket
            other = self.run(run).toDF("hash", "doc_id_", "last_").hint("merge")
            merged = merged.join(other, "hash", "full").select("hash", F.least("doc_id", "doc_id_").alias("doc_id"), F.greatest("last", "last_").alias("last"))
        self._commit([self._write(merged)])


def covered_windows(flagged: DataFrame) -> DataFrame:
    """doc_id, text, suspects -> doc_id, at: the starts of the windows that an earlier document has too."""

    def make():
        def rows(x):
            ids, a, b, at = [], [], [], []
            for doc, t, s in zip(x["doc_id"], x["text"], x["suspects"]):
                data, starts, ends, low = window_anchors(t)
                hit = np.flatnonzero(np.isin(low, np.array(s, np.int64).view(np.uint64)))
                if not len(hit):
                    continue
                h = xxhash.xxh3_128_digest
                d = np.frombuffer(b"".join(h(data[i:j]) for i, j in zip(starts[hit].tolist(), ends[hit + WINDOW - 1].tolist())), np.int64).reshape(-1, 2)
                ids.append(np.full(len(hit), doc, np.int64))
                a.append(d[:, 0])
                b.append(d[:, 1])
                at.append(hit)
            cat = lambda v: np.concatenate(v) if v else np.empty(0, np.int64)
            return {"doc_id": cat(ids), "a": cat(a), "b": cat(b), "at": cat(at).astype(np.int32)}

        return rows

    windows = map_rows(flagged, make, "doc_id long, a long, b long, at int")
    first = windows.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("a", "b", "first")
    first = stored(first, "window-firsts")  # both sides of the join are then plain exchanges, of which Spark splits skewed partitions
    return windows.join(first, ["a", "b"]).filter("doc_id > first").select("doc_id", "at")


def remove_spans(text: str | None, at: list[int] | np.ndarray, window: int = WINDOW) -> tuple[int, str]:
    """Removed words and the digest of the rest, given the starts of the windows that go."""
    data, starts, ends = normal_words(text)
    n = len(starts)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.asarray(at, np.int64), 1)
    np.add.at(edge, np.asarray(at, np.int64) + window, -1)
    gone = np.cumsum(edge[:-1]) > 0
    cuts = np.flatnonzero(np.diff(np.concatenate(([True], gone, [True])).astype(np.int8)))
    kept = b" ".join(data[starts[i] : ends[j - 1]] for i, j in zip(cuts[::2].tolist(), cuts[1::2].tolist()))
    return int(gone.sum()), hashlib.sha256(kept).hexdigest()


def sieve(docs: DataFrame, keys: DataFrame, bits: int) -> DataFrame:
    """Rows whose doc_id may be in keys (doc_id), by a broadcast Bloom filter of `bits` bits; the rest is surely not."""
    held = docs.sparkSession.sparkContext.broadcast(bloom(keys.select(F.xxhash64("doc_id").alias("fp")), bits))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(held.value, np.uint8)
        for b in batches:
            ok = may_hold(packed, b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            if ok.any():
                yield b.filter(pa.array(ok)).drop_columns(["fp"])

    return docs.withColumn("fp", F.xxhash64("doc_id")).mapInArrow(sift, docs.schema)


def substring_duplicates(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    source = texts(docs)
    prof = stored(profiles(docs), "window-profiles")
    first = prof.filter("n_words >= %d" % WINDOW).groupBy("sha").agg(F.min("doc_id").alias("rep"))
    reps = first.filter("rep is not null").select(F.col("rep").alias("doc_id"))
    one = first.filter("rep is not null").select(F.col("sha").alias("s"), "rep")
    held = prof.join(one, (prof["sha"] == one["s"]) & (prof["doc_id"] == one["rep"]))  # by both: copies don't meet in one task
    anchors = stored(held.select("doc_id", F.explode("anchors").alias("hash")), "window-anchors")
    cuts = sorted(set(reps.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    index, hits = FingerprintIndex(docs.sparkSession), None
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = anchors if lo is None else anchors.filter(F.col("doc_id") > lo)
        new = index.add(part if hi is None else part.filter(F.col("doc_id") <= hi))
        hits = new if hits is None else hits.unionAll(new)
    hits = stored(hits.distinct(), "lsm-hits")
    flagged = stored(anchors.join(hits, "hash").groupBy("doc_id").agg(F.collect_set("hash").alias("suspects")), "window-suspects")
    again = sieve(source, flagged, bloom_bits(flagged.count()))
    whole = stored(again.join(flagged, "doc_id"), "window-texts")
    at = covered_windows(whole).groupBy("doc_id").agg(F.collect_set("at").alias("at"))

    def make():
        def rows(x):
            cut = [remove_spans(t, a) for t, a in zip(x["text"], x["at"])]
            return {"doc_id": x["doc_id"], "n_removed": [n for n, _ in cut], "kept": [k for _, k in cut]}

        return rows

    cut = map_rows(whole.select("doc_id", "text").join(at, "doc_id"), make, "doc_id long, n_removed long, kept string")
    cut = stored(cut.groupBy("doc_id").agg(F.max_by("kept", "n_removed").alias("kept"), F.max("n_removed").alias("cut")), "window-cuts")
    copied = stored(prof.filter("n_words >= %d AND doc_id IS NOT NULL" % WINDOW).groupBy("sha").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1"), "window-copies")
    copies = prof.drop("anchors").join(copied.select("sha", "rep"), "sha", "left")  # hot texts: both sides are plain exchanges, which Spark splits
    copies = copies.withColumn("copy", F.coalesce(F.col("doc_id") > F.col("rep"), F.lit(False)))
    out = copies.join(cut, "doc_id", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"), F.when(F.col("copy"), none).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
ORACLE = {
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50),
     g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM s),
     f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
     c AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT g.doc_id, g.i FROM g JOIN f USING (h) WHERE g.doc_id > f.first) x, range(50) r(k)),
     p AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
     q AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
             CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(gone, j)) END AS kept FROM d LEFT JOIN p USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM q"""
}
