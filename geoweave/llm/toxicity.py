r"""Toxicity by subword-bag embeddings averaged into a linear softmax (op7), trained in numpy.

A word (white-space token, lower-cased, stripped of outer punctuation) is the mean of the embeddings of its character n-grams (3 to 5,
with word ends marked) and of itself; a document is the mean of its words; two logits follow by a linear layer of fixed scale. Embeddings
and layer are trained jointly with Adam, so that misspellings never seen in training share the n-gram vectors of what they resemble.
Words are found and their n-grams hashed to buckets as arrays of code points, CHUNK characters at a time.

Fit: on labelled rows that are not held out (crc32 of the doc_id's text mod 4 is 2 for held-out ones). At most ROWS rows of label 1 and
twice as many of label 0, those with the least hashes; of a text of over CHARS characters, a passage of CHARS at a place that is a hash of
its doc_id. Their loss is weighted back to the labels' shares among all training rows. Only text is ever an input. Without rows of both
labels, every score is the share of label 1 (0 without labels).

Scoring covers every whole text. A model is a scalar per bucket at that point (embedding times layer), BUCKETS doubles whatever the data.

Edge cases: null and empty texts score as a document without words (the bias alone); repeated rows and null doc_ids give a row each (a
null doc_id is not held out); labels that are null are not used; of texts that share a labelled doc_id the least is learned from; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import string
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, slices, table, texts

HELD_OUT, FOLDS, THRESHOLD = 2, 4, 0.3
ROWS, CHARS, BUCKETS, DIM = 2000, 20_000, 1 << 17, 6
STEPS, BATCH, RATE, SCALE, DECAY, MIN_DF, SEED = 400, 128, 0.02, 100.0, 1e-4, 3, 7
CHUNK, GRAMS = 1 << 18, (3, 4, 5)
EDGE = string.punctuation + "«»“”„’‘…¡¿"
#: White space of Unicode, as str.split() sees it.
SPACE = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE, _EDGE = np.zeros(0x3001, bool), np.zeros(0x3001, bool)
_SPACE[SPACE] = True
_EDGE[[ord(c) for c in EDGE]] = True
_A, _R, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)
_POW = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(4095, _R))), dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M
    return h ^ (h >> np.uint64(29))


def words_of(docs: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, where each word begins and ends (begin = end: it was all punctuation), and whose it is."""
    lower = [(d or "").lower() for d in docs]
    points = np.frombuffer(" ".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.minimum(points, 0x3001 - 2)  # neither space nor edge lies beyond, but for U+3000
    space = _SPACE[small] | (points == 0x3000)
    change = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    begin, end = change[::2], change[1::2]
    inner = np.flatnonzero(~space & ~_EDGE[small])
    lo, hi = np.searchsorted(inner, begin), np.searchsorted(inner, end)
    whole = hi > lo
    begin, end = np.where(whole, np.append(inner, 0)[np.minimum(lo, len(inner))], begin), np.where(whole, np.append(inner, 0)[hi - 1] + 1, begin)
    stops = np.cumsum(np.fromiter(map(len, lower), np.int64, len(lower)) + 1)
    return points, begin, end, np.searchsorted(stops, change[::2], side="right")


def chunks(begin: np.ndarray, end: np.ndarray):
    """Ranges of words of about CHUNK characters, or of one word."""
    sizes = np.cumsum(end - begin + 2)
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + CHUNK, side="right")))
        yield i, j
        i = j


def subwords(points: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Of words: (64-bit hash of each word, start of each in the marked characters, per n-gram size: hashes at each place and which count)."""
    size = end - begin + 2
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    ends = np.repeat(size, size)
    marked = points[np.minimum(np.repeat(begin, size) + place - 1, len(points) - 1)].astype(np.uint64)
    marked[first], marked[first + size - 1] = ord("<"), ord(">")
    c = _mix((marked + np.uint64(1)) * _A)
    words = _mix(np.add.reduceat(c * _POW[place & 4095], first) + np.uint64(1))
    grams = []
    for k in GRAMS:
        h = np.zeros(len(c), np.uint64)
        if len(c) >= k:
            total = c[: len(c) - k + 1].copy()
            for i in range(1, k):
                total += c[i : len(c) - k + 1 + i] * _POW[i]
            h[: len(total)] = _mix(total + np.uint64(k))
        grams.append((h, (place + k <= ends) & (ends > k)))
    return words, first, grams


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(20)) % np.uint64(buckets)


class Model:
    """score(texts) from a scalar per bucket and a bias."""

    def __init__(self, scalars: np.ndarray, bias: float):
        self.scalars, self.bias = np.asarray(scalars, np.float64), float(bias)

    def words(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The scalar of each word; 0 for those that were all punctuation."""
        out, n = np.zeros(len(begin)), len(self.scalars)
        for i, j in chunks(begin, end):
            whole, first, grams = subwords(points, begin[i:j], end[i:j])
            total, count = self.scalars[_bucket(whole, n)], np.ones(j - i)
            for h, valid in grams:
                total = total + np.add.reduceat(np.where(valid, self.scalars[_bucket(h, n)], 0.0), first)
                count += np.add.reduceat(valid.astype(np.float64), first)
            out[i:j] = np.where(end[i:j] > begin[i:j], total / count, 0.0)
        return out

    def word(self, token: str) -> float:
        points, begin, end, _ = words_of([token])
        return float(self.words(points, begin, end).sum())

    def score(self, docs: list[str | None]) -> np.ndarray:
        points, begin, end, doc = words_of(docs)
        n = np.bincount(doc, minlength=len(docs))
        # summed document by document, so that equal texts have equal scores whatever stands beside them
        sums = np.zeros(len(docs))
        if len(begin):
            some = np.flatnonzero(n)
            sums[some] = np.add.reduceat(self.words(points, begin, end), (np.cumsum(n) - n)[some])
        z = self.bias + sums / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _sum_rows(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Rows of values summed by at into (size, columns)."""
    return np.stack([np.bincount(at, values[:, j], size) for j in range(values.shape[1])], axis=1)


def _bags(docs: list[str], buckets: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """(of each document its distinct words and their shares; number of buckets of each word; the buckets of all words, word after word).
    CHUNK characters are read at a time."""
    index: dict[int, int] = {}
    bags, number, flat = [], array("q"), array("i")
    held = np.cumsum([len(d) for d in docs]) // CHUNK
    for i, j in zip(*(lambda cut: (cut[:-1], cut[1:]))(np.concatenate(([0], np.flatnonzero(np.diff(held)) + 1, [len(docs)])).tolist())):
        points, begin, end, doc = words_of(docs[i:j])
        ids = np.zeros(len(begin), np.int64)
        for a, b in chunks(begin, end):
            whole, _, grams = subwords(points, begin[a:b], end[a:b])
            keys, at, inverse = np.unique(np.where(end[a:b] > begin[a:b], whole, np.uint64(0)), return_index=True, return_inverse=True)
            fresh = [n for n, k in enumerate(keys.tolist()) if k not in index]
            for n in fresh:
                index[int(keys[n])] = len(index)
            ids[a:b] = np.array([index[k] for k in keys.tolist()], np.int64)[inverse]
            wanted = np.full(b - a, -1)
            wanted[at[fresh]] = np.arange(len(fresh))
            wanted[end[a:b] <= begin[a:b]] = -1
            owner = np.repeat(wanted, end[a:b] - begin[a:b] + 2)
            owners = np.concatenate([wanted[wanted >= 0], *(owner[valid & (owner >= 0)] for _, valid in grams)])
            hashes = np.concatenate([whole[wanted >= 0], *(h[valid & (owner >= 0)] for h, valid in grams)])
            flat.frombytes(_bucket(hashes, buckets)[np.argsort(owners, kind="stable")].astype(np.int32).tobytes())
            number.frombytes(np.bincount(owners, minlength=len(fresh)).astype(np.int64).tobytes())
        cuts = np.searchsorted(doc, np.arange(j - i + 1))
        for a, b in zip(cuts, cuts[1:]):
            words, times = np.unique(ids[a:b], return_counts=True)
            bags.append((words.astype(np.int32), (times / max(1, b - a)).astype(np.float32)))
    return bags, np.array(number, np.int64), np.array(flat, np.int32)


def fit(docs: list[str], labels: list[int], shares: tuple[float, float], dim: int = DIM, steps: int = STEPS, rate: float = RATE, buckets: int = BUCKETS, min_df: int = MIN_DF, scale: float = SCALE, decay: float = DECAY) -> Model:
    """docs and labels (0, 1) -> a Model. shares: of the labels among all training rows."""
    y = np.asarray(labels, np.int64)
    counts = np.bincount(y, minlength=2)
    if not counts.all():
        p = min(max(shares[1], 1e-6), 1 - 1e-6)
        return Model(np.zeros(buckets), float(np.log(p / (1 - p))))
    bags, number, flat = _bags(docs, buckets)
    begin = np.cumsum(number) - number
    spread = np.zeros(buckets, np.int64)  # documents that a bucket occurs in
    for words, _ in bags:
        n = number[words]
        spread[np.unique(flat[np.arange(n.sum()) + np.repeat(begin[words] - (np.cumsum(n) - n), n)])] += 1
    live = spread >= min_df
    sizes = np.maximum(1, number)  # a word is the mean over all its buckets, of which rare ones are zero
    kept = live[flat]
    first = np.concatenate(([0], np.cumsum(kept)))[np.concatenate(([0], np.cumsum(number)))]
    flat = flat[kept]
    rng = np.random.default_rng(SEED)
    emb = (rng.uniform(-1 / dim, 1 / dim, (buckets, dim)) * live[:, None]).astype(np.float32)
    layer, bias = rng.normal(0, 0.3, (dim, 2)), np.zeros(2)
    m, v = np.zeros_like(emb), np.zeros_like(emb)
    small = {"layer": [np.zeros_like(layer), np.zeros_like(layer)], "bias": [np.zeros(2), np.zeros(2)]}
    weight = (np.asarray(shares) / counts * len(y))[y]
    step = 0
    epochs = -(-steps // -(-len(y) // BATCH))
    for _ in range(epochs):
        for order in np.array_split(rng.permutation(len(y)), -(-len(y) // BATCH)):
            step += 1
            doc = np.repeat(np.arange(len(order)), [len(bags[i][0]) for i in order])
            word, share = np.concatenate([bags[i][0] for i in order]), np.concatenate([bags[i][1] for i in order])
            words, place = np.unique(word, return_inverse=True)
            lens = first[words + 1] - first[words]
            starts = np.cumsum(lens) - lens
            gram = flat[np.arange(lens.sum()) + np.repeat(first[words] - starts, lens)]
            owner = np.repeat(np.arange(len(words)), lens)
            used, slot = np.unique(gram, return_inverse=True)
            vec = _sum_rows(emb[gram], owner, len(words)) / sizes[words][:, None]
            mean = _sum_rows(vec[place] * share[:, None], doc, len(order))
            z = scale * mean @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(order)), y[order]] -= 1
            g = p * weight[order][:, None] / len(order)
            lr = rate * (1 - (step - 1) / (epochs * -(-len(y) // BATCH)))
            back = scale * g @ layer.T
            g_vec = _sum_rows(back[doc] * share[:, None], place, len(words)) / sizes[words][:, None]
            g_emb = _sum_rows(g_vec[owner], slot, len(used)) + decay * emb[used]
            m[used] = 0.9 * m[used] + 0.1 * g_emb
            v[used] = 0.999 * v[used] + 0.001 * g_emb**2
            emb[used] -= lr * (m[used] / (1 - 0.9**step)) / (np.sqrt(v[used] / (1 - 0.999**step)) + 1e-8)
            for name, grad in (("layer", scale * mean.T @ g), ("bias", g.sum(0))):
                a, b = small[name]
                a += 0.1 * (grad - a)
                b += 0.001 * (grad**2 - b)
                target = layer if name == "layer" else bias
                target -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Model((scale * emb @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def held_out(doc_id):
    fold = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))
    return F.coalesce(fold == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("y")).filter("y IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.filter(~held_out(F.col("doc_id")))
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    chosen = None
    for y in (0, 1):
        # twice as many clean rows; a few more than needed, as some have no text
        some = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(rows * (2 - y) * 6 // 5)
        chosen = some if chosen is None else chosen.unionAll(some)
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - CHARS, F.lit(1))).cast("int") + 1
    picked = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    picked = picked.withColumn("text", F.when(F.length("text") > CHARS, F.substr("text", place, F.lit(CHARS))).otherwise(F.col("text")))
    sample = []
    for y in (0, 1):
        sample += picked.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(rows * (2 - y)).collect()
    shares = (n.get(0, 0) / total, n.get(1, 0) / total) if total else (1.0, 0.0)
    return fit([r.text for r in sample], [r.y for r in sample], shares)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = train(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((np.array(model.scalars, np.float32), model.bias))  # BUCKETS floats: a fixed size

    def make():
        scalars, bias = sent.value
        model = Model(scalars, bias)
        return lambda x: {"doc_id": x["doc_id"], "score": model.score(x["text"])}

    out = map_rows(texts(docs), make, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, that score below the threshold: one scan, nothing shuffled."""
    model = train(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((np.array(model.scalars, np.float32), model.bias))

    def run(batches):
        scalars, bias = sent.value
        model = Model(scalars, bias)
        for b in batches:
            for part in slices(b):
                yield part.filter(pa.array(model.score(part.column("text").to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE: dict[str, str] = {}
