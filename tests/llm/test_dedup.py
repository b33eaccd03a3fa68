import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from geoweave.llm import exact_dedup, simhash, substring_dedup
from geoweave.operators.components import components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed"]) for _ in range(n))


def brute_exact(texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        for i, _ in members:
            out.append((i, best, len(members), i == best and i is not None or len(members) == 1, hashlib.sha256(norm.encode()).hexdigest()))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def test_exact_edge_cases(docs, empty, edge_texts):
    got = [tuple(r) for r in exact_dedup.exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=key) == sorted(brute_exact(edge_texts), key=key)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_exact_hot_group(make):
    rng = random.Random(5)
    texts = [(i, "same  text" if i % 3 == 0 else f"text {rng.randrange(150)}") for i in range(600)]
    got = [tuple(r) for r in exact_dedup.exact_duplicates(make(texts)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got) == sorted(brute_exact(texts))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), min_size=1, max_size=60), st.integers(0, 30))
def test_rice_round_trip(gaps, k):
    g = np.array([x % (1 << (k + 6)) for x in gaps], np.uint64)
    assert (exact_dedup.rice_decode(exact_dedup.rice_encode(g, k), len(g), k) == g).all()


def test_rice_cut_short():
    blob = exact_dedup.rice_encode(np.array([5, 9, 1000], np.uint64), 3)
    with pytest.raises((ValueError, IndexError)):
        exact_dedup.rice_decode(blob[:2], 3, 3)


def test_owner_bitmaps():
    a, b = np.array([3, 3, 10, 2**63 + 5], np.uint64), np.array([10, 11], np.uint64)
    sent = [exact_dedup.send(x) for x in (a, b)]
    maps = exact_dedup.owner_bitmaps([(k, int(v[0]), len(v), blob, np.packbits(again).tobytes()) for k, blob, v, again in sent])
    bits = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(s[2])).tolist() for m, s in zip(maps, sent)]
    assert bits == [[1, 1, 0], [1, 0]]


def slow_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_simhash(texts):
    fps = [slow_fingerprint(t) for _, t in texts]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(texts):
        least[find(i)].append(d)
    return [(d, f"{fps[i]:016x}", min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(texts)]


def test_simhash_edge_cases(docs, empty, edge_texts):
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=key) == sorted(brute_simhash(edge_texts), key=key)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_chains_of_near_fingerprints(spark):
    """Chains whose neighbours differ in one or two bits, a dense ball, and fingerprints three bits away."""
    rng = random.Random(3)
    fps, x = [], 0x0123456789ABCDEF
    for _ in range(120):
        fps.append(x)
        for _ in range(rng.choice((1, 2))):
            x ^= 1 << rng.randrange(64)
    ball = rng.getrandbits(64)
    fps += [ball ^ (1 << i) for i in range(64)] + [ball ^ 0b111 << 40]
    far = rng.getrandbits(64)
    fps += [far, far ^ 0b10101]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    root = {f: f for f in signed}
    changed = True
    while changed:
        changed = False
        for a in signed:
            for b in signed:
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2 and root[b] < root[a]:
                    root[a], changed = root[b], True
    assert {f: got.get(f, f) for f in signed} == root


def test_simhash_near_copies(make):
    rng = random.Random(8)
    base = prose(rng, 400)
    texts = [(i, base if i % 4 else base + " " + rng.choice(WORDS)) for i in range(40)] + [(100 + i, prose(rng, 30)) for i in range(40)]
    got = [tuple(r) for r in simhash.near_duplicates(make(texts)).collect()]
    assert sorted(got) == sorted(brute_simhash(texts))


def brute_substring(texts, window=50):
    first, docs = {}, [(i, [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in texts]
    for i, w in docs:
        for p in range(len(w) - window + 1 if i is not None else 0):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in docs:
        gone = set()
        for p in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[p : p + window])] < i:
                gone |= set(range(p, p + window))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_edge_cases(docs, empty, edge_texts):
    got = [tuple(r) for r in substring_dedup.substring_duplicates(docs).collect()]
    assert sorted(got, key=key) == sorted(brute_substring(edge_texts), key=key)
    assert substring_dedup.substring_duplicates(empty).count() == 0


def test_substring_shared_passages(make):
    rng = random.Random(2)
    passages = [prose(rng, n) for n in (49, 50, 51, 80, 200)]
    texts = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(5, 60))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), prose(rng, rng.randrange(0, 20))]
        texts.append((rng.randrange(10**6) * 100 + i, "  ".join(parts)))
    texts += [(i + 5, passages[3]) for i in range(20)] + [(99999999, "\n".join([passages[4]] * 2))]
    got = [tuple(r) for r in substring_dedup.substring_duplicates(make(texts)).collect()]
    assert sorted(got) == sorted(brute_substring(texts))


def test_index_compacts_reopens_and_remembers(spark, tmp_path):
    path = "file://" + str(tmp_path / "index")
    found, batches = [], ([(1, 1), (2, 1)], [(2, 2), (3, 2)], [(4, 3), (4, 4)], [(1, 5), (3, 5)])
    for k, rows in enumerate(batches):
        index = substring_dedup.FingerprintIndex(spark, path, fanout=2, buckets=3)  # opened anew for each batch
        assert index.version == (k if k < 3 else 4) and index.buckets == 3
        found.append(sorted(r.hash for r in index.add(spark.createDataFrame(rows, "hash long, doc_id long")).collect()))
        for name in index.runs:
            spark.sql(f"DROP TABLE {name}")  # as in another session, whose catalog is empty
    assert found == [[], [2], [4], [1, 3]] and len(index.runs) == 2
    index = substring_dedup.FingerprintIndex(spark, path)
    index.compact()
    assert sorted(tuple(r) for r in index.run(index.runs[0]).collect()) == [(1, 1, 5), (2, 1, 2), (3, 2, 5), (4, 3, 4)]


def test_runs_merge_join_without_a_shuffle(spark):
    index = substring_dedup.FingerprintIndex(spark)
    for k in (0, 1):
        index.add(spark.range(2000).selectExpr(f"id * 2 + {k} AS hash", "id AS doc_id"))
    a, b = map(index.run, index.runs)
    joined = a.join(b.select("hash").hint("merge"), "hash")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_window_minima_match_naive():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 200).astype(np.uint64)
    for span in (1, 2, 26, 31, 64):
        assert (substring_dedup.window_minima(x, span) == [x[i : i + span].min() for i in range(len(x) - span + 1)]).all()


def test_gram_hashes_depend_on_the_gram_only():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 80).astype(np.uint64)
    h = substring_dedup.gram_hashes(np.concatenate((x, x[5:40])), 25)
    assert (h[5:16] == h[80:91]).all() and len(np.unique(h)) == len(h) - 11


def test_word_hashes_ignore_what_follows():
    for seed in range(40):
        words = prose(random.Random(seed), 50).split()
        text, longer = " ".join(words), " ".join(words + ["more"])
        ends = substring_dedup.window_anchors(text)[3]
        assert ends[0] == substring_dedup.window_anchors(longer)[3][0]
        data, starts, stops = substring_dedup.normal_words(longer)
        whole = substring_dedup.word_hashes(data, starts, stops)
        assert all((substring_dedup.word_hashes(data, starts, stops, step) == whole).all() for step in (1, 7, 50))
        assert (substring_dedup.word_hashes(*substring_dedup.normal_words(text)) == whole[:-1]).all()


def test_substring_passages_at_a_documents_end(make):
    rng, texts = random.Random(11), []
    for k in range(40):
        passage = prose(rng, 50)
        texts += [(2 * k, prose(rng, 20) + " " + passage), (2 * k + 1, prose(rng, 9) + " " + passage + " " + prose(rng, 30))]
    got = [tuple(r) for r in substring_dedup.substring_duplicates(make(texts)).collect()]
    assert sorted(got, key=key) == sorted(brute_substring(texts), key=key)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100), (200, 50), (50, 60)]
    got = Counter(r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {0: 31, 50: 3}
