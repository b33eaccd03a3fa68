r"""License scans on a positional rare-token index (op2). DataFrame functions only.

Words: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the text with A-Z lower-cased. Document frequencies of the licence words (a fixed
vocabulary, the words of TEMPLATES) are counted over all documents. The index holds postings (word, template, place): of each template the
RARE words with the highest IDF, and the two rarest of its first key phrase. A file's words that have postings are looked up; each posting
says where the template would begin in the file, and beginnings that AGREE postings or more share are the candidates. They are verified
word by word: all key phrases of the template must stand at their places. All places count, however many; as two words of a key phrase
are always posted, none is missed.

Labels: the three base phrases, and the method's own (versions, further licences, their standard texts). Score: of the verified places,
the highest share of a template's IDF mass that stands in place; 0 without one.

Edge cases: null and empty texts have no words, null first and last word, empty labels and score 0; repeated rows and null doc_ids give
a row each; overlapping places all count; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lower_ascii, table, texts

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed values: (label, words of a licence notice or text, its mandatory key phrases). The first three have the base phrases.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by", "licensed under a creative commons attribution license", ("creative commons attribution",)),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    (
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "with or without modification"),
    ),
    (
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("copy modify and or distribute this software", "this permission notice appear in all copies"),
    ),
    (
        "apache-text",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ("apache license version 2 0", "except in compliance with the license"),
    ),
    (
        "gpl-text",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        ("you can redistribute it and or modify it", "general public license as published by the free software foundation"),
    ),
)
BASE, RARE, AGREE = 3, 4, 2


def words(text):
    return F.array_remove(F.split(lower_ascii(text), SPLIT), "")


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, text, _ in templates for w in text.split()})


def word_idf(docs: DataFrame, templates=TEMPLATES) -> dict[str, float]:
    """IDF of each licence word over all documents; as many rows come to the driver as the vocabulary has words."""
    vocab = vocabulary(templates)
    held = docs.select(F.explode(F.array_append(F.array_intersect(words("text"), F.lit(vocab)), "")).alias("w"))  # "" counts documents
    n = {r.w: r.n for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: math.log((n.get("", 0) + 1) / (n.get(w, 0) + 1)) + 1e-3 for w in vocab}


def _sql(x) -> str:
    if isinstance(x, str):
        return "'" + x + "'"
    if isinstance(x, float):
        return f"{x!r}D"
    if isinstance(x, dict):
        return "named_struct(" + ", ".join(f"'{k}', {_sql(v)}" for k, v in x.items()) + ")"
    if isinstance(x, list):
        return "array(" + ", ".join(map(_sql, x)) + ")"
    return str(x)


def key_places(text: str, keys: tuple[str, ...]) -> list[int]:
    """Where each key phrase first stands in a template."""
    t = text.split()
    return [next(i for i in range(len(t)) if t[i : i + len(k.split())] == k.split()) for k in keys]


#: Units of a template and of a begin in the longs that postings agree on.
_T, _A = "1099511627776L", "1048576L"


def build_index(idf: dict[str, float], templates=TEMPLATES) -> tuple[list[dict], list[dict]]:
    """(postings of the rare words, templates with their key phrases and IDF masses)."""
    postings, sheets = [], []
    for t, (label, text, keys) in enumerate(templates):
        n, at = text.split(), key_places(text, keys)
        rarest = lambda places, most: sorted(places, key=lambda i: (-idf[n[i]], i))[:most]
        first = range(at[0], at[0] + len(keys[0].split()))
        postings += [{"w": n[i], "t": t, "off": i} for i in sorted({*rarest(range(len(n)), RARE), *rarest(first, AGREE)})]
        sheets.append({"label": label, "at": at[0], "keys": [{"off": i, "words": k.split()} for i, k in zip(at, keys)], "words": n, "idf": [idf[w] for w in n], "mass": sum(idf[w] for w in n)})
    return postings, sheets


def scan(docs: DataFrame, templates=TEMPLATES, base: int = BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    source = texts(docs)
    postings, sheets = build_index(word_idf(source, templates), templates)
    rare = sorted({p["w"] for p in postings})
    w = source.select("doc_id", words("text").alias("ws"))
    hits = F.expr(f"CASE WHEN arrays_overlap(ws, {_sql(rare)}) THEN filter(transform(ws, (w, i) -> named_struct('w', w, 'i', i)), x -> x.w IN ({', '.join(map(_sql, rare))})) ELSE array() END")
    w = w.select("doc_id", "ws", F.size("ws").cast("long").alias("n_words"), hits.alias("hits"))
    # a posting's template and the word at which it would begin, as one long: equal ones agree
    begins = f"array_sort(flatten(transform(hits, h -> transform(filter({_sql(postings)}, p -> p.w = h.w), p -> p.t * {_T} + {_A} + h.i - p.off))))"
    w = w.select("doc_id", "ws", "n_words", F.expr(begins).alias("begins"))
    shared = f"transform(begins, (x, i) -> CASE WHEN get(begins, i + {AGREE - 1}) = x AND NOT get(begins, i - 1) <=> x THEN x END)"
    w = w.select("doc_id", "ws", "n_words", F.expr(f"transform(filter({shared}, x -> x IS NOT NULL), x -> named_struct('t', CAST(x div {_T} AS INT), 'a', CAST(x % {_T} - {_A} AS INT)))").alias("candidates"))
    keys = _sql([s["keys"] for s in sheets])
    stand = f"forall(element_at({keys}, c.t + 1), k -> c.a + k.off >= 0 AND slice(ws, greatest(c.a + k.off, 0) + 1, size(k.words)) = k.words)"
    w = w.select("doc_id", "ws", "n_words", F.expr(f"filter(candidates, c -> {stand})").alias("places"))
    starts = f"transform(filter(places, p -> p.t < {base}), p -> CAST(p.a + element_at({_sql([s['at'] for s in sheets])}, p.t + 1) AS BIGINT))"
    labels = lambda where: F.expr(f"concat_ws(',', array_sort(array_distinct(transform({where}, p -> element_at({_sql([s['label'] for s in sheets])}, p.t + 1)))))")
    sheet = _sql([{k: s[k] for k in ("words", "idf", "mass")} for s in sheets])
    share = f"""transform(transform(places, p -> named_struct('a', p.a, 'n', element_at({sheet}, p.t + 1))),
        q -> aggregate(sequence(0, size(q.n.words) - 1), 0D, (v, j) -> v + CASE WHEN get(ws, q.a + j) = q.n.words[j] THEN q.n.idf[j] ELSE 0D END) / q.n.mass)"""
    score = F.expr(f"CASE WHEN size(places) = 0 THEN 0D ELSE least(1D, array_max({share})) END")
    out = w.select("doc_id", "n_words", F.expr(starts).alias("starts"), labels(f"filter(places, p -> p.t < {base})").alias("base_labels"), labels("places").alias("labels"), F.round(score, 6).alias("score"))
    return out.select("doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"), "base_labels", "labels", "score")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same by plain list searches: every start of every template's first key phrase is tried."""
    rows = ", ".join(f"({t}, '{label}', string_split('{text}', ' '), {list(keys)!r}, {[len(k.split()) for k in keys]}, {key_places(text, keys)})" for t, (label, text, keys) in enumerate(TEMPLATES))
    return rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
     n(t, label, words, ks, kn, ko) AS (VALUES {rows}),
     v AS (SELECT DISTINCT unnest(words) AS w FROM n),
     idf AS (SELECT v.w, ln(((SELECT count(*) FROM d) + 1) / (count(x.doc_id) + 1)) + 0.001 AS idf
             FROM v LEFT JOIN (SELECT doc_id, unnest(list_distinct(ws)) AS w FROM d) x ON x.w = v.w GROUP BY v.w),
     p0 AS (SELECT doc_id, ws, n.*, unnest(list_filter(range(len(ws)), lambda i: array_to_string(ws[i + 1:i + kn[1]], ' ') = ks[1])) AS s
           FROM d, n WHERE contains(array_to_string(ws, ' '), ks[1])),
     p1 AS (SELECT *, s - ko[1] AS a FROM p0),
     p AS (SELECT * FROM p1 WHERE len(list_filter(range(1, len(ks) + 1), lambda j: a + ko[j] >= 0 AND array_to_string(ws[greatest(a + ko[j], 0) + 1:a + ko[j] + kn[j]], ' ') = ks[j])) = len(ks)),
     e AS (SELECT doc_id, t, s, a, label, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS j, ws FROM p),
     sc AS (SELECT doc_id, t, s, label, sum(CASE WHEN a + j >= 0 AND ws[a + j + 1] = e.w THEN idf ELSE 0 END) / sum(idf) AS share
            FROM e JOIN idf ON idf.w = e.w GROUP BY ALL),
     b AS (SELECT doc_id, count(*) FILTER (t < {BASE}) AS n_base, min(s) FILTER (t < {BASE}) AS first_word, max(s) FILTER (t < {BASE}) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (t < {BASE}) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
           FROM sc GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, round(CASE WHEN score IS NULL THEN 0 ELSE least(score, 1.0) END, 6) AS score FROM d LEFT JOIN b USING (doc_id)"""


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLE = {"op2_license_scan": _oracle()}
