r"""Mixing sources to target weights by pivotal dependent rounding (op10). DataFrame functions only.

Size: number of `[^\x20\x09-\x0D]+` in the text (null: 0). Sources in code-point order, null last, weigh 5, 2, 1, repeating, and share
150 % of all sizes; a target stops at twice its source's size and the excess is reshared by weight (water-filling, by running sums over
the sources: one row a source).

A document of a source is to be taken target / size-of-source times: a whole part, and a fraction p that is rounded. Pairs of
fractional documents exchange mass (p times size, so words are conserved exactly): mass moves one way or the other with the
probabilities that leave every p unchanged in expectation, until one of the two is integral. Only the other goes on.

Reduction tree: documents are dealt to buckets of about FAN within (source, size class); each bucket leaves one residual at most, the
residuals of a class meet in buckets of FAN again. At the root a source's classes are combined, large sizes first; about RESERVE
documents of each class wait for it. There each unit is paired with all that are smaller at once: they give or take its mass in
proportion, so that even one very long document becomes integral, and only the smallest is rounded on its own. A document so long
that the smaller ones can balance its mass in one direction only goes that way (there, nearness to the target goes before an unbiased
draw). No bucket grows with the table, and a hot source is just more buckets.
The random numbers are hashes of doc_ids and SEED: reruns and recomputed tasks agree.

Edge cases: documents of size 0 take 0; each repeated row is a document of its own; a null doc_id takes part; a source without words has
target 0; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

WEIGHTS, SHARE, CAP, FAN, RESERVE, CLASSES, SEED = (5, 2, 1), 1.5, 2.0, 64, 8, 4, 20240607
EPS = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    words = F.regexp_count(F.coalesce(docs["text"].cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    out = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), words.cast("long").alias("size"))
    return out.withColumn("class", F.when(F.col("size") > 0, F.floor(CLASSES * F.log2(F.col("size")))).otherwise(-1).cast("int"))


def targets(stats: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """stats (source, size) in parts -> src, source_size, target, one row a source."""
    per = stats.groupBy("source").agg(F.sum("size").alias("s"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.lit([float(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("c", cap * F.col("s"))
    fill = Window.partitionBy(F.lit(0)).orderBy(F.col("c") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    gone = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    per = per.withColumn("t", share * F.sum("s").over(whole)).withColumn("all_w", F.sum("w").over(whole))
    per = per.withColumn("level", (F.col("t") - gone("c")) / (F.col("all_w") - gone("w"))).withColumn("full", F.col("c") / F.col("w") <= F.col("level"))
    left = F.col("t") - F.sum(F.when(F.col("full"), F.col("c")).otherwise(0.0)).over(whole)
    rest = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(whole)
    per = per.withColumn("left", left).withColumn("rest", rest)
    return per.select(F.col("source").alias("src"), F.col("s").alias("source_size"), F.when(F.col("full"), F.col("c")).otherwise(F.col("w") * F.col("left") / F.col("rest")).alias("target"))


_UNIT = "struct<size:bigint,key:bigint,id:bigint,p:double>"
_DONE = "array<struct<id:bigint,size:bigint,extra:int>>"


def _done(unit: str, extra: str) -> str:
    return f"array(named_struct('id', {unit}.id, 'size', {unit}.size, 'extra', {extra}))"


def _with_p(unit: str, p: str) -> str:
    return f"named_struct('size', {unit}.size, 'key', {unit}.key, 'id', {unit}.id, 'p', {p})"


def _fold(units: str, seed: int) -> str:
    """SQL: fold an array of units into (cur: the residual or null, done: the integral ones)."""
    up = "least(c.size * (1 - c.p), x.size * x.p)"  # mass that can move to c
    down = "least(c.size * c.p, x.size * (1 - x.p))"
    case = f"""
      CASE WHEN t.u * (t.up + t.down) < t.down THEN
             CASE WHEN t.c.size * (1 - t.c.p) <= t.x.size * t.x.p
                  THEN named_struct('cur', {_with_p("t.x", "t.x.p - t.up / t.x.size")}, 'done', concat(t.done, {_done("t.c", "1")}))
                  ELSE named_struct('cur', {_with_p("t.c", "t.c.p + t.up / t.c.size")}, 'done', concat(t.done, {_done("t.x", "0")})) END
           ELSE
             CASE WHEN t.c.size * t.c.p <= t.x.size * (1 - t.x.p)
                  THEN named_struct('cur', {_with_p("t.x", "t.x.p + t.down / t.x.size")}, 'done', concat(t.done, {_done("t.c", "0")}))
                  ELSE named_struct('cur', {_with_p("t.c", "t.c.p - t.down / t.c.size")}, 'done', concat(t.done, {_done("t.x", "1")})) END
      END"""
    settle = f"""
      CASE WHEN r.cur.p < {EPS}D THEN named_struct('cur', CAST(NULL AS {_UNIT}), 'done', concat(r.done, {_done("r.cur", "0")}))
           WHEN r.cur.p > 1 - {EPS}D THEN named_struct('cur', CAST(NULL AS {_UNIT}), 'done', concat(r.done, {_done("r.cur", "1")}))
           ELSE r END"""
    u = f"pmod(xxhash64(c.key, x.key, {seed}), 9007199254740992) / 9007199254740992D"
    let = f"""element_at(transform(transform(transform(array(named_struct('c', a.cur, 'x', b, 'done', a.done)),
        s -> {_let("s", up, down, u)}), t -> {case}), r -> {settle}), 1)"""
    zero = f"named_struct('cur', CAST(NULL AS {_UNIT}), 'done', CAST(array() AS {_DONE}))"
    return f"aggregate({units}, {zero}, (a, b) -> CASE WHEN a.cur IS NULL THEN named_struct('cur', b, 'done', a.done) ELSE {let} END)"


def _let(s: str, up: str, down: str, u: str) -> str:
    of = lambda x: x.replace("c.", f"{s}.c.").replace("x.", f"{s}.x.")
    return f"named_struct('c', {s}.c, 'x', {s}.x, 'done', {s}.done, 'up', {of(up)}, 'down', {of(down)}, 'u', {of(u)})"


def _root(units: str, seed: int) -> str:
    """SQL: round a source's last units, each against the pool of those after it. The pool's fractions are kept as the map
    p -> a * p + b, its mass as m and its size as s, so a unit costs the same however many follow."""
    u = f"pmod(xxhash64(t.x.key, {seed}), 9007199254740992) / 9007199254740992D"
    full_up, full_down = f"t.up >= t.x.size * (1 - t.p) - {EPS}D", f"t.down >= t.x.size * t.p - {EPS}D"
    rises = f"CASE WHEN {full_up} AND {full_down} THEN t.u * (t.up + t.down) < t.down WHEN {full_up} THEN true WHEN {full_down} THEN false ELSE t.x.size * (1 - t.p) - t.up <= t.x.size * t.p - t.down END"
    lets = [
        "q -> named_struct('z', q.z, 'x', q.x, 'p', least(1D, greatest(0D, q.z.a * q.x.p + q.z.b)))",
        "q -> named_struct('z', q.z, 'x', q.x, 'p', q.p, 'm', greatest(0D, q.z.m - q.p * q.x.size), 's', q.z.s - q.x.size)",
        f"t -> named_struct('z', t.z, 'x', t.x, 'p', t.p, 'm', t.m, 's', t.s, 'u', {u}, 'up', least(t.x.size * (1 - t.p), t.m), 'down', least(t.x.size * t.p, greatest(0D, t.s - t.m)))",
        f"""t -> CASE WHEN t.p < {EPS}D OR t.p > 1 - {EPS}D OR t.up + t.down < {EPS}D
              THEN named_struct('x', t.x, 'z', t.z, 'p', t.p, 'rose', t.p >= 0.5D, 'a', t.z.a, 'b', t.z.b, 'm', t.m, 's', t.s)
            WHEN {rises}
              THEN named_struct('x', t.x, 'z', t.z, 'p', t.p + t.up / t.x.size, 'rose', true, 'a', t.z.a * (1 - t.up / t.m), 'b', t.z.b * (1 - t.up / t.m), 'm', t.m - t.up, 's', t.s)
            ELSE named_struct('x', t.x, 'z', t.z, 'p', t.p - t.down / t.x.size, 'rose', false, 'a', t.z.a * (1 - t.down / (t.s - t.m)), 'b', t.z.b * (1 - t.down / (t.s - t.m)) + t.down / (t.s - t.m), 'm', t.m + t.down, 's', t.s)
            END""",
        f"""t -> named_struct('a', t.a, 'b', t.b, 'm', t.m, 's', t.s, 'done', concat(t.z.done, array(named_struct('id', t.x.id, 'size', t.x.size, 'extra',
              CASE WHEN t.p < {EPS}D THEN 0 WHEN t.p > 1 - {EPS}D THEN 1
                   WHEN t.s > 0 THEN CAST(t.rose AS INT)
                   ELSE CAST(pmod(xxhash64(t.x.key, {seed + 1}), 9007199254740992) / 9007199254740992D < t.p AS INT) END))))""",
    ]
    step = "array(named_struct('z', z, 'x', x))"
    for let in lets:
        step = f"transform({step}, {let})"
    total = lambda of: f"aggregate({units}, 0D, (v, x) -> v + {of})"
    zero = f"named_struct('a', 1D, 'b', 0D, 'm', {total('x.size * x.p')}, 's', {total('CAST(x.size AS DOUBLE)')}, 'done', CAST(array() AS {_DONE}))"
    return f"aggregate({units}, {zero}, (z, x) -> element_at({step}, 1))"


def _level(units: DataFrame, keys: list[str], seed: int, fold=_fold) -> DataFrame:
    """One level of the tree: each bucket's fold, stored."""
    out = units.groupBy("source", *keys).agg(F.sort_array(F.collect_list("unit"), asc=False).alias("units"))
    return stored(out.select("source", *keys, F.expr(fold("units", seed)).alias("f")), "mix-level")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, fan: int = FAN, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row."""
    rows = stored(sizes(docs), "mix-sizes")
    stats = stored(rows.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("size")), "mix-stats")
    aim = targets(stats, weights, share, cap)
    plan = stats.select(F.col("source").alias("so"), F.col("class").alias("cl"), "n", F.ceil(F.col("n") / fan).alias("buckets"))
    plan = plan.join(aim, plan["so"].eqNullSafe(aim["src"])).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = stored(plan.withColumn("base", F.floor(F.col("rate") + EPS).cast("int")).withColumn("p", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0))), "mix-plan")
    depth = math.ceil(math.log(max(2, plan.agg(F.max("buckets")).head()[0] or 1), fan))
    of = rows.join(plan, rows["source"].eqNullSafe(plan["so"]) & (rows["class"] == plan["cl"]))
    moving = (F.col("size") > 0) & (F.col("p") > EPS)
    key = F.xxhash64("doc_id", F.lit(seed))
    waits = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.col("n")) < RESERVE
    unit = F.struct("size", key.alias("key"), F.col("doc_id").alias("id"), "p").alias("unit")
    units = of.filter(moving).select("source", "class", F.pmod(F.xxhash64("doc_id", F.lit(seed + 2)), F.col("buckets")).alias("bucket"), waits.alias("waits"), unit)
    levels = [_level(units.filter(~F.col("waits")), ["class", "bucket"], seed)]
    left = lambda: levels[-1].filter("f.cur is not null")
    for k in range(depth):
        levels.append(_level(left().select("source", "class", F.expr(f"bucket div {fan}").alias("bucket"), F.col("f.cur").alias("unit")), ["class", "bucket"], seed + 2 + k))
    last = left().select("source", F.col("f.cur").alias("unit")).unionAll(units.filter("waits").select("source", "unit"))
    levels.append(_level(last, [], seed - 2, _root))
    decided = None
    for level in levels:
        d = level.select("source", F.explode("f.done").alias("d")).select("source", "d.id", "d.size", "d.extra")
        decided = d if decided is None else decided.unionAll(d)
    fixed = of.filter(~moving).select("source", F.col("doc_id").alias("id"), "size", F.lit(0).alias("extra"))
    rates = plan.select(F.col("so"), "source_size", "target", "base").dropDuplicates(["so"])
    out = decided.unionAll(fixed).join(rates, F.col("source").eqNullSafe(F.col("so")))
    copies = F.col("base") + F.col("extra")
    return out.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op10_mixing": op10_mixing}
ORACLE: dict[str, str] = {}
