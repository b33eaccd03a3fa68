"""Name search and geocoding over tables of names and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoweave.functions import text

#: Default limits.
LIMIT, GEOCODE_LIMIT = 50, 25


def with_buckets(names: DataFrame) -> DataFrame:
    """Adds `folded` and `bucket`: write the result with partitionBy("bucket") and searches read two partitions of it."""
    return names.withColumn("folded", text.fold_name(F.col("name"))).withColumn("bucket", text.bucket(F.col("folded")))


def search_indexed(index: DataFrame, query: str, limit: int = LIMIT) -> DataFrame:
    """Matches of the query in its buckets (a partition filter), best score first, then the name in byte order, then fid."""
    q = text.fold(query.strip())
    hits = index.filter(F.col("bucket").isin(text.probe_buckets(query))).withColumn("score", text.match_score(F.col("folded"), F.lit(q))).filter("score IS NOT NULL")
    return hits.orderBy(F.desc("score"), "name", "fid").limit(limit if q else 0)


def search_all(names: DataFrame, query: str, limit: int = LIMIT, scan_order: tuple[str, ...] | None = None) -> DataFrame:
    """Matches in the whole table. With scan_order, only the first `limit` matches in that order are ranked."""
    q = text.fold(query.strip())
    hits = names.withColumn("score", text.match_score(text.fold_name(F.col("name")), F.lit(q))).filter("score IS NOT NULL")
    if scan_order:
        hits = hits.orderBy(*scan_order).limit(limit)
    return hits.orderBy(F.desc("score"), "name", "fid").limit(limit if q else 0)


def search_national(index: DataFrame, query: str, limit: int = LIMIT) -> DataFrame:
    """The best `limit` matches of each state."""
    q = text.fold(query.strip())
    hits = index.filter(F.col("bucket").isin(text.probe_buckets(query))).withColumn("score", text.match_score(F.col("folded"), F.lit(q))).filter("score IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("state").orderBy(F.desc("score"), "name", "fid"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= limit)


def match_addresses(addresses: DataFrame, query: str, limit: int = GEOCODE_LIMIT) -> DataFrame:
    """Leading digits are the exact house number, the rest is part of the street. Streets that begin with it come first, then
    shorter ones (bytes), then input order. Records without a position don't count."""
    q = query.strip().lower()
    digits = q[: len(q) - len(q.lstrip("0123456789"))]
    street = q[len(digits) :].strip()
    hits = addresses.filter("lat IS NOT NULL AND lon IS NOT NULL")
    if digits:
        hits = hits.filter(F.lower("housenumber") == digits)
    if street:
        hits = hits.filter(F.lower("street").contains(street))
    return hits.orderBy(F.desc(F.lower("street").startswith(street)), F.octet_length("street"), "fid").limit(limit if q else 0)


def find_address(addresses: DataFrame, number: str, street: str) -> DataFrame:
    """The exact folded house number, and the folded street as a part."""
    same = text.fold_name(F.col("housenumber")) == text.fold(number.strip())
    return addresses.filter(same & text.fold_name(F.col("street")).contains(text.fold(street.strip())))
