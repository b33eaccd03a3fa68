"""A training corpus from `documents`: toxic documents go, exact copies go, of near-duplicates one stays, sources are mixed to their
target weights (rows repeat), and the result is tokenised. Each stage is an operator of geoweave.llm; its rows are written as Parquet and
read again as the next one's input. All stages but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.llm import bpe, common, exact_dedup, mixing, simhash, toxicity
from geoweave.llm.common import drop_stored, kept_rows, keyed, repeated_rows, stored, table

#: Scores of a model trained in numpy can't be had from SQL.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = keyed(docs)
    return kept_rows(rows, key, exact_dedup.exact_duplicates(rows, key))


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = keyed(docs)
    return kept_rows(rows, key, simhash.near_duplicates(rows, key=key))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = keyed(docs)
    found = mixing.mix(rows.withColumn("doc_id", F.col(key)))  # what is rounded is a row
    return repeated_rows(rows, key, found.select(F.col("doc_id").alias(key), "copies"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_digests(docs)


STAGES = [("toxicity", clean), ("exact dedup", distinct), ("simhash near-dedup", dissimilar), ("mixing", mixed), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are stored before the next begins; then what it and the stage before have stored on the way is deleted."""
    docs = table(spark, sf_dir, "documents")
    begun = len(common._made)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{i}")
            drop_stored(spark, begun, keep=1)
    return docs
