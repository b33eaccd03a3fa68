"""What several training-data operators share: shared-folder checkpoints, typed inputs, Arrow row maps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.session import checkpoint_dir

#: White space of the word and normalisation rules: `[\x20\x09-\x0D]`.
SPACE_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_made: list[str] = []  # the folders that stored() has written and drop_stored() has not deleted


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the shared checkpoint folder and reread: smaller than a checkpoint, and columnar."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete what stored() has written: all but the first `since` folders and the last `keep`. What was read from them must be done with."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = _made[since : len(_made) - keep]
    for path in gone:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)
        _made.remove(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns only, so that extra columns can't clash."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), *(docs[c] for c in more))


def lower_ascii(col):
    return F.translate(col, UPPER, LOWER)


def map_rows(df: DataFrame, make: Callable[[], Callable[[list[dict[str, list]]], dict[str, list]]], schema: str) -> DataFrame:
    """mapInArrow over columns as Python lists: make() once a task, then its result once a slice of rows.

    A slice has at most SLICE_ROWS rows and about SLICE_CHARS characters of text, so memory is bounded by the longest text and not by the batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema) if df.sparkSession else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch):
                out = f({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


SLICE_ROWS, SLICE_CHARS = 2000, 4_000_000


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold at most SLICE_CHARS bytes, or a single row."""
    wide = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
    if not wide:
        yield batch
        return
    import numpy as np
    import pyarrow.compute as pc

    sizes = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in wide)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (held + n > SLICE_CHARS or i - start >= SLICE_ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a stored key of each row (doc_ids can be null or repeat), and the name of that column."""
    key = fresh(docs, "_row")
    return stored(docs.withColumn(key, F.monotonically_increasing_id()), "keyed-rows"), key


def kept_rows(rows: DataFrame, key: str, decisions: DataFrame) -> DataFrame:
    """The rows that decisions (key, kept) keep, without the key. The hash table is built of keys; texts are not sorted."""
    return rows.join(decisions.filter("kept").select(key).hint("shuffle_hash"), key, "left_semi").drop(key)


def repeated_rows(rows: DataFrame, key: str, decisions: DataFrame) -> DataFrame:
    """Each row as often as decisions (key, copies) say, without the key."""
    times = fresh(rows, "_times")
    wanted = decisions.filter("copies > 0").select(key, F.col("copies").cast("int").alias(times))
    held = rows.join(wanted.hint("shuffle_hash"), key)
    nth = fresh(held, "_nth")
    return held.withColumn(nth, F.explode(F.array_repeat(F.lit(0), F.col(times)))).select(*(rows[c] for c in rows.columns if c != key))
