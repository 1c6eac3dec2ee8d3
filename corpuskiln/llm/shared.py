"""Session helpers of the training-data operators."""

from __future__ import annotations

import binascii
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


ARROW_ROWS, ARROW_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
TEXT_ROWS, TEXT_BYTES = 512, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the rows and bytes of an Arrow batch to what texts allow.

    A batch holds whole texts, in the JVM and in the Python worker; Spark's defaults are
    10,000 rows of any size. Plans read these settings when they run, so they stay lowered
    for the session (never raised).
    """
    for name, most in ((ARROW_ROWS, TEXT_ROWS), (ARROW_BYTES, TEXT_BYTES)):
        if not 0 < _bytes(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))


def _bytes(value: str) -> int:
    """A setting's number; sizes may carry a unit."""
    digits = value.rstrip("bBkKmMgGtT")
    unit = value[len(digits) :].lower().rstrip("b")
    return int(digits or 0) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """The id (as long) and text (as string) of documents, for tasks that read batches of them."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, path: str):
    """Hadoop's path and the file system that it lies in."""
    context = spark.sparkContext
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(context._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """The same rows, with lineage cut by a table in the shared checkpoint folder.

    The folder comes from the session; only where none is set (tests, a local run) a
    folder of our own is set on the context. The table goes when the driver's JVM ends, or
    with ``discard`` as soon as nothing reads it any more.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_DIR, None) or context.getConf().get(CHECKPOINT_DIR)
    if root is None:
        if not context.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that driver and executors share")
        root = "/tmp/corpuskiln-checkpoints"
    path = f"{root.rstrip('/')}/corpuskiln-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, files = _files(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote and that no later step reads."""
    for table in tables:
        at, files = _files(table.sparkSession, table.cut_path)
        files.delete(at, True)


HEAVY_KEYS = 1 << 16


def heavy_keys(counts: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """The keys of (key, count) with a ``HEAVY_KEYS``-th part of all rows or more, to broadcast.

    So they are at most ``HEAVY_KEYS`` however many keys there are. ``total``: the rows, if
    ``counts`` leaves out light keys.
    """
    if total is None:
        total = counts.agg(F.sum("count")).first()[0] or 0
    return F.broadcast(cut(counts.where(F.col("count") > max(64, total // HEAVY_KEYS)).select(key)))


def join_dealt(rows: DataFrame, facts: DataFrame, key: str, heavy: DataFrame, how: str = "inner") -> DataFrame:
    """``rows.join(facts, key, how)`` for facts with one row a key, without gathering a heavy key.

    Rows of heavy keys stay where they are and meet their facts by broadcast; only the
    others are shuffled.
    """
    known = F.broadcast(facts.join(heavy, key, "left_semi"))
    still = rows.join(heavy, key, "left_semi").join(known, key, how)
    return still.unionByName(rows.join(heavy, key, "left_anti").join(facts, key, how))


def crc_bucket(doc_id, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``."""
    return F.crc32(doc_id.cast("string")) % modulus


def crc_of(doc_id: int | None, modulus: int) -> int | None:
    return None if doc_id is None else binascii.crc32(str(doc_id).encode()) % modulus


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_split(spark: SparkSession) -> int:
    """How many parts a key that may hold a large share of all rows is dealt to."""
    return max(8, 2 * partitions(spark))
