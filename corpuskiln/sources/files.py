"""Single files and renames in whatever store a path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small UTF-8 file, replaced if it is there."""
    store, where = _at(spark, path)
    out = store.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def swap(spark: SparkSession, new: str, path: str) -> None:
    """Puts ``new`` in the place of ``path``, which becomes ``path`` + ``.bak`` (a former backup goes)."""
    store, target = _at(spark, path)
    backup, fresh = _at(spark, path + ".bak")[1], _at(spark, new)[1]
    store.delete(backup, True)
    if not store.rename(target, backup) or not store.rename(fresh, target):
        raise OSError(f"{path} could not be replaced; look at {path}.bak and {new}")
