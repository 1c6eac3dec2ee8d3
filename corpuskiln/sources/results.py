"""The result relation: JSON-lines log, its reader, and the two ways to resolve reruns."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskiln.sources import files

SCHEMA = (
    "row_id string, cell_kind string, corpus_tier string, corpus_bytes long, corpus_sha256 string, tokenizer string, packing string, backend string, backend_profile string,"
    " backend_transport string, tokenization_layout string, chunk_size long, batch_chunks int, threads int, tokenize_time_s double, pack_time_s double, compress_time_s double,"
    " total_time_s double, throughput_mbps double, compressed_bytes long, ratio double, token_count long, peak_rss_mb double, decompress_time_s double, decompress_throughput_mbps double,"
    " round_trip_verified boolean, sha256_match boolean, token_count_match boolean, length_match boolean, tokenizer_startup_s double, error string, status string, started_utc string,"
    " finished_utc string, packed_bytes long, unsafe_boundary_cuts long, compress_sha256 string, wall_time_s double, corpus string, traceback string, logged_utc string"
)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't blank, parsed and as they are, with a number that orders a file's lines."""
    text = spark.read.text(path).select("value", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("source_file"), F.monotonically_increasing_id().alias("line"))
    return text.where(F.trim("value") != "").select(F.from_json("value", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), F.get_json_object("value", "$.row_id").alias("id"), "source_file", "line", "value")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON-lines files with their file and a number that orders a file's lines.

    Blank lines and lines that don't parse are left out.
    """
    return _lines(spark, path).where("id is not null").select("r.*", "source_file", "line")


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows as JSON lines; each task's file is committed whole or not at all.

    Names of files say nothing of their order, so all rows carry the time of the call.
    """
    now = datetime.now(UTC).isoformat(timespec="microseconds")
    rows.withColumn("logged_utc", F.lit(now)).write.mode("append").json(path)


def prune(spark: SparkSession, path: str, gone: Column, dry: bool = False) -> DataFrame:
    """Rewrites a log in place without the rows that ``gone`` holds for, and returns those.

    Kept lines stay as they are and in their order, also those that don't parse; blank lines
    go. The former log is at ``path`` + ``.bak`` afterwards. With ``dry`` nothing is written.
    """
    lines = _lines(spark, path).select("r.*", "id", "source_file", "line", "value")
    drops = F.coalesce(F.col("id").isNotNull() & gone, F.lit(False))
    dropped = [r.asDict() for r in lines.where(drops).select("row_id", "tokenizer", "packing", "backend", "backend_transport").collect()]
    if not dry:
        lines.where(~drops).orderBy("source_file", "line").select("value").write.mode("overwrite").text(path + ".new")
        files.swap(spark, path + ".new", path)
    return spark.createDataFrame(dropped, "row_id string, tokenizer string, packing string, backend string, backend_transport string")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def union_keys(*parts: DataFrame) -> DataFrame:
    """All rows under the union of their columns; what a part lacks is null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def latest(log: DataFrame) -> DataFrame:
    """The last line of each row and tier: by the time of appending, then by file and line."""
    times = [F.desc("logged_utc")] if "logged_utc" in log.columns else []
    last = Window.partitionBy("row_id", "corpus_tier").orderBy(*times, F.desc("source_file"), F.desc("line"))
    return log.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


def verified(rows: DataFrame) -> DataFrame:
    """Rows whose round trip is known to be right; null is not."""
    return rows.where(F.col("round_trip_verified").eqNullSafe(True))


def is_stale(prefix: str = "lzma", transport: str = "in_process_binding") -> Column:
    """Rows of a backend family and transport whose settings changed; xz binding runs ignored their threads."""
    return F.startswith("backend", F.lit(prefix)) & (F.col("backend_transport") == transport)


def stale(rows: DataFrame) -> DataFrame:
    return rows.where(is_stale())


def without_stale(rows: DataFrame) -> DataFrame:
    return rows.where(~is_stale())
