"""Corpus records, their reproducible order and nested size tiers.

Order is data here: it comes from a seeded hash of the id, and running totals over it are
made in two levels (hash buckets, then rows in a bucket), so that no task orders the
whole corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskiln.plans import dims

SEED = 20240517
BUCKET_DIGITS = 3


def record(text: Column) -> Column:
    """A document as the corpus holds it: a line feed at its end, then an empty line."""
    return F.concat(F.when(F.endswith(text, F.lit("\n")), text).otherwise(F.concat(text, F.lit("\n"))), F.lit("\n\n"))


def record_bytes(text: Column) -> Column:
    """Bytes of the record, without building it."""
    return (F.octet_length(text) + F.when(F.endswith(text, F.lit("\n")), 2).otherwise(3)).cast("long")


def shuffle_key(doc_id: Column, seed: int = SEED) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256)


def running_totals(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per document its record's bytes and the bytes of all records before it."""
    sized = docs.select("doc_id", shuffle_key(F.col("doc_id"), seed).alias("key"), record_bytes(F.col("text")).alias("record_bytes"))
    sized = sized.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # At most 16^BUCKET_DIGITS rows, whatever the input's size.
    totals = sized.groupBy("bucket").agg(F.sum("record_bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    whole = before(Window.orderBy("bucket"))
    bases = totals.select("bucket", F.coalesce(F.sum("bytes").over(whole), F.lit(0)).alias("base"), F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("rank"))
    inner = Window.partitionBy("bucket").orderBy("key", "doc_id")
    local = sized.withColumn("inside", F.coalesce(F.sum("record_bytes").over(before(inner)), F.lit(0))).withColumn("place", F.row_number().over(inner))
    return local.join(bases, "bucket").select(
        "doc_id", (F.col("rank") + F.col("place")).cast("long").alias("ord"), "record_bytes", (F.col("base") + F.col("inside")).cast("long").alias("bytes_before")
    )


def tier_members(docs: DataFrame, tiers: DataFrame, seed: int = SEED) -> DataFrame:
    """Documents of each tier: those that begin before its target; unreached tiers are left out."""
    placed = running_totals(docs, seed)
    total = placed.agg(F.coalesce(F.sum("record_bytes"), F.lit(0)).alias("total"))
    reached = tiers.crossJoin(F.broadcast(total)).where("total >= target_bytes").drop("total")
    # Five literal rows at most.
    return placed.join(F.broadcast(reached), F.col("bytes_before") < F.col("target_bytes"))


def tier_summary(docs: DataFrame, tiers: DataFrame, seed: int = SEED) -> DataFrame:
    return tier_members(docs, tiers, seed).groupBy("corpus_tier", "target_bytes", "tier_rank").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("record_bytes").alias("bytes"), F.max("bytes_before").alias("last_start")
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small(spark: SparkSession) -> DataFrame:
    return dims.small_tiers(spark)


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of a list file, trimmed; an error if there are none."""
    lines = spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")
    if not lines.head(1):
        raise ValueError(f"no paths in {path}")
    return lines


def corpus_identity(spark: SparkSession, docs: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Tier, bytes and digest: from the metadata relation where it has them, else computed.

    The computed digest is over the sorted digests of hash buckets, so it doesn't depend on
    partitions and needs no ordered pass over the corpus.
    """
    rows = docs.select(shuffle_key(F.col("doc_id")).alias("key"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), record_bytes(F.col("text")).alias("bytes"))
    buckets = rows.groupBy(F.substring("key", 1, BUCKET_DIGITS).alias("bucket")).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("key", "sha"))), ""), 256).alias("sha"), F.sum("bytes").alias("bytes")
    )
    own = buckets.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("bucket", "sha"))), ""), 256).alias("manifest_sha256"), F.sum("bytes").alias("counted_bytes"))
    if meta is None:
        return own.select(F.lit(None).cast("string").alias("tier"), F.col("counted_bytes").alias("bytes"), F.col("manifest_sha256").alias("sha256"))
    return own.crossJoin(F.broadcast(meta)).select("tier", F.coalesce("bytes", "counted_bytes").alias("bytes"), F.coalesce("sha256", "manifest_sha256").alias("sha256"))


def write_tiers(spark: SparkSession, docs: DataFrame, tiers: DataFrame, out: str, seed: int = SEED) -> None:
    """Builds the corpus: ``records`` by tier in their order, and ``meta``, one line a tier.

    Documents without text are left out and counted as skipped; tiers that the documents don't
    reach are not written.
    """
    known = docs.where("text is not null")
    members = tier_members(known, tiers, seed).join(known.select("doc_id", "text"), "doc_id")
    rows = members.select("corpus_tier", "ord", record(F.col("text")).alias("record"))
    rows.repartitionByRange("corpus_tier", "ord").sortWithinPartitions("corpus_tier", "ord").write.mode("overwrite").partitionBy("corpus_tier").parquet(f"{out}/records")
    skipped = docs.where("text is null").agg(F.count(F.lit(1)).alias("skipped"))
    found = tier_digests(spark.read.parquet(f"{out}/records")).join(F.broadcast(tiers.select("corpus_tier", "target_bytes")), "corpus_tier").crossJoin(F.broadcast(skipped))
    fixed = found.withColumns({"shuffle_seed": F.lit(seed), "doc_separator": F.lit("\n\n"), "built_utc": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")})
    fixed.coalesce(1).write.mode("overwrite").json(f"{out}/meta")


def tier_digests(records: DataFrame) -> DataFrame:
    """Documents, bytes and a digest of each tier, and whether every record ends as it must.

    The digest is over those of runs of 65,536 places, so no task holds a tier.
    """
    runs = records.groupBy("corpus_tier", F.floor(F.col("ord") / 65536).alias("run")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("record")).alias("b"), F.bool_and(F.endswith("record", F.lit("\n\n"))).alias("e"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.sha2(F.col("record").cast("binary"), 256).alias("sha")))), lambda x: x["sha"]), ""), 256).alias("d"),
    )
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "d"))), lambda x: x["d"]), ""), 256)
    return runs.groupBy("corpus_tier").agg(F.sum("n").alias("documents"), F.sum("b").alias("bytes"), whole.alias("sha256"), F.bool_and("e").alias("ends_right"))


def verify_tiers(spark: SparkSession, out: str) -> DataFrame:
    """A built corpus against its metadata: ``ok`` for each tier that either of them names."""
    now = tier_digests(spark.read.parquet(f"{out}/records"))
    said = spark.read.schema("corpus_tier string, target_bytes long, documents long, bytes long, sha256 string").json(f"{out}/meta")
    same = [F.col(f"now.{c}").eqNullSafe(F.col(f"said.{c}")) for c in ("documents", "bytes", "sha256")]
    both = now.alias("now").join(said.alias("said"), "corpus_tier", "full")
    ok = F.coalesce(same[0] & same[1] & same[2] & F.col("now.ends_right") & (F.col("now.bytes") >= F.col("said.target_bytes")), F.lit(False))
    return both.select("corpus_tier", "now.documents", "now.bytes", "now.sha256", ok.alias("ok"))
