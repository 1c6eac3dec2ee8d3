"""Axes of the experiment matrix as small literal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names, codes, vocabulary sizes and compressor settings of the experiment.
TOKENIZERS = ("none", "o200k_base", "cl100k_base", "r50k_base", "p50k_base")
VOCABULARY = {"none": 0, "o200k_base": 200019, "cl100k_base": 100277, "r50k_base": 50257, "p50k_base": 50281}
PACKINGS = ("raw_utf8", "leb128", "fixed_u16")
PACKING_CODE = {"raw_utf8": 0, "leb128": 1, "fixed_u16": 2}
MAX_ID = {"leb128": 2097151, "fixed_u16": 65535}
#: backend: family, profile, dictionary MiB, level, long window, xz options
BACKENDS = {
    "lzma_extreme": ("lzma", "max", 64, None, None, "preset=9e,lc=3,lp=0,pb=0,dict=64MiB"),
    "lzma_fast": ("lzma", "fast", 32, None, None, "preset=6,lc=3,lp=0,pb=0,dict=32MiB"),
    "lzma_tuned_lp1pb1": ("lzma", "max", 64, None, None, "preset=9e,lc=1,lp=1,pb=1,dict=64MiB"),
    "zstd_19": ("zstd", "max", None, 19, 27, None),
    "zstd_12": ("zstd", "fast", None, 12, 27, None),
    "zstd_22_long": ("zstd", "max", None, 22, 31, None),
    "gzip_9": ("gzip", "fast", None, 9, None, None),
    "bz2_9": ("bz2", "fast", None, 9, None, None),
}
LAYOUTS = ("library_batch", "manual_pool", "process_pool")
TRANSPORTS = ("subprocess_cli", "in_process_binding")
CHUNK_SIZES = (1048576, 2097152, 4194304)
SWEEP_PAIRS = (("o200k_base", "leb128"), ("none", "raw_utf8"), ("r50k_base", "fixed_u16"))
SWEEP_BACKENDS = ("lzma_extreme", "lzma_fast", "zstd_19", "zstd_12")
TOOL = {"lzma": "xz", "zstd": "zstd", "gzip": "gzip", "bz2": "bzip2"}
FAMILY_ORDER = ("lzma", "zstd", "gzip", "bzip2")
#: Corpus tiers: the published ones, and small ones for the tables here.
TIERS = ("64MB", "256MB", "1GB", "4GB")
SMALL_TIERS = {"64KB": 65536, "256KB": 262144, "1MB": 1048576, "4MB": 4194304, "16MB": 16777216}
#: The settings that one axis at a time departs from.
BASE_THREADS, BASE_BATCH, BASE_CHUNK = 20, 64, 2097152


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def tokenizers(spark: SparkSession) -> DataFrame:
    return _table(spark, [(t, VOCABULARY[t], i) for i, t in enumerate(TOKENIZERS)], "tokenizer string, vocabulary long, tokenizer_ord int")


def packings(spark: SparkSession) -> DataFrame:
    return _table(spark, [(p, i) for i, p in enumerate(PACKINGS)], "packing string, packing_ord int")


def backends(spark: SparkSession, profile: str = "full") -> DataFrame:
    """Backends of a profile: ``fast`` or all."""
    rows = [(name, v[0], v[1], v[2] and v[2] << 20, i) for i, (name, v) in enumerate(BACKENDS.items())]
    found = _table(spark, rows, "backend string, family string, backend_profile string, dict_bytes long, backend_ord int")
    return found.where("backend_profile = 'fast'") if profile == "fast" else found


def small_tiers(spark: SparkSession) -> DataFrame:
    return _table(spark, [(t, b, i) for i, (t, b) in enumerate(SMALL_TIERS.items())], "corpus_tier string, target_bytes long, tier_rank int")


def plot_family(backend):
    """Family as figures name it (bz2 is bzip2)."""
    family = F.split(backend, "_")[0]
    return F.when(family == "bz2", "bzip2").otherwise(family)
