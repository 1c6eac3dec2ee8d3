"""Archive files as a source: headers and footers without decompressing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.plans.dims import PACKING_CODE

FOOTER = 48


def _little_endian(data, at):
    """A 64-bit number from eight bytes, low byte first."""
    byte = lambda k: F.conv(F.hex(F.substring(data, at + k, F.lit(1))), 16, 10).cast("long")
    total = byte(0)
    for k in range(1, 8):
        total = total + F.shiftleft(byte(k), 8 * k)
    return total


def describe(archives: DataFrame, content: str = "content") -> DataFrame:
    """Fields of every archive's header and footer, from its bytes; JVM expressions alone."""
    data, size = F.col(content), F.octet_length(content)
    number = lambda at: F.conv(F.hex(F.substring(data, at, F.lit(1))), 16, 10).cast("int")
    out = archives.withColumns({"version": number(F.lit(5)), "packing_code": number(F.lit(6))})
    at = F.lit(7)
    for name in ("tokenizer", "backend", "transport"):
        out = out.withColumn(f"_{name}_n", number(at)).withColumn(name, F.decode(F.substring(data, at + 1, F.col(f"_{name}_n")), "US-ASCII"))
        at = at + 1 + F.col(f"_{name}_n")
    packing = F.create_map(*[x for k, v in PACKING_CODE.items() for x in (F.lit(v), F.lit(k))])
    return out.select(
        *archives.columns, (F.substring(data, F.lit(1), F.lit(4)) == F.lit(b"PRMR")).alias("known"), "version", packing[F.col("packing_code")].alias("packing"), "tokenizer", "backend", "transport",
        _little_endian(data, size - FOOTER + 1).alias("orig_len"), _little_endian(data, size - FOOTER + 9).alias("token_count"), F.lower(F.hex(F.substring(data, size - 31, F.lit(32)))).alias("sha256"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Archive files of a folder, described."""
    return describe(spark.read.format("binaryFile").load(path).select("path", "content"))
