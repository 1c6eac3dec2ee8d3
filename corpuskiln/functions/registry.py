"""Registers the engine's functions under SQL names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskiln.operators import codecs, packing, text, tokenizers


@F.pandas_udf(T.BinaryType())
def compress(data: pd.Series, backend: pd.Series) -> pd.Series:
    """The data as one stream of the backend's binding."""
    return pd.Series([codecs.compress([bytes(d)], b) for d, b in zip(data, backend)])


@F.pandas_udf(T.BinaryType())
def decompress(data: pd.Series, backend: pd.Series) -> pd.Series:
    return pd.Series([b"".join(codecs.decompress(bytes(d), b)) for d, b in zip(data, backend)])


@F.pandas_udf(T.LongType())
def utf8_trim(data: pd.Series, end: pd.Series) -> pd.Series:
    """The end moved back to a character's edge."""
    return pd.Series([text.utf8_trim(bytes(d), int(e)) for d, e in zip(data, end)])


def register(spark: SparkSession) -> list[str]:
    """All functions; their names come back."""
    packing.register(spark)
    for name, f in {"compress_bytes": compress, "decompress_bytes": decompress, "utf8_trim": utf8_trim}.items():
        spark.udf.register(name, f)
    for role in tokenizers.STAND_INS:
        spark.udf.register(f"bpe_encode_{role}", tokenizers.bpe_encode(role))
        spark.udf.register(f"bpe_decode_{role}", tokenizers.bpe_decode(role))
    spark.udtf.register("read_chunks", text.ReadChunks)
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION safe_boundary(t STRING) RETURNS BIGINT RETURN nullif(regexp_instr(decode(encode(t, 'UTF-8'), 'ISO-8859-1'), '(?<=[A-Za-z0-9])[ \\t\\r\\n\\x0b\\f]'), 0) - 1")
    roles = [f"bpe_{way}_{role}" for role in tokenizers.STAND_INS for way in ("encode", "decode")]
    return ["leb128_pack", "leb128_unpack", "u16_pack", "u16_unpack", "compress_bytes", "decompress_bytes", "utf8_trim", "read_chunks", "safe_boundary", *roles]
