"""Labelled rows for fitting small models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.llm.shared import crc_bucket
from corpuskiln.llm.text import mix64

_CELLS = 1 << 24
#: Bytes of all texts of a sample; what goes beyond makes the sample smaller, whatever a text's length.
FIT_BYTES = 64 << 20


def fetch(rows: DataFrame, most_bytes: int = FIT_BYTES, each: bool = False) -> pa.Table:
    """(doc_id, text, label) of about as many of ``rows`` (doc_id, text, label) as ``most_bytes`` hold.

    Ids are taken in the order of a hash, so long texts are as likely as short ones, until
    the next would begin beyond the bytes; with ``each`` every label has an equal part of
    them. Of rows that repeat an id the least text stands for it. First the lengths alone
    reach the driver, so ``rows`` must be a bounded sample already.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sizes = rows.groupBy("doc_id", "label").agg(F.max(size).alias("bytes")).toArrow()
    ids, labels, lengths = sizes["doc_id"].to_numpy(), np.asarray(sizes["label"].to_pylist()), sizes["bytes"].to_numpy()
    kept: list[tuple] = []
    groups = [labels == x for x in np.unique(labels)] if each else [np.ones(len(ids), bool)]
    for own in groups:
        at = np.flatnonzero(own)
        at = at[np.lexsort((ids[at], mix64(ids[at].astype(np.uint64))))]
        begins = np.cumsum(lengths[at]) - lengths[at]
        kept += [(int(ids[k]), labels[k].item()) for k in at[begins < most_bytes / len(groups)]]
    spark = rows.sparkSession
    kind = dict(rows.dtypes)["label"]
    wanted = spark.createDataFrame(kept, f"doc_id long, label {kind}")
    texts = rows.join(F.broadcast(wanted), ["doc_id", "label"]).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return texts.select("doc_id", "text", "label").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, modulus: int, held: int) -> pa.Table:
    """(doc_id, text, label) of about ``most`` labelled documents at most, outside the held-out part.

    Which ones is decided by a hash of the id below a bound, so no task sorts the labels,
    and by ``FIT_BYTES``. Ids with null or contradicting labels are left out.
    """
    usable = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_bucket(F.col("doc_id"), modulus) != held))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .where(F.col("label") == F.col("other"))
    )
    bound = _CELLS * most // max(1, usable.count())
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(_CELLS)) < bound).select("doc_id", F.col("label").cast("int").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # About ``most`` rows of two integers.
    return fetch(texts.join(F.broadcast(chosen), "doc_id"))
