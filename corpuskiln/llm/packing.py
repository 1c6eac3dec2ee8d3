"""Best-fit packing of documents into sequences of a fixed token length.

Method: length-histogram planning. Tokenizing gives thin piece rows (no text). The plan
is best-fit decreasing over the *counts* of the at most ``capacity`` piece lengths, so
its work depends on the number of lengths and not on the number of pieces. Pieces then
take the planned slots by a join on their rank within their length.

Ranks are made without gathering a length in one task: pieces of a length are dealt to
salts by a hash, ranked within (length, salt), and shifted by the salts' running counts.

Defined cases: a null or empty text is a document of the end token alone; equal rows, or
rows with equal ids, are packed once each; a very long text is tokenized whole, long runs
of white space too; an empty table gives no pieces; extra columns
of the input are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln.llm.shared import cut, hot_split, texts_of
from corpuskiln.llm.tokens import load_byte_bpe

CAPACITY = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, salt int"


def piece_starts(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, after a shorter first one."""
    first = (total - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: place in its document, length and crc32 of its ids."""
    salts = hot_split(docs.sparkSession)

    def encode(batches):
        bpe = load_byte_bpe(tokenizer_path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: list[tuple] = []
            for k, doc in enumerate(ids):
                tokens = np.append(bpe.encode(texts[k].as_py() or ""), np.uint32(end_id)).astype("<u4")
                for p, (start, length) in enumerate(piece_starts(len(tokens), capacity)):
                    crc = zlib.crc32(tokens[start : start + length].tobytes())
                    rows.append((doc, p, start, length, crc, zlib.crc32(b"%d:%d" % (doc or 0, p)) % salts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "salt"],
            )

    return texts_of(docs).mapInArrow(encode, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, count, first sequence, offset) by best-fit decreasing.

    Sequences with equal content are kept as one range of numbers. Best fit goes on in a
    sequence while the length fits, since that one has the least space; so a step fills as
    many sequences of a range as it can, and one more with the rest.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by space left: (first, count)
    slots, opened = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        spaces = iter([s for s in range(length, capacity + 1) for _ in room[s]])
        while left:
            if (space := next(spaces, None)) is not None:
                first, count = room[space].pop()
            else:
                space, first = capacity, opened
                count = -(-left // (capacity // length))
                opened += count
            each = space // length
            full = min(count, left // each)
            rest = left - full * each if full < count else 0
            for bins, times in ((full, each), (1, rest)):
                if not bins or not times:
                    continue
                for k in range(times):
                    slots.append((length, rank, bins, first, capacity - space + k * length))
                    rank, left = rank + bins, left - bins
                room[space - times * length].append((first, bins))
                first, count = first + bins, count - bins
            if count:
                room[space].append((first, count))
    return slots


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces with their sequence and their offset in it."""
    spark = docs.sparkSession
    cells = cut(pieces(docs, tokenizer_path, capacity, end_id))
    sizes = cells.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(
        plan(histogram, capacity), "length int, rank_from long, slot_count long, sequence_from long, offset long"
    )
    #: Slots of a length tile its ranks: joined by length and coarse step of the rank, each
    #: step lists the slots that touch it.
    step = 4096
    stepped = slots.withColumn(
        "step",
        F.explode(F.sequence(F.floor(F.col("rank_from") / step), F.floor((F.col("rank_from") + F.col("slot_count") - 1) / step))),
    )
    local = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        cells.withColumn("local", F.row_number().over(local) - 1)
        .join(shifts, ["length", "salt"])
        .withColumn("rank", F.col("local") + F.col("shift"))
        .withColumn("step", F.floor(F.col("rank") / step))
    )
    placed = ranked.join(stepped, ["length", "step"]).where(
        (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_from") + F.col("slot_count"))
    )
    return placed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("sequence_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset",
    )
