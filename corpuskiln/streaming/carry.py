"""Chunking a byte stream with carried state, and the live result log.

A stream key's bytes arrive in pieces. What is left after the last safe cut is kept as
state until more comes, just as a reader of one file would carry it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpuskiln.operators.text import chunk_spans

CHUNKS = "stream string, chunk_idx int, data binary, unsafe boolean, final boolean"


class Chunker(StatefulProcessor):
    """Emits whole chunks of a key's pieces (``seq`` orders a batch); keeps the rest.

    A row with ``last`` set ends its stream: what is left comes out as its final chunk.
    """

    def __init__(self, size: int, lookahead: int):
        self.size, self.lookahead = size, lookahead

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("carry", "rest binary, chunk_idx int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rest, index = (self.state.get() if self.state.exists() else (b"", 0))
        rest = bytes(rest)
        parts = pd.concat(list(rows)).sort_values("seq")
        data, ended = rest + b"".join(map(bytes, parts["data"])), bool(parts["last"].any())
        out, done = [], 0
        for start, end, unsafe in chunk_spans(data, self.size, self.lookahead):
            # Without the stream's end a cut counts only if its whole window is there.
            if not ended and (end == len(data) or start + self.size + self.lookahead > len(data)):
                break
            out.append((key[0], index, data[start:end], unsafe, ended and end == len(data)))
            index, done = index + 1, end
        if ended:
            self.state.clear()
        else:
            self.state.update((data[done:], index))
        yield pd.DataFrame(out, columns=["stream", "chunk_idx", "data", "unsafe", "final"])

    def close(self) -> None:
        pass


def chunk_stream(pieces: DataFrame, size: int, lookahead: int) -> DataFrame:
    """Chunks of a streaming DataFrame (stream, seq, data, last)."""
    return pieces.groupBy("stream").transformWithStateInPandas(
        statefulProcessor=Chunker(size, lookahead), outputStructType=CHUNKS, outputMode="Append", timeMode="None"
    )


def result_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The JSON-lines result log as a stream."""
    return spark.readStream.schema(schema).json(path)


def run_available(stream: DataFrame, path: str, checkpoint: str, kind: str = "parquet") -> None:
    """Processes what is there and ends."""
    stream.writeStream.format(kind).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
