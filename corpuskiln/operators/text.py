"""UTF-8 and safe-boundary operators.

A place is safe to cut if an ASCII letter or digit stands before it and ASCII white space
after it. Byte positions are found on the Latin-1 view of the bytes, where one character
is one byte, so the search stays in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

SAFE = r"(?<=[A-Za-z0-9])[ \t\r\n\x0b\f]"
_SAFE = re.compile(SAFE.encode())
#: Where a pre-token of the GPT-2 pattern ends whatever stands around it: a run of letters
#: (a contraction too) or of digits before another ASCII character, anything before white
#: space. Both bytes are ASCII, so Unicode tables don't matter.
_EDGE = re.compile(rb"(?<=[A-Za-z])[\x00-@\[-`{-\x7f]|(?<=[0-9])[\x00-/:-\x7f]|(?<=[!-~])[\t-\r ]")
CHUNK, LOOKAHEAD = 2 << 20, 64 << 10


def latin1(text: Column) -> Column:
    """The UTF-8 bytes as a string of one character each."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def first_boundary(text: Column) -> Column:
    """Byte offset of the first safe place to cut, null if there is none."""
    return F.nullif(F.expr("0") + F.regexp_instr(latin1(text), F.lit(SAFE)), F.lit(0)).cast("long") - 1


def sequence_length(lead: Column) -> Column:
    """Bytes of the UTF-8 sequence that a byte leads; null for continuation and bad bytes."""
    return (
        F.when(lead < 0x80, 1).when((lead >= 0xC0) & (lead < 0xE0), 2).when((lead >= 0xE0) & (lead < 0xF0), 3).when((lead >= 0xF0) & (lead < 0xF8), 4)
    )


def is_continuation(byte: Column) -> Column:
    return byte.bitwiseAND(0xC0) == 0x80


def utf8_trim(data: bytes, end: int) -> int:
    """The end moved back to a character's edge; kept where the bytes are malformed."""
    for back in range(1, min(4, end) + 1):
        byte = data[end - back]
        if byte & 0xC0 != 0x80:
            width = 1 if byte < 0x80 else 2 if byte >> 5 == 6 else 3 if byte >> 4 == 14 else 4 if byte >> 3 == 30 else 0
            return end - back if width > back else end
    return end


def chunk_spans(data: bytes, size: int = CHUNK, lookahead: int | None = LOOKAHEAD) -> Iterator[tuple[int, int, bool]]:
    """(start, end, unsafe) of chunks: at least ``size`` bytes, cut at the next safe place.

    The place is looked for in ``lookahead`` bytes past the size (None: to the end). With
    none there, the cut is at the character's edge at the end of the window, and counted.
    """
    start, seen = 0, 0
    while start < len(data):
        reach = max(start + size, seen)
        if reach >= len(data):
            yield start, len(data), False
            return
        limit = len(data) if lookahead is None else min(len(data), reach + lookahead)
        found = _SAFE.search(data, reach, limit)
        if found:
            end, unsafe = found.start(), False
        else:
            end, unsafe = (len(data), False) if lookahead is None else (utf8_trim(data, limit), True)
            end = end if end > start else limit
        yield start, end, unsafe
        start, seen = end, 0 if lookahead is None else limit


def sure_spans(data: bytes, size: int = CHUNK, lookahead: int | None = LOOKAHEAD) -> Iterator[tuple[int, int, bool]]:
    """The chunks of ``chunk_spans`` without its unsafe cuts, for tokenizers of the GPT-2 pattern.

    Such a cut goes back to the last edge of a pre-token, what follows it to the next chunk;
    where a chunk has no edge, it goes on into the next one.
    """
    start, seen = 0, 0
    for _, end, unsafe in chunk_spans(data, size, lookahead):
        if unsafe and end < len(data):
            edges = [m.start() for m in _EDGE.finditer(data, max(start + 1, seen), end)]
            seen = end
            if not edges:
                continue
            end = edges[-1]
        yield start, end, False
        start = end


def stream_chunks(blocks: Iterable[bytes], size: int = CHUNK, lookahead: int = LOOKAHEAD) -> Iterator[tuple[bytes, bool]]:
    """(chunk, unsafe) of a stream that comes in blocks: the cuts of ``chunk_spans``, holding one chunk and a block."""
    held, window = bytearray(), size + lookahead + 1
    for block in blocks:
        held += block
        at = 0
        while len(held) - at >= window:
            _, end, unsafe = next(chunk_spans(bytes(held[at : at + window]), size, lookahead))
            yield bytes(held[at : at + end]), unsafe
            at += end
        del held[:at]
    for start, end, unsafe in chunk_spans(bytes(held), size, lookahead):
        yield bytes(held[start:end]), unsafe


def chunks(docs: DataFrame, size: int = CHUNK, lookahead: int | None = LOOKAHEAD) -> DataFrame:
    """Chunks of every document, as byte ranges."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = (text.as_py() or "").encode()
                rows.extend((doc, k, a, b, unsafe) for k, (a, b, unsafe) in enumerate(chunk_spans(data, size, lookahead)))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "chunk_idx", "start", "end", "unsafe"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, chunk_idx int, start long, end long, unsafe boolean")


@udtf(returnType="chunk_idx int, start long, end long, unsafe boolean")
class ReadChunks:
    """``SELECT * FROM docs, LATERAL read_chunks(text, size, lookahead)``."""

    def eval(self, text: str, size: int, lookahead: int):
        for k, (start, end, unsafe) in enumerate(chunk_spans((text or "").encode(), size, lookahead)):
            yield k, start, end, unsafe


def first_divergence(a: Column, b: Column) -> Column:
    """Index of the first place where two arrays differ (the shorter length if one is a prefix), else null."""
    both = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: F.struct(x["a"].eqNullSafe(x["b"]).alias("same")))
    at = F.array_position(F.transform(both, lambda x: x["same"]), False)
    return F.when(at > 0, F.least(at - 1, F.size(a), F.size(b)).cast("long"))
