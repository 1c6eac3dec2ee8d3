"""Self-describing archives of corpus shards, and their verified inverse.

Layout: ``PRMR``, version 2, packing code, three length-prefixed ASCII names (tokenizer,
backend, transport), the compressed packed stream, then 48 bytes: original length and
token count as little-endian 64-bit numbers and the SHA-256 of the original.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import time
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskiln.operators import codecs, packing, tokenizers
from corpuskiln.operators.text import CHUNK, LOOKAHEAD, stream_chunks
from corpuskiln.plans.dims import MAX_ID, PACKING_CODE, VOCABULARY

MAGIC, VERSION, FOOTER = b"PRMR", 2, 48


@dataclass(frozen=True)
class Header:
    packing: str
    tokenizer: str
    backend: str
    transport: str
    size: int


def refusal(tokenizer: str, packing_name: str) -> str | None:
    """Why a configuration can't run; it is refused, never changed silently."""
    if (tokenizer == "none") != (packing_name == "raw_utf8"):
        return "raw_utf8 and tokenizer=none only go together"
    if tokenizer != "none" and VOCABULARY[tokenizer] - 1 > MAX_ID[packing_name]:
        return f"{tokenizer} has ids above {packing_name}'s {MAX_ID[packing_name]}"
    return tokenizers.unavailable_reason(tokenizer)


def build_header(packing_name: str, tokenizer: str, backend: str, transport: str) -> bytes:
    names = b"".join(bytes([len(n)]) + n.encode("ascii") for n in (tokenizer, backend, transport))
    return MAGIC + bytes([VERSION, PACKING_CODE[packing_name]]) + names


def parse_header(data: bytes) -> Header:
    if data[:4] != MAGIC or len(data) < 6:
        raise ValueError("not an archive")
    if data[4] != VERSION:
        raise ValueError(f"archive version {data[4]} isn't {VERSION}")
    codes = {v: k for k, v in PACKING_CODE.items()}
    if data[5] not in codes:
        raise ValueError(f"unknown packing code {data[5]}")
    at, names = 6, []
    for _ in range(3):
        if at >= len(data):
            raise ValueError("archive ends within its header")
        names.append(data[at + 1 : at + 1 + data[at]].decode("ascii"))
        at += 1 + data[at]
    if len(data) < at + FOOTER:
        raise ValueError("archive shorter than its header and footer")
    return Header(codes[data[5]], *names, at)


def header_hex(packing_code: Column, tokenizer: Column, backend: Column, transport: Column) -> Column:
    """The header as lower-case hexadecimal text, in JVM expressions."""
    byte = lambda n: F.lpad(F.hex(n.cast("long")), 2, "0")
    name = lambda c: F.concat(byte(F.octet_length(c)), F.hex(c))
    return F.lower(F.concat(F.hex(F.lit(MAGIC.decode())), F.lit(f"{VERSION:02X}"), byte(packing_code), name(tokenizer), name(backend), name(transport)))


def build(
    data: bytes | Iterable[bytes], tokenizer: str, packing_name: str, backend: str, transport: str = "in_process_binding", threads: int = 1,
    chunk: int = CHUNK, lookahead: int = LOOKAHEAD, layout: str = "library_batch", batch: int = 1,
) -> tuple[bytes, dict]:
    """An archive of some bytes or of a stream of blocks, and what making it took.

    A stream is never held whole: ``batch`` chunks are tokenized at a time, as ``layout``
    says, on ``threads`` threads or processes, and go on to the coder.
    """
    if reason := refusal(tokenizer, packing_name):
        raise ValueError(reason)
    stats = {"token_count": 0, "packed_bytes": 0, "unsafe_boundary_cuts": 0, "tokenize_time_s": 0.0, "pack_time_s": 0.0, "corpus_bytes": 0}
    sha = hashlib.sha256()
    began = time.perf_counter()

    def pieces():
        for piece, unsafe in stream_chunks([data] if isinstance(data, bytes) else data, chunk, lookahead):
            stats["unsafe_boundary_cuts"] += unsafe
            stats["corpus_bytes"] += len(piece)
            sha.update(piece)
            yield piece

    def parts():
        for some in itertools.batched(pieces(), batch):
            if tokenizer != "none":
                t0 = time.perf_counter()
                ids = tokenizers.encode_many(tokenizer, [p.decode("utf-8") for p in some], layout, threads)
                t1 = time.perf_counter()
                some = [packing.PACK[packing_name](x) for x in ids]
                stats["token_count"] += sum(map(len, ids))
                stats["tokenize_time_s"] += t1 - t0
                stats["pack_time_s"] += time.perf_counter() - t1
            stats["packed_bytes"] += sum(map(len, some))
            yield from some

    payload = codecs.compress(parts(), backend, transport, threads)
    footer = struct.pack("<QQ", stats["corpus_bytes"], stats["token_count"]) + sha.digest()
    out = build_header(packing_name, tokenizer, backend, transport) + payload + footer
    stats["total_time_s"] = time.perf_counter() - began
    stats["compress_time_s"] = max(stats["total_time_s"] - stats["tokenize_time_s"] - stats["pack_time_s"], 0)
    stats["compressed_bytes"] = len(out)
    stats["ratio"] = stats["corpus_bytes"] / len(out)
    return out, stats | {"sha256": sha.hexdigest()}


def verify(archive: bytes, transport: str | None = None, threads: int = 1, keep: bool = False) -> dict:
    """Reads an archive back: length, token count and digest against its footer."""
    head = parse_header(archive)
    length, tokens, digest = struct.unpack("<QQ32s", archive[-FOOTER:])
    sha, seen, count, pending, kept = hashlib.sha256(), 0, 0, b"", []
    for block in codecs.decompress(archive[head.size : -FOOTER], head.backend, transport or head.transport, threads):
        if head.tokenizer != "none":
            ids, pending = packing.UNPACK[head.packing](pending + block)
            count += len(ids)
            block = tokenizers.decode(head.tokenizer, ids)
        sha.update(block)
        seen += len(block)
        if keep:
            kept.append(block)
    found = {"length_match": seen == length, "sha256_match": sha.digest() == digest, "token_count_match": head.tokenizer == "none" or count == tokens}
    return found | {"round_trip_verified": all(found.values()) and not pending, "data": b"".join(kept) if keep else None}


ARCHIVES = "shard int, documents long, orig_len long, token_count long, packed_bytes long, unsafe_boundary_cuts long, compressed_bytes long, ratio double, sha256 string, archive binary"


def pack_shards(docs: DataFrame, shards: int, tokenizer: str, packing_name: str, backend: str, transport: str = "in_process_binding") -> DataFrame:
    """One archive a shard; a shard is a range of the corpus order (``ord``, ``text``).

    Rows come sorted by shard, a task may have several, and each is fed to its archive
    record by record; only the archive itself is held.
    """
    if reason := refusal(tokenizer, packing_name):
        raise ValueError(reason)
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.binary())
    names = ["shard", "documents", "orig_len", "token_count", "packed_bytes", "unsafe_boundary_cuts", "compressed_bytes", "ratio", "sha256", "archive"]

    def records(batches):
        for batch in batches:
            for shard, text in zip(batch.column(0).to_pylist(), batch.column(2)):
                value = text.as_py() or ""
                yield shard, (value if value.endswith("\n") else value + "\n").encode() + b"\n\n"

    def run(batches):
        for shard, own in itertools.groupby(records(batches), lambda r: r[0]):
            seen: list[int] = []
            archive, stats = build((seen.append(1) or data for _, data in own), tokenizer, packing_name, backend, transport)
            values = [shard, len(seen), stats["corpus_bytes"], stats["token_count"], stats["packed_bytes"], stats["unsafe_boundary_cuts"], len(archive), stats["ratio"], stats["sha256"], archive]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    ranged = docs.select(F.pmod(F.floor(F.col("ord") / F.greatest(F.lit(1), F.ceil(F.lit(docs.count()) / shards))), F.lit(shards)).cast("int").alias("shard"), "ord", "text")
    dealt = ranged.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "ord")
    return dealt.mapInArrow(run, ARCHIVES)


def verify_shards(archives: DataFrame) -> DataFrame:
    """The four checks of every archive, one row each; a broken archive is a row, not a crash."""

    def run(batches):
        for batch in batches:
            for shard, archive in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    found, error = verify(archive.as_py()), None
                except Exception as e:  # every kind of damage is a result
                    found, error = dict.fromkeys(("length_match", "sha256_match", "token_count_match", "round_trip_verified"), False), f"{type(e).__name__}: {e}"[-400:]
                names = ("length_match", "sha256_match", "token_count_match", "round_trip_verified")
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *[pa.array([found[n]]) for n in names], pa.array([error], pa.string())], ["shard", *names, "error"])

    return archives.select("shard", "archive").mapInArrow(run, "shard int, length_match boolean, sha256_match boolean, token_count_match boolean, round_trip_verified boolean, error string")
