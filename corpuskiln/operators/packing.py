"""Token ids to bytes: LEB128 and fixed 16-bit little-endian, and back.

Arrow UDFs do it with numpy; ``*_hex`` are twins in JVM expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types, not their names: workers import this module without a session to parse them.
_UNPACKED = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("leftover", T.BinaryType())])
LEB128_MAX, U16_MAX = (1 << 21) - 1, (1 << 16) - 1


def leb128_bytes(ids) -> bytes:
    """One to three bytes an id, low seven bits first; ids above 21 bits are refused."""
    x = np.asarray(ids, np.int64)
    if len(x) and (x.max() > LEB128_MAX or x.min() < 0):
        raise ValueError(f"id outside 0..{LEB128_MAX}")
    width = 1 + (x > 0x7F) + (x > 0x3FFF)
    place = np.arange(3) < width[:, None]
    septets = (x[:, None] >> np.array([0, 7, 14])) & 0x7F
    more = np.arange(3) < (width - 1)[:, None]
    return (septets | np.where(more, 0x80, 0))[place].astype(np.uint8).tobytes()


def leb128_ids(data: bytes) -> tuple[np.ndarray, bytes]:
    """Whole ids and the bytes of an unfinished last one; wider than three bytes is refused."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 0x80)
    if not len(ends):
        if len(raw) > 2:
            raise ValueError("id wider than three bytes")
        return np.zeros(0, np.uint32), bytes(data)
    begins = np.append(0, ends[:-1] + 1)
    width = ends - begins + 1
    if width.max() > 3 or len(raw) - ends[-1] - 1 > 2:
        raise ValueError("id wider than three bytes")
    padded = np.append(raw, [0, 0])
    out = padded[begins].astype(np.uint32) & 0x7F
    for k in (1, 2):
        out |= np.where(width > k, (padded[begins + k].astype(np.uint32) & 0x7F) << np.uint32(7 * k), 0).astype(np.uint32)
    return out, bytes(data[ends[-1] + 1 :])


def u16_bytes(ids) -> bytes:
    """Two bytes an id, low byte first; ids above 16 bits are refused."""
    x = np.asarray(ids, np.int64)
    if len(x) and (x.max() > U16_MAX or x.min() < 0):
        raise ValueError(f"id outside 0..{U16_MAX}")
    return x.astype("<u2").tobytes()


def u16_ids(data: bytes) -> tuple[np.ndarray, bytes]:
    whole = len(data) // 2 * 2
    return np.frombuffer(data[:whole], "<u2").astype(np.uint32), bytes(data[whole:])


PACK = {"leb128": leb128_bytes, "fixed_u16": u16_bytes}
UNPACK = {"leb128": leb128_ids, "fixed_u16": u16_ids}


def _packed(ids: pa.Array, pack, widths) -> pa.Array:
    """All rows packed at once, cut by the bytes that each row's ids take; a null list is empty."""
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    edges = np.append(0, np.cumsum(ids.value_lengths().fill_null(0).to_numpy()))
    bytes_before = np.append(0, np.cumsum(widths(flat)))
    data, where = pack(flat), bytes_before[edges]
    return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(where.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


@F.arrow_udf(T.BinaryType())
def leb128_pack(ids: pa.Array) -> pa.Array:
    return _packed(ids, leb128_bytes, lambda x: 1 + (x > 0x7F) + (x > 0x3FFF))


@F.arrow_udf(T.BinaryType())
def u16_pack(ids: pa.Array) -> pa.Array:
    return _packed(ids, u16_bytes, lambda x: np.full(len(x), 2))


def _rows_unpacked(ids: list[np.ndarray], left: list[bytes]) -> pa.Array:
    flat = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(flat))
    return pa.StructArray.from_arrays([lists, pa.array(left, pa.binary())], ["ids", "leftover"])


@F.arrow_udf(_UNPACKED)
def leb128_unpack(data: pa.Array) -> pa.Array:
    """Rows that end with a whole id, as most do, are read at once and cut by how many ids each ends."""
    values = data.fill_null(b"").cast(pa.large_binary())
    where = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(values.buffers()[2] or b"", np.uint8)[where[0] : where[-1]]
    where = where - where[0]
    last = np.append(raw, np.uint8(0))[np.maximum(where[1:] - 1, 0)]
    if ((last < 0x80) | (where[1:] == where[:-1])).all():
        ids, _ = leb128_ids(raw.tobytes())
        edges = np.append(0, np.cumsum(raw < 0x80))[where]
        lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int64)))
        return pa.StructArray.from_arrays([lists, pa.array([b""] * len(data), pa.binary())], ["ids", "leftover"])
    rows = [leb128_ids(x.as_py()) for x in values]
    return _rows_unpacked([ids for ids, _ in rows], [rest for _, rest in rows])


@F.arrow_udf(_UNPACKED)
def u16_unpack(data: pa.Array) -> pa.Array:
    rows = [u16_ids(x.as_py() or b"") for x in data]
    return _rows_unpacked([ids for ids, _ in rows], [rest for _, rest in rows])


def leb128_width(x: Column) -> Column:
    return F.lit(1) + (x >= 128).cast("int") + (x >= 16384).cast("int")


def _hex(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 2, "0"))


def leb128_hex(ids: Column) -> Column:
    def one(x: Column) -> Column:
        low, middle, high = x.bitwiseAND(0x7F), F.shiftright(x, 7).bitwiseAND(0x7F), F.shiftright(x, 14)
        return (
            F.when(x < 128, _hex(x))
            .when(x < 16384, F.concat(_hex(low.bitwiseOR(0x80)), _hex(F.shiftright(x, 7))))
            .otherwise(F.concat(_hex(low.bitwiseOR(0x80)), _hex(middle.bitwiseOR(0x80)), _hex(high)))
        )

    return F.array_join(F.transform(ids, one), "")


def u16_hex(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: F.concat(_hex(x.bitwiseAND(0xFF)), _hex(F.shiftright(x, 8)))), "")


def register(spark) -> None:
    """The UDFs under their SQL names."""
    for name, f in {"leb128_pack": leb128_pack, "u16_pack": u16_pack, "leb128_unpack": leb128_unpack, "u16_unpack": u16_unpack}.items():
        spark.udf.register(name, f)
