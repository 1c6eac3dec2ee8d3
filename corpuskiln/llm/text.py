"""Vectorised text primitives on Arrow buffers.

A *word* is a maximal run of bytes other than ``0x20`` and ``0x09``-``0x0D``; A-Z count
as a-z in hashes. The bytes of a whole Arrow batch are hashed at once with a polynomial
rolling sum, so no Python string is made for a word. Null texts have no words.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

_SLICE = 1 << 20
_M_MMAP_THRESHOLD = -3  # of mallopt()


def _give_back_freed_arrays() -> None:
    """Keeps glibc from raising the size from which freed memory goes back to the system.

    Workers live on from task to task; else each keeps the largest arrays it ever had.
    """
    try:
        ctypes.CDLL("libc.so.6").mallopt(_M_MMAP_THRESHOLD, 4 << 20)
    except (OSError, AttributeError):
        pass  # another C library: nothing to set


_give_back_freed_arrays()
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD_BYTES = ~_SPACE
#: ASCII letters and all bytes of other characters.
LETTER_BYTES = np.zeros(256, bool)
LETTER_BYTES[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, np.uint64)[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, _SLICE + 4096)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column, and the offsets between them (null: none)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    where = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[where[0] : where[-1]], where - where[0]


def word_spans(raw: np.ndarray, where: np.ndarray, member: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of each text (with the total).

    ``member`` tells of each byte value whether it belongs to a word.
    """
    inside = member[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = where[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    begins[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, where)


def span_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(stops, base + _SLICE, "right")))
        up, down = _power_tables(int(stops[j - 1] - base) + 1)
        piece = raw[base : stops[j - 1]]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE[piece] * up[: len(piece)], out=total[1:])
        a, b = starts[i:j] - base, stops[i:j] - base
        out[i:j] = (total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)
        i = j
    return mix64(out)


def word_hashes(texts: pa.Array, member: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and the first word of each text (with the total)."""
    raw, where = buffers(texts)
    starts, stops, first = word_spans(raw, where, member)
    return span_hashes(raw, starts, stops), first


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; fewer words make one run; none make none."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = words[:n].copy()
    for k in range(1, width):
        out = mix64(out) * _BASE + words[k : k + n]
    return mix64(out)


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """Row slices of a batch of about ``most`` text bytes, so that memory stays bounded."""
    at = batch.schema.get_field_index(column)
    _, where = buffers(batch.column(at))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(where, where[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
