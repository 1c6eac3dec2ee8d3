"""Byte-pair encoders by role, cached once in each Python worker.

The named encodings of the experiment need a download; offline, files of public
tokenizers stand in for the two 50k roles. The large vocabularies are planned for but
can't be run here, and say so.
"""

from __future__ import annotations

import base64
import multiprocessing
import re
from concurrent.futures import ProcessPoolExecutor, ThreadPoolExecutor
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpuskiln.plans.dims import VOCABULARY

#: The matcher of the pattern recurses once for each white-space character; from about a
#: million on its stack overflows. Longer runs than this are encoded beside the pattern.
LONG_RUN = 1 << 14
_RUN = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_RUN},}}")
STAND_INS = {"r50k_base": "byte_bpe_50k.tiktoken", "p50k_base": "byte_bpe_multi_50k.tiktoken"}


def unavailable_reason(tokenizer: str) -> str | None:
    if tokenizer == "none" or tokenizer in STAND_INS:
        return None
    return f"no offline vocabulary for {tokenizer}"


@lru_cache(maxsize=4)
def encoder(tokenizer: str):
    """The encoder of a role; special strings in a text are ordinary text."""
    if (reason := unavailable_reason(tokenizer)) or tokenizer == "none":
        raise ValueError(reason or "tokenizer=none encodes nothing")
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(STAND_INS[tokenizer]), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(tokenizer, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary_gap(tokenizer: str) -> int:
    """Live ids less the planned ones; a stand-in's differs from the role's by its special ids."""
    return encoder(tokenizer).n_vocab - VOCABULARY[tokenizer]


def encode_with(own, text: str) -> np.ndarray:
    """Ids of a text by a ``tiktoken`` encoder whose pattern ends in ``\\s+(?!\\S)|\\s+``.

    Before a word such a run is one piece up to its last character, which goes with what
    follows; at the end of a text it is one piece. So long runs need no matching.
    """
    if len(text) < LONG_RUN or not (runs := [m.span() for m in _RUN.finditer(text)]):
        return own.encode_to_numpy(text)
    parts, at = [], 0
    for start, end in runs:
        stop = end if end == len(text) else end - 1
        parts += [own.encode_to_numpy(text[at:start]), np.asarray(own._encode_single_piece(text[start:stop]), np.uint32)]
        at = stop
    return np.concatenate([*parts, own.encode_to_numpy(text[at:])])


def encode(tokenizer: str, text: str) -> np.ndarray:
    return encode_with(encoder(tokenizer), text)


def encode_many(tokenizer: str, texts: list[str], layout: str = "library_batch", threads: int = 1) -> list[np.ndarray]:
    """Ids of each text: by the library's own batches, by a pool of threads here, or by processes."""
    own = encoder(tokenizer)
    if layout == "library_batch":
        if any(len(t) >= LONG_RUN and _RUN.search(t) for t in texts):
            return [encode_with(own, t) for t in texts]
        return [np.asarray(ids, np.uint32) for ids in own.encode_ordinary_batch(texts, num_threads=threads)]
    if layout == "manual_pool":
        with ThreadPoolExecutor(threads) as pool:
            return list(pool.map(lambda t: encode_with(own, t), texts))
    if layout == "process_pool":
        with ProcessPoolExecutor(threads, multiprocessing.get_context("fork")) as pool:
            return list(pool.map(partial(encode, tokenizer), texts))
    raise ValueError(f"unknown layout {layout!r}")


def decode(tokenizer: str, ids) -> bytes:
    """Bytes, never text: a batch may end within a character."""
    return encoder(tokenizer).decode_bytes(ids.tolist() if isinstance(ids, np.ndarray) else list(ids))


def _lists(parts: list[np.ndarray], kind: type) -> pa.ListArray:
    """One Arrow list for each part, from a single buffer."""
    flat = np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat))


def rows_of(lists: pa.Array) -> list[np.ndarray]:
    """The rows of an Arrow list column as arrays; null is empty."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    cuts = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
    return np.split(flat, cuts[:-1]) if len(cuts) else []


def bpe_encode(tokenizer: str):
    """A column function: text -> ids."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        own = encoder(tokenizer)
        return _lists([encode_with(own, t.as_py() or "") for t in texts], np.int32)

    return run


def bpe_count(tokenizer: str):
    """A column function: text -> number of ids, which stay in the worker."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        own = encoder(tokenizer)
        return pa.array([len(encode_with(own, t.as_py() or "")) for t in texts], pa.int64())

    return run


def bpe_decode(tokenizer: str):
    """A column function: ids -> bytes."""

    @F.arrow_udf("binary")
    def run(ids: pa.Array) -> pa.Array:
        own = encoder(tokenizer)
        return pa.array([own.decode_bytes(x.tolist()) for x in rows_of(ids)], pa.binary())

    return run


def bpe_decode_each(tokenizer: str):
    """A column function: ids -> the bytes of each."""

    @F.arrow_udf("array<binary>")
    def run(ids: pa.Array) -> pa.Array:
        own = encoder(tokenizer)
        return pa.array([own.decode_tokens_bytes(x.tolist()) for x in rows_of(ids)], pa.list_(pa.binary()))

    return run
