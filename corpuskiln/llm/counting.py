"""Exact token counts, with overlap resynchronisation for huge documents.

Method: a text above ``chunk`` code points is encoded in overlapping chunks with offsets.
Neighbouring chunks are spliced at a *stable common boundary*: a place in the overlap
with an ASCII letter or digit before and ASCII white space after it, where both chunks
have a token edge and after which both have the same tokens up to the last such place
they share. White space ends a pre-token there whatever stands around it, and BPE never
merges across pre-tokens, so the splice is exact. If the overlap has no such place, the
left chunk is encoded again with twice the overlap, in the end to the end of the text.
Shorter texts of a tokenizer that drops white space and always parts there (as its file
says, and a probe confirms) are counted by their words, each distinct word being encoded
once for a worker's table of at most ``TABLE_WORDS`` words; for other tokenizers they are
encoded whole, many to a call.

Defined cases: a null or empty text has no bytes and no tokens; repeated rows are counted
each; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import itertools
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.llm.shared import texts_of
from corpuskiln.llm.text import buffers
from corpuskiln.llm.tokens import load_tokenizer

CHUNK = 1 << 15
OVERLAP = 1 << 9
CALL_CHARS = 1 << 20
TABLE_WORDS = 1_000_000
_STABLE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \t\r\n\x0b\x0c])")


class _Span:
    """Tokens of ``text[start:stop]`` with their offsets in ``text``."""

    def __init__(self, tokenizer, text: str, start: int, stop: int):
        found = tokenizer.encode(text[start:stop], add_special_tokens=False)
        self.stop = stop
        self.ids = np.asarray(found.ids, np.int64)
        edges = np.asarray(found.offsets, np.int64).reshape(-1, 2) + start
        self.begin, self.end = edges[:, 0], edges[:, 1]

    def split(self, at: int) -> int | None:
        """How many tokens end by ``at``; None if a token crosses it."""
        k = int(np.searchsorted(self.begin, at, "left"))
        return k if k == 0 or self.end[:k].max() <= at else None


def _common_boundary(left: _Span, right: _Span, text: str, low: int, high: int) -> int | None:
    """First stable boundary in [low, high) after which both spans agree; None if none."""
    places = [m.start() for m in _STABLE.finditer(text, low, high)]
    for k, place in enumerate(places):
        last = places[-1] if k + 1 < len(places) else place
        cuts = [left.split(place), left.split(last), right.split(place), right.split(last)]
        if None in cuts:
            continue
        a, b, c, d = cuts
        if np.array_equal(left.ids[a:b], right.ids[c:d]) and np.array_equal(left.begin[a:b], right.begin[c:d]):
            return place
    return None


def spliced_count(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text of any length; equal to encoding it at once."""
    start, counted_from, total = 0, 0, 0
    left = _Span(tokenizer, text, 0, min(len(text), chunk + overlap))
    while left.stop < len(text):
        width, low = overlap, start + chunk
        right = None
        while left.stop < len(text):
            reach = min(len(text), max(low + chunk + overlap, left.stop))
            if right is None or right.stop < reach:
                right = _Span(tokenizer, text, low, reach)
            if (place := _common_boundary(left, right, text, max(low, counted_from), left.stop)) is not None:
                break
            width *= 2
            left = _Span(tokenizer, text, start, min(len(text), low + width))
        else:
            break
        total += left.split(place) - left.split(counted_from)
        start, counted_from, left = low, place, right
    return total + len(left.ids) - (left.split(counted_from) or 0)


def parts_at_spaces(tokenizer, path: str) -> bool:
    """Whether a text's tokens are always those of its words, one after the other."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = spec.get("pre_tokenizer") or {}
    first = (steps.get("pretokenizers") or [steps])[0]
    drops = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed"
    pattern = (first.get("pattern") or {}).get("Regex", "")
    names_space = re.search(r"\\s(?![^\[]*\])| ", pattern)
    special = [t for t in spec.get("added_tokens", []) if re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip")]
    forms = {n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [spec.get("normalizer") or {}])}
    if not drops or names_space or special or not forms <= {None, "NFC", "Replace", "Lowercase"}:
        return False
    probe = "It's 12 o'clock\tNaïve e\u0301 \u0301x\n<|x|>a,b. don't 中文"
    whole = tokenizer.encode(probe, add_special_tokens=False).ids
    return whole == [i for w in probe.encode().split() for i in tokenizer.encode(w.decode(), add_special_tokens=False).ids]


class WordTable:
    """Token counts of words, each encoded once while it stays in the table."""

    def __init__(self, tokenizer):
        self.tokenizer, self.known = tokenizer, {}

    def _learn(self, words: list[bytes]) -> None:
        """Encodes the words in lines, many to a call, and counts by their offsets."""
        for k in range(0, len(words), 4096):
            some = [w.decode() for w in words[k : k + 4096]]
            begins = np.cumsum([0, *(len(w) + 1 for w in some[:-1])])
            found = self.tokenizer.encode("\n".join(some), add_special_tokens=False)
            at = np.asarray(found.offsets, np.int64).reshape(-1, 2)[:, 0]
            counts = np.bincount(np.searchsorted(begins, at, "right") - 1, minlength=len(some))
            self.known.update(zip(words[k : k + 4096], counts.tolist()))

    def count(self, texts: list[bytes]) -> list[int]:
        split = [t.split() for t in texts]  # of bytes: at ASCII white space alone
        new = set(itertools.chain.from_iterable(split)) - self.known.keys()
        if len(self.known) + len(new) > TABLE_WORDS:
            self.known.clear()
            new = set(itertools.chain.from_iterable(split))
        self._learn(list(new))
        return [sum(map(self.known.__getitem__, words)) for words in split]


@lru_cache(maxsize=4)
def _table_of(path: str) -> WordTable | None:
    tokenizer = load_tokenizer(path)
    return WordTable(tokenizer) if parts_at_spaces(tokenizer, path) else None


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per document: UTF-8 bytes, tokens, and whether there are more than ``limit``.

    ``.json`` files are read by ``tokenizers``, ``.model`` files by ``sentencepiece``
    (always encoded whole: its offsets don't splice).
    """

    def count(batches):
        if tokenizer_path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path)
            many, huge = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], None
        else:
            tokenizer = load_tokenizer(tokenizer_path)
            many = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            huge = lambda text: spliced_count(tokenizer, text, chunk, overlap)
            if (words := _table_of(tokenizer_path)) is not None:
                many = lambda texts: words.count([t.encode() for t in texts])
        for batch in batches:
            _, where = buffers(batch.column(1))
            counts = np.zeros(batch.num_rows, np.int64)
            waiting: list[tuple[int, str]] = []
            size = 0

            def flush(waiting=waiting, counts=counts):
                if waiting:
                    counts[[k for k, _ in waiting]] = many([t for _, t in waiting])
                    waiting.clear()

            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py() or ""
                if huge and len(text) > chunk + overlap:
                    counts[k] = huge(text)
                elif text:
                    waiting.append((k, text))
                    size += len(text)
                    if size > CALL_CHARS:
                        flush()
                        size = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(where)), pa.array(counts), pa.array(counts > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return texts_of(docs).mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
