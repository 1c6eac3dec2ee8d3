"""Verification operators: split against whole, decode at any place, adversarial texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.operators import tokenizers
from corpuskiln.operators.text import chunk_spans, sure_spans


#: Difficulty, a unit, how often it is repeated, and the cuts without a safe place that
#: chunks of 4,096 bytes with 2,048 to look ahead must make in it.
HARD_TEXTS = (
    ("blanks alone", " ", 60_000, 10),
    ("digits alone", "31415926535", 3_700, 6),
    ("letters alone", "incomprehensible", 15_625, 41),
    ("marks alone", "<>?/|{}[]~", 4_200, 7),
    ("wide characters alone", "ß漢\U0001f680", 4_300, 6),
    ("figures between blanks", "9 80 701 6002 ", 2_900, 0),
    ("grouped figures", "7.001.340,50 ", 3_100, 0),
    ("letters and digits in one word", "x9y88z777 ", 4_000, 0),
    ("long words after blanks", "   incomprehensibilities", 1_800, 0),
    ("empty lines", "row\n\n", 9_000, 0),
    ("carriage returns", "A short line.\r\n\r\nAnother one, longer.\r\n", 1_100, 0),
    ("apostrophes and quotes", "we're “said” they'll ", 2_000, 0),
    ("tabs and runs of blanks", "cell\t\t cell   \r\n  ", 2_400, 0),
    ("capitals here and there", "LOUD Loud lOUD LoUd ", 2_100, 0),
)


def adversarial_cases() -> list[tuple[str, str]]:
    """Texts that are hard to cut: without a safe place, with white space that regroups, with wide characters."""
    return [(name, unit * times) for name, unit, times, _ in HARD_TEXTS]


SPLITS = "case_name string, tokenizer string, whole_tokens long, split_tokens long, chunks int, unsafe_cuts int, identical boolean, first_divergence long"


def split_invariance(texts: DataFrame, tokenizer: str, size: int, lookahead: int, sure: bool = False) -> DataFrame:
    """Whether the chunks' ids are the whole text's, for every (case_name, text).

    ``sure``: chunks that the plain rule would cut at an unsafe place are cut elsewhere.
    """
    spans_of = sure_spans if sure else chunk_spans

    def run(batches):
        for batch in batches:
            rows = []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py() or ""
                data = text.encode()
                whole = tokenizers.encode(tokenizer, text)
                spans = list(spans_of(data, size, lookahead))
                parts = [tokenizers.encode(tokenizer, data[a:b].decode()) for a, b, _ in spans]
                split = np.concatenate(parts) if parts else whole[:0]
                common = min(len(whole), len(split))
                apart = np.flatnonzero(whole[:common] != split[:common])
                at = int(apart[0]) if len(apart) else None if len(whole) == len(split) else common
                rows.append((name, tokenizer, len(whole), len(split), len(spans), sum(u for *_, u in spans), at is None, at))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64())
            names = ["case_name", "tokenizer", "whole_tokens", "split_tokens", "chunks", "unsafe_cuts", "identical", "first_divergence"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names)

    return texts.select("case_name", "text").mapInArrow(run, SPLITS)


def verdict(found: DataFrame) -> DataFrame:
    """A difference without an unsafe cut is a failure; with one, a known limit."""
    outcome = F.when(F.col("identical"), "identical").when(F.col("unsafe_cuts") > 0, "limitation").otherwise("failure")
    return found.withColumn("outcome", outcome)
