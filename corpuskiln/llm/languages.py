"""Language identification by multilingual mixture inference.

Method: every word (a run of letters) is a draw from a mixture of languages; its likelihood
in a language is the product of its byte-trigram probabilities, tempered because trigrams
overlap. Expectation-maximisation estimates a document's language proportions. Which
languages a document holds is chosen by penalised likelihood: the best single language
against the two strongest, then three and so on as long as the penalised likelihood rises,
each further language costing ``PENALTY`` times the log of the number of words. The prediction is the language with the largest proportion in
the chosen set, and that proportion is the score.

The trigram tables come from at most about ``TRAIN_DOCS`` documents (dealt evenly among the
languages, by a hash of the id) of ``FIT_BYTES`` in all, a documented bound; they hold
``CODES`` numbers a language. More than ``MOST_LANGUAGES`` values of ``lang`` are refused,
since then the column names no languages.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; documents
with a null ``lang`` aren't learned from; without any language to learn every document is
``und``; of languages with equal shares the first by name is predicted; a very long text is
read whole, in a slice of its own; repeated rows are scored each; an empty table gives no rows; extra columns are not
looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.llm.shared import crc_bucket, texts_of
from corpuskiln.llm.text import LETTER_BYTES, buffers, slices, word_spans
from corpuskiln.llm.training import fetch

TRAIN_DOCS = 6_000
MOST_LANGUAGES = 1024
CODES = 1 << 16
TEMPER = 0.5
PENALTY = 1.5
ROUNDS = 8
UNKNOWN = "und"
_FOLD = np.zeros(256, np.uint32)
_FOLD[LETTER_BYTES] = np.arange(256)[LETTER_BYTES]
_FOLD[65:91] = np.arange(97, 123)
_ASCII_LETTER = LETTER_BYTES & (np.arange(256) < 128)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all trigrams around letters; the first of each word; the first word of each text."""
    raw, where = buffers(texts)
    starts, stops, first = word_spans(raw, where, LETTER_BYTES)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), first
    lengths = stops - starts
    firsts = np.cumsum(lengths) - lengths
    at = np.repeat(starts - firsts, lengths) + np.arange(int(lengths.sum()))
    middle = _FOLD[raw[at]]
    before, after = np.zeros_like(middle), np.zeros_like(middle)
    before[1:], after[:-1] = middle[:-1], middle[1:]
    before[firsts] = 0
    after[firsts + lengths - 1] = 0
    code = ((before * np.uint32(131) + middle) * np.uint32(2654435761) + after * np.uint32(40503)) >> np.uint32(16)
    return (code ^ after).astype(np.int64) & (CODES - 1), firsts, first


@dataclass
class Languages:
    names: list[str]
    table: np.ndarray  # CODES x languages, log probabilities

    def infer(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Per text: language, its proportion, and all languages' proportions."""
        size, kinds = len(texts), len(self.names)
        shares, names, top = np.zeros((size, kinds)), [UNKNOWN] * size, np.zeros(size)
        codes, firsts, first = trigrams(texts)
        rows = np.flatnonzero(np.diff(first))
        if not kinds or not len(rows):
            return names, top, shares
        evidence = np.add.reduceat(self.table[codes], firsts, axis=0).astype(np.float64) * TEMPER
        begins, words = first[rows], np.diff(first)[rows]
        single = np.add.reduceat(evidence, begins, axis=0)
        peak = evidence.max(1, keepdims=True)
        likely = np.exp(evidence - peak)
        owner = np.repeat(np.arange(len(rows)), words)
        base = np.add.reduceat(peak[:, 0], begins)
        mixture = self._mix(likely, begins, owner, np.full((len(rows), kinds), 1 / kinds), words)[0]
        mixture[np.arange(len(rows)), single.argmax(1)] += 1  # the best single language is in every set
        order = np.argsort(-mixture, axis=1, kind="stable")
        best = single.max(1) - PENALTY * np.log(words + 1.0)
        chosen = np.zeros((len(rows), kinds))
        chosen[np.arange(len(rows)), order[:, 0]] = 1
        growing = np.arange(len(rows))
        for k in range(2, kinds + 1):
            if not len(growing):
                break
            at = np.flatnonzero(np.isin(owner, growing))
            n = words[growing]
            allowed = np.zeros((len(growing), kinds))
            np.put_along_axis(allowed, order[growing, :k], 1 / k, axis=1)
            weights, fit = self._mix(likely[at], np.cumsum(n) - n, np.repeat(np.arange(len(n)), n), allowed, n)
            value = fit + base[growing] - k * PENALTY * np.log(n + 1.0)
            better = value > best[growing]
            chosen[growing[better]], best[growing[better]] = weights[better], value[better]
            growing = growing[better]
        shares[rows] = chosen
        top[rows] = chosen.max(1)
        for row, at in zip(rows, chosen.argmax(1)):
            names[row] = self.names[at]
        raw, where = buffers(texts)
        plain = np.append(0, np.cumsum(_ASCII_LETTER[raw]))[where]
        for row in rows[np.diff(plain)[rows] == 0]:
            if not any(c.isalpha() for c in texts[int(row)].as_py()):
                names[row], top[row], shares[row] = UNKNOWN, 0.0, 0.0
        return names, top, shares

    @staticmethod
    def _mix(likely, begins, owner, weights, words):
        """Proportions by expectation-maximisation, and their log-likelihood."""
        total = None
        for _ in range(ROUNDS):
            joint = likely * weights[owner]
            total = np.maximum(joint.sum(1, keepdims=True), 1e-300)
            weights = np.add.reduceat(joint / total, begins, axis=0) / words[:, None]
        return weights, np.add.reduceat(np.log(total[:, 0]), begins)


def fit(texts: pa.Array, langs: list[str], smoothing: float = 0.5) -> Languages:
    names = sorted(set(langs))
    counts = np.zeros((len(names), CODES))
    which = np.array([names.index(x) for x in langs], np.int64)
    for k in range(0, len(texts), 500):
        codes, firsts, first = trigrams(texts[k : k + 500])
        per_text = np.diff(np.append(firsts, len(codes))[first]) if len(firsts) else np.zeros(len(first) - 1, np.int64)
        owner = np.repeat(which[k : k + 500], per_text)
        counts += np.bincount(owner * CODES + codes, minlength=counts.size).reshape(counts.shape)
    table = np.log(counts + smoothing) - np.log(counts.sum(1, keepdims=True) + smoothing * CODES)
    return Languages(names, np.ascontiguousarray(table.T.astype(np.float32)))


def train(docs: DataFrame, most: int = TRAIN_DOCS, modulus: int = 4, held: int = 2) -> Languages:
    """Tables from an even share of documents of each language, outside the held-out part."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_bucket(F.col("doc_id"), modulus) != held))
    found = usable.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    if not found:
        return Languages([], np.zeros((CODES, 0), np.float32))
    cells = 1 << 20
    rows = [(r["lang"], min(cells, int(cells * most / len(found) / r["count"]) + 1)) for r in found]
    shares = docs.sparkSession.createDataFrame(rows, "lang string, share long")
    sampled = (
        usable.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("text").cast("string").alias("text"))
        .join(F.broadcast(shares), "lang")
        .where(F.pmod(F.xxhash64("doc_id"), F.lit(cells)) < F.col("share"))
    )
    table = fetch(sampled.select("doc_id", "text", F.col("lang").alias("label")), each=True)
    return fit(table["text"].combine_chunks(), table["label"].to_pylist())


def identify(docs: DataFrame, languages: Languages) -> DataFrame:
    """Per document: lang_pred, score and the proportions of the languages found."""
    broadcast = docs.sparkSession.sparkContext.broadcast(languages)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 19):
                names, top, shares = broadcast.value.infer(batch.column(1))
                parts = [[{"lang": broadcast.value.names[k], "share": float(row[k])} for k in np.flatnonzero(row > 0)] for row in shares]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(names, pa.string()), pa.array(top), pa.array(parts, kind)],
                    ["doc_id", "lang_pred", "score", "languages"],
                )

    return texts_of(docs).mapInArrow(
        run, "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    )


def predict(docs: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """Per document: held_out, lang_pred, score and languages."""
    return identify(docs, train(docs, most)).select(
        "doc_id", (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "languages"
    )
