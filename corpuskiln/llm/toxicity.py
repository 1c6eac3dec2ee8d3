"""Toxicity by multiple-instance learning: sentences are the instances of a document.

Method: a sentence ends at ``.``, ``!``, ``?`` or a line feed; its score is a logistic
function of its distinct words (runs of letters, A-Z as a-z, by hash) and their beginnings
of ``PREFIXES`` bytes. A document's score is the noisy-or of its sentences, one minus the product of their complements. The weights
are learned from document labels alone, by gradient descent on the noisy-or likelihood
with an L1 penalty, so the words that mark offending sentences stand out. Scoring also
gives the places of the offending sentences.

The model is fitted on at most ``TRAIN_DOCS`` labelled documents (chosen by a hash of the
id) of ``training.FIT_BYTES`` in all, a documented bound; it is a sorted table of at most ``MOST_FEATURES``
hashes and weights, and is sent to the tasks as such.

Defined cases: a null, empty or wordless text is scored by its sentences without words,
so it gets the score of the bias alone; labels that are null are left out, as are ids with
several labels that differ; without any usable label the score is 0; a very long text is
scored whole, in a slice of its own; repeated rows are scored each; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.llm.shared import bound_batches, crc_bucket, texts_of
from corpuskiln.llm.text import LETTER_BYTES, buffers, slices, span_hashes, word_spans
from corpuskiln.llm.training import labelled

TRAIN_DOCS = 6_000
TRAIN_SLICE = 500
MIN_DOCS = 4
MOST_FEATURES = 20_000
PREFIXES = (4, 6, 8)
STEPS = 160
L1 = 1e-4
THRESHOLD = 0.3
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Instances:
    """Features of sentences of documents, flat: hash and sentence of each, document by sentence."""

    features: np.ndarray
    sentence: np.ndarray
    document: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    documents: int


def instances(texts: pa.Array, wanted: np.ndarray | None = None) -> Instances:
    """Sentences with at least one letter, in order, and their distinct features.

    ``wanted``: sorted hashes of the only features that are of use.
    """
    raw, where = buffers(texts)
    starts, stops, first = word_spans(raw, where, LETTER_BYTES)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    group = np.searchsorted(np.flatnonzero(_STOP[raw]), starts) + doc
    change = np.flatnonzero(np.diff(group, prepend=-1))
    sentence = np.repeat(np.arange(len(change)), np.diff(np.append(change, len(group))))
    document = doc[change]
    begin = starts[change] - where[document] if len(change) else change
    end = stops[np.append(change[1:], len(group)) - 1] - where[document] if len(change) else change
    features, owners = [], []
    for length in (0, *PREFIXES):
        long = slice(None) if not length else np.flatnonzero(stops - starts > length)
        cut_at = stops if not length else starts[long] + length
        hashes = span_hashes(raw, starts[long], cut_at) + np.uint64(length)
        owner = sentence[long]
        if wanted is not None:
            at = np.searchsorted(wanted, hashes)
            at[at == len(wanted)] = 0
            hit = wanted[at] == hashes if len(wanted) else np.zeros(len(hashes), bool)
            hashes, owner = hashes[hit], owner[hit]
        features.append(hashes)
        owners.append(owner)
    hashes, owner = np.concatenate(features), np.concatenate(owners)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return Instances(hashes[new], owner[new], document, begin, end, len(texts))


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float

    def sentence_scores(self, x: Instances) -> np.ndarray:
        """``x`` holds only features of the model."""
        z = np.bincount(x.sentence, self.weights[np.searchsorted(self.features, x.features)], len(x.document)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def document_scores(self, x: Instances, sentences: np.ndarray) -> np.ndarray:
        quiet = np.bincount(x.document, np.log1p(-np.minimum(sentences, 1 - 1e-12)), x.documents)
        empty = np.bincount(x.document, minlength=x.documents) == 0
        return np.where(empty, 1 / (1 + np.exp(-self.bias)), -np.expm1(quiet))


def _document_frequencies(texts: pa.Array, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted features, and in how many documents of label 0 and 1 each stands."""
    x = instances(texts)
    order = np.lexsort((x.document[x.sentence], x.features))
    f, d = x.features[order], x.document[x.sentence][order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (d[1:] != d[:-1])
    f, d = f[new], d[new]
    vocabulary, at = np.unique(f, return_inverse=True)
    one = np.bincount(at, labels[d] == 1, len(vocabulary)).astype(np.int64)
    return vocabulary, np.bincount(at, minlength=len(vocabulary)) - one, one


def telling_features(texts: pa.Array, labels: np.ndarray, min_docs: int = MIN_DOCS, most: int = MOST_FEATURES) -> np.ndarray:
    """Features of some documents whose share of label 1 differs most from the whole's."""
    vocabulary, zero, one = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    for k in range(0, len(texts), TRAIN_SLICE):
        more = _document_frequencies(texts[k : k + TRAIN_SLICE], labels[k : k + TRAIN_SLICE])
        merged = np.union1d(vocabulary, more[0])
        counts = []
        for own, new in ((zero, more[1]), (one, more[2])):
            total = np.zeros(len(merged), np.int32)
            total[np.searchsorted(merged, vocabulary)] = own
            total[np.searchsorted(merged, more[0])] += new.astype(np.int32)
            counts.append(total)
        vocabulary, (zero, one) = merged, counts
    n1, n0 = max(1, int((labels == 1).sum())), max(1, int((labels == 0).sum()))
    odds = np.log((one + 0.5) / (n1 + 1)) - np.log((zero + 0.5) / (n0 + 1))
    z = odds / np.sqrt(1 / (one + 0.5) + 1 / (zero + 0.5))
    z[zero + one < min_docs] = 0
    return np.sort(vocabulary[np.argsort(-np.abs(z), kind="stable")[:most]][np.abs(np.sort(-np.abs(z))[:most]) > 2])


def _joined(parts: list[Instances]) -> Instances:
    sentences = np.cumsum([0, *(len(p.document) for p in parts)])
    documents = np.cumsum([0, *(p.documents for p in parts)])
    return Instances(
        np.concatenate([p.features for p in parts]), np.concatenate([p.sentence + s for p, s in zip(parts, sentences)]),
        np.concatenate([p.document + d for p, d in zip(parts, documents)]), np.concatenate([p.begin for p in parts]),
        np.concatenate([p.end for p in parts]), int(documents[-1]),
    )


def fit(texts: pa.Array, labels: np.ndarray, steps: int = STEPS, l1: float = L1) -> Model:
    """Weights by proximal Adam on the mean negative log-likelihood of the noisy-or."""
    if not len(labels):
        return Model(np.zeros(0, np.uint64), np.zeros(0), -40.0)
    vocabulary = telling_features(texts, labels)
    x = _joined([instances(texts[k : k + TRAIN_SLICE], vocabulary) for k in range(0, len(texts), TRAIN_SLICE)])
    at, sentence, n_sentences, size = np.searchsorted(vocabulary, x.features), x.sentence, len(x.document), len(vocabulary)
    per_doc = max(1.0, float(np.bincount(x.document, minlength=x.documents).mean()))
    bias = float(np.log(max(float(labels.mean()), 1e-4) / per_doc))
    w, m, v = np.zeros(size), np.zeros(size + 1), np.zeros(size + 1)
    y = labels.astype(float)
    for step in range(1, steps + 1):
        z = np.bincount(sentence, w[at], n_sentences) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        quiet = np.exp(np.bincount(x.document, np.log1p(-np.minimum(p, 1 - 1e-9)), x.documents))
        pull = np.where(y > 0.5, -quiet / np.maximum(1 - quiet, 1e-3), 1.0)
        dz = pull[x.document] * p / x.documents
        g = np.append(np.bincount(at, dz[sentence], size), dz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        rate = 0.1 if step < 0.7 * steps else 0.03
        scale = rate / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)
        move = scale * (m / (1 - 0.9**step))
        w = w - move[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - l1 * scale[:-1], 0)
        bias -= float(move[-1])
    alive = w != 0
    return Model(vocabulary[alive], w[alive], bias)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAIN_DOCS, modulus: int = 4, held: int = 2) -> Model:
    table = labelled(docs, labels, label, most, modulus, held)
    return fit(table["text"].combine_chunks(), table["label"].to_numpy())


SCORES = "doc_id long, score double, offending array<struct<begin:int,end:int,score:double>>"
_OFFENDING = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per document its score, and byte ranges of sentences at or above the threshold."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 19):
                x = instances(batch.column(1), model.features)
                sentences = model.sentence_scores(x)
                found: list[list] = [[] for _ in range(batch.num_rows)]
                for k in np.flatnonzero(sentences >= threshold):
                    found[x.document[k]].append({"begin": int(x.begin[k]), "end": int(x.end[k]), "score": float(sentences[k])})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(model.document_scores(x, sentences)), pa.array(found, _OFFENDING)],
                    ["doc_id", "score", "offending"],
                )

    return texts_of(docs).mapInArrow(run, SCORES)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = TRAIN_DOCS) -> DataFrame:
    """Per document: held_out, score, predicted and offending sentences."""
    scored = score(docs, train(docs, labels, most=most), threshold)
    return scored.select(
        "doc_id", (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "offending",
    )


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score below the threshold."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text, 1 << 19):
                x = instances(batch.column(batch.schema.get_field_index(text)), model.features)
                yield batch.filter(pa.array(model.document_scores(x, model.sentence_scores(x)) < threshold))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
