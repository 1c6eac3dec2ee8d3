"""Quality by nearest-neighbour voting in a latent-semantic space.

Method: a text becomes a bag of terms - runs of three byte classes (lower case, upper case,
digit, space, line feed, other characters, each ASCII mark) and how often its words and
lines repeat. Log counts, weighted by how rare a term is among the labelled documents and
scaled to length one, are projected on the leading singular vectors of the labelled
documents' matrix. Every document is compared with *all* labelled vectors by exact cosine,
in blocks of matrix products, and the ``NEIGHBOURS`` nearest vote with their similarity
(raised to ``SHARPNESS``) as weight.

The labelled vectors come from at most ``TRAIN_DOCS`` documents (chosen by a hash of the
id) of ``training.FIT_BYTES`` in all, a documented bound, so what is broadcast is at most
``TRAIN_DOCS * DIMENSIONS + TERMS * DIMENSIONS`` numbers of four bytes.

Defined cases: a null or empty text has the zero vector and gets the share of label 1
among the labelled documents; without usable labels the score is 0.5; labels that are
null, or differ for one id, are left out; of labelled documents at equal distance the
one with the lesser id votes; a very long text is scored whole, in a slice of its own;
repeated rows are scored each; an empty table
gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.llm.shared import bound_batches, crc_bucket, texts_of
from corpuskiln.llm.text import buffers, slices, span_hashes, word_spans
from corpuskiln.llm.training import labelled

TRAIN_DOCS = 4_000
TERMS = 3072
DIMENSIONS = 64
NEIGHBOURS = 25
SHARPNESS = 4
THRESHOLD = 0.5
BLOCK = 512
_CLASSES = 48
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_CLASS[[9, 10, 13, 32]] = 5, 6, 6, 7
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = np.arange(8, 40)
_SHAPES = TERMS - 256
_NOT_FEED = np.ones(256, bool)
_NOT_FEED[10] = False


def _repetition(raw: np.ndarray, where: np.ndarray, member: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per text the number of spans, and of those that another span of it equals before."""
    starts, stops, first = word_spans(raw, where) if member is None else word_spans(raw, where, member)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    hashes = span_hashes(raw, starts, stops)
    order = np.lexsort((hashes, doc))
    same = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return n, np.bincount(doc[order][1:][same], minlength=len(n))


def term_counts(texts: pa.Array) -> np.ndarray:
    """Counts of every text's terms, as a dense matrix."""
    raw, where = buffers(texts)
    size = len(texts)
    out = np.zeros((size, TERMS), np.float32)
    if len(raw):
        doc = np.repeat(np.arange(size), np.diff(where))
        c = _CLASS[raw]
        code = (c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:]
        inside = doc[:-2] == doc[2:]
        term = code[inside] * 2654435761 % 4294967291 % _SHAPES
        out[:, :_SHAPES] = np.bincount(doc[:-2][inside] * _SHAPES + term, minlength=size * _SHAPES).reshape(size, _SHAPES)
    words, words_again = _repetition(raw, where)
    lines, lines_again = _repetition(raw, where, _NOT_FEED)
    bytes_ = np.diff(where)
    rows = np.flatnonzero(words)
    scale = np.log1p(bytes_[rows]) * 8
    for k, share in enumerate(
        (words_again[rows] / words[rows], lines_again[rows] / np.maximum(lines[rows], 1), np.minimum(bytes_[rows] / words[rows] / 20, 1), np.log1p(words[rows]) / 12)
    ):
        step = np.minimum((share * 16).astype(int), 15)
        for near, weight in ((-1, 0.5), (0, 1.0), (1, 0.5)):
            at = np.clip(step + near, 0, 15)
            out[rows, _SHAPES + 32 * k + at] += scale * weight
    return out


def _nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest of each row; of equal ones the first."""
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(cosine, near, 1).min(1)
    for row in np.flatnonzero((cosine >= least[:, None]).sum(1) > k):
        near[row] = np.argsort(-cosine[row], kind="stable")[:k]
    return near


@dataclass
class Space:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        z = x @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def vote(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        z = self.project(counts)
        k = min(NEIGHBOURS, len(self.labels))
        out = np.empty(len(z))
        for i in range(0, len(z), BLOCK):
            cosine = z[i : i + BLOCK] @ self.vectors.T
            near = _nearest(cosine, k)
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(float) ** SHARPNESS
            total = weight.sum(1)
            share = (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-12)
            out[i : i + BLOCK] = np.where(total > 1e-9, share, self.labels.mean())
        return np.clip(out, 0, 1)


def fit(texts: pa.Array, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Space:
    """Leading right singular vectors of the labelled documents' weighted term matrix."""
    if not len(labels):
        return Space(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels)
    df = np.zeros(TERMS)
    x = np.empty((len(texts), TERMS), np.float32)
    for k in range(0, len(texts), 250):
        part = term_counts(texts[k : k + 250])
        df += (part > 0).sum(0)
        np.log1p(part, out=x[k : k + 250])
    idf = np.log((1 + len(x)) / (1 + df)).astype(np.float32) + np.float32(0.2)
    idf[df == 0] = 0
    for k in range(0, len(x), 250):
        part = x[k : k + 250]
        part *= idf
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    gram = x.T @ x
    basis = np.random.Generator(np.random.PCG64(11)).standard_normal((TERMS, min(dimensions + 16, len(x)))).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(gram @ basis)
    values, turn = np.linalg.eigh(basis.T @ gram @ basis)
    axes = (basis @ turn[:, np.argsort(-values)[:dimensions]]).astype(np.float32)
    vectors = x @ axes
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return Space(idf, axes, vectors, labels.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_DOCS, modulus: int = 3, held: int = 1) -> Space:
    table = labelled(docs, labels, label, most, modulus, held)
    return fit(table["text"].combine_chunks(), table["label"].to_numpy())


def score(docs: DataFrame, space: Space) -> DataFrame:
    """Per document the vote of its nearest labelled documents."""
    broadcast = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 19):
                votes = [broadcast.value.vote(term_counts(batch.column(1)[k : k + 250])) for k in range(0, batch.num_rows, 250)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(votes))], ["doc_id", "score"])

    return texts_of(docs).mapInArrow(
        run, "doc_id long, score double"
    )


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = TRAIN_DOCS) -> DataFrame:
    """Per document: held_out, score and predicted."""
    return score(docs, train(docs, labels, most=most)).select(
        "doc_id", (crc_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, space: Space, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score at or above the threshold."""
    broadcast = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text, 1 << 19):
                for low in range(0, batch.num_rows, 250):
                    part = batch.slice(low, 250)
                    votes = broadcast.value.vote(term_counts(part.column(part.schema.get_field_index(text))))
                    yield part.filter(pa.array(votes >= threshold))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
