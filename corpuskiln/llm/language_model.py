"""A hashed maximum-entropy language model with a class-factored softmax.

Method: the probability of a token is that of its class given what stands before it, times
that of the token in its class. The class part is a maximum-entropy model: the weights of
hashed features (the word before, the pair before, the words two and three back as skips,
the classes of the last three tokens) are added and go through a softmax over the classes.
It is trained by distributed gradient updates: every task runs Adagrad steps over its part
of the training texts from the same start, and the weights are averaged over the tasks by
their tokens, ``ROUNDS`` times. Scoring runs in sparse numpy batches.

A word's class comes from how it ends (its kind): kinds are clustered by how they occur
together in the training documents, all of which are counted; the mark after the last
letter makes four classes of each cluster, and the end of a text is a class of its own. In
its class a word has its share of the class's smoothed counts; what a class gives to words
never seen is estimated from its words seen once, and all words never seen in a class are
one event, as in the base score. So the probabilities of all events add up to one.

Counts cover all training texts. The ``TABLE_WORDS`` most frequent words (a documented
bound) are sent to the scoring tasks; all others are looked up by a join on their hash, so
nothing that grows with the input is broadcast.

Defined cases: a null or empty text is the end alone; a null id is scored but not learned
from; rows repeated in id and text are each given out; a very long text is scored in a
slice of its own; without training texts the counts
are zero; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.llm.shared import bound_batches, crc_bucket, cut, partitions, texts_of
from corpuskiln.llm.text import LETTER_BYTES, buffers, mix64, slices, span_hashes, word_spans

CELLS, MARKS, CLUSTERS = 256, 4, 6
END_KIND = CELLS * MARKS
CLASSES = CLUSTERS * MARKS + 1
FEATURES = 1 << 14
PER_TOKEN = 5
BATCH = 1 << 14
RATE = 0.4
ROUNDS = 1
TABLE_WORDS = 1 << 18
EXACT_COUNTS = 1_000_000
BLOCK_FEATURES = 256
END_HASH = np.uint64(0x2545F4914F6CDD1D)
_START = np.array([0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x3C6EF372FE94F82B], np.uint64)
_CLOSING = np.zeros(256, bool)
_CLOSING[[ord(c) for c in ".?!"]] = True


@dataclass
class Tokens:
    """Hash and kind of every token of some texts, ends included; the first token of each."""

    hashes: np.ndarray
    kinds: np.ndarray
    first: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    raw, where = buffers(texts)
    starts, stops, first = word_spans(raw, where)
    hashes = span_hashes(raw, starts, stops)
    kinds = np.zeros(len(starts), np.int16)
    if len(starts):
        letter = LETTER_BYTES[raw]
        last = np.maximum.accumulate(np.where(letter, np.arange(len(raw)), -1))[stops - 1]
        none = last < starts
        at = np.where(none, stops - 1, last)
        low = raw | np.where((raw >= 65) & (raw <= 90), 32, 0).astype(np.uint8)
        code = low[at].astype(np.uint32)
        for back in (1, 2):
            code = code * np.uint32(31) + np.where(at - back >= starts, low[np.maximum(at - back, 0)], 0).astype(np.uint32)
        cell = (code * np.uint32(2654435761)) >> np.uint32(24)
        final = raw[stops - 1]
        mark = np.where(none, 3, np.where(letter[stops - 1], 0, np.where(_CLOSING[final], 1, 2)))
        kinds = (cell.astype(np.int64) * MARKS + mark).astype(np.int16)
    ends = first[1:]
    return Tokens(np.insert(hashes, ends, END_HASH), np.insert(kinds, ends, END_KIND), first + np.arange(len(first)))


def class_features(t: Tokens, classes: np.ndarray) -> np.ndarray:
    """Indexes of the features that stand before each token (rows: features)."""
    n = len(t.hashes)
    before = np.empty((3, n), np.uint64)
    kinds = np.full((3, n), CLASSES, np.int64)
    for back in (1, 2, 3):
        before[back - 1, back:] = t.hashes[:-back] if n > back else t.hashes[:0]
        kinds[back - 1, back:] = classes[:-back] if n > back else classes[:0]
        for k in range(back):
            at = t.first[:-1] + k
            at = at[at < t.first[1:]]
            before[back - 1, at] = _START[k]
            kinds[back - 1, at] = CLASSES
    one, two, three = before
    shape = (kinds[0] * (CLASSES + 1) + kinds[1]) * (CLASSES + 1) + kinds[2]
    mixed = (mix64(one), mix64(mix64(one) + two * np.uint64(5)), mix64(two + np.uint64(17)), mix64(three + np.uint64(29)), mix64(shape.astype(np.uint64) + np.uint64(1 << 40)))
    return np.stack([(m % np.uint64(FEATURES)).astype(np.int32) for m in mixed])


def _softmax(weights: np.ndarray, index: np.ndarray) -> np.ndarray:
    z = weights[index[0]]
    for row in index[1:]:
        z = z + weights[row]
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def adagrad(weights: np.ndarray, squares: np.ndarray, index: np.ndarray, classes: np.ndarray) -> None:
    """Steps over batches of tokens, in place."""
    for low in range(0, len(classes), BATCH):
        own, y = index[:, low : low + BATCH], classes[low : low + BATCH]
        p = _softmax(weights, own)
        p[np.arange(len(y)), y] -= 1
        flat = own.ravel()
        pull = np.ascontiguousarray(p.T)
        step = np.stack([np.bincount(flat, np.tile(pull[k], PER_TOKEN), FEATURES) for k in range(CLASSES)], axis=1).astype(np.float32)
        squares += step * step
        weights -= RATE * step / np.sqrt(squares + 1e-3)


def _rows(matrix: np.ndarray, kind: type) -> pa.RecordBatch:
    """The rows of a matrix as (key, values), values as the bytes of numbers of a kind."""
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(matrix)), pa.int32()), pa.array([r.astype(kind).tobytes() for r in matrix], pa.binary())], ["key", "values"])


def _summed(rows: DataFrame, kind: type) -> DataFrame:
    """Element-wise sums of ``values`` by ``key``; a task holds one array for each of its keys."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                row = np.frombuffer(value.as_py(), kind).astype(np.float64)
                total[key] = total[key] + row if key in total else row
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["key", "values"])

    return rows.repartition(partitions(rows.sparkSession), "key").mapInArrow(run, "key int, values binary")


def word_counts(train: DataFrame) -> DataFrame:
    """(h, kind, c) of all training tokens."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def out():
            h = np.concatenate([x[0] for x in held])
            _, at, back = np.unique(h, return_index=True, return_inverse=True)
            c = np.bincount(back, np.concatenate([x[2] for x in held])).astype(np.int64)
            kind = np.concatenate([x[1] for x in held])[at]
            for low in range(0, len(at), 1 << 16):
                part = slice(low, low + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(h[at[part]].view(np.int64)), pa.array(kind[part].astype(np.int32)), pa.array(c[part])], ["h", "kind", "c"])

        for whole in batches:
            for batch in slices(whole, "text"):
                t = tokens(batch.column(0))
                h, at, n = np.unique(t.hashes, return_index=True, return_counts=True)
                held.append((h, t.kinds[at], n))
                size += len(h)
                if size > 1 << 21:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    return train.select("text").mapInArrow(run, "h long, kind int, c long").groupBy("h", "kind").agg(F.sum("c").alias("c"))


def cluster_of_cells(train: DataFrame) -> np.ndarray:
    """Cluster of each word ending, from how endings occur together in all training texts."""

    def run(batches):
        gram = np.zeros((CELLS, CELLS), np.float32)
        for whole in batches:
            for batch in slices(whole, "text"):
                t = tokens(batch.column(0))
                n = batch.num_rows
                doc = np.repeat(np.arange(n), np.diff(t.first))
                word = t.kinds != END_KIND
                x = np.bincount(doc[word] * CELLS + t.kinds[word] // MARKS, minlength=n * CELLS).reshape(n, CELLS).astype(np.float32)
                x = np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1))
                gram += x.T @ x
        yield _rows(gram, np.float32)

    # CELLS rows of CELLS numbers, whatever the input's size.
    rows = _summed(train.select("text").mapInArrow(run, "key int, values binary"), np.float32).collect()
    gram = np.zeros((CELLS, CELLS))
    for r in rows:
        gram[r["key"]] = np.frombuffer(r["values"])
    return spectral(gram)


def spectral(gram: np.ndarray, clusters: int = CLUSTERS) -> np.ndarray:
    """Clusters of rows by leading eigenvectors; deterministic."""
    degree = np.sqrt(np.maximum(np.diag(gram), 1e-9))
    _, vectors = np.linalg.eigh(gram / degree[:, None] / degree[None, :])
    x = vectors[:, -clusters:]
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = [x[int(np.argmax(np.diag(gram)))]]
    while len(centres) < clusters:
        centres.append(x[int(np.argmin(np.max(np.stack([x @ c for c in centres]), axis=0)))])
    c = np.stack(centres)
    for _ in range(30):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == k].sum(0) if (own == k).any() else c[k] for k in range(clusters)])
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return np.argmax(x @ c.T, axis=1)


def class_map(cells: np.ndarray) -> np.ndarray:
    """Class of each kind."""
    kinds = np.arange(CELLS * MARKS)
    return np.append(cells[kinds // MARKS] * MARKS + kinds % MARKS, CLASSES - 1).astype(np.int64)


def train_weights(train: DataFrame, classes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One round: every task steps from ``weights``; the mean by tokens comes back."""
    start = train.sparkSession.sparkContext.broadcast((classes, weights))

    def run(batches):
        kind_class, w = start.value
        w, squares, seen = w.copy(), np.zeros_like(w), 0
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                t = tokens(batch.column(0))
                y = kind_class[t.kinds]
                adagrad(w, squares, class_features(t, y), y)
                seen += len(y)
        if seen:
            change = ((w - start.value[1]) * (seen / 1e6)).reshape(-1, BLOCK_FEATURES * CLASSES)
            tail = np.zeros((1, BLOCK_FEATURES * CLASSES))
            tail[0, 0] = seen / 1e6
            yield _rows(np.concatenate([change, tail]), np.float16)

    total = weights.reshape(-1, BLOCK_FEATURES * CLASSES).copy()
    summed = _summed(train.select("text").mapInArrow(run, "key int, values binary"), np.float16)
    rows = {r["key"]: np.frombuffer(r["values"]) for r in summed.toLocalIterator()}
    seen = rows.pop(len(total), np.zeros(1))[0]
    for key, value in rows.items():
        total[key] += (value / max(seen, 1e-9)).astype(np.float32)
    return total.reshape(weights.shape)


@dataclass
class Model:
    classes: np.ndarray  # class of each kind
    weights: np.ndarray
    words: np.ndarray  # sorted hashes of the most frequent words
    counts: np.ndarray
    share: np.ndarray  # log10 of what a unit of smoothed count weighs in each class
    unseen: np.ndarray  # log10 of what all unseen words of a class weigh
    train_tokens: int
    vocabulary: int


def fit(train: DataFrame, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model, and the counts of all training words."""
    bound_batches(train.sparkSession)
    train = train.select(F.col("text").cast("string").alias("text"))
    counts = cut(word_counts(train))
    classes = class_map(cluster_of_cells(train))
    weights = np.zeros((FEATURES, CLASSES), np.float32)
    for _ in range(rounds):
        weights = train_weights(train, classes, weights)
    mass, once, kinds = np.zeros(CLASSES), np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("kind").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("s")).collect():
        k = classes[r["kind"]]
        mass[k], once[k], kinds[k] = mass[k] + r["n"], once[k] + r["s"], kinds[k] + r["v"]
    unseen = np.clip((once + 0.5) / (mass + 1), 1e-6, 0.5)
    unseen[-1] = 1e-9
    unseen[kinds == 0] = 1 - 1e-9
    share = np.log10(1 - unseen) - np.log10(np.maximum(mass + 0.5 * kinds, 0.5))
    # A histogram of counts (in steps of a thousandth from ``EXACT_COUNTS`` on) gives the least
    # count whose words fit the table; no sort, no limit.
    exact = F.col("c") < EXACT_COUNTS
    step = F.when(exact, F.col("c")).otherwise(EXACT_COUNTS + F.floor(1000 * F.log(F.col("c") / EXACT_COUNTS))).cast("long")
    sizes = counts.groupBy(step.alias("c")).agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("c", "descending")])
    fits = np.cumsum(sizes["n"].to_numpy()) <= TABLE_WORDS
    least = int(sizes["c"][int(fits.sum()) - 1].as_py()) if fits.any() else 1 << 62
    top = counts.where(step >= least).select("h", "c").toArrow()
    words, held = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.argsort(words)
    return Model(classes, weights, words[order], held[order], share, np.log10(unseen), int(mass.sum()), int(kinds.sum())), counts


PARTS = "doc_id long, digest long, h long, class int, tf long, n_tokens long, n_known long, base double, score double"


def _score_parts(docs: DataFrame, model: Model) -> DataFrame:
    """Per text a row (class -1) with what its frequent words give; per rare word of it a row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        floor = np.log10(m.train_tokens + 0.5 * (m.vocabulary + 1))
        logs = np.log10(m.counts + 0.5)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                t = tokens(batch.column(1))
                y = m.classes[t.kinds]
                index = class_features(t, y)
                class_part = np.empty(len(y))
                for low in range(0, len(y), BATCH):
                    part = slice(low, low + BATCH)
                    p = _softmax(m.weights, index[:, part])
                    class_part[part] = np.log10(np.maximum(p[np.arange(len(p)), y[part]], 1e-30))
                names, back = np.unique(t.hashes, return_inverse=True)
                at = np.searchsorted(m.words, names)
                at[at == len(m.words)] = 0
                hit = (m.words[at] == names if len(m.words) else np.zeros(len(names), bool))[back]
                at = at[back]
                own = np.zeros(len(y))
                own[hit] = logs[at[hit]] if len(logs) else 0
                begin = t.first[:-1]
                base = np.add.reduceat(np.where(hit, own - floor, 0), begin)
                score = np.add.reduceat(class_part + np.where(hit, own + m.share[y], 0), begin)
                known = np.add.reduceat(hit.astype(np.int64), begin)
                doc = np.repeat(np.arange(batch.num_rows), np.diff(t.first))
                digest = np.add.reduceat(mix64(t.hashes + (np.arange(len(y)) - begin[doc]).astype(np.uint64)), begin).view(np.int64)
                rare = np.flatnonzero(~hit)
                order = rare[np.lexsort((t.hashes[rare], doc[rare]))]
                new = np.ones(len(order), bool)
                new[1:] = (t.hashes[order][1:] != t.hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                tf = np.diff(np.append(np.flatnonzero(new), len(order)))
                lead = order[new]
                n, r = batch.num_rows, len(lead)
                ids = batch.column(0)
                rows = np.concatenate([np.arange(n), doc[lead]])
                zeros = np.zeros(r, np.int64)
                # Whole texts have a place of their own in the join, copies of one text too.
                own_place = mix64(digest.view(np.uint64) ^ mix64(ids.fill_null(0).to_numpy().view(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(rows)), pa.array(digest[rows]),
                        pa.array(np.concatenate([own_place, t.hashes[lead]]).view(np.int64)),
                        pa.array(np.concatenate([np.full(n, -1), y[lead]]), pa.int32()), pa.array(np.concatenate([np.ones(n, np.int64), tf])),
                        pa.array(np.concatenate([np.diff(t.first), zeros])), pa.array(np.concatenate([known, zeros])),
                        pa.array(np.concatenate([base, zeros])), pa.array(np.concatenate([score, zeros])),
                    ],
                    ["doc_id", "digest", "h", "class", "tf", "n_tokens", "n_known", "base", "score"],
                )

    return texts_of(docs).mapInArrow(run, PARTS)


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Per document: tokens, known tokens, base score and model score."""
    parts = _score_parts(docs, model).join(counts.select("h", "c"), "h", "left")
    floor = float(np.log10(model.train_tokens + 0.5 * (model.vocabulary + 1)))
    share, unseen = F.lit(model.share.tolist()), F.lit(model.unseen.tolist())
    rare, known = F.col("class") >= 0, F.col("c").isNotNull()
    log = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    inside = F.when(known, log + F.get(share, F.col("class"))).otherwise(F.get(unseen, F.col("class")))
    whole = parts.groupBy("doc_id", "digest").agg(
        F.count_if(~rare).alias("copies"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.when(rare & known, F.col("tf")).otherwise(F.col("n_known"))).alias("n_known"),
        F.sum(F.when(rare, F.col("tf") * (log - floor)).otherwise(F.col("base"))).alias("base_score"),
        F.sum(F.when(rare, F.col("tf") * inside).otherwise(F.col("score"))).alias("score"),
    )
    each = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    per = lambda name: (F.col(name) / F.col("copies")).cast("long").alias(name)
    return each.select(
        "doc_id", per("n_tokens"), per("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"),
    )


def held_out_scores(docs: DataFrame, modulus: int = 5, held: int = 1, rounds: int = ROUNDS) -> DataFrame:
    """Scores of all documents by a model learned outside the held-out part."""
    bucket = crc_bucket(F.col("doc_id"), modulus)
    model, counts = fit(docs.where(bucket != held), rounds)
    scored = score(docs, model, counts)
    return scored.select("doc_id", F.coalesce(crc_bucket(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
