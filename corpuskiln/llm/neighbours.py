"""Near-duplicate embeddings by spherical-cap filters with random product codes.

Method: the sphere is covered by caps around structured random directions. After a random
rotation a vector is cut into blocks; each block has a codebook of random unit vectors, and
a direction is one codeword of every block. A vector is list-decoded to *all* directions
whose dot product with it exceeds the cap's threshold: level by level, a partial choice of
codewords goes on only while the best rest can still lift it over the threshold. Vectors
that share a cap (and a label) are compared by exact cosine in double precision.

The threshold follows from the number of vectors and their length: a cap holds about
``CAP_ROWS`` of the largest label's vectors, by the exact tail of the sphere, but at least
as large a part of it as lies within the wanted cosine (that matters in few dimensions).
Caps that share codewords are missed together, so there are several rotations with
codebooks of their own: as many as it takes until at most ``MISSED`` of ``TRIALS`` seeded
random pairs at exactly the wanted cosine have no cap in common. Where that would take more
than ``MOST_TURNS``, caps are made larger.

Equal vectors of a label are folded before (their copies are weights). A pair is counted in
the first cap that it shares alone; a cap's rows beyond ``BLOCK`` are dealt to blocks that
are compared two by two, so no task holds a whole hot cap. Caps are counted and dealt on
rows of ids; a vector is attached to them once for each block pair. A task gives one row
for each of its vectors (links and the least vector it is chained to), never the pairs.

Defined cases: a vector that is null, empty or zero, or has null or non-finite components,
and one with a null label, links with nothing; vectors of different lengths aren't
compared; a null id links with nothing; rows that repeat an id are one vector, of different
ones that with the least label and hash, and each row gets its result; an empty table gives
no rows; extra columns are not looked at.
"""

from __future__ import annotations

from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.llm.components import components
from corpuskiln.llm.shared import cut, heavy_keys, join_dealt, partitions

THRESHOLD = 0.93
CAP_ROWS = 128
SHARED = 1.5
MOST_WORDS = 1024
TRIALS, MISSED = 2048, 2
MOST_TURNS = 48
BLOCK = 512
SEED = 41


@lru_cache(maxsize=64)
def cap_plan(most: int, cosine: float, length: int, cap_rows: int = CAP_ROWS, shared: float = SHARED) -> tuple[float, int, int, int]:
    """Threshold in standard deviations, blocks, codewords of a block, and rotations."""
    # The angle between a random vector and a direction has density sin^(length - 2).
    angle = np.linspace(0, np.pi, 200_001)
    tail = np.cumsum(np.sin(angle) ** max(0, length - 2))
    tail /= tail[-1]
    share = max(cap_rows / max(1, most), float(tail[np.searchsorted(angle, np.arccos(cosine))]))
    while True:
        share = min(0.25, share)
        z = float(np.sqrt(length) * np.cos(angle[max(1, int(np.searchsorted(tail, share)))]))
        blocks, words = _codebooks(z, cosine, share, shared)
        if length < 2:
            return z, blocks, words, 1
        x, y = random_pairs(TRIALS, length, cosine, SEED)
        turn = 0
        while len(x) > MISSED and turn <= MOST_TURNS:
            apart = ~_meet(x, y, z, blocks, words, turn)
            x, y, turn = x[apart], y[apart], turn + 1
        if turn <= MOST_TURNS or share >= 0.25:
            return z, blocks, words, turn
        share *= 2


def _codebooks(z: float, cosine: float, share: float, shared: float) -> tuple[int, int]:
    """Blocks, and codewords of each, by Gaussian tails: a first size, which rotations make up for."""
    normal = NormalDist()
    grid = np.linspace(z, z + 8, 4001)
    density = np.exp(-grid * grid / 2)
    spread = max(np.sqrt(1 - cosine * cosine), 1e-6)
    beyond = np.array([1 - normal.cdf(float(x)) for x in (z - cosine * grid) / spread])
    both = float(np.sum(density * beyond) / np.sum(density))
    caps = shared / max(both, 1e-6) / share
    blocks = next(n for n in (2, 3, 4) if caps <= MOST_WORDS**n or n == 4)
    return blocks, int(np.ceil(caps ** (1 / blocks)))


def random_pairs(n: int, length: int, cosine: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of random unit vectors at exactly this cosine."""
    rng = np.random.Generator(np.random.PCG64(seed))
    x, y = rng.standard_normal((2, n, length))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= np.sum(x * y, axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return x, cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * y


def _meet(x: np.ndarray, y: np.ndarray, z: float, blocks: int, words: int, turn: int) -> np.ndarray:
    """Whether each pair has a cap of this rotation in common."""
    out = np.zeros(len(x), bool)
    for low in range(0, len(x), 128):
        one, two = (np.stack(decode(v[low : low + 128], z, blocks, words, turn), axis=1) for v in (x, y))
        both = np.concatenate([one, two])
        rows, n = np.unique(both, axis=0, return_counts=True)
        out[low + rows[n > 1, 0]] = True
    return out


@lru_cache(maxsize=64)
def _codes(length: int, blocks: int, words: int, turn: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rotation, and each block's codewords, from the seed and the turn alone."""
    rng = np.random.Generator(np.random.PCG64(SEED + turn))
    rotation, _ = np.linalg.qr(rng.standard_normal((length, length)))
    books = []
    for part in np.array_split(np.arange(length), min(blocks, length)):
        book = rng.standard_normal((words, len(part)))
        books.append(book / np.linalg.norm(book, axis=1, keepdims=True))
    return rotation, books


def decode(vectors: np.ndarray, z: float, blocks: int, words: int, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, direction) of every direction over the threshold, for unit vectors."""
    length = vectors.shape[1]
    rotation, books = _codes(length, blocks, words, turn)
    turned = vectors @ rotation
    parts = np.array_split(np.arange(length), len(books))
    scores = [turned[:, part] @ book.T for part, book in zip(parts, books)]
    least = z / np.sqrt(length) * np.sqrt(len(books))
    rest = np.cumsum([s.max(1) for s in scores[::-1]], axis=0)[::-1]
    row, code, total = np.arange(len(vectors)), np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    for k, score in enumerate(scores):
        after = rest[k + 1] if k + 1 < len(scores) else np.zeros(len(vectors))
        sums = total[:, None] + score[row]
        at, word = np.nonzero(sums >= (least - after[row])[:, None] - 1e-12)
        total, code, row = sums[at, word], code[at] * words + word, row[at]
    return row, code


def decode_turns(vectors: np.ndarray, z: float, blocks: int, words: int, turns: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, direction) over all rotations; directions of different ones differ."""
    found = [decode(vectors, z, blocks, words, turn) for turn in range(turns)]
    return np.concatenate([row for row, _ in found]), np.concatenate([code + turn * words**blocks for turn, (_, code) in enumerate(found)])


def _valid(column) -> F.Column:
    """Whether a vector can be compared: finite, not null inside, not all zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(column, lambda x: x != 0), F.lit(False))


def _unit_rows(cells: DataFrame, threshold: float) -> DataFrame:
    """Per cap part and vector: its counted links and the least vector it chains to there."""

    def compare(ids, sides, weights, cap, lists, vectors):
        x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        # A part of two blocks compares across them; each block has a part of its own.
        near &= (sides[:, None] != sides[None, :]) | (sides[:, None] == 2)
        a, b = np.nonzero(near)
        if not len(a):
            return None
        first = _first_shared(lists, a, b)
        links = np.bincount(a[first], weights[b[first]], len(ids)).astype(np.int64)
        root = ids.copy()
        while True:
            low = root.copy()
            np.minimum.at(low, a, root[b])
            if np.array_equal(low, root):
                break
            root = low
        some = (links > 0) | (root != ids)
        return ids[some], links[some], root[some]

    def run(batches):
        kept: pa.RecordBatch | None = None
        for batch in batches:
            if kept is not None:
                batch = pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
            ends = _changes(batch)
            yield from units(batch, [0, *ends])
            kept = batch.slice(ends[-1] if ends else 0)
        if kept is not None and kept.num_rows:
            yield from units(kept, [0, kept.num_rows])

    def units(batch, edges):
        found = []
        for low, high in zip(edges[:-1], edges[1:]):
            if high - low < 2:
                continue
            part = batch.slice(low, high - low)
            _, _, cap, _, _, ids, sides, weights, lists, raw = part.columns
            own = np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])
            vectors = raw.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1).astype(np.float64)
            row = compare(ids.to_numpy(), sides.to_numpy(), weights.to_numpy(), cap[0].as_py(), own, vectors)
            if row is not None:
                found.append(row)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in range(3)], ["rep", "links", "root"])

    ordered = cells.repartition(partitions(cells.sparkSession), *_UNIT).sortWithinPartitions(*_UNIT)
    return ordered.select(*_UNIT, "rep", "side", "copies", "lower", "embedding").mapInArrow(run, "rep long, links long, root long")


_UNIT = ["label", "length", "cap", "low", "high"]


def _changes(batch: pa.RecordBatch) -> list[int]:
    """Rows of a sorted batch at which a new unit begins, after the first."""
    n = len(batch)
    new = np.zeros(max(0, n - 1), bool)
    for column in batch.columns[: len(_UNIT)]:
        new |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return (np.flatnonzero(new) + 1).tolist()


def _first_shared(lower: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether no lower cap is held by both of each pair; ``lower`` are a vector's caps below this one."""
    rows, at = np.unique(a, return_inverse=True)
    names = np.unique(np.concatenate([lower[k] for k in rows]))
    if not len(names):
        return np.ones(len(a), bool)
    holds = np.zeros((len(rows), len(names)), np.float32)
    for k, row in enumerate(rows):
        holds[k, np.searchsorted(names, lower[row])] = 1
    return (holds @ holds.T)[at, np.searchsorted(rows, b)] == 0


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, cap_rows: int = CAP_ROWS, shared: float = SHARED) -> DataFrame:
    """Per vector: links, component (least id) and whether it is kept."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), F.col("label").cast("string").alias("label"))
    usable = every.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & _valid(F.col("embedding")))
    digest = F.struct("label", F.size("embedding").alias("length"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(SEED), "embedding").alias("h2"))
    hashed = usable.withColumn("fold", digest)
    single = cut(hashed.groupBy("vec_id").agg(F.min("fold").alias("fold")))
    folded = cut(single.groupBy("fold").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("count")))
    # A row for each length of vectors.
    most = folded.groupBy("fold.label", "fold.length").count().groupBy("length").agg(F.max("count").alias("n")).collect()
    plans = {r["length"]: cap_plan(r["n"], threshold, r["length"], cap_rows, shared) for r in most}
    reps = hashed.withColumnRenamed("vec_id", "rep").join(folded.withColumnRenamed("count", "copies"), ["rep", "fold"]).dropDuplicates(["rep"])

    def decoded(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                lengths = part.column(2).to_numpy()
                caps: list = [None] * len(part)
                for length in np.unique(lengths):
                    rows = np.flatnonzero(lengths == length)
                    x = part.column(1).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).astype(np.float64)
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    row, code = decode_turns(x, *plans[int(length)])
                    order = np.lexsort((code, row))
                    cuts = np.searchsorted(row[order], np.arange(len(rows) + 1))
                    for k, r in enumerate(rows):
                        caps[r] = code[order][cuts[k] : cuts[k + 1]]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(caps, pa.list_(pa.int64()))], ["rep", "embedding", "length", "label", "copies", "caps"])

    listed = cut(
        reps.select("rep", "embedding", "fold.length", "label", "copies").mapInArrow(
            decoded, f"rep long, embedding {kind}, length int, label string, copies long, caps array<long>"
        )
    )
    # Caps are counted, and their rows dealt to blocks, before any vector moves.
    thin = listed.select("rep", F.explode("caps").alias("cap"), "label", "length").select("rep", F.struct("label", "length", "cap").alias("spot"))
    sizes = cut(thin.groupBy("spot").count().where("count > 1"))
    placed = join_dealt(thin, sizes.select("spot", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts")), "spot", heavy_keys(sizes, "spot"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    met = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.struct(
            F.least("block", other).alias("low"), F.greatest("block", other).alias("high"),
            F.when(other == F.col("block"), 2).when(F.col("block") < other, 0).otherwise(1).alias("side"),
        ),
    )
    cells = placed.withColumn("m", F.explode(met)).select("rep", "spot.cap", "m.*")
    cells = cells.join(listed, "rep").withColumn("lower", F.filter("caps", lambda c: c < F.col("cap")))
    found = cut(_unit_rows(cells, threshold))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.where("root <> rep").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    classes = cut(
        folded.join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .select("fold", "count", (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = join_dealt(single, classes.drop("count"), "fold", heavy_keys(classes, "fold")).drop("fold")
    rows = every.select("vec_id").join(linked, "vec_id", "left")
    rows = rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return rows.withColumn("kept", F.col("vec_id") == F.col("component_id"))
