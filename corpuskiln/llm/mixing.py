"""Mixing sources to target weights, with disjoint blocks dealt to output shards.

Method: a multivariate-hypergeometric splitting tree. Documents of a source are dealt by a
hash to blocks; how many block draws each source gives follows from its target. The vector
of draws by source is split at random, but exactly, between the left and right halves of
the output shards, and so on down to single shards. A source's permuted blocks are then
handed to the shards in the order of those quotas, so that shards are disjoint, and each
shard is shuffled locally.

A source's target is a share of ``ratio`` times all words by its weight, at most ``cap``
times its own words; what is cut off is shared again by weight. Whole passes over a source
take each block once; the rest of a target takes blocks in permuted order, and of the
block in which the target falls the documents that fill the gap best (largest first).

The upper levels of the tree are split on the driver, down to subtrees of ``SUBTREE``
shards; tasks split those. A node's draws depend on the seed and its range of shards
alone, so it doesn't matter who splits it. The plan has a row for each draw of a block, and
blocks meet their draws by an equality join on (source, draw). One row for each source and
the quotas of each subtree (many gigabytes of text) pass through the driver.

Defined cases: a null text has no words; documents without words are placed like others
and take nothing; null is a source of its own, after all others; repeated rows are
placed each on its own, but rows that repeat an id are taken together by the last block;
rows without an id go by their text; a very long text is a size like any other and may not
fit a small gap; an empty table gives no rows; extra columns are not looked at, and
``mixed`` keeps them whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln.llm.shared import cut, partitions

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
RATIO, CAP = 1.5, 2.0
BLOCK_DOCS = 64
SHARD_WORDS = 1 << 18
SUBTREE = 1 << 10
SMALL_SOURCES = 1 << 10
SEED = 20240517
_RUN = 1024


def water_fill(sizes: Sequence[float], weights: Sequence[float], total: float, cap: float = CAP) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size."""
    shares = [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), total
    while open_:
        per = left / sum(weights[k] for k in open_)
        full = [k for k in open_ if weights[k] * per > cap * sizes[k]]
        for k in full or open_:
            shares[k] = cap * sizes[k] if full else weights[k] * per
        if not full:
            break
        left -= sum(cap * sizes[k] for k in full)
        open_ = [k for k in open_ if k not in set(full)]
    return shares


def _halves(low: int, high: int, have: np.ndarray, seed: int) -> tuple[int, np.ndarray]:
    """Where a node's shards are halved, and the draws of each source that the left half gets."""
    middle = (low + high) // 2
    share = int(have.sum()) * (middle - low) // (high - low)
    rng = np.random.Generator(np.random.PCG64([seed, low, high]))
    return middle, rng.multivariate_hypergeometric(have, share, method="marginals") if share else np.zeros_like(have)


def split_nodes(low: int, high: int, have: np.ndarray, seed: int, most: int = 1) -> Iterator[tuple[int, int, np.ndarray]]:
    """(low, high, draws of each source) of the nodes of at most ``most`` shards under a node, in order."""
    if high - low <= most:
        yield low, high, have
        return
    middle, left = _halves(low, high, have, seed)
    yield from split_nodes(low, middle, left, seed, most)
    yield from split_nodes(middle, high, have - left, seed, most)


def split_quotas(quotas: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Draws of each source (columns) for each shard (rows): exact, disjoint, seeded."""
    return np.stack([have for *_, have in split_nodes(0, shards, np.asarray(quotas, np.int64), seed)])


def plan_draws(spark, quotas: Sequence[int], shards: int, seed: int) -> DataFrame:
    """(no, draw, shard): which shard each draw of each source goes to."""
    rows, before = [], np.zeros(len(quotas), np.int64)
    for low, high, have in split_nodes(0, shards, np.asarray(quotas, np.int64), seed, SUBTREE):
        some = np.flatnonzero(have)
        rows.append((low, high, some.tolist(), have[some].tolist(), before[some].tolist()))
        before = before + have

    def run(batches):
        for batch in batches:
            for low, high, some, have, start in zip(*(c.to_pylist() for c in batch.columns)):
                some, at = np.asarray(some, np.int32), np.asarray(start, np.int64)
                for shard, _, own in split_nodes(low, high, np.asarray(have, np.int64), seed):
                    used = np.flatnonzero(own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some[used], pa.int32()), pa.array(at[used]), pa.array(own[used]), pa.array(np.full(len(used), shard, np.int64))],
                        ["no", "first", "n", "shard"],
                    )
                    at = at + own

    nodes = spark.createDataFrame(rows, "low long, high long, some array<int>, have array<long>, start array<long>")
    ranges = nodes.repartition(max(1, min(len(rows), partitions(spark)))).mapInArrow(run, "no int, first long, n long, shard long")
    return ranges.select("no", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("draw"), "shard")


def _fill_gap(items: Column, gap: Column) -> Column:
    """Which of a block's documents, largest first, bring its source nearest to its target.

    Each is taken if it still fits; at the end the smallest one left out is taken too if
    that comes nearer.
    """
    start = F.struct(
        gap.alias("gap"), F.array().cast("array<boolean>").alias("picks"), F.lit(-1).alias("spare"), F.lit(0).cast("long").alias("spare_size")
    )

    def step(acc: Column, item: Column) -> Column:
        fits = (item["size"] > 0) & (item["size"] <= acc["gap"])
        left_out = ~fits & (item["size"] > 0)
        return F.struct(
            (acc["gap"] - F.when(fits, item["size"]).otherwise(0)).alias("gap"),
            F.concat(acc["picks"], F.array(fits)).alias("picks"),
            F.when(left_out, F.size(acc["picks"])).otherwise(acc["spare"]).alias("spare"),
            F.when(left_out, item["size"]).otherwise(acc["spare_size"]).alias("spare_size"),
        )

    def finish(acc: Column) -> Column:
        nearer = (acc["spare"] >= 0) & (acc["spare_size"] - acc["gap"] < acc["gap"])
        return F.transform(acc["picks"], lambda pick, k: pick | (nearer & (k == acc["spare"])))

    return F.aggregate(items, start, step, finish)


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("-"))


def _deal(seed: int) -> Column:
    """What deals a row to a block: a hash of its id, without one of its text."""
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.when(F.col("doc_id").isNull(), F.coalesce(F.col("text").cast("string"), F.lit(""))))


@dataclass
class Mix:
    """A drawn mix: its sources, the placements of its blocks, and the documents that the last blocks give."""

    sources: DataFrame
    blocks: DataFrame
    picks: DataFrame
    few: bool
    seed: int

    def place(self, rows: DataFrame) -> DataFrame:
        """Adds ``placements`` (copy, shard, turn) to rows with ``skey`` and ``deal``.

        ``turn`` orders the copies of a shard: the local shuffle.
        """
        # A table of the sources, and one of few rows for each, are sent to all tasks only while they are small.
        sent = F.broadcast if self.few else (lambda df: df)
        block = F.pmod(F.col("deal"), F.col("n_blocks"))
        found = rows.join(sent(self.sources), "skey").withColumn("block", block)
        found = found.join(self.blocks, ["no", "block"]).join(sent(self.picks), ["no", "block", "deal"], "left")
        taken = F.when(F.col("whole") | F.coalesce("pick", F.lit(False)), F.concat("rounds", "last")).otherwise(F.col("rounds"))
        turn = lambda p: F.struct(p["copy"].alias("copy"), p["shard"].alias("shard"), F.xxhash64(F.lit(self.seed), "deal", p["copy"]).alias("turn"))
        return found.withColumn("placements", F.transform(taken, turn)).drop("no", "block", "whole", "rounds", "last", "pick", "n_blocks")


def draw_mix(sized: DataFrame, weights: Sequence[float] = WEIGHTS, ratio: float = RATIO, cap: float = CAP, seed: int = SEED) -> Mix:
    """The mix of rows (skey, size, deal)."""
    spark = sized.sparkSession
    found = sized.groupBy("skey").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect()
    found.sort(key=lambda r: (r["skey"] == "-", r["skey"]))
    few = len(found) <= SMALL_SOURCES
    sent = F.broadcast if few else (lambda df: df)
    words = [r["words"] for r in found]
    targets = water_fill(words, [weights[k % len(weights)] for k in range(len(found))], ratio * sum(words), cap)
    blocks = [1 << max(0, int(r["n"] // BLOCK_DOCS).bit_length() - 1) for r in found]
    passes = [int(t // w) if w else 1 for t, w in zip(targets, words)]
    sources = spark.createDataFrame(
        [(r["skey"], k, w, t, b, p, t - p * w) for k, (r, w, t, b, p) in enumerate(zip(found, words, targets, blocks, passes))],
        "skey string, no int, source_size long, target double, n_blocks long, passes int, rest double",
    )
    dealt = sized.join(sent(sources.select("skey", "no", "n_blocks")), "skey").withColumn("block", F.pmod("deal", "n_blocks"))
    totals = dealt.groupBy("no", "block").agg(F.sum("size").alias("words")).join(sent(sources), "no")
    turned = totals.withColumn("turn", F.pmod(F.col("block") * 2654435761 + seed % 65536, "n_blocks")).withColumn(
        "run", F.floor(F.col("turn") / _RUN)
    )
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    runs = turned.groupBy("no", "run").agg(F.sum("words").alias("words"))
    runs = runs.select("no", "run", F.coalesce(F.sum("words").over(upto(Window.partitionBy("no").orderBy("run"))), F.lit(0)).alias("base"))
    inner = upto(Window.partitionBy("no", "run").orderBy("turn"))
    ranged = cut(
        turned.withColumn("inside", F.coalesce(F.sum("words").over(inner), F.lit(0)))
        .join(runs, ["no", "run"])
        .withColumn("before", F.col("base") + F.col("inside"))
        .withColumn("whole", (F.col("before") + F.col("words") <= F.col("rest")) & (F.col("rest") > 0))
        .withColumn("gap", F.when(~F.col("whole") & (F.col("before") < F.col("rest")), F.col("rest") - F.col("before")))
        .select("no", "block", "turn", "n_blocks", "passes", "whole", "gap")
    )
    drawn = {r["no"]: r["k"] for r in ranged.groupBy("no").agg(F.count_if(F.col("whole") | F.col("gap").isNotNull()).alias("k")).collect()}
    quotas = [p * b + drawn.get(k, 0) for k, (p, b) in enumerate(zip(passes, blocks))]
    shards = max(1, int(sum(targets)) // SHARD_WORDS)
    # A block's draws: one in each pass, and one of the rest; at most ``cap`` and one.
    whole_pass = F.when(F.col("passes") > 0, F.sequence(F.lit(0), F.col("passes") - 1)).otherwise(F.array().cast("array<int>"))
    copies = F.concat(whole_pass, F.when(F.col("whole") | F.col("gap").isNotNull(), F.array("passes")).otherwise(F.array().cast("array<int>")))
    half = F.floor(F.col("n_blocks") / 2)
    draws = ranged.withColumn("copy", F.explode(copies)).withColumn(
        "draw",
        F.col("copy") * F.col("n_blocks") + F.when(F.col("copy") < F.col("passes"), F.pmod(F.col("turn") + F.col("copy") * half, "n_blocks")).otherwise(F.col("turn")),
    )
    seen = draws.join(plan_draws(spark, quotas, shards, seed), ["no", "draw"])
    placed = seen.groupBy("no", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("placed"))
    split = lambda extra: F.filter("placed", lambda p: (p["copy"] >= F.col("passes")) == F.lit(extra))
    none = F.array().cast("array<struct<copy:int,shard:bigint>>")
    whole = ranged.join(placed, ["no", "block"], "left").withColumn("placed", F.coalesce("placed", none))
    whole = cut(whole.select("no", "block", "whole", split(False).alias("rounds"), split(True).alias("last")))
    # One block for each source at most: about BLOCK_DOCS rows of two integers each.
    edge = dealt.join(sent(ranged.where(F.col("gap").isNotNull()).select("no", "block", "gap")), ["no", "block"])
    edge = edge.groupBy("no", "block", "gap", "deal").agg(F.sum("size").alias("size"))
    items = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("order"), "deal"))), lambda x: F.struct((-x["order"]).alias("size"), x["deal"].alias("deal")))
    picks = (
        edge.groupBy("no", "block", "gap").agg(items.alias("items"))
        .withColumn("item", F.explode(F.arrays_zip("items", _fill_gap(F.col("items"), F.col("gap")).alias("pick"))))
        .select("no", "block", "item.items.deal", "item.pick")
    )
    return Mix(sources.select("skey", "no", "n_blocks", "source_size", "target"), whole, cut(picks), few, seed)


def _words() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def assign(docs: DataFrame, weights: Sequence[float] = WEIGHTS, ratio: float = RATIO, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """Per document: size, source_size, target and placements (copy, shard, turn)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _source_key().alias("skey"), _words().alias("size"), _deal(seed).alias("deal"))
    sized = cut(keyed)
    mix = draw_mix(sized, weights, ratio, cap, seed)
    return mix.place(sized).select("doc_id", "size", "source_size", "target", "placements")


def shuffled(assigned: DataFrame) -> DataFrame:
    """One row per copy: shard and place in it after the local shuffle."""
    copies = assigned.select("doc_id", "size", F.explode("placements").alias("p")).select("doc_id", "size", "p.*")
    order = Window.partitionBy("shard").orderBy("turn", "doc_id", "copy")
    return copies.withColumn("place", F.row_number().over(order) - 1)


def taken(assigned: DataFrame) -> DataFrame:
    """Per document the words that the mix takes of it, repeats counted."""
    return assigned.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("placements")).alias("taken"), "placements"
    )


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, ratio: float = RATIO, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, all columns as they are, once for each copy, dealt to shards and shuffled there."""
    key, deal = _source_key(), _deal(seed)
    mix = draw_mix(cut(docs.select(key.alias("skey"), _words().alias("size"), deal.alias("deal"))), weights, ratio, cap, seed)
    rows = docs.select(key.alias("skey"), deal.alias("deal"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    copies = mix.place(rows).select("row", F.explode("placements").alias("p"))
    dealt = copies.repartition(partitions(docs.sparkSession), "p.shard").sortWithinPartitions("p.shard", "p.turn")
    return dealt.select("row.*")
