"""Exact n-gram Jaccard self-join with token-combination prefixes.

A document's set holds the 64-bit hashes of its distinct word shingles. Two sets link when
``100 * intersection >= percent * union``. Such sets share at least ``k`` tokens among their
first ``size - ceil(percent% of size) + k`` tokens in any one order of all tokens, which
gives the indexes below; every candidate is verified on the whole sets.

1. Documents with equal sets are folded to their least id.
2. Tokens are ordered by hash; each document lists a prefix extended by ``EXTRA``
   tokens and a part of its length. A token
   that more than ``FREQUENT`` lists hold is *frequent* and goes to the end of the order.
3. *Plain* documents still have a whole prefix of rare tokens in their list: they are
   indexed by single rare tokens, and a pair must share as many as the extension promises.
   A list is the whole set at most, so it promises no more tokens than the set needs, and
   one fewer for each frequent token in it.
4. The other documents (*crowded*: most of their tokens are frequent, as in large groups of
   near copies) are met with plain ones by single rare tokens, and with each other in an
   order of their own (tokens rare among them first): by single tokens that are rare among
   them, and by two-token combinations of frequent ones. For those the prefix is extended
   by the number of token classes of the size, so that one class holds two shared tokens;
   only combinations within a class are indexed, which keeps them linear in the prefix.
5. Posting lists of frequent combinations may be long. First every document is compared
   with the leader of its list alone, in several turns; lists that lie in one component then
   need nothing more, and of the others at last all pairs across components are looked at,
   in blocks of ``BLOCK`` rows so that no task holds a whole list. Parities of
   hashed cells of each set give an exact upper bound of the similarity before sets are moved.

No pair is lost: a pair is left out only if its sets cannot reach the threshold, or if its
documents are already known to be connected.

Defined cases: a null, empty or wordless text has an empty set and links with nothing; with
fewer words than the shingle's, the whole sequence is the one shingle; a null id links with
nothing and is its own (null) component; rows that repeat an id are given out each; a very
long text is one set, in a slice of its own; an empty table gives no rows; extra columns
are not looked at. Sets are of 64-bit hashes: different shingles of two documents are
taken for equal with a chance of 2^-64 for each pair of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln.llm.components import components
from corpuskiln.llm.shared import bound_batches, cut, discard, texts_of
from corpuskiln.llm.text import mix64, shingle_hashes, slices, word_hashes

EXTRA, EXTRA_PART = 8, 4
FREQUENT = 8
CLASS_TOKENS = 4
BLOCK = 512
SALTS = 64
ORDERS = 4
TURNS = 3
BITS = 1024
MOST_MARKS = 1 << 25


def needed(size, percent: int):
    """Least overlap that a set of this size needs with any partner."""
    return (percent * size + 99) // 100


def prefix_length(size, percent: int, k: int = 1):
    """Tokens of which similar sets share at least ``k``."""
    return size - needed(size, percent) + k


def token_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, first = word_hashes(texts)
    return [np.unique(shingle_hashes(words[a:b], width)) for a, b in zip(first[:-1], first[1:])]


def parities(tokens: np.ndarray) -> np.ndarray:
    """For each of ``BITS`` cells whether an odd number of tokens falls in it, as longs.

    Tokens that two sets share cancel out in the exclusive or of their parities, so its bits
    are at most as many as the tokens that only one of them holds, and nearly as many.
    """
    odd = np.bincount((tokens % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def promised(size, percent: int):
    """Shared tokens that the extended prefix of a set of this size gives."""
    return EXTRA + prefix_length(size, percent) // EXTRA_PART


def _sql(form: str, size: str, percent: int) -> Column:
    """``needed`` or ``promised`` of a column, as a 32-bit integer."""
    need = f"({percent} * {size} + 99) div 100"
    return F.expr(f"cast({need} as int)" if form == "needed" else f"cast({EXTRA} + ({size} - {need} + 1) div {EXTRA_PART} as int)")


def _promise(n_frequent: Column | int, percent: int) -> Column:
    """Rare tokens that a set shares with any similar one, with so many frequent tokens in its list."""
    return F.greatest(F.lit(1), F.least(_sql("needed", "n", percent), _sql("promised", "n", percent)) - n_frequent).cast("int")


def features(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Set size, digest of the set, and the extended prefix in hash order."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                sizes, ones, twos, lists = [], [], [], []
                for tokens in token_sets(batch.column(1), width):
                    n = len(tokens)
                    sizes.append(n)
                    ones.append(int(mix64(tokens).sum(dtype=np.uint64).view(np.int64)) if n else 0)
                    twos.append(int(mix64(tokens ^ np.uint64(0x5DEECE66D1CE4E5B)).sum(dtype=np.uint64).view(np.int64)) if n else 0)
                    lists.append(tokens[: prefix_length(n, percent, promised(n, percent))].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int32()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                    ["doc", "n", "h1", "h2", "listed"],
                )

    return texts_of(docs).mapInArrow(
        run, "doc long, n int, h1 long, h2 long, listed array<long>"
    )


def _marks(wanted: DataFrame, n: int) -> np.ndarray:
    """A bit for the hash of each of ``n`` wanted ids, in at most ``MOST_MARKS`` bits."""
    bits = 1 << min(MOST_MARKS.bit_length() - 1, max(16, (64 * n).bit_length()))
    at = F.pmod(F.xxhash64("doc"), F.lit(bits))
    words = wanted.groupBy(F.floor(at / 64).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc), {bits}) % 64 as int))")).alias("bits"))
    found = words.toArrow()  # at most MOST_MARKS / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def whole_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc, n, tokens, bits) of the wanted documents, from their texts, and of a few others.

    While a table of hashed bits can tell them apart, it is sent to the scanning tasks and
    no text is moved; every use of the sets joins them by id. For more documents than that
    the texts are joined with the wanted ids.
    """
    n = wanted.count()
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    marked = 8 * n <= MOST_MARKS
    if not marked:
        texts = texts.join(wanted, "doc", "left_semi")
    marks = docs.sparkSession.sparkContext.broadcast(_marks(wanted, n) if marked else np.full(1, -1).view(np.uint64))

    def run(batches):
        for whole in batches:
            at = whole.column(2).to_numpy() % (64 * len(marks.value))
            word, bit = at // 64, (at % 64).astype(np.uint64)
            whole = whole.filter(pa.array((marks.value[word] >> bit & np.uint64(1)).astype(bool)))
            for batch in slices(whole, "text"):
                sets = token_sets(batch.column(1), width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([parities(s) for s in sets], pa.list_(pa.int64()))],
                    ["doc", "n", "tokens", "bits"],
                )

    bound_batches(docs.sparkSession)
    return texts.withColumn("hash", F.xxhash64("doc")).mapInArrow(run, "doc long, n int, tokens array<long>, bits array<long>").where("n > 0")


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return (F.least(a, b) * 100).cast("long") >= F.greatest(a, b).cast("long") * percent


def _bits_fit(a: str, b: str, percent: int) -> Column:
    """Whether the parities that differ allow the threshold: each costs a token of one set alone."""
    differ = F.aggregate(F.zip_with(f"{a}.bits", f"{b}.bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return differ * (100 + percent) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - percent)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose whole sets reach the threshold."""
    left = sets.select(F.col("doc").alias("a"), F.col("tokens").alias("left"))
    right = sets.select(F.col("doc").alias("b"), F.col("tokens").alias("right"))
    shared = F.size(F.array_intersect("left", "right"))
    return (
        pairs.join(left, "a").join(right, "b").withColumn("shared", shared)
        .where(F.col("shared") * (100 + percent) >= (F.size("left") + F.size("right")) * percent)
        .select("a", "b")
    )


def _combination_keys(crowded: DataFrame, percent: int) -> DataFrame:
    """(key, doc, n, bits) of crowded documents; ``rare`` and ``frequent`` are their tokens.

    A document stands under the size class of its own size, and under the next one if a
    partner there could be similar; the larger of a pair's classes is the pair's.
    """

    def run(batches):
        for batch in batches:
            out: list[list] = [[], []]
            n_of, rare_of, frequent_of, left_of = (batch.column(k).to_pylist() for k in (1, 2, 3, 4))
            for k, n in enumerate(n_of):
                keys = [np.asarray(rare_of[k] or [], np.int64)]
                frequent = np.unique(np.asarray(frequent_of[k] or [], np.int64).view(np.uint64))
                spare = prefix_length(n, percent) - left_of[k]
                if spare > 0 and n > 1:
                    low = n.bit_length() - 1
                    for size in (low, low + 1) if n * 100 >= percent << (low + 1) else (low,):
                        classes = max(1, ((1 << size) * (100 - percent) // 100) // CLASS_TOKENS)
                        used = frequent[: spare + classes]
                        kind = (mix64(used) % np.uint64(classes)).astype(np.int64)
                        for one in np.unique(kind):
                            own = used[kind == one]
                            a, b = np.triu_indices(len(own), 1)
                            keys.append(mix64(mix64(own[a]) + own[b] * np.uint64(3) + np.uint64(size)).view(np.int64))
                keys = np.unique(np.concatenate(keys))
                out[0].append(keys)
                out[1].append(np.full(len(keys), k))
            if out[0]:
                rows = np.concatenate(out[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out[0])), batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), batch.column(5).take(pa.array(rows))],
                    ["key", "doc", "n", "bits"],
                )

    return crowded.select("doc", "n", "rare", "frequent", "n_rare", "bits").mapInArrow(run, "key long, doc long, n int, bits array<long>")


def _leader_pairs(keyed: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs of each document with the leader of each of its lists, across components.

    The first turn has ``ORDERS`` orders of documents, so that few documents lead; later
    turns, when most lists are in one component, have an order for each list.
    """
    order = F.xxhash64(F.pmod("key", F.lit(ORDERS)), "doc") if not turn else F.xxhash64(F.lit(turn), "key", "doc")
    leaders = keyed.groupBy("key").agg(F.min_by(F.struct("doc", "n", "bits", "part"), F.struct(order, F.col("doc"))).alias("y"), F.count(F.lit(1)).alias("many"))
    met = keyed.select("key", F.struct("doc", "n", "bits", "part").alias("x")).join(leaders.where("many > 1"), "key")
    fit = (F.col("x.part") != F.col("y.part")) & _sizes_fit(F.col("x.n"), F.col("y.n"), percent) & _bits_fit("x", "y", percent)
    return met.where(fit).select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct()


def _open_lists(keyed: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of the lists that lie in more than one component, with the documents' components."""
    placed = keyed.select("key", "doc", "n", "bits").join(parts.withColumnRenamed("node", "doc"), "doc", "left")
    placed = placed.select("key", "doc", "n", "bits", F.coalesce("component", "doc").alias("part"))
    ends = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    return placed.join(ends.select("key"), "key", "left_semi")


def _cross_pairs(keyed: DataFrame, percent: int) -> DataFrame:
    """All pairs of a list across components.

    A list of more than ``BLOCK`` rows meets its size in ``SALTS`` parts; there are at most a
    ``BLOCK``-th as many such lists as rows, so their salted sizes are fewer than the rows.
    """
    sizes = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    blocked = keyed.withColumn("salt", F.pmod(F.xxhash64(F.lit(SALTS), "doc"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left")
    blocked = blocked.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    one = lambda name: blocked.select(
        "key", F.struct("doc", "n", "bits", "part").alias(name), F.col("block").alias(f"{name}_block"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    )
    left = one("x").select("key", "x", F.col("x_block").alias("i"), F.col("other").alias("j"))
    right = one("y").select("key", "y", F.col("other").alias("i"), F.col("y_block").alias("j"))
    met = left.join(right, ["key", "i", "j"]).where(
        (F.col("x.doc") < F.col("y.doc")) & (F.col("x.part") != F.col("y.part"))
        & _sizes_fit(F.col("x.n"), F.col("y.n"), percent) & _bits_fit("x", "y", percent)
    )
    return met.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()


def join_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id."""
    every = cut(features(docs, width, percent))
    filled = every.where("n > 0 and doc is not null")
    folded = cut(filled.groupBy("h1", "h2").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies")))
    member = filled.select("doc", "h1", "h2").join(folded.where("copies > 1"), ["h1", "h2"])
    member = cut(member.groupBy("doc").agg(F.min("rep").alias("rep")))  # rows may repeat an id
    discard(folded)
    reps = filled.join(member.where("doc <> rep"), "doc", "left_anti").select("doc", "n", "listed")
    postings = reps.select("doc", "n", F.explode("listed").alias("token"))
    counts = cut(postings.groupBy("token").count().where("count > 1"))
    known = cut(postings.join(counts, "token"))

    crowd = known.groupBy("doc", "n").agg(F.count_if(F.col("count") > FREQUENT).alias("n_frequent")).where("n_frequent > 0")
    length = F.least(F.col("n"), F.col("n") - _sql("needed", "n", percent) + _sql("promised", "n", percent)) - F.col("n_frequent")
    crowd = cut(
        crowd.withColumn("promise", _promise(F.col("n_frequent"), percent))
        .withColumn("crowded", length < F.col("n") - _sql("needed", "n", percent) + 1)
    )
    crowded = crowd.where("crowded").select("doc")

    # Single rare tokens of plain documents.
    rare = known.where(F.col("count") <= FREQUENT).join(crowd.select("doc", "promise", "crowded"), "doc", "left")
    rare = cut(rare.where(~F.coalesce("crowded", F.lit(False))).select("token", "doc", "n", F.coalesce("promise", _promise(0, percent)).alias("promise")))
    discard(known)
    x, y = (rare.select("token", F.struct("doc", "n", "promise").alias(c)) for c in "xy")
    plain = (
        x.join(y, "token").where((F.col("x.doc") < F.col("y.doc")) & _sizes_fit(F.col("x.n"), F.col("y.n"), percent))
        .groupBy(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))
        .agg(F.count(F.lit(1)).alias("shared"), F.first(F.least("x.promise", "y.promise")).alias("promise"))
        .where("shared >= promise").select("a", "b")
    )
    plain = cut(plain)

    sets = cut(whole_sets(docs, crowded.unionByName(_ends(plain)), width))
    full = sets.join(crowded, "doc", "left_semi")
    tokens = cut(full.select("doc", "n", F.explode("tokens").alias("token")))

    # Crowded with plain documents: rare tokens of both in the first order.
    position = Window.partitionBy("doc").orderBy(F.expr("token < 0"), "token")
    own_rare = tokens.join(counts.where(F.col("count") > FREQUENT), "token", "left_anti").withColumn("at", F.dense_rank().over(position))
    within = F.col("n") - _sql("needed", "n", percent) + _sql("promised", "n", percent)
    own_rare = cut(own_rare.where(F.col("at") <= within).select("token", "doc", "n"))
    unseen = own_rare.select("token").distinct().join(counts, "token", "left_anti")
    missed = postings.join(crowded, "doc", "left_anti").join(unseen, "token", "left_semi").join(crowd.select("doc", "promise"), "doc", "left")
    plain_rare = rare.unionByName(missed.select("token", "doc", "n", F.coalesce("promise", _promise(0, percent)).alias("promise")))
    x, y = plain_rare.select("token", F.struct("doc", "n", "promise").alias("x")), own_rare.select("token", F.struct("doc", "n", _promise(0, percent).alias("promise")).alias("y"))
    mixed = (
        x.join(y, "token").where(_sizes_fit(F.col("x.n"), F.col("y.n"), percent))
        .groupBy(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b"))
        .agg(F.count(F.lit(1)).alias("shared"), F.first(F.least("x.promise", "y.promise")).alias("promise"))
        .where("shared >= promise").select("a", "b")
    )
    mixed = cut(mixed)
    discard(rare, own_rare)
    extra = cut(_ends(mixed).join(sets.select("doc"), "doc", "left_anti"))
    if extra.head(1):
        sets = sets.unionByName(cut(whole_sets(docs, extra, width)))

    # Crowded documents with each other, in an order of their own.
    among = tokens.groupBy("token").count().where("count > 1")
    split = tokens.join(among, "token").groupBy("doc").agg(
        F.collect_list(F.when(F.col("count") <= FREQUENT, F.col("token"))).alias("rare"),
        F.collect_list(F.when(F.col("count") > FREQUENT, F.col("token"))).alias("frequent"),
    )
    index = full.select("doc", "n", "bits").join(split, "doc").withColumn("n_rare", (F.col("n") - F.size(F.array_distinct("frequent"))).cast("int"))
    keyed = cut(_combination_keys(index, percent).withColumn("part", F.col("doc")))
    discard(tokens)
    links = cut(verified(plain.unionByName(mixed).unionByName(_leader_pairs(keyed, percent, 0)).distinct(), sets, percent))
    discard(plain, mixed)
    parts = components(links)
    for turn in range(1, TURNS + 1):
        before, keyed = keyed, cut(_open_lists(keyed, parts))
        discard(before)
        if not keyed.head(1):
            break
        pairs = _leader_pairs(keyed, percent, turn) if turn < TURNS else _cross_pairs(keyed, percent)
        found = cut(verified(pairs, sets, percent))
        if found.head(1):
            links = links.unionByName(found)
            parts = components(links)

    classes = member.withColumnRenamed("rep", "node").join(parts, "node", "left").select("doc", F.coalesce("component", "node").alias("c1"))
    return (
        every.select("doc", "n").join(classes, "doc", "left").join(parts.withColumnRenamed("node", "doc"), "doc", "left")
        .select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("c1", "component", "doc").alias("component_id"))
    )


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without all but the least id of each group.

    Of rows that repeat an id one stays; rows with a null id all stay.
    """
    linked = join_components(docs, width, percent)
    dropped = linked.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.head(1):
        return kept
    once = kept.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(once)
