"""Document fingerprints from closed syncmers, in DataFrame expressions only.

Method: words are maximal runs without white space. A run of ``K`` words is an anchor if
the smallest hash of its inner runs of ``S`` words lies at its first or last place. That
depends on nothing outside the run, so equal passages give equal anchors wherever they
stand. The fingerprint lists the anchors' 64-bit hashes in text order, each with the words
since the anchor before. Likeness is positional: the Dice coefficient of the two sets of
anchors and of links, a link being two neighbouring anchors with the distance between
them, so anchors count more where they match in step. An anchor is certain only from
``2 K - S - 1`` words on; shorter texts list their single words and pairs too, after their
anchors, so only texts without words have an empty fingerprint.

The next document (descending id, after the last the first) comes from a window within
ranges of ids; the range bounds are quantiles, so ranges stay even whatever the ids are,
and only the head of each range is copied to the range before it. An id that fills whole
ranges, and the rows without one, are dealt on by the hash of their texts.

Defined cases: a null text is empty; two fingerprints without anchors are alike (1), one
without and one with are not (0); a null id stands after all others; rows with equal ids
follow each other by the hash of their texts; a table of one row is its own next; a very
long text is one array of its words in its task; an empty table gives no rows; extra
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln.llm.shared import partitions

K, S = 8, 2
_SPACES = "[\\x20\\x09-\\x0D]+"
_TRIM = " \t\n\x0b\x0c\r"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def anchors(text: Column, k: int = K) -> Column:
    """The text's closed syncmers (inner runs of two words) in order: arrays of their hashes and of their places.

    Of a short text its words and pairs too, after its anchors.
    """
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_TRIM))
    words = F.transform(F.split(trimmed, _SPACES), lambda w: F.xxhash64(w))

    def of_words(h: Column) -> Column:
        n = F.size(h)
        pairs = F.zip_with(F.slice(h, 1, n - 1), F.slice(h, 2, n - 1), lambda a, b: F.xxhash64(a, b))
        window = k - S + 1

        def of_pairs(p: Column) -> Column:
            edge = lambda i: F.least(p[i - 1], p[i + window - 2]) == F.array_min(F.slice(p, i, window))

            def of_places(at: Column) -> Column:
                runs = F.transform(at, lambda i: F.xxhash64(F.slice(h, i, k)))
                single, double = (F.transform(x, lambda y: F.xxhash64(y)) for x in (h, p))
                more = F.concat(F.sequence(F.lit(1), n), F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")))
                short = n < 2 * k - S - 1
                return F.struct(
                    F.when(short, F.concat(runs, single, double)).otherwise(runs).alias("hashes"),
                    F.when(short, F.concat(at, more)).otherwise(at).alias("places"),
                )

            places = F.when(n < k, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(1), n - k + 1), edge))
            return _let(places, of_places)

        return _let(pairs, of_pairs)

    none = F.struct(F.array().cast("array<bigint>").alias("hashes"), F.array().cast("array<int>").alias("places"))
    return F.when(trimmed == "", none).otherwise(_let(words, of_words))


def fingerprint(found: Column) -> Column:
    """Each anchor's hash, and the words since the one before, as hexadecimal text."""
    step = lambda p, i: F.when(i == 0, p).otherwise(p - F.get(found["places"], i - 1))
    steps = F.transform(found["places"], step)
    return F.array_join(F.zip_with(found["hashes"], steps, lambda h, s: F.concat_ws("+", F.hex(h), s.cast("string"))), "-")


def _elements(found: Column) -> Column:
    """The distinct anchors, and links of neighbouring anchors with their distance."""
    h, p, n = found["hashes"], found["places"], F.size(found["hashes"])
    both = F.arrays_zip(h.alias("h"), p.alias("p"))
    links = F.when(
        n > 1, F.zip_with(F.slice(both, 1, n - 1), F.slice(both, 2, n - 1), lambda a, b: F.xxhash64(a["h"], b["h"], b["p"] - a["p"]))
    ).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(h, links))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of the anchors and links of two results of ``anchors``."""

    def of(x: Column) -> Column:
        total = F.size(x["a"]) + F.size(x["b"])
        return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(x["a"], x["b"])) / total)

    return _let(F.struct(_elements(a).alias("a"), _elements(b).alias("b")), of)


def _range_of(key: Column, bounds: list[float]) -> Column:
    """How many of the sorted bounds are at or below the key, in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    coarse, fine = F.lit(bounds[::step]), F.lit(bounds)
    at = F.greatest(F.size(F.filter(coarse, lambda b: b <= key)) - 1, F.lit(0)) * step
    return at + F.size(F.filter(F.slice(fine, at + 1, step), lambda b: b <= key))


def with_next(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text), each with ``next_text`` and ``next_anchors`` of its successor by descending id, cyclic.

    Order: descending id, null last; within an id descending hash of the text, then text.
    """
    count = 8 * partitions(docs.sparkSession)
    quantiles = docs.stat.approxQuantile("doc_id", [i / count for i in range(1, count)], 0.25 / count) if count > 1 else []
    # An id that is several quantiles gets a range of its own, of as many parts.
    parts = {v: quantiles.count(v) for v in quantiles if quantiles.count(v) > 1 and abs(v) < 1 << 53}
    bounds = sorted({*quantiles, *(v + 1 for v in parts)})
    split = {bounds.index(v): n for v, n in parts.items()}
    hashed = docs.withColumn("h", F.xxhash64("text"))
    at = _range_of(F.col("doc_id").cast("double"), bounds) - 1
    dealt = F.lit(1)
    for k, n in split.items():
        dealt = F.when(at == k, n).otherwise(dealt)
    place = lambda n: F.floor((F.col("h") / 2.0**64 + 0.5) * n).cast("long")
    part = F.when(F.col("doc_id").isNull(), place(F.lit(count)) - 2 * count).otherwise(at.cast("long") * count + place(dealt))
    ranged = hashed.withColumn("part", part)
    # One row for each part: bounded by the partitions, whatever the input's size.
    heads = ranged.groupBy("part").agg(F.max(F.struct("doc_id", "h")).alias("head"))
    everything = Window.orderBy(F.desc("part"))
    heads = heads.select(F.lead("head").over(everything).alias("head"), "part", F.max_by("head", "part").over(Window.partitionBy()).alias("top"))
    heads = heads.select(F.coalesce("head", "top").alias("head"), F.col("part").alias("to"))
    borrowed = (
        hashed.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")["doc_id"]) & (F.col("h") == F.col("head")["h"]))
        .groupBy("to").agg(F.max("text").alias("text"), F.max("doc_id").alias("doc_id"), F.max("h").alias("h"))
        .select("doc_id", "text", "h", F.col("to").alias("part"), F.lit(True).alias("borrowed"))
    )
    both = ranged.withColumn("borrowed", F.lit(False)).unionByName(borrowed).withColumn("anchors", anchors(F.col("text")))
    order = Window.partitionBy("part").orderBy("borrowed", F.desc_nulls_last("doc_id"), F.desc("h"), F.desc("text"))
    both = both.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", "anchors")})
    return both.where(~F.col("borrowed")).drop("part", "borrowed", "h")


def edited(text: Column, following: Column) -> Column:
    """The text with its last half replaced by the beginning of the following one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next are."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = with_next(base)
    done = joined.withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn("edited_anchors", anchors(F.col("edited")))
    return done.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("anchors")).alias("fingerprint"),
        fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )
