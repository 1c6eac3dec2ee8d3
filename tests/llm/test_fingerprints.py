import hashlib
import random

from pyspark.sql import functions as F

from corpuskiln.llm import fingerprints


def test_edited_texts_and_likeness(spark, docs_of):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(900)]
    values = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    values[20] = values[21] = "ünï " + values[22]
    rows = [(k * 3 + 1, v) for k, v in enumerate(values)]
    found = {r["doc_id"]: r for r in fingerprints.edit_likeness(docs_of(rows).repartition(5)).collect()}
    assert len(found) == 150
    for k, (doc, value) in enumerate(rows):
        following = rows[k - 1][1]
        half = len(value) // 2
        edited = value[: len(value) - half] + following[:half]
        r = found[doc]
        assert r["n_chars"] == len(value) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert found[61]["fingerprint"] == found[64]["fingerprint"] and found[64]["near_next"] == 1
    long = [found[d] for d, v in rows if len(v.split()) > 60]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.35 and sum(r["near_next"] for r in long) / len(long) < 0.2


def test_anchors_are_closed_syncmers(spark):
    words = [f"v{k * 7 % 31}" for k in range(60)]
    df = spark.createDataFrame([(" ".join(words),), (" ".join(["new", *words, "end"]),)], "text string")
    a, b = (r[0]["hashes"] for r in df.select(fingerprints.anchors(df.text)).collect())
    inside = [x for x in b if x in a]
    assert a and inside == a  # what stands around a passage changes none of its anchors


def test_short_texts_have_anchors(spark):
    rng = random.Random(9)
    rows = [(n, " ".join(f"t{n}x{k}w{j}" for j in range(n)), " ".join(f"t{n}x{k}w{j}" if j < n // 2 else f"other{rng.random()}" for j in range(n))) for n in range(1, 16) for k in range(30)]
    df = spark.createDataFrame(rows, "n int, text string, edited string")
    a, b = fingerprints.anchors(df.text), fingerprints.anchors(df.edited)
    found = df.select("n", a.alias("a"), fingerprints.likeness(a, b).alias("near")).collect()
    assert all(r["a"]["hashes"] for r in found) and len({tuple(r["a"]["hashes"]) for r in found}) == len(rows)
    assert all(0 < r["near"] < 1 for r in found if 2 <= r["n"] < 13)


def test_odd_rows(odd):
    found = fingerprints.edit_likeness(odd).collect()
    assert len(found) == 15 and all(r["fingerprint"] == "" and r["n_chars"] == 0 for r in found if r["doc_id"] in (1, 2))
    assert fingerprints.edit_likeness(odd.where("doc_id < 0")).count() == 0
    one = fingerprints.edit_likeness(odd.where("doc_id = 5")).first()
    assert one["near_next"] == 1


def test_fingerprints_are_brute_force_s(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.choice([0, 1, 2, 7, 8, 11, 12, 13, 60]))) for _ in range(80)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(texts)], "k int, text string")
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.xxhash64(F.xxhash64(F.get("w", i - 1)), F.xxhash64(F.get("w", i))))
    df = df.withColumn("w", F.split("text", " ")).withColumn("p", F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<bigint>")))
    found = df.select("k", "w", "p", fingerprints.anchors(F.col("text")).alias("f")).collect()
    k, s = fingerprints.K, fingerprints.S
    elements = {}
    for r in found:
        n = len(r["w"]) if texts[r["k"]] else 0
        places = [i for i in range(n - k + 1) if min(r["p"][i], r["p"][i + k - s]) == min(r["p"][i : i + k - s + 1])]
        assert r["f"]["places"][: len(places)] == [i + 1 for i in places]
        assert len(r["f"]["hashes"]) == len(r["f"]["places"]) == len(places) + (n + max(0, n - 1) if n < 2 * k - s - 1 else 0)
        pairs_of = list(zip(r["f"]["hashes"], r["f"]["places"]))
        elements[r["k"]] = {h for h, _ in pairs_of} | {(a, b, q - p) for (a, p), (b, q) in zip(pairs_of, pairs_of[1:])}
    a, b = (df.select(F.col("k").alias(c + "k"), fingerprints.anchors(F.col("text")).alias(c)) for c in "ab")
    for r in a.join(b, F.col("bk") < F.col("ak")).select("ak", "bk", fingerprints.likeness(F.col("a"), F.col("b")).alias("near")).collect():
        x, y = elements[r["ak"]], elements[r["bk"]]
        assert abs(r["near"] - (2 * len(x & y) / (len(x) + len(y)) if x or y else 1)) < 1e-9


def test_order_of_repeated_and_null_ids(spark):
    rng = random.Random(5)
    rows = [(7 if k % 3 else None if k % 2 else k, f"text {rng.randrange(200)} of {k % 50}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    h = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h[r[1]], r[1]), reverse=True)
    expected = sorted((a or -1, b, c[1]) for (a, b), c in zip(ordered, [*ordered[1:], ordered[0]]))
    got = sorted((r["doc_id"] or -1, r["text"], r["next_text"]) for r in fingerprints.with_next(df.repartition(5)).collect())
    assert got == expected


def test_no_python_in_the_plan(odd):
    shown = fingerprints.edit_likeness(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in shown and "Arrow" not in shown and "Pandas" not in shown
