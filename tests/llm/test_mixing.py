import numpy as np
from pyspark.sql import functions as F

from corpuskiln.llm import mixing


def test_water_fill():
    shares = mixing.water_fill([100, 100, 100, 10], [5, 2, 1, 5], 300)
    assert abs(sum(shares) - 300) < 1e-9 and shares[3] == 20 and all(s <= 2 * w for s, w in zip(shares, [100, 100, 100, 10]))
    assert mixing.water_fill([], [], 0) == [] and mixing.water_fill([0, 4], [5, 2], 6) == [0, 6]


def test_quotas_are_exact():
    quotas = [17, 0, 250, 3]
    for shards in (1, 2, 7, 64):
        plan = mixing.split_quotas(quotas, shards, 5)
        assert plan.sum(0).tolist() == quotas and np.ptp(plan.sum(1)) <= 2 and np.array_equal(plan, mixing.split_quotas(quotas, shards, 5))


def test_mix_of_sources(spark, docs_of):
    rng = np.random.default_rng(0)
    rows = [(k, " ".join("w" * int(rng.integers(1, 60))), "en", ["a", "b", "c", None][int(rng.integers(0, 4))] if k > 900 else "a") for k in range(1500)]
    df = docs_of(rows)
    found = mixing.taken(mixing.assign(df)).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.taken(mixing.assign(df.repartition(7))).collect()}
    assert len(found) == 1500 and all(again[r["doc_id"]] == r["taken"] <= 2 * r["size"] for r in found)
    by = {}
    for (doc, value, _, source), r in zip(rows, sorted(found, key=lambda r: r["doc_id"])):
        assert r["size"] == len(value.split())
        sums = by.setdefault(source, [0, 0, r["target"]])
        sums[0] += r["size"]
        sums[1] += r["taken"]
    order = ["a", "b", "c", None]
    expected = mixing.water_fill([by[s][0] for s in order], [5, 2, 1, 5], 1.5 * sum(v[0] for v in by.values()))
    for s, target in zip(order, expected):
        assert abs(by[s][2] - target) < 1e-6 and abs(by[s][1] - target) <= 20
    placed = mixing.shuffled(mixing.assign(df)).collect()
    assert sum(r["size"] for r in placed) == sum(v[1] for v in by.values())
    shards = {}
    for r in placed:
        shards.setdefault(r["shard"], []).append(r["place"])
    assert all(sorted(p) == list(range(len(p))) for p in shards.values())


def test_subtrees_split_like_the_whole_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SUBTREE", 3)
    quotas = [40, 0, 7, 120]
    whole = mixing.split_quotas(quotas, 17, 9)
    found = mixing.plan_draws(spark, quotas, 17, 9).collect()
    assert sorted((r["no"], r["draw"]) for r in found) == [(k, d) for k, q in enumerate(quotas) for d in range(q)]
    by = np.zeros_like(whole)
    for r in found:
        by[r["shard"], r["no"]] += 1
    assert (by == whole).all()


def test_taken_words_are_brute_force_s(spark, docs_of):
    rng = np.random.default_rng(4)
    rows = [(k, " ".join("w" * int(rng.integers(0, 90))), "en", "ab"[int(rng.integers(0, 2))]) for k in range(700)]
    sized = [(k, len(v.split()), s) for k, v, _, s in rows]
    hashes = docs_of(rows).select("doc_id", mixing._deal(mixing.SEED).alias("h")).collect()
    h = {r["doc_id"]: r["h"] for r in hashes}
    expected = {}
    totals = [sum(n for _, n, s in sized if s == x) for x in "ab"]
    for x, w, t in zip("ab", totals, mixing.water_fill(totals, [5, 2], 1.5 * sum(totals))):
        own = [(k, n) for k, n, s in sized if s == x]
        blocks = 1 << max(0, (len(own) // 64).bit_length() - 1)
        passes, rest = int(t // w), t - int(t // w) * w
        expected |= {k: n * passes for k, n in own}
        for block in sorted(range(blocks), key=lambda b: (b * 2654435761 + mixing.SEED % 65536) % blocks):
            inside = [(k, n) for k, n in own if h[k] % blocks == block]
            if rest <= 0:
                break
            if sum(n for _, n in inside) <= rest:
                rest -= sum(n for _, n in inside)
                expected |= {k: expected[k] + n for k, n in inside}
                continue
            spare = None
            for k, n in sorted(inside, key=lambda x: (-x[1], h[x[0]])):
                if 0 < n <= rest:
                    rest, expected[k] = rest - n, expected[k] + n
                elif n:
                    spare = (k, n)
            if spare and spare[1] - rest < rest:
                expected[spare[0]] += spare[1]
            break
    found = {r["doc_id"]: r["taken"] for r in mixing.taken(mixing.assign(docs_of(rows))).collect()}
    assert found == expected


def test_odd_rows(odd):
    found = mixing.taken(mixing.assign(odd)).collect()
    assert len(found) == 15 and all(r["taken"] == 0 for r in found if not r["size"])
    assert mixing.assign(odd.where("doc_id < 0")).count() == 0 and mixing.mixed(odd.where("doc_id < 0")).count() == 0


def test_mixed_rows_are_the_assigned_copies(spark):
    rows = [(None, f"{'ab'[k % 2]} text {k} " * (k % 5 + 1), "ab"[k % 2], k, "x", "y", "z") for k in range(40)]
    rows += [(k, f"word {k} " * (k % 30 + 1), "abc"[k % 3], k, "x", "y", None) for k in range(100, 400)] + [(150, "word 150 " * 2, "a", 1, "q", "q", "q")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, placements long, _id string, _p string, `a.b` string")
    copies = mixing.mixed(df)
    assert copies.columns == df.columns and set(map(tuple, copies.collect())) <= set(rows)
    got = {(r["doc_id"], r["source"], r["text"]): r["n"] for r in copies.groupBy("doc_id", "source", "text").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = df.select("doc_id", "source", "text", mixing._source_key().alias("skey"), mixing._words().alias("size"), mixing._deal(mixing.SEED).alias("deal"))
    placed = mixing.draw_mix(texts.select("skey", "size", "deal")).place(texts)
    want = {(r["doc_id"], r["source"], r["text"]): r["n"] for r in placed.groupBy("doc_id", "source", "text").agg(F.sum(F.size("placements")).alias("n")).collect() if r["n"]}
    assert got == want
