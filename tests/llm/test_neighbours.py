import numpy as np
import pandas as pd
import pytest

from corpuskiln.llm import components, neighbours


def test_links_are_brute_force_s(spark):
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        base = rng.standard_normal((150, 32))
        hot = base[0] + 0.05 * rng.standard_normal((300, 32))  # one large group of near copies
        rows += [(label, v.astype(np.float32)) for v in (*base, *hot, base[1], base[1], 2 * base[1])]
    table = [(k, [float(x) for x in v], label, "x") for k, (label, v) in enumerate(rows)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int, cap string")
    found = {r["vec_id"]: r for r in neighbours.near_duplicates(df, 0.93).collect()}
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (np.array([a for a, _ in rows])[:, None] == np.array([a for a, _ in rows])[None])
    np.fill_diagonal(near, False)
    true = near.sum(1)
    got = np.array([found[k]["n_links"] for k in range(len(rows))])
    assert (got <= true).all() and got.sum() >= 0.98 * true.sum()
    assert np.mean([found[k]["component_id"] <= k and found[k]["kept"] == (found[k]["component_id"] == k) for k in found]) == 1


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [1.0, None], 0), (7, [1.0, 0.5], None), (8, [1.0, 0.5], 0), (9, [2.0, 1.0], 0), (10, [1.0, 0.5], 1), (11, [1.0, 0.5, 0.0], 0), (12, [1.0, 0.5], 0), (None, [1.0, 0.5], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neighbours.near_duplicates(df).collect()}
    assert len(found) == 13
    assert all(found[k] == (0, k) for k in (1, 2, 3, 4, 5, 6, 7, 10, 11)) and found[None] == (0, None)
    assert found[8] == found[9] == found[12] == (2, 8)
    assert neighbours.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_decoding_lists_every_cap_over_the_threshold():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for blocks in (1, 2, 3):
        row, code = neighbours.decode(x, 1.2, blocks, 7)
        rotation, books = neighbours._codes(12, blocks, 7)
        parts = np.array_split(np.arange(12), len(books))
        total = np.zeros((40, 1))
        for part, book in zip(parts, books):
            total = (total[:, :, None] + ((x @ rotation)[:, part] @ book.T)[:, None, :]).reshape(40, -1)
        assert set(zip(row.tolist(), code.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(total >= 1.2 / np.sqrt(12) * np.sqrt(len(books)) - 1e-12))))


@pytest.mark.parametrize("length", [2, 3, 8, 16, 64, 768])
@pytest.mark.parametrize("most", [10_000, 1_000_000, 100_000_000])
@pytest.mark.parametrize("cosine", [0.931, 0.95, 0.97])
def test_few_pairs_over_the_threshold_have_no_common_cap(length, most, cosine):
    """By the plan of a label of so many vectors, which needs no such table."""
    x, y = neighbours.random_pairs(400, length, cosine, 77)
    plan = neighbours.cap_plan(most, 0.93, length)
    met = set()
    for low in range(0, 400, 50):
        one, two = (set(zip(*(a.tolist() for a in neighbours.decode_turns(v[low : low + 50], *plan)))) for v in (x, y))
        met |= {low + row for row, _ in one & two}
    assert len(met) >= 394


def test_links_of_a_large_label(spark):
    """50,000 vectors of one label, 4,000 of them in planted groups of two to forty."""
    rng = np.random.default_rng(21)
    x = rng.standard_normal((50_000, 24)).astype(np.float32)
    at = 0
    while at < 4_000:
        size = int(rng.integers(2, 41))
        x[at : at + size] = x[at] + rng.uniform(0.05, 0.3) * rng.standard_normal((size, 24))
        at += size
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x), "label": "a"}), "vec_id long, embedding array<float>, label string")
    found = neighbours.near_duplicates(df).toPandas().sort_values("vec_id")
    z = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    true = np.concatenate([(z[k : k + 1000] @ z.T >= 0.93).sum(1) - 1 for k in range(0, len(z), 1000)])
    got = found["n_links"].to_numpy()
    assert true.sum() > 10_000 and (got <= true).all() and got.sum() >= 0.99 * true.sum()


def test_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [1.0, 0.01], "a"), (2, [0.0, 1.0], "b"), (3, [0.0, 1.0], "b"), (4, [0.0, 1.0], None), (4, [0.0, 1.0], "b")]
    found = neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (4, 1, 3)]


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(500, 560)] + [(900, 900)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in parent}
