import random

import pytest

from corpuskiln.llm import jaccard


def brute(rows, width, percent):
    """Sizes and components by comparing all pairs of sets."""
    sets, parent = {}, {}
    for doc, value in rows:
        words = (value or "").encode().lower().split()
        sets[doc] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
        parent[doc] = doc

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_copies(rng, seed_words, n, edits):
    vocabulary = [f"w{k}" for k in range(400)]
    for _ in range(n):
        words = list(seed_words)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        yield " ".join(words)


@pytest.mark.parametrize(("width", "percent", "length", "edits"), [(4, 85, 60, 3), (5, 80, 120, 8), (1, 70, 25, 6), (4, 85, 400, 16)])
def test_components_are_brute_force_s(spark, docs_of, width, percent, length, edits):
    rng = random.Random(length)
    vocabulary = [f"w{k}" for k in range(400)]
    line = " ".join(rng.choice(vocabulary) for _ in range(20))
    values = []
    for size in (90, 40, 5, 2):  # groups of near copies, two of them past what counts as frequent
        values += near_copies(rng, [rng.choice(vocabulary) for _ in range(length)], size, edits)
    values += [line + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, length))) for _ in range(80)]
    values += values[:30] + ["a", "a b", "A B", "", None]
    rng.shuffle(values)
    rows = list(enumerate(values))
    found = {r[0]: (r[1], r[2]) for r in jaccard.join_components(docs_of(rows), width, percent).collect()}
    assert found == brute(rows, width, percent)


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_short_documents_behind_a_common_opening(spark, docs_of, width, percent):
    rng = random.Random(width)
    vocabulary = [f"w{k}" for k in range(400)]
    values = []
    for shared in (width, width + 1, width + 3):
        opening = [rng.choice(vocabulary) for _ in range(shared)]
        for size in range(width + 3, width + 11):
            for _ in range(8):
                words = opening + [rng.choice(vocabulary) for _ in range(max(1, size - shared))]
                values += [" ".join(words), " ".join(words[:-1])]
    rng.shuffle(values)
    rows = list(enumerate(values))
    found = {r[0]: (r[1], r[2]) for r in jaccard.join_components(docs_of(rows), width, percent).collect()}
    assert found == brute(rows, width, percent)


def test_odd_rows(odd):
    found = jaccard.join_components(odd, 4, 85).collect()
    assert len(found) == 15
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert by[1] == by[2] == [(0, by[1][0][1])] or (by[1] == [(0, 1)] and by[2] == [(0, 2)])
    assert by[4] == [(1, 4)] and by[5] == [(1, 5)] and by[7][0][1] == 6 and by[9] == [(3, 9)] * 2 and by[10] == [(3, 9)]
    assert sorted(by[None], key=str) == [(0, None), (1, None)]


def test_empty_table(docs_of):
    assert jaccard.join_components(docs_of([(1, "x")]).where("doc_id < 0")).count() == 0


def test_keep_one(odd):
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(9) == 1 and 10 not in ids and 7 not in ids and ids.count(None) == 2


def test_prefix_rules():
    for n in range(1, 300):
        need = jaccard.needed(n, 85)
        assert need == -(-85 * n // 100) and jaccard.prefix_length(n, 85) == n - need + 1


def test_long_lists_give_all_pairs_across_components(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rows = [(key, doc, 100, [0] * 16, doc % parts) for key, many, parts in ((1, 60, 7), (2, 3, 2), (3, 1, 1)) for doc in range(many)]
    keyed = spark.createDataFrame(rows, "key long, doc long, n int, bits array<long>, part long")
    found = sorted(map(tuple, jaccard._cross_pairs(keyed, 85).collect()))
    wanted = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[4] != b[4]}
    assert found == sorted(wanted)
