import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corpuskiln.llm import language_model, languages, quality, toxicity


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture
def corpus(spark, docs_of):
    """600 documents: some with bad words in one sentence, some shouted, in two languages."""
    rng = random.Random(9)
    syllables = {"en": ["th", "ing", "er", "on"], "de": ["sch", "ung", "ich", "ä"]}
    rows, labels = [], []
    for k in range(600):
        lang = "en" if k % 3 else "de"
        words = ["".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(rng.randint(20, 80))]
        bad, poor = k % 7 == 0, k % 5 == 0
        if bad:
            words[rng.randrange(len(words))] = "scoundrel"
        value = " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))
        rows.append((k, value.upper().replace(" ", "!! ") if poor else value, lang))
        labels.append((k, int(not poor), int(bad)))
    return docs_of(rows), _labels(spark, labels), rows


def test_toxicity_learns_and_locates(corpus):
    docs, labels, rows = corpus
    found = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    held = [k for k in found if found[k]["held_out"]]
    assert len(found) == 600 and np.mean([found[k]["predicted"] == (k % 7 == 0) for k in held]) > 0.97
    caught = [k for k in held if found[k]["predicted"]]
    for k in caught:
        data = rows[k][1].encode()
        assert any(b"scoundrel" in data[s["begin"] : s["end"]].lower() for s in found[k]["offending"])


def test_quality_learns(corpus):
    docs, labels, _ = corpus
    found = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert np.mean([r["predicted"] == (k % 5 != 0) for k, r in found.items() if r["held_out"]]) > 0.97


def test_language_and_mixture(corpus):
    docs, _, rows = corpus
    found = {r["doc_id"]: r for r in languages.predict(docs).collect()}
    assert np.mean([found[k]["lang_pred"] == lang for k, _, lang in rows]) > 0.98
    model = languages.train(docs)
    both = next(v for _, v, lang in rows if lang == "en") + " " + next(v for _, v, lang in rows if lang == "de")
    names, top, shares = model.infer(pa.array([both, None, "", "123 --", "…"]))
    assert names[1:] == ["und"] * 4 and (shares[0] > 0).sum() == 2 and 0.4 < top[0] < 1


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_odd_rows(spark, odd, operator):
    labels = _labels(spark, [(k, k % 2, k % 2) for k in range(0, 13)] + [(4, 1, 1), (4, 0, 0), (5, None, None)])
    found = operator.classify(odd, labels).collect()
    assert len(found) == 15 and all(0 <= r["score"] <= 1 for r in found)
    assert operator.classify(odd, labels.where("doc_id < 0")).count() == 15
    assert operator.classify(odd.where("doc_id < 0"), labels).count() == 0


def test_odd_rows_of_languages(odd):
    found = languages.predict(odd).collect()
    assert len(found) == 15 and {r["doc_id"]: r["lang_pred"] for r in found}[12] == "und"
    assert all(r["lang_pred"] == "und" for r in languages.predict(odd.where("doc_id in (1, 2, 3)")).collect())
    assert languages.predict(odd.where("doc_id < 0")).count() == 0


def test_filters_keep_columns(corpus):
    docs, labels, _ = corpus
    kept = toxicity.keep_clean(docs, toxicity.train(docs, labels))
    assert kept.columns == docs.columns and 480 < kept.count() < 560
    good = quality.keep_good(docs, quality.train(docs, labels))
    assert good.columns == docs.columns and 450 < good.count() < 520


def test_language_model_counts_and_beats_the_base(corpus):
    import binascii
    import math
    from collections import Counter

    docs, _, rows = corpus
    found = {r["doc_id"]: r for r in language_model.held_out_scores(docs).collect()}
    tokens = {k: [*v.encode().lower().split(), None] for k, v, _ in rows}
    out = {k: binascii.crc32(str(k).encode()) % 5 == 1 for k in tokens}
    counts = Counter(w for k, ws in tokens.items() if not out[k] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for k, ws in tokens.items():
        r = found[k]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert r["held_out"] == out[k] and r["train_tokens"] == n and r["n_tokens"] == len(ws) and r["n_known"] == sum(counts[w] > 0 for w in ws)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] <= 0
    held = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_is_a_distribution(corpus):
    docs, _, _ = corpus
    model, counts = language_model.fit(docs.select("text"))
    kinds = {r["h"]: (r["kind"], r["c"]) for r in counts.collect()}
    mass = np.zeros(language_model.CLASSES)
    for kind, c in kinds.values():
        k = model.classes[kind]
        mass[k] += (c + 0.5) * 10 ** model.share[k]
    seen = mass > 0
    assert np.allclose(mass[seen] + 10 ** model.unseen[seen], 1, atol=1e-6)
    p = language_model._softmax(model.weights, np.zeros((language_model.PER_TOKEN, 3), np.int32))
    assert np.allclose(p.sum(1), 1, atol=1e-5)


def test_odd_rows_of_the_language_model(odd):
    found = language_model.held_out_scores(odd).collect()
    assert len(found) == 15 and sum(r["doc_id"] == 9 for r in found) == 2
    assert {r["doc_id"]: r["n_tokens"] for r in found if r["doc_id"] is not None}[1] == 1
    assert language_model.held_out_scores(odd.where("doc_id < 0")).count() == 0


def test_samples_are_bounded_whatever_the_lengths(spark):
    from corpuskiln.llm import training

    rows = [(k, "x" * (1_000_000 if k % 4 == 0 else 100), k % 2) for k in range(80)] + [(1, "y", 1), (3, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    whole = training.fetch(df)
    assert whole.num_rows == 80 and whole["text"][1].as_py() == "x" * 100
    some = training.fetch(df, 5_000_000)
    kept = some["doc_id"].to_pylist()
    assert 5 <= sum(k % 4 == 0 for k in kept) <= 6 and any(k % 4 for k in kept)  # long texts are in it
    each = training.fetch(df, 2_000_000, each=True)
    assert set(each["label"].to_pylist()) == {0, 1}


def test_four_languages_in_one_document():
    rng = random.Random(3)
    alphabets = {"a": "abcde", "b": "fghij", "c": "klmno", "d": "pqrst", "e": "uvwxy"}
    text = lambda lang, n: " ".join("".join(rng.choice(alphabets[lang]) for _ in range(6)) for _ in range(n))
    model = languages.fit(pa.array([text(x, 300) for x in alphabets for _ in range(3)]), [x for x in alphabets for _ in range(3)])
    mixed = " ".join(text(x, 100 + 20 * k) for k, x in enumerate("abcd"))
    names, top, shares = model.infer(pa.array([mixed, text("e", 50), None]))
    assert names == ["d", "e", "und"] and ((shares > 0).sum(1) == [4, 1, 0]).all() and abs(top[0] - 160 / 520) < 0.02


def test_votes_are_brute_force_s():
    rng = np.random.default_rng(6)
    texts = pa.array([" ".join(rng.choice(["ab", "CD", "12", "x.y", "é"], rng.integers(5, 40))) for _ in range(120)] * 2 + ["", None])
    labels = rng.integers(0, 2, len(texts))
    space = quality.fit(texts, labels)
    got = space.vote(quality.term_counts(texts))
    z = space.project(quality.term_counts(texts))
    for k in range(len(texts)):
        cosine = z[k] @ space.vectors.T
        near = sorted(range(len(labels)), key=lambda j: -cosine[j])[: quality.NEIGHBOURS]
        weight = np.maximum(cosine[near], 0) ** quality.SHARPNESS
        expected = (weight * labels[near]).sum() / weight.sum() if weight.sum() > 1e-9 else labels.mean()
        assert abs(got[k] - expected) < 0.05


def test_noisy_or_is_brute_force_s(corpus):
    docs, labels, rows = corpus
    model = toxicity.train(docs, labels)
    weights = dict(zip(model.features.tolist(), model.weights.tolist()))
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for k, value, _ in rows[:60]:
        quiet = 1.0
        for sentence in re.split(r"[.!?\n]", value):
            x = toxicity.instances(pa.array([sentence]))
            if len(x.document):
                z = sum(weights.get(f, 0.0) for f in x.features.tolist()) + model.bias
                quiet *= 1 - 1 / (1 + np.exp(-z))
        assert abs(found[k] - (1 - quiet)) < 1e-6
