import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuskiln.llm import text

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB cé\t\n\x0b\x1c .", max_size=30)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_the_contract_s(texts):
    hashes, first = text.word_hashes(pa.array(texts, pa.string()))
    words = [[w.encode().translate(bytes(b + 32 if 65 <= b < 91 else b for b in range(256))) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    for i, a in enumerate(flat):
        for j in range(i):
            assert (hashes[i] == hashes[j]) == (a == flat[j])


def test_slices_and_long_words():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["x" * 3_000_000, None, "x" * 3_000_000 + " y"])], ["id", "text"])
    parts = list(text.slices(batch, "text", 1000))
    assert sum(p.num_rows for p in parts) == 3
    hashes, first = text.word_hashes(batch.column(1))
    assert first.tolist() == [0, 1, 1, 3] and hashes[0] == hashes[1]


def test_hash_does_not_depend_on_the_place():
    a, _ = text.word_hashes(pa.array(["pad " * 400000 + "Target"]))
    b, _ = text.word_hashes(pa.array(["tArget"]))
    assert a[-1] == b[0]


def test_shingles():
    words = np.arange(1, 6, dtype=np.uint64)
    assert len(text.shingle_hashes(words, 4)) == 2 and len(text.shingle_hashes(words[:2], 4)) == 1 and len(text.shingle_hashes(words[:0], 4)) == 0
