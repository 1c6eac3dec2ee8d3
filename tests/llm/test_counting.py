import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpuskiln.llm import counting

WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("tokenizer", [WORDS, BYTES])
@settings(max_examples=60, deadline=None)
@given(value=st.text(alphabet="ab1é ́\n\t.,'中s", max_size=400), chunk=st.integers(5, 80), overlap=st.integers(1, 20))
def test_splicing_is_exact(tokenizer, value, chunk, overlap):
    assert counting.spliced_count(tokenizer, value, chunk, overlap) == len(tokenizer.encode(value, add_special_tokens=False).ids)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=120))
def test_word_table_is_exact(value):
    table = counting.WordTable(WORDS)
    value = value.encode("utf-8", "ignore").decode()
    assert table.count([value.encode()]) == [len(WORDS.encode(value, add_special_tokens=False).ids)]


def test_only_tokenizers_that_drop_spaces_have_a_table():
    assert counting.parts_at_spaces(WORDS, public_tokenizers.path("word_bpe_49k.json"))
    assert not counting.parts_at_spaces(BYTES, public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_odd_rows(odd, name):
    path = public_tokenizers.path(name)
    found = counting.token_counts(odd, path, chunk=4000, overlap=100).collect()
    assert len(found) == 15
    if name.endswith(".json"):
        library = Tokenizer.from_file(path)
        texts = {r["doc_id"]: r["text"] or "" for r in odd.collect() if r["doc_id"] is not None}
        for r in found:
            if r["doc_id"] is not None:
                n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
                assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 2048, len(texts[r["doc_id"]].encode()))
    assert counting.token_counts(odd.where("doc_id < 0"), path).count() == 0
