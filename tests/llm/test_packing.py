import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpuskiln.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_fit(histogram, capacity=64):
    """Space left in the bins of best-fit decreasing, piece by piece."""
    bins = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [k for k, space in enumerate(bins) if space >= length]
            if fits:
                bins[min(fits, key=lambda k: bins[k])] -= length
            else:
                bins.append(capacity - length)
    return bins


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_places_every_piece_once(histogram):
    slots = packing.plan(histogram, 64)
    ranks, fill = {}, {}
    for length, rank, count, first, offset in slots:
        for k in range(count):
            ranks.setdefault(length, []).append(rank + k)
            fill.setdefault(first + k, []).append((offset, length))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
    for parts in fill.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert len(fill) == len(best_fit(histogram))


def test_plan_is_best_fit_piece_by_piece():
    for histogram in ({10: 31, 6: 7, 15: 1}, {33: 3, 20: 9, 7: 40, 5: 11, 1: 30}, {64: 2, 1: 1}, {}):
        slots, space = packing.plan(histogram, 64), {}
        for length, _, count, first, _ in slots:
            for k in range(first, first + count):
                space[k] = space.get(k, 64) - length
        assert sorted(space.values()) == sorted(best_fit(histogram))


def test_pieces_and_sequences(spark, docs_of):
    library = Tokenizer.from_file(PATH)
    values = ["", None, "short one", "word " * 5000, "x<|endoftext|>y", "Mixed É 中文 12,3\n\n " * 60, "same", "same"] + [f"text number {k} " * (k % 90) for k in range(120)]
    found = packing.pack(docs_of(list(enumerate(values))), PATH).collect()
    by, filled = {}, {}
    for r in found:
        by.setdefault(r["doc_id"], {})[r["piece"]] = r
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, value in enumerate(values):
        ids = np.array([*library.encode(value or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for piece in range(len(by[doc])):
            r = by[doc][piece]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes()) and (piece == 0 or r["length"] == 2048)
            at += r["length"]
        assert at == len(ids) and (len(by[doc]) == 1) == (len(ids) <= 2048)
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048


def test_odd_rows(odd):
    found = packing.pack(odd, PATH).collect()
    assert {r["doc_id"] for r in found} == {None, *range(1, 13)} and sum(r["doc_id"] == 9 for r in found) == 2
    assert packing.pack(odd.where("doc_id < 0"), PATH).count() == 0


def test_fast_ids_are_the_library_s():
    bpe, library = tokens.load_byte_bpe(PATH), Tokenizer.from_file(PATH)
    assert bpe.fast is not None
    for value in ["", " ", "a  b\n\n c\t", "I'll don't WE'LL", "é中\U0001f600", "\x00\x1c x", "<|endoftext|>", "1234567890" * 50]:
        assert bpe.encode(value).tolist() == library.encode(value, add_special_tokens=False).ids


def test_long_runs_of_one_character(spark, docs_of):
    library = Tokenizer.from_file(PATH)
    values = [c * 1_500_000 for c in " \n\ta"] + ["x" + " " * 1_200_000 + "y", "\r\n" * 400_000 + "."]
    found = packing.pack(docs_of(list(enumerate(values))), PATH).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in found} == {k: len(library.encode(v, add_special_tokens=False).ids) + 1 for k, v in enumerate(values)}
