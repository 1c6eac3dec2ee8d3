"""Packing, boundaries, codecs, archives, identity: properties and edges."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuskiln.cli import selftest
from corpuskiln.functions import scalars
from corpuskiln.operators import archive, codecs, packing, text, tokenizers
from corpuskiln.plans import dims, matrix, verify

EDGES = [0, 1, 126, 127, 128, 129, 255, 256, 16382, 16383, 16384, 16385, 65534, 65535]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, (1 << 21) - 1)), st.integers(0, 600))
def test_leb128_round_trip_at_any_cut(ids, at):
    data = packing.leb128_bytes(ids)
    assert len(data) == sum(1 + (i >= 128) + (i >= 16384) for i in ids)
    at = min(at, len(data))
    first, rest = packing.leb128_ids(data[:at])
    second, left = packing.leb128_ids(rest + data[at:])
    assert [*first, *second] == ids and left == b""


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 65535)), st.integers(0, 400))
def test_u16_round_trip_at_any_cut(ids, at):
    data = packing.u16_bytes(ids)
    first, rest = packing.u16_ids(data[: min(at, len(data))])
    second, left = packing.u16_ids(rest + data[min(at, len(data)) :])
    assert [*first, *second] == ids and left == b""


def test_known_bytes_and_refusals():
    assert packing.leb128_bytes([0, 127, 128, 16383, 16384, 2097151]).hex() == "007f8001ff7f808001ffff7f"
    assert packing.leb128_bytes([]) == packing.u16_bytes([]) == b""
    for bad, pack in (([1 << 21], packing.leb128_bytes), ([-1], packing.leb128_bytes), ([65536], packing.u16_bytes)):
        with pytest.raises(ValueError):
            pack(bad)
    with pytest.raises(ValueError):
        packing.leb128_ids(b"\x80\x80\x80\x01")
    assert selftest()


def test_native_hex_is_the_bytes(spark):
    df = spark.createDataFrame([(EDGES,), ([],)], "ids array<long>")
    for a, b in df.select(packing.leb128_hex(F.col("ids")), F.lower(F.hex(packing.leb128_pack("ids")))).collect():
        assert a == b
    for a, b in df.select(packing.u16_hex(F.col("ids")), F.lower(F.hex(packing.u16_pack("ids")))).collect():
        assert a == b


def test_trim_goes_back_to_a_character():
    wide = b"x" * 10 + "é".encode()
    assert text.utf8_trim(wide, 12) == 12 and text.utf8_trim(wide, 11) == 10
    for c in ("é", "中", "\U0001f600"):
        data = b"a" + c.encode()
        assert all(text.utf8_trim(data, k) == 1 for k in range(1, len(data))) and text.utf8_trim(data, len(data)) == len(data)


def _slow_chunks(data, size, lookahead):
    """The same rule, byte by byte, over a file-like reader with what is left carried on."""
    at, left, out = 0, b"", []
    while True:
        need = size - len(left)
        block = data[at : at + max(need, 0)]
        at += len(block)
        buf = left + block
        if not buf:
            return out
        ahead = data[at : at + lookahead]
        if len(buf) < size or not ahead:
            return [*out, (buf, False)]
        at += len(ahead)
        probe = buf + ahead
        cut = next((i for i in range(max(len(buf), 1), len(probe)) if probe[i] in b" \t\r\n\v\f" and chr(probe[i - 1]).isascii() and chr(probe[i - 1]).isalnum()), None)
        unsafe = cut is None
        cut = cut if cut is not None else (text.utf8_trim(probe, len(probe)) or len(probe))
        out.append((probe[:cut], unsafe))
        left = probe[cut:]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 \n.é中\U0001f600", max_size=400), st.integers(1, 60), st.integers(1, 40))
def test_chunks_follow_the_reader(value, size, lookahead):
    data = value.encode()
    assert [(data[a:b], u) for a, b, u in text.chunk_spans(data, size, lookahead)] == _slow_chunks(data, size, lookahead)


@pytest.mark.parametrize("filler", ["é", "中", "\U0001f600"])
def test_chunks_of_runs_without_a_boundary(filler):
    data = ("word " * 400)[:1997].encode() + (filler * 9000).encode()
    spans = list(text.chunk_spans(data, 2000, 512))
    assert b"".join(data[a:b] for a, b, _ in spans) == data and any(u for *_, u in spans)
    for a, b, _ in spans:
        data[a:b].decode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abS19'’ \t\n.%\x1c\u0301éä²٣中\u00a0\u3000\U0001f600", max_size=300), st.integers(1, 40), st.integers(1, 20))
def test_sure_chunks_keep_the_ids(value, size, lookahead):
    data = value.encode()
    spans = list(text.sure_spans(data, size, lookahead))
    assert [a for a, *_ in spans] == [0, *(b for _, b, _ in spans)][: len(spans)] and (not data or spans[-1][1] == len(data))
    for role in tokenizers.STAND_INS:
        parts = [tokenizers.encode(role, data[a:b].decode()).tolist() for a, b, _ in spans]
        assert sum(parts, []) == tokenizers.encode(role, value).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="adelmrstv19' \t\n.%é\u0301", min_size=2, max_size=40))
def test_every_edge_parts_the_ids(value):
    data = value.encode()
    for m in text._EDGE.finditer(data):
        a, b = data[: m.start()].decode(), data[m.start() :].decode()
        for role in tokenizers.STAND_INS:
            assert [*tokenizers.encode(role, a), *tokenizers.encode(role, b)] == tokenizers.encode(role, value).tolist()


def test_sure_chunks_are_cut_where_there_is_an_edge():
    marked, solid = b"Of%%% the&&& anerha$$$ " * 4000, b"x" * 90_000
    assert [b - a for a, b, _ in text.sure_spans(marked, 1024, 65536)] == [66_558, 25_442]
    assert list(text.sure_spans(solid, 1024, 65536)) == [(0, 90_000, False)]


def test_first_boundary_and_table_function(spark):
    rows = [(1, "ab cd"), (2, "ébc d"), (3, ". , "), (4, ""), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: r[1] for r in df.select("doc_id", text.first_boundary(F.col("text"))).collect()} == {1: 2, 2: 4, 3: None, 4: None, 5: None}
    spark.udtf.register("read_chunks", text.ReadChunks)
    df.createOrReplaceTempView("some_docs")
    found = spark.sql("SELECT doc_id, chunk_idx, start, end FROM some_docs, LATERAL read_chunks(text, 2, 10)").collect()
    assert (1, 0, 0, 2) in [tuple(r) for r in found]


def test_compressor_arguments():
    assert codecs.compressor_argv("lzma_fast", 1, "xz") == ["xz", "-T", "1", "-c", "--lzma2=preset=6,lc=3,lp=0,pb=0,dict=32MiB"]
    assert "--block-size=134217728" in codecs.compressor_argv("lzma_extreme", 4, "xz")
    assert codecs.compressor_argv("zstd_22_long", 2, "zstd") == ["zstd", "-T2", "-c", "--ultra", "-22", "--long=31"]
    assert codecs.decompressor_argv("zstd_19", 2, "zstd") == ["zstd", "-dc", "-T2", "--long=27"]
    assert codecs.compressor_argv("gzip_9", 8, "gzip") == ["gzip", "-9", "-c"]


@pytest.mark.parametrize("backend", [b for b in dims.BACKENDS if b != "zstd_22_long"])
def test_codecs_round_trip(backend):
    parts = [b"one " * 2000, b"", "zwei é ".encode() * 3000]
    packed = codecs.compress(parts, backend)
    assert b"".join(codecs.decompress(packed, backend)) == b"".join(parts)


@pytest.mark.parametrize(("tokenizer", "packing_name"), [("none", "raw_utf8"), ("r50k_base", "leb128"), ("r50k_base", "fixed_u16"), ("p50k_base", "fixed_u16")])
def test_archives_round_trip_hostile_text(tokenizer, packing_name):
    data = (("word " * 500)[:2497] + "\U0001f926\U0001f3fc‍♂️" * 300 + " normal prose resumes here. " * 200 + "中文" * 900 + " tail. ").encode()
    made, stats = archive.build(data, tokenizer, packing_name, "zstd_12", chunk=2500, lookahead=64)
    found = archive.verify(made, keep=True)
    assert found["round_trip_verified"] and found["data"] == data and stats["unsafe_boundary_cuts"] > 0
    assert made[:6] == b"PRMR\x02" + bytes([dims.PACKING_CODE[packing_name]])


def test_archives_refuse_and_reject():
    for tokenizer, packing_name in (("o200k_base", "fixed_u16"), ("none", "leb128"), ("o200k_base", "raw_utf8")):
        with pytest.raises(ValueError):
            archive.build(b"x", tokenizer, packing_name, "gzip_9")
    made, _ = archive.build(b"some text", "r50k_base", "leb128", "gzip_9")
    for broken in (b"XXXX" + made[4:], made[:4] + b"\x03" + made[5:], made[:5] + b"\x09" + made[6:], made[:20]):
        with pytest.raises(ValueError):
            archive.parse_header(broken)


@pytest.mark.parametrize("value", ["\U0001f926\U0001f3fc‍♂️", "\U0001f600\U0001f600", "中文测试", "क्षत्र", "café naïve ça va"])
def test_decoding_is_exact_at_every_split(value):
    ids = tokenizers.encode("r50k_base", value)
    for k in range(len(ids) + 1):
        assert tokenizers.decode("r50k_base", ids[:k]) + tokenizers.decode("r50k_base", ids[k:]) == value.encode()


def test_sizes_for_readers(spark):
    def slow(n):
        for unit in ("B", "KB", "MB", "GB", "TB"):
            if abs(n) < 1024:
                return f"{n:.1f}{unit}"
            n /= 1024
        return f"{n:.1f}PB"

    rng = np.random.default_rng(7)
    values = [0.0, 0.05, 0.15, 0.25, 0.35, 0.75, 0.95, 1.05, 1023.95, 1023.96, -0.25, -1280.0, 1024.0**5, 1.25 * 1024.0**5, 900.05 * 1024.0**4]
    values += [float(k * 64) * 1024**p for k in range(1, 400) for p in range(5)]
    values += [float(x) for x in np.concatenate([rng.integers(0, 20_480, 2000) / 20, 2.0 ** rng.uniform(0, 55, 2000), np.floor(2.0 ** rng.uniform(0, 55, 2000))])]
    df = spark.createDataFrame([*((x,) for x in values), (None,)], "n double")
    found = {r["n"]: r["size"] for r in df.select("n", scalars.human(F.col("n")).alias("size")).collect()}
    assert found == {None: None, **{x: slow(x) for x in values}}
    assert spark.range(2 << 20, (2 << 20) + 1).select(scalars.human(F.col("id"), "KB")).first()[0] == "2048.0KB"


def test_matrix_counts(spark):
    grid = matrix.grid_candidates(spark)
    assert (grid.where("reason is null").count(), grid.where("reason is not null").count()) == (51, 69)
    fast = matrix.grid_candidates(spark, "fast")
    assert (fast.where("reason is null").count(), fast.where("reason is not null").count()) == (28, 32)
    swept = matrix.sweep_candidates(spark)
    assert (swept.where("reason is null").count(), swept.where("reason is not null").count()) == (100, 8)


def test_adversarial_texts_have_no_hard_failure(spark):
    cases = spark.createDataFrame(verify.adversarial_cases(), "case_name string, text string")
    found = {r["case_name"]: r for r in verify.verdict(verify.split_invariance(cases, "r50k_base", 4096, 2048)).collect()}
    assert {name: r["unsafe_cuts"] for name, r in found.items()} == {name: cuts for name, *_, cuts in verify.HARD_TEXTS}
    assert all(r["outcome"] == "identical" or r["unsafe_cuts"] for r in found.values())
    assert found["digits alone"]["outcome"] == "limitation"


@pytest.mark.parametrize("filler", [" ", "\n", "\t", "\u3000", " \n", "a"])
def test_long_runs_are_encoded_like_short_ones(filler):
    own = tokenizers.encoder("r50k_base")
    for before, after in (("", ""), ("x", ""), ("", "x"), ("don't ", " y z"), ("1\n", "\r\n.")):
        value = before + filler * 20_000 + after
        assert tokenizers.encode("r50k_base", value).tolist() == own.encode_ordinary(value)
    for value in (filler * 2_000_000, "a" + filler * 2_000_000 + "b"):
        assert tokenizers.decode("r50k_base", tokenizers.encode("r50k_base", value)) == value.encode()


def test_packing_columns_are_the_functions(spark):
    rng = np.random.default_rng(8)
    lists = [rng.integers(0, 60_000, int(n)).tolist() for n in rng.integers(0, 40, 200)] + [[], None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, ids array<long>")
    for pack, unpack, plain in ((packing.leb128_pack, packing.leb128_unpack, packing.leb128_bytes), (packing.u16_pack, packing.u16_unpack, packing.u16_bytes)):
        packed = df.select("k", pack("ids").alias("p"))
        rows = {r["k"]: (bytes(r["p"]), r["u"]) for r in packed.withColumn("u", unpack("p")).collect()}
        assert all(rows[k][0] == plain(x or []) and rows[k][1]["ids"] == (x or []) and not rows[k][1]["leftover"] for k, x in enumerate(lists))


def test_numpy_and_plain_unpacking_agree():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 50, 400):
        ids = rng.integers(0, 1 << 21, n).tolist()
        plain, value, shift = [], 0, 0
        for byte in packing.leb128_bytes(ids):
            value |= (byte & 127) << shift
            shift = shift + 7 if byte & 128 else 0
            if not byte & 128:
                plain.append(value)
                value = 0
        assert plain == ids == packing.leb128_ids(packing.leb128_bytes(ids))[0].tolist()


def test_tools_as_processes():
    import shutil

    for backend, tool in (("gzip_9", "gzip"), ("bz2_9", "bzip2"), ("lzma_fast", "xz"), ("zstd_12", "zstd")):
        if shutil.which(tool):
            packed = codecs.compress([b"abc " * 5000, b"end"], backend, "subprocess_cli", 2)
            assert b"".join(codecs.decompress(packed, backend, "subprocess_cli", 2)) == b"abc " * 5000 + b"end"
            assert b"".join(codecs.decompress(packed, backend)) == b"abc " * 5000 + b"end"


def test_byte_classes(spark):
    df = spark.createDataFrame([(b,) for b in (0x41, 0x80, 0xBF, 0xC3, 0xE4, 0xF0, 0xFF)], "b int")
    found = [tuple(r) for r in df.select(text.sequence_length(F.col("b")), text.is_continuation(F.col("b"))).collect()]
    assert found == [(1, False), (None, True), (None, True), (2, False), (3, False), (4, False), (None, False)]


def test_streams_are_cut_like_whole_texts():
    rng = np.random.default_rng(3)
    data = "".join(rng.choice(["word ", "é", "1\n", "中", "x"], 4000)).encode()
    for size, lookahead in ((50, 10), (300, 100), (5000, 1000), (100_000, 10)):
        spans = [(data[a:b], u) for a, b, u in text.chunk_spans(data, size, lookahead)]
        for step in (1, 77, 4096, len(data)):
            assert list(text.stream_chunks((data[k : k + step] for k in range(0, len(data), step)), size, lookahead)) == spans


def test_cells_that_hang_or_die_are_rows(monkeypatch):
    import os
    import time

    from corpuskiln.plans import sweep

    cell = {"tokenizer": "none", "packing": "raw_utf8", "backend": "gzip_9", "backend_transport": "in_process_binding", "tokenization_layout": "library_batch", "chunk_size": 4096, "batch_chunks": 2, "threads": 1}
    good = sweep.isolated(cell, b"abc " * 9000)
    assert good["status"] == "ok" and good["round_trip_verified"] and good["peak_rss_mb"] > 0
    assert sweep.isolated(cell | {"tokenizer": "o200k_base", "packing": "leb128"}, b"x")["status"] == "refused"
    monkeypatch.setattr(sweep, "measure", lambda *_: time.sleep(60))
    assert "not done" in sweep.isolated(cell, b"x", 0.5)["error"]
    monkeypatch.setattr(sweep, "measure", lambda *_: os._exit(7))
    assert "ended with 7" in sweep.isolated(cell, b"x")["error"]


def test_several_shards_in_one_partition(spark):
    docs = spark.createDataFrame([(k, f"document {k} " * 20) for k in range(40)], "ord long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = archive.pack_shards(docs, 8, "none", "raw_utf8", "gzip_9").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(r["shard"] for r in found) == list(range(8)) and all(r["documents"] == 5 for r in found)
    kept = [archive.verify(bytes(r["archive"]), keep=True)["data"] for r in sorted(found, key=lambda r: r["shard"])]
    assert b"".join(kept) == b"".join(f"document {k} ".encode() * 20 + b"\n\n\n" for k in range(40))
