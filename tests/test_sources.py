"""Result log, file lists, corpus identity, streaming twins."""

import json

import pytest
from pyspark.sql import functions as F

from corpuskiln import cli
from corpuskiln.operators.text import chunk_spans
from corpuskiln.sources import corpus, results
from corpuskiln.streaming import carry


def test_log_reader_skips_what_is_broken(spark, tmp_path):
    lines = [json.dumps({"row_id": "a", "corpus_tier": "1MB", "ratio": 2.0, "round_trip_verified": False}), "", "   ", "{broken", json.dumps({"row_id": "b", "corpus_tier": "1MB", "ratio": 3.0, "unknown": 1}), json.dumps({"row_id": "a", "corpus_tier": "1MB", "ratio": 2.5, "round_trip_verified": True})]
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n")
    log = results.read_log(spark, str(tmp_path))
    assert log.count() == 3
    last = {r["row_id"]: r for r in results.latest(log).collect()}
    assert last["a"]["ratio"] == 2.5 and [r["row_id"] for r in results.verified(results.latest(log)).collect()] == ["a"]


def test_log_append_and_csv(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5)], "row_id string, ratio double")
    for _ in range(2):
        results.append_log(rows, str(tmp_path / "log"))
    assert results.read_log(spark, str(tmp_path / "log")).count() == 2
    both = results.union_keys(rows, spark.createDataFrame([("b", "late")], "row_id string, note string"))
    results.write_csv(both, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["row_id", "ratio", "note"]


def test_later_appends_win(spark, tmp_path):
    log = str(tmp_path / "log")
    for ratio in (1.0, 2.0, 3.0):
        results.append_log(spark.createDataFrame([("a", "1MB", ratio)], "row_id string, corpus_tier string, ratio double"), log)
    assert [r["ratio"] for r in results.latest(results.read_log(spark, log)).collect()] == [3.0]


def test_prune_rewrites_and_keeps_the_former_log(spark, tmp_path, capsys):
    old = {"row_id": "a", "corpus_tier": "1MB", "backend": "lzma_fast", "backend_transport": "in_process_binding"}
    kept = [json.dumps(old | {"row_id": "b", "backend": "zstd_12", "ratio": 2.0}), "{broken", json.dumps(old | {"row_id": "c", "backend_transport": "subprocess_cli", "unknown": 1}), json.dumps(old | {"row_id": "b", "backend": "zstd_12", "ratio": 1.0})]
    log = tmp_path / "log.jsonl"
    for round_ in range(2):  # the second one replaces the first backup
        lines = [json.dumps(old), "", *kept]
        if not round_:
            log.write_text("\n".join(lines) + "\n")
        assert cli.main(["prune", str(log), "--dry-run"]) == 0 and not (tmp_path / "log.jsonl.new").exists()
        assert cli.main(["prune", str(log)]) == 0
        assert [r["value"] for r in spark.read.text(str(log)).collect()] == kept
        assert not (tmp_path / "log.jsonl.new").exists()
    assert "1 rows would go" in (said := capsys.readouterr().out) and "1 rows gone" in said and "0 rows gone" in said
    assert {r["row_id"]: r["ratio"] for r in results.latest(results.read_log(spark, str(log))).collect()} == {"b": 1.0, "c": None}
    assert spark.read.text(str(log) + ".bak").count() == len(kept)


def test_file_list(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text(" a.txt \n\n  \nb.txt\n")
    assert [r["path"] for r in corpus.file_list(spark, str(path)).collect()] == ["a.txt", "b.txt"]
    path.write_text("\n \n")
    with pytest.raises(ValueError):
        corpus.file_list(spark, str(path))


def test_running_totals_are_one_order(spark, sf):
    docs = corpus.documents(spark, sf)
    rows = sorted(corpus.running_totals(docs).collect(), key=lambda r: r["ord"])
    assert [r["ord"] for r in rows] == list(range(1, docs.count() + 1))
    total = 0
    for r in rows:
        assert r["bytes_before"] == total
        total += r["record_bytes"]


def test_identity_ignores_partitions(spark, sf):
    docs = corpus.documents(spark, sf)
    a, b = (corpus.corpus_identity(spark, docs.repartition(n)).first() for n in (1, 7))
    assert a == b
    meta = spark.createDataFrame([("1MB", 5, "abc")], "tier string, bytes long, sha256 string")
    assert corpus.corpus_identity(spark, docs, meta).first()["sha256"] == "abc"


def test_streamed_chunks_are_the_files_chunks(spark, tmp_path):
    data = ("some words and é more " * 300 + "z" * 900 + " end " * 50).encode()
    pieces = [data[k : k + 701] for k in range(0, len(data), 701)]
    rows = [("s", k, p, k == len(pieces) - 1) for k, p in enumerate(pieces)]
    for k in range(3):
        part = rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3]
        spark.createDataFrame(part, "stream string, seq int, data binary, last boolean").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema("stream string, seq int, data binary, last boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    carry.run_available(carry.chunk_stream(source, 1000, 200), str(tmp_path / "out"), str(tmp_path / "ck"))
    found = spark.read.parquet(str(tmp_path / "out")).orderBy("chunk_idx").collect()
    assert b"".join(bytes(r["data"]) for r in found) == data
    assert [bytes(r["data"]) for r in found] == [data[a:b] for a, b, _ in chunk_spans(data, 1000, 200)] and found[-1]["final"]


def test_streamed_log(spark, tmp_path):
    spark.createDataFrame([("a", 1.5)], "row_id string, ratio double").write.json(str(tmp_path / "log"))
    log = carry.result_log(spark, str(tmp_path / "log"), "row_id string, ratio double")
    carry.run_available(log.where(F.col("ratio") > 1), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_fetching_tries_again_and_gives_up():
    import urllib.error

    from corpuskiln.sources import http

    waits, calls = [], []

    def flaky(url):
        calls.append(url)
        if len(calls) < 4:
            raise OSError("reset")
        return b"body"

    assert http.fetch("u", flaky, waits.append) == b"body" and waits == [2, 4, 8]

    def missing(url):
        calls.append(url)
        raise urllib.error.HTTPError(url, 404, "gone", {}, None)

    calls.clear()
    with pytest.raises(urllib.error.HTTPError):
        http.fetch("u", missing, waits.append)
    assert len(calls) == 1


def test_http_source_keeps_order_and_rows(spark, tmp_path):
    from corpuskiln.sources import http

    for k in range(5):
        (tmp_path / f"{k}.txt").write_text(f"document {k}")
    names = [(tmp_path / f"{k}.txt").as_uri() for k in range(5)]
    names.insert(2, (tmp_path / "bad.bin").as_uri())
    (tmp_path / "bad.bin").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "list").write_text("\n".join([*names, "", " "]))
    spark.dataSource.register(http.HttpDocuments)
    rows = spark.read.format("http_documents").option("urls", str(tmp_path / "list")).option("perTask", 2).load().orderBy("ord").collect()
    assert [r["ord"] for r in rows] == list(range(6)) and rows[2]["text"] is None and rows[2]["error"] and rows[5]["text"] == "document 4"


def test_archive_files_are_described(spark, tmp_path):
    from corpuskiln.operators import archive
    from corpuskiln.sources import archives

    data = "some text é ".encode() * 300
    for name, settings in (("a", ("r50k_base", "fixed_u16", "zstd_12")), ("b", ("none", "raw_utf8", "bz2_9"))):
        (tmp_path / name).write_bytes(archive.build(data, *settings)[0])
    found = {r["path"][-1]: r for r in archives.read(spark, str(tmp_path)).collect()}
    assert found["a"]["known"] and (found["a"]["tokenizer"], found["a"]["packing"], found["a"]["backend"]) == ("r50k_base", "fixed_u16", "zstd_12")
    assert found["b"]["orig_len"] == len(data) and found["b"]["token_count"] == 0 and found["a"]["token_count"] > 0 and found["a"]["sha256"] == found["b"]["sha256"]


def test_resources(spark):
    from corpuskiln.sources import resources

    seen = resources.snapshot()
    assert seen["cores"] >= 1 and 4 <= seen["batch_chunks_default"] <= 128 and seen["ram_available"] > 0
    assert resources.parse_version("xz (XZ Utils) 5.4.1") == (5, 4, 1) and resources.parse_version("none") is None
    assert resources.tools(spark).where("tool = 'xz'").count() == 1 and resources.cluster(spark)["parallelism"] >= 1


def test_sql_functions(spark):
    from corpuskiln.functions.registry import register

    names = register(spark)
    assert "bpe_encode_r50k_base" in names
    row = spark.sql("SELECT safe_boundary('ab cd') AS b, safe_boundary('...') AS n, hex(u16_pack(array(1, 258))) AS u, cast(bpe_decode_r50k_base(bpe_encode_r50k_base('héllo wörld')) AS string) AS t, cast(decompress_bytes(compress_bytes(encode('abc abc', 'UTF-8'), 'gzip_9'), 'gzip_9') AS string) AS z, utf8_trim(encode('aé', 'UTF-8'), 2) AS e").first()
    assert tuple(row) == (2, None, "01000201", "héllo wörld", "abc abc", 1)
