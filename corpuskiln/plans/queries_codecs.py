"""Queries that run tokenizers, coders and archives; their columns are invariants."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from corpuskiln.operators import archive, tokenizers
from corpuskiln.plans import dims, matrix, sweep, verify
from corpuskiln.plans.registry import query
from corpuskiln.plans.synth import RECORDS
from corpuskiln.sources import corpus

_ROLES = tuple(tokenizers.STAND_INS)


@query("SELECT t.tokenizer, count(*) AS docs, count(*) AS identical FROM documents, (VALUES ('r50k_base'), ('p50k_base')) t(tokenizer) GROUP BY t.tokenizer")
def bpe_split_invariance(spark, sf_dir):
    """Ids of safely cut chunks against the whole document's, for every document."""
    texts = corpus.documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("case_name"), "text")
    found = None
    for role in _ROLES:
        one = verify.split_invariance(texts, role, 1024, 65536, sure=True)
        found = one if found is None else found.unionByName(one)
    return found.groupBy("tokenizer").agg(F.count(F.lit(1)).alias("docs"), F.count_if("identical").alias("identical"))


@query("SELECT doc_id, true AS whole_equal, true AS parts_equal FROM documents")
def bpe_decode_exact(spark, sf_dir):
    """Decoding to bytes is exact at once and cut at any token."""
    role = _ROLES[0]
    docs = corpus.documents(spark, sf_dir).withColumn("ids", tokenizers.bpe_encode(role)("text"))
    decode = tokenizers.bpe_decode(role)
    half = F.floor(F.size("ids") / 2).cast("int")
    both = docs.withColumn("a", F.slice("ids", F.lit(1), half)).withColumn("b", F.slice("ids", half + 1, F.size("ids")))
    original = F.encode("text", "UTF-8")
    done = both.select("doc_id", original.alias("o"), decode("ids").alias("w"), decode("a").alias("x"), decode("b").alias("y"))
    return done.select("doc_id", (F.col("w") == F.col("o")).alias("whole_equal"), (F.concat("x", "y") == F.col("o")).alias("parts_equal"))


_HARD = ", ".join(f"('{name}', {cuts})" for name, *_, cuts in verify.HARD_TEXTS)


@query(f"SELECT t.tokenizer, case_name, cuts AS unsafe_cuts, true AS as_expected FROM (VALUES ('r50k_base'), ('p50k_base')) t(tokenizer), (VALUES {_HARD}) h(case_name, cuts)")
def adversarial_boundaries(spark, sf_dir):
    """Cuts without a safe place in each hard text; where there are none the ids are the whole text's."""
    cases = spark.createDataFrame(verify.adversarial_cases(), "case_name string, text string").repartition(len(verify.HARD_TEXTS))
    found = verify.split_invariance(cases, _ROLES[0], 4096, 2048).unionByName(verify.split_invariance(cases, _ROLES[1], 4096, 2048))
    return verify.verdict(found).select("tokenizer", "case_name", "unsafe_cuts", (F.col("outcome") != "failure").alias("as_expected"))


def _tier_stream(spark, sf_dir, tier="64KB"):
    """One row with a small tier's stream; the tier's target bounds it."""
    docs = corpus.documents(spark, sf_dir)
    small = corpus.tier_members(docs, corpus.small(spark)).where(F.col("corpus_tier") == tier).select("doc_id", "ord")
    records = docs.join(small, "doc_id").select(F.struct("ord", corpus.record(F.col("text")).alias("r")).alias("x"))
    stream = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]), "")
    return records.agg(F.encode(stream, "UTF-8").alias("data"))


_RUN = "(tokenizer = 'none' OR tokenizer IN ('r50k_base', 'p50k_base')) AND backend <> 'zstd_22_long'"


#: Settings that run anywhere, small enough that the tier is several chunks and batches.
LOCAL = {"backend_transport": "in_process_binding", "threads": 1, "chunk_size": 8192, "batch_chunks": 3}


def _runnable(spark, profile="full"):
    """Grid cells under local settings: vocabularies that are here, and no 2 GiB window."""
    return matrix.at(matrix.cells(spark, profile).where("cell_kind = 'ratio_grid'").where(_RUN), **LOCAL)


@query("SELECT backend, packing, count(*) AS cells, count(*) AS verified, true AS length_match, true AS sha256_match, true AS token_count_match FROM (SELECT backend, packing FROM (VALUES ('lzma_extreme'), ('lzma_fast'), ('zstd_19'), ('zstd_12'), ('gzip_9'), ('bz2_9')) b(backend), (VALUES ('raw_utf8'), ('leb128'), ('leb128'), ('fixed_u16'), ('fixed_u16')) p(packing) UNION ALL SELECT 'lzma_tuned_lp1pb1', 'fixed_u16' UNION ALL SELECT 'lzma_tuned_lp1pb1', 'fixed_u16') GROUP BY ALL")
def roundtrip_matrix(spark, sf_dir):
    """Every runnable grid cell over the 64 KB tier, built and read back."""
    found = sweep.run_cells(_runnable(spark), _tier_stream(spark, sf_dir))
    every = [F.bool_and(c).alias(c) for c in ("length_match", "sha256_match", "token_count_match")]
    return found.groupBy("backend", "packing").agg(F.count(F.lit(1)).alias("cells"), F.count_if("round_trip_verified").alias("verified"), *every)


@query()
def sweep_real(spark, sf_dir):
    """Measured rows of the fast profile's runnable cells over the 256 KB tier."""
    return sweep.run_cells(_runnable(spark, "fast"), _tier_stream(spark, sf_dir, "256KB"))


_AXES_RUN = (("library_batch", 8192, 3, 1), ("library_batch", 4096, 8, 2), ("manual_pool", 8192, 3, 2), ("process_pool", 16384, 2, 2))


@query("SELECT layout AS tokenization_layout, chunk::BIGINT AS chunk_size, batch AS batch_chunks, threads, backend_transport, CASE WHEN backend_transport = 'subprocess_cli' AND backend = 'zstd_12' THEN 'refused' WHEN backend_transport = 'in_process_binding' AND backend = 'lzma_fast' AND threads > 1 THEN 'refused' ELSE 'ok' END AS status, count(*) AS cells FROM (VALUES "
    + ", ".join(f"('{a}', {b}, {c}, {d})" for a, b, c, d in _AXES_RUN)
    + ") s(layout, chunk, batch, threads), (VALUES ('in_process_binding'), ('subprocess_cli')) t(backend_transport), (VALUES ('lzma_fast'), ('gzip_9'), ('bz2_9')) b(backend) GROUP BY ALL")
def sweep_settings_kept(spark, sf_dir):
    """Cells run with the layout, chunk, batch, threads and transport that they name, or are refused."""
    grid = matrix.cells(spark, "fast").where("cell_kind = 'ratio_grid' and tokenizer = 'r50k_base' and packing = 'fixed_u16' and family <> 'zstd'")
    cells = None
    for layout, chunk, batch, threads in _AXES_RUN:
        for transport in dims.TRANSPORTS:
            one = matrix.at(grid, tokenization_layout=layout, chunk_size=chunk, batch_chunks=batch, threads=threads, backend_transport=transport)
            cells = one if cells is None else cells.unionByName(one)
    found = sweep.run_cells(cells, _tier_stream(spark, sf_dir))
    return found.groupBy("tokenization_layout", "chunk_size", "batch_chunks", "threads", "backend_transport", "status").agg(F.count(F.lit(1)).alias("cells"))


@query()
def bench_raw_vs_packed(spark, sf_dir):
    """Best packed size against raw bytes for each backend."""
    found = sweep_real(spark, sf_dir)
    raw = F.max(F.when(F.col("tokenizer") == "none", F.col("ratio")))
    best = F.max(F.when(F.col("tokenizer") != "none", F.struct("ratio", "tokenizer", "packing")))
    return found.groupBy("backend").agg(raw.alias("raw_ratio"), best.alias("b")).select("backend", "raw_ratio", F.col("b.ratio").alias("best_ratio"), F.col("b.tokenizer").alias("tokenizer"), F.col("b.packing").alias("packing"))


def _refusals() -> list[tuple[str, str, bool]]:
    return [(t, p, archive.refusal(t, p) is not None) for t in dims.TOKENIZERS for p in dims.PACKINGS]


@query("SELECT tokenizer, packing, NOT ((tokenizer = 'none' AND packing = 'raw_utf8') OR (tokenizer IN ('r50k_base', 'p50k_base') AND packing <> 'raw_utf8')) AS refused FROM (VALUES ('none'), ('o200k_base'), ('cl100k_base'), ('r50k_base'), ('p50k_base')) t(tokenizer), (VALUES ('raw_utf8'), ('leb128'), ('fixed_u16')) p(packing)")
def invalid_combo_refusals(spark, sf_dir):
    """Combinations that are invalid, or whose vocabulary isn't here, are refused by name."""
    return spark.createDataFrame(_refusals(), "tokenizer string, packing string, refused boolean")


_DAMAGE = ("none", "magic", "version", "packing", "footer length", "footer hash", "cut short")


def _damaged(data: bytes, how: str) -> bytes:
    broken = bytearray(data)
    at = {"magic": 0, "version": 4, "packing": 5, "footer length": len(data) - 48, "footer hash": len(data) - 1}
    if how in at:
        broken[at[how]] ^= 0x55
    return bytes(broken[: len(broken) // 2]) if how == "cut short" else bytes(broken)


@query("SELECT damage, damage = 'none' AS verified FROM (VALUES " + ", ".join(f"('{d}')" for d in _DAMAGE) + ") v(damage)")
def archive_corruption_detected(spark, sf_dir):
    """A flipped byte or a cut is found wherever it is."""
    made = _tier_stream(spark, sf_dir)

    def run(batches):
        for batch in batches:
            for value in batch.column(0):
                whole, _ = archive.build(value.as_py(), _ROLES[0], "fixed_u16", "zstd_12")
                rows = [_damaged(whole, how) for how in _DAMAGE]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary())], ["shard", "archive"])

    checked = archive.verify_shards(made.mapInArrow(run, "shard int, archive binary"))
    names = F.array(*[F.lit(d) for d in _DAMAGE])
    return checked.select(F.get(names, F.col("shard")).alias("damage"), F.col("round_trip_verified").alias("verified"))


@query(f"WITH {RECORDS} SELECT count(*) AS documents, sum(record_bytes)::BIGINT AS bytes, true AS all_verified, 4::BIGINT AS shards FROM sized")
def shard_archives(spark, sf_dir):
    """The whole corpus as four archives in corpus order, each read back."""
    docs = corpus.documents(spark, sf_dir)
    ordered = docs.join(corpus.running_totals(docs).select("doc_id", (F.col("ord") - 1).alias("ord")), "doc_id")
    shards = archive.pack_shards(ordered, 4, _ROLES[0], "leb128", "zstd_12")
    checked = shards.select("shard", "documents", "orig_len", "archive")
    both = checked.join(archive.verify_shards(checked), "shard")
    return both.agg(F.sum("documents").alias("documents"), F.sum("orig_len").alias("bytes"), F.bool_and("round_trip_verified").alias("all_verified"), F.count(F.lit(1)).alias("shards"))


@query()
def tokens_by_language(spark, sf_dir):
    """Tokens and bytes of each language under the runnable vocabularies."""
    docs = corpus.documents(spark, sf_dir).select("lang", F.octet_length("text").cast("long").alias("bytes"), *[tokenizers.bpe_count(r)("text").alias(r) for r in _ROLES])
    return docs.groupBy("lang").agg(F.sum("bytes").alias("bytes"), *[F.sum(r).alias(r) for r in _ROLES])
