"""A result relation that both engines can derive: cells x tiers with closed-form metrics.

Measured results can't be held against SQL, so the report queries are tested on a log whose
metrics are arithmetic on digits of SHA-256. It has what a real log has: reruns (a later
line for the same row), failed rows, rows without packed bytes, and older smoke rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.plans import dims, matrix
from corpuskiln.sources import corpus


def digits(text: Column, at: int) -> Column:
    """Six hexadecimal digits of the text's SHA-256 from a place on, as a number."""
    return F.conv(F.substring(F.sha2(text, 256), at, 6), 16, 10).cast("long")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log: one or two lines for each cell and reached tier."""
    tiers = corpus.tier_summary(corpus.documents(spark, sf_dir), corpus.small(spark)).select("corpus_tier", "tier_rank", F.col("bytes").alias("corpus_bytes"))
    grid = matrix.cells(spark)
    # Cells are 143 rows and tiers five at most.
    crossed = grid.withColumnRenamed("row_id", "cell_id").crossJoin(F.broadcast(tiers))
    key = F.concat_ws("|", "corpus_tier", "cell_id")
    attempts = F.when(F.pmod(digits(key, 1), F.lit(9)) == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    lines = crossed.withColumn("key", key).withColumn("attempt", F.explode(attempts)).withColumn("row_id", F.substring(F.sha2("key", 256), 1, 12))
    salted = F.concat_ws("|", "key", F.col("attempt").cast("string"))
    d = lambda at, m: F.pmod(digits(salted, at), F.lit(m))
    raw = F.col("tokenizer") == "none"
    tokens = F.when(raw, F.lit(0)).otherwise(F.floor(F.col("corpus_bytes") * 10 / (F.lit(24) + d(7, 10)))).cast("long")
    out = lines.withColumn("token_count", tokens).withColumn("ratio", (F.lit(20000) + d(1, 20000)) / 10000.0 + F.col("tier_rank") * 0.05)
    packed = F.when(d(13, 7) == 0, F.lit(None)).when(raw, F.col("corpus_bytes")).when(F.col("packing") == "fixed_u16", F.col("token_count") * 2).otherwise(F.floor(F.col("token_count") * 19 / 10)).cast("long")
    verified = F.when(d(19, 13) == 0, F.lit(False)).when(d(19, 13) == 1, F.lit(None).cast("boolean")).otherwise(F.lit(True))
    return out.select(
        "row_id", F.when(d(25, 17) == 0, F.lit("smoke")).otherwise(F.col("cell_kind")).alias("cell_kind"), "corpus_tier", "tier_rank", "corpus_bytes", *matrix.KEYS, "backend_profile", "family",
        F.when(raw, F.lit(0.0)).otherwise((F.lit(100) + d(31, 9000)) / 1000.0).alias("tokenize_time_s"), ((F.lit(500) + d(37, 90000)) / 1000.0).alias("total_time_s"),
        ((F.lit(5000) + d(43, 70000)) / 1000.0).alias("throughput_mbps"), F.when(d(49, 5) == 0, F.lit(None)).otherwise((F.lit(9000) + d(49, 90000)) / 1000.0).alias("decompress_throughput_mbps"),
        "ratio", F.floor(F.col("corpus_bytes") / F.col("ratio")).cast("long").alias("compressed_bytes"), "token_count", packed.alias("packed_bytes"), verified.alias("round_trip_verified"),
        F.when(verified.eqNullSafe(False), F.concat(F.lit("sha256 mismatch in "), "backend")).alias("error"), F.when(d(55, 23) == 0, d(57, 5)).otherwise(F.lit(0)).cast("long").alias("unsafe_boundary_cuts"),
        F.concat("corpus_tier", F.lit(".jsonl")).alias("source_file"), (F.col("gen_ord") + F.col("attempt") * 1000000).cast("long").alias("line"),
    )


_B = dims.BACKENDS


def _values(rows) -> str:
    show = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(show(v) for v in r) + ")" for r in rows)


#: The same relation for DuckDB, as common table expressions.
RECORDS = """sized AS (SELECT doc_id, sha256('20240517:' || doc_id::VARCHAR) AS k,
  CAST(strlen(text) + CASE WHEN ends_with(text, chr(10)) THEN 2 ELSE 3 END AS BIGINT) AS record_bytes, text FROM documents),
placed AS (SELECT doc_id, text, k, record_bytes, row_number() OVER (ORDER BY k, doc_id) AS ord,
  CAST(coalesce(sum(record_bytes) OVER (ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bytes_before FROM sized),
targets(corpus_tier, target_bytes, tier_rank) AS (VALUES """ + _values([(t, b, i) for i, (t, b) in enumerate(dims.SMALL_TIERS.items())]) + """),
members AS (SELECT t.*, p.* FROM targets t, placed p WHERE p.bytes_before < t.target_bytes AND (SELECT sum(record_bytes) FROM sized) >= t.target_bytes),
tiers AS (SELECT corpus_tier, target_bytes, tier_rank, count(*) AS documents, CAST(sum(record_bytes) AS BIGINT) AS corpus_bytes, max(bytes_before) AS last_start FROM members GROUP BY ALL)"""

_AXES = "tok(tokenizer, vocabulary, tokenizer_ord) AS (VALUES " + _values([(t, dims.VOCABULARY[t], i) for i, t in enumerate(dims.TOKENIZERS)]) + "),\n" + \
    "pck(packing, packing_ord) AS (VALUES " + _values([(p, i) for i, p in enumerate(dims.PACKINGS)]) + "),\n" + \
    "bck(backend, family, backend_profile, dict_bytes, backend_ord) AS (VALUES " + _values([(n, v[0], v[1], v[2] and v[2] << 20, i) for i, (n, v) in enumerate(_B.items())]) + "),\n" + \
    "pairs(tokenizer, packing, pair_ord) AS (VALUES " + _values([(t, p, i) for i, (t, p) in enumerate(dims.SWEEP_PAIRS)]) + "),\n" + \
    """changes(cell_kind, axis, v, change_ord) AS (VALUES ('ofat_threads','t','1',0),('ofat_threads','t','4',1),('ofat_layout','l','manual_pool',2),
 ('ofat_layout','l','process_pool',3),('ofat_transport','b','in_process_binding',4),('ofat_chunk_size','c','1048576',5),('ofat_chunk_size','c','4194304',6),
 ('ofat_batch_chunks','n','32',7),('ofat_batch_chunks','n','128',8))"""

_REASON = """CASE WHEN packing = 'fixed_u16' AND vocabulary > 65536 THEN '16 bits tell 65536 ids apart, not the ' || vocabulary || ' of ' || tokenizer
 WHEN packing = 'raw_utf8' AND tokenizer <> 'none' THEN 'raw bytes leave no room for a tokenizer'
 WHEN tokenizer = 'none' AND packing <> 'raw_utf8' THEN packing || ' packs ids, and without a tokenizer there are none'
 WHEN backend = 'lzma_tuned_lp1pb1' AND packing <> 'fixed_u16' THEN 'this coder is tuned to ids of two bytes each'"""

CELLS = _AXES + """,
grid AS (SELECT 'ratio_grid' AS cell_kind, tokenizer, packing, backend, 'subprocess_cli' AS backend_transport, 'library_batch' AS tokenization_layout, CAST(2097152 AS BIGINT) AS chunk_size,
 64 AS batch_chunks, 20 AS threads, family, backend_profile, """ + _REASON + """ END AS reason, tokenizer_ord * 1000 + packing_ord * 100 + backend_ord AS gen_ord FROM tok, pck, bck),
swept AS (SELECT cell_kind, tokenizer, packing, backend, CASE WHEN axis = 'b' THEN v ELSE 'subprocess_cli' END AS backend_transport, CASE WHEN axis = 'l' THEN v ELSE 'library_batch' END AS tokenization_layout,
 CAST(CASE WHEN axis = 'c' THEN v ELSE '2097152' END AS BIGINT) AS chunk_size, CAST(CASE WHEN axis = 'n' THEN v ELSE '64' END AS INTEGER) AS batch_chunks, CAST(CASE WHEN axis = 't' THEN v ELSE '20' END AS INTEGER) AS threads,
 family, backend_profile, vocabulary, 100000 + pair_ord * 10000 + backend_ord * 100 + change_ord AS gen_ord
 FROM pairs JOIN tok USING (tokenizer), bck, changes WHERE backend IN ('lzma_extreme', 'lzma_fast', 'zstd_19', 'zstd_12')),
candidates AS (SELECT cell_kind, tokenizer, packing, backend, backend_transport, tokenization_layout, chunk_size, batch_chunks, threads, family, backend_profile, reason, gen_ord FROM grid UNION ALL
 SELECT cell_kind, tokenizer, packing, backend, backend_transport, tokenization_layout, chunk_size, batch_chunks, threads, family, backend_profile, """ + _REASON + """
 WHEN tokenizer = 'none' AND tokenization_layout <> 'library_batch' THEN 'without a tokenizer nothing is laid out as ' || tokenization_layout END AS reason, gen_ord FROM swept),
cells AS (SELECT * EXCLUDE (reason), substr(sha256(concat_ws('|', tokenizer, packing, backend, backend_transport, tokenization_layout, chunk_size::VARCHAR, batch_chunks::VARCHAR, threads::VARCHAR)), 1, 12) AS cell_id
 FROM candidates WHERE reason IS NULL)"""


def _d(at: int, m: int, text: str = "k || '|' || attempt::VARCHAR") -> str:
    return f"(('0x' || substr(sha256({text}), {at}, 6))::BIGINT % {m})"


RESULTS = RECORDS + ",\n" + CELLS + f""",
tries AS (SELECT c.*, t.corpus_tier, t.tier_rank, t.corpus_bytes, t.corpus_tier || '|' || cell_id AS k FROM cells c, tiers t),
lines AS (SELECT *, a.attempt FROM tries, (VALUES (0), (1)) a(attempt) WHERE a.attempt = 0 OR {_d(1, 9, "k")} = 0),
metrics AS (SELECT *, CASE WHEN tokenizer = 'none' THEN 0 ELSE CAST(floor(corpus_bytes * 10 / (24 + {_d(7, 10)})) AS BIGINT) END AS token_count,
 (20000 + {_d(1, 20000)}) / 10000.0::DOUBLE + tier_rank * 0.05::DOUBLE AS ratio, {_d(19, 13)} AS ver FROM lines),
log AS (SELECT substr(sha256(k), 1, 12) AS row_id, CASE WHEN {_d(25, 17)} = 0 THEN 'smoke' ELSE cell_kind END AS cell_kind, corpus_tier, tier_rank, corpus_bytes, tokenizer, packing, backend, backend_transport,
 tokenization_layout, chunk_size, batch_chunks, threads, backend_profile, family, CASE WHEN tokenizer = 'none' THEN 0.0 ELSE (100 + {_d(31, 9000)}) / 1000.0 END::DOUBLE AS tokenize_time_s,
 (500 + {_d(37, 90000)}) / 1000.0::DOUBLE AS total_time_s, (5000 + {_d(43, 70000)}) / 1000.0::DOUBLE AS throughput_mbps,
 CASE WHEN {_d(49, 5)} = 0 THEN NULL ELSE (9000 + {_d(49, 90000)}) / 1000.0::DOUBLE END AS decompress_throughput_mbps, ratio, CAST(floor(corpus_bytes / ratio) AS BIGINT) AS compressed_bytes, token_count,
 CAST(CASE WHEN {_d(13, 7)} = 0 THEN NULL WHEN tokenizer = 'none' THEN corpus_bytes WHEN packing = 'fixed_u16' THEN token_count * 2 ELSE floor(token_count * 19 / 10) END AS BIGINT) AS packed_bytes,
 CASE ver WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS round_trip_verified, CASE WHEN ver = 0 THEN 'sha256 mismatch in ' || backend END AS error,
 CAST(CASE WHEN {_d(55, 23)} = 0 THEN {_d(57, 5)} ELSE 0 END AS BIGINT) AS unsafe_boundary_cuts, corpus_tier || '.jsonl' AS source_file, CAST(gen_ord + attempt * 1000000 AS BIGINT) AS line FROM metrics),
latest AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY row_id, corpus_tier ORDER BY source_file DESC, line DESC) AS n FROM log) WHERE n = 1),
ok AS (SELECT * FROM latest WHERE round_trip_verified),
base AS (SELECT *, CASE WHEN tokenizer = 'none' THEN 'raw' ELSE tokenizer || '+' || packing END AS pipeline FROM ok WHERE cell_kind = 'ratio_grid' OR NOT EXISTS (SELECT 1 FROM ok WHERE cell_kind = 'ratio_grid')),
raw_own AS (SELECT backend, corpus_tier, ratio AS raw_ratio FROM base WHERE tokenizer = 'none'),
raw AS (SELECT * FROM raw_own UNION ALL SELECT 'lzma_tuned_lp1pb1', corpus_tier, raw_ratio FROM raw_own r WHERE backend = 'lzma_extreme'
 AND NOT EXISTS (SELECT 1 FROM raw_own o WHERE o.backend = 'lzma_tuned_lp1pb1' AND o.corpus_tier = r.corpus_tier)),
gaps AS (SELECT b.backend, b.pipeline, b.corpus_tier, b.tier_rank, b.ratio, b.ratio - r.raw_ratio AS gap, (b.ratio - r.raw_ratio) / r.raw_ratio * 100 AS gap_pct
 FROM base b LEFT JOIN raw r ON r.backend = b.backend AND r.corpus_tier = b.corpus_tier WHERE b.tokenizer <> 'none')"""
