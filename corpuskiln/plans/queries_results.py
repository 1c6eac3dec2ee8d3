"""Report queries over the derivable result relation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskiln.functions import scalars
from corpuskiln.plans import dims, matrix, reports, synth
from corpuskiln.plans.registry import query
from corpuskiln.plans.synth import RESULTS
from corpuskiln.sources import results


def _log(spark, sf_dir):
    return synth.results(spark, sf_dir)


def _ok(spark, sf_dir):
    return results.verified(results.latest(_log(spark, sf_dir)))


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"WITH {RESULTS} SELECT row_id, corpus_tier, line, ratio, round_trip_verified AS verified FROM latest")
def last_wins_dedup(spark, sf_dir):
    return results.latest(_log(spark, sf_dir)).select("row_id", "corpus_tier", "line", "ratio", F.col("round_trip_verified").alias("verified"))


@query(f"WITH {RESULTS} SELECT row_id, corpus_tier, bool_or(coalesce(round_trip_verified, false)) AS done FROM log GROUP BY row_id, corpus_tier")
def done_any_verified(spark, sf_dir):
    """Resume's view: done if any line was verified, whatever came later."""
    return _log(spark, sf_dir).groupBy("row_id", "corpus_tier").agg(F.bool_or(F.coalesce("round_trip_verified", F.lit(False))).alias("done"))


@query(f"WITH {RESULTS} SELECT row_id, max(line) AS line, arg_max(ratio, line) AS ratio FROM log GROUP BY row_id")
def rerun_lookup(spark, sf_dir):
    """The last line of every row that can be asked for."""
    return _log(spark, sf_dir).groupBy("row_id").agg(F.max("line").alias("line"), F.max_by("ratio", "line").alias("ratio"))


@query(f"WITH {RESULTS} SELECT row_id, line, backend FROM log WHERE NOT (starts_with(backend, 'lzma') AND backend_transport = 'in_process_binding')")
def prune_stale(spark, sf_dir):
    return results.without_stale(_log(spark, sf_dir)).select("row_id", "line", "backend")


@query(f"WITH {RESULTS} SELECT starts_with(backend, 'lzma') AND backend_transport = 'in_process_binding' AS pruned, count(*) AS lines FROM log GROUP BY 1")
def prune_partition(spark, sf_dir):
    """Kept and pruned rows are all rows."""
    log = _log(spark, sf_dir)
    part = lambda df, flag: df.agg(F.count(F.lit(1)).alias("lines")).select(F.lit(flag).alias("pruned"), "lines")
    return part(results.stale(log), True).unionByName(part(results.without_stale(log), False))


@query(f"WITH {RESULTS} SELECT source_file, count(*) AS rows, count(DISTINCT corpus_tier) AS tiers, count(*) FILTER (WHERE round_trip_verified) AS verified, sum(unsafe_boundary_cuts)::BIGINT AS unsafe_cuts FROM latest GROUP BY source_file")
def results_by_file(spark, sf_dir):
    return results.latest(_log(spark, sf_dir)).groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("corpus_tier").alias("tiers"), F.count_if(F.col("round_trip_verified").eqNullSafe(True)).alias("verified"), F.sum("unsafe_boundary_cuts").alias("unsafe_cuts")
    )


@query(f"WITH {RESULTS} SELECT count(*) AS rows, sum(round(total_time_s * 1000)::BIGINT)::BIGINT AS total_ms, sum(unsafe_boundary_cuts)::BIGINT AS unsafe_cuts, max(corpus_bytes) AS largest FROM ok")
def results_totals(spark, sf_dir):
    milliseconds = F.round(F.col("total_time_s") * 1000).cast("long")
    return _ok(spark, sf_dir).agg(F.count(F.lit(1)).alias("rows"), F.sum(milliseconds).alias("total_ms"), F.sum("unsafe_boundary_cuts").alias("unsafe_cuts"), F.max("corpus_bytes").alias("largest"))


@query(f"WITH {RESULTS} SELECT row_id, corpus_tier, NULL::VARCHAR AS note, ratio FROM ok WHERE corpus_tier = '64KB' UNION ALL SELECT row_id, corpus_tier, 'rerun', NULL FROM log WHERE line >= 1000000")
def results_key_union(spark, sf_dir):
    """Rows under the union of their keys; what one kind lacks is null."""
    a = _ok(spark, sf_dir).where("corpus_tier = '64KB'").select("row_id", "corpus_tier", "ratio")
    b = _log(spark, sf_dir).where("line >= 1000000").select("row_id", "corpus_tier", F.lit("rerun").alias("note"))
    return results.union_keys(a, b).select("row_id", "corpus_tier", "note", "ratio")


@query(f"WITH {RESULTS} SELECT row_id, corpus_tier, backend, coalesce(left(error, 200), '') AS error FROM latest WHERE round_trip_verified IS DISTINCT FROM true")
def unverified_report(spark, sf_dir):
    rows = results.latest(_log(spark, sf_dir)).where(~F.col("round_trip_verified").eqNullSafe(True))
    return rows.select("row_id", "corpus_tier", "backend", F.coalesce(F.left("error", F.lit(200)), F.lit("")).alias("error"))


@query(f"WITH {RESULTS} SELECT corpus_tier, count(*) AS rows, sum(unsafe_boundary_cuts)::BIGINT AS cuts FROM ok WHERE unsafe_boundary_cuts > 0 GROUP BY corpus_tier")
def unsafe_rows(spark, sf_dir):
    return _ok(spark, sf_dir).where("unsafe_boundary_cuts > 0").groupBy("corpus_tier").agg(F.count(F.lit(1)).alias("rows"), F.sum("unsafe_boundary_cuts").alias("cuts"))


@query(f"WITH {RESULTS} SELECT backend, pipeline, corpus_tier, round(ratio, 6) AS ratio, round(gap, 6) AS gap, round(gap_pct, 6) AS gap_pct FROM gaps")
def gap_by_tier(spark, sf_dir):
    return _rounded(reports.gaps(_ok(spark, sf_dir)).drop("tier_rank"), "ratio", "gap", "gap_pct")


@query(f"WITH {RESULTS} SELECT backend, pipeline, corpus_tier, CASE WHEN gap IS NULL THEN '-' ELSE printf('%+.3f', round(gap, 3)) END AS gap_text FROM gaps")
def gap_texts(spark, sf_dir):
    """Gaps as the report writes them."""
    gap = F.round("gap", 3)
    return reports.gaps(_ok(spark, sf_dir)).select("backend", "pipeline", "corpus_tier", F.when(gap.isNull(), "-").otherwise(F.format_string("%+.3f", gap)).alias("gap_text"))


_VERDICTS = f"""WITH {RESULTS}, ends AS (SELECT backend, pipeline, count(gap) AS tiers, arg_max(gap, tier_rank) FILTER (WHERE gap IS NOT NULL) - arg_min(gap, tier_rank) FILTER (WHERE gap IS NOT NULL) AS t,
 arg_max(gap_pct, tier_rank) FILTER (WHERE gap IS NOT NULL) - arg_min(gap_pct, tier_rank) FILTER (WHERE gap IS NOT NULL) AS p FROM gaps GROUP BY backend, pipeline),
verdicts AS (SELECT backend, pipeline, tiers, CASE WHEN tiers >= 2 THEN t END AS trend, CASE WHEN tiers >= 2 THEN p END AS trend_pp, CASE WHEN tiers < 2 THEN '-' WHEN p > 0.25 THEN 'WIDENS' WHEN p < -0.25 THEN 'NARROWS' ELSE 'flat' END AS verdict FROM ends)"""


@query(f"{_VERDICTS} SELECT backend, pipeline, tiers, round(trend, 6) AS trend, round(trend_pp, 6) AS trend_pp, verdict FROM verdicts")
def gap_verdicts(spark, sf_dir):
    return _rounded(reports.gap_verdicts(_ok(spark, sf_dir)), "trend", "trend_pp")


@query(f"{_VERDICTS} SELECT verdict, count(*) AS n FROM verdicts WHERE verdict <> '-' GROUP BY verdict")
def gap_verdict_counts(spark, sf_dir):
    return reports.gap_verdicts(_ok(spark, sf_dir)).where("verdict <> '-'").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


_PACKING = f"""WITH {RESULTS}, wide AS (SELECT corpus_tier, tokenizer, max(ratio) FILTER (WHERE packing = 'leb128' AND backend = 'lzma_extreme') AS leb128, max(ratio) FILTER (WHERE packing = 'fixed_u16' AND backend = 'lzma_extreme') AS fixed_u16,
 max(ratio) FILTER (WHERE packing = 'fixed_u16' AND backend = 'lzma_tuned_lp1pb1') AS tuned FROM base WHERE tokenizer IN ('r50k_base', 'p50k_base') GROUP BY ALL)"""


@query(f"""{_PACKING} SELECT corpus_tier, tokenizer, round(leb128, 6) AS leb128, round(fixed_u16, 6) AS fixed_u16, round(tuned, 6) AS tuned, round((tuned - leb128) / leb128 * 100, 6) AS tuned_vs_leb128_pct, round((tuned - fixed_u16) / fixed_u16 * 100, 6) AS tuning_alone_pct,
 CASE WHEN tuned IS NULL OR leb128 IS NULL THEN '-' WHEN tuned > leb128 THEN 'fixed_u16 WINS' ELSE 'LEB128 wins' END AS verdict FROM wide WHERE leb128 IS NOT NULL OR tuned IS NOT NULL""")
def packing_effect(spark, sf_dir):
    return _rounded(reports.packing_effect(_ok(spark, sf_dir)), "leb128", "fixed_u16", "tuned", "tuned_vs_leb128_pct", "tuning_alone_pct")


@query(f"""{_PACKING}, steps AS (SELECT * FROM wide WHERE leb128 IS NOT NULL AND fixed_u16 IS NOT NULL) SELECT corpus_tier, tokenizer, 1 AS step, 'leb128' AS label, round(leb128, 6) AS top, 0.0::DOUBLE AS delta FROM steps
 UNION ALL SELECT corpus_tier, tokenizer, 2, 'fixed_u16', round(fixed_u16, 6), round(fixed_u16 - leb128, 6) FROM steps UNION ALL SELECT corpus_tier, tokenizer, 3, 'tuned', round(coalesce(tuned, fixed_u16), 6), round(coalesce(tuned, fixed_u16) - fixed_u16, 6) FROM steps""")
def packing_waterfall(spark, sf_dir):
    return _rounded(reports.packing_steps(_ok(spark, sf_dir)), "top", "delta")


_LAYOUT = f"""WITH {RESULTS}, times AS (SELECT corpus_tier, tokenizer, packing, backend, threads, chunk_size, batch_chunks, backend_transport, max(tokenize_time_s) FILTER (WHERE tokenization_layout = 'library_batch') AS library_batch,
 max(tokenize_time_s) FILTER (WHERE tokenization_layout = 'manual_pool') AS manual_pool, max(tokenize_time_s) FILTER (WHERE tokenization_layout = 'process_pool') AS process_pool FROM ok WHERE tokenizer <> 'none' AND tokenize_time_s > 0 GROUP BY ALL)"""


@query(f"{_LAYOUT} SELECT *, round((library_batch - manual_pool) / library_batch * 100, 6) AS manual_pool_saves_pct, round((library_batch - process_pool) / library_batch * 100, 6) AS process_pool_saves_pct FROM times WHERE library_batch IS NOT NULL AND (manual_pool IS NOT NULL OR process_pool IS NOT NULL)")
def layout_compare(spark, sf_dir):
    return _rounded(reports.layout_compare(_ok(spark, sf_dir)), "manual_pool_saves_pct", "process_pool_saves_pct")


@query(f"{_LAYOUT} SELECT count(*) FILTER (WHERE manual_pool < library_batch) AS manual_wins, count(*) AS comparable FROM times WHERE library_batch IS NOT NULL AND manual_pool IS NOT NULL")
def layout_win_count(spark, sf_dir):
    return reports.layout_wins(_ok(spark, sf_dir))


_DICT = "CASE backend WHEN 'lzma_extreme' THEN 67108864 WHEN 'lzma_tuned_lp1pb1' THEN 67108864 WHEN 'lzma_fast' THEN 33554432 END"
_THREADS = f"""WITH {RESULTS}, swept_t AS (SELECT * FROM ok WHERE backend_transport = 'subprocess_cli' AND cell_kind IN ('ratio_grid', 'ofat_threads')),
pairs_t AS (SELECT s.*, o.ratio AS r1, o.total_time_s AS t1, coalesce(nullif(o.packed_bytes, 0), CASE WHEN s.packing = 'raw_utf8' THEN s.corpus_bytes WHEN s.packing = 'fixed_u16' AND o.token_count > 0 THEN o.token_count * 2 END) AS fed
 FROM swept_t s JOIN swept_t o ON o.threads = 1 AND s.threads <> 1 AND s.corpus_tier = o.corpus_tier AND s.tokenizer = o.tokenizer AND s.packing = o.packing AND s.backend = o.backend)"""


@query(f"""{_THREADS} SELECT corpus_tier, tokenizer, packing, backend, threads, fed AS fed_bytes, CASE WHEN fed IS NOT NULL THEN greatest(1, round_even(fed / (2.0::DOUBLE * {_DICT}), 0)::BIGINT) ELSE 1 END AS blocks_rounded,
 CASE WHEN fed IS NOT NULL THEN greatest(1, ceil(fed / (2.0::DOUBLE * {_DICT}))::BIGINT) ELSE 1 END AS blocks_ceil, round(t1 / total_time_s, 6) AS speedup, round((ratio - r1) / r1 * 100, 6) AS ratio_cost_pct FROM pairs_t WHERE starts_with(backend, 'lzma')""")
def thread_scaling(spark, sf_dir):
    return _rounded(reports.thread_scaling(_ok(spark, sf_dir)), "speedup", "ratio_cost_pct")


@query(f"{_THREADS} SELECT threads, corpus_tier, greatest(1, round_even(fed / (2.0::DOUBLE * {_DICT}), 0)::BIGINT) AS blocks, round(t1 / total_time_s, 6) AS speedup FROM pairs_t WHERE starts_with(backend, 'lzma') AND fed IS NOT NULL AND threads IN (4, 20)")
def fig_thread_points(spark, sf_dir):
    points = reports.thread_scaling(_ok(spark, sf_dir)).where("fed_bytes is not null and threads in (4, 20)")
    return _rounded(points.select("threads", "corpus_tier", F.col("blocks_rounded").alias("blocks"), "speedup"), "speedup")


@query(f"{_THREADS} SELECT backend, count(*) AS points, round(avg((ratio - r1) / r1 * 100), 6) AS mean_cost_pct FROM pairs_t GROUP BY backend")
def fig_thread_cost_mean(spark, sf_dir):
    return _rounded(reports.thread_cost_mean(_ok(spark, sf_dir)), "mean_cost_pct")


def _top_sql(by: str) -> str:
    return f"WITH {RESULTS}, p AS (SELECT *, row_number() OVER (PARTITION BY corpus_tier ORDER BY coalesce({by}, 0) DESC, row_id)::INTEGER AS place FROM ok) SELECT corpus_tier, place, row_id, tokenizer, packing, backend, threads, round(ratio, 6) AS ratio, throughput_mbps FROM p WHERE place <= 10"


@query(_top_sql("ratio"))
def top10_ratio(spark, sf_dir):
    return _rounded(reports.top(_ok(spark, sf_dir), "ratio"), "ratio")


@query(_top_sql("throughput_mbps"))
def top10_throughput(spark, sf_dir):
    return _rounded(reports.top(_ok(spark, sf_dir), "throughput_mbps"), "ratio")


@query(f"WITH {RESULTS}, b AS (SELECT backend, corpus_tier, max(ratio) AS best_ratio FROM ok WHERE tokenizer <> 'none' GROUP BY ALL), r AS (SELECT backend, corpus_tier, max(ratio) AS raw_ratio FROM ok WHERE tokenizer = 'none' GROUP BY ALL) SELECT backend, corpus_tier, round(best_ratio, 6) AS best_ratio, round(raw_ratio, 6) AS raw_ratio, round(best_ratio - raw_ratio, 6) AS gap FROM b JOIN r USING (backend, corpus_tier)")
def best_vs_raw(spark, sf_dir):
    return _rounded(reports.best_vs_raw(_ok(spark, sf_dir)), "best_ratio", "raw_ratio", "gap")


@query(f"""WITH {RESULTS}, pts AS (SELECT *, max(throughput_mbps) OVER (ORDER BY ratio DESC, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fastest FROM base WHERE corpus_tier = '1MB' AND throughput_mbps > 0 AND ratio > 0)
SELECT row_id, backend, CASE WHEN family IN ('lzma', 'zstd') THEN family ELSE 'gzip / bzip2' END AS family, pipeline, round(ratio, 6) AS ratio, throughput_mbps FROM pts WHERE fastest IS NULL OR throughput_mbps > fastest""")
def pareto_frontier(spark, sf_dir):
    return _rounded(reports.pareto(_ok(spark, sf_dir), "1MB"), "ratio")


@query(f"""WITH {RESULTS}, g AS (SELECT * FROM gaps WHERE gap IS NOT NULL AND pipeline IN ('p50k_base+fixed_u16', 'o200k_base+leb128')), e AS (SELECT pipeline, backend, arg_max(gap_pct, tier_rank) AS last, arg_min(gap_pct, tier_rank) AS first FROM g GROUP BY ALL HAVING count(*) >= 2),
m AS (SELECT *, last = max(last) OVER w AS highest, last = min(last) OVER w AS lowest, last - first = max(last - first) OVER w AS steepest FROM e WINDOW w AS (PARTITION BY pipeline)) SELECT pipeline, backend, corpus_tier, round(gap_pct, 6) AS gap_pct, highest, lowest, steepest FROM g JOIN m USING (pipeline, backend)""")
def fig_gap_data(spark, sf_dir):
    return _rounded(reports.gap_curves(_ok(spark, sf_dir)), "gap_pct")


_FIRST_TIERS = ("64KB", "256KB", "1MB")


@query(f"WITH {RESULTS} SELECT backend, pipeline, " + ", ".join(f"round(max(ratio) FILTER (WHERE corpus_tier = '{t}'), 6) AS r_{t.lower()}" for t in _FIRST_TIERS) + " FROM base GROUP BY backend, pipeline")
def fig_ratio_multiples(spark, sf_dir):
    wide = reports.ratio_multiples(_ok(spark, sf_dir), _FIRST_TIERS)
    return wide.select("backend", "pipeline", *[F.round(F.col(t), 6).alias(f"r_{t.lower()}") for t in _FIRST_TIERS])


def _median(column: str) -> str:
    return f"list_sort(list({column}))[count(*) // 2 + 1]"


@query(f"""WITH {RESULTS}, known AS (SELECT *, coalesce(nullif(decompress_throughput_mbps, 0), throughput_mbps) AS d FROM log WHERE round_trip_verified AND corpus_tier <> '1MB'),
x AS (SELECT backend, backend_transport, threads, {_median('throughput_mbps')} AS c, {_median('d')} AS d FROM known GROUP BY ALL), b AS (SELECT backend, {_median('throughput_mbps')} AS c, {_median('d')} AS d, {_median('ratio')} AS r FROM known GROUP BY ALL),
j AS (SELECT coalesce(x.c, b.c) AS c, coalesce(x.d, b.d) AS d, coalesce(b.r, 3.0) AS r FROM cells LEFT JOIN x USING (backend, backend_transport, threads) LEFT JOIN b USING (backend))
SELECT count(*) AS cells, count(*) FILTER (WHERE c IS NULL) AS cells_without_prior, round(sum(5.0::DOUBLE / greatest(c, 1e-9) + 5.0::DOUBLE / greatest(d, 1e-9)), 6) AS wall_clock_s, max(floor(5242880.0::DOUBLE / greatest(r, 0.1)))::BIGINT AS peak_disk_bytes, max(floor(5242880.0::DOUBLE / greatest(r, 0.1))) * 2 <= 4000000 AS allowed FROM j""")
def estimate_sweep(spark, sf_dir):
    """Pre-flight estimate of a 5 MB corpus from the rows of other tiers."""
    prior = _log(spark, sf_dir).where("corpus_tier <> '1MB'")
    return _rounded(reports.estimate(matrix.cells(spark), prior, 5242880, 4000000), "wall_clock_s")


@query(f"WITH {RESULTS} SELECT row_id, corpus_tier, CASE WHEN tokenizer = 'none' THEN 'raw' ELSE tokenizer || '+' || packing END AS pipeline, coalesce(printf('%.4f', ratio), '-') AS ratio_text, coalesce(printf('%.1f', decompress_throughput_mbps), '-') AS decompress_text FROM ok")
def formatted_rows(spark, sf_dir):
    """What the report tables show: labels, fixed decimals, ``-`` for null."""
    return _ok(spark, sf_dir).select("row_id", "corpus_tier", scalars.pipeline(F.col("tokenizer"), F.col("packing")).alias("pipeline"), scalars.number(F.col("ratio")).alias("ratio_text"), scalars.number(F.col("decompress_throughput_mbps"), 1).alias("decompress_text"))


# Published ratios by tier, tokenizer and packing (LEB128, 16-bit, 16-bit tuned).
PUBLISHED_PACKING = (
    ("64MB", "r50k_base", 3.6856, 3.8975, 3.9214),
    ("64MB", "p50k_base", 3.6915, 3.9060, 3.9304),
    ("256MB", "r50k_base", 3.7978, 4.0152, 4.0344),
    ("256MB", "p50k_base", 3.8099, 4.0295, 4.0488),
    ("1GB", "r50k_base", 3.8260, 4.0480, 4.0661),
    ("1GB", "p50k_base", 3.8416, 4.0668, 4.0855),
    ("4GB", "r50k_base", 3.8242, 4.0454, 4.0634),
    ("4GB", "p50k_base", 3.8355, 4.0602, 4.0785),
)
# Published gaps of p50k+16-bit over raw in percent, first and last tier, with verdicts.
PUBLISHED_GAPS = (
    ("gzip_9", 15.38, 15.30, "flat"),
    ("bz2_9", -3.87, -3.85, "flat"),
    ("zstd_12", 6.12, 6.53, "WIDENS"),
    ("zstd_19", 5.04, 5.58, "WIDENS"),
    ("lzma_fast", 8.16, 9.21, "WIDENS"),
    ("lzma_extreme", 7.55, 9.08, "WIDENS"),
    ("lzma_tuned_lp1pb1", 8.22, 9.58, "WIDENS"),
    ("zstd_22_long", 3.65, 5.19, "WIDENS"),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{k}', '{'+%.1f' % ((c - a) / a * 100)}%', 'fixed_u16 WINS')" for t, k, a, _, c in PUBLISHED_PACKING) + ") v(corpus_tier, tokenizer, change, verdict)")
def published_packing_verdicts(spark, sf_dir):
    """The packing query on published ratios."""
    cells = [(t, k, p, b, r) for t, k, *rs in PUBLISHED_PACKING for (p, b), r in zip((("leb128", "lzma_extreme"), ("fixed_u16", "lzma_extreme"), ("fixed_u16", "lzma_tuned_lp1pb1")), rs)]
    rows = spark.createDataFrame(cells, "corpus_tier string, tokenizer string, packing string, backend string, ratio double").withColumn("cell_kind", F.lit("ratio_grid"))
    found = reports.packing_effect(rows)
    return found.select("corpus_tier", "tokenizer", F.format_string("%+.1f%%", "tuned_vs_leb128_pct").alias("change"), "verdict")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{b}', '{v}')" for b, _, _, v in PUBLISHED_GAPS) + ") v(backend, verdict)")
def published_gap_verdicts(spark, sf_dir):
    """The gap query on published gaps, put back as ratios over a raw ratio of one."""
    rows = [("none", "raw_utf8", b, t, k, 1.0) for b, *_ in PUBLISHED_GAPS if b != "lzma_tuned_lp1pb1" for t, k in (("64MB", 0), ("4GB", 3))]
    rows += [("p50k_base", "fixed_u16", b, t, k, 1 + g / 100) for b, first, last, _ in PUBLISHED_GAPS for t, k, g in (("64MB", 0, first), ("4GB", 3, last))]
    table = spark.createDataFrame(rows, "tokenizer string, packing string, backend string, corpus_tier string, tier_rank int, ratio double")
    return reports.gap_verdicts(table.withColumn("cell_kind", F.lit("ratio_grid"))).select("backend", "verdict")


@query("SELECT * FROM (VALUES ('lzma_extreme', 1, 134217728::BIGINT), ('lzma_extreme', 4, 134217728), ('lzma_extreme', 20, 134217728), ('lzma_tuned_lp1pb1', 1, 134217728), ('lzma_tuned_lp1pb1', 4, 134217728), ('lzma_tuned_lp1pb1', 20, 134217728), ('lzma_fast', 1, 67108864), ('lzma_fast', 4, 67108864), ('lzma_fast', 20, 67108864)) v(backend, threads, block_size)")
def xz_block_sizes(spark, sf_dir):
    some = dims.backends(spark).where("family = 'lzma'").select("backend", "dict_bytes").withColumn("threads", F.explode(F.array(F.lit(1), F.lit(4), F.lit(20))))
    return some.select("backend", "threads", scalars.xz_block_size(F.col("dict_bytes"), F.col("threads")).alias("block_size"))
