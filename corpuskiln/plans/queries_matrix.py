"""Queries over the experiment matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskiln.plans import matrix
from corpuskiln.plans.registry import query
from corpuskiln.plans.synth import CELLS, RESULTS

_SHOWN = "cell_kind, tokenizer, packing, backend, backend_transport, tokenization_layout, chunk_size, batch_chunks, threads"
_COLUMNS = [c.strip() for c in _SHOWN.split(",")]


@query(f"WITH {CELLS} SELECT {_SHOWN} FROM grid WHERE reason IS NULL")
def ratio_grid(spark, sf_dir):
    return matrix.grid_candidates(spark).where("reason is null").select(_COLUMNS)


@query(f"WITH {CELLS} SELECT {_SHOWN} FROM grid WHERE reason IS NULL AND backend_profile = 'fast'")
def ratio_grid_fast(spark, sf_dir):
    return matrix.grid_candidates(spark, "fast").where("reason is null").select(_COLUMNS)


@query(f"WITH {CELLS} SELECT tokenizer, packing, backend, backend_transport, tokenization_layout, reason FROM candidates WHERE reason IS NOT NULL")
def drop_log(spark, sf_dir):
    return matrix.candidates(spark).where("reason is not null").select("tokenizer", "packing", "backend", "backend_transport", "tokenization_layout", "reason")


@query(f"WITH {CELLS} SELECT reason, count(*) AS dropped, min(gen_ord)::INTEGER AS first_seen FROM candidates WHERE reason IS NOT NULL GROUP BY reason")
def drop_log_summary(spark, sf_dir):
    """Drops by reason; ``first_seen`` orders equal counts."""
    found = matrix.candidates(spark).where("reason is not null")
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("dropped"), F.min("gen_ord").alias("first_seen")).orderBy(F.desc("dropped"), "first_seen")


@query(f"WITH {CELLS} SELECT {_SHOWN} FROM candidates WHERE reason IS NULL AND cell_kind <> 'ratio_grid'")
def ofat_cells(spark, sf_dir):
    return matrix.sweep_candidates(spark).where("reason is null").select(_COLUMNS)


@query(f"WITH {CELLS}, firsts AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY gen_ord) AS n FROM cells) SELECT cell_id AS row_id, {_SHOWN} FROM firsts WHERE n = 1")
def all_cells_dedup(spark, sf_dir):
    return matrix.cells(spark).select("row_id", *_COLUMNS)


@query(f"WITH {CELLS} SELECT cell_kind, count(DISTINCT cell_id) AS cells FROM cells GROUP BY cell_kind")
def cell_kind_counts(spark, sf_dir):
    return matrix.cells(spark).groupBy("cell_kind").agg(F.count(F.lit(1)).alias("cells")).orderBy(F.desc("cells"), "cell_kind")


@query(f"WITH {CELLS} SELECT cell_id AS row_id, concat_ws('|', tokenizer, packing, backend, backend_transport, tokenization_layout, chunk_size::VARCHAR, batch_chunks::VARCHAR, threads::VARCHAR) AS identity FROM cells")
def row_id_sha(spark, sf_dir):
    return matrix.cells(spark).select("row_id", matrix.canonical(*matrix.KEYS).alias("identity"))


@query(f"WITH {CELLS} SELECT count(*) AS cells, count(*) AS distinct_ids, true AS well_formed FROM cells")
def row_id_blake2b(spark, sf_dir):
    ids = matrix.cells(spark).select(matrix.blake_row_id(F.lit("64MB"), *matrix.KEYS).alias("id"))
    return ids.agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("id").alias("distinct_ids"), F.bool_and(F.col("id").rlike("^[0-9a-f]{12}$")).alias("well_formed"))


@query(f"WITH {CELLS} SELECT count(*) FILTER (WHERE reason IS NULL) AS cells, count(*) FILTER (WHERE reason IS NOT NULL) AS dropped, count(DISTINCT reason) AS reasons FROM candidates")
def plan_summary(spark, sf_dir):
    return matrix.candidates(spark).agg(F.count_if(F.col("reason").isNull()).alias("cells"), F.count("reason").alias("dropped"), F.count_distinct("reason").alias("reasons"))


@query(f"""WITH {CELLS}, tools(tool, available, threaded) AS (VALUES ('xz', true, false), ('zstd', false, true), ('gzip', true, true), ('bzip2', true, true)),
need AS (SELECT c.*, CASE WHEN backend_transport = 'subprocess_cli' THEN CASE family WHEN 'lzma' THEN 'xz' WHEN 'bz2' THEN 'bzip2' ELSE family END WHEN family = 'zstd' THEN 'zstandard' END AS tool FROM cells c)
SELECT backend, backend_transport, count(*) AS cells, CASE WHEN n.tool IS NULL THEN NULL WHEN NOT coalesce(available, false) THEN CASE WHEN n.tool = 'zstandard' THEN 'in process, zstd needs the zstandard package' ELSE 'no command named ' || n.tool END
 WHEN n.tool = 'xz' AND NOT threaded THEN 'this xz knows no threads' END AS unavailable FROM need n LEFT JOIN tools t ON n.tool = t.tool GROUP BY ALL""")
def availability(spark, sf_dir):
    tools = spark.createDataFrame([("xz", True, False), ("zstd", False, True), ("gzip", True, True), ("bzip2", True, True)], "tool string, available boolean, supports_threading boolean")
    return matrix.availability_reason(matrix.cells(spark), tools).groupBy("backend", "backend_transport", "unavailable").agg(F.count(F.lit(1)).alias("cells"))


_RESUME = f"WITH {RESULTS}, todo AS (SELECT DISTINCT row_id, corpus_tier, backend FROM log WHERE corpus_tier = '256KB')"


@query(f"{_RESUME} SELECT row_id, backend FROM todo t WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.row_id = t.row_id AND l.round_trip_verified)")
def resume_antijoin(spark, sf_dir):
    from corpuskiln.plans import synth

    log = synth.results(spark, sf_dir)
    todo = log.where("corpus_tier = '256KB'").select("row_id", "backend").distinct()
    return matrix.remaining(todo, log)


@query("SELECT * FROM (VALUES ('fig_gap.png'), ('fig_threads.png')) v(figure)")
def missing_figures(spark, sf_dir):
    """Expected names without those that are present."""
    expected = spark.createDataFrame([(f"fig_{n}.png",) for n in ("gap", "pareto", "ratio", "threads")], "figure string")
    present = spark.createDataFrame([("fig_pareto.png",), ("fig_ratio.png",), ("other.png",)], "figure string")
    return expected.subtract(present)


@query(f"WITH {CELLS} SELECT backend, family, CASE WHEN family = 'bz2' THEN 'bzip2' ELSE family END AS plot_family, CASE family WHEN 'lzma' THEN 0 WHEN 'zstd' THEN 1 WHEN 'gzip' THEN 2 ELSE 3 END AS family_ord, CASE backend WHEN 'lzma_extreme' THEN '64 MiB' WHEN 'lzma_tuned_lp1pb1' THEN '64 MiB' WHEN 'lzma_fast' THEN '32 MiB' WHEN 'zstd_12' THEN '128 MiB' WHEN 'zstd_19' THEN '128 MiB' WHEN 'zstd_22_long' THEN '2 GiB' WHEN 'gzip_9' THEN '32 KiB' ELSE '900 KiB blk' END AS window_label FROM bck")
def backend_dimension(spark, sf_dir):
    """Backends with the family and window that figures show."""
    from corpuskiln.plans import dims

    labels = {"gzip_9": "32 KiB", "bz2_9": "900 KiB blk"} | {b: f"{v[2]} MiB" for b, v in dims.BACKENDS.items() if v[2]} | {b: "2 GiB" if v[4] == 31 else f"{1 << (v[4] - 20)} MiB" for b, v in dims.BACKENDS.items() if v[4]}
    label = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    plot = dims.plot_family(F.col("backend"))
    order = F.array_position(F.array(*[F.lit(f) for f in dims.FAMILY_ORDER]), plot) - 1
    return dims.backends(spark).select("backend", "family", plot.alias("plot_family"), order.cast("int").alias("family_ord"), label[F.col("backend")].alias("window_label"))
