"""The report queries over a result relation, as DataFrames.

``rows`` is always the verified, latest rows (``sources.results``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskiln.functions import scalars
from corpuskiln.plans import dims

DICT = {b: v[2] << 20 for b, v in dims.BACKENDS.items() if v[2]}


def grid_rows(rows: DataFrame) -> DataFrame:
    """Grid rows, or all rows if there are none."""
    any_grid = F.max(F.col("cell_kind") == "ratio_grid").alias("any_grid")
    # One row.
    flagged = rows.crossJoin(F.broadcast(rows.agg(any_grid)))
    kept = flagged.where((F.col("cell_kind") == "ratio_grid") | ~F.coalesce("any_grid", F.lit(False))).drop("any_grid")
    return kept.withColumn("pipeline", scalars.pipeline(F.col("tokenizer"), F.col("packing")))


def raw_baselines(grid: DataFrame) -> DataFrame:
    """Raw ratio of each backend and tier; the tuned backend borrows lzma_extreme's if it has none."""
    own = grid.where("tokenizer = 'none'").select("backend", "corpus_tier", F.col("ratio").alias("raw_ratio"))
    lent = own.where("backend = 'lzma_extreme'").withColumn("backend", F.lit("lzma_tuned_lp1pb1"))
    return own.unionByName(lent.join(own, ["backend", "corpus_tier"], "left_anti"))


def gaps(rows: DataFrame) -> DataFrame:
    """Ratio minus the raw ratio, absolute and in percent; null without a baseline."""
    grid = grid_rows(rows)
    joined = grid.where("tokenizer <> 'none'").join(raw_baselines(grid), ["backend", "corpus_tier"], "left")
    gap = F.col("ratio") - F.col("raw_ratio")
    return joined.select("backend", "pipeline", "corpus_tier", "tier_rank", "ratio", gap.alias("gap"), (gap / F.col("raw_ratio") * 100).alias("gap_pct"))


def gap_verdicts(rows: DataFrame) -> DataFrame:
    """Change of the gap from the first to the last tier, judged on the relative one."""
    edge = lambda f, c: f(F.when(F.col("gap").isNotNull(), F.col(c)), F.when(F.col("gap").isNotNull(), F.col("tier_rank")))
    ends = gaps(rows).groupBy("backend", "pipeline").agg(
        F.count("gap").alias("tiers"), (edge(F.max_by, "gap") - edge(F.min_by, "gap")).alias("trend"), (edge(F.max_by, "gap_pct") - edge(F.min_by, "gap_pct")).alias("trend_pp")
    )
    verdict = F.when(F.col("tiers") < 2, "-").when(F.col("trend_pp") > 0.25, "WIDENS").when(F.col("trend_pp") < -0.25, "NARROWS").otherwise("flat")
    two = F.col("tiers") >= 2
    return ends.select("backend", "pipeline", "tiers", F.when(two, F.col("trend")).alias("trend"), F.when(two, F.col("trend_pp")).alias("trend_pp"), verdict.alias("verdict"))


def packing_effect(rows: DataFrame) -> DataFrame:
    """Fixed 16-bit and tuned against LEB128, for the two vocabularies that allow both."""
    of = lambda p, b: F.max(F.when((F.col("packing") == p) & (F.col("backend") == b), F.col("ratio")))
    grid = grid_rows(rows).where(F.col("tokenizer").isin("r50k_base", "p50k_base"))
    wide = grid.groupBy("corpus_tier", "tokenizer").agg(of("leb128", "lzma_extreme").alias("leb128"), of("fixed_u16", "lzma_extreme").alias("fixed_u16"), of("fixed_u16", "lzma_tuned_lp1pb1").alias("tuned"))
    change = (F.col("tuned") - F.col("leb128")) / F.col("leb128") * 100
    return wide.where("leb128 is not null or tuned is not null").select(
        "corpus_tier", "tokenizer", "leb128", "fixed_u16", "tuned", change.alias("tuned_vs_leb128_pct"), ((F.col("tuned") - F.col("fixed_u16")) / F.col("fixed_u16") * 100).alias("tuning_alone_pct"),
        F.when(change.isNull(), "-").when(change > 0, "fixed_u16 WINS").otherwise("LEB128 wins").alias("verdict"),
    )


LAYOUT_KEYS = ["corpus_tier", "tokenizer", "packing", "backend", "threads", "chunk_size", "batch_chunks", "backend_transport"]


def layout_times(rows: DataFrame) -> DataFrame:
    """Tokenizing seconds by layout, one row for each otherwise equal configuration."""
    timed = rows.where("tokenizer <> 'none' and tokenize_time_s > 0")
    return timed.groupBy(*LAYOUT_KEYS).pivot("tokenization_layout", list(dims.LAYOUTS)).agg(F.max("tokenize_time_s"))


def layout_compare(rows: DataFrame) -> DataFrame:
    """Percent that the other layouts save over the library's batch."""
    saves = lambda c: ((F.col("library_batch") - F.col(c)) / F.col("library_batch") * 100).alias(f"{c}_saves_pct")
    both = layout_times(rows).where("library_batch is not null and (manual_pool is not null or process_pool is not null)")
    return both.select(*LAYOUT_KEYS, *dims.LAYOUTS, saves("manual_pool"), saves("process_pool"))


def layout_wins(rows: DataFrame) -> DataFrame:
    both = layout_times(rows).where("library_batch is not null and manual_pool is not null")
    return both.agg(F.count_if(F.col("manual_pool") < F.col("library_batch")).alias("manual_wins"), F.count(F.lit(1)).alias("comparable"))


THREAD_KEYS = ["corpus_tier", "tokenizer", "packing", "backend"]


def threaded(rows: DataFrame) -> DataFrame:
    """Rows at other thread counts beside their one-thread row.

    Only grid and thread-sweep rows count: sweeps of other axes share the default thread
    count and would stand in for each other.
    """
    swept = rows.where("backend_transport = 'subprocess_cli' and cell_kind in ('ratio_grid', 'ofat_threads')")
    one = swept.where("threads = 1").select(*THREAD_KEYS, F.col("ratio").alias("t1_ratio"), F.col("total_time_s").alias("t1_time"), F.col("packed_bytes").alias("t1_packed"), F.col("token_count").alias("t1_tokens"))
    joined = swept.where("threads <> 1").join(one, THREAD_KEYS)
    fed = scalars.compressor_input(F.col("t1_packed"), F.col("packing"), F.col("corpus_bytes"), F.col("t1_tokens"))
    lookup = F.create_map(*[F.lit(x) for kv in DICT.items() for x in kv])
    return joined.withColumn("fed_bytes", fed).withColumn("dict_bytes", lookup[F.col("backend")])


def thread_scaling(rows: DataFrame) -> DataFrame:
    """Speedup, ratio cost and block counts of xz at several threads."""
    found = threaded(rows).where(F.startswith("backend", F.lit("lzma")))
    return found.select(
        *THREAD_KEYS, "threads", "fed_bytes", scalars.blocks_rounded(F.col("fed_bytes"), F.col("dict_bytes")).alias("blocks_rounded"), scalars.blocks_ceil(F.col("fed_bytes"), F.col("dict_bytes")).alias("blocks_ceil"),
        (F.col("t1_time") / F.col("total_time_s")).alias("speedup"), ((F.col("ratio") - F.col("t1_ratio")) / F.col("t1_ratio") * 100).alias("ratio_cost_pct"),
    )


def thread_cost_mean(rows: DataFrame) -> DataFrame:
    cost = (F.col("ratio") - F.col("t1_ratio")) / F.col("t1_ratio") * 100
    return threaded(rows).groupBy("backend").agg(F.count(F.lit(1)).alias("points"), F.avg(cost).alias("mean_cost_pct"))


def top(rows: DataFrame, by: str, n: int = 10) -> DataFrame:
    """The n best rows of each tier."""
    best = Window.partitionBy("corpus_tier").orderBy(F.desc(F.coalesce(by, F.lit(0.0))), "row_id")
    return rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n).select("corpus_tier", "place", "row_id", "tokenizer", "packing", "backend", "threads", "ratio", "throughput_mbps")


def best_vs_raw(rows: DataFrame) -> DataFrame:
    """The best packed ratio of each backend and tier beside its raw ratio."""
    best = rows.where("tokenizer <> 'none'").groupBy("backend", "corpus_tier").agg(F.max(F.struct("ratio", "row_id")).alias("b"))
    raw = rows.where("tokenizer = 'none'").groupBy("backend", "corpus_tier").agg(F.max("ratio").alias("raw_ratio"))
    return best.join(raw, ["backend", "corpus_tier"]).select("backend", "corpus_tier", F.col("b.ratio").alias("best_ratio"), "raw_ratio", (F.col("b.ratio") - F.col("raw_ratio")).alias("gap"))


def pareto(rows: DataFrame, tier: str) -> DataFrame:
    """Rows of a tier that no row beats in both ratio and throughput.

    Ratios of one tier's grid only: as many rows as the grid has cells.
    """
    points = grid_rows(rows).where((F.col("corpus_tier") == tier) & (F.col("throughput_mbps") > 0) & (F.col("ratio") > 0))
    above = Window.partitionBy("corpus_tier").orderBy(F.desc("ratio"), "row_id").rowsBetween(Window.unboundedPreceding, -1)
    front = points.withColumn("fastest", F.max("throughput_mbps").over(above)).where(F.col("fastest").isNull() | (F.col("throughput_mbps") > F.col("fastest")))
    family = dims.plot_family(F.col("backend"))
    return front.select("row_id", "backend", F.when(family.isin("lzma", "zstd"), family).otherwise("gzip / bzip2").alias("family"), "pipeline", "ratio", "throughput_mbps")


def gap_curves(rows: DataFrame, pipelines: tuple[str, ...] = ("p50k_base+fixed_u16", "o200k_base+leb128")) -> DataFrame:
    """Points of the gap curves with at least two tiers, and which curves carry a label."""
    found = gaps(rows).where(F.col("gap").isNotNull() & F.col("pipeline").isin(*pipelines))
    each = Window.partitionBy("pipeline", "backend")
    points = found.withColumn("tiers", F.count(F.lit(1)).over(each)).where("tiers >= 2")
    ends = points.groupBy("pipeline", "backend").agg(F.max_by("gap_pct", "tier_rank").alias("last"), F.min_by("gap_pct", "tier_rank").alias("first"))
    panel = Window.partitionBy("pipeline")
    marked = ends.select("pipeline", "backend", (F.col("last") == F.max("last").over(panel)).alias("highest"), (F.col("last") == F.min("last").over(panel)).alias("lowest"), ((F.col("last") - F.col("first")) == F.max(F.col("last") - F.col("first")).over(panel)).alias("steepest"))
    return points.join(marked, ["pipeline", "backend"]).select("pipeline", "backend", "corpus_tier", "gap_pct", "highest", "lowest", "steepest")


def ratio_multiples(rows: DataFrame, tiers: tuple[str, ...]) -> DataFrame:
    return grid_rows(rows).groupBy("backend", "pipeline").pivot("corpus_tier", list(tiers)).agg(F.max("ratio"))


def packing_steps(rows: DataFrame) -> DataFrame:
    """LEB128, fixed 16-bit and tuned ratios as steps; without a tuned row its step is flat."""
    wide = packing_effect(rows).where("leb128 is not null and fixed_u16 is not null")
    tuned = F.coalesce("tuned", "fixed_u16")
    steps = F.array(
        F.struct(F.lit(1).alias("step"), F.lit("leb128").alias("label"), F.col("leb128").alias("top"), F.lit(0.0).alias("delta")),
        F.struct(F.lit(2).alias("step"), F.lit("fixed_u16").alias("label"), F.col("fixed_u16").alias("top"), (F.col("fixed_u16") - F.col("leb128")).alias("delta")),
        F.struct(F.lit(3).alias("step"), F.lit("tuned").alias("label"), tuned.alias("top"), (tuned - F.col("fixed_u16")).alias("delta")),
    )
    return wide.select("corpus_tier", "tokenizer", F.explode(steps).alias("s")).select("corpus_tier", "tokenizer", "s.*")


def estimate(cells: DataFrame, log: DataFrame, corpus_bytes: int, free_bytes: int) -> DataFrame:
    """Wall clock and disk of a sweep from verified rows, by three widening lookups."""
    known = log.where(F.col("round_trip_verified").eqNullSafe(True))
    timed = known.where("throughput_mbps > 0").select("backend", "backend_transport", "threads", F.col("throughput_mbps").alias("c"), F.coalesce(F.nullif("decompress_throughput_mbps", F.lit(0.0)), "throughput_mbps").alias("d"))
    both = lambda p: [scalars.upper_median(F.collect_list("c")).alias(f"{p}c"), scalars.upper_median(F.collect_list("d")).alias(f"{p}d")]
    exact = timed.groupBy("backend", "backend_transport", "threads").agg(*both("x"))
    any_threads = timed.where("threads is null").groupBy("backend", "backend_transport").agg(*both("n"))
    any_row = timed.groupBy("backend").agg(*both("b"))
    ratios = known.where("ratio > 0").groupBy("backend").agg(scalars.upper_median(F.collect_list("ratio")).alias("r"))
    joined = cells.join(exact, ["backend", "backend_transport", "threads"], "left").join(any_threads, ["backend", "backend_transport"], "left").join(any_row, "backend", "left").join(ratios, "backend", "left")
    mb = corpus_bytes / 1048576
    c, d = F.coalesce("xc", "nc", "bc"), F.coalesce("xd", "nd", "bd")
    seconds = F.lit(mb) / F.greatest(c, F.lit(1e-9)) + F.lit(mb) / F.greatest(d, F.lit(1e-9))
    disk = F.floor(F.lit(float(corpus_bytes)) / F.greatest(F.coalesce("r", F.lit(3.0)), F.lit(0.1))).cast("long")
    out = joined.agg(F.count(F.lit(1)).alias("cells"), F.count_if(c.isNull()).alias("cells_without_prior"), F.coalesce(F.sum(seconds), F.lit(0.0)).alias("wall_clock_s"), F.coalesce(F.max(disk), F.lit(0)).alias("peak_disk_bytes"))
    return out.withColumn("allowed", F.col("peak_disk_bytes") * 2 <= F.lit(free_bytes))


def sections(log: DataFrame, tiers: list[str]) -> list[tuple[str, DataFrame]]:
    """Titles and relations of the whole report over a log; each as small as the matrix.

    ``log`` has the latest rows, verified or not, with ``tier_rank``.
    """
    rows = log.where(F.col("round_trip_verified").eqNullSafe(True))
    unsure = log.where(~F.col("round_trip_verified").eqNullSafe(True)).select("row_id", "corpus_tier", "backend", F.left(F.coalesce("error", F.lit("")), F.lit(200)).alias("error"))
    cuts = rows.where("unsafe_boundary_cuts > 0").groupBy("corpus_tier").agg(F.count(F.lit(1)).alias("rows"), F.sum("unsafe_boundary_cuts").alias("cuts"))
    found = [
        ("gaps", gap_verdicts(rows), ["backend", "pipeline"]),
        ("packing", packing_effect(rows), ["corpus_tier", "tokenizer"]),
        ("layouts", layout_compare(rows), LAYOUT_KEYS),
        ("layouts that win", layout_wins(rows), ["comparable"]),
        ("threads", thread_scaling(rows), [*THREAD_KEYS, "threads"]),
        ("mean ratio cost of threads", thread_cost_mean(rows), ["backend"]),
        ("best ratios", top(rows, "ratio"), ["corpus_tier", "place"]),
        ("fastest", top(rows, "throughput_mbps"), ["corpus_tier", "place"]),
        ("best against raw", best_vs_raw(rows), ["backend", "corpus_tier"]),
        ("rows not verified", unsure, ["corpus_tier", "row_id"]),
        ("unsafe cuts", cuts, ["corpus_tier"]),
        ("figure: gap curves", gap_curves(rows), ["pipeline", "backend", "corpus_tier"]),
        ("figure: ratios by tier", ratio_multiples(rows, tuple(tiers)), ["backend", "pipeline"]),
        ("figure: packing steps", packing_steps(rows), ["corpus_tier", "tokenizer", "step"]),
        *((f"figure: best trade-offs at {tier}", pareto(rows, tier), ["throughput_mbps", "row_id"]) for tier in tiers),
    ]
    return [(title, part.orderBy(*order)) for title, part, order in found]
