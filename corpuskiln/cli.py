"""Command line: ``python -m corpuskiln.cli <command>``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.functions import scalars
from corpuskiln.operators import archive
from corpuskiln.operators.packing import leb128_bytes, leb128_ids, u16_bytes, u16_ids
from corpuskiln.plans import dims, matrix, programme, reports, sweep, verify
from corpuskiln.session import session
from corpuskiln.sources import corpus, files, resources, results


AXES = ("threads", "layout", "transport", "chunk_size", "batch_chunks")


def selftest() -> bool:
    """Packing at its edges."""
    ids = [0, 1, 126, 127, 128, 129, 255, 256, 16382, 16383, 16384, 16385, 50256, 50280, 65535]
    wide = [*ids, 100276, 200018, (1 << 21) - 2, (1 << 21) - 1]
    return leb128_ids(leb128_bytes(wide))[0].tolist() == wide and u16_ids(u16_bytes(ids))[0].tolist() == ids


def markdown(rows: DataFrame) -> str:
    """A small relation as a markdown table."""
    found = rows.collect()
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join("-" if v is None else str(v) for v in r) + " |" for r in found)])


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="corpuskiln")
    commands = parser.add_subparsers(dest="command", required=True)
    one = lambda name, help_: commands.add_parser(name, help=help_)
    p = one("compress", "pack a documents table into verified shard archives")
    p.add_argument("documents")
    p.add_argument("out")
    p.add_argument("--tokenizer", default="r50k_base", choices=dims.TOKENIZERS)
    p.add_argument("--packing", default="fixed_u16", choices=dims.PACKINGS)
    p.add_argument("--backend", default="zstd_12", choices=list(dims.BACKENDS))
    p.add_argument("--shards", type=int, default=8)
    p = one("verify", "read archives back and show their checks")
    p.add_argument("archives")
    p = one("tiers", "show the size tiers of a documents table")
    p.add_argument("documents")
    p = one("plan", "show cells and drops of the matrix")
    p.add_argument("--profile", default="full", choices=["fast", "full"])
    p = one("sweep", "run the remaining runnable cells over a tier and append to a log")
    p.add_argument("documents")
    p.add_argument("log")
    p.add_argument("--tier", default="256KB", choices=list(dims.SMALL_TIERS))
    p.add_argument("--profile", default="fast", choices=["fast", "full"])
    p.add_argument("--transport", default="in_process_binding", choices=dims.TRANSPORTS)
    p.add_argument("--layout", default="library_batch", choices=dims.LAYOUTS)
    p.add_argument("--threads", type=int, default=1)
    p.add_argument("--chunk-size", type=int, default=dims.BASE_CHUNK)
    p.add_argument("--batch-chunks", type=int, default=dims.BASE_BATCH)
    p.add_argument("--timeout", type=float, default=sweep.TIMEOUT, help="seconds for each cell")
    p.add_argument("--ofat", action="store_true", help="run the cells that change one axis at a time, by their own settings")
    p.add_argument("--axes", help="only these axes, by commas: " + ", ".join(AXES))
    p.add_argument("--no-resume", action="store_true")
    p.add_argument("--row-id", help="run this one cell again, whatever the log says")
    p.add_argument("--smoke", action="store_true", help="run one cell of each packing, logged as smoke rows")
    p = one("resources", "show what driver and cluster can do")
    p = one("analyze", "answer the report questions from a log")
    p.add_argument("log")
    p.add_argument("--out", help="a folder for report.md and all rows as CSV")
    p = one("prune", "rewrite a log without the rows of a backend family and transport; the former log is kept")
    p.add_argument("log")
    p.add_argument("--backend-prefix", default="lzma")
    p.add_argument("--transport", default="in_process_binding")
    p.add_argument("--dry-run", action="store_true")
    p = one("build", "write the records of every tier that a documents table reaches, with metadata")
    p.add_argument("documents")
    p.add_argument("out")
    p.add_argument("--tiers", default=",".join(dims.SMALL_TIERS), help="sizes by commas")
    p.add_argument("--seed", type=int, default=corpus.SEED)
    p = one("verify-tiers", "hold a built corpus against its metadata")
    p.add_argument("out")
    p = one("programme", "run all sweeps and reports, the most telling first")
    p.add_argument("documents")
    p.add_argument("log")
    p.add_argument("out")
    p.add_argument("--tiers", default="64KB,256KB,1MB", help="names by commas, the least first")
    p.add_argument("--plan", action="store_true", help="show the stages without running them")
    one("boundaries", "check that splitting never changes tokens")
    one("selftest", "check packing at its edges")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "selftest":
        good = selftest()
        print("PASS" if good else "FAIL")
        return 0 if good else 1
    spark = session(None, "corpuskiln")
    if args.command == "compress":
        docs = spark.read.parquet(args.documents)
        ordered = docs.join(corpus.running_totals(docs).select("doc_id", (F.col("ord") - 1).alias("ord")), "doc_id")
        archive.pack_shards(ordered, args.shards, args.tokenizer, args.packing, args.backend).write.parquet(args.out)
        print(markdown(spark.read.parquet(args.out).drop("archive").orderBy("shard")))
    elif args.command == "verify":
        found = archive.verify_shards(spark.read.parquet(args.archives)).orderBy("shard")
        print(markdown(found))
        return 0 if not found.where(~F.col("round_trip_verified")).head(1) else 1
    elif args.command == "tiers":
        print(markdown(corpus.tier_summary(spark.read.parquet(args.documents), dims.small_tiers(spark)).orderBy("tier_rank")))
    elif args.command == "plan":
        found = matrix.candidates(spark, args.profile)
        print(markdown(found.where("reason is null").groupBy("cell_kind").count().orderBy("cell_kind")))
        print(markdown(found.where("reason is not null").groupBy("reason").count().orderBy(F.desc("count"), "reason")))
    elif args.command == "sweep":
        if args.axes and not set(args.axes.split(",")) <= set(AXES):
            raise SystemExit(f"axes are {', '.join(AXES)}")
        cells = matrix.cells(spark, args.profile, axes=tuple(args.axes.split(",")) if args.axes else None).where(F.col("cell_kind").startswith("ofat") if args.ofat else F.col("cell_kind") == "ratio_grid")
        cells = cells.where(F.col("tokenizer").isin("none", "r50k_base", "p50k_base"))
        if not args.ofat:  # cells of one axis at a time keep their own settings
            cells = matrix.at(cells, backend_transport=args.transport, tokenization_layout=args.layout, threads=args.threads, chunk_size=args.chunk_size, batch_chunks=args.batch_chunks)
        cells = cells.withColumn("corpus_tier", F.lit(args.tier)).withColumn("row_id", F.substring(F.sha2(F.concat_ws("|", "corpus_tier", "row_id"), 256), 1, 12))
        try:
            log = results.read_log(spark, args.log)
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            log = None
        if args.row_id:
            cells = cells.where(F.col("row_id") == args.row_id)
        elif args.smoke:
            cells = cells.where("backend = 'zstd_12' and tokenizer in ('none', 'r50k_base')")
        elif log is not None and not args.no_resume:
            # A smoke row never stands in for its grid cell.
            cells = matrix.remaining(cells, log.where("cell_kind is distinct from 'smoke'"))
        docs = spark.read.parquet(args.documents)
        members = corpus.tier_members(docs, dims.small_tiers(spark)).where(F.col("corpus_tier") == args.tier)
        stream = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]), "")
        data = docs.join(members.select("doc_id", "ord"), "doc_id").select(F.struct("ord", corpus.record(F.col("text")).alias("r")).alias("x")).agg(F.encode(stream, "UTF-8").alias("data"))
        measured = sweep.run_cells(cells, data, args.timeout, ("cell_kind",)).withColumn("corpus_tier", F.lit(args.tier))
        results.append_log(measured.withColumn("cell_kind", F.lit("smoke")) if args.smoke else measured, args.log)
    elif args.command == "analyze":
        ranks = F.create_map(*[F.lit(x) for k, t in enumerate([*dims.SMALL_TIERS, *dims.TIERS]) for x in (t, k)])
        rows = results.latest(results.read_log(spark, args.log)).withColumn("tier_rank", ranks[F.col("corpus_tier")])
        tiers = [r[0] for r in rows.groupBy("corpus_tier").agg(F.min("tier_rank").alias("n")).orderBy("n").collect()]
        text = "\n".join(f"\n### {title}\n\n{markdown(found)}" for title, found in reports.sections(rows, tiers))
        print(text)
        if args.out:
            files.write_text(spark, f"{args.out}/report.md", f"# Report\n{text}\n")
            results.write_csv(rows.drop("tier_rank", "source_file", "line"), f"{args.out}/rows")
    elif args.command == "prune":
        gone = results.prune(spark, args.log, results.is_stale(args.backend_prefix, args.transport), args.dry_run)
        print(f"{gone.count()} rows {'would go' if args.dry_run else 'gone'}\n\n{markdown(gone)}")
    elif args.command == "build":
        sizes = spark.createDataFrame([(t,) for t in args.tiers.split(",")], "corpus_tier string").withColumn("target_bytes", scalars.parse_size(F.col("corpus_tier")))
        corpus.write_tiers(spark, spark.read.parquet(args.documents), sizes, args.out, args.seed)
        print(markdown(spark.read.json(f"{args.out}/meta").drop("doc_separator").orderBy("target_bytes")))
    elif args.command == "verify-tiers":
        found = corpus.verify_tiers(spark, args.out).orderBy("bytes")
        print(markdown(found))
        return 0 if not found.where(~F.col("ok")).head(1) else 1
    elif args.command == "programme":
        for title, arguments in programme.stages(args.documents, args.log, args.out, args.tiers.split(",")):
            print(f"\n## {title}\n\n    {' '.join(arguments)}")
            if not args.plan:
                main(arguments)
    elif args.command == "resources":
        print(json.dumps(resources.snapshot() | resources.cluster(spark), indent=1))
        print(markdown(resources.tools(spark)))
    elif args.command == "boundaries":
        cases = spark.createDataFrame(verify.adversarial_cases(), "case_name string, text string")
        found = verify.verdict(verify.split_invariance(cases, "r50k_base", 4096, 2048))
        print(markdown(found))
        return 0 if not found.where("outcome = 'failure'").head(1) else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
