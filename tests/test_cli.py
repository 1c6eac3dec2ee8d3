from pyspark.sql import functions as F

from corpuskiln import cli
from corpuskiln.functions import scalars
from corpuskiln.operators import tokenizers
from corpuskiln.sources import results


def test_selftest_plan_and_resources(spark, capsys):
    assert cli.main(["selftest"]) == 0
    assert cli.main(["plan"]) == 0 and cli.main(["resources"]) == 0
    said = capsys.readouterr().out
    assert "ratio_grid | 51" in said and "raw bytes leave no room" in said and "parallelism" in said


def test_archives_from_the_command_line(spark, sf, tmp_path, capsys):
    out = str(tmp_path / "archives")
    assert cli.main(["compress", f"{sf}/documents.parquet", out, "--shards", "3"]) == 0
    assert cli.main(["verify", out]) == 0
    assert capsys.readouterr().out.count("True | True | True | True") == 3


def test_sweep_resumes_and_reports(spark, sf, tmp_path, capsys):
    log = str(tmp_path / "log")
    run = ["sweep", f"{sf}/documents.parquet", log, "--tier", "64KB"]
    assert cli.main([*run, "--smoke"]) == 0
    smoke = results.read_log(spark, log).count()
    assert cli.main(run) == 0
    once = results.read_log(spark, log)
    assert once.count() == smoke + 20 and once.where("not round_trip_verified").count() == 0
    assert cli.main(run) == 0 and results.read_log(spark, log).count() == smoke + 20
    cell = once.where("cell_kind = 'ratio_grid'").first()["row_id"]
    assert cli.main([*run, "--row-id", cell]) == 0 and results.read_log(spark, log).count() == smoke + 21
    assert cli.main(["analyze", log]) == 0 and "### best ratios" in capsys.readouterr().out


def test_signed_and_vocabulary(spark):
    df = spark.createDataFrame([(0.1234, 5.55), (-1.0, None)], "a double, b double")
    shown = [r[0] for r in df.select(scalars.signed(F.col("a"), F.col("b"))).collect()]
    assert shown[0].startswith("+0.1234 (+5.") and shown[1] == "-"
    assert tokenizers.vocabulary_gap("r50k_base") == -1


def test_programme_report_and_axes(spark, sf, tmp_path, capsys):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    plan = ["programme", f"{sf}/documents.parquet", log, out, "--tiers", "64KB,256KB,1MB"]
    assert cli.main([*plan, "--plan"]) == 0
    shown = [line[3:] for line in capsys.readouterr().out.splitlines() if line.startswith("## ")]
    assert shown == ["64KB: grid", "64KB: one axis at a time", "256KB: grid", "1MB: grid", "report", "256KB: threads", "report", "1MB: threads", "report", "256KB: one axis at a time", "report"]
    sweep = ["sweep", f"{sf}/documents.parquet", log, "--tier", "64KB"]
    assert cli.main([*sweep, "--ofat", "--axes", "threads"]) == 0 and cli.main(sweep) == 0
    kinds = {r["cell_kind"]: r["n"] for r in results.read_log(spark, log).groupBy("cell_kind").agg(F.count("*").alias("n")).collect()}
    assert set(kinds) == {"ratio_grid", "ofat_threads"} and kinds["ratio_grid"] == 20
    assert cli.main(["analyze", log, "--out", out]) == 0
    report = (tmp_path / "out" / "report.md").read_text()
    assert all(f"### {t}\n" in report for t in ("threads", "layouts", "rows not verified", "figure: best trade-offs at 64KB"))
    assert spark.read.option("header", True).csv(f"{out}/rows").count() == sum(kinds.values())


def test_corpus_is_built_and_verified(spark, sf, tmp_path, capsys):
    out = str(tmp_path / "corpus")
    assert cli.main(["build", f"{sf}/documents.parquet", out, "--tiers", "64KB,100KB,64GB"]) == 0
    assert cli.main(["verify-tiers", out]) == 0
    assert "64GB" not in capsys.readouterr().out
    meta = {r["corpus_tier"]: r for r in spark.read.json(f"{out}/meta").collect()}
    small, large = (spark.read.parquet(f"{out}/records").where(F.col("corpus_tier") == t).orderBy("ord").collect() for t in ("64KB", "100KB"))
    assert [r["record"] for r in large[: len(small)]] == [r["record"] for r in small] and len(small) == meta["64KB"]["documents"]
    assert sum(len(r["record"].encode()) for r in small) == meta["64KB"]["bytes"] >= 65536
    changed = spark.read.parquet(f"{out}/records").withColumn("record", F.when(F.col("ord") == 1, "x\n\n").otherwise(F.col("record")))
    changed.write.partitionBy("corpus_tier").parquet(f"{out}2/records")
    spark.read.json(f"{out}/meta").write.json(f"{out}2/meta")
    assert cli.main(["verify-tiers", f"{out}2"]) == 1
