import corpus_pipeline
from corpuskiln.llm.shared import table


def test_stages_over_the_small_table(spark, sf):
    docs = table(spark, sf, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns and docs.count() > 0
        if name != "mixing":
            assert docs.count() <= before
            before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
    filled = {}
    for r in packed:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "jaccard", "mixing", "packing"]
