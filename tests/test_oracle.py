"""Every core query with a SQL twin gives DuckDB's rows and types."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corpuskiln.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def rows(names, found):
    at = sorted(range(len(names)), key=lambda k: names[k])
    shown = [tuple(round(r[k], 6) if isinstance(r[k], float) else r[k] for k in at) for r in found]
    return sorted(shown, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    expected = duck.sql(catalogue.oracle_sql()[name])
    assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(expected.columns, map(str, expected.types)))
    assert rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_other_query_runs(spark, sf, name):
    df = catalogue.queries()[name](spark, sf)
    found = df.collect()
    assert found and df.columns
    if "round_trip_verified" in df.columns:
        assert all(r["round_trip_verified"] for r in found)


def _matches_sql(spark, folder, name, texts, ids=None):
    """A query against its SQL on documents with these texts, ids from 0 if none are given."""
    table = pa.table({"doc_id": pa.array(ids or range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    pq.write_table(table, f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    df = catalogue.queries()[name](spark, str(folder))
    expected = con.sql(catalogue.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())


def test_documents_without_safe_cuts_are_counted(spark, tmp_path):
    marked = "Of%%% the&&& anerha$$$ thea*** ha%%% anonre,%%% thor,### "
    texts = [None, "", " ", "a word", marked * 1300, marked * 4000, "plain words " * 9000, "plain words " * 60 + marked * 1400]
    texts += ["no-one's,'re'll" * 7000, "é中\u0301" * 15_000, "x" * 90_000, " " * 90_000, "'" * 70_000 + "s b", "7" * 66_560 + "a1" * 9000]
    _matches_sql(spark, tmp_path, "bpe_split_invariance", texts)


def test_sizes_are_rounded_like_the_sql(spark, tmp_path):
    lengths = [None, 0, 1, 51, 52, 256, 768, 1023, 1024, 1280, 1792, 2304, 3328, 5376, 104_858, 262_144, 262_400]
    cases = [(k, n) for n in lengths for k in (*range(20), *range(-20, 0), None)]
    _matches_sql(spark, tmp_path, "human_bytes", [n if n is None else "é" * (n // 2) + "x" * (n % 2) for _, n in cases], [k for k, _ in cases])


def test_entry_imports_without_the_training_operators():
    import __spark_entry__

    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
