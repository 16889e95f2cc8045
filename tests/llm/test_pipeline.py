"""The pipeline against a chain of brute-force stages, and the entry."""

import corpus_pipeline as cp

import __spark_entry__ as entry
from covary.llm.queries import ORACLE_SQL as QUERIES_SQL
from covary.llm.queries import QUERIES
from tests.conftest import SF001
from tests.llm.test_dedup import brute_groups, find_roots, slow_print
from tests.llm.test_filters import brute_hits


def test_stages_compose(spark, vocab):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    clean = cp.toxic(spark, docs, SF001)
    assert clean.columns == docs.columns
    rows = sorted((r.doc_id, r.text) for r in clean.collect())
    once = sorted({k for _, k, _, _ in brute_groups(rows)})
    text = dict(rows)
    got = cp.exact_copies(spark, clean, SF001)
    assert sorted(r.doc_id for r in got.collect()) == once
    roots = find_roots([slow_print(text[i]) for i in once])
    near = sorted({once[r] for r in roots})
    got = cp.near_copies(spark, got, SF001)
    assert sorted(r.doc_id for r in got.collect()) == near
    bench = [tuple(r) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").select("item_id", "text").collect()]
    pure = sorted(r[0] for r in brute_hits([(i, text[i]) for i in near], bench) if not r[5])
    whole = cp.run(spark, SF001)
    assert sorted(r.doc_id for r in whole.collect()) == pure


def test_stages_on_awkward_and_empty_tables(spark, awkward, empty):
    for docs in (awkward, empty):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, SF001)
            if name != cp.STAGES[-1][0]:
                assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert out.count() <= docs.count()


def test_sql_twins(spark):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    for name, sql in QUERIES_SQL.items():
        got, want = QUERIES[name](spark, SF001), con.sql(sql)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_all_are_registered():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
