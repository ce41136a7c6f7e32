"""Registered queries and the pipeline over a small test table."""

import os

import pytest

import corpus_pipeline
from quarry.llm import queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_every_operator_has_a_query():
    assert [q.split("_")[0] for q in queries.queries()] == [f"op{n}" for n in range(1, 11)] + ["pipeline"]


@pytest.mark.parametrize("name", [q for q in queries.queries() if q not in ("op1_warc_salvage", "op6_bounded_packing", "pipeline")])
def test_one_row_for_each_document(spark, documents, name):
    got = queries.queries()[name](spark, SF)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(i for i, _ in documents)


def test_digests_agree_with_plain_python(spark, documents):
    q = queries.queries()
    got = {r[0]: r[1:] for r in q["op4_secret_links"](spark, SF).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()}
    assert got == {i: brute.secrets(t) for i, t in documents}
    got = {r[0]: r[1:] for r in q["op9_block_anchors"](spark, SF).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    assert got == brute.repeats(documents)
    got = {r[0]: r[1:] for r in q["op5_scaled_sketch"](spark, SF).select("doc_id", "n_chars", "edited_sha256").collect()}
    assert got == brute.edits(documents)


def test_op1_against_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = con.execute(queries.oracle_sql()["op1_warc_salvage"])
    columns = [c[0] for c in want.description]
    got = queries.queries()["op1_warc_salvage"](spark, SF).select(*columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_pipeline_stages(spark, documents, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, given = docs.columns, dict(documents)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k == 0:
            assert all(not brute.statistics(r.text)[-1] for r in docs.collect())
            kept = {r.doc_id for r in docs.collect()}
        if k == 1:
            rest = {r.doc_id for r in docs.collect()}
            assert rest <= kept and len({given[i] for i in kept}) >= len(rest)
        if k == 3:
            assert all(brute.secrets(r.text)[:3] == (0, 0, 0) for r in docs.collect())
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(docs.columns)
