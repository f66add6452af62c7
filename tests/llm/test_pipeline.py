"""The queries and the pipeline on small tables."""

import hashlib

import duckdb
import pytest

import corpus_pipeline
from compare import connect, duck_rows, spark_rows
from twinsieve.llm import oracle, queries

SF = "/root/testdata/sf0.001"
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_equals_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == duck_rows(connect(SF), oracle.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.ORACLE)))
def test_query_has_a_row_per_row(spark, name):
    table = {"op1_warc": "pages", "op2_quotes": "conversations"}.get(name, "documents")
    want = duckdb.connect().execute(f"select count(*) from '{SF}/{table}.parquet'").fetchone()[0]
    assert queries.QUERIES[name](spark, SF).count() == want


def test_pipeline(spark, ws):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.toPandas().set_index("doc_id")
    for name, stage in corpus_pipeline.STAGES:
        docs = ws.save(stage(spark, docs, SF), name)
        if name != "encode":
            assert docs.columns == DOCUMENT and set(docs.toPandas().doc_id) <= set(before.index)
    final = docs.toPandas()
    assert 0 < len(final) < len(before) and (final.n_tokens * 4 == final.ids.map(len)).all()
    run = corpus_pipeline.run(spark, SF).toPandas()
    digest = lambda frame: sorted(hashlib.sha256(bytes(i)).hexdigest() for i in frame.ids)
    assert digest(run) == digest(final)


def test_pipeline_of_nothing_and_of_nulls(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for n, rows in enumerate(([], [(None, None, None, None, None), (1, None, "en", "s", 0), (1, "a b", None, "s", 3)])):
        sf = str(tmp_path / str(n))
        spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
        assert corpus_pipeline.run(spark, sf).count() == (0 if not rows else 2)
