"""The queries that SQL can express, and the pipeline."""

import pytest

import corpus_pipeline
from millrace.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query(name, spark, sf_dir, same):
    same(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name])


def test_pipeline_keeps_columns_and_packs_all(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= (docs.count() if name != "mixing" else 2 * docs.count())
        docs = out
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
