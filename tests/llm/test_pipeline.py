"""The pipeline's stages against what each stage may do, and the registered queries."""

import check_queries
import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from survlake.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    state, _, _, _, note = check_queries.compare(spark, sf_dir, name, SQL)
    assert state == "ok", note


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, sf_dir)
        assert out.columns == docs.columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        assert out.count() <= seen.count()
        assert out.join(seen.select("doc_id"), "doc_id", "left_anti").count() == 0
        seen = out
    last = corpus_pipeline.STAGES[-1][1](spark, seen, sf_dir)
    assert last.count() == seen.count() and last.where(F.size("ids") != F.col("n_tokens")).count() == 0
