import os

import pytest

import __spark_entry__ as entry
from cachelens.llm.queries import QUERIES, SQL

from ..oracle import differences

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), SQL[name], FOLDER) == ""


def test_registered():
    assert {f"op{n}" for n in range(1, 11)} == {n.split("_")[0] for n in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_pipeline(spark):
    import corpus_pipeline

    folder, docs = "/root/testdata/sf0.001", spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert 0 < docs.select("doc_id").distinct().count() <= left
        left = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert out.count() == left and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
