"""The pipeline's stages on odd rows, and its registered queries against their SQL."""

import os

import pytest
from oracle_check import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_line_dedup", "op3_url_filter", "op4_exact_topk", "op5_source_mixing"])
def test_queries_equal_their_sql(spark, name):
    import __spark_entry__ as entry

    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    assert compare(entry.queries()[name](spark, SF_DIR), oracle_connection(SF_DIR), entry.oracle_sql()[name]) == ""


def test_stages_keep_columns_and_odd_rows(spark, tmp_path):
    import corpus_pipeline as pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, _kept string, _Score long"
    rows = [(1, None, "en", "a", 0, "k", 1), (2, "", "en", None, 0, "k", 1), (None, "some words without an id", "en", "a", 5, "k", 1)]
    rows += [(10 + i, f"text number {i} is unlike all others {i * 7} {i * 13}", "en", "b", 30, "k", 1) for i in range(30)]
    rows += [(100 + i, "the same words again and again in every copy of this text", "en", "b", 30, "k", 1) for i in range(9)]
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(10 + i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet")
    )
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = []
    for name, function in pipeline.STAGES:
        assert function(spark, docs.where("false"), str(tmp_path)).count() == 0
        out = function(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
    assert counts[:3] == [len(rows), len(rows), len(rows) - 8]
    assert counts[4] > 0
