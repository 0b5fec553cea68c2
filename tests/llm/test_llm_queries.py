"""Queries beside their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import pytest

import corpus_pipeline
from compare import compare
from polyloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, name, SF, queries.QUERIES[name], queries.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() >= 0


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got: dict = {}
    for r in pieces.collect():
        assert r["length"] & (r["length"] - 1) == 0
        got.setdefault(r["doc_id"], []).append((r["piece"], r["text"]))
    assert {k: "".join(t for _, t in sorted(v)) for k, v in got.items()} == {k: v for k, v in texts.items() if v}
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, pieces.collect()))


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
