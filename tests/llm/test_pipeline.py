"""The stages on odd texts, and the pipeline against its parts."""

import brute
import pytest
from against_duckdb import compare, connect

import corpus_pipeline
from harrow.llm import queries


def test_stages_keep_columns(spark, sf_dir, docs, none):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for d in (docs, none):
            out = stage(spark, d, sf_dir)
            assert out.dtypes == d.dtypes and out.count() <= d.count()
    assert corpus_pipeline.STAGES[-1][1](spark, none, sf_dir).count() == 0


def test_pipeline(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, at, sf_dir).cache()
        was, now = {r.doc_id: r.text for r in at.collect()}, {r.doc_id: r.text for r in new.collect()}
        assert set(now) <= set(was)
        if name == "near dedup":
            groups = brute.near_groups(list(was.items()), 5, 80)
            assert set(now) == {i for i, (_, c) in groups.items() if i == c}
        if name == "decontamination":
            assert set(now) == {i for i, t in was.items() if not brute.matches(t, items)[1]}
        at = new
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in at.collect()}
    total = packed.agg(F.sum("length")).first()[0]
    assert total == sum(len(brute.token_ids(r.text)) for r in at.collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    assert compare(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL[name]) > 0


def test_quality_keeps_good_documents(spark, sf_dir):
    """Documents that are labelled good and pass the base rules are kept; junk goes."""
    d = queries.QUERIES["op8_quality_cascade"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    assert all(r.kept for r in d if r.quality == 1 and not r.base_failed)
    assert not [r for r in d if r.quality == 0 and r.kept]
