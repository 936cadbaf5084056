"""The registered queries against their SQL, and the pipeline's stages against each other."""

import pytest
from compare_sql import compare, connect

import corpus_pipeline
from duelframe.llm import exact_dedup, near_dedup, packing, target_rules
from duelframe.llm.base import written
from duelframe.llm.queries import CHECKS, QUERIES, trusted_ids


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, sf_dir, name):
    text, ok = compare(spark, connect(sf_dir), name, QUERIES[name], CHECKS[name], sf_dir)
    assert ok, text


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_query_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), "test")
        kept[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    before, after = kept["quality rules"]
    verdict = {r.doc_id for r in target_rules.judge(before, trusted_ids(spark, sf_dir)).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == verdict
    before, after = kept["exact dedup"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in exact_dedup.duplicate_groups(before).where("kept").collect()}
    before, after = kept["near dedup"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in near_dedup.components(before).where("kept").collect()}
    before, after = kept["mixing"]
    assert after.subtract(before).count() == 0
    before, after = kept["packing"]
    assert after.agg({"length": "sum"}).first()[0] == packing.tokenise(before).agg({"n": "sum"}).first()[0]
