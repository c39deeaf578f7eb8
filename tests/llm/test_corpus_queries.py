"""The registered corpus queries and the pipeline over the test tables."""

import importlib.util
import os

import pytest

import corpus_pipeline
from quarrylens.llm import queries
from workload import compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")

NATIVE = ("op2_licenses", "op3_surrogates", "op10_decontaminate", "op11_shuffle")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    got = queries.QUERIES[name](spark, SF_DIR)
    assert compare.differences(got, compare.database(SF_DIR), queries.ORACLE_SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_rows(spark, name):
    got = queries.QUERIES[name](spark, SF_DIR)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in NATIVE:
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    table = "pages" if "main_text" in name else "documents"
    if name not in ("op2_licenses", "op10_decontaminate", "op13_repair"):
        assert got.count() == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = corpus_pipeline.run(spark, SF_DIR)
    ids = {r.doc_id for r in got.collect()}
    assert 0 < len(ids) <= docs.count()
    odd = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF_DIR).count() == 0


def test_no_swallowed_imports():
    assert importlib.util.find_spec("corpus_pipeline") and queries.QUERIES
