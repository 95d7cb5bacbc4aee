"""Queries of the subpackage with SQL give the rows that DuckDB gives; the others run."""

import pytest

from coterie.llm import abuse
from coterie.llm.queries import ORACLE, QUERIES
from tests.conftest import DATA
from tests.test_queries import _same


@pytest.mark.parametrize("name", list(ORACLE))
def test_matches_sql(spark, duck, name):
    _same(spark, duck, QUERIES, ORACLE, name)


def test_ids_have_a_row_per_document(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    out = QUERIES["p8_ids"](spark, DATA)
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")] and out.count() == docs


@pytest.mark.parametrize("name", ["p9_found", "p9_overlaps", "p10_found", "p10_scores", "p10_source_rates", "p3_runs"])
def test_runs(spark, name):
    QUERIES[name](spark, DATA).collect()


def test_few_labels_accuse_somebody_and_the_queries_agree(spark):
    folder = "/root/testdata/sf0.01"
    found = {r.doc_id for r in QUERIES["p10_found"](spark, folder).collect()}
    scores = {r.doc_id: r.score for r in QUERIES["p10_scores"](spark, folder).collect()}
    assert found == {i for i, s in scores.items() if s >= abuse.CASE} and 0 < len(found) < len(scores) / 10
    rates = QUERIES["p10_source_rates"](spark, folder).collect()
    assert sum(r.found for r in rates) == len(found) and sum(r.documents for r in rates) == len(scores)
