"""Registered queries against their SQL on the smallest driver data; ``compare.py`` runs all of them."""

from pathlib import Path

import pytest
from compare import connect, difference

from __spark_entry__ import entry, oracle_sql, queries
from evalspark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver data is not here")
CHECKED = ["documents_profile", "table_row_units", "page_dedupe", "upsert", "program_values", "questions", "quality_gate",
           "split_leak", "tokens", "bm25_corpus", "ranking_full", "question_results", "breakdown", "bootstrap_weights",
           "compare_to_best", "conversation_metrics", "file_manifest", "json_lineage", "table_writes", "run_rows", "ranking_checks",
           "bm25_train_corpus", "program_overflow"]


def test_every_oracle_has_a_query():
    """Only queries of the training-data subpackage, where it is there, may lack SQL."""
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    assert difference(queries()[name](spark, SF), connect(SF), oracle_sql()[name]) is None


def test_random_ranking_is_bracketed(spark):
    """A random ranking does worse than BM25, and BM25 no better than a perfect one."""
    r = queries()["conversation_summary"](spark, SF).first()
    assert r["random_rr"] < r["rr"] <= 1
