"""Every query runs on the small tables; the ones with a SQL twin name the same columns."""

import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
NAMES = sorted(entry.queries())
FEW = [n for n in NAMES if n in ("tokens_per_document", "roc_curve", "pair_jaccard", "rloo_advantage", "policy_loss", "conversation_filter_reasons", "lineitem_rollup", "boxed_answer_grading")]


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(NAMES)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", FEW)
def test_runs(spark, name):
    assert entry.queries()[name](spark, DIR).count() >= 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() == 1
