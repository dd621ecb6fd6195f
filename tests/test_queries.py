"""Registered queries against their SQL; ``ORACLE_ALL=1`` runs all of them."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import check, connect

SF = "/root/testdata/sf0.001"
SHORT = ["window_preference_pairs", "t1_segment_by_gap", "j2_attach_and_orient", "c6_one_per_cluster", "g6_equivalence_pairs", "a4_group_distribution", "l7_source_weights", "m3_average_precision", "m5_budget_metrics", "q3_stratified_sample", "i5_resolve_paths", "v5_assert_groups", "x1_fold_balanced"]
NAMES = sorted(entry.queries()) if os.environ.get("ORACLE_ALL") else SHORT


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    ok, message, _ = check(spark, connect(SF), name, SF, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, message


def test_every_sql_has_a_query_and_names_are_unique():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
