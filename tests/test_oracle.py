"""Registered queries against the SQL engine; all of them with STRATAFLOW_ALL=1."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = os.environ.get("STRATAFLOW_SF", "/root/testdata/sf0.001")
FAST = [
    "coh_longlos",
    "coh_invasive_vent",
    "coh_sepsis",
    "coh_demographics",
    "fx_long_features",
    "fx_feature_table",
    "spl_stratified3",
    "spl_domain_gen",
    "smp_group_balanced",
    "pp_quantile_bin",
    "pp_all_steps",
    "ev_auc",
    "ev_auprc",
    "ev_stratified",
    "ev_ece_quantile",
    "ev_ace_logistic",
    "ev_ace_bin",
    "ev_rce",
    "fr_ova_frame",
    "agg_quantiles",
    "win_optimal_threshold",
    "bs_resample_counts",
    "bs_avg",
    "bs_compare_best",
    "bs_block_metrics",
    "bs_block_ci",
    "rpt_results_table",
    "rpt_lambda_from_name",
    "src_partition_prune",
    "dg_coral",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("STRATAFLOW_ALL") else FAST


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert set(FAST) <= set(oracles)
    assert len(queries) > 110


def test_statements_make_views(duck):
    """The checking engine may wrap a statement in a view."""
    for name, sql in entry.oracle_sql().items():
        duck.execute(f"CREATE OR REPLACE TEMP VIEW checked AS {sql}")


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert compare(name, got, want) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "label" in df.columns
