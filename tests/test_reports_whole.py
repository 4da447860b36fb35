"""Intervals of reports rest on all replicates, in the queries and in their statements."""

import re
from types import SimpleNamespace

import pytest

from strataflow.operators import bootstrap as B
from strataflow.operators import reporting as R
from strataflow.plans import all_oracles, reports

COMPARED = ["rpt_ci_comparison", "rpt_significance"]
BY_VARIANT = ["rpt_ci_group", "rpt_lambda_sweep", "rpt_results_table"]


def replicates(monkeypatch, make, v):
    """How many replicates stand behind every interval."""
    monkeypatch.setattr(R, "collect_ci", lambda rows, keys, *a: rows.groupBy(*keys).agg({B.BOOT: "count"}))
    return [r[-1] for r in make(v).collect()]


def statement_replicates(names):
    return {int(n) - 1 for name in names for n in re.findall(r"unnest\(range\(1, (\d+)\)\)", all_oracles()[name])}


def predictions(spark, k):
    rows = [(p, 1, i, i % 2, (i * k % 7) / 7) for p in ("val", "test") for i in range(9)]
    return spark.createDataFrame(rows, "phase string, iter int, ids long, labels int, pred_probs double")


def test_compared_models(spark, monkeypatch):
    v = SimpleNamespace(predictions=lambda k=3: predictions(spark, k % 7))
    assert replicates(monkeypatch, reports.compare_ci, v) == [1000] * 6
    assert statement_replicates(COMPARED) == {1000}


@pytest.mark.parametrize("make", ["variant_ci", "variant_comparison"])
def test_variants(spark, monkeypatch, make):
    rows = [(m, x, 0, g, i, i % 2, (i * k % 7) / 7) for m, x, k in (("erm", -1.0, 1), ("irm", 0.1, 3)) for g in (0, 1) for i in range(9)]
    fields = "train_method string, lambda double, n_ood int, `group` int, ids long, labels int, pred_probs double"
    v = SimpleNamespace(variants=spark.createDataFrame(rows, fields))
    groups = 4 if make == "variant_ci" else 2
    assert replicates(monkeypatch, getattr(reports, make), v) == [1000] * 2 * groups
    assert statement_replicates(BY_VARIANT) == {1000}
