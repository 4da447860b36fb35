"""Replicates in blocks: exact counts, their moments, and independence of how the work is cut."""

import math

import numpy as np
import pytest

from strataflow.operators import replicates as R
from strataflow.operators.metrics import evaluate


def predictions(spark, n, seed=1, ties=False):
    rng = np.random.default_rng(seed)
    p = rng.random(n)
    if ties:
        p = np.where(rng.random(n) < 0.4, 0.25, np.round(p, 2))
    y = (rng.random(n) < p).astype(int)
    return spark.createDataFrame([(int(i % 3 == 0), float(a), int(b)) for i, (a, b) in enumerate(zip(p, y))], "g int, pred_probs double, labels int")


def test_quantiles_are_binomial():
    u = (np.arange(4000) + 0.5) / 4000
    for n, p in ((1, 0.5), (7, 0.2), (400, 0.62), (90_000, 0.5)):
        got = R.binomial_quantiles(np.full(4000, n), p, u)
        assert abs(got.mean() - n * p) < 0.02 * math.sqrt(n * p * (1 - p)) + 1e-9
        assert abs(got.var() / (n * p * (1 - p)) - 1) < 0.03 and got.min() >= 0 and got.max() <= n
    low = R.binomial_quantiles(np.full(3, 3), 0.5, np.array([0.1, 0.125 + 1e-9, 0.9]))
    assert low.tolist() == [0, 1, 3]


def test_counts_are_multinomial():
    """Counts of points: sum, mean, variance and covariance over replicates."""
    b, n = np.arange(1, 4001), 40
    sizes = np.array([8, 0, 12, 20])
    draws = R._divided(44, "k", 1, 0, sizes, np.full(len(b), n), b, 2, 0)
    assert (draws.sum(0) == n).all() and (draws[1] == 0).all()
    counts = np.array([3, 5, 12])
    dealt = R._deal(44, "k", 1, 2, counts, np.full(len(b), 30), b)
    assert (dealt.sum(0) == 30).all()
    for got, share, m in ((draws[[0, 2, 3]], np.array([8, 12, 20]) / 40, n), (dealt, counts / 20, 30)):
        want = m * (np.diag(share) - np.outer(share, share))
        assert np.abs(got.mean(1) - m * share).max() < 0.15
        assert np.abs(np.cov(got) - want).max() < 0.6
    again = R._deal(44, "k", 1, 2, counts, np.full(10, 30), b[100:110])
    assert np.array_equal(again, dealt[:, 100:110])  # ranges of replicates join


@pytest.mark.parametrize("ties", [False, True])
def test_cuts_of_the_work_change_nothing_but_draws(spark, ties):
    """Each cut gives whole replicates; of the tree's width the result does not depend."""
    df = predictions(spark, 1500, ties=ties)
    made = {}
    for fan in (1, 3, 10):
        rows = R.replicate_metrics(df.repartition(5), 12, ["g"], leaf=64, fan=fan).collect()
        made[fan] = {(r["metric"], r["boot_iter"], r["g"]): r["performance"] for r in rows}
        assert len(made[fan]) == 12 * 2 * len(R.METRICS)
        assert all(v == {0: 1000, 1: 500}[k[2]] for k, v in made[fan].items() if k[0] == "n")
    for fan in (3, 10):
        assert all(abs(v - made[1][k]) < 1e-9 for k, v in made[fan].items())
    later = R.replicate_metrics(df, 4, ["g"], leaf=64, first=9).collect()
    assert all(abs(r["performance"] - made[10][r["metric"], r["boot_iter"], r["g"]]) < 1e-9 for r in later)
    # replicates lie about the value of the rows themselves
    for r in evaluate(df, ["auc", "auprc", "loss_bce", "brier"], ["g"]).collect():
        own = [v for (m, _, g), v in made[3].items() if m == r["metric"] and g == r["g"]]
        assert abs(np.mean(own) - r["performance"]) < 0.05


def test_one_label_nulls_and_nothing(spark):
    rows = [(1, 0.2, 1), (1, 0.9, 1), (1, None, 1), (2, 0.5, None), (None, 0.5, 0), (3, 0.1, 0)]
    df = spark.createDataFrame(rows, "g int, pred_probs double, labels int")
    got = {(r["metric"], r["g"]): r["performance"] for r in R.replicate_metrics(df, 1, ["g"]).collect()}
    assert {g for _, g in got} == {1, 3} and got["n", 1] == 2 and got["auc", 1] == -1 and got["auprc", 3] is None
    assert got["loss_bce", 3] == 1e18
    whole = R.replicate_metrics(df.where("g = 1"), 2).collect()
    assert len(whole) == 2 * len(R.METRICS)
    assert R.replicate_metrics(df.limit(0), 3, ["g"]).count() == 0
    with pytest.raises(ValueError):
        R.replicate_metrics(df, 2, ["g"], metrics=["ppv"])


def test_no_exchange_of_rows_times_replicates(spark):
    plan = R.replicate_metrics(predictions(spark, 50), 1000, ["g"])._jdf.queryExecution().toString()
    assert "Generate explode" not in plan


def test_neighbours_share_a_call(spark, monkeypatch):
    """Nodes and cells come in groups to a call, and points are made once; neither changes a result."""
    df = predictions(spark, 600)
    kw = dict(n_boot=6, strata=["g"], leaf=16, fan=2)

    def values(out):
        return {(r["metric"], r["boot_iter"], r["g"]): r["performance"] for r in out.collect()}

    many = R.replicate_metrics(df, **kw)
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "AS cells" in plan
    monkeypatch.setattr(R, "CHILDREN", 1)
    monkeypatch.setattr(R, "TOGETHER", 1)
    alone, many = values(R.replicate_metrics(df, **kw)), values(many)
    assert many.keys() == alone.keys() and len(many) == 6 * 6 * 2
    assert all(many[k] == pytest.approx(alone[k], abs=1e-12) for k in many)


def test_hashes_of_a_cell_are_those_of_its_draws():
    want = [R._two_hashes(44, "draw", "a|b", 1, 7, j) for j in range(120)]
    assert R._hash_pairs(120, 44, "draw", "a|b", 1, 7).tolist() == [list(w) for w in want]
    assert R._hash_pairs(0, 44).shape == (0, 2)
