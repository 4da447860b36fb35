"""Metrics against brute force and numpy."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataflow.operators import calibration as CAL
from strataflow.operators import fairness as FR
from strataflow.operators import metrics as M
from strataflow.operators.running import exact_quantiles, score_bucket


def frame(spark, y, p, w=None, g=None):
    n = len(y)
    pdf = pd.DataFrame({"labels": y, "pred_probs": p, "w": w if w is not None else np.ones(n), "group": g if g is not None else 0})
    return spark.createDataFrame(pdf)


def sample(seed=0, n=400, ties=False):
    rng = np.random.default_rng(seed)
    p = rng.uniform(0.02, 0.98, n)
    if ties:
        p = np.round(p, 1)
    y = (rng.uniform(size=n) < p).astype(int)
    return y, p, rng.integers(1, 5, n).astype(float), rng.integers(0, 3, n)


def brute_auc(y, p, w):
    pos, neg = y == 1, y == 0
    d = p[pos][:, None] - p[neg][None, :]
    ww = w[pos][:, None] * w[neg][None, :]
    return (ww * ((d > 0) + 0.5 * (d == 0))).sum() / ww.sum()


def brute_ap(y, p, w):
    out, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        on = p >= t
        tp = (w * y)[on].sum()
        recall, precision = tp / (w * y).sum(), tp / w[on].sum()
        out += (recall - last) * precision
        last = recall
    return out


def values(df, *keys):
    return {tuple(r[k] for k in ("metric", *keys)): r["performance"] for r in df.collect()}


def test_auc_and_ap_with_ties_and_weights(spark):
    for ties in (False, True):
        y, p, w, g = sample(1, ties=ties)
        got = values(M.evaluate(frame(spark, y, p, w, g), ["auc", "auprc"], ["group"], weight="w"), "group")
        for k in range(3):
            m = g == k
            assert got[("auc", k)] == pytest.approx(brute_auc(y[m], p[m], w[m]))
            assert got[("auprc", k)] == pytest.approx(brute_ap(y[m], p[m], w[m]))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.0, 1e-12, 0.1, 0.5, 0.999999, 1.0])), min_size=2, max_size=30))
def test_auc_property(spark, rows):
    y, p = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    got = M.evaluate(frame(spark, y, p), ["auc"]).first()["performance"]
    want = -1.0 if len(set(y)) == 1 else brute_auc(y, p, np.ones(len(y)))
    assert got == pytest.approx(want)


def test_bucket_never_decreases(spark):
    xs = np.concatenate([np.linspace(-5, 5, 2001), 10.0 ** np.arange(-18, 18), 1 - 10.0 ** -np.arange(1, 17)])
    df = spark.createDataFrame(pd.DataFrame({"x": np.sort(xs)}))
    got = [r[0] for r in df.selectExpr("x", f"{score_bucket('x')} AS b").orderBy("x").select("b").collect()]
    assert got == sorted(got)


def test_one_class_marks_and_cleaning(spark):
    df = frame(spark, [0, 0], [0.2, 0.4])
    got = values(M.evaluate(df, ["auc", "loss_bce", "brier"]))
    assert got[("auc",)] == -1 and got[("loss_bce",)] == 1e18
    assert [r.metric for r in M.clean_results(M.evaluate(df, ["auc", "loss_bce", "brier"])).collect()] == ["brier"]


def test_threshold_strictness_and_empty_denominators(spark):
    df = frame(spark, [1, 0, 0], [0.5, 0.5, 0.2]).withColumn("t", F.lit(0.5))
    got = values(M.evaluate(df, ["ppv", "specificity", "recall_0.5", "precision_0.9"], threshold="t"))
    assert got[("ppv",)] is None  # nothing is strictly above
    assert got[("specificity",)] == 1.0
    assert got[("recall_0.5",)] == 1.0 and got[("precision_0.9",)] == 0.0


def test_unit_weights_change_nothing(spark):
    y, p, _, g = sample(2)
    df = frame(spark, y, p, None, g)
    names = ["auc", "auprc", "brier", "loss_bce", "ece_abs", "ece_q_rmse", "spiegelhalter_z"]
    a, b = values(M.evaluate(df, names)), values(M.evaluate(df, names, weight="w"))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_rows_without_stratum_are_left_out(spark):
    df = spark.createDataFrame([(1, 0.5, "a"), (0, 0.5, None)], "labels int, pred_probs double, s string")
    assert [r.s for r in M.evaluate(df, ["brier"], ["s"]).collect()] == ["a"]


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.lognormal(size=501), 2)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(501) % 2, "x": x}))
    probs = [0.0, 0.025, 0.2, 0.5, 0.8, 1.0]
    for r in exact_quantiles(df, ["k"], "x", probs).collect():
        assert r.q == pytest.approx(np.percentile(x[np.arange(501) % 2 == r.k], [100 * p for p in probs]))


def test_ece_quantile_with_coinciding_edges_is_null(spark):
    df = frame(spark, [0, 1] * 10, [0.5] * 20)
    got = values(M.evaluate(df, ["ece_q_abs", "ece_abs"]))
    assert got[("ece_q_abs",)] is None and got[("ece_abs",)] == pytest.approx(0.0)


def irls(x, y, w, steps=50):
    b = np.zeros(2)
    a = np.column_stack([np.ones_like(x), x])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-a @ b))
        h = (a * (w * p * (1 - p))[:, None]).T @ a
        b = b + np.linalg.solve(h, a.T @ (w * (y - p)))
    return b


def test_logistic_calibration_matches_irls(spark):
    y, p, w, g = sample(4)
    df = frame(spark, y, p, w, g)
    got = values(M.evaluate(df, ["ace_abs_logistic_log", "ace_rmse_logistic_none"], ["group"], weight="w"), "group")
    for k in range(3):
        m = g == k
        for name, x in (("ace_abs_logistic_log", np.log(p[m])), ("ace_rmse_logistic_none", p[m])):
            b = irls(x, y[m], w[m])
            d = 1 / (1 + np.exp(-(b[0] + b[1] * x))) - p[m]
            want = np.average(abs(d), weights=w[m]) if "abs" in name else np.sqrt(np.average(d**2, weights=w[m]))
            assert got[(name, k)] == pytest.approx(want, abs=1e-8)


def test_degenerate_fits(spark):
    one_class = CAL.cox_calibration(frame(spark, [1, 1, 1], [0.2, 0.4, 0.6])).first()
    assert one_class.cox_slope is None
    flat = CAL.cox_calibration(frame(spark, [1, 0, 1], [0.5, 0.5, 0.5])).first()
    assert flat.cox_slope is None
    split = CAL.cox_calibration(frame(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])).first()
    assert not split.converged


def test_forest_error_is_stable_and_in_range(spark):
    y, p, _, _ = sample(5)
    df = frame(spark, y, p)
    a = CAL.forest_calibration_error(df, num_trees=5).first()["performance"]
    assert 0 <= a <= 1 and a == CAL.forest_calibration_error(df, num_trees=5).first()["performance"]


def brute_emd(u, v):
    xs = np.sort(np.concatenate([u, v]))
    cu = np.searchsorted(np.sort(u), xs[:-1], side="right") / len(u)
    cv = np.searchsorted(np.sort(v), xs[:-1], side="right") / len(v)
    return (abs(cu - cv) * np.diff(xs)).sum()


def test_emd_and_xauc(spark):
    y, p, _, g = sample(6, ties=True)
    df = frame(spark, y, p, None, g)
    emd = values(FR.emd_ova(df, "group"), "group")
    for k in range(3):
        assert emd[("emd_ova", k)] == pytest.approx(brute_emd(p[g == k], p))
    same = FR.emd_ova(frame(spark, y, p), "group").first()["performance"]
    assert same == pytest.approx(0.0)
    for name, (lab, exclude) in FR.XAUC_VARIANTS.items():
        got = values(FR.xauc(df, "group", name), "group")
        for k in range(3):
            mine = (g == k) & (y == lab)
            rest = (y == 1 - lab) & ((g != k) | (not exclude))
            yy, pp = np.concatenate([y[mine], y[rest]]), np.concatenate([p[mine], p[rest]])
            assert got[(name, k)] == pytest.approx(brute_auc(yy, pp, np.ones(len(yy))))


def test_emd_without_rows_of_the_label_is_marked(spark):
    df = frame(spark, [0, 0, 1], [0.1, 0.2, 0.3], None, [0, 0, 1])
    got = values(FR.emd_ova(df, "group", "emd_1_ova"), "group")
    assert got[("emd_1_ova", 0)] == -1.0 and got[("emd_1_ova", 1)] == 0.0


def test_custom_metric_adds_up_its_parts(spark):
    y, p, _, g = sample(7)
    df = frame(spark, y, p, None, g).repartition(5)
    state = lambda labels, scores, w: [(labels * w).sum(), w.sum()]
    got = M.custom_metric(df, "rate", state, lambda s: s[0] / s[1]).first()
    assert got["performance"] == pytest.approx(y.mean())
    by = values(M.custom_metric(df, "rate", state, lambda s: s[0] / s[1], ["group"]), "group")
    assert all(by[("rate", k)] == pytest.approx(y[g == k].mean()) for k in range(3))


def test_metrics_do_not_depend_on_their_company(spark):
    y, p, _, _ = sample(8)
    df = frame(spark, y, p.round(1))
    names = ["ece_q_abs", "ece_abs", "ace_abs_bin_none", "ace_rmse_bin_log", "ace_abs_logistic_log", "brier"]
    alone = {n: M.evaluate(df, [n]).first()["performance"] for n in names}
    both = {r["metric"]: r["performance"] for r in M.evaluate(df, [*names, "auc", "auprc"]).collect()}
    for n in names:
        assert alone[n] == pytest.approx(both[n]), n
    with pytest.warns(UserWarning, match="auk"):
        assert M.evaluate(df, ["brier", "auk"]).count() == 1


def test_separable_strata_have_no_curve(spark):
    df = frame(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])
    assert M.evaluate(df, ["ace_abs_logistic_log"]).first()["performance"] is None


def test_register_row_metric(spark):
    M.register_row_metric("mean_label", "try_divide(sum(__w * __y), sum(__w))")
    try:
        assert M.evaluate(frame(spark, [1, 0], [0.5, 0.5]), ["mean_label"]).first()["performance"] == 0.5
    finally:
        del M.ROW_METRICS["mean_label"]
    with pytest.raises(ValueError):
        M.evaluate(frame(spark, [1, 0], [0.5, 0.5]), ["nothing_known"])


def test_batch_loss_and_min_max(spark):
    b = spark.createDataFrame([("a", 1.0, 10), ("a", 2.0, 30)], "k string, loss double, size int")
    assert M.batch_mean_loss(b, ["k"], "loss", "size").first()["loss"] == 1.75
    r = spark.createDataFrame([("auc", 0, 0.5), ("auc", 1, 0.7)], "metric string, g int, performance double")
    assert values(M.min_max_over(r)) == {("auc_min",): 0.5, ("auc_max",): 0.7}


def test_thresholds_don_t_gather_runs(spark):
    """The rows of a run stay where they are, also where Spark's size check would not broadcast."""
    df = spark.createDataFrame([("val", i % 3, i / 99) for i in range(99)], "phase string, iter int, pred_probs double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = M.risk_thresholds(df.repartition(4), 0.1)
        assert "BroadcastHashJoin" in "".join(out._jdf.queryExecution().sparkPlan().toString().split("\n")[:3])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len({r["threshold"] for r in out.collect()}) == 3
