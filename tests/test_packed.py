"""Packed draws against the same draws as rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.operators import bootstrap as B
from strataflow.operators import packed as K
from strataflow.operators.metrics import ECE_METRICS, ensemble_predictions, evaluate

NAMES = ["auc", "auprc", "loss_bce", "brier", "mean_prediction"]


def frame(spark, n=400):
    """Scores with ties, none, and no numbers; rows without label or stratum; one-class and one-row strata."""
    rows = []
    for i in range(n):
        p = [None, float("nan"), 0.5, 0.0, 1.0][i % 5] if i % 17 == 0 else (i * 37 % 101) / 101
        y = None if i % 29 == 0 else int(i * 31 % 7 < 3)
        rows.append((None if i % 43 == 0 else "ab"[i % 2], 1 + i % 3, i // 3, i // 3, y, p))
    rows += [("one", 1, 1, 1, 1, 0.3), ("ones", 1, 1, 1, 1, 0.3), ("ones", 2, 1, 1, 1, 0.4), ("ones", 2, 2, 2, 1, 0.6)]
    return spark.createDataFrame(rows, "phase string, iter int, ids long, row_id long, labels int, pred_probs double")


def values(df):
    keys = [c for c in df.columns if c not in ("performance", "performance_base", "performance_test", "performance_diff", "mean", "std")]
    rest = [c for c in df.columns if c not in keys]
    got = {tuple(r[k] for k in sorted(keys)): [r[c] for c in rest] for r in df.collect()}
    return got


def same(a, b):
    a, b = values(a), values(b)
    assert a and a.keys() == b.keys()
    for k in a:
        assert [x if x is None else pytest.approx(x, abs=1e-9) for x in a[k]] == b[k], k


@pytest.mark.parametrize("cell,n_boot,first", [(K.CELL, 5, 1), (16, 70, 2**18 + 3)])
def test_metrics_of_packed_draws(spark, monkeypatch, cell, n_boot, first):
    monkeypatch.setattr(K, "CELL", cell)
    df, strata = frame(spark), ["phase", "iter"]
    drawn = B.resample_counts(df, strata, ["ids"], n_boot, first=first)
    got = B.bootstrap(df, n_boot, strata, metrics=NAMES, first=first)
    assert got.columns == ["metric", "boot_iter", *strata, "performance"]
    same(got, evaluate(drawn, NAMES, ["boot_iter", *strata], count="boot_weight"))
    # drawn within finer strata than are evaluated, and without any
    got = B.bootstrap(df, 3, ["phase"], ["iter"], metrics=NAMES)
    drawn = B.resample_counts(df, strata, ["ids"], 3)
    same(got, evaluate(drawn, NAMES, ["boot_iter", "phase"], count="boot_weight"))
    drawn = B.resample_counts(df, [], ["ids"], 3)
    same(B.bootstrap(df, 3, metrics=NAMES), evaluate(drawn, NAMES, ["boot_iter"], count="boot_weight"))


def test_ensemble_and_pairs_of_packed_draws(spark, monkeypatch):
    df = frame(spark).where("phase IN ('a', 'b')")
    other = df.withColumn("pred_probs", F.expr("1 - pred_probs * pred_probs"))
    got = {m: B.compare_models(df, other, m, n_boot=4, metrics=NAMES) for m in ("avg", "ensemble")}
    alone = B.evaluate_ensemble(df, 4, metrics=NAMES)
    monkeypatch.setattr(B, "supported", lambda metrics: False)
    for m in got:
        same(got[m], B.compare_models(df, other, m, n_boot=4, metrics=NAMES))
    drawn = B.resample_counts(df, ["phase", "iter"], ["row_id"], 4)
    mean = ensemble_predictions(drawn, ["boot_iter", "phase", "row_id"], ("pred_probs", "labels"), "boot_weight")
    same(alone, evaluate(mean.withColumn("labels", F.expr("CAST(round(labels) AS INT)")), NAMES, ["boot_iter", "phase"]))


@pytest.mark.parametrize("cell,n_boot,first", [(K.CELL, 5, 1), (16, 70, 2**18 + 3)])
def test_binned_calibration_of_packed_draws(spark, monkeypatch, cell, n_boot, first):
    """Edges follow the draws of a replicate, over several cells too; coinciding edges give NULL."""
    names, strata = ["auc", *ECE_METRICS], ["phase", "iter"]
    monkeypatch.setattr(K, "CELL", cell)
    monkeypatch.setattr(K, "_bits", lambda most, n_boot: 3)  # several score cells per stratum
    df = frame(spark)
    got = B.bootstrap(df, n_boot, strata, metrics=names, first=first)
    assert K.supported(names)
    drawn = B.resample_counts(df, strata, ["ids"], n_boot, first=first)
    same(got, evaluate(drawn, names, ["boot_iter", *strata], count="boot_weight"))
    found = {(r["metric"], r["performance"] is None) for r in got.where("metric LIKE 'ece_q%'").collect()}
    assert found == {(m, x) for m in ("ece_q_abs", "ece_q_rmse") for x in (True, False)}


def test_binned_calibration_of_pairs_and_ensembles(spark, monkeypatch):
    names = ["auc", "ece_abs", "ece_q_abs"]
    df = frame(spark).where("phase IN ('a', 'b')")
    other = df.withColumn("pred_probs", F.expr("1 - pred_probs * pred_probs"))
    got = {m: B.compare_models(df, other, m, n_boot=3, metrics=names) for m in ("avg", "ensemble")}
    monkeypatch.setattr(B, "supported", lambda metrics: False)
    for m in got:
        same(got[m], B.compare_models(df, other, m, n_boot=3, metrics=names))


def test_counts_beyond_a_byte_go_on():
    p, y = np.array([0.2, 0.2, 0.9]), np.array([True, True, False])
    made = list(K._points(p, y, np.array([[300, 1], [400, 0], [0, 255]]), 4))
    rec = np.concatenate([np.frombuffer(b"".join(points.to_pylist()), K._record(2)) for _, points in made])
    assert rec["w"][rec["y"] == 1].astype(int).sum(0).tolist() == [700, 1]
    assert rec["w"][rec["y"] == 0].astype(int).sum(0).tolist() == [0, 255]


def test_score_cells_follow_the_scores():
    p = np.sort(np.concatenate([[-3.0, -1e-9, 0.0, 5e-324, 1.0, 1.5, 1e300], np.random.default_rng(1).random(1000), 1 - 2.0 ** -np.arange(1, 60)]))
    for bits in (-11, 0, 7, 14):
        assert (np.diff(K.score_cells(p, bits)) >= 0).all()


@pytest.mark.parametrize("block,n_boot,first", [(K.BLOCK, 5, 1), (3, 7, 2**18 + 3)])
def test_whole_strata_and_cells_agree(spark, monkeypatch, block, n_boot, first):
    """Strata held by one task and strata in cells give the metrics of the same draws."""
    monkeypatch.setattr(K, "BLOCK", block)
    df, strata = frame(spark).withColumn("lambda", F.expr("iter / 10D")), ["phase", "lambda"]
    drawn = B.resample_counts(df, strata, ["ids"], n_boot, first=first)
    want = evaluate(drawn, NAMES, ["boot_iter", *strata], count="boot_weight")
    other = df.withColumn("pred_probs", F.expr("1 - pred_probs * pred_probs")).withColumnRenamed("pred_probs", "pred_test")
    pairs = df.withColumnRenamed("pred_probs", "pred_base").join(
        other.select("phase", "iter", "ids", "pred_test", F.expr("1 - labels AS labels_test")), ["phase", "iter", "ids"]
    )
    found = []
    for whole in (K.WHOLE, 0):
        monkeypatch.setattr(K, "WHOLE", whole)
        same(B.bootstrap(df, n_boot, strata, metrics=NAMES, first=first), want)
        found.append(B.compare_pairs(pairs, strata, n_boot, NAMES, first=first))
    same(*found)


def test_draws_of_whole_strata_do_not_travel(spark, monkeypatch):
    """A thousand replicates send a row once per block, not a number per draw."""
    monkeypatch.setattr(K, "CELL", 64)
    sent = spark.sparkContext.accumulator(0)
    made = K.Cells.draws
    monkeypatch.setattr(K.Cells, "draws", lambda *a: sent.add(1) or made(*a))
    got = B.bootstrap(frame(spark), 1000, ["phase", "iter"], metrics=["auc"])
    assert got.count() == 1000 * 9 and sent.value == 0


def test_pairs_by_attribute_are_stacked_after_pairing(spark):
    """The pairs of stacked frames, repeated and missing keys included, from one join of the frames as they are."""
    attributes = {"sex": "sex", "age": B.age_band("age")}
    rows = [("a", 1, None if i == 3 else i // 2, i % 2, i / 40, [None, "F", "M"][i % 3], 30 + i) for i in range(40)]
    base = spark.createDataFrame(rows, "phase string, iter int, ids long, labels int, pred_probs double, sex string, age int")
    test = base.withColumn("pred_probs", F.expr("1 - pred_probs")).withColumn("age", F.expr("IF(ids = 7, 90, age)"))
    columns = ["phase", "iter", "ids", "labels", "pred_probs"]
    keys = ["phase", "attribute", "value", "iter", "ids"]
    want = B.pair_predictions(*(B.stack_attributes(x, attributes, columns) for x in (base, test)), keys)
    got = B.pair_by_attributes(base, test, attributes)
    rows = lambda df: sorted(map(tuple, df.select(*keys, "labels", "labels_test", "pred_base", "pred_test").collect()))
    assert rows(got) == rows(want) and len(rows(got)) > 40
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(want).index("Join") < plan(want).index("Generate") and plan(got).index("Generate") < plan(got).index("Join")
