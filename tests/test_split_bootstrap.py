"""Folds, samples, bootstrap, preprocessing and reporting rules."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataflow.operators import bootstrap as B
from strataflow.operators import diagnostics as D
from strataflow.operators import modeling as ML
from strataflow.operators import preprocess as PP
from strataflow.operators import reporting as R
from strataflow.operators import split as S
from strataflow.session import scratch_path
from strataflow.sources import tables as IO


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"subject_id": np.arange(1000), "label": (rng.uniform(size=1000) < 0.2).astype(int)})
    pdf["group_var"] = np.where(pdf.subject_id % 3 == 0, "b", "a")
    return spark.createDataFrame(pdf)


def test_stratified_split_sizes(people):
    out = S.stratified_split(people).toPandas()
    assert len(out) == 1000 and out.subject_id.is_unique
    for _, part in out.groupby("label"):
        share = part.fold_id.value_counts() / len(part)
        assert share["train"] == pytest.approx(0.7, abs=0.01) and share["val"] == pytest.approx(0.15, abs=0.01)
    again = S.stratified_split(people.repartition(9)).toPandas()
    assert out.sort_values("subject_id").fold_id.tolist() == again.sort_values("subject_id").fold_id.tolist()
    with pytest.raises(ValueError):
        S.stratified_split(people, {"train": 0.5})


def test_split_by_ids_is_strict(spark, people):
    folds = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test")], "subject_id long, fold_id string")
    assert S.split_by_ids(people, folds).count() == 3
    with pytest.raises(ValueError):
        S.split_by_ids(people, folds.where("fold_id <> 'val'"))
    twice = folds.union(spark.createDataFrame([(1, "val")], folds.schema))
    with pytest.raises(ValueError):
        S.split_by_ids(people, twice)


def test_group_balanced_sample(people):
    out = S.group_balanced_sample(people.select("subject_id", "group_var"), "group_var", "subject_id", 4000).toPandas()
    assert len(out) == 4000 and out.draw.is_unique
    assert (out.group_var == "b").mean() == pytest.approx(0.5, abs=0.1)


def test_sparse_roundtrip_and_refusal(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (2, 3.0, 0.0)], "id long, `a.x` double, b double")
    back = S.from_sparse(S.to_sparse(df, ["a.x", "b"]), ["a.x", "b"])
    assert sorted(map(tuple, back.collect())) == [(1, 0.0, 2.0), (2, 3.0, 0.0)]
    with pytest.raises(ValueError):
        S.to_sparse(df.withColumn("b", F.lit(None).cast("double")), ["a.x", "b"])


def test_resample_counts_add_up(spark):
    pdf = pd.DataFrame({"ids": np.arange(300), "phase": np.where(np.arange(300) < 200, "val", "test")})
    df = spark.createDataFrame(pdf)
    drawn = B.resample_counts(df, ["phase"], ["ids"], 50).toPandas()
    sums = drawn.groupby(["phase", "boot_iter"]).boot_weight.sum().unstack()
    assert (sums.loc["val"] == 200).all() and (sums.loc["test"] == 100).all()
    # distinct share of a bootstrap sample is about 1 - 1/e, weights have variance about 1
    share = drawn.groupby(["phase", "boot_iter"]).size().unstack().loc["val"] / 200
    assert share.mean() == pytest.approx(1 - np.exp(-1), abs=0.02)
    # replicates are unrelated to each other and ranges of replicates join
    wide = drawn[drawn.phase == "val"].pivot(index="ids", columns="boot_iter", values="boot_weight").fillna(0)
    corr = np.corrcoef(wide.to_numpy().T)[np.triu_indices(50, 1)]
    assert abs(corr.mean()) < 0.01 and corr.std() == pytest.approx(1 / np.sqrt(200), rel=0.2)
    later = B.resample_counts(df, ["phase"], ["ids"], 10, first=41).toPandas()
    cols = ["ids", "boot_iter", "boot_weight"]
    a = drawn[drawn.boot_iter > 40][cols].sort_values(cols).to_numpy()
    assert (a == later[cols].sort_values(cols).to_numpy()).all()


def test_same_model_has_no_difference(spark):
    pdf = pd.DataFrame({"ids": np.tile(np.arange(100), 2), "iter": np.repeat([1, 2], 100), "phase": "val"})
    pdf["labels"] = (pdf.ids % 3 == 0).astype(int)
    pdf["pred_probs"] = (pdf.ids * 37 % 101) / 101 * 0.9 + 0.05
    df = spark.createDataFrame(pdf)
    for method in ("avg", "ensemble", "best"):
        out = B.compare_models(df, df, method, n_boot=3, metrics=["auc", "brier"]).toPandas()
        assert len(out) == 6 and (out.performance_diff.abs() < 1e-12).all()
    with pytest.raises(ValueError):
        B.pair_predictions(df, df.where("ids > 5"), check=True)


def test_intervals_and_significance(spark):
    df = spark.createDataFrame([("m", float(i)) for i in range(101)], "metric string, performance double")
    ci = R.collect_ci(df, ["metric"], alpha=0.1)
    row = R.significance(ci).first()
    assert (row.ci_lower, row.ci_med, row.ci_upper, row.sig) == (5.0, 50.0, 95.0, "*")
    zero = R.significance(ci.withColumn("ci_lower", F.lit(-1.0))).first()
    assert zero.sig == ""


def wide(spark):
    n = 60
    pdf = pd.DataFrame(
        {
            "subject_id": np.arange(n),
            "label": np.arange(n) % 2,
            "x_lab_count_bin_0_0.167": np.where(np.arange(n) < 26, 1.0, 0.0),
            "y_lab_count_bin_0_0.167": np.where(np.arange(n) < 25, 1.0, 0.0),
            "z_labs_measurement_avg_bin_0_0.167": np.where(np.arange(n) < 50, np.arange(n, dtype=float), None),
            "gender": np.where(np.arange(n) % 2 == 0, "F", "M"),
        }
    )
    schema = "subject_id long, label long, `x_lab_count_bin_0_0.167` double, `y_lab_count_bin_0_0.167` double, `z_labs_measurement_avg_bin_0_0.167` double, gender string"
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), schema)


def test_prune_is_strict_and_repeatable(spark):
    df = wide(spark)
    step = PP.PruneFeatures(thresh=25, special_cols={"count": 0})
    kept = step.fit(df).get_params()["cols_to_keep"]
    assert "x_lab_count_bin_0_0.167" in kept and "y_lab_count_bin_0_0.167" not in kept
    assert step.fit(df).get_params()["cols_to_keep"] == kept


def test_quantile_bins(spark):
    df = wide(spark)
    name = "z_labs_measurement_avg_bin_0_0.167"
    model = PP.QuantileBins(n_bins=4, include=["measurement"]).fit(df)
    edges = model.get_params()["edges"][name]
    assert edges == pytest.approx(np.percentile(np.arange(50), [25, 50, 75]).round(4))
    got = {r[0]: r[1] for r in model.transform(df).select("subject_id", f"`{name}`").collect()}
    assert got[59] == 0 and got[0] == 1 and got[49] == 4
    assert got[25] == 1 + sum(e <= 25 for e in edges)


def test_one_hot_unknown(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "subject_id long, kind string")
    b = spark.createDataFrame([(3, "new"), (4, "x")], "subject_id long, kind string")
    model = PP.OneHotColumns(include=["kind"]).fit(a)
    assert model.output_columns() == ["kind_None", "kind_x"]
    assert sorted(map(tuple, model.transform(b).collect())) == [(3, 0, 0), (4, 0, 1)]
    fixed = PP.OneHotColumns(include=["kind"], categories={"kind": ["x", "new"]}, drop="first").fit(a)
    assert fixed.output_columns() == ["kind_new"]


def test_exclude_tags_exclude_all_of_them():
    assert PP.select_by_tags(["a_count", "b_meas", "c"], exclude=["count", "meas"]) == ["c"]
    assert PP.select_by_tags(["a_count", "b_meas", "c"], ["a", "b"], ["meas"]) == ["a_count"]


def test_steps_save_and_load(spark):
    from pyspark.ml import PipelineModel

    df = wide(spark).withColumns({"group_var": F.lit("g"), "fold_id": F.lit("train")})
    model = PP.standard_steps().fit(df)
    path = scratch_path(spark, "steps")
    model.save(path)
    again = PipelineModel.load(path)
    assert PP.fitted_params(again) == PP.fitted_params(model)
    assert again.transform(df).collect() == model.transform(df).collect()


def test_long_steps_match_wide(spark):
    df = wide(spark)
    name = "z_labs_measurement_avg_bin_0_0.167"
    long = PP.unpivot_features(df, [name])
    edges = PP.quantile_edges_long(long)
    wide_edges = PP.QuantileBins(include=["measurement"]).fit(df).get_params()["edges"][name]
    assert list(edges.first()["edges"]) == wide_edges
    bins = PP.bin_long(long, edges).groupBy("feature_val").count().collect()
    assert {r[0]: r[1] for r in bins} == {0.0: 10, 1.0: 10, 2.0: 10, 3.0: 10, 4.0: 10, 5.0: 10}
    assert PP.prune_long(long, 49).count() == 60 and PP.prune_long(long, 50).count() == 0


def test_sql_script_and_cache(spark, tmp_path):
    path = tmp_path / "script.sql"
    path.write_text("CREATE OR REPLACE TEMP VIEW v1 AS SELECT 1 AS a;\nSELECT a + 1 AS b FROM v1;\n")
    assert IO.run_sql_file(spark, str(path)).first()[0] == 2
    calls = []
    target = scratch_path(spark, "cached")
    for _ in range(2):
        IO.read_or_compute(spark, target, lambda: calls.append(1) or spark.range(3))
    assert len(calls) == 1


def test_coral_against_numpy(spark):
    rng = np.random.default_rng(2)
    x, g = rng.normal(size=(90, 4)), np.arange(90) % 3
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(g, x)], "g int, v array<double>")
    parts = [x[g == k] for k in range(3)]
    dist = lambda a, b: ((a.mean(0) - b.mean(0)) ** 2).mean() + ((np.cov(a.T) - np.cov(b.T)) ** 2).mean()
    pairs = np.mean([dist(parts[i], parts[j]) for i in range(3) for j in range(i)])
    rest = np.mean([dist(x[g == k], x[g != k]) for k in range(3)])
    assert D.coral_penalty(df, "g", "v").first()["penalty"] == pytest.approx(pairs)
    assert D.coral_penalty(df, "g", "v", "overall").first()["penalty"] == pytest.approx(rest)
    lone = df.union(spark.createDataFrame([(9, [0.0] * 4)], df.schema))
    got = D.coral_penalty(lone, "g", "v").first()
    assert got["n_groups"] == 4 and got["penalty"] == pytest.approx(pairs * 3 / 6)


def test_group_weights_scale_only_above_the_bound(spark):
    losses = spark.createDataFrame([(0, 0.5), (1, 1.0)], "g int, loss double")
    w = {r.g: r.weight for r in D.group_dro_step(losses, "g", eta=1.0, bound=1.0).collect()}
    assert sum(w.values()) == pytest.approx(1.0) and w[1] / w[0] == pytest.approx(np.exp(0.5))
    free = {r.g: r.weight for r in D.group_dro_step(losses, "g", eta=1.0, bound=100.0).collect()}
    assert free[0] == pytest.approx(np.exp(0.5))
    added = {r.g: r.weight for r in D.group_dro_step(losses, "g", eta=0.1, additive=True).collect()}
    assert added[1] == pytest.approx(0.1)


def test_param_grid():
    grid = ML.param_grid({"a": [1, 2], "b": [3, 4]})
    assert len(grid) == 4 and grid == ML.param_grid({"b": [3, 4], "a": [1, 2]})
    assert ML.param_grid({"a": [1, 2], "b": [3, 4]}, 2) == grid[:2]
    assert ML.hidden_layers(5, 2, 8) == [5, 8, 8, 2]


def test_default_metrics_of_a_replicate_equal_those_of_its_rows(spark):
    """Weights stand for repeated rows in every metric, fitted calibration too."""
    from strataflow.operators import metrics as M

    rng = np.random.default_rng(5)
    p = rng.uniform(0.05, 0.95, 200)
    pdf = pd.DataFrame({"ids": np.arange(200), "phase": "test", "pred_probs": p})
    pdf["labels"] = (rng.uniform(size=200) < p).astype(int)
    df = spark.createDataFrame(pdf)
    got = B.bootstrap(df, 2, ["phase"]).toPandas().set_index(["boot_iter", "metric"]).performance
    assert set(got.index.get_level_values(1)) == set(M.DEFAULT_METRICS)
    drawn = B.resample_counts(df, ["phase"], ["ids"], 2)
    repeated = drawn.selectExpr("boot_iter", "labels", "pred_probs", "explode(sequence(1, CAST(boot_weight AS INT)))")
    want = M.evaluate(repeated, M.DEFAULT_METRICS, ["boot_iter"]).toPandas().set_index(["boot_iter", "metric"]).performance
    for key, value in want.items():
        assert got[key] == pytest.approx(value, abs=1e-9)


def test_every_metric_of_a_replicate_equals_that_of_its_rows(spark):
    """With ties, fixed and quantile bins, fitted curves and a sample weight."""
    from strataflow.operators import metrics as M

    rng = np.random.default_rng(6)
    p = rng.uniform(0.03, 0.97, 240).round(2)
    pdf = pd.DataFrame({"ids": np.arange(240), "phase": "test", "pred_probs": p, "w": rng.uniform(0.5, 2, 240)})
    pdf["labels"] = (rng.uniform(size=240) < p).astype(int)
    df = spark.createDataFrame(pdf)
    names = [m for m in M.known_metrics() if m not in M.THRESHOLD_METRICS]
    got = B.bootstrap(df, 2, ["phase"], metrics=names, weight="w").toPandas().set_index(["boot_iter", "metric"]).performance
    drawn = B.resample_counts(df, ["phase"], ["ids"], 2)
    repeated = drawn.selectExpr("boot_iter", "labels", "pred_probs", "w", "explode(sequence(1, CAST(boot_weight AS INT)))")
    want = M.evaluate(repeated, names, ["boot_iter"], weight="w").toPandas().set_index(["boot_iter", "metric"]).performance
    assert set(got.index) == set(want.index) and len(want) == 2 * len(names)
    for key, value in want.items():
        assert (pd.isna(got[key]) and pd.isna(value)) or got[key] == pytest.approx(value, abs=1e-9), key


def test_replicates_of_any_number(spark):
    df = spark.range(50).selectExpr("id AS ids", "'a' AS phase")
    late = B.resample_counts(df, ["phase"], ["ids"], 2, first=2**20 + 5)
    assert {r["boot_iter"] for r in late.collect()} == {2**20 + 5, 2**20 + 6}
    assert late.groupBy("boot_iter").agg(F.sum("boot_weight").alias("n")).where("n <> 50").count() == 0


def test_folds_among_many_others(spark):
    names = [f"other{i}" for i in range(400)] + ["train", "val", "test"]
    folds = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "subject_id long, fold_id string")
    S.check_folds(folds, "subject_id", "fold_id")
    with pytest.raises(ValueError):
        S.check_folds(folds.where("fold_id <> 'val'"), "subject_id", "fold_id")


def test_categories_without_a_limit(spark):
    df = spark.range(3000).selectExpr("id AS subject_id", "CAST(id % 1500 AS STRING) AS kind", "IF(id = 7, NULL, 'x') AS other")
    model = PP.OneHotColumns(include=["kind"]).fit(df.limit(1500))
    assert len(model.output_columns()) == 1500
    words = PP.category_vocabulary(df, ["kind", "other"])
    assert words.count() == 1502 and words.agg(F.max("idx")).first()[0] == 1501
    ones = PP.one_hot_long(df, ["kind", "other"], words)
    assert ones.count() == 6000 and ones.groupBy("subject_id").count().where("count <> 2").count() == 0


def test_scripts_bundles_and_unfinished_results(spark, tmp_path):
    script = "SELECT 'a;b' AS x; -- no; end\n/* ; */ SELECT `x;` FROM (SELECT 2 AS `x;`)"
    assert IO.statements(script) == ["SELECT 'a;b' AS x", "SELECT `x;` FROM (SELECT 2 AS `x;`)"]
    folds = spark.createDataFrame([(1, "train"), (2, "val")], "id long, fold_id string")
    path = str(tmp_path / "bundle")
    for _ in range(2):
        IO.save_bundle(folds, path, "a", "d")
    assert IO.load_bundle(spark, path, "a", "d").count() == 2
    cache = str(tmp_path / "cache")
    spark.range(5).write.parquet(cache)
    (tmp_path / "cache" / "_SUCCESS").unlink()
    assert not IO.path_exists(spark, cache)
    assert IO.read_or_compute(spark, cache, lambda: spark.range(3)).count() == 3 and IO.path_exists(spark, cache)


def test_nobody_is_lost_from_training(spark):
    rows = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test")], "subject_id long, fold_id string")
    long = spark.createDataFrame([(1, "f", 2.0), (2, "g", 1.0)], "subject_id long, feature_id string, feature_val double")
    words = spark.createDataFrame([("f", 0)], "feature_id string, idx int")
    got = {r["subject_id"]: r["features"].toArray().tolist() for r in S.sparse_for_all(rows, long, words, 1).collect()}
    assert got == {1: [2.0], 2: [0.0], 3: [0.0]}


def test_vectors_are_made_without_an_object_per_entry(spark):
    """Entries in the order of the words; NULL is no number; two values of a word are refused."""
    rows = [(i, f"f{j}", None if (i, j) == (3, 1) else 10.0 * i + j) for i in range(1, 60) for j in range(i % 5 + 1)]
    long = spark.createDataFrame(rows, "subject_id long, feature_id string, feature_val double")
    words = spark.createDataFrame([(f"f{j}", 4 - j) for j in range(5)], "feature_id string, idx int")
    made = S.long_to_sparse(long.repartition(3), words, 5)
    assert "BatchEvalPython" not in made._jdf.queryExecution().toString()
    got = {r["subject_id"]: r["features"] for r in made.collect()}
    assert len(got) == 59 and got[3].indices.tolist() == [1, 2, 3, 4] and str(got[3].values[2]) == "nan"
    for i, v in got.items():
        if i != 3:
            assert v.size == 5 and dict(zip(v.indices.tolist(), v.values.tolist())) == {4 - j: 10.0 * i + j for j in range(i % 5 + 1)}
    with pytest.raises(Exception, match="two values of one vocabulary word"):
        S.long_to_sparse(long.union(long), words, 5).collect()


def test_one_stratum_holds_most_rows(spark):
    """Ranks of a hot stratum are dense and complete; no window sorts it whole."""
    from strataflow.functions.hashing import hash_key
    from strataflow.operators.running import hash_ranks

    df = spark.range(6000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN 'small' ELSE 'hot' END AS s")
    ranked = hash_ranks(df, ["s"], hash_key(1, "id"), ["id"])
    got = ranked.groupBy("s").agg(F.countDistinct("rank0").alias("d"), F.max("rank0").alias("m"), F.max("n").alias("n"))
    assert {r.s: (r.d, r.m, r.n) for r in got.collect()} == {"hot": (5400, 5399, 5400), "small": (600, 599, 600)}
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    row_windows = [line for line in plan.splitlines() if "Window [" in line and "__sum" not in line]
    assert row_windows and all("__bucket" in line for line in row_windows)


def test_attributes_are_stacked(spark):
    rows = spark.createDataFrame(
        [(1, "a", 39), (2, None, 40), (3, "b", 80), (4, None, None)], "ids int, kind string, age int"
    )
    got = B.stack_attributes(rows, {"kind": "kind", "age": B.age_band("age")}, ["ids"]).collect()
    assert sorted(tuple(r) for r in got) == [
        (1, "age", "under 40"), (1, "kind", "a"), (2, "age", "40-59"), (3, "age", "80 and over"), (3, "kind", "b"),
    ]
    assert B.stack_attributes(rows.where("false"), {"kind": "kind"}, ["ids"]).count() == 0


def test_group_weights_don_t_gather_groups(spark):
    """The rows of a group stay where they are, also where Spark's size check would not broadcast."""
    df = spark.createDataFrame([(i, i % 2) for i in range(30)], "subject_id long, group_var int").repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = S.add_group_weights(df, "group_var")
        assert "BroadcastHashJoin" in "".join(out._jdf.queryExecution().sparkPlan().toString().split("\n")[:3])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r["weight"] for r in out.collect()} == {2}
