"""Training and diagnostic queries."""

import numpy as np
from pyspark.sql import functions as F

from strataflow.operators import diagnostics as D
from strataflow.operators import features as X
from strataflow.operators import modeling as ML
from strataflow.operators import network as NET
from strataflow.operators import split as S
from strataflow.plans.features import long_features
from strataflow.plans.registry import query, r
from strataflow.plans.splits import folds
from strataflow.session import cut_lineage, scratch_path
from strataflow.sources import tables as IO


#: Rows of a task's part of a training frame. Frames of some parts' rows stay as the joins leave them.
PART_ROWS, WHOLE_ROWS = 8192, 32768


def in_parts(data, n, key="subject_id"):
    """Rows in parts of bounded size, however few tasks the shuffles before use."""
    return data.repartition(-(-n // PART_ROWS), key) if n > WHOLE_ROWS else data


def training_frame(v):
    """Folds with sparse feature vectors over all seven sources; also the vocabulary size.

    Words are those of the training fold; patients without any keep an empty vector.
    """
    long = cut_lineage(long_features(v).select("subject_id", "feature_id", "feature_val"))
    rows = cut_lineage(folds(v))
    train = long.join(part(rows, "train").select("subject_id"), "subject_id", "left_semi")
    # the words are written once: their places are found in two steps
    vocab = cut_lineage(X.vocabulary(cut_lineage(train.select("feature_id").distinct())))
    size = vocab.count()
    return cut_lineage(in_parts(S.sparse_for_all(rows, long, vocab, size), rows.count())), size


def part(data, *names):
    return data.where(F.col("fold_id").isin(*names))


def fit_and_score(v, kind, **params):
    data, _ = training_frame(v)
    model = ML.make_estimator(kind, **params).fit(part(data, "train"))
    return ML.score(model, part(data, "val", "test"))


@query("ml_logistic")
def _(v):
    return fit_and_score(v, "lr", regParam=0.01, maxIter=50)


@query("ml_forest")
def _(v):
    return fit_and_score(v, "rf", numTrees=20, maxDepth=5)


@query("ml_gbt")
def _(v):
    return fit_and_score(v, "gbt", maxIter=5, maxDepth=3)


@query("ml_mlp")
def _(v):
    data, size = training_frame(v)
    net = ML.make_estimator("mlp", layers=ML.hidden_layers(size, 1, 8), maxIter=20)
    return ML.score(net.fit(part(data, "train")), part(data, "val", "test"))


@query("ml_score")
def _(v):
    """Scores of the held-out folds with ids and group, ready for evaluation."""
    data, _ = training_frame(v)
    model = ML.make_estimator("lr", regParam=0.1).fit(part(data, "train"))
    return ML.score(model, part(data, "val", "test"), keep=["group_var"])


@query("ml_repeat_seeds")
def _(v):
    data, _ = training_frame(v)
    return ML.repeat_training("rf", {"numTrees": 5, "maxDepth": 4}, part(data, "train"), part(data, "val", "test"), n_iters=3)


GRID = {"regParam": [0.01, 0.1], "elasticNetParam": [0.0, 0.5]}


def searched(v, metrics=("loss_bce",)):
    data, _ = training_frame(v)
    return ML.search_logistic_by(GRID, part(data, "train"), part(data, "val"), metrics)


@query("ml_grid_search")
def _(v):
    """The seeded grid with each setting's validation loss and the choice."""
    return searched(v)["loss_bce"][0]


@query("rpt_hyperparams")
def _(v):
    """Chosen settings of two searches, stored as JSON and read back as one table."""
    root = scratch_path(v.spark, "params")
    paths = []
    for metric, (_, best, _) in searched(v, ("loss_bce", "auc")).items():
        paths.append(IO.write_params(v.spark, {"analysis_id": "longlos", "metric": metric, **best}, f"{root}/{metric}"))
    return IO.read_params(v.spark, paths, "analysis_id string, metric string, regParam double, elasticNetParam double")


# --- many logistic models at once -------------------------------------------------

PENALTIES = (0.0, 0.01, 0.03, 0.1, 0.3, 1.0)
RIDGE = {
    "mat_ridge_rows": """
SELECT labels::DOUBLE AS y, (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS x, x AS raw, phase
FROM (SELECT labels, phase, ln(pred_probs / (1 - pred_probs)) AS x FROM predictions)""",
    "mat_ridge_0": f"""
SELECT reg, (SELECT ln(avg(y) / (1 - avg(y))) FROM mat_ridge_rows) AS a, 0.0::DOUBLE AS b
FROM (SELECT unnest([{", ".join(f"{p}::DOUBLE" for p in PENALTIES)}]) AS reg)""",
}
for _i in range(1, 10):
    RIDGE[f"mat_ridge_{_i}"] = f"""
SELECT reg, a + (g0 * h11 - g1 * h01) / (h00 * h11 - h01 * h01) AS a, b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b
FROM (SELECT reg, any_value(a) AS a, any_value(b) AS b, avg(y - p) AS g0, avg((y - p) * x) - reg * any_value(b) AS g1,
             avg(p * (1 - p)) AS h00, avg(p * (1 - p) * x) AS h01, avg(p * (1 - p) * x * x) + reg AS h11
      FROM (SELECT *, 1 / (1 + exp(-(a + b * x))) AS p FROM mat_ridge_rows CROSS JOIN mat_ridge_{_i - 1}) GROUP BY reg)"""


def penalised(v):
    """Predictions as one feature, and the models of all penalties on it."""
    from pyspark.ml.functions import array_to_vector

    rows = v.predictions().select(
        "phase", F.col("labels").alias("label"),
        array_to_vector(F.array(F.expr("ln(pred_probs / (1 - pred_probs))"))).alias("features"),
    )
    rows = cut_lineage(rows)
    return rows, ML.fit_many(rows, [{"regParam": p} for p in PENALTIES])


@query("ml_penalty_path", f"""
SELECT reg, {r("b / s", 5)} AS slope, {r("a - b * m / s", 5)} AS intercept
FROM mat_ridge_9, (SELECT avg(raw) AS m, stddev_samp(raw) AS s FROM mat_ridge_rows)""", RIDGE)
def _(v):
    """Models of all penalties, fitted together, against Newton's steps."""
    _, found = penalised(v)
    rows = [(p, float(c[0]), float(b)) for p, c, b in zip(PENALTIES, found.coefficients, found.intercepts)]
    made = v.spark.createDataFrame(rows, "reg double, slope double, intercept double")
    return made.selectExpr("reg", "round(slope, 5) + 0D AS slope", "round(intercept, 5) + 0D AS intercept")


@query("ml_penalty_scores", f"""
SELECT reg, phase, count(*) AS n, {r("avg(p)", 5)} AS mean_prediction, {r("avg((p - y) * (p - y))", 5)} AS brier
FROM (SELECT *, 1 / (1 + exp(-(a + b * x))) AS p FROM mat_ridge_rows CROSS JOIN mat_ridge_9) GROUP BY reg, phase""", RIDGE)
def _(v):
    """The same models' scores of all rows, made in one pass."""
    rows, found = penalised(v)
    scored = found.score(rows, keep=["phase", "label"])
    reg = F.element_at(F.array(*map(F.lit, PENALTIES)), F.col("setting") + 1)
    return scored.withColumn("reg", reg).groupBy("reg", "phase").agg(
        F.count("*").alias("n"),
        F.expr("round(avg(pred_probs), 5) + 0D").alias("mean_prediction"),
        F.expr("round(avg((pred_probs - label) * (pred_probs - label)), 5) + 0D").alias("brier"),
    )


# --- networks ---------------------------------------------------------------------

#: Two hidden units over one feature: weights and offsets of both layers in their order, and which are penalised.
NET_START = (0.5, -0.7, 0.1, 0.2, 0.6, -0.4, 0.0)
NET_PENALISED = (1, 1, 0, 0, 1, 1, 0)
NET_STEPS, NET_RATE, NET_PENALTY = 6, 0.05, 0.01
NET_VIEWS = {
    "mat_net_rows": """
SELECT labels::DOUBLE AS y, ln(pred_probs / (1 - pred_probs)) AS x, 1.0::DOUBLE + ids % 3 AS w, phase FROM predictions""",
    "mat_net_0": "SELECT 0.0::DOUBLE AS loss, "
    + ", ".join(f"{p}::DOUBLE AS p{j}, 0.0::DOUBLE AS m{j}, 0.0::DOUBLE AS s{j}" for j, p in enumerate(NET_START, 1)),
}


def net_margins(step: int) -> str:
    """Rows with hidden outputs h1, h2 and margin o under the weights of a step."""
    return f"""
SELECT *, p5 * h1 + p6 * h2 + p7 AS o FROM (
  SELECT *, greatest(p1 * x + p3, 0) AS h1, greatest(p2 * x + p4, 0) AS h2 FROM mat_net_rows CROSS JOIN mat_net_{step})"""


for _t in range(1, NET_STEPS + 1):
    _back = ["e * p5 * x * (h1 > 0)::INT", "e * p6 * x * (h2 > 0)::INT", "e * p5 * (h1 > 0)::INT", "e * p6 * (h2 > 0)::INT",
             "e * h1", "e * h2", "e"]
    _slopes = ", ".join(f"sum({b}) / sum(w) AS r{j}" for j, b in enumerate(_back, 1))
    _moved = ", ".join(
        f"p{j} - {NET_RATE}::DOUBLE * (m{j} / (1 - pow(0.9::DOUBLE, {_t}))) / (sqrt(s{j} / (1 - pow(0.999::DOUBLE, {_t}))) + 1e-8) AS p{j}, "
        f"m{j}, s{j}" for j in range(1, 8))
    _means = ", ".join(
        f"p{j}, 0.9::DOUBLE * m{j} + 0.1::DOUBLE * (r{j} + {NET_PENALTY * k}::DOUBLE * p{j}) AS m{j}, "
        f"0.999::DOUBLE * s{j} + 0.001::DOUBLE * pow(r{j} + {NET_PENALTY * k}::DOUBLE * p{j}, 2) AS s{j}"
        for j, k in enumerate(NET_PENALISED, 1))
    NET_VIEWS[f"mat_net_{_t}"] = f"""
SELECT loss, {_moved} FROM (
  SELECT g.loss, {_means} FROM mat_net_{_t - 1} CROSS JOIN (
    SELECT sum(w * (ln(1 + exp(o)) - y * o)) / sum(w) AS loss, {_slopes}
    FROM (SELECT *, w * (1 / (1 + exp(-o)) - y) AS e FROM ({net_margins(_t - 1)}))) g)"""


def small_network(v):
    """Predictions as one feature, and the network after some steps over all of them."""
    from pyspark.ml.functions import array_to_vector

    rows = v.predictions().select(
        "phase", "ids", F.col("labels").alias("label"), F.expr("1D + ids % 3").alias("w"),
        array_to_vector(F.array(F.expr("ln(pred_probs / (1 - pred_probs))"))).alias("features"),
    )
    rows = cut_lineage(rows)
    a = np.array(NET_START)
    start = [(a[:2].reshape(1, 2), a[2:4]), (a[4:6].reshape(2, 1), a[6:])]
    return rows, NET.fit_network(
        rows, "ids", (2,), weight="w", epochs=NET_STEPS, rate=NET_RATE, penalty=NET_PENALTY, start=start
    )


@query("ml_network_steps", " UNION ALL ".join(
    [f"SELECT 'loss' AS kind, {t} AS place, {r('loss', 5)} AS value FROM mat_net_{t}" for t in range(1, NET_STEPS + 1)]
    + [f"SELECT 'weight', {j}, {r(f'p{j}', 5)} FROM mat_net_{NET_STEPS}" for j in range(1, 8)]), NET_VIEWS)
def _(v):
    """Losses and weights of a weighted, penalised network, step by step as SQL computes them."""
    _, net = small_network(v)
    made = [("loss", i, x) for i, x in enumerate(net.losses, 1)]
    made += [("weight", i, float(x)) for i, x in enumerate(net.weights, 1)]
    found = v.spark.createDataFrame(made, "kind string, place int, value double")
    return found.selectExpr("kind", "place", "round(value, 5) + 0D AS value")


@query("ml_network_scores", f"""
SELECT phase, count(*) AS n, {r("avg(p)", 5)} AS mean_prediction, {r("avg((p - y) * (p - y))", 5)} AS brier
FROM (SELECT *, 1 / (1 + exp(-o)) AS p FROM ({net_margins(NET_STEPS)})) GROUP BY phase""", NET_VIEWS)
def _(v):
    """The same network's scores of all rows."""
    rows, net = small_network(v)
    return net.score(rows, keep=["phase", "label"]).groupBy("phase").agg(
        F.count("*").alias("n"),
        F.expr("round(avg(pred_probs), 5) + 0D").alias("mean_prediction"),
        F.expr("round(avg((pred_probs - label) * (pred_probs - label)), 5) + 0D").alias("brier"),
    )


@query("ml_network")
def _(v):
    """A network over all seven sources: groups weigh alike, hidden units are dropped, rows come in mini-batches."""
    data, _ = training_frame(v)
    train = cut_lineage(S.add_group_weights(part(data, "train"), "group_var"))
    net = NET.fit_network(train, "subject_id", (16,), weight="weight", epochs=5, batches=4, dropout=0.25, rate=0.01)
    scored = net.score(part(data, "val", "test"), keep=["fold_id", "subject_id", "label"])
    return scored.selectExpr(
        "fold_id AS phase", "subject_id AS ids", "subject_id AS row_id", "CAST(label AS INT) AS labels", "outputs", "pred_probs"
    )


# --- group penalties --------------------------------------------------------------

CORAL_CELLS = """
SELECT g, i, j, count(*) AS n, avg(x) AS m, covar_samp(x, y) AS c FROM (
  SELECT g, i, j, v[i]::DOUBLE AS x, v[j]::DOUBLE AS y
  FROM (SELECT label % 4 AS g, embedding AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
       (SELECT unnest(range(1, 65)) AS j))
GROUP BY g, i, j"""


@query("dg_coral", f"""
SELECT 'group' AS mode, (SELECT count(DISTINCT g) FROM mat_cells)::BIGINT AS n_groups, {r("avg(a + b)")} AS penalty FROM (
  SELECT p.g, s.g AS h, avg((p.m - s.m) * (p.m - s.m)) FILTER (p.j = 1) AS a, avg((p.c - s.c) * (p.c - s.c)) AS b
  FROM mat_cells p JOIN mat_cells s ON p.i = s.i AND p.j = s.j AND p.g < s.g GROUP BY p.g, s.g)
UNION ALL
SELECT 'overall', (SELECT count(DISTINCT g) FROM mat_cells)::BIGINT, {r("avg(a + b)")} FROM (
  SELECT p.g, avg((p.m - s.m) * (p.m - s.m)) FILTER (p.j = 1) AS a, avg((p.c - s.c) * (p.c - s.c)) AS b
  FROM mat_cells p JOIN mat_rest s ON p.i = s.i AND p.j = s.j AND p.g = s.g GROUP BY p.g)""", {
    "mat_cells": CORAL_CELLS,
    "mat_rest": CORAL_CELLS.replace("label % 4 AS g, embedding AS v", "k AS g, embedding AS v").replace(
        "FROM embeddings)", "FROM embeddings, (SELECT unnest(range(0, 4)) AS k) WHERE label % 4 <> k)")})
def _(v):
    """Distance of group means and covariances, between pairs and against the rest."""
    df = v.table("embeddings").selectExpr("label % 4 AS `group`", "embedding")
    pairs = D.coral_penalty(df, "group", "embedding", "group").select(F.lit("group").alias("mode"), "n_groups", "penalty")
    rest = D.coral_penalty(df, "group", "embedding", "overall").select(F.lit("overall").alias("mode"), "n_groups", "penalty")
    return pairs.unionByName(rest)


SIG = "1 / (1 + exp(-outputs))"
CE = "ln(1 + exp(outputs)) - labels * outputs"


def logits(v):
    return v.predictions().withColumn("z0", F.lit(0.0))


@query("dg_irm_penalty", f"""
SELECT "group", {r(f"pow(avg({SIG} * outputs - labels * outputs), 2)")} AS penalty FROM predictions GROUP BY "group" """)
def _(v):
    return D.irm_penalty(logits(v), "group", ["z0", "outputs"])


@query("dg_group_dro", f"""
SELECT "group", {r("loss")} AS loss, {r("weight")} AS weight, {r("sum(weight * loss) OVER ()")} AS objective FROM (
  SELECT *, w * CASE WHEN sum(w) OVER () > 1 THEN 1 / sum(w) OVER () ELSE 1 END AS weight FROM (
    SELECT "group", avg({CE}) AS loss, exp(0.1::DOUBLE * avg({CE})) AS w FROM predictions GROUP BY "group"))""")
def _(v):
    return D.group_dro_step(D.group_losses(logits(v), "group", ["z0", "outputs"]), "group")


@query("dg_baselined_loss", f"""
SELECT "group", {r("ce - CASE WHEN x < 1e-6 OR 1 - x < 1e-6 THEN 0 ELSE -x * ln(x) - (1 - x) * ln(1 - x) END")} AS loss
FROM (SELECT "group", avg({CE}) AS ce, avg(labels) AS x FROM predictions GROUP BY "group")""")
def _(v):
    return D.baselined_loss(logits(v), "group", ["z0", "outputs"])
