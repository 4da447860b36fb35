"""Metric, calibration, fairness and aggregation queries over the prediction tables."""

from pyspark.sql import functions as F

from strataflow.operators import calibration as CAL
from strataflow.operators import fairness as FR
from strataflow.operators import metrics as M
from strataflow.operators.running import exact_quantiles
from strataflow.plans.registry import query, r
from strataflow.plans.sqltext import (
    RANK_SQL,
    metrics_sql,
    newton_views,
    points_sql,
    q,
    ranks_sql,
    threshold_sql,
    weighted,
)

STRATA = ["phase", "iter", "group"]
PRED = weighted("predictions")
# a weight that differs by row, for the weighted forms
WEIGHTED = weighted("predictions", "(1 + ids % 3)::DOUBLE")
TIES = "(SELECT * REPLACE (round(pred_probs, 1) AS pred_probs), 1.0::DOUBLE AS w FROM predictions)"


def ties(v):
    return v.predictions().withColumn("pred_probs", F.round("pred_probs", 1))


def with_weight(v):
    return v.predictions().withColumn("w", F.expr("CAST(1 + ids % 3 AS DOUBLE)"))


@query("ev_auc", metrics_sql(PRED, STRATA, ["auc"]) + " UNION ALL " +
       metrics_sql(TIES, STRATA, ["auc"]).replace("'auc' AS", "'auc_ties' AS") + " UNION ALL " +
       metrics_sql(WEIGHTED, STRATA, ["auc"]).replace("'auc' AS", "'auc_weighted' AS"))
def _(v):
    """Plain, with many ties, and weighted."""
    plain = M.evaluate(v.predictions(), ["auc"], STRATA)
    tied = M.evaluate(ties(v), ["auc"], STRATA).withColumn("metric", F.lit("auc_ties"))
    heavy = M.evaluate(with_weight(v), ["auc"], STRATA, weight="w").withColumn("metric", F.lit("auc_weighted"))
    return plain.unionByName(tied).unionByName(heavy)


@query("ev_auprc", metrics_sql(PRED, STRATA, ["auprc"]) + " UNION ALL " +
       metrics_sql(TIES, STRATA, ["auprc"]).replace("'auprc' AS", "'auprc_ties' AS"))
def _(v):
    tied = M.evaluate(ties(v), ["auprc"], STRATA).withColumn("metric", F.lit("auprc_ties"))
    return M.evaluate(v.predictions(), ["auprc"], STRATA).unionByName(tied)


for _name, _metrics in {
    "ev_brier": ["brier"],
    "ev_log_loss": ["loss_bce"],
    "ev_mean_prediction": ["mean_prediction", "mean_prediction_0", "mean_prediction_1"],
    "ev_spiegelhalter_z": ["spiegelhalter_z"],
    "ev_at_threshold": M.at_threshold_names(),
}.items():

    @query(_name, metrics_sql(WEIGHTED, STRATA, _metrics))
    def _(v, metrics=tuple(_metrics)):
        return M.evaluate(with_weight(v), metrics, STRATA, weight="w")


THRESHOLD = "0.1::DOUBLE + 0.1::DOUBLE * iter"


@query("ev_threshold", metrics_sql(PRED, STRATA, M.THRESHOLD_METRICS, THRESHOLD))
def _(v):
    """Threshold from a column; positive strictly above it."""
    df = v.predictions().withColumn("threshold", F.expr("0.1D + 0.1D * iter"))
    return M.evaluate(df, M.THRESHOLD_METRICS, STRATA, threshold="threshold")


STANDARD = ["auc", "auprc", "loss_bce", "brier", "ppv", "npv", "sensitivity", "specificity"]


@query("ev_stratified", metrics_sql(PRED, ["phase", "iter"], STANDARD, THRESHOLD))
def _(v):
    """Chosen metrics by strata; unknown metrics and strata the table lacks are left out."""
    df = v.predictions().withColumn("threshold", F.expr("0.1D + 0.1D * iter"))
    return M.evaluate(df, [*STANDARD, "not_a_metric"], ["phase", "iter", "no_such_column"], threshold="threshold")


@query("ev_clean", f"""
SELECT * FROM ({metrics_sql(weighted("toxicity"), ["group"], ["auc", "loss_bce", "brier"])}
UNION ALL {metrics_sql("(SELECT *, 1.0::DOUBLE AS w FROM one_class)", ["group"], ["auc", "loss_bce", "brier"])})
WHERE performance IS NOT NULL AND NOT (metric = 'auc' AND performance < 0) AND NOT (metric = 'loss_bce' AND performance = 1e18)
""", {"one_class": 'SELECT doc_id, "group" || \'-clean\' AS "group", pred_probs, labels FROM toxicity WHERE labels = 0'})
def _(v):
    """Undefined values of one-class strata are removed."""
    clean = v.toxicity.where("labels = 0").withColumn("group", F.expr("concat(`group`, '-clean')"))
    both = v.toxicity.unionByName(clean)
    return M.clean_results(M.evaluate(both, ["auc", "loss_bce", "brier"], ["group"]))


def ece_sql(quantile: bool, src: str = "predictions", strata=None) -> str:
    s = q(strata or STRATA)
    if quantile:
        place = " + ".join(f"(p > quantile_{i})::INTEGER" for i in range(1, 10))
        ends = ", ".join(f"quantile_cont(pred_probs, {i / 10}) AS quantile_{i}" for i in range(1, 10))
    else:
        place = " + ".join(f"(p > lo + (hi - lo) / 10 * {i})::INTEGER" for i in range(1, 10))
        ends = "min(pred_probs) AS lo, max(pred_probs) AS hi"
    return f"""
SELECT {s}, sum(n) AS n, sum(n * abs(d)) / sum(n) AS ece_abs, sqrt(sum(n * d * d) / sum(n)) AS ece_rmse,
       sum(n * d) / sum(n) AS ece_signed, sum(n * d * d) / sum(n) AS ece_squared
FROM (SELECT {s}, bin, count(*) AS n, avg(p) - avg(labels) AS d
      FROM (SELECT {s}, labels, p, {place} AS bin
            FROM (SELECT *, pred_probs AS p FROM {src}) JOIN
                 (SELECT {s}, {ends} FROM {src} GROUP BY {s}) USING ({s}))
      GROUP BY {s}, bin) GROUP BY {s}"""


@query("ev_ece", " UNION ALL ".join(
    f"SELECT '{m}' AS metric, {q(STRATA)}, {r(m)} AS performance FROM ({ece_sql(False)})"
    for m in ("ece_abs", "ece_rmse", "ece_signed", "ece_squared")))
def _(v):
    return M.evaluate(v.predictions(), ["ece_abs", "ece_rmse", "ece_signed", "ece_squared"], STRATA)


@query("ev_ece_quantile", " UNION ALL ".join(
    f"SELECT 'ece_q_{m}' AS metric, {q(STRATA)}, {r(f'ece_{m}')} AS performance FROM ({ece_sql(True)})" for m in ("abs", "rmse")))
def _(v):
    return M.evaluate(v.predictions(), ["ece_q_abs", "ece_q_rmse"], STRATA)


TIED = "floor(pred_probs * 200) / 200"


@query("ev_mixed_metrics", f"""
SELECT 'ece_q_abs' AS metric, {q(STRATA)}, {r("ece_abs")} AS performance FROM ({ece_sql(True, "tied")})
UNION ALL {metrics_sql(weighted("tied"), STRATA, ["auc", "auprc", "brier"])}""",
       {"tied": f"SELECT * REPLACE ({TIED} AS pred_probs) FROM predictions"})
def _(v):
    """Quantile bins beside ranks on tied scores: no family changes with its company."""
    df = v.predictions().withColumn("pred_probs", F.expr(TIED))
    return M.evaluate(df, ["auc", "auprc", "brier", "ece_q_abs"], STRATA)


@query("ev_ece_pointwise", f"""
SELECT {q(STRATA)}, {r("sqrt(sum(w * (p - m) * (p - m)) / sum(w))")} AS performance FROM (
  SELECT *, sum(w * labels) OVER b / sum(w) OVER b AS m FROM (
    SELECT {q(STRATA)}, labels, pred_probs AS p, (1 + ids % 3)::DOUBLE AS w,
           {" + ".join(f"(pred_probs > lo + (hi - lo) / 10 * {i})::INTEGER" for i in range(1, 10))} AS bin
    FROM predictions JOIN (SELECT {q(STRATA)}, min(pred_probs) AS lo, max(pred_probs) AS hi FROM predictions GROUP BY ALL)
    USING ({q(STRATA)})) WINDOW b AS (PARTITION BY {q(STRATA)}, bin)) GROUP BY {q(STRATA)}""")
def _(v):
    return M.pointwise_calibration_error(with_weight(v), STRATA, weight="w", norm_order=2)


# --- fitted calibration -----------------------------------------------------

PG = ["phase", "group"]


@query("ev_calibration_density", f"""
SELECT {q(PG)}, {r("pred_probs")} AS pred_probs, w1, w0, {r("x")} AS model_input, {r("density")} AS density FROM cd_curve""",
       newton_views(points_sql(PRED, PG, "c_log_log"), PG, "cd"))
def _(v):
    return CAL.calibration_density(v.predictions(), PG, transform="c_log_log")


def ace_rows(view: str, keys, names) -> str:
    parts = []
    for n in names:
        d = "density - pred_probs"
        f = {"abs": f"abs({d})", "signed": f"({d})"}.get(n.split("_")[1], f"({d}) * ({d})")
        e = f"sum((w1 + w0) * {f}) / sum(w1 + w0)"
        e = f"sqrt({e})" if "rmse" in n else e
        parts.append(f"SELECT '{n}' AS metric, {q(keys)}, {r(e)} AS performance FROM {view} GROUP BY {q(keys)}")
    return " UNION ALL ".join(parts)


LOGISTIC = [n for n, (_, m, _t) in CAL.ACE_METRICS.items() if m == "logistic"]


@query("ev_ace_logistic", ace_rows("lg_curve", PG, [n for n in LOGISTIC if n.endswith("log")]) + " UNION ALL " +
       ace_rows("ln_curve", PG, [n for n in LOGISTIC if n.endswith("none")]),
       {**newton_views(points_sql(WEIGHTED, PG, "log"), PG, "lg"), **newton_views(points_sql(WEIGHTED, PG, None), PG, "ln")})
def _(v):
    return M.evaluate(with_weight(v), LOGISTIC, PG, weight="w")


def bin_curve_sql(transform) -> str:
    x = "ln(pred_probs)" if transform else "pred_probs"
    ends = ", ".join(f"quantile_cont({x}, {i / 10}) AS q{i}" for i in range(1, 10))
    place = " + ".join(f"(q{i} <= x + 1e-8::DOUBLE + 1e-5::DOUBLE * abs(x))::INTEGER" for i in range(1, 10))
    return f"""
SELECT *, sum(w1) OVER b / sum(w1 + w0) OVER b AS density FROM (
  SELECT *, {place} AS bin FROM ({points_sql(PRED, PG, transform)}) JOIN
  (SELECT {q(PG)}, {ends} FROM predictions GROUP BY {q(PG)}) USING ({q(PG)}))
WINDOW b AS (PARTITION BY {q(PG)}, bin)"""


BINNED = [n for n, (_, m, _t) in CAL.ACE_METRICS.items() if m == "bin"]


@query("ev_ace_bin", ace_rows("bl", PG, [n for n in BINNED if n.endswith("log")]) + " UNION ALL " +
       ace_rows("bn", PG, [n for n in BINNED if n.endswith("none")]),
       {"bl": bin_curve_sql("log"), "bn": bin_curve_sql(None)})
def _(v):
    return M.evaluate(v.predictions(), BINNED, PG)


@query("ev_rce", f"""
SELECT phase, "group", {r("sum((w1 + w0) * abs(density - all_density)) / sum(w1 + w0)")} AS relative_calibration_error,
       {r("sum((w1 + w0) * abs(density - pred_probs)) / sum(w1 + w0)")} AS absolute_calibration_error
FROM rg_curve JOIN (SELECT phase, pred_probs, density AS all_density FROM ra_curve) USING (phase, pred_probs)
GROUP BY phase, "group" """,
       {**newton_views(points_sql(PRED, PG, "log"), PG, "rg"), **newton_views(points_sql(PRED, ["phase"], "log"), ["phase"], "ra")})
def _(v):
    return CAL.relative_calibration_error(v.predictions(), "group", ["phase"], transform="log", compute_ace=True)


@query("ev_cox", f"""
SELECT {q(PG)}, {r("a")} AS cox_intercept, {r("b")} AS cox_slope, TRUE AS converged FROM cx_coefs""",
       newton_views(points_sql(PRED, PG, "logit"), PG, "cx"))
def _(v):
    return CAL.cox_calibration(v.predictions(), PG)


@query("ev_ace_forest")
def _(v):
    """A seeded forest; checked for range and stability in the tests."""
    return CAL.forest_calibration_error(v.predictions(), num_trees=20)


@query("udf_custom_metric", f"""
SELECT 'balanced_error' AS metric, {q(PG)}, {r(f"1 - ({threshold_sql('sensitivity', 'pred_probs >= 0.5::DOUBLE')} + {threshold_sql('specificity', 'pred_probs >= 0.5::DOUBLE')}) / 2")} AS performance
FROM {PRED} GROUP BY {q(PG)}""")
def _(v):
    """A user's own function: sums over any part of a stratum, and what they come to."""

    def counts(labels, scores, weights):
        called = scores >= 0.5
        right = [(weights * ((labels == y) & (called == y))).sum() for y in (1, 0)]
        return [*right, *[(weights * (labels == y)).sum() for y in (1, 0)]]

    def balanced_error(s):
        return 1 - (s[0] / s[2] + s[1] / s[3]) / 2

    return M.custom_metric(v.predictions(), "balanced_error", counts, balanced_error, PG)


# --- fairness ---------------------------------------------------------------

OVA = list(FR.OVA_METRICS)


def side_by_side(metrics, keys=("phase",)) -> str:
    k = list(keys)
    return f"""
SELECT a.metric, {q(k, "a.")}, a."group", a.performance AS own, b.performance AS overall
FROM ({metrics_sql(PRED, [*k, "group"], metrics, rounded=False)}) a
JOIN ({metrics_sql(PRED, k, metrics, rounded=False)}) b ON a.metric = b.metric AND {" AND ".join(f'a."{c}" = b."{c}"' for c in k)}"""


@query("agg_group_vs_overall", f"""
SELECT metric, phase, "group", {r("own")} AS performance, {r("overall")} AS performance_overall FROM ({side_by_side(["auc", "brier"])})""")
def _(v):
    return FR.group_vs_overall(v.predictions(), "group", ["auc", "brier"], ["phase"])


OVA_SQL = f"""SELECT metric || '_ova' AS metric, phase, "group", {r("own - overall")} AS performance FROM ({side_by_side(OVA)})"""


@query("fr_metric_ova", OVA_SQL)
def _(v):
    return FR.metric_ova(v.predictions(), "group", OVA, ["phase"])


def emd_sql(variant: str) -> str:
    lab = FR.EMD_VARIANTS[variant]
    src = "predictions" if lab is None else f"(SELECT * FROM predictions WHERE labels = {lab})"
    return f"""
SELECT '{variant}' AS metric, phase, "group", {r("sum(abs(cu / tu - cv / tv) * (nxt - p))")} AS performance FROM (
  SELECT *, sum(u) OVER w AS cu, sum(v) OVER w AS cv, sum(u) OVER t AS tu, sum(v) OVER t AS tv, lead(p) OVER w AS nxt FROM (
    SELECT phase, g AS "group", pred_probs AS p, count(*) FILTER ("group" = g)::DOUBLE AS u, count(*)::DOUBLE AS v
    FROM {src}, (SELECT DISTINCT "group" AS g FROM predictions) GROUP BY phase, g, pred_probs)
  WINDOW w AS (PARTITION BY phase, "group" ORDER BY p), t AS (PARTITION BY phase, "group"))
GROUP BY phase, "group" """


EMD_SQL = " UNION ALL ".join(emd_sql(n) for n in FR.EMD_VARIANTS)


@query("fr_emd", EMD_SQL)
def _(v):
    out = None
    for n in FR.EMD_VARIANTS:
        part = FR.emd_ova(v.predictions(), "group", n, ["phase"])
        out = part if out is None else out.unionByName(part)
    return out


def xauc_sql(variant: str) -> str:
    lab, exclude = FR.XAUC_VARIANTS[variant]
    other = 'AND "group" <> g' if exclude else ""
    src = f"""(SELECT phase, g AS grp, pred_probs, labels, 1.0::DOUBLE AS w
FROM predictions, (SELECT DISTINCT "group" AS g FROM predictions)
WHERE ("group" = g AND labels = {lab}) OR (labels = {1 - lab} {other}))"""
    return f"""SELECT '{variant}' AS metric, phase, grp AS "group", {r(RANK_SQL["auc"])} AS performance
FROM ({ranks_sql(src, ["phase", "grp"])}) GROUP BY phase, grp"""


XAUC_SQL = " UNION ALL ".join(xauc_sql(n) for n in FR.XAUC_VARIANTS)


@query("fr_xauc", XAUC_SQL)
def _(v):
    out = None
    for n in FR.XAUC_VARIANTS:
        part = FR.xauc(v.predictions(), "group", n, ["phase"])
        out = part if out is None else out.unionByName(part)
    return out


@query("fr_ova_frame", f"{OVA_SQL} UNION ALL {EMD_SQL} UNION ALL {XAUC_SQL}")
def _(v):
    return FR.fairness_ova(v.predictions(), "group", ["phase"])


# --- aggregations over predictions and results --------------------------------

@query("agg_mean_over_iter", f"""
SELECT phase, "group", metric, {r("avg(performance)")} AS mean, {r("stddev_samp(performance)")} AS std
FROM ({metrics_sql(PRED, STRATA, ["auc", "brier"], rounded=False)}) GROUP BY phase, "group", metric""")
def _(v):
    return M.mean_over_iterations(M.evaluate(v.predictions(), ["auc", "brier"], STRATA), ["phase", "group"])


@query("agg_ensemble_predictions", f"""
SELECT phase, row_id, {r("avg(outputs)")} AS outputs, {r("avg(pred_probs)")} AS pred_probs, {r("avg(labels)")} AS labels
FROM predictions GROUP BY phase, row_id""")
def _(v):
    return M.ensemble_predictions(v.predictions(), ["phase", "row_id"])


BEST_SQL = f"""
SELECT iter, performance FROM ({metrics_sql("(SELECT *, 1.0::DOUBLE AS w FROM predictions WHERE phase = 'val')", ["iter"], ["loss_bce"], rounded=False)})
ORDER BY performance, iter LIMIT 1"""


@query("sel_best_iter", f"SELECT iter, {r('performance')} AS loss_bce FROM ({BEST_SQL})")
def _(v):
    return M.best_iteration(v.predictions())


@query("agg_quantiles", f"""
SELECT phase, "group", count(*) AS n, {r("quantile_cont(pred_probs, 0.025)")} AS q_low, {r("quantile_cont(pred_probs, 0.5)")} AS q_mid,
       {r("quantile_cont(pred_probs, 0.975)")} AS q_high
FROM predictions GROUP BY phase, "group" """)
def _(v):
    """Exact quantiles of whole strata, without one buffer per stratum."""
    out = exact_quantiles(v.predictions(), ["phase", "group"], "pred_probs", [0.025, 0.5, 0.975])
    return out.selectExpr("phase", "`group`", "n", "q[0] AS q_low", "q[1] AS q_mid", "q[2] AS q_high")


@query("agg_group_min_max", f"""
SELECT metric || '_' || s AS metric, phase, {r("CASE s WHEN 'min' THEN lo ELSE hi END")} AS performance FROM (
  SELECT metric, phase, min(performance) AS lo, max(performance) AS hi, unnest(['min', 'max']) AS s
  FROM ({metrics_sql(PRED, ["phase", "group"], ["auc", "loss_bce"], rounded=False)}) GROUP BY metric, phase)""")
def _(v):
    return M.min_max_over(M.evaluate(v.predictions(), ["auc", "loss_bce"], ["phase", "group"]), ["phase"])


@query("win_risk_threshold", f"""
SELECT p.phase, p.iter, p.ids, {r("t.threshold")} AS threshold, (p.pred_probs > t.threshold) AS high_risk
FROM predictions p LEFT JOIN (SELECT iter, quantile_cont(pred_probs, 0.9) AS threshold FROM predictions WHERE phase = 'val' GROUP BY iter) t
ON p.iter = t.iter""")
def _(v):
    """Each row with its run's threshold for the top tenth of the validation rows."""
    out = M.risk_thresholds(v.predictions(), 0.1)
    return out.selectExpr("phase", "iter", "ids", "threshold", "pred_probs > threshold AS high_risk")


SHARES = [0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


@query("win_optimal_threshold", f"""
SELECT iter, {r("threshold")} AS threshold, {r("score")} AS ppv_npv FROM (
  SELECT *, row_number() OVER (PARTITION BY iter ORDER BY score DESC, threshold DESC) AS k FROM (
    SELECT iter, threshold, coalesce({threshold_sql("ppv", "pred_probs > threshold")}, 0) + coalesce({threshold_sql("npv", "pred_probs > threshold")}, 0) AS score
    FROM (SELECT *, 1.0::DOUBLE AS w FROM predictions WHERE phase = 'val') JOIN (
      {" UNION ALL ".join(f"SELECT iter, quantile_cont(pred_probs, {1 - s!r}::DOUBLE) AS threshold FROM predictions WHERE phase = 'val' GROUP BY iter" for s in SHARES)})
    USING (iter) GROUP BY iter, threshold)) WHERE k = 1""")
def _(v):
    return M.optimal_thresholds(v.predictions(), SHARES)
