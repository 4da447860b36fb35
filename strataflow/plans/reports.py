"""Report queries: intervals, marks, text tables."""

from pyspark.sql import functions as F

from strataflow.operators import bootstrap as B
from strataflow.operators import cohort as C
from strataflow.operators import metrics as M
from strataflow.operators import reporting as R
from strataflow.plans.bootstraps import AVG_DRAWS, DEMO, FAST, N_BOOT, PAIRS, two_level, with_demographics
from strataflow.plans.cohorts import long_stay
from strataflow.plans.registry import query, r
from strataflow.plans.sqltext import draw_views, interval_sql, metrics_sql, q, threshold_sql, weighted
from strataflow.session import scratch_path
from strataflow.sources import tables as IO
from strataflow.sources.fixtures import VARIANTS, YEAR_GROUPS

#: Replicates of an interval: what the operators take where no number is given.
REPLICATES = 1000

EVAL = two_level("drawn", ["boot_iter", "phase"], rounded=False)


def raw_difference(rows: str, keys, value="performance") -> str:
    """Unrounded differences, for quantiles."""
    k = q(keys)
    side = lambda s: f"max(CASE WHEN side = '{s}' THEN {value} END)"
    return f"SELECT {k}, metric, {side('base')} - {side('test')} AS performance_diff FROM ({rows}) GROUP BY {k}, metric"


DIFF = raw_difference(two_level("sides", ["side", "boot_iter", "phase"], rounded=False), ["boot_iter", "phase"], "mean")
ALL_DIFF = raw_difference(two_level("all_sides", ["side", "boot_iter", "phase"], rounded=False), ["boot_iter", "phase"], "mean")
ALL_PAIRS = {
    "pairs": PAIRS["pairs"],
    **draw_views("pairs", ["phase", "iter"], ["ids"], REPLICATES, "all_pairs"),
    "all_sides": PAIRS["sides"].replace("drawn_pairs", "all_pairs"),
}


def eval_ci(v):
    return R.collect_ci(B.evaluate_avg(v.predictions(), N_BOOT, metrics=FAST), ["phase", "metric"], "mean")


def compare_ci(v, n_boot=REPLICATES):
    rows = B.compare_models(v.predictions(), v.predictions(15485863), "avg", n_boot=n_boot, metrics=FAST)
    return R.collect_ci(rows, ["phase", "metric"], "performance_diff")


@query("rpt_ci_evaluation", interval_sql(f"({EVAL})", ["phase", "metric"], "mean", 0.01), AVG_DRAWS)
def _(v):
    return eval_ci(v)


@query("rpt_ci_comparison", interval_sql(f"({ALL_DIFF})", ["phase", "metric"], "performance_diff", 0.01), ALL_PAIRS)
def _(v):
    return compare_ci(v)


@query("rpt_significance", f"""
SELECT phase, metric, {r("lo")} AS ci_lower, {r("med")} AS ci_med, {r("hi")} AS ci_upper, CASE WHEN lo * hi > 0 THEN '*' ELSE '' END AS sig
FROM (SELECT phase, metric, quantile_cont(performance_diff, 0.005) AS lo, quantile_cont(performance_diff, 0.5) AS med,
             quantile_cont(performance_diff, 0.995) AS hi FROM ({ALL_DIFF}) GROUP BY phase, metric)""", ALL_PAIRS)
def _(v):
    return R.significance(compare_ci(v))


@query("rpt_join_significance", f"""
SELECT e.*, coalesce(s.sig, '') AS sig FROM ({interval_sql(f"({EVAL})", ["phase", "metric"], "mean", 0.01)}) e
LEFT JOIN (SELECT phase, metric, CASE WHEN quantile_cont(performance_diff, 0.005) * quantile_cont(performance_diff, 0.995) > 0
                  THEN '*' ELSE '' END AS sig FROM ({DIFF}) WHERE metric <> 'brier' GROUP BY phase, metric) s
ON e.phase = s.phase AND e.metric = s.metric""", {**AVG_DRAWS, **PAIRS})
def _(v):
    """One metric has no comparison: its mark is empty."""
    return R.join_significance(eval_ci(v), compare_ci(v, N_BOOT).where("metric <> 'brier'"), ["phase", "metric"])


@query("rpt_ci_demographic", interval_sql(f"({two_level('drawn_d', ['boot_iter', 'phase', 'gender'], rounded=False)})", ["phase", "gender", "metric"], "mean", 0.01),
       {**DEMO, **draw_views("pred_demo", ["phase", "gender", "iter"], ["ids"], N_BOOT, "drawn_d")})
def _(v):
    rows = B.evaluate_avg(with_demographics(v), N_BOOT, ["phase", "gender"], FAST)
    return R.collect_ci(rows, ["phase", "gender", "metric"], "mean")


# --- training methods by group, lambda and target rows ----------------------------

VKEYS = ["train_method", "lambda", "n_ood", "group"]
VBOOT = 5
VMETRICS = ["auc", "brier"]
VARIANT_VIEWS = {
    **draw_views("variants", VKEYS, ["ids"], REPLICATES, "drawn_v"),
    "variant_ci": interval_sql(
        f"({metrics_sql('drawn_v', ['boot_iter', *VKEYS], VMETRICS, rounded=False)})", [*VKEYS, "metric"], alpha=0.01, rounded=False
    ),
    "vpairs": f"""
SELECT a.train_method, a."lambda", a.n_ood, a."group", a.ids, a.labels, a.pred_probs AS pred_base, b.pred_probs AS pred_test
FROM variants a JOIN variants b ON a.ids = b.ids AND a."group" = b."group"
WHERE a.train_method NOT IN ('erm', 'oracle') AND b.train_method = 'erm'""",
    **draw_views("vpairs", VKEYS, ["ids"], REPLICATES, "drawn_vp"),
    "vsides": """
SELECT * EXCLUDE (pred_base, pred_test), 'base' AS side, pred_base AS pred_probs FROM drawn_vp
UNION ALL SELECT * EXCLUDE (pred_base, pred_test), 'test', pred_test FROM drawn_vp""",
}
VSIG = f"""
SELECT {q(VKEYS)}, metric, CASE WHEN quantile_cont(performance_diff, 0.005) * quantile_cont(performance_diff, 0.995) > 0 THEN '*' ELSE '' END AS sig
FROM ({raw_difference(metrics_sql('vsides', ['side', 'boot_iter', *VKEYS], VMETRICS, rounded=False), ['boot_iter', *VKEYS])}) GROUP BY {q(VKEYS)}, metric"""


def variant_ci(v):
    return R.collect_ci(B.bootstrap(v.variants, REPLICATES, VKEYS, metrics=VMETRICS), [*VKEYS, "metric"])


def variant_comparison(v):
    erm = v.variants.where("train_method = 'erm'").selectExpr(
        "ids", "`group`", "pred_probs AS pred_test", "labels AS labels_test"
    )
    rest = v.variants.where("train_method NOT IN ('erm', 'oracle')").withColumnRenamed("pred_probs", "pred_base")
    rows = B.compare_pairs(rest.join(erm, ["ids", "group"]), VKEYS, REPLICATES, VMETRICS)
    return R.collect_ci(rows, [*VKEYS, "metric"], "performance_diff")


@query("rpt_ci_group", f"""
SELECT {q(VKEYS)}, metric, {r("ci_lower")} AS ci_lower, {r("ci_med")} AS ci_med, {r("ci_upper")} AS ci_upper FROM variant_ci""", VARIANT_VIEWS)
def _(v):
    return variant_ci(v)


CELLS = [(0, "ERM"), (0, "IRM"), (0, "CORAL"), (100, "AL"), (500, "CORAL"), (1000, "AL")]


def cell_sql(n: int, method: str) -> str:
    name = f"{n} | {method}"
    return f"""coalesce(max(CASE WHEN heading = '{name}' THEN txt END), ' ') AS "{name}" """


@query("rpt_results_table", f"""
SELECT year_group, metric, {", ".join(cell_sql(*c) for c in CELLS)} FROM (
  SELECT CASE c."group" WHEN 0 THEN 'early years' ELSE 'late years' END AS year_group,
         CASE c.metric WHEN 'auc' THEN 'AUROC' ELSE c.metric END AS metric,
         c.n_ood || ' | ' || CASE c.train_method WHEN 'erm' THEN 'ERM' WHEN 'irm' THEN 'IRM' WHEN 'coral' THEN 'CORAL'
                             WHEN 'al_layer' THEN 'AL' ELSE c.train_method END AS heading,
         printf('%.3f%s (%.3f,%.3f)', ci_med, coalesce(s.sig, ''), ci_lower, ci_upper) AS txt
  FROM variant_ci c LEFT JOIN ({VSIG}) s ON c.train_method = s.train_method AND c."lambda" = s."lambda" AND c.n_ood = s.n_ood
       AND c."group" = s."group" AND c.metric = s.metric)
GROUP BY year_group, metric""", VARIANT_VIEWS)
def _(v):
    """Median with mark and interval; a listed combination without results is blank."""
    marked = R.join_significance(variant_ci(v), variant_comparison(v), [*VKEYS, "metric"])
    groups = F.expr("CASE `group` WHEN 0 THEN 'early years' ELSE 'late years' END")
    return R.results_table(
        marked.withColumn("year_group", groups),
        ["year_group", "metric"],
        ["n_ood", "train_method"],
        CELLS,
        {"metric": R.METRIC_LABELS, "train_method": R.METHOD_LABELS},
    )


@query("rpt_lambda_sweep", f"""
SELECT c.train_method, c."lambda", c.n_ood, c."group", c.metric, bound,
       {r("CASE bound WHEN 'ci_lower' THEN c.ci_lower WHEN 'ci_med' THEN c.ci_med ELSE c.ci_upper END")} AS performance,
       {r("e.ci_med")} AS erm_level, {r("o.ci_med")} AS oracle_level
FROM (SELECT *, unnest(['ci_lower', 'ci_med', 'ci_upper']) AS bound FROM variant_ci WHERE "lambda" <> -1) c
LEFT JOIN (SELECT * FROM variant_ci WHERE train_method = 'erm') e ON c."group" = e."group" AND c.metric = e.metric
LEFT JOIN (SELECT * FROM variant_ci WHERE train_method = 'oracle') o ON c."group" = o."group" AND c.metric = o.metric""", VARIANT_VIEWS)
def _(v):
    ci = IO.read_or_compute(v.spark, scratch_path(v.spark, "variant_ci"), lambda: variant_ci(v))
    base, oracle = ci.where("train_method = 'erm'"), ci.where("train_method = 'oracle'")
    return R.lambda_sweep(ci, [*VKEYS, "metric"], base, oracle, ["group", "metric"])


YKEYS = ["train_group", "eval_group"]


@query("rpt_year_series", f"""
SELECT train_group, eval_group, metric, series, {r("ci_med")} AS ci_med, {r("abs(ci_lower - ci_med)")} AS err_low, {r("abs(ci_upper - ci_med)")} AS err_high
FROM (SELECT *, unnest(list_filter([CASE WHEN train_group = 0 THEN 'base' END, CASE WHEN train_group = eval_group THEN 'retrained' END], lambda x: x IS NOT NULL)) AS series
      FROM ({interval_sql(f"({metrics_sql('drawn_y', ['boot_iter', *YKEYS], VMETRICS, rounded=False)})", [*YKEYS, "metric"], alpha=0.01, rounded=False)}))""",
       draw_views("year_models", YKEYS, ["ids"], VBOOT, "drawn_y"))
def _(v):
    ci = R.collect_ci(B.bootstrap(v.year_models, VBOOT, YKEYS, metrics=VMETRICS), [*YKEYS, "metric"])
    return R.year_series(ci, 0).select(*YKEYS, "metric", "series", "ci_med", "err_low", "err_high")


# --- description tables -------------------------------------------------------------

DESCRIBE = """
SELECT group_var, unnest([
  {'k': 'Sample Size', 't': printf('%d (%.1f%%)', n, n_pos * 100.0::DOUBLE / n)},
  {'k': 'Age', 't': printf('%.0f±%.0f', age_mean, age_sd)},
  {'k': 'Gender (Female)', 't': printf('%d (%.0f%%)', f, f * 100.0::DOUBLE / n)},
  {'k': 'Gender (Male)', 't': printf('%d (%.0f%%)', n - f, (n - f) * 100.0::DOUBLE / n)},
  {'k': 'Ethnicity (White)', 't': printf('%d (%.0f%%)', w, w * 100.0::DOUBLE / n)},
  {'k': 'Ethnicity (Non-white)', 't': printf('%d (%.0f%%)', n - w, (n - w) * 100.0::DOUBLE / n)}]) AS x
FROM (SELECT group_var, count(*) AS n, sum(label) AS n_pos, avg(age) AS age_mean, stddev_samp(age) AS age_sd,
             count(*) FILTER (gender = 'F') AS f, count(*) FILTER (ethnicity = 'WHITE') AS w
      FROM described GROUP BY group_var)"""
DESCRIBED = {"described": """SELECT * REPLACE (CASE WHEN ethnicity = 'BUILDING' THEN 'WHITE' ELSE ethnicity END AS ethnicity) FROM cohort_demographics"""}


def described(v):
    demo = C.demographics(long_stay(v), v.admissions, v.patients)
    return demo.withColumn("ethnicity", F.expr("CASE WHEN ethnicity = 'BUILDING' THEN 'WHITE' ELSE ethnicity END"))


@query("rpt_cohort_descriptives", f"""
SELECT x.k AS variable, {", ".join(f"max(CASE WHEN group_var = '{g}' THEN x.t END) AS \"{g}\"" for g in YEAR_GROUPS)}
FROM ({DESCRIBE}) GROUP BY x.k""", DESCRIBED)
def _(v):
    return R.cohort_descriptives(described(v), YEAR_GROUPS)


@query("rpt_melt_pivot", f"""
SELECT group_var, {", ".join(f"max(CASE WHEN x.k = '{k}' THEN x.t END) AS \"{k}\"" for k in R.DESCRIPTION_ORDER)}
FROM ({DESCRIBE}) GROUP BY group_var""", DESCRIBED)
def _(v):
    """Wide counts to long text rows and back to one column per variable."""
    melted = R.melt_description(R.group_counts(described(v)))
    return melted.groupBy("group_var").pivot("variable", list(R.DESCRIPTION_ORDER)).agg(F.first("value"))


THRESHOLDS = [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45]
PREVALENCE, N_PATIENTS = 0.34, 100


def clinical_sql() -> str:
    pos = float(round(N_PATIENTS * PREVALENCE))
    neg = N_PATIENTS - pos
    cells = []
    for t in THRESHOLDS:
        se, sp = (threshold_sql(m, f"pred_probs > {t}::DOUBLE") for m in ("sensitivity", "specificity"))
        cells.append(f"SELECT model, iter, '{t}' AS t, {se} AS se, {sp} AS sp FROM {weighted('two_models')} GROUP BY model, iter")
    counts = f"""
SELECT *, {pos}::DOUBLE - tp AS fn, {neg}::DOUBLE - tn AS fp FROM (
  SELECT model, t, avg(se) AS se, avg(sp) AS sp, round_even({pos}::DOUBLE * avg(se), 0) AS tp, round_even({neg}::DOUBLE * avg(sp), 0) AS tn
  FROM ({" UNION ALL ".join(cells)}) GROUP BY model, t)"""
    measures = {
        "Sensitivity": "round(se, 2)", "Specificity": "round(sp, 2)", "PPV": "round(tp / nullif(tp + fp, 0), 2)",
        "NPV": "round(tn / nullif(tn + fn, 0), 2)", "TP": "tp", "TN": "tn", "FP": "fp", "FN": "fn",
    }
    long = " UNION ALL ".join(f"SELECT model, t, '{m}' AS \"Metric\", {e} AS v FROM cc" for m, e in measures.items())
    cols = ", ".join(f"""{r(f"max(CASE WHEN t = '{t}' THEN v END)")} AS "t_{str(t).replace('.', '_')}" """ for t in THRESHOLDS)
    return f"""WITH_CC {counts} END_CC SELECT "Metric", model, {cols} FROM ({long}) GROUP BY "Metric", model"""


_COUNTS, _REST = clinical_sql().removeprefix("WITH_CC ").split(" END_CC ")


@query("rpt_clinical_counts", _REST, {
    "two_models": "SELECT *, 'base' AS model FROM predictions WHERE phase = 'test' UNION ALL SELECT *, 'retrained' FROM predictions2 WHERE phase = 'test'",
    "cc": _COUNTS})
def _(v):
    test = lambda k, name: v.predictions(k).where("phase = 'test'").withColumn("model", F.lit(name))
    both = test(7919, "base").unionByName(test(15485863, "retrained"))
    counts = R.clinical_counts(both, "model", THRESHOLDS, PREVALENCE, N_PATIENTS)
    return R.clinical_table(counts, "model", THRESHOLDS)


# --- results in files -----------------------------------------------------------------

FILE_SCHEMA = "metric string, `group` int, performance double"


def write_results(v) -> str:
    """One CSV folder per method and lambda, as an evaluation run leaves them."""
    root = scratch_path(v.spark, "results")
    results = M.evaluate(v.variants, ["brier", "loss_bce"], VKEYS).persist()
    for method, lam, n_ood, _ in VARIANTS:
        name = f"nn_{method}_lambda_{lam}_{n_ood}_avg" if lam >= 0 else f"nn_{method}_{n_ood}_avg"
        part = results.where(f"train_method = '{method}' AND lambda = {lam!r}D AND n_ood = {n_ood}")
        IO.write_csv(part.select("metric", "group", "performance"), f"{root}/{name}")
    results.unpersist()
    return root


def files_sql(where: str) -> str:
    name = "'nn_' || train_method || CASE WHEN \"lambda\" >= 0 THEN '_lambda_' || \"lambda\"::VARCHAR ELSE '' END || '_' || n_ood || '_avg'"
    return f"SELECT metric, \"group\", performance, file_name FROM (SELECT *, {name} AS file_name FROM ({metrics_sql(weighted('variants'), VKEYS, ['brier', 'loss_bce'])})) WHERE {where}"


@query("rpt_collect_files", files_sql("file_name LIKE '%coral%' AND file_name LIKE '%avg%'"))
def _(v):
    return R.collect_files(v.spark, write_results(v), FILE_SCHEMA, ["coral", "avg"])


@query("rpt_lambda_from_name", f"SELECT metric, \"group\", performance, CASE WHEN position('lambda' IN file_name) > 0 THEN regexp_extract(file_name, 'lambda_([^_]+)', 1)::DOUBLE ELSE -1 END AS \"lambda\" FROM ({files_sql('TRUE')})")
def _(v):
    rows = R.collect_files(v.spark, write_results(v), FILE_SCHEMA)
    return rows.withColumn("lambda", R.lambda_from_name(F.col("file_name"))).drop("file_name")
