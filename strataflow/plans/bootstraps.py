"""Bootstrap and comparison queries (few replicates; the number is a parameter)."""


from strataflow.operators import bootstrap as B
from strataflow.operators import replicates as R
from strataflow.operators.metrics import mean_over_iterations
from strataflow.plans.evaluation import BEST_SQL, ece_sql
from strataflow.plans.registry import query, r
from strataflow.plans.sqltext import block_draw_views, draw_views, interval_sql, metrics_sql, q

N_BOOT = 10
FAST = ["auc", "loss_bce", "brier"]

AVG_DRAWS = draw_views("predictions", ["phase", "iter"], ["ids"], N_BOOT)


def two_level(src: str, keys, metrics=FAST, rounded=True) -> str:
    fin = r if rounded else (lambda e: e)
    return f"""
SELECT {q(keys)}, metric, {fin("avg(performance)")} AS mean, {fin("stddev_samp(performance)")} AS std
FROM ({metrics_sql(src, [*keys, "iter"], metrics, rounded=False)}) GROUP BY {q(keys)}, metric"""


@query("bs_resample_counts", "SELECT phase, iter, ids, boot_iter, w AS boot_weight FROM drawn", AVG_DRAWS)
def _(v):
    drawn = B.resample_counts(v.predictions(), ["phase", "iter"], ["ids"], N_BOOT)
    return drawn.select("phase", "iter", "ids", B.BOOT, B.WEIGHT)


@query("bs_evaluate_ci", interval_sql(
    f"({metrics_sql('drawn', ['boot_iter', 'phase', 'iter'], FAST + ['auprc'], rounded=False)})", ["metric", "phase", "iter"]), AVG_DRAWS)
def _(v):
    return B.bootstrap_ci(v.predictions(), N_BOOT, ["phase", "iter"], metrics=FAST + ["auprc"])


REPEATED = ["boot_iter", "phase", "iter"]


@query("bs_binned_calibration", " UNION ALL ".join(
    f"SELECT '{m}' AS metric, {q(REPEATED)}, {r('ece_abs')} AS performance FROM ({ece_sql(m == 'ece_q_abs', 'repeated', REPEATED)})"
    for m in ("ece_abs", "ece_q_abs")),
    {**AVG_DRAWS, "repeated": "SELECT * EXCLUDE (k) FROM (SELECT *, unnest(range(1, w::BIGINT + 1)) AS k FROM drawn)"})
def _(v):
    """A row drawn several times counts as so many rows, in quantile edges too."""
    return B.bootstrap(v.predictions(), N_BOOT, ["phase", "iter"], metrics=["ece_abs", "ece_q_abs", "auc"]).where(
        "metric <> 'auc'"
    )


@query("bs_avg", two_level("drawn", ["boot_iter", "phase"]), AVG_DRAWS)
def _(v):
    return B.evaluate_avg(v.predictions(), N_BOOT, metrics=FAST)


ENSEMBLE = """
SELECT boot_iter, phase, row_id, sum(w * pred_probs) / sum(w) AS pred_probs, max(labels) AS labels, 1.0::DOUBLE AS w
FROM drawn_rows GROUP BY boot_iter, phase, row_id"""


@query("bs_ensemble", metrics_sql("ens", ["boot_iter", "phase"], FAST),
       {**draw_views("predictions", ["phase", "iter"], ["row_id"], N_BOOT, "drawn_rows"), "ens": ENSEMBLE})
def _(v):
    return B.evaluate_ensemble(v.predictions(), N_BOOT, metrics=FAST)


BEST_VIEWS = {
    "best_iter": BEST_SQL,
    "best_rows": "SELECT * FROM predictions WHERE iter = (SELECT iter FROM best_iter)",
    **draw_views("best_rows", ["phase"], ["ids"], N_BOOT, "drawn_best"),
}


@query("bs_best", metrics_sql("drawn_best", ["boot_iter", "phase"], FAST), BEST_VIEWS)
def _(v):
    return B.evaluate_best(v.predictions(), N_BOOT, metrics=FAST)


# --- paired comparison ----------------------------------------------------------

PAIRS = {
    "pairs": """
SELECT a.* EXCLUDE (pred_probs, outputs), a.pred_probs AS pred_base, b.pred_probs AS pred_test, b.labels AS labels_test
FROM predictions a JOIN predictions2 b USING (phase, iter, ids)""",
    **draw_views("pairs", ["phase", "iter"], ["ids"], N_BOOT, "drawn_pairs"),
    "sides": """
SELECT * EXCLUDE (pred_base, pred_test), 'base' AS side, pred_base AS pred_probs FROM drawn_pairs
UNION ALL SELECT * EXCLUDE (pred_base, pred_test), 'test', pred_test FROM drawn_pairs""",
}


def difference(rows: str, keys, value="performance") -> str:
    k = f"{q(keys)}," if keys else ""
    side = lambda s: f"max(CASE WHEN side = '{s}' THEN {value} END)"
    return f"""
SELECT {k} metric, {r("a")} AS performance_base, {r("b")} AS performance_test, {r("a - b")} AS performance_diff
FROM (SELECT {k} metric, {side("base")} AS a, {side("test")} AS b FROM ({rows}) GROUP BY {k} metric)"""


@query("jn_paired_predictions", f"""
SELECT phase, iter, ids, {r("pred_base")} AS pred_base, {r("pred_test")} AS pred_test, labels, labels_test FROM pairs""", PAIRS)
def _(v):
    pairs = B.pair_predictions(v.predictions(), v.predictions(15485863), check=True)
    return pairs.select("phase", "iter", "ids", "pred_base", "pred_test", "labels", "labels_test")


@query("bs_compare_avg", difference(two_level("sides", ["side", "boot_iter", "phase"], rounded=False), ["boot_iter", "phase"], "mean"), PAIRS)
def _(v):
    return B.compare_models(v.predictions(), v.predictions(15485863), "avg", n_boot=N_BOOT, metrics=FAST)


@query("bs_compare_ensemble", difference(metrics_sql("ens_sides", ["side", "boot_iter", "phase"], FAST, rounded=False), ["boot_iter", "phase"]), {
    **PAIRS, "ens_sides": """
SELECT side, boot_iter, phase, ids, sum(w * pred_probs) / sum(w) AS pred_probs, max(labels) AS labels, 1.0::DOUBLE AS w
FROM sides GROUP BY side, boot_iter, phase, ids"""})
def _(v):
    return B.compare_models(v.predictions(), v.predictions(15485863), "ensemble", n_boot=N_BOOT, metrics=FAST)


BEST_PAIRS = {
    "best_iter": BEST_SQL,
    "best_iter2": BEST_SQL.replace("FROM predictions ", "FROM predictions2 "),
    "best_pairs": """
SELECT a.phase, a.ids, a.labels, a.pred_probs AS pred_base, b.pred_probs AS pred_test
FROM predictions a JOIN predictions2 b ON a.phase = b.phase AND a.ids = b.ids
WHERE a.iter = (SELECT iter FROM best_iter) AND b.iter = (SELECT iter FROM best_iter2)""",
    **draw_views("best_pairs", ["phase"], ["ids"], N_BOOT, "drawn_bp"),
    "best_sides": """
SELECT phase, boot_iter, labels, w, 'base' AS side, pred_base AS pred_probs FROM drawn_bp
UNION ALL SELECT phase, boot_iter, labels, w, 'test', pred_test FROM drawn_bp""",
}


@query("bs_compare_best", difference(metrics_sql("best_sides", ["side", "boot_iter", "phase"], FAST, rounded=False), ["boot_iter", "phase"]), BEST_PAIRS)
def _(v):
    """Each model's best run, paired by id; draws keep their multiplicity on both sides."""
    return B.compare_models(v.predictions(), v.predictions(15485863), "best", n_boot=N_BOOT, metrics=FAST)


@query("bs_by_group", two_level("drawn_g", ["boot_iter", "phase", "group"]),
       draw_views("predictions", ["phase", "group", "iter"], ["ids"], N_BOOT, "drawn_g"))
def _(v):
    return B.evaluate_avg(v.predictions(), N_BOOT, ["phase", "group"], FAST)


DEMO = {"pred_demo": "SELECT p.*, d.insurance, d.gender, d.language FROM predictions p LEFT JOIN demographics d ON p.ids = d.ids"}


def with_demographics(v, predictions=None):
    rows = v.predictions() if predictions is None else predictions
    return rows.join(v.demographics, "ids", "left")


@query("jn_pred_demographics", f"""
SELECT phase, iter, ids, insurance, gender, language, {r("pred_probs")} AS pred_probs FROM pred_demo""", DEMO)
def _(v):
    return with_demographics(v).select("phase", "iter", "ids", "insurance", "gender", "language", "pred_probs")


@query("bs_by_demographic", two_level("drawn_d", ["boot_iter", "phase", "language"]),
       {**DEMO, **draw_views("pred_demo", ["phase", "language", "iter"], ["ids"], N_BOOT, "drawn_d")})
def _(v):
    """Strata with an attribute; rows without a value are left out."""
    return B.evaluate_avg(with_demographics(v), N_BOOT, ["phase", "language"], FAST)


def compared_by(src: str, by: str) -> tuple[str, dict]:
    """Statement and views of a comparison within phase and one more column of ``src``."""
    keys, name = ["phase", by], f"drawn_by_{by}"
    views = draw_views(src, [*keys, "iter"], ["ids"], N_BOOT, name)
    views[f"sides_by_{by}"] = f"""
SELECT * EXCLUDE (pred_base, pred_test), 'base' AS side, pred_base AS pred_probs FROM {name}
UNION ALL SELECT * EXCLUDE (pred_base, pred_test), 'test', pred_test FROM {name}"""
    rows = two_level(f"sides_by_{by}", ["side", "boot_iter", *keys], rounded=False)
    return difference(rows, ["boot_iter", *keys], "mean"), {**PAIRS, **views}


BY_GROUP_SQL, BY_GROUP_VIEWS = compared_by("pairs", "group")


@query("bs_compare_by_group", BY_GROUP_SQL, BY_GROUP_VIEWS)
def _(v):
    return B.compare_models(
        v.predictions(), v.predictions(15485863), "avg", ["phase", "group"], n_boot=N_BOOT, metrics=FAST
    )


BY_LANGUAGE_SQL, BY_LANGUAGE_VIEWS = compared_by("pairs_demo", "language")


@query("bs_compare_by_demographic", BY_LANGUAGE_SQL, {
    "pairs": PAIRS["pairs"],
    "pairs_demo": "SELECT p.*, d.language FROM pairs p LEFT JOIN demographics d ON p.ids = d.ids",
    **{k: x for k, x in BY_LANGUAGE_VIEWS.items() if k.endswith("by_language") or "drawn_by" in k}})
def _(v):
    """Both models within an attribute; rows without a value are left out."""
    base, test = with_demographics(v), with_demographics(v, v.predictions(15485863))
    return B.compare_models(base, test, "avg", ["phase", "language"], n_boot=N_BOOT, metrics=FAST)


@query("bs_cross_experiment", difference(two_level("cross_sides", ["side", "boot_iter"], rounded=False), ["boot_iter"], "mean"), {
    "xexp": """
SELECT a.iter, a.ids, a.labels, a.pred_probs AS pred_base, b.pred_probs AS pred_test
FROM predictions a JOIN predictions2 b USING (iter, ids) WHERE a.phase = 'test' AND b.phase = 'test' AND a."group" = 3""",
    **draw_views("xexp", ["iter"], ["ids"], N_BOOT, "drawn_c"),
    "cross_sides": """
SELECT boot_iter, iter, labels, w, 'base' AS side, pred_base AS pred_probs FROM drawn_c
UNION ALL SELECT boot_iter, iter, labels, w, 'test', pred_test FROM drawn_c"""})
def _(v):
    return B.compare_across_experiments(v.predictions(), v.predictions(15485863), 3, N_BOOT, FAST)


# --- replicates in blocks ---------------------------------------------------------

#: Small cells and a narrow tree, so that the given tables need several of both.
BLOCK_LEAF, BLOCK_FAN, BLOCK_LEVELS = 256, 3, 12
BLOCK_METRICS = ["auc", "auprc", "loss_bce", "brier", "mean_prediction"]
BLOCK_VIEWS = block_draw_views("predictions", ["phase", "iter"], N_BOOT, BLOCK_LEAF, BLOCK_LEVELS)
BLOCK_SQL = metrics_sql("blocks", REPEATED, BLOCK_METRICS)


@query("bs_block_metrics", f"""{BLOCK_SQL}
UNION ALL SELECT 'n' AS metric, boot_iter, phase, iter, {r("count(*)")} AS performance
FROM predictions, range(1, {N_BOOT + 1}) AS b(boot_iter) GROUP BY ALL""", BLOCK_VIEWS)
def _(v):
    """Every metric of every replicate; ``n``, the rows drawn, is that of the stratum each time."""
    return R.replicate_metrics(v.predictions(), N_BOOT, ["phase", "iter"], leaf=BLOCK_LEAF, fan=BLOCK_FAN)


@query("bs_block_ci", interval_sql(
    f"({metrics_sql('blocks', REPEATED, BLOCK_METRICS, rounded=False)})", ["metric", "phase", "iter"]), BLOCK_VIEWS)
def _(v):
    return R.replicate_intervals(
        v.predictions(), N_BOOT, ["phase", "iter"], metrics=BLOCK_METRICS, leaf=BLOCK_LEAF, fan=BLOCK_FAN
    )


# --- all attributes at once -------------------------------------------------------

ATTRIBUTES = {
    **{a: a for a in ("insurance", "marital_status", "ethnicity", "language", "gender")},
    "age": B.age_band("age"),
}
BY_VALUE = ["phase", "attribute", "value"]


def stacked_sql(src: str, columns: str) -> str:
    each = " UNION ALL ".join(f"SELECT {columns}, '{n}' AS attribute, ({e})::VARCHAR AS value FROM w" for n, e in ATTRIBUTES.items())
    return f"WITH w AS (SELECT p.*, d.* EXCLUDE (ids) FROM {src} p JOIN demographics d ON p.ids = d.ids) SELECT * FROM ({each}) WHERE value IS NOT NULL"


def by_attribute(v):
    return B.stack_attributes(with_demographics(v), ATTRIBUTES, ["phase", "iter", "ids", "labels", "pred_probs"])


@query("bs_by_attributes", two_level("attr_blocks", ["boot_iter", *BY_VALUE], BLOCK_METRICS), {
    "pred_attr": stacked_sql("predictions", "phase, iter, ids, labels, pred_probs"),
    **block_draw_views("pred_attr", [*BY_VALUE, "iter"], N_BOOT, BLOCK_LEAF, BLOCK_LEVELS, "attr_blocks")})
def _(v):
    """Replicates within every value of all six attributes, in blocks: mean and deviation over the runs."""
    metrics = R.replicate_metrics(
        by_attribute(v), N_BOOT, [*BY_VALUE, "iter"], BLOCK_METRICS, leaf=BLOCK_LEAF, fan=BLOCK_FAN
    )
    return mean_over_iterations(metrics, ["boot_iter", *BY_VALUE])


@query("bs_compare_by_attributes", difference(
    two_level("attr_sides", ["side", "boot_iter", *BY_VALUE], rounded=False), ["boot_iter", *BY_VALUE], "mean"), {
    "pairs": PAIRS["pairs"],
    "pairs_attr": stacked_sql("pairs", "phase, iter, ids, labels, pred_base, pred_test"),
    **draw_views("pairs_attr", [*BY_VALUE, "iter"], ["ids"], N_BOOT, "drawn_attr"),
    "attr_sides": """
SELECT * EXCLUDE (pred_base, pred_test), 'base' AS side, pred_base AS pred_probs FROM drawn_attr
UNION ALL SELECT * EXCLUDE (pred_base, pred_test), 'test', pred_test FROM drawn_attr"""})
def _(v):
    """Both models within every value of all six attributes."""
    base, test = with_demographics(v), with_demographics(v, v.predictions(15485863))
    return B.compare_models(base, test, "avg", BY_VALUE, n_boot=N_BOOT, metrics=FAST, attributes=ATTRIBUTES)
