"""Calibration curves per stratum and the errors derived from them.

A logistic curve is fitted for all strata at once by Newton steps: one step is
one aggregation of five sums per stratum. Rows collapse to distinct
(stratum, score) points first. Lineage is cut every few steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.functions.scalar import CLIP
from strataflow.operators.metrics import NEGATIVE, POSITIVE, C, P, W, keyed, prepare, variant_sql
from strataflow.operators.running import attach, exact_quantiles, quoted
from strataflow.session import cut_lineage, without_summary

# Names of the absolute calibration errors as
# name -> (variant, curve, transform of the score).
ACE_METRICS = {
    f"ace_{variant}_{model}_{transform}": (variant, model, None if transform == "none" else transform)
    for variant in ("abs", "rmse", "signed", "squared")
    for model in ("logistic", "bin")
    for transform in ("log", "none")
}
# Tolerance of the bin lookup, absolute and relative.
BIN_ATOL, BIN_RTOL = 1e-8, 1e-5
# Input of the curve for a score ``__p``.
TRANSFORMS = {
    None: P,
    "log": f"ln({P})",
    "c_log_log": f"ln(-ln(1D - {P}))",
    "logit": f"ln({P} / (1D - {P}))",
}

STEPS_PER_ROUND = 4
TOLERANCE = 1e-10

_SIGMOID = "1D / (1D + exp(-({})))"


def _inside(transform: str | None) -> str:
    return "TRUE" if transform is None else f"{P} > {CLIP!r}D AND {P} < 1D - {CLIP!r}D"


def score_points(base: DataFrame, keys: Sequence[str], transform: str | None) -> DataFrame:
    """Distinct scores per key with weights ``w1`` (label 1) and ``w0`` and the input ``x``."""
    sums = [F.expr(f"sum({POSITIVE}) AS w1"), F.expr(f"sum({NEGATIVE}) AS w0")]
    points = base.where(_inside(transform)).groupBy(*keys, P).agg(*sums).where("w1 + w0 > 0")
    return points.withColumn("x", F.expr(TRANSFORMS[transform]))


def fit_logistic(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, intercept, slope, converged``: unpenalised maximum likelihood.

    A maximum exists exactly if the inputs of the two classes overlap; strata with one
    class, one distinct input or separable classes get NULL. Steps run on standardised
    input until all strata stand still. A step that lowers the likelihood is halved,
    so every stratum comes to its end.
    """
    k = [quoted(c) for c in keys]
    scale = points.groupBy(*keys).agg(
        F.expr("sum(w1) AS n1"),
        F.expr("sum(w0) AS n0"),
        F.expr("sum((w1 + w0) * x) / sum(w1 + w0) AS mx"),
        F.expr("sum((w1 + w0) * x * x) / sum(w1 + w0) AS mxx"),
        *[F.expr(f"{f}(CASE WHEN w{y} > 0 THEN x END) AS {f}{y}") for f in ("min", "max") for y in (0, 1)],
    )
    usable = "n1 > 0 AND n0 > 0 AND max0 > min1 AND max1 > min0"
    coefs = scale.selectExpr(
        *k,
        "mx",
        "CASE WHEN mxx > mx * mx THEN sqrt(mxx - mx * mx) ELSE 1D END AS sx",
        f"CASE WHEN {usable} THEN ln(n1) - ln(n0) END AS a",
        f"CASE WHEN {usable} THEN 0D END AS b",
        "CAST(NULL AS DOUBLE) AS best_a",
        "CAST(NULL AS DOUBLE) AS best_b",
        "CAST(NULL AS DOUBLE) AS best",
        f"CASE WHEN {usable} THEN 1D END AS move",
    )
    while True:
        for _ in range(STEPS_PER_ROUND):
            coefs = _newton_step(points, coefs, list(keys))
        coefs = cut_lineage(coefs)
        if (coefs.agg(F.max("move")).first()[0] or 0.0) < TOLERANCE:
            break
    return coefs.selectExpr(
        *k, "a - b / sx * mx AS intercept", "b / sx AS slope", f"coalesce(move < {TOLERANCE!r}D, false) AS converged"
    )


_STATE = ("mx", "sx", "a", "b", "best_a", "best_b", "best")
# sum of w * ln(p) without overflow, t the log odds
_LIKELIHOOD = "sum(-w1 * greatest(-t, 0D) - w0 * greatest(t, 0D) - n * log1p(exp(-abs(t))))"


def _newton_step(points: DataFrame, coefs: DataFrame, keys: list[str]) -> DataFrame:
    """One step for every key; coefficients ride along, so a step is one join and one aggregation."""
    rows = attach(points, coefs, keys).selectExpr(
        *map(quoted, keys), *_STATE, "w1", "w0", "w1 + w0 AS n", "(x - mx) / sx AS z"
    )
    rows = rows.withColumn("t", F.expr("a + b * z")).withColumn("p", F.expr(_SIGMOID.format("t")))
    sums = rows.groupBy(*keys).agg(
        *[F.expr(f"first({c}) AS {c}") for c in _STATE],
        F.expr("sum(w1 - n * p) AS g0"),
        F.expr("sum((w1 - n * p) * z) AS g1"),
        F.expr("sum(n * p * (1D - p)) AS h00"),
        F.expr("sum(n * p * (1D - p) * z) AS h01"),
        F.expr("sum(n * p * (1D - p) * z * z) AS h11"),
        F.expr(f"{_LIKELIHOOD} AS now"),
    )
    det = "(h00 * h11 - h01 * h01)"
    step = sums.selectExpr(
        *map(quoted, keys),
        *_STATE,
        "now",
        "best IS NULL OR now >= best - 1e-13D * abs(best) AS better",
        "best IS NOT NULL AND abs(now - best) <= 1e-13D * abs(best) AS level",
        f"try_divide(g0 * h11 - g1 * h01, {det}) AS da",
        f"try_divide(h00 * g1 - h01 * g0, {det}) AS db",
    ).withColumn("far", F.expr("sqrt(da * da + db * db)"))
    damp = "CASE WHEN far > 4D THEN 4D / far ELSE 1D END"
    # what stands level with the best and would hardly move is done
    move = "CASE WHEN NOT better THEN sqrt((a - best_a) * (a - best_a) + (b - best_b) * (b - best_b)) / 2 WHEN level AND far < 1e-6D THEN 0D ELSE far END"
    return step.selectExpr(
        *map(quoted, keys),
        "mx",
        "sx",
        f"CASE WHEN better THEN a + {damp} * da ELSE (a + best_a) / 2 END AS a",
        f"CASE WHEN better THEN b + {damp} * db ELSE (b + best_b) / 2 END AS b",
        "IF(better, a, best_a) AS best_a",
        "IF(better, b, best_b) AS best_b",
        "IF(better, now, best) AS best",
        f"{move} AS move",
    )


def bin_edges(base: DataFrame, keys: Sequence[str], transform: str | None, n_bins: int = 10) -> DataFrame:
    """``keys, edges``: inner edges of quantile bins over the unweighted rows.

    Bins narrower than 1e-8 are merged; the first and last bin are open.
    """
    rows = base.where(f"{_inside(transform)} AND {W} > 0").withColumn("x", F.expr(TRANSFORMS[transform]))
    q = exact_quantiles(rows, keys, "x", [i / n_bins for i in range(n_bins + 1)], C)
    wide = f"filter(slice(q, 2, {n_bins}), (e, i) -> e - q[i] > {BIN_ATOL!r}D)"
    q = q.withColumn("ends", F.expr(wide))
    return q.selectExpr(
        *map(quoted, keys),
        "CASE WHEN size(ends) > 1 THEN slice(ends, 1, size(ends) - 1) ELSE CAST(array() AS ARRAY<DOUBLE>) END AS edges",
    )


_BIN = f"size(filter(edges, e -> e <= x + {BIN_ATOL!r}D + {BIN_RTOL!r}D * abs(x)))"


def curve(
    points: DataFrame, base: DataFrame, keys: Sequence[str], model: str, transform: str | None, n_bins: int = 10
) -> DataFrame:
    """Points with ``density``, the fitted chance of label 1 at the score."""
    keys, columns = list(keys), [quoted(c) for c in points.columns]
    if model == "logistic":
        fitted = attach(points, fit_logistic(points, keys), keys)
        return fitted.selectExpr(*columns, f"{_SIGMOID.format('intercept + slope * x')} AS density")
    if model == "bin":
        placed = attach(points, bin_edges(base, keys, transform, n_bins), keys).selectExpr(*columns, f"{_BIN} AS bin")
        means = placed.groupBy(*keys, "bin").agg(F.expr("try_divide(sum(w1), sum(w1 + w0)) AS density"))
        return placed.join(means, [*keys, "bin"]).selectExpr(*columns, "density")
    raise ValueError(f"curve {model!r} is not known")


def calibration_density(
    df: DataFrame,
    strata: Sequence[str] = (),
    model: str = "logistic",
    transform: str | None = None,
    label: str = "labels",
    pred: str = "pred_probs",
    weight: str | None = None,
) -> DataFrame:
    """``strata, pred_probs, w1, w0, model_input, density`` per distinct score."""
    base, keys = keyed(prepare(df, strata, label, pred, weight), strata)
    points = cut_lineage(score_points(base, keys, transform))
    return curve(points, base, keys, model, transform).selectExpr(
        *map(quoted, strata), f"{P} AS pred_probs", "w1", "w0", "x AS model_input", "density"
    )


def _error(diff: str, variant: str, w: str = "(w1 + w0)") -> str:
    value = f"try_divide(sum({w} * {variant_sql(diff, variant)}), sum({w}))"
    return f"sqrt({value})" if variant == "rmse" else value


def absolute_errors(base: DataFrame, strata: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide frame of the named errors; each curve is fitted once for all its variants."""
    rows, keys = keyed(base, strata)
    curves: dict[tuple, list[str]] = {}
    for n in metrics:
        curves.setdefault(ACE_METRICS[n][1:], []).append(n)
    out, points = None, {}
    for (model, transform), chosen in curves.items():
        if transform not in points:
            points[transform] = cut_lineage(score_points(rows, keys, transform))
        fitted = curve(points[transform], rows, keys, model, transform)
        part = fitted.groupBy(*keys).agg(
            *[F.expr(f"{_error(f'density - {P}', ACE_METRICS[n][0])} AS {n}") for n in chosen]
        )
        out = part if out is None else out.join(part, keys, "full")
    return out if strata else out.drop("__all")


def relative_calibration_error(
    df: DataFrame,
    group: str,
    strata: Sequence[str] = (),
    variant: str = "abs",
    model: str = "logistic",
    transform: str | None = None,
    compute_ace: bool = False,
    label: str = "labels",
    pred: str = "pred_probs",
    weight: str | None = None,
) -> DataFrame:
    """Group curve minus overall curve on the group's rows, per group."""
    base, keys = keyed(prepare(df, strata, label, pred, weight, keep=[group]), strata)
    base = base.where(f"{quoted(group)} IS NOT NULL")
    gkeys = [*keys, group]
    gpoints = cut_lineage(score_points(base, gkeys, transform))
    points = gpoints.groupBy(*keys, P, "x").agg(F.expr("sum(w1) AS w1"), F.expr("sum(w0) AS w0"))
    own = curve(gpoints, base, gkeys, model, transform)
    overall = curve(points, base, keys, model, transform)
    both = own.join(overall.selectExpr(*map(quoted, keys), P, "density AS all_density"), [*keys, P])
    aggs = [F.expr(f"{_error('density - all_density', variant)} AS relative_calibration_error")]
    if compute_ace:
        aggs.append(F.expr(f"{_error(f'density - {P}', variant)} AS absolute_calibration_error"))
    return both.groupBy(*gkeys).agg(*aggs).drop("__all")


def cox_calibration(
    df: DataFrame, strata: Sequence[str] = (), label: str = "labels", pred: str = "pred_probs", weight: str | None = None
) -> DataFrame:
    """``strata, cox_intercept, cox_slope``: logistic fit on the log odds of the score."""
    base, keys = keyed(prepare(df, strata, label, pred, weight), strata)
    points = cut_lineage(score_points(base, keys, "logit"))
    return fit_logistic(points, keys).selectExpr(
        *map(quoted, strata), "intercept AS cox_intercept", "slope AS cox_slope", "converged"
    )


def forest_calibration_error(
    df: DataFrame,
    variant: str = "abs",
    transform: str | None = None,
    label: str = "labels",
    pred: str = "pred_probs",
    seed: int = 44,
    num_trees: int = 100,
) -> DataFrame:
    """Absolute calibration error against a random forest of score -> label."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    base, keys = keyed(prepare(df, (), label, pred), ())
    # one row per (score, label) with its weight instead of the rows themselves
    points = score_points(base, keys, transform).selectExpr(P, "x", "stack(2, 1D, w1, 0D, w0) AS (y, w)").where("w > 0")
    rows = cut_lineage(points)
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    forest = RandomForestClassifier(labelCol="y", weightCol="w", seed=seed, numTrees=num_trees, maxDepth=10)
    fitted = without_summary(rows.sparkSession, forest.fit(rows))
    scored = fitted.transform(rows).withColumn("density", vector_to_array("probability")[1])
    value = _error(f"density - {P}", variant, "w")
    return scored.agg(F.expr(f"{value} AS performance")).selectExpr(f"'ace_{variant}_rf' AS metric", "performance")
