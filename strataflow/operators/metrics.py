"""Weighted evaluation metrics per stratum, in long form.

Metrics come in families that share one pass: sums over rows, fixed cut
points, ranks over distinct scores, and binned calibration. Every metric takes
weights and counts, so a bootstrap replicate is one more stratum: a count says how
often a row is there, which also moves quantile edges; a weight only weighs it.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from strataflow.functions.scalar import CLIP, ratio
from strataflow.operators.running import ALL, attach, exact_quantiles, quoted, running_sums, score_bucket

# Metric names and default sets, cut points of the *_at metrics,
# and the marks for metrics that one-class strata leave undefined.
DEFAULT_METRICS = ("auc", "auprc", "loss_bce", "ace_rmse_logistic_log", "ace_abs_logistic_log")
DEFAULT_THRESHOLD_METRICS = ("ppv", "npv", "sensitivity", "specificity")
THRESHOLD_METRICS = ("sensitivity", "specificity", "ppv", "npv", "fpr", "fnr", "fdr")
FIXED_THRESHOLDS = (0.01, 0.05, 0.1, 0.2, 0.5)
AUC_UNDEFINED = -1.0
LOSS_UNDEFINED = 1e18

Y, P, W, T, C = "__y", "__p", "__w", "__t", "__c"


def prepare(
    df: DataFrame,
    strata: Sequence[str] = (),
    label: str = "labels",
    pred: str = "pred_probs",
    weight: str | None = None,
    threshold: str | None = None,
    keep: Sequence[str] = (),
    count: str | None = None,
) -> DataFrame:
    """Strata, label, score, weight, count under fixed names; rows without a stratum or score are left out.

    ``count`` names the column that says how many rows a row stands for; ``weight`` is that of each.
    """
    times = f" * CAST({quoted(count)} AS DOUBLE)" if count else ""
    out = df.selectExpr(
        *map(quoted, strata),
        *[quoted(k) for k in keep if k not in strata],
        f"CAST({quoted(label)} AS INT) AS {Y}",
        f"CAST({quoted(pred)} AS DOUBLE) AS {P}",
        (f"CAST({quoted(weight)} AS DOUBLE)" if weight else "1D") + f"{times} AS {W}",
        f"CAST({quoted(count)} AS BIGINT) AS {C}" if count else f"1L AS {C}",
        *([f"CAST({quoted(threshold)} AS DOUBLE) AS {T}"] if threshold else []),
    )
    tests = [f"{P} IS NOT NULL", f"NOT isnan({P})", f"{Y} IS NOT NULL", *[f"{quoted(s)} IS NOT NULL" for s in strata]]
    return out.where(" AND ".join(tests))


def keyed(df: DataFrame, strata: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The frame and its keys; without strata one constant key stands in."""
    return (df, list(strata)) if strata else (df.withColumn(ALL, F.lit(0)), [ALL])


def _div(num: str, den: str) -> str:
    return f"try_divide(CAST({num} AS DOUBLE), CAST({den} AS DOUBLE))"


def _wmean(value: str, when: str | None = None) -> str:
    if when is None:
        return _div(f"sum({W} * ({value}))", f"sum({W})")
    return _div(f"sum(CASE WHEN {when} THEN {W} * ({value}) END)", f"sum(CASE WHEN {when} THEN {W} END)")


# --- sums over rows: one aggregate expression each ---------------------------

_CLIPPED = f"least(greatest({P}, {CLIP!r}D), 1D - {CLIP!r}D)"
_ROW_LOSS = f"-(CASE WHEN {Y} = 1 THEN ln({_CLIPPED}) ELSE ln(1D - {_CLIPPED}) END)"
_MISS = f"({Y} - {P}) * (1D - 2D * {P})"
_SPREAD = f"(1D - 2D * {P}) * (1D - 2D * {P}) * {P} * (1D - {P})"

ROW_METRICS: dict[str, str] = {
    "brier": _wmean(f"({P} - {Y}) * ({P} - {Y})"),
    "loss_bce": f"CASE WHEN min({Y}) = max({Y}) THEN {LOSS_UNDEFINED!r}D ELSE {_wmean(_ROW_LOSS)} END",
    "mean_prediction": _wmean(P),
    "mean_prediction_0": _wmean(P, f"{Y} = 0"),
    "mean_prediction_1": _wmean(P, f"{Y} = 1"),
    "spiegelhalter_z": _div(f"sum({W} * {_MISS})", f"sqrt(sum({W} * {_SPREAD}))"),
}


def register_row_metric(name: str, sql: str) -> None:
    """Add a metric that is one aggregate expression over ``__y, __p, __w``."""
    ROW_METRICS[name] = sql


# --- confusion counts ---------------------------------------------------------

def confusion(positive: str) -> dict[str, str]:
    """Weighted counts for a SQL test of being called positive."""
    cells = {"tp": (True, 1), "fp": (True, 0), "fn": (False, 1), "tn": (False, 0)}
    return {
        n: f"sum(CASE WHEN {'' if called else 'NOT '}({positive}) AND {Y} = {y} THEN {W} ELSE 0D END)"
        for n, (called, y) in cells.items()
    }


def from_confusion(name: str, c: Mapping[str, str]) -> str:
    """A rate of the four counts; NULL for an empty denominator."""
    num, other = {
        "sensitivity": ("tp", "fn"),
        "recall": ("tp", "fn"),
        "specificity": ("tn", "fp"),
        "ppv": ("tp", "fp"),
        "precision": ("tp", "fp"),
        "npv": ("tn", "fn"),
        "fpr": ("fp", "tn"),
        "fnr": ("fn", "tp"),
        "fdr": ("fp", "tp"),
    }[name]
    return _div(c[num], f"({c[num]} + {c[other]})")


def _at_threshold(name: str) -> str | None:
    """``recall_0.1``, ``precision_0.1``, ``specificity_0.1``: positive when p >= t."""
    kind, _, value = name.rpartition("_")
    if kind not in ("recall", "precision", "specificity"):
        return None
    return f"coalesce({from_confusion(kind, confusion(f'{P} >= {float(value)!r}D'))}, 0D)"


def at_threshold_names(thresholds: Sequence[float] = FIXED_THRESHOLDS) -> list[str]:
    return [f"{k}_{t}" for k in ("recall", "precision", "specificity") for t in thresholds]


# --- ranks over distinct scores -------------------------------------------------

POSITIVE = f"CASE WHEN {Y} = 1 THEN {W} ELSE 0D END"
NEGATIVE = f"CASE WHEN {Y} = 1 THEN 0D ELSE {W} END"


def score_points(base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key and distinct score with positive and negative weight and row counts."""
    rows = [f"sum(CASE WHEN {'' if y else 'NOT '}({Y} = 1) THEN {C} ELSE 0L END) AS c{n}" for y, n in ((1, "pos"), (0, "neg"))]
    sums = [f"sum({POSITIVE}) AS pos", f"sum({NEGATIVE}) AS neg", *rows]
    return base.groupBy(*keys, P).agg(*[F.expr(s) for s in sums])


def point_rows(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points as weighted rows again, one per score and label: all metrics but those of a threshold column."""
    return points.selectExpr(
        *map(quoted, keys), P, f"stack(2, 1, pos, cpos, 0, neg, cneg) AS ({Y}, {W}, {C})"
    ).where(f"{C} > 0")


def rank_points(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points with running and total weights."""
    return running_sums(points, keys, [P], ["pos", "neg"], score_bucket(P))


_TP, _FP = "(total_pos - before_pos)", "(total_neg - before_neg)"
RANK_METRICS: dict[str, str] = {
    # pairs ranked right, ties count half
    "auc": f"coalesce({_div('sum(pos * (before_neg + neg / 2))', '(max(total_pos) * max(total_neg))')}, {AUC_UNDEFINED!r}D)",
    # recall steps times precision at each distinct score, from above
    "auprc": f"sum({_div('pos', 'total_pos')} * {_div(_TP, f'({_TP} + {_FP})')})",
}


# --- binned calibration -----------------------------------------------------------

# Name -> (variant, quantile bins).
ECE_METRICS = {
    "ece_abs": ("abs", False),
    "ece_rmse": ("rmse", False),
    "ece_signed": ("signed", False),
    "ece_squared": ("squared", False),
    "ece_q_abs": ("abs", True),
    "ece_q_rmse": ("rmse", True),
}


def variant_sql(diff: str, variant: str) -> str:
    return {"abs": f"abs({diff})", "signed": f"({diff})"}.get(variant, f"({diff}) * ({diff})")


def equal_width_bins(base: DataFrame, keys: Sequence[str], n_bins: int = 10) -> DataFrame:
    """Add ``bin``: right-closed bins of equal width between the extremes of the key."""
    ends = base.groupBy(*keys).agg(F.expr(f"min({P}) AS __lo"), F.expr(f"max({P}) AS __hi"))
    step = f"(__hi - __lo) / {n_bins}"
    place = " + ".join(f"CAST({P} > __lo + {step} * {i} AS INT)" for i in range(1, n_bins))
    return attach(base, ends, keys).selectExpr(*map(quoted, base.columns), f"{place} AS bin")


def quantile_bins(base: DataFrame, keys: Sequence[str], n_bins: int = 10) -> DataFrame:
    """Add ``bin``: right-closed bins between unweighted quantiles; NULL when edges coincide."""
    edges = exact_quantiles(base, keys, P, [i / n_bins for i in range(n_bins + 1)], C)
    place = " + ".join(f"CAST({P} > q[{i}] AS INT)" for i in range(1, n_bins))
    return attach(base, edges.drop("n"), keys).selectExpr(
        *map(quoted, base.columns), f"CASE WHEN size(array_distinct(q)) = {n_bins + 1} THEN {place} END AS bin"
    )


def expected_calibration_error(
    base: DataFrame, strata: Sequence[str], names: Sequence[str], n_bins: int = 10
) -> DataFrame:
    """Wide frame of the named binned errors: sum over bins of share x f(mean p - mean y)."""
    rows, keys = keyed(base, strata)
    out = None
    for quantile in (False, True):
        chosen = [n for n in names if ECE_METRICS[n][1] == quantile]
        if not chosen:
            continue
        binned = (quantile_bins if quantile else equal_width_bins)(rows, keys, n_bins)
        bins = binned.groupBy(*keys, "bin").agg(
            F.expr(f"sum({W}) AS bw"), F.expr(f"sum({W} * {P}) AS bp"), F.expr(f"sum({W} * {Y}) AS by")
        )
        aggs = []
        for n in chosen:
            variant = ECE_METRICS[n][0]
            value = _div(f"sum(bw * {variant_sql(_div('bp - by', 'bw'), variant)})", "sum(bw)")
            value = f"sqrt({value})" if variant == "rmse" else value
            aggs.append(F.expr(f"CASE WHEN count(bin) > 0 THEN {value} END AS {n}"))
        part = bins.groupBy(*keys).agg(*aggs)
        out = part if out is None else out.join(part, keys)
    return out if strata else out.drop("__all")


def pointwise_calibration_error(
    df: DataFrame,
    strata: Sequence[str] = (),
    label: str = "labels",
    pred: str = "pred_probs",
    weight: str | None = None,
    norm_order: int | None = 1,
    quantile: bool = False,
    n_bins: int = 10,
) -> DataFrame:
    """Each row against the mean label of its bin; edges ignore weights."""
    rows, keys = keyed(prepare(df, strata, label, pred, weight), strata)
    binned = (quantile_bins if quantile else equal_width_bins)(rows, keys, n_bins).where("bin IS NOT NULL")
    means = binned.groupBy(*keys, "bin").agg(F.expr(f"{_wmean(Y)} AS __m"))
    err = variant_sql(f"{P} - __m", {1: "abs", 2: "squared", None: "signed"}[norm_order])
    value = f"sqrt({_wmean(err)})" if norm_order == 2 else _wmean(err)
    out = binned.join(means, [*keys, "bin"]).groupBy(*keys).agg(F.expr(f"{value} AS performance"))
    return out if strata else out.drop("__all")


# --- the evaluator -----------------------------------------------------------

def melt_metrics(wide: DataFrame, strata: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Wide metric columns to ``metric, strata..., performance``."""
    pairs = ", ".join(f"'{n}', CAST(`{n}` AS DOUBLE)" for n in names)
    return wide.selectExpr(*map(quoted, strata), f"stack({len(names)}, {pairs}) AS (metric, performance)").select(
        "metric", *strata, "performance"
    )


def known_metrics() -> list[str]:
    from strataflow.operators.calibration import ACE_METRICS

    return [*RANK_METRICS, *ROW_METRICS, *ECE_METRICS, *ACE_METRICS, *at_threshold_names(), *THRESHOLD_METRICS]


def evaluate_prepared(
    base: DataFrame, metrics: Sequence[str], strata: Sequence[str] = ()
) -> DataFrame:
    """Metrics of a prepared frame; names that are not known are left out, with a warning."""
    from strataflow.operators import calibration

    strata = list(strata)
    ranked = [m for m in metrics if m in RANK_METRICS]
    base, keys = keyed(base, strata)
    if ranked:
        # ranks need distinct scores anyway: with them every other family reads
        # the same shuffled points instead of the rows
        points = score_points(base, keys)
        if T not in base.columns:
            base = point_rows(points, keys)
    rows: dict[str, str] = {}
    for m in metrics:
        if m in ROW_METRICS:
            rows[m] = ROW_METRICS[m]
        elif m in THRESHOLD_METRICS and T in base.columns:
            rows[m] = from_confusion(m, confusion(f"{P} > {T}"))
        elif m not in RANK_METRICS and m not in ECE_METRICS and m not in calibration.ACE_METRICS:
            at = _at_threshold(m)
            if at is not None:
                rows[m] = at
            elif m not in THRESHOLD_METRICS:
                warnings.warn(f"metric {m!r} is not known and left out", stacklevel=3)
    parts = []
    if rows:
        wide = base.groupBy(*keys).agg(*[F.expr(f"{e} AS `{n}`") for n, e in rows.items()])
        parts.append(melt_metrics(wide, strata, list(rows)))
    if ranked:
        wide = rank_points(points, keys).groupBy(*keys).agg(*[F.expr(f"{RANK_METRICS[m]} AS {m}") for m in ranked])
        parts.append(melt_metrics(wide, strata, ranked))
    eces = [m for m in metrics if m in ECE_METRICS]
    if eces:
        parts.append(melt_metrics(expected_calibration_error(base, strata, eces), strata, eces))
    aces = [m for m in metrics if m in calibration.ACE_METRICS]
    if aces:
        parts.append(melt_metrics(calibration.absolute_errors(base, strata, aces), strata, aces))
    if not parts:
        raise ValueError("no known metric asked for")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def evaluate(
    df: DataFrame,
    metrics: Sequence[str] = DEFAULT_METRICS,
    strata: Sequence[str] = (),
    label: str = "labels",
    pred: str = "pred_probs",
    weight: str | None = None,
    threshold: str | None = None,
    count: str | None = None,
) -> DataFrame:
    """``metric, strata..., performance`` for every stratum.

    Strata columns the frame lacks are dropped. With a ``threshold`` column the
    default threshold metrics are added unless others are named.
    """
    strata = [s for s in strata if s in df.columns]
    names = list(metrics)
    if threshold and not any(m in THRESHOLD_METRICS for m in names):
        names += DEFAULT_THRESHOLD_METRICS
    return evaluate_prepared(prepare(df, strata, label, pred, weight, threshold, count=count), names, strata)


def clean_results(results: DataFrame) -> DataFrame:
    """Without undefined values: NULL, negative auc, the one-class loss mark."""
    return results.where(
        f"performance IS NOT NULL AND NOT (metric = 'auc' AND performance < 0) "
        f"AND NOT (metric = 'loss_bce' AND performance = {LOSS_UNDEFINED!r}D)"
    )


def custom_metric(
    df: DataFrame,
    name: str,
    state: Callable,
    finish: Callable,
    strata: Sequence[str] = (),
    label: str = "labels",
    pred: str = "pred_probs",
    weight: str | None = None,
) -> DataFrame:
    """A user's own metric with mergeable state.

    ``state(labels, pred_probs, sample_weight)`` gives the same few numbers for any
    rows; they are added over all parts of a stratum, and ``finish(sums)`` is its value.
    No task ever holds a whole stratum. What is one SQL sum belongs in ``register_row_metric``.
    """
    base, keys = keyed(prepare(df, strata, label, pred, weight), strata)
    fields = [base.schema[k] for k in keys]
    schema = ST.StructType([*fields, ST.StructField("state", ST.ArrayType(ST.DoubleType()))])

    def partial(parts):
        for pdf in parts:
            for key, rows in pdf.groupby(keys, sort=False):
                sums = state(rows[Y].to_numpy(), rows[P].to_numpy(), rows[W].to_numpy())
                yield pd.DataFrame([[*key, [float(x) for x in sums]]], columns=[*keys, "state"])

    def value(sums: pd.Series) -> pd.Series:
        return pd.Series([float(finish(s)) for s in sums], dtype="float64")

    parts = base.mapInPandas(partial, schema).select(*keys, F.posexplode("state").alias("at", "x"))
    added = parts.groupBy(*keys, "at").agg(F.sum("x").alias("x"))
    whole = added.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("s"))
    performance = F.pandas_udf(value, "double")(F.transform("s", lambda e: e["x"]))
    return whole.select(F.lit(name).alias("metric"), *strata, performance.alias("performance"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return ratio(F.sum(value * weight), F.sum(weight))


def mean_over_iterations(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Second level: mean and sample deviation over the model runs."""
    return results.groupBy(*keys, "metric").agg(
        F.expr("avg(performance) AS mean"), F.expr("stddev_samp(performance) AS std")
    )


def min_max_over(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Least and greatest value over groups as ``<metric>_min`` and ``<metric>_max``."""
    agg = results.groupBy(*keys, "metric").agg(F.expr("min(performance) AS lo"), F.expr("max(performance) AS hi"))
    return agg.selectExpr(
        *map(quoted, keys),
        "stack(2, concat(metric, '_min'), lo, concat(metric, '_max'), hi) AS (metric, performance)",
    )


def batch_mean_loss(batches: DataFrame, keys: Sequence[str], loss: str, size: str) -> DataFrame:
    """Size-weighted mean of batch losses."""
    return batches.groupBy(*keys).agg(weighted_mean(F.col(loss), F.col(size)).alias("loss"))


def ensemble_predictions(
    df: DataFrame, keys: Sequence[str], values: Sequence[str] = ("outputs", "pred_probs", "labels"), weight: str | None = None
) -> DataFrame:
    """Mean of the numeric columns per row over the model runs, weighted if asked."""
    if weight is None:
        return df.groupBy(*keys).agg(*[F.expr(f"avg({v}) AS {v}") for v in values])
    w = quoted(weight)
    return df.where(f"{w} > 0").groupBy(*keys).agg(
        *[F.expr(f"{_div(f'sum({w} * {v})', f'sum({w})')} AS {v}") for v in values]
    )


def best_iteration(df: DataFrame, strata: Sequence[str] = (), iteration: str = "iter", phase: str = "phase") -> DataFrame:
    """The run with the least log loss on the validation phase; ties take the lower number."""
    losses = evaluate(df.where(F.col(phase) == "val"), ["loss_bce"], [*strata, iteration])
    best = F.min(F.struct("performance", iteration)).alias("b")
    return losses.groupBy(*strata).agg(best).select(
        *strata, F.col(f"b.{iteration}").alias(iteration), F.col("b.performance").alias("loss_bce")
    )


def keep_best(df: DataFrame, strata: Sequence[str] = ()) -> DataFrame:
    return df.join(best_iteration(df, strata).select(*strata, "iter"), [*strata, "iter"], "left_semi")


def top_share_thresholds(df: DataFrame, shares: Sequence[float], key: str = "iter", pred: str = "pred_probs") -> DataFrame:
    """Score above which each top share of the validation rows lies: ``key, share, threshold``."""
    val = df.where(F.col("phase") == "val")
    q = exact_quantiles(val, [key], pred, [1 - s for s in shares])
    pairs = ", ".join(f"{float(s)!r}D, q[{i}]" for i, s in enumerate(shares))
    return q.selectExpr(quoted(key), f"stack({len(shares)}, {pairs}) AS (share, threshold)")


def risk_thresholds(df: DataFrame, share: float) -> DataFrame:
    """Rows with their run's threshold for one top share."""
    t = top_share_thresholds(df, [share]).select("iter", "threshold")
    # one row per run: a shuffle by the run would gather all its rows in one task
    return df.join(F.broadcast(t), "iter", "left")


def optimal_thresholds(df: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Per run the grid threshold with the greatest PPV + NPV on validation rows.

    The counts of all grid points come from one aggregation, so the grid does
    not multiply the rows; on ties the higher threshold wins.
    """
    val = df.where(F.col("phase") == "val")
    base = prepare(val, ["iter"])
    cuts = exact_quantiles(base, ["iter"], P, [1 - s for s in shares]).select("iter", "q")
    points = []
    for i in range(len(shares)):
        c = confusion(f"{P} > q[{i}]")
        score = " + ".join(f"coalesce({from_confusion(m, c)}, 0D)" for m in ("ppv", "npv"))
        points.append(f"named_struct('score', {score}, 'threshold', first(q[{i}]))")
    best = f"array_max(array({', '.join(points)})) AS b"
    return (
        base.join(cuts, "iter")
        .groupBy("iter")
        .agg(F.expr(best))
        .selectExpr("iter", "b.threshold AS threshold", "b.score AS ppv_npv")
    )
