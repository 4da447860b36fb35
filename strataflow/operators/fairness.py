"""One group against all: metric differences, score distance, cross-group ranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.operators.metrics import P, W, Y, evaluate_prepared, keyed, prepare
from strataflow.operators.running import ALL, attach, quoted, running_sums, score_bucket
from strataflow.session import cut_lineage

# Default base metrics of the one-vs-all frame.
OVA_METRICS = ("auc", "auprc", "loss_bce", "brier", "mean_prediction", "mean_prediction_0", "mean_prediction_1")
XAUC_VARIANTS = {
    "xauc_1_ova": (1, False),
    "xauc_0_ova": (0, False),
    "xauc_1": (1, True),
    "xauc_0": (0, True),
}
EMD_VARIANTS = {"emd_ova": None, "emd_0_ova": 0, "emd_1_ova": 1}
UNDEFINED = -1.0


def _base(df, group, strata, label, pred, weight):
    rows, keys = keyed(prepare(df, strata, label, pred, weight, keep=[group]), strata)
    return rows.where(f"{quoted(group)} IS NOT NULL"), keys


def group_vs_overall(
    df: DataFrame,
    group: str,
    metrics: Sequence[str],
    strata: Sequence[str] = (),
    label: str = "labels",
    pred: str = "pred_probs",
    weight: str | None = None,
) -> DataFrame:
    """``metric, strata, group, performance, performance_overall`` side by side."""
    base, keys = _base(df, group, strata, label, pred, weight)
    own = evaluate_prepared(base, metrics, [*keys, group])
    overall = evaluate_prepared(base, metrics, keys).withColumnRenamed("performance", "performance_overall")
    return own.join(overall, ["metric", *keys]).drop(ALL)


def metric_ova(
    df: DataFrame,
    group: str,
    metrics: Sequence[str] = OVA_METRICS,
    strata: Sequence[str] = (),
    transform: Callable[[Column], Column] | None = None,
    **names,
) -> DataFrame:
    """``<metric>_ova``: metric of the group minus metric of all."""
    both = group_vs_overall(df, group, metrics, strata, **names)
    diff = F.col("performance") - F.col("performance_overall")
    out = both.withColumn("performance", transform(diff) if transform else diff)
    return out.selectExpr("concat(metric, '_ova') AS metric", *map(quoted, [*strata, group]), "performance")


def emd_ova(
    df: DataFrame,
    group: str,
    variant: str = "emd_ova",
    strata: Sequence[str] = (),
    label: str = "labels",
    pred: str = "pred_probs",
    weight: str | None = None,
) -> DataFrame:
    """Earth mover's distance between the scores of a group and of all.

    Distinct scores of all rows are repeated once per group of the stratum
    (never per pair of rows); both distributions are running sums, and the
    distance adds |F_group - F_all| times the gap to the next score.
    """
    the_label = EMD_VARIANTS[variant]
    base, keys = _base(df, group, strata, label, pred, weight)
    groups = base.select(*keys, group).distinct()
    if the_label is not None:
        base = base.where(f"{Y} = {the_label}")
    own = base.groupBy(*keys, group, P).agg(F.expr(f"sum({W}) AS u"))
    everyone = own.groupBy(*keys, P).agg(F.expr("sum(u) AS v"))
    gkeys = [*keys, group]
    per_key = groups.groupBy(*keys).agg(F.expr(f"collect_set({quoted(group)}) AS __groups"))
    cells = (
        attach(everyone, per_key, keys)
        .selectExpr(*map(quoted, keys), P, "v", f"explode(__groups) AS {quoted(group)}")
        .join(own, [*gkeys, P], "left")
        .selectExpr(*map(quoted, gkeys), P, "coalesce(u, 0D) AS u", "v")
    )
    run = running_sums(cells, gkeys, [P], ["u", "v"], score_bucket(P))
    # |F_group - F_all| holds on the gap below each score: the sum of gap x height
    # equals the sum of score x (height below - height at), which needs no neighbour
    below = "abs(try_divide(before_u, total_u) - try_divide(before_v, total_v))"
    at = "abs(try_divide(before_u + u, total_u) - try_divide(before_v + v, total_v))"
    value = run.groupBy(*gkeys).agg(F.expr(f"sum({P} * ({below} - {at})) AS d"))
    return groups.join(value, gkeys, "left").selectExpr(
        f"'{variant}' AS metric", *map(quoted, [*strata, group]), f"coalesce(d, {UNDEFINED!r}D) AS performance"
    )


def xauc(
    df: DataFrame,
    group: str,
    variant: str = "xauc_1_ova",
    strata: Sequence[str] = (),
    label: str = "labels",
    pred: str = "pred_probs",
    weight: str | None = None,
) -> DataFrame:
    """Chance that the group's rows of one label are ranked right against the other label's rows.

    Other-label rows are ranked once per stratum; the group's rows read their
    place by score. Leaving the group itself out subtracts the group's own
    running sums.
    """
    the_label, exclude = XAUC_VARIANTS[variant]
    base, keys = _base(df, group, strata, label, pred, weight)
    gkeys = [*keys, group]
    cells = base.groupBy(*gkeys, P).agg(
        F.expr(f"sum(CASE WHEN {Y} = {the_label} THEN {W} ELSE 0D END) AS a"),
        F.expr(f"sum(CASE WHEN {Y} = {the_label} THEN 0D ELSE {W} END) AS b"),
    )
    by_score = cells.groupBy(*keys, P).agg(F.expr("sum(b) AS b"))
    everyone = running_sums(by_score, keys, [P], ["b"], score_bucket(P)).withColumnsRenamed(
        {"b": "all_b", "before_b": "all_before", "total_b": "all_total"}
    )
    own = running_sums(cells, gkeys, [P], ["a", "b"], score_bucket(P))
    both = own.join(everyone, [*keys, P])
    before, same, total = "all_before", "all_b", "all_total"
    if exclude:
        before, same, total = "(all_before - before_b)", "(all_b - b)", "(all_total - total_b)"
    below = f"({before} + {same} / 2)"
    right = below if the_label == 1 else f"({total} - {below})"
    value = f"coalesce(try_divide(sum(a * {right}), max(total_a) * max({total})), {UNDEFINED!r}D) AS performance"
    return both.groupBy(*gkeys).agg(F.expr(value)).selectExpr(
        f"'{variant}' AS metric", *map(quoted, [*strata, group]), "performance"
    )


def fairness_ova(
    df: DataFrame,
    group: str,
    strata: Sequence[str] = (),
    metrics: Sequence[str] = OVA_METRICS,
    emd: Sequence[str] = tuple(EMD_VARIANTS),
    xaucs: Sequence[str] = tuple(XAUC_VARIANTS),
    label: str = "labels",
    pred: str = "pred_probs",
    weight: str | None = None,
) -> DataFrame:
    """All one-vs-all measures for every group and stratum.

    Rows collapse once to distinct (stratum, group, score, label) with their
    weight; every measure starts from those.
    """
    strata = [s for s in strata if s in df.columns]
    base, keys = _base(df, group, strata, label, pred, weight)
    cells = base.groupBy(*keys, group, Y, P).agg(F.expr(f"sum({W}) AS {W}"))
    cells = cut_lineage(cells)
    names = {"label": Y, "pred": P, "weight": W}
    parts = [metric_ova(cells, group, metrics, strata, **names)] if metrics else []
    parts += [emd_ova(cells, group, v, strata, **names) for v in emd]
    parts += [xauc(cells, group, v, strata, **names) for v in xaucs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
