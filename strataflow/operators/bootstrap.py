"""Stratified bootstrap as weights, and paired comparison of two models.

A replicate draws exactly n rows with replacement in every stratum of n rows.
Row k of a stratum makes draw k of every replicate, so drawing is as parallel
as the rows. Two hashes h1, h2 of (seed, stratum, k) give all its draws: in
replicate b it takes place ((h1 + b * h2) mod P) mod n with a prime P. Draws of
one replicate are independent, draws of any two replicates are independent of
each other, which is what quantiles over replicates need, and a draw costs two
remainders instead of a digest. Draws are counted per place and joined back as
a weight. Metrics then take the replicate as one more stratum.

Rows x replicates is the size of the work. ``first`` lets a caller run ranges
of replicates and append their results; ranges join without overlap.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.functions.hashing import hash_key, hash_slice
from strataflow.operators.metrics import (
    DEFAULT_METRICS,
    ensemble_predictions,
    evaluate,
    keep_best,
    mean_over_iterations,
)
from strataflow.operators.packed import BOOT, PART, PRIME, replicated, supported
from strataflow.operators.running import hash_ranks, quoted
from strataflow.session import cut_lineage

WEIGHT = "boot_weight"
#: Score and label of either model of a pair.
SIDES = {"base": ("pred_base", "labels"), "test": ("pred_test", "labels_test")}
_TIMES = f"{BOOT} % {PART} * __h2 + CAST({BOOT} AS BIGINT) DIV {PART} * __h2 % {PRIME}L * {PART}"


def resample_counts(
    df: DataFrame, strata: Sequence[str], ids: Sequence[str], n_boot: int, seed: int = 44, first: int = 1
) -> DataFrame:
    """Rows of ``df`` drawn in each replicate: all columns, ``boot_iter``, ``boot_weight``.

    ``ids`` identify a row within its stratum. Rows without a stratum value are left out.
    """
    strata, ids = list(strata), list(ids)
    units = df.where(" AND ".join(f"`{s}` IS NOT NULL" for s in strata)) if strata else df
    keys = strata
    if not keys:
        units, keys = units.withColumn("__all", F.lit(0)), ["__all"]
    ranked = hash_ranks(units, keys, hash_key(seed, *map(quoted, ids)), ids)
    # drawing multiplies the rows, so they are spread over all tasks first; draws and
    # rows both read what is written here: n rows, not n x replicates
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digest = hash_key(seed, "'draw'", *map(quoted, strata), "rank0")
    hashed = ranked.withColumn("__d", F.expr(digest)).selectExpr(
        *map(quoted, ranked.columns),
        f"{hash_slice('__d', 1)} % {PRIME}L AS __h1",
        f"{hash_slice('__d', 13)} % {PRIME}L AS __h2",
    )
    units = cut_lineage(hashed.repartition(tasks, "rank0", *keys))
    draws = (
        units.selectExpr(
            *map(quoted, keys), "n", "__h1", "__h2", f"explode(sequence({first}, {first + n_boot - 1})) AS {BOOT}"
        )
        .selectExpr(
            *map(quoted, keys), BOOT, f"coalesce((__h1 + {_TIMES}) % {PRIME}L % n, 0L) AS rank0"
        )
        # one shuffle serves the count and the join; draws hit places at random, so
        # counting before the shuffle would save little
        .repartition("rank0", *keys)
        .groupBy("rank0", *keys, BOOT)
        .agg(F.expr(f"CAST(count(*) AS DOUBLE) AS {WEIGHT}"))
    )
    # the planner's estimate does not see rows x replicates: never broadcast the draws
    rows = units.drop("n", "__h1", "__h2")
    # the place comes first among the keys: a number that nearly decides the sort order
    return rows.join(draws.hint("merge"), ["rank0", *keys]).drop("rank0", "__all")


def bootstrap(
    df: DataFrame,
    n_boot: int = 1000,
    strata: Sequence[str] = (),
    boot_strata: Sequence[str] = (),
    ids: Sequence[str] = ("ids",),
    metrics: Sequence[str] = DEFAULT_METRICS,
    seed: int = 44,
    first: int = 1,
    threshold: str | None = None,
    label: str = "labels",
    pred: str = "pred_probs",
    weight: str | None = None,
) -> DataFrame:
    """Metrics per replicate and stratum; rows are drawn within strata and ``boot_strata`` together.

    How often a row is drawn is its count, beside the sample weight it may have.
    """
    within = [*strata, *[s for s in boot_strata if s not in strata]]
    if weight is None and threshold is None and supported(metrics):
        return replicated(df, within, strata, ids, n_boot, metrics, seed, first, {"": (pred, label)})
    drawn = resample_counts(df, within, ids, n_boot, seed, first)
    return evaluate(drawn, metrics, [BOOT, *strata], label, pred, weight, threshold, count=WEIGHT)


def quantile_interval(df: DataFrame, keys: Sequence[str], value: str = "performance", alpha: float = 0.05) -> DataFrame:
    """``ci_lower, ci_med, ci_upper`` per key over the replicates.

    A group holds one value per replicate, so its buffer is bounded by their number.
    """
    probs = f"array({alpha / 2!r}D, 0.5D, {1 - alpha / 2!r}D)"
    q = df.where(f"{value} IS NOT NULL").groupBy(*keys).agg(F.expr(f"percentile({value}, {probs}) AS q"))
    return q.selectExpr(*map(quoted, keys), "q[0] AS ci_lower", "q[1] AS ci_med", "q[2] AS ci_upper")


def bootstrap_ci(df: DataFrame, n_boot: int = 1000, strata: Sequence[str] = (), alpha: float = 0.05, **kw) -> DataFrame:
    """Interval per metric and stratum: quantiles .025, .5, .975 of the replicates."""
    return quantile_interval(bootstrap(df, n_boot, strata, **kw), ["metric", *strata], alpha=alpha)


def evaluate_avg(
    df: DataFrame,
    n_boot: int,
    strata: Sequence[str] = ("phase",),
    metrics: Sequence[str] = DEFAULT_METRICS,
    seed: int = 44,
    ids: Sequence[str] = ("ids",),
    first: int = 1,
) -> DataFrame:
    """Metric per model run, then mean and deviation over the runs of a replicate."""
    per_run = bootstrap(df, n_boot, [*strata, "iter"], metrics=metrics, seed=seed, ids=ids, first=first)
    return mean_over_iterations(per_run, [BOOT, *strata])


def evaluate_ensemble(
    df: DataFrame,
    n_boot: int,
    strata: Sequence[str] = ("phase",),
    metrics: Sequence[str] = DEFAULT_METRICS,
    seed: int = 44,
    row: str = "row_id",
    first: int = 1,
) -> DataFrame:
    """Scores averaged per row over its draws in all runs, then one metric per replicate."""
    if supported(metrics):
        return replicated(df, [*strata, "iter"], strata, [row], n_boot, metrics, seed, first, ensemble=True)
    drawn = resample_counts(df, [*strata, "iter"], [row], n_boot, seed, first)
    mean = ensemble_predictions(drawn, [BOOT, *strata, row], ("pred_probs", "labels"), WEIGHT)
    return evaluate(mean.withColumn("labels", F.expr("CAST(round(labels) AS INT)")), metrics, [BOOT, *strata])


def evaluate_best(
    df: DataFrame,
    n_boot: int,
    strata: Sequence[str] = ("phase",),
    metrics: Sequence[str] = DEFAULT_METRICS,
    seed: int = 44,
    ids: Sequence[str] = ("ids",),
    first: int = 1,
) -> DataFrame:
    """Only the run with the least validation log loss, drawn per phase."""
    return bootstrap(keep_best(df), n_boot, strata, metrics=metrics, seed=seed, ids=ids, first=first)


EVALUATIONS = {"avg": evaluate_avg, "ensemble": evaluate_ensemble, "best": evaluate_best}


#: Lower ends of the age bands after the first.
AGE_ENDS = (40, 60, 80)


def age_band(age: str, ends: Sequence[int] = AGE_ENDS) -> str:
    """SQL expression of an age's band, such as ``40-59``; NULL stays NULL."""
    names = [f"under {ends[0]}", *[f"{a}-{b - 1}" for a, b in zip(ends, ends[1:])], f"{ends[-1]} and over"]
    whens = " ".join(f"WHEN {age} < {e} THEN '{n}'" for e, n in zip(ends, names))
    return f"CASE {whens} WHEN {age} >= {ends[-1]} THEN '{names[-1]}' END"


def stack_attributes(df: DataFrame, attributes: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """A row per row and attribute it has a value of: ``keep, attribute, value``.

    ``attributes`` gives each name's SQL expression. All attributes are evaluated from one
    scan, as strata of ``(attribute, value)``.
    """
    pairs = ", ".join(f"'{name}', CAST({expr} AS STRING)" for name, expr in attributes.items())
    stacked = df.selectExpr(*map(quoted, keep), f"stack({len(attributes)}, {pairs}) AS (attribute, value)")
    return stacked.where("value IS NOT NULL")


def pair_predictions(
    base: DataFrame, test: DataFrame, keys: Sequence[str] = ("phase", "iter", "ids"), check: bool = False
) -> DataFrame:
    """One row per key with both models' scores: ``pred_base, pred_test, labels, labels_test``."""
    if check:
        from strataflow.operators.split import assert_same_ids

        assert_same_ids(base, test, *keys)
    right = test.select(*keys, F.col("pred_probs").alias("pred_test"), F.col("labels").alias("labels_test"))
    left = base.withColumnRenamed("pred_probs", "pred_base")
    return left.join(right, list(keys))


def pair_by_attributes(
    base: DataFrame, test: DataFrame, attributes: Mapping[str, str], keys: Sequence[str] = ("phase", "iter", "ids")
) -> DataFrame:
    """The pairs of two frames of ``stack_attributes``, paired before they are stacked: ``keys`` have neither attribute nor value.

    A pair stands below an attribute where both sides have the same value of it.
    """
    def side(df, mark, *columns):
        values = [f"CAST({e} AS STRING) AS __{mark}{i}" for i, e in enumerate(attributes.values())]
        return df.selectExpr(*map(quoted, keys), *columns, *values)

    left = side(base, "a", "pred_probs AS pred_base", "labels")
    right = side(test, "b", "pred_probs AS pred_test", "labels AS labels_test")
    shared = {name: f"IF(__a{i} = __b{i}, __a{i}, NULL)" for i, name in enumerate(attributes)}
    keep = [*keys, "pred_base", "pred_test", "labels", "labels_test"]
    return stack_attributes(left.join(right, list(keys)), shared, keep)


def _stack_sides(drawn: DataFrame) -> DataFrame:
    """Both models below each other, so that one evaluation serves both."""
    own = ("pred_base", "pred_test", "labels", "labels_test", "outputs")
    rest = [quoted(c) for c in drawn.columns if c not in own]
    return drawn.selectExpr(
        *rest, "stack(2, 'base', pred_base, labels, 'test', pred_test, labels_test) AS (side, pred_probs, labels)"
    )


def _difference(results: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    both = results.groupBy(*keys, "metric").agg(
        *[F.expr(f"max(CASE WHEN side = '{s}' THEN {value} END) AS performance_{s}") for s in ("base", "test")]
    )
    return both.selectExpr("*", "performance_base - performance_test AS performance_diff")


def compare_pairs(
    pairs: DataFrame,
    strata: Sequence[str],
    n_boot: int,
    metrics: Sequence[str] = DEFAULT_METRICS,
    ids: Sequence[str] = ("ids",),
    seed: int = 44,
    first: int = 1,
) -> DataFrame:
    """Metrics of both scores of paired rows on the same draws, per replicate and stratum."""
    if supported(metrics):
        both = replicated(pairs, strata, strata, ids, n_boot, metrics, seed, first, SIDES)
    else:
        drawn = _stack_sides(resample_counts(pairs, strata, ids, n_boot, seed, first))
        both = evaluate(drawn, metrics, ["side", BOOT, *strata], count=WEIGHT)
    return _difference(both, [BOOT, *strata], "performance")


def compare_models(
    base: DataFrame,
    test: DataFrame,
    method: str = "avg",
    strata: Sequence[str] = ("phase",),
    n_boot: int = 1000,
    metrics: Sequence[str] = DEFAULT_METRICS,
    seed: int = 44,
    first: int = 1,
    ids: Sequence[str] = ("ids",),
    attributes: Mapping[str, str] | None = None,
) -> DataFrame:
    """Both models on the same draws: ``boot_iter, strata, metric, performance_base/_test/_diff``.

    With ``attributes``, as ``stack_attributes`` takes them, ``attribute`` and ``value`` may be among the strata.
    """
    strata, ids = list(strata), list(ids)

    def pair(base, test, keys):
        if not attributes:
            return pair_predictions(base, test, keys)
        return pair_by_attributes(base, test, attributes, [k for k in keys if k not in ("attribute", "value")])

    if method == "best":
        pairs = pair(keep_best(base), keep_best(test).drop("iter"), [*strata, *ids])
        return compare_pairs(pairs, strata, n_boot, metrics, ids, seed, first)
    pairs = pair(base, test, [*strata, "iter", *ids])
    within, packed = [*strata, "iter"], supported(metrics)
    if method == "ensemble" and packed and len(ids) == 1:
        both = replicated(pairs, within, strata, ids, n_boot, metrics, seed, first, SIDES, ensemble=True)
        return _difference(both, [BOOT, *strata], "performance")
    if method == "avg" and packed:
        per_run = replicated(pairs, within, within, ids, n_boot, metrics, seed, first, SIDES)
        return _difference(mean_over_iterations(per_run, ["side", BOOT, *strata]), [BOOT, *strata], "mean")
    drawn = _stack_sides(resample_counts(pairs, within, ids, n_boot, seed, first))
    if method == "avg":
        per_run = evaluate(drawn, metrics, ["side", BOOT, *strata, "iter"], count=WEIGHT)
        return _difference(mean_over_iterations(per_run, ["side", BOOT, *strata]), [BOOT, *strata], "mean")
    if method == "ensemble":
        mean = ensemble_predictions(drawn, ["side", BOOT, *strata, *ids], ("pred_probs", "labels"), WEIGHT)
        mean = mean.withColumn("labels", F.expr("CAST(round(labels) AS INT)"))
        return _difference(evaluate(mean, metrics, ["side", BOOT, *strata]), [BOOT, *strata], "performance")
    raise ValueError(f"method {method!r} is not known")


def compare_across_experiments(
    base: DataFrame, test: DataFrame, group: int, n_boot: int, metrics: Sequence[str] = DEFAULT_METRICS, seed: int = 44
) -> DataFrame:
    """Test phase and target group only, rows matched by (run, id)."""
    pick = (F.col("phase") == "test") & (F.col("group") == group)
    return compare_models(base.where(pick), test.where(F.col("phase") == "test"), "avg", (), n_boot, metrics, seed)
