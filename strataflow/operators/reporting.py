"""Intervals, significance marks and text tables from replicate tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.functions.scalar import category_position, count_percent, interval_text, mean_sd, ratio, remap
from strataflow.operators.bootstrap import quantile_interval
from strataflow.operators.metrics import P, confusion, from_confusion, prepare

# Report labels of metrics, methods, tasks and groups.
METRIC_LABELS = {"auc": "AUROC", "auprc": "AUPRC", "ace_abs_logistic_log": "Calibration"}
METHOD_LABELS = {"al_layer": "AL", "coral": "CORAL", "erm": "ERM", "irm": "IRM", "dro": "GroupDRO"}
TASK_LABELS = {
    "longlos": "Long LOS",
    "sepsis": "Sepsis",
    "mortality": "Mortality",
    "invasivevent": "Invasive Ventilation",
}
# Order of the rows of the cohort description.
DESCRIPTION_ORDER = (
    "Sample Size",
    "Age",
    "Gender (Female)",
    "Gender (Male)",
    "Ethnicity (White)",
    "Ethnicity (Non-white)",
)
# Measures of the expected-count table.
CLINICAL_MEASURES = ("Sensitivity", "Specificity", "PPV", "NPV", "TP", "TN", "FP", "FN")


def collect_ci(df: DataFrame, keys: Sequence[str], value: str = "performance", alpha: float = 0.01) -> DataFrame:
    """Quantiles alpha/2, 1/2, 1 - alpha/2 of the replicates per key."""
    return quantile_interval(df, keys, value, alpha)


def significance(ci: DataFrame) -> DataFrame:
    """``sig`` is ``*`` when the interval leaves out zero."""
    flag = F.when(F.col("ci_lower") * F.col("ci_upper") > 0, "*").otherwise("")
    return ci.withColumn("sig", flag)


def join_significance(results: DataFrame, comparison_ci: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Results with the mark of their comparison; without one the mark is empty."""
    marks = significance(comparison_ci).select(*keys, "sig")
    return results.join(marks, list(keys), "left").withColumn("sig", F.coalesce("sig", F.lit("")))


def performance_text(df: DataFrame) -> DataFrame:
    text = interval_text(F.col("ci_med"), F.col("ci_lower"), F.col("ci_upper"), F.coalesce("sig", F.lit("")))
    return df.withColumn("Performance", text)


def results_table(
    df: DataFrame,
    index: Sequence[str],
    columns: Sequence[str],
    cells: Sequence[tuple],
    labels: Mapping[str, Mapping] | None = None,
) -> DataFrame:
    """Text table: one row per ``index``, one column per listed combination of ``columns``.

    Missing column values count as a blank; the list keeps the report order. Two rows
    for one cell are refused.
    """
    out = performance_text(df)
    for col, mapping in (labels or {}).items():
        out = out.withColumn(col, remap(F.col(col), mapping))
    heading = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in columns])
    names = [" | ".join(str(v) for v in cell) for cell in cells]
    twice = F.raise_error(F.concat(F.lit("more than one value for the cell "), F.col("__h"))).cast("string")
    single = F.when(F.count("*") > 1, twice).otherwise(F.first("Performance")).alias("Performance")
    cell = out.withColumn("__h", heading).groupBy(*index, "__h").agg(single)
    wide = cell.groupBy(*index).pivot("__h", names).agg(F.first("Performance"))
    return wide.na.fill(" ", names)


def group_counts(demo: DataFrame, group: str = "group_var") -> DataFrame:
    """Count, mean, sample deviation and sums per group."""
    return demo.groupBy(group).agg(
        F.count("subject_id").alias("n"),
        F.sum("label").alias("n_pos"),
        F.avg("age").alias("age_mean"),
        F.stddev_samp("age").alias("age_sd"),
        F.count_if(F.col("gender") == "F").alias("n_female"),
        F.count_if(F.col("ethnicity") == "WHITE").alias("n_white"),
    )


def melt_description(counts: DataFrame, group: str = "group_var") -> DataFrame:
    """``group, variable, value`` with formatted text."""
    n = F.col("n")
    cells = {
        "Sample Size": count_percent(n, n, 1) if "n_pos" not in counts.columns else F.format_string(
            "%d (%.1f%%)", n, ratio(F.col("n_pos") * 100.0, n)
        ),
        "Age": mean_sd(F.col("age_mean"), F.col("age_sd")),
        "Gender (Female)": count_percent(F.col("n_female"), n),
        "Gender (Male)": count_percent(n - F.col("n_female"), n),
        "Ethnicity (White)": count_percent(F.col("n_white"), n),
        "Ethnicity (Non-white)": count_percent(n - F.col("n_white"), n),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("variable"), v.alias("value")) for k, v in cells.items()])
    return counts.select(F.col(group), F.explode(pairs).alias("x")).select(
        group, F.col("x.variable").alias("variable"), F.col("x.value").alias("value")
    )


def cohort_descriptives(demo: DataFrame, groups: Sequence[str], group: str = "group_var") -> DataFrame:
    """Description table: a row per variable in report order, a column per group."""
    melted = melt_description(group_counts(demo, group), group)
    wide = melted.groupBy("variable").pivot(group, list(groups)).agg(F.first("value"))
    return wide.orderBy(category_position(F.col("variable"), DESCRIPTION_ORDER))


def feature_counts(long: DataFrame, tags: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Number of distinct features per bin and source, with a total."""
    keys = [*extra, "bin_left", "bin_right"]
    ids = long.select(*keys, F.concat_ws("_", "feature_tag", "feature_type").alias("tag"), "feature_id").distinct()
    wide = ids.groupBy(*keys).pivot("tag", list(tags)).agg(F.count("feature_id"))
    wide = wide.na.fill(0, list(tags))
    total = sum((F.col(t) for t in tags[1:]), F.col(tags[0]))
    return wide.withColumn("total", total)


def clinical_counts(
    predictions: DataFrame, model: str, thresholds: Sequence[float], prevalence: float, n_patients: int = 100
) -> DataFrame:
    """Expected counts per ``n_patients`` at each threshold, from mean sensitivity and specificity.

    All thresholds are counted in one pass. Counts round half to even.
    """
    base = prepare(predictions, [model, "iter"])
    cells = []
    for t in map(float, thresholds):
        c = confusion(f"{P} > {t!r}D")
        rates = ", ".join(f"'{m}', {from_confusion(m, c)}" for m in ("sensitivity", "specificity"))
        cells.append(f"named_struct('t', {t!r}D, {rates})")
    per_run = base.groupBy(model, "iter").agg(F.expr(f"array({', '.join(cells)}) AS c"))
    means = per_run.selectExpr(model, "inline(c)").groupBy(model, F.col("t").alias("threshold")).agg(
        F.expr("avg(sensitivity) AS sensitivity"), F.expr("avg(specificity) AS specificity")
    )
    pos = float(round(n_patients * prevalence))
    neg = float(n_patients - pos)
    counted = (
        means.withColumn("TP", F.bround(pos * F.col("sensitivity")))
        .withColumn("TN", F.bround(neg * F.col("specificity")))
        .withColumn("FN", pos - F.col("TP"))
        .withColumn("FP", neg - F.col("TN"))
    )
    return counted.select(
        model,
        "threshold",
        F.round("sensitivity", 2).alias("Sensitivity"),
        F.round("specificity", 2).alias("Specificity"),
        F.round(ratio(F.col("TP"), F.col("TP") + F.col("FP")), 2).alias("PPV"),
        F.round(ratio(F.col("TN"), F.col("TN") + F.col("FN")), 2).alias("NPV"),
        "TP",
        "TN",
        "FP",
        "FN",
    )


def clinical_table(counts: DataFrame, model: str, thresholds: Sequence[float]) -> DataFrame:
    """Measures x models by threshold."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v")) for m in CLINICAL_MEASURES]
    )
    melted = counts.select(model, "threshold", F.explode(pairs).alias("x"))
    names = [f"t_{t}" for t in thresholds]
    return (
        melted.select(model, F.col("x.m").alias("Metric"), F.concat(F.lit("t_"), F.col("threshold").cast("string")).alias("t"), F.col("x.v").alias("v"))
        .groupBy("Metric", model)
        .pivot("t", names)
        .agg(F.first("v"))
    )


def lambda_sweep(ci: DataFrame, keys: Sequence[str], base: DataFrame, oracle: DataFrame, join: Sequence[str]) -> DataFrame:
    """Long interval rows by lambda with the levels of the plain and the oracle model."""
    levels = base.select(*join, F.col("ci_med").alias("erm_level")).join(
        oracle.select(*join, F.col("ci_med").alias("oracle_level")), list(join), "left"
    )
    long = ci.where(F.col("lambda") != -1)
    pairs = F.array(*[F.struct(F.lit(c).alias("bound"), F.col(c).alias("v")) for c in ("ci_lower", "ci_med", "ci_upper")])
    melted = long.select(*keys, F.explode(pairs).alias("x")).select(
        *keys, F.col("x.bound").alias("bound"), F.col("x.v").alias("performance")
    )
    return melted.join(levels, list(join), "left")


def year_series(ci: DataFrame, first_group: str, train: str = "train_group", evaluated: str = "eval_group") -> DataFrame:
    """Base model over all groups and the retrained models, with distances of the interval ends."""
    dist = ci.withColumns(
        {
            "err_low": F.abs(F.col("ci_lower") - F.col("ci_med")),
            "err_high": F.abs(F.col("ci_upper") - F.col("ci_med")),
        }
    )
    is_base, is_own = F.col(train) == first_group, F.col(train) == F.col(evaluated)
    series = F.array_compact(F.array(F.when(is_base, "base"), F.when(is_own, "retrained")))
    return dist.where(is_base | is_own).withColumn("series", F.explode(series)).drop("ci_lower", "ci_upper")


def collect_files(
    spark: SparkSession, folder: str, schema: str, fragments: Sequence[str] = ()
) -> DataFrame:
    """Rows of all CSV files of a folder whose name holds every fragment, with ``file_name``.

    Names are file metadata; a writer leaves each result in a folder of its own name.
    """
    df = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(folder)
    df = df.select("*", F.col("_metadata.file_path").alias("__path"))
    name = F.element_at(F.split("__path", "/"), -2)
    out = df.withColumn("file_name", name).drop("__path")
    for f in fragments:
        out = out.where(F.col("file_name").contains(f))
    return out


def lambda_from_name(name: Column) -> Column:
    """Value after ``lambda_`` in a file name, else -1."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"lambda_([^_]+)", 1), F.lit("")).try_cast("double"), F.lit(-1.0))
