"""Preprocessing steps, fitted on the training fold only.

Wide frames use ``pyspark.ml`` estimators and transformers whose fitted state
is JSON parameters. Long frames (``feature_id, feature_val``) use the ``*_long``
functions, which never build thousands of columns.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.operators.running import exact_quantiles


def select_by_tags(
    columns: Sequence[str], include: Sequence[str] = (), exclude: Sequence[str] = ()
) -> list[str]:
    """Columns whose name holds one of ``include`` (all, if empty) and none of ``exclude``."""
    return [
        c
        for c in columns
        if (not include or any(t in c for t in include)) and not any(t in c for t in exclude)
    ]


def _c(name: str) -> Column:
    """Column by its literal name; feature names hold dots."""
    return F.col(f"`{name}`")


class _State(Params):
    """One JSON parameter holds settings or fitted state."""

    state = Param(Params._dummy(), "state", "settings and fitted values as JSON", TypeConverters.toString)

    def _put(self, **values):
        current = self.get_params()
        current.update(values)
        return self._set(state=json.dumps(current))

    def get_params(self) -> dict:
        """Settings and, on models, the fitted values."""
        return json.loads(self.getOrDefault(self.state)) if self.isSet(self.state) else {}


class _Step(_State, DefaultParamsReadable, DefaultParamsWritable):
    pass


def _rewrite(df: DataFrame, changed: Mapping[str, Column]) -> DataFrame:
    """One projection: changed columns replaced in place, new ones appended."""
    new = [c.alias(n) for n, c in changed.items() if n not in df.columns]
    return df.select(*[changed[n].alias(n) if n in changed else _c(n) for n in df.columns], *new)


class FillMissing(Transformer, _Step):
    """Fill NULL in the columns whose name holds a tag."""

    @keyword_only
    def __init__(self, config=None):
        super().__init__()
        self._put(config=config or {})

    def _transform(self, df):
        changed = {}
        for tag, value in self.get_params()["config"].items():
            for name in select_by_tags(df.columns, [tag]):
                changed[name] = F.coalesce(changed.get(name, _c(name)), F.lit(value))
        return _rewrite(df, changed)


class PruneFeatures(Estimator, _Step):
    """Keep columns with more than ``thresh`` informative rows.

    NULL is never informative; in columns whose name holds the tag of
    ``special_cols`` neither is the value given there.
    """

    @keyword_only
    def __init__(self, thresh=25, special_cols=None, keep=("subject_id", "label", "fold_id")):
        super().__init__()
        self._put(thresh=thresh, special_cols=special_cols or {}, keep=list(keep))

    def _fit(self, df):
        p = self.get_params()
        names = [c for c in df.columns if c not in p["keep"]]
        counts = []
        for name in names:
            special = next((v for t, v in p["special_cols"].items() if t in name), None)
            ok = _c(name).isNotNull() if special is None else _c(name) != F.lit(special)
            counts.append(F.count_if(ok))
        row = df.agg(F.array(*counts)).first()[0] if names else []
        kept = [n for n, c in zip(names, row) if c > p["thresh"]]
        model = PruneFeaturesModel()
        return model._put(cols_to_keep=kept, cols_removed=[n for n in names if n not in kept], keep=p["keep"])


class PruneFeaturesModel(Model, _Step):
    def _transform(self, df):
        p = self.get_params()
        ids = [c for c in p["keep"] if c in df.columns]
        return df.select(
            *ids,
            *[_c(n) if n in df.columns else F.lit(0.0).alias(n) for n in p["cols_to_keep"]],
        )


class BinaryDiscretizer(Transformer, _Step):
    """0 stays 0, anything else, NULL too, becomes 1."""

    @keyword_only
    def __init__(self, include=(), exclude=()):
        super().__init__()
        self._put(include=list(include), exclude=list(exclude))

    def _transform(self, df):
        p = self.get_params()
        names = select_by_tags(df.columns, p["include"], p["exclude"])
        return _rewrite(df, {n: F.when(_c(n) == 0, 0).otherwise(1) for n in names})


class QuantileBins(Estimator, _Step):
    """Cut points per column at equal shares of its non-NULL values."""

    @keyword_only
    def __init__(self, n_bins=5, include=(), exclude=(), digits=4):
        super().__init__()
        self._put(n_bins=n_bins, include=list(include), exclude=list(exclude), digits=digits)

    def _fit(self, df):
        p = self.get_params()
        names = select_by_tags(df.columns, p["include"], p["exclude"])
        edges = {n: [] for n in names}
        if names:
            fitted = quantile_edges_long(unpivot_features(df, names), p["n_bins"], p["digits"])
            edges.update({r["feature_id"]: list(r["edges"]) for r in fitted.collect()})
        return QuantileBinsModel()._put(edges=edges, n_bins=p["n_bins"])


class QuantileBinsModel(Model, _Step):
    def _transform(self, df):
        edges = self.get_params()["edges"]
        return _rewrite(
            df, {n: bin_number(_c(n), [F.lit(float(e)) for e in es]) for n, es in edges.items() if n in df.columns}
        )


class OneHotColumns(Estimator, _Step):
    """One 0/1 column per column and category; unknown categories give all zeros.

    The categories become column names, so their number is that of the output's
    columns; ``one_hot_long`` gives the same as rows, for any number of them.
    """

    @keyword_only
    def __init__(self, include=(), exclude=(), categories=None, drop=None):
        super().__init__()
        self._put(
            include=list(include),
            exclude=list(exclude),
            categories=categories or {},
            drop=drop,
        )

    def _fit(self, df):
        p = self.get_params()
        names = select_by_tags(df.columns, p["include"], p["exclude"])
        found = {n: list(map(str, p["categories"][n])) for n in names if n in p["categories"]}
        open_names = [n for n in names if n not in found]
        if open_names:
            rows = category_counts(df, open_names).select("feature_id", "category").collect()
            for n in open_names:
                found[n] = sorted(r["category"] for r in rows if r["feature_id"] == n)
        if p["drop"] == "first":
            found = {n: c[1:] for n, c in found.items()}
        return OneHotColumnsModel()._put(categories={n: found[n] for n in names})


class OneHotColumnsModel(Model, _Step):
    def output_columns(self) -> list[str]:
        return [f"{n}_{c}" for n, cats in self.get_params()["categories"].items() for c in cats]

    def _transform(self, df):
        cats = self.get_params()["categories"]
        rest = [_c(n) for n in df.columns if n not in cats]
        hot = [
            F.when(category_text(_c(n)) == c, 1).otherwise(0).alias(f"{n}_{c}")
            for n, values in cats.items()
            for c in values
        ]
        return df.select(*rest, *hot)


def category_text(col: Column) -> Column:
    """Category as text; NULL is a category of its own."""
    return F.coalesce(col.cast("string"), F.lit("None"))


def unpivot_features(df: DataFrame, names: Sequence[str], as_text: bool = False) -> DataFrame:
    """Wide to long (``feature_id, feature_val``) without other columns."""
    cast = (lambda n: category_text(_c(n))) if as_text else (lambda n: _c(n).cast("double"))
    pairs = F.array(*[F.struct(F.lit(n).alias("n"), cast(n).alias("v")) for n in names])
    return df.select(F.explode(pairs).alias("p")).select(
        F.col("p.n").alias("feature_id"), F.col("p.v").alias("feature_val")
    )


def category_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return (
        unpivot_features(df, names, as_text=True)
        .groupBy("feature_id", F.col("feature_val").alias("category"))
        .agg(F.count("*").alias("n_rows"))
    )


def category_vocabulary(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``feature_id, category, idx``: every category of the columns with a dense index, as a table."""
    from strataflow.operators.features import vocabulary

    words = category_counts(df, names).select(F.to_json(F.array("feature_id", "category")).alias("feature_id"))
    parts = F.from_json("feature_id", "array<string>")
    return vocabulary(words).select(parts[0].alias("feature_id"), parts[1].alias("category"), "idx")


def one_hot_long(df: DataFrame, names: Sequence[str], vocabulary: DataFrame, id_col: str = "subject_id") -> DataFrame:
    """``id, idx``: the ones of each row, by the fitted vocabulary; unknown categories give none."""
    pairs = F.array(*[F.struct(F.lit(n).alias("n"), category_text(_c(n)).alias("v")) for n in names])
    rows = df.select(id_col, F.explode(pairs).alias("p"))
    rows = rows.select(id_col, F.col("p.n").alias("feature_id"), F.col("p.v").alias("category"))
    return rows.join(vocabulary, ["feature_id", "category"]).select(id_col, "idx")


def quantile_edges_long(long: DataFrame, n_bins: int = 5, digits: int = 4) -> DataFrame:
    """``feature_id, n, edges``: exact inner cut points, rounded."""
    probs = [i / n_bins for i in range(1, n_bins)]
    fitted = exact_quantiles(long, ["feature_id"], "feature_val", probs)
    return fitted.select(
        "feature_id", "n", F.transform("q", lambda e: F.round(e, digits)).alias("edges")
    )


def bin_number(x: Column, inner_edges: Sequence[Column]) -> Column:
    """1 + number of inner edges not above x; NULL gives 0."""
    above = F.lit(1)
    for e in inner_edges:
        above = above + F.when(x >= e, 1).otherwise(0)
    return F.when(x.isNull(), 0).otherwise(above).cast("int")


def bin_long(long: DataFrame, edges: DataFrame) -> DataFrame:
    """Replace values of the fitted features by their bin number."""
    n_low = F.size(F.filter("edges", lambda e: e <= F.col("feature_val")))
    return (
        long.join(edges.select("feature_id", "edges"), "feature_id")
        .withColumn("feature_val", F.when(F.col("feature_val").isNull(), 0).otherwise(1 + n_low).cast("double"))
        .drop("edges")
    )


def informative_counts_long(long: DataFrame, special: Mapping[str, float] | None = None) -> DataFrame:
    """Informative rows per feature: not NULL and not the tagged value."""
    ok = F.col("feature_val").isNotNull()
    for tag, value in (special or {}).items():
        ok = ok & (~F.col("feature_id").contains(tag) | (F.col("feature_val") != F.lit(value)))
    return long.groupBy("feature_id").agg(F.count_if(ok).alias("n_rows"))


def prune_long(long: DataFrame, thresh: int = 25, special: Mapping[str, float] | None = None) -> DataFrame:
    """Rows of the features kept by the strict threshold."""
    kept = informative_counts_long(long, special).where(F.col("n_rows") > thresh).select("feature_id")
    return long.join(kept, "feature_id", "left_semi")


def fit_steps_long(train: DataFrame, thresh: int = 25, n_bins: int = 5) -> DataFrame:
    """``feature_id, edges`` of the kept features; counts have no edges."""
    kept = prune_long(train, thresh, {"count": 0})
    edges = quantile_edges_long(kept.where(~F.col("feature_id").contains("count")), n_bins).select("feature_id", "edges")
    return kept.select("feature_id").distinct().join(edges, "feature_id", "left")


def apply_steps_long(long: DataFrame, fitted: DataFrame) -> DataFrame:
    """Rows of the kept features with ``category``: 1 for counts, the bin number for measurements.

    What has no row is 0: a count of 0, or a measurement that is missing.
    """
    n_low = F.size(F.filter("edges", lambda e: e <= F.col("feature_val")))
    number = F.when(F.col("feature_id").contains("count"), F.lit(1)).otherwise(1 + n_low)
    shown = F.col("feature_val").isNotNull() & (~F.col("feature_id").contains("count") | (F.col("feature_val") != 0))
    binned = long.join(fitted, "feature_id").where(shown)
    return binned.withColumn("category", number.cast("string")).drop("edges", "feature_val")


def step_totals_long(rows: DataFrame, binned: DataFrame, fitted: DataFrame) -> DataFrame:
    """``fold_id, feature, total``: ones per fold of the 0/1 columns the steps would make, zeros too.

    ``rows`` (fold_id) holds every patient, ``binned`` has fold_id. Bin 0 is counted as
    the patients without a row; categories are those of the training fold.
    """
    sizes = rows.groupBy("fold_id").agg(F.count("*").alias("n"))
    grid = sizes.crossJoin(fitted.select("feature_id"))
    found = binned.groupBy("fold_id", "feature_id", "category").agg(F.count("*").alias("total"))
    present = found.groupBy("fold_id", "feature_id").agg(F.sum("total").alias("present"))
    missing = (
        grid.where(~F.col("feature_id").contains("count"))
        .join(present, ["fold_id", "feature_id"], "left")
        .select("fold_id", "feature_id", F.lit("0").alias("category"), (F.col("n") - F.coalesce("present", F.lit(0))).alias("total"))
    )
    every = found.unionByName(missing)
    words = every.where("fold_id = 'train' AND total > 0").select("feature_id", "category")
    words = words.unionByName(
        fitted.where(F.col("feature_id").contains("count")).select("feature_id", F.lit("1").alias("category"))
    ).distinct()
    totals = sizes.select("fold_id").crossJoin(words).join(every, ["fold_id", "feature_id", "category"], "left")
    name = F.when(F.col("feature_id").contains("count"), F.col("feature_id")).otherwise(F.concat_ws("_", "feature_id", "category"))
    return totals.select("fold_id", name.alias("feature"), F.coalesce("total", F.lit(0)).cast("bigint").alias("total"))


def standard_steps(
    thresh: int = 25, n_bins: int = 5, keep: Sequence[str] = ("subject_id", "label", "group_var", "fold_id")
) -> Pipeline:
    """Fill, prune, binarise counts, bin measurements, one-hot: the fixed order."""
    return Pipeline(
        stages=[
            FillMissing(config={"count": 0, "marital_status": "None"}),
            PruneFeatures(thresh=thresh, special_cols={"count": 0}, keep=tuple(keep)),
            BinaryDiscretizer(include=("count",)),
            QuantileBins(n_bins=n_bins, include=("measurement",)),
            OneHotColumns(exclude=("count", *keep)),
        ]
    )


def rename_for_tags(df: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """``age`` becomes ``age_measurement`` so that the measurement steps take it."""
    return df.withColumnsRenamed(dict(names or {"age": "age_measurement"}))


def fitted_params(stage) -> dict:
    """Settings and fitted values of one step or of all steps of a fitted sequence."""
    if hasattr(stage, "stages"):
        return {type(s).__name__: s.get_params() for s in stage.stages}
    return stage.get_params()
