"""Preprocessing queries, fitted on the training fold."""

from pyspark.sql import functions as F

from strataflow.operators import cohort as C
from strataflow.operators import preprocess as PP
from strataflow.operators import split as S
from strataflow.plans.cohorts import long_stay
from strataflow.plans.features import ALL_LONG, HCPCS_IDS, ICU_IDS, WIDE_IDS, feature_table, long_features, long_sql, rounded, wide_views
from strataflow.plans.registry import query, r
from strataflow.plans.splits import FOLD_VIEWS
from strataflow.session import cut_lineage

DEMO = ["insurance", "marital_status", "ethnicity", "language", "age", "gender"]


def safe(n: str) -> str:
    return n.replace(".", "_")


VIEWS = {
    **FOLD_VIEWS,
    **wide_views(),
    "tab": "SELECT t.*, f.fold_id FROM feature_tab t JOIN folds f ON t.subject_id = f.subject_id",
}


def folded(v):
    """Feature table with folds, written once: fits and transforms read it several times."""
    return cut_lineage(S.stratified_split(feature_table(v)))


@query("pp_fill_missing", f"""
SELECT subject_id, coalesce(marital_status, 'None') AS marital_status,
       {", ".join(r(f'coalesce("{n}", 0)') + f' AS "{n}"' for n in HCPCS_IDS)}, {rounded(ICU_IDS)}
FROM feature_tab""", VIEWS)
def _(v):
    out = PP.FillMissing(config={"count": 0, "marital_status": "None"}).transform(feature_table(v))
    return out.select("subject_id", "marital_status", *[F.col(f"`{n}`") for n in WIDE_IDS])


LONG_TRAIN = {**VIEWS, "all_long": long_sql(), "train_long": """
SELECT l.* FROM all_long l JOIN folds f ON l.subject_id = f.subject_id WHERE f.fold_id = 'train'"""}


def train_long(v):
    train = S.stratified_split(long_stay(v).select("subject_id", "label")).where("fold_id = 'train'")
    return cut_lineage(long_features(v).join(train.select("subject_id"), "subject_id"))


@query("pp_prune_features", """
SELECT feature_id, count(*) FILTER (feature_id NOT LIKE '%count%' OR feature_val <> 0) AS n_rows FROM train_long
GROUP BY feature_id HAVING count(*) FILTER (feature_id NOT LIKE '%count%' OR feature_val <> 0) > 25""", LONG_TRAIN)
def _(v):
    """All features in long form, kept when more than 25 training rows inform."""
    counts = PP.informative_counts_long(train_long(v), {"count": 0})
    return counts.where(F.col("n_rows") > 25)


@query("pp_prune_missing_cols", f"""
SELECT subject_id, label, {rounded(HCPCS_IDS[:4])}, 0.0::DOUBLE AS "H9_hcpcs_count_bin_-7_0" FROM feature_tab""", VIEWS)
def _(v):
    """A kept column that the frame lacks is created as 0."""
    model = PP.PruneFeaturesModel()._put(
        cols_to_keep=[*HCPCS_IDS[:4], "H9_hcpcs_count_bin_-7_0"], cols_removed=[], keep=["subject_id", "label"]
    )
    return model.transform(feature_table(v))


@query("pp_binarize", f"""
SELECT subject_id, {", ".join(f'(CASE WHEN "{n}" = 0 THEN 0 ELSE 1 END)::INTEGER AS "{n}"' for n in HCPCS_IDS)}
FROM feature_tab""", VIEWS)
def _(v):
    out = PP.BinaryDiscretizer(include=["count"]).transform(feature_table(v))
    return out.select("subject_id", *[F.col(f"`{n}`") for n in HCPCS_IDS])


@query("pp_quantile_fit", f"""
SELECT feature_id, count(*) AS n, {", ".join(r(f"round(quantile_cont(feature_val, {i / 5}), 4)") + f" AS e{i}" for i in range(1, 5))}
FROM train_long WHERE feature_type = 'measurement' GROUP BY feature_id""", LONG_TRAIN)
def _(v):
    long = train_long(v).where("feature_type = 'measurement'")
    e = PP.quantile_edges_long(long)
    return e.select("feature_id", "n", *[F.element_at("edges", i).alias(f"e{i}") for i in range(1, 5)])


def bins_sql(where: str, out_where: str = "TRUE") -> str:
    edges = ", ".join(
        f'round(quantile_cont("{safe(n)}", {i / 5}), 4) AS "{safe(n)}_e{i}"' for n in ICU_IDS for i in range(1, 5)
    )
    cols = []
    for n in map(safe, ICU_IDS):
        total = " + ".join(f'(t."{n}" >= e."{n}_e{i}")::INTEGER' for i in range(1, 5))
        cols.append(f'(CASE WHEN t."{n}" IS NULL THEN 0 ELSE 1 + coalesce({total}, 0) END)::INTEGER AS "{n}"')
    return f"""
SELECT t.subject_id, {", ".join(cols)} FROM tab t, (SELECT {edges} FROM tab WHERE {where}) e WHERE {out_where}"""


@query("pp_quantile_bin", bins_sql("fold_id = 'train'"), VIEWS)
def _(v):
    df = folded(v)
    model = PP.QuantileBins(n_bins=5, include=["measurement"]).fit(df.where("fold_id = 'train'"))
    return model.transform(df).select("subject_id", *[F.col(f"`{n}`") for n in ICU_IDS])


@query("pp_cross_group_apply", bins_sql(
    "fold_id = 'train' AND group_var = '1995 - 1996'", "t.fold_id = 'test' AND t.group_var = '2001 - 2001'"), VIEWS)
def _(v):
    """Fitted on one group's training fold, applied to another group's test fold."""
    df = folded(v)
    train = df.where("fold_id = 'train' AND group_var = '1995 - 1996'")
    model = PP.QuantileBins(n_bins=5, include=["measurement"]).fit(train)
    test = df.where("fold_id = 'test' AND group_var = '2001 - 2001'")
    return model.transform(test).select("subject_id", *[F.col(f"`{n}`") for n in ICU_IDS])


@query("pp_params", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{safe(n)}' AS feature, {i} AS edge_no, {r(f'round(quantile_cont("{safe(n)}", {i / 5}), 4)')} AS edge
FROM tab WHERE fold_id = 'train'""" for n in ICU_IDS for i in range(1, 5)) + ") WHERE edge IS NOT NULL", VIEWS)
def _(v):
    """Fitted cut points read back from the model's parameters."""
    df = folded(v)
    model = PP.QuantileBins(n_bins=5, include=["measurement"]).fit(df.where("fold_id = 'train'"))
    edges = PP.fitted_params(model)["edges"]
    rows = [(safe(n), i + 1, float(e)) for n, es in edges.items() for i, e in enumerate(es)]
    return v.spark.createDataFrame(rows, "feature string, edge_no int, edge double")


CATEGORIES = {
    "insurance": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "marital_status": ["F", "None", "O", "P"],
    "ethnicity": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "language": ["ENGLISH", "None", "OTHER"],
    "gender": ["F", "M"],
}


@query("pp_one_hot", "SELECT subject_id, age, " + ", ".join(
    f"(CASE WHEN coalesce({c}, 'None') = '{x}' THEN 1 ELSE 0 END)::INTEGER AS \"{c}_{x}\"" for c, xs in CATEGORIES.items() for x in xs)
    + " FROM tab", VIEWS)
def _(v):
    df = folded(v).select("subject_id", "label", "fold_id", *DEMO)
    step = PP.OneHotColumns(include=list(CATEGORIES))
    model = step.fit(df.where("fold_id = 'train'"))
    return model.transform(df).drop("label", "fold_id")


STEP_VIEWS = {
    **VIEWS,
    "steps_num": " UNION ALL ".join(
        f"""SELECT subject_id, fold_id, '{n}' AS f, {'coalesce("' + n + '", 0)' if "count" in n else '"' + n + '"'}::DOUBLE AS x FROM tab"""
        for n in map(safe, WIDE_IDS)
    ) + " UNION ALL SELECT subject_id, fold_id, 'age_measurement' AS f, age::DOUBLE AS x FROM tab",
    "steps_kept": """
SELECT f FROM steps_num WHERE fold_id = 'train' GROUP BY f
HAVING count(*) FILTER (x IS NOT NULL AND (f NOT LIKE '%count%' OR x <> 0)) > 25""",
    "steps_edges": """
SELECT f, round(quantile_cont(x, 0.2), 4) AS e1, round(quantile_cont(x, 0.4), 4) AS e2,
       round(quantile_cont(x, 0.6), 4) AS e3, round(quantile_cont(x, 0.8), 4) AS e4
FROM steps_num WHERE fold_id = 'train' AND f NOT LIKE '%count%' GROUP BY f""",
    "steps_binned": """
SELECT s.subject_id, s.fold_id, s.f,
       (CASE WHEN x IS NULL THEN 0 ELSE 1 + (x >= e1)::INTEGER + (x >= e2)::INTEGER + (x >= e3)::INTEGER + (x >= e4)::INTEGER END)::VARCHAR AS c
FROM steps_num s JOIN steps_edges e ON s.f = e.f JOIN steps_kept k ON s.f = k.f""",
    "steps_cat": """
SELECT subject_id, fold_id, f, c FROM steps_binned
UNION ALL SELECT subject_id, fold_id, 'insurance', insurance FROM tab
UNION ALL SELECT subject_id, fold_id, 'marital_status', coalesce(marital_status, 'None') FROM tab
UNION ALL SELECT subject_id, fold_id, 'ethnicity', ethnicity FROM tab
UNION ALL SELECT subject_id, fold_id, 'language', coalesce(language, 'None') FROM tab
UNION ALL SELECT subject_id, fold_id, 'gender', gender FROM tab""",
    "steps_vocab": "SELECT DISTINCT f, c FROM steps_cat WHERE fold_id = 'train'",
}


@query("pp_all_steps", """
SELECT fold_id, s.f AS feature, sum(CASE WHEN x = 0 THEN 0 ELSE 1 END)::BIGINT AS total
FROM steps_num s JOIN steps_kept k ON s.f = k.f WHERE s.f LIKE '%count%' GROUP BY fold_id, s.f
UNION ALL
SELECT s.fold_id, v.f || '_' || v.c AS feature, count(*) FILTER (s.c = v.c)::BIGINT AS total
FROM steps_vocab v JOIN steps_cat s ON s.f = v.f GROUP BY s.fold_id, v.f, v.c""", STEP_VIEWS)
def _(v):
    """All steps in their fixed order; the 0/1 output columns summed per fold."""
    df = PP.rename_for_tags(folded(v))
    df = df.withColumnsRenamed({n: safe(n) for n in WIDE_IDS})
    out = PP.standard_steps().fit(df.where("fold_id = 'train'")).transform(df)
    names = [c for c in out.columns if c not in ("subject_id", "label", "group_var", "fold_id")]
    sums = out.groupBy("fold_id").agg(*[F.sum(F.col(f"`{n}`")).cast("bigint").alias(n) for n in names])
    return sums.unpivot(["fold_id"], names, "feature", "total")


ALL_VIEWS = {
    **{n.replace("steps_", "mat_all_"): sql.replace("steps_", "mat_all_") for n, sql in STEP_VIEWS.items()},
    **ALL_LONG,
    "mat_all_num": """
SELECT p.subject_id, p.fold_id, w.feature_id AS f,
       (CASE WHEN w.feature_id LIKE '%count%' THEN coalesce(l.feature_val, 0) ELSE l.feature_val END)::DOUBLE AS x
FROM folds p CROSS JOIN (SELECT DISTINCT feature_id FROM all_long) w
LEFT JOIN all_long l ON l.subject_id = p.subject_id AND l.feature_id = w.feature_id
UNION ALL SELECT subject_id, fold_id, 'age_measurement', age::DOUBLE FROM tab""",
}


@query("pp_all_long", """
SELECT fold_id, s.f AS feature, sum(CASE WHEN x = 0 THEN 0 ELSE 1 END)::BIGINT AS total
FROM mat_all_num s JOIN mat_all_kept k ON s.f = k.f WHERE s.f LIKE '%count%' GROUP BY fold_id, s.f
UNION ALL
SELECT s.fold_id, v.f || '_' || v.c AS feature, count(*) FILTER (s.c = v.c)::BIGINT AS total
FROM mat_all_vocab v JOIN mat_all_cat s ON s.f = v.f GROUP BY s.fold_id, v.f, v.c""", ALL_VIEWS)
def _(v):
    """All steps over all features of the seven sources, in long form."""
    rows = cut_lineage(S.stratified_split(C.demographics(long_stay(v), v.admissions, v.patients)))
    age = rows.selectExpr("subject_id", "'age_measurement' AS feature_id", "CAST(age AS DOUBLE) AS feature_val")
    long = long_features(v).select("subject_id", "feature_id", "feature_val").unionByName(age)
    long = cut_lineage(long.join(rows.select("subject_id", "fold_id"), "subject_id"))
    fitted = cut_lineage(PP.fit_steps_long(long.where("fold_id = 'train'")))
    totals = PP.step_totals_long(rows, PP.apply_steps_long(long, fitted), fitted)
    # text columns: filled, pruned and one-hot encoded; few of them, so in wide form
    text = rows.select("subject_id", "label", "group_var", "fold_id", *[c for c in DEMO if c != "age"])
    out = PP.standard_steps().fit(text.where("fold_id = 'train'")).transform(text)
    names = [c for c in out.columns if c not in ("subject_id", "label", "group_var", "fold_id")]
    sums = out.groupBy("fold_id").agg(*[F.sum(F.col(f"`{n}`")).cast("bigint").alias(n) for n in names])
    return totals.unionByName(sums.unpivot(["fold_id"], names, "feature", "total"))
