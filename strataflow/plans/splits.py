"""Split, sample and dataset queries."""

import hashlib

from pyspark.sql import functions as F

from strataflow.operators import cohort as C
from strataflow.operators import features as X
from strataflow.operators import split as S
from strataflow.plans.cohorts import COHORT_SQL, long_stay
from strataflow.plans.features import ALL_LONG, WIDE_IDS, feature_table, long_features, rounded, wide_long, wide_views
from strataflow.plans.registry import query, r
from strataflow.plans.sqltext import folds_sql
from strataflow.session import cut_lineage
from strataflow.sources.fixtures import LAST_GROUP

FOLD_VIEWS = {
    **COHORT_SQL,
    "folds": folds_sql("cohort", S.FOLDS),
    "mort_folds": folds_sql("mort", S.FOLDS),
    "rest": f"SELECT * FROM cohort WHERE group_var <> '{LAST_GROUP}' AND subject_id NOT IN "
    "(SELECT subject_id FROM folds WHERE fold_id = 'test')",
    "late": """
SELECT * EXCLUDE (rank0, n), CASE WHEN rank0 < floor(0.35::DOUBLE / 0.85::DOUBLE * n) THEN 'val' ELSE 'train' END AS fold_id
FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', 44, subject_id)), subject_id) - 1 AS rank0,
             count(*) OVER () AS n FROM rest WHERE group_var = '1999 - 2000')""",
    "domain_gen": """
SELECT subject_id, label, group_var, 'test' AS fold_id FROM cohort
WHERE subject_id IN (SELECT subject_id FROM folds WHERE fold_id = 'test')
UNION ALL SELECT subject_id, label, group_var, fold_id FROM late
UNION ALL SELECT subject_id, label, group_var, 'train' FROM rest WHERE group_var <> '1999 - 2000'""",
}
KEYS = ("subject_id", "label", "group_var")


def folds(v):
    return S.stratified_split(long_stay(v).select(*KEYS))


def domain_gen(v):
    cohort = long_stay(v).select(*KEYS)
    test = folds(v).where("fold_id = 'test'")
    return S.domain_generalisation_split(cohort, test, LAST_GROUP, "1999 - 2000")


@query("spl_stratified3", "SELECT subject_id, label, group_var, fold_id FROM folds", FOLD_VIEWS)
def _(v):
    return folds(v)


@query("spl_stratified2", "SELECT subject_id, label, fold_id FROM two", {"two": folds_sql("cohort", {"train": 0.8, "test": 0.2}, seed=7)})
def _(v):
    return S.stratified_split(long_stay(v).select("subject_id", "label"), {"train": 0.8, "test": 0.2}, seed=7)


@query("spl_by_ids", """
SELECT s.subject_id, s.label, f.fold_id FROM seps s JOIN mort_folds f ON s.subject_id = f.subject_id""", FOLD_VIEWS)
def _(v):
    """Folds fixed on one cohort, applied to another."""
    fixed = S.stratified_split(C.mortality_cohort(v.icustays, v.patients, v.admissions))
    other = C.sepsis_cohort(v.icustays, v.patients, v.admissions, v.sepsis3).select("subject_id", "label")
    return S.split_by_ids(other, fixed)


@query("spl_domain_gen", "SELECT * FROM domain_gen", FOLD_VIEWS)
def _(v):
    return domain_gen(v)


@query("spl_domain_adapt", f"""
SELECT * FROM domain_gen UNION ALL
SELECT subject_id, label, group_var, 'train' FROM (
  SELECT * FROM folds WHERE fold_id = 'train' AND group_var = '{LAST_GROUP}'
  ORDER BY md5(concat_ws('|', 44, subject_id)), subject_id LIMIT 50)""", FOLD_VIEWS)
def _(v):
    target = folds(v).where((F.col("fold_id") == "train") & (F.col("group_var") == LAST_GROUP)).drop("fold_id")
    return S.domain_adaptation_augment(domain_gen(v), target, 50)


FIVE = {str(i): 0.2 for i in range(1, 6)}


@query("spl_fold_roles", """
SELECT subject_id, fold_id, CASE fold_id WHEN '5' THEN 'test' WHEN '2' THEN 'val' ELSE 'train' END AS role FROM five""",
       {"five": folds_sql("cohort", FIVE)})
def _(v):
    five = S.stratified_split(long_stay(v).select("subject_id", "label"), FIVE)
    return S.fold_roles(five, val_fold="2", test_fold="5").select("subject_id", "fold_id", "role")


@query("smp_n_ood", f"""
SELECT subject_id, label FROM cohort WHERE group_var = '{LAST_GROUP}'
ORDER BY md5(concat_ws('|', 44, subject_id)), subject_id LIMIT 100""")
def _(v):
    target = long_stay(v).where(F.col("group_var") == LAST_GROUP).select("subject_id", "label")
    return S.sample_rows(target, 100, "subject_id")


_ALL_COLS = ["subject_id", "label", "group_var", "insurance", "marital_status", "ethnicity", "language", "age", "gender", *WIDE_IDS]
_PICKED = sorted(_ALL_COLS[5:], key=lambda c: hashlib.md5(f"44|{c}".encode()).hexdigest())[:12]


def _sample_cols() -> str:
    keep = _ALL_COLS[:5] + [c for c in _ALL_COLS[5:] if c in set(_PICKED)]
    return ", ".join(rounded([c]) if c in WIDE_IDS else c for c in keep)


@query("smp_rows_cols", f"""
SELECT {_sample_cols()} FROM feature_tab ORDER BY md5(concat_ws('|', 44, subject_id)), subject_id LIMIT 200""", wide_views())
def _(v):
    return S.sample_frame(feature_table(v), n_rows=200, n_cols=12)


N_DRAWS = 25_600


@query("smp_group_balanced", f"""
SELECT k AS draw, p.subject_id, p.group_var FROM (
  SELECT d.k, (('0x' || substr(md5(concat_ws('|', '44|draw', d.k)), 1, 15))::BIGINT % t.total)::BIGINT AS at
  FROM (SELECT unnest(range(1, {N_DRAWS + 1})) AS k) d, (SELECT sum(weight)::BIGINT AS total FROM placed) t) x
JOIN placed p ON x.at >= p.before AND x.at < p.before + p.weight""", {
    "sizes": "SELECT group_var, floor(sum(count(*)) OVER () / count(*))::BIGINT AS weight FROM cohort GROUP BY group_var",
    "placed": """
SELECT c.subject_id, c.group_var, s.weight,
       coalesce(sum(s.weight) OVER (ORDER BY md5(concat_ws('|', 44, c.subject_id)), c.subject_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
FROM cohort c JOIN sizes s ON c.group_var = s.group_var"""})
def _(v):
    cohort = long_stay(v).select("subject_id", "group_var")
    return S.group_balanced_sample(cohort, "group_var", "subject_id", N_DRAWS)


@query("agg_group_weights", """
SELECT group_var, count(*) AS n, floor(sum(count(*)) OVER () / count(*))::BIGINT AS weight FROM cohort GROUP BY group_var""")
def _(v):
    return S.group_weights(long_stay(v), "group_var")


@query("smp_domain_weights", f"""
SELECT subject_id, {r(f"CASE WHEN group_var = '{LAST_GROUP}' THEN 0.0 ELSE n / src END")} AS sample_weight
FROM cohort, (SELECT count(*)::DOUBLE AS n, count(*) FILTER (group_var <> '{LAST_GROUP}') AS src FROM cohort)""")
def _(v):
    out = S.domain_weights(long_stay(v), F.col("group_var") == LAST_GROUP)
    return out.select("subject_id", "sample_weight")


@query("ds_sparse_vectors", f"""
SELECT subject_id, count(*) FILTER (feature_val <> 0) AS n_entries, {r("sum(feature_val)")} AS total
FROM wide_long GROUP BY subject_id""", wide_views())
def _(v):
    """Long features to sparse vectors and back to arrays."""
    return sparse_totals(wide_long(v))


@query("ds_sparse_all", f"""
SELECT subject_id, count(*) FILTER (feature_val <> 0) AS n_entries, {r("sum(feature_val)")} AS total
FROM all_long GROUP BY subject_id""", ALL_LONG)
def _(v):
    """The same over all seven sources."""
    return sparse_totals(cut_lineage(long_features(v)))


def sparse_totals(long):
    from pyspark.ml.functions import vector_to_array

    vocab = X.vocabulary(long)
    size = vocab.count()
    vectors = S.long_to_sparse(long, vocab, size).withColumn("a", vector_to_array("features"))
    return vectors.select(
        "subject_id",
        F.size(F.filter("a", lambda x: x != 0)).cast("bigint").alias("n_entries"),
        F.aggregate("a", F.lit(0.0), lambda acc, x: acc + x).alias("total"),
    )


@query("ds_stack_folds", """
SELECT fold_id, subject_id, label, group_var FROM folds""", FOLD_VIEWS)
def _(v):
    f = folds(v)
    parts = {n: f.where(F.col("fold_id") == n) for n in S.FOLDS}
    return S.stack_folds(parts, ["subject_id", "label", "group_var"])


@query("chk_id_coverage", """
SELECT 'left_only' AS side, count(*) AS n_missing FROM (SELECT subject_id FROM cohort EXCEPT SELECT subject_id FROM seps)
UNION ALL SELECT 'right_only', count(*) FROM (SELECT subject_id FROM seps EXCEPT SELECT subject_id FROM cohort)""", COHORT_SQL)
def _(v):
    other = C.sepsis_cohort(v.icustays, v.patients, v.admissions, v.sepsis3)
    return S.uncovered_ids(long_stay(v), other, "subject_id")


@query("smp_large_rows", """
SELECT line, quantity FROM (
  SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', 44, line)), line) AS k, count(*) OVER () AS n
  FROM (SELECT concat_ws('-', l_orderkey, l_linenumber) AS line, min(l_quantity) AS quantity FROM lineitem GROUP BY 1))
WHERE k <= n * 2 // 5""")
def _(v):
    """Two fifths of all order lines, chosen by a threshold on their hash."""
    lines = v.table("lineitem").groupBy(F.expr("concat_ws('-', l_orderkey, l_linenumber)").alias("line"))
    lines = cut_lineage(lines.agg(F.min("l_quantity").alias("quantity")))
    return S.rows_below(lines, lines.count() * 2 // 5, "line")
