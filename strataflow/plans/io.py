"""Source and sink queries: what is written comes back equal."""

from pyspark.sql import functions as F

from strataflow.operators import cohort as C
from strataflow.plans.cohorts import COHORT_SQL, long_stay
from strataflow.plans.registry import query, r
from strataflow.plans.splits import FOLD_VIEWS, folds
from strataflow.session import scratch_path
from strataflow.sources import tables as IO


@query("src_sql_scan", f"""
SELECT p.anchor_year_group, count(*) AS n_stays, {r("avg(date_diff('hour', i.intime, i.outtime))")} AS mean_hours
FROM icustays i JOIN patients p ON i.subject_id = p.subject_id GROUP BY p.anchor_year_group""")
def _(v):
    """A statement in SQL text over named frames."""
    return IO.run_sql(
        v.spark,
        """
        SELECT p.anchor_year_group, count(*) AS n_stays,
               avg(timestampdiff(HOUR, date_trunc('HOUR', i.intime), date_trunc('HOUR', i.outtime))) AS mean_hours
        FROM {stays} i JOIN {people} p ON i.subject_id = p.subject_id GROUP BY p.anchor_year_group
        """,
        stays=v.icustays,
        people=v.patients,
    )


SCRIPT = """
BEGIN
  DECLARE typical DOUBLE;
  DECLARE high DOUBLE;
  SET typical = (SELECT avg(o_totalprice) FROM orders);
  SET high = (SELECT avg(o_totalprice) FROM orders WHERE o_totalprice > typical);
  SELECT o_orderpriority, count(*) AS n, count_if(o_totalprice > typical) AS n_above,
         count_if(o_totalprice > high) AS n_high, 'a;b' AS mark
  FROM orders GROUP BY o_orderpriority;
END
"""


@query("src_sql_script", """
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_totalprice > typical) AS n_above,
       count(*) FILTER (o_totalprice > high) AS n_high, 'a;b' AS mark
FROM orders, (SELECT avg(o_totalprice) AS typical FROM orders),
     (SELECT avg(o_totalprice) AS high FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders))
GROUP BY o_orderpriority""")
def _(v):
    """A script file with variables, of which one depends on the other."""
    path = scratch_path(v.spark, "script")
    v.spark.createDataFrame([(SCRIPT,)], "value string").coalesce(1).write.text(path)
    return IO.run_script(v.spark, path, {"orders": v.table("orders")})


LINE_NUMBERS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
)
LINE_OTHERS = ("l_returnflag", "l_linestatus", "l_shipdate")


@query("snk_write_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS name, count(*) AS n_rows, count(*) - count({c}) AS n_null, "
    + ", ".join(f"{r(f'{m}({c})') if c in LINE_NUMBERS else 'NULL::DOUBLE'} AS {a}" for m, a in (("min", "low"), ("max", "high")))
    + " FROM lineitem" for c in LINE_NUMBERS + LINE_OTHERS))
def _(v):
    """Written and profiled by one job."""
    return IO.write_profiled(v.table("lineitem"), scratch_path(v.spark, "profiled")).drop("n_bytes")


@query("src_profile", """
SELECT 'lineitem' AS name, count(*) AS n_rows, 11 AS n_cols FROM lineitem
UNION ALL SELECT 'orders', count(*), 6 FROM orders UNION ALL SELECT 'events', count(*), 6 FROM events""")
def _(v):
    out = None
    for name in ("lineitem", "orders", "events"):
        part = IO.profile(v.table(name)).select(F.lit(name).alias("name"), "n_rows", "n_cols")
        out = part if out is None else out.unionByName(part)
    return out


@query("snk_ctas_roundtrip", "SELECT subject_id, stay_id, label FROM mort", COHORT_SQL)
def _(v):
    """A cohort replaces its table and is read back by name."""
    cohort = C.mortality_cohort(v.icustays, v.patients, v.admissions)
    return IO.save_table(cohort, "strataflow_mortality", scratch_path(v.spark, "mortality")).select(
        "subject_id", "stay_id", "label"
    )


@query("snk_parquet_roundtrip", f"SELECT hadm_id, itemid, charttime::VARCHAR AS charttime, value, {r('valuenum')} AS valuenum FROM labevents")
def _(v):
    path = IO.write_parquet(v.labevents, scratch_path(v.spark, "labs"))
    return v.spark.read.parquet(path)


@query("snk_csv_roundtrip", f"""
SELECT phase, iter, "group", ids, labels, {r("pred_probs")} AS pred_probs, {r("outputs")} AS outputs FROM predictions""")
def _(v):
    df = v.predictions().select("phase", "iter", "group", "ids", "labels", "pred_probs", "outputs")
    path = IO.write_csv(df, scratch_path(v.spark, "predictions"))
    return IO.read_csv(v.spark, path, df.schema)


@query("src_partition_prune", """
SELECT subject_id, label, 'sepsis' AS analysis_id FROM seps""", COHORT_SQL)
def _(v):
    """One folder per task; the filter on the task reads one of them."""
    tasks = {
        "longlos": long_stay(v),
        "mortality": C.mortality_cohort(v.icustays, v.patients, v.admissions),
        "sepsis": C.sepsis_cohort(v.icustays, v.patients, v.admissions, v.sepsis3),
    }
    both = None
    for name, df in tasks.items():
        part = df.select("subject_id", "label").withColumn("analysis_id", F.lit(name))
        both = part if both is None else both.unionByName(part)
    path = IO.write_parquet(both, scratch_path(v.spark, "tasks"), ["analysis_id"])
    return v.spark.read.parquet(path).where("analysis_id = 'sepsis'")


@query("ds_bundle_roundtrip", """
SELECT subject_id, label, group_var, 'longlos' AS analysis_id, 'raw_split' AS dataset, fold_id FROM folds WHERE fold_id = 'test'""", FOLD_VIEWS)
def _(v):
    path = scratch_path(v.spark, "bundle")
    f = folds(v)
    IO.save_bundle(f, path, "longlos", "raw_split")
    IO.save_bundle(f.where("label = 1"), path, "longlos", "positives")
    return IO.load_bundle(v.spark, path, "longlos", "raw_split", "test")


@query("src_read_or_compute", "SELECT subject_id, label, fold_id FROM folds", FOLD_VIEWS)
def _(v):
    """Computed and stored on the first call, read on the second."""
    path = scratch_path(v.spark, "cache")
    IO.read_or_compute(v.spark, path, lambda: folds(v))

    def never():
        raise AssertionError("stored result was not found")

    return IO.read_or_compute(v.spark, path, never).select("subject_id", "label", "fold_id")
