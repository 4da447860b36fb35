"""Clinical-shaped views derived from the given tables, in Spark and in SQL.

Both forms read whole tables. ``VIEW_SQL`` holds the same definitions for the
independent engine; ``with_views`` prepends what a statement needs.
"""

from __future__ import annotations

import os
import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The year groups of the fixture patients, oldest first.
YEAR_GROUPS = ("1995 - 1996", "1997 - 1998", "1999 - 2000", "2001 - 2001")
LAST_GROUP = YEAR_GROUPS[-1]


# Training methods of the report fixtures (method, lambda, target rows, score multiplier).
VARIANTS = (
    ("erm", -1.0, 0, 7919),
    ("oracle", -1.0, 0, 104723),
    ("irm", 0.1, 0, 15485863),
    ("coral", 1.0, 0, 32452843),
    ("al_layer", 0.1, 100, 49979687),
    ("coral", 0.1, 500, 67867967),
)
_SCORE = (
    "0.01D + 0.98D * (0.35D * labels + 0.65D * CAST((ids * {mult} + {run} * 104729) % 10007 AS DOUBLE) / 10007D)"
)
_SCORE_SQL = (
    "0.01::DOUBLE + 0.98::DOUBLE * (0.35::DOUBLE * labels + 0.65::DOUBLE * "
    "(((ids * {mult} + {run} * 104729) % 10007)::DOUBLE / 10007::DOUBLE))"
)


class Views:
    """Lazily built DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))
        return self._tables[name]

    @cached_property
    def patients(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS subject_id",
            "CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender",
            "CAST(1995 + c_custkey % 7 AS INT) AS anchor_year",
            "CAST(20 + c_custkey % 60 AS INT) AS anchor_age",
            "CASE WHEN c_custkey % 7 < 2 THEN '1995 - 1996' WHEN c_custkey % 7 < 4 THEN '1997 - 1998' "
            "WHEN c_custkey % 7 < 6 THEN '1999 - 2000' ELSE '2001 - 2001' END AS anchor_year_group",
        )

    @cached_property
    def _stays(self) -> DataFrame:
        return (
            self.table("orders")
            .selectExpr(
                "o_orderkey AS k",
                "o_custkey AS subject_id",
                "o_orderstatus",
                "o_orderpriority",
                "CAST(o_orderdate AS TIMESTAMP_NTZ) + make_dt_interval(0, CAST(o_orderkey % 24 AS INT), "
                "CAST(o_orderkey % 60 AS INT)) AS intime",
            )
            .withColumn(
                "outtime", F.expr("intime + make_dt_interval(0, CAST(1 + (k * 7) % 200 AS INT))")
            )
        )

    @cached_property
    def icustays(self) -> DataFrame:
        return self._stays.selectExpr("subject_id", "k AS hadm_id", "k AS stay_id", "intime", "outtime")

    @cached_property
    def admissions(self) -> DataFrame:
        stays = self._stays.selectExpr(
            "subject_id",
            "k AS hadm_id",
            "intime - make_dt_interval(0, CAST(k % 12 AS INT)) AS admittime",
            "outtime + make_dt_interval(0, CAST(k % 72 AS INT)) AS dischtime",
            "CASE WHEN o_orderstatus = 'F' AND k % 5 = 0 "
            "THEN intime + make_dt_interval(0, CAST(k % 240 AS INT)) END AS deathtime",
            "o_orderpriority AS insurance",
            "CASE k % 3 WHEN 0 THEN 'ENGLISH' WHEN 1 THEN 'SPANISH' END AS language",
            "CASE WHEN k % 10 <> 0 THEN o_orderstatus END AS marital_status",
        )
        ethnicity = self.table("customer").selectExpr(
            "c_custkey AS subject_id", "c_mktsegment AS ethnicity"
        )
        return stays.join(ethnicity, "subject_id")

    @cached_property
    def _lines(self) -> DataFrame:
        """Order lines with the stay's admission time."""
        stays = self._stays.selectExpr("k AS hadm_id", "intime")
        lines = self.table("lineitem").selectExpr(
            "l_orderkey AS hadm_id",
            "l_partkey",
            "l_suppkey",
            "l_linenumber",
            "l_quantity",
            "l_extendedprice",
            "CAST(l_shipdate AS TIMESTAMP_NTZ) AS l_shipdate",
        )
        return lines.join(stays, "hadm_id").withColumn(
            "charttime",
            F.expr(
                "CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate "
                "ELSE intime + make_dt_interval(0, CAST(l_partkey % 12 - 4 AS INT)) END"
            ),
        )

    @cached_property
    def ventilation(self) -> DataFrame:
        return self._lines.selectExpr(
            "hadm_id AS stay_id",
            "intime + make_dt_interval(0, CAST(l_partkey % 60 - 6 AS INT)) AS starttime",
            "CASE l_suppkey % 4 WHEN 0 THEN 'InvasiveVent' WHEN 1 THEN 'Trach' "
            "WHEN 2 THEN 'NonInvasiveVent' ELSE 'None' END AS ventilation_status",
        )

    @cached_property
    def sepsis3(self) -> DataFrame:
        return self._stays.selectExpr(
            "k AS stay_id",
            "CASE WHEN k % 4 <> 0 THEN intime + make_dt_interval(0, CAST(k % 300 - 20 AS INT)) END "
            "AS suspected_infection_time",
            "k % 3 = 0 AS sepsis3",
        ).selectExpr(
            "stay_id",
            "suspected_infection_time",
            "suspected_infection_time + make_dt_interval(0, 2) AS sofa_time",
            "sepsis3",
        )

    @cached_property
    def labevents(self) -> DataFrame:
        return self._lines.selectExpr(
            "hadm_id",
            "CAST(l_suppkey % 20 AS INT) AS itemid",
            "charttime",
            "CASE WHEN l_partkey % 20 = 0 THEN 'NEG' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS value",
            "CASE WHEN l_partkey % 10 <> 0 THEN l_quantity END AS valuenum",
        )

    @cached_property
    def chartevents(self) -> DataFrame:
        return self._lines.selectExpr(
            "hadm_id",
            "l_linenumber AS itemid",
            "charttime",
            "CAST(NULL AS STRING) AS value",
            "l_extendedprice AS valuenum",
        )

    @cached_property
    def prescriptions(self) -> DataFrame:
        brands = self.table("part").selectExpr("p_partkey AS l_partkey", "p_brand AS ndc")
        return self._lines.join(brands, "l_partkey").selectExpr(
            "hadm_id", "ndc", "charttime AS starttime"
        )

    @cached_property
    def diagnoses_icd(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "l_orderkey AS hadm_id",
            "concat(l_returnflag, l_linestatus, CAST(l_partkey % 15 AS STRING)) AS icd_code",
        )

    @cached_property
    def procedures_icd(self) -> DataFrame:
        types = self.table("part").selectExpr("p_partkey AS l_partkey", "p_type AS icd_code")
        return (
            self.table("lineitem")
            .selectExpr("l_orderkey AS hadm_id", "l_partkey")
            .join(types, "l_partkey")
            .select("hadm_id", "icd_code")
        )

    @cached_property
    def hcpcsevents(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "l_orderkey AS hadm_id", "concat('H', CAST(l_suppkey % 7 AS STRING)) AS hcpcs_cd"
        )

    def predictions(self, multiplier: int = 7919) -> DataFrame:
        """Scores of three model runs for every order; the multiplier makes another model."""
        return (
            self.table("orders")
            .selectExpr(
                "o_orderkey AS ids",
                "o_custkey AS subject_id",
                "CASE WHEN o_orderkey % 2 = 0 THEN 'val' ELSE 'test' END AS phase",
                "CAST(CASE WHEN year(o_orderdate) < 1997 THEN 0 WHEN year(o_orderdate) < 1999 THEN 1 "
                "WHEN year(o_orderdate) < 2001 THEN 2 ELSE 3 END AS INT) AS group",
                "CAST(o_orderstatus = 'F' AS INT) AS labels",
                "explode(array(1, 2, 3)) AS iter",
            )
            .withColumn(
                "pred_probs",
                F.expr(_SCORE.format(mult=multiplier, run="iter")),
            )
            .withColumn("outputs", F.expr("ln(pred_probs / (1D - pred_probs))"))
            .selectExpr(
                "phase", "iter", "group", "ids", "ids AS row_id", "subject_id", "labels", "pred_probs", "outputs"
            )
        )

    @cached_property
    def variants(self) -> DataFrame:
        """One run of several training methods, with their lambda and number of target rows."""
        rows = ", ".join(
            f"named_struct('train_method', '{m}', 'lambda', {lam!r}D, 'n_ood', {n}, 'k', {k}L)" for m, lam, n, k in VARIANTS
        )
        base = self.table("orders").selectExpr(
            "o_orderkey AS ids",
            "CAST(CASE WHEN year(o_orderdate) < 1999 THEN 0 ELSE 1 END AS INT) AS `group`",
            "CAST(o_orderstatus = 'F' AS INT) AS labels",
            f"inline(array({rows}))",
        )
        return base.selectExpr(
            "train_method", "lambda", "n_ood", "`group`", "ids", "labels", f"{_SCORE.format(mult='k', run='1')} AS pred_probs"
        )

    @cached_property
    def year_models(self) -> DataFrame:
        """Models trained on each year group, scored on all orders."""
        base = self.table("orders").selectExpr(
            "o_orderkey AS ids",
            "CAST(CASE WHEN year(o_orderdate) < 1997 THEN 0 WHEN year(o_orderdate) < 1999 THEN 1 "
            "WHEN year(o_orderdate) < 2001 THEN 2 ELSE 3 END AS INT) AS eval_group",
            "CAST(o_orderstatus = 'F' AS INT) AS labels",
            "explode(array(0, 1, 2, 3)) AS train_group",
        )
        return base.selectExpr(
            "train_group", "eval_group", "ids", "labels", f"{_SCORE.format(mult='7919', run='train_group')} AS pred_probs"
        )

    @cached_property
    def demographics(self) -> DataFrame:
        """Per order: the attributes predictions are broken down by."""
        orders = self.table("orders").selectExpr(
            "o_orderkey AS ids",
            "o_orderpriority AS insurance",
            "CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender",
            "CASE o_orderkey % 3 WHEN 0 THEN 'ENGLISH' WHEN 1 THEN 'OTHER' END AS language",
            "CASE o_custkey % 4 WHEN 0 THEN 'SINGLE' WHEN 1 THEN 'MARRIED' WHEN 2 THEN 'WIDOWED' END AS marital_status",
            "CASE WHEN o_custkey % 5 < 3 THEN 'WHITE' ELSE 'OTHER' END AS ethnicity",
            "18 + o_custkey % 73 AS age",
        )
        return orders

    @cached_property
    def toxicity(self) -> DataFrame:
        """Small real labels: toxic documents by language, scored from the length."""
        docs = self.table("documents").selectExpr(
            "doc_id", "lang AS group", "1D / (1D + CAST(n_chars AS DOUBLE) / 1000D) AS pred_probs"
        )
        return docs.join(self.table("labels").selectExpr("doc_id", "toxic AS labels"), "doc_id")


_GROUP_CASE = (
    "CASE WHEN c_custkey % 7 < 2 THEN '1995 - 1996' WHEN c_custkey % 7 < 4 THEN '1997 - 1998' "
    "WHEN c_custkey % 7 < 6 THEN '1999 - 2000' ELSE '2001 - 2001' END"
)


def predictions_sql(multiplier: int = 7919) -> str:
    return f"""
SELECT phase, iter, "group", ids, ids AS row_id, subject_id, labels, pred_probs,
       ln(pred_probs / (1.0::DOUBLE - pred_probs)) AS outputs
FROM (
  SELECT *, 0.01::DOUBLE + 0.98::DOUBLE * (0.35::DOUBLE * labels + 0.65::DOUBLE *
            (((ids * {multiplier} + iter * 104729) % 10007)::DOUBLE / 10007::DOUBLE)) AS pred_probs
  FROM (
    SELECT o_orderkey AS ids, o_custkey AS subject_id,
           CASE WHEN o_orderkey % 2 = 0 THEN 'val' ELSE 'test' END AS phase,
           (CASE WHEN year(o_orderdate) < 1997 THEN 0 WHEN year(o_orderdate) < 1999 THEN 1
                 WHEN year(o_orderdate) < 2001 THEN 2 ELSE 3 END)::INTEGER AS "group",
           (o_orderstatus = 'F')::INTEGER AS labels,
           unnest([1, 2, 3])::INTEGER AS iter
    FROM orders))"""


VIEW_SQL = {
    "patients": f"""
SELECT c_custkey AS subject_id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
       (1995 + c_custkey % 7)::INTEGER AS anchor_year, (20 + c_custkey % 60)::INTEGER AS anchor_age,
       {_GROUP_CASE} AS anchor_year_group
FROM customer""",
    "stays_base": """
SELECT *, intime + to_hours(1 + (k * 7) % 200) AS outtime FROM (
  SELECT o_orderkey AS k, o_custkey AS subject_id, o_orderstatus, o_orderpriority,
         o_orderdate + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60) AS intime
  FROM orders)""",
    "icustays": "SELECT subject_id, k AS hadm_id, k AS stay_id, intime, outtime FROM stays_base",
    "admissions": """
SELECT s.subject_id, k AS hadm_id, intime - to_hours(k % 12) AS admittime,
       outtime + to_hours(k % 72) AS dischtime,
       CASE WHEN o_orderstatus = 'F' AND k % 5 = 0 THEN intime + to_hours(k % 240) END AS deathtime,
       o_orderpriority AS insurance,
       CASE k % 3 WHEN 0 THEN 'ENGLISH' WHEN 1 THEN 'SPANISH' END AS language,
       CASE WHEN k % 10 <> 0 THEN o_orderstatus END AS marital_status,
       c_mktsegment AS ethnicity
FROM stays_base s JOIN customer c ON s.subject_id = c.c_custkey""",
    "lines": """
SELECT l_orderkey AS hadm_id, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, intime,
       CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate ELSE intime + to_hours(l_partkey % 12 - 4) END AS charttime
FROM lineitem JOIN stays_base ON l_orderkey = k""",
    "ventilation": """
SELECT hadm_id AS stay_id, intime + to_hours(l_partkey % 60 - 6) AS starttime,
       CASE l_suppkey % 4 WHEN 0 THEN 'InvasiveVent' WHEN 1 THEN 'Trach'
            WHEN 2 THEN 'NonInvasiveVent' ELSE 'None' END AS ventilation_status
FROM lines""",
    "sepsis3": """
SELECT stay_id, suspected_infection_time, suspected_infection_time + to_hours(2) AS sofa_time, sepsis3 FROM (
  SELECT k AS stay_id, CASE WHEN k % 4 <> 0 THEN intime + to_hours(k % 300 - 20) END AS suspected_infection_time,
         k % 3 = 0 AS sepsis3
  FROM stays_base)""",
    "labevents": """
SELECT hadm_id, (l_suppkey % 20)::INTEGER AS itemid, charttime,
       CASE WHEN l_partkey % 20 = 0 THEN 'NEG' ELSE l_quantity::BIGINT::VARCHAR END AS value,
       CASE WHEN l_partkey % 10 <> 0 THEN l_quantity END AS valuenum
FROM lines""",
    "chartevents": """
SELECT hadm_id, l_linenumber AS itemid, charttime, NULL::VARCHAR AS value, l_extendedprice AS valuenum
FROM lines""",
    "prescriptions": """
SELECT hadm_id, p_brand AS ndc, charttime AS starttime FROM lines JOIN part ON l_partkey = p_partkey""",
    "diagnoses_icd": """
SELECT l_orderkey AS hadm_id, l_returnflag || l_linestatus || (l_partkey % 15)::VARCHAR AS icd_code
FROM lineitem""",
    "procedures_icd": """
SELECT l_orderkey AS hadm_id, p_type AS icd_code FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "hcpcsevents": """
SELECT l_orderkey AS hadm_id, 'H' || (l_suppkey % 7)::VARCHAR AS hcpcs_cd FROM lineitem""",
    "predictions": predictions_sql(),
    "predictions2": predictions_sql(15485863),
    "variants": f"""
SELECT train_method, "lambda", n_ood, "group", ids, labels, {_SCORE_SQL.format(mult="k", run="1")} AS pred_probs
FROM (SELECT o_orderkey AS ids, (CASE WHEN year(o_orderdate) < 1999 THEN 0 ELSE 1 END)::INTEGER AS "group",
             (o_orderstatus = 'F')::INTEGER AS labels FROM orders),
     (VALUES {", ".join(f"('{m}', {lam}::DOUBLE, {n}::INTEGER, {k})" for m, lam, n, k in VARIANTS)}) t(train_method, "lambda", n_ood, k)""",
    "year_models": f"""
SELECT train_group, eval_group, ids, labels, {_SCORE_SQL.format(mult="7919", run="train_group")} AS pred_probs
FROM (SELECT o_orderkey AS ids, (CASE WHEN year(o_orderdate) < 1997 THEN 0 WHEN year(o_orderdate) < 1999 THEN 1
             WHEN year(o_orderdate) < 2001 THEN 2 ELSE 3 END)::INTEGER AS eval_group,
             (o_orderstatus = 'F')::INTEGER AS labels, unnest([0, 1, 2, 3])::INTEGER AS train_group FROM orders)""",
    "demographics": """
SELECT o_orderkey AS ids, o_orderpriority AS insurance,
       CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
       CASE o_orderkey % 3 WHEN 0 THEN 'ENGLISH' WHEN 1 THEN 'OTHER' END AS language,
       CASE o_custkey % 4 WHEN 0 THEN 'SINGLE' WHEN 1 THEN 'MARRIED' WHEN 2 THEN 'WIDOWED' END AS marital_status,
       CASE WHEN o_custkey % 5 < 3 THEN 'WHITE' ELSE 'OTHER' END AS ethnicity, 18 + o_custkey % 73 AS age
FROM orders""",
    "toxicity": """
SELECT d.doc_id, lang AS "group", 1.0::DOUBLE / (1.0::DOUBLE + n_chars::DOUBLE / 1000.0::DOUBLE) AS pred_probs,
       toxic AS labels
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    # cohort steps, reused by later views
    "eligible": """
SELECT i.*, p.anchor_year_group
FROM icustays i JOIN patients p ON i.subject_id = p.subject_id
WHERE year(intime) = anchor_year AND date_diff('hour', intime, outtime) > 4""",
    "picked": """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_id
         ORDER BY md5(concat(subject_id, intime, outtime)), stay_id) AS rn
  FROM eligible) WHERE rn = 1""",
    "cohort": """
SELECT p.subject_id, p.hadm_id, p.stay_id, p.intime AS ref_datetime, p.intime, p.outtime, a.admittime,
       a.dischtime, p.anchor_year_group AS group_var,
       (CASE WHEN date_diff('hour', p.intime, p.outtime) > 72 THEN 1 ELSE 0 END)::INTEGER AS label
FROM picked p LEFT JOIN admissions a ON p.hadm_id = a.hadm_id""",
    "cohort_demographics": """
SELECT c.subject_id, c.label, c.group_var, a.insurance, a.marital_status, a.ethnicity,
       CASE WHEN a.language <> 'ENGLISH' THEN 'OTHER' ELSE a.language END AS language,
       (year(a.admittime) - p.anchor_year + p.anchor_age)::INTEGER AS age, p.gender
FROM cohort c JOIN admissions a ON c.hadm_id = a.hadm_id JOIN patients p ON c.subject_id = p.subject_id""",
}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prepend the view definitions a statement refers to, in dependency order."""
    defs = dict(VIEW_SQL)
    defs.update(extra or {})
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"(?:FROM|JOIN)\s+(\w+)", text):
            if name in defs and name not in needed:
                visit(defs[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    keep = lambda n: "MATERIALIZED " if n.startswith("mat_") else ""
    ctes = ",\n".join(f"{n} AS {keep(n)}(\n{defs[n].strip()}\n)" for n in needed)
    return f"WITH {ctes}\n{sql.strip()}"
