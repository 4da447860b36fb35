"""Cohort, join, filter and set queries."""

from pyspark.sql import functions as F

from strataflow.functions.scalar import remap
from strataflow.operators import cohort as C
from strataflow.plans.registry import query, r

COHORT_COLS = """subject_id, hadm_id, stay_id, ref_datetime::VARCHAR AS ref_datetime, intime::VARCHAR AS intime,
outtime::VARCHAR AS outtime, admittime::VARCHAR AS admittime, dischtime::VARCHAR AS dischtime, group_var, label"""

COHORT_SQL = {
    "mort": """
SELECT p.subject_id, p.hadm_id, p.stay_id, p.intime AS ref_datetime, p.intime, p.outtime, a.admittime, a.dischtime,
       p.anchor_year_group AS group_var,
       (CASE WHEN a.deathtime <= p.intime + to_days(7) THEN 1 ELSE 0 END)::INTEGER AS label
FROM picked p LEFT JOIN admissions a ON p.hadm_id = a.hadm_id""",
    "vent_excluded": """
SELECT DISTINCT p.stay_id FROM picked p JOIN ventilation v ON p.stay_id = v.stay_id
WHERE v.starttime <= p.intime + to_hours(4) AND v.ventilation_status IN ('InvasiveVent', 'Trach')""",
    "vent_label": """
SELECT p.stay_id, max(CASE WHEN v.ventilation_status IN ('InvasiveVent', 'Trach') THEN 1 ELSE 0 END) AS label
FROM picked p JOIN ventilation v ON p.stay_id = v.stay_id
WHERE v.starttime > p.intime + to_hours(4) AND v.starttime <= p.intime + to_hours(28) GROUP BY p.stay_id""",
    "vent": """
SELECT p.subject_id, p.hadm_id, p.stay_id, p.intime AS ref_datetime, p.intime, p.outtime, a.admittime, a.dischtime,
       p.anchor_year_group AS group_var, coalesce(l.label, 0)::INTEGER AS label
FROM picked p LEFT JOIN admissions a ON p.hadm_id = a.hadm_id LEFT JOIN vent_label l ON p.stay_id = l.stay_id
LEFT JOIN vent_excluded e ON p.stay_id = e.stay_id WHERE e.stay_id IS NULL""",
    "seps": """
SELECT p.subject_id, p.hadm_id, p.stay_id, p.intime AS ref_datetime, p.intime, p.outtime, a.admittime, a.dischtime,
       s.suspected_infection_time, s.sofa_time, p.anchor_year_group AS group_var,
       (CASE WHEN s.suspected_infection_time > p.intime + to_hours(4)
              AND s.suspected_infection_time <= p.intime + to_hours(168) AND s.sepsis3 THEN 1 ELSE 0 END)::INTEGER AS label
FROM picked p LEFT JOIN admissions a ON p.hadm_id = a.hadm_id LEFT JOIN sepsis3 s ON p.stay_id = s.stay_id
WHERE p.stay_id NOT IN (SELECT p2.stay_id FROM picked p2 JOIN sepsis3 s2 ON p2.stay_id = s2.stay_id
                        WHERE s2.suspected_infection_time <= p2.intime + to_hours(4))""",
}


def long_stay(v):
    return C.long_stay_cohort(v.icustays, v.patients, v.admissions)


@query("coh_eligible", """
SELECT subject_id, hadm_id, stay_id, intime::VARCHAR AS intime, outtime::VARCHAR AS outtime, anchor_year_group
FROM eligible""")
def _(v):
    return C.eligible_stays(v.icustays, v.patients)


@query("coh_pick_one", """
SELECT subject_id, hadm_id, stay_id, intime::VARCHAR AS intime, outtime::VARCHAR AS outtime, anchor_year_group
FROM picked""")
def _(v):
    return C.picked_stays(v.icustays, v.patients)


@query("win_hash_pick", """
SELECT subject_id, stay_id FROM (
  SELECT subject_id, stay_id, row_number() OVER (PARTITION BY subject_id
         ORDER BY md5(concat(subject_id, intime, outtime)), stay_id) AS rn FROM icustays) WHERE rn = 1""")
def _(v):
    return C.pick_one_stay(v.icustays).select("subject_id", "stay_id")


@query("coh_longlos", f"SELECT {COHORT_COLS} FROM cohort")
def _(v):
    return long_stay(v)


@query("coh_mortality", f"SELECT {COHORT_COLS} FROM mort", COHORT_SQL)
def _(v):
    return C.mortality_cohort(v.icustays, v.patients, v.admissions)


@query("coh_invasive_vent", f"SELECT {COHORT_COLS} FROM vent", COHORT_SQL)
def _(v):
    return C.invasive_ventilation_cohort(v.icustays, v.patients, v.admissions, v.ventilation)


@query("coh_sepsis", f"""SELECT {COHORT_COLS}, suspected_infection_time::VARCHAR AS suspected_infection_time,
sofa_time::VARCHAR AS sofa_time FROM seps""", COHORT_SQL)
def _(v):
    return C.sepsis_cohort(v.icustays, v.patients, v.admissions, v.sepsis3)


@query("coh_demographics", "SELECT * FROM cohort_demographics")
def _(v):
    return C.demographics(long_stay(v), v.admissions, v.patients)


@query("jn_anti_exclude", """
SELECT subject_id, stay_id FROM picked WHERE stay_id NOT IN (SELECT stay_id FROM vent_excluded)""", COHORT_SQL)
def _(v):
    picked = C.picked_stays(v.icustays, v.patients)
    onset = v.ventilation.where(F.col("ventilation_status").isin(*C.INVASIVE_STATES))
    early = C.early_onset(picked, onset, "starttime")
    return picked.join(early, "stay_id", "left_anti").select("subject_id", "stay_id")


@query("flt_group", "SELECT subject_id, label, group_var FROM cohort WHERE group_var = '1997 - 1998'")
def _(v):
    return long_stay(v).where(F.col("group_var") == "1997 - 1998").select("subject_id", "label", "group_var")


@query("flt_in_semi", """
SELECT ids, iter, phase, pred_probs FROM (SELECT ids, iter, phase, round(pred_probs, 6) + 0.0 AS pred_probs FROM predictions)
WHERE ids IN (SELECT stay_id FROM picked)""")
def _(v):
    """Predictions of the picked stays: an id list as a semi-join."""
    picked = C.picked_stays(v.icustays, v.patients).select(F.col("stay_id").alias("ids"))
    return v.predictions().select("ids", "iter", "phase", "pred_probs").join(picked, "ids", "left_semi")


@query("flt_not_in_anti", """
SELECT hadm_id, itemid, valuenum FROM (SELECT hadm_id, itemid, round(valuenum, 6) + 0.0 AS valuenum FROM labevents)
WHERE hadm_id NOT IN (SELECT stay_id FROM picked)""")
def _(v):
    picked = C.picked_stays(v.icustays, v.patients).select(F.col("stay_id").alias("hadm_id"))
    return v.labevents.select("hadm_id", "itemid", "valuenum").join(picked, "hadm_id", "left_anti")


@query("prj_remap_group", """
SELECT subject_id, CASE group_var WHEN '2001 - 2001' THEN 1 ELSE 0 END::INTEGER AS grp,
       CASE gender WHEN 'F' THEN 'Female' WHEN 'M' THEN 'Male' ELSE gender END AS gender_label
FROM cohort_demographics""")
def _(v):
    demo = C.demographics(long_stay(v), v.admissions, v.patients)
    return demo.select(
        "subject_id",
        remap(F.col("group_var"), {"2001 - 2001": 1}, 0).alias("grp"),
        remap(F.col("gender"), {"F": "Female", "M": "Male"}).alias("gender_label"),
    )


@query("set_intersect", """
SELECT subject_id FROM (SELECT subject_id FROM mort WHERE label = 0) INTERSECT SELECT subject_id FROM seps""", COHORT_SQL)
def _(v):
    a = C.mortality_cohort(v.icustays, v.patients, v.admissions).where("label = 0").select("subject_id")
    return a.intersect(C.sepsis_cohort(v.icustays, v.patients, v.admissions, v.sepsis3).select("subject_id"))


@query("set_except", "SELECT subject_id FROM cohort EXCEPT SELECT subject_id FROM vent", COHORT_SQL)
def _(v):
    vent = C.invasive_ventilation_cohort(v.icustays, v.patients, v.admissions, v.ventilation)
    return long_stay(v).select("subject_id").subtract(vent.select("subject_id"))


@query("set_union_all", """
SELECT 'longlos' AS task, subject_id, label, NULL::VARCHAR AS sofa_time FROM cohort
UNION ALL SELECT 'sepsis', subject_id, label, sofa_time::VARCHAR FROM seps""", COHORT_SQL)
def _(v):
    a = long_stay(v).select(F.lit("longlos").alias("task"), "subject_id", "label")
    s = C.sepsis_cohort(v.icustays, v.patients, v.admissions, v.sepsis3)
    b = s.select(F.lit("sepsis").alias("task"), "subject_id", "label", F.col("sofa_time").cast("string"))
    return a.unionByName(b, allowMissingColumns=True)


@query("srt_limit", """
SELECT subject_id, stay_id, intime::VARCHAR AS intime FROM eligible ORDER BY intime, stay_id LIMIT 100""")
def _(v):
    """First rows of a table in a stated order: a distributed top-n."""
    stays = C.eligible_stays(v.icustays, v.patients)
    return stays.orderBy("intime", "stay_id").limit(100).select("subject_id", "stay_id", "intime")


@query("rpt_category_order", """
SELECT group_var, count(*) AS n, CASE group_var WHEN '2001 - 2001' THEN 1 WHEN '1995 - 1996' THEN 2
       WHEN '1997 - 1998' THEN 3 ELSE 4 END::INTEGER AS pos
FROM cohort GROUP BY group_var""")
def _(v):
    from strataflow.functions.scalar import category_position

    order = ["2001 - 2001", "1995 - 1996", "1997 - 1998"]
    out = long_stay(v).groupBy("group_var").agg(F.count("*").alias("n"))
    return out.withColumn("pos", category_position(F.col("group_var"), order)).orderBy("pos")


@query("agg_weighted_mean", f"""
SELECT group_var, {r("sum(age * w) / sum(w)")} AS weighted_age
FROM (SELECT group_var, age, 1 + label AS w FROM cohort_demographics) GROUP BY group_var""")
def _(v):
    from strataflow.operators.metrics import weighted_mean

    demo = C.demographics(long_stay(v), v.admissions, v.patients)
    return demo.groupBy("group_var").agg(weighted_mean(F.col("age"), 1 + F.col("label")).alias("weighted_age"))
