"""Feature queries."""

from pyspark.sql import functions as F

from strataflow.operators import cohort as C
from strataflow.operators import features as X
from strataflow.operators.reporting import feature_counts
from strataflow.plans.cohorts import long_stay
from strataflow.plans.registry import query, r
from strataflow.session import cut_lineage

BINS = X.build_time_bins()
PAST = [b for b in BINS if float(b.right) <= 0]
CONFIG = X.FeatureConfig(list(X.STANDARD_SOURCES), analysis_id="longlos")
TABLES = ("diagnoses_icd", "hcpcsevents", "labevents", "prescriptions", "procedures_icd", "chartevents")


def bins_values(bins) -> str:
    rows = ", ".join(
        f"('{b.name}', '{b.left}', '{b.right}', {round(float(b.left) * 24)}, {round(float(b.right) * 24)})" for b in bins
    )
    return f"(VALUES {rows}) AS b(time_bin, bin_left, bin_right, lo, hi)"


def events_sql(table: str, concept: str, ts: str, bins, cols: str = "") -> str:
    when = "a.dischtime" if ts == "discharge" else f"e.{ts}"
    return f"""
SELECT c.subject_id, e.hadm_id, e.{concept}::VARCHAR AS concept_id, b.time_bin, b.bin_left, b.bin_right {cols}
FROM cohort c JOIN admissions a ON c.subject_id = a.subject_id JOIN {table} e ON e.hadm_id = a.hadm_id
JOIN {bins_values(bins)} ON {when} BETWEEN c.ref_datetime + to_hours(b.lo) AND c.ref_datetime + to_hours(b.hi)"""


def count_sql(src: X.Source, bins=None) -> str:
    bins = src.bins(BINS) if bins is None else bins
    return f"""
SELECT subject_id, concept_id || '_{src.feature_tag}_count_' || time_bin AS feature_id, count(*)::DOUBLE AS feature_val,
       concept_id, '{src.feature_tag}' AS feature_tag, 'count' AS feature_type, NULL::VARCHAR AS stat, bin_left, bin_right
FROM ({events_sql(src.table, src.concept_id, src.timestamp, bins)})
GROUP BY subject_id, concept_id, time_bin, bin_left, bin_right"""


def measure_sql(src: X.Source, stat: str, bins=None) -> str:
    bins = src.bins(BINS) if bins is None else bins
    return f"""
SELECT * FROM (
SELECT subject_id, concept_id || '_{src.feature_tag}_measurement_{stat}_' || time_bin AS feature_id,
       {stat}(coalesce(valuenum, try_cast(value AS DOUBLE))) AS feature_val,
       concept_id, '{src.feature_tag}' AS feature_tag, 'measurement' AS feature_type, '{stat}' AS stat, bin_left, bin_right
FROM ({events_sql(src.table, src.concept_id, src.timestamp, bins, ", e.valuenum, e.value")})
WHERE valuenum IS NOT NULL OR value IS NOT NULL
GROUP BY subject_id, concept_id, time_bin, bin_left, bin_right) WHERE feature_val IS NOT NULL"""


def long_sql(sources=None) -> str:
    parts = []
    for s in sources or X.STANDARD_SOURCES:
        if not s.bins(BINS):
            continue
        if s.feature_type == "count":
            parts.append(count_sql(s))
        else:
            parts += [measure_sql(s, stat) for stat in X.STATS]
    return " UNION ALL ".join(f"({p})" for p in parts)


DIAG, HCPCS, LABS_N, PRESC, PROC, ICU, LABS = X.STANDARD_SOURCES
LONG_COLS = f"subject_id, feature_id, {r('feature_val')} AS feature_val"

# the explicit vocabulary of the wide queries
HCPCS_IDS = [f"H{i}_hcpcs_count_{b.name}" for i in range(7) for b in PAST]
ICU_IDS = [f"{i}_icucharts_measurement_{s}_bin_0_0.167" for i in range(1, 8) for s in X.STATS]
WIDE_IDS = HCPCS_IDS + ICU_IDS


def wide_views() -> dict[str, str]:
    cols = []
    for f in WIDE_IDS:
        expr = f"avg(CASE WHEN feature_id = '{f}' THEN feature_val END)"
        if "count" in f:
            expr = f"coalesce({expr}, 0.0)"
        cols.append(f'{expr}::DOUBLE AS "{f.replace(".", "_")}"')
    return {
        "wide_long": long_sql([HCPCS, ICU]),
        "wide": f"SELECT subject_id, {', '.join(cols)} FROM wide_long GROUP BY subject_id",
        "feature_tab": "SELECT d.*, w.* EXCLUDE (subject_id) FROM cohort_demographics d LEFT JOIN wide w ON d.subject_id = w.subject_id",
    }


def rounded(names) -> str:
    return ", ".join(f'{r(chr(34) + n.replace(".", "_") + chr(34))} AS "{n.replace(".", "_")}"' for n in names)


def tables(v) -> dict:
    return {t: getattr(v, t) for t in TABLES}


def index(v):
    return X.admission_index(long_stay(v), v.admissions)


def long_features(v):
    return X.build_features(long_stay(v), v.admissions, tables(v), CONFIG)


def wide_long(v):
    config = X.FeatureConfig([HCPCS, ICU])
    return X.build_features(long_stay(v), v.admissions, tables(v), config)


def feature_table(v):
    demo = C.demographics(long_stay(v), v.admissions, v.patients)
    return X.feature_table(demo, X.pivot_features(wide_long(v), WIDE_IDS))


@query("fx_bins", f"""
SELECT bin_left, bin_right, count(*) AS n_events, count(DISTINCT subject_id) AS n_subjects
FROM ({events_sql("labevents", "itemid", "charttime", BINS)}) GROUP BY bin_left, bin_right""")
def _(v):
    """The time bins with the laboratory events and patients they hold."""
    ev = X.binned_events(index(v), v.labevents, "itemid", "charttime", BINS)
    per = ev.groupBy("bin").agg(F.count("*").alias("n_events"), F.countDistinct("subject_id").alias("n_subjects"))
    left = F.array(*[F.lit(b.left) for b in BINS])
    right = F.array(*[F.lit(b.right) for b in BINS])
    return per.select(
        F.element_at(left, F.col("bin") + 1).alias("bin_left"),
        F.element_at(right, F.col("bin") + 1).alias("bin_right"),
        "n_events",
        "n_subjects",
    )


@query("jn_time_bin", f"""
SELECT subject_id, hadm_id, concept_id, time_bin FROM ({events_sql("chartevents", "itemid", "charttime", BINS)})""")
def _(v):
    ev = X.binned_events(index(v), v.chartevents, "itemid", "charttime", BINS)
    names = F.array(*[F.lit(b.name) for b in BINS])
    return ev.select("subject_id", "hadm_id", "concept_id", F.element_at(names, F.col("bin") + 1).alias("time_bin"))


@query("fx_discharge_count", f"SELECT {LONG_COLS} FROM ({count_sql(DIAG)})")
def _(v):
    f = X.count_features(index(v), v.diagnoses_icd, "icd_code", None, PAST, "diag")
    return f.select("subject_id", "feature_id", "feature_val")


@query("fx_charttime_count", f"SELECT {LONG_COLS} FROM ({count_sql(PRESC)})")
def _(v):
    f = X.count_features(index(v), v.prescriptions, "ndc", "starttime", BINS, "presc")
    return f.select("subject_id", "feature_id", "feature_val")


@query("fx_measurement", f"SELECT {LONG_COLS} FROM ({long_sql([LABS])})")
def _(v):
    f = X.measurement_features(index(v), v.labevents, "itemid", "charttime", BINS, "labs")
    return f.select("subject_id", "feature_id", "feature_val")


@query("agg_n_admissions", f"""
SELECT subject_id, concept_id, time_bin, count(*) AS n_events, count(DISTINCT hadm_id) AS n_admissions
FROM ({events_sql("diagnoses_icd", "icd_code", "discharge", PAST)}) GROUP BY subject_id, concept_id, time_bin""")
def _(v):
    f = X.count_features(
        index(v), v.diagnoses_icd, "icd_code", None, PAST, "diag", with_admissions=True
    )
    return f.select(
        "subject_id",
        "concept_id",
        F.concat_ws("_", F.lit("bin"), "bin_left", "bin_right").alias("time_bin"),
        F.col("feature_val").cast("bigint").alias("n_events"),
        "n_admissions",
    )


@query("fx_dispatch", f"""
SELECT feature_tag, feature_type, bin_left, bin_right, count(*) AS n_rows, count(DISTINCT feature_id) AS n_features
FROM ({long_sql()}) GROUP BY feature_tag, feature_type, bin_left, bin_right""")
def _(v):
    """Which bins each source is computed for, with what they yield."""
    return long_features(v).groupBy("feature_tag", "feature_type", "bin_left", "bin_right").agg(
        F.count("*").alias("n_rows"), F.countDistinct("feature_id").alias("n_features")
    )


@query("fx_long_features", f"SELECT {LONG_COLS} FROM ({long_sql()})")
def _(v):
    return long_features(v).select("subject_id", "feature_id", "feature_val")


@query("fx_wide_features", f"SELECT subject_id, {rounded(WIDE_IDS)} FROM wide", wide_views())
def _(v):
    return X.pivot_features(wide_long(v), WIDE_IDS)


@query("fx_feature_table", f"""
SELECT subject_id, label, group_var, insurance, marital_status, ethnicity, language, age, gender, {rounded(WIDE_IDS)}
FROM feature_tab""", wide_views())
def _(v):
    return feature_table(v)


# all seven sources; the columns are what the data holds
ALL_LONG = {"all_long": long_sql()}
GRID_VIEWS = {
    **ALL_LONG,
    "mat_all_words": "SELECT DISTINCT feature_id FROM all_long",
    "mat_all_values": "SELECT subject_id, feature_id, avg(feature_val) AS x FROM all_long GROUP BY subject_id, feature_id",
    "mat_all_seen": "SELECT DISTINCT subject_id FROM all_long",
}
#: A missing count of a patient with events is 0.
VALUE_ALL = r("CASE WHEN x IS NULL AND feature_id LIKE '%count%' AND s.subject_id IS NOT NULL THEN 0 ELSE x END")


def wide_all(v):
    """All features as columns; the queries take them as arrays."""
    long = cut_lineage(long_features(v).select("subject_id", "feature_id", "feature_val"))
    return X.pivot_features(long, X.feature_names(long))


def wide_cells(v):
    """All features as one list of cells per patient, their places and names."""
    long = cut_lineage(long_features(v).select("subject_id", "feature_id", "feature_val"))
    names = X.feature_names(long)
    places = X.feature_places(v.spark, names)
    return X.feature_cells(long, places), places, names


@query("fx_wide_all", f"""
SELECT s.subject_id, feature_id AS feature, {VALUE_ALL} AS value
FROM mat_all_seen s CROSS JOIN mat_all_words LEFT JOIN mat_all_values USING (subject_id, feature_id)""", GRID_VIEWS)
def _(v):
    cells, places, names = wide_cells(v)
    return X.stack_arrays(X.dense_arrays(cells, names), places, len(names), ["subject_id"])


TABLE_KEYS = ["subject_id", "label", "group_var", "insurance", "marital_status", "ethnicity", "language", "age", "gender"]


@query("fx_table_all", f"""
SELECT {", ".join("d." + k for k in TABLE_KEYS)}, feature_id AS feature, {VALUE_ALL} AS value
FROM cohort_demographics d CROSS JOIN mat_all_words LEFT JOIN mat_all_seen s ON d.subject_id = s.subject_id
LEFT JOIN mat_all_values a ON a.subject_id = d.subject_id AND a.feature_id = mat_all_words.feature_id""".replace(
    "feature_id AS feature", "mat_all_words.feature_id AS feature").replace("AND feature_id LIKE", "AND mat_all_words.feature_id LIKE"), GRID_VIEWS)
def _(v):
    cells, places, names = wide_cells(v)
    # cells are joined and spread afterwards: no full array is sent
    table = X.feature_table(C.demographics(long_stay(v), v.admissions, v.patients), cells)
    return X.stack_arrays(X.dense_arrays(table, names), places, len(names), TABLE_KEYS)


LAB_IDS = [f"{i}_labs_measurement_avg_{BINS[0].name}" for i in range(20)]


@query("agg_pivot_features", f"""
SELECT subject_id, {", ".join(r(f"avg(CASE WHEN feature_id = '{f}' THEN feature_val END)") + f' AS "{f}"' for f in LAB_IDS)}
FROM ({measure_sql(LABS, "avg", BINS[:1])}) GROUP BY subject_id""")
def _(v):
    f = X.measurement_features(
        index(v), v.labevents, "itemid", "charttime", BINS[:1], "labs", stats=("avg",)
    )
    return X.pivot_features(f, LAB_IDS)


@query("set_union_distinct", f"""
SELECT {LONG_COLS} FROM (
SELECT subject_id, feature_id, feature_val FROM ({measure_sql(ICU, "min")})
UNION SELECT subject_id, feature_id, feature_val FROM ({measure_sql(ICU, "max")})
UNION SELECT subject_id, feature_id, feature_val FROM ({measure_sql(ICU, "max")}))""")
def _(v):
    """Pieces appended with duplicates removed; the engine itself needs no such distinct."""
    bins = ICU.bins(BINS)
    piece = lambda stat: X.measurement_features(
        index(v), v.chartevents, "itemid", "charttime", bins, "icucharts", stats=(stat,)
    ).select("subject_id", "feature_id", "feature_val")
    return piece("min").unionByName(piece("max")).unionByName(piece("max")).distinct()


@query("prj_tag_select", f"""
SELECT feature_id, count(*) AS n_rows FROM ({long_sql()})
WHERE feature_tag LIKE '%lab%' AND feature_type = 'count' GROUP BY feature_id""")
def _(v):
    """Tag tests are predicates on real columns in long form."""
    long = long_features(v).where(F.col("feature_tag").contains("lab") & (F.col("feature_type") == "count"))
    return long.groupBy("feature_id").agg(F.count("*").alias("n_rows"))


COUNT_TAGS = ["diag_count", "proc_count", "hcpcs_count", "presc_count", "lab_count", "labs_measurement", "icucharts_measurement"]


@query("rpt_feature_counts", f"""
SELECT bin_left, bin_right, {", ".join(f"count(DISTINCT CASE WHEN tag = '{t}' THEN feature_id END) AS {t}" for t in COUNT_TAGS)},
       count(DISTINCT tag || feature_id) AS total
FROM (SELECT *, feature_tag || '_' || feature_type AS tag FROM ({long_sql()})) GROUP BY bin_left, bin_right""")
def _(v):
    return feature_counts(long_features(v), COUNT_TAGS)
