"""Cohort and feature rules on small literal frames."""

from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from strataflow.functions import scalar as SC
from strataflow.operators import cohort as C
from strataflow.operators import features as X

STAYS = "subject_id long, hadm_id long, stay_id long, intime timestamp_ntz, outtime timestamp_ntz"
PATIENTS = "subject_id long, anchor_year int, anchor_age int, anchor_year_group string, gender string"
ADMS = "subject_id long, hadm_id long, admittime timestamp_ntz, dischtime timestamp_ntz, deathtime timestamp_ntz"


@pytest.fixture(scope="module")
def world(spark):
    stays = [
        (1, 10, 100, dt(2000, 1, 1, 0, 59), dt(2000, 1, 1, 5, 1)),  # 5 boundaries, 4 h 2 min elapsed
        (2, 20, 200, dt(2000, 1, 1, 0, 0), dt(2000, 1, 1, 4, 59)),  # 4 boundaries: too short
        (3, 30, 300, dt(2001, 1, 1), dt(2001, 1, 9)),  # not in the anchor year
        (4, 40, 400, dt(2000, 3, 1), dt(2000, 3, 10)),
    ]
    patients = [(i, 2000, 50, "g", "F") for i in (1, 2, 3, 4)]
    adms = [
        (1, 10, dt(2000, 1, 1), dt(2000, 1, 2), dt(2000, 1, 8, 0, 59)),  # exactly 7 days later
        (4, 40, dt(2000, 2, 28), dt(2000, 3, 12), None),
        (4, 41, dt(1999, 1, 1), dt(2000, 2, 23), None),  # discharged 7 days before 2000-03-01
    ]
    return (
        spark.createDataFrame(stays, STAYS),
        spark.createDataFrame(patients, PATIENTS),
        spark.createDataFrame(adms, ADMS),
    )


def test_hours_are_boundaries(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2000-01-01 00:59:00' AS a, TIMESTAMP_NTZ'2000-01-01 05:01:00' AS b")
    assert df.select(SC.hours_between(F.col("a"), F.col("b"))).first()[0] == 5


def test_eligible(world):
    stays, patients, _ = world
    assert {r.stay_id for r in C.eligible_stays(stays, patients).collect()} == {100, 400}


def test_pick_is_one_per_patient_and_stable(spark):
    rows = [(1, i, i, dt(2000, 1, 1, i % 24), dt(2000, 1, 3)) for i in range(50)]
    df = spark.createDataFrame(rows, STAYS)
    a = C.pick_one_stay(df).collect()
    b = C.pick_one_stay(df.repartition(7)).collect()
    assert len(a) == 1 and a == b


def test_mortality_and_long_stay(world):
    stays, patients, adms = world
    labels = {r.stay_id: r.label for r in C.mortality_cohort(stays, patients, adms).collect()}
    assert labels == {100: 1, 400: 0}
    labels = {r.stay_id: r.label for r in C.long_stay_cohort(stays, patients, adms).collect()}
    assert labels == {100: 0, 400: 1}


def test_ventilation_edges(spark, world):
    stays, patients, adms = world
    vent = spark.createDataFrame(
        [
            (100, dt(2000, 1, 1, 4, 59), "Trach"),  # exactly 4 h: excluded
            (400, dt(2000, 3, 1, 3), "NonInvasiveVent"),  # early but not invasive
            (400, dt(2000, 3, 2, 4), "InvasiveVent"),  # exactly 28 h: label 1
        ],
        "stay_id long, starttime timestamp_ntz, ventilation_status string",
    )
    out = C.invasive_ventilation_cohort(stays, patients, adms, vent).collect()
    assert [(r.stay_id, r.label) for r in out] == [(400, 1)]


def test_sepsis_rules_and_fan_out(spark, world):
    stays, patients, adms = world
    schema = "stay_id long, suspected_infection_time timestamp_ntz, sofa_time timestamp_ntz, sepsis3 boolean"
    sep = spark.createDataFrame(
        [(100, None, None, True), (400, dt(2000, 3, 2), None, True), (400, dt(2000, 3, 3), None, False)], schema
    )
    out = C.sepsis_cohort(stays, patients, adms, sep)
    assert sorted((r.stay_id, r.label) for r in out.collect()) == [(100, 0), (400, 0), (400, 1)]
    with pytest.raises(ValueError):
        C.assert_unique(out, "stay_id")


def test_bins_and_rules():
    bins = X.build_time_bins()
    assert [b.name for b in bins][0] == "bin_-365000_-180" and len(bins) == 5
    assert bins[-1].bounds() == (0, 4 * 3_600_000_000)
    conf = X.FeatureConfig(list(X.STANDARD_SOURCES))
    assert sum(len(s.bins(conf.bins)) for s in conf.sources) == 28


def test_edge_counts_twice_and_text_values(spark, world):
    _, _, adms = world
    cohort = spark.createDataFrame([(4, dt(2000, 3, 1))], "subject_id long, ref_datetime timestamp_ntz")
    labs = spark.createDataFrame(
        [
            (40, 7, dt(2000, 2, 23), "3.5", None),  # on the edge of -30..-7 and -7..0
            (40, 7, dt(2000, 2, 24), "NEG", None),  # not a number
            (40, 7, dt(2000, 2, 25), None, 9.5),
            (40, 7, dt(2000, 2, 26), None, None),  # counted, not measured
        ],
        "hadm_id long, itemid int, charttime timestamp_ntz, value string, valuenum double",
    )
    index = X.admission_index(cohort, adms)
    bins = X.build_time_bins()
    counts = X.count_features(index, labs, "itemid", "charttime", bins, "lab")
    assert {r.bin_left: r.feature_val for r in counts.collect()} == {"-30": 1.0, "-7": 4.0}
    meas = X.measurement_features(index, labs, "itemid", "charttime", bins, "labs").collect()
    got = {(r.bin_left, r.stat): r.feature_val for r in meas}
    assert got[("-7", "avg")] == 6.5 and got[("-7", "min")] == 3.5 and got[("-30", "max")] == 3.5
    assert "7_labs_measurement_avg_bin_-7_0" in {r.feature_id for r in meas}
    both = X.build_features(
        cohort,
        adms,
        {"labevents": labs},
        X.FeatureConfig([s for s in X.STANDARD_SOURCES if s.table == "labevents"]),
    )
    assert both.count() == counts.count() + len(meas)


def test_discharge_counts_use_the_admission(spark, world):
    _, _, adms = world
    cohort = spark.createDataFrame([(4, dt(2000, 3, 1))], "subject_id long, ref_datetime timestamp_ntz")
    diag = spark.createDataFrame([(40, "A"), (41, "A"), (41, "A")], "hadm_id long, icd_code string")
    past = [b for b in X.build_time_bins() if float(b.right) <= 0]
    out = X.count_features(
        X.admission_index(cohort, adms), diag, "icd_code", None, past, "diag", with_admissions=True
    ).collect()
    assert {(r.bin_left, r.feature_val, r.n_admissions) for r in out} == {("-30", 2.0, 1), ("-7", 2.0, 1)}


def test_patient_without_events_keeps_null(spark):
    demo = spark.createDataFrame([(1, 0), (2, 1)], "subject_id long, label int")
    long = spark.createDataFrame([(1, "a_x_count_bin_0_0.167", 2.0)], "subject_id long, feature_id string, feature_val double")
    ids = ["a_x_count_bin_0_0.167", "b_x_count_bin_0_0.167"]
    rows = {r[0]: r for r in X.feature_table(demo, X.pivot_features(long, ids)).collect()}
    assert tuple(rows[1])[2:] == (2.0, 0.0) and tuple(rows[2])[2:] == (None, None)


def test_scalars(spark):
    df = spark.sql("SELECT 4.6D AS x, 'abc' AS t, '' AS e, 0.25D AS p")
    row = df.select(
        SC.round_half_up(F.col("x")),
        SC.to_double(F.col("t")),
        SC.join_tags(F.col("t"), F.col("e"), F.col("t")),
        SC.sigmoid(SC.logit(F.col("p"))),
        SC.softmax_positive(F.lit(0.0), SC.logit(F.col("p"))),
        SC.hinge_surrogate(F.lit(-2.0)),
        SC.remap(F.col("t"), {"abc": 1}, 0),
        SC.indicator(F.col("x")),
        SC.logistic_surrogate(F.lit(0.0)),
    ).first()
    assert row[0] == 5 and row[1] is None and row[2] == "abc_abc"
    assert row[3] == pytest.approx(0.25) and row[4] == pytest.approx(0.25)
    assert tuple(row)[5:8] == (0.0, 1, 1.0) and row[8] == pytest.approx(1.0)


def test_arrays_of_features_are_the_pivot(spark):
    """Arrays and columns hold the same; NULLs, repeated cells and features that are not listed too."""
    rows = [(1, "a_count_x", 2.0), (1, "b", None), (1, "c", 1.0), (1, "c", 2.0), (2, "other", 5.0), (3, "b", float("nan")), (None, "b", 4.0)]
    long = spark.createDataFrame(rows, "subject_id long, feature_id string, feature_val double")
    ids = ["c", "a_count_x", "b", "never"]
    places = X.feature_places(spark, ids)
    wide = X.pivot_arrays(long, places, ids)
    got = {r["subject_id"]: r["values"] for r in wide.collect()}
    want = {r[0]: list(r[1:]) for r in X.pivot_features(long, ids).collect()}
    assert repr(sorted(got.items(), key=str)) == repr(sorted(want.items(), key=str))
    keys = spark.createDataFrame([(1,), (9,)], "subject_id long").join(wide, "subject_id", "left")
    stacked = {tuple(r) for r in X.stack_arrays(keys, places, len(ids), ["subject_id"]).collect()}
    assert stacked == {(1, f, x) for f, x in zip(ids, want[1])} | {(9, f, None) for f in ids}


def test_patients_are_joined_before_their_arrays_are_made(spark):
    """Rows of patients with repeated, missing and no features, spread from their cells."""
    long = spark.createDataFrame(
        [(1, "a_count", 2.0), (1, "a_count", 4.0), (1, "b", None), (2, "b", 5.0), (2, "rare", 1.0), (3, "rare", 1.0)],
        "subject_id long, feature_id string, feature_val double",
    )
    names = ["a_count", "b"]
    places = X.feature_places(spark, names)
    demo = spark.createDataFrame([(1, "F"), (1, "M"), (3, None), (4, "F")], "subject_id long, gender string")
    cells = X.feature_cells(long, places)
    table = X.feature_table(demo, cells)
    got = X.stack_arrays(X.dense_arrays(table, names), places, len(names), ["subject_id", "gender"])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [
        (1, "F", "a_count", 3.0), (1, "F", "b", None), (1, "M", "a_count", 3.0), (1, "M", "b", None),
        (3, None, "a_count", 0.0), (3, None, "b", None), (4, "F", "a_count", None), (4, "F", "b", None)]))
    wide = X.feature_table(demo, X.pivot_arrays(long, places, names))
    assert sorted(map(str, wide.collect())) == sorted(map(str, X.dense_arrays(table, names).collect()))
