"""Cohorts: one eligible stay per patient with a rule-based label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.functions.scalar import hours_between, plus_days, plus_hours

# Ventilation states that count as invasive.
INVASIVE_STATES = ("InvasiveVent", "Trach")


def eligible_stays(stays: DataFrame, patients: DataFrame, min_hours: int = 4) -> DataFrame:
    """Stays in the patient's anchor year that last longer than ``min_hours``."""
    people = patients.select("subject_id", "anchor_year", "anchor_year_group")
    return (
        stays.where(hours_between(F.col("intime"), F.col("outtime")) > min_hours)
        .join(people, "subject_id")
        .where(F.year("intime") == F.col("anchor_year"))
        .select("subject_id", "hadm_id", "stay_id", "intime", "outtime", "anchor_year_group")
    )


def pick_hash(subject: str = "subject_id", start: str = "intime", end: str = "outtime") -> Column:
    return F.md5(F.concat(*[F.col(c).cast("string") for c in (subject, start, end)]))


def pick_one_stay(stays: DataFrame, key: str = "subject_id") -> DataFrame:
    """The stay with the least hash per patient.

    A minimum of structs instead of a ranked window: it combines map-side,
    sorts nothing, and a patient with very many stays is no heavy task.
    """
    rest = [c for c in stays.columns if c not in (key, "stay_id")]
    least = F.min(F.struct(pick_hash(key).alias("h"), "stay_id", *rest)).alias("s")
    return stays.groupBy(key).agg(least).select(
        *[F.col(key) if c == key else F.col(f"s.{c}").alias(c) for c in stays.columns]
    )


def _with_admission(picked: DataFrame, admissions: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    adm = admissions.select("hadm_id", "admittime", "dischtime", *extra)
    return picked.join(adm, "hadm_id", "left")


def _layout(df: DataFrame, label: Column, extra: Sequence[str] = ()) -> DataFrame:
    return df.select(
        "subject_id",
        "hadm_id",
        "stay_id",
        F.col("intime").alias("ref_datetime"),
        "intime",
        "outtime",
        "admittime",
        "dischtime",
        *extra,
        F.col("anchor_year_group").alias("group_var"),
        label.cast("int").alias("label"),
    )


def picked_stays(stays: DataFrame, patients: DataFrame) -> DataFrame:
    return pick_one_stay(eligible_stays(stays, patients))


def mortality_cohort(stays: DataFrame, patients: DataFrame, admissions: DataFrame, days: int = 7) -> DataFrame:
    """Label 1 when death is known and not later than ``days`` after admission to the unit."""
    base = _with_admission(picked_stays(stays, patients), admissions, ["deathtime"])
    return _layout(base, F.when(F.col("deathtime") <= plus_days(F.col("intime"), days), 1).otherwise(0))


def long_stay_cohort(stays: DataFrame, patients: DataFrame, admissions: DataFrame, hours: int = 72) -> DataFrame:
    """Label 1 when the stay crosses more than ``hours`` hour boundaries."""
    base = _with_admission(picked_stays(stays, patients), admissions)
    long = hours_between(F.col("intime"), F.col("outtime")) > hours
    return _layout(base, F.when(long, 1).otherwise(0))


def first_onset(events: DataFrame, time_col: str) -> DataFrame:
    """Earliest event per stay: ``stay_id, onset``.

    "Any event by h" is "the earliest event by h", so a stay with very many
    events collapses map-side and the join below meets one row per stay.
    """
    return events.groupBy("stay_id").agg(F.min(time_col).alias("onset"))


def early_onset(picked: DataFrame, events: DataFrame, time_col: str, hours: int = 4) -> DataFrame:
    """Stays to leave out: an event at or before ``hours`` after admission."""
    return (
        picked.select("stay_id", "intime")
        .join(first_onset(events, time_col), "stay_id")
        .where(F.col("onset") <= plus_hours(F.col("intime"), hours))
        .select("stay_id")
    )


def invasive_ventilation_cohort(
    stays: DataFrame,
    patients: DataFrame,
    admissions: DataFrame,
    ventilation: DataFrame,
    gap_hours: int = 4,
    end_hours: int = 28,
) -> DataFrame:
    """Leave out stays ventilated by ``gap_hours``; label onset in (gap, end].

    The event table is read once: among the stays that are kept every onset
    lies after the gap, so the earliest one decides the label too.
    """
    picked = picked_stays(stays, patients)
    onsets = first_onset(ventilation.where(F.col("ventilation_status").isin(*INVASIVE_STATES)), "starttime")
    onset, first = F.col("onset"), F.col("intime")
    kept = picked.join(onsets, "stay_id", "left").where(onset.isNull() | (onset > plus_hours(first, gap_hours)))
    label = F.when(onset <= plus_hours(first, end_hours), 1).otherwise(0)
    return _layout(_with_admission(kept, admissions), label)


def sepsis_cohort(
    stays: DataFrame,
    patients: DataFrame,
    admissions: DataFrame,
    sepsis: DataFrame,
    gap_hours: int = 4,
    end_hours: int = 168,
) -> DataFrame:
    """Leave out infections by ``gap_hours``; label flagged infections in (gap, end].

    As in the source rules a stay with several infection rows yields several
    rows; ``assert_unique`` finds them.
    """
    picked = picked_stays(stays, patients)
    excluded = early_onset(picked, sepsis, "suspected_infection_time", gap_hours)
    kept = _with_admission(picked.join(excluded, "stay_id", "left_anti"), admissions)
    joined = kept.join(
        sepsis.select("stay_id", "suspected_infection_time", "sofa_time", "sepsis3"), "stay_id", "left"
    )
    t, first = F.col("suspected_infection_time"), F.col("intime")
    hit = (t > plus_hours(first, gap_hours)) & (t <= plus_hours(first, end_hours)) & F.col("sepsis3")
    return _layout(joined, F.when(hit, 1).otherwise(0), ["suspected_infection_time", "sofa_time"])


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    if duplicate_keys(df, *keys).limit(1).count():
        raise ValueError(f"rows are not unique on {keys}")
    return df


def demographics(cohort: DataFrame, admissions: DataFrame, patients: DataFrame) -> DataFrame:
    """Label, group and attributes per patient; language is ENGLISH, OTHER or NULL."""
    adm = admissions.select("hadm_id", "admittime", "insurance", "marital_status", "ethnicity", "language")
    people = patients.select("subject_id", "anchor_year", "anchor_age", "gender")
    return (
        cohort.select("subject_id", "hadm_id", "label", "group_var")
        .join(adm, "hadm_id")
        .join(people, "subject_id")
        .select(
            "subject_id",
            "label",
            "group_var",
            "insurance",
            "marital_status",
            "ethnicity",
            F.when(F.col("language") != "ENGLISH", "OTHER").otherwise(F.col("language")).alias("language"),
            (F.year("admittime") - F.col("anchor_year") + F.col("anchor_age")).cast("int").alias("age"),
            "gender",
        )
    )
