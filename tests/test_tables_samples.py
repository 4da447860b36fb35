"""Samples by threshold, profiles made while writing, script files."""

import pytest
from pyspark.sql import functions as F

from strataflow.operators import split as S
from strataflow.session import scratch_path
from strataflow.sources import tables as IO


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [10_001, 29_000, 30_000, 40_000])
def test_large_samples_are_the_first_by_hash(spark, n):
    df = spark.range(30_000).withColumn("x", F.col("id") * 2)
    got = S.sample_rows(df, n, "id")
    first = df.orderBy(F.expr("md5(concat_ws('|', '44', id))"), "id").limit(n)
    assert got.columns == ["id", "x"]
    assert {r["id"] for r in got.collect()} == {r["id"] for r in first.collect()}
    assert "SinglePartition" not in plan(got)


def test_cells_are_divided_and_repeats_counted(spark, monkeypatch):
    monkeypatch.setattr(S, "TOP_ROWS", 50)
    df = spark.range(5_000)
    want = {r["id"] for r in df.orderBy(F.expr("md5(concat_ws('|', '7', id))")).limit(1_234).collect()}
    for digits in (1, 2, 4):
        assert {r["id"] for r in S.rows_below(df, 1_234, "id", 7, digits).collect()} == want
    hot = df.withColumn("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")))
    assert S.rows_below(hot, 2_500, "id").count() == 2_500
    nulls = df.withColumn("id", F.when(F.col("id") > 100, F.col("id")))
    assert S.rows_below(nulls, 700, "id").count() == 700
    assert S.rows_below(df.limit(0), 700, "id").count() == 0


def test_profile_comes_from_the_job_that_writes(spark):
    df = spark.range(1_000).selectExpr("id", "IF(id % 4 = 0, NULL, id / 2D) AS `a.b`", "CAST(id AS STRING) AS text", "NULL AS none")
    df = df.withColumn("none", F.col("none").cast("int"))
    path = scratch_path(spark, "profiled")
    spark.sparkContext.setJobGroup("profiled", "one job")
    made = IO.write_profiled(df, path)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("profiled")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1
    rows = {r["name"]: r for r in made.collect()}
    assert [rows[c][1:5] for c in ("id", "a.b", "text", "none")] == [
        (1000, 0, 0.0, 999.0), (1000, 250, 0.5, 499.5), (1000, 0, None, None), (1000, 1000, None, None)]
    assert all(r["n_bytes"] > 0 for r in rows.values())
    assert spark.read.parquet(path).count() == 1_000
    empty = IO.write_profiled(df.limit(0), scratch_path(spark, "profiled")).first()
    assert (empty["n_rows"], empty["n_null"], empty["low"]) == (0, 0, None)


def test_script_with_branches_and_views_given_back(spark):
    path = scratch_path(spark, "script")
    script = """BEGIN
      DECLARE n BIGINT; -- a comment; with a semicolon
      SET n = (SELECT count(*) FROM things);
      IF n > 5 THEN SELECT 'many; ' || n AS found; ELSE SELECT 'few' AS found; END IF;
    END"""
    spark.createDataFrame([(script,)], "value string").coalesce(1).write.text(path)
    spark.range(2).createOrReplaceTempView("things")
    assert IO.run_script(spark, path, {"things": spark.range(9)}).first()["found"] == "many; 9"
    assert spark.table("things").count() == 2
    spark.catalog.dropTempView("things")
    assert IO.run_script(spark, path, {"things": spark.range(3)}).first()["found"] == "few"
    assert not spark.catalog.tableExists("things")
