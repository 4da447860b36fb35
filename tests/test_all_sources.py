"""Wide, sparse, preprocessing and model frames hold every feature of the seven sources."""

import pytest

import __spark_entry__ as entry
from strataflow.operators import features as X
from strataflow.plans import features as FX
from strataflow.plans import models
from strataflow.sources.fixtures import Views
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["fx_wide_all", "fx_table_all", "ds_sparse_all", "pp_all_long"])
def test_all_features_match_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert compare(name, got, connect(SF).execute(entry.oracle_sql()[name]).fetchdf()) is None


def test_wide_columns_come_from_the_data(spark):
    v = Views(spark, SF)
    names = FX.wide_all(v).columns[1:]
    assert names == X.feature_names(FX.long_features(v))
    for s in X.STANDARD_SOURCES:
        assert any(f"_{s.feature_tag}_{s.feature_type}_" in n for n in names)


def test_models_see_all_sources(spark):
    v = Views(spark, SF)
    data, size = models.training_frame(v)
    train = models.part(data, "train").select("subject_id")
    words = X.feature_names(FX.long_features(v).join(train, "subject_id", "left_semi"))
    assert size == len(words) and {w.split("_")[1] for w in words} == {s.feature_tag for s in X.STANDARD_SOURCES}


def test_training_rows_come_in_bounded_parts(spark, monkeypatch):
    """Large frames are cut into parts of bounded size; small ones stay as they are."""
    monkeypatch.setattr(models, "PART_ROWS", 8)
    monkeypatch.setattr(models, "WHOLE_ROWS", 16)
    few = spark.range(16).withColumnRenamed("id", "subject_id").coalesce(1)
    assert models.in_parts(few, 16) is few
    many = spark.range(1000).withColumnRenamed("id", "subject_id").coalesce(1)
    parts = models.in_parts(many, 1000).rdd.glom().map(len).collect()
    assert len(parts) == 125 and sum(parts) == 1000 and max(parts) < 40
    data, _ = models.training_frame(Views(spark, SF))
    assert data.rdd.getNumPartitions() > 4


def test_training_frame_writes_what_it_needs_once(spark, monkeypatch):
    """Features are written without their descriptions, and the words of the training fold before they are placed."""
    written, write = [], models.cut_lineage
    monkeypatch.setattr(models, "cut_lineage", lambda df: written.append(df.columns) or write(df))
    models.training_frame(Views(spark, SF))
    assert ["subject_id", "feature_id", "feature_val"] in written and ["feature_id"] in written
    assert not any("feature_tag" in columns for columns in written)
