import zlib

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from strataflow.llm import queries, toxicity  # noqa: E402
from tests.llm.helpers import documents  # noqa: E402
from tests.llm.test_dedup import brute, fold, near_rows  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark, tmp_path):
    rows = [(d, t) for d, t in near_rows() if d is not None]
    docs = documents(spark, rows)
    labels = [(d, 1, int(d % 3 == 0)) for d, _ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    left = [(d, t) for d, t in rows if scorer.scores([t or ""])[0] < 0.5]
    keep = {}
    for d, t in left:
        keep[fold(t)] = max(keep.get(fold(t), (d, t)), (d, t), key=lambda r: r[0])
    left = list(keep.values())
    left = [r for r, (_, _, c) in zip(left, brute(left, pipeline.NEAR_PERCENT)) if r[0] == c]
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == {d for d, _ in left}
    from tests.llm.test_tokens import check_packing
    from strataflow.llm.bpe import encoder
    import numpy as np

    ids = encoder(queries.VOCABULARY).encode([t or "" for _, t in left])
    check_packing(got, {d: [*np.frombuffer(b, "<u4").tolist(), 0] for (d, _), b in zip(left, ids)})


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes
        assert out.join(docs, docs.columns, "left_anti").count() == 0


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert pipeline.ORACLE_SQL is None and len(pipeline.STAGES) == 4


def test_held_out_rows(spark):
    got = queries.op1_toxicity(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    order = list(want.columns)
    got, want = (x.sort_values(order).reset_index(drop=True).astype(str) for x in (got, want))
    assert got.equals(want)
