"""Registered queries of this subpackage, with the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import strataflow
from strataflow.llm import (
    bpe,
    counting,
    exact_dedup,
    extraction,
    lexical,
    licenses,
    near_dedup,
    packing,
    sharding,
    spelling,
    topk,
    toxicity,
    urls,
)

#: Vocabulary of the token queries.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def find_package(spark: SparkSession) -> None:
    """Python workers find this package where the driver has it; a cluster has it installed."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(strataflow.__file__).parents[1]))


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            find_package(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op2_near_dedup")
def op2_near_dedup(spark, sf_dir):
    return near_dedup.cluster(table(spark, sf_dir, "documents")).drop("text_key")


@query("op3_license_scan")
def op3_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op4_url_filter")
def op4_url_filter(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


@query("op5_main_text")
def op5_main_text(spark, sf_dir):
    return extraction.extract(table(spark, sf_dir, "pages"))


@query("op6_ring_shards")
def op6_ring_shards(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"), 40)


@query(
    "op7_nra_topk",
    """
    WITH v AS (
        SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS xs FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.xs, c.xs)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
    )
    SELECT query_id, rank::INT AS rank, vec_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
    ) WHERE rank <= 20
    """,
)
def op7_nra_topk(spark, sf_dir):
    return topk.top_products(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


@query("op8_bpe")
def op8_bpe(spark, sf_dir):
    return bpe.digest_documents(table(spark, sf_dir, "documents"), VOCABULARY)


@query(
    "op9_exact_dedup",
    """
    WITH t AS (
        SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
        FROM documents
    )
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY body)
    """,
)
def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents")).drop("text_key")


@query("op10_packing")
def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY)


@query(
    "op11_ranked_search",
    r"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
    ), held AS (SELECT * FROM d WHERE len(terms) > 0),
    stats AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS total FROM held),
    tf AS (SELECT r, term, count(*) AS times FROM (SELECT r, unnest(terms) AS term FROM held) GROUP BY r, term),
    i AS (
        SELECT row_number() OVER () AS place, item_id, list_distinct(regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms FROM benchmark
    ), asked AS (SELECT place, item_id, unnest(terms) AS term FROM i),
    weight AS (
        SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
        FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), stats
    ), parts AS (
        SELECT place, item_id, doc_id, r, w * ((1000000000 * times) // (1000 * times
            + 20 * (50 + (50 * len(terms) * n_docs) // total))) AS part
        FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN held USING (r), stats
    ), scores AS (
        SELECT place, item_id, r, doc_id, sum(part)::BIGINT AS score FROM parts GROUP BY ALL HAVING sum(part) > 0
    )
    SELECT item_id, rank::INT AS rank, doc_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores
    ) WHERE rank <= 50
    """,
)
def op11_ranked_search(spark, sf_dir):
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_spelling_variants")
def op12_spelling_variants(spark, sf_dir):
    return spelling.group_variants(table(spark, sf_dir, "documents"))


@query("op13_token_counts")
def op13_token_counts(spark, sf_dir):
    return counting.count_documents(table(spark, sf_dir, "documents"), WORD_VOCABULARY)
