"""Small tables with the awkward rows every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use themselves
        T.StructField("score", T.StringType()),
        T.StructField("rank", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("component", T.StringType()),
        T.StructField("n", T.StringType()),
    ]
)


def row(doc_id, text):
    return (doc_id, text, "en", "s", len(text or ""), "x", 1, 2, "c", "n")


def documents(spark, rows):
    return spark.createDataFrame([row(*r) for r in rows], DOCS)


def prose(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    syllables = "an be co de er fi go in ka lo me no pi ra se ti un ve".split()
    return ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def awkward():
    """Nulls in both columns, empty and very long texts, ties, repeated rows, odd characters."""
    words = prose(1, 400)
    rows = [(i, " ".join(words[i * 7 : i * 7 + 30 + i])) for i in range(12)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "one two"), (104, "ONE two"), (105, "One\u00a0two")]
    rows += [(106, "É é"), (107, "é é"), (108, "x" * 30_000), (109, "word " * 6_000), (None, "no id"), (None, None)]
    rows += [(3, rows[3][1])] * 2  # repeated rows
    rows += [(200, rows[5][1].upper()), (201, rows[5][1])]
    rows += [(202, rows[6][1] + " tail"), (203, "<|endoftext|>a  b<|endoftext|> \u3000 \x1c ½ 日本")]
    return rows
