"""Running sums over an ordered key without gathering a group in one task.

A window over a whole stratum would sort a third of all rows in one task when
one stratum is that large. Here the order axis is cut into ordered buckets by
an expression of the key itself. The sums before a row are those of earlier
buckets (a window over one row per bucket) plus those of earlier rows of the
same bucket (a window over one bucket). The bucket depends on the row alone,
so a task that runs again after a lost executor puts its rows in the same place.

Expressions are SQL text: one call to the JVM each, however long they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BUCKET = "__bucket"
ALL = "__all"


def quoted(name: str) -> str:
    """Column by its literal name; feature names hold dots."""
    return f"`{name}`"


def names(cols: Sequence[str]) -> str:
    return ", ".join(quoted(c) for c in cols)


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the columns of a table with one row per key.

    With no real key (``keys`` is the constant one) that row is a scalar
    subquery: one value for all tasks instead of a cross join.
    """
    if list(keys) != [ALL]:
        return df.join(small, list(keys))
    cols = [c for c in small.columns if c != ALL]
    one = small.select(F.struct(*[F.col(quoted(c)) for c in cols])).scalar()
    return df.withColumn("__row", one).selectExpr(
        *map(quoted, df.columns), *[f"__row.{quoted(c)} AS {quoted(c)}" for c in cols]
    )


def score_bucket(x: str, per_e_fold: int = 256) -> str:
    """Ordered bucket of a number, fine near 0 and near 1, where scores crowd.

    Each term never decreases with ``x``, so neither does the bucket.
    Probabilities fall into at most about 15,000 buckets, any double into
    about 400,000, whatever the number of rows.
    """
    near_zero = f"signum({x}) * log1p(abs({x}) * 1e9D)"
    near_one = f"CASE WHEN {x} >= 1 THEN 40D WHEN {x} > 0 THEN -log1p(-{x}) ELSE 0D END"
    # coalesce: a bucket is never NULL, so no branch gets a filter of its own and shuffles can be shared
    return f"coalesce(CAST(floor(({near_zero} + {near_one}) * {per_e_fold}) AS BIGINT), 0L)"


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str], bucket: str
) -> DataFrame:
    """Add ``before_<s>`` (sum over earlier rows of the key) and ``total_<s>``.

    ``order`` must identify a row within ``keys``; key columns must not be NULL.
    ``bucket`` is SQL text that never decreases along ``order``.
    """
    keys, columns = list(keys), df.columns
    k, by_bucket = names(keys), names([*keys, _BUCKET])
    rows = df.withColumn(_BUCKET, F.expr(bucket))
    per_bucket = rows.groupBy(*keys, _BUCKET).agg(*[F.expr(f"sum({s}) AS __sum_{s}") for s in sums])
    earlier = f"OVER (PARTITION BY {k} ORDER BY {_BUCKET} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    offsets = per_bucket.selectExpr(
        *map(quoted, keys),
        _BUCKET,
        *[f"coalesce(sum(__sum_{s}) {earlier}, 0) AS __off_{s}" for s in sums],
        *[f"sum(__sum_{s}) OVER (PARTITION BY {k}) AS total_{s}" for s in sums],
    )
    inside = (
        f"OVER (PARTITION BY {by_bucket} ORDER BY {names(order)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    placed = rows.selectExpr("*", *[f"coalesce(sum({s}) {inside}, 0) AS __in_{s}" for s in sums])
    return placed.join(offsets, [*keys, _BUCKET]).selectExpr(
        *map(quoted, columns),
        *[f"__in_{s} + __off_{s} AS before_{s}" for s in sums],
        *[f"total_{s}" for s in sums],
    )


def score_table(df: DataFrame, keys: Sequence[str], score: str, sums: Mapping[str, str]) -> DataFrame:
    """One row per key and distinct score with running sums of ``sums`` (name -> SQL text).

    Equal scores collapse map-side before the shuffle, so a third of all rows
    with one score costs one row per task.
    """
    keys = list(keys)
    scores = df.groupBy(*keys, score).agg(*[F.expr(f"sum({e}) AS {n}") for n, e in sums.items()])
    return running_sums(scores, keys, [score], list(sums), score_bucket(quoted(score)))


def hash_ranks(df: DataFrame, keys: Sequence[str], order_hash: str, tie: Sequence[str]) -> DataFrame:
    """Add ``rank0`` (0-based place in hash order within the key) and ``n``."""
    columns = df.columns
    rows = df.selectExpr("*", f"{order_hash} AS __hash", "1L AS __one")
    ranked = running_sums(rows, keys, ["__hash", *tie], ["__one"], "coalesce(substring(__hash, 1, 4), '')")
    return ranked.selectExpr(*map(quoted, columns), "before___one AS rank0", "total___one AS n")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], count: str = "1L"
) -> DataFrame:
    """Exact quantiles with linear interpolation: columns ``keys, n, q`` (array in ``probs`` order).

    ``count`` is SQL text: how many rows a row stands for.

    ``percentile`` keeps all distinct values of a group in one buffer; this
    keeps one row per distinct value, spread over tasks.
    """
    keys, v = list(keys), quoted(value)
    ranked = score_table(df.where(f"{v} IS NOT NULL AND NOT isnan({v})"), keys, value, {"cnt": count})
    aggs, parts = ["max(total_cnt) AS n"], []
    for i, p in enumerate(probs):
        pos = f"(total_cnt - 1) * {float(p)!r}D"
        for name, fn in (("lo", "floor"), ("hi", "ceil")):
            aggs.append(f"min(CASE WHEN before_cnt + cnt - 1 >= {fn}({pos}) THEN {v} END) AS __{name}{i}")
        at = f"(n - 1) * {float(p)!r}D"
        parts.append(f"__lo{i} + (__hi{i} - __lo{i}) * ({at} - floor({at}))")
    return (
        ranked.groupBy(*keys)
        .agg(*[F.expr(a) for a in aggs])
        .selectExpr(*map(quoted, keys), "n", f"array({', '.join(parts)}) AS q")
    )
