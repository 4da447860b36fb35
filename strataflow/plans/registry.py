"""Registered queries: a Spark builder each and, where SQL can say it, the checking statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataflow.sources.fixtures import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register ``fn(views) -> DataFrame``; ``extra`` holds further views of the statement."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return presentable(fn(Views(spark, sf_dir)))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, extra)
        return fn

    return wrap


def presentable(df: DataFrame) -> DataFrame:
    """Doubles rounded (engines add in different orders), times as text, no dots in names."""
    cols = []
    for name, kind in df.dtypes:
        c, out = f"`{name}`", name.replace(".", "_")
        if kind in ("double", "float"):
            c = f"round(CAST({c} AS DOUBLE), {DIGITS}) + 0D"
        elif kind.startswith("timestamp"):
            c = f"CAST({c} AS STRING)"
        cols.append(f"{c} AS `{out}`")
    return df.selectExpr(*cols)


def r(expr: str, digits: int = DIGITS) -> str:
    """SQL twin of the rounding above."""
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0::DOUBLE)"
