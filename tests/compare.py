"""Run registered queries in Spark and their statements in DuckDB and compare the results."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _canonical(pdf: pd.DataFrame) -> list[tuple]:
    def text(x):
        if x is None or (isinstance(x, float) and x != x) or x is pd.NaT or x is pd.NA:
            return ""
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (float, int)) or hasattr(x, "dtype"):
            return repr(float(x))
        return str(x)

    cols = sorted(pdf.columns)
    return sorted(tuple(text(x) for x in row) for row in pdf[cols].itertuples(index=False, name=None))


def compare(name: str, spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    if sorted(spark_pdf.columns) != sorted(oracle_pdf.columns):
        return f"{name}: columns {sorted(spark_pdf.columns)} vs {sorted(oracle_pdf.columns)}"
    if len(spark_pdf) != len(oracle_pdf):
        return f"{name}: {len(spark_pdf)} rows vs {len(oracle_pdf)}"
    for c in spark_pdf.columns:
        a, b = spark_pdf[c].dtype, oracle_pdf[c].dtype
        if a.kind != b.kind:
            return f"{name}: column {c} is {a} vs {b}"
    a, b = _canonical(spark_pdf), _canonical(oracle_pdf)
    for x, y in zip(a, b):
        if x != y:
            return f"{name}: {sorted(spark_pdf.columns)}\n  {x}\n  {y}"
    return None


def main(sf_dir: str, only: list[str]) -> int:
    import __spark_entry__ as entry
    from strataflow.session import local_session

    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t0 = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            t1 = time.time()
            if name in oracles:
                want = con.execute(oracles[name]).fetchdf()
                problem = compare(name, got, want)
            else:
                problem = None if len(got) else f"{name}: no rows"
        except Exception as e:  # noqa: BLE001
            problem, got, t1 = f"{name}: {type(e).__name__} {str(e)[:1500]}", [], time.time()
        if problem:
            bad += 1
        mark = "FAIL" if problem else ("ok" if name in oracles else "rows")
        print(f"{mark:5} {name:26} {len(got):7} rows  spark {t1 - t0:5.1f}s duck {time.time() - t1:5.1f}s", flush=True)
        if problem:
            print("   ", problem, flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1], sys.argv[2:]) != 0)
