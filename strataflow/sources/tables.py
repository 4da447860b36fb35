"""Reading and writing tables, scripts, bundles and cached predictions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from strataflow.operators.running import quoted

# literals, quoted names and comments of a script: a semicolon inside ends nothing
_PIECES = re.compile(
    r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^'"`;/-]+|.""", re.S
)


def statements(script: str) -> list[str]:
    """The statements of a script without its comments."""
    out = [""]
    for piece in _PIECES.findall(script):
        if piece == ";":
            out.append("")
        elif not piece.startswith(("--", "/*")):
            out[-1] += piece
    return [s.strip() for s in out if s.strip()]


def run_sql(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    """Result of one statement; named frames can be used as ``{name}``."""
    return spark.sql(query, **tables)


def run_sql_file(spark: SparkSession, path: str) -> DataFrame | None:
    """Run a script of ``;``-separated statements; the last result is returned."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    out = None
    for statement in statements(text):
        out = spark.sql(statement)
    return out


def run_script(spark: SparkSession, path: str, views: Mapping[str, DataFrame]) -> DataFrame:
    """Result of a compound statement (``BEGIN ... END``) in a file: declared variables, branches and loops.

    Spark runs it as it is, nothing is cut at semicolons. The named frames are its tables; views that had
    their names before are given back.
    """
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    before = {name: spark.table(name) for name in views if spark.catalog.tableExists(name)}
    try:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return spark.sql(text)
    finally:
        for name in views:
            spark.catalog.dropTempView(name)
        for name, df in before.items():
            df.createOrReplaceTempView(name)


def save_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Replace a table by the rows of ``df``; a path makes it external."""
    writer = df.write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def write_parquet(df: DataFrame, path: str, partitions: Sequence[str] = ()) -> str:
    writer = df.write.mode("overwrite")
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """The schema is given, so the files are read once."""
    return spark.read.schema(schema).option("header", True).csv(path)


def save_bundle(folds: DataFrame, path: str, analysis_id: str, dataset: str) -> str:
    """One table of all folds, laid out by task, dataset and fold; folders written before are replaced."""
    out = folds.withColumns({"analysis_id": F.lit(analysis_id), "dataset": F.lit(dataset)})
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("analysis_id", "dataset", "fold_id").parquet(path)
    return path


def load_bundle(spark: SparkSession, path: str, analysis_id: str, dataset: str, fold: str | None = None) -> DataFrame:
    """Rows of one dataset (and fold); only its folders are listed and read."""
    df = spark.read.parquet(path).where((F.col("analysis_id") == analysis_id) & (F.col("dataset") == dataset))
    return df if fold is None else df.where(F.col("fold_id") == fold)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished result lies at the path, on any file system Spark can reach."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def read_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """Stored result if there is one, else compute, store and read back."""
    if not path_exists(spark, path):
        # what an unfinished write left there is replaced
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def profile(df: DataFrame) -> DataFrame:
    """``n_rows, n_cols``"""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def write_profiled(df: DataFrame, path: str) -> DataFrame:
    """Write Parquet and profile it in the same job: ``name, n_rows, n_null, low, high, n_bytes`` per column.

    The figures are observed while the rows are written; ``low`` and ``high`` are NULL where a column is
    not numeric or has no value. ``n_bytes`` is that of the written files, from the file system.
    """
    seen = Observation()
    numeric = [isinstance(f.dataType, NumericType) for f in df.schema]
    measures = [F.count(F.lit(1)).alias("n")]
    for i, name in enumerate(df.columns):
        c = F.col(quoted(name))
        measures.append(F.count(c).alias(f"filled_{i}"))
        if numeric[i]:
            measures += [F.min(c).cast("double").alias(f"low_{i}"), F.max(c).cast("double").alias(f"high_{i}")]
    df.observe(seen, *measures).write.mode("overwrite").parquet(path)
    got, spark = seen.get, df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = int(system.getContentSummary(place).getLength())
    rows = [
        (name, got["n"], got["n"] - got[f"filled_{i}"], got.get(f"low_{i}"), got.get(f"high_{i}"), size)
        for i, name in enumerate(df.columns)
    ]
    return spark.createDataFrame(rows, "name string, n_rows long, n_null long, low double, high double, n_bytes long")


def write_params(spark: SparkSession, params: dict, path: str) -> str:
    """Chosen settings as one JSON record."""
    row = spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(path)
    return path


def read_params(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """All settings below the paths, one row per file."""
    return spark.read.schema(schema).json(list(paths))


