"""Folds, samples and dataset bundles; all draws follow a hash of (seed, id)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from strataflow.functions.hashing import hash_int, hash_key
from strataflow.operators.running import hash_ranks, quoted, running_sums

# The three folds and their usual shares.
FOLDS = {"train": 0.7, "val": 0.15, "test": 0.15}

#: Rows of a sample that one task may rank.
TOP_ROWS = 10_000


def stratified_split(
    df: DataFrame,
    fractions: Mapping[str, float] = FOLDS,
    label: str = "label",
    id_col: str = "subject_id",
    seed: int = 44,
    fold_col: str = "fold_id",
) -> DataFrame:
    """Fold per row, cut per label at the rounded cumulative shares in hash order."""
    if abs(sum(fractions.values()) - 1) > 1e-9:
        raise ValueError("fractions must add up to 1")
    ranked = hash_ranks(df.where(F.col(label).isNotNull()), [label], hash_key(seed, id_col), [id_col])
    names, cases, cum = list(fractions), "", 0.0
    for name in names[:-1]:
        cum += fractions[name]
        cases += f" WHEN rank0 < floor(n * {cum!r}D + 0.5D) THEN '{name}'"
    fold = f"CASE{cases} ELSE '{names[-1]}' END" if cases else f"'{names[-1]}'"
    return ranked.withColumn(fold_col, F.expr(fold)).drop("rank0", "n")


def check_folds(folds: DataFrame, id_col: str, fold_col: str, needed: Sequence[str] = tuple(FOLDS)) -> None:
    """Every fold is there and no id lies in two folds."""
    # at most one row per fold that is asked for
    present = folds.where(F.col(fold_col).isin(*needed)).select(fold_col).distinct().collect()
    missing = set(needed) - {r[0] for r in present}
    if missing:
        raise ValueError(f"folds missing: {sorted(missing)}")
    twice = folds.groupBy(id_col).agg(F.countDistinct(fold_col).alias("n")).where(F.col("n") > 1)
    if twice.limit(1).count():
        raise ValueError("an id lies in more than one fold")


def split_by_ids(
    df: DataFrame, folds: DataFrame, id_col: str = "subject_id", fold_col: str = "fold_id", check: bool = True
) -> DataFrame:
    """Fold of each row from a table of ids; rows without a fold are left out."""
    if check:
        check_folds(folds, id_col, fold_col)
    return df.drop(fold_col).join(folds.select(id_col, fold_col).distinct(), id_col)


def take_fraction(
    df: DataFrame, numerator: float, denominator: float, id_col: str, seed: int, flag: str
) -> DataFrame:
    """Flag the first ``floor(n * numerator / denominator)`` rows in hash order."""
    ranked = hash_ranks(df.withColumn("__all", F.lit(0)), ["__all"], hash_key(seed, id_col), [id_col])
    cut = f"rank0 < floor({float(numerator)!r}D / {float(denominator)!r}D * n)"
    return ranked.withColumn(flag, F.expr(cut)).drop("rank0", "n", "__all")


def domain_generalisation_split(
    df: DataFrame,
    test_ids: DataFrame,
    last_group: str,
    val_group: str,
    id_col: str = "subject_id",
    group_col: str = "group_var",
    val_share: tuple[float, float] = (0.35, 0.85),
    seed: int = 44,
) -> DataFrame:
    """Test ids of all groups are kept; the rest without the last group trains,
    a share of what is left of ``val_group`` validates."""
    ids = test_ids.select(id_col).distinct()
    test = df.join(ids, id_col, "left_semi").withColumn("fold_id", F.lit("test"))
    rest = df.join(ids, id_col, "left_anti").where(F.col(group_col) != last_group)
    late = take_fraction(rest.where(F.col(group_col) == val_group), *val_share, id_col, seed, "__val")
    late = late.withColumn("fold_id", F.when(F.col("__val"), "val").otherwise("train")).drop("__val")
    early = rest.where(F.col(group_col) != val_group).withColumn("fold_id", F.lit("train"))
    return test.unionByName(late).unionByName(early)


def sample_rows(df: DataFrame, n: int, id_col: str, seed: int = 44) -> DataFrame:
    """``n`` rows without replacement, the first by hash of their id; all rows, where there are fewer.

    Up to ``TOP_ROWS`` this is a distributed top-n; no task holds the rows of a larger sample (``rows_below``).
    """
    if n > TOP_ROWS:
        return rows_below(df, n, id_col, seed)
    return df.withColumn("__h", F.expr(hash_key(seed, id_col))).orderBy("__h", id_col).limit(n).drop("__h")


def rows_below(df: DataFrame, n: int, id_col: str, seed: int = 44, digits: int = 4) -> DataFrame:
    """The rows of ``sample_rows`` by threshold, without sorting them.

    A histogram of leading hash digits (``16 ** digits`` cells at most) names the cell in which the n-th row lies.
    Rows of lower cells are kept as they are; a cell of over ``TOP_ROWS`` rows is divided by its next digits, and
    only the last one is ranked. ``df`` is read once per histogram and twice for the result. Ids are meant
    to tell rows apart: rows of one id, which no digit divides, are ranked together; of them any may be taken.
    """
    hashed = df.withColumn("__h", F.expr(hash_key(seed, id_col)))
    prefix, left = "", n
    while len(prefix) < 32:
        cell = F.substring("__h", len(prefix) + 1, digits)
        counted = hashed.where(F.col("__h").startswith(prefix)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
        cells, inside = sorted((r["cell"], r["n"]) for r in counted.collect()), None
        for name, rows in cells:
            if left <= rows:
                inside = name, rows
                break
            left -= rows
        if inside is None:
            return df
        prefix += inside[0]
        if inside[1] <= TOP_ROWS:
            break
    lower = hashed.where(F.substring("__h", 1, len(prefix)) < prefix)
    edge = hashed.where(F.col("__h").startswith(prefix)).orderBy("__h", id_col).limit(left)
    return lower.unionByName(edge).drop("__h")


def domain_adaptation_augment(
    split: DataFrame, target_train: DataFrame, n_ood: int, id_col: str = "subject_id", seed: int = 44
) -> DataFrame:
    """Add ``n_ood`` training rows of the target group to the training fold."""
    extra = sample_rows(target_train, n_ood, id_col, seed).withColumn("fold_id", F.lit("train"))
    return split.unionByName(extra, allowMissingColumns=True)


def fold_roles(df: DataFrame, val_fold: str, test_fold: str, fold_col: str = "fold_id") -> DataFrame:
    """Role of each row when one fold validates and one is held out."""
    fold = F.col(fold_col)
    role = F.when(fold == test_fold, "test").when(fold == val_fold, "val").otherwise("train")
    return df.withColumn("role", role)


def sample_frame(
    df: DataFrame, n_rows: int = 2000, n_cols: int = 500, id_col: str = "subject_id", seed: int = 44, first: int = 5
) -> DataFrame:
    """First columns, a seeded choice of the others, and a seeded choice of rows."""
    import hashlib

    rest = sorted(df.columns[first:], key=lambda c: hashlib.md5(f"{seed}|{c}".encode()).hexdigest())
    chosen = set(rest[:n_cols])
    keep = df.columns[:first] + [c for c in df.columns[first:] if c in chosen]
    return sample_rows(df, n_rows, id_col, seed).select(*[F.col(f"`{c}`") for c in keep])


def group_weights(df: DataFrame, group: str) -> DataFrame:
    """Whole-number weight N / n_g per group, over all folds: ``group, n, weight``."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).scalar()
    return sizes.select(group, "n", F.floor(total / F.col("n")).cast("bigint").alias("weight"))


def add_group_weights(df: DataFrame, group: str) -> DataFrame:
    # one row per group: a shuffle by the group would gather all its rows in one task
    return df.join(F.broadcast(group_weights(df, group).select(group, "weight")), group)


def group_balanced_sample(
    df: DataFrame, group: str, id_col: str, n_draws: int, seed: int = 44
) -> DataFrame:
    """Draw ``n_draws`` rows with replacement, each with probability ~ N / n_g.

    Draw k takes a whole number below the total weight and the row whose
    weight interval holds it. Intervals and draws meet on a block of the
    weight axis, so neither side is gathered in one task.
    """
    weighted = add_group_weights(df, group).selectExpr("*", f"{hash_key(seed, id_col)} AS __h", "0 AS __k")
    placed = running_sums(weighted, ["__k"], ["__h", id_col], ["weight"], "coalesce(substring(__h, 1, 4), '')")
    total = group_weights(df, group).agg(F.sum(F.col("n") * F.col("weight"))).scalar()
    draws = df.sparkSession.range(1, n_draws + 1).withColumnRenamed("id", "draw").withColumn("total_weight", total)
    draws = draws.withColumn("__at", F.expr(f"pmod({hash_int(f'{seed}|draw', 'draw')}, total_weight)"))
    width = "greatest(1L, total_weight DIV 4096)"
    rows = placed.withColumn(
        "__block",
        F.expr(f"explode(sequence(before_weight DIV {width}, (before_weight + weight - 1) DIV {width}))"),
    )
    hits = draws.selectExpr("draw", "__at", f"__at DIV {width} AS __block").join(rows, "__block")
    return hits.where("__at >= before_weight AND __at < before_weight + weight").select("draw", *df.columns)


def domain_weights(df: DataFrame, is_target: Column) -> DataFrame:
    """Training weight: target rows 0, source rows n / n_source over the whole set."""
    share = df.agg(F.count("*") / F.count_if(~is_target)).scalar()
    return df.withColumn("sample_weight", F.when(is_target, F.lit(0.0)).otherwise(share))


def null_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Columns that hold a NULL."""
    flags = df.agg(F.array(*[F.max(F.col(f"`{n}`").isNull().cast("int")) for n in names])).first()[0]
    return [n for n, f in zip(names, flags or []) if f]


def to_sparse(df: DataFrame, names: Sequence[str], output: str = "features") -> DataFrame:
    """Columns to one sparse vector; refused while NULLs remain."""
    from pyspark.ml.feature import VectorAssembler

    bad = null_columns(df, names)
    if bad:
        raise ValueError(f"NULLs remain in {bad[:5]}")
    # the assembler reads a dotted name as a field access
    safe = {n: f"__x{i}" for i, n in enumerate(names)}
    renamed = df.withColumnsRenamed(safe)
    assembled = VectorAssembler(inputCols=list(safe.values()), outputCol=output).transform(renamed)
    return assembled.drop(*safe.values())


def from_sparse(df: DataFrame, names: Sequence[str], vector: str = "features") -> DataFrame:
    """Vector back to named columns."""
    from pyspark.ml.functions import vector_to_array

    arr = df.withColumn("__a", vector_to_array(vector)).drop(vector)
    return arr.select(
        *[F.col(f"`{c}`") for c in arr.columns if c != "__a"],
        *[F.element_at("__a", i + 1).alias(n) for i, n in enumerate(names)],
    )


def long_to_sparse(long: DataFrame, vocabulary: DataFrame, size: int, id_col: str = "subject_id") -> DataFrame:
    """Long features straight to sparse vectors, without wide columns.

    A row's vector holds at most one entry per vocabulary word.
    """
    from pyspark.ml.linalg import VectorUDT

    value = "coalesce(CAST(feature_val AS DOUBLE), double('nan'))"
    pairs = (
        long.join(vocabulary, "feature_id")
        .groupBy(id_col)
        .agg(F.sort_array(F.collect_list(F.struct(F.expr("CAST(idx AS INT) AS idx"), F.expr(f"{value} AS x")))).alias("p"))
        .selectExpr(quoted(id_col), "p.idx AS at", "p.x AS x")
    )

    def vectors(batches):
        for batch in batches:
            at, x = batch.column(1), batch.column(2)
            flat, ends = at.flatten().to_numpy(), at.offsets.to_numpy()
            rising = np.diff(flat) > 0
            rising[ends[1:-1] - ends[0] - 1] = True
            if not rising.all() or flat.min() < 0 or flat.max() >= size:
                raise ValueError(f"a row has two values of one vocabulary word, or a word's index is not below {size}")
            n = batch.num_rows
            made = pa.StructArray.from_arrays(
                [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), at, x],
                names=["type", "size", "indices", "values"],
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), made], [id_col, "features"])

    # the vector's own struct, a batch at a time: no Python object per entry
    return pairs.mapInArrow(vectors, StructType([pairs.schema[id_col], StructField("features", VectorUDT())]))


def sparse_for_all(
    rows: DataFrame, long: DataFrame, vocabulary: DataFrame, size: int, id_col: str = "subject_id"
) -> DataFrame:
    """Each row of ``rows`` with its vector; one without features gets an empty vector."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    empty = rows.sparkSession.createDataFrame(
        [(SparseVector(size, [], []),)], StructType([StructField("__empty", VectorUDT())])
    )
    joined = rows.join(long_to_sparse(long, vocabulary, size, id_col), id_col, "left").crossJoin(F.broadcast(empty))
    return joined.withColumn("features", F.coalesce("features", "__empty")).drop("__empty")


def stack_folds(parts: Mapping[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Folds in one table keyed by ``(fold_id, id)``."""
    out = None
    for name, part in parts.items():
        rows = part.select(*columns).withColumn("fold_id", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def uncovered_ids(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """How many keys of each side the other lacks: ``side, n_missing``."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    only_a = a.join(b, list(keys), "left_anti").agg(F.count("*").alias("n_missing"))
    only_b = b.join(a, list(keys), "left_anti").agg(F.count("*").alias("n_missing"))
    return only_a.select(F.lit("left_only").alias("side"), "n_missing").unionByName(
        only_b.select(F.lit("right_only").alias("side"), "n_missing")
    )


def assert_same_ids(left: DataFrame, right: DataFrame, *keys: str) -> None:
    missing = {r["side"]: r["n_missing"] for r in uncovered_ids(left, right, *keys).collect()}
    if any(missing.values()):
        raise ValueError(f"ids differ: {missing}")
