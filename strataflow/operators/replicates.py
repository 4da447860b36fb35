"""Bootstrap replicates in blocks: exact multinomial counts without rows x replicates.

A replicate draws n rows with replacement from the n rows of a stratum. Here rows are
never multiplied. Rows of equal score and label are one point with a multiplicity;
points in order of their score fall into cells of bounded size. The draws of a stratum
are divided by label, then down a binary tree over the cells of a label: a node's draws
go to its left half as a binomial quantile of a number that is a function of (seed,
stratum, node, replicate), so every task that needs a node computes it alike. A cell
deals its own draws to its rows. What is handed on is one array over replicates per
node. Since cells follow the score, a cell also knows how many draws of either label lie
before it, and gives its share of every metric by itself: ranked ones, too.

Rows that leave a task: one array per node of the tree, and one row per cell and
replicate, summed over neighbouring cells: n / ``TOGETHER`` x replicates, n / ``LEAF`` if that is less. A single score that
half of all rows have is one point in a cell of its own, and costs one row.

Counts of one replicate are multinomial; those of any two replicates are independent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.operators.bootstrap import BOOT, PRIME, quantile_interval
from strataflow.operators.metrics import LOSS_UNDEFINED
from strataflow.operators.running import ALL, quoted, score_table
from strataflow.session import cut_lineage

#: Rows of a cell; a cell's draws are made in one task, some replicates at a time.
LEAF = 4096
#: Binary levels of the tree that one task descends.
FAN = 10
#: Nodes that one call divides draws among, and rows of neighbouring cells that one call takes.
CHILDREN, TOGETHER = 1024, 1 << 16
#: Numbers held at once by one step.
CELLS = 1 << 21
#: Standard deviations, and numbers besides, on either side of the mean that a quantile is looked for in.
REACH, MARGIN = 12, 20
METRICS = ("auc", "auprc", "loss_bce", "brier", "mean_prediction", "n")
_KEY = "__key"
_ROW = f"{_KEY} string, label int, node bigint, size bigint"
_NODE = f"{_ROW}, draws array<bigint>, before array<bigint>, whole array<bigint>"
_SUMS = ("n0", "n1", "auc", "auprc", "loss_bce", "brier", "mean_prediction")


def _two_hashes(*parts) -> tuple[int, int]:
    digest = hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    return int(digest[:12], 16) % PRIME, int(digest[12:24], 16) % PRIME


def _hash_pairs(n: int, *parts) -> np.ndarray:
    """Both hashes of ``parts`` and each number below ``n``."""
    begun = hashlib.md5("|".join(map(str, [*parts, ""])).encode())
    digests = bytearray()
    for j in range(n):
        one = begun.copy()
        one.update(b"%d" % j)
        digests += one.digest()
    six = np.frombuffer(digests, np.uint8).reshape(n, 16)[:, :12].reshape(n, 2, 6)
    return (six.astype(np.int64) << np.arange(40, -1, -8, dtype=np.int64)).sum(2) % PRIME


def _numbers(replicates: np.ndarray, *parts) -> np.ndarray:
    """A number between 0 and 1 for each replicate."""
    h1, h2 = _two_hashes(*parts)
    return ((h1 + replicates * h2) % PRIME + 0.5) / PRIME


def binomial_quantiles(trials: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """Least k with P(X <= k) >= u for X binomial over ``trials``, by sums of ratios of neighbouring terms."""
    out = np.empty(len(trials), np.int64)
    mean, reach = trials * p, REACH * np.sqrt(trials * p * (1 - p)) + MARGIN
    low = np.maximum(np.floor(mean - reach), 0).astype(np.int64)
    high = np.minimum(np.ceil(mean + reach), trials).astype(np.int64)
    width = int((high - low).max()) + 1 if len(trials) else 0
    step = max(1, CELLS // max(width, 1))
    for a in range(0, len(trials), step):
        part = slice(a, a + step)
        k = low[part, None] + np.arange(1, width)
        inside = k <= high[part, None]
        ratio = np.where(inside, (trials[part, None] - k + 1) / k * (p / (1 - p)), 1.0)
        log = np.concatenate([np.zeros((len(k), 1)), np.cumsum(np.log(ratio), 1)], 1)
        inside = np.concatenate([np.ones((len(k), 1), bool), inside], 1)
        weight = np.where(inside, np.exp(log - np.where(inside, log, -np.inf).max(1, keepdims=True)), 0.0)
        total = np.cumsum(weight, 1)
        out[part] = low[part] + (total >= u[part, None] * total[:, -1:]).argmax(1)
    return out


def _divided(seed, key: str, label: int, parent: int, sizes: np.ndarray, draws: np.ndarray, replicates, fan: int, base: int):
    """Draws of the ``2 ** fan`` children of a node; ``base`` is the absolute level of the children."""
    levels = [sizes]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).sum(1))
    now = draws[None, :]
    for depth in range(fan - 1, -1, -1):
        size = levels[depth].reshape(-1, 2)
        left = np.zeros_like(now)
        for k, (a, b) in enumerate(size.tolist()):
            if b == 0:
                left[k] = now[k]
            elif a:
                index = (parent << (fan - depth - 1)) + k
                u = _numbers(replicates, seed, "split", key, label, base + depth + 1, index)
                left[k] = binomial_quantiles(now[k], a / (a + b), u)
        now = np.stack([left, now - left], 1).reshape(-1, now.shape[1])
    return now


def _cells(points: DataFrame, leaf: int) -> DataFrame:
    """A cell for each score: rows before it in units of ``leaf``; scores of very many rows have their own."""
    return points.withColumn("cell", F.expr(f"2 * ((before_c0 + before_c1) DIV {leaf}) + IF(c0 + c1 >= {leaf}, 1, 0)"))


def _deal(seed, key, label, cell, counts: np.ndarray, draws: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """How often each point of a cell is drawn: points x replicates."""
    if np.count_nonzero(counts) == 1:
        return (counts > 0)[:, None] * draws
    size, most = int(counts.sum()), int(draws.max(initial=0))
    if not size or not most:
        return np.zeros((len(counts), len(draws)), np.int64)
    h = _hash_pairs(most, seed, "draw", key, label, cell)
    point_of = np.repeat(np.arange(len(counts)), counts)
    place = (h[:, :1] + replicates * h[:, 1:]) % PRIME % size
    taken = np.arange(most)[:, None] < draws
    at = (point_of[place] * len(draws) + np.arange(len(draws)))[taken]
    return np.bincount(at, minlength=len(counts) * len(draws)).reshape(len(counts), -1)


def _shares(pred, counts, before, whole) -> dict[str, np.ndarray]:
    """A cell's part of each sum, per replicate. ``counts``, ``before``, ``whole`` are pairs by label."""
    c0, c1 = counts
    ahead0, ahead1 = (b + np.cumsum(c, 0) - c for b, c in zip(before, counts))
    true, false = whole[1] - ahead1, whole[0] - ahead0
    p = pred[:, None]
    clipped = np.clip(p, 1e-15, 1 - 1e-15)
    return {
        "n0": c0.sum(0),
        "n1": c1.sum(0),
        "auc": (c1 * (ahead0 + c0 / 2)).sum(0),
        "auprc": (c1 / np.maximum(whole[1], 1) * true / np.maximum(true + false, 1)).sum(0),
        "loss_bce": -(c1 * np.log(clipped) + c0 * np.log(1 - clipped)).sum(0),
        "brier": (c1 * (1 - p) ** 2 + c0 * p**2).sum(0),
        "mean_prediction": ((c0 + c1) * p).sum(0),
    }


def replicate_metrics(
    df: DataFrame,
    n_boot: int = 1000,
    strata: Sequence[str] = (),
    metrics: Sequence[str] = METRICS,
    seed: int = 44,
    first: int = 1,
    label: str = "labels",
    pred: str = "pred_probs",
    leaf: int = LEAF,
    fan: int = FAN,
) -> DataFrame:
    """``metric, boot_iter, strata, performance`` of unweighted rows; rows without stratum, score or label are left out.

    ``n`` is the number of rows drawn. ``first`` lets replicates be made in ranges.
    """
    strata = list(strata)
    if unknown := set(metrics) - set(METRICS):
        raise ValueError(f"no metrics by blocks: {sorted(unknown)}")
    keys = strata or [ALL]
    rows = df if strata else df.withColumn(ALL, F.lit(0))
    rows = rows.where(" AND ".join(f"{quoted(c)} IS NOT NULL" for c in [*keys, label, pred]))
    rows = rows.selectExpr(*map(quoted, keys), f"CAST({quoted(pred)} AS DOUBLE) AS pred", f"{quoted(label)} = 1 AS positive")
    sums = {f"c{k}": f"IF({'' if k else 'NOT '}positive, 1L, 0L)" for k in (0, 1)}
    key = f"concat_ws('|', {', '.join(f'CAST({quoted(k)} AS STRING)' for k in keys)})"
    points = _cells(score_table(rows, keys, "pred", sums), leaf).withColumn(_KEY, F.expr(key))
    # every level of the tree and the metrics read these
    points = cut_lineage(points.select(_KEY, "cell", "pred", "c0", "c1"))
    named = rows.select(F.expr(key).alias(_KEY), *map(quoted, keys)).distinct()

    # sizes of the tree's nodes, from the cells up; a cell without rows of a label still learns what lies before it
    tables = [
        points.groupBy(_KEY, "cell")
        .agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
        .selectExpr(_KEY, "stack(2, 0, c0, 1, c1) AS (label, size)", "cell AS node")
        .select(_KEY, "label", "node", "size")
    ]
    tables[0] = cut_lineage(tables[0])
    highest = tables[0].agg(F.max("node")).first()[0] or 0
    levels = max(1, -(-int(highest).bit_length() // fan))
    for _ in range(levels):
        up = tables[-1].groupBy(_KEY, "label", F.expr(f"node >> {fan}").alias("node")).agg(F.sum("size").alias("size"))
        tables.append(up.select(_KEY, "label", "node", "size"))
    replicates = np.arange(first, first + n_boot, dtype=np.int64)

    def roots(pdf: pd.DataFrame) -> pd.DataFrame:
        size = dict(zip(pdf["label"], pdf["size"]))
        n, ones, name = sum(size.values()), size.get(1, 0), pdf[_KEY].iloc[0]
        drawn = np.full(n_boot, n if ones == n else 0)
        if 0 < ones < n:
            drawn = binomial_quantiles(np.full(n_boot, n), ones / n, _numbers(replicates, seed, "label", name))
        whole = [n - drawn if k == 0 else drawn for k in pdf["label"]]
        return pdf.assign(draws=whole, before=[np.zeros(n_boot, np.int64)] * len(pdf), whole=whole)

    nodes = tables[-1].groupBy(_KEY).applyInPandas(roots, _NODE)

    def descend(level: int):
        def run(above: pd.DataFrame, children: pd.DataFrame) -> pd.DataFrame:
            above, children = above.sort_values("node"), children.sort_values("node")
            node, size = children["node"].to_numpy(), children["size"].to_numpy()
            made: dict[str, list] = {"draws": [], "before": [], "whole": []}
            for top in above.itertuples(index=False):
                a, b = np.searchsorted(node >> fan, [top.node, top.node + 1])
                at = node[a:b] - (top.node << fan)
                sizes = np.zeros(1 << fan, np.int64)
                sizes[at] = size[a:b]
                draws = _divided(
                    seed, above[_KEY].iloc[0], int(top.label), int(top.node), sizes, np.asarray(top.draws), replicates, fan, level * fan
                )
                before = np.asarray(top.before) + np.cumsum(draws, 0) - draws
                made["draws"] += list(draws[at])
                made["before"] += list(before[at])
                made["whole"] += [np.asarray(top.whole)] * len(at)
            return children[[_KEY, "label", "node", "size"]].assign(**made)

        return run

    # neighbours come together: a call costs more than a node or a small cell
    near = max(0, (CHILDREN >> fan).bit_length() - 1)
    for level in range(levels - 1, -1, -1):
        parents = nodes.withColumn("parents", F.expr(f"node >> {near}")).groupBy(_KEY, "label", "parents")
        below = tables[level].withColumn("parents", F.expr(f"node >> {fan + near}")).groupBy(_KEY, "label", "parents")
        nodes = parents.cogroup(below).applyInPandas(descend(level), _NODE)

    def metric_shares(pdf: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell", "pred"])
        name, number, pred_ = pdf[_KEY].iloc[0], pdf["cell"].to_numpy(), pdf["pred"].to_numpy()
        sizes = [pdf[f"c{k}"].to_numpy() for k in (0, 1)]
        held = {(c, k): i for i, (c, k) in enumerate(zip(cell["cell"], cell["label"]))}
        known = [cell[c].to_numpy() for c in ("draws", "before", "whole")]
        total = {c: np.zeros(n_boot) for c in _SUMS}
        starts = np.flatnonzero(np.diff(number, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(number)]):
            at = [held[number[a], k] for k in (0, 1)]
            draws, before, whole = ([np.asarray(x[i]) for i in at] for x in known)
            step = max(1, CELLS // max(b - a, int(max(d.max() for d in draws)), 1))
            for first_ in range(0, n_boot, step):
                part = slice(first_, first_ + step)
                counts = [
                    _deal(seed, name, k, int(number[a]), sizes[k][a:b], draws[k][part], replicates[part]) for k in (0, 1)
                ]
                shares = _shares(pred_[a:b], counts, [x[part] for x in before], [w[part] for w in whole])
                for c in _SUMS:
                    total[c][part] += shares[c]
        return pd.DataFrame({_KEY: name, BOOT: replicates.astype(np.int32), **total})[[_KEY, BOOT, *_SUMS]]

    schema = f"{_KEY} string, {BOOT} int, " + ", ".join(f"{c} double" for c in _SUMS)
    cells = nodes.withColumnRenamed("node", "cell")
    # numbers of cells go up by two for each cell's rows
    together = F.expr(f"cell >> {max(1, (2 * TOGETHER // leaf).bit_length() - 1)}").alias("cells")
    made = points.groupBy(_KEY, together).cogroup(cells.groupBy(_KEY, together)).applyInPandas(metric_shares, schema)
    total = made.groupBy(_KEY, BOOT).agg(*[F.sum(c).alias(c) for c in _SUMS])
    values = {
        "auc": "coalesce(auc / nullif(n0 * n1, 0), -1D)",
        "auprc": "IF(n1 > 0, auprc, NULL)",
        "loss_bce": f"IF(n0 = 0 OR n1 = 0, {LOSS_UNDEFINED!r}D, loss_bce / (n0 + n1))",
        "brier": "brier / (n0 + n1)",
        "mean_prediction": "mean_prediction / (n0 + n1)",
        "n": "n0 + n1",
    }
    wide = total.join(named, _KEY).drop(ALL)
    stacked = ", ".join(f"'{m}', {values[m]}" for m in metrics)
    return wide.selectExpr(f"stack({len(metrics)}, {stacked}) AS (metric, performance)", BOOT, *map(quoted, strata)).select(
        "metric", BOOT, *map(quoted, strata), "performance"
    )



def replicate_intervals(df: DataFrame, n_boot: int = 1000, strata: Sequence[str] = (), alpha: float = 0.05, **kw) -> DataFrame:
    """Interval per metric and stratum over replicates made in blocks."""
    return quantile_interval(replicate_metrics(df, n_boot, strata, **kw), ["metric", *strata], alpha=alpha)
