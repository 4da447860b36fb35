"""Exact top-k inner products by sorted lists read in order (no random access).

Each dimension of a block of candidates is a list sorted by value; a query reads it
from the end that its own sign prefers, equal values together. What has been read gives
every candidate an upper bound (unread components count as the last value read) and a
lower bound (unread components count as the worst value of their list). The floor of a
query is the k-th lower bound of the block's candidates, or the k-th score of earlier
blocks if that is more. When the upper bound of an unread candidate and of nearly all
read ones lies below it, the query stops reading, and the scores of those few that could
still qualify are resolved. Candidates that can no longer qualify for any query are left
out of the deeper reads. All queries of a block read to the same depths, so a depth is
two matrix products, one per bound.

Queries and candidates meet in blocks of bounded size, each pair of blocks once; each
pair yields at most k rows per query, which are ranked with a limit before the shuffle.

Vectors that are null or hold a null or non-finite component take no part, nor do null
ids. Rows that repeat a vec_id are rows of their own: each is a candidate, and each asks if
its id does, ranked together under that id; none meets a row of its own id. Equal rows
travel once with their number. Vectors of different length have no product and never
meet. Ties go to the smaller vec_id. Fewer candidates than k give fewer rows; an empty
table gives none. Columns beside ``vec_id`` and ``embedding`` are not read, whatever their
names, unless ``is_query`` names them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 20
SCALE = 64
QUERY_ROWS = 1024
RUN_ROWS = 8192
BLOCK_ROWS = 2048
#: Shares of a list read before a query is looked at again; at the last all is known.
DEPTHS = (0.25, 0.6, 1.0)
#: Share of a block that may be left to resolve when a query stops.
FEW = 0.04
LEAST = np.iinfo(np.int64).min


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.empty((queries, 0), np.int64)
        self.id = np.empty((queries, 0), np.int64)

    def floor(self) -> np.ndarray:
        """The k-th score of each query; the least number where there are fewer."""
        if self.score.shape[1] < self.k:
            return np.full(len(self.score), LEAST)
        return self.score[:, self.k - 1]

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Take in (query, id, score) triples."""
        n, had = len(self.score), self.score.shape[1]
        taken = self.id >= 0 if had else np.empty((n, 0), bool)
        q = np.concatenate([np.nonzero(taken)[0], query])
        s = np.concatenate([self.score[taken], scores])
        i = np.concatenate([self.id[taken], ids])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        rank = np.arange(len(q)) - np.searchsorted(q, np.arange(n))[q]
        keep = rank < self.k
        width = int(rank[keep].max()) + 1 if keep.any() else 0
        self.score = np.full((n, width), LEAST)
        self.id = np.full((n, width), -1)
        self.score[q[keep], rank[keep]], self.id[q[keep], rank[keep]] = s[keep], i[keep]


def _number_type(q: np.ndarray, x: np.ndarray):
    """The quickest type in which all sums are exact."""
    most = x.shape[1] * int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0))
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def _bounds(q: np.ndarray, x: np.ndarray, high: np.ndarray, low: np.ndarray, top: np.ndarray, end: np.ndarray, kind):
    """Upper and lower bounds, queries x candidates, when lists are read down to ``high`` and up to ``low``.

    ``top`` and ``end`` are the largest and smallest values of the lists.
    """
    signed = np.hstack([np.maximum(q, 0), np.minimum(q, 0)]).astype(kind)
    most = np.hstack([np.maximum(x, high), np.minimum(x, low)]).astype(kind)
    least = np.hstack([np.where(x >= high, x, end), np.where(x <= low, x, top)]).astype(kind)
    return signed @ most.T, signed @ least.T


def _kth(lower: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, or the least number where a row has fewer."""
    if lower.shape[1] < k:
        return np.full(len(lower), LEAST)
    kth = np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k]
    out = np.full(len(kth), LEAST)
    known = np.isfinite(kth)
    out[known] = kth[known].astype(np.int64)
    return out


def read_block(
    best: Best, q_index: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, rows: np.ndarray | None = None
) -> None:
    """Bring one block of candidates to all queries. ``q_index`` holds the queries' own candidate ids.

    ``rows`` are the numbers, 0 or more, under which ``best`` keeps the candidates, if not their ids.
    """
    rows = ids if rows is None else rows
    kind = _number_type(q, x)
    lists = np.sort(x, axis=0)
    end, top = lists[0], lists[-1]
    todo, alive = np.arange(len(q)), np.arange(len(x))
    for depth in DEPTHS:
        t = min(len(x) - 1, int(depth * len(x)))
        high, low = lists[len(x) - 1 - t], lists[t]  # the last values read
        upper, lower = _bounds(q[todo], x[alive], high, low, top, end, kind)
        own = q_index[todo][:, None] == ids[alive]
        lower[own] = LEAST if kind is np.int64 else -np.inf
        floor = np.maximum(best.floor()[todo], _kth(lower, best.k))
        fit = (upper >= floor[:, None]) & ~own
        # an unread candidate has at most this score; read ones have their own bound
        outside = np.maximum(q[todo], 0) @ high + np.minimum(q[todo], 0) @ low
        stop = (outside < floor) & (fit.sum(1) <= FEW * len(x)) | (depth >= 1)
        left, at = np.nonzero(fit[stop])
        query, at = todo[stop][left], alive[at]
        scores = np.concatenate(
            [np.einsum("ij,ij->i", q[query[s : s + 65536]], x[at[s : s + 65536]]) for s in range(0, len(query), 65536)]
            or [np.empty(0, np.int64)]
        )
        best.add(query, rows[at], scores)
        alive = alive[fit[~stop].any(0)]
        todo = todo[~stop]
        if not len(todo):
            return


def _search(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """One block of queries against one run of candidates."""
    asked = pdf["query"].to_numpy()
    if asked.all() or not asked.any():
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "times": []}).astype("int64")
    pdf = pdf.sort_values("vec_id", kind="stable")  # so that the smaller row number is the smaller id
    asked = pdf["query"].to_numpy()
    x = np.stack(pdf["x"].to_numpy()).astype(np.int64)
    ids, copies = pdf["vec_id"].to_numpy(), np.minimum(pdf["copies"].to_numpy(), k)
    q, q_ids, q_copies, x, ids, copies = x[asked], ids[asked], copies[asked], x[~asked], ids[~asked], copies[~asked]
    best = Best(len(q), k)
    for s in range(0, len(x), BLOCK_ROWS):
        block = slice(s, s + BLOCK_ROWS)
        read_block(best, q_ids, q, ids[block], x[block], np.arange(len(x))[block])
    row, col = np.nonzero(best.id >= 0)
    found = best.id[row, col]
    times = np.minimum(q_copies[row] * copies[found], k)
    return pd.DataFrame({"query_id": q_ids[row], "vec_id": ids[found], "score": best.score[row, col], "times": times})


def top_products(vectors: DataFrame, is_query: str, k: int = K, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows where ``is_query`` holds, against all rows."""
    finite = "forall(embedding, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity'))"
    usable = vectors.where(f"vec_id IS NOT NULL AND embedding IS NOT NULL AND {finite}").selectExpr(
        "CAST(vec_id AS BIGINT) AS vec_id",
        f"transform(embedding, v -> CAST(floor({scale} * CAST(v AS DOUBLE)) AS BIGINT)) AS x",
    )
    rows = usable.groupBy("vec_id", "x").agg(F.count("*").alias("copies"))
    sizes = rows.selectExpr("count(*) AS n", f"count_if({is_query}) AS q").first()
    runs, blocks = max(1, -(-sizes["n"] // RUN_ROWS)), max(1, -(-sizes["q"] // QUERY_ROWS))
    mine = f"CAST(pmod(xxhash64(vec_id, x, 1), {blocks}) AS INT)"
    run = f"CAST(pmod(xxhash64(vec_id, x), {runs}) AS INT)"
    # every block of queries meets every run of candidates once
    queries = rows.where(is_query).selectExpr(
        "true AS query", "vec_id", "x", "copies", f"{mine} AS block", f"explode(sequence(0, {runs - 1})) AS run"
    )
    candidates = rows.selectExpr(
        "false AS query", "vec_id", "x", "copies", f"explode(sequence(0, {blocks - 1})) AS block", f"{run} AS run"
    )
    met = queries.unionByName(candidates).withColumn("dimension", F.size("x"))
    found = met.groupBy("block", "run", "dimension").applyInPandas(
        lambda pdf: _search(pdf, k), "query_id bigint, vec_id bigint, score bigint, times bigint"
    ).selectExpr("query_id", "vec_id", "score", "explode(sequence(1, times)) AS copy")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select(
        "query_id", "rank", "vec_id", "score"
    )
