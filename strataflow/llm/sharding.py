"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``NODES`` points on a ring; a key goes clockwise from its hash to the
next point whose shard has room, so with tight bounds all counts are equal to within
one row, while most keys stay with the shard they hash to. The law of the result is
``rows``: the bounds are the even shares, so all fill up exactly.

The keys between two points form an arc. How many rows of an arc stay, and how many
go on to which shard, depends only on the arcs' row counts; that plan is made from
one number per arc (shards x ``NODES`` numbers). Within an arc the rows of the lowest
hashes stay. A row then needs its rank in its arc, which is summed over cells of
bounded size, never over an arc in one task.

Null doc_ids hash by their text. Repeated rows take places of their own. An empty
table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.operators.running import running_sums
from strataflow.session import cut_lineage

NODES = 64
#: A row's size beside its text's bytes.
OVERHEAD = 16
#: Rows that a cell of an arc holds about.
CELL_ROWS = 4096
_RING = 1 << 32


def ring(shards: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Sorted points and their shards; a shard's points depend on its number alone."""
    points, owners = [], []
    for shard in range(shards):
        draw = np.random.default_rng([shard, 977]).choice(_RING, nodes, replace=False)
        points.append(draw)
        owners.append(np.full(nodes, shard))
    points, owners = np.concatenate(points), np.concatenate(owners)
    order = np.lexsort((owners, points))
    return points[order].astype(np.int64), owners[order].astype(np.int64)


@lru_cache(maxsize=8)
def _points(shards: int, nodes: int) -> np.ndarray:
    return ring(shards, nodes)[0]


def bounded_loads(counts: np.ndarray, owners: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each arc, (shard, rows) in order: what its point takes, then what goes on.

    Step by step, what an arc has left reaches the next point clockwise; a shard with
    room takes from the arcs that reach it in order of the ring. The bounds must
    add up to at least all rows.
    """
    arcs = len(owners)
    room = bounds.astype(np.int64).copy()
    left = counts.astype(np.int64).copy()
    plan: list[list[tuple[int, int]]] = [[] for _ in range(arcs)]
    for hop in range(arcs):
        waiting = np.flatnonzero(left)
        if not len(waiting):
            break
        for arc in waiting:
            shard = owners[(arc + hop) % arcs]
            if took := min(int(left[arc]), int(room[shard])):
                room[shard] -= took
                left[arc] -= took
                plan[arc].append((int(shard), took))
    return plan


def even_bounds(rows: int, shards: int) -> np.ndarray:
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)


def assign(docs: DataFrame, shards: int, nodes: int = NODES) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    points = _points(shards, nodes)
    place = F.coalesce(F.xxhash64("doc_id"), F.lit(0).cast("bigint"))
    hashed = docs.select("doc_id", F.octet_length(body).cast("bigint").alias("bytes"), F.crc32(body).alias("text_crc32"))
    by_id = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(1), "text_crc32", "bytes")).otherwise(place)
    # the mixed low half is the place on the ring, the high half orders rows within its cell
    hashed = hashed.withColumn("hash", by_id).withColumn("spot", F.expr(f"pmod(hash, {_RING}L)"))

    @F.pandas_udf("int")
    def arc_of(spot: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(points, spot.to_numpy(), "left") % len(points)).astype(np.int32))

    # three numbers and a hash per row are kept, the texts are not
    rows = cut_lineage(hashed.withColumn("arc", arc_of("spot")))
    counts = np.zeros(len(points), np.int64)
    for r in rows.groupBy("arc").count().collect():  # one row per point of the ring
        counts[r["arc"]] = r["count"]
    total = int(counts.sum())
    plan = bounded_loads(counts, ring(shards, nodes)[1], even_bounds(total, shards))

    # segments: from which rank of an arc on, which shard, and the slot of its first row
    start_rank, start_slot, shard_of, filled = [], [], [], [0] * shards
    for arc, parts in enumerate(plan):
        rank = 0
        for shard, n in parts:
            start_rank.append((arc << 44) + rank)
            start_slot.append(filled[shard])
            shard_of.append(shard)
            rank, filled[shard] = rank + n, filled[shard] + n
    start_rank, start_slot, shard_of = np.array(start_rank), np.array(start_slot), np.array(shard_of)

    @F.pandas_udf("struct<shard int, slot bigint>")
    def placed(arc: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = (arc.to_numpy(np.int64) << 44) + rank.to_numpy(np.int64)
        at = np.searchsorted(start_rank, key, "right") - 1
        return pd.DataFrame({"shard": shard_of[at].astype(np.int32), "slot": start_slot[at] + key - start_rank[at]})

    # an arc runs once round from its point, so distances never fall along it; cells are equal parts of the ring
    cells = max(1, total // CELL_ROWS)
    order = ["turn", "hash", "doc_id", "text_crc32", "bytes", "tie"]
    turned = rows.selectExpr("*", f"pmod(spot - {int(points[-1]) + 1}L, {_RING}L) AS turn", "1L AS one").withColumn(
        "tie", F.monotonically_increasing_id()
    )
    ranked = running_sums(turned, ["arc"], order, ["one"], f"turn * {cells}L DIV {_RING}L")
    return ranked.withColumn("to", placed("arc", "before_one")).select(
        "doc_id",
        (F.col("bytes") + OVERHEAD).alias("size"),
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("to.shard").alias("shard"),
        F.col("to.slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
