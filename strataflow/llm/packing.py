"""Packing of token sequences into bins of fixed length, certified by lower bounds.

Best-fit decreasing runs in many partitions side by side. A dual feasible function
``f`` maps sizes to weights such that the weights of whatever fits a bin sum to at
most 1, so the sum of all weights is a lower bound on the number of bins; the best
of a family of such functions certifies a partition whose bin count meets it. What a
partition cannot certify lies in its bins with gaps: their pieces go on, are dealt
anew over as many partitions as their number asks for, and are packed again by best-fit
decreasing, until one partition holds them all or a round saves too few bins. Full bins
never move again, and no task packs more pieces for there being more of them.

Only documents longer than a bin are cut: full pieces at the end, a shorter first one.
Every row is a document of its own, repeated rows too. A null or empty text has the
closing id alone. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.batches import slices
from strataflow.llm.tokens import encoder
from strataflow.session import cut_lineage

CAPACITY = 2048
#: Pieces of a partition; its bins are built in one task.
PER_PARTITION = 4096
#: A round is the last when it saves less than this share of the bins it was given.
LEAST_SAVED = 0.005
#: Rounds that sequence ids have room for.
MOST_ROUNDS = 100
#: A bin with a larger gap counts as having one.
GAP = 16


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, closing: int = 0) -> DataFrame:
    """One row per piece: place in the document, length and checksum of its ids."""
    end = np.array([closing], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            rows: list[list] = [[], [], [], [], []]
            for doc, ids in zip(part.column("doc_id").to_pylist(), encoder(path).encode(texts)):
                ids += end
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + n)])
                    for column, value in zip(rows, (doc, k, start, n, crc)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        # the worker lives on: what this task learned would stay beside what the next stage holds
        encoder(path).forget()
        pa.default_memory_pool().release_unused()

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; ``sizes`` in falling order.

    Open bins lie in stacks by free room; a bit set over rooms finds the tightest one.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, bins = 0, 0
    bin_of, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b = capacity, bins
            bins += 1
        bin_of[i], offset[i] = b, capacity - room
        if left := room - size:
            stacks[left].append(b)
            open_rooms |= 1 << left
    return bin_of, offset


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Best bound over two families of dual feasible functions, from the counts by size.

    For a threshold t up to half a bin: sizes over capacity - t weigh 1, sizes under t
    nothing, the others their share. For k = 1, 2, ...: a size x weighs
    floor((k + 1) x / capacity) / k, or x / capacity where (k + 1) x / capacity is whole.
    """
    count = np.bincount(sizes, minlength=capacity + 1)
    x = np.arange(capacity + 1)
    upto, volume = np.cumsum(count), np.cumsum(count * x)
    t = np.arange(capacity // 2 + 1)
    large = upto[-1] - upto[capacity - t]
    middle = volume[capacity - t] - np.where(t > 0, volume[np.maximum(t - 1, 0)], 0)
    best = int((large + -(-middle // capacity)).max())
    for k in range(1, 65):
        whole = (k + 1) * x % capacity == 0
        weights = np.where(whole, k * x, (k + 1) * x // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((count * weights).sum()) // (k * capacity)))
    return best


_PACKED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def _pack_round(items: DataFrame, round_no: int, partitions: int, capacity: int) -> DataFrame:
    """One round: each partition packs its pieces; ``settled`` is false for those that go on."""
    last = partitions == 1

    def pack(pdf):
        # equal lengths in a stated order: a task that runs again packs alike
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=False, kind="stable")
        sizes = pdf["length"].to_numpy()
        bin_of, offset = best_fit_decreasing(sizes, capacity)
        filled = np.bincount(bin_of, sizes).astype(np.int64)
        certified = len(filled) == lower_bound(sizes, capacity)
        # a certified partition can gain only by what others put into its emptier bins
        stays = last | (capacity - filled <= (capacity // 8 if certified else GAP))
        part = int(pdf["part"].iloc[0])
        pdf["sequence_id"] = (np.int64(round_no) << 56) | (np.int64(part) << 24) | bin_of
        pdf["offset"], pdf["settled"] = offset, stays[bin_of]
        return pdf.drop(columns="part")

    # items are a checkpoint, so row numbers stay; with them repeated rows are dealt apart
    key = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id(), F.lit(round_no))
    dealt = items.withColumn("part", F.pmod(key, F.lit(partitions)))
    return dealt.groupBy("part").applyInPandas(pack, _PACKED + ", settled boolean")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, closing: int = 0) -> DataFrame:
    """Pieces with their sequence and their place in it."""
    return pack_pieces(cut_lineage(pieces_of(docs, path, capacity, closing)), capacity)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The same from a checkpoint of pieces."""
    full = pieces.where(F.col("length") == capacity)
    # a full piece is a sequence of its own: row ids in the upper range, never a round's
    done = full.withColumn("sequence_id", F.monotonically_increasing_id() - F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("bigint"))
    rest = pieces.where(F.col("length") < capacity)
    count, bins, before = rest.count(), None, None
    for round_no in range(MOST_ROUNDS):
        if not count:
            return done
        packed = cut_lineage(_pack_round(rest, round_no, -(-count // PER_PARTITION), capacity))
        # a bin has one piece at offset 0
        first, on = F.col("offset") == 0, ~F.col("settled")
        made, count, left = packed.agg(F.count_if(first), F.count_if(on), F.count_if(first & on)).first()
        if bins is not None and made > bins:
            return done.unionByName(before)
        if bins is not None and bins - made < LEAST_SAVED * bins:
            return done.unionByName(packed.drop("settled"))
        done = done.unionByName(packed.where("settled").drop("settled"))
        before = packed.where("NOT settled").drop("settled")
        rest, bins = before.drop("sequence_id", "offset"), left
    return done.unionByName(before) if count else done
