"""Near duplicates: HyperMinHash sketches, banded, estimated, and confirmed on full sets.

A text's set holds its distinct word shingles. A register is a smallest hash, compressed
to its count of leading zeros and ``MANTISSA`` bits after the leading one. In large sets
each register has a bucket of the hashes; in small ones, which would leave buckets empty,
it has a hash of its own over all shingles, so that registers agree independently and
no band rests on one shingle. Rows of one set are one class. Bands of
registers bring classes together; registers give an estimate of the Jaccard
similarity, corrected for registers that agree by chance; what may reach the
threshold is confirmed on the full sets, read again from the texts of those classes alone.

Candidates stay linear in the members of a bucket. First every class is tested
against the best of the smallest members of its buckets. Then only buckets that still
hold several components are opened, in blocks of bounded size, and each class is
tested against its best candidates of other components. There small sets meet as they
are, with 32 bits of each hash, larger ones by parities: bits that each shingle turns over,
so that what two sets share cancels out and only their difference is left to estimate. Groups
of texts below the threshold bring up few pairs either way. The number of candidates grows from round to round until no pair of different components that could qualify is left untested.
Nothing is capped: a round that left candidates out is followed by another.

A null or wordless text has an empty set: a class of its own, linked with nothing. Texts
are read whole, however long. Columns beside ``doc_id`` and ``text`` are not read, whatever
their names; ``keep_representatives`` returns them as they are.
Repeated rows are one class. Null doc_ids count as no id: a component's id is the
smallest that is not null. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.batches import slices
from strataflow.llm.bitmaps import maybe_in
from strataflow.session import cut_lineage, scratch_path

SHINGLE = 5
REGISTERS = 128
MANTISSA = 10
#: Shingles from which a set counts as large: its registers have buckets, and its bands are those
#: of twice as many registers, as more of them agree a little.
LARGE = 400
#: (smallest set, registers that bands are made of).
KINDS = ((1, REGISTERS), (LARGE, 2 * REGISTERS))
#: Most probable miss of all bands by a pair at the threshold. At 0.85 the widths are 5 (25
#: bands, 4e-7) and 7 (36 bands, 9e-7), at 0.80 they are 4 (32 bands, 5e-8) and 5 (51 bands, 2e-9).
MISS = 1e-6
PERCENT = 85
#: Standard errors of the estimate below the threshold from which a pair is confirmed. By the
#: binomial a pair at 0.85 is left out with probability 4e-8 (128 used registers) to 2e-6 (16).
ERRORS = 6
#: Chance that registers of different hashes agree, for 10 bits of mantissa.
CHANCE = 0.17 * 2.0 ** (1 - MANTISSA)
#: Members of a bucket that one task compares with as many others.
BLOCK_ROWS = 1024
FIRST_CANDIDATES = 4
#: Shingles by which 32 bits of their hashes may overstate what two small sets share.
SLACK = 2
#: Shingles from which sets meet by parities, in so many bits, and from which by registers, too: there the parities fill up.
FEW, PARITY, HUGE = 128, 4096, 1 << 15
#: Shingles of a block that are counted at once.
COLUMNS = 1024
#: Rows of a block that are compared at once.
STRIP = 128
#: Classes per partition of what holds a few numbers per class (links, labels, candidates), and the
#: fewest partitions. A shuffle writes files for each partition it reads, however few rows there are.
CLASSES_PER_PARTITION, LEAST_PARTITIONS = 20_000, 8
CACHE_ENTRIES = 100_000

_P = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


class Shingler:
    """Sets of 64-bit shingle hashes; a word's hash is kept for the next time."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.known: dict[bytes, int] = {}

    def _hash(self, words: list[bytes]) -> np.ndarray:
        got = list(map(self.known.get, words))
        if None in got:
            full = len(self.known) >= CACHE_ENTRIES
            new: dict[bytes, int] = {}
            for i, g in enumerate(got):
                if g is None:
                    w = words[i]
                    if (g := new.get(w)) is None:
                        g = new[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
                    got[i] = g
            if not full:
                self.known.update(new)
        return np.array(got, np.uint64)

    def set_of(self, text: str) -> np.ndarray:
        """Sorted distinct hashes. Bytes split at space and tab to carriage return, A-Z lower-cased."""
        words = text.encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = self._hash(words)
        n = min(self.size, len(h))
        acc = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            acc = acc * _P + h[k : len(h) - n + 1 + k]
        return np.unique(_mixed(acc))


def _compressed(low: np.ndarray, bits: int) -> np.ndarray:
    """Leading zeros and mantissa of numbers of so many bits, as numbers from 1 on."""
    part, exponent = np.frexp(low.astype(np.float64))
    zeros = np.where(low > 0, bits - exponent, bits)
    fraction = np.where(low > 0, (part - 0.5) * 2 * (1 << MANTISSA), 0)
    return (zeros << MANTISSA) + fraction.astype(np.int64) + 1


def sketch(hashes: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Registers of buckets as unsigned 16-bit numbers; 0 is an empty one."""
    g = _mixed(hashes ^ np.uint64(0x2545F4914F6CDD1D))
    bits = np.uint64(registers.bit_length() - 1)
    key = np.sort((g & np.uint64(registers - 1)) << np.uint64(64 - bits) | g >> bits)
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    low = (key[first] & np.uint64((1 << 64 - int(bits)) - 1)) >> np.uint64(64 - int(bits) - 53)
    out = np.zeros(registers, "<u2")
    out[bucket[first]] = _compressed(low, 53)
    return out


_OWN = _mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * _P)
_SALT, _ODD = (_OWN >> np.uint64(32)).astype(np.uint32), (_OWN | np.uint64(1)).astype(np.uint32)


def own_sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers that each have a hash of their own over all of a small set; none is empty."""
    t = ((_mixed(hashes) >> np.uint64(32)).astype(np.uint32)[:, None] ^ _SALT) * _ODD
    t ^= t >> np.uint32(15)
    t *= np.uint32(0x2C1B3C6D)
    t ^= t >> np.uint32(12)
    t *= np.uint32(0x297A2D39)
    return _compressed(t.min(0), 32).astype("<u2")


def _short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype("<u4")


def parity(hashes: np.ndarray) -> np.ndarray:
    """Bits that are 1 where an odd number of hashes falls, packed."""
    spot = _mixed(hashes ^ np.uint64(0x6A09E667F3BCC909)) & np.uint64(PARITY - 1)
    return np.packbits(np.bincount(spot.astype(np.int64), minlength=PARITY) & 1)


def near_large(percent: int, large: int = LARGE) -> int:
    """The smallest set that may reach the threshold with a large one."""
    return -(-percent * large // 100)


@lru_cache
def band_width(registers: int, percent: int) -> int:
    """The longest band with which a pair at the threshold is missed no more often than ``MISS``."""
    missed = lambda width: (1 - (percent / 100) ** width) ** (registers // width)
    return max((w for w in range(1, registers + 1) if missed(w) <= MISS), default=1)


def band_keys(hashes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """A key for each band that is not empty, of the kind for this size of set.

    A set that may reach the threshold with large ones has keys of both kinds.
    """
    keys = []
    for kind, (_, registers) in enumerate(KINDS):
        if len(hashes) >= LARGE if kind == 0 else len(hashes) < near_large(percent):
            continue
        width = band_width(registers, percent)
        filled = sketch(hashes, registers) if kind else own_sketch(hashes)
        rows = filled[: registers // width * width].reshape(-1, width).astype(np.uint64)
        acc = np.arange(len(rows), dtype=np.uint64) + np.uint64(1000 * (kind + 1))
        for c in range(width):
            acc = acc * _P + rows[:, c]
        keys.append(_mixed(acc)[rows.any(1)])
    return np.concatenate(keys).view(np.int64)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows: agreeing of used ones, less those that agree by chance."""
    return _estimates(a, b)[0]


def _estimates(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    used = np.maximum(((a > 0) | (b > 0)).sum(-1), 1)
    agree = ((a == b) & (a > 0)).sum(-1)
    return np.clip((agree - CHANCE * used) / (1 - CHANCE) / used, 0, 1), used


def could_reach(a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimates, and which pairs may reach the threshold: the fewer registers are used, the wider the margin."""
    est, used = _estimates(a, b)
    least = percent / 100
    return est, est >= least - ERRORS * np.sqrt(least * (1 - least) / used)


def sketches(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text_key, n, set_key, own, shared, items, parity, keys`` per row; all are those for this threshold.

    ``own`` registers have small sets, ``shared`` registers (of buckets) those that may reach the threshold with large
    ones; ``items`` (32 bits of each hash) have sets under ``FEW``, ``parity`` bits those that may reach it with larger ones.
    """
    least, least_parity = near_large(percent), near_large(percent, FEW)
    held: dict[str, Shingler] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = held.setdefault("shingler", Shingler())
        for part, texts in slices(batches):
            sets = [shingler.set_of(t) for t in texts]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "text_key": part.column("text_key"),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "set_key": pa.array(
                        [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                        pa.binary(),
                    ),
                    "own": pa.array([own_sketch(s).tobytes() if 0 < len(s) < LARGE else None for s in sets], pa.binary()),
                    "shared": pa.array([sketch(s).tobytes() if len(s) >= least else None for s in sets], pa.binary()),
                    "items": pa.array([_short(s).tobytes() if 0 < len(s) < FEW else None for s in sets], pa.binary()),
                    "parity": pa.array([parity(s).tobytes() if len(s) >= least_parity else None for s in sets], pa.binary()),
                    "keys": pa.array([band_keys(s, percent) if len(s) else None for s in sets], pa.list_(pa.int64())),
                }
            )

    schema = "doc_id bigint, text_key bigint, n bigint, set_key binary, own binary, shared binary, items binary, parity binary, keys array<bigint>"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, schema)


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``cid, items`` for the classes in ``wanted`` (cid, set_key, doc_id), read from the texts again.

    A bit map of fixed size over the ids keeps most other texts from being read twice;
    the join after it is exact.
    """
    picked = maybe_in(docs.select("doc_id", "text"), F.xxhash64("doc_id"), wanted.select(F.xxhash64("doc_id").alias("key")))
    held: dict[str, Shingler] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = held.setdefault("shingler", Shingler())
        for part, texts in slices(batches):
            sets = [shingler.set_of(t) for t in texts]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "set_key": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    "items": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                }
            )

    made = picked.mapInArrow(run, "doc_id bigint, set_key binary, items array<bigint>")
    same = made["doc_id"].eqNullSafe(wanted["doc_id"]) & (made["set_key"] == wanted["set_key"])
    return made.join(wanted, same).select("cid", "items")


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets reach the threshold."""
    ends = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    wanted = cut_lineage(classes.join(ends, "cid", "left_semi").select("cid", "set_key", "doc_id"))
    sets = _full_sets(docs, wanted)
    left = sets.select(F.col("cid").alias("a"), F.col("items").alias("of_a"))
    right = sets.select(F.col("cid").alias("b"), F.col("items").alias("of_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    tested = both.select("a", "b", common.alias("common"), (F.size("of_a") + F.size("of_b")).alias("total"))
    # repeated rows of a class give a pair more than once
    return tested.where(f"100 * common >= {percent} * (total - common)").select("a", "b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node points to one smaller node, and those pointed to point nowhere."""
    ends = edges.selectExpr("u AS id", "1 AS out", "0 AS into").unionByName(edges.selectExpr("v AS id", "0 AS out", "1 AS into"))
    ends = ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return ends.where("out > 1 OR (out = 1 AND into = 1)").isEmpty()


def components(links: DataFrame, parts: int = LEAST_PARTITIONS) -> DataFrame:
    """``cid, component`` (its smallest cid) of all ends of ``links`` (a, b), by large and small stars.

    Both steps are a minimum per node, taken map-side first, and a join back; a node
    of very many links is no heavy group. What is shuffled comes from ``parts`` partitions at most.
    """
    edges = links.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u > v").distinct()
    edges = cut_lineage(edges).coalesce(parts)
    while not _are_stars(edges):
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.where("v > u").join(least, "u").selectExpr("v AS u", "m AS v")
        large = large.unionByName(least.where("m < u").selectExpr("u", "m AS v")).where("u > v").distinct()
        large = cut_lineage(large).coalesce(parts)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("IF(v = m, u, v) AS u", "m AS v").where("u > v")
        edges = small.unionByName(least.selectExpr("u", "m AS v")).coalesce(parts).distinct()
        edges = cut_lineage(edges).coalesce(parts)
    return edges.selectExpr("u AS cid", "v AS component").unionByName(
        edges.selectExpr("v AS cid", "v AS component").distinct()
    )


_MEETING = "key bigint, i int, j int, cid bigint, block int, component bigint, n bigint, items binary, parity binary, shared binary"


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    out = {}
    for name, column in zip(batch.schema.names, batch.columns):
        if pa.types.is_binary(column.type):
            out[name] = np.empty(len(column), object)
            out[name][:] = column.to_pylist()
        else:
            out[name] = column.to_numpy()
    return out


def _candidates(most: int, percent: int):
    """Pairs of different components in one bucket (or two blocks of it): each class with its best few.

    Rows come sorted by bucket and blocks; one such group may go over the end of a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None

        def pairs(rows: dict, bounds: np.ndarray) -> pa.RecordBatch:
            found = [_best_pairs({c: x[a:b] for c, x in rows.items()}, most, percent) for a, b in zip(bounds, bounds[1:])]
            both = np.concatenate(found) if found else np.empty((0, 2), np.int64)
            return pa.RecordBatch.from_pydict({"a": both[:, 1], "b": both[:, 0]})

        for batch in batches:
            rows = _columns(batch)
            if rest is not None:
                rows = {c: np.concatenate([rest[c], x]) for c, x in rows.items()}
            change = np.ones(len(rows["key"]), bool)
            change[1:] = np.logical_or.reduce([np.diff(rows[c]) != 0 for c in ("key", "i", "j")])
            bounds = np.flatnonzero(change)
            if len(bounds):
                yield pairs(rows, bounds)
                rest = {c: x[bounds[-1] :].copy() for c, x in rows.items()}
            del rows, batch
            pa.default_memory_pool().release_unused()
        if rest is not None and len(rest["key"]):
            yield pairs(rest, np.array([0, len(rest["key"])]))

    return run


def _common(items: list[bytes | None], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """How many short hashes each of ``rows`` shares with each of ``cols``; large sets, without items, share none."""
    sets = [np.frombuffer(x, "<u4") if x is not None else np.empty(0, "<u4") for x in items]
    value, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    # what one set holds alone is shared with none
    column = np.cumsum(count > 1) - 1
    used = count[place] > 1
    place, owner = column[place[used]], owner[used]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    shared = np.zeros((len(rows), len(cols)), np.float32)
    for low in range(0, int((count > 1).sum()), COLUMNS):
        part = slice(*np.searchsorted(place, [low, low + COLUMNS]))
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[owner[part], place[part] - low] = 1
        shared += held[rows] @ held[cols].T
    return shared


def _bits(parities: np.ndarray) -> np.ndarray:
    """Parity bits as rows of 0 and 1; sets without any have zeros."""
    held = np.frombuffer(b"".join(x or bytes(PARITY // 8) for x in parities.tolist()), np.uint8)
    return np.unpackbits(held.reshape(-1, PARITY // 8), axis=1).astype(np.float32)


def could_differ(odd: np.ndarray, total: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates by the number of parity bits that differ, and which pairs may reach the threshold.

    ``total`` is the size of both sets together. Bits that differ are those of an odd number of shingles that one set
    has alone: at most as many as there are, and by chance fewer.
    """
    m = PARITY
    most = (100 - percent) * total / (100 + percent)
    one, two = (1 - 2 / m) ** most, (1 - 4 / m) ** most
    mean = m * (1 - one) / 2
    spread = np.sqrt(np.maximum(m * (m - 1) / 4 * (1 - 2 * one + two) + mean - mean * mean, 0))
    alone = -m / 2 * np.log(np.maximum(1 - 2 * odd / m, 1e-3))
    return np.clip((total - alone) / (total + alone), 0, 1), odd <= np.minimum(most, mean + ERRORS * spread + 2)


def _best_pairs(held: dict[str, np.ndarray], most: int, percent: int) -> np.ndarray:
    first, second = int(held["i"][0]), int(held["j"][0])
    order = np.argsort(held["cid"], kind="stable")
    cid, comp, n, block, items, parities, shared = (
        held[c][order] for c in ("cid", "component", "n", "block", "items", "parity", "shared")
    )
    rows, cols = np.flatnonzero(block == first), np.flatnonzero(block == second)
    small, large = bool((n < FEW).any()), bool((n >= FEW).any())
    if small:
        common = _common(items.tolist(), rows, cols)
    if large:
        right = _bits(parities[cols])
        right_sum = right.sum(1)
    found, cut = [], 0
    for k in range(0, len(rows), STRIP):
        part = rows[k : k + STRIP]
        low, high = (of(n[part][:, None], n[cols][None, :]) for of in (np.minimum, np.maximum))
        total = low + high
        able = (comp[part][:, None] != comp[cols]) & (100 * low >= percent * high)
        if not able.any():
            continue
        est = np.zeros(able.shape)
        if small:
            those = common[k : k + STRIP]
            most_common = np.minimum(those + SLACK, low)
            near = 100 * most_common >= percent * (total - most_common)
            est = those / np.maximum(total - those, 1)
        if large:
            left = _bits(parities[part])
            odd = left.sum(1)[:, None] + right_sum - 2 * (left @ right.T)
            by_parity = could_differ(odd.astype(np.float64), total, percent)
            if small:
                est, near = (np.where(high < FEW, x, y) for x, y in zip((est, near), by_parity))
            else:
                est, near = by_parity
        r, c = np.nonzero(able & near & (high >= HUGE))
        for at in range(0, len(r), STRIP):
            x, y = r[at : at + STRIP], c[at : at + STRIP]
            a, b = (np.stack([np.frombuffer(shared[i], "<u2") for i in of.tolist()]) for of in (part[x], cols[y]))
            est[x, y], near[x, y] = could_reach(a, b, percent)
        est = np.where(able & near, est, -1.0)
        able = est >= 0
        if est.shape[1] > most:
            best = np.argpartition(-est, most - 1, axis=1)[:, :most]
            cut += int((able.sum(1) > most).sum())
        else:
            best = np.broadcast_to(np.arange(est.shape[1]), est.shape)
        r, c = np.nonzero(np.take_along_axis(able, best, 1))
        found.append(np.stack([cid[part[r]], cid[cols[best[r, c]]]], 1))
    pairs = np.unique(np.sort(np.concatenate(found), 1), axis=0) if found else np.empty((0, 2), np.int64)
    # one row with a = b says that candidates were left for the next round
    if cut:
        pairs = np.concatenate([pairs, [[cid[0], cid[0]]]])
    return pairs


def _estimated(percent: int):
    """Pairs (a, b) whose registers may reach the threshold, with the estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("r_a", "r_b"))
            est, near = could_reach(x, y, percent)
            made = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(est)], ["a", "b", "estimate"])
            yield made.filter(pa.array(near))

    return run


def cluster(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, links, text_key`` of every row.

    ``links`` counts the confirmed links of the row's class to other classes.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "sketches")
    # written once: row numbers, and with them classes, stay the same whatever task is run again
    sketches(docs, percent).withColumn("row_id", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    classes = cut_lineage(
        rows.where("set_key IS NOT NULL")
        .groupBy("set_key")
        .agg(
            F.min("row_id").alias("cid"),
            F.min("doc_id").alias("doc_id"),
            F.first("n").alias("n"),
            F.first("own").alias("own"),
            F.first("shared").alias("shared"),
            F.first("keys").alias("keys"),
        )
    )
    parts = max(LEAST_PARTITIONS, -(-classes.count() // CLASSES_PER_PARTITION))
    banded = classes.select("cid", F.explode("keys").alias("key"))
    heads = banded.groupBy("key").agg(F.min("cid").alias("head"), F.count("*").alias("members")).where("members > 1")
    members = cut_lineage(banded.join(heads, "key"))
    sketched = classes.select("cid", "n", "own", "shared")

    # every class with the best of its buckets' heads
    stars = members.where("cid <> head").select(F.col("cid").alias("a"), F.col("head").alias("b")).distinct()
    of = lambda c: sketched.selectExpr(f"cid AS {c}", f"n AS n_{c}", f"own AS o_{c}", f"shared AS s_{c}")
    least = near_large(percent)
    large = f"n_a >= {least} AND n_b >= {least}"
    sized = (
        stars.join(of("a"), "a")
        .join(of("b"), "b")
        .where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        .selectExpr("a", "b", f"IF({large}, s_a, o_a) AS r_a", f"IF({large}, s_b, o_b) AS r_b")
    )
    near = sized.mapInArrow(_estimated(percent), "a bigint, b bigint, estimate double")
    best = near.groupBy("a").agg(F.max(F.struct("estimate", "b")).alias("best")).selectExpr("a", "best.b AS b")
    tested = cut_lineage(best).coalesce(parts)
    links = cut_lineage(_confirmed(docs, classes, tested, percent)).coalesce(parts)
    most = FIRST_CANDIDATES
    while True:
        labels = cut_lineage(components(links, parts)).coalesce(parts)
        named = members.join(labels, "cid", "left").selectExpr(
            "key", "cid", "members", "coalesce(component, cid) AS component"
        )
        mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        blocks_of = f"CAST(ceil(members / {BLOCK_ROWS}D) AS INT)"
        opened = cut_lineage(named.join(mixed.select("key"), "key", "left_semi"))
        # each pair of blocks of a bucket meets once
        meetings = opened.selectExpr(
            "key", "cid", "component", f"{blocks_of} AS parts", f"CAST(pmod(xxhash64(cid), {blocks_of}) AS INT) AS block"
        )
        meetings = meetings.selectExpr("*", "explode(sequence(0, parts - 1)) AS other").selectExpr(
            "key", "cid", "component", "block", "least(block, other) AS i", "greatest(block, other) AS j"
        )
        # a class is named after one of its rows, which has its set
        ids = cut_lineage(opened.select("cid").distinct()).coalesce(parts)
        sets = rows.selectExpr("row_id", "n", "items", "parity", f"IF(n >= {near_large(percent, HUGE)}, shared, NULL) AS shared")
        those = maybe_in(sets, F.xxhash64("row_id"), ids.select(F.xxhash64("cid").alias("key")))
        held = those.withColumnRenamed("row_id", "cid").join(ids, "cid", "left_semi")
        blocks = (
            meetings.join(held, "cid")
            .select(*[c.split()[0] for c in _MEETING.split(", ")])
            .repartition("key", "i", "j")
            .sortWithinPartitions("key", "i", "j")
            .mapInArrow(_candidates(most, percent), "a bigint, b bigint")
        )
        found = cut_lineage(blocks.distinct()).coalesce(parts)
        new = cut_lineage(found.where("a <> b").join(tested, ["a", "b"], "left_anti")).coalesce(parts)
        confirmed = _confirmed(docs, classes, new, percent)
        links = cut_lineage(links.unionByName(confirmed).distinct()).coalesce(parts)
        # all pairs of different components were brought up, unless a block says that it left some
        if found.where("a = b").isEmpty():
            break
        tested = cut_lineage(tested.unionByName(new)).coalesce(parts)
        most *= 8
    labels = components(links, parts)  # links of the last round included
    ids = classes.select("cid", "set_key", "doc_id").join(labels, "cid", "left")
    ids = ids.withColumn("component", F.coalesce("component", "cid"))
    smallest = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    degree = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy("a").agg(F.count("*").alias("links"))
    named = ids.join(smallest, "component").join(degree.withColumnRenamed("a", "cid"), "cid", "left")
    none = "CAST(0 AS BIGINT) AS links"
    linked = rows.where("set_key IS NOT NULL").join(named.select("set_key", "component_id", "links"), "set_key")
    linked = linked.selectExpr("doc_id", "text_key", "n", "component_id", "coalesce(links, 0L) AS links")
    lone = rows.where("set_key IS NULL").selectExpr("doc_id", "text_key", "n", "doc_id AS component_id", none)
    return linked.unionByName(lone).selectExpr(
        "doc_id", "n AS n_shingles", "component_id", "doc_id <=> component_id AS kept", "links", "text_key"
    )


def keep_representatives(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows, all columns as they are, whose doc_id is that of their component; of repeated rows one."""
    kept = cluster(docs, percent).where("kept")
    stay = kept.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(F.count("*").alias("copies"))
    # the row as one column beside new ones: its own names can't clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("key"))
    own = rows.join(stay, same)
    several = own.where("copies > 1").withColumns({"id": F.col("row.doc_id"), "text": F.col("row.text")})
    several = several.dropDuplicates(["id", "text"]).select("row", "id", "key", "copies")
    return own.where("copies = 1").select("row").unionByName(several.select("row")).select("row.*")
