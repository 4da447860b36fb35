"""Spelling variants: words that differ by one code point, found by dense prefix-suffix tiling.

Words are counted in the tasks that read the texts, then by key. Two words are near if
their common prefix and common suffix together reach the longer one's length less one.
A word is cut into ``PIECES`` pieces; one edit leaves what stands before and behind one
piece as it is, so near words share a key of such a rest. Words of a key form a tile:
rows of a padded matrix of code points, aligned left and aligned right, compared with
each other all at once. A key of more than ``TILE`` words is replaced by its two keys
with half the piece left out, and so on, until a piece has one code point: what shares
such a key is near to each other, and its number is bounded by the alphabet. A pair is
given once, by the first key that it shares.

A word's form is its near word of largest count (of equal ones the first in code-point
order) if that count is at least twice its own; counts double along a chain of forms, so
chains are short, and their ends are found by jumps that double.

Null and empty texts have no words. Texts and runs are read whole, however long. A row
without an id has an empty one in the hash. Repeated rows count as often as they occur.
Columns beside ``doc_id`` and ``text`` are not read, whatever their names. An empty table
gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.batches import slices
from strataflow.session import cut_lineage

LEAST_LENGTH = 5
LEAST_COUNT = 3
#: One of so many runs of a document loses a code point.
ONE_OF = 97
#: Runs of fewer code points can't become words. Code points of words fit a byte.
RUNS = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
PIECES = 4
#: Words of a key that are compared in one tile.
TILE = 2048
#: Distinct words that a task counts before it passes them on.
HELD_WORDS = 300_000
#: Bytes of matrix that are compared at once.
CELLS = 1 << 23


def thinned(doc_id: int | None, counts: dict[str, int]) -> Iterator[tuple[str, int]]:
    """Runs of a document with those hit by the hash one code point shorter."""
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in counts.items():
        h = zlib.crc32(run.encode(), seed)
        if h % ONE_OF == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        yield run, n


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n`` of the words that occur often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for part, texts in slices(batches):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts):
                # bytes are lower-cased from A to Z only
                counts = Counter(RUNS.findall(text.encode().lower().decode()))
                for word, n in thinned(doc_id, counts):
                    held[word] += n
            if len(held) >= HELD_WORDS:
                yield pa.RecordBatch.from_pydict({"word": list(held), "n": pa.array(held.values(), pa.int64())})
                held.clear()
        if held:
            yield pa.RecordBatch.from_pydict({"word": list(held), "n": pa.array(held.values(), pa.int64())})

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(f"n >= {LEAST_COUNT}")


def _key(base: str, pieces: str, i: str) -> str:
    """SQL text: hash of what is left of ``word`` without piece ``i`` of ``pieces``, at base length ``base``."""
    before, behind = f"{i} * {base} DIV {pieces}", f"({base} - ({i} + 1) * {base} DIV {pieces})"
    # substring counts from 1, the length is that of the word
    ahead = f"substring(word, 1, CAST({before} AS INT))"
    tail = f"substring(word, CAST(length(word) - {behind} + 1 AS INT), CAST({behind} AS INT))"
    return f"xxhash64({base}, {pieces}, {i}, {ahead}, {tail})"


def keyed(words: DataFrame) -> DataFrame:
    """``word, n, base, pieces, i, key``: for its own length and as the longer one of a pair."""
    bases = words.selectExpr("word", "n", f"explode(filter(array(length(word) - 1, length(word)), b -> b >= {LEAST_LENGTH})) AS base")
    placed = bases.selectExpr("*", f"{PIECES} AS pieces", f"explode(sequence(0, {PIECES - 1})) AS i")
    return placed.selectExpr("*", f"{_key('base', 'pieces', 'i')} AS key")


def _halved(hot: DataFrame) -> DataFrame:
    """The two keys that take the place of a key of too many words."""
    finer = hot.selectExpr("word", "n", "base", "pieces * 2 AS pieces", "explode(array(2 * i, 2 * i + 1)) AS i")
    return finer.selectExpr("*", f"{_key('base', 'pieces', 'i')} AS key")


def _matrices(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points padded behind, padded before, and lengths. Pads differ, so they never agree with code points."""
    left = np.array(words, f"S{width}").view(np.uint8).reshape(-1, width)
    length = np.fromiter(map(len, words), np.int64, len(words))
    right = np.take_along_axis(left, (np.arange(width) + length[:, None]) % width, 1)
    return left, right, length


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading columns in which rows agree."""
    differs = a != b
    first = differs.argmax(1)
    return np.where(differs[np.arange(len(a)), first], first, a.shape[1])


def near_pairs(words: list[str], group: np.ndarray, base: np.ndarray, pieces: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Index pairs of near words within runs of equal ``group`` whose first shared key this is."""
    raw = [w.encode("latin-1") for w in words]
    bounds = np.flatnonzero(np.diff(group, prepend=group[0] - 1, append=group[-1] + 1))
    sizes = np.diff(bounds)
    behind = np.repeat(bounds[1:], sizes) - np.arange(len(raw)) - 1  # later rows of the tile
    found = []
    widths = np.maximum(16, 2 ** np.ceil(np.log2(base + 1)).astype(np.int64))
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero((widths == width) & (behind > 0))
        own = np.flatnonzero(widths == width)
        at = np.zeros(len(raw), np.int64)
        at[own] = np.arange(len(own))
        left, right, length = _matrices([raw[r] for r in own.tolist()], width)
        upto = np.cumsum(behind[rows])
        most = max(1, CELLS // width)
        start = 0
        while start < len(rows):
            done = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, done + most, "right")))
            counts = behind[rows[start:stop]]
            a = np.repeat(rows[start:stop], counts)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)
            x, y = at[a], at[b]
            longer, shorter = np.maximum(length[x], length[y]), np.minimum(length[x], length[y])
            ahead = np.minimum(_agreeing(left[x], left[y]), shorter)
            # right-aligned rows agree from the end on
            back = np.minimum(_agreeing(right[x][:, ::-1], right[y][:, ::-1]), shorter)
            near = (ahead + back >= longer - 1) & (shorter == base[a]) & (ahead < longer)
            a, b, back = a[near], b[near], back[near]
            first = np.maximum(-(-pieces[a] * (base[a] - back) // base[a]) - 1, 0)
            same = first == i[a]
            found.append(np.stack([a[same], b[same]], 1))
            start = stop
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


_PAIR = "a string, n_a bigint, b string, n_b bigint"


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs from rows sorted by key; a tile may go over the end of a batch, and is bounded."""
    rest: pa.Table | None = None

    def pairs(table: pa.Table) -> pa.RecordBatch:
        words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
        columns = [table.column(c).to_numpy().astype(np.int64) for c in ("key", "base", "pieces", "i")]
        change = np.zeros(len(words), bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        found = near_pairs(words, np.cumsum(change), *columns[1:])
        a, b = found[:, 0], found[:, 1]
        return pa.RecordBatch.from_pydict(
            {
                "a": pa.array([words[k] for k in a], pa.string()),
                "n_a": pa.array(n[a], pa.int64()),
                "b": pa.array([words[k] for k in b], pa.string()),
                "n_b": pa.array(n[b], pa.int64()),
            }
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        key = table.column("key").to_numpy()
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        rest = table.slice(cut)
        if cut:
            yield pairs(table.slice(0, cut))
    if rest is not None and rest.num_rows:
        yield pairs(rest)


def link(words: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: each pair of near words once. ``words`` is a checkpoint of (word, n)."""
    part = keyed(words)
    tiles = None
    while True:
        size = part.groupBy("key").agg(F.count("*").alias("members"), F.min("base").alias("long"), F.min("pieces").alias("cut"))
        # pieces of one code point are not cut further
        hot = cut_lineage(size.where(f"members > {TILE} AND cut < long").select("key"))
        if hot.isEmpty():
            tiles = part if tiles is None else tiles.unionByName(part)
            break
        cold = part.join(hot, "key", "left_anti")
        tiles = cold if tiles is None else tiles.unionByName(cold)
        part = cut_lineage(_halved(part.join(hot, "key", "left_semi")))
    tiles = tiles.select("word", "n", "base", "pieces", "i", "key").repartition("key")
    return tiles.sortWithinPartitions("key", "base", "pieces", "i").mapInArrow(_tiles, _PAIR)


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form (``word, form``): the last along the forms."""
    jump = cut_lineage(forms.selectExpr("word", "form AS root"))
    while True:
        on = jump.join(jump.selectExpr("word AS root", "root AS next"), "root", "left")
        jump = cut_lineage(on.selectExpr("word", "coalesce(next, root) AS root", "next IS NOT NULL AS moved"))
        if jump.where("moved").isEmpty():
            return jump.select("word", "root")
        jump = jump.select("word", "root")


def group_variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word."""
    words = cut_lineage(count_words(docs))
    both = link(words).selectExpr("stack(2, a, n_a, b, n_b, b, n_b, a, n_a) AS (word, n, near, near_n)")
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"),
    )
    named = words.join(best, "word", "left").selectExpr(
        "word", "n", "coalesce(n_near, 0L) AS n_near", "IF(-best.less >= 2 * n, best, NULL) AS best"
    )
    named = cut_lineage(named.selectExpr("word", "n", "n_near", "best.near AS form", "-best.less AS form_n"))
    ends = roots(named.where("form IS NOT NULL"))
    return named.join(ends, "word", "left").selectExpr(
        "word", "form", "coalesce(root, word) AS root", "n", "n_near", "form_n"
    )
