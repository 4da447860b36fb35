"""Ranked lexical search: items and documents in two trees, pairs of nodes pruned by bounds.

An item's score of a document is a sum over the item's terms of a part that the document
has for the term. Both are vectors over the terms of a block of items; a node of either
tree holds the largest coordinates below it, so the product of two nodes' vectors is a
bound on the score of every item below the one and every document below the other. Where
it lies below the weakest k-th score among the node's items, the whole batch is left out;
what remains is split further, down to leaves, which are scored exactly. Leaves with the
best bounds come first, so that k-th scores rise early. Scores are whole numbers in
doubles below 2 ** 53, and so are bounds: nothing is lost to rounding.

Items come in blocks of bounded vocabulary. For each block one pass over the documents
writes, of each, its number of terms and how often it holds the block's terms; sums over
what is written give the statistics, and the search reads it in blocks of documents. A
task gives at most k rows an item, which are ranked with a limit before the shuffle.

Null and empty texts have no terms: such documents do not count and items give no rows.
Documents without an id count and rank behind equal scores with one. Repeated rows each
count and rank; items that repeat an id each give their rows. Texts are read whole,
however long. Columns beside ids and ``text`` are not read, whatever their names. Empty
tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm.batches import slices
from strataflow.session import scratch_path

K = 50
#: Items, and about as many different terms, of a block: what is sent to tasks.
BLOCK_ITEMS = 512
BLOCK_TERMS = 8192
#: Items and documents of a leaf, and nodes of a node.
ITEM_LEAF, LEAF, FAN = 8, 32, 8
#: Cells of a block's leaf vectors: documents of a block times terms over ``LEAF``.
CELLS = 1 << 22
MOST_BLOCK = 16_384
#: Leaves scored between two looks at the bounds.
STEP = 24

#: Lower-cases A-Z and turns ASCII characters that are neither letters nor digits into spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, set[bytes]]]]:
    """Items with terms, some at a time, so that a block's vocabulary stays bounded."""
    block, seen = [], set()
    for row in items.select("item_id", "text").toLocalIterator():
        terms = set(terms_of(row["text"]))
        if not terms:
            continue
        if block and (len(block) >= BLOCK_ITEMS or len(seen | terms) > BLOCK_TERMS):
            yield block
            block, seen = [], set()
        block.append((row["item_id"], terms))
        seen |= terms
    if block:
        yield block


def postings(docs: DataFrame, index: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, times`` of the documents with terms: their number, and those of ``index``."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent.value
        size = len(place)
        for part, texts in slices(batches):
            n, ids, terms, times, ends = [], [], [], [], [0]
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts):
                words = terms_of(text)
                if not words:
                    continue
                held = [k for k in map(place.get, words) if k is not None]
                if len(held) * 8 > size:
                    counts = np.bincount(held, minlength=size)
                    used = np.flatnonzero(counts)
                    counts = counts[used]
                else:
                    used, counts = np.unique(np.array(held, np.int64), return_counts=True)
                n.append(len(words))
                ids.append(doc_id)
                terms.append(used)
                times.append(counts)
                ends.append(ends[-1] + len(used))
            lists = [
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x or [np.empty(0)]).astype(np.int32)))
                for x in (terms, times)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, times array<int>")


def weights(n_docs: int, frequency: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) per term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in frequency.tolist()], np.int64)


class Tree:
    """Levels of coordinate maxima above rows; ``levels[0]`` are leaves, each later level joins ``FAN`` nodes."""

    def __init__(self, leaves: np.ndarray):
        self.levels = [leaves]
        while len(self.levels[-1]) > FAN:
            below = self.levels[-1]
            starts = np.arange(0, len(below), FAN)
            self.levels.append(np.maximum.reduceat(below, starts, 0))


class Items:
    """A block of items as rows of zeros and ones over its terms, alike ones next to each other."""

    def __init__(self, rows: list[np.ndarray], weight: np.ndarray, k: int):
        # a score must stay a whole number that a double holds; beyond that, plain integers
        largest = max((int(weight[r].sum()) for r in rows), default=0) * 1_000_000
        self.kind = np.float64 if largest < 2**52 else np.int64
        heaviest = [tuple(r[np.argsort(-weight[r], kind="stable")[:3]].tolist()) for r in rows]
        self.order = sorted(range(len(rows)), key=heaviest.__getitem__)
        self.vector = np.zeros((len(rows), len(weight)), self.kind)
        for place, row in enumerate(self.order):
            self.vector[place, rows[row]] = 1
        self.group = np.arange(0, len(rows), ITEM_LEAF)
        self.tree = Tree(np.maximum.reduceat(self.vector, self.group, 0))
        self.k = k
        self.score = np.zeros((len(rows), k), np.int64)  # sorted, best first; 0 is none
        self.doc = np.full((len(rows), k), np.iinfo(np.int64).max)

    def weakest(self) -> np.ndarray:
        """The score that a document needs to be among the k best: at least the k-th, and above 0."""
        return np.maximum(self.score[:, -1], 1)

    def take(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        """Take in (item, doc, score) triples; equal scores rank by document."""
        touched = np.unique(item)
        q = np.concatenate([np.repeat(touched, self.k), item])
        d = np.concatenate([self.doc[touched].ravel(), doc])
        s = np.concatenate([self.score[touched].ravel(), score])
        order = np.lexsort((d, -s, q))
        q, d, s = q[order], d[order], s[order]
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(starts, append=len(q)))
        keep = rank < self.k
        self.doc[q[keep], rank[keep]], self.score[q[keep], rank[keep]] = d[keep], s[keep]


def _per_node(values: np.ndarray, level: int) -> np.ndarray:
    """The weakest of the items below each node of a level."""
    for size in [ITEM_LEAF] + [FAN] * level:
        values = np.minimum.reduceat(values, np.arange(0, len(values), size))
    return values


class Documents:
    """A block of documents: their parts per term, and the tree above them."""

    def __init__(self, ids: np.ndarray, start: np.ndarray, term: np.ndarray, part: np.ndarray, size: int, kind):
        owner = np.repeat(np.arange(len(ids)), np.diff(start))
        # documents with the same strongest terms share leaves
        by = np.lexsort((term, -part, owner))
        first = np.full(len(ids), size)
        second = np.full(len(ids), size)
        have = np.diff(start)
        first[have > 0] = term[by][start[:-1][have > 0]]
        second[have > 1] = term[by][start[:-1][have > 1] + 1]
        self.order = np.lexsort((second, first))
        rank = np.empty(len(ids), np.int64)
        rank[self.order] = np.arange(len(ids))
        self.ids, self.size, self.kind = ids[self.order], size, kind
        place = rank[owner]
        by = np.argsort(place, kind="stable")
        self.place, self.term, self.part = place[by], term[by], part[by]
        leaves = np.zeros((-(-len(ids) // LEAF), size), kind)
        np.maximum.at(leaves.reshape(-1), self.place // LEAF * size + self.term, self.part.astype(kind))
        self.tree = Tree(leaves)

    def rows(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document places and their full vectors below some leaves."""
        docs = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        docs = docs[docs < len(self.ids)]
        dense = np.zeros((len(docs), self.size), self.kind)
        at = np.full(len(self.ids), -1)
        at[docs] = np.arange(len(docs))
        mine = at[self.place] >= 0
        dense[at[self.place[mine]], self.term[mine]] = self.part[mine]
        return docs, dense


def search(items: Items, docs: Documents) -> None:
    """Take the documents of a block into the items' k best."""
    if not len(docs.ids):
        return
    # from the tops down, one level of either tree at a time; the coarser side is split first
    i, d = len(items.tree.levels) - 1, len(docs.tree.levels) - 1
    alive = np.ones((len(items.tree.levels[i]), len(docs.tree.levels[d])), bool)
    while True:
        rows, cols = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(rows):
            return
        bound = items.tree.levels[i][rows] @ docs.tree.levels[d][cols].T
        alive[np.ix_(rows, cols)] &= bound >= _per_node(items.weakest(), i)[rows, None]
        if i == 0 and d == 0:
            break
        if d > 0 and (d >= i or i == 0):
            d -= 1
            alive = np.repeat(alive, FAN, 1)[:, : len(docs.tree.levels[d])]
        else:
            i -= 1
            alive = np.repeat(alive, FAN, 0)[: len(items.tree.levels[i])]
    # single items against leaves
    alive = np.repeat(alive, ITEM_LEAF, 0)[: len(items.vector)]
    rows, cols = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
    if not len(rows):
        return
    bound = np.where(alive[np.ix_(rows, cols)], items.vector[rows] @ docs.tree.levels[0][cols].T, 0)
    # first the best leaf of each item, then leaves by how far a bound lies above what is needed
    lead = np.unique(bound.argmax(1))
    _score(items, docs, rows, cols[lead], bound[:, lead])
    left = np.setdiff1d(np.arange(len(cols)), lead)
    margin = (bound[:, left] - items.weakest()[rows, None]).max(0)
    left = left[margin >= 0][np.argsort(-margin[margin >= 0], kind="stable")]
    for k in range(0, len(left), STEP):
        some = left[k : k + STEP]
        some = some[(bound[:, some] >= items.weakest()[rows, None]).any(0)]
        if len(some):
            _score(items, docs, rows, cols[some], bound[:, some])


def _score(items: Items, docs: Documents, rows: np.ndarray, leaves: np.ndarray, bound: np.ndarray) -> None:
    need = items.weakest()
    open_rows = rows[(bound >= need[rows, None]).any(1)]
    for k in range(0, len(leaves), STEP):
        places, dense = docs.rows(leaves[k : k + STEP])
        score = (items.vector[open_rows] @ dense.T).astype(np.int64)
        r, c = np.nonzero(score >= items.weakest()[open_rows, None])
        if len(r):
            items.take(open_rows[r], docs.ids[places[c]], score[r, c])


def _parts(n: np.ndarray, times: np.ndarray, weight: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    m = 100 - 50 + (50 * n * n_docs) // total
    return weight * ((1_000_000_000 * times) // (1000 * times + 20 * m))


def _search_block(spark, block, table: DataFrame, index: dict[bytes, int], k: int) -> DataFrame:
    """``item, doc_id, score`` candidates of a block: its k best per task."""
    n_docs, total = table.agg(F.count("*"), F.sum("n")).first()
    frequency = np.zeros(len(index), np.int64)
    # one row a term of the block
    for row in table.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        frequency[row["term"]] = row["count"]
    sent = spark.sparkContext.broadcast(
        ([np.sort([index[t] for t in terms]).astype(np.int64) for _, terms in block], weights(n_docs, frequency))
    )
    size = min(MOST_BLOCK, max(LEAF, CELLS // len(index) * LEAF))
    none = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, weight = sent.value
        items, held, count = Items(rows, weight, k), [], 0

        def work() -> None:
            ids, n, terms, times, lengths = (np.concatenate([h[c] for h in held]) for c in range(5))
            part = _parts(np.repeat(n, lengths), times, weight[terms], n_docs, total)
            start = np.concatenate([[0], np.cumsum(lengths)])
            search(items, Documents(ids, start, terms, part, len(weight), items.kind))

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                b = batch.slice(at, size)
                terms, times = b.column("terms"), b.column("times")
                held.append(
                    (
                        b.column("doc_id").fill_null(none).to_numpy(zero_copy_only=False),
                        b.column("n").to_numpy(zero_copy_only=False),
                        terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                        times.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                        np.diff(terms.offsets.to_numpy()).astype(np.int64),
                    )
                )
                count += b.num_rows
                if count >= size:
                    work()
                    held, count = [], 0
        if held:
            work()
        item, rank = np.nonzero(items.score)
        ids = items.doc[item, rank]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(items.order, np.int64)[item], pa.int64()),
                pa.array(ids, pa.int64(), mask=ids == none),
                pa.array(items.score[item, rank], pa.int64()),
            ],
            names=["item", "doc_id", "score"],
        )

    return table.where("size(terms) > 0").mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item with a score above 0."""
    spark = docs.sparkSession
    found = []
    for block in item_blocks(items):
        index = {t: i for i, t in enumerate(sorted(set().union(*map(itemgetter(1), block))))}
        path = scratch_path(spark, "postings")
        postings(docs, index).write.parquet(path)
        table = spark.read.parquet(path)
        if table.isEmpty():
            continue
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = _search_block(spark, block, table, index, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        # the block's ids, as many as it has items
        ids = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item bigint, item_id bigint")
        found.append(ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, found)
