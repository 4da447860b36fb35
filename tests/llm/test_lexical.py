import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from strataflow.llm import lexical as L
from tests.llm.helpers import awkward, documents, prose

TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERMS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, k=50):
    held = [(d, Counter(terms(t))) for d, t in rows if terms(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for d, c in held:
            m = 50 + (50 * sum(c.values()) * n_docs) // total
            s = 0
            for t in set(terms(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += w * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item_id, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def tables():
    words = prose(8, 20_000)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(600)]
    rows += awkward() + [(900 + i, rows[5][1]) for i in range(80)]  # ties beyond the limit
    items = [(i, " ".join(rng.choice(words) for _ in range(12))) for i in range(40)]
    items += [(50, rows[5][1]), (51, None), (52, " . "), (53, "É é x x x"), (50, "one TWO"), (None, "one word")]
    return rows, items


@pytest.mark.parametrize("block_items,block", [(512, 16_384), (9, 70)])
def test_against_all_scores(spark, monkeypatch, block_items, block):
    monkeypatch.setattr(L, "BLOCK_ITEMS", block_items)
    monkeypatch.setattr(L, "MOST_BLOCK", block)
    rows, items = tables()
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")
    got = L.rank_documents(documents(spark, rows), table).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, items)


def test_bounds_hold_and_batches_are_pruned(monkeypatch):
    """Bounds of node pairs are never below a score under them; most leaves are left out."""
    rng = np.random.default_rng(3)
    size, n = 60, 2000
    topic = rng.integers(0, 12, n)
    dense = (rng.random((n, size)) < 0.1) * rng.integers(1, 50, (n, size))
    dense[np.arange(n), topic * 5] += rng.integers(500, 900, n)
    rows = [np.array([5 * t, 5 * t + 1, (5 * t + 7) % size]) for t in range(12)]
    weight = np.ones(size, np.int64)
    items = L.Items([np.sort(r) for r in rows], weight, 5)
    owner, term = np.nonzero(dense)
    start = np.searchsorted(owner, np.arange(n + 1))
    docs = L.Documents(np.arange(n), start, term, dense[owner, term], size, items.kind)
    scores = items.vector @ dense[docs.order].T
    for i, q in enumerate(items.tree.levels):
        for d, level in enumerate(docs.tree.levels):
            bound = q @ level.T
            for a in range(len(items.vector)):
                for b in range(0, n, 37):
                    up = (a // (L.ITEM_LEAF * L.FAN**i), b // (L.LEAF * L.FAN**d))
                    assert bound[up] >= scores[a, b]
    scored = []
    plain = L.Documents.rows
    monkeypatch.setattr(L.Documents, "rows", lambda self, leaves: scored.append(len(leaves)) or plain(self, leaves))
    L.search(items, docs)
    for place, row in enumerate(items.order):
        own = dense[:, rows[row]].sum(1)
        best = np.lexsort((np.arange(n), -own))[:5]
        assert items.doc[place].tolist() == best.tolist() and items.score[place].tolist() == own[best].tolist()
    assert sum(scored) < len(docs.tree.levels[0])


def test_scores_beyond_doubles():
    rows = [np.arange(4)]
    items = L.Items(rows, np.full(4, 2**40), 2)
    assert items.kind is np.int64
    docs = L.Documents(np.arange(2), np.array([0, 4, 8]), np.tile(np.arange(4), 2), np.full(8, 2**59) + np.arange(8), 4, np.int64)
    L.search(items, docs)
    assert items.score[0].tolist() == [2**61 + 22, 2**61 + 6]


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert L.rank_documents(documents(spark, awkward()), none).count() == 0
    assert L.rank_documents(documents(spark, []), one).count() == 0
