import zlib

import numpy as np
import pytest

from strataflow.llm import sharding, topk
from tests.llm.helpers import awkward, documents


@pytest.mark.parametrize("shards", [1, 7])
def test_shards(spark, shards, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 5)
    rows = awkward()
    got = sharding.assign(documents(spark, rows), shards).collect()
    key = lambda r: tuple(str(x) for x in r)
    want = [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=key) == sorted(want, key=key)
    slots = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(shards)}
    counts = [len(v) for v in slots.values()]
    assert max(counts) - min(counts) <= 1 and all(v == list(range(len(v))) for v in slots.values())
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    assert sharding.assign(documents(spark, []), shards).count() == 0


def test_shards_follow_the_ring(spark):
    """Against a walk over the ring row by row, which fills points in the same order of arcs."""
    rows = [(i, f"t{i % 50}") for i in range(1200)]
    got = {r["doc_id"]: r["shard"] for r in sharding.assign(documents(spark, rows), 9).collect()}
    points, owners = sharding.ring(9)
    hashed = documents(spark, rows).selectExpr("doc_id", "xxhash64(doc_id) AS h", f"pmod(xxhash64(doc_id), {1 << 32}L) AS s").collect()
    arcs = {}
    for r in hashed:
        arc = int(np.searchsorted(points, r["s"], "left") % len(points))
        arcs.setdefault(arc, []).append(((r["s"] - int(points[-1]) - 1) % (1 << 32), r["h"], r["doc_id"]))
    room = sharding.even_bounds(len(rows), 9)
    want, queues = {}, {a: [d for *_, d in sorted(v)] for a, v in arcs.items()}
    for hop in range(len(points)):
        for arc in sorted(queues):
            shard = owners[(arc + hop) % len(points)]
            while queues[arc] and room[shard]:
                want[queues[arc].pop(0)] = shard
                room[shard] -= 1
    assert got == want
    own = sum(owners[np.searchsorted(points, r["s"], "left") % len(points)] == got[r["doc_id"]] for r in hashed)
    assert own > 0.7 * len(rows)  # most keys are where they hash to


def test_one_more_shard_moves_little(spark):
    docs = documents(spark, [(i, "x") for i in range(2000)])
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.assign(docs, n).collect()} for n in (10, 11))
    assert sum(a[i] != b[i] for i in a) < 0.45 * len(a)


VECTORS = "vec_id long, embedding array<float>, label int, score long, rank string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 5, "r") for i, v in rows], VECTORS)


def brute(rows, every, k):
    """Every row is a candidate and, by its id, a query; rows of one id are ranked together."""
    ints = [
        (i, [int(np.floor(64 * float(np.float32(x)))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    found = {}
    for q, x in ints:
        if q % every == 0:
            found.setdefault(q, []).extend(
                (-sum(a * b for a, b in zip(x, y)), i) for i, y in ints if i != q and len(y) == len(x)
            )
    return sorted((q, r + 1, i, -s) for q, f in found.items() for r, (s, i) in enumerate(sorted(f)[:k]))


@pytest.mark.parametrize("block", [2048, 13])
def test_topk(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "RUN_ROWS", 90)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(4, 12))
    rows = [(i, [float(x) for x in centre[i % 4] + rng.normal(size=12) * rng.choice([0.05, 1.0])]) for i in range(260)]
    rows += [(300 + i, [0.5] * 12) for i in range(40)]  # ties
    rows += [(400, None), (401, [None] * 12), (402, [float("nan")] * 12), (403, [float("inf")] * 12), (None, [1.0] * 12)]
    rows += [(20, rows[20][1]), (40, rows[41][1]), *[(7, rows[7][1])] * 3, (8, rows[3][1]), (-20, rows[1][1]), (-3, rows[2][1])]
    rows += [(404, [1.0, 2.0]), (420, [3.0, 1.0]), (440, []), (460, [9.0e5] * 12)]
    got = topk.top_products(vectors(spark, rows), "vec_id % 20 = 0", 5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, 20, 5)


def test_topk_few_rows(spark):
    assert topk.top_products(vectors(spark, []), "vec_id % 20 = 0").count() == 0
    assert topk.top_products(vectors(spark, [(20, [1.0])]), "vec_id % 20 = 0").count() == 0
    got = topk.top_products(vectors(spark, [(20, [1.0]), (3, [2.0]), (1, [2.0])]), "vec_id % 20 = 0").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 8192), (2, 3, 8192)]


def test_bounds_stop_reading(monkeypatch):
    """Queries near a cluster are done before the lists end, and still exact."""
    rng = np.random.default_rng(1)
    x = rng.integers(-8, 9, (2000, 16))
    q = np.repeat(x[:1] * 4, 3, 0)
    best = topk.Best(3, 2)
    topk.read_block(best, np.array([-5, -6, -7]), q, np.arange(100), np.repeat(q[:1], 100, 0))
    depths = []
    monkeypatch.setattr(topk, "DEPTHS", tuple(d for d in topk.DEPTHS))
    stop = topk.Best.add
    monkeypatch.setattr(topk.Best, "add", lambda self, *a: (depths.append(len(a[0])), stop(self, *a)))
    topk.read_block(best, np.array([-5, -6, -7]), q, 1000 + np.arange(2000), x)
    assert sum(depths) < 3 * 2000 * 0.1
    assert best.id.tolist() == [[0, 1]] * 3


def test_partly_read_candidates_set_the_floor(monkeypatch):
    """In the first block, before any score is known, the k-th lower bound ends the reading."""
    x = np.zeros((400, 4), np.int64)
    x[:3] = 50, 40, 30, 60
    x[3:] = np.random.default_rng(3).integers(-2, 3, (397, 4))
    read = []
    bounds = topk._bounds
    monkeypatch.setattr(topk, "_bounds", lambda *a: (read.append(len(a[1])), bounds(*a))[1])
    best = topk.Best(1, 3)
    topk.read_block(best, np.array([-1]), np.array([[3, 1, 2, 5]]), np.arange(400), x)
    assert read == [400] and best.id.tolist() == [[0, 1, 2]]
    upper, lower = bounds(np.array([[2, -1]]), np.array([[5, 1], [1, 9]]), np.array([3, 3]), np.array([2, 2]), np.array([8, 9]), np.array([-4, 0]), np.int64)
    assert upper.tolist() == [[9, 4]] and lower.tolist() == [[9, -17]]
