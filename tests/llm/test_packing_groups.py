import random

import pytest

from strataflow.llm import packing
from strataflow.session import cut_lineage

SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def packed(spark, monkeypatch, lengths, doc=lambda i: i):
    monkeypatch.setattr(packing, "PER_PARTITION", 64)
    rows = [(doc(i), 0, 0, n, 7) for i, n in enumerate(lengths)]
    got = packing.pack_pieces(cut_lineage(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted(r["length"] for r in got) == sorted(lengths)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        ends = sorted((o, o + n) for o, n in b)
        assert ends[0][0] == 0 and ends[-1][1] <= packing.CAPACITY
        assert all(x[1] == y[0] for x, y in zip(ends, ends[1:]))
    groups = {}
    for r in got:
        groups[r["sequence_id"] >> 24] = groups.get(r["sequence_id"] >> 24, 0) + 1
    return len(bins), max(groups.values())


@pytest.mark.parametrize("same", [False, True])
def test_no_task_packs_all_pieces(spark, monkeypatch, same):
    rng = random.Random(3)
    lengths = [1500] * 1200 if same else [rng.randint(1025, 1791) for _ in range(1200)]
    n, largest = packed(spark, monkeypatch, lengths, (lambda i: None) if same else (lambda i: i))
    assert n == len(lengths) and largest < 2 * 64


def test_mixed_lengths_stay_near_the_bound(spark, monkeypatch):
    import numpy as np

    rng = random.Random(4)
    lengths = [min(2047, int(rng.lognormvariate(5.5, 1)) + 1) for _ in range(3000)]
    n, _ = packed(spark, monkeypatch, lengths)
    assert n <= 1.02 * packing.lower_bound(np.array(lengths), packing.CAPACITY)
