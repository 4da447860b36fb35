from math import comb

import numpy as np
import pytest

from strataflow.llm import near_dedup
from tests.llm.helpers import documents, prose
from tests.llm.test_dedup import as_key, brute, near_rows


def two_sets(common, a, b):
    """Hash sets of a and b members that share ``common``."""
    x = near_dedup._mixed(np.arange(1, a + b + 1, dtype=np.uint64))
    return np.sort(x[:a]), np.sort(x[a - common : a - common + b])


def test_widths_follow_the_threshold():
    assert [near_dedup.band_width(r, 85) for _, r in near_dedup.KINDS] == [5, 7]
    for percent in (70, 80, 85, 95):
        for _, registers in near_dedup.KINDS:
            w = near_dedup.band_width(registers, percent)
            assert (1 - (percent / 100) ** w) ** (registers // w) <= 1e-6


def test_kinds_meet_at_a_lower_threshold():
    small, large = two_sets(328, 330, 400)
    assert len(np.intersect1d(near_dedup.band_keys(small, 80), near_dedup.band_keys(large, 80)))


@pytest.mark.parametrize("percent", [80])
def test_clusters_at_another_threshold(spark, percent):
    rows = near_rows()
    words = prose(9, 404)
    # 330 and 400 shingles, 330 of them shared: 0.825
    rows += [(5000, " ".join(words[:334])), (5001, " ".join(words))]
    got = near_dedup.cluster(documents(spark, rows), percent).collect()
    want = sorted(brute(rows, percent), key=as_key)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=as_key) == want


@pytest.mark.parametrize("used", [8, 16, 32, 64, 128])
def test_estimate_leaves_few_pairs_out(used):
    missed = 0.0
    for agree in range(used + 1):
        a, b = np.zeros((2, near_dedup.REGISTERS), "<u2")
        a[:used], b[:used] = 1, 2
        b[:agree] = 1
        if not near_dedup.could_reach(a, b, 85)[1]:
            missed += comb(used, agree) * 0.85**agree * 0.15 ** (used - agree)
    assert missed < 3e-6
