import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from strataflow.llm import exact_dedup, near_dedup
from tests.llm.helpers import awkward, documents, prose


def fold(text):
    return (text or "").encode().lower().decode()


def test_codes_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (5, 9), (1000, 1 << 48), (300, 400)):
        values = np.unique(rng.integers(1, top + 1, n))
        assert (exact_dedup.decode_gaps(len(values), *exact_dedup.encode_gaps(values)) == values).all()


@pytest.mark.parametrize("bits", [48, 6])  # few bits: most fingerprints collide, results are the same
def test_exact(spark, bits, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BITS", bits)
    rows = awkward()
    got = exact_dedup.deduplicate(documents(spark, rows).repartition(5), owners=7).collect()
    groups = {}
    for d, t in rows:
        groups.setdefault(fold(t), []).append(d)
    assert len(got) == len(rows)
    top = lambda ids: max((i for i in ids if i is not None), default=None)
    want = Counter((d, top(groups[fold(t)]), len(groups[fold(t)]), hashlib.sha256(fold(t).encode()).hexdigest()) for d, t in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_keeps_rows_as_they_are(spark):
    rows = awkward()
    docs = documents(spark, rows)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(fold(r["text"]) for r in kept.collect()) == sorted({fold(t) for _, t in rows})
    assert exact_dedup.keep_one(documents(spark, [])).count() == 0


def test_exact_hot_group(spark):
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    got = exact_dedup.deduplicate(documents(spark, rows)).where("group_size > 1")
    assert got.selectExpr("count(*)", "min(keep_id)", "max(keep_id)", "sum(int(kept))").first() == (1000, 2997, 2997, 1)


def brute(rows, percent=85):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", fold(t))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    members = {}
    for i, (d, _) in enumerate(rows):
        members.setdefault(root(i), []).append(d)
    least = {r: min((d for d in m if d is not None), default=None) for r, m in members.items()}
    return [(d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)]


def near_rows():
    rng = random.Random(5)
    rows, at = awkward(), 1000
    for size, copies in ((6, 3), (12, 8), (40, 12), (300, 40), (90, 150)):
        words = prose(size, size)
        for _ in range(copies):  # copies of one text, not of each other: many pairs lie about the threshold
            w = list(words)
            for _ in range(rng.randint(0, max(1, size // 45))):
                w[rng.randrange(len(w))] = "".join(rng.choice("abcdef") for _ in range(6))
            rows.append((at, " ".join(w)))
            at += 1
    chain = prose(77, 400)
    rows += [(at + k, " ".join(chain[12 * k : 12 * k + 180])) for k in range(15)]  # each is near the next alone
    return rows


def as_key(r):
    return tuple(str(x) for x in r)


@pytest.mark.parametrize("block", [1024, 7])
def test_near(spark, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    monkeypatch.setattr(near_dedup, "FIRST_CANDIDATES", 1)
    rows = near_rows()
    got = near_dedup.cluster(documents(spark, rows)).collect()
    want = sorted(brute(rows), key=as_key)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=as_key) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_keeps_rows_as_they_are(spark):
    rows = near_rows()
    docs = documents(spark, rows)
    kept = near_dedup.keep_representatives(docs)
    assert kept.columns == docs.columns
    want = {(d, t) for (d, t), (_, _, c) in zip(rows, brute(rows)) if d == c}
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=as_key) == sorted(want, key=as_key)
    assert near_dedup.keep_representatives(documents(spark, [])).count() == 0


def test_estimate_follows_similarity():
    rng = np.random.default_rng(4)
    for share in (0.3, 0.6, 0.9):
        est = []
        for _ in range(60):
            common, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (int(600 * share), 100, 100))
            k = int(len(common) * (1 - share) / share / 2)
            one, two = (near_dedup.sketch(np.unique(np.concatenate([common, np.resize(x, k) + np.arange(k, dtype=np.uint64)]))) for x in (a, b))
            est.append(near_dedup.estimates(one, two))
        assert abs(np.mean(est) - share) < 0.03


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 3), (7, 8), (8, 6), (30, 20)], "a long, b long")
    got = {r["cid"]: r["component"] for r in near_dedup.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 20: 20, 30: 20}
    assert near_dedup.components(links.limit(0)).count() == 0


def test_small_sets_with_one_common_passage_bring_few_candidates(spark):
    """Short texts that share a passage and nothing else do not meet in buckets."""
    rng = random.Random(11)
    passage = " ".join(prose(3, 8))
    rows = []
    for i in range(2000):
        own = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(rng.randint(10, 30))]
        rows.append((i, " ".join(own[:5]) + " " + passage + " " + " ".join(own[5:])))
    made = near_dedup.sketches(documents(spark, rows)).selectExpr("doc_id", "explode(keys) AS key")
    size = [r["count"] for r in made.groupBy("key").count().where("count > 1").collect()]
    assert sum(n * (n - 1) // 2 for n in size) < 400
    got = near_dedup.cluster(documents(spark, rows)).collect()
    assert all(r["kept"] for r in got) and len(got) == len(rows)


@pytest.mark.parametrize("n", [7, 60, 399])
def test_own_registers_agree_as_often_as_sets_do(n):
    rng = np.random.default_rng(n)
    common, each = int(n * 0.85), (n - int(n * 0.85)) // 2
    share = common / (common + 2 * each)
    agree = []
    for _ in range(80):
        x = rng.integers(0, 1 << 63, common + 2 * each).astype(np.uint64)
        a, b = near_dedup.own_sketch(x[: common + each]), near_dedup.own_sketch(x[each:][:common] if not each else np.concatenate([x[:common], x[common + each :]]))
        assert a.all() and b.all()
        agree.append((a == b).mean())
    assert abs(np.mean(agree) - share) < 0.02


@pytest.mark.parametrize("keep", [near_dedup.keep_representatives, exact_dedup.keep_one])
def test_clashing_names_stay(spark, keep):
    names = "doc_id long, text string, row string, id string, key string, copies string, __id string, __key string, __rows string, __kept string, stays string"
    text = " ".join(prose(6, 30))
    rows = [(d, t, *"abcdefghi") for d, t in ((1, text), (2, text), (2, text), (3, "other"), (4, None))]
    docs = spark.createDataFrame(rows, names)
    out = keep(docs)
    assert out.dtypes == docs.dtypes and out.count() == 3
    assert {tuple(r)[2:] for r in out.collect()} == {tuple("abcdefghi")}


def test_what_small_sets_share(monkeypatch):
    monkeypatch.setattr(near_dedup, "COLUMNS", 5)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 30))).astype("<u4") for _ in range(12)]
    items = [s.tobytes() for s in sets] + [None]
    rows, cols = np.array([0, 3, 12, 5]), np.arange(13)
    got = near_dedup._common(items, rows, cols)
    sets.append(np.empty(0, "<u4"))
    assert got.tolist() == [[len(np.intersect1d(sets[r], sets[c])) if r != c or r == 12 else got[k, c] for c in cols] for k, r in enumerate(rows)]


def test_large_sets_below_the_threshold_bring_few_candidates(spark, monkeypatch):
    """Texts that all share three quarters of their shingles with each other: registers alone bring up most pairs."""
    rng = random.Random(3)
    base = prose(8, 900)
    rows = []
    for i in range(80):
        own = [w if j % 40 >= 2 else "".join(rng.choice("abcdefghij") for _ in range(7)) for j, w in enumerate(base)]
        rows.append((i, " ".join(own)))
    asked, confirmed = [], near_dedup._confirmed

    def counted(docs, classes, pairs, percent):
        asked.append(pairs.count())
        return confirmed(docs, classes, pairs, percent)

    monkeypatch.setattr(near_dedup, "_confirmed", counted)
    got = near_dedup.cluster(documents(spark, rows)).collect()
    assert all(r["kept"] for r in got) and sum(asked) <= len(rows)


@pytest.mark.parametrize("n", [7, 128, 700, 6000, 60_000])
def test_parities_leave_no_pair_at_the_threshold_out(n):
    rng = np.random.default_rng(n)
    for share, near in ((0.85, True), (0.72, False)):
        alone = int(n * (1 - share))
        for _ in range(20):
            x = rng.integers(0, 1 << 63, n).astype(np.uint64)
            a, b = x[: n - alone // 2], x[alone - alone // 2 :]
            odd = np.unpackbits(near_dedup.parity(a) ^ near_dedup.parity(b)).sum()
            est, may = near_dedup.could_differ(np.float64(odd), np.float64(len(a) + len(b)), 85)
            if near:
                assert may
            elif n < near_dedup.HUGE and alone * 100 > 20 * n:
                assert not may and abs(est - share) < 0.06
