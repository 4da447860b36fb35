import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strataflow.llm import spelling as S
from tests.llm.helpers import awkward, documents


def one_edit(u, v):
    """One code point of ``v``, the longer one, is too many or another."""
    k = next((k for k in range(len(u)) if u[k] != v[k]), len(u))
    return len(v) - len(u) < 2 and (u[k + 1 :] == v[k + 1 :] if len(u) == len(v) else u[k:] == v[k + 1 :])


def brute(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in n if x != w and one_edit(*sorted((w, x), key=len))] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def variant_rows():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcéo") for _ in range(rng.randint(5, 9))) for _ in range(25)] + ["a" * 40, "b" * 300, "aaaaa", "abababab"]
    rows = []
    for d in range(150):
        text = []
        for w in rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=25):
            if rng.random() < 0.5:
                k = rng.randrange(len(w) + 1)
                w = rng.choice([w[:k] + rng.choice("ab×é") + w[k:], w[:k] + w[k + 1 :], w[:k] + "c" + w[k + 1 :]])
            text.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((d, rng.choice([" ", "-", "\n"]).join(text)))
    return rows


@pytest.mark.parametrize("tile", [2048, 6])
def test_against_all_edits(spark, monkeypatch, tile):
    """Keys of too many words are cut finer; the pairs stay the same."""
    monkeypatch.setattr(S, "TILE", tile)
    rows = variant_rows() + awkward() * 3
    got = S.group_variants(documents(spark, rows)).collect()
    want = brute(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert sum(1 for r in got if r["form"]) > 10 and any(r["root"] not in (r["word"], r["form"]) for r in got)


def test_pairs_once(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(5, 8))) for _ in range(300)})
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = [tuple(sorted((r["a"], r["b"]))) for r in S.link(table).collect()]
    assert len(got) == len(set(got))
    near = lambda u, v: u != v and one_edit(*sorted((u, v), key=len))
    assert set(got) == {tuple(sorted((u, v))) for u in words for v in words if near(u, v)}


def test_long_chains_of_forms(spark):
    chain = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(37)], "word string, form string")
    assert {tuple(r) for r in S.roots(chain).collect()} == {(f"w{k}", "w37") for k in range(37)}


def test_held_words_are_passed_on(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD_WORDS", 10)
    rows = variant_rows()
    got = {tuple(r) for r in S.count_words(documents(spark, rows)).collect()}
    assert got == {(w, n) for w, _, _, n, _, _ in brute(rows)}


def test_empty(spark):
    assert S.group_variants(documents(spark, [])).count() == 0
    assert S.group_variants(documents(spark, [(1, None), (2, "ab cd")])).count() == 0
    left, right, _ = S._matrices([b"abcde", b"abcdef"], 16)
    assert S._agreeing(left[:1], left[1:])[0] == 5 and np.count_nonzero(right[0, :11]) == 0
