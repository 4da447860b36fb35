import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from strataflow.llm import bpe, packing
from strataflow.llm.queries import VOCABULARY, op10_packing
from strataflow.llm.tokens import RankEncoder
from tests.llm.helpers import awkward, documents


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def odd_texts():
    rng = random.Random(3)
    letters = "ab \n.'tse<1é²😀\u3000\x1c\x85_½ⅧA"
    texts = ["", " ", "  ", "a  b   c", "a\n\n  b", "don't I'LL", "a" * 3000, "ab" * 900, "x \n y", "tail  ", "<|endoftext|>"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(800)]
    return [*texts, " ".join("".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 60))) for _ in range(2000))]


@pytest.mark.parametrize("kind", [bpe.Encoder, RankEncoder])
def test_ids_are_the_librarys(library, kind, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 500)  # a full cache changes nothing
    texts = odd_texts()
    encoder = kind(VOCABULARY)
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_digests(spark, library):
    rows = awkward()
    got = bpe.digest_documents(documents(spark, rows), VOCABULARY).collect()
    assert len(got) == len(rows)
    want = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    encoded = bpe.encode_documents(documents(spark, rows[:3]), VOCABULARY).collect()
    assert all(bpe.decode(np.array(r["ids"]), VOCABULARY) == dict(rows[:3])[r["doc_id"]] for r in encoded)
    assert bpe.digest_documents(documents(spark, []), VOCABULARY).count() == 0


def check_packing(got, want_ids, capacity=2048):
    by_doc, by_bin = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(want_ids)
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        ids, at = want_ids[doc], 0
        for k, r in enumerate(pieces):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["length"] == capacity or k == 0
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids)
    for pieces in by_bin.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_bin)


def test_packing(spark, library):
    rows = [(i, t) for i, (_, t) in enumerate(awkward())]
    got = packing.pack(documents(spark, rows), VOCABULARY).collect()
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 0] for d, t in rows}
    bins = check_packing(got, ids)
    lengths = [n for v in ids.values() for _, n in packing.cut(len(v), 2048)]
    assert packing.lower_bound(np.array(lengths), 2048) <= bins <= packing.lower_bound(np.array(lengths), 2048) + 1
    assert packing.pack(documents(spark, []), VOCABULARY).count() == 0
    repeated = packing.pack(documents(spark, [(1, "a b")] * 3), VOCABULARY)
    assert repeated.count() == 3 and repeated.select("offset").distinct().count() == 3


def test_packing_in_rounds(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "PER_PARTITION", 16)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = packing.pack(docs, VOCABULARY).collect()
    ids = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    bins = check_packing(got, ids)
    sizes = np.array([r["length"] for r in got])
    assert bins <= 1.03 * packing.lower_bound(sizes, 2048) + 2


def test_bound_is_never_above_the_best():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        sizes = np.sort(rng.integers(1, 21, n))[::-1]
        best = n
        # all ways to put few items into bins
        def place(i, room):
            nonlocal best
            if len(room) >= best:
                return
            if i == n:
                best = len(room)
                return
            for k in range(len(room)):
                if room[k] >= sizes[i]:
                    place(i + 1, [*room[:k], room[k] - sizes[i], *room[k + 1 :]])
            place(i + 1, [*room, 20 - sizes[i]])

        place(0, [])
        used = packing.best_fit_decreasing(sizes, 20)[0].max() + 1
        assert packing.lower_bound(sizes, 20) <= best <= used


def test_query(spark):
    assert op10_packing(spark, "/root/testdata/sf0.001").selectExpr("max(length)").first()[0] <= 2048
