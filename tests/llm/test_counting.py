import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from strataflow.llm import counting as C
from strataflow.llm.queries import WORD_VOCABULARY
from tests.llm.helpers import awkward, documents


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_VOCABULARY)


def odd_texts():
    rng = random.Random(5)
    letters = "ab 's'rel'l'veTdm\n.é²😀　\x1c\x85½ⅧAΣς́İ<|9ꟋᲉ"
    texts = ["", "'", "''s", "'s's", "it's", "a'sun", "I'LL", "x" * 5000, "ab" * 4000, "ΑΣ Σ", "<|ENDOFTEXT|>"]
    texts += ["<|endoftext|>a<|startoftext|>'s b", "<|endoftext|>" * 3, "e<|startoftext|>́"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    return texts + ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 3000))) for _ in range(60)]


def counted(library, texts):
    return np.array([len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)])


@pytest.mark.parametrize("chunk,states", [(1024, 1 << 16), (64, 1 << 16), (7, 300)])
def test_counts_are_the_librarys(library, chunk, states):
    """Chunks shorter than words and tables that fill up change nothing."""
    texts = odd_texts()
    counter = C.Counter(WORD_VOCABULARY, states, chunk)
    for _ in range(2):
        assert np.array_equal(counter.counts(texts), counted(library, texts))
    assert len(counter.transducer.states) <= states + 1024


def test_neighbours_that_stay_apart():
    tokens = C.Tokens(WORD_VOCABULARY)
    rng = random.Random(1)
    whole = [i for i in rng.sample(range(tokens.size), 600) if tokens.symbols[i] and tokens.symbols[i][-1] < 256]
    whole = [i for i in whole if tokens.is_whole(i)]
    for a, b in zip(whole, reversed(whole)):
        assert tokens.stay_apart(a, b) == (tokens.merge(tokens.symbols[a] + tokens.symbols[b]) == [a, b])


def test_chunk_maps_compose():
    """Emissions do not depend on where chunks begin."""
    counter = C.Counter(WORD_VOCABULARY)
    rng = np.random.default_rng(2)
    symbols = rng.integers(97, 110, 4000)
    symbols[rng.random(4000) < 0.02] += 256
    symbols[-1] = 97 + 256
    symbols[1000:2500] %= 256  # a word over many chunks
    want = C.emissions(counter.transducer, symbols, 4000)
    for chunk in (1, 3, 50, 999):
        assert np.array_equal(C.emissions(counter.transducer, symbols, chunk), want)


def test_documents(spark, library):
    rows = awkward()
    got = C.count_documents(documents(spark, rows), WORD_VOCABULARY, 100).collect()
    want = []
    for doc_id, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 100))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert C.count_documents(documents(spark, []), WORD_VOCABULARY).count() == 0
