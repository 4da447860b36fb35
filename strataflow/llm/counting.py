"""Token counts through a compiled finite-state transducer.

A BPE tokenizer with word ends is compiled into a deterministic transducer over bytes,
where the last byte of a word is a symbol of its own. The encoding of a prefix ends in
one token that is determined by what stands before it: of all tokens that end here, the
one whose left neighbour, the last token of the shorter prefix, stays apart from it. So
a state holds, for each place from which a token may still run on, the place's node in
the trie of tokens, its last token, and how many tokens it is ahead of the least; a
transition emits the tokens by which that least number grows. States are made when a
text first needs them, and thrown away together when their table is full.

A slice of texts is one row of symbols, cut into chunks that run side by side. A chunk
maps the state it is entered with to the one it is left with. Behind a word end the map
is constant, so chunks run from there without knowing how they are entered; a prefix
scan over the maps then finds the last one that forgets its entry, and what lies between
it and the next word end runs from its state. Words longer than a chunk pass through.

Special strings count one token each, as the library matches them in raw text.
Characters that are newer than this Python's tables are looked up in the library.

A null text is empty: no bytes, no tokens. Very long texts and words are counted whole;
a text is never split between tasks. Repeated rows and rows without an id each give a
row. Columns beside ``doc_id`` and ``text`` are not read, whatever their names. An
empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, pre_tokenizers

from strataflow.llm.batches import per_slice

LIMIT = 2048
#: Symbols: bytes, bytes that end a word, and one that changes nothing.
BYTES, SYMBOLS, PAD = 256, 513, 512
#: States of a transducer before it starts anew; at 150 symbols in use the table has 160 MB.
#: Prose of four languages needs about half of them.
MOST_STATES = 1 << 18
CHUNK = 1024
#: Lanes below which a loop over single symbols is faster than one over arrays.
FEW_LANES = 12
_OUT = 256  # emitted tokens of a transition fit a byte
START = 0

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
#: What may follow an apostrophe that begins a word (fixed values of the tokenizer's split).
SHORT, LONG = "stmd", ("re", "ve", "ll")


@lru_cache
def character_classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        if category == "Cn":
            table[c] = UNKNOWN
        elif (kind := kinds.get(category[0])) is not None:
            table[c] = kind
        elif category[0] == "Z" or c in (9, 10, 11, 12, 13, 0x85):
            table[c] = SPACE
    return table


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in the vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(BYTES) if b not in plain]
    return {chr(b): b for b in plain} | {chr(BYTES + k): b for k, b in enumerate(others)}


class Tokens:
    """Vocabulary as symbols: the trie of tokens, their merges, and which neighbours stay apart."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, end = byte_letters(), model["end_of_word_suffix"]
        self.end = end
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []  # token made by a merge
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        self.parts: list[tuple[int, int] | None] = [None] * self.size
        self.level = [-1] * self.size  # rank of the merge that makes a token; -1 for single symbols
        for k, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = k
            self.made.append(whole)
            self.parts[whole], self.level[whole] = (left, right), k
        self.symbols: list[list[int]] = [[] for _ in range(self.size)]
        for token, i in vocab.items():
            body = token.removesuffix(end) if token != end else token
            if all(c in letters for c in body):
                self.symbols[i] = [letters[c] for c in body]
                if body != token:
                    self.symbols[i][-1] += BYTES
        self.single = {s[0]: i for i, s in enumerate(self.symbols) if len(s) == 1}
        # trie: (node * 512 + symbol) -> node
        self.go: dict[int, int] = {}
        self.token_at, self.goes_on = [-1], [True]
        for i, symbols in enumerate(self.symbols):
            node = 0
            for s in symbols:
                self.goes_on[node] = True
                if (child := self.go.get(node * 512 + s)) is None:
                    child = self.go[node * 512 + s] = len(self.token_at)
                    self.token_at.append(-1)
                    self.goes_on.append(False)
                node = child
            if symbols:
                self.token_at[node] = i
        self._whole: dict[int, bool] = {}
        self._apart: dict[tuple[int, int], bool] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Plain merging: the lowest rank first, the leftmost of equal ones."""
        ids = [self.single[s] for s in symbols]
        while len(ids) > 1:
            k, at = min((self.rank.get(p, len(self.made)), i) for i, p in enumerate(zip(ids, ids[1:])))
            if k == len(self.made):
                break
            ids[at : at + 2] = [self.made[k]]
        return ids

    def is_whole(self, token: int) -> bool:
        """Whether the token is the encoding of its own symbols."""
        if (known := self._whole.get(token)) is None:
            known = self._whole[token] = self.merge(self.symbols[token]) == [token]
        return known

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' symbols is the two tokens.

        Both grow from single symbols in the order of their merges. They do not stay
        apart if the parts that touch would be merged before either has grown further;
        of equal ranks the left one comes first.
        """
        if (known := self._apart.get((a, b))) is None:
            known = self._apart[a, b] = self._grown_apart(a, b)
        return known

    def _edge(self, token: int, side: int) -> list[int]:
        edge = [token]
        while (parts := self.parts[edge[-1]]) is not None:
            edge.append(parts[side])
        return edge

    def _grown_apart(self, a: int, b: int) -> bool:
        never = len(self.made) + 1
        left, right = self._edge(a, 1), self._edge(b, 0)
        x, y = left.pop(), right.pop()
        while True:
            grow_x = self.level[left[-1]] if left else never
            grow_y = self.level[right[-1]] if right else never
            together = self.rank.get((x, y), never)
            if together < grow_x and together <= grow_y and together < never:
                return False
            if not left and not right:
                return True
            if grow_x <= grow_y:
                x = left.pop()
            else:
                y = right.pop()


class Transducer:
    """States and transitions made so far: ``table[state, column]`` is next state * 256 + emitted tokens."""

    def __init__(self, tokens: Tokens, most_states: int = MOST_STATES):
        self.tokens, self.most = tokens, most_states
        self.column = np.full(SYMBOLS, -1, np.int64)
        self.symbol: list[int] = []
        self._clear()

    def _clear(self) -> None:
        self.states = [((0, -1, 0),)]
        self.number = {self.states[0]: START}
        self.table = np.full((256, max(64, len(self.symbol))), -1, np.int32)

    def columns(self, symbols: np.ndarray) -> np.ndarray:
        """Columns of symbols; new symbols get the next ones."""
        new = np.flatnonzero((np.bincount(symbols, minlength=SYMBOLS) > 0) & (self.column < 0))
        for s in new.tolist():
            self.column[s] = len(self.symbol)
            self.symbol.append(s)
        if (more := len(self.symbol) - self.table.shape[1]) > 0:
            self.table = np.pad(self.table, ((0, 0), (0, more + 32)), constant_values=-1)
        return self.column[symbols].astype(np.int32)

    def _move(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        if symbol == PAD:
            return state, 0
        t = self.tokens
        open_places, last = [], None
        for node, token, ahead in state:
            child = t.go.get(node * 512 + symbol)
            if child is None:
                continue
            v = t.token_at[child]
            if last is None and v >= 0 and t.is_whole(v) and (token < 0 or t.stay_apart(token, v)):
                last = (v, ahead + 1)
            if t.goes_on[child]:
                open_places.append((child, token, ahead))
        if symbol >= BYTES:
            return ((0, -1, 0),), last[1]
        open_places.append((0, *last))
        least = min(p[2] for p in open_places)
        return tuple((n, v, c - least) for n, v, c in open_places), least

    def _make(self, states: np.ndarray, columns: np.ndarray) -> None:
        for s, c in set(zip(states.tolist(), columns.tolist())):
            key, out = self._move(self.states[s], self.symbol[c])
            if (n := self.number.get(key)) is None:
                n = self.number[key] = len(self.states)
                self.states.append(key)
                if n >= len(self.table):
                    self.table = np.pad(self.table, ((0, len(self.table)), (0, 0)), constant_values=-1)
            self.table[s, c] = n * _OUT + out

    def _again(self, states: np.ndarray) -> np.ndarray:
        """A new, empty table in which only the given states are known; their new numbers."""
        used, back = np.unique(states, return_inverse=True)
        kept = [self.states[s] for s in used.tolist()]
        self._clear()
        for key in kept:
            if key not in self.number:
                self.number[key] = len(self.states)
                self.states.append(key)
        while len(self.table) < len(self.states):
            self.table = np.pad(self.table, ((0, len(self.table)), (0, 0)), constant_values=-1)
        return np.array([self.number[k] for k in kept], np.int64)[back]

    def step(self, states: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and emitted tokens of lanes that each read one symbol."""
        if len(self.states) > self.most:
            states = self._again(states)
        v = self.table[states, columns]
        if len(missing := np.flatnonzero(v < 0)):
            self._make(states[missing], columns[missing])
            v = self.table[states, columns]
        return v >> 8, (v & 255).astype(np.uint8)

    def run_one(self, state: int, columns: np.ndarray, emitted: np.ndarray) -> int:
        """One lane, symbol after symbol; its last state."""
        for k, c in enumerate(columns.tolist()):
            if len(self.states) > self.most:
                state = int(self._again(np.array([state]))[0])
            v = self.table.item(state, c)
            if v < 0:
                self._make(np.array([state]), np.array([c]))
                v = self.table.item(state, c)
            state, emitted[k] = v >> 8, v & 255
        return state


def emissions(transducer: Transducer, symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Emitted tokens at each of ``symbols``, which begin at a word's begin and end at a word's end.

    Chunks run side by side from their first word end; the scan over their maps then
    gives each stretch before a first word end the state it is entered with.
    """
    n = len(symbols)
    if not n:
        return np.empty(0, np.uint8)
    lanes = -(-n // chunk)
    columns = transducer.columns(np.append(symbols, PAD))
    pad, columns = columns[-1], columns[:-1]
    place = np.arange(n)
    ends = np.flatnonzero(symbols >= BYTES)
    # behind the first word end of each chunk the map of the chunk is constant
    lane_of_end = ends // chunk
    first = np.full(lanes, -1)
    first[lane_of_end[::-1]] = ends[::-1]
    forgets = first >= 0
    known = place > np.where(forgets, first, n)[place // chunk]
    grid = np.full((lanes, chunk), pad, np.int32)
    grid.reshape(-1)[:n] = np.where(known, columns, pad)
    grid = np.ascontiguousarray(grid.T)
    states = np.zeros(lanes, np.int64)
    out = np.empty((chunk, lanes), np.uint8)
    for k in range(chunk):
        states, out[k] = transducer.step(states, grid[k])
    emitted = np.ascontiguousarray(out.T).reshape(-1)[:n]
    # scan: the last chunk before this one whose map forgets its entry
    last = np.maximum.accumulate(np.where(forgets, np.arange(lanes), -1))
    open_lanes = np.flatnonzero(forgets)
    before = np.where(open_lanes > 0, last[open_lanes - 1], -1)
    begin, end = (before + 1) * chunk, first[open_lanes] + 1
    # states are numbers of the present table; a new table renumbers them all
    entry = [transducer.states[s] for s in states.tolist()]
    enter = [entry[b] if b >= 0 else ((0, -1, 0),) for b in before.tolist()]
    _run_stretches(transducer, columns, emitted, begin, end, enter)
    return emitted


def _number(transducer: Transducer, key: tuple) -> int:
    if (n := transducer.number.get(key)) is None:
        n = transducer.number[key] = len(transducer.states)
        transducer.states.append(key)
        while len(transducer.table) <= n:
            transducer.table = np.pad(transducer.table, ((0, len(transducer.table)), (0, 0)), constant_values=-1)
    return n


def _run_stretches(transducer, columns, emitted, begin, end, enter) -> None:
    """Stretches of different lengths side by side, the longest first; few long ones one by one."""
    length = end - begin
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    states = np.array([_number(transducer, enter[i]) for i in order.tolist()], np.int64)
    k, active = 0, len(order)
    while active > FEW_LANES:
        at = begin[:active] + k
        states, emitted[at] = transducer.step(states[:active], columns[at])
        k += 1
        active = int(np.searchsorted(-length, -k))
    keys = [transducer.states[s] for s in states[:active].tolist()]
    for i, key in enumerate(keys):
        a, b = int(begin[i]) + k, int(begin[i] + length[i])
        transducer.run_one(_number(transducer, key), columns[a:b], emitted[a:b])


class Counter:
    """Counts of whole texts in a task."""

    def __init__(self, path: str, most_states: int = MOST_STATES, chunk: int = CHUNK):
        self.library = Tokenizer.from_file(path)
        self.transducer = Transducer(Tokens(path), most_states)
        self.classes = character_classes().copy()
        self.chunk = chunk
        special = [t.content for t in self.library.get_added_tokens_decoder().values() if t.special]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))

    def _plain(self, text: str) -> str:
        """The text as the tokenizer's normalisation leaves it, but for white space."""
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # the library lower-cases letter by letter: no final sigma
        return text.replace("Σ", "σ").lower()

    def _look_up(self, text: str) -> None:
        """Classes of characters that this Python's tables do not have."""
        met = sorted(set(text))
        for c in met:
            if self.classes[ord(c)] == UNKNOWN:
                kind = OTHER
                for pattern, k in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
                    if pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(c):
                        kind = k
                self.classes[ord(c)] = kind

    def counts(self, texts: list[str]) -> np.ndarray:
        extra = np.zeros(len(texts), np.int64)
        plain = []
        for i, t in enumerate(texts):
            if "<|" in t:
                t, extra[i] = self.special.subn("\n", t)
            plain.append(self._plain(t))
        joined = "\n".join(plain)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.classes[code]
        if (kind == UNKNOWN).any() or any(map(self._newer, texts)):
            plain = [
                self.library.normalizer.normalize_str(self.special.sub("\n", t)) if self._newer(t) else p
                for t, p in zip(texts, plain)
            ]
            joined = "\n".join(plain)
            self._look_up(joined)
            code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            kind = self.classes[code]
        stops = np.cumsum([len(p) + 1 for p in plain]) - 1
        symbols, before = self._symbols(joined, code, kind)
        emitted = emissions(self.transducer, symbols, self.chunk)
        total = np.concatenate([[0], np.cumsum(emitted, dtype=np.int64)])[before[stops]]
        return np.diff(total, prepend=0) + extra

    def _newer(self, text: str) -> bool:
        """Whether the text has characters that this Python does not know."""
        if text.isascii():
            return False
        table = character_classes()
        return bool((table[np.frombuffer(text.encode("utf-32-le"), np.uint32)] == UNKNOWN).any())

    @staticmethod
    def _symbols(joined: str, code: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words, and how many of them stand before each character (and in all)."""
        n = len(code)
        starts = np.ones(n + 3, bool)
        starts[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        marks = np.flatnonzero((code == 39) & starts[:n])
        after = np.concatenate([code, [0, 0]]).astype(np.uint32)
        short = marks[np.isin(after[marks + 1], [ord(c) for c in SHORT])]
        two = (after[marks + 1].astype(np.uint64) << np.uint64(32)) | after[marks + 2]
        long = marks[np.isin(two, np.array([ord(a) << 32 | ord(b) for a, b in LONG], np.uint64))]
        starts[short + 1] = starts[long + 1] = starts[long + 2] = False
        starts[short + 2] = starts[long + 3] = True
        word = kind != SPACE
        ends = word & starts[1 : n + 1]
        raw = np.frombuffer(joined.encode(), np.uint8)
        if len(raw) == n:
            symbols = raw.astype(np.int64)
            symbols[ends] += BYTES
            return symbols[word], np.concatenate([[0], np.cumsum(word)])
        width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        symbols = raw.astype(np.int64)
        symbols[(np.cumsum(width) - 1)[ends]] += BYTES
        return symbols[np.repeat(word, width)], np.concatenate([[0], np.cumsum(width * word)])


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The counter of a worker: states made for one task serve the next."""
    return Counter(path)


def count_documents(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; one pass without a shuffle."""

    def work(part, texts):
        counts = counter(path).counts(texts)
        return {
            "doc_id": part.column("doc_id"),
            "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
            "n_tokens": pa.array(counts, pa.int64()),
            "over_limit": pa.array(counts > limit),
        }

    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return per_slice(docs.select("doc_id", "text"), work, schema)
