"""Byte-pair encoding and decoding by speculation and verification.

A word is first cut greedily into the longest tokens. That proposal is the true
encoding exactly if no merge would join two neighbouring tokens before the merges
inside them are done, which depends on each adjacent pair alone: on the tokens
along the right edge of the left one, those along the left edge of the right one,
and the ranks at which they come and go. All pairs of a batch are tested at once in
numpy. Words with a failing pair, and only those, are merged exactly.

Texts of any length take time in proportion (a heap merges long words). Null text
counts as empty: no ids, empty decoding. The special token's own string in a text
becomes its id, as in the library whose file is read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from strataflow.llm.batches import per_slice

#: Entries of each of a worker's caches; a full cache keeps what came first, which has the common words.
CACHE_ENTRIES = 400_000
_LONG = 48  # bytes of a word up to which failing words are merged side by side
_NEVER = np.int64(1 << 40)
_SIDE = 2048
_DEEP = 16  # bytes of a token that the greedy match follows
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], "<u8")


def _mix(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low * np.uint64(0x9E3779B97F4A7C15) ^ high


# The split before merging. The plain module is faster, and equal on characters
# whose classes it shares with the vocabulary's pattern; others take the full pattern.
_PLAIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_SHARED = re.compile(r"[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧€]*")
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
_FULL = regex.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)


def pretokens(text: str) -> list[str]:
    return (_PLAIN if _SHARED.fullmatch(text) else _FULL).findall(text)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """Vocabulary and merge table of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.size, self.token = size, [b""] * size
        for s, i in vocab.items():
            self.token[i] = bytes(letters[c] for c in s)
        for s, i in self.specials.items():
            self.token[i] = s.encode()
        self.byte_id = np.zeros(256, np.int64)
        for i in vocab.values():
            if len(self.token[i]) == 1:
                self.byte_id[self.token[i][0]] = i
        left, right, made = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        pairs = []
        for rank, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            t = vocab[a + b]
            left[t], right[t], made[t] = vocab[a], vocab[b], rank
            pairs.append((vocab[a] * size + vocab[b], rank, t))
        self.left, self.made = left, made
        keys, ranks, out = np.array(sorted(pairs)).T
        self.keys, self.ranks, self.out = keys.copy(), ranks.copy(), out.copy()
        self.by_pair = {int(k): (int(r), int(t)) for k, r, t in pairs}
        self.right_edge, self.left_edge = self._edges(right), self._edges(left)
        # pairs seen before, direct-mapped
        self._slot_key, self._slot_bad = np.full(1 << 18, -1), np.zeros(1 << 18, bool)
        whole = ~self._meets(left.clip(0), right.clip(0), made)  # merges into itself from its bytes
        whole |= left < 0
        for t in np.argsort(made):
            whole[t] &= left[t] < 0 or (whole[left[t]] and whole[right[t]])
        self.proposals = {self.token[i]: i for i in vocab.values() if whole[i]}
        self._prefixes = self._prefix_levels()

    def _prefix_levels(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per length up to ``_DEEP``: sorted first halves, second halves and the token (or -1) of every token prefix."""
        levels = []
        for n in range(1, _DEEP + 1):
            found = {b[:n] for b in self.proposals if len(b) >= n}
            rows = sorted((*np.frombuffer(b.ljust(16, b"\0"), "<u8").tolist(), self.proposals.get(b, -1)) for b in found)
            low, high, token = (np.array([r[i] for r in rows], t) for i, t in ((0, "<u8"), (1, "<u8"), (2, np.int64)))
            if n > 8:  # one sorted key; both halves are compared afterwards
                order = np.argsort(_mix(low, high))
                low, high, token = low[order], high[order], token[order]
            levels.append((low if n <= 8 else _mix(low, high), np.stack([low, high]), token))
        return levels

    def _edges(self, child: np.ndarray) -> np.ndarray:
        """Row t: t, its child on one side, that one's child, ...; -1 past the byte."""
        cols = [np.arange(self.size)]
        while (cols[-1] >= 0).any():
            cols.append(np.where(cols[-1] >= 0, child[cols[-1].clip(0)], -1))
        return np.stack(cols[:-1], 1)

    def rank_of(self, key: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, key).clip(max=len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def _meets(self, a: np.ndarray, b: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Whether a merge of rank under ``before`` joins a's right edge to b's left edge."""
        bad = np.zeros(len(a), bool)
        for i in range(self.right_edge.shape[1]):
            x = self.right_edge[a, i]
            if not (x >= 0).any():
                break
            gone_x = self.made[self.right_edge[a, i - 1]] if i else np.full(len(a), _NEVER)
            for j in range(self.left_edge.shape[1]):
                rows = np.flatnonzero((x >= 0) & ~bad & (self.left_edge[b, j] >= 0))
                if not len(rows):
                    break
                u, v = x[rows], self.left_edge[b[rows], j]
                rank = self.rank_of(u * self.size + v)
                when = np.maximum(rank, np.maximum(self.made[u], self.made[v]))
                gone_y = self.made[self.left_edge[b[rows], j - 1]] if j else np.full(len(rows), _NEVER)
                # of two equal merges the left one comes first
                bad[rows] = (rank < before[rows]) & (when < gone_x[rows]) & (when <= gone_y)
        return bad

    def clash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each adjacent pair: True if exact merging would not leave that border."""
        key = a * self.size + b
        slot = (key * 0x9E3779B1) % len(self._slot_key)
        new = np.flatnonzero(self._slot_key[slot] != key)
        out = self._slot_bad[slot]
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            bad = self._meets(fresh // self.size, fresh % self.size, np.full(len(fresh), _NEVER))
            out[new] = bad[back]
            at = (fresh * 0x9E3779B1) % len(self._slot_key)
            self._slot_key[at], self._slot_bad[at] = fresh, bad
            # two new pairs may share a slot: the last key stays, so its flag must be written with it
            self._slot_bad[at] = self._slot_bad[at] & (self._slot_key[at] == fresh) | bad & (self._slot_key[at] == fresh)
            other = self._slot_key[at] != fresh
            self._slot_key[at[other]] = -1
        return out

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words at once: ids in order, and the word each belongs to.

        Tokens of more than ``_DEEP`` bytes are proposed only as whole words; a shorter
        proposal is just one more that the test may refuse.
        """
        whole = np.fromiter((self.proposals.get(w, -1) for w in words), np.int64, len(words))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        joined = b"".join(words) + b"\0" * 24
        eight = np.ndarray((len(joined) - 7,), "<u8", joined, 0, (1,))
        ends = np.cumsum(lengths)
        row = np.flatnonzero(whole < 0)
        at, end = (ends - lengths)[row], ends[row]
        got_row, got_at, got = [np.flatnonzero(whole >= 0)], [(ends - lengths)[whole >= 0]], [whole[whole >= 0]]
        while len(row):
            size, token = np.ones(len(row), np.int64), self.byte_id[eight[at].astype(np.uint8)]
            live, low, high, room = np.arange(len(row)), eight[at], eight[at + 8], end - at
            for n in range(2, _DEEP + 1):
                keep = room[live] >= n
                live = live[keep]
                if not len(live):
                    break
                keys, halves, tokens = self._prefixes[n - 1]
                a = low[live] & _MASK[min(n, 8)]
                b = high[live] & _MASK[max(n - 8, 0)]
                key = a if n <= 8 else _mix(a, b)
                found = np.searchsorted(keys, key).clip(max=len(keys) - 1)
                hit = (halves[0, found] == a) & (halves[1, found] == b)
                live, found = live[hit], found[hit]
                ends_here = tokens[found] >= 0
                size[live[ends_here]], token[live[ends_here]] = n, tokens[found[ends_here]]
            got_row.append(row)
            got_at.append(at)
            got.append(token)
            at = at + size
            more = at < end
            row, at, end = row[more], at[more], end[more]
        order = np.argsort(np.concatenate(got_at), kind="stable")
        return np.concatenate(got)[order], np.concatenate(got_row)[order]

    def merge_long(self, word: bytes) -> list[int]:
        """Exact merging with a heap."""
        ids = [int(self.byte_id[c]) for c in word]
        n, pair = len(ids), self.by_pair.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair(ids[i] * self.size + ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = pair(a * self.size + b)[1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (r := pair(ids[p] * self.size + ids[q])):
                    heapq.heappush(heap, (r[0], p, ids[p], ids[q]))
        return [t for t in ids if t >= 0]

    def merge_side_by_side(self, words: list[bytes]) -> list[bytes]:
        """Exact merging of many short words: each pass makes the first lowest-ranked merge of every row."""
        width = max(map(len, words)) + 1
        ids = np.full((len(words), width), -1, np.int64)
        for r, w in enumerate(words):
            ids[r, : len(w)] = self.byte_id[np.frombuffer(w, np.uint8)]
        key = np.where((ids[:, :-1] >= 0) & (ids[:, 1:] >= 0), ids[:, :-1] * self.size + ids[:, 1:], -1)
        rank = self.rank_of(key)
        done = [b""] * len(words)
        rows, columns = np.arange(len(words)), np.arange(width - 1)
        while len(rows):
            at = rank.argmin(1)
            every = np.arange(len(rows))
            live = rank[every, at] < _NEVER
            for r in np.flatnonzero(~live):
                done[rows[r]] = ids[r][ids[r] >= 0].astype("<u4").tobytes()
            ids, rank, rows, at = ids[live], rank[live], rows[live], at[live]
            if not len(rows):
                break
            every = np.arange(len(rows))
            new = self.out[np.searchsorted(self.keys, ids[every, at] * self.size + ids[every, at + 1])]
            moved = columns[None, :] > at[:, None]
            ids[:, :-1] = np.where(moved, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ids[every, at] = new
            rank[:, :-1] = np.where(moved[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = _NEVER
            for p in (at - 1, at):
                ok = (p >= 0) & (ids[every, p + 1] >= 0)
                rank[every[ok], p[ok]] = self.rank_of(ids[every[ok], p[ok]] * self.size + ids[every[ok], p[ok] + 1])
                rank[every[(p >= 0) & ~ok], p[(p >= 0) & ~ok]] = _NEVER
        return done

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit bytes: propose, test all adjacent pairs at once, merge what fails."""
        out: list[bytes] = [b""] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= _LONG]
        for i, w in enumerate(words):
            if len(w) > _LONG:  # a word so long is merged at once: testing it pair by pair gains nothing
                out[i] = np.array(self.merge_long(w), "<u4").tobytes()
        if not short:
            return out
        flat, word = self.propose([words[i] for i in short])
        inner = np.flatnonzero(word[:-1] == word[1:])
        failing = np.unique(word[inner][self.clash(flat[inner], flat[inner + 1])])
        stop = np.cumsum(np.bincount(word, minlength=len(short))).tolist()
        packed, start = flat.astype("<u4").tobytes(), 0
        for i, e in zip(short, stop):
            out[i] = packed[4 * start : 4 * e]
            start = e
        if len(failing):
            failing = sorted((short[f] for f in failing), key=lambda i: len(words[i]))
            for k in range(0, len(failing), _SIDE):  # like lengths together, few enough to stay in the CPU's cache
                part = failing[k : k + _SIDE]
                for i, ids in zip(part, self.merge_side_by_side([words[i] for i in part])):
                    out[i] = ids
        return out


class Table:
    """Byte strings by id, joined for an array of ids in numpy."""

    def __init__(self, items: list[bytes]):
        self.lengths = np.fromiter(map(len, items), np.int64, len(items))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(items), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        shift = self.starts[ids] - (np.cumsum(n) - n)
        return self.flat[np.repeat(shift, n) + np.arange(int(n.sum()))].tobytes()


class Encoder:
    """Texts to ids (little-endian unsigned 32-bit bytes) and back.

    Outside runs of spaces a space always starts a new word, so texts are split at
    spaces and the ids of a part are kept for the next time it occurs.
    """

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.spaced: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self._special = re.compile("(" + "|".join(map(re.escape, self.merges.specials)) + ")")

    def forget(self) -> None:
        """Give up what was kept of parts."""
        self.spaced.clear()
        self.plain.clear()

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        single = [p.isalpha() or p[:1] == " " and p[1:].isalpha() for p in parts]
        split = [(p,) if one else pretokens(p) for p, one in zip(parts, single)]
        words = list({w for s in split for w in s})
        known = dict(zip(words, self.merges.encode_words([w.encode() for w in words])))
        return [known[s[0]] if len(s) == 1 else b"".join([known[w] for w in s]) for s in split]

    def _learn(self, parts: set[str], cache: dict[str, bytes], lead: str) -> dict[str, bytes]:
        """Ids of new parts; a cache that is full keeps what it has."""
        new = list(parts)
        found = dict(zip(new, self._encode_parts([lead + p for p in new])))
        if len(cache) + len(new) <= CACHE_ENTRIES:
            cache.update(found)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        specials = self.merges.specials
        new_spaced: set[str] = set()
        new_plain: set[str] = set()
        known: list[list[list]] = []  # for each text: [parts, their ids or None, whether a space precedes them]
        for t in texts:
            held: list[list] = []
            has = any(s in t for s in specials)
            for s in self._special.split(t) if has else (t,):
                if has and s in specials:
                    held.append([(), [np.array([specials[s]], "<u4").tobytes()], False])
                    continue
                first, *rest = pretokens(s) if "  " in s else s.split(" ")
                groups = [([first, *rest], False)] if "  " in s else [([first], False), (rest, True)]
                for parts, spaced in groups:
                    got = list(map((self.spaced if spaced else self.plain).get, parts))
                    if None in got:
                        (new_spaced if spaced else new_plain).update([p for p, g in zip(parts, got) if g is None])
                    held.append([parts, got, spaced])
            known.append(held)
        new = {
            True: self._learn(new_spaced, self.spaced, " ") if new_spaced else {},
            False: self._learn(new_plain, self.plain, "") if new_plain else {},
        }
        out = []
        for held in known:
            for piece in held:
                if None in piece[1]:
                    found = new[piece[2]]
                    piece[1] = [found[p] if g is None else g for p, g in zip(piece[0], piece[1])]
            out.append(b"".join([b"".join(piece[1]) for piece in held]))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def _tables(path: str) -> tuple[Table, Table]:
    merges = encoder(path).merges
    return Table(merges.token), Table([b"%d," % i for i in range(merges.size)])


def decode(ids: np.ndarray, path: str) -> str:
    """Text of ids; bytes that form no character become the replacement sign."""
    return _tables(path)[0].join(ids.astype(np.int64)).decode("utf-8", errors="replace")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` (array<int>) of each row's text."""

    def work(part, texts):
        ids = [np.frombuffer(b, "<u4").astype(np.int32) for b in encoder(path).encode(texts)]
        return {"doc_id": part.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32()))}

    return per_slice(docs.select("doc_id", "text"), work, "doc_id bigint, ids array<int>")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """Per row: token count, hash of the ids as decimals, hash of the decoded text.

    Ids and texts stay in the task that made them; nothing is shuffled.
    """

    def work(part, texts):
        token, decimal = _tables(path)
        counts, id_hashes, text_hashes = [], [], []
        for b in encoder(path).encode(texts):
            ids = np.frombuffer(b, "<u4").astype(np.int64)
            counts.append(len(ids))
            id_hashes.append(hashlib.sha256(decimal.join(ids)[:-1]).hexdigest())
            text_hashes.append(hashlib.sha256(token.join(ids).decode("utf-8", errors="replace").encode()).hexdigest())
        return {
            "doc_id": part.column("doc_id"),
            "n_tokens": pa.array(counts, pa.int64()),
            "ids_sha256": pa.array(id_hashes, pa.string()),
            "decoded_sha256": pa.array(text_hashes, pa.string()),
        }

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return per_slice(docs.select("doc_id", "text"), work, schema)
