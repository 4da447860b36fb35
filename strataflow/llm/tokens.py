"""Token ids for operators that only need them, through the public rank-based library.

The same split at spaces and the same kept parts as in ``bpe``; new parts are
encoded many at a time.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import tiktoken

from strataflow.llm.bpe import Encoder, Merges

_SPLIT = r"""'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class RankEncoder(Encoder):
    """``Encoder`` whose new parts go through the rank-based library."""

    def __init__(self, path: str):
        super().__init__(path)
        tokens = {t: i for i, t in enumerate(self.merges.token) if t and i not in self.merges.specials.values()}
        self._ranks = tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=tokens, special_tokens={})
        self._length = np.fromiter(map(len, self.merges.token), np.int64, self.merges.size)

    def _alone(self, part: str) -> bytes:
        return np.array(self._ranks.encode_ordinary(part), "<u4").tobytes()

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        # parts that begin with their only space, and neither begin nor end with more, don't touch each other when joined
        safe = [i for i, p in enumerate(parts) if p[:1] == " " and len(p) > 1 and not (p[1].isspace() or p[-1].isspace())]
        joined = "".join([parts[i] for i in safe])
        ids = self._ranks.encode_to_numpy(joined, allowed_special=set(), disallowed_special=()).astype("<u4")
        ends = np.cumsum([len(parts[i].encode()) for i in safe])
        reached = np.cumsum(self._length[ids])
        stop = np.searchsorted(reached, ends) + 1
        if len(safe) and not np.array_equal(reached[stop - 1], ends):
            return [self._alone(p) for p in parts]
        out: list[bytes | None] = [None] * len(parts)
        packed, start = ids.tobytes(), 0
        for i, e in zip(safe, stop.tolist()):
            out[i] = packed[4 * start : 4 * e]
            start = e
        return [self._alone(p) if o is None else o for p, o in zip(parts, out)]


@lru_cache(maxsize=2)
def encoder(path: str) -> RankEncoder:
    return RankEncoder(path)


__all__ = ["Merges", "RankEncoder", "encoder"]
