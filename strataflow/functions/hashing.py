"""Deterministic randomness: every draw is a function of (seed, key).

md5 gives the same bytes in every SQL engine, so results depend neither on
the partitioning nor on retries, and an independent engine can replay them.
The functions return SQL text.
"""

from __future__ import annotations


def hash_key(seed, *cols: str) -> str:
    """Sort key: 32 hex digits of the seed and the columns joined with ``|``."""
    return f"md5(concat_ws('|', {', '.join([repr(str(seed)), *cols])}))"


def hash_slice(key: str, start: int, digits: int = 12) -> str:
    """Integer from some hex digits of a hash key; separate digits are independent."""
    return f"CAST(conv(substring({key}, {start}, {digits}), 16, 10) AS BIGINT)"


def hash_int(seed, *cols: str) -> str:
    """Uniform integer below 2**60 from the first 15 hex digits."""
    return hash_slice(hash_key(seed, *cols), 1, 15)
