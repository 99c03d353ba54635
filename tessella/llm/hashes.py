"""64-bit hashes of words, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np

P = np.uint64(0x9E3779B97F4A7C15)
P_INVERSE = np.uint64(pow(int(P), -1, 2**64))
MULTIPLIERS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that are not ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: ASCII letters and whatever is not ASCII.
LETTERS = np.r_[np.zeros(128, bool), np.ones(128, bool)]
LETTERS[[*range(65, 91), *range(97, 123)]] = True
_powers: list[np.ndarray] = []


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of P and of its inverse, n at least."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.r_[np.uint64(1), np.multiply.accumulate(np.full(n, p))] for p in (P, P_INVERSE)]
    return _powers


def word_hashes(batch: list[str], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all texts, and at which word each text begins, with the end at last. Words are runs of
    bytes that are `inside`, none of which may be a blank; A-Z is lower-cased."""
    raw = [t.encode() for t in batch]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends_at = np.cumsum([len(r) + 1 for r in raw])
    up, down = _power_tables(len(data))
    sums = np.r_[np.uint64(0), np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)])]
    edge = np.flatnonzero(np.diff(np.r_[False, inside[data]]))
    start, end = edge[::2], edge[1::2]
    hashes = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, np.r_[0, ends_at])
