"""Words and hashed word runs of whole texts, vectorised over batches."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Runs of letters or digits of any script, after lower-casing.
WORD = re.compile(r"[^\W_]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class _Hashes(dict):
    """Word hashes, kept while they fit: the length of the word in the first bits, so that the greatest is a longest word."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[w] = (min(len(w), 31) << 59) | (xxhash.xxh64_intdigest(w) >> 5)
        return h


_HASHES = _Hashes()


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a batch, one after another, and the bounds of each text in them."""
    get = _HASHES.__getitem__
    each = [np.fromiter(map(get, WORD.findall(t.lower())), np.uint64) if t else np.empty(0, np.uint64) for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in each])]).astype(np.int64)
    return np.concatenate(each) if each else np.empty(0, np.uint64), bounds


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 positions have none."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix(out * _MUL + h[k : len(h) - n + 1 + k])
    return out


#: Bits of a run's hash beside its text's number in one sortable word; the first of them are those of its longest word.
RUN_BITS, CLASS_BITS = 50, 14


def shingles(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of n words per text as hashes of RUN_BITS bits: (text number, hash), sorted by both; fewer than 2 ** 14 texts.

    A hash begins with the class of the run's longest word, which neighbouring runs share."""
    runs = run_hashes(h, n)
    if len(runs):
        longest = h[: len(runs)]
        for k in range(1, n):
            longest = np.maximum(longest, h[k : k + len(runs)])
        with np.errstate(over="ignore"):
            runs = (mix(longest) >> np.uint64(64 - CLASS_BITS) << np.uint64(64 - CLASS_BITS)) | (runs >> np.uint64(CLASS_BITS))
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(runs)]
    if not len(runs):
        return owner, runs
    inside = np.arange(len(runs)) + n <= bounds[owner + 1]
    both = np.sort((owner[inside].astype(np.uint64) << np.uint64(RUN_BITS)) | (runs[inside] >> np.uint64(64 - RUN_BITS)))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    return (both >> np.uint64(RUN_BITS)).astype(np.int64), both & np.uint64((1 << RUN_BITS) - 1)
