"""Words of a text and their 64-bit hashes, shared by the operators on word sequences."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
CACHE_ENTRIES = 400_000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, lower-cased; none for null."""
    return WORD.findall(text.lower()) if text else []


class WordHashes:
    """64-bit hashes of words. The cache is emptied when full, so memory stays bounded on any vocabulary."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, found: list[str]) -> list[int]:
        known, out = self.known, []
        for w in found:
            h = known.get(w)
            if h is None:
                if len(known) >= CACHE_ENTRIES:
                    known.clear()
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return out


def mix(h: np.ndarray) -> np.ndarray:
    """Bits of every 64-bit value spread over all places."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str | None], width: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The set of word sequences of ``width`` words of every text, as hashes: (all sets, sorted, one after the other;
    size of each set)."""
    rows = [hashes.of(words(t)) for t in texts]
    lengths = np.array([len(r) for r in rows], np.int64)
    flat = np.fromiter((h for r in rows for h in r), np.uint64, int(lengths.sum()))
    owner = np.repeat(np.arange(len(rows)), lengths)
    if len(flat) < width:
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
    last = len(flat) - width + 1
    h = np.zeros(last, np.uint64)
    for k in range(width):
        h = mix(h + flat[k : last + k] * _MULTIPLIERS[k % len(_MULTIPLIERS)])
    whole = owner[:last] == owner[width - 1 :]
    h, own = h[whole], owner[:last][whole]
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[first], np.bincount(own[first], minlength=len(rows)).astype(np.int64)
