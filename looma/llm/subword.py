"""Character n-grams of many words at once, hashed to buckets by array operations."""

from __future__ import annotations

import re
from itertools import chain, repeat

import numpy as np

from .common import mix

NOT_WORD = re.compile(r"[\W_]+")


def core(chunk: str) -> str:
    """A stretch between white space, without what is neither letter nor digit."""
    return chunk if chunk.isalnum() else NOT_WORD.sub("", chunk)


def grams(words: list[str], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the word) of every n-gram of every word; ends of words are marked by < and >."""
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) + 2 for w in words])
    found, owners, h = [], [], codes
    with np.errstate(over="ignore"):
        for n in range(1, max(sizes) + 1):
            if n > 1:
                h = h[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
            if n in sizes:
                whole = owner[: len(h)] == owner[n - 1 :]
                found.append((mix(h[whole], n) & np.uint64(buckets - 1)).astype(np.int32))
                owners.append(owner[: len(h)][whole])
    return np.concatenate(found), np.concatenate(owners)


class WordValues:
    """Rows of numbers for words, computed in bulk for the words not met before; holds `limit` words at most between calls."""

    def __init__(self, compute, width: int, limit: int = 250_000):
        self.compute, self.width, self.limit = compute, width, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows, self.used = np.zeros((1024, self.width)), 0

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each list of white-space separated stretches, the indexes of their rows in self.rows."""
        if self.used > self.limit:
            self.clear()
        index, flat = self.index, list(chain.from_iterable(texts))
        ids = np.fromiter(map(index.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(ids < 0).tolist()
        if missing:
            new = sorted({flat[i] for i in missing})
            while self.used + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.used : self.used + len(new)] = self.compute(new)
            index.update(zip(new, range(self.used, self.used + len(new)), strict=True))
            self.used += len(new)
            ids[missing] = [index[flat[i]] for i in missing]
        ends = np.cumsum([len(t) for t in texts]).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]
