"""Word shingles as 64-bit numbers, by array operations over many texts at once."""

from __future__ import annotations

import numpy as np

from .common import mix
from .words import word_hashes

WORDS = 5
_P = np.uint64(0x9FB21C651E98DF25)
#: A-Z in lower case, ASCII white space as blanks.
PLAIN = bytes(32 if b in b"\t\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Shingler:
    """texts -> for each text its distinct shingles of WORDS words (all words as one shingle where there are fewer).

    Words are stretches without ASCII white space, A-Z in lower case. Two shingles are taken for equal when their 64-bit
    hashes are; among n shingles two different ones share a hash with probability n^2 / 2^65.
    """

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(shingles of all texts, number of each text's shingles); those of one text are sorted and distinct."""
        h, owner = word_hashes([(t or "").encode("utf-8", "surrogatepass").translate(PLAIN) for t in texts])
        n = np.bincount(owner, minlength=len(texts))
        starts = np.cumsum(n) - n
        with np.errstate(over="ignore"):
            rolled = np.zeros(max(len(h) - WORDS + 1, 0), np.uint64)
            for k in range(WORDS):
                rolled = rolled * _P + mix(h[k : k + len(rolled)], k)
            whole = owner[: len(rolled)] == owner[WORDS - 1 :] if len(rolled) else np.zeros(0, bool)
            values, owners = [mix(rolled[whole], 9)], [owner[: len(rolled)][whole]]
            for i in np.flatnonzero((n < WORDS) & (n > 0)):
                x = np.uint64(n[i])
                for v in h[starts[i] : starts[i] + n[i]]:
                    x = x * _P + v
                values.append(mix(np.array([x], np.uint64), 10))
                owners.append(np.array([i]))
        value, owner = np.concatenate(values), np.concatenate(owners)
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        first = np.ones(len(value), bool)
        first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        return value[first], np.bincount(owner[first], minlength=len(n))
