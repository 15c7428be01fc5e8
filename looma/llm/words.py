"""Words of many texts as 64-bit numbers, by array operations over their bytes.

Two words are taken for equal when their hashes are; among n different words two share a hash with probability n^2 / 2^65.
Words of more than LONG bytes are hashed one by one, since a sum of powers is weak for long chosen strings. Memory beside the
texts is bounded by PIECE, however long a text or a word is.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .common import mix

PIECE, LONG = 1 << 20, 256
_BASE = 0xD6E8FEB86659FD93
_tables: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """A number for each byte, and the powers of the base and of its inverse."""
    if not _tables:
        with np.errstate(over="ignore"):
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                row = np.ones(1, np.uint64)
                while len(row) < PIECE:
                    row = np.concatenate([row, row * np.uint64(pow(base, len(row), 1 << 64))])
                _tables.append(row)
        _tables.insert(0, mix(np.arange(256, dtype=np.uint64), 77))
    return _tables


def _pieces(joined: bytes):
    """(start, stop) of stretches of at most PIECE bytes that end at a blank; a longer one is a single word."""
    at, size = 0, len(joined)
    while at < size:
        stop = size
        if size - at > PIECE:
            stop = joined.rfind(b" ", at, at + PIECE)
            if stop < at:
                stop = joined.find(b" ", at)
                stop = size if stop < 0 else stop
            stop = max(stop, at + 1)
        yield at, stop
        at = stop


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the text) of every word of the texts, in order; words are separated by blanks."""
    joined = b" ".join(texts)
    symbol, power, inverse = _powers()
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at, stop in _pieces(joined):
        data = np.frombuffer(joined, np.uint8, stop - at, at)
        if len(data) > PIECE:
            hashes.append(np.array([xxhash.xxh64_intdigest(data.tobytes())], np.uint64))
            places.append(np.array([at]))
            continue
        word = data != 32
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        first, last = edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(symbol[data] * power[: len(data)], out=total[1:])
            h = mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64))
        for i in np.flatnonzero(last - first > LONG).tolist():
            h[i] = xxhash.xxh64_intdigest(data[first[i] : last[i]].tobytes())
        hashes.append(h)
        places.append(first + at)
    place = np.concatenate(places)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]) if texts else np.zeros(1, np.int64)
    return np.concatenate(hashes), (np.searchsorted(starts, place, side="right") - 1).astype(np.int32)
