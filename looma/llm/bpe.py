"""BPE encoding and decoding with a public vocabulary, exactly as the tokenizers library does it.

A text is cut at the vocabulary's added tokens, normalised (NFC, white space, lower case), cut into words, and each word
is merged over a contiguous rank array: part boundaries and the ranks of adjacent parts lie in two lists; the smallest rank
is searched by a scan, its right boundary deleted, and the two neighbouring ranks are looked up anew. Words of more than
`SHORT` parts would make that scan quadratic, so they take the same merges from a heap.

Tasks are independent (no shuffle); the vocabulary has a fixed size, and a bounded cache holds the words met lately.
Letters, numbers and lower case are those of Python's Unicode tables (15.1) and what the library's newer tables add. Decoding
starts from the ids.
Defined results: a null text counts as empty (no ids, empty decoded text). Repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Cache, class_of, map_batches, table

SHORT = 128
# The vocabulary's word pattern (L letters, N numbers; it meets no white space) and the characters that count as
# white space.
WORD = "'s|'t|'re|'ve|'m|'ll|'d|[L]+|[N]|[^LN]+"
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
# Letters, numbers and lower-case forms of the Unicode versions after 15.1 that the library knows (letters and
# numbers of 16.0, lower case of 17.0).
LATER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
LATER_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
LATER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LATER_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
NOT_SPACE = re.compile("[\x1c-\x1f]")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file (kind: BPE with word ends)."""

    def __init__(self, path: str, limit: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids, self.end = model["vocab"], model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*self.ids.items(), *self.added.items()]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.chars = byte_chars()
        later = {"L": LATER_LETTERS, "N": LATER_NUMBERS}
        kinds = {k: class_of(k) + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in later[k]) for k in "LN"}
        self.words = re.compile("".join(kinds.get(c, c) for c in WORD))
        self.chunks, self.known = Cache(self._chunk, limit), Cache(self._word, limit)

    def merge(self, parts: list[str]) -> list[str]:
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def _scan(self, parts: list[str]) -> list[str]:
        get, none = self.ranks.get, len(self.ranks)
        ranks = [get(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            parts[i] += parts[i + 1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
        return parts

    def _heap(self, parts: list[str]) -> list[str]:
        get, n = self.ranks.get, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != left or parts[j] != right:
                continue
            parts[i], parts[j], after[i] = left + right, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p in parts if p is not None]

    def word(self, word: str) -> list[str]:
        parts = [self.chars[b] for b in word.encode()]
        parts[-1] += self.end
        return self.merge(parts)

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a stretch without white space; no word reaches over white space."""
        if chunk.isalpha() and chunk.isascii():
            return self.known[chunk]
        if not chunk.isascii():
            chunk = chunk.translate(LATER_LOWER)
        return b"".join([self.known[w] for w in self.words.findall(chunk)])

    def _word(self, word: str) -> bytes:
        tokens = self.word(word)
        return struct.pack(f"<{len(tokens)}I", *map(self.ids.__getitem__, tokens))

    def _plain(self, text: str) -> list[bytes]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if NOT_SPACE.search(text):  # str.split() takes them for white space, the vocabulary's pattern does not
            pieces = [p for p in SPACE.split(text.replace("Σ", "σ").lower()) if p]
        else:
            pieces = text.replace("Σ", "σ").lower().split()
        return list(map(self.chunks.__getitem__, pieces))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.cut is None or not any(t in text for t in self.added):
            found = self._plain(text)
        else:
            found = []
            for piece in self.cut.split(text):
                if piece in self.added:
                    found.append(struct.pack("<I", self.added[piece]))
                elif piece:
                    found += self._plain(piece)
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        """The text of ids; those that the vocabulary does not have are left out."""
        return " ".join([t for t in map(self.names.get, np.frombuffer(ids, "<u4").tolist()) if t is not None])


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (binary), decoded, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return _encoded(docs, path, True)


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """As encode_texts, without ids and decoded text."""
    return _encoded(docs, path, False)


def _encoded(docs: DataFrame, path: str | None, whole: bool) -> DataFrame:
    path = path or vocabulary()

    def make():
        codec = Codec(path)

        def run(batch: pa.RecordBatch) -> dict:
            ids = [codec.encode(t) for t in batch.column(1).to_pylist()]
            texts = map(codec.decode, ids)
            out = {"doc_id": batch.column(0), "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64())}
            if whole:
                texts = list(texts)
                out |= {"ids": pa.array(ids, pa.binary()), "decoded": pa.array(texts, pa.string())}
            out["ids_sha256"] = pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string())
            out["decoded_sha256"] = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())
            return out

        return run

    more = "ids binary, decoded string, " if whole else ""
    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), make, f"doc_id long, n_tokens long, {more}ids_sha256 string, decoded_sha256 string", 500)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))
