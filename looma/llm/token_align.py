"""Alignment of two tokenizers' tokens, for every document of a corpus: A is a byte-level vocabulary, B one of pieces.

Merging in lockstep: the documents of a batch lie one after the other in two arrays of byte ends, and one NumPy vector holds
every document's place in A's tokens, another its place in B's. A step compares both ends of all documents at once and advances
the side that is behind, or both where the ends meet: that is a cut, which closes a group of tokens and gives its links. Documents
that are through leave the vectors. Long documents enter as stretches that begin where both tokenizers begin a token, so that the
vectors stay long and steps few; what is written is the documents' own.

What is counted over the corpus stays with blocks of documents. A task writes for each block its documents' distinct linked pairs as
places in the block's own dictionary of pairs; dictionaries are counted by pair, and the counts go back to their blocks. So a pair
that all documents hold travels once a block, and no text and no document's list of pairs is shuffled twice.

Texts are cut before each space that follows something else than white space: neither vocabulary has a token across such a place,
so a bounded cache gives the tokens of every piece met before (tested against whole texts).

Defined results: texts that are null, empty, or whose tokens of A or B do not give back the space and the text have no tokens: all
numbers are 0 and the digest is ''. Rows with a null id and rows that repeat an id are documents of their own, also in the counts;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import byte_chars
from .common import table, written

#: Characters of text of a batch, of a block at most (a longer text is a block of its own), tokens of a stretch at least, pieces of
#: text in the cache, characters of a short piece, and pairs of a group that are written out before they are counted.
BATCH, BLOCK, STRETCH, KNOWN, SHORT, SPREAD = 1 << 19, 1 << 22, 256, 200_000, 500, 64
# Fixed value: A's pattern of words.
ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
CUT = re.compile(r"(?<=\S)(?= )")


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def pieces(text: str) -> list[str]:
    """The text cut before each space that follows something else than white space."""
    return CUT.split(text)


class Tokens:
    """Tokens of pieces of text under both vocabularies, kept as rows of growing arrays."""

    def __init__(self, path_a: str, path_b: str, limit: int = KNOWN):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        self.a, self.b, self.limit = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b), limit
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte = {c: b for b, c in enumerate(byte_chars())}
        names = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(byte[c] for c in name)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.long = [np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b)]
        # no token of B may reach over the places where texts are cut; A's pattern has none
        self.whole = any(" " in x.lstrip(b" ").decode(errors="replace") for x in self.bytes_b)
        # short pieces of ASCII take the same merges (ids rise with ranks) from a library that is quicker with them
        added = {t["id"] for t in spec["added_tokens"]}
        self.ascii = tiktoken.Encoding("a", pat_str=ASCII, mergeable_ranks={x: i for i, x in enumerate(self.bytes_a) if i not in added}, special_tokens={}).encode_ordinary
        self.blank = [self.b.piece_to_id("▁")]  # what B makes of a space alone
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.fits = np.zeros(0, bool)
        #: of each vocabulary: tokens of all pieces, the first and the number of those of each piece
        self.pools = [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(2)]

    def learn(self, new: list[str]) -> None:
        """Tokens of pieces that are not known; all begin with a space, which B adds by itself."""
        size = np.array([len(p) if p.isascii() else len(p.encode()) for p in new])
        whole, fits = "".join(new).encode(), np.ones(len(new), bool)
        for k, (names, long) in enumerate(zip((self.bytes_a, self.bytes_b), self.long, strict=True)):
            if k:
                found = [x or self.blank for x in self.b.encode([p[1:] for p in new], num_threads=1)]
            else:
                other = [p for p in new if len(p) > SHORT or not p.isascii()]
                slow = iter(self.a.encode_batch_fast(other, add_special_tokens=False))
                found = [self.ascii(p) if len(p) <= SHORT and p.isascii() else next(slow).ids for p in new]
            n = np.array(list(map(len, found)), np.int64)
            ids = np.fromiter(chain.from_iterable(found), np.int32, int(n.sum()))
            first = np.cumsum(n) - n
            same = np.add.reduceat(long[ids], first) == size
            if k and (not same.all() or b"".join(map(names.__getitem__, ids.tolist())) != whole):  # A's tokens spell bytes, so their number tells
                same = np.array([b"".join(map(names.__getitem__, x)) == p.encode() for x, p in zip(found, new, strict=True)])
            fits &= same
            pool, start, count = self.pools[k]
            self.pools[k] = np.concatenate([pool, ids]), np.concatenate([start, first + len(pool)]), np.concatenate([count, n])
        self.place |= zip(new, range(len(self.fits), len(self.fits) + len(new)), strict=True)
        self.fits = np.concatenate([self.fits, fits])

    def encode(self, texts: list[str | None]):
        """(ids, ends, first token of each stretch) for A and for B, and the document of each stretch, of the texts that have tokens."""
        cut = [([" " + t] if self.whole else pieces(" " + t)) if t else [] for t in texts]
        if len(self.fits) > self.limit:
            self.clear()
        new = list({p for c in cut for p in c if p not in self.place})
        for i in range(0, len(new), 20_000):
            self.learn(new[i : i + 20_000])
        which = [np.fromiter(map(self.place.__getitem__, c), np.int64, len(c)) for c in cut]
        which = [w if self.fits[w].all() else w[:0] for w in which]
        doc = np.repeat(np.arange(len(texts)), [len(w) for w in which])
        which = np.concatenate([*which, np.zeros(0, np.int64)])
        out = []
        for (pool, start, count), long in zip(self.pools, self.long, strict=True):
            n = count[which]
            first = np.cumsum(n) - n
            ids = pool[np.repeat(start[which] - first, n) + np.arange(n.sum())]
            out.append((ids, np.cumsum(long[ids]), first))
        # a stretch starts at a document's first piece, or at the first piece after so many tokens of it
        lead = out[0][2]
        begin = np.flatnonzero(np.diff(doc, prepend=-1))
        within = lead - lead[begin][np.cumsum(np.diff(doc, prepend=-1) != 0) - 1] if len(doc) else lead
        step = np.flatnonzero((np.diff(within // STRETCH, prepend=0) != 0) | (np.diff(doc, prepend=-1) != 0))
        return tuple((ids, ends, first[step]) for ids, ends, first in out), doc[step]


def lockstep(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """a and b: (ids, ends, first token of each stretch); ends rise over the whole batch. -> for every group, in order, its last
    token of A and its last token of B."""
    (_, x, at), (_, y, bt) = a, b
    stop = np.append(at[1:], len(x))
    i, j = at.copy(), bt.copy()
    last_a, last_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(i):
        p, q = x[i], y[j]
        cut = p == q
        if cut.any():
            last_a.append(i[cut])
            last_b.append(j[cut])
        i = i + (p <= q)
        j = j + (q <= p)
        left = i < stop
        if not left.all():  # what is through goes
            i, j, stop = i[left], j[left], stop[left]
    last_a, last_b = np.concatenate(last_a), np.concatenate(last_b)
    order = np.argsort(last_a, kind="stable")
    return last_a[order], last_b[order]


def linked(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, doc: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, pair) in order and how many links each has: doc, a * wide + b, links. doc is that of each group."""
    na, nb = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    first_a, first_b, n = last_a + 1 - na, last_b + 1 - nb, na * nb
    small = np.flatnonzero(n <= SPREAD)
    group = np.repeat(small, n[small])
    r = np.arange(len(group)) - np.repeat(np.cumsum(n[small]) - n[small], n[small])
    i, j = first_a[group] + r // nb[group], first_b[group] + r % nb[group]
    pair = a[i].astype(np.int64) * wide + b[j]
    docs, pairs, times = [doc[group]], [pair], [np.ones(len(pair), np.int64)]
    for g in np.flatnonzero(n > SPREAD).tolist():  # rare: a long stretch without a common end; its ids are counted, not its links
        ua, ca = np.unique(a[first_a[g] : last_a[g] + 1], return_counts=True)
        ub, cb = np.unique(b[first_b[g] : last_b[g] + 1], return_counts=True)
        pairs.append((ua[:, None].astype(np.int64) * wide + ub[None, :]).ravel())
        times.append((ca[:, None] * cb[None, :]).ravel())
        docs.append(np.full(len(pairs[-1]), doc[g]))
    docs, pairs, times = np.concatenate(docs), np.concatenate(pairs), np.concatenate(times)
    if not len(docs):
        return docs, pairs, times
    key = docs.astype(np.int64) * (int(pairs.max()) + 1) + pairs  # documents of a batch times pairs of ids: far below 2^63
    if len(times) == len(group):
        key = np.sort(key)
        head = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.diff(head, append=len(key))
    else:
        order = np.argsort(key)
        key = key[order]
        head = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.add.reduceat(times[order], head)
    docs, pairs = np.divmod(key[head], int(pairs.max()) + 1)
    return docs, pairs, times


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to size - 1, from the left, with one place more; and how many."""
    names = [str(i).encode() for i in range(size)]
    wide = len(names[-1]) + 1
    return np.frombuffer(b"".join(n.ljust(wide, b"\0") for n in names), np.uint8).reshape(size, wide), np.array([len(n) for n in names])


def group_texts(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, doc: np.ndarray, n_docs: int, digits: tuple) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each document."""
    na, nb = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    end = last_a + last_b + 1  # the place of a group's last token among the tokens of both, groups in order, A before B
    ids = np.empty(len(a) + len(b), np.int64)
    ids[np.arange(len(a)) + np.repeat(last_b + 1 - nb, na)] = a
    ids[np.arange(len(b)) + np.repeat(last_a + 1, nb)] = b
    mark = np.full(len(ids), ord(","), np.uint8)
    mark[end - nb] = ord("|")
    mark[end] = ord(";")
    table_, size = digits
    n = size[ids]
    rows = table_[ids]
    rows[np.arange(len(ids)), n] = mark
    data = rows[np.arange(rows.shape[1])[None, :] <= n[:, None]].tobytes()
    stop = np.cumsum(n + 1)
    last = np.flatnonzero(np.diff(doc, append=-1))  # the last group of each document that has one
    out, at = [b""] * n_docs, 0
    for d, e in zip(doc[last].tolist(), stop[end[last]].tolist() if len(last) else [], strict=True):
        out[d] = data[at : e - 1]
        at = e
    return out


def _packed(x: np.ndarray) -> bytes:
    """Numbers compressed by the planes of their bytes."""
    return pa.compress(x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").ravel()


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_BLOCKS = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, n_pairs array<int>, places binary, times binary, pairs array<long>, n_docs array<int>"


def _blocks(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """A row for each block of documents: their numbers and digests, and their distinct pairs as places in the block's pairs."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, bool]]:
        """(ids, texts, whether a block ends) of at most BATCH characters, but for a longer text."""
        ids, texts, size, block = [], [], 0, 0
        for batch in rows:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py()
                if texts and size + len(t or "") > BATCH:
                    block += size
                    yield ids, texts, block >= BLOCK
                    block = 0 if block >= BLOCK else block
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t or "") + 100
        if texts:
            yield ids, texts, True

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # lists of tokens come and go by the million and hold no cycles
        try:
            yield from blocks(rows)
        finally:
            gc.enable()
            gc.collect()
            pa.default_memory_pool().release_unused()

    def blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(*paths)
        wide = len(tokens.bytes_b)
        digits = _digits(max(len(tokens.bytes_a), wide))
        own, block = [], TaskContext.get().partitionId() << 32
        for ids, texts, ends in batches(rows):
            (a, b), doc = tokens.encode(texts)
            last_a, last_b = lockstep(a, b)
            of_group = doc[np.searchsorted(a[2], last_a, side="right") - 1] if len(last_a) else last_a
            n = len(texts)
            count = lambda weight: np.bincount(of_group, weight, minlength=n).astype(np.int64)  # noqa: E731, B023 (sums below 2^53 are exact)
            na, nb = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
            d, pair, times = linked(a[0], b[0], last_a, last_b, of_group, wide)
            digests = [hashlib.sha256(t).hexdigest() if t else "" for t in group_texts(a[0], b[0], last_a, last_b, of_group, n, digits)]
            own.append((ids, count(na), count(nb), count(np.ones(len(na))), count(na * nb), digests, np.bincount(d, minlength=n), pair, times))
            if ends:
                pairs = np.concatenate([o[7] for o in own])
                named, place, held = np.unique(pairs, return_inverse=True, return_counts=True)
                n_pairs = np.concatenate([o[6] for o in own])
                step = np.diff(place, prepend=0)
                if len(place):  # a document's pairs rise, so steps between them are small
                    first = (np.cumsum(n_pairs) - n_pairs)[n_pairs > 0]
                    step[first] = place[first]
                many = lambda i: [np.concatenate([o[i] for o in own])]
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([block], pa.int64()), "doc_id": pa.array([[i for o in own for i in o[0]]], pa.list_(pa.int64())),
                    **{c: pa.array(many(k), pa.list_(pa.int64())) for k, c in enumerate(NUMBERS, 1)}, "groups_sha256": pa.array([[s for o in own for s in o[5]]], pa.list_(pa.string())),
                    "n_pairs": pa.array([n_pairs.astype(np.int32)], pa.list_(pa.int32())), "places": pa.array([_packed(step)], pa.binary()), "times": pa.array([_packed(np.concatenate([o[8] for o in own]))], pa.binary()),
                    "pairs": pa.array([named // wide << 32 | named % wide], pa.list_(pa.int64())), "n_docs": pa.array([held.astype(np.int32)], pa.list_(pa.int32())),
                })
                own, block = [], block + 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BLOCKS)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Texts go to Python in batches of so many rows while this holds: for jobs that run within it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair (A id * 2^32 + B id), held (documents that hold it linked), best (1 where no pair of its A id is held by more)."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("p"))
    counts = each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.n_docs").alias("held"))
    most = F.max("held").over(W.partitionBy(F.shiftright("pair", 32)))  # over the pairs of one A id: no more than B has pieces
    return counts.select("pair", "held", (F.col("held") == most).cast("int").alias("best"))


def align(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    with small_batches(docs.sparkSession):
        blocks = written(_blocks(docs, paths or vocabularies()), "token-blocks")
    counts = written(pair_counts(blocks), "token-pairs")
    back = blocks.select(F.col("block").alias("of"), F.explode("pairs").alias("pair")).join(counts.hint("shuffle_hash"), "pair")  # a row a pair: their number is bounded by the vocabularies

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        """One block and the counts of its pairs."""
        row = {c: own.column(c)[0] for c in own.column_names}
        place = np.argsort(found.column("pair").to_numpy())  # all of the block's pairs, in their order
        held, best = (found.column(c).to_numpy()[place] for c in ("held", "best"))
        n_pairs = row["n_pairs"].values.to_numpy()
        total = int(n_pairs.sum())
        doc = np.repeat(np.arange(len(n_pairs)), n_pairs)
        at, times = (_unpacked(row[c].as_py(), total) for c in ("places", "times"))
        at = np.cumsum(at)
        first = np.cumsum(n_pairs) - n_pairs
        at = at - np.repeat(np.where(first > 0, at[np.maximum(first - 1, 0)], 0) if total else first, n_pairs)  # steps begin anew in each document
        sums = [np.zeros(len(n_pairs), np.int64) for _ in range(2)]
        for out, weight in zip(sums, (best, held), strict=True):
            np.add.at(out, doc, times * weight[at])
        return pa.table({"doc_id": row["doc_id"].values, **{c: row[c].values for c in NUMBERS}, "n_best": sums[0], "count_sum": sums[1], "groups_sha256": row["groups_sha256"].values})

    return blocks.drop("pairs", "n_docs").groupBy("block").cogroup(back.groupBy("of")).applyInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
