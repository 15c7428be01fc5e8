"""Benchmark decontamination by latent semantic retrieval.

1. Every task counts in how many of its documents each hashed word is, Spark adds the counts up: the IDF table (fixed size).
2. A randomised SVD of the TF-IDF matrix of the benchmark's passages is computed by Spark: every task sums A^T (A x) over
   its items, the driver only orthogonalises a matrix of fixed size. Rare words weigh most, words in more than
   `COMMON` of all documents weigh nothing here (see 5).
3. Every whole document is read once. Windows of 16, 32, ... words (as long as the longest item) are folded into the
   latent space and compared with all items of a block by cosine; a window whose benchmark words are too little of its
   norm is skipped first, which loses nothing.
4. A candidate is checked on the words around it: the longest common subsequence must cover `LCS` of the item, and
   `ANSWERS` of the item's rarest words must be there; from `SURE` on the subsequence alone is enough. Both allow for
   paraphrases.
5. Items whose copies the windows could miss (their words are frequent, as in a corpus full of copies, so the words around
   them outweigh them; or the latent space keeps little of them) take another path to the same checks: a document is a
   candidate if it holds enough of an item's rarest words that the subsequence can cover `LCS` of it. Nothing is lost.
   Items of fewer than `LEAST_WORDS` words are found by all their words, and must stand in the text as they are.

The benchmark is the stated query set; it is taken in blocks of `ITEMS`, so what goes to the tasks has a fixed bound.
Defined results: null or empty texts of documents or items match nothing;
repeated rows and ids give a row for each match and id; empty tables give no rows; other columns are kept by `clean`.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table
from .words import word_hashes

TERMS, FEATURES, RANK, EXTRA = 1 << 16, 1 << 14, 96, 16
COMMON, LEAST_IDF, COSINE, LCS, SURE, ANSWERS, LEAST_WORDS, ITEMS = 0.3, 0.1, 0.5, 0.6, 0.75, 0.5, 5, 5000
SAFE, LEAST_NORM = 0.6, 0.3
SLICE, CHUNK = 200, 1 << 13


#: ASCII white space becomes a blank, other signs of ASCII go; those beyond it are found by SIGN.
BLANKS = bytes(32 if chr(b).isspace() and b < 128 else b for b in range(256))
DROPPED = bytes(b for b in range(128) if not chr(b).isalnum() and not chr(b).isspace())
SIGN = re.compile(r"[^\w\x00-\x7f]+")


def _plain(text: str | None) -> bytes:
    """The text in lower case, with blanks for white space and without what is neither letter nor digit."""
    text = (text or "").lower()
    if not text.isascii():
        text = SIGN.sub(lambda m: " " if any(map(str.isspace, m[0])) else "", text)
    return text.encode("utf-8", "surrogatepass").translate(BLANKS, DROPPED)


def hashes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the text) of every word of the texts."""
    return word_hashes([_plain(t) for t in texts])


def terms_of(text: str | None) -> list[int]:
    return hashes_of([text])[0].tolist()


def _summed(parts: DataFrame) -> np.ndarray:
    """parts (chunk, values: array of float64 as binary) added up by chunk, in order of chunks. The sum has a fixed size."""

    def add(rows: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.float64) for x in rows.column("values").to_pylist()], axis=0)
        return pa.table({"chunk": rows.column("chunk")[:1], "values": pa.array([total.tobytes()], pa.binary())})

    rows = parts.groupBy("chunk").applyInArrow(add, "chunk long, values binary").collect()
    return np.concatenate([np.frombuffer(r["values"], np.float64) for r in sorted(rows, key=lambda r: r["chunk"])]) if rows else np.zeros(0)


def _in_chunks(x: np.ndarray) -> pa.RecordBatch:
    x = x.ravel()
    at = range(0, len(x), CHUNK)
    return pa.RecordBatch.from_pydict({"chunk": pa.array(range(len(at)), pa.int64()), "values": pa.array([x[i : i + CHUNK].astype(np.float64).tobytes() for i in at], pa.binary())})


def document_counts(docs: DataFrame) -> np.ndarray:
    """For each hashed word the number of documents that hold it; at the end the number of documents. A task counts its own
    documents; Spark adds the tasks' counts up by word."""

    def run(batches):
        total = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                texts = batch.column(0).slice(at, SLICE).to_pylist()
                h, owner = hashes_of(texts)
                seen = np.unique(owner * np.int64(TERMS) + (h % np.uint64(TERMS)).astype(np.int64))
                total += np.bincount(seen % TERMS, minlength=TERMS + 1)
                total[TERMS] += len(texts)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"t": pa.array(some), "n": pa.array(total[some])})

    counts = np.zeros(TERMS + 1)
    for t, n in docs.select("text").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n")).collect():  # TERMS + 1 rows at most
        counts[t] = n
    return counts


def _idf(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The IDF of every hashed word, and the weights of the latent space, in which frequent words are 0."""
    n = counts[TERMS]
    idf = np.log((n + 1) / (counts[:TERMS] + 1))
    idf = np.maximum(idf, LEAST_IDF).astype(np.float32)
    return idf, np.where(counts[:TERMS] > max(COMMON * n, 5), 0, idf)


def _vector(terms: list[int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and TF-IDF weights of a passage, of length one."""
    feature, n = np.unique(np.array([t % FEATURES for t in terms]), return_counts=True)
    weight = np.zeros(FEATURES)
    for t in terms:
        weight[t % FEATURES] = max(weight[t % FEATURES], idf[t % TERMS])
    w = n * weight[feature]
    return feature, w / max(np.linalg.norm(w), 1e-9)


def latent_space(items: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 5) -> np.ndarray:
    """FEATURES x rank: the right singular vectors of the items' TF-IDF matrix, by a randomised SVD with one power step."""
    spark = items.sparkSession
    shared_idf = spark.sparkContext.broadcast(idf)

    def product(x: np.ndarray, gram: bool) -> np.ndarray:
        """A^T (A x) if gram, else (A x)^T (A x)."""
        shared = spark.sparkContext.broadcast(x.astype(np.float32))

        def run(batches):
            x, total = shared.value, None
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    if terms := terms_of(text):
                        if total is None:
                            total = np.zeros(x.shape if gram else (x.shape[1], x.shape[1]))
                        feature, w = _vector(terms, shared_idf.value)
                        y = w @ x[feature]
                        if gram:
                            total[feature] += np.outer(w, y)
                        else:
                            total += np.outer(y, y)
            if total is not None:
                yield _in_chunks(total)

        out = _summed(items.select("text").mapInArrow(run, "chunk long, values binary"))
        shape = x.shape if gram else (x.shape[1], x.shape[1])
        return out.reshape(shape) if len(out) else np.zeros(shape)

    x = np.random.default_rng(seed).normal(size=(FEATURES, rank + EXTRA))
    for _ in range(2):
        x, _ = np.linalg.qr(product(x, True))
    _, turn = np.linalg.eigh(product(x, False))
    return (x @ turn[:, ::-1][:, :rank]).astype(np.float32)


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, a bit for each element of a."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if m := where.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _least_cosine(e: np.ndarray, top: float, longest: int) -> float:
    """A bound of the cosine of an item (squared weights e of its words) and the best window over a copy of it, wherever the
    windows begin and if all words around it have the squared weight top."""
    run, best, size = np.concatenate([[0.0], np.cumsum(e)]), 0.0, 16
    while True:
        step = size // 4
        s = np.arange(-size + 1, len(e) + (-(size + len(e) - 1)) % step)  # whole steps
        a, b = s.clip(0, len(e)), (s + size).clip(0, len(e))
        own = run[b] - run[a]
        c = own / np.sqrt(np.maximum(run[-1] * (own + (size - b + a) * top), 1e-12))
        best = max(best, float(c.reshape(-1, step).max(0).min()))
        if size >= longest:
            return best
        size *= 2


class Searcher:
    """The items of one block, ready for comparison with whole texts.

    A text becomes one number for each word: the place of a benchmark word in the vocabulary, or -1, with the squared weight
    of the word. Everything that follows (windows, subsequences, answers) works on these numbers."""

    def __init__(self, items: list[tuple[int, str]], idf: np.ndarray, weights: np.ndarray, space: np.ndarray):
        self.idf, self.weights, self.space = idf, weights.astype(np.float64) ** 2, space
        own = [(i, terms) for i, t in items if (terms := terms_of(t))]
        self.vocab = np.unique(np.array([h for _, terms in own for h in terms], np.uint64))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.vocab & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.feature = (self.vocab % np.uint64(FEATURES)).astype(np.int64)
        term = (self.vocab % np.uint64(TERMS)).astype(np.int64)
        self.rarity, self.weight = idf[term].astype(np.float64), weights[term].astype(np.float64)
        self.items = [(i, np.searchsorted(self.vocab, np.array(terms, np.uint64)).tolist()) for i, terms in own]
        self.distinct = [set(words) for _, words in self.items]
        rows, self.rare = [], []
        for (_, terms), (_, words) in zip(own, self.items, strict=True):
            feature, w = _vector(terms, weights)
            rows.append(w @ space[feature])
            self.rare.append(set(self._rarest(list(set(words)))[: max(2, len(set(words)) // 4)]))
        latent = np.array(rows, np.float32).reshape(len(rows), space.shape[1])
        norm = np.linalg.norm(latent, axis=1)
        self.latent = (latent / np.maximum(norm, 1e-9)[:, None] ** 2).T  # relative to what the space keeps of the item
        self.longest = max((len(w) for _, w in self.items), default=0)
        top = float(idf.max()) ** 2
        bound = [_least_cosine(self.weight[words] ** 2, top, self.longest) for _, words in self.items]
        long_enough = np.array([len(w) >= LEAST_WORDS for _, w in self.items], bool)
        self.use = long_enough & (norm > LEAST_NORM) & (np.array(bound) >= SAFE)
        self._anchor(long_enough)

    def _rarest(self, words: list[int]) -> list[int]:
        return sorted(words, key=lambda x: (-self.rarity[x], x))

    def _anchor(self, long_enough: np.ndarray) -> None:
        """For the items that windows could miss: which (item, times) hang on a word. A text in which the subsequence covers LCS
        of an item lacks at most 1 - LCS of its words, so it holds at least `need` of the rarest ones taken here. Of a shorter
        item all words must be there."""
        hung: dict[int, dict[int, int]] = {}
        self.need = np.zeros(len(self.items), np.int64)
        for q in np.flatnonzero(~self.use).tolist():
            words = self._rarest(self.items[q][1])
            self.need[q] = max(1, len(words) // 4) if long_enough[q] else len(words)
            for w in words[: len(words) - math.ceil(LCS * len(words)) + int(self.need[q])] if long_enough[q] else words:
                own = hung.setdefault(w, {})
                own[q] = own.get(q, 0) + 1
        self.anchor = np.full(len(self.vocab) + 1, -1, np.int64)  # the last one is for words out of the vocabulary
        self.anchor[list(hung)] = np.arange(len(hung))
        self.anchors = len(hung)
        self.hung = np.array([(q, n) for own in hung.values() for q, n in own.items()], np.int64).reshape(-1, 2)
        self.hung_at = np.concatenate([[0], np.cumsum([len(own) for own in hung.values()])]).astype(np.int64)

    def __call__(self, texts: list[str | None]) -> list[tuple]:
        """(index of the text, item, cosine, share of the common subsequence, share of the rarest words)."""
        if not self.items:
            return []
        h, owner = hashes_of(texts)
        if not len(h):
            return []
        some = np.flatnonzero(self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        place = np.searchsorted(self.vocab, h[some]).clip(0, len(self.vocab) - 1)
        word = np.full(len(h), -1, np.int32)
        word[some] = np.where(self.vocab[place] == h[some], place, -1)
        found = self._search(word, self.weights[(h % np.uint64(TERMS)).astype(np.int64)], owner)
        return sorted(found + self._exact(word, owner)) if self.anchors else found

    def _exact(self, word: np.ndarray, owner: np.ndarray) -> list[tuple]:
        """The items that windows could miss: by their rarest words, then in every region with enough of their words."""
        anchor = self.anchor[word]
        there = np.flatnonzero(anchor >= 0)
        doc, a = np.divmod(np.unique(owner[there].astype(np.int64) * self.anchors + anchor[there]), self.anchors)
        n = self.hung_at[a + 1] - self.hung_at[a]
        at = np.repeat(self.hung_at[a] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pairs, back = np.unique(np.repeat(doc, n) * len(self.items) + self.hung[at, 0], return_inverse=True)
        enough = np.bincount(back, self.hung[at, 1], len(pairs)) >= self.need[pairs % len(self.items)]
        out, last = [], -1
        for doc, q in zip(*(x.tolist() for x in np.divmod(pairs[enough], len(self.items))), strict=True):
            if doc != last:
                low, high = np.searchsorted(owner, [doc, doc + 1])
                text, last = word[low:high], doc
                places = np.flatnonzero(text >= 0)
                inside = text[places]
                counts = np.bincount(inside, minlength=len(self.vocab))
            item, words = self.items[q]
            m = len(words)
            if m < LEAST_WORDS:  # so short that only the same words in the same order count
                match = np.ones(max(0, len(text) - m + 1), bool)
                for k, w in enumerate(words):
                    match &= text[k : len(text) - m + 1 + k] == w
                if match.any():
                    out.append((doc, item, 1.0, 1.0, 1.0))
                continue
            if np.count_nonzero(counts[words]) < LCS * m:
                continue
            mark = np.zeros(len(self.vocab), np.int64)
            mark[words] = 1
            run = np.zeros(len(text) + 1, np.int64)
            run[places + 1] = mark[inside]
            np.cumsum(run, out=run)
            starts = np.arange(0, max(1, len(text) - 2 * m + m // 2), max(1, m // 2))
            stops = np.minimum(starts + 2 * m + m // 2, len(text))
            n = run[stops] - run[starts]
            top = None
            for k in np.argsort(-n, kind="stable").tolist():
                if n[k] < LCS * m or (top and top[0] == 1.0):
                    break
                share, answers = self._checked(q, text[starts[k] : stops[k]], top[0] if top else 0)
                if share and (top is None or (share, answers) > top[:2]):
                    top = (share, answers, int(starts[k]), int(stops[k]))
            if top:
                begins = np.arange(top[2], max(top[2], top[3] - m) + 1)
                b = int(begins[np.argmax(run[np.minimum(begins + m, len(text))] - run[begins])])
                out.append((doc, item, self._cosine(words, text[b : b + m]), top[0], top[1]))
        return out

    def _checked(self, q: int, region: np.ndarray, beat: float) -> tuple[float, float]:
        """Shares of the common subsequence and of the rarest words if the item is in the region (and its subsequence is not
        shorter than `beat`), else zeros."""
        words, region = self.items[q][1], region[region >= 0].tolist()
        there = self.distinct[q].intersection(region)
        if sum(map(there.__contains__, words)) < max(LCS, beat) * len(words):  # no common subsequence can be longer
            return 0.0, 0.0
        answers = len(self.rare[q] & there) / len(self.rare[q])
        share = lcs(words, region) / len(words)
        return (share, answers) if share >= SURE or (share >= LCS and answers >= ANSWERS) else (0.0, 0.0)

    def _cosine(self, words: list[int], region: np.ndarray) -> float:
        """Of the item and the benchmark words of a region, in TF-IDF with the weights of all words."""
        idf = np.maximum(self.weight, LEAST_IDF)
        a = np.bincount(words, minlength=len(idf)) * idf
        b = np.bincount(region[region >= 0], minlength=len(idf)) * idf
        return min(1.0, float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-9)))

    def _search(self, word: np.ndarray, mass: np.ndarray, owner: np.ndarray) -> list[tuple]:
        """All texts of a slice at once; windows end where their text does."""
        n = len(word)
        if not n:
            return []
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        stop = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
        known = (word >= 0) & (mass > 0)
        total = np.concatenate([[0], np.cumsum(mass)])
        own = np.concatenate([[0], np.cumsum(np.where(known, mass, 0))])
        spans = []

        def add(starts: np.ndarray, size: int) -> None:
            """The windows from these starts whose benchmark words are enough of their norm for the cosine."""
            starts = starts[own[np.minimum(starts + size, n)] > own[starts]]
            ends = np.minimum(starts + size, stop[starts])
            norm2 = total[ends] - total[starts]
            keep = (norm2 > 1e-9) & (own[ends] - own[starts] >= COSINE**2 * norm2)
            spans.append(np.stack([starts[keep], ends[keep]]))

        size = 16
        while True:
            add(np.arange(0, n, size // 4), size)
            if size >= self.longest:
                break
            size *= 2
        add(first, max(16, self.longest))  # short texts begin between the places above: each text is a window of its own
        starts, ends = np.concatenate(spans, 1)
        if not len(starts):
            return []
        cover = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
        at = np.flatnonzero(known & (np.cumsum(cover[:-1]) > 0))
        run = np.zeros((len(at) + 1, self.space.shape[1]), np.float32)
        np.cumsum(self.space[self.feature[word[at]]] * self.weight[word[at], None].astype(np.float32), axis=0, out=run[1:])
        best: dict[tuple[int, int], list] = {}
        for b in range(0, len(starts), 8192):
            s, e = starts[b : b + 8192], ends[b : b + 8192]
            latent = (run[np.searchsorted(at, e)] - run[np.searchsorted(at, s)]) / np.sqrt(total[e] - total[s])[:, None].astype(np.float32)
            cosine = latent @ self.latent
            for w, q in zip(*np.nonzero((cosine >= COSINE) & self.use), strict=True):
                best.setdefault((int(owner[s[w]]), int(q)), []).append((float(cosine[w, q]), int(s[w]), int(e[w])))
        out = []
        for (doc, q), found in sorted(best.items()):
            low, high = np.searchsorted(owner, [doc, doc + 1]).tolist()
            item, m, top, tried = self.items[q][0], len(self.items[q][1]), None, set()
            for c, s, e in sorted(found, reverse=True):
                mid = (s + e) // 2
                if any(abs(mid - x) <= m // 2 for x in tried):
                    continue
                tried.add(mid)
                share, answers = self._checked(q, word[max(low, mid - m - m // 4) : min(high, mid + m + m // 4)], top[0] if top else 0)
                if share:
                    top = max(top or (0, 0, 0), (share, answers, c))
            if top:
                out.append((doc, item, min(1.0, top[2]), top[0], top[1]))
        return out


def _blocks(benchmark: DataFrame, docs: DataFrame):
    """Searcher parts (items, idf, weights, space) of each block of ITEMS items, in order of ids."""
    idf, weights = _idf(document_counts(docs))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    last = None
    while True:
        rest = items if last is None else items.where(F.col("item_id") > last)
        ids = [r[0] for r in rest.select("item_id").distinct().orderBy("item_id").limit(ITEMS).collect()]
        if not ids:
            return
        own = rest.where(F.col("item_id") <= ids[-1])
        yield [(r[0], r[1]) for r in own.collect()], idf, weights, latent_space(own, weights)
        last = ids[-1]


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answers: every document that holds an item, with the item."""
    spark, schema = docs.sparkSession, "doc_id long, item_id long, cosine double, lcs double, answers double"
    out = None
    for block in _blocks(benchmark, docs):
        shared = spark.sparkContext.broadcast(block)

        def make(shared=shared):
            search = Searcher(*shared.value)

            def run(batch: pa.RecordBatch) -> dict:
                hits = search(batch.column(1).to_pylist())
                doc = batch.column(0).to_pylist()
                return {"doc_id": pa.array([doc[h[0]] for h in hits], pa.int64()), "item_id": pa.array([h[1] for h in hits], pa.int64())} | {c: pa.array([round(h[k], 6) for h in hits], pa.float64()) for k, c in ((2, "cosine"), (3, "lcs"), (4, "answers"))}

            return run

        part = map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), make, schema, SLICE)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold an item of the benchmark; columns stay as they are."""
    where = docs.columns.index("text")
    out = docs
    for block in _blocks(benchmark, docs):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            search = Searcher(*shared.value)
            for batch in batches:
                for i in range(0, batch.num_rows, SLICE):
                    part = batch.slice(i, SLICE)
                    hit = {h[0] for h in search(part.column(where).to_pylist())}
                    yield part.filter(pa.array([k not in hit for k in range(part.num_rows)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
