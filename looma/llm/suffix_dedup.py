"""Removal of repeated byte strings: every byte that a 100-byte string covers which also starts earlier goes.

The named method, matching statistics over a run-length index of all text, visits every byte through an index that is
shared by all; here each repeated string is instead brought together in one bucket by its content (see the README):

1. In every 100-byte window the K-byte string with the least hash is its anchor, so equal windows have equal anchors.
   About one byte in thirty starts an anchor. Tasks deal the documents' anchors out to buckets by hash, packed as arrays;
   a bucket sends back those that are in two or more documents.
2. Documents meet their list by a join on the id. For every anchor that is repeated (in another document or in the same
   one) the stretch of windows that have it as anchor goes to the anchor's bucket; of equal stretches in one batch only
   the first goes on, the others are known to be repeats.
3. A bucket groups all windows of its stretches by a 64-bit hash and compares their bytes; whatever is not the first is a
   repeat.
4. The repeats' places meet the documents by a join on the id.

Counts cover all documents; matches never cross documents. Memory of a task is bounded by the bucket size, which is planned
from the number of bytes. Defined results: null and empty texts and those under 100 bytes keep all; rows with a null id are
left out; rows that repeat an id are judged each, none of them being earlier than another; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, partitions, table, written
from .ngram_join import gathered, pack, repeated

LENGTH, K = 100, 40
#: Bytes of stretches in a bucket, as planned from the number of bytes of all texts (about a quarter of them repeat); bytes
#: and known repeats that a task holds before it passes them on; documents it unpacks at once.

BUCKET_BYTES, HELD_BYTES, HELD_KNOWN, SLICE = 250_000, 6_000_000, 100_000, 200
EVERY = b"*"
_P = 0xD6E8FEB86659FD93
_INV = pow(_P, -1, 1 << 64)
_POWERS: dict[int, list[np.ndarray]] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.setdefault(base, [np.ones(1, np.uint64)])[0]
    with np.errstate(over="ignore"):
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _POWERS[base][0] = have
    return have[:n]


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place on, equal for equal strings."""
    n = len(data)
    if n < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_P, n), out=total[1:])
        return mix((total[k:] - total[:-k]) * _powers(_INV, n - k + 1), k)


def _sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (minimum or maximum) over every w neighbours."""
    done, out = 1, x
    while done < w:
        step = min(done, w - done)
        out = f(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window, hash) of every anchor: a window's anchor is the first least-hash K-gram in it."""
    h = rolling(data, K)
    w = LENGTH - K + 1
    if len(h) < w:
        none = np.zeros(0, np.int64)
        return none, none, none, h[:0]
    low = _sliding(h, w, np.minimum)
    # candidates are the places that are least in some window; the first of them in each window is its anchor
    padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    least = np.flatnonzero(h == _sliding(padded, w, np.maximum))
    value = h[least]
    first = np.arange(len(low))
    at = np.searchsorted(least, first)  # first candidate not before the window's start; step on while it isn't the least
    while True:
        wrong = value[at] != low
        if not wrong.any():
            break
        at[wrong] += 1
    place, start = np.unique(at, return_index=True)
    end = np.append(start[1:], len(low)) - 1
    return least[place], start, end, value[place]


class AnchorSets:
    """texts -> the distinct anchor hashes of each text, sorted, and how many."""

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for t in texts:
            found.append(np.unique(anchors(np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8))[3]))
        return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.array([len(f) for f in found], np.int64)


def _shared(rows: pa.Table) -> pa.Table:
    """Of one block of documents: id, key and the anchors that other documents hold too. Documents of the block that have all
    their anchors in common get EVERY instead."""
    doc, n, whole, o, v, _ = gathered(rows)
    order = np.argsort(o, kind="stable")
    o, v = o[order], v[order]
    cuts = np.searchsorted(o, np.arange(len(n) + 1))
    _, back, often = np.unique(whole, return_inverse=True, return_counts=True)
    alike = (often[back] > 1) & (n > 0)
    some = np.flatnonzero((np.diff(cuts) > 0) | alike)
    return pa.table({"doc_id": pa.array(doc[some]), "anchors": pa.array([EVERY if alike[i] else v[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary())})


def _stretches(joined: DataFrame, buckets: int) -> DataFrame:
    """bucket, at (id, row, first window, windows of every stretch), data (bytes one after another); bucket -1: repeats known
    already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: dict, known: list) -> pa.RecordBatch:
            rows: dict[int, list] = {}
            for key, at in held.items():
                rows.setdefault(key[0], []).append((at, key[2]))
            packed = [(b, [x for x, _ in own], b"".join(x for _, x in own)) for b, own in rows.items()]
            if known:
                packed.append((-1, known, b""))
            return pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in packed], pa.int64()), "at": pa.array([np.array(r[1], np.int64).tobytes() for r in packed], pa.binary()), "data": pa.array([r[2] for r in packed], pa.binary())})

        held: dict = {}
        known: list = []
        size = 0
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            for doc, row, text, listed in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                place, first, last, h = anchors(np.frombuffer(raw, np.uint8))
                if not len(place):
                    continue
                bucket = (mix(h, 6) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)  # anchors are least hashes, so not spread
                _, back, often = np.unique(h, return_inverse=True, return_counts=True)
                take = often[back] > 1
                if listed == EVERY:
                    take[:] = True
                elif listed is not None:
                    take |= np.isin(h, np.frombuffer(listed, np.uint64))
                for i in np.flatnonzero(take).tolist():
                    s, e = int(first[i]), int(last[i])
                    key = (int(bucket[i]), int(place[i]) - s, raw[s : e + LENGTH])
                    here, old = (doc, row, s, e - s + 1), held.get(key)
                    if old is not None and old[0] == doc and old[1] != row:  # neither is before the other
                        key = (*key, row)
                        old = held.get(key)
                    if old is None:
                        held[key] = here
                        size += e - s + LENGTH
                    elif old[:3] != here[:3]:
                        held[key] = min(old, here)
                        known.append(max(old, here))
                if size > HELD_BYTES or len(known) > HELD_KNOWN:
                    yield flush(held, known)
                    held, known, size = {}, [], 0
        if held or known:
            yield flush(held, known)

    return joined.select("doc_id", "row", "text", "anchors").mapInArrow(run, "bucket long, at binary, data binary")


def _runs(doc: np.ndarray, row: np.ndarray, start: np.ndarray) -> pa.Table:
    """Windows (doc, row, start) as runs of neighbouring starts."""
    order = np.lexsort((start, row, doc))
    doc, row, start = doc[order], row[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(new)
    return pa.table({"doc_id": pa.array(doc[at]), "row": pa.array(row[at]), "first": pa.array(start[at]), "last": pa.array(start[np.append(at[1:], len(doc)) - 1] if len(doc) else start)})


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal numbers together and keeps them in order; where in it each one's group begins."""
    order = np.argsort(x, kind="stable")
    new = np.ones(len(x), bool)
    new[1:] = x[order[1:]] != x[order[:-1]]
    return order, np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))


def _alike(data: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_groups() of the LENGTH bytes from each place on: by a hash, then compared byte by byte with the first of the group.
    Where that follows from the window before, only the last byte is."""
    order, head = _groups(rolling(data, LENGTH)[place])
    first = np.empty(len(place), np.int64)
    first[order] = place[order[head]]
    follows = np.zeros(len(place), bool)
    follows[1:] = (place[1:] == place[:-1] + 1) & (first[1:] == first[:-1] + 1)
    equal = data[place + LENGTH - 1] == data[first + LENGTH - 1]
    for i in np.flatnonzero(~follows & (first != place)).tolist():
        equal[i] = np.array_equal(data[place[i] : place[i] + LENGTH], data[first[i] : first[i] + LENGTH])
    if equal.all():
        return order, head
    text, seen = data.tobytes(), {}
    return _groups(np.array([seen.setdefault(text[p : p + LENGTH], len(seen)) for p in place.tolist()]))


def _repeats(rows: pa.Table) -> pa.Table:
    """Of one bucket: the windows that are not the first of their kind. Rows of the same id are not before one another."""
    at = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 4) for x in rows.column("at").to_pylist()])
    if rows.column("bucket")[0].as_py() < 0:
        doc, row, start, n = (at[:, i].copy() for i in range(4))
        return pa.table({"doc_id": pa.array(doc), "row": pa.array(row), "first": pa.array(start), "last": pa.array(start + n - 1)})
    data = np.frombuffer(b"".join(rows.column("data").to_pylist()), np.uint8)
    size = at[:, 3] + LENGTH - 1
    sorted_ = np.lexsort((at[:, 2], at[:, 1], at[:, 0]))
    begin, at = (np.cumsum(size) - size)[sorted_], at[sorted_]
    n = at[:, 3]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    order, head = _alike(data, np.repeat(begin, n) + step)
    doc, row, start = np.repeat(at[:, 0], n)[order], np.repeat(at[:, 1], n)[order], (np.repeat(at[:, 2], n) + step)[order]
    again = np.zeros(len(order), bool)  # the row has the string at an earlier place; a row that came twice is one
    again[1:] = (head[1:] == head[:-1]) & (doc[1:] == doc[:-1]) & (row[1:] == row[:-1]) & (start[1:] != start[:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] = (head[1:] == head[:-1]) & (doc[1:] == doc[:-1]) & (row[1:] == row[:-1]) & (start[1:] == start[:-1])
    for i in np.flatnonzero(twice).tolist():  # the same place once more is as the one before it
        again[i] = again[i - 1]
    later = (doc != doc[head]) | again
    return _runs(doc[later], row[later], start[later])


def remove_repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if texts, kept (binary) of every document with an id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text").where("doc_id is not null")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), int(size / (4 * BUCKET_BYTES)) + 1)
    back = pack(docs.select("doc_id", "text"), buckets, AnchorSets).groupBy("bucket").applyInArrow(repeated(buckets), "block long, own binary, data binary, log binary")
    shared = written(back.groupBy("block").applyInArrow(_shared, "doc_id long, anchors binary"), "anchors")
    packed = _stretches(docs.join(shared, "doc_id", "left"), buckets)
    spread = F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("at"), F.lit(buckets))).otherwise(F.col("bucket"))
    found = packed.withColumn("bucket", spread).groupBy("bucket").applyInArrow(_repeats, "doc_id long, row long, first long, last long")
    of_doc = written(found.groupBy("doc_id", "row").agg(F.collect_list(F.struct("first", "last")).alias("runs")), "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            out: list[tuple] = []
            runs = batch.column(2)
            first, last = (runs.values.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last"))
            cuts = runs.offsets.to_numpy().tolist()
            for i, text in enumerate(batch.column(1).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                gone: list[list[int]] = []
                for s, e in sorted(zip(first[cuts[i] : cuts[i + 1]].tolist(), last[cuts[i] : cuts[i + 1]].tolist(), strict=True)):
                    e = min(len(raw), e + LENGTH)
                    if gone and s <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], e)
                    elif s < len(raw):
                        gone.append([s, e])
                edges = [0, *(x for g in gone for x in g), len(raw)]
                kept = b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                out.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            columns = {"doc_id": batch.column(0)} | {c: pa.array([o[i] for o in out], pa.int64()) for i, c in enumerate(("n_bytes", "n_removed", "n_spans"))}
            columns["kept_sha256"] = pa.array([o[3] for o in out], pa.string())
            if texts:
                columns["kept"] = pa.array([o[4] for o in out], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    return docs.join(of_doc, ["doc_id", "row"], "left").select("doc_id", "text", "runs").mapInArrow(run, schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False)
