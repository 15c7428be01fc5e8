"""Similarity join of documents on the Jaccard index of their word shingles, by filters under several global orders.

1. Tasks shingle whole texts (five words, 64-bit hashes) and deal the shingles out to buckets by hash, packed as arrays.
   A bucket counts in how many documents each shingle is and sends back only those in two or more, with the logarithm of
   that count. What a document shares with nobody never travels again.
2. Order i sorts shingles by (logarithm of the count, i-th hash). A document of n shingles can only be similar to one with
   which it shares one of its first n - ceil(0.8 n) + 1, under every order. Unique shingles come first in all of them, so
   a document with that many of them has no partner and leaves here; exact copies are reduced to one of them.
3. A hub of a prefix shingle is the document with the fewest shingles of its own, which in a group of copies is the one that
   the others were made from. Documents are tied to the hub that they share most prefix shingles with, candidates are
   verified and components taken; then again between components. Shingles that the same documents have in their prefixes
   (as those of one common line) count as one. Last, every remaining pair of documents in different components that
   shares a prefix shingle under both orders is verified. Pairs inside a component cannot change the result, so a group of
   copies or near copies costs as many pairs as it has members, and no link between components is missed.

Defined results: null and empty texts have no shingle and link with nothing; rows with a null id are left out; rows that
repeat an id give a row each, in the component of both texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, partitions, table, written
from .graph import components
from .shingles import Shingler

#: Similar: 100 * shared >= SIMILAR * all.
SIMILAR = 80
#: Shingles of a block that a task packs together, and of a bucket as planned from the number of characters.
BLOCK, BUCKET, CHARS_A_SHINGLE = 400_000, 400_000, 5
ORDERS = (1, 2, 3)
FEW = 1_000_000


def prefix(n):
    """How many shingles of n, in any order, must hold one that is shared with a similar set."""
    return n - (SIMILAR * n + 99) // 100 + 1


def first_of_each(whole: np.ndarray, n: np.ndarray) -> np.ndarray:
    """True for the first of equal sets of a block, and for none that is empty."""
    first = np.zeros(len(n), bool)
    first[np.unique(whole, return_index=True)[1]] = True
    return first & (n > 0)


def _packed(owner: np.ndarray, n: int) -> bytes:
    """Ascending numbers below n, as they are or as a count for each, whichever is shorter."""
    counts = np.bincount(owner, minlength=n)
    kind = "u1" if counts.max() < 1 << 8 else "u2" if counts.max() < 1 << 16 else "u4"
    if 2 * len(owner) < n * int(kind[1]):
        return b"id" + owner.astype(np.uint16).tobytes()
    return kind.encode() + counts.astype(f"<{kind}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if data[:2] == b"id":
        return np.frombuffer(data, np.uint16, offset=2)
    counts = np.frombuffer(data, f"<{data[:2].decode()}", offset=2)
    return np.repeat(np.arange(len(counts), dtype=np.uint16), counts)


def pack(docs: DataFrame, buckets: int, make_sets=Shingler) -> DataFrame:
    """bucket, block, data and owners: the block's shingles in a bucket and whose they are; in the buckets from `buckets` on
    the block's documents (id, n, set hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, part, at = make_sets(), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        values: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            nonlocal at
            doc, v, n = np.concatenate(ids), np.concatenate(values), np.concatenate(sizes)
            for x in (ids, values, sizes):
                x.clear()
            owner = np.repeat(np.arange(len(n)), n)
            with np.errstate(over="ignore"):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(v, 3))])
                ends = np.cumsum(n)
                whole = mix(total[ends] - total[ends - n] + n.astype(np.uint64), 4)
            # of equal sets in this block only the first is dealt out, however many there are
            keep = first_of_each(whole, n)[owner]
            v, owner = v[keep], owner[keep]
            bucket = ((mix(v, 5) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, v, owner = bucket[order], v[order], owner[order]
            filled, cuts = np.unique(bucket, return_index=True)
            number = part * (1 << 20) + at
            at += 1
            rows = [(buckets + number % buckets, np.stack([doc.view(np.uint64), n.astype(np.uint64), whole]).tobytes(), b"")]
            for b, low, high in zip(filled.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(v)], strict=True):
                rows.append((b, v[low:high].tobytes(), _packed(owner[low:high], len(n))))
            return pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([number] * len(rows), pa.int64()), "data": pa.array([r[1] for r in rows], pa.binary()), "owners": pa.array([r[2] for r in rows], pa.binary())})

        for batch in batches:
            for i in range(0, batch.num_rows, 300):
                piece = batch.slice(i, 300)
                v, n = shingle(piece.column(1).to_pylist())
                ids.append(piece.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
                values.append(v)
                sizes.append(n)
                if sum(map(len, values)) >= BLOCK or sum(map(len, ids)) >= 60_000:
                    yield block()
        if ids:
            yield block()

    return docs.mapInArrow(run, "bucket long, block long, data binary, owners binary")


def repeated(buckets: int):
    """Of one bucket: the shingles that are in two or more documents, back to the blocks they came from."""

    def run(rows: pa.Table) -> pa.Table:
        block = rows.column("block").to_numpy()
        data, owners = rows.column("data").to_pylist(), rows.column("owners").to_pylist()
        out: list[tuple] = []
        if rows.column("bucket")[0].as_py() >= buckets:  # the list of documents of a block passes through
            out = [(b, d, b"", b"") for b, d in zip(block.tolist(), data, strict=True)]
        else:
            v = np.concatenate([np.frombuffer(d, np.uint64) for d in data])
            own = [_unpacked(c) for c in owners]
            where = np.repeat(np.arange(len(owners)), [len(x) for x in own])
            own = np.concatenate(own)
            order = np.argsort(v, kind="stable")
            v = v[order]
            new = np.ones(len(v), bool)
            new[1:] = v[1:] != v[:-1]
            n = np.diff(np.append(np.flatnonzero(new), len(v)))
            n = np.repeat(n, n)
            often = n > 1
            order, v, log = order[often], v[often], np.log2(n[often]).astype(np.uint8)
            own, where = own[order], where[order]
            order = np.argsort(where, kind="stable")
            own, where, v, log = own[order], where[order], v[order], log[order]
            cuts = np.searchsorted(where, np.arange(len(block) + 1))
            for i, b in enumerate(block.tolist()):
                s = slice(cuts[i], cuts[i + 1])
                if cuts[i] < cuts[i + 1]:
                    out.append((b, own[s].astype(np.uint16).tobytes(), v[s].tobytes(), log[s].tobytes()))
        return pa.table({"block": pa.array([r[0] for r in out], pa.int64()), "own": pa.array([r[1] for r in out], pa.binary()), "data": pa.array([r[2] for r in out], pa.binary()), "log": pa.array([r[3] for r in out], pa.binary())})

    return run


def gathered(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Of one block: ids, sizes and hashes of its sets; index of the set, shingle and logarithm of every shared shingle."""
    own, data, log = (rows.column(c).to_pylist() for c in ("own", "data", "log"))
    head = next(o for o, d in zip(own, data, strict=True) if not d)
    doc, n, whole = np.frombuffer(head, np.uint64).reshape(3, -1)
    n = n.astype(np.int64)
    parts = [i for i, d in enumerate(data) if d]
    o = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(own[i], np.uint16).astype(np.int64) for i in parts)])
    v = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(data[i], np.uint64) for i in parts)])
    g = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(log[i], np.uint8) for i in parts)])
    return doc.view(np.int64), n, whole.view(np.int64), o, v, g


def _sets(rows: pa.Table) -> pa.Table:
    """Of one block: doc_id, n, whole, and the shared shingles with their logarithms where a partner is possible; of equal
    sets the first has them."""
    doc, n, whole, o, v, g = gathered(rows)
    shared = np.bincount(o, minlength=len(n))
    able = first_of_each(whole, n) & (n - shared < prefix(n))
    keep = able[o]
    o, v, g = o[keep], v[keep], g[keep]
    order = np.argsort(o, kind="stable")
    o, v, g = o[order], v[order], g[order]
    cuts = np.searchsorted(o, np.arange(len(n) + 1))
    blob = lambda x, i: x[cuts[i] : cuts[i + 1]].tobytes() if able[i] else None
    return pa.table({
        "doc_id": pa.array(doc), "n": pa.array(n), "whole": pa.array(whole),
        "shingles": pa.array([blob(v, i) for i in range(len(n))], pa.binary()), "logs": pa.array([blob(g, i) for i in range(len(n))], pa.binary()),
    })


def shared_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n, whole (hash of the set), shingles, logs: the last two are null where no other set can be similar, and where
    another document of the block has the same set."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), int(chars / CHARS_A_SHINGLE / BUCKET) + 1)
    back = pack(docs, buckets).groupBy("bucket").applyInArrow(repeated(buckets), "block long, own binary, data binary, log binary")
    return back.groupBy("block").applyInArrow(_sets, "doc_id long, n long, whole long, shingles binary, logs binary")


def _entries(sets: DataFrame) -> DataFrame:
    """place, shingle, doc_id, n, left, rank: the prefix of each set under every order; of the unique shingles only their number counts.

    left is the number of the set's shingles from this one on. rank is small for sets with few unique shingles, then for those whose shingles are in many documents. Of the shingles
    that are in the prefixes of the same documents the first in the order stays, and none that is in one prefix only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                doc, n = piece.column(0).to_numpy(), piece.column(1).to_numpy()
                of_set = [(size, np.frombuffer(v, np.uint64), np.frombuffer(g, np.uint8)) for size, v, g in zip(n.tolist(), piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True)]
                for order in ORDERS:
                    parts: list[tuple] = []
                    for size, v, g in of_set:
                        own, h = size - len(v), mix(v, 20 + order) >> np.uint64(1)
                        first = np.lexsort((h, g))[: max(0, prefix(size) - own)]
                        parts.append((v[first], g[first], h[first], size - own - np.arange(len(first)), (own << 32) - int(g.sum())))
                    k = [len(p[0]) for p in parts]
                    column = lambda i: np.concatenate([p[i] for p in parts]).astype(np.uint64).view(np.int64)  # noqa: B023, E731
                    yield pa.RecordBatch.from_pydict({"place": pa.array(np.full(sum(k), order, np.int32)), "shingle": pa.array(column(0)), "doc_id": pa.array(np.repeat(doc, k)), "n": pa.array(np.repeat(n, k)), "left": pa.array(column(3)), "rank": pa.array(np.repeat(np.array([p[4] for p in parts], np.int64), k)), "log": pa.array(column(1)), "h": pa.array(column(2))})

    every = written(sets.select("doc_id", "n", "shingles", "logs").mapInArrow(run, "place int, shingle long, doc_id long, n long, left long, rank long, log long, h long"), "prefix")
    members = every.groupBy("place", "shingle", "log", "h").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("doc_id").cast("decimal(20,0)")).alias("a"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("b")).where("m > 1")
    first = written(members.groupBy("place", "m", "a", "b").agg(F.min(F.struct("log", "h", "shingle")).alias("first")).select("place", "first.shingle"), "shingles")
    return every.join(first, ["place", "shingle"], "left_semi").drop("log", "h")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that are similar: their sets are intersected."""
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("shingles").alias(f"s_{c}"))
    both = pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v").select("u", "v", "n_u", "n_v", "s_u", "s_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                n, m = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (4, 5))
                shared = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * shared >= SIMILAR * (n + m - shared))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "u long, v long")


def _in_all(found: DataFrame, places: int) -> DataFrame:
    """The pairs (u, v) that were found (place, u, v) under so many orders: the filters of the orders are intersected."""
    return found.distinct().groupBy("u", "v").count().where(F.col("count") == places).select("u", "v")


def _meeting(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """The pairs (u, v) that share a prefix shingle under every order but the first, from which they come."""
    others = entries.where(F.col("place") != ORDERS[0])
    of_v = pairs.join(others.select("place", F.col("doc_id").alias("v"), "shingle"), "v")
    found = of_v.join(others.select("place", F.col("doc_id").alias("u"), "shingle"), ["place", "u", "shingle"], "left_semi")
    return _in_all(found.select("place", "u", "v"), len(ORDERS) - 1)


def _fits(a: str, b: str, left_a: str, left_b: str):
    """Sizes a and b may be similar: neither is too large for the other, and from the shared shingle on both have enough
    shingles for the intersection that the two need. The first shingle that similar sets share always meets this."""
    return (100 * F.least(a, b) >= SIMILAR * F.greatest(a, b)) & ((100 + SIMILAR) * F.least(left_a, left_b) >= SIMILAR * (F.col(a) + F.col(b)))


def _stars(entries: DataFrame) -> DataFrame:
    """Every document with the hub that it shares most prefix shingles with under the first order."""
    entries = entries.where(F.col("place") == ORDERS[0])
    # written, so that adaptive execution may split the join where one shingle has very many entries
    hubs = written(entries.groupBy("shingle").agg(F.min(F.struct("rank", "doc_id", "n", "left")).alias("hub")), "hubs")
    tied = entries.join(hubs, "shingle").where((F.col("doc_id") != F.col("hub.doc_id")) & _fits("n", "hub.n", "left", "hub.left"))
    counted = tied.groupBy("doc_id", F.col("hub.doc_id").alias("hub")).count()
    best = counted.groupBy("doc_id").agg(F.min(F.struct((-F.col("count")).alias("c"), "hub")).alias("best"))
    return best.select(F.least("best.hub", "doc_id").alias("u"), F.greatest("best.hub", "doc_id").alias("v")).distinct()


def _labelled(entries: DataFrame, roots: DataFrame) -> DataFrame:
    return entries.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))


def _between(entries: DataFrame) -> DataFrame:
    """Every component's first member in a prefix bucket of the first order with the bucket's first, where a component is another's."""
    of_comp = written(entries.where(F.col("place") == ORDERS[0]).groupBy("shingle", "root").agg(F.min(F.struct("rank", "doc_id", "n", "left")).alias("m")), "first")
    hubs = written(of_comp.groupBy("shingle").agg(F.min(F.struct("m.rank", "m.doc_id", "m.n", "m.left", "root")).alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members"), "hubs")
    tied = of_comp.join(hubs, "shingle").where((F.col("root") != F.col("hub.root")) & _fits("m.n", "hub.n", "m.left", "hub.left"))
    return tied.select(F.least("m.doc_id", "hub.doc_id").alias("u"), F.greatest("m.doc_id", "hub.doc_id").alias("v")).distinct()


def _rest(entries: DataFrame) -> DataFrame:
    """All pairs of documents of different components that share a prefix shingle under every order. Similar sets differ in size
    by 100 / SIMILAR at most, so components meet by shingle and band of sizes."""
    band = lambda n: F.floor(F.log(F.col(n).cast("double")) / math.log(100 / SIMILAR)).cast("int")
    comps = written(entries.groupBy("place", "shingle", "root").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("left").alias("most")), "rest")
    far = lambda c, more: comps.select("place", "shingle", F.explode(F.sequence(band("low") - more, band("high") + more)).alias("band"), *(F.col(x).alias(f"{x}_{c}") for x in ("root", "low", "high", "most")))

    def near(a: str, low: str, high: str, most: str):
        """A set (or component) a may be similar to one among those between low and high."""
        enough = (100 + SIMILAR) * F.least(f"most_{a}", most) >= SIMILAR * (F.col(f"low_{a}") + F.col(low))
        return (100 * F.col(f"high_{a}") >= SIMILAR * F.col(low)) & (100 * F.col(high) >= SIMILAR * F.col(f"low_{a}")) & enough

    meet = far("a", 0).join(far("b", 1), ["place", "shingle", "band"]).where((F.col("root_a") < F.col("root_b")) & near("a", "low_b", "high_b", "most_b")).drop("band").distinct()
    side = lambda c: entries.select("place", "shingle", F.col("root").alias(f"root_{c}"), F.col("doc_id").alias(f"id_{c}"), F.col("n").alias(f"n_{c}"), F.col("left").alias(f"left_{c}"))
    one = meet.drop("low_a", "high_a", "most_a").join(side("a"), ["place", "shingle", "root_a"])
    one = one.withColumns({"low_a": F.col("n_a"), "high_a": F.col("n_a"), "most_a": F.col("left_a")}).where(near("a", "low_b", "high_b", "most_b"))
    pairs = one.select("place", "shingle", "root_b", "id_a", "n_a", "left_a").join(side("b"), ["place", "shingle", "root_b"]).where(_fits("n_a", "n_b", "left_a", "left_b"))
    return _in_all(pairs.select("place", F.least("id_a", "id_b").alias("u"), F.greatest("id_a", "id_b").alias("v")), len(ORDERS))


def _few(df: DataFrame) -> DataFrame:
    """df to be broadcast if it has FEW rows at most (counted), else to be joined by a shuffle, with the same result."""
    return F.broadcast(df) if df.count() <= FEW else df


def join_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document with an id."""
    every = written(shared_sets(docs), "sets")
    same = every.where("n > 0").groupBy("whole", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"))
    copies = written(same.where("members > 1").drop("members"), "copies")
    held = every.join(_few(copies), ["whole", "n"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    sets = written(held.where("shingles is not null").dropDuplicates(["rep", "whole"]).select(F.col("rep").alias("doc_id"), "n", "shingles", "logs"), "reps")
    # rows that repeat an id tie the sets of that id together
    repeated_ids = every.groupBy("doc_id").count().where("count > 1").select("doc_id")
    tied = held.select("doc_id", "rep").where("doc_id <> rep").join(repeated_ids, "doc_id", "left_semi").select(F.least("doc_id", "rep").alias("u"), F.greatest("doc_id", "rep").alias("v"))
    entries = written(_entries(sets), "entries")
    links = written(_verified(_meeting(_stars(entries), entries), sets).unionByName(tied), "links")
    for last in (False, True):
        named = _labelled(entries, components(links))
        pairs = _rest(named) if last else _meeting(_between(named), named)
        links = links.unionByName(written(_verified(pairs, sets), "links"))
    roots = components(links)
    least = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    of_rep = written(roots.join(least, "root").select(F.col("node").alias("rep"), "component_id"), "components")
    return held.select("doc_id", F.col("n").alias("n_shingles"), "rep").join(_few(of_rep), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the documents whose component holds one with a smaller id; columns stay as they are.

    Up to FEW ids (a checked size) are broadcast, so that no text is shuffled; more meet the documents by a shuffled join. Rows
    with a null id stay; of rows that repeat an id all stay or all go; an empty table stays empty."""
    gone = written(join_documents(docs).where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    return docs.join(_few(gone), docs["doc_id"] == gone["doc_id"], "left_anti")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"))
