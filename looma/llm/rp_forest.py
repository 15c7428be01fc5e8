"""Approximate nearest neighbours by inner product: a forest of random-projection trees with one priority queue.

Vectors are scaled into the unit ball and get one more coordinate that puts them on the sphere, so the largest inner product is the
least distance. A node of a tree has a random direction (drawn from a seed, so only thresholds are kept) and the median of a bounded
sample along it; every row goes to one leaf of each tree. A query's nodes of all trees share one queue: going to a side of a node
costs the less the farther the query lies on that side, -log of a logistic chance, and leaves are popped cheapest first until `pops` have left. Costs only grow
on the way down, so these are the cheapest leaves, and a batch of queries takes them by a partial sort (tested against a heap).
How many are popped is measured, not given: for a bounded sample of queries, the exact neighbours among all rows are found in one pass, and `pops` is
the least number that reaches the share RECALL of them.

In Spark: equal vectors become one item with its k + 1 smallest ids (no answer can hold more of them), so copies that hold a third of all rows are one
item. Leaves side by side form regions of up to TILE_MB of items, a larger leaf is split by a hash of its items, and queries of a region are split into tiles
as well: a group of the cogroup is one tile of items and one of queries. A query takes k + 1 ids from each tile that it asks, so tiles are as large as a task's
memory allows. Inside, popped leaves are multiplied, the best are computed again one by one in
double precision on the vectors as given (the exact reranking), and k + 1 ids a query go on; a last grouping merges the tiles.

Bounds: SAMPLE vectors (or SAMPLE_MB) for the medians, PROBES queries for the number of pops, both by a hash of the id. Leaves a tree: rows / LEAF, at most an
eighth of the sample. Beyond that leaves grow with the rows and are split into tiles: raise SAMPLE there.

Defined results: rows with a null id take no part, nor do vectors that are null, empty, zero or hold null or non-finite components; shorter vectors are
taken as if zeros followed. Rows that repeat id and vector count once; rows that repeat an id with another vector are candidates and queries of their own, and none is a candidate of its own id. A query with fewer candidates gets all
that there are in its leaves; where all rows fit into one leaf that is every candidate. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

K, EVERY, TREES, LEAF, RECALL, SEED = 20, 20, 4, 64, 0.95, 12
SAMPLE, SAMPLE_MB, PROBES, CHUNK, SLACK = 65_536, 64, 128, 128, 1e-12
#: MB of a tile of items as doubles, queries of a tile at most and (while there are fewer tiles than cores) at least, and products at once.
TILE_MB, ASKED, FEW, PRODUCTS = 32, 4096, 512, 1 << 22
#: Cost of a side, per square root of the number of coordinates.
SLOPE = 0.8


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v of the rows that take part, each once."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    exact = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{exact}>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(fine).distinct()


def matrix(column, width: int) -> np.ndarray:
    """Rows of doubles, zeros after the end of shorter ones."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    long = np.diff(c.offsets.to_numpy())
    flat = c.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (long == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(long), width))
    out[np.arange(width)[None, :] < long[:, None]] = flat
    return out


class Forest:
    """Trees of one depth; node k of a tree has the children 2k + 1 (below its threshold) and 2k + 2."""

    def __init__(self, width: int, longest: float, depth: int, trees: int = TREES, seed: int = SEED):
        self.width, self.longest, self.depth, self.trees, self.seed = width, longest, depth, trees, seed
        self.nodes, self.leaves_per_tree = 2**depth - 1, 2**depth
        self.thresholds = np.zeros((trees, self.nodes), np.float32)

    def directions(self) -> np.ndarray:
        r = np.random.default_rng(self.seed).standard_normal((self.trees, self.nodes, self.width + 1), np.float32)
        return r / np.linalg.norm(r, axis=2, keepdims=True) if self.nodes else r

    def on_sphere(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        last = np.sqrt(np.maximum(1 - (x * x).sum(1, keepdims=True), 0))
        return np.hstack([x, last]).astype(np.float32)

    def fit(self, sample: np.ndarray) -> Forest:
        """Medians of the sample, level by level."""
        x, r = self.on_sphere(sample), self.directions()
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                p = np.einsum("ij,ij->i", x, r[t][node])
                order = np.lexsort((p, node))
                own, first, n = np.unique(node[order], return_index=True, return_counts=True)
                self.thresholds[t, own] = p[order][first + n // 2]
                node = 2 * node + 1 + (p >= self.thresholds[t][node])
        return self

    def leaves(self, x: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The leaf of every row in each tree."""
        x = self.on_sphere(x)
        out = np.zeros((len(x), self.trees), np.int32)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, r[t][node]) >= self.thresholds[t][node])
            out[:, t] = node - self.nodes
        return out

    def costs(self, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        """For every query the cost of each leaf of all trees (tree by tree): what the queue holds."""
        unit = q / np.abs(q).max(1, keepdims=True)
        unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
        cost = np.zeros((len(q), self.trees, 1), np.float32)
        slope = np.float32(SLOPE * self.width**0.5)
        for level in range(self.depth):
            part = slice(2**level - 1, 2 ** (level + 1) - 1)
            m = slope * (np.einsum("qd,tnd->qtn", unit, r[:, part, :-1], optimize=True) - self.thresholds[None, :, part])
            cost = np.stack([cost + np.logaddexp(0, m), cost + np.logaddexp(0, -m)], axis=-1).reshape(len(q), self.trees, -1)
        return cost.reshape(len(q), -1)

    def search(self, q: np.ndarray, r: np.ndarray, pops: int) -> np.ndarray:
        """The leaves (tree * leaves_per_tree + leaf) that leave the queue first."""
        cost = self.costs(q, r)
        return np.argpartition(cost, pops - 1, axis=1)[:, :pops] if pops < cost.shape[1] else np.broadcast_to(np.arange(cost.shape[1]), cost.shape)


def items_of(rows: DataFrame, k: int) -> DataFrame:
    """item (least id), ids (the k + 1 smallest, rising), v of every distinct vector. The limit of each vector's rows is applied before the shuffle, too."""
    rank = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    few = rows.withColumn("r", rank).where(F.col("r") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("item"), "ids", "v")


def _by_hash(df: DataFrame, key: str, n: int, wanted: int) -> DataFrame:
    """About `wanted` of the n rows, by a hash of the key; all if there are no more."""
    return df if n <= wanted else df.where(F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(1 << 30)) < int((1 << 30) * wanted / n))


def build(items: DataFrame, n: int, width: int, longest: float, trees: int, leaf: int) -> Forest:
    sample = int(max(1024, min(SAMPLE, SAMPLE_MB * 2**20 // (4 * width))))
    x = matrix(_by_hash(items, "item", n, sample).select("v").toArrow().column(0), width)
    depth = max(0, min(int(np.ceil(np.log2(max(1, n / leaf)))), int(np.log2(max(1, len(x) // 8)))))
    return Forest(width, longest, depth, trees).fit(x)


def _best(q: np.ndarray, x: np.ndarray, allowed: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, inner product) of the k largest of each query among allowed rows, with what ties; products are exact for the pair, wherever it is met."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = q @ x.T
        s = np.where(np.isnan(s), -np.inf, s)
        if allowed is not None:
            s[~allowed] = -np.inf
        least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
        slack = SLACK * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max(initial=0)
        i, j = np.nonzero((s >= (least - slack)[:, None]) & (s > -np.inf))
        return i, j, np.einsum("ij,ij->i", q[i], x[j])


def _first(by: np.ndarray, k: int) -> np.ndarray:
    """Whether a row is among the first k of its run of equal values."""
    start = np.flatnonzero(np.diff(by, prepend=by[:1] - 1))
    return np.arange(len(by)) - np.repeat(start, np.diff(start, append=len(by))) < k


def measure_pops(leafed: DataFrame, queries: DataFrame, n_queries: int, forest: Forest, k: int, recall: float) -> int:
    """The least number of pops with which the sampled queries meet the share `recall` of their exact neighbours."""
    q = matrix(_by_hash(queries, "query", n_queries, PROBES).select("v").toArrow().column(0), forest.width)
    if forest.depth == 0 or not len(q):
        return forest.trees
    width = forest.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            for part in (batch.slice(at, 8192) for at in range(0, batch.num_rows, 8192)):
                x, leaf = matrix(part.column("v"), width), np.array(part.column("leaves").to_pylist(), np.int32).reshape(part.num_rows, -1)
                i, j, s = _best(q, x, None, k + 1)
                other = (q[i] != x[j]).any(1)
                new = i[other], s[other], leaf[j[other]]
                kept = new if kept is None else tuple(np.concatenate([a, b]) for a, b in zip(kept, new, strict=True))
                order = np.lexsort((-kept[1], kept[0]))
                order = order[_first(kept[0][order], k)]
                kept = tuple(a[order] for a in kept)
        if kept is not None:
            yield pa.RecordBatch.from_pydict({"q": pa.array(kept[0], pa.int32()), "s": pa.array(kept[1], pa.float64()), "leaves": pa.array(list(kept[2]), pa.list_(pa.int32()))})

    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("s")))
    found = leafed.select("v", "leaves").mapInArrow(run, "q int, s double, leaves array<int>").withColumn("r", rank).where(F.col("r") <= k).select("q", "leaves").collect()
    if not found:
        return forest.trees
    cost = forest.costs(q, forest.directions())
    place = cost.argsort(1).argsort(1)
    base = np.arange(forest.trees) * forest.leaves_per_tree
    met = np.sort([place[r["q"], base + r["leaves"]].min() for r in found])
    return max(forest.trees, int(met[min(len(met) - 1, int(np.ceil(recall * len(met))) - 1)]) + 1)


def regions(counts: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """counts: rows of each leaf of all trees, (trees, leaves). -> the region of each leaf, and the number of tiles of each region."""
    of, blocks = np.zeros(counts.size, np.int32), []
    for t, row in enumerate(counts.tolist()):
        held = None
        for leaf, n in enumerate(row):
            if held is None or held + n > tile:
                blocks.append(1)
                held = 0
            held += n
            blocks[-1] = max(1, -(-held // tile))
            of[t * counts.shape[1] + leaf] = len(blocks) - 1
    return of, np.array(blocks)


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL, tile: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    items = written(items_of(rows, k), "vectors")
    double = lambda x: x.cast("double")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.hypot(a, double(x)))).alias("longest")).first()
    if not size["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, kind = size["width"], items.schema["v"].dataType.simpleString()
    forest = build(items, size["n"], width, size["longest"], trees, leaf)
    of_query = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    queries = written(of_query.groupBy("v").agg(F.min("vec_id").alias("query")), "queries")
    n_queries = queries.count()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = forest.directions()
        for batch in (b.slice(at, 8192) for b in batches for at in range(0, b.num_rows, 8192)):
            found = forest.leaves(matrix(batch.column("v"), width), r)
            yield pa.RecordBatch.from_pydict({"item": batch.column("item"), "ids": batch.column("ids"), "v": batch.column("v"), "leaves": pa.array(list(found), pa.list_(pa.int32()))})

    leafed = written(items.mapInArrow(place, f"item long, ids array<long>, v {kind}, leaves array<int>"), "leaves")
    pops = measure_pops(leafed, queries, n_queries, forest, k, recall)
    counts = np.zeros((trees, forest.leaves_per_tree), np.int64)
    for r in leafed.select(F.posexplode("leaves").alias("t", "leaf")).groupBy("t", "leaf").count().collect():  # a row for each leaf
        counts[r["t"], r["leaf"]] = r["count"]
    tile = tile or max(1024, TILE_MB * 2**20 // (8 * width))
    of, blocks = regions(counts, tile)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array(batch.column("leaves").to_pylist(), np.int64).reshape(batch.num_rows, -1)
            for t in range(trees):
                own = found[:, t] + t * forest.leaves_per_tree
                yield pa.RecordBatch.from_pydict({"region": pa.array(of[own], pa.int32()), "leaf": pa.array(own, pa.int32()), "item": batch.column("item"), "ids": batch.column("ids"), "v": batch.column("v")})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = forest.directions()
        for batch in (b.slice(at, CHUNK) for b in batches for at in range(0, b.num_rows, CHUNK)):
            popped = np.sort(forest.search(matrix(batch.column("v"), width), r, pops), axis=1)  # leaves of a region lie side by side
            q = np.repeat(np.arange(len(popped)), popped.shape[1])
            where, popped = of[popped.ravel()], popped.ravel()
            first = np.flatnonzero((np.diff(where, prepend=-1) != 0) | (np.diff(q, prepend=-1) != 0))
            asked = pa.ListArray.from_arrays(pa.array(np.append(first, len(q)), pa.int32()), pa.array(popped, pa.int32()))
            at = pa.array(q[first])
            yield pa.RecordBatch.from_pydict({"region": pa.array(where[first], pa.int32()), "query": batch.column("query").take(at), "v": batch.column("v").take(at), "asked": asked})

    asked = written(queries.mapInArrow(ask, f"region int, query long, v {kind}, asked array<int>"), "asked")
    per = {r["region"]: r["count"] for r in asked.groupBy("region").count().collect()}  # a row for each region
    wanted = -(-2 * spark.sparkContext.defaultParallelism // max(1, sum(int(blocks[i]) for i in per)))
    parts = {i: max(-(-n // ASKED), min(-(-n // FEW), wanted)) for i, n in per.items()}
    tiles = F.broadcast(spark.createDataFrame([(i, int(blocks[i]), parts[i]) for i in per], "region int, blocks int, parts int"))
    dealt = leafed.mapInArrow(deal, f"region int, leaf int, item long, ids array<long>, v {kind}").join(tiles, "region")
    dealt = dealt.select("region", F.pmod(F.xxhash64("item"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "leaf", "ids", "v")
    sent = asked.join(tiles, "region").select("region", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query"), "parts").cast("int").alias("part"), "query", "v", "asked")

    def compare(own: pa.Table, wanted: pa.Table) -> pa.Table:
        """One tile of items and one of queries: the k + 1 nearest ids of each query."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if own.num_rows and wanted.num_rows:
            x, leaves = matrix(own.column("v"), width), own.column("leaf").to_numpy()
            ids = own.column("ids").combine_chunks()
            long, flat = np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy()
            base = np.cumsum(long) - long
            names = wanted.column("query").to_numpy()
            lists = wanted.column("asked").combine_chunks()
            n = np.diff(lists.offsets.to_numpy())
            low, high = int(leaves.min()), int(leaves.max())
            ask = np.zeros((len(names), high - low + 1), bool)
            i, j = np.repeat(np.arange(len(names)), n), lists.flatten().to_numpy() - low
            inside = (j >= 0) & (j <= high - low)
            ask[i[inside], j[inside]] = True
            q = matrix(wanted.column("v"), width)
            order = np.argsort(ask.argmax(1), kind="stable")  # queries that ask for the same leaves side by side
            step = max(16, PRODUCTS // len(x))
            for at in range(0, len(order), step):
                rows_ = order[at : at + step]
                cols = np.flatnonzero(ask[rows_].any(0)[leaves - low])
                if not len(cols):
                    continue
                i, j, s = _best(q[rows_], x[cols], ask[rows_][:, leaves[cols] - low], k + 1)
                i, j = rows_[i], cols[j]
                m = long[j]
                at_id = np.repeat(base[j] - np.cumsum(m) + m, m) + np.arange(m.sum())
                i, s, v = np.repeat(i, m), np.repeat(s, m), flat[at_id]
                best = np.lexsort((v, -s, i))
                best = best[_first(i[best], k + 1)] if len(best) else best
                out.append((names[i[best]], v[best], s[best]))
        query, v, s = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"query": pa.array(query, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    keys = ("region", "block", "part")
    found = dealt.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(compare, "query long, vec_id long, score double")
    once = found.groupBy("query", "vec_id").agg(F.max("score").alias("score"))  # the trees give equal scores
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    lists = once.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    names = of_query.select(F.col("vec_id").alias("query_id"), "v").join(queries, "v").select("query_id", "query")
    near = F.slice(F.filter("near", lambda c: c["vec_id"] != F.col("query_id")), 1, k)
    out = names.join(lists, "query").select("query_id", F.posexplode(near).alias("p", "c"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "c.vec_id", "c.score")


def op12_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
