"""Near-duplicate vectors by PCA-ordered tiled comparison.

Spark sums the vectors' outer products (a matrix of fixed size); the driver takes the principal axes from it. Vectors are
normalised, turned to those axes and dealt out to tiles (of a size within `TILES`) by a hash of the id; every pair of tiles is
one group. Inside, leading coordinates are multiplied first: with the norms of what is left, appended as one more coordinate,
a product of a few columns bounds the cosine from above (Cauchy-Schwarz), and a pair goes on to more coordinates only
while that bound reaches the threshold. What is left is decided on the vectors as given, in double precision.

A pair of tiles gives one count for each vector and the edges of a spanning forest, never its links: a group of copies that
holds a third of all rows costs rows in proportion to its members. All pairs are compared; the work is quadratic in the
number of vectors with a small constant (most pairs stop after a quarter of the coordinates).

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing, nor do vectors of
different lengths; rows with a null id are left out; a row that repeats id and vector counts once, and each gives a row; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table, written
from .graph import components

THRESHOLD, ROWS, SLACK, DOUBT = 0.9, 512, 1e-4, 1e-12
#: Vectors of a tile: a tile goes to every other, so fewer and larger ones travel less.
TILES = (2048, 32768)


def _usable(vectors: DataFrame) -> DataFrame:
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    exact = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"  # floats travel as they are
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{exact}>").alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _unit(x.flatten().to_numpy(zero_copy_only=False).reshape(n, -1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _reach(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of a's rows i and b's rows j reaches the threshold: the one place where links are decided."""
    return np.einsum("ij,ij->i", a[i], b[j]) >= threshold


def axes(vectors: DataFrame, size: int) -> np.ndarray:
    """Principal axes (columns, leading first) of the normalised vectors, from sums of outer products."""

    def run(batches):
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                total += x.T @ x
        yield pa.RecordBatch.from_pydict({"row": pa.array(range(size), pa.int64()), "values": pa.array(list(total), pa.list_(pa.float64()))})

    parts = vectors.select("v").mapInArrow(run, "row long, values array<double>")
    sums = parts.groupBy("row").agg(*(F.sum(F.col("values")[i]).alias(f"c{i}") for i in range(size))) if size <= 128 else None
    if sums is not None:
        rows = sorted(tuple(r) for r in sums.collect())
    else:
        flat = parts.select("row", F.posexplode("values")).groupBy("row", "pos").agg(F.sum("col").alias("x")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("x"))
        rows = sorted((r["row"], *(p["x"] for p in r["x"])) for r in flat.collect())
    _, vec = np.linalg.eigh(np.array([r[1:] for r in rows]).reshape(size, size))
    return vec[:, ::-1]


def compare(ids_a: np.ndarray, a: np.ndarray, ids_b: np.ndarray, b: np.ndarray, turn: np.ndarray, threshold: float, same: bool):
    """Numbers of links of a's and of b's rows, and edges (u, v) that connect what is linked."""
    size = a.shape[1]
    steps = sorted({min(size, s) for s in (max(4, size // 4), max(8, size // 2))})
    ta, tb = a @ turn, b @ turn
    lead = []
    for s in steps:
        tail = lambda t, s=s: np.sqrt(np.maximum((t[:, s:] ** 2).sum(1), 0))[:, None]
        lead.append((np.hstack([ta[:, :s], tail(ta)]).astype(np.float32), np.hstack([tb[:, :s], tail(tb)]).astype(np.float32)))
    n_a, n_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    label_a = np.arange(len(a))
    label_b = np.arange(len(b)) if same else np.arange(len(b)) + len(a)
    ids = ids_a if same else np.concatenate([ids_a, ids_b])
    edges = []
    for at in range(0, len(a), ROWS):
        top = slice(at, at + ROWS)
        i, j = np.nonzero(lead[0][0][top] @ lead[0][1].T >= threshold - SLACK)
        if len(i) > 16 * (ROWS + len(b)):  # many alike: whole rows at once
            rows, cols = np.unique(i), np.unique(j)
            product = a[top][rows] @ b[cols].T
            linked = product >= threshold
            doubt = np.nonzero(np.abs(product - threshold) < DOUBT)  # where the order of the sum may decide
            linked[doubt] = _reach(a, b, rows[doubt[0]] + at, cols[doubt[1]], threshold)
            i, j = np.nonzero(linked)
            i, j = rows[i], cols[j]
        else:
            for x, y in lead[1:]:
                near = np.einsum("ij,ij->i", x[top][i], y[j]) >= threshold - SLACK
                i, j = i[near], j[near]
            exact = _reach(a, b, i + at, j, threshold)
            i, j = i[exact], j[exact]
        i = i + at
        if same:
            i, j = i[i != j], j[i != j]
        if not len(i):
            continue
        n_a += np.bincount(i, minlength=len(a))
        if not same:
            n_b += np.bincount(j, minlength=len(b))
        while True:  # least label among what is linked
            low = np.minimum(label_a[i], label_b[j])
            before = label_a[i].sum() + label_b[j].sum()
            np.minimum.at(label_a, i, low)
            np.minimum.at(label_b, j, low)
            if same:
                label_a = label_b = np.minimum(label_a, label_b)
            if label_a[i].sum() + label_b[j].sum() == before:
                break
        for nodes, labels, own in ((np.unique(i), label_a, ids_a), (np.unique(j), label_b, ids_b)):
            edges.append(np.stack([own[nodes], ids[labels[nodes]]], 1))
    edges = np.unique(np.concatenate(edges), axis=0) if edges else np.zeros((0, 2), np.int64)
    return n_a, n_b, edges[edges[:, 0] != edges[:, 1]]


def _pairs(vectors: DataFrame, turn: np.ndarray, threshold: float, tile: int | None) -> DataFrame:
    """u, v, n: links of u (v null), or an edge u-v (n 0), from every pair of tiles. Vectors of each length are by themselves;
    turn holds the axes of the most frequent one, the others are taken as they are."""
    n = vectors.count()
    tile = tile or min(TILES[1], max(TILES[0], n // max(1, round((2 * partitions(vectors.sparkSession)) ** 0.5))))
    tiles = max(1, -(-n // tile))
    kind = np.float32 if vectors.schema["v"].dataType.simpleString() == "array<float>" else np.float64

    def pack(rows: pa.Table) -> pa.Table:
        x = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table({"size": rows.column("size")[:1], "tile": rows.column("tile")[:1], "ids": pa.array([rows.column("vec_id").to_numpy().tobytes()], pa.binary()), "data": pa.array([x.astype(kind).tobytes()], pa.binary())})

    keyed = vectors.withColumns({"size": F.size("v").cast("long"), "tile": F.pmod(F.xxhash64("vec_id"), F.lit(tiles))})
    packed = keyed.groupBy("size", "tile").applyInArrow(pack, "size long, tile long, ids binary, data binary")
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    dealt = packed.withColumn("other", other).select("size", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "ids", "data")

    def run(rows: pa.Table) -> pa.Table:
        size = rows.column("size")[0].as_py()
        found = {t: (np.frombuffer(i, np.int64), _unit(np.frombuffer(d, kind).reshape(-1, size))) for t, i, d in zip(*(rows.column(c).to_pylist() for c in ("tile", "ids", "data")), strict=True)}
        low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
        u, v, n = [], [], []
        if low in found and high in found:
            (ids_a, a), (ids_b, b) = found[low], found[high]
            n_a, n_b, edges = compare(ids_a, a, ids_b, b, turn if len(turn) == size else np.eye(size), threshold, low == high)
            for ids, count in ((ids_a, n_a), (ids_b, n_b)):
                some = np.flatnonzero(count)
                u += ids[some].tolist()
                v += [None] * len(some)
                n += count[some].tolist()
            u += edges[:, 0].tolist()
            v += edges[:, 1].tolist()
            n += [0] * len(edges)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(n, pa.int64())})

    return dealt.groupBy("size", "low", "high").applyInArrow(run, "u long, v long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row with an id."""
    usable = written(_usable(vectors).distinct(), "vectors")
    most = usable.groupBy(F.size("v").alias("k")).count().orderBy(F.desc("count"), "k").first()
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id is not null")
    if most is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    turn = axes(usable.where(F.size("v") == most["k"]), most["k"])
    found = written(_pairs(usable, turn, threshold, tile), "pairs")
    counts = found.where("v is null").groupBy(F.col("u").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    roots = components(found.where("v is not null").select("u", "v"))
    least = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    comps = roots.join(least, "root").select(F.col("node").alias("vec_id"), "component_id")
    out = ids.join(counts, "vec_id", "left").join(comps, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op9_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
