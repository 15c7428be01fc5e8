"""Whitening of embeddings by the polarisation covariance.

Entries become whole numbers x, so sums are exact. With n rows and the sums S, the centred value of an entry is n*x - S; tasks square
and sum the centred values of every dimension and of the sum of every pair of dimensions, and half of what the variance of a sum has
beside the variances of its parts is their covariance: cov(i, j) = (var(i + j) - var(i) - var(j)) / 2. The sums are kept in limbs of
`LIMB` bits, so no square overflows a long and Spark adds them as decimals; the driver gets d * (d + 1) / 2 numbers, turns exact
fractions into a matrix of doubles and takes its leading eigenvectors. Rows are then projected, written once, and
their covariance is measured by Spark's own covar_pop, which centres before it multiplies.

Three scans of the vectors, whose rows are never shuffled: what a task sends grows with d squared, not with its rows.

Defined results: rows with a null vector, an empty one, or one that holds null or non-finite entries are dropped; so are vectors of another length
than the most frequent one (ties: the longest). Entries beyond +-2^40 are taken for +-2^40. Rows with a null id and rows that repeat stay, each with
its results. A component whose eigenvalue is not above rounding (2^-40 of the largest) has a null whitened value and takes no part in identity_error, which is 0
if there is none; explained is null where all rows are equal. deviation is null where it does not fit a long; deviation_exact has it then.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SCALE, SHIFT, MOST, COMPONENTS = 1024, 100_000, 2.0**40, 8
#: Bits of a limb, rows that are squared at once (LIMB * 2 + bits of ROWS < 63), and the least share of the largest eigenvalue.
LIMB, ROWS, LEAST = 24, 4096, 2.0**-40


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of doubles) of rows whose vector is complete and finite."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(v.isNotNull() & (F.size(v) > 0)).where(fine)


def _whole(column: pa.Array, size: int) -> np.ndarray:
    """x of the rows: whole numbers."""
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    return np.floor(SCALE * np.clip(c, -MOST, MOST)).astype(np.int64) + SHIFT


def sums(rows: DataFrame, size: int) -> tuple[int, list[int]]:
    """n and S."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * size
        for batch in batches:
            if batch.num_rows:
                n += batch.num_rows
                total = [a + b for a, b in zip(total, _whole(batch.column(0), size).sum(0).tolist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"pos": pa.array(range(-1, size), pa.int32()), "s": pa.array([Decimal(x) for x in (n, *total)], pa.decimal128(38, 0))})

    found = dict(tuple(r) for r in rows.select("v").mapInArrow(run, "pos int, s decimal(38,0)").groupBy("pos").agg(F.sum("s")).collect())
    return int(found.get(-1, 0)), [int(found.get(i, 0)) for i in range(size)]


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - S, as longs or, where those could overflow, as Python's numbers."""
    if n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, total)) < 2**61:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def square_sums(y: np.ndarray) -> list[np.ndarray]:
    """Of centred rows y: for each dimension i the sums of squares of y[i] and of y[i] + y[j] for j > i, exact. Numbers of at most 2 * LIMB bits
    go through limbs, larger ones through Python's numbers."""
    bound = 2 * int(np.abs(y).max(initial=0)) + 1
    out = []
    for i in range(y.shape[1]):
        z = np.concatenate([y[:, i : i + 1], y[:, i : i + 1] + y[:, i + 1 :]], axis=1)
        if len(y) * bound**2 < 2**63:
            out.append(np.einsum("ij,ij->j", z, z).astype(object))
        elif bound < 2 ** (2 * LIMB - 1):
            high, low = z >> LIMB, z & (2**LIMB - 1)
            hh, hl, ll = (np.einsum("ij,ij->j", a, b).astype(object) for a, b in ((high, high), (high, low), (low, low)))
            out.append((hh << (2 * LIMB)) + (hl << (LIMB + 1)) + ll)
        else:
            z = z.astype(object)
            out.append((z * z).sum(0))
    return out


def covariance(rows: DataFrame, size: int, n: int, total: list[int]) -> np.ndarray:
    """The covariance of x, divisor n, each entry correctly rounded from exact sums."""
    limbs = 4
    base = 10**18

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                own = square_sums(centred(_whole(batch.column(0).slice(at, ROWS), size), n, total))
                found = own if found is None else [a + b for a, b in zip(found, own, strict=True)]
        for i, row in enumerate(found or ()):  # a row for each dimension; its numbers in parts of 18 digits
            parts = {f"p{k}": pa.array([[x // base**k % base if k + 1 < limbs else x // base**k for x in row.tolist()]], pa.list_(pa.int64())) for k in range(limbs)}
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), **parts})

    parts = rows.select("v").mapInArrow(run, "i int, " + ", ".join(f"p{k} array<long>" for k in range(limbs)))
    each = parts.select("i", F.posexplode(F.arrays_zip(*(f"p{k}" for k in range(limbs)))).alias("k", "p"))
    added = each.groupBy("i", "k").agg(*(F.sum(F.col(f"p.p{k}").cast("decimal(38,0)")).alias(f"p{k}") for k in range(limbs)))
    q = {(r["i"], r["i"] + r["k"]): sum(int(r[f"p{k}"]) * base**k for k in range(limbs)) for r in added.collect()}
    v = np.zeros((size, size))
    for i in range(size):
        v[i, i] = q[i, i] / n**3
        for j in range(i + 1, size):
            v[i, j] = v[j, i] = (q[i, j] - q[i, i] - q[j, j]) / (2 * n**3)
    return v


def principal(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; the largest entry of each is positive."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values, vectors * np.where(sign == 0, 1, sign)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact: a row for each usable row and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    complete = usable(vectors)
    most = complete.groupBy(F.size("v").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).first()
    if most is None:
        return vectors.sparkSession.createDataFrame([], schema)
    size = most["k"]
    rows = complete.where(F.size("v") == size)
    n, total = sums(rows, size)
    v = covariance(rows, size, n, total)
    values, axes = principal(v, min(components, size))
    good = (values > LEAST * values[0]) & (values > 0)
    weight = axes[:, good] / np.sqrt(values[good])
    trace = float(np.trace(v))
    explained = [float(e / trace) if trace > 0 else None for e in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            y = centred(_whole(batch.column(1), size), n, total)
            white = np.full((len(y), len(values)), np.nan)
            white[:, good] = (y.astype(np.float64) / n) @ weight
            if y.dtype != object and size * (int(np.abs(y).max(initial=0)) ** 2) < 2**63:
                deviation = (y * y).sum(1).tolist()
            else:
                deviation = [sum(int(c) ** 2 for c in row) for row in y]
            flat = pa.array(white.ravel(), pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "w": pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * len(values), pa.int32()), flat), "deviation_exact": pa.array([Decimal(x) if x < 10**38 else None for x in deviation], pa.decimal128(38, 0))})

    done = written(rows.select("vec_id", "v").mapInArrow(run, "vec_id long, w array<double>, deviation_exact decimal(38,0)"), "whitened")
    own = np.flatnonzero(good).tolist()
    pairs = [(i, j) for i in own for j in own if i <= j]
    error = 0.0
    if pairs:
        found = done.agg(*(F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs)).first()
        error = max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True))
    named = F.array(*(F.struct(F.lit(i + 1).alias("component"), F.col("w")[i].alias("whitened"), F.lit(e).cast("double").alias("explained")) for i, e in enumerate(explained)))
    out = done.select("vec_id", F.explode(named).alias("c"), "deviation_exact")
    return out.select("vec_id", "c.component", F.lit(n).cast("long").alias("n"), F.expr("try_cast(deviation_exact as long)").alias("deviation"), "c.whitened", "c.explained", F.lit(float(error)).alias("identity_error"), "deviation_exact")


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
