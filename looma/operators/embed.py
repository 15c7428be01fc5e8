"""Texts to vectors through a pluggable encoder, pooling, similarity and scores of classes."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.core import dot

Encoder = Callable[[list[str]], list]


class HashingEncoder:
    """The built-in encoder: words hashed to signed places of a vector of length one."""

    def __init__(self, dim: int = 32):
        self.dim = dim

    def __call__(self, texts: list[str]) -> list:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in t.lower().split() or [" "]:
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                out[i, h % self.dim] += 1.0 if h >> 63 else -1.0
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


class RemoteEncoder:
    """An embedding server: batches of 128, the empty text sent as one space, results ordered by index, retried."""

    def __init__(self, url: str, model: str, batch: int = 128, retries: int = 3, timeout: float = 60.0):
        self.url, self.model, self.batch, self.retries, self.timeout = url, model, batch, retries, timeout

    def __call__(self, texts: list[str]) -> list:
        out: list = []
        for i in range(0, len(texts), self.batch):
            body = json.dumps({"model": self.model, "input": [t or " " for t in texts[i : i + self.batch]]}).encode()
            for attempt in range(self.retries + 1):
                try:
                    request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
                    with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                        data = json.load(answer)["data"]
                    break
                except OSError:
                    if attempt == self.retries:
                        raise
                    time.sleep(0.1 * 2**attempt)
            out += [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]
        return out


def encode_distinct(texts: DataFrame, encoder: Encoder, batch: int = 512) -> DataFrame:
    """text -> text, vector; the encoder meets lists of at most `batch` texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                own = frame["text"].iloc[i : i + batch].tolist()
                yield pd.DataFrame({"text": own, "vector": encoder(own)})

    return texts.select("text").mapInPandas(run, "text string, vector array<double>")


def embed_texts(df: DataFrame, column: str, encoder: Encoder, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """df with a vector for each text, and the vectors that the cache (text, vector) lacked. Each text is encoded once."""
    need = df.select(F.col(column).alias("text")).where("text is not null").distinct()
    if cache is not None:
        need = need.join(cache.select("text"), "text", "left_anti")
    new = encode_distinct(need, encoder)
    known = new if cache is None else cache.select("text", "vector").unionByName(new)
    return df.join(known.withColumnRenamed("text", column), column, "left"), new


def pool_tokens(tokens: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """tokens (keys, pos, mask, vector) -> one vector: mean of unmasked tokens, the first, or the last unmasked one."""
    own = tokens.where("mask = 1")
    if mode in ("cls", "first"):
        return tokens.groupBy(*keys).agg(F.min_by("vector", "pos").alias("vector"))
    if mode == "last":
        return own.groupBy(*keys).agg(F.max_by("vector", "pos").alias("vector"))
    flat = own.select(*keys, F.posexplode("vector").alias("i", "x")).groupBy(*keys, "i").agg((F.sum("x") / F.greatest(F.count(F.lit(1)), F.lit(1e-9))).alias("x"))
    return flat.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select(*keys, F.transform("v", lambda s: s["x"]).alias("vector"))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def compare_backends(a: DataFrame, b: DataFrame, limit: float = 0.999) -> tuple[DataFrame, DataFrame]:
    """Per text the norms and the cosine of both vectors; the mean cosine and the verdict."""
    both = a.select("text", F.col("vector").alias("va")).join(b.select("text", F.col("vector").alias("vb")), "text")
    per = both.select("text", norm(F.col("va")).alias("norm_a"), norm(F.col("vb")).alias("norm_b"), (dot(F.col("va"), F.col("vb")) / (norm(F.col("va")) * norm(F.col("vb")) + 1e-9)).alias("cosine"))
    total = per.agg(F.avg("cosine").alias("mean_cosine"))
    return per, total.withColumn("same", F.col("mean_cosine") >= limit)


#: Rows of a context that are broadcast at most; a larger one is an error of the caller, who bounds contexts.
MAX_CONTEXT = 131_072


def bounded(df: DataFrame, limit: int = MAX_CONTEXT) -> DataFrame:
    """df to be broadcast, after its rows are counted up to the limit."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows are not broadcast")
    return F.broadcast(df)


def symmetrised(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, similarity) of one set of rows -> the mean of both directions."""
    other = pairs.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("similarity").alias("back"))
    return pairs.join(other, ["a", "b"]).select("a", "b", ((F.col("similarity") + F.col("back")) / 2).alias("similarity"))


def symmetrised_products(rows: DataFrame, parts: int = 64) -> DataFrame:
    """rows (id, left, right) of a bounded set -> a, b, the mean of left(a) . right(b) and left(b) . right(a), of all pairs. It is one product of
    the joined vectors, so the two directions need not meet in a join of pairs."""
    joined = lambda x, y: F.concat(x, y).alias("vector")
    one = rows.repartition(parts, "id").select(F.col("id").alias("query_id"), joined("left", "right"))
    other = rows.select(F.col("id").alias("context_id"), F.lit(None).cast("string").alias("label"), joined("right", "left"))
    return pairwise_similarity(one, other, "dot").select(F.col("query_id").alias("a"), F.col("context_id").alias("b"), (F.col("similarity") / 2).alias("similarity"))


#: Rows of a tile of symmetrised_summary(), and numbers that one holds at most: a tile goes to every other, so fewer and larger ones travel less.
TILE_ROWS, TILE_NUMBERS = (2048, 32_768), 1 << 21
#: Rows of a block of a tile, whose pairs are in memory at a time.
BLOCK = 256


def _blocks(first: np.ndarray, n: int) -> list[tuple[slice, slice]]:
    """Rows and groups (which begin at `first`) of the blocks of a tile of n rows: whole groups with BLOCK rows at most, or one that is larger."""
    last, out, at = np.append(first[1:], n), [], 0
    while at < len(first):
        end = max(at + 1, int(np.searchsorted(last, first[at] + BLOCK, "right")))
        out.append((slice(int(first[at]), int(last[end - 1])), slice(at, end)))
        at = end
    return out


def _summarised(tiles: list[tuple[np.ndarray, np.ndarray]], similarity: Callable) -> list[pa.RecordBatch]:
    """One tile (ids, vectors; sorted by id) with itself, or two with each other: id, total, n, top of the ids of each."""
    own, other = [(ids, x, *np.unique(ids, return_index=True, return_counts=True)[1:]) for ids, x in (tiles[0], tiles[-1])]
    weights = [np.repeat(counts, counts).astype(float) for *_, counts in (own, other)]
    totals, tops = [np.zeros(len(t[0])) for t in (own, other)], [np.full(len(t[2]), -np.inf) for t in (own, other)]
    repeated = any(len(t[0]) > len(t[2]) for t in (own, other))
    pieces = lambda rows: [slice(i, min(i + BLOCK, rows.stop)) for i in range(rows.start, rows.stop, BLOCK)]
    with np.errstate(invalid="ignore", over="ignore"):
        for rows_a, groups_a in _blocks(own[2], len(own[0])):
            for rows_b, groups_b in _blocks(other[2], len(other[0])):
                most = [-np.inf] * 4
                for i in pieces(rows_a):
                    for j in pieces(rows_b):
                        ways = similarity(own[1][i], other[1][j])
                        if repeated:  # by pair of ids the largest one of each direction, and of what is negated
                            folded = (np.maximum.reduceat(np.maximum.reduceat(x, own[2][groups_a] - rows_a.start, axis=0), other[2][groups_b] - rows_b.start, axis=1) for x in (*ways, *(-x for x in ways)))
                            most = [np.maximum(x, y) for x, y in zip(most, folded, strict=True)]
                        s = ways[0] + ways[1]
                        totals[0][i] += s @ weights[1][j]
                        totals[1][j] += weights[0][i] @ s
                if repeated:
                    s = most[0] + most[1]
                    s[(most[0] == np.inf) & (most[3] == np.inf) | (most[1] == np.inf) & (most[2] == np.inf)] = np.nan  # one pair of the join is infinity less infinity
                tops[0][groups_a] = np.maximum(tops[0][groups_a], s.max(1))
                tops[1][groups_b] = np.maximum(tops[1][groups_b], s.max(0))
        out = []
        for k, (ids, _, first, counts) in enumerate((own, other)[: len(tiles)]):
            n = counts**2 * int(weights[1 - k].sum())
            out.append(pa.RecordBatch.from_pydict({"id": pa.array(ids[first]), "total": pa.array(np.add.reduceat(totals[k], first) * counts / 2), "n": pa.array(n), "top": pa.array(tops[k] / 2)}))
    return out


def symmetrised_summary(rows: DataFrame, similarity: Callable, tile: int | None = None) -> DataFrame:
    """rows (id long, vector) -> id, mean, top: of (s(a, b) + s(b, a)) / 2 over all b of the rows, a among them.

    similarity(a, b) gives two matrices, s(a, b) and s(b, a), for the vectors in the rows of two matrices; in each, rows are a's and columns b's.
    Rows are dealt to tiles by a hash of the id, every pair of tiles is one group, and that gives a sum, a number and a maximum for each id, never
    pairs. All pairs are compared, so the work is quadratic and a vector travels once for each tile. An id that repeats stands for the join of
    the pairs of both directions. Vectors that are null, empty or hold nulls have no similarity, nor do two of different lengths; an id without
    any has nulls. Null ids are left out."""
    kind = np.float32 if rows.schema["vector"].dataType.simpleString() == "array<float>" else np.float64  # floats travel as they are
    known = rows.where("id is not null").select("id", F.col("vector").cast(f"array<{'float' if kind is np.float32 else 'double'}>").alias("v"))
    fine = F.coalesce(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull()), F.lit(False))
    usable = known.where(fine).withColumn("size", F.size("v").cast("long"))
    shares = max(1, round((8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))) ** 0.5))
    within = F.least(F.greatest(F.col("n") / shares, F.lit(TILE_ROWS[0])), F.lit(TILE_ROWS[1]), F.lit(TILE_NUMBERS) / F.col("size"))
    each = F.lit(tile) if tile else F.greatest(F.floor(within), F.lit(1))
    lengths = usable.groupBy("size").agg(F.count(F.lit(1)).alias("n")).select("size", F.ceil(F.col("n") / each).alias("tiles"))  # a row a length

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
        return pa.table({"size": t.column("size")[:1], "tile": t.column("tile")[:1], "tiles": t.column("tiles")[:1], "ids": pa.array([t.column("id").to_numpy().tobytes()], pa.binary()), "data": pa.array([x.tobytes()], pa.binary())})

    keyed = usable.join(F.broadcast(lengths), "size").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    packed = keyed.groupBy("size", "tile").applyInArrow(pack, "size long, tile long, tiles long, ids binary, data binary")
    dealt = packed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select("size", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "ids", "data")

    def run(t: pa.Table) -> pa.Table:
        size = t.column("size")[0].as_py()
        met = [(np.frombuffer(i, np.int64), np.frombuffer(d, kind).reshape(-1, size).astype(np.float64)) for i, d in zip(t.column("ids").to_pylist(), t.column("data").to_pylist(), strict=True)]
        alone = len(met) == 1 and t.column("low")[0].as_py() != t.column("high")[0].as_py()  # no row of this length in the other tile
        return pa.Table.from_batches([] if alone else _summarised(met, similarity), pa.schema({"id": pa.int64(), "total": pa.float64(), "n": pa.int64(), "top": pa.float64()}))

    found = dealt.groupBy("size", "low", "high").applyInArrow(run, "id long, total double, n long, top double")
    none = known.where(~fine).select("id", F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("top"))
    by_id = found.unionByName(none).groupBy("id").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("top").alias("top"))
    return by_id.select("id", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("mean"), "top")


#: Pairs that a task holds at a time.
PAIRS = 1 << 18


def _padded(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of a matrix, and their lengths; -1 for one that is null or holds nulls."""
    length = np.array([-1 if v is None or any(x is None for x in v) else len(v) for v in vectors], int)
    out = np.zeros((len(vectors), max(1, length.max(initial=0))))
    for i, n in enumerate(length):
        if n > 0:
            out[i, :n] = vectors[i]
    return out, length


def pairwise_similarity(query: DataFrame, context: DataFrame, kind: str = "cosine", with_sigmoid: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """query (query_id, vector, and the columns `keep`) x context (context_id, label, vector), which holds MAX_CONTEXT rows at most and goes to
    every task; there blocks of queries are multiplied with it. Vectors that are null, hold nulls or differ in length have no similarity."""
    known = context.select("context_id", "label", "vector").limit(MAX_CONTEXT + 1).toArrow()
    if known.num_rows > MAX_CONTEXT:
        raise ValueError(f"more than {MAX_CONTEXT} rows are not broadcast")
    sent = query.sparkSession.sparkContext.broadcast((known.select(["context_id", "label"]), *_padded(known.column("vector").to_pylist())))
    own = query.select("query_id", *keep, "vector")
    fields = [*(own.schema[c] for c in ("query_id", *keep)), *(context.schema[c] for c in ("context_id", "label"))]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in fields), T.StructField("similarity", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, c, c_length = sent.value
        unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12) if kind == "cosine" else x
        c, n = unit(c), len(c)
        step = max(1, PAIRS // max(n, 1))
        for batch in batches:
            for part in (batch.slice(at, step) for at in range(0, batch.num_rows if n else 0, step)):
                q, q_length = _padded(part.column(part.num_columns - 1).to_pylist())
                q, width = unit(q), min(q.shape[1], c.shape[1])
                with np.errstate(invalid="ignore", over="ignore"):
                    s = q[:, :width] @ c[:, :width].T
                    s = 1 / (1 + np.exp(-s)) if with_sigmoid else s
                none = (q_length[:, None] != c_length[None, :]) | (q_length[:, None] < 0)
                rows, places = pa.array(np.repeat(np.arange(len(q)), n)), pa.array(np.tile(np.arange(n), len(q)))
                found = [*(part.column(i).take(rows) for i in range(part.num_columns - 1)), *(x.combine_chunks().take(places) for x in labels.columns), pa.array(s.ravel(), mask=none.ravel())]
                yield pa.RecordBatch.from_arrays([x.combine_chunks().cast(f.type) if isinstance(x, pa.ChunkedArray) else x.cast(f.type) for x, f in zip(found, arrow, strict=True)], schema=arrow)

    return own.mapInArrow(run, schema).select("query_id", "context_id", "label", *keep, "similarity")


def class_scores(similarities: DataFrame, classes: DataFrame) -> DataFrame:
    """Per query and class of classes (label) the largest similarity; -inf where the context lacks the class."""
    best = similarities.groupBy("query_id", "label").agg(F.max("similarity").alias("score"))
    every = similarities.select("query_id").distinct().crossJoin(bounded(classes))
    return every.join(best, ["query_id", "label"], "left").withColumn("score", F.coalesce("score", F.lit(float("-inf"))))


def similarity_logit(s: Column, eps: float = 1e-6) -> Column:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), s))
    return F.greatest(F.lit(-1e4), F.least(F.lit(1e4), F.log(p / (1 - p))))


def score_batches(query: DataFrame, context: DataFrame, scorer: Callable, schema: str, keys: list[str]) -> DataFrame:
    """A user's scorer(query, context) -> frame for each group of keys (table, bag, chunk); both sides are bounded by the
    chunk and the context size."""
    return query.groupBy(*keys).cogroup(context.groupBy(*keys)).applyInPandas(scorer, schema)


def align_classes(scores: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
    """scores (keys, label, logit) with every class of classes; missing ones -inf."""
    every = scores.select(*keys).distinct().crossJoin(bounded(classes))
    return every.join(scores, [*keys, "label"], "left").withColumn("logit", F.coalesce("logit", F.lit(float("-inf"))))


def softmax(scores: DataFrame, keys: list[str]) -> DataFrame:
    by = W.partitionBy(*keys)
    e = F.exp(F.col("logit") - F.max("logit").over(by))
    return scores.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(by)).drop("_e")


def combine_bags(scores: DataFrame, how: str = "mean") -> DataFrame:
    """scores (query_id, bag, label, logit) -> query_id, label, p."""
    if how == "mean":
        return softmax(scores, ["query_id", "bag"]).groupBy("query_id", "label").agg(F.avg("p").alias("p"))
    best = scores.groupBy("query_id", "label").agg(F.max("logit").alias("logit"))
    return softmax(best, ["query_id"]).drop("logit")


def predict_label(probabilities: DataFrame) -> DataFrame:
    """The most probable class of each query; ties to the first."""
    best = F.min(F.struct((-F.col("p")).alias("n"), "label"))
    return probabilities.groupBy("query_id").agg(best.alias("b")).select("query_id", F.col("b.label").alias("label"), (-F.col("b.n")).alias("p"))


def predict_proba(probabilities: DataFrame, classes: list) -> DataFrame:
    return probabilities.groupBy("query_id").pivot("label", classes).agg(F.first("p"))


def predict_value_binned(scores: DataFrame, midpoints: DataFrame, bins: int = 16) -> DataFrame:
    """scores (query_id, bin, logit) and midpoints (bin, mid) -> query_id, value. Every query needs all bins."""
    out = softmax(scores, ["query_id"]).join(F.broadcast(midpoints), "bin").groupBy("query_id").agg(F.sum(F.col("p") * F.col("mid")).alias("value"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("value", F.when(F.col("n") == bins, F.col("value")).otherwise(F.raise_error(F.lit(f"exactly {bins} bins are needed")).cast("double"))).drop("n")


def predict_value_scaled(z: Column, mean: Column, std: Column) -> Column:
    return z * std + mean


def combine_regression(values: DataFrame) -> DataFrame:
    return values.groupBy("query_id").agg(F.avg("value").alias("value"))
