"""Sampling rows and splitting them into context and query; bags of context rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import h32
from .places import ordered_places


def _by(seed: int, key: str = "row_idx"):
    return h32(seed, F.col("table_id"), F.col(key)), F.col(key)


def sample_rows(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """At most n rows of each table, without replacement."""
    rn = F.row_number().over(W.partitionBy("table_id").orderBy(*_by(seed)))
    return rows.withColumn("rn", rn).where(F.col("rn") <= n).drop("rn")


def sample_big(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows of one big table: a top-n by hash, no window."""
    return df.orderBy(h32(seed, F.col(key)), F.col(key)).limit(n)


def shuffle_rows(rows: DataFrame, seed: int) -> DataFrame:
    """row_idx replaced by the place in a random order of each table."""
    return rows.withColumn("row_idx", (F.row_number().over(W.partitionBy("table_id").orderBy(*_by(seed))) - 1).cast("long"))


def number_rows(rows: DataFrame, seed: int | None, parts: int = 1024) -> DataFrame:
    """row_idx of one big table replaced by its place in a random order (or in order, without a seed): places are counted within
    parts of the order and the parts' first places come from their counts, so no window holds all rows."""
    if seed is None:
        return ordered_places(rows, ["row_idx"], "_place").withColumn("row_idx", F.col("_place")).drop("_place")
    keyed = rows.withColumn("_part", F.floor(_by(seed)[0] / F.lit(4294967296 // parts)).cast("long"))
    before = keyed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_first", F.sum("_n").over(W.orderBy("_part")) - F.col("_n"))  # a row a part
    place = F.row_number().over(W.partitionBy("_part").orderBy(*_by(seed))) - 1 + F.col("_first")
    return keyed.join(before, "_part").withColumn("row_idx", place.cast("long")).drop("_part", "_n", "_first")


def rows_at(rows: DataFrame, places: DataFrame, seed: int, parts: int = 65_536) -> DataFrame:
    """The rows of number_rows() at places (row_idx), and others near them. The order's parts are counted; only rows of a part that holds one of the
    places are shuffled and sorted."""
    keyed = rows.withColumn("_h", _by(seed)[0]).withColumn("_part", F.floor(F.col("_h") / F.lit(4294967296 // parts)).cast("long"))
    before = keyed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_first"))  # a row a part
    marks = before.select(F.col("_first").alias("_at"), F.struct("_part", "_first").alias("_own")).unionByName(places.select(F.col("row_idx").alias("_at")).distinct(), allowMissingColumns=True)
    last = F.last("_own", ignorenulls=True).over(W.orderBy("_at", F.col("_own").isNull()).rowsBetween(W.unboundedPreceding, 0))  # a row a part and place
    hit = marks.withColumn("_last", last).where("_own is null").select("_last.*").distinct()
    place = F.row_number().over(W.partitionBy("_part").orderBy("_h", "row_idx")) - 1 + F.col("_first")
    return keyed.join(F.broadcast(hit), "_part").withColumn("row_idx", place.cast("long")).drop("_h", "_part", "_first")


def context_size(n, fit_size):
    """Number of context rows: an int, or a share of n."""
    if isinstance(fit_size, bool) or (isinstance(fit_size, float) and not 0 < fit_size < 1) or (isinstance(fit_size, int) and fit_size < 1):
        raise ValueError("fit_size must be a positive int or a share between 0 and 1")
    return F.floor(n * fit_size).cast("long") if isinstance(fit_size, float) else F.lit(fit_size).cast("long")


def split_fixed(rows: DataFrame, fit_size) -> DataFrame:
    """role 'context' for the first rows of each table; tables where a part would be empty go."""
    n = F.count(F.lit(1)).over(W.partitionBy("table_id"))
    k = context_size(F.col("n"), fit_size)
    return rows.withColumn("n", n).withColumn("k", k).where("k >= 1 and k < n").withColumn("role", F.when(F.col("row_idx") < F.col("k"), "context").otherwise("query")).drop("n", "k")


def split_query_range(rows: DataFrame, low: int, high: int, seed: int) -> DataFrame:
    """The query takes between low and high rows, drawn for each table, at most all but one; the rest is context."""
    low, high = max(1, min(low, high)), max(1, max(low, high))
    n = F.count(F.lit(1)).over(W.partitionBy("table_id"))
    lo, hi = F.least(F.lit(low), F.col("n") - 1), F.least(F.lit(high), F.col("n") - 1)
    size = lo + h32(seed, F.col("table_id")) % (hi - lo + 1)
    return rows.withColumn("n", n).where("n >= 2").withColumn("q", size).withColumn("role", F.when(F.col("row_idx") < F.col("n") - F.col("q"), "context").otherwise("query")).drop("n", "q")


def train_test_split(rows: DataFrame, test_share: float, seed: int) -> DataFrame:
    """role 'test' for a random share of each table's rows, rounded up."""
    by = W.partitionBy("table_id")
    return rows.withColumns({"rn": F.row_number().over(by.orderBy(*_by(seed))), "n": F.count(F.lit(1)).over(by)}).withColumn("role", F.when(F.col("rn") <= F.ceil(F.col("n") * F.lit(test_share)), "test").otherwise("train")).drop("rn", "n")


def bootstrap_places(spark: SparkSession, n_rows: int, bags: int, size: int, seed: int) -> DataFrame:
    """bag, draw, and a row_idx of 0 to n_rows - 1, drawn with replacement."""
    draws = spark.range(bags * size).select(F.floor(F.col("id") / size).cast("long").alias("bag"), (F.col("id") % size).alias("draw"))
    return draws.withColumn("row_idx", h32(seed, F.col("bag"), F.col("draw")) % n_rows)


def bootstrap_bags(rows: DataFrame, n_rows: int, bags: int, size: int, seed: int) -> DataFrame:
    """bag, draw, and a row drawn with replacement; row_idx of rows must be 0 to n_rows - 1. Every bag has size rows."""
    return bootstrap_places(rows.sparkSession, n_rows, bags, size, seed).join(rows, "row_idx")


def bag_starts(n: int, size: int, limit: int = 16) -> list[tuple[int, int]]:
    """(bag, first place) of overlapping windows over one permutation."""
    if n <= size:
        return [(0, 0)]
    bags = min(limit, math.ceil(n / size))
    return [(i, int((n - size) / (bags - 1) * i)) for i in range(bags)]


def window_places(spark: SparkSession, n_rows: int, size: int, limit: int = 16) -> DataFrame:
    """row_idx: the places of the windows of bags_of_places()."""
    starts = F.array(*(F.lit(s) for _, s in bag_starts(n_rows, size, limit)))
    return spark.range(len(bag_starts(n_rows, size, limit)) * size).select((F.element_at(starts, (F.floor(F.col("id") / size) + 1).cast("int")) + F.col("id") % size).alias("row_idx"))


def auto_bags(rows: DataFrame, n_rows: int, size: int, seed: int, limit: int = 16) -> DataFrame:
    """bag and its rows: windows of size places over one permutation of the table's rows (row_idx 0 to n_rows - 1)."""
    placed = number_rows(rows.withColumn("own_idx", F.col("row_idx")), seed)
    return bags_of_places(placed, n_rows, size, limit).withColumnRenamed("row_idx", "place").withColumnRenamed("own_idx", "row_idx")


def bags_of_places(placed: DataFrame, n_rows: int, size: int, limit: int = 16) -> DataFrame:
    """bag and its rows, where row_idx is a place in a permutation."""
    placed = placed.withColumnRenamed("row_idx", "place")
    starts = bag_starts(n_rows, size, limit)
    bags = F.explode(F.array(*(F.when((F.col("place") >= s) & (F.col("place") < s + max(size, 1) if n_rows > size else F.lit(True)), F.lit(b)) for b, s in starts)))
    return placed.withColumn("bag", bags).where("bag is not null").withColumnRenamed("place", "row_idx")


def predict_chunks(query: DataFrame, size: int) -> DataFrame:
    return query.withColumn("chunk", F.floor(F.col("row_idx") / size).cast("long"))


def hide_query_target(rows: DataFrame, target: str) -> DataFrame:
    return rows.withColumn(target, F.when(F.col("role") == "context", F.col(target)))
