"""Filters and projections of tables: constant and empty columns, caps, row chunks, least sizes, features and target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import h32
from .cells import value


def drop_constant_columns(cells: DataFrame, target: str | None = None) -> DataFrame:
    """Features with exactly one distinct value that is not null go, over context and query together; all-null ones stay."""
    kept = constant_columns(cells, ["table_id"]).where(~F.col("constant") | F.coalesce(F.col("col_name") == F.lit(target), F.lit(False)))
    return cells.join(kept.select("table_id", "col_idx"), ["table_id", "col_idx"], "left_semi")


def constant_columns(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, col_idx, col_name, constant: whether the column's least value that is not null is its largest, too."""
    ends = cells.groupBy(*keys, "col_idx", "col_name").agg(F.min(value()).alias("least"), F.max(value()).alias("most"))
    return ends.withColumn("constant", F.coalesce(F.col("least") == F.col("most"), F.lit(False)))


def drop_all_null_columns(cells: DataFrame) -> DataFrame:
    """Columns without a value in the context go, from context and query."""
    seen = cells.where("role = 'context'").groupBy("table_id", "col_idx").agg(F.count(value()).alias("n")).where("n > 0").drop("n")
    return cells.join(seen, ["table_id", "col_idx"], "left_semi")


def cap_columns(columns: DataFrame, cap: int, seed: int, target: str) -> DataFrame:
    """columns (table_id, col_name) -> those kept: all if at most cap, else cap - 1 sampled features and the target."""
    by = W.partitionBy("table_id")
    rank = F.row_number().over(by.orderBy(F.col("col_name") == target, h32(seed, F.col("table_id"), F.col("col_name")), "col_name"))
    return columns.withColumns({"rn": rank, "n": F.count(F.lit(1)).over(by)}).where((F.col("n") <= cap) | (F.col("col_name") == target) | (F.col("rn") < cap)).select("table_id", "col_name")


def within_feature_limit(tables: DataFrame, limit: int | None) -> DataFrame:
    return tables if limit is None else tables.where(F.col("num_cols") - 1 <= limit)


def with_min_rows(tables: DataFrame, n: int, one: bool = False) -> DataFrame:
    """Tables of at least n rows; for one table, fewer are an error."""
    if one and tables.where(F.col("num_rows") < n).limit(1).count():
        raise ValueError(f"the table has fewer than {n} rows")
    return tables.where(F.col("num_rows") >= n)


def split_xy(df: DataFrame, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Features and target; the last column unless one is named."""
    target = df.columns[-1] if target is None else target
    if target not in df.columns:
        raise ValueError(f"no column {target}")
    return df.drop(target), df.select(target)


def row_chunks(rows: DataFrame, batch_size: int, min_rows: int) -> DataFrame:
    """Consecutive chunks of each table's rows (row_idx from 0), each a table of its own; short ones go."""
    chunked = rows.withColumn("chunk_idx", F.floor(F.col("row_idx") / batch_size).cast("long"))
    sizes = chunked.groupBy("table_id", "chunk_idx").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows).drop("n")
    return chunked.join(sizes, ["table_id", "chunk_idx"], "left_semi")


def probe(chunked: DataFrame) -> DataFrame:
    """Only the first chunk of each table."""
    first = chunked.groupBy("table_id").agg(F.min("chunk_idx").alias("chunk_idx"))
    return chunked.join(first, ["table_id", "chunk_idx"], "left_semi")
