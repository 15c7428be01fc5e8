"""Whole tables encoded in long form: one row for each feature cell and for each row's target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import embed, encode, tables, verbalize

#: encoded(table_id, row_idx, role, col_idx, col_name, kind, value, delta, parts, vector, text_vector): value is a bin or a
#: scaled number, parts those of a date, vector that of a text, text_vector that of a number's or date's words; the target
#: has the kind 'target'.
COLUMNS = ("table_id", "row_idx", "role", "col_idx", "col_name", "kind", "value", "delta", "parts", "vector", "text_vector")
KEYS = ["table_id", "col_idx"]


def encode_column_names(columns: DataFrame, target: str, encoder: embed.Encoder) -> DataFrame:
    """columns (table_id, col_idx, col_name) -> place (the target last), col_name, vector. Every distinct name is encoded once."""
    named, _ = embed.embed_texts(columns.select("table_id", "col_idx", "col_name").distinct(), "col_name", encoder)
    last = F.col("col_name") == target
    place = F.row_number().over(embed.W.partitionBy("table_id").orderBy(last, "col_idx")) - 1
    return named.select("table_id", "col_name", place.cast("int").alias("place"), "vector")


def encode_texts(cells: DataFrame, encoder: embed.Encoder, dim: int) -> DataFrame:
    """Text cells with a vector; the vector of a null text is zero."""
    out, _ = embed.embed_texts(cells, "txt", encoder)
    return out.withColumn("vector", F.coalesce("vector", F.array_repeat(F.lit(0.0), dim)))


def _filled(cells: DataFrame, **given) -> DataFrame:
    """cells with the columns of COLUMNS; those that are not given are null."""
    kinds = {"value": "double", "delta": "double", "parts": "array<int>", "vector": "array<double>", "text_vector": "array<double>"}
    return cells.select(*(given.get(c, F.lit(None).cast(kinds[c]) if c in kinds else F.col(c)).alias(c) for c in COLUMNS))


def encode_features(cells: DataFrame, encoder: embed.Encoder, dim: int, mode: str = "scaled", clip_q: float = 0.02) -> DataFrame:
    """Feature cells of tables (with role), statistics from their context only: numbers binned or scaled, dates in parts, texts
    as vectors. Columns without a value in the context go first."""
    own = tables.drop_all_null_columns(cells)
    numbers = own.where("kind = 'number'").withColumnRenamed("num", "x")
    if mode == "binned":
        numbers = encode.encode_numbers_binned(numbers, KEYS)
        numbers = _filled(numbers, value=F.col("lower_bin").cast("double"), delta=F.col("delta"))
    elif mode == "scaled":
        numbers = _filled(encode.encode_numbers_scaled(numbers, KEYS, clip_q), value=F.col("z"))
    else:
        raise ValueError(mode)
    dates = _filled(own.where("kind = 'date'"), parts=F.array(*encode.date_parts(F.col("ts"))))
    texts = _filled(encode_texts(own.where("kind = 'text'"), encoder, dim), vector=F.col("vector"))
    return numbers.unionByName(dates).unionByName(texts)


def encode_targets(cells: DataFrame, task: str, encoder: embed.Encoder, dim: int, seed: int = 0, clip_q: float = 0.02) -> DataFrame:
    """Target cells: task is 'classification' (class id and the vector of its name), 'binned' or 'scaled'; hidden in the query."""
    hidden = F.col("role") == "query"
    zero = F.array_repeat(F.lit(0.0), dim)
    if task == "classification":
        label = F.coalesce(F.col("txt"), F.col("num").cast("string"))
        out = encode.encode_target(cells.withColumn("x", label), KEYS, task, "x", seed)
        out, _ = embed.embed_texts(out, "x", encoder)
        return _filled(out, kind=F.lit("target"), value=F.col("target"), delta=F.col("delta"), vector=F.when(hidden, zero).otherwise(F.coalesce("vector", zero)))
    out = encode.encode_target(cells.withColumnRenamed("num", "x"), KEYS, task, "x", seed, clip_q)
    return _filled(out, kind=F.lit("target"), value=F.col("target"), delta=F.col("delta"))


def encode_table(cells: DataFrame, targets: DataFrame, encoder: embed.Encoder, dim: int, mode: str = "scaled", cell_text: str | None = None, seed: int = 0, clip_q: float = 0.02) -> DataFrame:
    """cells (with role) and targets (table_id, target_column, is_regression) -> encoded features and targets of each table.

    mode: how numbers and regression targets are encoded, 'binned' or 'scaled'. cell_text: the words of number and date cells
    (s0, s1, s2), whose vectors go to text_vector; a cell without words has none. Cells of other tables are left out."""
    marked = written(cells.join(targets.select("table_id", "target_column", "is_regression"), "table_id"), "marked")  # read by every branch below
    is_target = F.col("col_name") == F.col("target_column")
    features = encode_features(marked.where(~is_target).drop("target_column", "is_regression"), encoder, dim, mode, clip_q)
    if cell_text is not None:
        words = verbalize.cell_texts(marked.where(~is_target).select(*cells.columns), cell_text)
        words, _ = embed.embed_texts(words.select("table_id", "row_idx", "col_idx", "text"), "text", encoder)
        words = words.select("table_id", "row_idx", "col_idx", F.col("vector").alias("words"))
        features = features.join(words, ["table_id", "row_idx", "col_idx"], "left").withColumn("text_vector", F.col("words")).select(*COLUMNS)
    own = marked.where(is_target)
    classes = encode_targets(own.where(~F.col("is_regression")).drop("target_column", "is_regression"), "classification", encoder, dim, seed)
    numbers = encode_targets(own.where("is_regression").drop("target_column", "is_regression"), mode, encoder, dim, seed, clip_q)
    return features.unionByName(classes).unionByName(numbers)
