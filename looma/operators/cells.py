"""Wide tables to long cells: one row for each table, row and column, with three typed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import feature_kind, nan_to_null

#: cells(table_id, row_idx, col_idx, col_name, kind, num, txt, ts)


def typed_cells(df: DataFrame, columns: list[str] | None = None) -> list[tuple[str, Column]]:
    """kind and struct (col_idx, col_name, kind, num, txt, ts) of each column, in the order of columns. Those without a kind are left out."""
    fields = [f for f in df.schema.fields if (columns is None or f.name in columns)]
    if columns is not None:
        fields = sorted(fields, key=lambda f: columns.index(f.name))
    made = []
    for i, f in enumerate(fields):
        kind, c = feature_kind(f.dataType), F.col(f"`{f.name}`")
        if kind is None:
            continue
        text = F.when(c, "True").otherwise("False") if f.dataType.typeName() == "boolean" else c.cast("string")
        if f.dataType.typeName() in ("array", "struct", "map"):
            text = F.to_json(c)
        made.append((kind, F.struct(
            F.lit(i).alias("col_idx"), F.lit(f.name).alias("col_name"), F.lit(kind).alias("kind"),
            (nan_to_null(c) if kind == "number" else F.lit(None).cast("double")).alias("num"),
            (F.when(c.isNotNull(), text) if kind == "text" else F.lit(None).cast("string")).alias("txt"),
            (c.cast("timestamp") if kind == "date" else F.lit(None).cast("timestamp")).alias("ts"),
        )))
    return made


def to_cells(df: DataFrame, table_id: Column, row_idx: Column, columns: list[str] | None = None) -> DataFrame:
    """One scan: an array of structs for each row, exploded. Columns without a kind are left out."""
    made = [cell for _, cell in typed_cells(df, columns)]
    rows = df.select(table_id.alias("table_id"), row_idx.alias("row_idx"), F.explode(F.array(*made)).alias("c"))
    return rows.select("table_id", "row_idx", "c.*")


def value(cells: str = "") -> Column:
    """A text that is equal for equal values of a column, null for missing ones."""
    return F.coalesce(F.col("num").cast("string"), F.col("txt"), F.col("ts").cast("string"))
