"""Places of rows in a global order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written


#: Rows of a part of an order that one window sums up.
PART = 65_536


def ordered_places(df: DataFrame, keys: list[str], name: str, parts: int | None = None) -> DataFrame:
    """df with its place (from 0) in the order of keys, whatever their types and however sparse they are.

    Rows are dealt to ranges by Spark's own sample of quantiles, sorted within them and written with their number there, since
    another run could draw other ranges; a row for each range then says how many come before."""
    spark = df.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = written(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "places").withColumn("_range", F.shiftright("_at", 33))
    before = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_first", F.sum("_n").over(W.orderBy("_range")) - F.col("_n"))  # a row a range
    place = F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(before), "_range").withColumn(name, place.cast("long")).drop("_range", "_at", "_n", "_first")


def running_sums(df: DataFrame, keys: list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """df with its place and the sum of `value` up to and with each row, in the order of keys."""
    rows = ordered_places(df, keys, "place", parts)
    part = F.floor(F.col("place") / PART)
    own = rows.withColumns({"_part": part, "_own": F.sum(value).over(W.partitionBy(part).orderBy("place"))})
    before = rows.groupBy(part.alias("_part")).agg(F.sum(value).alias("_sum")).withColumn("_before", F.sum("_sum").over(W.orderBy("_part")) - F.col("_sum"))  # a row a part
    return own.join(before, "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_own", "_sum", "_before")
