"""Packing many small tables into shards, with a manifest, resumably."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.places import running_sums
from .scratch import written

#: shard record: table_id, source_path, source_chunk, first_row, num_rows, num_cols, table_rows, table_bytes
MANIFEST = "struct<version:int, blob_format:string, input_root:string, shard_size_mb:double, dedup_by_hash:boolean, num_shards:long, num_tables:long, num_skipped:long, shards:array<struct<path:string, num_tables:long, chunk:string>>>"


def content_hash(name: Column) -> Column:
    return F.substring_index(name, "=__", 1)


def dedup_by_content_hash(tables: DataFrame, within: str = "source_chunk") -> DataFrame:
    """The first file (in path order) of each hash in a chunk. Decided before reading, so an unreadable first copy hides
    the others."""
    rn = F.row_number().over(W.partitionBy(within, content_hash(F.col("name"))).orderBy("source_path"))
    return tables.withColumn("rn", rn).where("rn = 1").drop("rn")


def pack_shards(tables: DataFrame, target_bytes: int) -> DataFrame:
    """tables (source_chunk, source_path, table_id, size) -> table_id, shard: shards of a chunk are filled in path order and
    closed when they reach target_bytes.

    A shard that starts at a table ends at the first one whose running sum of sizes reaches target_bytes, so every table has a next start; those that are
    starts are found from the first one by pointer doubling: known starts jump by 1, 2, 4, ... shards, and the jumps double in a join. No chunk is
    ever one group, however many tables it has; only sizes are handled, never tables. Tables of size 0 end no shard."""
    files = tables.select("source_chunk", "source_path", "table_id", F.col("size").cast("long").alias("size"))
    run = written(running_sums(files, ["source_chunk", "source_path", "table_id"], "size", "total"), "sizes")
    base = run.groupBy("source_chunk").agg(F.min(F.col("total") - F.col("size")).alias("base"), F.min("place").alias("first"), F.max("place").alias("last"))
    run = run.join(base, "source_chunk").withColumn("total", F.col("total") - F.col("base"))
    # the first table whose running sum reaches what a table before it asks for: within buckets of sizes, else the first of a later bucket.
    # Windows run backwards from their end, since Spark reads a frame that ends at the last row anew for every row
    wide = max(1, target_bytes)
    bucket = F.floor(F.col("at") / wide)
    points = run.select("source_chunk", F.col("total").alias("at"), "place", F.lit(None).cast("long").alias("asks"))
    asks = run.select("source_chunk", (F.col("total") - F.col("size") + target_bytes).alias("at"), F.lit(None).cast("long").alias("place"), F.col("place").alias("asks"))
    both = points.unionByName(asks).withColumn("bucket", bucket)
    later = both.groupBy("source_chunk", "bucket").agg(F.min("place").alias("least"))
    back = W.partitionBy("source_chunk").orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)
    later = later.withColumn("later", F.min("least").over(back))  # a row for each target_bytes of a chunk; places rise with buckets
    ahead = W.partitionBy("source_chunk", "bucket").orderBy(F.desc("at"), F.col("place").isNull(), F.desc("place")).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("end", F.min("place").over(ahead)).where("asks is not null").join(later.select("source_chunk", "bucket", "later"), ["source_chunk", "bucket"])
    end = F.coalesce("end", "later")
    jump = found.join(base.select("source_chunk", "last"), "source_chunk").where(end < F.col("last")).select(F.col("asks").alias("start"), (end + 1).alias("next"))
    jump, starts = written(jump, "jumps"), base.select(F.col("first").alias("start"))
    while True:
        new = written(starts.join(jump, "start").select(F.col("next").alias("start")), "starts")
        if new.isEmpty():
            break
        starts = written(starts.unionByName(new), "starts")
        jump = written(jump.join(jump.select(F.col("start").alias("next"), F.col("next").alias("far")), "next").select("start", F.col("far").alias("next")), "jumps")
    marked = run.join(starts.select(F.col("start").alias("place"), F.lit(1).cast("long").alias("opens")), "place", "left").fillna(0, ["opens"])
    counted = running_sums(marked.select("source_chunk", "table_id", F.col("place").alias("at"), "first", "opens"), ["at"], "opens", "n").drop("place")
    own = counted.where(F.col("at") == F.col("first")).select("source_chunk", F.col("n").alias("n0"))
    name = F.format_string("shard-%s-%04d", F.col("source_chunk"), F.col("n") - F.col("n0"))
    return counted.join(own, "source_chunk").select("table_id", name.alias("shard"))


def build_manifest(parts: DataFrame, input_root: str, shard_size_mb: float, dedup: bool = True) -> DataFrame:
    """parts (chunk, path, num_tables, num_skipped) -> one JSON document with all shards and the totals."""
    shards = F.array_sort(F.collect_list(F.struct("path", "num_tables", "chunk")))
    total = parts.agg(F.count(F.lit(1)).alias("num_shards"), F.coalesce(F.sum("num_tables"), F.lit(0)).alias("num_tables"), F.coalesce(F.sum("num_skipped"), F.lit(0)).alias("num_skipped"), shards.alias("shards"))
    doc = F.struct(F.lit(1).alias("version"), F.lit("arrow-ipc").alias("blob_format"), F.lit(input_root).alias("input_root"), F.lit(float(shard_size_mb)).alias("shard_size_mb"), F.lit(dedup).alias("dedup_by_hash"), "num_shards", "num_tables", "num_skipped", "shards")
    return total.select(F.to_json(doc).alias("manifest"))


def read_manifest(spark: SparkSession, text: str) -> DataFrame:
    """path, num_tables, chunk of every shard of a manifest document."""
    one = spark.createDataFrame([(text,)], "t string")
    return one.select(F.from_json("t", MANIFEST).alias("m")).select(F.explode("m.shards").alias("s")).select("s.*")


def read_shards(spark: SparkSession, manifest: str, root: str, min_rows: int = 1) -> DataFrame:
    """The shard records that a manifest lists, without tables under min_rows; sizes are filtered before any blob is read."""
    paths = [f"{root}/{s['path']}" for s in json.loads(manifest)["shards"]]
    return spark.read.parquet(*paths).where(F.col("table_rows") >= min_rows)


def write_shards(tables: DataFrame, shards: DataFrame, out: str, key: str = "table_id") -> None:
    tables.join(shards, key).repartition("shard").write.mode("append").partitionBy("shard").parquet(out)


def unfinished(chunks: DataFrame, parts: DataFrame) -> DataFrame:
    """Chunks without a valid part record."""
    return chunks.join(parts.where("valid").select("chunk"), "chunk", "left_anti")


def write_outputs(data: DataFrame, predictions: DataFrame, metrics: DataFrame, out: str) -> None:
    """Parquet and CSV of the data, CSV of predictions, JSON of metrics."""
    data.write.mode("overwrite").parquet(f"{out}/data.parquet")
    data.write.mode("overwrite").option("header", True).csv(f"{out}/data.csv")
    predictions.write.mode("overwrite").option("header", True).csv(f"{out}/predictions.csv")
    metrics.write.mode("overwrite").json(f"{out}/metrics.json")
