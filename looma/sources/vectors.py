"""A lasting cache of texts' vectors: a table in hash buckets that batches append to."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import embed


class EmbeddingCache:
    """text -> vector of one encoder, kept as Parquet in `buckets` hash buckets of the text below `path`; a new session finds
    what an earlier one has written.

    A batch's distinct texts are dealt to as many parts as there are buckets, so the joins with the cache read each bucket where its texts are and never
    shuffle the cache. Rows then meet the batch's vectors in a join of their own, which adaptive execution splits where one text has many rows.
    A batch first appends vectors of the texts that are missing, each encoded once, and then reads all of them from the table; a batch
    that fails in between is repeated without encoding twice. One batch at a time appends."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 200):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.name = "vectors_" + hashlib.sha256(self.path.encode()).hexdigest()[:24]
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (text STRING, vector ARRAY<DOUBLE>) USING parquet CLUSTERED BY (text) SORTED BY (text) INTO {buckets} BUCKETS LOCATION '{self.path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def embed(self, df: DataFrame, column: str, encoder: embed.Encoder) -> DataFrame:
        """df with vector, null where the text is null."""
        texts = df.select(F.col(column).alias("text")).where("text is not null").repartition(self.buckets, "text").distinct()
        missing = texts.join(self.table(), "text", "left_anti")
        new = embed.encode_distinct(missing, encoder).repartition(self.buckets, "text")
        new.write.mode("append").bucketBy(self.buckets, "text").sortBy("text").format("parquet").option("path", self.path).saveAsTable(self.name)
        found = texts.join(self.table(), "text").select(F.col("text").alias(column), "vector")
        return df.drop("vector").join(found, column, "left")
