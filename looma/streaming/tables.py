"""Arriving table files and running task counts, as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.core import h32
from ..operators import profile, tasks
from ..sources import collection, tablefiles
from ..sources.scratch import scratch_folder, written


def stream_tables(spark: SparkSession, root: str, specs_path: str, checkpoint: str, seed: int = 0, trigger: dict | None = None):
    """New Parquet files under root: their targets are chosen and written once for each table id. A table is a file, or a folder named *.parquet
    whose files arrive together. Only paths go through the stream; tasks read ranges of the files.

    A batch that is run again writes to the folder of its own run and number once more, and tables whose specs another folder holds are left out
    before they are decoded. So nothing appears twice, also when the checkpoint is lost and every file arrives anew. A table
    counts as done with its specs; one without a target is looked at again by a new run."""
    near = tablefiles.reachable(root)
    files = spark.readStream.format("binaryFile").schema(collection.FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root).select("path", *([] if near else ["content"]))

    def batch(frame: DataFrame, number: int) -> None:
        session = frame.sparkSession
        run = session.sparkContext.getLocalProperty("sql.streaming.queryId")  # lasts as long as the checkpoint
        frame = frame.withColumn("table_id", tablefiles.table_path(F.col("path")))
        try:
            done = session.read.parquet(specs_path).where(~((F.col("run") == run) & (F.col("batch") == number))).select("table_id").distinct()
        except AnalysisException:  # nothing has been written yet
            done = None
        fresh = frame if done is None else frame.join(done, "table_id", "left_anti")
        cells = tablefiles.read_files(fresh.drop("table_id")).withColumn("table_id", tablefiles.table_path(F.col("table_id")))
        found = written(profile.profile_columns(cells), "profiles")  # an unreadable file gives a row without a column; its table goes
        whole = found.join(found.where("col_idx is null").select("table_id"), "table_id", "left_anti")
        tasks.choose_targets(whole, seed).write.mode("overwrite").parquet(f"{specs_path}/run={run}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def task_counts(specs: DataFrame) -> DataFrame:
    """Running counts of both tasks, for update mode."""
    return specs.groupBy("is_regression").agg(F.count(F.lit(1)).alias("n"))


#: Keys that share the running counts of a stream.
SHARES = 32
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Share(StatefulProcessor):
    """One of the keys that share a stream's counts: specs it has let through, and how many of them are regression."""

    def __init__(self, warm_up: int):
        self.warm_up = warm_up

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "seen long, regression long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (names of the interface)
        seen, regression = self.counts.get() if self.counts.exists() else (0, 0)
        batch = pd.concat(list(rows)).sort_values("seq")
        kept = []
        for is_regression, chance in zip(batch["is_regression"].tolist(), batch["chance"].tolist(), strict=True):
            share = (regression if is_regression else seen - regression) / seen if seen else 0.0
            keep = seen < self.warm_up or share <= 0.5 or chance >= 2 * (share - 0.5)
            kept.append(keep)
            seen, regression = seen + keep, regression + (keep and is_regression)
        self.counts.update((seen, regression))
        yield batch[kept][["share", "seq", "table_id", "is_regression"]]

    def close(self) -> None:
        pass


def running_skip(specs: DataFrame, seed: int, warm_up: int = 50, shares: int = SHARES) -> DataFrame:
    """A stream of specs (seq, table_id, is_regression) without those whose task has had too large a share so far: share, seq, table_id, is_regression.

    The running counts are kept by `shares` keys, to which specs are dealt in turn, so no key sees more than its part of the stream. A key applies the
    rule to what it has let through itself, after its part of the warm-up; its counts are sums, so those of all keys add up to the stream's
    (task_counts()). Within a batch a key takes specs in the order of seq. Needs the RocksDB state store."""
    share = F.pmod("seq", F.lit(shares)).cast("int")
    keyed = specs.select(share.alias("share"), "seq", "table_id", "is_regression", (h32(seed, F.col("seq")) / F.lit(4294967296.0)).alias("chance"))
    return keyed.groupBy("share").transformWithStateInPandas(_Share(-(-warm_up // shares)), "share int, seq long, table_id string, is_regression boolean", "Append", "None")


def run_to_table(stream: DataFrame, what: str) -> DataFrame:
    """What a stream gives for all that has arrived so far, written to the shared folder, with its checkpoint beside it."""
    spark, path = stream.sparkSession, scratch_folder(stream.sparkSession, what)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
