"""Whole jobs: classify last columns, repack collections, diagnose rules, build training tasks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import assemble, embed, profile, split, tables, tasks
from ..sources import collection, shards, tablefiles
from ..sources.scratch import written


def classify_inputs(spark: SparkSession, root: str, pattern: str = "*.parquet") -> tuple[DataFrame, DataFrame]:
    """(path, group, label, reason, destination) of every table's last column, and the counts of labels. Tasks read the bytes of the
    last column only; its values are counted by path. The files of a folder named *.parquet are one table, whose path is the folder's."""
    values = tablefiles.last_values(spark, root, pattern).withColumn("path", tablefiles.table_path(F.col("path")))
    out = profile.last_columns(values).withColumn("r", profile.label_last_column())
    broken = F.max("error").isNotNull()
    errors = values.groupBy("path").agg(broken.alias("broken"))
    label = lambda c, v: F.when(F.col("broken"), v).otherwise(F.col(f"r.{c}"))
    out = errors.join(out.withColumnRenamed("table_id", "path"), "path").select("path", label("label", "unknown").alias("label"), label("reason", "read_error").alias("reason"))
    group, _ = collection.source_group(F.col("path"), root)
    out = out.withColumn("group", group).withColumn("destination", collection.destination(F.col("label"), F.col("group")))
    return out, profile.summarize_labels(out)


def route_inputs(spark: SparkSession, root: str, out: str) -> None:
    """The files below root with their labels, in folders by destination."""
    below = lambda c: F.substring_index(c, tablefiles.plain(root), -1)
    files = collection.list_files(spark, root).select(tablefiles.table_path(below(F.col("path"))).alias("below"), "content")
    labels = classify_inputs(spark, root)[0]
    collection.write_routed(files.join(labels.withColumn("below", below(F.col("path"))), "below").drop("below"), out)


def repack(spark: SparkSession, root: str, out: str, shard_mb: float, finished: DataFrame | None = None) -> DataFrame:
    """Tables under root, one of each content hash, packed into shards; returns the manifest document. A table comes in records of some megabytes
    (first_row, num_rows; table_rows counts all of its rows); it counts for the shard that holds its first one."""
    tables = written(tablefiles.read_blobs(spark, root), "tables")  # every file is decoded once
    if tables.isEmpty():
        raise ValueError(f"no Parquet file under {root}")
    per = tables.groupBy(F.col("path").alias("source_path")).agg(F.max("table_rows").alias("num_rows"), F.max("num_cols").alias("num_cols"), F.max("error").alias("error"))
    step = lambda at: F.element_at(F.split("source_path", "/"), at)
    first = shards.dedup_by_content_hash(per.withColumns({"name": step(-1), "source_chunk": step(-2)}))
    if finished is not None:
        first = first.join(finished.select(F.col("chunk").alias("source_chunk")), "source_chunk", "left_anti")
    first = written(first, "files")
    good = first.where("error is null and num_rows > 0 and num_cols > 0").select("source_path", "source_chunk", F.sha2("source_path", 256).alias("table_id"))
    record = F.format_string("%s#%015d", F.sha2("path", 256), F.col("first_row"))
    parts = tables.select(F.col("path").alias("source_path"), record.alias("record"), "first_row", "size").join(good, "source_path")
    packed = written(shards.pack_shards(parts.select("source_chunk", "source_path", F.col("record").alias("table_id"), "size"), int(shard_mb * 1e6)).withColumnRenamed("table_id", "record"), "packed")
    own = tables.select(F.col("path").alias("source_path"), "first_row", "num_rows", "num_cols", "table_rows", "table_bytes", record.alias("record"))
    shards.write_shards(own.join(good, "source_path"), packed, out, "record")
    skipped = first.where("error is not null or num_rows = 0 or num_cols = 0").groupBy(F.col("source_chunk").alias("chunk")).agg(F.count(F.lit(1)).alias("num_skipped"))
    begins = (F.col("first_row") == 0).cast("long")
    found = packed.join(parts.select("record", "first_row", F.col("source_chunk").alias("chunk")), "record").groupBy("chunk", F.concat(F.lit("shard="), "shard").alias("path")).agg(F.sum(begins).alias("num_tables"))
    last = found.groupBy("chunk").agg(F.min("path").alias("path"))
    found = found.join(last.join(skipped, "chunk").select("chunk", "path", "num_skipped"), ["chunk", "path"], "left").fillna(0, ["num_skipped"])
    return shards.build_manifest(found, root, shard_mb)


def diagnose(cells: DataFrame) -> dict[str, DataFrame]:
    """The reports on a sample of tables."""
    p = profile.profile_columns(cells)
    widths = p.groupBy("table_id").agg(F.count(F.lit(1)).alias("num_cols"))
    return {"routing": profile.compare_routing(p), "cardinality": profile.cardinality_histogram(p), "widths": profile.width_distribution(widths), "caps": profile.cap_impact(widths, (32, 64, 128, 256, 500)), "kinds": p.groupBy("kind").count()}


@dataclass(frozen=True)
class RunConfiguration:
    """Settings of a run that builds tasks; the defaults are those of the published configuration."""

    rules: profile.TableRules = profile.TableRules()
    query_rows: tuple[int, int] = (50, 900)
    target: str | None = None
    seed: int = 42
    balance: bool = True
    max_rows: int = 1000
    mixing_ratio: float = 0.8
    mode: str = "scaled"
    cell_text: str | None = None
    clip_q: float = 0.02
    workers: int = 1


def build_tasks(cells: DataFrame, config: RunConfiguration, encoder: embed.Encoder, dim: int, second: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """specs (task_id, table_id, target_column, is_regression, position, replay, from_a, place, worker), and the encoded cells of
    every task: tables within the limits of the rules (B4, B5), targets (C, D1 or D3), tasks balanced by replay (D4), a second
    source mixed in (D7), rows sampled, shuffled and split (E), cells encoded (F13). Tables of both sources have ids of their
    own."""
    own, specs = _specs(cells, config)
    if second is None:
        specs = tasks.epoch_places(specs, "task_id", config.seed, 0).withColumn("from_a", F.lit(True))
        every = own
    else:
        other, more = _specs(second, config)
        a, b = (tasks.epoch_places(x, "task_id", config.seed, 0).withColumnRenamed("place", "k") for x in (specs, more))
        specs = tasks.mix_sources(a, b, a.count(), b.count(), config.mixing_ratio, config.seed).drop("k")
        every = own.unionByName(other)
    specs = written(specs.withColumn("worker", F.pmod(F.col("place"), F.lit(config.workers)).cast("int")), "tasks")
    rows = every.select("table_id", "row_idx").distinct()
    kept = split.split_query_range(split.shuffle_rows(split.sample_rows(rows.withColumn("own_idx", F.col("row_idx")), config.max_rows, config.seed), config.seed), *config.query_rows, config.seed)
    placed = written(kept.select("table_id", F.col("own_idx").alias("row_idx"), F.col("row_idx").alias("place"), "role"), "placed")
    cut = every.join(placed, ["table_id", "row_idx"]).withColumn("row_idx", F.col("place")).drop("place")
    # a task is a table with a target; replays are the same task again, so it is encoded once
    once = specs.where("not replay").select("table_id", "target_column", "is_regression", _task().alias("task"))
    of_task = cut.join(once.select("table_id", "task"), "table_id").drop("table_id").withColumnRenamed("task", "table_id")
    targets = once.select(F.col("task").alias("table_id"), "target_column", "is_regression")
    encoded = assemble.encode_table(of_task, targets, encoder, dim, config.mode, config.cell_text, config.seed, config.clip_q)
    return specs, encoded.withColumnRenamed("table_id", "task_id")


def _task():
    """table_id/target_column; a target's own signs that separate are escaped, so two tasks never share a name."""
    target = F.col("target_column")
    for sign, code in (("%", "%25"), ("/", "%2F"), ("#", "%23")):
        target = F.replace(target, F.lit(sign), F.lit(code))
    return F.concat_ws("/", F.col("table_id"), target)


def _specs(cells: DataFrame, config: RunConfiguration) -> tuple[DataFrame, DataFrame]:
    """The cells of the tables within the rules' limits, and the specs of their tasks."""
    p = written(profile.profile_columns(cells), "profile")  # all cells are profiled once
    sizes = p.groupBy("table_id").agg(F.max("num_rows").alias("num_rows"), F.count(F.lit(1)).alias("num_cols"))
    fit = tables.with_min_rows(tables.within_feature_limit(sizes, config.rules.max_columns), config.rules.min_rows).select("table_id")
    fit = written(fit, "fit")  # of known size, so cells are not shuffled for a few tables
    p = p.join(fit, "table_id", "left_semi")
    chosen = tasks.choose_targets(p, config.seed, config.rules) if config.target is None else tasks.fixed_target_specs(p, config.target, config.rules)
    specs = written(tasks.order_specs(chosen, config.seed), "specs")
    specs = tasks.balance_by_replay(specs, config.seed) if config.balance else specs.withColumn("replay", F.lit(False))
    task = _task()
    copy = F.row_number().over(W.partitionBy("table_id", "target_column").orderBy("replay")) - 1
    return cells.join(fit, "table_id", "left_semi"), specs.withColumn("task_id", F.when(F.col("replay"), F.concat_ws("#", task, copy.cast("string"))).otherwise(task))


def write_tasks(specs: DataFrame, encoded: DataFrame, out: str) -> None:
    """Specs and encoded cells as Parquet, the cells in folders by target."""
    specs.write.mode("overwrite").parquet(f"{out}/specs")
    encoded.write.mode("overwrite").parquet(f"{out}/cells")
