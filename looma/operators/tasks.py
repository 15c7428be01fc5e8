"""Choosing targets, balancing and mixing tasks, and their order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import h32
from ..sources.scratch import written
from .places import ordered_places
from .profile import TableRules, route

MAX = 4294967296.0


def choose_targets(profile: DataFrame, seed: int, rules: TableRules = TableRules()) -> DataFrame:
    """At most one regression and one classification target of each table, by a hash of table and column."""
    tasks = profile.withColumn("task", route(rules)).where("task <> 'none'")
    salt = F.when(F.col("task") == "regression", 0).otherwise(1)
    rn = F.row_number().over(W.partitionBy("table_id", "task").orderBy(h32(seed, F.col("table_id"), salt, F.col("col_name")), "col_name"))
    return tasks.withColumn("rn", rn).where("rn = 1").select("table_id", F.col("col_name").alias("target_column"), (F.col("task") == "regression").alias("is_regression"))


def order_specs(specs: DataFrame, seed: int) -> DataFrame:
    """position 0 or 1 of the specs of a table."""
    flip = h32(seed, F.col("table_id"), 2) % 2
    rn = F.row_number().over(W.partitionBy("table_id").orderBy(F.when(flip == 0, ~F.col("is_regression")).otherwise(F.col("is_regression"))))
    return specs.withColumn("position", (rn - 1).cast("int"))


def fixed_target_specs(profile: DataFrame, target: str | None = None, rules: TableRules = TableRules()) -> DataFrame:
    """One spec a table: the named target or the last column; tables whose target has no task go."""
    own = profile.where(F.col("col_name") == target) if target else profile.join(profile.groupBy("table_id").agg(F.max("col_idx").alias("col_idx")), ["table_id", "col_idx"], "left_semi")
    return own.withColumn("task", route(rules)).where("task <> 'none'").select("table_id", F.col("col_name").alias("target_column"), (F.col("task") == "regression").alias("is_regression"))


def balance_by_replay(specs: DataFrame, seed: int, salts: int = 64) -> DataFrame:
    """specs with replays (replay true) of the rarer task, drawn with replacement, until both are equally many.

    Specs are numbered within `salts` parts by hash and the parts are counted, so no window holds them all."""
    keyed = specs.withColumn("part", F.pmod(F.xxhash64("table_id", "target_column"), F.lit(salts)))
    counts = {r["is_regression"]: r["n"] for r in specs.groupBy("is_regression").agg(F.count(F.lit(1)).alias("n")).collect()}
    few, many = sorted((counts.get(True, 0), counts.get(False, 0)))
    out = specs.withColumn("replay", F.lit(False))
    if not few or few == many:
        return out
    rare = counts.get(True, 0) == few
    own = keyed.where(F.col("is_regression") == rare)
    before = own.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("first", F.sum("n").over(W.orderBy("part")) - F.col("n"))
    numbered = own.withColumn("rn", F.row_number().over(W.partitionBy("part").orderBy("table_id", "target_column")) - 1).join(F.broadcast(before), "part").withColumn("number", F.col("first") + F.col("rn"))
    draws = specs.sparkSession.range(many - few).select((h32(seed, F.col("id")) % few).alias("number"))
    return out.unionByName(draws.join(numbered, "number").select(*specs.columns, F.lit(True).alias("replay")))


#: Specs of a task's history that a replay is drawn from: the latest ones.
HISTORY = 50_000


def replay_places(specs: DataFrame, seed: int, history: int = HISTORY, part: int = 32_768) -> DataFrame:
    """specs (table_id, target_column, is_regression, table_place: the table's place in the order of a run, position in the table) -> the
    whole sequence: place, seq (the spec that a row is or stands behind), replay, and the spec.

    A table's specs enter the histories of their tasks together. As long as one history is empty nothing is replayed. At the first spec
    after that the rarer task is replayed until both have come equally often, and from then on every spec leaves one missing on the other
    side, so exactly one replay of the other task follows it. Each is drawn, with replacement, from the latest `history` specs of its task.
    Running counts are taken within parts of the order, and a row a part is summed up; draws meet their specs in a join by number."""
    spark, reg = specs.sparkSession, F.col("is_regression").cast("long")
    kept = ["table_id", "target_column", "is_regression"]
    keyed = specs.select(*kept, "table_place", "position", F.floor(F.col("table_place") / part).alias("part"))
    per = keyed.groupBy("part").agg(F.sum(reg).alias("r"), F.count(F.lit(1)).alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # over a row a part
    per = per.select("part", F.coalesce(F.sum("r").over(before), F.lit(0)).alias("r0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    row, table = W.partitionBy("part").orderBy("table_place", "position"), W.partitionBy("part").orderBy("table_place").rangeBetween(W.unboundedPreceding, 0)
    counts = {"r": F.sum(reg).over(row), "n": F.row_number().over(row), "hr": F.sum(reg).over(table), "hn": F.count(F.lit(1)).over(table)}
    run = keyed.withColumns(counts).join(per, "part")
    run = run.select(*kept, (F.col("n0") + F.col("n") - 1).alias("seq"), (F.col("r0") + F.col("r")).alias("r"), (F.col("r0") + F.col("hr")).alias("h_r"), (F.col("n0") + F.col("hn") - F.col("r0") - F.col("hr")).alias("h_c"))
    run = written(run.withColumn("number", F.when(F.col("is_regression"), F.col("r")).otherwise(F.col("seq") + 1 - F.col("r")) - 1), "run")
    first = run.where("h_r > 0 and h_c > 0").agg(F.min_by(F.struct("seq", "r", "h_r", "h_c"), "seq").alias("s")).first()["s"]
    originals = lambda place: run.select(place.cast("long").alias("place"), "seq", F.lit(False).alias("replay"), *kept)
    if first is None:
        return originals(F.col("seq"))
    at, gap = first["seq"], abs(2 * first["r"] - first["seq"] - 1)
    rarer = 2 * first["r"] < at + 1
    catch_up = spark.range(gap).select(F.lit(at).cast("long").alias("seq"), (F.col("id") + 1).alias("k"), F.lit(rarer).alias("is_regression"), F.lit(first["h_r"] if rarer else first["h_c"]).cast("long").alias("h"), (F.col("id") + at + 1).alias("place"))
    later = run.where(F.col("seq") > at)
    behind = at + gap + 1 + 2 * (F.col("seq") - at - 1)
    other = ~F.col("is_regression")
    answers = later.select("seq", F.lit(1).cast("long").alias("k"), other.alias("is_regression"), F.when(other, F.col("h_r")).otherwise(F.col("h_c")).alias("h"), (behind + 1).alias("place"))
    draws = catch_up.unionByName(answers)
    size = F.least("h", F.lit(history))
    draws = draws.withColumn("number", F.col("h") - size + h32(seed, F.col("seq"), F.col("k")) % size)
    replays = draws.join(run.select("is_regression", "number", "table_id", "target_column"), ["is_regression", "number"]).select("place", "seq", F.lit(True).alias("replay"), *kept)
    return originals(F.when(F.col("seq") <= at, F.col("seq")).otherwise(behind)).unionByName(replays)


def balance_by_skip(specs: DataFrame, seed: int) -> DataFrame:
    """The task with a share above one half loses each spec with probability 2 (share - 0.5)."""
    total = specs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_regression").cast("long")).alias("r"))
    share = F.when(F.col("is_regression"), F.col("r") / F.col("n")).otherwise(1 - F.col("r") / F.col("n"))
    return specs.crossJoin(F.broadcast(total)).where(h32(seed, F.col("table_id"), F.col("target_column")) / MAX >= 2 * (share - 0.5)).drop("n", "r")


def routing_mix(seq: DataFrame, every: int) -> DataFrame:
    """seq (seq from 1, is_regression) -> after every so many specs the counts so far and the share of regression.

    Counts are taken for each stretch first; only one row a stretch goes through the running sum."""
    part = seq.groupBy(F.floor((F.col("seq") - 1) / every).cast("long").alias("part")).agg(F.sum(F.col("is_regression").cast("long")).alias("r"), F.count(F.lit(1)).alias("n"))
    run = W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)
    out = part.withColumns({"regression": F.sum("r").over(run), "specs": F.sum("n").over(run)}).where(F.col("n") == every)
    return out.select("specs", "regression", (F.col("specs") - F.col("regression")).alias("classification"), (F.col("regression") / F.col("specs")).alias("regression_share"))


def mix_sources(a: DataFrame, b: DataFrame, n_a: int, n_b: int, ratio: float, seed: int) -> DataFrame:
    """a and b (each with k from 0) in one order: draw d takes the next of a with probability ratio, else of b; all rows of
    both appear once. The k-th item of a source sorts at the place of that source's k-th draw, or after all draws."""
    spark = a.sparkSession
    total = n_a + n_b
    draws = spark.range(total).select(F.col("id").alias("draw"), (h32(seed, F.col("id")) / MAX < ratio).alias("from_a"), F.floor(F.col("id") / 4096).cast("long").alias("part"))
    per = draws.groupBy("part").agg(F.sum(F.col("from_a").cast("long")).alias("na"), F.count(F.lit(1)).alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("part", F.coalesce(F.sum("na").over(before), F.lit(0)).alias("a0"), F.coalesce(F.sum(F.col("n") - F.col("na")).over(before), F.lit(0)).alias("b0"))
    own = W.partitionBy("part").orderBy("draw")
    na = F.sum(F.col("from_a").cast("long")).over(own)
    placed = draws.withColumns({"na": na, "rn": F.row_number().over(own)}).join(per, "part")
    placed = placed.select("draw", "from_a", F.when(F.col("from_a"), F.col("a0") + F.col("na") - 1).otherwise(F.col("b0") + F.col("rn") - F.col("na") - 1).alias("k"))
    both = a.withColumn("from_a", F.lit(True)).unionByName(b.withColumn("from_a", F.lit(False)))
    late = F.when(F.col("draw").isNull(), total + F.col("k")).otherwise(F.col("draw"))
    return both.join(placed, ["from_a", "k"], "left").withColumn("place", late).drop("draw")


def numbered(df: DataFrame, key: str) -> DataFrame:
    """df with k, its place in the order of a key."""
    return ordered_places(df, [key], "k")


def epoch_places(items: DataFrame, key: str, seed: int, epoch: int, parts: int = 1024) -> DataFrame:
    """items with place, their place in the order of an epoch; no window holds all items."""
    h = h32(seed, epoch, F.col(key))
    keyed = items.withColumn("_part", F.floor(h / F.lit(4294967296 // parts)).cast("long"))
    before = keyed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_first", F.sum("_n").over(W.orderBy("_part")) - F.col("_n"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(h, F.col(key))) - 1 + F.col("_first")
    return keyed.join(before, "_part").withColumn("place", place.cast("long")).drop("_part", "_n", "_first")


def buffered_shuffle(items: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """items in a random order; a size of 1 or less keeps their order. Spark sorts with spill, so the size bounds nothing else."""
    return items.orderBy(key) if size <= 1 else epoch_order(items, key, seed, 0)


def epoch_order(items: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """items in the order of an epoch; a distributed sort, which also is the shuffle of rows."""
    return items.orderBy(h32(seed, epoch, F.col(key)), F.col(key))


def assign_workers(files: DataFrame, n: int) -> DataFrame:
    """files (path, chunk) -> worker: strided over the paths in order, offsets of chunks by counts."""
    per = files.groupBy("chunk").agg(F.count(F.lit(1)).alias("c")).withColumn("first", F.sum("c").over(W.orderBy("chunk")) - F.col("c"))
    rn = F.row_number().over(W.partitionBy("chunk").orderBy("path")) - 1
    return files.withColumn("rn", rn).join(F.broadcast(per), "chunk").withColumn("worker", F.pmod(F.col("first") + F.col("rn"), F.lit(n)).cast("int")).select("path", "chunk", "worker")
