"""Encoding of numbers, labels and dates. Statistics come from context rows only and are applied to all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import finite, h32, is_missing
from ..sources.scratch import written
from .places import running_sums

BINS, NAN_BIN, MAX_CLASSES, HIDDEN = 16, 63, 62, -100.0


def _context(x: Column) -> Column:
    return F.when(F.col("role") == "context", x)


def quantiles(rows: DataFrame, keys: list[str], x: str, points: list[float]) -> DataFrame:
    """keys, q: the interpolated quantiles of x at the points, null without a value; the numbers that percentile() gives.

    percentile() keeps all values of a group in one task. Here equal values are counted, put in order by ranges and summed up, so no group meets in one task
    and a task holds a range of the order."""
    counts = rows.groupBy(*keys, F.col(x).alias("_x")).agg(F.count(F.when(F.col(x).isNotNull(), True)).alias("_c"))
    run = written(running_sums(counts, [*keys, "_x"], "_c", "_to"), "quantiles")  # nulls count nothing
    own = [F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]
    size = run.groupBy(*own).agg(F.min(F.col("_to") - F.col("_c")).alias("_base"), F.sum("_c").alias("_n"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
    met, upto = run.join(size, same), F.col("_to") - F.col("_base")
    at = lambda place: F.max(F.when((upto - F.col("_c") <= place) & (place < upto), F.col("_x")))
    places = [(F.col("_n") - 1) * F.lit(p) for p in points]
    found = met.groupBy(*keys).agg(F.first("_n").alias("_n"), *(c.alias(f"_{w}{i}") for i, place in enumerate(places) for w, c in (("l", at(F.floor(place))), ("h", at(F.ceil(place))))))
    one = lambda i, place: F.when(F.col(f"_l{i}") == F.col(f"_h{i}"), F.col(f"_l{i}")).otherwise((F.ceil(place) - place) * F.col(f"_l{i}") + (place - F.floor(place)) * F.col(f"_h{i}"))
    return found.select(*keys, F.when(F.col("_n") > 0, F.array(*(one(i, p) for i, p in enumerate(places)))).alias("q"))


def quantile_edges(rows: DataFrame, keys: list[str], bins: int = BINS, x: str = "x") -> DataFrame:
    """Per column the interpolated quantiles at (2i+1)/2n of the context, between its least and largest value."""
    known = rows.select(*keys, _context(F.col(x)).cast("double").alias("_v"))
    ends = known.groupBy(*keys).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    agg = ends.join(quantiles(known, keys, "_v", [(2 * i + 1) / (2 * bins) for i in range(bins)]).withColumnRenamed("q", "mid"), keys)
    return agg.select(*keys, "mid", F.concat(F.array("lo"), "mid", F.array("hi")).alias("edges"))


def quantize(rows: DataFrame, keys: list[str], bins: int = BINS, x: str = "x") -> DataFrame:
    """rows with lower_bin, delta and bin. The edges are a small frame; the join is left to adaptive execution."""
    e, v = F.col("edges"), F.col(x)
    idx = F.greatest(F.lit(1), F.least(F.lit(bins - 1), F.size(F.filter(e, lambda y: y <= v)) - 1))
    out = rows.join(quantile_edges(rows, keys, bins, x), keys).withColumn("idx", F.when(v.isNotNull(), idx))
    step = F.greatest(F.element_at(e, F.col("idx") + 2) - F.element_at(e, F.col("idx") + 1), F.lit(1e-10))
    delta = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - F.element_at(e, F.col("idx") + 1)) / step))
    out = out.withColumns({"lower_bin": F.col("idx") - 1, "delta": F.when(v.isNotNull(), delta)})
    return out.withColumn("bin", F.rint(F.col("lower_bin") + F.col("delta")).cast("int")).drop("idx", "edges", "mid")


def replace_inf(rows: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Infinities to one beyond the finite range of their own role; without finite values all is null."""
    v, f = F.col(x), finite(F.col(x))
    ranges = rows.groupBy(*keys, "role").agg(F.min(f).alias("_lo"), F.max(f).alias("_hi"))
    clipped = F.when(v.isNotNull() & ~F.isnan(v) & F.col("_lo").isNotNull(), F.greatest(F.col("_lo") - 1, F.least(F.col("_hi") + 1, v)))
    return rows.join(ranges, [*keys, "role"]).withColumn(x, clipped).drop("_lo", "_hi")


def encode_numbers_binned(rows: DataFrame, keys: list[str], bins: int = BINS, x: str = "x") -> DataFrame:
    out = quantize(replace_inf(rows, keys, x), keys, bins, x)
    return out.withColumns({"bin": F.coalesce("bin", F.lit(NAN_BIN)), "lower_bin": F.coalesce("lower_bin", F.lit(NAN_BIN)), "delta": F.coalesce("delta", F.lit(0.0))})


def standard_scale(rows: DataFrame, keys: list[str], clip_q: float = 0.02, x: str = "x") -> DataFrame:
    """rows with z, and mean and std of the clipped context: clip to context quantiles, impute the mean, standardise. Statistics come from the
    keys and numbers alone; rows meet them in one join."""
    v = F.when(~is_missing(F.col(x)), F.greatest(F.lit(-1e100), F.least(F.lit(1e100), F.col(x).cast("double"))))
    clip = lambda c: F.when(c.isNotNull() & F.col("_q")[0].isNotNull(), F.greatest(F.col("_q")[0], F.least(F.col("_q")[1], c)))
    known = rows.select(*keys, _context(v).alias("_v"))
    q = quantiles(known, keys, "_v", [clip_q, 1 - clip_q]).withColumnRenamed("q", "_q")
    stats = known.where("_v is not null").join(q, keys).groupBy(*keys).agg(F.avg(clip(F.col("_v"))).alias("mean"), F.stddev_pop(clip(F.col("_v"))).alias("std"))
    stats = q.join(stats, keys, "left").select(*keys, "_q", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("std", F.lit(1.0)).alias("std"))
    z = (F.coalesce(clip(v), "mean") - F.col("mean")) / F.when(F.col("std") == 0, 1.0).otherwise(F.col("std"))
    return rows.join(stats, keys).withColumn("z", z).drop("_q")


def encode_numbers_scaled(rows: DataFrame, keys: list[str], clip_q: float = 0.02, x: str = "x") -> DataFrame:
    """Features: missing values get the plain context mean first, then standard_scale()."""
    filled = rows.withColumn(x, finite(F.col(x)))
    mean = filled.groupBy(*keys).agg(F.avg(_context(F.col(x))).alias("_mean"))
    return standard_scale(filled.join(mean, keys).withColumn(x, F.coalesce(F.col(x), F.col("_mean"))).drop("_mean"), keys, clip_q, x)


def number_statistics(rows: DataFrame, keys: list[str], clip_q: float = 0.02, x: str = "x") -> DataFrame:
    """What encode_numbers_scaled() takes from a table's context, apart from its rows: keys, fill (mean of finite values), low and
    high (quantiles of the filled ones), mean and std of the clipped ones. All null without a finite value."""
    own = rows.where("role = 'context'").withColumn("_v", finite(F.col(x)))
    fill = own.groupBy(*keys).agg(F.avg("_v").alias("fill"))
    filled = own.join(fill, keys).withColumn("_v", F.coalesce("_v", "fill"))
    ends = quantiles(filled.select(*keys, "_v"), keys, "_v", [clip_q, 1 - clip_q]).withColumnRenamed("q", "_q")
    clipped = filled.join(ends, keys).withColumn("_c", F.greatest(F.col("_q")[0], F.least(F.col("_q")[1], F.col("_v"))))
    return clipped.groupBy(*keys).agg(F.first("fill").alias("fill"), F.first(F.col("_q")[0]).alias("low"), F.first(F.col("_q")[1]).alias("high"), F.avg("_c").alias("mean"), F.stddev_pop("_c").alias("std"))


def scaled(x: Column, s: Column) -> Column:
    """The number that encode_numbers_scaled() makes of x, given a struct of number_statistics()."""
    v = F.greatest(s["low"], F.least(s["high"], F.coalesce(finite(x), s["fill"])))
    return F.when(s["fill"].isNull(), 0.0).otherwise((v - s["mean"]) / F.when(s["std"] == 0, 1.0).otherwise(s["std"]))


def label_ids(rows: DataFrame, keys: list[str], label: str, limit: int | None = MAX_CLASSES, seed: int = 0) -> DataFrame:
    """keys, label, class_id: the most frequent context labels (ties: least label) numbered in a random order."""
    n = rows.where((F.col("role") == "context") & F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    by = W.partitionBy(*keys)
    kept = n.withColumn("rank", F.row_number().over(by.orderBy(F.desc("n"), label)))
    if limit is not None:
        kept = kept.where(F.col("rank") <= limit)
    return kept.select(*keys, label, (F.row_number().over(by.orderBy(h32(seed, F.col(label)), label)) - 1).alias("class_id"))


def encode_labels(rows: DataFrame, keys: list[str], label: str, limit: int | None = MAX_CLASSES, seed: int = 0) -> DataFrame:
    ids = label_ids(rows, keys, label, limit, seed)
    return rows.join(ids, [*keys, label], "left").withColumn("class_id", F.coalesce("class_id", F.lit(MAX_CLASSES)).cast("int"))


def encode_target(rows: DataFrame, keys: list[str], task: str, x: str, seed: int = 0, clip_q: float = 0.02) -> DataFrame:
    """rows with target and delta (task: classification, binned or scaled); query rows are hidden: target -100, delta 0."""
    if task == "classification":
        out = encode_labels(rows, keys, x, seed=seed).withColumns({"target": F.col("class_id").cast("double"), "delta": F.lit(0.0)}).drop("class_id")
    elif task == "binned":
        out = quantize(rows, keys, x=x).withColumn("target", F.col("lower_bin").cast("double")).drop("lower_bin", "bin")
    else:
        out = standard_scale(rows, keys, clip_q, x).withColumns({"target": F.col("z"), "delta": F.lit(0.0)}).drop("z", "mean", "std")
    hidden = F.col("role") == "query"
    return out.withColumns({"target": F.when(hidden, HIDDEN).otherwise(F.col("target")), "delta": F.when(hidden, 0.0).otherwise(F.col("delta"))})


def disambiguate_classes(classes: DataFrame, keys: list[str]) -> DataFrame:
    """classes (class, vector, first_row): if two share a vector, all are renamed <rank of first row>_<class>."""
    by = W.partitionBy(*keys)
    rank = F.row_number().over(by.orderBy("first_row", "class")) - 1
    same = classes.groupBy(*keys).agg((F.count_distinct("vector") < F.count_distinct("class")).alias("same"))
    return classes.withColumn("rank", rank).join(same, keys).withColumn("name", F.when(F.col("same"), F.concat_ws("_", F.col("rank").cast("string"), F.col("class").cast("string"))).otherwise(F.col("class").cast("string"))).drop("rank", "same")


def date_parts(ts: Column) -> list[Column]:
    """year (2000 to 2050, from 1), month, day, weekday (Monday 1); 0 where the date is missing."""
    year = F.greatest(F.lit(2000), F.least(F.lit(2050), F.year(ts))) - 1999
    parts = (year, F.month(ts), F.dayofmonth(ts), F.weekday(ts) + 1)
    return [F.coalesce(F.when(ts.isNotNull(), p), F.lit(0)).cast("int").alias(n) for p, n in zip(parts, ("year", "month", "day", "weekday"), strict=True)]


def shift_mask(t: Column) -> Column:
    return F.when(t < 0, 0).otherwise(t + 1)


def interpolate_bins(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """rows (bin, delta) with the mix of the vectors (bin, vector) of a bin and the next one (at most 63)."""
    table = F.broadcast(vectors)  # NAN_BIN + 1 rows
    nxt = table.select(F.col("bin").alias("next_bin"), F.col("vector").alias("next_vector"))
    out = rows.withColumn("next_bin", F.least(F.col("bin") + 1, F.lit(NAN_BIN))).join(table, "bin").join(F.broadcast(nxt), "next_bin")
    return out.withColumn("vector", F.zip_with("vector", "next_vector", lambda a, b: a * (1 - F.col("delta")) + b * F.col("delta"))).drop("next_bin", "next_vector")
