"""Short texts for numbers and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import finite, fmt_num, h32

MODES = ("s0", "s1", "s2")


def fit_edges(rows: DataFrame, keys: list[str], bins: int = 10, x: str = "x") -> DataFrame:
    """Per column the bins + 1 interpolated quantiles of finite context values."""
    points = F.array(*(F.lit(i / bins) for i in range(bins + 1)))
    return rows.groupBy(*keys).agg(F.percentile(F.when(F.col("role") == "context", finite(F.col(x))), points).alias("edges"))


def quantile_bucket(edges: Column, v: Column, bins: int = 10) -> Column:
    """struct(lo, hi, p0, p1) of the bucket that holds v; values outside are clamped."""
    idx = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.size(F.filter(edges, lambda e: e <= v)) - 1))
    inside = F.struct(F.element_at(edges, idx + 1).alias("lo"), F.element_at(edges, idx + 2).alias("hi"), F.bround(100.0 * idx / bins, 0).cast("int").alias("p0"), F.bround(100.0 * (idx + 1) / bins, 0).cast("int").alias("p1"))
    return F.when(edges.isNull(), F.struct(v.alias("lo"), v.alias("hi"), F.lit(0).alias("p0"), F.lit(100).alias("p1"))).otherwise(inside)


def verbalize_numbers(rows: DataFrame, mode: str, keys: list[str] | None = None, bins: int = 10, x: str = "x", name: str = "col_name") -> DataFrame:
    """rows with text. The %.4g form is computed once for each distinct number and joined back."""
    if mode not in MODES or (mode == "s2" and keys is None):
        raise ValueError(mode)
    v = finite(F.col(x))
    if mode == "s2":
        rows = rows.join(fit_edges(rows, keys, bins, x), keys).withColumn("_b", quantile_bucket(F.col("edges"), v, bins)).drop("edges")
        need = rows.where(v.isNotNull()).select(F.explode(F.array("_b.lo", "_b.hi")).alias("_n"))
    else:
        need = rows.where(v.isNotNull()).select(v.alias("_n"))
    texts = need.distinct().select("_n", fmt_num(F.col("_n")).alias("_t"))
    if mode != "s2":
        out = rows.withColumn("_n", v).join(texts, "_n", "left").drop("_n")
        text = F.col("_t") if mode == "s0" else F.concat(F.col(name), F.lit(": "), F.col("_t"))
        return out.withColumn("text", F.coalesce(F.when(v.isNotNull(), text), F.lit(""))).drop("_t")
    out = rows.join(texts.select(F.col("_n").alias("_lo"), F.col("_t").alias("_tl")), F.col("_b.lo") == F.col("_lo"), "left").join(texts.select(F.col("_n").alias("_hi"), F.col("_t").alias("_th")), F.col("_b.hi") == F.col("_hi"), "left")
    text = F.format_string("%s: %s-%s (quantile %d-%d%%)", F.col(name), F.col("_tl"), F.col("_th"), F.col("_b.p0"), F.col("_b.p1"))
    return out.withColumn("text", F.when(v.isNotNull(), text).otherwise("")).drop("_b", "_lo", "_hi", "_tl", "_th")


def verbalize_date(name: Column, ts: Column, mode: str) -> Column:
    if mode not in MODES:
        raise ValueError(mode)
    iso = F.date_format(ts, "yyyy-MM-dd")
    long = F.concat(F.lit("year "), F.year(ts).cast("string"), F.lit(", "), F.date_format(ts, "MMMM"), F.lit(", "), F.date_format(ts, "EEEE"), F.lit(", Q"), F.quarter(ts).cast("string"))
    text = iso if mode == "s0" else F.concat(name, F.lit(": "), iso if mode == "s1" else long)
    return F.coalesce(text, F.lit(""))


def cell_texts(cells: DataFrame, mode: str, target: str | None = None, bins: int = 10) -> DataFrame:
    """Number and date cells with a text, edges from the context; the target and empty texts are left out."""
    own = cells.where(F.col("kind").isin("number", "date"))
    if target is not None:
        own = own.where(F.col("col_name") != target)
    numbers = verbalize_numbers(own.where("kind = 'number'"), mode, ["table_id", "col_idx"], bins, "num")
    dates = own.where("kind = 'date'").withColumn("text", verbalize_date(F.col("col_name"), F.col("ts"), mode))
    return numbers.unionByName(dates).where("text <> ''")


def placebo_vectors(texts: DataFrame, dim: int, seed: int) -> DataFrame:
    """The cells of cell_texts() with seeded standard-normal vectors."""
    u = lambda i, salt: (h32(seed, F.col("table_id"), F.col("row_idx"), F.col("col_idx"), i, F.lit(salt)) + 1) / 4294967297.0
    normal = lambda i: F.sqrt(-2 * F.log(u(i, "a"))) * F.cos(6.283185307179586 * u(i, "b"))
    return texts.withColumn("vector", F.transform(F.sequence(F.lit(1), F.lit(dim)), normal))
