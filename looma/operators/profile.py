"""Profiles of columns, and the rules that say which columns can be targets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.core import feature_kind, is_date_like, is_numeric, nan_to_null, number_text
from .cells import value


@dataclass(frozen=True)
class TableRules:
    """Thresholds of routing; the defaults are those of the published configuration."""

    nan_thr: float = 0.5
    cat_thr: float = 0.2
    num_cls_max: int = 20
    cls_max: int = 62
    max_columns: int = 128
    min_rows: int = 1


def profile_columns(cells: DataFrame) -> DataFrame:
    """Long form: per table and column the rows, non-nulls, distinct values and their ratios. Distinct values are counted as two hashes of different seeds,
    128 bits, so no text of a number, date or long value is made or travels."""
    keys, v = ["table_id", "col_idx", "col_name", "kind"], (F.col("num") + 0.0, F.col("txt"), F.col("ts"))  # one of them at most
    have = F.col("num").isNotNull() | F.col("txt").isNotNull() | F.col("ts").isNotNull()
    each = cells.groupBy(*keys, have.alias("have"), F.xxhash64(F.lit(1), *v).alias("a"), F.xxhash64(F.lit(2), *v).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    return with_ratios(each.groupBy(*keys).agg(F.sum(n).alias("num_rows"), F.coalesce(F.sum(F.when(F.col("have"), n)), F.lit(0)).alias("n_non_null"), F.count(F.when(F.col("have"), True)).alias("n_distinct")))


def with_ratios(profile: DataFrame) -> DataFrame:
    n = F.greatest(F.col("num_rows"), F.lit(1))
    return profile.withColumns({"missing_ratio": (F.col("num_rows") - F.col("n_non_null")) / n, "unique_ratio": F.col("n_distinct") / n})


#: Columns that share a scan in an exact profile, and such scans of a table at most; a wider table has more columns in each.
SHARED, SCANS = 4, 32
#: Size of a sketch (2^LG_K counters) and five times its relative standard error (1.04 / 2^(LG_K / 2)).
LG_K, SKETCH_ERROR = 12, 0.0813


def _columns(df: DataFrame) -> list[tuple[int, str, str, Column]]:
    """(index, name, kind, value) of every column; values that count as equal are equal, missing ones null."""
    out = []
    for i, f in enumerate(df.schema.fields):
        c, t = F.col(f"`{f.name}`"), f.dataType
        kind = "date" if is_date_like(t) else "number" if is_numeric(t) else "text" if feature_kind(t) else "other"
        out.append((i, f.name, kind, nan_to_null(c) + 0.0 if t.typeName() in ("float", "double") else F.to_json(c) if t.typeName() in ("array", "struct", "map") else c))
    return out


def _known(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as literals of the plan; schema: name kind, ..."""
    kinds = [c.split() for c in schema.split(", ")]
    return spark.range(1).select(F.explode(F.array(*(F.struct(*(F.lit(v).cast(k).alias(n) for v, (n, k) in zip(r, kinds, strict=True))) for r in rows))).alias("c")).select("c.*")


def profile_table(df: DataFrame, name: str, only: list[int] | None = None) -> DataFrame:
    """Exact profile of one big table (or of the columns `only`). Distinct values are counted as two hashes of different seeds, 128 bits, so no
    text travels and partial aggregation leaves each task's distinct values only. A scan of a few columns gives a line for each row and column of
    them and reads no other."""
    columns = [c for c in _columns(df) if only is None or c[0] in only]
    # the seed is the hash of the first argument, so the two differ as hashes of different seeds do
    value = lambda i, c: F.struct(F.lit(i).alias("col_idx"), c.isNotNull().alias("have"), F.xxhash64(F.lit(1), c).alias("a"), F.xxhash64(F.lit(2), c).alias("b"))
    size, counts, have = max(SHARED, -(-len(columns) // SCANS)), None, F.col("have")
    for at in range(0, len(columns), size):
        rows = df.select(F.explode(F.array(*(value(i, c) for i, _, _, c in columns[at : at + size]))).alias("c"))
        each = rows.select("c.*").groupBy("col_idx", "have", "a", "b").agg(F.count(F.lit(1)).alias("n"))
        found = each.groupBy("col_idx").agg(F.sum("n").alias("num_rows"), F.coalesce(F.sum(F.when(have, F.col("n"))), F.lit(0)).alias("n_non_null"), F.count(F.when(have, True)).alias("n_distinct"))
        counts = found if counts is None else counts.unionByName(found)
    every = _known(df.sparkSession, [(i, n, k) for i, n, k, _ in columns], "col_idx int, col_name string, kind string")
    out = every.join(counts, "col_idx", "left").fillna(0, ["num_rows", "n_non_null", "n_distinct"])
    return with_ratios(out.select(F.lit(name).alias("table_id"), "num_rows", "col_idx", "col_name", "kind", "n_non_null", "n_distinct"))


def sketch_table(df: DataFrame, name: str) -> DataFrame:
    """table_id, col_idx, col_name, kind, num_rows, n_non_null, sketch of every column, in one scan and one aggregation of fixed size."""
    columns = _columns(df)
    found = df.agg(F.count(F.lit(1)).alias("num_rows"), *(x for i, _, _, c in columns for x in (F.count(c).alias(f"n{i}"), F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(F.lit(1), c)), LG_K).alias(f"s{i}"))))
    rows = F.array(*(F.struct(F.lit(i).alias("col_idx"), F.lit(n).alias("col_name"), F.lit(k).alias("kind"), F.col(f"n{i}").alias("n_non_null"), F.col(f"s{i}").alias("sketch")) for i, n, k, _ in columns))
    return found.select(F.lit(name).alias("table_id"), "num_rows", F.explode(rows).alias("c")).select("table_id", "c.col_idx", "c.col_name", "c.kind", "num_rows", "c.n_non_null", "c.sketch")


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """The sketches of parts of tables, or of the same tables at other times, as those of the whole."""
    return sketches.groupBy("table_id", "col_idx", "col_name", "kind").agg(F.sum("num_rows").alias("num_rows"), F.sum("n_non_null").alias("n_non_null"), F.hll_union_agg("sketch").alias("sketch"))


#: Limits of every rule: a rule asks whether a column has at most so many distinct values, or at most such a share of its rows.
LIMITS, SHARES = (1, 20, 62), (0.2,)


def routing_profiles(tables: dict[str, DataFrame], limits: tuple[int, ...] = LIMITS, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """Profiles of tables by name, by which every rule with these limits decides as by exact ones. Distinct values are estimated by sketches,
    all tables in one job; columns whose bounds hold a limit inside are counted exactly, and no other column is read again."""
    sketches = None
    for name, df in tables.items():
        one = sketch_table(df, name)
        sketches = one if sketches is None else sketches.unionByName(one)
    clear, doubtful = [], {}
    for r in sketches.select("*", F.hll_sketch_estimate("sketch").alias("n_distinct")).drop("sketch").collect():  # a row for each column
        low, high = int(-(-r["n_distinct"] // (1 + SKETCH_ERROR))), int(r["n_distinct"] * (1 + SKETCH_ERROR))
        if any(low <= x < high for x in [*limits, *(s * r["num_rows"] for s in shares)]):
            doubtful.setdefault(r["table_id"], []).append(r["col_idx"])
        else:
            clear.append(r)
    schema = "table_id string, num_rows long, col_idx int, col_name string, kind string, n_non_null long, n_distinct long"
    spark = next(iter(tables.values())).sparkSession
    out = with_ratios(_known(spark, [tuple(r[c.split()[0]] for c in schema.split(", ")) for r in clear], schema)) if clear else None
    for name, columns in doubtful.items():
        exact = profile_table(tables[name], name, columns)
        out = exact if out is None else out.unionByName(exact)
    return out


def routing_profile(df: DataFrame, name: str, limits: tuple[int, ...] = LIMITS, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """routing_profiles() of one table."""
    return routing_profiles({name: df}, limits, shares)


def route(rules: TableRules = TableRules()) -> Column:
    """classification, regression or none, from a row of a profile."""
    k = F.col("n_distinct")
    number = F.when(F.col("missing_ratio") > rules.nan_thr, "none").when(k < 2, "none").when(k <= rules.num_cls_max, "classification").otherwise("regression")
    other = F.when((k < 2) | (k > rules.cls_max), "none").when(F.col("unique_ratio") <= rules.cat_thr, "classification").otherwise("none")
    return F.when(F.col("n_non_null") == 0, "none").when(F.col("kind").isin("date", "other"), "none").when(F.col("kind") == "number", number).otherwise(other)


def route_legacy(nan_thr: float = 0.5, cat_thr: float = 0.2) -> Column:
    """The older rule, without limits on the number of classes."""
    number = F.when(F.col("missing_ratio") <= nan_thr, "regression").otherwise("none")
    other = F.when(F.col("unique_ratio") <= cat_thr, "classification").otherwise("none")
    return F.when((F.col("n_non_null") == 0) | F.col("kind").isin("date", "other"), "none").when(F.col("kind") == "number", number).otherwise(other)


def target_candidates(profile: DataFrame, rules: TableRules = TableRules()) -> DataFrame:
    """Per table the names of both kinds of targets, in column order."""
    names = lambda task: F.transform(F.array_sort(F.collect_list(F.when(F.col("task") == task, F.struct("col_idx", "col_name")))), lambda s: s["col_name"])
    return profile.withColumn("task", route(rules)).groupBy("table_id").agg(names("classification").alias("classification"), names("regression").alias("regression"))


def compare_routing(profile: DataFrame) -> DataFrame:
    """What the new rule changes: columns recovered, degenerate and removed; tables that offer each task, old and new."""
    p = profile.withColumns({"new": route(), "old": route_legacy()})
    n = lambda o, w: F.sum(((F.col("old") == o) & (F.col("new") == w)).cast("long"))
    per = p.groupBy("table_id").agg(n("regression", "classification").alias("recovered"), n("regression", "none").alias("degenerate"), n("classification", "none").alias("removed"), *(F.max((F.col(v) == t).cast("long")).alias(f"{v}_{t}") for v in ("old", "new") for t in ("classification", "regression")))
    return per.agg(*(F.sum(c).alias(c) for c in per.columns if c != "table_id"))


# Limits of the histogram.
BUCKETS = (1, 2, 3, 5, 10, 15, 20, 30, 50, 62, 100, 200, 500, 1000)


def cardinality_histogram(profile: DataFrame) -> DataFrame:
    """Numeric columns and old classification candidates by number of distinct values; counts and shares."""
    k = F.col("n_distinct")
    bucket = F.lit(">1000")
    for b in reversed(BUCKETS):
        bucket = F.when(k <= b, f"<={b}").otherwise(bucket)
    p = profile.withColumn("family", F.when(F.col("kind") == "number", "numeric").when(route_legacy() == "classification", "categorical")).where("family is not null")
    counts = p.groupBy("family", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy("family"))  # over a row for each bucket
    return counts.select("family", "bucket", "n", (100.0 * F.col("n") / total).alias("pct"))


def width_distribution(widths: DataFrame) -> DataFrame:
    """widths (num_cols) -> p50, p75, p90, p95, p99, p100, mean, max."""
    points = (50, 75, 90, 95, 99, 100)
    p = F.percentile("num_cols", F.array(*(F.lit(x / 100) for x in points)))
    return widths.agg(p.alias("p"), F.avg("num_cols").alias("mean_cols"), F.max("num_cols").alias("max_cols")).select(*(F.col("p")[i].alias(f"p{x}") for i, x in enumerate(points)), "mean_cols", "max_cols")


def cap_impact(widths: DataFrame, caps: tuple[int, ...]) -> DataFrame:
    """For each cap the share of tables that are wider and the mean number of columns that those would lose."""
    caps_df = F.explode(F.array(*map(F.lit, caps))).alias("cap")
    over = F.col("num_cols") > F.col("cap")
    return widths.select("num_cols", caps_df).groupBy("cap").agg((100.0 * F.avg(over.cast("double"))).alias("pct_over"), F.coalesce(F.avg(F.when(over, F.col("num_cols") - F.col("cap"))), F.lit(0.0)).alias("mean_dropped"))


def last_column_profile(df: DataFrame, column: str, name: str) -> DataFrame:
    """Profile of one column with numeric-looking text taken for numbers, for label_last_column()."""
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    text = kind.typeName() == "string"
    x = number_text(c) if text else nan_to_null(c) if is_numeric(kind) else F.lit(None).cast("double")
    present = nan_to_null(c) if is_numeric(kind) else c
    all_numbers = F.lit(is_numeric(kind)) if not text else F.coalesce(F.bool_and(F.when(c.isNotNull(), x.isNotNull())), F.lit(False))
    rest = x - F.floor(x)
    whole = F.coalesce(F.bool_and(F.when(x.isNotNull(), (F.abs(x) < float("inf")) & (rest < 1e-9))), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("num_rows"), F.count(present).alias("n_non_null"), F.count_distinct(present).alias("k_text"), F.count_distinct(x).alias("k_number"), all_numbers.alias("numeric"), whole.alias("integer_like"),
    ).select(F.lit(name).alias("table_id"), F.lit(column).alias("column_name"), F.lit(is_date_like(kind)).alias("date_like"), "num_rows", "n_non_null", F.when(F.col("numeric"), F.col("k_number")).otherwise(F.col("k_text")).alias("k"), "numeric", "integer_like")


def last_columns(values: DataFrame) -> DataFrame:
    """values (path, column_name, kind, value, n) of many files -> a row of last_column_profile() for each path."""
    number = F.col("kind") == "number"
    v = F.when(~(number & (F.lower("value") == "nan")), F.col("value"))
    one = values.groupBy("path", "column_name", "kind", v.alias("v")).agg(F.sum("n").alias("n"))
    have = F.col("v").isNotNull()
    x = F.when(F.col("kind").isin("number", "text"), number_text(F.col("v")))
    rest = x - F.floor(x)
    numeric = F.when(F.first("kind") == "number", True).when(F.first("kind") == "text", F.bool_and(F.when(have, x.isNotNull()))).otherwise(False)
    out = one.groupBy("path").agg(
        F.first("column_name", True).alias("column_name"), F.first("kind", True).isin("date", "other").alias("date_like"), F.sum("n").alias("num_rows"), F.coalesce(F.sum(F.when(have, F.col("n"))), F.lit(0)).alias("n_non_null"),
        F.count("v").alias("k_text"), F.count_distinct(x).alias("k_number"), F.coalesce(numeric, F.lit(False)).alias("numeric"), F.coalesce(F.bool_and(F.when(x.isNotNull(), (F.abs(x) < float("inf")) & (rest < 1e-9))), F.lit(False)).alias("integer_like"),
    )
    return out.select(F.col("path").alias("table_id"), "column_name", F.coalesce("date_like", F.lit(False)).alias("date_like"), "num_rows", "n_non_null", F.when(F.col("numeric"), F.col("k_number")).otherwise(F.col("k_text")).alias("k"), "numeric", "integer_like")


def label_last_column(missing_thr: float = 0.5, discrete_thr: float = 0.2, few: int = 20) -> Column:
    """struct(label, reason) of a row of last_column_profile()."""
    n, k, have = F.col("num_rows"), F.col("k"), F.col("n_non_null")
    ratio = k / F.greatest(n, F.lit(1))
    # fixed values: the reasons
    pair = lambda label, reason: F.struct(F.lit(label).alias("label"), F.lit(reason).alias("reason"))
    number = F.when(ratio <= discrete_thr, pair("classification", "numeric_discrete_target")).when(F.col("integer_like") & (k <= few), pair("classification", "numeric_integer_low_cardinality_target")).otherwise(pair("regression", "numeric_continuous_target"))
    other = F.when(ratio <= discrete_thr, pair("classification", "categorical_discrete_target")).when((k < have) & (k <= few), pair("classification", "categorical_low_cardinality_target")).otherwise(pair("unknown", "non_numeric_high_cardinality_target"))
    return (
        F.when(n == 0, pair("unknown", "empty_table"))
        .when(have == 0, pair("unknown", "all_null_target"))
        .when(F.col("date_like"), pair("unknown", "date_like_target"))
        .when((n - have) / n > missing_thr, pair("unknown", "missing_ratio_gt_50_percent"))
        .when(F.col("numeric"), number)
        .otherwise(other)
    )


def summarize_labels(labels: DataFrame) -> DataFrame:
    """labels (label) -> label, n for the three labels, zeros too."""
    three = labels.sparkSession.createDataFrame([("classification",), ("regression",), ("unknown",)], "label string")
    return three.join(labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
