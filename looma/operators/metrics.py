"""Measures of predictions, each one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(rows: DataFrame) -> DataFrame:
    """rows (role, label, prediction) -> accuracy, dummy_accuracy (most frequent context label, ties to the least), skill."""
    top = rows.where("role = 'context'").groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("m")).select(F.col("m.label").alias("dummy"))
    own = rows.where("role = 'query'").crossJoin(F.broadcast(top))
    out = own.agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"), F.avg((F.col("label") == F.col("dummy")).cast("double")).alias("dummy_accuracy"))
    skill = (F.col("accuracy") - F.col("dummy_accuracy")) / (1 - F.col("dummy_accuracy") + 1e-5)
    return out.withColumn("skill", F.greatest(F.lit(0.0), F.least(F.lit(1.0), skill)))


def log_loss(scores: DataFrame) -> DataFrame:
    """scores (query_id, label, logit, truth) -> log_loss."""
    per = scores.groupBy("query_id").agg(F.max("logit").alias("m"), F.collect_list("logit").alias("x"), F.max(F.when(F.col("label") == F.col("truth"), F.col("logit"))).alias("t"))
    loss = F.log(F.aggregate("x", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("m")))) + F.col("m") - F.col("t")
    return per.agg(F.avg(loss).alias("log_loss"))


def scaled_errors(rows: DataFrame) -> DataFrame:
    """rows (truth, logit), both scaled -> mse in [0, 10] and r2 in [-1, 1]; NaN logits are 0, infinite ones the largest."""
    top = 3.4028234663852886e38
    x = F.when(F.isnan("logit"), 0.0).otherwise(F.greatest(F.lit(-top), F.least(F.lit(top), F.col("logit"))))
    mean = rows.agg(F.avg("truth").alias("m"))
    out = rows.crossJoin(F.broadcast(mean)).agg(F.avg(F.pow(x - F.col("truth"), 2)).alias("mse"), F.sum(F.pow(x - F.col("truth"), 2)).alias("rest"), F.sum(F.pow(F.col("truth") - F.col("m"), 2)).alias("all"))
    return out.select(F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.col("mse"))).alias("mse"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.col("rest") / F.col("all"))).alias("r2"))


def residuals(rows: DataFrame) -> DataFrame:
    return rows.withColumn("residual", F.col("truth") - F.col("prediction"))


def regression_report(rows: DataFrame) -> DataFrame:
    """rows (truth, prediction) -> n, mae, rmse, r2."""
    e = F.col("truth") - F.col("prediction")
    mean = rows.agg(F.avg("truth").alias("m"))
    return rows.crossJoin(F.broadcast(mean)).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / F.sum(F.pow(F.col("truth") - F.col("m"), 2))).alias("r2"))


def pair_cluster_metrics(pairs: DataFrame) -> DataFrame:
    """pairs (label_a, label_b, p) of a bounded context and its queries -> precision of pairs, three times the mean BCE."""
    same, said = F.col("label_a") == F.col("label_b"), F.col("p") > 0.5
    p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col("p")))
    bce = -F.when(same, F.log(p)).otherwise(F.log(1 - p))
    return pairs.agg((F.sum((same & said).cast("double")) / F.greatest(F.sum((same | said).cast("double")), F.lit(1.0))).alias("precision"), (3 * F.avg(bce)).alias("loss"))


def task_mix_report(specs: DataFrame) -> DataFrame:
    r = F.sum(F.col("is_regression").cast("long"))
    return specs.agg(r.alias("regression"), (F.count(F.lit(1)) - r).alias("classification"), (r / F.count(F.lit(1))).alias("regression_share"))


def additive_score(numbers: dict[str, float], effects: dict[str, dict[str, float]], interactions: list[tuple[str, str, float]] = (), season: tuple[str, float] | None = None, logs: dict[str, float] | None = None, roots: dict[str, float] | None = None, digits: int = 4) -> Column:
    """Weighted numbers, effects of categories, products, a yearly wave, logarithms and roots, added and rounded."""
    total = F.lit(0.0)
    for name, w in numbers.items():
        total = total + w * F.col(name)
    for name, table in effects.items():
        mapped = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
        total = total + F.coalesce(mapped[F.col(name)], F.lit(0.0))
    for a, b, w in interactions:
        total = total + w * F.col(a) * F.col(b)
    if season:
        total = total + season[1] * F.sin(2 * 3.141592653589793 * F.dayofyear(season[0]) / 365.0)
    for name, w in (logs or {}).items():
        total = total + w * F.log1p(F.col(name))
    for name, w in (roots or {}).items():
        total = total + w * F.sqrt(F.col(name))
    return F.round(total, digits)
