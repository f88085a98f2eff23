"""Quality of clusterings and of threshold settings."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def first_match_rate(matches: DataFrame) -> DataFrame:
    """(n_docs, n_matched, fmr) of matches (topic_id): the share of documents with a topic."""
    hit = (F.col("topic_id") >= 0).cast("long")
    return matches.agg(F.count("*").alias("n_docs"), F.sum(hit).alias("n_matched"), F.avg(hit.cast("double")).alias("fmr"))


def _entropy(counts: DataFrame, total: DataFrame) -> DataFrame:
    p = F.col("n") / F.col("total")
    return counts.join(F.broadcast(total)).agg(F.coalesce(-F.sum(p * F.log(p)), F.lit(0.0)).alias("h"))


def normalised_mutual_information(rows: DataFrame, label: str, cluster: str) -> DataFrame:
    """(nmi) of two labellings, over the arithmetic mean of their entropies; 1 if both are constant."""
    joint = rows.groupBy(label, cluster).agg(F.count("*").alias("n"))
    total = joint.agg(F.sum("n").alias("total"))
    left = joint.groupBy(label).agg(F.sum("n").alias("nl"))
    right = joint.groupBy(cluster).agg(F.sum("n").alias("nc"))
    cells = joint.join(left, label).join(right, cluster).join(F.broadcast(total))
    mutual = cells.agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("nl") * F.col("nc")))).alias("mi"))
    hl = _entropy(left.withColumnRenamed("nl", "n"), total).withColumnRenamed("h", "hl")
    hc = _entropy(right.withColumnRenamed("nc", "n"), total).withColumnRenamed("h", "hc")
    mean = (F.col("hl") + F.col("hc")) / 2
    return mutual.join(hl).join(hc).select(F.when(mean == 0, 1.0).otherwise(F.col("mi") / mean).alias("nmi"))


def normalised_time(time: Column, over: Window | None = None) -> Column:
    """Min-max scaled over a data set; 0 where all times are equal."""
    w = over if over is not None else Window.partitionBy()
    low, high = F.min(time).over(w), F.max(time).over(w)
    return F.coalesce(F.try_divide(time - low, high - low), F.lit(0.0))


def score(nmi: Column, fmr: Column, time: Column) -> Column:
    return nmi * fmr * (1 - time)


def grid(alphas: list[float], betas: list[float]) -> list[tuple[float, float]]:
    """Settings of a grid search whose match limit is not below the cluster scale less 0.1."""
    return [(a, b) for a in alphas for b in betas if b >= a - 0.1]


def refined(best: tuple[float, float], step: float = 0.02, width: int = 2) -> list[tuple[float, float]]:
    """A finer grid around the best settings of a coarse one."""
    return [(round(best[0] + i * step, 6), round(best[1] + j * step, 6)) for i in range(-width, width + 1) for j in range(-width, width + 1)]


#: nmi, fmr and time of the settings alpha and beta.
Measure = Callable[[float, float], tuple[float, float, float]]


def searched(spark: SparkSession, measure: Measure, settings: Iterable[tuple[float, float]]) -> DataFrame:
    """(alpha, beta, nmi, fmr, time, norm_time, score) of each of the settings: one run each, its measures alone return."""
    rows = [(float(a), float(b), *map(float, measure(a, b))) for a, b in settings]
    out = spark.createDataFrame(rows, "alpha double, beta double, nmi double, fmr double, time double")
    out = out.withColumn("norm_time", normalised_time(F.col("time")))
    return out.withColumn("score", score(F.col("nmi"), F.col("fmr"), F.col("norm_time")))


def grid_search(spark: SparkSession, measure: Measure, alphas: list[float], betas: list[float], step: float = 0.02, width: int = 2) -> DataFrame:
    """Both stages of a search, as (stage, alpha, ..., score): the grid, then a finer one around its best settings. Times
    are scaled within a stage; of equal scores the lowest alpha and beta are taken."""
    coarse = searched(spark, measure, grid(alphas, betas))
    best = coarse.orderBy(F.desc("score"), "alpha", "beta").first()
    out = coarse.select(F.lit(1).alias("stage"), "*")
    if best is None:
        return out
    return out.union(searched(spark, measure, refined((best["alpha"], best["beta"]), step, width)).select(F.lit(2), "*"))
