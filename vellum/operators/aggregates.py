"""Aggregates of the corpus layer whose definitions differ from the built-in ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.relational import ranked


def flag_rate(flag: str) -> Column:
    """Share of set flags among all rows; rows without a flag count in the denominator, no flag at all gives null."""
    return F.sum(flag).cast("double") / F.count("*")


def index_percentile(df: DataFrame, value: str, percents: list[int]) -> DataFrame:
    """``sorted[int(n * p / 100)]`` of the non-null values, for each p below 100; exact, by ranks over partitions."""
    rows, n = ranked(df.select(value).where(F.col(value).isNotNull()), value)
    wanted = df.sparkSession.createDataFrame([(p, n * p // 100) for p in percents], "percent int, rank bigint")
    return rows.join(F.broadcast(wanted), "rank").select("percent", F.col(value).alias("value"))


def scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 from columns tp, fp, fn; null where undefined, and F1 also where either is 0."""
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when((p > 0) & (r > 0), 2 * p * r / (p + r)))


def normalised_entropy(counts: DataFrame, by: str, n: str, classes: int) -> DataFrame:
    """Support and entropy of each row of a confusion table, in units of the largest possible."""
    total = counts.groupBy(by).agg(F.sum(n).alias("support"))
    share = F.col(n) / F.col("support")
    own = counts.join(total, by).withColumn("part", -share * F.log(share) / F.log(F.lit(float(classes))))
    return own.groupBy(by, "support").agg(F.round(F.sum("part"), 6).alias("entropy"))


def class_weights(df: DataFrame, label: str, classes: list[str] | None = None, most: float = 10.0) -> DataFrame:
    """Inverse-frequency weights ``min(total / (classes * count), most)``; a class of the list without a row weighs ``most``."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    if classes is not None:
        known = df.sparkSession.createDataFrame([(c,) for c in classes], f"{label} string")
        counts = known.join(counts, label, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total, k = counts.agg(F.sum("n"), F.count("*")).first()
    share = F.try_divide(F.lit(float(total or 0)), F.lit(k) * F.col("n"))
    return counts.select(label, F.round(F.least(F.coalesce(share, F.lit(most)), F.lit(most)), 6).alias("weight"))
