"""Small number tables for formulas that have no built-in: log factorials and harmonic sums, made by the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def log_factorials(spark: SparkSession, most: int) -> DataFrame:
    """n, lf: the natural logarithm of n!, for 0 <= n <= most."""
    order = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return spark.range(0, most + 1, 1, 1).select(F.col("id").alias("n")).select("n", F.sum(F.log(F.greatest("n", F.lit(1)).cast("double"))).over(order).alias("lf"))


def harmonics(spark: SparkSession, most: int) -> DataFrame:
    """n, a1, a2: sums of 1/i and 1/i^2 for i < n, for 1 <= n <= most."""
    order = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    i = F.col("n").cast("double")
    return spark.range(1, most + 1, 1, 1).select(F.col("id").alias("n")).select("n", F.coalesce(F.sum(1 / i).over(order), F.lit(0.0)).alias("a1"), F.coalesce(F.sum(1 / (i * i)).over(order), F.lit(0.0)).alias("a2"))
