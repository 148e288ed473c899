"""Aggregations that are two steps in Spark: counts per value first, then a summary of the counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))


def histogram(df: DataFrame, keys: list[str], value: str, name: str = "histogram") -> DataFrame:
    """A map from value to count per group, sorted by value. Rows are counted before any are gathered."""
    pairs = F.array_sort(F.collect_list(F.struct("__v", "__n")))
    return _counts(df, keys, value).groupBy(*keys).agg(F.map_from_entries(pairs).alias(name))


def entropy(df: DataFrame, keys: list[str], value: str, name: str = "entropy") -> DataFrame:
    """Entropy in bits of the values' frequencies: log2 N - sum n log2 n / N."""
    n = F.col("__n")
    return _counts(df, keys, value).groupBy(*keys).agg((F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)).alias(name))


def mode(df: DataFrame, keys: list[str], value: str, name: str = "mode") -> DataFrame:
    """The most frequent value, the least of equally frequent ones."""
    return _counts(df, keys, value).groupBy(*keys).agg(F.min_by("__v", F.struct(-F.col("__n"), "__v")).alias(name))


def distinct_on(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__at", at).filter("__at = 1").drop("__at")


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key; Spark cuts each task's rows to k before the shuffle."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__at", at).filter(F.col("__at") <= k).drop("__at")


def with_rowid(df: DataFrame, order: list[str], name: str = "rowid", partitions: int | None = None) -> DataFrame:
    """Dense numbers from 0 in the order of columns, without a sort in one task: partitions are ranges, their sizes are
    counted, and each adds the sizes before it. The order should be total; equal rows get numbers in any order."""
    sorted_ = (df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)).withColumn("__p", F.spark_partition_id())
    within = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    sizes = sorted_.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    # One row per partition: as many as tasks, whatever the data.
    return sorted_.withColumn("__i", within).join(F.broadcast(before), F.col("__p") == F.col("__q")).withColumn(name, F.col("__b") + F.col("__i") - 1).drop("__p", "__q", "__b", "__i")
