"""Decision-support queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        items.filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.count("*").alias("n"))
    )


QUERIES = {"tpch_q1": pricing_summary}
ORACLE = {
    "tpch_q1": """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
        round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
        FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus"""
}
