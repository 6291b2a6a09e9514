"""The registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans import documents, statements

Query = Callable[[SparkSession, str], DataFrame]


def segment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals by market segment: the flagship join and rollup."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .groupBy("c_mktsegment")
        .agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
        .filter("n > 10")
    )


QUERIES: dict[str, Query] = {"segment_totals": segment_totals, **statements.QUERIES, **documents.QUERIES}

SQL: dict[str, str] = {
    "segment_totals": """
        SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total
        FROM orders JOIN customer ON o_custkey = c_custkey
        GROUP BY c_mktsegment HAVING count(*) > 10""",
    **statements.SQL,
    **documents.SQL,
}
