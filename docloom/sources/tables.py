"""The star-schema tables as keyspaces: name, key and place in the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.catalog import Catalog

#: Place and key of every table; lineitem has no unique key.
PLACES = {
    "region": ("tpch", "geo", "r_regionkey"),
    "nation": ("tpch", "geo", "n_nationkey"),
    "customer": ("tpch", "sales", "c_custkey"),
    "orders": ("tpch", "sales", "o_orderkey"),
    "lineitem": ("tpch", "sales", None),
    "part": ("tpch", "catalog", "p_partkey"),
    "supplier": ("tpch", "catalog", "s_suppkey"),
    "events": ("app", "stream", "event_id"),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a relation with its key as text in ``id``."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = PLACES[name][2]
    return df.withColumn("id", F.col(key).cast("string") if key else F.lit(None).cast("string"))


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """A catalog of all tables."""
    found = Catalog(spark)
    for name, (db, partition, _) in PLACES.items():
        found.ensure(db, partition, name, lambda name=name: load(spark, sf_dir, name))
    return found
