"""Change logs, snapshots and backups as Parquet in any file system of Spark."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.changes import SCHEMA, current, latest, purged


class IntegrityError(ValueError):
    """A snapshot whose rows aren't those of its manifest."""


class ChangeLog:
    """An append-only table of changes, in folders by partition and keyspace."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, changes: DataFrame) -> None:
        cols = [f.strip().split()[0] for f in SCHEMA.split(",")]
        whole = changes.select(*[F.col(c) if c in changes.columns else F.lit(None).alias(c) for c in cols])
        typed = self.spark.createDataFrame([], SCHEMA).unionByName(whole)
        typed.write.mode("append").partitionBy("partition", "keyspace").parquet(self.path)

    def read(self) -> DataFrame:
        """All changes; none if nothing was written yet."""
        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def state(self, now: int) -> DataFrame:
        return current(self.read(), now)

    def compacted(self, target: str, now: int) -> None:
        """Write the log with one row per key and without what can be purged."""
        purged(latest(self.read()), now).write.partitionBy("partition", "keyspace").parquet(target)

    def shards(self) -> DataFrame:
        """Keyspaces with their rows."""
        return self.read().groupBy("partition", "keyspace").agg(F.count("*").alias("rows"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.rename(path(source), path(target)):
        raise IntegrityError(f"{target} can't be put in place")


def digest(df: DataFrame) -> dict:
    """Number of rows and an order-free sum of their hashes."""
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).head()
    return {"rows": r["n"], "hash": str(r["h"] or 0)}


def export(df: DataFrame, path: str) -> dict:
    """Write a snapshot with its manifest."""
    df.write.parquet(f"{path}/data")
    found = digest(df.sparkSession.read.parquet(f"{path}/data"))
    df.sparkSession.createDataFrame([(json.dumps(found),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return found


def restore(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Check a snapshot, stage it and put it in place with one rename."""
    wanted = json.loads(spark.read.text(f"{path}/manifest").head()[0])
    data = spark.read.parquet(f"{path}/data")
    staged = f"{target}.{uuid.uuid4().hex}"
    data.write.parquet(staged)
    if digest(spark.read.parquet(staged)) != wanted:
        raise IntegrityError(f"{path} isn't what its manifest says")
    _rename(spark, staged, target)
    return spark.read.parquet(target)


def backup(keyspaces: Mapping[str, DataFrame], path: str, skip: tuple[str, ...] = ("__system__",)) -> dict:
    """Snapshots of many keyspaces, system ones left out."""
    return {name: export(df, f"{path}/{name}") for name, df in sorted(keyspaces.items()) if not name.startswith(skip)}


def restore_all(spark: SparkSession, names: list[str], path: str, target: str) -> dict[str, DataFrame]:
    return {name: restore(spark, f"{path}/{name}", f"{target}/{name}") for name in names}


def size_bytes(spark: SparkSession, path: str) -> int:
    """Bytes that a table takes in its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
