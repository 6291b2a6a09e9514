"""Workload reports over per-node snapshots.

A snapshot is ``(node, ts, shards[], slow[], cluster{})``; the newest of each
node counts, and none older than ``MAX_AGE`` seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_AGE = 1800
COUNTERS = ("reads", "writes", "updates", "deletes", "read_us", "write_us")


def newest(snapshots: DataFrame, now: int) -> DataFrame:
    """The newest snapshot of every node that is not out of date."""
    rest = [c for c in snapshots.columns if c != "node"]
    fresh = snapshots.filter(F.col("ts") >= now - MAX_AGE)
    return fresh.groupBy("node").agg(F.max_by(F.struct(*rest), F.struct("ts", F.xxhash64(F.to_json(F.struct(*rest))))).alias("s")).select("node", "s.*")


def shard_totals(snapshots: DataFrame) -> DataFrame:
    """Per keyspace: counters summed, sizes as the largest copy."""
    rows = snapshots.select(F.explode("shards").alias("s")).select("s.*")
    totals = rows.groupBy("partition", "keyspace").agg(*[F.sum(c).alias(c) for c in COUNTERS], F.max("size_bytes").alias("size_bytes"))
    mean = lambda us, n: F.when(F.col(n) > 0, F.col(us) / F.col(n) / 1000.0).otherwise(0.0)
    return totals.withColumn("read_ms", mean("read_us", "reads")).withColumn("write_ms", mean("write_us", "writes"))


def slow_totals(snapshots: DataFrame) -> DataFrame:
    """Per kind, keyspace and filter: counts and times summed, the worst kept."""
    rows = snapshots.select(F.explode("slow").alias("s")).select("s.*")
    return rows.groupBy("kind", "partition", "keyspace", "filter").agg(
        F.sum("count").alias("count"), F.sum("total_us").alias("total_us"), F.max("max_us").alias("max_us")
    )


def pending_total(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(F.sum("cluster.pending_changes").alias("pending_changes"))


def largest(totals: DataFrame, n: int = 10) -> DataFrame:
    """The n largest keyspaces."""
    return totals.orderBy(F.desc("size_bytes"), "partition", "keyspace").limit(n)


def slowest(totals: DataFrame, n: int = 10) -> DataFrame:
    """The n operations with the worst single time."""
    return totals.orderBy(F.desc("max_us"), "kind", "partition", "keyspace", "filter").limit(n)


def filter_label(keys: Column) -> Column:
    """The keys of a filter in one spelling, whatever their order."""
    return F.array_join(F.array_sort(keys), ",")


def attributed(elapsed: Column, references: Column, keyspaces: Column) -> Column:
    """A statement's time per keyspace that it read."""
    return F.floor(F.round(elapsed / references) / F.greatest(keyspaces, F.lit(1)))
