"""Merging the copies that replicas return.

Copies are rows ``(id, timestamp, value, replica)``. A row is agreed if enough
replicas hold the same newest value. Ties in time go to the smaller replica
number. Grouping is by key with partial aggregates; the copies of one key are
as many as there are replicas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(value: Column) -> Column:
    """Identity of a value as text; the order of its keys counts."""
    return F.md5(value.cast("binary"))


def required(replicas: int) -> int:
    """A majority."""
    return replicas // 2 + 1


def merged_rows(copies: DataFrame, needed: int) -> DataFrame:
    """``(id, timestamp, value)`` of the rows whose newest value is agreed: a
    replica counts once, however often its reply came."""
    newest = Window.partitionBy("id").orderBy(F.desc("timestamp"), "replica")
    voted = copies.withColumn("won", F.first(F.struct("timestamp", "value")).over(newest))
    same = fingerprint(F.col("value")) == fingerprint(F.col("won.value"))
    return (
        voted.groupBy("id", "won")
        .agg(F.size(F.collect_set(F.when(same, F.col("replica")))).alias("agree"))
        .filter(F.col("agree") >= needed)
        .select("id", "won.timestamp", "won.value")
    )


def merged_ids(copies: DataFrame, needed: int) -> DataFrame:
    """Keys that enough replicas list."""
    return copies.select("id", "replica").distinct().groupBy("id").agg(F.count("*").alias("seen")).filter(F.col("seen") >= needed).select("id")


def read_keys(copies: DataFrame, replicas: int, needed: int) -> DataFrame:
    """Per key: ``absent`` if enough replicas lack it, else the newest value
    with enough votes, else ``undecided``."""
    votes = copies.groupBy("id", fingerprint(F.col("value")).alias("print")).agg(
        F.count_distinct("replica").alias("votes"), F.max("timestamp").alias("timestamp"), F.min("value").alias("value")
    )
    choice = F.when(F.col("votes") >= needed, F.struct("timestamp", "print", "value"))
    return votes.groupBy("id").agg(F.sum("votes").alias("answers"), F.max(choice).alias("best")).select(
        "id",
        F.when(F.lit(replicas) - F.col("answers") >= needed, "absent").when(F.col("best").isNull(), "undecided").otherwise("found").alias("outcome"),
        F.when(F.lit(replicas) - F.col("answers") < needed, F.col("best.timestamp")).alias("timestamp"),
        F.when(F.lit(replicas) - F.col("answers") < needed, F.col("best.value")).alias("value"),
    )


def write_decision(nodes: DataFrame, acks: DataFrame, factor: int) -> DataFrame:
    """Per change: whether enough of its holders acknowledged it.

    Holders are the first ``factor`` nodes, online ones first, by id. ``nodes``
    has ``(node, online)``, one row a node; ``acks`` ``(cid, node)``.
    """
    place = Window.orderBy(F.desc("online"), "node")
    holders = nodes.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= factor).select("node")
    return (
        acks.select("cid", "node").distinct()
        .join(F.broadcast(holders.withColumn("holder", F.lit(1))), "node", "left")
        .groupBy("cid")
        .agg(F.count("holder").alias("acked"))
        .withColumn("accepted", F.col("acked") >= required(factor))
    )
