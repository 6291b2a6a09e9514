"""Which node owns and holds a shard: reports over hash ranges.

Keys are 32 hexadecimal digits; n nodes in order of id share their space in
equal slices, the last one taking the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = 1 << 32


def slice_of(key: Column, nodes: int) -> Column:
    """The number of the slice that holds a key."""
    head = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")
    return F.least(F.floor(head / F.lit(SPACE // nodes)), F.lit(nodes - 1)).cast("int")


def ranges(nodes: list[str]) -> list[tuple[str, str, str]]:
    """``(node, start, end)`` of every slice, bounds inclusive."""
    step, last = SPACE // len(nodes), len(nodes) - 1
    return [
        (node, f"{i * step:08x}" + "0" * 24, "f" * 32 if i == last else f"{(i + 1) * step - 1:08x}" + "f" * 24)
        for i, node in enumerate(sorted(nodes))
    ]


def owners(shards: DataFrame, nodes: list[str], key: str = "key") -> DataFrame:
    """``shards`` with the node that owns each."""
    names = F.array(*map(F.lit, sorted(nodes)))
    return shards.withColumn("owner", F.element_at(names, slice_of(F.col(key), len(nodes)) + 1))


def holders(shards: DataFrame, nodes: list[str], factor: int, key: str = "key") -> DataFrame:
    """One row per shard and holder: the ring from its owner on."""
    names, n = F.array(*map(F.lit, sorted(nodes))), len(nodes)
    ring = F.sequence(F.lit(0), F.lit(min(factor, n) - 1))
    return shards.withColumn("place", F.explode(ring)).withColumn(
        "node", F.element_at(names, (slice_of(F.col(key), n) + F.col("place")) % n + 1)
    )


def moves(shards: DataFrame, before: list[str], after: list[str], factor: int, key: str = "key") -> DataFrame:
    """Copies that a change of nodes adds or makes redundant."""
    old = holders(shards, before, factor, key).select(key, "node", F.lit(1).alias("had"))
    new = holders(shards, after, factor, key).select(key, "node", F.lit(1).alias("has"))
    both = old.join(new, [key, "node"], "full")
    return both.filter(F.col("had").isNull() | F.col("has").isNull()).select(
        key, "node", F.when(F.col("had").isNull(), "copy").otherwise("drop").alias("action")
    )


def leader(nodes: DataFrame) -> DataFrame:
    """The least id of those online."""
    return nodes.filter("online").agg(F.min("node").alias("leader"))


def gossip(views: DataFrame) -> DataFrame:
    """Views of nodes merged: latest contact, highest compliance, and removal
    that stays once seen."""
    return views.groupBy("node").agg(
        F.max("last_seen").alias("last_seen"), F.max("compliant").alias("compliant"), F.bool_or("removed").alias("removed")
    )


def newest_ranges(tables: DataFrame) -> DataFrame:
    """The range table of the highest generation."""
    top = tables.agg(F.max("generation").alias("generation"))
    return tables.join(F.broadcast(top), "generation")
