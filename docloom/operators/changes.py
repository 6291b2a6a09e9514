"""The change log and what is read from it.

A change is ``(op, db, partition, keyspace, id, value, ttl, ts, origin, cid)``:
a put with its JSON text and absolute expiry, or a delete. The current state is
a view over the log: per key the change with the greatest ``(ts, origin)``
wins, so changes may arrive in any order and more than once. Every operator
that depends on the time takes it as ``now`` in epoch seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("db", "partition", "keyspace", "id")
SCHEMA = "op string, db string, partition string, keyspace string, id string, value string, ttl bigint, ts bigint, origin string, cid string"
#: Seconds that a tombstone lies in the past, and that purging waits.
TOMBSTONE_AGE, GRACE = 5, 7200


def live(now: int | Column, ttl: str = "ttl") -> Column:
    """Not expired at ``now``."""
    return F.col(ttl).isNull() | (F.col(ttl) >= now)


def expiry(seconds: Column, ts: Column) -> Column:
    """Absolute expiry of a relative one; negative means none."""
    return F.when(seconds >= 0, ts + seconds)


def shard_key(partition: Column, keyspace: Column) -> Column:
    """The key of a shard; databases share shards of equal names."""
    return F.md5(F.concat(F.md5(partition.cast("binary")), F.lit(":"), F.md5(keyspace.cast("binary"))).cast("binary"))


def latest(changes: DataFrame, *keys: str) -> DataFrame:
    """Last write wins: one row per key, tombstones included.

    The winner is taken by a partial aggregate, so a key with any number of
    versions sends one row per task to the shuffle.
    """
    keys = keys or KEY
    rest = [c for c in changes.columns if c not in keys]
    # Equal (ts, origin) pairs are decided by the row itself, not by arrival.
    order = F.struct(F.col("ts"), F.coalesce("origin", F.lit("")), F.struct(*rest))
    won = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("won"))
    state = won.select(*keys, "won.*")
    dead = F.col("op") == "delete"
    return state.withColumn("ttl", F.when(dead, F.col("ts") - TOMBSTONE_AGE).otherwise(F.col("ttl"))).withColumn(
        "value", F.when(~dead, F.col("value"))
    )


def current(changes: DataFrame, now: int, *keys: str) -> DataFrame:
    """The live documents of a change log."""
    return latest(changes, *keys).filter((F.col("op") != "delete") & live(now))


def purged(state: DataFrame, now: int) -> DataFrame:
    """The state without rows that expired over ``GRACE`` seconds ago."""
    return state.filter(F.col("ttl").isNull() | (F.col("ttl") >= now - GRACE))


def distinct_changes(changes: DataFrame, *by: str) -> DataFrame:
    """Each change once per target: deliveries may repeat."""
    return changes.dropDuplicates(list(by or ("target", "cid")))


def pending(changes: DataFrame, applied: DataFrame, batch: int | None = 256) -> DataFrame:
    """Changes a target has not applied, oldest first, a batch at a time."""
    left = changes.join(applied.select("target", "cid").distinct(), ["target", "cid"], "left_anti")
    if batch is None:
        return left
    turn = Window.partitionBy("target").orderBy("seq")
    return left.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= batch).drop("turn")


def caught_up(snapshot: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """A snapshot's rows and the changes since, resolved together."""
    return latest(snapshot.unionByName(changes, allowMissingColumns=True), *keys)
