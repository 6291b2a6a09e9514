"""INSERT, UPDATE and DELETE as rows of the change log.

A relation is a DataFrame with a column ``id`` and one column per member of
the documents. Statements don't change it: they return change rows
``(op, id, value, ttl, ts)``, which the caller appends to the log. Every column
of a row is written, nulls as explicit JSON nulls, and an expiry that a
document had is lost, as a put without one replaces it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that route a row and aren't part of its document.
ROUTING = ("id", "_keyspace")


class Conflict(ValueError):
    """An inserted key exists; nothing is applied."""


def document(relation: DataFrame) -> Column:
    """The JSON text of a row."""
    members = [F.col(f"`{c}`") for c in relation.columns if c not in ROUTING]
    return F.to_json(F.struct(*members), {"ignoreNullFields": "false"}) if members else F.lit("{}")


def _changes(op: str, rows: DataFrame, now: int) -> DataFrame:
    value = document(rows) if op == "put" else F.lit(None).cast("string")
    kept = [c for c in ROUTING if c in rows.columns]
    return rows.select(F.lit(op).alias("op"), *kept, value.alias("value"), F.lit(None).cast("bigint").alias("ttl"), F.lit(now).cast("bigint").alias("ts"))


def insert(relation: DataFrame, rows: DataFrame, now: int, replace: bool = False) -> DataFrame:
    """Puts of new rows. A key that exists, or occurs twice, fails the whole
    statement unless ``replace`` is set."""
    if "_keyspace" in relation.columns:
        raise ValueError("rows are inserted into one keyspace, not into a partition")
    if "id" not in rows.columns:
        raise ValueError("inserted rows need an id")
    rows = rows.withColumn("id", F.col("id").cast("string"))
    if not replace:
        known = rows.select("id").join(relation.select("id"), "id", "left_semi")
        twice = rows.groupBy("id").count().filter("count > 1").select("id")
        found = known.unionByName(twice).head(1)
        if found:
            raise Conflict(f"id {found[0]['id']!r} exists")
    return _changes("put", rows, now)


def update(relation: DataFrame, assignments: Mapping[str, Column | str], condition: Column | str, now: int) -> DataFrame:
    """Puts of the changed rows; new columns may be assigned. A changed ``id``
    deletes the old key and puts the new one."""
    where = F.expr(condition) if isinstance(condition, str) else condition
    values = {c: (F.expr(v) if isinstance(v, str) else v) for c, v in assignments.items()}
    hit = relation.filter(where)
    if "id" not in values:
        return _changes("put", hit.withColumns(values), now)
    moved = hit.withColumn("_old", F.col("id")).withColumns(values)
    same = F.col("_old").eqNullSafe(F.col("id"))
    gone = moved.filter(~same).select(F.col("_old").alias("id"), *[c for c in ("_keyspace",) if c in relation.columns])
    return _changes("delete", gone, now).unionByName(_changes("put", moved.drop("_old"), now))


def delete(relation: DataFrame, condition: Column | str | None, now: int) -> DataFrame:
    """Tombstones of the matching rows, of all without a condition."""
    hit = relation if condition is None else relation.filter(condition)
    return _changes("delete", hit.select(*[c for c in ROUTING if c in relation.columns]), now)


def applied(relation: DataFrame, changes: DataFrame) -> DataFrame:
    """``(id, value)`` of a relation after a statement's changes."""
    new = changes.groupBy("id").agg(F.max_by(F.struct("op", "value"), F.when(F.col("op") == "put", 1).otherwise(0)).alias("c"))
    old = relation.select("id", document(relation).alias("value"))
    return old.join(new.select("id", F.col("c.op").alias("op"), F.col("c.value").alias("put")), "id", "full").filter(
        F.col("op").isNull() | (F.col("op") == "put")
    ).select("id", F.coalesce("put", "value").alias("value"))


def summary(changes: DataFrame, statement: str) -> dict:
    """What a client is told: the statement, its count and the first 1000 keys;
    ``truncated`` says whether there are more."""
    ids = [r["id"] for r in changes.select("id").orderBy("id").limit(1001).collect()]
    return {"status": "ok", "op": statement, "count": changes.count(), "applied": ids[:1000], "failed": [], "truncated": len(ids) > 1000}
