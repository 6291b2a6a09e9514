"""Keyspaces: reading documents by key, by filter, in order, across a partition."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.filters import json_predicate, native_predicate
from docloom.operators.changes import live

#: A stored row: JSON text with its expiry, write time and origin.
ROW = "id string, value string, ttl bigint, timestamp bigint, origin string"


class Keyspace:
    """One collection of documents: rows of ``ROW``, seen at time ``now``."""

    def __init__(self, rows: DataFrame, now: int):
        self.rows, self.now = rows, now

    def live(self, filters: Any = None) -> DataFrame:
        """Live rows for which all filters hold."""
        found = self.rows.filter(live(self.now))
        return found.filter(json_predicate(F.col("value"), filters)) if filters else found

    def get(self, key: str) -> DataFrame:
        """The document of one key, or no row."""
        return self.live().filter(F.col("id") == key).select("id", "timestamp", "value")

    def ids(self, filters: Any = None) -> DataFrame:
        """Keys by write time, then key."""
        return self.live(filters).orderBy("timestamp", "id").select("id")

    def all(self, filters: Any = None) -> DataFrame:
        return self.live(filters).select("value")

    def meta(self, filters: Any = None) -> DataFrame:
        """``(id, timestamp, value)``, as merges take them."""
        return self.live(filters).select("id", "timestamp", "value")

    def documents(self, filters: Any = None) -> DataFrame:
        """JSON objects with their key as the leading member ``id``."""
        body = F.col("value")
        inner = F.regexp_extract(body, r"(?s)\A\s*\{(.*)\}\s*\z", 1)
        known = F.try_parse_json(body)
        own = F.concat(F.lit('{"id":'), F.to_json(F.struct(F.col("id").alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("id").alias("v")))) - 6))
        whole = F.when(F.trim(inner) == "", F.concat(own, F.lit("}"))).otherwise(F.concat(own, F.lit(","), inner, F.lit("}")))
        return self.live(filters).filter(F.schema_of_variant(known).startswith("OBJECT")).select("id", whole.alias("document"))

    def count(self) -> DataFrame:
        return self.live().agg(F.count("*").alias("n"))

    def table(self, schema: str) -> DataFrame:
        """Documents as columns: a relation for SQL, booleans as 0 and 1."""
        parsed = self.live().select("id", F.from_json("value", schema).alias("doc")).select("id", "doc.*")
        return as_relation(parsed)


def as_relation(df: DataFrame) -> DataFrame:
    """Columns as SQL sees them: booleans are numbers, nested values JSON text."""
    out = []
    for name, kind in df.dtypes:
        x = F.col(f"`{name}`")
        if kind == "boolean":
            x = x.cast("bigint")
        elif kind.startswith(("struct", "array", "map")):
            x = F.to_json(x)
        out.append(x.alias(name))
    return df.select(*out)


def where(df: DataFrame, filters: Any) -> DataFrame:
    """Filters over native columns; they reach the scan."""
    return df.filter(native_predicate(df, filters))


def union(keyspaces: Mapping[str, DataFrame]) -> DataFrame:
    """All keyspaces of a partition under the union of their columns."""
    tagged = [df.withColumn("_keyspace", F.lit(name)) for name, df in keyspaces.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def newest_first(keyspaces: Mapping[str, DataFrame]) -> DataFrame:
    """A partition's documents, newest first; equal keys stay apart."""
    return union(keyspaces).orderBy(F.desc("timestamp"), "id", "_keyspace")


def one_per_id(keyspaces: Mapping[str, DataFrame], key: str = "id") -> DataFrame:
    """A partition as one relation: of equal keys the later keyspace's row."""
    order = {name: i for i, name in enumerate(keyspaces)}
    place = F.element_at(F.create_map(*[x for k, i in order.items() for x in (F.lit(k), F.lit(i))]), F.col("_keyspace"))
    turn = Window.partitionBy(key).orderBy(F.desc("_place"))
    return (
        union(keyspaces).withColumn("_place", place).withColumn("_turn", F.row_number().over(turn)).filter("_turn = 1").drop("_place", "_turn")
    )
