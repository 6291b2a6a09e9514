"""Databases, partitions and keyspaces by name, and SQL over them.

Statements name relations in braces, ``{db.partition.keyspace}`` or, for all
keyspaces of a partition, ``{db.partition}``; PySpark's own parameters put the
DataFrames there, and Spark parses, plans and runs the rest.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession

from docloom.operators.keyspace import as_relation, one_per_id
from docloom.operators.security import authorise, next_group_bit

READS = ("SELECT", "WITH", "VALUES", "FROM", "(")


class StatementError(ValueError):
    """A statement that isn't one read of known relations."""


class Entities:
    """Named settings, groups, users or handlers of a catalog, listed by name."""

    def __init__(self) -> None:
        self._found: dict[str, dict] = {}

    def create(self, name: str, **values) -> None:
        if name in self._found:
            raise ValueError(f"{name!r} exists")
        self._found[name] = values

    def update(self, name: str, **values) -> None:
        self._found[name] = {**self._found[name], **values}

    def delete(self, name: str) -> None:
        del self._found[name]

    def get(self, name: str) -> dict | None:
        return self._found.get(name)

    def list(self) -> list[tuple[str, dict]]:
        return sorted(self._found.items())


class Catalog:
    """A registry of keyspaces; relations are loaded when they are named."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._databases: dict[str, int] = {}
        self._masks: dict[str, dict[str, int]] = {}
        self._keyspaces: dict[tuple[str, str, str], Callable[[], DataFrame]] = {}
        self.settings, self.users, self.code = Entities(), Entities(), Entities()
        self.groups = Entities()

    def create_group(self, name: str) -> int:
        """A group with the lowest free bit of the permission masks."""
        bit = next_group_bit(g["bit"] for _, g in self.groups.list())
        self.groups.create(name, bit=bit)
        return bit

    def create_database(self, name: str, replicas: int = 1) -> None:
        if name in self._databases:
            raise ValueError(f"database {name!r} exists")
        self._databases[name] = replicas

    def drop_database(self, name: str) -> None:
        """Drops its partitions and keyspaces too."""
        del self._databases[name]
        self._masks = {k: v for k, v in self._masks.items() if k.split(".")[0] != name}
        self._keyspaces = {k: v for k, v in self._keyspaces.items() if k[0] != name}

    def ensure(self, db: str, partition: str, keyspace: str, load: Callable[[], DataFrame]) -> None:
        """Register a keyspace, and its database and partition on the way."""
        self._databases.setdefault(db, 1)
        self._masks.setdefault(f"{db}.{partition}", {})
        self._keyspaces[(db, partition, keyspace)] = load

    def set_masks(self, db: str, partition: str, **masks: int) -> None:
        self._masks.setdefault(f"{db}.{partition}", {}).update(masks)

    def databases(self) -> dict[str, int]:
        return dict(self._databases)

    def partitions(self, db: str | None = None) -> list[str]:
        return sorted(p for p in self._masks if db is None or p.split(".")[0] == db)

    def keyspaces(self, db: str | None = None) -> list[tuple[str, str, str]]:
        return sorted(k for k in self._keyspaces if db is None or k[0] == db)

    def relation(self, db: str, partition: str, keyspace: str) -> DataFrame:
        if (db, partition, keyspace) not in self._keyspaces:
            raise StatementError(f"unknown keyspace {db}.{partition}.{keyspace}")
        return as_relation(self._keyspaces[(db, partition, keyspace)]())

    def partition(self, db: str, partition: str) -> DataFrame:
        """All keyspaces of a partition as one relation, one row per key."""
        found = {k[2]: as_relation(load()) for k, load in self._keyspaces.items() if k[:2] == (db, partition)}
        if not found:
            raise StatementError(f"unknown partition {db}.{partition}")
        return one_per_id(found).drop("_keyspace")

    def references(self, statement: str) -> list[tuple[str, ...]]:
        """The names in braces."""
        names = [field for _, field, _, _ in string.Formatter().parse(statement) if field is not None]
        found = [tuple(n.split(".")) for n in dict.fromkeys(names)]
        if not found or any(len(f) not in (2, 3) for f in found):
            raise StatementError("a statement names {db.partition.keyspace} or {db.partition}")
        return found

    def sql(self, statement: str, groups: int | None = None) -> DataFrame:
        """Run one reading statement; ``groups`` are the caller's, if checked."""
        words = statement.strip().rstrip(";")
        if not words.upper().startswith(READS):
            raise StatementError("only reading statements; changes go through the dml operators")
        names = self.references(words)
        if groups is not None:
            authorise(self._masks, {".".join(n[:2]) for n in names}, "read", groups)
        tree: dict[str, SimpleNamespace] = {}
        for n in names:
            df = self.relation(*n) if len(n) == 3 else self.partition(*n)
            words = words.replace("{" + ".".join(n) + "}", "{" + "_".join(n) + "}")
            tree["_".join(n)] = df
        return self.spark.sql(words, **tree)
