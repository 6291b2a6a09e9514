"""Handlers around writes.

A handler is a Python callable for ``(db, partition, keyspace, event)``. Before
a write it may return another document or veto it; after a write it may cause
further writes, which never fire handlers themselves. Handlers run on the
executors over Arrow batches; what they look up is a broadcast table of checked
size. They are administrators' code and run unconfined.
"""

from __future__ import annotations

import calendar
import json
import logging
import time
from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from docloom.functions.filters import ORDERED, path_segments, validate

EVENTS = ("beforeInsert", "afterInsert", "beforeUpdate", "afterUpdate", "beforeDelete", "afterDelete")
#: Rows that handlers may look up at most.
LOOKUP_ROWS = 100_000


class Rollback(Exception):
    """Raised by a handler to veto the write."""


def _holds(entity: dict, f: dict) -> bool:
    """Whether a filter holds for a document, by the rules of ``json_predicate``."""
    x: Any = entity
    for part in path_segments(f["key"]):
        if not isinstance(x, dict) or part not in x:
            return False
        x = x[part]
    op, value = f["operator"], f["value"]
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    if op in ORDERED:
        return number(x) and {"gt": x > value, "gte": x >= value, "lt": x < value, "lte": x <= value}[op]
    same = x == value if number(x) and number(value) else type(x) is type(value) and x == value
    return same == (op == "eq")


class Context:
    """What a handler may call: lookups, writes, the nodes, the log and the clock."""

    def __init__(self, lookups: dict[tuple[str, str, str], str], now: int, nodes: Sequence[dict] = ()):
        self._lookups, self.now, self.writes, self._nodes = lookups, now, [], nodes

    def cluster(self) -> list[dict]:
        """The nodes as the caller described them."""
        return [dict(n) for n in self._nodes]

    def get(self, partition: str, keyspace: str, key: str) -> dict | None:
        found = self._lookups.get((partition, keyspace, key))
        return None if found is None else {"id": key, **json.loads(found)}

    def query(self, partition: str, keyspace: str, filters: Any = None) -> list[dict]:
        """The documents of a keyspace for which all filters hold."""
        found = [{"id": k, **json.loads(v)} for (p, s, k), v in sorted(self._lookups.items()) if (p, s) == (partition, keyspace)]
        wanted = validate(filters)
        return [d for d in found if all(_holds(d, f) for f in wanted)]

    def count(self, partition: str, keyspace: str) -> int:
        return len(self.query(partition, keyspace))

    def put(self, partition: str, keyspace: str, key: str, entity: dict) -> None:
        body = {k: v for k, v in entity.items() if k != "id"}
        self.writes.append((partition, keyspace, key, "put", json.dumps(body, separators=(",", ":"), ensure_ascii=False)))

    def remove(self, partition: str, keyspace: str, key: str) -> None:
        self.writes.append((partition, keyspace, key, "delete", None))

    def rollback(self, reason: str = "rejected") -> None:
        raise Rollback(reason)

    @staticmethod
    def log(*values: Any) -> None:
        logging.getLogger("docloom.triggers").info("\t".join(map(str, values)))

    @staticmethod
    def date_format(fmt: str, t: int) -> str:
        return time.strftime(fmt, time.gmtime(t))

    def date_time(self, parts: dict | None = None) -> int:
        """Seconds since 1970 of ``{"year", "month", "day", "hour", "min", "sec"}`` in UTC, or of now."""
        if parts is None:
            return self.now
        return calendar.timegm((parts["year"], parts["month"], parts["day"], parts.get("hour", 12), parts.get("min", 0), parts.get("sec", 0)))

    @staticmethod
    def date_diff(t1: int, t2: int) -> int:
        return t2 - t1


Handler = Callable[[dict, str, Context], dict | None]


class Triggers:
    """A registry of handlers by place and event; several run by name."""

    def __init__(self) -> None:
        self._handlers: dict[tuple[str, str, str, str], dict[str, Handler]] = {}

    def on(self, db: str, partition: str, keyspace: str, event: str, handler: Handler, name: str | None = None) -> None:
        if event not in EVENTS:
            raise ValueError(f"unknown event {event!r}")
        self._handlers.setdefault((db, partition, keyspace, event), {})[name or handler.__name__] = handler

    def handlers(self, db: str, partition: str, keyspace: str, event: str) -> list[Handler]:
        return [h for _, h in sorted(self._handlers.get((db, partition, keyspace, event), {}).items())]


def _lookups(table: DataFrame | None) -> dict[tuple[str, str, str], str]:
    if table is None:
        return {}
    rows = table.select("partition", "keyspace", "id", "value").limit(LOOKUP_ROWS + 1).collect()
    if len(rows) > LOOKUP_ROWS:
        raise ValueError(f"handlers look up at most {LOOKUP_ROWS} rows")
    return {(r["partition"], r["keyspace"], r["id"]): r["value"] for r in rows}


def before(rows: DataFrame, handlers: list[Handler], now: int, lookups: DataFrame | None = None, nodes: Sequence[dict] = ()) -> DataFrame:
    """``(id, value, veto)``: documents as handlers leave them. A veto or an
    error closes the write: ``veto`` has its reason."""
    known = _lookups(lookups)

    def run(batches):
        for pdf in batches:
            out = []
            for key, value in zip(pdf["id"], pdf["value"]):
                veto, entity = None, json.loads(value) if value else None
                try:
                    for h in handlers:
                        entity = h(dict(entity or {}), key, Context(known, now, nodes)) or entity
                except Rollback as e:
                    veto = str(e)
                except Exception as e:  # noqa: BLE001  a failing handler fails its write
                    veto = f"handler error: {e}"
                body = None if entity is None else json.dumps({k: v for k, v in entity.items() if k != "id"}, separators=(",", ":"), ensure_ascii=False)
                out.append((key, body, veto))
            yield pd.DataFrame(out, columns=["id", "value", "veto"])

    return rows.select("id", "value").mapInPandas(run, "id string, value string, veto string")


def after(rows: DataFrame, handlers: list[Handler], now: int, lookups: DataFrame | None = None, nodes: Sequence[dict] = ()) -> DataFrame:
    """Writes that handlers cause: ``(partition, keyspace, id, op, value)``. An
    error of a handler drops only its own writes."""
    known = _lookups(lookups)

    def run(batches):
        for pdf in batches:
            out: list[tuple] = []
            for key, value in zip(pdf["id"], pdf["value"]):
                for h in handlers:
                    ctx = Context(known, now, nodes)
                    try:
                        h(json.loads(value) if value else {}, key, ctx)
                        out += ctx.writes
                    except Exception as e:  # noqa: BLE001  the write itself has happened
                        ctx.log("after handler failed", e)
            yield pd.DataFrame(out, columns=["partition", "keyspace", "id", "op", "value"])

    return rows.select("id", "value").mapInPandas(run, "partition string, keyspace string, id string, op string, value string")
