"""Typed document filters as Spark columns.

A filter is ``{"key": "a.b", "operator": op, "value": literal}``; several hold
together. Comparison is strict about types: the text "42" never equals the
number 42, true never equals 1, and a missing key matches neither ``eq`` nor
``ne``. Over JSON text the typed value comes from a VARIANT; over native
columns the same filters become plain comparisons that reach the Parquet scan.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERED = ("gt", "gte", "lt", "lte")
OPERATORS = ("eq", "ne", *ORDERED)
#: Longest path of a filter key.
PATH_LENGTH = 512
_NUMERIC = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


class FilterError(ValueError):
    """A filter that is not well formed."""


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def path_segments(key: str) -> list[str]:
    """``a.b`` as its members; array positions can't be addressed."""
    if not isinstance(key, str) or not key or len(key) > PATH_LENGTH:
        raise FilterError(f"bad key: {key!r}")
    parts = key.split(".")
    if any(not p or any(ord(c) < 32 for c in p) for p in parts):
        raise FilterError(f"empty or unprintable member in {key!r}")
    return parts


def json_path(key: str) -> str:
    """The members of ``key`` as a quoted JSON path."""
    quote = lambda p: p.replace("\\", "\\\\").replace('"', '\\"')
    return "$" + "".join(f'["{quote(p)}"]' for p in path_segments(key))


def _bracket_path(key: str) -> str:
    """The path form of ``get_json_object``."""
    return "$" + "".join(f"['{p}']" for p in path_segments(key))


def validate(filters: Any) -> list[dict]:
    """A filter, a list of them, ``{"filters": ...}`` or nothing, as a list."""
    if filters is None:
        return []
    if isinstance(filters, str):
        try:
            filters = json.loads(filters)
        except ValueError as e:
            raise FilterError(str(e)) from e
    if isinstance(filters, Mapping) and "filters" in filters:
        return validate(filters["filters"])
    found = [filters] if isinstance(filters, Mapping) else filters
    if not isinstance(found, Sequence):
        raise FilterError("a filter is an object or a list of objects")
    for f in found:
        if not isinstance(f, Mapping) or not {"key", "operator", "value"} <= set(f):
            raise FilterError("a filter needs key, operator and value")
        path_segments(f["key"])
        if f["operator"] not in OPERATORS:
            raise FilterError(f"unknown operator {f['operator']!r}")
        if f["operator"] in ORDERED and not _is_number(f["value"]):
            raise FilterError(f"{f['operator']} needs a number")
    return [dict(f) for f in found]


def _normal(value: Any) -> Any:
    """Whole doubles are integers, as a JSON printer writes them."""
    return int(value) if isinstance(value, float) and value.is_integer() else value


def _compare(x: Column, op: str, value: Any) -> Column:
    return {"gt": x > value, "gte": x >= value, "lt": x < value, "lte": x <= value}[op]


def _json_equal(doc: Column, parsed: Column, key: str, value: Any) -> Column:
    value = _normal(value)
    x = F.try_variant_get(parsed, json_path(key), "variant")
    kind = F.schema_of_variant(x)
    if value is None:
        return F.is_variant_null(x)
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(x, "$", "boolean") == value)
    if isinstance(value, int):
        return (kind == "BIGINT") & (F.try_variant_get(x, "$", "bigint") == value)
    if isinstance(value, float):
        return kind.rlike(_NUMERIC) & (kind != "BIGINT") & (F.try_variant_get(x, "$", "double") == value)
    if isinstance(value, str):
        return (kind == "STRING") & (F.try_variant_get(x, "$", "string") == value)
    # Objects and arrays compare as minified text, in their own order of keys.
    return F.get_json_object(doc, _bracket_path(key)) == json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def json_predicate(doc: Column, filters: Any) -> Column:
    """All filters over a column of JSON text, which is parsed once a row."""
    def one(parsed: Column, f: dict) -> Column:
        key, op, value = f["key"], f["operator"], _normal(f["value"])
        if op == "eq":
            return F.coalesce(_json_equal(doc, parsed, key, value), F.lit(False))
        x = F.try_variant_get(parsed, json_path(key), "variant")
        if op == "ne":
            return x.isNotNull() & ~F.coalesce(_json_equal(doc, parsed, key, value), F.lit(False))
        kind = F.schema_of_variant(x)
        number = F.when(kind.rlike(_NUMERIC), _compare(F.try_variant_get(x, "$", "double"), op, float(value)))
        if isinstance(value, int) and -(2**63) <= value < 2**63:  # doubles blur whole numbers past 2 ** 53
            number = F.when(kind == "BIGINT", _compare(F.try_variant_get(x, "$", "bigint"), op, value)).otherwise(number)
        return F.coalesce(number, F.lit(False))

    found = validate(filters)
    if not found:
        return F.lit(True)
    # One-element array: the text is parsed once, however many filters look at it.
    return F.exists(F.array(F.try_parse_json(doc)), lambda parsed: reduce(lambda a, b: a & b, (one(parsed, f) for f in found)))


def _field(schema: T.StructType, key: str) -> T.DataType | None:
    kind: T.DataType = schema
    for part in path_segments(key):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return kind


def _same_class(kind: T.DataType, value: Any) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, int):
        return isinstance(kind, T.IntegralType) or isinstance(kind, T.FractionalType)
    if isinstance(value, float):
        return isinstance(kind, T.FractionalType)
    return isinstance(value, str) and isinstance(kind, T.StringType)


def native_predicate(df: DataFrame, filters: Any) -> Column:
    """All filters over native columns (structs for nested keys).

    A literal of another class than its column never matches. A null stands
    for a JSON null, so ``eq null`` is ``IS NULL``.
    """
    def one(f: dict) -> Column:
        key, op, value = f["key"], f["operator"], _normal(f["value"])
        kind = _field(df.schema, key)
        if kind is None:
            return F.lit(False)
        x = df[path_segments(key)[0]]
        for part in path_segments(key)[1:]:
            x = x.getField(part)
        if op in ORDERED:
            return _compare(x, op, value) if isinstance(kind, T.NumericType) else F.lit(False)
        if value is None:
            return x.isNull() if op == "eq" else x.isNotNull()
        if isinstance(kind, (T.ArrayType, T.StructType)) and isinstance(value, (list, dict)):
            same = F.to_json(x, {"ignoreNullFields": "false"}) == json.dumps(value, separators=(",", ":"), ensure_ascii=False)
        elif _same_class(kind, value):
            same = x == value
        else:
            return F.lit(op == "ne")
        # A null is no match here and stays one under AND, which lets Parquet
        # take the comparison; only a negation needs it made false.
        return same if op == "eq" else ~F.coalesce(same, F.lit(False))

    return reduce(lambda a, b: a & b, map(one, validate(filters)), F.lit(True))
