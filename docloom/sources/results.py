"""Results as the JSON envelope that clients read, and as aligned text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON array, distributed: binary as lower-case hex."""
    cells = [F.lower(F.hex(F.col(f"`{c}`"))) if t == "binary" else F.col(f"`{c}`") for c, t in df.dtypes]
    quoted = [F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)\A\{\"v\":(.*)\}\z", 1), F.lit("null")) for c in cells]
    text = [F.when(c.isNull(), F.lit("null")).otherwise(q) for c, q in zip(cells, quoted)]
    return df.select(F.concat(F.lit("["), F.concat_ws(",", *text), F.lit("]")).alias("row"))


def envelope(df: DataFrame, limit: int = 10_000) -> str:
    """``{"columns", "rows", "status"}`` of at most ``limit`` rows; a result of
    more says ``"truncated":true``. Whole results go to a writer over ``row_json``."""
    rows = [r["row"] for r in row_json(df).limit(limit + 1).collect()]
    cut = ',"truncated":true' if len(rows) > limit else ""
    return '{"columns":' + json.dumps(df.columns) + ',"rows":[' + ",".join(rows[:limit]) + '],"status":"ok"' + cut + "}"


def table(df: DataFrame, limit: int = 100) -> str:
    """Aligned columns of at most ``limit`` rows."""
    rows = [["NULL" if v is None else str(v) for v in r] for r in df.limit(limit).collect()]
    wide = [max(map(len, col)) for col in zip(df.columns, *rows)] if rows else [len(c) for c in df.columns]
    line = lambda cells: " | ".join(c.ljust(w) for c, w in zip(cells, wide)).rstrip()
    return "\n".join([line(df.columns), "-+-".join("-" * w for w in wide), *map(line, rows)])
