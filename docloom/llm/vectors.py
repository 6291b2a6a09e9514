"""Vectors of the search operators: which take part, and how they are blocked."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vector: Column, nonzero: bool = False) -> Column:
    """Not null, not empty, all components finite; some of them not zero."""
    x = vector.cast("array<double>")
    ok = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    if nonzero:
        ok = ok & F.exists(x, lambda v: v != 0)
    return F.coalesce(ok, F.lit(False))


def prepared(table: DataFrame, id_col: str, vector_col: str, nonzero: bool = False) -> DataFrame:
    """``(vec_id, x)`` of the rows that take part."""
    return table.filter(usable(F.col(vector_col), nonzero) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")
    )


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of ``(query_id, vec_id, score)`` per query, with ``rank``.

    Repeated rows of one id count as often as they occur.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def stack(column: pd.Series, dim: int, dtype=np.float64) -> np.ndarray:
    return np.array(column.tolist(), dtype=dtype).reshape(-1, dim)
