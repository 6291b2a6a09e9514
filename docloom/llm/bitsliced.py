"""Exact top-k inner products over a bit-sliced index.

Every component is quantised to an integer, made non-negative by the column's
minimum, and stored as bit slices: slice b of a component has one bit a row.
A query's inner products with all rows of a block are worked out by bitmap
arithmetic alone: for every bit a of a query component the component's slices
are added at weight a, with full adders that turn three bitmaps of one weight
into one of that weight and one of the next. The sums are then bit slices
themselves, from which the top rows are selected from the most significant
slice downward; rows that tie at the boundary are resolved by smaller id.
Scores are computed exactly for the rows selected.

A query's components are made non-negative too; what that adds to a row's
score depends on the row alone and is taken off through one more attribute.

Rows are blocked by a hash of the id, queries likewise, and every query block
meets every row block by key: memory is bounded by the two blocks, and no pair
of row and query is ever a row of a table. Row blocks stand on ``SHELVES``
shelves, and a query block is copied to each shelf and not to each block, so
that what is moved grows as the input. It is never broadcast: Spark can't see
from the size of the queries how large their copies are.

Defined cases: vectors that are null, empty or hold null or non-finite
components take no part, nor do rows with a null id; vectors whose length
differs from the query's have no score with it; a row is no candidate of a
query with its own id; fewer candidates than k give fewer rows; an empty table
gives an empty result. Components beyond ``LIMIT`` raise an error, as their
scores might not fit a long.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import write_shared
from docloom.llm.vectors import best, prepared, stack

#: Rows of an index block and of a query block, queries worked on at once.
BLOCK_ROWS, QUERY_ROWS, AT_ONCE = 4096, 512, 32
#: Most copies of a query block.
SHELVES = 128
#: Largest quantised component.
LIMIT = 1 << 26


def _compact(q: np.ndarray) -> np.ndarray:
    """Integers in the smallest type that holds them all."""
    return q.astype(np.promote_types(np.min_scalar_type(min(-1, int(q.min(initial=0)))), np.min_scalar_type(-1 - int(q.max(initial=0)))))


def _slices(values: np.ndarray) -> list[np.ndarray]:
    """Non-negative integers as packed bitmaps, least significant first."""
    pad = -len(values) % 64
    v = np.pad(values, (0, pad))
    return [np.packbits((v >> b) & 1 == 1, bitorder="little").view(np.uint64) for b in range(int(values.max(initial=0)).bit_length())]


def build_block(ids: np.ndarray, q: np.ndarray) -> dict:
    """The index of one block: ids in order and slices of every attribute."""
    order = np.argsort(ids, kind="stable")
    ids, q = ids[order], q[order]
    low = q.min(axis=0)
    shifted = q - low
    total = shifted.sum(axis=1)
    return {
        "ids": ids,
        "rows": _compact(q),
        "low": low,
        "slices": [_slices(shifted[:, d]) for d in range(q.shape[1])],
        "rest": _slices(total.max() - total),
    }


def _sum(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Add bitmaps of weights 0, 1, 2, ... with full and half adders."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(columns):
        maps = columns[at]
        if at + 1 == len(columns) and len(maps) > 1:
            columns.append([])
        while len(maps) > 1:
            if len(maps) > 2:
                a, b, c = maps.pop(), maps.pop(), maps.pop()
                ab = a ^ b
                maps.insert(0, ab ^ c)
                columns[at + 1].append((a & b) | (ab & c))
            else:
                a, b = maps.pop(), maps.pop()
                maps.insert(0, a ^ b)
                columns[at + 1].append(a & b)
        out.append(maps[0] if maps else np.zeros(1, np.uint64))
        at += 1
    return out


def scores(block: dict, queries: np.ndarray) -> list[np.ndarray]:
    """Bit slices of every row's score, shifted by a constant per query."""
    least = min(0, int(queries.min()))
    u = queries - least
    columns: list[list[np.ndarray]] = [[] for _ in range(96)]
    for d, slices in enumerate(block["slices"]):
        for a in range(int(u[:, d].max()).bit_length()):
            mask = np.where((u[:, d] >> a) & 1 == 1, ~np.uint64(0), np.uint64(0))[:, None]
            for b, s in enumerate(slices):
                columns[a + b].append(mask & s)
    for a in range((-least).bit_length()):
        if (-least) >> a & 1:
            for b, s in enumerate(block["rest"]):
                columns[a + b].append(np.broadcast_to(s, (len(u), len(s))))
    while columns and not columns[-1]:
        columns.pop()
    return _sum(columns)


def select(slices: list[np.ndarray], n: int, queries: int, k: int) -> list[np.ndarray]:
    """Per query the positions of the k largest, ties to the first position."""
    words = -(-n // 64)
    valid = np.packbits(np.pad(np.ones(n, bool), (0, -n % 64)), bitorder="little").view(np.uint64)
    sure = np.zeros((queries, words), np.uint64)
    open_ = np.broadcast_to(valid, (queries, words)).copy()
    count = lambda x: np.bitwise_count(x).sum(axis=1)
    for s in reversed(slices):
        ones = open_ & s
        many = (count(sure) + count(ones) >= k)[:, None]
        sure = np.where(many, sure, sure | ones)
        open_ = np.where(many, ones, open_ & ~s)
    out = []
    for g, e in zip(sure, open_):
        where = lambda x: np.nonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))[0]
        taken = where(g)
        out.append(np.concatenate([taken, where(e)[: max(0, k - len(taken))]]))
    return out


def search_block(block: dict, ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """``(query_id, vec_id, score)`` of each query's k best rows of the block."""
    own = np.unique(block["ids"], return_counts=True)
    extra = int(own[1].max(initial=0))
    out = []
    for at in range(0, len(ids), AT_ONCE):
        q = queries[at : at + AT_ONCE].astype(np.int64)
        for i, rows in enumerate(select(scores(block, q), len(block["ids"]), len(q), k + extra)):
            exact = block["rows"][rows].astype(np.int64) @ q[i]
            near = sorted((-int(s), int(block["ids"][r])) for s, r in zip(exact, rows) if block["ids"][r] != ids[at + i])
            out += [(int(ids[at + i]), v, -s) for s, v in near[:k]]
    return out


def top_products(vectors: DataFrame, queries: DataFrame, k: int, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k largest products."""
    both = {}
    for name, table, size in (("rows", vectors, BLOCK_ROWS), ("queries", queries, QUERY_ROWS)):
        t = prepared(table, id_col, vector_col).select("vec_id", F.transform("x", lambda v: F.floor(v * scale)).alias("q"), F.size("x").alias("dim"))
        both[name] = write_shared(t, name)
    counts = {name: max(1, -(-t.count() // size)) for (name, t), size in zip(both.items(), (BLOCK_ROWS, QUERY_ROWS))}

    def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        q = stack(pdf["q"], int(pdf["dim"].iloc[0]), np.int64)
        if np.abs(q).max(initial=0) > LIMIT:
            raise ValueError(f"components beyond {LIMIT} after scaling")
        return pd.DataFrame({"dim": [q.shape[1]], "block": [int(pdf["block"].iloc[0])], "packed": [pickle.dumps(build_block(pdf["vec_id"].to_numpy(), q))]})

    def groups(pdf: pd.DataFrame) -> pd.DataFrame:
        q = stack(pdf["q"], int(pdf["dim"].iloc[0]), np.int64)
        return pd.DataFrame({"dim": [q.shape[1]], "group": [int(pdf["block"].iloc[0])], "asked": [pickle.dumps((pdf["vec_id"].to_numpy(), _compact(q)))]})

    dealt = {name: t.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(counts[name]))) for name, t in both.items()}
    index = dealt["rows"].groupBy("dim", "block").applyInPandas(blocks, "dim int, block int, packed binary")
    asked = dealt["queries"].groupBy("dim", "block").applyInPandas(groups, "dim int, group int, asked binary")
    shelves = min(SHELVES, counts["rows"])
    shelved = write_shared(index, "index").withColumn("shelf", F.col("block") % shelves)
    copied = write_shared(asked, "asked").withColumn("shelf", F.explode(F.sequence(F.lit(0), F.lit(shelves - 1))))
    # A number of partitions is named as little data makes much work here: Spark would put it into few tasks.
    left, right = (t.repartition(2 * shelves, "dim", "shelf") for t in (shelved, copied))
    pairs = left.join(right.hint("merge"), ["dim", "shelf"])

    def search(batches):
        for pdf in batches:
            rows = []
            for packed, wanted in zip(pdf["packed"], pdf["asked"]):
                rows += search_block(pickle.loads(packed), *pickle.loads(wanted), k)
            yield pd.DataFrame(np.array(rows, dtype=np.int64).reshape(-1, 3), columns=["query_id", "vec_id", "score"])

    return best(pairs.select("packed", "asked").mapInPandas(search, "query_id long, vec_id long, score long"), k)
