"""Approximate nearest neighbours over a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is then sent to its leaf. A
query walks the tree best bin first: a priority queue holds the branches seen
so far by the cosine of their centre, the best is opened next, and leaves come
out in falling order of promise. How many leaves a query visits is calibrated:
a sample of rows is searched by brute force over all rows, the visits are
widened until the wanted recall is reached on them, and all queries use that
number, or more until as many rows as asked for are seen. Rows of a leaf are compared in double precision.

Leaves and the queries that visit them are cut into chunks of bounded size, so
a leaf that holds a third of all rows is spread over many tasks, and a pair of
row and query is never a row of a table.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows with a null id or a dimension other than
the most common one's; a row is no candidate of a query with its own id; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import write_shared
from docloom.llm.vectors import best, prepared, stack

#: Rows on which the tree is fitted, rows that calibrate, the wanted recall.
SAMPLE_ROWS, CALIBRATION_ROWS, RECALL = 20_000, 200, 0.97
#: Branches of a node, sampled rows of a leaf at most, rounds of k-means.
BRANCHES, LEAF_ROWS, ROUNDS = 8, 48, 8
#: Rows and queries of one task's chunk.
CHUNK_ROWS, CHUNK_QUERIES = 8192, 8192


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaling by the largest component first keeps
    tiny and huge vectors exact."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def build_tree(sample: np.ndarray, seed: int = 5) -> dict:
    """``centres`` and ``children`` of every inner node; leaves are numbered."""
    rng = np.random.default_rng(seed)
    tree: dict = {"centres": [], "children": [], "leaves": 0}

    def grow(x: np.ndarray) -> tuple[str, int]:
        if len(x) > LEAF_ROWS:
            centres = x[rng.choice(len(x), BRANCHES, replace=False)]
            for _ in range(ROUNDS):
                own = np.argmax(x @ centres.T, axis=1)
                means = np.array([x[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(BRANCHES)])
                norms = np.linalg.norm(means, axis=1, keepdims=True)
                centres = np.where(norms > 1e-12, means / np.maximum(norms, 1e-12), centres)
            own = np.argmax(x @ centres.T, axis=1)
            used = [c for c in range(BRANCHES) if (own == c).any()]
            if len(used) > 1:
                at = len(tree["centres"])
                tree["centres"].append(centres[used])
                tree["children"].append(None)
                tree["children"][at] = [grow(x[own == c]) for c in used]
                return "node", at
        tree["leaves"] += 1
        return "leaf", tree["leaves"] - 1

    tree["root"] = grow(sample)
    return tree


def leaves_of(tree: dict, x: np.ndarray) -> np.ndarray:
    """The leaf of each row: down the nearest centre at every node."""
    out = np.zeros(len(x), np.int32)
    stack_ = [(tree["root"], np.arange(len(x)))]
    while stack_:
        (kind, at), rows = stack_.pop()
        if kind == "leaf":
            out[rows] = at
            continue
        own = np.argmax(x[rows] @ tree["centres"][at].T, axis=1)
        stack_ += [(child, rows[own == c]) for c, child in enumerate(tree["children"][at]) if (own == c).any()]
    return out


def best_bins(tree: dict, x: np.ndarray, visits: int, sizes: dict[int, int] | None = None, least: int = 0) -> list[int]:
    """The first ``visits`` leaves that best-bin-first traversal reaches, and
    more until they hold ``least`` rows by ``sizes``."""
    queue, out, rows = [(-1.0, *tree["root"])], [], 0
    while queue and (len(out) < visits or rows < least):
        _, kind, at = heapq.heappop(queue)
        if kind == "leaf":
            out.append(at)
            rows += sizes.get(at, 0) if sizes else 0
            continue
        for s, child in zip((-(tree["centres"][at] @ x)).tolist(), tree["children"][at]):
            heapq.heappush(queue, (s, *child))
    return out


def _top(rows: np.ndarray, ids: np.ndarray, asked: np.ndarray, asked_ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """Each query's k best of the rows, ties to the smaller id."""
    out = []
    for at in range(0, len(asked), 256):
        dots = asked[at : at + 256] @ rows.T
        dots[asked_ids[at : at + 256, None] == ids[None, :]] = -2
        for i, row in enumerate(dots):
            near = np.nonzero(row >= np.partition(row, -k)[-k])[0] if len(row) > k else np.arange(len(row))
            near = near[row[near] > -1.5]
            order = np.lexsort((ids[near], -row[near]))[:k]
            out += [(int(asked_ids[at + i]), int(ids[j]), float(row[j])) for j in near[order]]
    return out


FOUND = "query_id long, vec_id long, score double"


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])
    return out.astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def calibrate(rows: DataFrame, tree: dict, k: int, dim: int) -> int:
    """Leaf visits at which sampled rows' own searches reach ``RECALL``."""
    asked = rows.orderBy(F.xxhash64("vec_id", F.lit(17)), "vec_id").limit(CALIBRATION_ROWS).toPandas()
    x, ids = unit(stack(asked["x"], dim)), asked["vec_id"].to_numpy()

    def brute(batches):
        for pdf in batches:
            yield _frame(_top(unit(stack(pdf["x"], dim)), pdf["vec_id"].to_numpy(), x, ids, k))

    true = best(rows.mapInPandas(brute, FOUND), k).select("query_id", "vec_id")
    placed = rows.select("vec_id", "leaf").join(F.broadcast(true), "vec_id").dropDuplicates(["query_id", "vec_id"]).toPandas()
    where = {q: g["leaf"].tolist() for q, g in placed.groupby("query_id")}
    needed = []
    for q, v in zip(ids, x):
        place = {leaf: i for i, leaf in enumerate(best_bins(tree, v, tree["leaves"]))}
        needed += [place[leaf] + 1 for leaf in where.get(q, [])]
    return int(np.quantile(needed, RECALL, method="higher")) if needed else 1


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows where ``is_query`` holds;
    it is written in terms of ``vec_id``."""
    spark = vectors.sparkSession
    table = prepared(vectors, id_col, vector_col, nonzero=True)
    common = table.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").head()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = common["dim"]
    table = table.filter(F.size("x") == dim)
    sample = table.orderBy(F.xxhash64("vec_id", F.lit(29)), "vec_id").limit(SAMPLE_ROWS).select("x").toPandas()
    tree = build_tree(unit(stack(sample["x"], dim)))
    shared = spark.sparkContext.broadcast(tree)

    def place(batches):
        for pdf in batches:
            yield pdf.assign(leaf=leaves_of(shared.value, unit(stack(pdf["x"], dim))))

    rows = write_shared(table.mapInPandas(place, "vec_id long, x array<double>, leaf int"), "leaves")
    visits = calibrate(rows, tree, k, dim)
    sizes = {r["leaf"]: r["n"] for r in rows.groupBy("leaf").agg(F.count_distinct("vec_id").alias("n")).collect()}

    def route(batches):
        for pdf in batches:
            bins = [best_bins(shared.value, v, visits, sizes, k + 1) for v in unit(stack(pdf["x"], dim))]
            yield pdf.assign(bins=bins)

    routed = write_shared(
        rows.filter(is_query).select("vec_id", "x").mapInPandas(route, "vec_id long, x array<double>, bins array<int>")
        .select("vec_id", "x", F.explode("bins").alias("leaf")), "routes")
    chunks = rows.groupBy("leaf").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("nv")).join(
        routed.groupBy("leaf").agg(F.ceil(F.count("*") / CHUNK_QUERIES).cast("int").alias("nq")), "leaf"
    )
    few = F.broadcast(write_shared(chunks, "chunks"))  # a row a leaf, and leaves are bounded by the sample

    def dealt(table: DataFrame, own: str, many: str, other: str, others: str) -> DataFrame:
        return (
            table.join(few, "leaf")
            .withColumn(own, F.pmod(F.xxhash64("vec_id"), F.col(many)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
            .select("leaf", "cv", "cq", "vec_id", "x")
        )

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return _frame([])
        return _frame(_top(unit(stack(left["x"], dim)), left["vec_id"].to_numpy(), unit(stack(right["x"], dim)), right["vec_id"].to_numpy(), k))

    key = ["leaf", "cv", "cq"]
    found = dealt(rows, "cv", "nv", "cq", "nq").groupBy(*key).cogroup(dealt(routed, "cq", "nq", "cv", "nv").groupBy(*key)).applyInPandas(compare, FOUND)
    return best(found, k)
