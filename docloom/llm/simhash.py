"""SimHash near-duplicates over sharded BK-trees.

A fingerprint has a bit for each of the 64 bits set in over half of the hashes
of a text's word shingles. Two fingerprints within ``radius`` bits link, and
documents linked directly or through others form a component.

Distinct fingerprints are dealt into shards: the 64 bits are cut into
``radius + 2`` blocks, and two fingerprints within the radius agree on at
least two of them, so a shard for every pair of blocks and their value holds
every link. A shard beyond ``TREE_ROWS`` is dealt into chunks, and the tree of
each chunk meets the fingerprints of every chunk of its shard: nothing is
dropped, and no task holds more than two chunks. In a cell, the chunk's
BK-tree has children keyed by Hamming distance to their parent, and a search
follows only the edges within the radius. Links are joined within the cell at
once, so that a cell returns a forest and not all pairs.

Trees travel to the fingerprints of their shard by key. A broadcast of the
trees would grow with the corpus and pass through the driver.

Defined cases: null and empty texts have fingerprint zero, linked like any
other; rows with a null id keep a null component unless linked to an id;
repeated rows are returned as often as they occur; an empty table gives an
empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import small_side, write_shared
from docloom.llm.components import components

#: Most fingerprints of one BK-tree.
TREE_ROWS = 2048
SEED = 42
#: Row keys up to which their list is broadcast (8 bytes each).
BROADCAST_ROWS = 1_000_000
#: Shingles hashed at once, to bound memory on very long texts.
SLICE = 200_000


def hashes(text: str | None, width: int) -> np.ndarray:
    """The unsigned 64-bit hashes of the lower-cased words' shingles, in order
    and with repeats."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    lo, hi, h = starts[:n].tolist(), ends[-n:].tolist(), xxhash.xxh64_intdigest
    parts = [np.array([h(joined[a:b], SEED) for a, b in zip(lo[at : at + SLICE], hi[at : at + SLICE])], dtype="<u8") for at in range(0, n, SLICE)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def majority(found: np.ndarray) -> int:
    """The bits set in over half of some hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(found), SLICE):
        counts += np.unpackbits(found[at : at + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of the lower-cased words' shingles."""
    return majority(hashes(text, width))


def fingerprints(text: Column, width: int = 3) -> Column:
    """``fingerprint`` of a column, as a signed long."""

    @F.pandas_udf("long")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))

    return made(text.cast("string"))


class BKTree:
    """A BK-tree over unsigned integers under Hamming distance."""

    def __init__(self, values: list[int]):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        for i in range(1, len(values)):
            at, v = 0, values[i]
            while True:
                d = (values[at] ^ v).bit_count()
                if d not in self.children[at]:
                    self.children[at][d] = i
                    break
                at = self.children[at][d]

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of all values at most ``radius`` bits away."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            edges = self.children[at]
            if len(edges) <= 2 * radius:
                stack += [i for k, i in edges.items() if -radius <= k - d <= radius]
            else:
                stack += [edges[k] for k in range(d - radius, d + radius + 1) if k in edges]
        return found


def _forest(trees: list[int], others: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges that join all links between ``trees`` and ``others`` (or within
    ``trees``, if ``others`` is empty)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    tree = BKTree(trees)
    for v in others or trees:
        for i in tree.within(v, radius):
            a, b = find(v), find(trees[i])
            if a != b:
                root[max(a, b)] = min(a, b)
    return [(x, r) for x in root if (r := find(x)) != x]


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Edges ``(a, b)`` that join all of ``prints(fp)`` within ``radius`` bits."""
    blocks = radius + 2
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    spans = [(edges[i], edges[i + 1] - edges[i]) for i in range(blocks)]

    def block(k: int) -> Column:
        at, wide = spans[k]
        return F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << wide) - 1))

    keys = [
        F.struct(F.lit(t).alias("t"), F.shiftleft(block(i), spans[j][1]).bitwiseOR(block(j)).alias("v"))
        for t, (i, j) in enumerate(combinations(range(blocks), 2))
    ]
    dealt = prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.v")
    sizes = dealt.groupBy("t", "v").agg(F.count("*").alias("n")).filter("n > 1")
    chunked = (
        dealt.join(sizes, ["t", "v"])
        .withColumn("chunks", F.ceil(F.col("n") / TREE_ROWS).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("fp", "t", "v", F.least("own", "other").alias("c"), F.greatest("own", "other").alias("d"), "own")
    )
    cell = ["t", "v", "c", "d"]

    def search(batches):
        held: list[tuple] = []
        at = None

        def close():
            trees = [x & (2**64 - 1) for x, own in held if own == at[2]]
            others = [x & (2**64 - 1) for x, own in held if own != at[2]]
            if at[2] != at[3] and not others:
                return []
            return _forest(trees, others, radius)

        for pdf in batches:
            out: list[tuple[int, int]] = []
            for fp, t, v, c, d, own in zip(*(pdf[k].tolist() for k in ("fp", *cell, "own"))):
                if (t, v, c, d) != at:
                    out += close() if held else []
                    held, at = [], (t, v, c, d)
                held.append((fp, own))
            yield _frame(out)
        if held:
            yield _frame(close())

    return chunked.repartition(*cell).sortWithinPartitions(*cell).mapInPandas(search, "a long, b long").distinct()


def _frame(pairs: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])


def grouped(docs: DataFrame, radius: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, row_key, fp, root)`` of every row; linked rows share ``root``."""
    text = F.col(text_col).cast("string")
    rows = write_shared(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(id_col), text).alias("row_key"), fingerprints(text, width).alias("fp")), "fingerprints"
    )
    prints = write_shared(rows.select("fp").distinct(), "prints")
    roots = components(links(prints, radius)).select(F.col("node").alias("fp"), "root")
    return rows.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def row_key(doc_id: Column, text: Column) -> Column:
    """A hash that only rows equal in id and text share."""
    return F.xxhash64(doc_id, text, F.lit(5))


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row; ``component_id`` is the least
    id reachable through links, the row's own included."""
    rows = write_shared(grouped(docs, radius, width, id_col, text_col), "grouped")
    # Written first, the join's two shuffles are its own and skewed ones are split.
    least = write_shared(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return rows.join(least, "root").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, radius: int = 3, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the least id of their component, one each."""
    return one_each(docs, write_shared(grouped(docs, radius, width, id_col, text_col), "grouped"), id_col, text_col)


def one_each(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` with the least id of their root in ``rows(doc_id, row_key, root)``."""
    least = write_shared(rows.groupBy("root").agg(F.min(F.struct("doc_id", "row_key")).alias("least")), "least")
    gone = write_shared(
        rows.join(least, "root").filter(~F.struct("doc_id", "row_key").eqNullSafe(F.col("least"))).select("row_key").distinct(), "gone"
    )
    again = write_shared(rows.groupBy("row_key").agg(F.count("*").alias("n")).filter("n > 1").select("row_key"), "again")
    keyed = docs.select(F.struct("*").alias("row"), row_key(F.col(id_col), F.col(text_col).cast("string")).alias("row_key"))
    kept = keyed.join(small_side(gone, gone.count(), BROADCAST_ROWS), "row_key", "left_anti")
    few = small_side(again, again.count(), BROADCAST_ROWS)
    single, repeated = kept.join(few, "row_key", "left_anti"), kept.join(few, "row_key", "left_semi")
    return single.unionByName(repeated.dropDuplicates(["row_key"])).select("row.*")
