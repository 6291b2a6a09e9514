"""Near-duplicates by SimHash over sharded BK-trees and exact Jaccard similarity.

A text is the set of 64-bit hashes of its lower-cased words' shingles (of all
its words, where these are fewer). Two texts link if their sets have at least
``SIMILARITY`` per cent of their union in common, and documents linked directly
or through others form a component.

Texts whose SimHash fingerprints, over the same shingles, the BK-trees of
``simhash`` group within ``RADIUS`` bits are confirmed and joined first.
Fingerprints alone can't reach every link, as texts that share four fifths of
their shingles differ in seven bits and more. So texts that are still apart
are looked for by their shingles.

No link is lost: with the shingles of every text in one order, two texts that
link share one within the first ``n - ceil(n * SIMILARITY / 100) + 1`` of each
(prefix filter). The order puts shingles that a sample of documents finds
common last, so that they make few candidates; any order is exact. Candidates
must also allow for the overlap by their sizes, by the place of the shared
shingle and by their tallies: how many shingles fall in each of ``TALLY`` parts
of the hashes' range differs by no more than the sets do. What is left is
confirmed on the whole sets, so that few of these are ever moved.

Large groups of near copies aren't compared pair by pair: of the texts under
one fingerprint group, and then of those under one shingle, neighbours by size
are confirmed first, and at last only pairs whose texts aren't joined yet.

Defined cases: null texts and texts without words all have the empty set and
link to each other; rows equal in id and text count as one row; an empty table
gives an empty result. n different shingles have a chance of about
n * n / 2**65 that some two are taken for one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import simhash
from docloom.llm.common import small_side, write_shared
from docloom.llm.components import components
from docloom.llm.simhash import SEED, one_each, row_key

#: Words of a shingle, and per cent of the union that linked texts share.
WIDTH, SIMILARITY = 5, 80
#: Bits by which fingerprints of one group differ, from one to the next, and
#: about how many sets of a group are put in order together.
RADIUS, GROUP_ROWS = 3, 512
#: About how many documents are sampled for common shingles, in how many of
#: them a common one is at least, and how many of these are kept.
SAMPLE_ROWS, COMMON, COMMON_ROWS = 10_000, 3, 100_000
#: Parts of the range of hashes whose shingles are counted.
TALLY = 128
#: Keys up to which their list is broadcast (8 bytes each).
BROADCAST_ROWS = 200_000


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The different hashes of a text's word shingles, as sorted signed longs."""
    return as_set(simhash.hashes(text, width))


def as_set(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes.view(np.int64))


def prefix_length(n: int, similarity: int) -> int:
    """Shingles of a set of ``n`` of which any set that links has one."""
    return n + (-n * similarity) // 100 + 1 if n else 0


def tally(own: np.ndarray) -> bytes:
    """Shingles in each part of the range, as bytes; what is over 255 counts as
    255, which never makes two sets differ by more."""
    return np.minimum(np.bincount(own & (TALLY - 1), minlength=TALLY), 255).astype(np.uint8).tobytes()


def tally_gap(a: str, b: str) -> Column:
    """By how many shingles the sets of two columns of tallies differ at least."""

    @F.pandas_udf("long")
    def gap(x: pd.Series, y: pd.Series) -> pd.Series:
        u, v = (np.frombuffer(b"".join(c), np.uint8).reshape(-1, TALLY).astype(np.int64) for c in (x, y))
        return pd.Series(np.abs(u - v).sum(axis=1))

    return gap(a, b)


def shingle_sets(text: Column, width: int) -> Column:
    """``shingle_set`` of a column, as an array."""

    @F.pandas_udf("array<long>")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, width) for t in texts], dtype=object)

    return made(text)


def common_shingles(docs: DataFrame, width: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles in ``COMMON`` or more of the sampled documents, and their counts."""
    every = max(1, docs.count() // SAMPLE_ROWS)
    text = F.col(text_col).cast("string")
    some = docs.filter(F.pmod(F.xxhash64(text), F.lit(every)) == 0)
    counts = some.select(F.explode(shingle_sets(text, width)).alias("s")).groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    found = counts.orderBy(F.desc("n"), "s").limit(COMMON_ROWS).toPandas().sort_values("s")
    return found["s"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def prefixes(text: Column, width: int, similarity: int, common: tuple[np.ndarray, np.ndarray]) -> Column:
    """Key, size and tally of a text's set, its fingerprint, and the set's prefix, rare shingles first."""
    import xxhash

    keys, counts = common

    def row(text: str | None) -> tuple[int, int, bytes, int, np.ndarray]:
        hashes = simhash.hashes(text, width)
        own, fp = as_set(hashes), np.uint64(simhash.majority(hashes)).astype(np.int64)
        rank = np.zeros(len(own), np.int64)
        if len(keys) and len(own):
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            rank = np.where(keys[at] == own, counts[at], 0)
        first = own[np.lexsort((own, rank))][: prefix_length(len(own), similarity)]
        return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).astype(np.int64)), len(own), tally(own), int(fp), first

    @F.pandas_udf("key long, n int, tally binary, fp long, prefix array<long>")
    def made(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([row(t) for t in texts], columns=["key", "n", "tally", "fp", "prefix"])

    return made(text)


def by_fingerprint(sets: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs ``(a, b)`` of the keys of ``sets(key, n, fp)``: neighbours by size
    of those that the BK-trees group. Large groups are dealt into parts."""
    roots = components(simhash.links(sets.select("fp").distinct(), radius)).select(F.col("node").alias("fp"), "root")
    placed = write_shared(sets.select("key", "n", "fp").join(roots, "fp", "left").select("key", "n", F.coalesce("root", "fp").alias("root")), "placed")
    sizes = placed.groupBy("root").agg(F.count("*").alias("of")).filter("of > 1")
    part = F.pmod(F.xxhash64("key"), F.ceil(F.col("of") / GROUP_ROWS).cast("long"))
    beside = F.lag(F.struct("key", "n")).over(Window.partitionBy("root", "part").orderBy("n", "key"))
    pairs = placed.join(sizes, "root").withColumn("part", part).withColumn("to", beside).filter("to IS NOT NULL")
    return pairs.select(F.least("key", "to.key").alias("a"), F.greatest("key", "to.key").alias("b"))


def links(docs: DataFrame, rows: DataFrame, similarity: int = SIMILARITY, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Edges ``(a, b)`` of set keys that join all sets of ``rows(row_key, key, n, tally, fp, prefix)`` that link."""
    one = Window.partitionBy("s")
    own = write_shared(rows.select("key", "n", "tally", "fp").dropDuplicates(["key"]), "tallies")
    tallies = own.select("key", "n", "tally")
    placed = rows.select("key", "n", F.posexplode("prefix").alias("at", "s"))
    shared = write_shared(
        placed.withColumn("lo", F.min("key").over(one)).withColumn("hi", F.max("key").over(one)).filter("lo <> hi")
        .dropDuplicates(["s", "key"]).select("s", "key", "n", "at"), "shared")

    def fit(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes, and shared shingle if it is their first, allow the overlap."""
        left = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("to"))
        return pairs.filter(left * (100 + similarity) >= (F.col("n") + F.col("m")) * similarity).select(
            F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")
        ).distinct()

    def close(pairs: DataFrame) -> DataFrame:
        """Pairs whose tallies allow the overlap."""
        both = pairs.join(tallies.withColumnsRenamed({"key": "a", "tally": "x"}), "a").join(tallies.withColumnsRenamed({"key": "b", "n": "m", "tally": "y"}), "b")
        return both.filter(tally_gap("x", "y") * (100 + similarity) <= (F.col("n") + F.col("m")) * (100 - similarity)).select("a", "b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = write_shared(close(pairs), "close")
        wanted = write_shared(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "wanted")
        chosen = write_shared(
            rows.select("key", "row_key").join(small_side(wanted, wanted.count(), BROADCAST_ROWS), "key").groupBy("key").agg(F.min("row_key").alias("row_key")), "chosen"
        )
        text = F.col(text_col).cast("string")
        texts = docs.select(row_key(F.col(id_col), text).alias("row_key"), text.alias("text"))
        sets = write_shared(
            texts.join(small_side(chosen, chosen.count(), BROADCAST_ROWS), "row_key").dropDuplicates(["key"]).select("key", shingle_sets(F.col("text"), width).alias("set")), "sets"
        )
        both = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("set").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y")).cast("long")
        return both.filter(common * (100 + similarity) >= (F.size("x") + F.size("y")) * similarity).select("a", "b")

    def rooted(joined: DataFrame) -> DataFrame:
        roots = components(joined).select(F.col("node").alias("key"), "root")
        return write_shared(shared.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "rooted")

    joined = write_shared(confirmed(by_fingerprint(own)), "joined")
    by_size = one.orderBy("n", "key")
    cols = ("key", "other"), ("n", "m"), ("at", "to"), ("root", "top")
    beside = rooted(joined).select("s", *[c for c, _ in cols], *[F.lag(c).over(by_size).alias(to) for c, to in cols])
    near = write_shared(fit(beside.filter("root <> top")), "beside")
    joined = write_shared(joined.unionByName(confirmed(near)), "joined")
    left = rooted(joined)
    others = left.select("s", *[F.col(c).alias(to) for c, to in cols])
    apart = write_shared(fit(left.join(others, "s").filter("root < top")).join(near, ["a", "b"], "left_anti"), "apart")
    return joined.unionByName(confirmed(apart))


def grouped(docs: DataFrame, similarity: int = SIMILARITY, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, row_key, root)`` of every row; linked rows share ``root``."""
    text = F.col(text_col).cast("string")
    made = prefixes(text, width, similarity, common_shingles(docs, width, text_col))
    rows = write_shared(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(id_col), text).alias("row_key"), made.alias("p")).select("doc_id", "row_key", "p.*"), "prefixes"
    )
    roots = components(links(docs, rows, similarity, width, id_col, text_col)).select(F.col("node").alias("key"), "root")
    return rows.select("doc_id", "row_key", "key").join(roots, "key", "left").select("doc_id", "row_key", F.coalesce("root", "key").alias("root"))


def representatives(docs: DataFrame, similarity: int = SIMILARITY, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the least id of their component, one each."""
    return one_each(docs, write_shared(grouped(docs, similarity, width, id_col, text_col), "grouped"), id_col, text_col)
