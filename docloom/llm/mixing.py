"""Mix sources to target weights with hash-threshold histograms.

Every document gets a uniform hash. Per source, the sizes are summed by hash
bucket, the bucket in which the running sum passes the budget is found, and
only that bucket is divided again, until it holds one hash. A document is then
taken if its hash lies below the threshold; nothing is sorted.

A source whose target exceeds its size takes every document once and spends
the rest on second copies: the two thresholds are nested on the same hash.

Defined cases: null text has size 0; null sources are a source of their own,
last in order; rows equal in id and text share a hash and are taken together;
an empty table gives an empty result; columns of the input are never read
beyond the named ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import WORD, small_side, write_shared

#: Buckets into which a hash range is divided at each step; six steps resolve
#: any 63-bit range.
BUCKETS = 4096
#: Thresholds are broadcast up to so many sources and joined by shuffle beyond.
BROADCAST_SOURCES = 50_000


def text_size(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """A non-negative 63-bit hash of the row."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, text), 1)


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``(src, source_size, target)`` from ``(src, source_size)``.

    Sources in code point order, null last, weigh ``weights`` repeating and
    share ``share`` times all sizes. A target stops at ``most`` times its
    source's size and the excess is shared again by weight: with sources in
    order of saturation, a source is full exactly if the level reached when
    all earlier ones are full reaches its own limit.
    """
    everything = Window.partitionBy()
    in_order = Window.orderBy(F.col("src").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("turn") + 1)
    ranked = (
        sizes.withColumn("turn", ((F.row_number().over(in_order) - 1) % len(weights)).cast("int"))
        .withColumn("w", w)
        .withColumn("limit", F.col("source_size") * F.lit(float(most)))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("fills_at", F.col("limit") / F.col("w"))
    )
    order = Window.orderBy("fills_at", F.col("src").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(after)
    full = ranked.withColumn("level", level).withColumn("full", F.col("level") >= F.col("fills_at"))
    open_level = F.min(F.when(~F.col("full"), F.struct("fills_at", "level"))).over(everything)["level"]
    return full.select(
        "src",
        "source_size",
        F.when(F.col("full"), F.col("limit")).otherwise(open_level * F.col("w")).alias("target"),
    )


def thresholds(sized: DataFrame, budgets: DataFrame, sources: int) -> DataFrame:
    """``(src, copy, cut)``: rows of ``src`` with ``h < cut`` fit ``copy``'s budget.

    ``sized`` has ``(src, size, h)``, ``budgets`` ``(src, copy, budget)``.
    """
    spark = sized.sparkSession
    top = (1 << 63) - 1
    state = budgets.select(
        "src", "copy", F.lit(0).cast("long").alias("lo"), F.lit(top).cast("long").alias("hi"), F.col("budget").alias("left")
    )
    done = None
    while True:
        width = F.expr(f"(hi - lo) div {BUCKETS} + 1")
        s = small_side(state.withColumn("width", width), 2 * sources, BROADCAST_SOURCES)
        inside = sized.join(s, sized.src.eqNullSafe(s.src) & sized.h.between(s.lo, s.hi)).select(
            s.src, "copy", "left", "h", "size", F.expr("(h - lo) div width").alias("bucket")
        )
        sums = inside.groupBy("src", "copy", "left", "bucket").agg(
            F.sum("size").alias("size"), F.min("h").alias("h_min"), F.max("h").alias("h_max")
        )
        running = Window.partitionBy("src", "copy").orderBy("bucket")
        passed = (
            sums.withColumn("upto", F.sum("size").over(running))
            .filter(F.col("upto") > F.col("left"))
            .groupBy("src", "copy")
            .agg(F.min_by(F.struct("h_min", "h_max", "size", (F.col("left") - F.col("upto") + F.col("size")).alias("left")), "bucket").alias("b"))
            .select("src", "copy", "b.*")
        )
        found = write_shared(passed, "mixing")
        one = found.filter("h_min = h_max").select(
            "src", "copy", F.when(F.col("left") * 2 >= F.col("size"), F.col("h_min") + 1).otherwise(F.col("h_min")).alias("cut")
        )
        done = one if done is None else done.unionByName(one)
        state = found.filter("h_min < h_max").select("src", "copy", F.col("h_min").alias("lo"), F.col("h_max").alias("hi"), "left")
        if not state.head(1):
            return done if done is not None else spark.createDataFrame([], "src string, copy int, cut long")


def plan(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, int]:
    """``(src, source_size, target, cut1, cut2)`` per source, and their number."""
    if not 0 < share <= most <= 2:
        raise ValueError("0 < share <= most <= 2 is needed: a row is taken twice at most")
    sized = write_shared(
        docs.select(
            F.col(source_col).alias("src"),
            text_size(F.col(text_col)).alias("size"),
            row_hash(F.col(id_col), F.col(text_col)).alias("h"),
        ),
        "sizes",
    )
    per_source = write_shared(sized.groupBy("src").agg(F.sum("size").alias("source_size")), "sources")
    n = per_source.count()
    goal = write_shared(targets(per_source, weights, share, most), "targets")
    budgets = goal.select(
        "src",
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("copy"), F.least("target", F.col("source_size").cast("double")).alias("budget")),
                F.struct(F.lit(2).alias("copy"), F.greatest(F.col("target") - F.col("source_size"), F.lit(0.0)).alias("budget")),
            )
        ).alias("x"),
    ).select("src", "x.*")
    cuts = thresholds(sized, budgets, n).groupBy("src").agg(
        F.max(F.when(F.col("copy") == 1, F.col("cut"))).alias("cut1"),
        F.max(F.when(F.col("copy") == 2, F.col("cut"))).alias("cut2"),
    )
    g, c = goal.alias("g"), cuts.alias("c")
    both = g.join(c, F.col("g.src").eqNullSafe(F.col("c.src")), "left").select("g.*", "c.cut1", "c.cut2")
    return write_shared(both, "cuts"), n


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Every row as ``(row struct, size, source_size, target, copies)``.

    ``row`` holds the input columns untouched, so their names can't clash.
    A cut that was never reached (null) means that the budget covers all.
    """
    cuts, n = plan(docs, weights, share, most, id_col, text_col, source_col)
    d = docs.select(
        F.struct("*").alias("row"),
        F.col(source_col).alias("own_src"),
        text_size(F.col(text_col)).alias("size"),
        row_hash(F.col(id_col), F.col(text_col)).alias("h"),
    )
    c = small_side(cuts, n, BROADCAST_SOURCES)
    below = lambda cut: F.when(F.col(cut).isNull() | (F.col("h") < F.col(cut)), 1).otherwise(0)
    return d.join(c, F.col("own_src").eqNullSafe(F.col("src"))).select(
        "row", "size", "source_size", "target", (below("cut1") + below("cut2")).cast("int").alias("copies")
    )
