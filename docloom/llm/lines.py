"""Line dedup by a segment-partition edit join.

Two lines of at least ``LEAST`` characters link if at most ``EDITS`` insertions,
deletions and substitutions apart; a shorter line, where these would be a large
part of it, has only its equals in its class. A line that can link is cut into
``EDITS + 1`` segments by its length; of two lines that link, the shorter has
a segment that occurs in the longer one, near its place. An index holds every
line's segments by length, ordinal and hash. Lines probe it with just the
substrings at the shifts that the ordinals and the lengths allow. Where a
segment is in very many lines, these meet only under a group of letters that
occur equally often in both, as some group does in lines this close. Candidates are verified by Hyyro's banded bit-parallel edit distance: one bit per
diagonal of the band, so a line of any length needs one word.

All of it is DataFrame functions. The edit distance is a fold over positions.

Of every class of linked lines the first in order of document and line stays
and the later ones go. A line is known by a 64-bit hash of its text: n
different lines have a chance of about n * n / 2**65 that some two are mixed
up.

Defined cases: null and empty texts have no line that takes part; nor have
blank lines below ``LEAST`` characters; ``deduplicated`` leaves all lines below
``LEAST`` characters where they are; rows equal in id and text count as one row
and lose the same lines; rows with a null id come before all others; of equal
lines in one document the first stays; the input columns pass through and are
never read beyond the named ones, so their names can't clash; an empty table
gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import WORD, small_side, write_shared
from docloom.llm.components import components

#: Edits between linked lines, and characters of a line that may have any.
EDITS, LEAST = 2, 24
#: Lines of one segment beyond which it alone makes no candidates.
HOT = 8
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Line hashes up to which their list is broadcast (8 bytes each).
BROADCAST_ROWS = 200_000


def exploded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """``(doc, row_key, line_no, line, h)`` of the lines of ``least`` characters that take part."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(id_col), text).alias("row_key"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    size = F.length("line")
    return d.filter((size >= least) & ((size >= LEAST) | F.col("line").rlike(WORD))).withColumn("h", F.xxhash64("line"))


def _segments(length: Column) -> list[tuple[Column, Column]]:
    """Start (from 1) and length of each segment of a line of ``length``."""
    parts = EDITS + 1
    base, longer = F.floor(length / parts).cast("int"), length % parts
    sizes = [base + F.when(F.lit(i) >= parts - longer, 1).otherwise(0) for i in range(parts)]
    starts = [F.lit(1)]
    for s in sizes[:-1]:
        starts.append(starts[-1] + s)
    return list(zip(starts, sizes))


def _keys(line: Column, length: Column) -> tuple[Column, Column]:
    """Keys of the index entries, and of the further probes, of a line.

    An entry's key also probes for lines of equal length at equal place.
    """
    own, probes = [], []
    for gap in range(EDITS + 1):
        for i, (start, size) in enumerate(_segments(length - gap)):
            low = max(-i, gap - (EDITS - i))
            high = min(i, gap + (EDITS - i))
            for shift in range(low, high + 1):
                key = F.xxhash64(length - gap, F.lit(i), F.substring(line, start + shift, size))
                (own if gap == shift == 0 else probes).append(key)
    return F.array(*own), F.array(*probes)


def within(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether two lines are at most ``edits`` apart.

    Bit i of a word stands for row j - edits + i of column j. The distance is
    followed along the diagonal that ends in the last cell.
    """
    longer = F.when(F.length(a) >= F.length(b), a).otherwise(b)
    shorter = F.when(F.length(a) >= F.length(b), b).otherwise(a)
    width = 2 * edits + 1
    full = (1 << width) - 1

    def run(pair: Column) -> Column:
        rows, gap = pair["rows"], pair["gap"]

        def column(state: Column, char: Column) -> Column:
            j = state["j"]
            same = [F.when(F.get(rows, j - edits + i - 1) == char, 1 << i).otherwise(0) for i in range(width)]
            # Arrays of one element keep each word from being worked out twice.
            x = F.array(F.struct(reduce(lambda p, q: p.bitwiseOR(q), same).alias("x"), state["vp"].alias("vp"), state["vn"].alias("vn")))
            down = F.transform(
                x,
                lambda w: F.struct(
                    ((w["x"].bitwiseAND(w["vp"]) + w["vp"]).bitwiseXOR(w["vp"])).bitwiseOR(w["x"]).bitwiseOR(w["vn"]).bitwiseAND(F.lit(full)).alias("d"), w["vp"].alias("vp"), w["vn"].alias("vn")
                ),
            )
            across = F.transform(
                down,
                lambda w: F.struct(
                    w["d"].alias("d"),
                    w["vn"].bitwiseOR(F.bitwise_not(w["d"].bitwiseOR(w["vp"]))).bitwiseAND(F.lit(full)).alias("hp"),
                    w["d"].bitwiseAND(w["vp"]).alias("hn"),
                ),
            )
            return F.transform(
                across,
                lambda w: F.struct(
                    (j + 1).alias("j"),
                    w["hn"].bitwiseOR(F.bitwise_not(F.shiftright(w["d"], 1).bitwiseOR(w["hp"]))).bitwiseAND(F.lit(full)).alias("vp"),
                    F.shiftright(w["d"], 1).bitwiseAND(w["hp"]).alias("vn"),
                    (state["score"] + 1 - F.call_function("shiftright", w["d"], gap + edits).bitwiseAND(F.lit(1))).alias("score"),
                ),
            )[0]

        start = F.struct(F.lit(1).alias("j"), F.lit(full & ~((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), gap.alias("score"))
        step = lambda s, c: F.when(s["score"] > edits, s).otherwise(column(s, c))
        return F.aggregate(pair["chars"], start, step, lambda s: s["score"] <= edits)

    pair = F.array(F.struct(F.split(longer, "", -1).alias("rows"), F.split(shorter, "", -1).alias("chars"), (F.length(longer) - F.length(shorter)).alias("gap")))
    return F.coalesce(F.get(F.transform(pair, run), F.lit(0)), F.lit(False))


def letter_counts(line: Column) -> Column:
    """How often each letter or digit occurs, and how many other characters there are.

    An edit changes two of these by one at most, so the counts of lines within
    ``EDITS`` differ by ``2 * EDITS`` in sum.
    """
    low = F.translate(line, LETTERS.upper(), LETTERS)
    each = [F.length(low) - F.length(F.replace(low, F.lit(c), F.lit(""))) for c in LETTERS]
    return F.array(*each, F.length(low) - reduce(lambda x, y: x + y, each))


def candidates(lines: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of line hashes that share a segment, a < b.

    A segment in over ``HOT`` lines alone says little. The letters' counts of
    two lines that link differ by ``2 * EDITS`` in sum, so of one more group of
    letters than that some group's counts are equal: there the key is the
    segment with a group's counts, and the counts must be as close as said.
    """
    n = F.length("line")
    own, probes = _keys(F.col("line"), n)
    once = write_shared(lines.select("h", own.alias("own"), probes.alias("probes")).dropDuplicates(["h"]), "segments")
    index = once.select("h", F.explode("own").alias("key"))
    asked = once.select("h", F.explode(F.concat("own", "probes")).alias("key"))
    hot = write_shared(index.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("key"), "hot")
    few = small_side(hot, hot.count(), BROADCAST_ROWS)
    pairs = _meet(index.join(few, "key", "left_anti"), asked.join(few, "key", "left_anti"))
    held, wanted = index.join(few, "key", "left_semi"), asked.join(few, "key", "left_semi")
    seen = write_shared(wanted.select("h").distinct(), "hot_lines")
    counted = write_shared(
        lines.select("h", "line").join(small_side(seen, seen.count(), BROADCAST_ROWS), "h").dropDuplicates(["h"]).select("h", letter_counts(F.col("line")).alias("n")), "counted"
    )
    far = F.aggregate(F.zip_with("n", "m", lambda x, y: F.abs(x - y)), F.lit(0), lambda x, y: x + y)
    groups = 2 * EDITS + 1
    letters = [F.get("n", i) for i in range(len(LETTERS) + 1)]
    finer = F.explode(F.array(*[F.xxhash64("key", F.lit(i), *letters[i::groups]) for i in range(groups)])).alias("key")
    left, right = (t.join(counted, "h").select("h", "n", finer) for t in (held, wanted))
    right = right.withColumnsRenamed({"h": "g", "n": "m"})
    near = left.join(right, "key").filter((F.col("h") != F.col("g")) & (far <= 2 * EDITS))
    return pairs.unionByName(near.select(F.least("h", "g").alias("a"), F.greatest("h", "g").alias("b"))).distinct()


def _meet(index: DataFrame, asked: DataFrame) -> DataFrame:
    met = index.join(asked.withColumnRenamed("h", "g"), "key").filter("h <> g")
    return met.select(F.least("h", "g").alias("a"), F.greatest("h", "g").alias("b"))


def links(lines: DataFrame) -> DataFrame:
    """Verified pairs ``(a, b)`` of line hashes, of lines of ``LEAST`` characters."""
    lines = lines.filter(F.length("line") >= LEAST)
    pairs = write_shared(candidates(lines), "candidates")
    wanted = write_shared(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "wanted")
    texts = write_shared(
        lines.select("h", "line").join(small_side(wanted, wanted.count(), BROADCAST_ROWS), "h").dropDuplicates(["h"]), "texts"
    )
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("y")), "b")
    return both.filter(within(F.col("x"), F.col("y"))).select("a", "b")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """``(doc, row_key, line_no, class_id, first)`` of every line of ``least`` characters that takes part.

    ``class_id`` is the same for linked lines; ``first`` marks the one that stays.
    """
    lines = exploded(docs, id_col, text_col, least)
    roots = components(links(lines))
    placed = write_shared(
        lines.select("doc", "row_key", "line_no", "h").distinct()
        .join(roots.withColumnRenamed("node", "h"), "h", "left")
        .select("doc", "row_key", "line_no", F.coalesce("root", "h").alias("class_id")), "placed")
    # Written first, the join's two shuffles are its own and skewed ones are split.
    first = write_shared(placed.groupBy("class_id").agg(F.min(F.struct("doc", "row_key", "line_no")).alias("f")), "first")
    return placed.join(first, "class_id").select(
        "doc", "row_key", "line_no", "class_id", F.struct("doc", "row_key", "line_no").eqNullSafe(F.col("f")).alias("first")
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the later lines of every class taken out of the text, but for short ones."""
    gone = write_shared(
        classes(docs, id_col, text_col, LEAST).filter("not first").groupBy("row_key").agg(F.collect_set("line_no").alias("gone")), "gone"
    )
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col(id_col), text).alias("row_key")).join(
        gone.hint("merge"), "row_key", "left"  # as many rows as documents with a repeated line: never a broadcast
    )
    source = F.col("row")[text_col]
    # One-element array: the lines are split once. Set difference takes time in proportion to them.
    whole = F.array(F.split(source, "\n", -1))
    left = lambda ls: F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("gone")))
    kept = F.array_join(F.flatten(F.transform(whole, lambda ls: F.transform(left(ls), lambda i: F.get(ls, i)))), "\n")
    return keyed.select(F.col("row").withField(text_col, F.when(F.col("gone").isNull(), source).otherwise(kept)).alias("row")).select("row.*")
