"""Secrets by regular expressions behind a trigram inverted index.

From each rule's expression a Boolean query over trigrams is derived: which
trigrams any match must hold, as ands and ors. Postings of those trigrams are
built in blocks of documents and intersected by array functions; only the
documents that are left are searched for that rule. A rule without mandatory
trigrams searches every document. The search itself is exact, so the index can
only save work.

All of it is DataFrame functions. Trigrams are of lower-cased text. Positions
are code points: the lengths of the pieces between matches and of the matches
themselves add up to them.

Defined cases: null text is empty and yields no span; rows equal in id and
text share a posting; repeated rows are returned as often as they occur; spans
that start at one place come in the order of their kinds; the input columns
stay within ``row``, so their names can't clash; the time for a text's spans
grows with their number; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import small_side, write_shared

#: Documents of one posting block, and candidates up to which the list of
#: candidates is broadcast (16 bytes each) instead of joined by shuffle.
BLOCK_ROWS = 4096
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``group`` of a match needs ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds in their order.
BASE = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Public token formats that the method adds.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35,}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
#: Matches whose lengths are summed as one run, and runs as one.
RUN = 64
#: Strings that a run of an expression may stand for before it is cut.
MOST_STRINGS = 48

#: A query: None (any text), a trigram, or ("and" | "or", queries).
Query = None | str | tuple


def _both(kind: str, parts: list[Query]) -> Query:
    if kind == "or" and any(p is None for p in parts):
        return None
    kept = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not kept else kept[0] if len(kept) == 1 else (kind, tuple(kept))


def _of_strings(strings: set[str]) -> Query:
    """Some string of the set occurs; what asks for more than another falls away."""
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    least = [x for x in sets if not any(y < x for y in sets)]
    return _both("or", [_both("and", sorted(x)) for x in sorted(least, key=sorted)])


def _analyse(items) -> tuple[set[str] | None, Query]:
    """The strings an expression stands for, if few; and its query."""
    run: set[str] = {""}
    exact, queries = True, []
    for op, arg in items:
        strings, query = _element(op, arg)
        joined = {a + b for a, b in product(run, strings)} if strings is not None else None
        if joined is not None and len(joined) <= MOST_STRINGS:
            run = joined
            continue
        queries += [_of_strings(run), query]
        run, exact = {""} if strings is None or len(strings) > MOST_STRINGS else strings, False
    queries.append(_of_strings(run))
    return (run if exact else None), _both("and", queries)


def _element(op, arg) -> tuple[set[str] | None, Query]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, None
    if op is sre.AT:
        return {""}, None
    if op is sre.IN:
        chars = [chr(a).lower() for o, a in arg if o is sre.LITERAL]
        return (set(chars), None) if len(chars) == len(arg) <= 8 else (None, None)
    if op is sre.SUBPATTERN:
        return _analyse(arg[-1])
    if op is sre.BRANCH:
        found = [_analyse(x) for x in arg[1]]
        every = None if any(s is None for s, _ in found) else set().union(*(s for s, _ in found))
        return every, _both("or", [q for _, q in found])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, sub = arg
        strings, query = _analyse(sub)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, None
        return None, query if low else None
    return None, None


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every match of ``pattern`` satisfies."""
    return _analyse(parser.parse(pattern))[1]


def trigrams(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def candidates(keyed: DataFrame, rules: tuple[Rule, ...], rows: int) -> DataFrame:
    """``(key, mask)``: bit r is set where rule r's query holds.

    ``keyed`` has ``(key, low)``, low the lower-cased text.
    """
    queries = [(r, q) for r, rule in enumerate(rules) if (q := trigram_query(rule.pattern)) is not None]
    grams = sorted(set().union(*(trigrams(q) for _, q in queries)))
    number = {g: i for i, g in enumerate(grams)}
    held = F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for g, i in number.items()])
    blocks = max(1, -(-rows // BLOCK_ROWS))
    postings = (
        keyed.select("key", F.explode(F.array_compact(held)).alias("gram"))
        .withColumn("block", F.pmod(F.xxhash64("key", F.lit(3)), F.lit(blocks)))
        .groupBy("block", "gram")
        .agg(F.collect_set("key").alias("keys"))
    )
    index = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("posting"))

    def evaluate(query: Query) -> Column:
        if isinstance(query, str):
            return F.coalesce(F.try_element_at("posting", F.lit(number[query])), F.array().cast("array<long>"))
        join = F.array_intersect if query[0] == "and" else F.array_union
        return reduce(join, map(evaluate, query[1]))

    def marked(keys: Column, bit: int) -> Column:
        return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(bit).alias("bit")))

    hits = [marked(evaluate(q), 1 << r) for r, q in queries]
    return index.select(F.explode(F.concat(*hits)).alias("x")).groupBy("x.key").agg(F.bit_or("x.bit").alias("mask"))


def running_sums(steps: Column) -> Column:
    """Sums of an array's leading elements, each in few steps: sums of runs and
    of runs of runs are worked out once, and an element adds those before it."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda x, y: x + y)

    def runs(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / RUN).cast("int")), lambda i: total(F.slice(xs, i * RUN + 1, RUN)))

    def at(x: Column, i: Column) -> Column:
        far, near = F.floor(i / (RUN * RUN)).cast("int"), F.floor(i / RUN).cast("int")
        return (
            total(F.slice(x["far"], F.lit(1), far)) + total(F.slice(x["near"], far * RUN + 1, near - far * RUN)) + total(F.slice(x["steps"], near * RUN + 1, i - near * RUN + 1))
        )

    # One-element arrays: what they hold is worked out once, however often used.
    once = F.transform(F.array(steps), lambda xs: F.struct(xs.alias("steps"), runs(xs).alias("near")))
    packed = F.transform(once, lambda x: F.struct(x["steps"].alias("steps"), x["near"].alias("near"), runs(x["near"]).alias("far")))
    return F.flatten(F.transform(packed, lambda x: F.transform(x["steps"], lambda _, i: at(x, i))))


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost non-overlapping matches as ``(start, order, end, kind)``."""
    pattern = F.lit(rule.pattern)
    pieces = F.transform(F.split(text, rule.pattern, -1), F.length)
    lengths = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    kept = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    packed = F.array(F.struct(pieces.alias("p"), lengths.alias("m"), kept.alias("k")))
    # A match starts after all pieces up to it and all matches before it.
    steps = lambda x: F.transform(x["m"], lambda _, i: F.get(x["p"], i) + F.coalesce(F.get(x["m"], i - 1), F.lit(0)))
    found = F.flatten(F.transform(packed, lambda x: F.arrays_zip(running_sums(steps(x)).alias("start"), x["m"].alias("m"), x["k"].alias("k"))))
    return F.transform(
        F.filter(found, lambda s: s["k"] >= rule.least),
        lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), (s["start"] + s["m"]).alias("end"), F.lit(rule.kind).alias("kind")),
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(row struct, spans)`` of every row; spans in order of start, then rule."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.struct("*").alias("row"), text.alias("t"), F.xxhash64(F.col(id_col), text).alias("key"))
    found = write_shared(candidates(d.select("key", F.lower("t").alias("low")), rules, docs.count()), "candidates")
    hit = small_side(found, found.count(), BROADCAST_ROWS)
    joined = d.join(hit, "key", "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    empty = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    each = [
        spans(F.col("t"), rule, r)
        if trigram_query(rule.pattern) is None
        else F.when(F.col("mask").bitwiseAND(F.lit(1 << r)) != 0, spans(F.col("t"), rule, r)).otherwise(empty)
        for r, rule in enumerate(rules)
    ]
    return joined.select("row", F.array_sort(F.concat(*each)).alias("spans"))


def as_text(found: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def python_spans(text: str | None, rules: tuple[Rule, ...] = BASE) -> list[tuple[int, int, int, str]]:
    """The same spans by Python's expressions: the yardstick of the tests."""
    found = []
    for order, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or ""):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), order, m.end(), rule.kind))
    return sorted(found)
