"""Whole numbers past doubles, repeated replies, cut results, handlers' context."""

import json

from pyspark.sql import functions as F

from docloom.functions import compat
from docloom.functions.filters import json_predicate
from docloom.operators import dml, quorum
from docloom.operators.triggers import Context
from docloom.sources import results


def test_numbers_past_doubles(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(f'{{"n":{big}}}', big)], "doc string, n bigint")
    f = lambda op, v: [{"key": "n", "operator": op, "value": v}]
    row = df.select(*[json_predicate(F.col("doc"), f(op, v)) for op, v in (("gt", big - 1), ("gt", big), ("lte", big - 1), ("gte", big), ("gt", 1.5), ("lt", 1e300))], compat.divide(F.col("n"), F.lit(1), True), compat.divide(F.col("n"), F.lit(0), True)).head()
    assert list(row) == [True, False, False, True, True, True, big, None]


def test_like_folds_ascii_only(spark):
    df = spark.createDataFrame([("\u00c4b",), ("\u00e4B",)], "x string")
    assert [r[0] for r in df.select(compat.like(F.col("x"), "\u00e4b")).collect()] == [False, True]


def test_repeated_reply_is_no_majority(spark):
    one = [("a", 5, "x", 0)]
    make = lambda rows: spark.createDataFrame(rows, "id string, timestamp bigint, value string, replica int")
    assert quorum.merged_rows(make(one * 2), 2).count() == 0
    assert quorum.merged_rows(make([*one * 2, ("a", 5, "x", 1)]), 2).count() == 1


def test_cut_results_say_so(spark):
    df = spark.range(3)
    assert json.loads(results.envelope(df, 2))["truncated"] and "truncated" not in json.loads(results.envelope(df, 3))
    ids = spark.range(1001).select(F.col("id").cast("string").alias("id"))
    found = dml.summary(ids, "DELETE")
    assert found["truncated"] and len(found["applied"]) == 1000 and found["count"] == 1001


def test_context(spark):
    held = {("p", "k", str(i)): json.dumps({"n": i, "t": {"s": "x" if i % 2 else True}}) for i in range(4)}
    ctx = Context(held, 7, [{"name": "n1", "online": True}])
    f = lambda key, op, v: {"key": key, "operator": op, "value": v}
    ids = lambda *fs: [d["id"] for d in ctx.query("p", "k", list(fs))]
    assert ids(f("n", "gt", 1)) == ["2", "3"] and ids(f("t.s", "eq", "x")) == ["1", "3"] and ids(f("t.s", "eq", 1)) == [] and ids(f("none", "ne", 1)) == [] and ids(f("n", "eq", 2.0)) == ["2"]
    assert ctx.cluster() == [{"name": "n1", "online": True}] and ctx.date_time() == 7
    assert ctx.date_time({"year": 2024, "month": 1, "day": 15, "hour": 0}) == 1705276800


def test_json_members(spark):
    df = spark.createDataFrame([('{"a":1}',)], "d string")
    row = df.select(*[g(F.col("d"), k, F.lit(2)) for g in (compat.json_insert, compat.json_replace) for k in ("a", "b")]).head()
    assert list(map(json.loads, row)) == [{"a": 1}, {"a": 1, "b": 2}, {"a": 2}, {"a": 1}]
