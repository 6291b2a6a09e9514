import json

import pytest
from pyspark.sql import functions as F

from docloom.functions.filters import FilterError, json_predicate, native_predicate, validate

DOCS = {
    "a": '{"name":"Alice","age":41,"active":true,"manager":{"age":50},"deleted":null,"tags":["red","blue"],"meta":{"rank":1}}',
    "b": '{"name":"Bob","age":42,"active":false,"manager":{"age":42},"deleted":null,"tags":["green"],"meta":{"rank":2}}',
    "c": '{"name":"Carol","age":60,"active":true,"manager":{"age":30},"deleted":"yes","tags":["red","blue"],"meta":{"rank":1}}',
}


def f(key, op, value):
    return {"key": key, "operator": op, "value": value}


CASES = [
    ([f("age", "eq", 42)], 1), ([f("manager.age", "eq", 42)], 1), ([f("age", "gt", 42)], 1), ([f("age", "gte", 42)], 2),
    ([f("age", "lt", 42)], 1), ([f("age", "lte", 42)], 2), ([f("name", "eq", "Alice")], 1), ([f("name", "ne", "Bob")], 2),
    ([f("active", "eq", True)], 2), ([f("deleted", "eq", None)], 2), ([f("tags", "eq", ["red", "blue"])], 2), ([f("meta", "eq", {"rank": 1})], 2),
    ([f("missing", "eq", 1)], 0), ([f("missing", "ne", 1)], 0), ([f("age') OR 1=1 --", "eq", 41)], 0), ([], 3), ([f("age", "eq", "42")], 0),
    ([f("active", "eq", True), f("manager.age", "gt", 40)], 1), ([f("age", "eq", 42.0)], 1), ([f("active", "eq", 1)], 0), ([f("active", "gt", 0)], 0), ([f("deleted", "ne", "yes")], 2),
]


def test_json_filters(spark):
    df = spark.createDataFrame(list(DOCS.items()), "id string, value string")
    counts = df.agg(*[F.count(F.when(json_predicate(F.col("value"), filters), 1)).alias(f"c{i}") for i, (filters, _) in enumerate(CASES)]).head()
    assert [counts[f"c{i}"] for i in range(len(CASES))] == [n for _, n in CASES]


def test_native_filters(spark):
    df = spark.read.json(spark.sparkContext.parallelize(DOCS.values()))
    skip = {"age') OR 1=1 --"}
    for filters, n in CASES:
        if not any(x["key"] in skip for x in filters):
            assert df.filter(native_predicate(df, filters)).count() == n, filters


def test_malformed_documents_never_match(spark):
    df = spark.createDataFrame([("x", "{bad"), ("y", None), ("z", "3")], "id string, value string")
    assert df.filter(json_predicate(F.col("value"), [f("age", "ne", 1)])).count() == 0


@pytest.mark.parametrize("bad", [f("a", "like", 1), f("a", "gt", "x"), {"operator": "eq", "value": 1}, f("manager..age", "eq", 1), 42, f("", "eq", 1), f("a", "gt", True), f("x" * 600, "eq", 1), "{"])
def test_invalid_filters(bad):
    with pytest.raises(FilterError):
        validate(bad)


def test_envelopes():
    one = f("a", "eq", 1)
    assert validate(one) == validate([one]) == validate({"filters": [one]}) == validate(json.dumps([one])) == [one]
    assert validate(None) == []


def test_pushdown(spark, small):
    df = spark.read.parquet(f"{small}/part.parquet")
    plan = df.filter(native_predicate(df, [f("p_size", "gt", 10)]))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(p_size,10)" in plan
