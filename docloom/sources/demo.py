"""A few documents to try things on."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from docloom.operators.changes import SCHEMA

#: Keyspace -> documents by id.
DOCUMENTS = {
    ("people", "staff"): {"s1": {"name": "Ada", "age": 36, "office": "o1", "skills": ["sql", "spark"]}, "s2": {"name": "Ben", "age": 29, "office": "o2", "lead": {"id": "s1"}}, "s3": {"name": "Cleo", "age": 41, "office": "o1", "email": None}},
    ("people", "guests"): {"g1": {"name": "Dan", "since": "2024-03-01"}, "g2": {"name": "Eve", "since": "2024-05-09"}},
    ("places", "offices"): {"o1": {"city": "Oslo", "floor": 3, "open": True}, "o2": {"city": "Porto", "floor": 1, "open": False}},
    ("stock", "products"): {"p1": {"title": "Loom", "price": 120.5, "supplier": "u1"}, "p2": {"title": "Thread", "price": 3, "supplier": "u1"}},
    ("stock", "suppliers"): {"u1": {"name": "Weft & Co"}},
}


def changes(spark: SparkSession, now: int = 0, db: str = "demo") -> DataFrame:
    """The documents as puts of a change log."""
    rows = [
        ("put", db, partition, space, key, json.dumps(doc, separators=(",", ":")), None, now, "demo", f"{partition}.{space}.{key}")
        for (partition, space), docs in DOCUMENTS.items()
        for key, doc in docs.items()
    ]
    return spark.createDataFrame(rows, SCHEMA)
