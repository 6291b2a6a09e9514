"""Quality scores against the same sizes worked out by hand, and odd labels."""

import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from docloom.llm import quality

SCHEMA = "doc_id long, text string, score string, row string, half string, label string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "c", "c", "c", "c") for r in rows], SCHEMA)


def marked(spark, n=200):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(100)]
    rows = [(i, " ".join(rng.choice(words) + ("%%%" if i % 2 else "") for _ in range(80))) for i in range(n)]
    return rows, docs_of(spark, rows), spark.createDataFrame([(i, 1 - i % 2) for i in range(n)], "doc_id long, quality int")


def test_scores_against_sizes(spark):
    rows, docs, labels = marked(spark)
    rows += [(1000, None), (1001, ""), (1002, rows[0][1]), (1002, rows[0][1]), (1003, "x" * 5000)]
    docs = docs_of(spark, rows)
    model = quality.train(docs, labels)
    a, b, c = model["curve"]

    def size(text, made):
        z = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(made), write_content_size=False, write_checksum=False, write_dict_id=False)
        data = (text or "").encode()
        return sum(len(z.compress(data[i : i + 256])) for i in range(0, max(1, len(data)), 256))

    got = quality.classify(docs, labels, "quality", 0.3, model).select("row.doc_id", "row.text", "score", "predicted").collect()
    assert len(got) == len(rows)
    for r in got:
        g, w = size(r["text"], model["good"]), size(r["text"], model["bad"])
        want = 1 / (1 + np.exp(-(a * (w - g) / (w + g) + b * (w - g) / (len((r["text"] or "").encode()) + 20) + c)))
        assert r["score"] == pytest.approx(want, abs=1e-12) and r["predicted"] == int(r["score"] >= 0.3)
    again = quality.train(docs, labels)
    assert again == model


def test_odd_labels(spark):
    rows, docs, labels = marked(spark)
    odd = labels.unionByName(labels.limit(50)).unionByName(spark.createDataFrame([(None, 1), (1, None), (2, 0), (3, 7)], "doc_id long, quality int"))
    twice = docs.unionByName(docs.limit(40)).unionByName(docs_of(spark, [(None, "a"), (5, None), (7, "")]))
    assert quality.classify(twice, odd).filter("score BETWEEN 0 AND 1").count() == 243
    for some in (labels.limit(0), labels.filter("quality = 1"), labels.withColumn("quality", F.lit(None).cast("int"))):
        assert [r["score"] for r in quality.classify(docs, some).select("score").distinct().collect()] == [0.5]
