"""Toxicity against brute-force cosine, and labels that give no model."""

import math
import pickle
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import toxicity

SCHEMA = "doc_id long, text string, score string, row string, neighbours string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "c", "c", "c") for r in rows], SCHEMA)


def labelled(spark, n=300):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 8))) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) + (" Horrid vilest" if i % 3 == 0 else "")) for i in range(n)]
    return rows, docs_of(spark, rows), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(n)], "doc_id long, toxic int")


def terms(text):
    out = Counter()
    for w in toxicity.LETTERS.findall((text or "").lower()):
        out[w + "$"] += 1
        if len(w) > toxicity.STEM:
            out[w[: toxicity.STEM]] += 1
    return out


def test_neighbours_against_brute_force(spark):
    rows, docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    inner = model["shared"].value
    inside = {int(d) for d in inner["ids"]}
    text, mark = dict(rows), {i: int(i % 3 == 0) for i, _ in rows}
    assert 60 < len(inside) < 180
    df = Counter(t for _, x in rows for t in terms(x))
    held = {v: [terms(text[d]) for d in inside if mark[d] == v] for v in (0, 1)}

    def factor(t):
        a, b, m, n = sum(t in c for c in held[1]), sum(t in c for c in held[0]), len(held[1]), len(held[0])
        rate = (a + b) / (m + n)
        g = 2 * sum(x * math.log(x / e) for x, e in ((a, m * rate), (b, n * rate), (m - a, m * (1 - rate)), (n - b, n * (1 - rate))) if x)
        return (1 + math.log((1 + len(rows)) / (1 + df[t]))) * max(0.0, g) / (max(0.0, g) + toxicity.HALF_GAIN)

    factors = {t: factor(t) for t in df}

    def vector(x):
        raw = {t: (1 + math.log(n)) * factors[t] for t, n in terms(x).items() if t in factors}
        norm = math.sqrt(sum(w * w for w in raw.values())) or 1
        return {t: w / norm for t, w in raw.items()}

    df = Counter(t for _, x in rows for t in set(terms(x)))
    factors = {t: factor(t) for t in df}
    examples = {d: vector(text[d]) for d in inside}
    got = {r["doc_id"]: r["neighbours"] for r in toxicity.classify(docs, labels, model=model).select("row.doc_id", F.col("neighbours")).collect()}
    for d, x in rows[:80]:
        q = vector(x)
        want = sorted((sum(w * v.get(t, 0) for t, w in q.items()) for v in examples.values()), reverse=True)[: toxicity.NEIGHBOURS]
        assert [n["cosine"] for n in got[d]] == pytest.approx([w for w in want if w > 0], abs=1e-9)
        for n in got[d]:
            assert n["label"] == mark[n["doc_id"]]
            assert n["cosine"] == pytest.approx(sum(w * examples[n["doc_id"]].get(t, 0) for t, w in q.items()), abs=1e-9)


def test_terms_and_bounds(monkeypatch):
    own = toxicity.Terms(np.array([], np.int64))
    assert len(own.counts("no vocabulary at all")[0]) == 0 and len(own.counts(None)[0]) == 0
    monkeypatch.setattr(toxicity, "KNOWN_CHUNKS", 5)
    free = toxicity.Terms()
    for text in ("one two three seven", "a b c d e f g h i j", "one ONE, two-longword longwords it's 12 one.ONE", ""):
        assert sorted(free.counts(text)[1].tolist()) == sorted(terms(text).values())


def test_labels_without_a_model(spark):
    rows, docs, labels = labelled(spark, 60)
    for some in (labels.limit(0), labels.filter("toxic = 1"), labels.filter("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        done = toxicity.classify(docs, some).select("score", "predicted").distinct().collect()
        assert [tuple(r) for r in done] == [(0.0, 0)]


def test_odd_labels(spark):
    rows, docs, labels = labelled(spark)
    odd = labels.unionByName(labels.limit(50)).unionByName(spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 7), (10**9, 0)], "doc_id long, toxic int"))
    twice = docs.unionByName(docs.limit(40)).unionByName(docs_of(spark, [(None, "Horrid"), (5, None), (7, "")]))
    done = toxicity.classify(twice, odd).select("row.doc_id", "score", "predicted").collect()
    assert len(done) == 343 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in done)


def test_kept_columns(spark):
    """The struct holds the named columns; the scores stay, and the index travels whole."""
    rows, docs, labels = labelled(spark, 60)
    model = toxicity.train(docs, labels)
    both = [toxicity.classify(docs, labels, model=model, columns=c) for c in (None, ["doc_id"])]
    assert both[1].select("row.*").columns == ["doc_id"]
    assert [sorted(map(tuple, d.select("row.doc_id", "score", "predicted").collect())) for d in both][0] == sorted(map(tuple, both[1].select("row.doc_id", "score", "predicted").collect()))
    index = model["shared"].value["index"]
    again = pickle.loads(pickle.dumps(index))
    assert all(np.array_equal(getattr(index, a), getattr(again, a)) for a in ("slots", "weights", "starts", "dense", "most"))
