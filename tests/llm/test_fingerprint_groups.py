"""The near_dedup stage's first step: SimHash fingerprints in BK-trees."""

import random

from pyspark.sql import functions as F

from docloom.llm import shingles, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    rng = random.Random(17)
    base = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    near = [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in (3, 200, 890)]
    return [" ".join(base), *near, *(" ".join(f"v{rng.randrange(10**6)}" for _ in range(300)) for _ in range(20))]


def test_stage_joins_by_bk_trees_first(spark, monkeypatch):
    import corpus_pipeline

    seen, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda prints, radius=3: seen.append((prints.count(), radius)) or links(prints, radius))
    # Only the BK-trees are left to find links.
    monkeypatch.setattr(shingles, "prefix_length", lambda n, similarity: 0)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts())], SCHEMA)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").select("doc_id").collect()}
    assert seen == [(len({simhash.fingerprint(t, 5) for t in texts()}), shingles.RADIUS)]
    assert kept == {0, *range(4, 24)}


def test_large_groups_are_dealt_and_fingerprint_links_confirmed(spark, monkeypatch):
    monkeypatch.setattr(shingles, "GROUP_ROWS", 2)
    sets = spark.createDataFrame([(k, 10 + k, 7) for k in range(40)] + [(99, 5, -1)], "key long, n int, fp long")
    pairs = [(r["a"], r["b"]) for r in shingles.by_fingerprint(sets).collect()]
    assert 10 <= len(pairs) < 39 and all(a < b < 40 for a, b in pairs)
    # Equal fingerprints of texts that share nothing link no more than their sets do.
    docs = spark.createDataFrame([(1, "a b c d e f", None, None, None), (2, "g h i j k l", None, None, None)], SCHEMA)
    made = shingles.prefixes(F.col("text"), 5, 80, shingles.common_shingles(docs, 5, "text")).alias("p")
    rows = docs.select(simhash.row_key(F.col("doc_id"), F.col("text")).alias("row_key"), made).select("row_key", "p.*").withColumn("fp", F.lit(7).cast("long"))
    assert shingles.by_fingerprint(rows.select("key", "n", "fp")).count() == 1 and shingles.links(docs, rows).count() == 0
