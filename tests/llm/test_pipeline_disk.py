"""What the pipeline leaves on disk and moves."""

import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import common, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def held(spark):
    """The folders of this application's tables."""
    return {p.parent for p in Path(common.own_dir(spark).removeprefix("file:")).rglob("*.parquet")}


def test_stages_delete_the_tables_of_those_before(spark, small, tmp_path):
    import corpus_pipeline

    docs, kept = spark.read.parquet(f"{small}/documents.parquet"), held(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        own = {p for p in held(spark) - kept if "pipeline-" in str(p)}
        assert own and {p.parent.name for p in own} == {f"pipeline-{name}"}
    assert kept <= held(spark)


def test_a_table_that_is_read_stays(spark):
    with common.tables_in("one"):
        read, other = common.write_shared(spark.range(3), "read"), common.write_shared(spark.range(4), "other")
    common.drop_tables(spark, "one", read.filter("id > 0"))
    assert read.count() == 3 and set(other.inputFiles()) and not any("other-" in str(p) for p in held(spark))


def test_result_of_a_run_outlives_the_next(spark, small):
    import corpus_pipeline

    first = corpus_pipeline.run(spark, small)
    corpus_pipeline.run(spark, small)
    assert first.count() > 0


def test_tallies_only_drop_pairs_that_differ_too_much(spark):
    rng = random.Random(5)
    sets = []
    for _ in range(60):
        base = {rng.getrandbits(63) for _ in range(rng.choice([1, 9, 300, 60_000]))}
        sets.append((base, {x for x in base if rng.random() < 0.95} | {rng.getrandbits(63) for _ in range(len(base) // 20)}))
        sets.append((base, {rng.getrandbits(63) for _ in range(len(base))}))
    packed = [[shingles.tally(np.array(sorted(s), np.int64)) for s in pair] for pair in sets]
    gaps = [r[0] for r in spark.createDataFrame(packed, "a binary, b binary").select(shingles.tally_gap(F.col("a"), F.col("b"))).collect()]
    assert all(g <= len(a ^ b) for g, (a, b) in zip(gaps, sets))
    assert sum(g > (len(a) + len(b)) / 9 for g, (a, b) in zip(gaps, sets) if 9 <= len(a) <= 300 and not a & b) > 5
