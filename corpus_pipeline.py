"""From raw documents to packed sequences, stage by stage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import lines, mixing, packing, shingles, toxicity
from docloom.llm.common import drop_tables, tables_in, write_shared
from docloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.classify(docs, labels, "toxic", 0.5).filter("predicted = 0").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; sizes follow the text."""
    done = lines.deduplicated(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in done.columns else done


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: found by SimHash and BK-trees, and by shingles where
    fingerprints can't reach; confirmed by four fifths of their five-word shingles in common."""
    return shingles.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mixing.mix(docs).filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place in it."""
    return packing.pack(docs, tokenizer_path())


WORK = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]


def _alone(k: int) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that deletes the tables of the stages before it, but for those
    that its documents are read from: their results have been written by then."""
    name, work = WORK[k]

    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for before, _ in WORK[:k]:
            drop_tables(spark, f"pipeline-{before}", docs)
        with tables_in(f"pipeline-{name}"):
            return work(spark, docs, sf_dir)

    return stage


#: Each stage's result is to be written before the next stage is called.
STAGES = [(name, _alone(k)) for k, (name, _) in enumerate(WORK)]

#: The scores and hashes of the stages have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with tables_in(f"run-{uuid.uuid4().hex}"):
        for name, stage in STAGES[:-1]:
            done = stage(spark, docs, sf_dir)
            with tables_in(f"pipeline-{name}"):
                docs = write_shared(done, name)
        return STAGES[-1][1](spark, docs, sf_dir)
