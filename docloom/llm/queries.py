"""The corpus operators as registered queries over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bitsliced, kmeans_tree, lines, mixing, packing, pii, quality, secrets, simhash, toxicity
from docloom.llm.common import crc_fold


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymised(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("row.doc_id", "row.text", "n_entities")


def op3_bitsliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return bitsliced.top_products(rows, rows.filter("vec_id % 50 = 0"), 5)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), "line_no", "class_id", F.col("first").alias("kept"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.classify(docs, _table(spark, sf_dir, "labels"), "toxic", 0.5, columns=["doc_id"])
    return scored.select("row.doc_id", crc_fold("row.doc_id").alias("held_out"), "score", "predicted", "neighbours")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["order"] < len(secrets.BASE))
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "row.doc_id",
        *[count(rule.kind) for rule in secrets.BASE],
        F.sha2(secrets.as_text(base).cast("binary"), 256).alias("base_sha256"),
        secrets.as_text(F.col("spans")).alias("spans"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, _table(spark, sf_dir, "labels"), "quality", 0.3)
    return scored.select("row.doc_id", crc_fold("row.doc_id").alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kmeans_tree": op1_kmeans_tree,
    "op2_surrogates": op2_surrogates,
    "op3_bitsliced": op3_bitsliced,
    "op4_simhash": op4_simhash,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_secrets": op9_secrets,
    "op10_quality": op10_quality,
}

def _found_sql(rule: secrets.Rule, order: int) -> str:
    """A rule's spans as a list of structs, in DuckDB's words."""
    pattern = rule.pattern.replace("'", "''")
    length = "lambda s: length(s)"
    add = lambda xs: f"coalesce(list_sum(list_transform({xs}, {length})), 0)"
    pieces, found, kept = f"string_split_regex(t, '{pattern}')", f"regexp_extract_all(t, '{pattern}')", f"regexp_extract_all(t, '{pattern}', {rule.group})"
    start = f"{add('x.p[1:i]')} + {add('x.m[1:i - 1]')}"
    one = f"{{'s': CAST({start} AS BIGINT), 'o': {order}, 'e': CAST({start} + length(x.m[i]) AS BIGINT), 'k': '{rule.kind}', 'n': length(x.k[i])}}"
    whole = f"(SELECT list_transform(range(1, len(x.m) + 1), lambda i: {one}) FROM (SELECT {{'p': {pieces}, 'm': {found}, 'k': {kept}}} AS x))"
    return f"list_transform(list_filter({whole}, lambda z: z.n >= {rule.least}), lambda z: {{'s': z.s, 'o': z.o, 'e': z.e, 'k': z.k}})"


_SPANS = "list_concat(" + ", ".join(_found_sql(r, i) for i, r in enumerate(secrets.BASE + secrets.ADDED)) + ")"
_TEXT = "coalesce(array_to_string(list_transform({}, lambda z: z.k || ':' || z.s || ':' || z.e), ','), '')"
_BASE = f"list_filter(x, lambda z: z.o < {len(secrets.BASE)})"

SQL: dict[str, str] = {
    "op3_bitsliced": """
        WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
          WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
          FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op9_secrets": f"""
        SELECT doc_id, {", ".join(f"CAST(len(list_filter(x, lambda z: z.k = '{r.kind}')) AS BIGINT) AS n_{r.kind}" for r in secrets.BASE)},
          sha256({_TEXT.format(_BASE)}) AS base_sha256, {_TEXT.format("x")} AS spans
        FROM (SELECT doc_id, list_sort({_SPANS}) AS x FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""",
}
