"""Quality by compression: which of two dictionaries shrinks a text more.

One zstandard dictionary is built from labelled good texts and one from bad
texts. A text is compressed with each, in pieces of ``PIECE_BYTES`` so that
what it repeats itself says nothing; the difference of the two sizes,
normalised and calibrated by a logistic curve on other labelled texts, is its
score. The dictionaries are built and the other texts compressed on executors:
the driver gets two dictionaries and two numbers a labelled text. Every text
is scored whole.

Defined cases: null and empty texts compress alike with both dictionaries, so
their difference is zero and they get its calibrated score; equal texts get
equal scores, and repeated rows are returned as often as they occur; labelled
rows that repeat are fitted on as often as they occur, an id marked both ways
counts as marked 1, and rows without id, text or mark take no part in fitting;
columns beyond those named are never read, whatever their names; an empty
table gives an empty result. Without labels of both classes every score is 0.5.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import crc_fold, labelled_sample, write_shared

#: Labelled rows a class from which dictionaries and calibration are fitted.
SAMPLE_ROWS = 3000
#: Bytes of one dictionary, and of the sampled texts that train it; a text of
#: over a 16th of the latter trains none.
DICTIONARY_BYTES = 112_640
TRAINING_BYTES = 12_000_000
#: Bytes that are compressed at once, and zstandard's level.
PIECE_BYTES, LEVEL = 256, 3


@lru_cache(maxsize=8)
def _compressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False
    )


def difference(text: str | None, good: bytes, bad: bytes) -> tuple[float, float]:
    """Size with the bad dictionary less that with the good one, normalised by
    the sum of both and by the text's length."""
    data = (text or "").encode()
    pieces = [data[at : at + PIECE_BYTES] for at in range(0, len(data), PIECE_BYTES)] or [b""]
    g, b = (sum(len(c.compress(p)) for p in pieces) for c in (_compressor(good), _compressor(bad)))
    return (b - g) / (b + g), (b - g) / (len(data) + 20)


def build_dictionary(texts: list[bytes]) -> bytes:
    """A dictionary trained on texts; the texts' end, where they are too few."""
    import zstandard

    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, texts)) // 60)), texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICTIONARY_BYTES:].ljust(8, b" ")


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    """Slopes and intercept by Newton's method, slightly regularised."""
    scale = np.where(np.std(x, axis=0) > 0, np.std(x, axis=0), 1.0)
    z = np.column_stack([x / scale, np.ones(len(x))])
    beta, ridge = np.zeros(z.shape[1]), 1e-3 * np.eye(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return [*map(float, beta[:-1] / scale), float(beta[-1])]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_ROWS) -> dict | None:
    """Dictionaries and calibration; None without labels of both classes.

    Half of the sample, dealt by a hash of the id, trains the dictionaries and
    the other half the calibration, weighted to the classes' share of labels.
    """
    sample = write_shared(labelled_sample(docs, labels, label, per_class).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2))), "labelled")
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id", "text")  # at most per_class rows
    size = F.octet_length("text")
    training = sample.filter((F.col("half") == 0) & (size > 0) & (size <= TRAINING_BYTES // 16)).withColumn("upto", F.sum(size).over(order)).filter(F.col("upto") <= TRAINING_BYTES)

    def built(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [t.encode() for t in pdf.sort_values("upto")["text"]]
        return pd.DataFrame({"label": pdf["label"].iloc[:1], "made": [build_dictionary(texts)]})

    made = {r["label"]: r["made"] for r in training.select("label", "text", "upto").groupBy("label").applyInPandas(built, "label int, made binary").collect()}
    made = {v: bytes(made.get(v, b" " * 8)) for v in (0, 1)}

    def differences(batches):
        for pdf in batches:
            x = np.array([difference(t, made[1], made[0]) for t in pdf["text"]]).reshape(-1, 2)
            yield pd.DataFrame({"half": pdf["half"], "label": pdf["label"], "by_size": x[:, 0], "by_length": x[:, 1]})

    rows = sample.select("half", "label", "text").mapInPandas(differences, "half long, label int, by_size double, by_length double").toPandas()
    if rows["label"].nunique() < 2:
        return None
    held = rows[rows["half"] == 1]
    held = (held if held["label"].nunique() == 2 else rows).sort_values(["label", "by_size", "by_length"])
    share = {r["label"]: r["n"] for r in labels.filter(F.col(label).isin(0, 1) & ~crc_fold()).groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    y = held["label"].to_numpy(float)
    weight = np.array([share[int(v)] / max(1, (y == v).sum()) for v in y])
    return {"good": made[1], "bad": made[0], "curve": fit_logistic(held[["by_size", "by_length"]].to_numpy(), y, weight / weight.mean())}


def score(text: Column, model: dict | None) -> Column:
    """The calibrated probability of label 1."""
    if model is None:
        return F.lit(0.5)
    good, bad, (*slopes, base) = (model[k] for k in ("good", "bad", "curve"))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        found = np.array([difference(t, good, bad) for t in texts]).reshape(-1, len(slopes))
        return pd.Series(1 / (1 + np.exp(-np.clip(found @ slopes + base, -30, 30))))

    return scored(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", cut: float = 0.3, model: dict | None = None) -> DataFrame:
    """``(row struct, score, predicted)`` of every row."""
    fitted = model or train(docs, labels, label)
    return docs.select(F.struct("*").alias("row"), score(F.col("text"), fitted).alias("score")).withColumn(
        "predicted", (F.col("score") >= cut).cast("int")
    )
