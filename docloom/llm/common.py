"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the corpus contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The folder within the application's own that tables are written to.
_FOLDER: ContextVar[str] = ContextVar("folder", default="")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, from ``spark.checkpoint.dir``. Where
    none is configured a temporary one is set, on a local master only (tests):
    executors on other machines would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/docloom/{spark.sparkContext.applicationId}"


@contextmanager
def tables_in(folder: str) -> Iterator[None]:
    """What ``write_shared`` writes meanwhile goes to a folder of that name."""
    before = _FOLDER.set(f"{_FOLDER.get()}/{folder}")
    try:
        yield
    finally:
        _FOLDER.reset(before)


def drop_tables(spark: SparkSession, folder: str, but: DataFrame) -> None:
    """Delete the tables of ``tables_in(folder)`` that ``but`` doesn't read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{own_dir(spark)}{_FOLDER.get()}/{folder}")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return
    read = {file.rsplit("/", 2)[1] for file in but.inputFiles()}
    for table in store.listStatus(path):
        if table.getPath().getName() not in read:
            store.delete(table.getPath(), True)


def write_shared(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the
    lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}{_FOLDER.get()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def clear_shared(spark: SparkSession) -> None:
    """Delete this application's tables of ``write_shared``, once no result
    needs them; those of others stay."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_fold(doc_id: str | Column = "doc_id") -> Column:
    """True for the rows held out of label learning: crc32 of the id's text is
    divisible by 5. A null id counts as held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def small_side(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast only where the counted rows are within ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int = 7
) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``per_class`` labelled rows a class.

    Held-out rows and rows without id, text or label take no part. Which rows
    are kept follows from a hash of the id, so reruns agree.
    """
    d = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & ~crc_fold())
    y = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(
        F.col("label").isin(0, 1)
    )
    y = y.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64("doc_id", F.lit(seed))
    kept = None
    for value in (0, 1):
        one = y.filter((F.col("label") == value) & ~crc_fold()).orderBy(order, "doc_id").limit(per_class)
        kept = one if kept is None else kept.unionByName(one)
    return d.join(F.broadcast(kept), "doc_id")
