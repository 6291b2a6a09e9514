"""The change log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.changes import KEY, SCHEMA, latest


def read(spark: SparkSession, path: str) -> DataFrame:
    """Changes as they are appended."""
    return spark.readStream.schema(SCHEMA).parquet(path)


def once_per_change(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each change id once, within the time that repeats may take to arrive."""
    timed = stream.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return timed.dropDuplicatesWithinWatermark(["cid"])


def write_counts(stream: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Writes per keyspace and window of event time."""
    timed = stream.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "partition", "keyspace", "op").agg(F.count("*").alias("n"))


def keep_state(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Fold every batch into the latest state, one folder per batch.

    Late and repeated changes are harmless: the winner of a key depends on
    times and origins alone. A batch that is run again writes the same folder.
    """
    def fold(batch: DataFrame, epoch: int) -> None:
        own = batch.sparkSession
        new = batch.select(*[f.strip().split()[0] for f in SCHEMA.split(",")])
        old = own.read.schema(SCHEMA).parquet(f"{path}/state-{epoch - 1}") if epoch else own.createDataFrame([], SCHEMA)
        latest(old.unionByName(new), *KEY).select(*new.columns).write.mode("overwrite").parquet(f"{path}/state-{epoch}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
