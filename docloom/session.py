"""Session construction with the settings the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Spark settings under which expressions behave as documented (lenient casts
#: and divisions, left-associative set operators, UTC clock).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "false",
    "spark.sql.legacy.setopsPrecedence.enabled": "true",
    "spark.sql.caseSensitive": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app: str = "docloom", cpus: str | None = None, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    n = cpus or os.environ.get("BENCH_CPUS", "*")
    builder = SparkSession.builder.master(f"local[{n}]").appName(app)
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**SETTINGS, **defaults, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
