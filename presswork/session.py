"""The Spark session that tests, the bench and local runs share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str = "8", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session with UTC time, adaptive execution and no console noise. Driver and executors are one process, so
    its checkpoint folder may be a temporary one; a cluster names its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("presswork")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
