"""Progress events as JSON lines, and the table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "run_id bigint, seq bigint, stage string, at_s bigint, article_count bigint, cluster_count bigint, notable_count bigint, message string"


def read_progress_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON-lines files; blank and unreadable lines, such as a cut-off last one, are left out."""
    x = spark.read.schema(EVENT + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return x.where(F.col("stage").isNotNull()).drop("_corrupt_record")


def parse_progress_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    x = lines.where(F.trim(text) != "").select(F.from_json(text, EVENT).alias("e")).select("e.*")
    return x.where("stage is not null")


def progress_lines(events: DataFrame) -> DataFrame:
    """Each event as one line of JSON without null fields."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def write_progress_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace the partitions that df has rows of, or the whole table where it has none."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    w.parquet(path)
