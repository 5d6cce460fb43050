"""The stored layout of cards and digests: partitioned by date, bucketed by digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table; both tables have as many, so a digest's rows are joined where they lie.
BUCKETS = 16


def _save(rows: DataFrame, table: str, key: str, path: str, buckets: int) -> None:
    # Rows go to the task of their bucket first, so that each date has one file a bucket and not one a task.
    dealt = rows.repartition(buckets, key)
    dealt.write.format("parquet").partitionBy("date_s").bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(table)


def store_editions(cards: DataFrame, digests: DataFrame, prefix: str, folder: str, buckets: int = BUCKETS) -> None:
    """Save cards(digest_id, date_s, ...) and digests(id, date_s, ...) as tables <prefix>_cards and <prefix>_digests beneath folder."""
    _save(cards, f"{prefix}_cards", "digest_id", f"{folder}/{prefix}_cards", buckets)
    _save(digests, f"{prefix}_digests", "id", f"{folder}/{prefix}_digests", buckets)


def stored_editions(spark: SparkSession, prefix: str, from_s: int | None = None, through_s: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(cards, digests) of the stored tables, of these dates alone, both ends inclusive: other partitions are not read, and
    joins and windows by digest do not shuffle."""
    tables = []
    for name in ("cards", "digests"):
        x = spark.table(f"{prefix}_{name}")
        x = x if from_s is None else x.where(F.col("date_s") >= from_s)
        tables.append(x if through_s is None else x.where(F.col("date_s") <= through_s))
    return tables[0], tables[1]
