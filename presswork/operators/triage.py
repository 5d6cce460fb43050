"""Batching clusters for judgement, and cleaning and aligning the verdicts that come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BATCH, DEPTH = 20, 2


def triage_batches(clusters: DataFrame) -> DataFrame:
    """Per run and topic, batches of at most twenty whose sizes differ by at most one, the larger first."""
    w = Window.partitionBy("run_id", "topic")
    x = clusters.withColumns({"i": F.row_number().over(w.orderBy("cluster_pos")) - 1, "n": F.count("*").over(w)})
    x = x.withColumn("batches", F.ceil(F.col("n") / BATCH))
    x = x.withColumns({"size": F.floor(F.col("n") / F.col("batches")), "larger": F.col("n") % F.col("batches")})
    head = F.col("larger") * (F.col("size") + 1)
    batch = F.when(F.col("i") < head, F.floor(F.col("i") / (F.col("size") + 1))).otherwise(F.col("larger") + F.floor((F.col("i") - head) / F.col("size")))
    at = F.when(F.col("i") < head, F.col("i") % (F.col("size") + 1)).otherwise((F.col("i") - head) % F.col("size"))
    return x.withColumns({"batch": batch.cast("bigint"), "batch_pos": at.cast("bigint")}).drop("i", "n", "batches", "size", "larger")


def batch_contexts(batched: DataFrame) -> DataFrame:
    """(run_id, topic, batch, clusters, text) from triage_batches with the context of each cluster: what a judge reads, numbered
    from 0 within the batch, as its answer refers to them. A batch is at most twenty clusters."""
    lines = F.array_sort(F.collect_list(F.struct("batch_pos", F.concat(F.col("batch_pos").cast("string"), F.lit(". "), F.coalesce("context", F.lit(""))).alias("line"))))
    x = batched.groupBy("run_id", "topic", "batch").agg(F.count("*").alias("clusters"), F.transform(lines, lambda s: s["line"]).alias("lines"))
    return x.select("run_id", "topic", "batch", "clusters", F.array_join("lines", "\n\n").alias("text"))


def first_verdict_wins(responses: DataFrame) -> DataFrame:
    """responses(batch_id, batch_size, verdicts array<struct<index, notable, severity>>): one verdict an index.

    Indexes outside of the batch are dropped; of several for an index the first in the response stands.
    """
    x = responses.select("batch_id", "batch_size", F.posexplode("verdicts").alias("nth", "v")).select("batch_id", "batch_size", "nth", "v.*")
    x = x.where((F.col("index") >= 0) & (F.col("index") < F.col("batch_size")))
    w = Window.partitionBy("batch_id", "index").orderBy("nth")
    return x.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "nth", "batch_size")


def align_verdicts(clusters: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One outcome a cluster; a cluster without a verdict is not notable, severity 1."""
    v = verdicts.select("cluster_pos", "notable", "severity")
    x = clusters.join(v, "cluster_pos", "left")
    return x.withColumns({"notable": F.coalesce("notable", F.lit(False)), "severity": F.coalesce("severity", F.lit(1))})


def retry_split(batches: DataFrame, verdicts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The clusters of a batch without a verdict, split again in halves, the first one larger: columns half1..depth.

    Each further half is that of the first try at which the cluster, still unjudged, would be asked again.
    """
    keys = ["run_id", "topic", "batch"]
    x = batches.join(verdicts.select("cluster_pos"), "cluster_pos", "left_anti")
    for level in range(1, depth + 1):
        w = Window.partitionBy(*keys)
        x = x.withColumns({"rn": F.row_number().over(w.orderBy("cluster_pos")), "n": F.count("*").over(w)})
        x = x.withColumn(f"half{level}", F.when(F.col("rn") > F.ceil(F.col("n") / 2), 1).otherwise(0)).drop("rn", "n")
        keys.append(f"half{level}")
    return x
