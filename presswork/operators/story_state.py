"""Stories that live across runs: sums of vectors kept as state, advanced by each batch of articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .skew import written
from .stories import ATTACH, assign_to_stories, story_components, story_pairs

STATE = "topic string, story long, total array<double>, n long"


def no_stories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def centroids(state: DataFrame) -> DataFrame:
    """(topic, story, centroid): the mean of all articles that a story ever took, not made unit length again."""
    return state.select("topic", "story", F.transform("total", lambda x: x / F.col("n")).alias("centroid"))


def _sums(members: DataFrame, vector: str, n: str) -> DataFrame:
    """The sum of the vectors and of n of each story; sums combine before they shuffle."""
    x = members.select("topic", "story", n, F.posexplode(vector).alias("dim", "x"))
    x = x.groupBy("topic", "story", "dim").agg(F.sum(F.col("x").cast("double")).alias("x"), F.sum(n).alias("n"))
    return x.groupBy("topic", "story").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("total"), F.max("n").alias("n"))


def advance(state: DataFrame, articles: DataFrame, attach: float = ATTACH, recall: float | None = None) -> tuple[DataFrame, DataFrame]:
    """One batch: (assigned, state) from state(topic, story, total, n) and articles(id, topic, embedding).

    An article joins the best story of its topic, by the centroids as they were before the batch, if it is similar enough.
    The others are compared with each other, and what is connected opens a story under its smallest id. assigned is
    (id, topic, story, sim, is_new), with sim null in new stories; state holds the sums after the batch, so its size is
    that of the stories and not of the articles. Within a batch the order of articles does not matter. An article without
    a vector or topic is a story by itself, and leaves no state. ids are unique over all batches. With recall, new
    articles are compared by bands of hyperplanes; see story_pairs. Both results are written tables.
    """
    found = written(assign_to_stories(articles, centroids(state), attach))
    matched = found.where("story is not null").withColumn("is_new", F.lit(False))
    open_ids = found.where("story is null").select("id")
    fresh = written(articles.select("id", "topic", "embedding").join(open_ids.hint("merge"), "id", "left_semi"))
    grouped = story_components(fresh, story_pairs(fresh, attach, recall=recall))
    new = fresh.select("id", "topic").join(grouped.hint("merge"), "id").select("id", "topic", "story", F.lit(None).cast("double").alias("sim"), F.lit(True).alias("is_new"))
    assigned = written(matched.unionByName(new))
    members = articles.where("embedding is not null and topic is not null").select("id", "embedding").join(assigned.hint("merge"), "id")
    added = _sums(members.withColumn("n", F.lit(1).cast("long")), "embedding", "n")
    return assigned, written(_sums(state.select("topic", "story", "total", "n").unionByName(added), "total", "n"))
