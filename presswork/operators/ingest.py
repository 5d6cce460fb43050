"""From feeds to fresh articles, for all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import plausible_cursor

LOOKBACK_S = 48 * 3600


def feed_plan(user_topics: DataFrame, user_sources: DataFrame, dim_feed: DataFrame, dim_topic: DataFrame) -> DataFrame:
    """The feeds to read for each user: those of their topics, kept where they chose the source, in curated order."""
    ordered = F.broadcast(dim_topic.select("topic", F.col("ord").alias("topic_ord")))
    wanted = user_topics.select("user_id", "topic").distinct().join(F.broadcast(dim_feed), "topic").join(ordered, "topic")
    return wanted.join(user_sources.select("user_id", "source").hint("merge"), ["user_id", "source"], "left_semi")


def first_sighting(articles: DataFrame, order: list[str]) -> DataFrame:
    """The first article of each url and user in ingest order; all empty urls count as one url."""
    seen = Window.partitionBy("user_id", "url").orderBy(*order)
    return articles.withColumn("nth", F.row_number().over(seen)).where("nth = 1").drop("nth")


def cutoff_of(cursor_s: Column, now_s: Column) -> Column:
    """The later of the lookback's start and a plausible cursor."""
    start = now_s - LOOKBACK_S
    return F.when(plausible_cursor(cursor_s, now_s) & (cursor_s > start), cursor_s).otherwise(start)


def recency_cutoff(articles: DataFrame, cursors: DataFrame, now_s: int) -> DataFrame:
    """Articles published at or after the cutoff of their user."""
    cut = cursors.select("user_id", "cursor_s")
    kept = articles.join(cut, "user_id", "left").withColumn("cutoff_s", cutoff_of(F.col("cursor_s"), F.lit(now_s)))
    return kept.where("published_s >= cutoff_s").drop("cursor_s", "cutoff_s")


def preferred_sources_only(articles: DataFrame, user_sources: DataFrame) -> DataFrame:
    return articles.join(user_sources.select("user_id", "source"), ["user_id", "source"], "left_semi")


def late_articles(articles: DataFrame, cursors: DataFrame, now_s: int) -> DataFrame:
    """Articles before the cutoff, which no later run takes up."""
    kept = articles.join(cursors.select("user_id", "cursor_s"), "user_id", "left")
    return kept.where(F.col("published_s") < cutoff_of(F.col("cursor_s"), F.lit(now_s))).drop("cursor_s")
