"""Assertions on keys, preferences, ranks, verdicts and runs, as tables of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_keys(table: DataFrame, name: str, key: list[str]) -> DataFrame:
    x = table.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return x.select(F.lit(name).alias("check"), F.concat_ws("|", *(F.col(k).cast("string") for k in key)).alias("value"), "n")


def missing_parents(child: DataFrame, name: str, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    p = parents.select(F.col(parent_key).alias(key)).distinct()
    x = child.where(F.col(key).isNotNull()).join(p, key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))
    return x.select(F.lit(name).alias("check"), F.col(key).cast("string").alias("value"), "n")


def bad_formats(table: DataFrame, name: str, column: str, valid: Column) -> DataFrame:
    """Values of a column that are not of its format; null is the business of other checks."""
    x = table.where(F.col(column).isNotNull() & ~valid).groupBy(column).agg(F.count("*").alias("n"))
    return x.select(F.lit(name).alias("check"), F.col(column).cast("string").alias("value"), "n")


def key_violations(digests: DataFrame, cards: DataFrame, bookmarks: DataFrame, user_topics: DataFrame, user_sources: DataFrame, formats: list[tuple[str, DataFrame, str, Column]] = ()) -> DataFrame:
    """(check, value, n) of every value that breaks a key: the unique keys of digests, cards, bookmarks and preferences, the
    parents of cards and bookmarks, and formats(name, table, column, valid), such as ids that must be a uuid."""
    parts = [
        duplicate_keys(digests, "digests.user_date", ["user_id", "date_s"]),
        duplicate_keys(digests, "digests.id", ["id"]),
        duplicate_keys(cards, "cards.id", ["id"]),
        duplicate_keys(bookmarks, "bookmarks.pair", ["user_id", "card_id"]),
        duplicate_keys(user_topics, "user_topics.pair", ["user_id", "topic"]),
        duplicate_keys(user_sources, "user_sources.pair", ["user_id", "source"]),
        missing_parents(cards, "cards.digest_id", "digest_id", digests, "id"),
        missing_parents(bookmarks, "bookmarks.card_id", "card_id", cards, "id"),
        *(bad_formats(table, name, column, valid) for name, table, column, valid in formats),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def preference_errors(user_topics: DataFrame, user_sources: DataFrame, dim_topic: DataFrame, dim_source: DataFrame, users: DataFrame) -> DataFrame:
    """Values that are not curated, and users without a topic or a source."""
    bad = lambda t, d, c, name: t.join(F.broadcast(d.select(c)), c, "left_anti").select("user_id", F.lit(name).alias("error"), F.col(c).alias("value"))
    none = lambda t, name: users.select("user_id").join(t.select("user_id").hint("merge"), "user_id", "left_anti").select("user_id", F.lit(name).alias("error"), F.lit("").alias("value"))
    return bad(user_topics, dim_topic, "topic", "unknown_topic").unionByName(bad(user_sources, dim_source, "source", "unknown_source")).unionByName(none(user_topics, "no_topics")).unionByName(none(user_sources, "no_sources"))


def rank_collisions(cards: DataFrame) -> DataFrame:
    x = cards.where("front_page_rank is not null").groupBy("digest_id", "front_page_rank")
    return x.agg(F.count("*").alias("n")).where("n > 1")


def verdict_accounting(judged: DataFrame) -> DataFrame:
    x = judged.groupBy("run_id").agg(F.count("*").alias("clusters"), F.count_if("notable").alias("passes"), F.count_if(~F.col("notable")).alias("rejects"))
    return x.withColumn("balanced", F.col("passes") + F.col("rejects") == F.col("clusters"))


def overlapping_runs(runs: DataFrame) -> DataFrame:
    """Runs whose window (since_s, at_s] begins before an earlier run of the same user ended: (user_id, run, at_s).

    A running maximum of the ends before, in order of since, finds them without a join of all pairs.
    """
    w = Window.partitionBy("user_id").orderBy("since_s", "at_s", "run").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("before_s", F.max("at_s").over(w)).where("since_s < before_s").drop("before_s")
