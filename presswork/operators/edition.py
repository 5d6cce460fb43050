"""From judged clusters to an edition: the cap by topic, cards, the front page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import generation_disposition

CAP, FRONT = 8, 6


def cap_per_topic(judged: DataFrame, scope: list[str] | None = None, most: int = CAP) -> DataFrame:
    """The notable clusters of each run and topic, at most eight, by severity and then input order."""
    w = Window.partitionBy(*(scope or ["run_id"]), "topic").orderBy(F.desc("severity"), "cluster_pos")
    return judged.where("notable").withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= most)


def topic_cuts(judged: DataFrame, most: int = CAP) -> DataFrame:
    """Of each topic over the cap: how many were notable and dropped, and the severities (1 to 5) of the dropped."""
    w = Window.partitionBy("run_id", "topic").orderBy(F.desc("severity"), "cluster_pos")
    x = judged.where("notable").withColumn("slot", F.row_number().over(w))
    gone = [F.count_if((F.col("slot") > most) & (F.col("severity") == s)).cast("int").alias(f"gone{s}") for s in range(1, 6)]
    x = x.groupBy("run_id", "topic").agg(F.count_if(F.col("slot") > most).alias("dropped"), F.count("*").alias("total"), *gone)
    severities = F.flatten(F.array(*(F.array_repeat(F.lit(s), F.col(f"gone{s}")) for s in range(5, 0, -1))))
    return x.where("dropped > 0").select("run_id", "topic", "dropped", "total", severities.alias("severities"))


def cluster_published_at(articles: DataFrame) -> DataFrame:
    """The article of each cluster published last, the first of equals."""
    latest = F.max_by(F.struct("pos", "published_s"), F.struct("published_s", -F.col("pos")))
    return articles.groupBy("cluster_pos").agg(latest.alias("a")).select("cluster_pos", F.col("a.pos").alias("pos"), F.col("a.published_s").alias("published_s"))


def ordered_sources(articles: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row a key with its sources as an ordered array of structs."""
    items = F.array_sort(F.collect_list(F.struct("pos", *fields)))
    drop_pos = F.transform("items", lambda s: F.struct(*(s[f].alias(f) for f in fields)))
    return articles.groupBy(key).agg(items.alias("items")).select(key, drop_pos.alias("sources"))


def resolve_generations(generations: DataFrame) -> DataFrame:
    """One row a card with the disposition and the text of the attempt that stands, null if none does."""
    first = generations.where("attempt = 1").select("card_key", F.col("text").alias("t1"), F.col("stop_reason").alias("s1"))
    second = generations.where("attempt = 2").select("card_key", F.col("text").alias("t2"))
    x = first.join(second, "card_key", "left")
    x = x.withColumn("disposition", generation_disposition(F.col("t1"), F.col("s1"), F.col("t2")))
    return x.withColumn("text", F.when(F.col("disposition") == "first", F.col("t1")).when(F.col("disposition") == "retry", F.col("t2")))


def stamp_run(resolved: DataFrame, run_at_s: int) -> DataFrame:
    """The generations that stand, all stamped with the instant of their run."""
    return resolved.where("disposition in ('first', 'retry')").withColumn("created_s", F.lit(run_at_s).cast("bigint"))


def rank_pool(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The candidates for the front page of each digest: existing cards, then new ones, numbered from 0."""
    both = existing.select("digest_id", "id", F.lit(0).alias("origin"), F.col("pos")).unionByName(new.select("digest_id", "id", F.lit(1).alias("origin"), F.col("pos")))
    w = Window.partitionBy("digest_id").orderBy("origin", "pos", "id")
    return both.withColumn("pool_pos", F.row_number().over(w) - 1)


def front_page_picks(responses: DataFrame, most: int = FRONT) -> DataFrame:
    """responses(run_id, pool_size, picks array<struct<index, rank>>) -> (run_id, pool_pos, rank) for every candidate.

    Picks are taken in order; one is skipped if its index is outside of the pool, or its index or rank was taken by a
    pick accepted before. A candidate without a pick has rank null. A run whose picks are null ranks nothing at all.
    """
    ran = responses.where("picks is not null")
    taken = lambda acc, p: F.exists(acc, lambda a: (a["index"] == p["index"]) | (a["rank"] == p["rank"]))
    start = F.lit(None).cast("array<struct<index:int,rank:int>>")
    start = F.coalesce(start, F.array().cast("array<struct<index:int,rank:int>>"))
    valid = F.filter("picks", lambda p: (p["index"] >= 0) & (p["index"] < F.col("pool_size")) & (p["rank"] >= 1) & (p["rank"] <= most))
    accepted = F.aggregate(valid, start, lambda acc, p: F.when(taken(acc, p), acc).otherwise(F.array_append(acc, F.struct(p["index"].alias("index"), p["rank"].alias("rank")))))
    x = ran.select("run_id", "pool_size", accepted.alias("accepted"))
    x = x.select("run_id", "accepted", F.explode(F.when(F.col("pool_size") > 0, F.sequence(F.lit(0), F.col("pool_size") - 1)).otherwise(F.array().cast("array<int>"))).alias("pool_pos"))
    mine = F.filter("accepted", lambda a: a["index"] == F.col("pool_pos"))
    return x.select("run_id", "pool_pos", F.get(mine, F.lit(0))["rank"].alias("rank"))


def rank_alignment(pool: DataFrame, ranks: DataFrame) -> DataFrame:
    """Ranks back on their cards by pool position; runs that were not ranked give no rows."""
    return pool.hint("merge").join(ranks.hint("merge"), ["digest_id", "pool_pos"]).select("digest_id", "id", "origin", F.col("rank").alias("front_page_rank"))


def apply_rank_updates(cards: DataFrame, updates: DataFrame) -> DataFrame:
    """Cards named in updates(id, new_rank) take that rank, null included; others keep theirs; unknown ids do nothing."""
    x = cards.join(updates.select("id", "new_rank", F.lit(True).alias("hit")), "id", "left")
    rank = F.when(F.col("hit"), F.col("new_rank")).otherwise(F.col("front_page_rank"))
    return x.withColumn("front_page_rank", rank).drop("hit", "new_rank")


def merge_snapshot(previous: DataFrame, updates: DataFrame, new: DataFrame) -> DataFrame:
    return apply_rank_updates(previous, updates).unionByName(new)


def default_front_page(cards: DataFrame, most: int = FRONT) -> DataFrame:
    """A stand-in where no picks are given: the best of every topic before the second best of any."""
    best = [F.desc("severity"), F.desc("published_s"), F.asc("id")]
    x = cards.withColumn("topic_rn", F.row_number().over(Window.partitionBy("digest_id", "topic").orderBy(*best)))
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("digest_id").orderBy("topic_rn", *best)))
    return x.where(F.col("rank") <= most).drop("topic_rn")
