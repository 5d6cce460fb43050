"""Whole jobs for all users at once: build an edition, read it, and report its cost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import tier_for_severity, writer_route
from ..operators import edition, ingest, reads, stories, tables, triage, usage
from ..operators.skew import written
from ..sources import feeds


def build_edition(
    articles: DataFrame,
    cursors: DataFrame,
    vectors: DataFrame,
    cards: DataFrame,
    digests: DataFrame,
    same_story: Callable[[DataFrame], DataFrame],
    verdicts: DataFrame,
    generations: DataFrame,
    now_s: int,
    order: list[str],
    attach: float = stories.ATTACH,
    ask: float = stories.ASK,
) -> tuple[DataFrame, DataFrame]:
    """(cards, digests) after a run of every user that has fresh articles.

    First sighting by url and cutoff; articles of a digest that are connected by similarity make a story, under its
    first article's topic; stories that same_story(candidates) calls covered go; the others are dealt into batches,
    judged (no verdict: not notable) and capped by topic; those with a generation that stands become cards, stamped with
    the instant of the run; existing and new cards are ranked for the front page; and all of it is persisted.

    vectors(pos, embedding); cards(digest_id, id, topic, severity, published_s, front_page_rank, created_s, embedding);
    generations as edition.resolve_generations takes them, with card_key the story. An article without a vector is a
    story by itself, and never covered. order must name the ingest order; pos is unique.
    """
    fresh = ingest.recency_cutoff(ingest.first_sighting(articles, order), cursors, now_s)
    fresh = fresh.select(F.concat_ws("/", "user_id", "run_id").alias("digest_id"), "pos", "topic", "title", "snippet", "url", "source", "published_s")
    fresh = written(fresh.join(vectors.select("pos", "embedding").hint("merge"), "pos", "left"))
    of_id = fresh.where("embedding is not null").select("digest_id", F.col("pos").alias("id"), "embedding")
    grouped = written(stories.story_components(fresh.select(F.col("pos").alias("id")), stories.story_pairs(of_id, attach, "digest_id")))
    members = written(fresh.drop("embedding").join(grouped.select(F.col("id").alias("pos"), F.col("story").alias("cluster_pos")).hint("merge"), "pos"))
    clusters = members.where("pos = cluster_pos").select("digest_id", "cluster_pos", "topic", "title")
    clusters = clusters.join(edition.cluster_published_at(members).select("cluster_pos", "published_s").hint("merge"), "cluster_pos")
    clusters = clusters.join(edition.ordered_sources(members, "cluster_pos", ["title", "url", "source", "snippet"]).hint("merge"), "cluster_pos")
    clusters = written(clusters)

    centroids = stories.story_centroid(of_id, grouped).select(F.col("story").alias("cluster_pos"), F.col("centroid").alias("embedding"))
    scope = F.concat_ws("/", "digest_id", "topic").alias("topic")
    vectored = written(clusters.select("cluster_pos", scope).join(centroids.hint("merge"), "cluster_pos"))
    candidates = written(stories.duplicate_candidates(vectored, cards.select(scope, "id", "embedding"), ask))
    kept = stories.drop_covered(clusters, candidates, same_story(candidates))

    judged = triage.align_verdicts(triage.triage_batches(kept.withColumnRenamed("digest_id", "run_id")), verdicts)
    capped = edition.cap_per_topic(judged, ["run_id"]).withColumnRenamed("run_id", "digest_id")
    told = edition.stamp_run(edition.resolve_generations(generations), now_s).select(F.col("card_key").alias("cluster_pos"), F.col("text").alias("short_summary"))
    new = capped.join(told.hint("merge"), "cluster_pos").withColumn("writer", writer_route(F.size("sources")))
    new = written(new.select("digest_id", F.col("cluster_pos").alias("id"), "topic", "title", "severity", "published_s", "batch", "slot", "writer", "sources", "short_summary"))

    pool = edition.rank_pool(cards.select("digest_id", "id", F.col("published_s").alias("pos")), new.select("digest_id", "id", F.col("published_s").alias("pos")))
    shown = ["digest_id", "id", "topic", "severity", "published_s"]
    front = edition.default_front_page(cards.select(*shown).unionByName(new.select(*shown))).select("digest_id", "id", "rank")
    ranked = written(pool.join(front.hint("merge"), ["digest_id", "id"], "left"))
    updates = ranked.where("origin = 0").select("digest_id", "id", F.col("rank").cast("bigint").alias("new_rank"))
    new = new.join(ranked.where("origin = 1").select("digest_id", "id", F.col("rank").cast("bigint").alias("front_page_rank")).hint("merge"), ["digest_id", "id"])
    runs = members.select("digest_id").distinct().withColumn("run_at_s", F.lit(now_s).cast("bigint"))
    return tables.persist_runs(cards.drop("embedding"), digests, new, updates, runs)


def feed_articles(records: DataFrame, planned: DataFrame) -> DataFrame:
    """Each item that could be read, once for every reader whose plan(run_id, user_id, feed_ord, topic, source) of the run
    has its feed: user_id, run_id, feed_ord, file, nth and the article."""
    items = feeds.placed(records.where("good")).drop("good", "record")
    return planned.select("run_id", "user_id", "feed_ord", "topic", "source").hint("merge").join(items.hint("merge"), ["run_id", "feed_ord"])


def edition_from_feeds(
    spark: SparkSession,
    path: str,
    planned: DataFrame,
    place: Column,
    cursors: DataFrame,
    cards: DataFrame,
    digests: DataFrame,
    same_story: Callable[[DataFrame], DataFrame],
    verdicts: DataFrame,
    generations: DataFrame,
    now_s: int,
    attach: float = stories.ATTACH,
    ask: float = stories.ASK,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """build_edition from the feed files landed beneath path on: (cards, digests, failures of planned feeds).

    planned as feed_articles takes it; place is the position of an article in ingest order, unique, from user_id, run_id,
    feed_ord and nth. cards hold title and snippet of what they tell, and ids that no position has; articles and cards are
    embedded together, so that both are weighted by the same counts.
    """
    elements = written(feeds.feed_elements(spark, path))
    records = written(feeds.feed_records(elements, now_s))
    failures = feeds.feed_failures(planned, feeds.landing_manifest(spark, path), elements, records)
    articles = written(feed_articles(records, written(planned)).withColumn("pos", place))
    text = ["topic", "title", "snippet"]
    vectors = written(stories.embed_articles(articles.select("pos", *text).unionByName(cards.select(F.col("id").alias("pos"), *text))))
    known = cards.drop("title", "snippet").join(vectors.select(F.col("pos").alias("id"), "embedding").hint("merge"), "id", "left")
    out = build_edition(articles, cursors, vectors, written(known), digests, same_story, verdicts, generations, now_s, ["pos"], attach, ask)
    return *out, failures


def read_edition(digests: DataFrame, cards: DataFrame, bookmarks: DataFrame, today_s: int, from_s: int | None = None, through_s: int | None = None) -> dict[str, DataFrame]:
    """What readers of all users see: day (cards with bookmark flag, badge, tier, place in the grid, place on the topic's
    page and rank on the front page), saved (the saved list) and history (past days). A range of days prunes the scan of
    day and history."""
    c = cards if from_s is None else cards.where(F.col("date_s") >= from_s)
    c = c if through_s is None else c.where(F.col("date_s") <= through_s)
    day = written(reads.new_run_badge(reads.digest_for_date(digests, c, bookmarks), "digest_id"))
    tiers = day.select(F.col("digest_id").alias("page_id"), F.col("place").alias("pos"), "id", tier_for_severity(F.col("severity")).alias("tier"))
    day = day.join(reads.edition_layout(tiers).withColumnRenamed("page_id", "digest_id").hint("merge"), ["digest_id", "id"])
    day = day.join(reads.topic_order(c).hint("merge"), ["digest_id", "id"])
    day = day.join(reads.front_page(c).select("digest_id", "id", F.col("place").alias("front_place")).hint("merge"), ["digest_id", "id"], "left")
    return {"day": day, "saved": reads.saved_cards(bookmarks, cards, digests), "history": reads.history_dates(digests, c, today_s, from_s, through_s)}


def priced_usage(calls: DataFrame, prices: DataFrame, promos: DataFrame) -> DataFrame:
    """Priced usage of every run, stage and model."""
    return usage.promo_price(usage.usage_by_stage_model(calls), prices, promos)


def cost_report(calls: DataFrame, expected: DataFrame, judged: DataFrame, members: DataFrame, baseline: DataFrame, prices: DataFrame, promos: DataFrame, users: int, days: int) -> dict[str, DataFrame]:
    """The report of all runs: priced usage, its totals, promotion notices, calls against those expected, the order
    statistics of tokens, statistics of verdicts and their acceptance against baseline(metric, low, high), the month's
    spend for so many users and days, and the share of stories (members: topic, cluster_pos) that rest on one source."""
    priced = written(priced_usage(calls, prices, promos))
    per_run = judged.groupBy("run_id").agg(F.avg(F.col("notable").cast("double")).alias("pass_rate"), F.avg(F.when(F.col("notable"), F.col("severity"))).alias("mean_severity"))
    stats = per_run.selectExpr("run_id", "stack(2, 'pass_rate', pass_rate, 'mean_severity', mean_severity) as (metric, value)")
    return {
        "priced": priced,
        "totals": usage.usage_totals(priced),
        "notices": usage.promo_notices(priced, promos),
        "findings": usage.expected_vs_actual(expected, priced),
        "tokens": usage.token_distribution(calls),
        "verdicts": usage.verdict_stats(judged),
        "acceptance": usage.run_acceptance(stats, baseline),
        "projection": usage.cost_projection(priced, users, days),
        "single_source": usage.single_source_share(members),
    }
